"""Canonical tables built from the order-and-lineitem test tables.

Unit prices are rounded to whole currency units. That keeps every sum exact in
doubles whatever the order of addition, and bounds the distinct prices of one
market day, so the exact median of a hot day fits in one aggregation buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import price_forecast_id
from granary.functions.windows import series_window
from granary.sources.tables import table


def _market_lines(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    lines = table(spark, folder, "lineitem") if lines is None else lines
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    # both are dimension tables; the optimizer broadcasts them only below its size threshold
    return (lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("price", F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("double"))
            .withColumn("day", F.col("l_shipdate").cast("date")))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """obs: one row per (commodity, market, variety, day)."""
    lines = _market_lines(spark, folder)
    key = [F.lit("rice").alias("commodity"), F.col("n_name").alias("market"),
           F.col("l_returnflag").alias("variety"), F.col("day").alias("reported_date")]
    # first collapse equal prices, so a hot day reaches its final task as few weighted values
    prices = lines.groupBy(*key, "price").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    return (prices.groupBy("commodity", "market", "variety", "reported_date")
            .agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"),
                 F.percentile("price", F.lit(0.5), F.col("n")).alias("modal_price"),
                 F.sum("qty").alias("arrivals")))


def raw_observations(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """obs_raw: one text row per line item (batch or stream) with dirt placed by the part key."""
    lines = _market_lines(spark, folder, lines)
    m = F.col("l_partkey") % 50
    price = F.col("price").cast("long")
    low, high = price - F.col("l_linenumber") * 2, price + F.col("l_linenumber") * 3
    text = lambda c: c.cast("string")
    day = F.col("day")
    return lines.select(
        F.lit("rice").alias("commodity"),
        F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")).alias("state"),
        F.col("n_name").alias("district"),
        F.when(m == 15, F.lower("n_name")).when(m == 16, F.concat(F.lit("  "), "n_name", F.lit(" ")))
        .when(m == 17, F.concat(F.lit("Haat "), F.col("n_nationkey").cast("string")))
        .otherwise(F.col("n_name")).alias("market"),
        F.col("l_returnflag").alias("variety"),
        F.when(F.col("l_linestatus") == "F", " Cereals").otherwise("PULSES").alias("group"),
        F.when(m == 18, F.lit(None).cast("string")).when(m == 19, "-4").when(m == 21, "nan").when(m == 22, "1e999")
        .when(m == 23, "125e-002")
        .otherwise(text(F.col("l_quantity").cast("long"))).alias("arrivals"),
        F.when(m == 11, "0").when(m == 13, text(high)).otherwise(text(low)).alias("min_price"),
        F.when(m == 12, "0").when(m == 13, text(low)).otherwise(text(high)).alias("max_price"),
        F.when(m == 7, "N/A").when(m == 8, "0").when(m == 9, "-5").when(m == 14, text(high + 1))
        .otherwise(text(price)).alias("modal_price"),
        F.when(m == 3, "not a date").when(m == 25, F.date_format(day, "yyyy-02-31"))
        .when(m == 20, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(m == 24, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(m == 28, F.date_format(day, "yyyy-M-d")).when(m == 32, F.date_format(day, "yyyy/MM/dd"))
        .when(m == 36, F.date_format(day, "dd-MMM-yyyy")).when(m == 40, F.date_format(day, "d MMMM yyyy"))
        .when(m == 44, F.date_format(day, "MMM d, yyyy")).when(m == 48, F.date_format(day, "dd/MM/yy"))
        .when(m % 4 == 1, F.date_format(day, "dd MMM yyyy"))
        .when(m % 4 == 2, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("reported_date"))


def _nation_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("district"), F.col("o_orderdate").cast("date").alias("date"),
                    F.floor(F.col("o_totalprice") + 0.5).cast("double").alias("total")))


def yield_panel(spark: SparkSession, folder: str) -> DataFrame:
    """panel: district x season x year with area, production (tonnes) and yield (kg per ha)."""
    month = F.month("date")
    season = (F.when(month <= 4, "Summer").when(month <= 8, "Autumn").otherwise("Winter"))
    grouped = (_nation_orders(spark, folder)
               .groupBy("district", season.alias("season"), F.year("date").alias("year"))
               .agg(F.count("*").cast("double").alias("area"), (F.sum("total") / 1000).alias("production")))
    return grouped.withColumn("yield_kg_ha", F.col("production") / F.col("area") * 1000)


def daily_weather(spark: SparkSession, folder: str) -> DataFrame:
    """weather: district x day; every 97th day of a district (by epoch day) is missing as -999.

    Scales are powers of two, so sums of the values stay exact in doubles too.
    """
    days = (_nation_orders(spark, folder).groupBy("district", "date", "total").agg(F.count("*").alias("n"))
            .groupBy("district", "date")
            .agg(F.sum("n").alias("n"), F.percentile("total", F.lit(0.5), F.col("n")).alias("med"),
                 F.min("total").alias("lo"), F.max("total").alias("hi")))
    missing = F.unix_date("date") % 97 == 0
    put = lambda c, name: F.when(missing, F.lit(-999.0)).otherwise(c.cast("double")).alias(name)
    return days.select(
        "district", "date",
        put(F.col("n"), "precip"), put(F.col("med") / 8192, "t2m"), put(F.col("lo") / 8192, "t2m_min"),
        put(F.col("hi") / 8192, "t2m_max"), put(F.col("n") % 101, "rh2m"),
        put(F.dayofyear("date") / 8.0, "solar"), put(F.unix_date("date") % 7, "wind"))


def service_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


def forecast_ledger(spark: SparkSession, folder: str, every: int = 30, horizons=(14, 30),
                    tolerance: int = 3) -> DataFrame:
    """PENDING persistence forecasts issued at each 30th row of a series."""
    w = series_window()
    rows = observations(spark, folder).select(
        "commodity", "market", "variety", "reported_date", "modal_price",
        F.row_number().over(w).alias("rn"))
    issued = (rows.filter(F.col("rn") % every == 0)
              .select("commodity", "market", "variety", F.col("reported_date").alias("origin_date"),
                      F.col("modal_price").alias("origin_price"),
                      F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")))
    start = F.date_add("origin_date", F.col("horizon"))
    return issued.select(
        price_forecast_id(F.col("market"), F.col("variety"), F.col("origin_date"), F.col("horizon"),
                          F.lit("persistence")).alias("forecast_id"),
        "commodity", "market", "variety", "origin_date", "horizon", "origin_price",
        F.col("origin_price").alias("predicted_price"),
        start.alias("window_start"), F.date_add(start, tolerance).alias("window_end"),
        F.when(F.year("origin_date") < 2000, "RETROSPECTIVE").otherwise("PROSPECTIVE").alias("cohort"),
        F.lit("PENDING").alias("status"))
