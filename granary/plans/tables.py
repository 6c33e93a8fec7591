"""Sources, sinks and table maintenance."""

from pyspark.sql import functions as F

from granary.operators import upserts as U
from granary.plans.registry import DAY_SQL, query
from granary.schemas import OBS_KEY, SERIES, WEATHER_COLUMNS
from granary.session import scratch_path
from granary.sources import adapters as A
from granary.sources import tables as S


@query("a01_read_observations", """
SELECT commodity, variety, "group", market, count(*) AS n, count(arrivals) AS with_arrivals,
  min(reported_date) AS min_text, max(reported_date) AS max_text
FROM @obs_raw@ GROUP BY ALL""")
def a01(spark, folder):
    # written as market files and read back through the reader; the commodity is the folder's name
    raw = A.raw_observations(spark, folder).drop("commodity")
    path = scratch_path(spark, "market-files")
    raw.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/rice")
    return S.read_observations(spark, f"{path}/*", raw.schema).groupBy("commodity", "variety", "group", "market").agg(
        F.count("*").alias("n"), F.count("arrivals").alias("with_arrivals"),
        F.min("reported_date").alias("min_text"), F.max("reported_date").alias("max_text"))


@query("a02_read_weather_json", """
SELECT district, date,
  ~CASE WHEN precip <> -999 THEN precip END AS precip,
  ~CASE WHEN t2m <> -999 THEN t2m END AS t2m,
  ~CASE WHEN t2m_min <> -999 THEN t2m_min END AS t2m_min,
  ~CASE WHEN t2m_max <> -999 THEN t2m_max END AS t2m_max,
  ~CASE WHEN rh2m <> -999 THEN rh2m END AS rh2m,
  ~CASE WHEN solar <> -999 THEN solar END AS solar,
  ~CASE WHEN wind <> -999 THEN wind END AS wind
FROM @weather@""".replace("SELECT district, date,\n", "SELECT district, date,\n"))
def a02(spark, folder):
    # documents of one district and year (366 days at most), as the weather service delivers them
    days = A.daily_weather(spark, folder)
    ymd = F.date_format("date", "yyyyMMdd")
    maps = [F.map_from_entries(F.collect_list(F.struct(ymd, F.col(c)))).alias(p)
            for p, c in WEATHER_COLUMNS.items()]
    docs = days.groupBy("district", F.year("date").alias("y")).agg(*maps)
    payload = F.to_json(F.struct(F.struct(F.struct(*WEATHER_COLUMNS).alias("parameter")).alias("properties")))
    return S.parse_weather_payload(docs.select("district", payload.alias("payload")))


@query("a03_unpivot_wide", """
SELECT district, year, season, floor(production / 1000 * 1e4 + 0.5) / 1e4 AS ndvi FROM @panel@
WHERE production IS NOT NULL""")
def a03(spark, folder):
    panel = A.yield_panel(spark, folder).withColumn(
        "cell", F.concat_ws("_", F.lit("NDVI"), F.col("year").cast("string"), "season"))
    # the columns of the wide table: one per year and season that occur, a calendar's worth
    cells = sorted(r[0] for r in panel.select("cell").distinct().collect())
    wide = panel.groupBy("district").pivot("cell", cells).agg(F.first(F.col("production") / 1000))
    return S.unpivot_wide(wide, ["district"], "NDVI", "ndvi")


RAW_NAMES = {"state": "State Name", "district": "District Name", "market": "MARKET NAME", "variety": "Variety",
             "arrivals": "Arrivals (Tonnes)", "modal_price": "Modal Price (Rs./Quintal)",
             "reported_date": "Reported Date"}


def _raw_named(spark, folder):
    return A.raw_observations(spark, folder).select(
        *[F.col(c).alias(n) for c, n in RAW_NAMES.items()], F.lit("2024-01-01").alias("created_at"))


@query("a04_normalize_columns", """
SELECT state, district, market, variety, arrivals, modal_price, reported_date, count(*) AS n
FROM @obs_raw@ GROUP BY ALL""")
def a04(spark, folder):
    df = S.normalize_columns(_raw_named(spark, folder))
    return df.groupBy(*df.columns).agg(F.count("*").alias("n"))


@query("a05_require_columns", """
SELECT market, variety, count(*) AS n, 0.0::DOUBLE AS arrivals_total FROM @obs_raw@ GROUP BY ALL""")
def a05(spark, folder):
    df = S.normalize_columns(_raw_named(spark, folder).drop("Arrivals (Tonnes)"))
    df = S.require_columns(df, ["market", "variety", "reported_date", "modal_price"])
    return df.groupBy("market", "variety").agg(F.count("*").alias("n"), F.sum("arrivals").alias("arrivals_total"))


@query("a06_parse_dates", f"""
SELECT {DAY_SQL} AS reported_date,
  count(*) AS n, count(DISTINCT reported_date) AS spellings
FROM @obs_raw@ GROUP BY 1""")
def a06(spark, folder):
    raw = A.raw_observations(spark, folder).groupBy("reported_date").agg(F.count("*").alias("n"))
    return (raw.select(S.parse_dates(F.col("reported_date")).alias("d"), "n")
            .groupBy(F.col("d").alias("reported_date")).agg(F.sum("n").alias("n"), F.count("*").alias("spellings")))


@query("a07_parse_double", """
SELECT modal_price AS text, TRY_CAST(modal_price AS DOUBLE) AS value, count(*) AS n
FROM @obs_raw@ GROUP BY ALL
UNION ALL
SELECT arrivals, CASE WHEN isfinite(TRY_CAST(arrivals AS DOUBLE)) THEN TRY_CAST(arrivals AS DOUBLE) END, count(*)
FROM @obs_raw@ GROUP BY ALL""")
def a07(spark, folder):
    raw = A.raw_observations(spark, folder)
    count = lambda c: raw.groupBy(F.col(c).alias("text")).agg(F.count("*").alias("n"))
    both = count("modal_price").unionByName(count("arrivals"))
    return both.select("text", S.parse_double(F.col("text")).alias("value"), "n")


@query("a08_extract_subset", """
SELECT state, market, variety, reported_date, modal_price, count(*) AS n FROM @obs_raw@
WHERE contains(lower(trim(state)), 'region_1') AND lower(trim("group")) = 'cereals' GROUP BY ALL""")
def a08(spark, folder):
    sub = S.extract_subset(A.raw_observations(spark, folder), "Region_1 ", "CEREALS")
    return sub.groupBy("state", "market", "variety", "reported_date", "modal_price").agg(F.count("*").alias("n"))


@query("a09_write_table", """
SELECT commodity, market, variety, reported_date, min_price, max_price, modal_price, arrivals FROM @obs@""")
def a09(spark, folder):
    path = scratch_path(spark, "obs")
    S.write_table(A.observations(spark, folder), path, ("commodity", "variety"))
    return spark.read.parquet(path).select(
        "commodity", "market", "variety", "reported_date", "min_price", "max_price", "modal_price", "arrivals")


@query("a10_export_group_mappings", """
WITH t AS (SELECT * FROM @typed@ WHERE reported_date <= DATE '1999-12-31')
SELECT 'market' AS kind, market AS value, count(*) AS n FROM t GROUP BY ALL
UNION ALL SELECT 'variety', variety, count(*) FROM t GROUP BY ALL
UNION ALL SELECT 'combination', market || '|' || variety, count(*) FROM t GROUP BY ALL""")
def a10(spark, folder):
    df = S.typed_observations(A.raw_observations(spark, folder))
    return U.group_mappings(df, ["market", "variety"], "reported_date", F.lit("1999-12-31").cast("date"))


# target: the table before 2000; batch: rows of the typed raw table from mid 1999 on
def _target_and_batch(spark, folder):
    obs = A.observations(spark, folder).select(*OBS_KEY, "modal_price", "arrivals")
    target = obs.filter(F.col("reported_date") < "2000-01-01")
    batch = (S.typed_observations(A.raw_observations(spark, folder))
             .filter((F.col("reported_date") >= "1999-06-01") & (F.col("modal_price") > 0))
             .select(*OBS_KEY, "modal_price", "arrivals"))
    return target, batch


_BATCH = """
target AS (SELECT commodity, market, variety, reported_date, modal_price, arrivals FROM @obs@
           WHERE reported_date < DATE '2000-01-01'),
batch AS (SELECT commodity, market, variety, reported_date, modal_price, arrivals FROM @typed@
          WHERE reported_date >= DATE '1999-06-01' AND modal_price > 0),
fresh AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY commodity, market, variety, reported_date
            ORDER BY modal_price NULLS FIRST, arrivals NULLS FIRST) AS rn FROM batch) WHERE rn = 1
          AND (commodity, market, variety, reported_date) NOT IN (
            SELECT (commodity, market, variety, reported_date) FROM target))"""


@query("a11_upsert_keep_first", f"""
WITH {_BATCH.strip()}
SELECT *, false AS inserted FROM target UNION ALL SELECT *, true FROM fresh""")
def a11(spark, folder):
    target, batch = _target_and_batch(spark, folder)
    return U.upsert_keep_first(target, batch).withColumnRenamed("_inserted", "inserted")


@query("a11_upsert_counts", f"""
WITH {_BATCH.strip()}
SELECT (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM batch) - (SELECT count(*) FROM fresh) AS duplicates,
  (SELECT count(*) FROM target) + (SELECT count(*) FROM fresh) AS total""")
def a11c(spark, folder):
    target, batch = _target_and_batch(spark, folder)
    return U.upsert_counts(U.upsert_keep_first(target, batch), batch)


@query("a12_upsert_last_wins", f"""
WITH {_BATCH.strip()},
b AS (SELECT *, reported_date + 400 AS created FROM batch),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commodity, market, variety, reported_date
           ORDER BY created DESC, modal_price DESC, arrivals DESC NULLS LAST) AS rn FROM b) WHERE rn = 1)
SELECT coalesce(l.commodity, t.commodity) AS commodity, coalesce(l.market, t.market) AS market,
  coalesce(l.variety, t.variety) AS variety, coalesce(l.reported_date, t.reported_date) AS reported_date,
  CASE WHEN l.market IS NOT NULL THEN l.modal_price ELSE t.modal_price END AS modal_price,
  CASE WHEN l.market IS NOT NULL THEN l.arrivals ELSE t.arrivals END AS arrivals,
  CAST(CASE WHEN t.market IS NOT NULL THEN t.reported_date ELSE l.created END AS DATE) AS created_at
FROM target t FULL JOIN last l USING (commodity, market, variety, reported_date)""")
def a12(spark, folder):
    target, batch = _target_and_batch(spark, folder)
    return U.upsert_last_wins(target.withColumn("created_at", F.col("reported_date")),
                              batch.withColumn("created_at", F.date_add("reported_date", 400)),
                              ["modal_price", "arrivals"])


@query("a12_batch_acceptance", """
SELECT count(*) AS offered, count(*) FILTER (modal_price > 0 AND reported_date IS NOT NULL) AS accepted,
  count(*) FILTER (NOT coalesce(modal_price > 0 AND reported_date IS NOT NULL, false)) AS rejected FROM @typed@""")
def a12b(spark, folder):
    return U.batch_acceptance(S.typed_observations(A.raw_observations(spark, folder)))


@query("a13_ingestion_summary", """
WITH log AS (SELECT commodity, 'run-' || strftime(m, '%Y-%m') AS run_id, CAST(last_day(m) AS DATE) AS finished_on,
    n - bad AS inserted, bad AS rejected, n % 7 AS duplicates, CASE WHEN bad * 5 > n THEN 'PARTIAL' ELSE 'OK' END AS status
  FROM (SELECT commodity, date_trunc('month', reported_date) AS m, count(*) AS n,
          count(*) FILTER (NOT coalesce(modal_price > 0, false)) AS bad FROM @typed@
        WHERE reported_date IS NOT NULL GROUP BY ALL)
  UNION ALL SELECT 'rice', 'run-final', DATE '2002-01-01', 0, 0, 0, 'EMPTY')
SELECT commodity, count(*) AS runs, max_by(run_id, (finished_on, run_id)) AS latest_run,
  max_by(status, (finished_on, run_id)) AS latest_status, max(finished_on) AS latest_finished_on,
  CAST(sum(inserted) AS BIGINT) AS total_inserted, CAST(sum(duplicates) AS BIGINT) AS total_duplicates,
  CAST(sum(rejected) AS BIGINT) AS total_rejected,
  (SELECT count(*) FROM @obs@) AS observations, (SELECT count(DISTINCT market) FROM @obs@) AS markets,
  (SELECT max(reported_date) FROM @obs@) AS latest_date
FROM log GROUP BY commodity""")
def a13(spark, folder):
    typed = S.typed_observations(A.raw_observations(spark, folder)).filter("reported_date IS NOT NULL")
    ok = F.coalesce(F.col("modal_price") > 0, F.lit(False))
    monthly = typed.groupBy("commodity", F.trunc("reported_date", "month").alias("m")).agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("bad"))
    log = monthly.select(
        "commodity", F.concat(F.lit("run-"), F.date_format("m", "yyyy-MM")).alias("run_id"),
        F.last_day("m").alias("finished_on"), (F.col("n") - F.col("bad")).alias("inserted"),
        F.col("bad").alias("rejected"), (F.col("n") % 7).alias("duplicates"),
        F.when(F.col("bad") * 5 > F.col("n"), "PARTIAL").otherwise("OK").alias("status"))
    final = spark.range(1).select(
        F.lit("rice").alias("commodity"), F.lit("run-final").alias("run_id"),
        F.lit("2002-01-01").cast("date").alias("finished_on"), F.lit(0).cast("long").alias("inserted"),
        F.lit(0).cast("long").alias("rejected"), F.lit(0).cast("long").alias("duplicates"),
        F.lit("EMPTY").alias("status"))
    return U.ingestion_summary(U.append_audit(log, final), A.observations(spark, folder))


def _stores(spark, folder):
    w = A.daily_weather(spark, folder)
    d = F.unix_date("date")
    return w.filter(d % 3 != 0), w.filter(d % 2 == 0).withColumn("precip", F.col("precip") + 1000)


_FILL = """
cal AS (SELECT district, CAST(unnest(generate_series(DATE '1998-05-01', DATE '1998-07-31', INTERVAL 1 DAY)) AS DATE) AS date
        FROM (SELECT DISTINCT district FROM @weather@)),
w AS (SELECT *, date - DATE '1970-01-01' AS d FROM @weather@),
filled AS (SELECT cal.district, cal.date, CASE WHEN c.date IS NOT NULL THEN c.precip ELSE a.precip + 1000 END AS precip,
    CASE WHEN c.date IS NOT NULL THEN c.t2m ELSE a.t2m END AS t2m,
    CASE WHEN c.date IS NOT NULL THEN 'cache' WHEN a.date IS NOT NULL THEN 'archive' ELSE 'missing' END AS source
  FROM cal LEFT JOIN (SELECT * FROM w WHERE d % 3 <> 0) c USING (district, date)
    LEFT JOIN (SELECT * FROM w WHERE d % 2 = 0) a USING (district, date))"""


def _filled(spark, folder):
    cache, archive = _stores(spark, folder)
    districts = A.yield_panel(spark, folder).select("district").distinct()
    return U.weather_gap_fill(cache, archive, districts, "1998-05-01", "1998-07-31", ["precip", "t2m"])


@query("a14_weather_gap_fill", f"""
WITH {_FILL.strip()}
SELECT district, date, source,
  ~precip AS precip,
  ~t2m AS t2m
FROM filled""")
def a14(spark, folder):
    return _filled(spark, folder)


@query("a14_weather_fill_report", f"""
WITH {_FILL.strip()}
SELECT district, count(*) AS expected_days, count(*) FILTER (source = 'cache') AS cache_days,
  count(*) FILTER (source = 'archive') AS archive_days, count(*) FILTER (source = 'missing') AS missing_days,
  ~count(*) FILTER (source <> 'missing') / count(*) AS completeness,
  coalesce(string_agg(CASE WHEN source = 'missing' THEN strftime(date, '%Y-%m-%d') END, ',' ORDER BY date), '') AS missing_list,
  CASE WHEN count(*) FILTER (source = 'cache') > 0 AND count(*) FILTER (source = 'archive') > 0 THEN 'mixed'
       WHEN count(*) FILTER (source = 'cache') > 0 THEN 'cache'
       WHEN count(*) FILTER (source = 'archive') > 0 THEN 'archive' ELSE 'none' END AS source_label
FROM filled GROUP BY district""")
def a14r(spark, folder):
    return U.weather_fill_report(_filled(spark, folder))


@query("a15_weather_store_stats", """
WITH s AS (SELECT *, CASE WHEN (date - DATE '1970-01-01') % 3 <> 0 THEN 'cache' ELSE 'archive' END AS source FROM @weather@)
SELECT source, count(*) AS row_count, count(DISTINCT district) AS districts, min(date) AS first_date, max(date) AS last_date
FROM s GROUP BY source
UNION ALL SELECT 'all', count(*), count(DISTINCT district), min(date), max(date) FROM s""")
def a15(spark, folder):
    store = A.daily_weather(spark, folder).withColumn(
        "source", F.when(F.unix_date("date") % 3 != 0, "cache").otherwise("archive"))
    return U.weather_store_stats(store)
