"""Streaming ingest, outcome maturity and rollups.

Ingest and maturity merge every micro-batch into a keyed table (``sources.keyed``) under
the batch's id, so a restart or a retry never counts a row twice and no batch reads
more of the table than it changes. Rollups write a folder per micro-batch. No
watermark drops late rows on the ingest path; maturity keeps forecasts open for a
stated lateness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from granary.functions.distributed import first_by
from granary.operators import cleaning as C
from granary.operators import ledger as K
from granary.schemas import OBS_KEY, OBSERVATION, SERIES
from granary.session import scratch_path
from granary.sources.keyed import KeyedTable


def read_folder_stream(spark: SparkSession, folder: str, glob: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder that match the glob."""
    schema = schema or spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def start_log(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], log: str, checkpoint: str,
              output_mode: str = "append") -> StreamingQuery:
    """Process what is available now and append each transformed micro-batch to the log."""
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
    return (stream.writeStream.foreachBatch(write).outputMode(output_mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_log(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], name: str,
            output_mode: str = "append") -> DataFrame:
    """Run to the end of the available input and return the log."""
    spark = stream.sparkSession
    log = scratch_path(spark, f"{name}-log")
    start_log(stream, transform, log, scratch_path(spark, f"{name}-checkpoint"), output_mode).awaitTermination()
    return spark.read.parquet(log)


# --- keyed tables ------------------------------------------------------------------------

def merge_stream(stream: DataFrame, table: KeyedTable, transform: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Merge each transformed micro-batch into a keyed table, as the version of its batch id, until the input ends."""
    query = (stream.writeStream.foreachBatch(lambda batch, batch_id: table.merge(transform(batch), batch_id) and None)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


# --- ingest ----------------------------------------------------------------------------

CURRENT = T.StructType([*(f for f in OBSERVATION.fields if f.name in OBS_KEY), *(f for f in OBSERVATION.fields if f.name in ("modal_price", "arrivals"))])


def observation_table(spark: SparkSession, folder: str, buckets: int = 16, **options) -> KeyedTable:
    """Current observations: per series and day the highest price, then the largest arrivals, in buckets per year."""
    return KeyedTable(spark, folder, CURRENT, OBS_KEY, lambda rows, keys: first_by(rows, keys, ["modal_price", "arrivals"], keep_last=True),
                      buckets, period="reported_date", period_format="yyyy", **options)


def stream_ingest_observations(raw: DataFrame, markets: DataFrame, varieties: DataFrame, table: KeyedTable, checkpoint: str) -> DataFrame:
    """Raw text rows into the table of current observations; a micro-batch costs the buckets that it touches."""
    merge_stream(raw, table, lambda b: C.normalize_batch(b, markets, varieties), checkpoint)
    return table.snapshot()


# --- maturity ----------------------------------------------------------------------------

HIT = T.StructType().add("forecast_id", "string").add("day", "date").add("price", "double")
PROGRESS = T.StructType([*(f for f in OBSERVATION.fields if f.name in SERIES)]).add("latest", "date")


def outcome_table(spark: SparkSession, folder: str, buckets: int = 16, **options) -> KeyedTable:
    """The earliest observation in the window of each forecast that has one."""
    return KeyedTable(spark, folder, HIT, ["forecast_id"], lambda rows, keys: first_by(rows, keys, ["day", "price"]), buckets, **options)


def progress_table(spark: SparkSession, folder: str, buckets: int = 16, **options) -> KeyedTable:
    """The last day reported of each series."""
    return KeyedTable(spark, folder, PROGRESS, SERIES, lambda rows, keys: rows.groupBy(*keys).agg(F.max("latest").alias("latest")), buckets, **options)


def window_hits(forecasts: DataFrame, obs: DataFrame, lateness: str = "60 days", longest_window: int = 31) -> DataFrame:
    """Streams of issued forecasts and of observations to a stream of (forecast_id, day, price).

    An interval join with state on both sides. A forecast leaves the state when no observation up to ``lateness`` before
    the latest one can be in its window any more; an observation leaves it when no forecast with a window of up to
    ``longest_window`` days can reach back to it. The state is bounded by open forecasts and recent days. Reports
    that come later than ``lateness`` are left to the batch resolution with ``recheck``.
    """
    left = forecasts.select("forecast_id", *SERIES, F.col("window_start").cast("timestamp").alias("opens_at"),
                            F.col("window_end").cast("timestamp").alias("closes_at")).withWatermark("closes_at", "0 days").alias("f")
    right = obs.select(*SERIES, F.col("reported_date").cast("timestamp").alias("seen_at"), F.col("modal_price").alias("price")).withWatermark(
        "seen_at", lateness).alias("o")
    same = [F.col(f"f.{c}") == F.col(f"o.{c}") for c in SERIES]
    return left.join(right, [*same, F.expr("o.seen_at >= f.opens_at"), F.expr("o.seen_at <= f.closes_at"),
                             F.expr(f"f.closes_at <= o.seen_at + INTERVAL {int(longest_window)} DAYS")]).select(
        "forecast_id", F.col("seen_at").cast("date").alias("day"), "price")


def stream_outcome_maturity(forecasts: DataFrame, obs: DataFrame, outcomes: KeyedTable, progress: KeyedTable, checkpoint: str,
                            **options) -> StreamingQuery:
    """Read what is new of both streams into the two tables; called again, it goes on where it stopped.

    Returns the finished query of the interval join. Both tables take their micro-batches under the batch's id.
    """
    query = merge_stream(window_hits(forecasts, obs, **options), outcomes, lambda b: b, f"{checkpoint}/hits")
    merge_stream(obs.select(*SERIES, F.col("reported_date").alias("latest")), progress, lambda b: b, f"{checkpoint}/progress")
    return query


def apply_maturity(ledger: DataFrame, hits: DataFrame, progress: DataFrame) -> DataFrame:
    """New ledger snapshot from the two tables, by the rules of the batch resolution."""
    ledger = K._with_outcome_columns(ledger)
    rows = ledger.join(hits.select("forecast_id", F.col("day").alias("_date"), F.col("price").alias("_price")), "forecast_id", "left").join(
        progress.select(*SERIES, F.col("latest").alias("_latest")), list(SERIES), "left")
    closed = F.coalesce(F.col("_latest") > F.col("window_end"), F.lit(False))
    return K._resolved(rows, ledger.columns, F.col("status") == "PENDING", closed, {
        "late": F.lit("late observation"), "match": F.lit("observation in window"),
        "closed": F.lit("window closed without observation")})


# --- rollups -------------------------------------------------------------------------------

def _last_complete(log: DataFrame) -> DataFrame:
    last = log.agg(F.max("batch")).scalar()
    return log.filter(F.col("batch") == last).drop("batch")


def stream_freshness_drift(obs_stream: DataFrame, baselines: DataFrame, width: str = "7 days") -> DataFrame:
    """Weekly counts, mean price and latest date per commodity, with the 2-sd drift flag.

    Complete mode keeps one small state row per week and commodity, so a late
    report corrects its week whenever it comes.
    """
    ts = F.col("reported_date").cast("timestamp_ntz")
    agg = obs_stream.groupBy(F.window(ts, width).alias("w"), "commodity").agg(
        F.count("*").alias("n"), F.sum("modal_price").alias("s"), F.max("reported_date").alias("latest_date"))
    flat = agg.select(F.col("w.start").cast("date").alias("week"), "commodity", "n", (F.col("s") / F.col("n")).alias("mean_price"),
                      "latest_date")
    out = _last_complete(run_log(flat, lambda b: b, "freshness", "complete"))
    base = baselines.select("commodity", "price_mean", "price_std")
    return out.join(base, "commodity", "left").select(
        "week", "commodity", "n", "mean_price", "latest_date",
        (F.abs(F.col("mean_price") - F.col("price_mean")) > 2 * F.col("price_std")).alias("drift"))


def stream_service_rollup(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Daily request, error and mean-latency counts per event service."""
    agg = events.groupBy(F.window("ts", width).alias("w"), "service").agg(
        F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("errors"), F.max("latency").alias("max_latency"))
    flat = agg.select(F.col("w.start").cast("date").alias("day"), "service", "total", "errors", "max_latency")
    return _last_complete(run_log(flat, lambda b: b, "service", "complete"))
