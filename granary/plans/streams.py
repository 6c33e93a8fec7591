"""Streaming jobs over the test tables; each equals its batch counterpart."""

from pyspark.sql import functions as F

from granary.operators import monitoring as O
from granary.plans.cleaning import _BATCH, _spellings
from granary.plans.labels import P
from granary.plans.ledger import CUT, KNOWN, RES1, _RES_COLS, _RES_OUT, _res, known
from granary.plans.registry import query
from granary.session import materialize, scratch_path
from granary.sources import adapters as A
from granary.streaming import jobs as R


@query("m01_stream_ingest_observations", f"""
WITH {_BATCH.strip()}
SELECT commodity, market, variety, reported_date, modal_price, arrivals FROM final""")
def m01(spark, folder):
    lines = R.read_folder_stream(spark, folder, "lineitem.parquet")
    table = R.observation_table(spark, scratch_path(spark, "current"), buckets=2)
    return R.stream_ingest_observations(A.raw_observations(spark, folder, lines), *_spellings(spark, folder), table,
                                        scratch_path(spark, "ingest-checkpoint"))


def _by_date(spark, df, steps: int):
    """Write a frame as files of rising dates, one after the other, and read them as they came, two per micro-batch."""
    path = scratch_path(spark, "dated-feed")
    df = materialize(df, "feed")
    low, high = df.agg(F.min(F.unix_date("reported_date")), F.max(F.unix_date("reported_date"))).first()
    step = F.floor((F.unix_date("reported_date") - low) * steps / max(high - low + 1, 1))
    for i in range(steps):
        df.filter(step == i).coalesce(1).write.mode("append").parquet(path)
    return R.read_folder_stream(spark, path, "*.parquet", df.schema, 2)


def _obs_stream(spark, df, files: int):
    """Write a frame as several files and read them back one per micro-batch."""
    path = scratch_path(spark, "obs-feed")
    df.repartition(files, "market").write.parquet(path)
    return R.read_folder_stream(spark, path, "*.parquet", df.schema, 2)


@query("m02_stream_outcome_maturity", f"""
WITH {KNOWN},
{RES1}
SELECT {_RES_COLS}, CASE status WHEN 'EVALUATED' THEN 'observation in window' WHEN 'TARGET_UNAVAILABLE' THEN 'window closed without observation' END AS reason,
{_RES_OUT}
FROM r1""")
def m02(spark, folder):
    ledger = A.forecast_ledger(spark, folder)
    issued = scratch_path(spark, "issued")
    ledger.write.parquet(issued)
    ledger = spark.read.parquet(issued)
    forecasts = R.read_folder_stream(spark, issued, "*.parquet", ledger.schema)
    feed = _by_date(spark, known(spark, folder).select(*R.OBS_KEY, P), 6)
    outcomes, progress = R.outcome_table(spark, scratch_path(spark, "outcomes"), 4), R.progress_table(spark, scratch_path(spark, "progress"), 4)
    R.stream_outcome_maturity(forecasts, feed, outcomes, progress, scratch_path(spark, "maturity-checkpoint"))
    return _res(R.apply_maturity(ledger, outcomes.snapshot(), progress.snapshot()))


@query("m03_stream_freshness_drift", f"""
WITH w AS (SELECT DATE '1970-01-01' + CAST(floor((reported_date - DATE '1970-01-01') / 7) * 7 AS INTEGER) AS week, commodity, count(*) AS n,
  avg({P}) AS m, max(reported_date) AS latest_date FROM @obs@ GROUP BY ALL)
SELECT CAST(week AS DATE) AS week, commodity, n, latest_date, abs(m - 2420.5) > 2 * 620.3 AS drift,
  ~m AS mean_price
FROM w""")
def m03(spark, folder):
    feed = _obs_stream(spark, A.observations(spark, folder).select(*R.OBS_KEY, P), 4)
    return R.stream_freshness_drift(feed, O.commodity_baselines(spark))


@query("m03_stream_service_rollup", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, 'svc' || (user_id % 4) AS service, count(*) AS total,
  count(*) FILTER (event_type = 'error') AS errors, max(value) AS max_latency FROM events GROUP BY ALL""")
def m03s(spark, folder):
    events = R.read_folder_stream(spark, folder, "events.parquet").select(
        "ts", F.col("value").alias("latency"), (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("svc"), (F.col("user_id") % 4).cast("string")).alias("service"))
    return R.stream_service_rollup(events)
