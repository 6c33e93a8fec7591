"""Keyed tables, upserts that leave the target in place, and streams cut into any micro-batches."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.distributed import first_by
from granary.functions.scalars import parse_dates
from granary.operators import ledger as K
from granary.operators import upserts as U
from granary.session import materialize
from granary.sources.keyed import KeyedTable
from granary.streaming import jobs as R

D = dt.date
SCHEMA = T.StructType().add("k", "string").add("day", "date").add("v", "long")


@pytest.fixture
def place():
    return tempfile.mkdtemp(prefix="granary-keyed-")


def highest(rows, keys):
    return first_by(rows, keys, ["v"], keep_last=True)


def plain(rows):
    best = {}
    for k, day, v in rows:
        best[k, day] = max(v, best.get((k, day), v))
    return sorted((k, day, v) for (k, day), v in best.items())


def held(table):
    return sorted(tuple(r) for r in table.snapshot().select("k", "day", "v").collect())


def test_keyed_table_equals_one_batch(spark, place):
    draw = random.Random(1)
    rows = [(draw.choice("abcdef"), D(2020, draw.randint(1, 6), draw.randint(1, 28)), draw.randint(0, 99)) for _ in range(600)]
    table = KeyedTable(spark, place, SCHEMA, ["k", "day"], highest, buckets=3, period="day")
    for version, at in enumerate(range(0, 600, 150)):
        table.merge(spark.createDataFrame(rows[at:at + 150], SCHEMA), version)
        assert held(table) == plain(rows[:at + 150])
        # the same batch again, as after a lost acknowledgement, changes nothing
        assert table.merge(spark.createDataFrame(rows[at:at + 150], SCHEMA), version) == []
    assert table.versions() == [2, 3]
    assert KeyedTable(spark, place, SCHEMA, ["k", "day"], highest, 3, "day").manifest() == table.manifest()


def test_batch_reads_and_writes_only_its_buckets(spark, place):
    table = KeyedTable(spark, place, SCHEMA, ["k", "day"], highest, buckets=2, period="day")
    table.merge(spark.createDataFrame([(f"k{i}", D(2020, m, 1), i) for i in range(40) for m in range(1, 9)], SCHEMA), 0)
    before = table.manifest()
    assert len(before) == 16
    reads = []
    rows_of = table.rows_of
    table.rows_of = lambda manifest: (reads.append(sorted(manifest)), rows_of(manifest))[1]
    touched = table.merge(spark.createDataFrame([("k1", D(2020, 8, 1), 500), ("new", D(2020, 9, 1), 1)], SCHEMA), 1)
    assert len(touched) == 2 and reads == [[b for b in touched if b in before]] and len(reads[0]) == 1
    after = table.manifest()
    assert {b for b in after if after[b] != before.get(b)} == set(touched)
    assert sum(f"v={1}/" in f for f in table.snapshot().inputFiles()) == 2
    # an empty batch is a version, too, and rewrites nothing
    assert table.merge(spark.createDataFrame([], SCHEMA), 2) == [] and table.manifest() == after and table.versions() == [1, 2]


def test_unfinished_version_is_overwritten_and_old_ones_go(spark, place):
    table = KeyedTable(spark, place, SCHEMA, ["k", "day"], highest, buckets=1)
    table.merge(spark.createDataFrame([("a", D(2020, 1, 1), 1)], SCHEMA), 0)
    commit, table._commit = table._commit, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError, match="lost"):
        table.merge(spark.createDataFrame([("a", D(2020, 1, 1), 7)], SCHEMA), 1)
    assert held(table) == [("a", D(2020, 1, 1), 1)]
    table._commit = commit
    table.merge(spark.createDataFrame([("a", D(2020, 1, 1), 5)], SCHEMA), 1)
    assert held(table) == [("a", D(2020, 1, 1), 5)]
    for version in (2, 3, 4):
        table.merge(spark.createDataFrame([("a", D(2020, 1, 1), 10 + version)], SCHEMA), version)
    assert held(table) == [("a", D(2020, 1, 1), 14)]
    assert not table._store.exists(table._path("v=2", "bucket=0")) and table._store.exists(table._path("v=3", "bucket=0"))


OBS = "commodity string, market string, variety string, reported_date date, modal_price double, arrivals double"


def _obs(rows, spark):
    return spark.createDataFrame([("rice", m, "A", D(2020, 1, 1) + dt.timedelta(days=n), float(p), a) for m, n, p, a in rows], OBS)


@pytest.mark.parametrize("kind", ["first", "last"])
def test_upsert_does_not_shuffle_the_target(spark, kind, monkeypatch):
    target = materialize(_obs([(f"m{i}", n, 100 + i, None) for i in range(20) for n in range(50)], spark), "target-table")
    batch = _obs([("m1", 3, 7, 1.0), ("m1", 3, 9, 2.0), ("m1", 77, 5, None), ("zz", 1, 4, None)], spark)
    plans = []
    stored_keys = U._stored_keys

    def kept_plan(*args):
        monkeypatch.setattr(U, "materialize", lambda df, name="stage": (plans.append(df._jdf.queryExecution().executedPlan().toString()), materialize(df, name))[1])
        found = stored_keys(*args)
        monkeypatch.setattr(U, "materialize", materialize)
        return found
    monkeypatch.setattr(U, "_stored_keys", kept_plan)
    if kind == "first":
        merged = U.upsert_keep_first(target, batch, order=["modal_price"])
    else:
        merged = U.upsert_last_wins(target.withColumn("created_at", F.lit(1)), batch.withColumn("created_at", F.lit(2)), ["modal_price", "arrivals"])
    plans.append(merged._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2
    for plan in plans:
        assert "target-table" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert "GreaterThanOrEqual(reported_date,2020-01-02)" in plans[0]
    rows = {(r.market, r.reported_date.day, r.reported_date.month): r for r in merged.collect()}
    assert len(rows) == 1002 and rows["zz", 2, 1].modal_price == 4
    assert rows["m1", 4, 1].modal_price == (101 if kind == "first" else 9)


def test_last_wins_with_null_keys_and_repeats(spark):
    target = spark.createDataFrame([("a", None, 1, 1), ("b", 2, 2, 1)], "k string, n int, v int, created_at int")
    batch = spark.createDataFrame([("a", None, 5, 7), ("a", None, 6, 8), (None, 3, 9, 9), (None, 3, 8, 4)], target.schema)
    got = sorted((tuple(r) for r in U.upsert_last_wins(target, batch, ["v"], keys=["k", "n"]).collect()), key=str)
    assert got == sorted([("a", None, 6, 1), ("b", 2, 2, 1), (None, 3, 9, 4)], key=str)
    assert U.upsert_last_wins(target, batch.limit(0), ["v"], keys=["k", "n"]).count() == 2
    assert U.upsert_last_wins(target.limit(0), batch, ["v"], keys=["k", "n"]).count() == 2


def _ledger(spark):
    draw = random.Random(4)
    rows = []
    for i in range(120):
        start = D(2020, 1, 1) + dt.timedelta(days=draw.randint(5, 300))
        rows.append((f"f{i}", "rice", f"m{i % 6}", "A", start - dt.timedelta(days=14), 14, 100.0, 101.0, start, start + dt.timedelta(days=3), "PENDING"))
    return spark.createDataFrame(rows, "forecast_id string, commodity string, market string, variety string, origin_date date, horizon int, origin_price double, "
                                 "predicted_price double, window_start date, window_end date, status string")


def _append(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_maturity_equals_the_batch_after_any_cut_and_restarts(spark, place, seed):
    draw = random.Random(seed)
    ledger = materialize(_ledger(spark), "ledger")
    days = [(f"m{m}", n, 100 + draw.randint(0, 20), None) for m in range(6) for n in range(0, 250 + 20 * m) if draw.random() < 0.3]
    # reports come in order of days, up to 30 days late
    days.sort(key=lambda r: r[1] + draw.randint(0, 30))
    feed, issued = f"{place}/feed", f"{place}/issued"
    obs = _obs(days, spark)
    outcomes, progress = R.outcome_table(spark, f"{place}/o", 2), R.progress_table(spark, f"{place}/p", 2)
    cuts = [draw.randint(1, len(days) // 3), draw.randint(len(days) // 2, len(days) - 1)]
    early, later = ledger.filter("window_end <= '2020-07-01'"), ledger.filter("window_end > '2020-07-01'")
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(days)], strict=True)):
        _append(_obs(days[a:b], spark), feed)
        # with seed 1 later forecasts are issued between two runs, before their windows open
        if i == 0:
            _append(early if seed == 1 else ledger, issued)
        elif i == 1 and seed == 1:
            _append(later, issued)
        R.stream_outcome_maturity(R.read_folder_stream(spark, issued, "*.parquet", ledger.schema),
                                  R.read_folder_stream(spark, feed, "*.parquet", obs.schema, 1), outcomes, progress, f"{place}/c")
    got = R.apply_maturity(ledger, outcomes.snapshot(), progress.snapshot())
    want = K.resolve_price_outcomes(ledger, obs)
    key = lambda r: r.forecast_id
    assert [tuple(r) for r in sorted(got.select(*want.columns).collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]


def test_closed_forecasts_and_old_days_leave_the_state(spark, place):
    ledger = _ledger(spark)
    _append(ledger, f"{place}/issued")
    for at in range(0, 300, 60):
        _append(_obs([(f"m{m}", n, 100, None) for m in range(6) for n in range(at, at + 60)], spark), f"{place}/feed")
    query = R.stream_outcome_maturity(
        R.read_folder_stream(spark, f"{place}/issued", "*.parquet", ledger.schema), R.read_folder_stream(spark, f"{place}/feed", "*.parquet", _obs([], spark).schema, 1),
        R.outcome_table(spark, f"{place}/o", 2), R.progress_table(spark, f"{place}/p", 2), f"{place}/c")
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    open_ = ledger.filter(F.col("window_end") >= F.lit(D(2020, 1, 1) + dt.timedelta(days=299 - 60))).count()
    assert open_ < kept <= open_ + 6 * (60 + 31 + 1)


def test_usual_and_unusual_dates(spark):
    texts = {"05-03-2020": D(2020, 3, 5), "31/12/1999": D(1999, 12, 31), "2020-02-29": D(2020, 2, 29), "2021-02-29": None, "05 MAR 2020": D(2020, 3, 5),
             "05-mar-2020": D(2020, 3, 5), "05 anf 2020": None, "05 xyz 2020": None, "  2020/3/5 ": D(2020, 3, 5), "5 March 2020": D(2020, 3, 5), "2020-13-01": None,
             "00-00-0000": None, "2020-03-05 10:00": D(2020, 3, 5), "05/03/70": D(1970, 3, 5), "": None, "20200305": D(2020, 3, 5), "5٣-03-2020": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_dates(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == texts
