"""Keyed table maintenance on plain files: the result of a merge is a new snapshot."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.distributed import first_by
from granary.schemas import OBS_KEY
from granary.session import materialize


def _stored_keys(target: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of a written batch that the target has.

    Only key columns are read, inside the batch's span of dates. The batch's size is known at planning: below the
    session's threshold it is broadcast and the target stays where it is, beyond it the join sorts both sides
    (a target bucketed by its keys still stays).
    """
    dates = [c for c in keys if isinstance(target.schema[c].dataType, (T.DateType, T.TimestampType))]
    slim = target.select(*keys)
    if dates:
        span = fresh.agg(*[f(c).alias(f"{n}_{c}") for c in dates for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for c in dates:
            if span[f"lo_{c}"] is not None:
                slim = slim.filter(F.col(c).between(span[f"lo_{c}"], span[f"hi_{c}"]) | F.col(c).isNull())
    offered = fresh.select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys))
    return materialize(slim.join(offered, same, "left_semi"), "stored-keys")


def upsert_keep_first(target: DataFrame, batch: DataFrame, keys: Sequence[str] = OBS_KEY,
                      order: Sequence[str] | None = None) -> DataFrame:
    """Target plus the batch rows whose key it lacks; column ``_inserted`` tells them apart.

    Within the batch the first row by ``order`` (default: all columns) wins. The target is scanned, not shuffled.
    """
    order = list(order or batch.columns)
    fresh = materialize(first_by(batch, keys, order), "batch")
    new = fresh.join(_stored_keys(target, fresh, keys), list(keys), "left_anti")
    return (target.withColumn("_inserted", F.lit(False))
            .unionByName(new.withColumn("_inserted", F.lit(True))))


def upsert_counts(merged: DataFrame, batch: DataFrame) -> DataFrame:
    """inserted / duplicates / total of a keep-first merge."""
    stats = merged.agg(F.count_if("_inserted").alias("inserted"), F.count("*").alias("total"))
    offered = batch.agg(F.count("*").alias("n")).scalar()
    return stats.select("inserted", (offered - F.col("inserted")).alias("duplicates"), "total")


def upsert_last_wins(target: DataFrame, batch: DataFrame, values: Sequence[str], created: str = "created_at",
                     keys: Sequence[str] = OBS_KEY, order: Sequence[str] | None = None) -> DataFrame:
    """New values replace old ones, the first creation time stays. The target has one row per key.

    Within the batch the last row by ``order`` wins, and a new key gets the batch's earliest creation time. The batch
    is reduced to one row per key and written; the target meets it in a join that is a broadcast while the batch is
    below the session's threshold, so the target is scanned, not shuffled.
    """
    order = list(order or (created, *values))
    rank = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*values).alias("_v"))
    fresh = materialize(batch.groupBy(*keys).agg(F.max(rank).alias("_best"), F.min(F.struct(created)).alias("_first")).select(
        *keys, F.col("_best._v").alias("_v"), F.col(f"_first.{created}").alias("_c")), "batch")
    offered = fresh.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_v")
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys))
    hit = F.col("_v").isNotNull()
    kept = target.join(offered, same, "left").select(
        *keys, *[F.when(hit, F.col(f"_v.{v}")).otherwise(F.col(v)).alias(v) for v in values], created)
    stored = _stored_keys(target, fresh, keys).select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    new = fresh.join(stored, same, "left_anti").select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values], F.col("_c").alias(created))
    return kept.unionByName(new)


def batch_acceptance(batch: DataFrame, price: str = "modal_price", date: str = "reported_date") -> DataFrame:
    """Accepted and rejected row counts of a prepared batch."""
    ok = F.coalesce((F.col(price) > 0) & F.col(date).isNotNull(), F.lit(False))
    return batch.agg(F.count("*").alias("offered"), F.count_if(ok).alias("accepted"),
                     F.count_if(~ok).alias("rejected"))


def append_audit(log: DataFrame, entry: DataFrame) -> DataFrame:
    """Run log with one more entry; columns the log lacks are an error."""
    return log.unionByName(entry)


def ingestion_summary(log: DataFrame, obs: DataFrame) -> DataFrame:
    """Latest run, run totals and the state of the observation table, one row per commodity."""
    runs = log.groupBy("commodity").agg(
        F.count("*").alias("runs"),
        F.max_by("run_id", F.struct("finished_on", "run_id")).alias("latest_run"),
        F.max_by("status", F.struct("finished_on", "run_id")).alias("latest_status"),
        F.max("finished_on").alias("latest_finished_on"),
        F.sum("inserted").alias("total_inserted"), F.sum("duplicates").alias("total_duplicates"),
        F.sum("rejected").alias("total_rejected"))
    state = (obs.groupBy("commodity", "market")
             .agg(F.count("*").alias("n"), F.max("reported_date").alias("d"))
             .groupBy("commodity").agg(F.sum("n").alias("observations"), F.count("*").alias("markets"),
                                       F.max("d").alias("latest_date")))
    return runs.join(state, "commodity", "left")


def group_mappings(df: DataFrame, categories: Sequence[str], date: str, train_end: Column) -> DataFrame:
    """(kind, value, n, nulls) rows: distinct values and observed combinations up to train_end.

    Each category is one grouped branch; nothing is gathered into a list.
    """
    train = df.filter(F.col(date) <= train_end)
    combos = train.groupBy(*categories).agg(F.count("*").alias("n"))
    # combinations are few; every category's own values come from them, not from the rows
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in categories]
    pair = F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in categories]), lambda x: x),
                  F.concat_ws("|", *[F.col(c).cast("string") for c in categories]))
    kinds.append(F.struct(F.lit("combination").alias("kind"), pair.alias("value")))
    return (combos.select("n", F.explode(F.array(*kinds)).alias("k"))
            .groupBy(F.col("k.kind").alias("kind"), F.col("k.value").alias("value"))
            .agg(F.sum("n").alias("n")))


def weather_gap_fill(cache: DataFrame, archive: DataFrame, districts: DataFrame, start: str, end: str,
                     values: Sequence[str]) -> DataFrame:
    """Every expected district-day with values from the cache, else the archive, and its source."""
    calendar = districts.select("district", F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    tag = lambda df, rank: df.select("district", "date", F.struct(
        F.lit(rank).alias("rank"), *values).alias("v")).filter(
            F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    # the better source has the smaller rank, so one aggregate resolves the priority
    best = tag(cache, 0).unionByName(tag(archive, 1)).groupBy("district", "date").agg(F.min("v").alias("v"))
    return calendar.join(best, ["district", "date"], "left").select(
        "district", "date", *[F.col(f"v.{c}").alias(c) for c in values],
        F.when(F.col("v.rank") == 0, "cache").when(F.col("v.rank") == 1, "archive")
        .otherwise("missing").alias("source"))


def weather_fill_report(filled: DataFrame) -> DataFrame:
    """Per district: expected, filled and missing days, completeness and a source label."""
    n = F.count("*")
    cache, archive = F.count_if(F.col("source") == "cache"), F.count_if(F.col("source") == "archive")
    return filled.groupBy("district").agg(
        n.alias("expected_days"), cache.alias("cache_days"), archive.alias("archive_days"),
        F.count_if(F.col("source") == "missing").alias("missing_days"),
        ((cache + archive) / n).alias("completeness"),
        # ranges of one season only: at most a few hundred days per district
        F.array_join(F.array_sort(F.collect_list(F.when(
            F.col("source") == "missing", F.date_format("date", "yyyy-MM-dd")))), ",").alias("missing_list"),
        F.when((cache > 0) & (archive > 0), "mixed").when(cache > 0, "cache")
        .when(archive > 0, "archive").otherwise("none").alias("source_label"))


def weather_store_stats(store: DataFrame) -> DataFrame:
    """Totals and rows by source in one pass: grouping set () and (source)."""
    by = (store.groupBy("source", "district")
          .agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")))
    return (by.rollup("source").agg(
        F.sum("n").alias("row_count"), F.countDistinct("district").alias("districts"),
        F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))
        .withColumn("source", F.coalesce("source", F.lit("all"))))
