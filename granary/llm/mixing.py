"""Mix sources to target weights: hash-random keys, range-sorted per source, cut at each source's exact budget.

Only DataFrame functions. A row's key is the md5 of its id; its range is the key's first ``RANGE_DIGITS`` hex digits,
equally wide ranges of a uniform key, so a source of any share is spread over many ranges. Sizes are summed per
source and range before the shuffle, prefix sums of these few sums give each range's offset, and a window inside one
range adds the rows before: no task sees a whole source. A row then takes its size once for each full epoch
that fits the source's target, and in the last, partial epoch as many words as the budget still has at its place.

Null and empty texts have size 0 and take nothing; a null source is a source of its own, the last one; rows with a
null id are keyed by their text instead. Repeated rows are mixed each, and it makes no difference which of two
equal ones comes first. A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import fresh, saved, word_count

#: Weights by the rank of the source, repeating; share of all words that the mix holds; epochs a source may be read.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: 16 ** RANGE_DIGITS ranges of the key per source.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row per source.

    Every source gets its weight's part of ``share`` times all words, at most ``epochs`` times its size; what is
    above goes to the others by weight. That is the level at which the capped parts sum up to the total: sources
    are taken in the order of size per weight and capped as long as the level of the rest is above theirs. The
    windows run over the table of sources, a dictionary of the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("reach", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(epochs))
    ranked = sizes.select("*", weight.alias("w")).select(
        "*", cap.alias("cap"), (F.col("source_size") / F.col("w")).alias("reach"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select(
        "*", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("words_left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
        F.row_number().over(by_cap).alias("place"))
    # the first source whose part is not above its cap, and all after it, share what is left there
    open_at = F.min(F.when(F.col("words_left") * F.col("w") <= F.col("cap") * F.col("w_left"), F.col("place"))).over(everything)
    level = left.select("*", open_at.alias("open_at")).select(
        "*", F.max(F.when(F.col("place") == F.col("open_at"), F.col("words_left"))).over(everything).alias("words_open"),
        F.max(F.when(F.col("place") == F.col("open_at"), F.col("w_left"))).over(everything).alias("w_open"))
    part = F.when(F.col("place") >= F.col("open_at"), F.col("words_open") * F.col("w") / F.col("w_open")).otherwise(F.col("cap"))
    return level.select("source", "source_size", part.alias("target"))


def taken(size: Column, source_size: Column, target: Column, before: Column) -> Column:
    """Words a row gives: its size per full epoch, and what the rest of the budget leaves after the words before it."""
    budget = F.floor(target).cast("long")
    epochs = F.floor(budget / F.greatest(source_size, F.lit(1)).cast("double")).cast("long")
    rest = budget - epochs * source_size
    return size * epochs + F.greatest(F.lit(0).cast("long"), F.least(size, rest - before))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source and text to (doc_id, source, size, source_size, target, taken), one row per row."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit("")))))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    rows = saved(rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "sizes")
    per_range = saved(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "ranges")
    goals = saved(targets(per_range.groupBy("source").agg(F.sum("range_size").alias("source_size")),
                          weights, share, epochs), "targets")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    goals = goals.withColumnRenamed("source", "goal_source")
    offsets = offsets.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source").select(
        F.col("source").alias("at_source"), F.col("range").alias("at_range"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("before"))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("range") == F.col("at_range")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken(
        F.col("size"), F.col("source_size"), F.col("target"), F.col("offset") + F.col("before")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix reads them; the one at a source's cut stays whole.

    A document that the mix reads for some of its words only, the last of a source's budget, is kept as a whole:
    rows are repeated ``ceil(taken / size)`` times, so a source exceeds its budget by less than one document.
    All columns of ``docs`` are returned. The texts are not shuffled for the sums: only ids meet the shuffle
    that finds what is taken.
    """
    takes = mix(docs, **options).where("taken > 0")
    id_name, copies, found = fresh(docs, "id_of_take", "copies", "n_take")
    reads = F.ceil(F.col("taken") / F.col("size")).cast("int")
    takes = takes.groupBy("doc_id", F.col("source").alias("take_source"), F.col("size").alias("take_size")).agg(
        F.sum(reads).cast("int").alias(copies), F.count("*").cast("int").alias(found)).withColumnRenamed("doc_id", id_name)
    rows = docs.join(takes, F.col("doc_id").eqNullSafe(F.col(id_name)) & F.col("source").eqNullSafe(F.col("take_source"))
                     & (word_count(F.col("text")) == F.col("take_size")))
    # equal rows share their reads evenly; what does not divide goes to each of them
    each = F.ceil(F.col(copies) / F.col(found)).cast("int")
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), each)).alias(copies)).drop(copies)
