"""Exact order statistics that never gather an unbounded group in one task.

Values are first collapsed to (value, weight) pairs with map-side combining.
The pairs are then cut into buckets by a monotone function of the value:
running sums inside a bucket use a window partitioned by the bucket, and the
bucket totals, of which there are few, give each bucket its starting offset.
A third of all rows in one group therefore spreads over that group's buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per unit of ln(1 + |x|): at most about 2.9 million for the whole double
# range, below 50,000 for prices and below 3,000 for probabilities.
RESOLUTION = 4096


def value_bucket(x: Column) -> Column:
    """Integer that never decreases when x grows."""
    return (F.signum(x) * F.floor(F.log1p(F.abs(x)) * RESOLUTION)).cast("long")


def running_by_value(df: DataFrame, value: str, sums: Mapping[str, Column],
                     keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """One row per (keys, value) with each sum's own, running-before and total value.

    Columns: keys, value, and for each name s: ``s``, ``s_before`` (sum over values
    strictly before this one) and ``s_total``. Key columns must not be NULL.
    """
    keys = list(keys)
    pairs = (df.filter(F.col(value).isNotNull())
             .groupBy(*keys, F.col(value).alias(value))
             .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
             .withColumn("_bucket", value_bucket(F.col(value))))
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    names = list(sums)

    inside = Window.partitionBy(*keys, "_bucket").orderBy(order(value)).rowsBetween(
        Window.unboundedPreceding, -1)
    rows = pairs.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in names])

    totals = pairs.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_sum_{n}") for n in names])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in names])

    joined = rows.join(totals, [*keys, "_bucket"])
    return joined.select(
        *keys, value, *names,
        *[(F.col(f"_off_{n}") + F.col(f"_in_{n}")).alias(f"{n}_before") for n in names],
        *[f"{n}_total" for n in names])


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated exact quantiles, one row per key with one column per name."""
    keys = list(keys)
    ranked = running_by_value(df, value, {"_n": F.lit(1)}, keys)
    lo_hi = []
    for name, p in probs.items():
        pos = (F.col("_n_total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n"))
            lo_hi.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
    picked = ranked.groupBy(*keys).agg(F.max("_n_total").alias("_total"), *lo_hi)
    out = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)


def scalar(df: DataFrame) -> Column:
    """A one-row, one-column DataFrame as a value: evaluated once, no join, no driver round trip."""
    return df.scalar()


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
             keep_last: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) by the order columns, then by all others.

    Because only row 1 is kept, the optimizer limits every key to one row per
    input task before the shuffle (window group limit), so copies of a hot key
    never travel to one task.
    """
    keys = list(keys)
    named = [o for o in order if not (isinstance(o, str) and o in keys)]
    rest = [c for c in df.columns if c not in keys and c not in named]
    turn = (lambda c: c.desc()) if keep_last else (lambda c: c.asc())
    ranking = [turn(F.col(o) if isinstance(o, str) else o) for o in [*named, *rest]]
    w = Window.partitionBy(*keys).orderBy(*ranking)
    return df.select("*", F.row_number().over(w).alias("_rank")).filter("_rank = 1").drop("_rank")


def row_scalar(df: DataFrame) -> Column:
    """A one-row DataFrame as a struct value (see ``scalar``)."""
    return df.select(F.struct(*df.columns)).scalar()


def day_quantile(df: DataFrame, date: str, p: float) -> Column:
    """Quantile of a date column as fractional epoch days.

    A built-in percentile keeps one counter per distinct value, and distinct
    days are few, so this one needs no bucketing.
    """
    return df.agg(F.percentile(F.unix_date(date).cast("double"), float(p))).scalar()
