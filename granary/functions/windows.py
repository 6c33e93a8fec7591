"""Shared window specifications.

A series holds at most one row per calendar day once it went through keyed
deduplication, so a window over a series is bounded by the days covered.
All builders use one partitioning and one ordering expression, so Spark plans
one exchange and one sort for any number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from granary.schemas import SERIES


def series_window(keys=SERIES, date: str = "reported_date") -> WindowSpec:
    """Series partition in date order; the plain column lets later windows reuse the sort."""
    return Window.partitionBy(*keys).orderBy(date)


def days_around(lo: int, hi: int, keys=SERIES, date: str = "reported_date") -> WindowSpec:
    """Rows whose date lies lo..hi days away; ordered by epoch day because RANGE offsets are numbers."""
    return Window.partitionBy(*keys).orderBy(F.unix_date(F.col(date))).rangeBetween(lo, hi)


def past(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    """Everything up to and including the current row."""
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full(aggregate: Column, value: Column, frame: WindowSpec, n: int) -> Column:
    """The aggregate over the frame, NULL until the frame holds n non-null values."""
    return F.when(F.count(value).over(frame) == n, aggregate.over(frame))
