"""Window helpers for ordered per-key series.

All frames are ROWS frames over observed periods (a missing month means
"3 months back" is 3 rows back), as in every form of the reference.
These run on aggregated series (place x period), never on raw sales.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from .numeric import pct_change


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series(keys, order) -> Window:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def momentum(c, w: Window, k: int) -> Column:
    """(x / lag(x, k) - 1) * 100 over ``w`` (the README form of k-period momentum)."""
    prev = F.lag(_c(c), k).over(w)
    return (_c(c) / F.nullif(prev, F.lit(0)) - F.lit(1.0)) * F.lit(100.0)


def rolling_mean(c, w: Window, size: int, min_periods: int = 1) -> Column:
    """Mean of the last ``size`` rows, NULL while fewer than ``min_periods`` non-null values."""
    frame = w.rowsBetween(-(size - 1), Window.currentRow)
    mean = F.avg(_c(c)).over(frame)
    if min_periods <= 1:
        return mean
    return F.when(F.count(_c(c)).over(frame) >= F.lit(min_periods), mean)


def running_sum(c, w: Window) -> Column:
    return F.sum(_c(c)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def value_at(c, cond: Column, keys) -> Column:
    """The value of ``c`` on the row where ``cond`` holds, broadcast to every row of the key.

    Join-free form of a left self-join to a one-period slice (unique per key).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return F.max(F.when(cond, _c(c))).over(Window.partitionBy(*keys))


def truncated_average_rank(c, partition=(), ascending: bool = False) -> Column:
    """pandas ``rank(method='average')`` truncated to int; NULL metric -> NULL rank.

    Ties share floor(first rank + (ties - 1) / 2), e.g. [5, 7, 7, 9] desc -> [4, 2, 2, 1].
    """
    c = _c(c)
    order = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    w = Window.partitionBy(*partition).orderBy(order) if partition else Window.orderBy(order)
    ties = Window.partitionBy(*partition, c) if partition else Window.partitionBy(c)
    avg_rank = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - F.lit(1)) / F.lit(2.0)
    return F.when(c.isNotNull(), F.floor(avg_rank).cast("int"))
