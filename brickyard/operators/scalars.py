"""Scalar broadcast and min-max scoring.

A global scalar (a national median, the min and max of a score input)
is a one-row aggregate attached to every row by a broadcast cross join:
one row is the proven size bound, and the plan stays partitioned
(a global window would funnel every row through one partition).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import round_half_away


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df`` (one scalar subquery)."""
    s = one_row.select(F.struct(*one_row.columns).alias("__s")).scalar()
    return df.select("*", *[s[c].alias(c) for c in one_row.columns])


def min_max_scores(df: DataFrame, specs: Mapping[str, tuple], digits: int = 1) -> DataFrame:
    """Add 0-100 min-max scores.

    ``specs``: output name -> (input column or Column, inverted: bool).
    score = round((x - min) / (max - min) * 100, digits); inverted uses
    (max - x).  All inputs equal (max = min) gives NULL.
    """
    cols = {}
    for name, (src, _) in specs.items():
        cols[name] = F.col(src) if isinstance(src, str) else src
    staged = df.select("*", *[c.alias(f"__in_{n}") for n, c in cols.items()])
    bounds = staged.agg(*[agg for n in cols for agg in (F.min(f"__in_{n}").alias(f"__min_{n}"),
                                                        F.max(f"__in_{n}").alias(f"__max_{n}"))])
    j = with_scalars(staged, bounds)
    out = []
    for name, (_, inverted) in specs.items():
        x, lo, hi = F.col(f"__in_{name}"), F.col(f"__min_{name}"), F.col(f"__max_{name}")
        num = (hi - x) if inverted else (x - lo)
        out.append(round_half_away(num / F.nullif(hi - lo, F.lit(0)) * F.lit(100.0), digits).alias(name))
    keep = [c for c in df.columns]
    return j.select(*keep, *out)


def require_unique(df: DataFrame, keys, what: str = "table", sample: int = 5) -> DataFrame:
    """Raise if ``keys`` repeat in ``df`` (a dimension joined on them would multiply rows).

    One aggregation job; at most ``sample`` offending keys reach the driver.
    """
    keys = list(keys)
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(sample).collect()
    if dup:
        shown = ", ".join(str(tuple(r[k] for k in keys)) for r in dup)
        raise ValueError(f"{what}: keys {keys} are not unique, e.g. {shown}")
    return df
