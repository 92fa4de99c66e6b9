"""Numeric column helpers.

``round_half_away`` is SQL ``ROUND(x, n)`` on a double: half away from
zero, decided on the binary value (so 1.005 -> 1.0, as PostgreSQL and
DuckDB do).  Spark's own ``F.round`` decides on the shortest decimal text
(1.005 -> 1.01), which flips a label now and then at a threshold.  The
helper is a pure arithmetic expression, so it stays inside whole-stage
codegen.  ``sql_round`` is the same expression as SQL text, used by the
oracle queries so both engines perform the identical IEEE operations.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c, n: int = 0) -> Column:
    """ROUND(x, n), half away from zero; NULL stays NULL; never -0.0."""
    c = _c(c)
    scale = float(10 ** n)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)


def round_int(c) -> Column:
    """ROUND(x) as BIGINT (money rounded to whole units)."""
    return round_half_away(c, 0).cast("bigint")


def safe_div(num, den) -> Column:
    """num / den with a zero denominator giving NULL (Spark ANSI mode raises)."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def pct_change(cur, prev) -> Column:
    """(cur - prev) / prev * 100, NULL when prev is NULL or 0."""
    cur, prev = _c(cur), _c(prev)
    return (cur - prev) / F.nullif(prev, F.lit(0)) * F.lit(100.0)


def sql_round(expr: str, n: int = 0) -> str:
    """SQL text of ``round_half_away`` for the DuckDB oracle."""
    s = f"1e{n}"
    return f"(sign({expr}) * floor(abs({expr}) * {s} + 0.5) / {s} + 0.0)"
