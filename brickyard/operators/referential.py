"""Do the keys of a dimension and of the facts meet?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def key_coverage(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys of either side, keys and rows of the facts without a dimension row, dimension keys without facts, keys that the dimension repeats.

    Facts are counted by key first, so what is joined grows with the keys and not with the facts.  NULL keys match NULL keys.
    """
    counted = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    a = counted(facts, "facts")
    b = counted(dimension, "rows").withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    both = a.join(b, on, "full")
    f, d = F.col("facts"), F.col("rows")
    return both.agg(F.count(f).alias("fact_keys"), F.count(d).alias("dimension_keys"), F.count(F.when(d.isNull(), F.lit(1))).alias("facts_without_dimension"),
                    F.coalesce(F.sum(F.when(d.isNull(), f)), F.lit(0)).alias("fact_rows_without_dimension"),
                    F.count(F.when(f.isNull(), F.lit(1))).alias("dimension_without_facts"), F.count(F.when(d > 1, F.lit(1))).alias("repeated_dimension_keys"))
