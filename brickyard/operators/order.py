"""A total order over part files, with each row's place in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def order_columns(keys: Sequence[str]) -> list[Column]:
    """``"-col"`` is descending with NULLs first, as PostgreSQL sorts; others ascend with NULLs last."""
    return [F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]


def with_ordinal(df: DataFrame, keys: Sequence[str], name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """``df`` sorted by ranges over its partitions, with the place of every row (from 1).

    Rows are dealt by range and numbered where they are; only the partitions' sizes are added up, one row each.
    Rows with equal keys are numbered in any order.  Written as files, part by part, the result is sorted throughout.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = order_columns(keys)
    rows = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # one row a partition
    place = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1
    return rows.join(F.broadcast(before), part == F.col("_part")).select(*df.columns, place.alias(name))
