"""Sharding by proportional stratified interleaving.

Each source's rows are shuffled by a seeded digest and ranked; rank r of n stands at (r - 1/2) / n on
the unit line.  Sorting all rows by that fraction interleaves the sources in proportion, and equal
cuts of the sorted line give shards whose sizes differ by one row at most and whose mixture is the
whole's.  Only DataFrame functions are used.

No row number is taken over more than a slice of the rows.  A source's shuffle order is cut at the
digest's first digits, the unit line at ``2 ** fraction_bits`` points; a slice's rows are numbered in a
window and the counts of the slices before it are added.  So a source with a third of all rows is
spread over as many windows as there are digest prefixes.

Nulls and ties: a null source is a source of its own; null texts have size 1 and CRC 0; null ids are
digested as such.  Rows equal in id, source, size and CRC are interchangeable: each gets its own slot.
Extra columns are ignored.  An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickyard.llm.common import text_crc32


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, digits: int = 3,
               fraction_bits: int = 16) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot (gapless from 0)."""
    rows = docs.select("doc_id", "source", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
                       text_crc32(F.col("text")).alias("text_crc32"))
    rows = rows.withColumn("mix", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
                                        .cast("binary")))
    rows = rows.withColumn("part", F.substring("mix", 1, digits))
    # rank within the source = rows in earlier digest prefixes + rank within the prefix
    counts = rows.groupBy("source", "part").agg(F.count("*").alias("c"))
    src = W.partitionBy("source")
    counts = counts.select(F.col("source").alias("s"), F.col("part").alias("p"),
                           (F.sum("c").over(src.orderBy("part")) - F.col("c")).alias("before"),
                           F.sum("c").over(src).alias("n"))
    here = W.partitionBy("source", "part").orderBy("mix", "doc_id", "size", "text_crc32")
    ranked = (rows.withColumn("r", F.row_number().over(here))
              .join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
              .withColumn("at", (F.col("before") + F.col("r") - 0.5) / F.col("n"))
              .select("doc_id", "source", "size", "text_crc32", "mix", "at",
                      F.floor(F.col("at") * (1 << fraction_bits)).alias("cut")))
    # the same again along the unit line; at most 2 ** fraction_bits counts
    cuts = ranked.groupBy("cut").agg(F.count("*").alias("c"))
    line = W.orderBy("cut")
    cuts = cuts.select(F.col("cut").alias("k"), (F.sum("c").over(line) - F.col("c")).alias("before"),
                       F.sum("c").over(W.partitionBy()).alias("total"))
    near = W.partitionBy("cut").orderBy("at", "source", "mix", "doc_id", "size", "text_crc32")
    placed = (ranked.withColumn("r", F.row_number().over(near)).join(cuts, F.col("cut") == F.col("k"))
              .withColumn("place", F.col("before") + F.col("r") - 1)
              .withColumn("shard", F.floor(F.col("place") * shards / F.col("total")).cast("int")))
    first = F.ceil(F.col("shard") * F.col("total") / F.lit(shards))
    return placed.select("doc_id", "source", "size", "text_crc32", "shard",
                         (F.col("place") - first).cast("long").alias("slot"))
