"""Mixing sources to target weights by pivotal (dependent) rounding.

A source's target divided by its size is the number of copies each of its documents should get, as a
real number below or at 2.  The whole part is given to every document; the fractions are rounded by
weighted pivotal steps: two documents trade words until one of them holds none or all of its words,
at random with the odds that keep every document's expectation.  A step keeps the pair's sum of
words, so a source's words stay on target however the steps fall.

The steps form a reduction tree.  A source's documents are dealt into blocks of about ``fan_in`` by a
seeded hash and every block is rounded by itself down to at most one document with a fraction; the
leftovers of ``fan_in`` blocks meet in one block of the next level, until one document a source is
left.  That last one gets its words in part (``part``), which is under one copy of one document.
Block contents, order and random numbers come from hashes of the seed and the ids, so reruns agree.

Nulls and ties: a null source is a source of its own, sorted last; null texts have size 0; documents
of size 0 take nothing.  Rows equal in id, source and size are rounded as one document of their joint
size, so each gets the same.  Extra columns are ignored.  An empty
input gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickyard.llm.common import stored, word_count

OPEN = "src int, block long, h long, doc_id long, rows long, each long, size long, source string, source_size long, target double, whole long, mass double"


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source, n, source_size, target) from rows (source, size), one per source.

    The words to give out are ``share`` of all sizes.  A target is the source's weight times the water
    level at which the targets, cut at ``most`` times the source's size, add up; that is where passing
    on the excess by weight ends.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    per = per.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = W.orderBy(F.col("cap") / F.col("w"), "src")
    everything = W.partitionBy()
    per = (per.withColumn("full_cap", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("free_w", F.sum("w").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)))
           .withColumn("words", F.sum("source_size").over(everything) * F.lit(float(share)))
           # the level if all sources before this one are full; it falls from the first that isn't, which sets it
           .withColumn("level", (F.col("words") - F.col("full_cap")) / F.col("free_w"))
           .withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything)))
    return per.select("src", "source", "n", "source_size",
                      F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def settle(size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weighted pivotal rounding in row order; all masses but one end at 0 or at the row's size."""
    mass, coins = mass.copy(), rng.random(len(mass))
    i = -1
    for j in range(len(mass)):
        if mass[j] <= 0 or mass[j] >= size[j]:
            continue
        if i < 0:
            i = j
            continue
        give, take = min(size[i] - mass[i], mass[j]), min(mass[i], size[j] - mass[j])
        if coins[j] * (give + take) < take:  # i gains with the odds that keep both expectations
            i_full = size[i] - mass[i] <= mass[j]
            mass[i], mass[j] = (size[i], mass[j] - give) if i_full else (mass[i] + give, 0.0)
        else:
            i_empty = mass[i] <= size[j] - mass[j]
            mass[i], mass[j] = (0.0, mass[j] + take) if i_empty else (mass[i] - take, size[j])
        left = [k for k in (i, j) if 0 < mass[k] < size[k]]
        i = left[0] if left else -1
    return mass


def _round_block(seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable", na_position="last")
        rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}:{key[0]}:{key[1]}:{len(pdf)}"))
        pdf["mass"] = settle(pdf["size"].to_numpy(float), pdf["mass"].to_numpy(float), rng)
        return pdf
    return run


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        seed: int = 29, fan_in: int = 4096, units_only: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, part, taken.

    ``copies`` whole copies and ``part`` words of one more; ``taken`` is their words.  With ``units_only``
    equal rows come as one, with their number in ``rows``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"))
    units = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    want = stored(targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, most), "targets")
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    cur = (units.join(want.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
           .withColumnRenamed("size", "each").withColumn("size", F.col("each") * F.col("rows"))
           .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "each"))
           .withColumn("block", F.pmod("h", F.ceil(F.col("n") / F.lit(fan_in))))
           .withColumn("ratio", F.coalesce(ratio, F.lit(0.0)))
           .withColumn("whole", F.floor("ratio").cast("long"))
           .withColumn("mass", (F.col("ratio") - F.col("whole")) * F.col("size"))
           .selectExpr(*[f"cast({f.split()[0]} as {f.split()[1]}) as {f.split()[0]}" for f in OPEN.split(", ")]))
    most_docs = want.agg(F.max("n")).first()[0] or 0
    done = []
    while True:
        cur = stored(cur.groupBy("src", "block").applyInPandas(_round_block(seed), OPEN), "rounded")
        if most_docs <= fan_in:
            break
        is_open = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
        done.append(cur.filter(~is_open))
        most_docs = -(-most_docs // fan_in)
        cur = cur.filter(is_open).withColumn("block", F.floor(F.col("block") / F.lit(fan_in)))
    for part in done:
        cur = cur.unionByName(part)
    settled = (F.col("mass") <= 0) | (F.col("mass") >= F.col("size"))
    copies = F.col("whole") + F.when(F.col("mass") >= F.col("size"), 1).otherwise(0)
    out = (cur.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
           .withColumn("part", F.when(settled, 0).otherwise(F.round(F.col("mass") / F.col("rows"))).cast("long"))
           .select("doc_id", F.col("each").alias("size"), "source", "source_size", "target", "copies", "part", "rows",
                   (F.col("copies") * F.col("each") + F.col("part")).alias("taken")))
    return out if units_only else out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("_n", "rows")
