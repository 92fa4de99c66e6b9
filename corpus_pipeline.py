"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns that ``docs`` has, whatever they are called.  ``run`` writes every stage's result as
Parquet to the shared checkpoint folder and reads it again; a stage's own files go when it is done, and its
result when the next one is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickyard.llm import minhash, mixing, packing, quality, surrogates
from brickyard.llm.common import remove, scope, stored, table, word_count
from brickyard.llm.queries import TOKENIZER


def _packed(docs: DataFrame, **keys) -> DataFrame:
    """The rows as one struct ``_row`` beside ``keys``, so that no column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in keys.items()])


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; null and empty texts have weight 0 and are judged like any."""
    out = quality.resample(docs, table(spark, sf_dir, "labels"), carry=True)
    return _unpacked(out.filter("kept"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id.

    Rows that share an id are one document; the one with the smallest text stays.  Documents without an
    id or without words stay.
    """
    found = stored(minhash.near_duplicates(docs, words_each=5, percent=80), "groups")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = _packed(docs, _id=F.col("doc_id").cast("long"), _text=F.col("text").cast("string"))
    rows = rows.join(gone.hint("merge"), F.col("_id") == F.col("gone"), "left_anti")
    repeated = stored(found.filter("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id").count().filter("count > 1")
                      .select(F.col("doc_id").alias("again")), "repeated")
    if repeated.isEmpty():
        return _unpacked(rows, docs)
    once = rows.join(repeated, F.col("_id") == F.col("again"), "left_semi")
    first = F.row_number().over(W.partitionBy("_id").orderBy(F.col("_text").asc_nulls_last()))
    rows = rows.join(repeated, F.col("_id") == F.col("again"), "left_anti").unionByName(once.withColumn("_n", first).filter("_n = 1").drop("_n"))
    return _unpacked(rows, docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text where it changes."""
    count = "_replaced"
    while count in docs.columns:
        count += "_"
    out = surrogates.replace(docs, surrogates.key_of(spark), count=count)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(f"`{count}`") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(count)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it whole; a last copy in part counts from one half on."""
    taken = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0, units_only=True)
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"),
                         (F.col("copies") + (F.col("part") * 2 > F.col("size")).cast("int")).cast("int").alias("_copies")).filter("_copies > 0")
    rows = _packed(docs, _id=F.col("doc_id").cast("long"), _source=F.col("source").cast("string"), _size=word_count(F.col("text")))
    out = rows.join(taken.hint("merge"), F.col("_id").eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n")))
    return _unpacked(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs, TOKENIZER, window=2048, end=1)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", replace_private),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't express the stages' models and rounding; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scope(spark) as files:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            result = files.pop()  # the last folder written is the result
        remove(spark, before)
        before = [result]
    return docs
