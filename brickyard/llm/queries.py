"""The registered queries: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.llm import covertree, lines, merkle, minhash, mixing, negatives, neighbours, oracle, packing, quality, repeats, sharding, surrogates, urls
from brickyard.llm.common import table

SHARDS = 8
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op7_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.cosine_links(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words_each=4, percent=80)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), least=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.RULES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: one row per document that is kept."""
    out = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.filter("kept").select("doc_id", "log_weight", "score", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, window=2048, end=1)


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replace(table(spark, sf_dir, "documents"), surrogates.key_of(spark), count="n_replaced")
    return out.select("doc_id", "text", "n_replaced")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [merkle.encoded(merkle.lower_ascii(F.col(c)) if c == "text" else F.col(c)) for c in columns]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(docs, columns, id="doc_id", group="source", changed=F.when(chosen & F.col("text").isNotNull(), merkle.digest(*tampered)), fanout=16)
    out = merkle.verified(found)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Limits of op12, for the query and its SQL.
LINES = {"least_docs": 10, "share": 0.01, "symbol_words": 10, "least_words": 10, "most_repeated": 20, "least_left": 30}


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.rules(table(spark, sf_dir, "documents"), **LINES)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, seventh = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 7 == 0
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(seventh, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_repeats": op2_repeats,
    "op3_neighbours": op3_neighbours,
    "op4_urls": op4_urls,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_covertree": op7_covertree,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_surrogates": op10_surrogates,
    "op11_merkle": op11_merkle,
    "op12_lines": op12_lines,
    "op13_negatives": op13_negatives,
}
#: No query is here whose whole result SQL can't give; they are tested against brute force instead.
SQL: dict[str, str] = {"op11_merkle": oracle.OP11_MERKLE, "op12_lines": oracle.op12_lines(**LINES), "op13_negatives": oracle.OP13_NEGATIVES}
