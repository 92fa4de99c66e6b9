"""Quality classifier by importance resampling.

Two generative models over hashed unigrams and bigrams, of words and of word shapes: one of the target
(documents labelled good and not toxic), one of the raw collection (all documents).  An n-gram counts
once a document, so repetition inside a document doesn't shift the models.  A document's log importance
weight is the sum, over its distinct n-grams, of the log ratio of their probabilities.  Its own counts
are taken out first, or a labelled document would speak for itself.  Ratios are smoothed towards 1 by
``smooth`` expected counts, and log ratios within ``margin`` of 0 count as 0: both keep sampling
noise from adding up over long documents.

Sampling is Gumbel top-k: every document's log weight gets Gumbel noise from a keyed hash of its id
and text, and the k largest are kept, which is sampling without replacement by weight.  k is the number
of documents whose weight clears the level that best parts the labelled documents; the level is
found on a histogram of their weights.  The k-th largest score is found by counting scores in
bins, and again in bins of the one bin that holds it; only what then shares its narrow bin is ranked, so
no task sorts the collection.

All counts cover all documents.  The models are two arrays with a count for each of a fixed number
of buckets: that bounds what goes to the driver and back.

Nulls and ties: a null or empty text has weight 0 (it is as likely under either model).  Labels are
matched by doc_id; a document with several labels is good only if all say so; documents with a null
id are unlabelled.  Without any labels, or with labels of one kind only, everything is kept.  Equal
scores are parted by id and text digest; rows equal in both are kept or dropped together.  Extra
columns are ignored.  An empty input gives an empty result.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.llm.common import small_batches, stored

PUNCTUATION = string.punctuation.encode()


SHAPE = bytes(b"a"[0] if 97 <= c <= 122 or c >= 128 else b"A"[0] if 65 <= c <= 90 else b"0"[0] if 48 <= c <= 57 else c for c in range(256))


class Shapes(dict):
    """Hashes of shapes, words with letters and digits as classes and runs as one: ``Hello!!`` is ``Aa!``.  Long ones aren't kept."""

    def __missing__(self, kinds: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        if len(kinds) > 64:
            at = np.frombuffer(kinds, np.uint8)
            return xxhash.xxh64_intdigest(at[np.append(True, at[1:] != at[:-1])].tobytes(), seed=1) & 0xFFFFFFFF
        shape = bytes(c for k, c in enumerate(kinds) if not k or c != kinds[k - 1])
        self[kinds] = value = xxhash.xxh64_intdigest(shape, seed=1) & 0xFFFFFFFF
        return value


class Vocabulary(dict):
    """Numbers of words; ``codes`` has, by number, the hashes of the bare word and of its shape, and its first four bytes."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.codes, self.shapes = most, np.empty((most, 3), np.uint64), Shapes()

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self.codes):
            self.codes = np.concatenate([self.codes, np.empty_like(self.codes)])
        bare = word.lower().strip(PUNCTUATION)
        self.codes[k] = (xxhash.xxh64_intdigest(bare) & 0xFFFFFFFF, int.from_bytes(bare[:4]), self.shapes[word.translate(SHAPE)])
        self[word] = k
        return k


class Grams:
    """Distinct buckets of a whole text's n-grams: words, their bigrams, their first letters, shapes and bigrams of shapes.

    Words have ``2 ** bits`` buckets, their bigrams a quarter and the others a sixteenth each.  The shape
    of a word that repeats the one before is how often it has, up to six times.
    """

    def __init__(self, bits: int):
        self.bits, self.words, self.stamp = bits, Vocabulary(), np.zeros(buckets(bits), np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.words) >= self.words.most:
            self.words = Vocabulary()
        words = text.encode().split() if text else ()
        number = np.fromiter((self.words[w] for w in words), np.int64, len(words))
        code = self.words.codes[number]
        word, head, kind = code[:, 0], code[:, 1], code[:, 2]
        at = np.arange(len(number))
        run = at - np.maximum.accumulate(np.where(np.append(True, word[1:] != word[:-1])[: len(word)], at, 0))
        kind = np.where(run > 0, np.minimum(run, 6).astype(np.uint64), kind)
        out, first = [], 0
        for h, own in ((word, self.bits), (_pairs(word), self.bits - 2), (head, self.bits - 4), (kind, self.bits - 4), (_pairs(kind), self.bits - 4)):
            out.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - own)).astype(np.int64) + first)
            first += 1 << own
        both = np.concatenate(out)
        at = np.arange(len(both), dtype=np.int32)
        self.stamp[both] = at  # each bucket's last place
        return both[self.stamp[both] == at]


def _pairs(h: np.ndarray) -> np.ndarray:
    pair = h[:-1] * np.uint64(0x9E3779B1) + h[1:] + np.uint64(0x7F4A7C15)
    return pair ^ (pair >> np.uint64(17))


def buckets(bits: int) -> int:
    return (1 << bits) + (1 << bits - 2) + 3 * (1 << bits - 4)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]):
        grams = Grams(bits)
        raw, target = np.zeros(buckets(bits), np.int64), np.zeros(buckets(bits), np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                g = grams(text.as_py())
                raw[g] += 1
                if good:
                    target[g] += 1
        at = np.flatnonzero(raw)
        for lo in range(0, len(at), 50_000):
            k = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw[k]), pa.array(target[k])], names=["bucket", "raw", "target"])
    return run


def log_ratios(raw: np.ndarray, target: np.ndarray, smooth: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Log of target over raw probability per bucket, for documents outside and inside the target.

    A document's own count is taken out of both models.
    """
    share = target.sum() / max(raw.sum(), 1)
    rest = np.maximum(raw - 1, 0) * share + smooth
    out = []
    for own in (0, 1):
        log = np.log((np.maximum(target - own, 0) + smooth) / rest)
        out.append((np.sign(log) * np.maximum(np.abs(log) - margin, 0)).astype(np.float32))
    return tuple(out)


def _weigh(model, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]):
        grams, ratios = Grams(bits), model.value
        for batch in batches:
            weight, noise, tie = [], [], []
            for key, text, good in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                weight.append(float(ratios[bool(good)][grams(text)].sum(dtype=np.float64)))
                h = xxhash.xxh3_64_intdigest(f"{key}\0{text}".encode(), seed=seed)
                noise.append(-math.log(-math.log(((h >> 11) + 0.5) / 2**53)))
                tie.append(xxhash.xxh64_intdigest(h.to_bytes(8, "big")) >> 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(weight, pa.float64()), pa.array(noise, pa.float64()), pa.array(tie, pa.int64()), batch.column(3)],
                                             names=["doc_id", "good", "log_weight", "noise", "tie", "_row"])
    return run


def _level(hist: list) -> float | None:
    """The weight that best parts good from bad documents: the largest sum of both shares on their side."""
    good, bad = sum(r.good for r in hist), sum(r.bad for r in hist)
    if not good or not bad:
        return None
    best, level, g, b = -1.0, None, 0, 0
    for r in sorted(hist, key=lambda r: r.bin):
        value = (good - g) / good + b / bad  # keep from this bin on
        if value > best:
            best, level = value, r.bin
        g, b = g + r.good, b + r.bad
    return level


def _kth_largest(scores: DataFrame, k: int, bins: int = 4096, levels: int = 4, limit: float = 1e5) -> tuple[float, float, int]:
    """(low, high, above): the k-th largest of (at, n) lies in [low, high), with ``above`` rows at or over high.

    Scores beyond the limit count into the outer bins.  Each level counts ``bins`` bins of one bin before.
    """
    low, high, above = -limit, limit, 0
    at = F.greatest(F.least(F.col("score"), F.lit(limit * (1 - 1e-12))), F.lit(-limit))
    for _ in range(levels):
        width = (high - low) / bins
        inside = scores.filter((at >= low) & (at < high)).groupBy(F.floor((at - low) / width).alias("bin")).count()
        for r in sorted(inside.collect(), key=lambda r: -r.bin):  # at most ``bins`` rows
            if above + r["count"] >= k:
                low, high = low + r.bin * width, low + (r.bin + 1) * width
                break
            above += r["count"]
    return low, high, above


def resample(docs: DataFrame, labels: DataFrame, bits: int = 20, smooth: float = 2.0, margin: float = 1.0, seed: int = 41,
             temperature: float = 0.2, most_labels: int = 200_000, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, log_weight, score, tie, kept, and with ``carry`` the whole row as struct _row.

    ``temperature`` scales the Gumbel noise against the log weights.  Of the labelled documents about
    ``most_labels`` at most, chosen by a hash of the id, make the target model and the level.
    """
    small_batches(docs)
    sc = docs.sparkSession.sparkContext
    good = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
            .agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good")))
    share = most_labels / max(good.count(), 1)
    ids = F.broadcast(stored(good.filter(F.pmod(F.xxhash64(F.lit(seed), "label_id"), F.lit(1 << 20)) < share * (1 << 20)), "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(True)).alias("_row"))
    raw, target = (np.zeros(buckets(bits), np.float32) for _ in range(2))
    known = rows.join(ids, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "text", "good", "_row")
    counted = known.select("text", "good").mapInArrow(_count(bits), "bucket long, raw long, target long")
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow().to_batches():
        at = r.column("bucket").to_numpy()  # at most buckets(bits) rows
        raw[at], target[at] = r.column("raw").to_numpy(), r.column("target").to_numpy()
    model = sc.broadcast(log_ratios(raw, target, smooth, margin))
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("good", T.BooleanType()), ("log_weight", T.DoubleType()),
                                                            ("noise", T.DoubleType()), ("tie", T.LongType()), ("_row", known.schema["_row"].dataType))])
    weighed = stored(known.mapInArrow(_weigh(model, bits, seed), schema)
                     .withColumn("score", F.col("log_weight") + temperature * F.col("noise")), "weights")
    out = ["doc_id", "log_weight", "score", "tie", *(["_row"] if carry else [])]
    bin_of = F.floor(F.greatest(F.least(F.col("log_weight"), F.lit(500.0)), F.lit(-500.0)) * 8)
    hist = (weighed.filter("good is not null").groupBy(bin_of.alias("bin")).agg(F.sum(F.col("good").cast("int")).alias("good"), F.sum((~F.col("good")).cast("int")).alias("bad")).collect())
    level = _level(hist)
    if level is None:
        return weighed.select(*out, F.lit(True).alias("kept"))
    k = weighed.filter(bin_of >= level).count()
    low, high, above = _kth_largest(weighed, k)
    # ties and near ties at the edge are parted by rank
    rank = F.rank().over(W.orderBy(F.desc("score"), "doc_id", "tie"))
    edge = (F.col("score") >= low) & (F.col("score") < high)
    inside = weighed.filter(edge).select(*out, (rank <= k - above).alias("kept"))
    return weighed.filter(~edge).select(*out, (F.col("score") >= high).alias("kept")).unionAll(inside)
