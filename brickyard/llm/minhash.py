"""Near-duplicate documents: MinHash signatures, multi-index Hamming join, confirmation on full sets.

A document's set holds its distinct word shingles as 64-bit hashes.  Its signature has ``lanes``
minima of ``bits`` = 16 bits each, so a lane of two documents differs with a chance of 1 - J.

Candidates.  The lanes are split into chunks of ``chunk`` lanes.  Two signatures that differ in at
most ``distance`` lanes differ in at most ``errors`` lanes of some chunk (pigeonhole), where
distance = chunks * (errors + 1) - 1.  Every chunk therefore files the document under each way of
leaving ``errors`` of its lanes out; two documents meet in a bucket exactly if some chunk has that few
errors.  All pairs under the signature distance become candidates, without a cap on buckets.  With
the defaults (32 lanes, 8 chunks of 4, 1 error) the guarantee is 15 of 32 lanes and a pair of
similarity 0.8 is missed with a chance of 0.181 ** 8, about one in a million.

Cost.  Equal sets are one class from the start.  In a bucket of more than ``crowd`` classes one class is the
centre; every class there is first compared with the ``stars`` centres that it shares most
buckets with, on full sets, so a large group of near copies is tied together by about one link each and sends
each set about ``stars`` times.  From then on only pairs of classes that aren't tied yet matter: buckets that hold
one tie only go at once; the others are dealt out as (bucket, block, block) groups of at most two blocks of
classes, whatever the bucket's size.  A pair is looked at only in the first bucket that holds it.  A pass over
signatures names the classes that have a candidate pair; only their texts are read again, and their sets go only to
those buckets.  There a pair is compared only if its classes aren't linked in that bucket yet, and
what comes out is links, not pairs.  Components of the links are found by distributed star steps.

Nulls and ties: null and empty texts have an empty set and link with nothing; a text with fewer words
than a shingle is one shingle.  A row without doc_id has component_id null and is kept.  Rows that share
a doc_id are one document, with all their texts.  Repeated rows come back as often as they came.
Extra columns are ignored.  An empty input gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import components, group_starts, pairs_within, partitions, small_batches, stored, whole_groups

BITS = 16
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, words_each: int, seen: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; A-Z count as a-z, white space is ASCII's."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
    k = min(words_each, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = out * np.uint64(_ODD[1]) + (h[j : len(h) - k + 1 + j] ^ np.uint64(_ODD[j % 5]))
            out ^= out >> np.uint64(31)
        out *= np.uint64(_ODD[0])
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signatures(sets: list[np.ndarray], lanes: int, seed: int = 7) -> np.ndarray:
    """(len(sets), lanes) uint16: the low bits of each lane's smallest hash; sets are not empty."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**32, lanes, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, lanes, dtype=np.uint32)
    out = np.empty((len(sets), lanes), np.uint16)
    lo = 0
    while lo < len(sets):
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= 30_000):
            total += len(sets[hi])
            hi += 1
        x = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        with np.errstate(over="ignore"):
            for k in range(lanes):
                v = x * mul[k] + add[k]
                v ^= v >> np.uint32(15)
                v *= np.uint32(0x85EBCA6B)
                v ^= v >> np.uint32(13)
                out[lo:hi, k] = np.minimum.reduceat(v, at).astype(np.uint16)
        lo = hi
    return out


def slots(lanes: int, chunk: int, errors: int) -> list[tuple[int, ...]]:
    """The lanes that each bucket slot compares: every chunk with every choice of lanes left out."""
    return [tuple(lane for lane in range(c, c + chunk) if lane - c not in out)
            for c in range(0, lanes, chunk) for out in itertools.combinations(range(chunk), errors)]


def _lanes(column, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, lanes)


def _sketch(words_each: int, lanes: int):
    def run(batches):
        seen = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words_each, seen) for t in batch.column(1)]
            some = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            for i, row in zip(some, signatures([sets[i] for i in some], lanes), strict=True):
                sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])
    return run


def _file(lanes: int, chunk: int, errors: int):
    def run(batches):
        compare = slots(lanes, chunk, errors)
        for batch in batches:
            sig = _lanes(batch.column(1), lanes).astype(np.int64)
            keys = np.empty((len(sig), len(compare)), np.int64)
            for s, cols in enumerate(compare):
                key = np.full(len(sig), s, np.int64)
                for c in cols:
                    key = key << BITS | sig[:, c]
                keys[:, s] = key
            who = np.repeat(np.arange(len(sig)), len(compare))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(who)), batch.column(2).take(pa.array(who))],
                                             names=["key", "digest", "tie"])
    return run


def _candidates(table: pa.Table, sizes: np.ndarray, sig: np.ndarray, compare, distance: int, percent: int):
    """Index pairs of a table's groups that this bucket is the first to hold and that may be similar."""
    block = table.column("block").to_numpy()
    i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
    slot = table.column("key").to_numpy() >> (BITS * len(compare[0]))
    starts = group_starts(table, ["key", "i", "j"])
    for x, y in pairs_within(starts, table.num_rows, runs=group_starts(table, ["key", "i", "j", "tie"])):
        ok = (i[x] == j[x]) | (block[x] != block[y])
        ok &= 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
        x, y = x[ok], y[ok]
        equal = sig[x] == sig[y]
        first = np.full(len(x), len(compare))
        for s in range(len(compare) - 1, -1, -1):
            first[np.logical_and.reduce([equal[:, c] for c in compare[s]])] = s
        ok = (first == slot[x]) & (equal.shape[1] - equal.sum(1) <= distance)
        yield x[ok], y[ok]


def _needs(lanes: int, chunk: int, errors: int, distance: int, percent: int):
    def run(batches):
        compare = slots(lanes, chunk, errors)
        for table in whole_groups(batches, ["key", "i", "j"]):
            sig = _lanes(table.column("sig"), lanes)
            sizes = table.column("n_shingles").to_numpy()
            named = np.zeros(table.num_rows, bool)
            for x, y in _candidates(table, sizes, sig, compare, distance, percent):
                named[x] = named[y] = True
            yield from table.filter(pa.array(named)).select(["key", "i", "j", "block", "digest", "cid", "tie"]).to_batches()
    return run


def _fetch(words_each: int, lanes: int):
    """(text, digest, cid, tie, groups) -> a row with the set for each group."""
    def run(batches):
        seen = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = batch.slice(lo, 64).to_pylist()
                sets = [shingle_set(r["text"], words_each, seen) for r in rows]
                mine = [k for k, (r, s) in enumerate(zip(rows, sets, strict=True)) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == r["digest"]]
                if not mine:
                    continue
                sig = signatures([sets[k] for k in mine], lanes)
                out = [(g["key"], g["i"], g["j"], g["block"], rows[k]["cid"], rows[k]["tie"], s.tobytes(), sets[k].tobytes())
                       for k, s in zip(mine, sig, strict=True) for g in rows[k]["groups"]]
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 names=["key", "i", "j", "block", "cid", "tie", "sig", "set"])
    return run


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if len(one) < len(two):
        one, two = two, one
    if 100 * len(two) < percent * len(one):
        return False
    at = np.searchsorted(one, two)
    at[at == len(one)] = 0
    both = int((one[at] == two).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _stars(percent: int):
    """Links of centres to classes; a group's rows follow their centre's, which has block 1."""
    def run(batches):
        centre, cid = np.empty(0, np.uint64), 0
        for batch in batches:
            a, b = [], []
            for block, own, raw in zip(batch.column("block").to_pylist(), batch.column("cid").to_pylist(), batch.column("set"), strict=True):
                mine = np.frombuffer(raw.as_py(), np.uint64)
                if block:
                    centre, cid = mine, own
                elif similar(centre, mine, percent):
                    a.append(cid)
                    b.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _confirm(lanes: int, chunk: int, errors: int, distance: int, percent: int):
    def run(batches):
        compare = slots(lanes, chunk, errors)
        for table in whole_groups(batches, ["key", "i", "j"]):
            sig = _lanes(table.column("sig"), lanes)
            sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            cid = table.column("cid").to_numpy()
            first = group_starts(table, ["key", "i", "j", "tie"])  # tied classes count as linked
            root = np.repeat(first, np.diff(np.append(first, len(sets)))).tolist()

            def find(a: int, root=root) -> int:
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                return a

            links = []
            for xs, ys in _candidates(table, sizes, sig, compare, distance, percent):
                for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                    a, b = find(x), find(y)
                    if a == b:
                        continue
                    if similar(sets[x], sets[y], percent):
                        root[max(a, b)] = min(a, b)
                        links.append((x, y))
            if links:
                x, y = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(cid[x]), pa.array(cid[y])], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, words_each: int = 4, percent: int = 80, lanes: int = 32, chunk: int = 4,
                    errors: int = 1, distance: int = 20, block: int = 2048, crowd: int = 64, stars: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links have 100 * intersection >= ``percent`` * union of their shingle sets.  ``distance`` is the most
    lanes in which a candidate may differ; at least the guaranteed distance, else the guarantee shrinks.
    """
    if lanes % chunk or errors >= chunk or len(slots(lanes, chunk, errors)).bit_length() + BITS * (chunk - errors) > 63:
        raise ValueError("lanes must be whole chunks, and a slot and its lanes must fit 63 bits")
    method = (lanes, chunk, errors, distance, percent)
    small_batches(docs)
    n = partitions(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stored(texts.mapInArrow(_sketch(words_each, lanes), "doc_id long, n_shingles long, digest binary, sig binary"), "sketch")
    classes = stored(sketch.filter("digest is not null and doc_id is not null").groupBy("digest")
                     .agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")),
                     "classes").withColumn("tie", F.col("cid"))

    def filed() -> DataFrame:
        return classes.select("digest", "sig", "tie").mapInArrow(_file(lanes, chunk, errors), "key long, digest binary, tie long")

    def sent(wanted: DataFrame) -> DataFrame:
        # by merge at every size: a broadcast here would only ever fit small inputs
        return (texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("cid")).select("text", "digest", "cid", "tie", "groups")
                .mapInArrow(_fetch(words_each, lanes), "key long, i int, j int, block int, cid long, tie long, sig binary, set binary"))

    # crowded buckets: every class against the centres it shares most of them with
    full = filed().groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("digest").alias("h"), "digest", "tie")).alias("centre")).filter(F.col("c") > crowd)
    full = stored(full.select("key", F.col("centre.digest").alias("to"), F.col("centre.tie").alias("to_cid")), "crowded")
    ties = None
    if not full.isEmpty():
        near = (filed().join(full, "key").filter("digest <> to").groupBy("digest", "tie").agg(F.collect_list(F.struct("to_cid", "to")).alias("to"))  # a bucket each
                .withColumn("to", F.expr("transform(array_distinct(to), t -> struct(size(filter(to, u -> u = t)) as shared, t.to_cid, t.to))"))
                .withColumn("to", F.explode(F.slice(F.sort_array("to", asc=False), 1, stars))).select("digest", F.col("tie").alias("cid"), "to.to_cid", "to.to"))
        near = stored(near, "near")
        count = near.groupBy("to_cid", "to").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("slices"))
        zero = F.lit(0)
        spokes = near.join(count.drop("to"), "to_cid").select("digest", "cid", F.struct(F.col("to_cid").alias("key"), F.pmod(F.xxhash64("digest"), F.col("slices")).cast("int").alias("i"),
                                                                                        zero.alias("j"), zero.alias("block")).alias("group"))
        hubs = count.select(F.col("to").alias("digest"), F.col("to_cid").alias("cid"), F.explode(F.sequence(zero, F.col("slices") - 1)).alias("i"), F.col("to_cid").alias("key"))
        hubs = hubs.select("digest", "cid", F.struct("key", "i", zero.alias("j"), F.lit(1).alias("block")).alias("group"))
        # a centre of very many slices comes as several rows
        part = F.when(F.col("group.block") == 1, F.floor(F.col("group.i") / 1024)).otherwise(F.lit(-1))
        wanted = spokes.unionByName(hubs).groupBy("digest", "cid", part.alias("part")).agg(F.collect_list("group").alias("groups")).withColumn("tie", F.col("cid"))
        links = sent(wanted).repartition(n, "key", "i").sortWithinPartitions("key", "i", F.desc("block")).mapInArrow(_stars(percent), "a long, b long")
        ties = stored(links, "ties")
        tied = components(ties)
        classes = stored(classes.drop("tie").join(tied, F.col("cid") == F.col("node"), "left")
                         .select("digest", "cid", "n_shingles", "sig", F.coalesce("component", "cid").alias("tie")), "classes")
    shared = filed().groupBy("key").agg(F.count("*").alias("c"), F.min("tie").alias("low"), F.max("tie").alias("high")).filter("low < high").select("key", "c")
    blocks = F.ceil(F.col("c") / F.lit(block)).cast("int")
    member = (filed().drop("tie").join(shared, "key").withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest"))
    needs = (member.join(classes, "digest").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "tie")
             .select("key", "i", "j", "block", "digest", "cid", "tie", "n_shingles", "sig")
             .mapInArrow(_needs(*method), "key long, i int, j int, block int, digest binary, cid long, tie long"))
    wanted = stored(needs.groupBy("digest", "cid", "tie").agg(F.collect_list(F.struct("key", "i", "j", "block")).alias("groups")), "wanted")
    links = (sent(wanted).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "tie")
             .mapInArrow(_confirm(*method), "a long, b long"))
    if ties is not None:
        links = links.unionAll(ties)
    found = components(links)
    ids = (classes.select(F.col("digest").alias("d"), "cid").join(found, F.col("cid") == F.col("node"), "left")
           .select("d", F.coalesce("component", "cid").alias("class_component")))
    return (sketch.join(ids, F.col("digest") == F.col("d"), "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
