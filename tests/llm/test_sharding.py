"""Shards against sorting all rows by fractional rank."""

import hashlib
import zlib

from brickyard.llm import sharding
from brickyard.llm.queries import QUERIES


def brute(rows, shards=8, seed=17):
    by = {}
    for i, t, s in rows:
        mix = hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
        raw = (t or "").encode()
        by.setdefault(s, []).append((mix, (i is not None, i or 0), len(raw) + 1, zlib.crc32(raw)))
    line = []
    for s, own in by.items():
        for r, row in enumerate(sorted(own), 1):
            line.append(((r - 0.5) / len(own), (s is not None, (s or "").encode()), *row))
    line.sort()
    out, slots = [], [0] * shards
    for place, (_, _, _, (known, i), size, crc) in enumerate(line):
        shard = place * shards // len(line)
        out.append((i if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=str)


def rows(words):
    data = [(k, words(k, k % 30), ("a", "b", None, "ü")[k % 4] if k % 3 else "a") for k in range(333)]
    return [*data, (None, None, None), (None, "x", "a"), (5, "again", "a"), (5, "again", "a"), (700, "é" * 40_000, "b")]


def test_against_sorting(docs, words):
    data = rows(words)
    for shards in (8, 3, 1):
        got = sharding.interleave(docs(data), shards).collect()
        assert sorted([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got], key=str) == brute(data, shards)


def test_counts_and_mixture(docs, words):
    data = rows(words)
    got = sharding.interleave(docs(data), 8).collect()
    n = [sum(r.shard == k for r in got) for k in range(8)]
    assert max(n) - min(n) <= 1
    for s in {r.source for r in got}:
        each = [sum(r.shard == k and r.source == s for r in got) for k in range(8)]
        assert max(each) - min(each) <= 2


def test_fewer_rows_than_shards_and_empty_table(docs):
    assert sorted(r.shard for r in sharding.interleave(docs([(1, "a", "s"), (2, "b", "s")])).collect()) == [0, 4]
    assert sharding.interleave(docs([])).collect() == []


def test_registered_query(spark):
    got = QUERIES["op8_sharding"](spark, "/root/testdata/sf0.001").collect()
    data = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got], key=str) == brute(data)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
