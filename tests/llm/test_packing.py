"""Packing as an exact round trip, and retrieval that beats chance."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brickyard.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(got, data, window):
    """Every id in one piece, sequences without gaps; returns the sequences."""
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((str(i), zlib.crc32(ids.tobytes())) for i, t, *_ in data for ids in [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")])
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    by = {}
    for i, t, *_ in data:
        by.setdefault(i, []).append(ids_of(t))
    for i, texts in by.items():
        left = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        for ids in texts:  # repeated rows: any matching chain of pieces
            at = 0
            while at < len(ids):
                piece = next(p for p in left if p[0] == at and p[3] == len(ids) and zlib.crc32(ids[at : at + p[1]].tobytes()) == p[2])
                left.remove(piece)
                at += piece[1]
            assert at == len(ids)
        assert not left
    assert len(want) == len(data)
    return list(sequences.values())


@pytest.mark.parametrize("shard_docs", [4096, 20])
def test_round_trip(docs, words, shard_docs):
    data = [(k, words(k, k * 3 % 90)) for k in range(70)]
    data += [(None, None), (None, "null id"), (100, ""), (101, words(1, 900)), (102, "éß " * 50), (103, "same"), (103, "same"), (104, "<|endoftext|> x")]
    data = [r for r in data if r[0] != 104]
    got = packing.pack(docs(data), PATH, window=128, shard_docs=shard_docs).collect()
    sequences = check(got, data, 128)
    short = [s for s in sequences if sum(r.length for r in s) < 128]
    assert len(short) <= -(-len(data) // shard_docs)


def test_added_tokens_are_their_ids(docs, words):
    data = [(104, "<|endoftext|> x"), (105, "a <|endoftext|> b"), (106, "<|endoftext|>" * 200), (107, f"{words(1, 300)}<|endoftext|>{words(2, 300)}"), (108, "<|endoftext> |x|"), (109, "")]
    assert packing.Encoder(PATH)("a <|endoftext|> b") == Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = packing.pack(docs(data), PATH, window=128).collect()
    check(got, data, 128)
    assert {r.doc_tokens for r in got if r.doc_id == 106} == {201}


def test_neighbours_share_words(docs):
    rng = random.Random(0)
    topics = [[f"t{t}word{k}" for k in range(30)] for t in range(6)]
    data = [(k, " ".join(rng.choices(topics[k % 6], k=40))) for k in range(120)]
    got = packing.pack(docs(data), PATH, window=1024, shard_docs=4096).collect()
    same = total = 0
    for s in check(got, data, 1024):
        seed = s[0].doc_id % 6
        same += sum(r.length for r in s[1:] if r.doc_id % 6 == seed)
        total += sum(r.length for r in s[1:])
    assert same / total > 0.6  # chance is one in six


def test_fast_ids_equal_the_library(spark):
    encoder = packing.Encoder(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "a  b\t\tc\n\n d", "I'll we've x", "日本語 русский ñ", "1234 5,6.7", "x" * 3000, "\0\x1f\x85"]
    assert encoder.fast is not None
    assert [encoder.fast.encode_ordinary(t) for t in texts] == [encoder.slow.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.fast = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).fast
    encoder.fast.encode_ordinary = lambda t: []
    encoder.compare(["some text"])
    assert encoder.fast is None and encoder("a b") == ids_of("a b")[:-1].tolist()


def test_empty_table(docs):
    assert packing.pack(docs([]), PATH).collect() == []


def test_equal_rows_are_dealt_over_the_shards(spark, words):
    """A third of all rows and more may be equal: no shard gets them all."""
    rows = [(None, "")] * 6000 + [(k, words(k, 30)) for k in range(600)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, shard_docs=512).select((F.col("sequence_id") / 2**32).cast("long").alias("shard"))
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(sizes) >= 6600 and len(sizes) >= 10 and max(sizes) < 2.5 * 512


def test_ids_as_arrays_equal_the_library(spark):
    """Ids come as arrays without a list of them; a difference there ends the fast way too."""
    encoder = packing.Encoder(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "a  b\t\tc\n\n d", "I'll we've x", "日本語 русский ñ", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext", "\0\x1f\x85"]
    fast = encoder.fast
    assert [encoder.array(t).tolist() for t in texts] == [encoder.slow.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.compare(texts)
    assert encoder.fast is fast
    listed = []
    fast.encode_ordinary = lambda t: listed.append(t) or []
    assert encoder.array("a b").tolist() == ids_of("a b")[:-1].tolist() and not listed
    del fast.encode_ordinary
    fast.encode_to_numpy = lambda t, **kw: np.zeros(1, np.uint32)
    encoder.compare(["some text"])
    assert encoder.fast is None and encoder.array("a b").tolist() == ids_of("a b")[:-1].tolist()


def plain_windows(tails, words, order, idf, mean, window, query_terms):
    """The filling of windows tail by tail, one score at a time."""
    weights = []
    for w in words:
        counts = {t: w.tolist().count(t) for t in sorted(set(w.tolist()))}
        weights.append({t: float(idf[t] * np.int64(n) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))) for t, n in counts.items()})
    left, place, out = [len(t) for t in tails], {d: k for k, d in enumerate(order)}, []
    while any(left):
        pieces, space = [], window
        seed = next(d for d in order if left[d])

        def take(d):
            nonlocal space
            n = min(space, left[d])
            pieces.append((d, len(tails[d]) - left[d], n))
            left[d] -= n
            space -= n

        take(seed)
        asked = sorted(weights[seed], key=lambda t: (-weights[seed][t], t))[:query_terms]
        scores = {d: sum(weights[d].get(t, 0.0) for t in asked) for d in range(len(tails)) if left[d]}
        ranked = sorted((d for d in scores if scores[d] > 0), key=lambda d: (-scores[d], place[d]))
        for d in ranked:
            if space and left[d] <= space:
                take(d)
        for d in ranked:
            if space and left[d]:
                take(d)
        for d in order:
            if space and left[d]:
                take(d)
        out.append(pieces)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_equal_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    count = int(rng.integers(1, 60))
    words = [rng.integers(0, 16, int(rng.integers(0, 12))) for _ in range(count)]
    for k in range(1, count, 5):
        words[k] = words[k - 1]  # equal scores go by the order
    tails = [np.arange(max(len(w) * 2, int(rng.integers(0, 3)))) for w in words]
    order = rng.permutation(count)
    idf = np.log(1 + rng.integers(1, 9, 16)).astype(np.float32)
    args = (tails, words, order, idf, 5.5, 32, 6)
    got = list(packing.fill_windows(*args))
    assert got == plain_windows(tails, words, order.tolist(), *args[3:])
    term, tail, weight = packing.postings(words, idf, 5.5)
    assert list(zip(term.tolist(), tail.tolist(), strict=True)) == sorted({(int(t), k) for k, w in enumerate(words) for t in w}) and len(weight) == len(term)
