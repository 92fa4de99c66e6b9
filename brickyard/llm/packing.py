"""Lexical retrieval packing: documents that share words fill each other's windows.

A document is the token ids of its whole text and an end id.  Its full windows are sequences of their
own; what is left of it, its tail, is packed with other tails.  Tails are dealt into shards of about
``shard_docs`` by range of the smallest hash of their words, so that lexical neighbours tend to meet,
and every shard has an inverted index of its tails.  In a seeded order each unused tail
becomes a seed; its telling words are looked up, and the unused tails with the best BM25 scores fill
its window: those that fit go in whole, and the best that doesn't is cut where the window ends; its rest
stays in the index.  If no scored neighbour is left, the next seeds follow.  So every sequence but a
shard's last one is full, and each id is in exactly one piece.

Words are read off the token ids, a word being what follows white space.  Document frequencies and the mean
length cover all tails.  They are one count for each of ``2 ** bits`` hash buckets, which bounds what
goes to the driver and back; a shard's index is bounded by its documents.

Ids are those of the ``tokenizers`` library.  For byte-level BPE files they are made by ``tiktoken`` from the
file's own vocabulary, which is several times faster; every task compares some texts first and goes
back to ``tokenizers`` if they differ.  The string of an added token, as ``<|endoftext|>``, is that token's id, as
``tokenizers`` has it by default; texts that hold one always go to ``tokenizers``.

Nulls and ties: null and empty texts are the end id alone; null doc_ids come back as they came; repeated
rows are packed separately.  Scores that tie go by the seeded order.  Extra columns are ignored.  An
empty input gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import group_starts, small_batches, stored, whole_groups

#: The usual split of byte-level BPE files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts by a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = self.added = None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type", "BPE") == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space"):
            import tiktoken

            letters, special = _byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
            if special:
                self.added = re.compile("|".join(map(re.escape, special)))
            ranks = {bytes(letters[c] for c in w): k for w, k in spec["model"]["vocab"].items() if w not in special}
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def compare(self, texts: list[str]) -> None:
        """Keep the fast way only if it agrees with the library."""
        if self.fast:
            wanted = [e.ids for e in self.slow.encode_batch(texts, add_special_tokens=False)]
            if [self(t) for t in texts] != wanted or [self.array(t).tolist() for t in texts] != wanted:
                self.fast = None

    def __call__(self, text: str) -> list[int]:
        if self.fast and not (self.added and self.added.search(text)):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def array(self, text: str) -> np.ndarray:
        """The same ids as an array, where the fast way allows without a list of them."""
        # a vocabulary without added tokens has nothing that tiktoken could look for
        if self.fast and self.added and not self.added.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self(text), np.uint32)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


CODED = ["doc_id", "h", "route", "tokens", "crcs", "tail", "terms", "counts"]


def _encode(path: str, starts, window: int, end: int, bits: int, seed: int):
    """(doc_id, h, route, tokens, CRCs of the full windows, ids of the tail); a task's last row has its word counts.

    ``route`` is the smallest hash of the tail's words: tails that share words tend to share it.
    """
    def run(batches):
        encoder, checked = Encoder(path), False
        counts, docs, length = np.zeros(1 << bits, np.int64), 0, 0
        last = np.zeros(1 << bits, np.int32)  # each word's last place in the text at hand
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                if not checked:
                    encoder.compare([t for t in texts if len(t) < 20_000][:10])
                    checked = True
                total, crcs, tails, h, route = [], [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    ids = np.append(encoder.array(text), np.uint32(end))
                    full = len(ids) // window
                    total.append(len(ids))
                    crcs.append([crc(ids[k * window : (k + 1) * window]) for k in range(full)])
                    tails.append(ids[full * window :].tobytes())
                    words = terms(ids[full * window :].astype(np.int64), starts.value, bits)
                    if len(words):
                        place = np.arange(len(words), dtype=np.int32)
                        last[words] = place
                        counts[words[last[words] == place]] += 1
                        docs, length = docs + 1, length + len(words)
                    route.append(int(((words + 1) * 0x9E3779B1 & 0xFFFFFFFF).min()) if len(words) else -1)
                    h.append(xxhash.xxh64_intdigest(f"{key}:{len(ids)}:{crc(ids)}", seed=seed) >> 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h, pa.int64()), pa.array(route, pa.int64()), pa.array(total, pa.int64()),
                                                  pa.array(crcs, pa.list_(pa.int64())), pa.array([_narrow(t) for t in tails], pa.binary()),
                                                  pa.nulls(len(total), pa.binary()), pa.nulls(len(total), pa.binary())], names=CODED)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((None, pa.int64()), (0, pa.int64()), (-1, pa.int64()), (0, pa.int64()), ([], pa.list_(pa.int64())),
                                                                        (None, pa.binary()), (np.append(at, [-1, -2]).tobytes(), pa.binary()),
                                                                        (np.append(counts[at], [docs, length]).tobytes(), pa.binary()))], names=CODED)
    return run


def _narrow(tail: bytes) -> bytes:
    """Ids below 2 ** 16 take two bytes; a first byte says which it is."""
    ids = np.frombuffer(tail, np.uint32)
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _wide(tail: bytes) -> np.ndarray:
    return np.frombuffer(tail, "<u2" if tail[0] == 2 else "<u4", offset=1).astype(np.int64)


def word_starts(path: str) -> np.ndarray:
    """By token id, whether the token begins a word: it carries the white space before it."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab()
    out = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    for token, k in vocabulary.items():
        out[k] = token[:1] in ("\u0120", "\u010a", "\u0109", "\u2581", " ", "\n", "\t")
    return out


_POWERS = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def terms(ids: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """Hash buckets of the words that a run of token ids spells."""
    if not len(ids):
        return np.empty(0, np.int64)
    begin = np.append(True, starts[ids[1:]])
    at = np.flatnonzero(begin)
    place = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
    h = np.add.reduceat((ids.astype(np.uint64) + np.uint64(1)) * _POWERS[place % 64], at)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


def _frequencies(batches):
    for batch in batches:
        for term, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(term, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["term", "n"])


def postings(words: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, tail, weight) of each term of each tail by BM25, by term and tail."""
    length = np.array([len(w) for w in words], np.int64)
    bits = max(len(words) - 1, 1).bit_length()
    key = np.sort(np.concatenate(words) << bits | np.repeat(np.arange(len(words)), length)) if len(words) else np.empty(0, np.int64)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    n, key = np.diff(np.append(at, len(key))), key[at]
    term, tail = key >> bits, key & (1 << bits) - 1
    return term, tail, idf[term] * n * (k1 + 1) / (n + k1 * (1 - b + b * length[tail] / mean))


def fill_windows(tails: list[np.ndarray], words: list[np.ndarray], order: np.ndarray, idf: np.ndarray, mean: float, window: int, query_terms: int):
    """Sequences of (tail, start, length) that use every id of the tails once."""
    # from here on a tail is its place in the order, so that what is sorted by score alone ties by the order
    names = order.tolist()
    token, doc, weight = postings([words[d] for d in names], idf, mean)
    by = np.argsort(doc, kind="stable")
    own = np.searchsorted(doc[by], np.arange(len(names) + 1))
    start, rest = np.zeros(len(names), np.int64), np.array([len(tails[d]) for d in names], np.int64)
    at = 0
    while True:
        while at < len(names) and not rest[at]:
            at += 1
        if at == len(names):
            return
        pieces, space = [], window

        def take(d: int) -> None:
            nonlocal space
            n = min(space, int(rest[d]))
            pieces.append((names[d], int(start[d]), n))
            start[d] += n
            rest[d] -= n
            space -= n

        first = at
        take(first)
        if space:
            mine = by[own[first] : own[first + 1]]
            tokens = token[mine[np.argsort(-weight[mine], kind="stable")[:query_terms]]]
            lists = [slice(*ends) for ends in zip(np.searchsorted(token, tokens).tolist(), np.searchsorted(token, tokens, side="right").tolist(), strict=True)]
            if lists:
                score = np.bincount(np.concatenate([doc[x] for x in lists]), np.concatenate([weight[x] for x in lists]), minlength=len(names))
                found = np.flatnonzero((score > 0) & (rest > 0))
                found = found[np.argsort(-score[found], kind="stable")]
                length, k = rest[found], 0
                while space:
                    fits = length[k:] <= space
                    step = int(fits.argmax()) if len(fits) else 0
                    if not len(fits) or not fits[step]:
                        break
                    take(int(found[k + step]))
                    k += step + 1
                if space:
                    left = found[rest[found] > 0]
                    if len(left):  # longer than the space, all of them
                        take(int(left[0]))
        while space and at < len(names):  # no neighbour is left: the next seeds
            if rest[at]:
                take(at)
            else:
                at += 1
        yield pieces


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(stats, window: int, query_terms: int, bits: int):
    def run(batches):
        starts_word, idf, mean = stats.value
        for table in whole_groups(batches, ["shard"]):
            starts = group_starts(table, ["shard"]).tolist()
            for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
                t = table.slice(lo, hi - lo)
                ids, tokens, crcs = t.column("doc_id").to_pylist(), t.column("tokens").to_pylist(), t.column("crcs").to_pylist()
                tails = [_wide(x) for x in t.column("tail").to_pylist()]
                sequence = t.column("shard")[0].as_py() << 32
                out = []
                for k, own in enumerate(crcs):
                    for j, c in enumerate(own):
                        out.append((ids[k], j * window, window, c, tokens[k], sequence, 0))
                        sequence += 1
                order = np.argsort(t.column("h").to_numpy(), kind="stable")
                for pieces in fill_windows(tails, [terms(x, starts_word, bits) for x in tails], order, idf, mean, window, query_terms):
                    offset = 0
                    for d, a, n in pieces:
                        out.append((ids[d], len(crcs[d]) * window + a, n, crc(tails[d][a : a + n]), tokens[d], sequence, offset))
                        offset += n
                    sequence += 1
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in PIECE.split(", ")])
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, shard_docs: int = 4096, query_terms: int = 24,
         bits: int = 20, seed: int = 3) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that executors can open.
    """
    small_batches(docs)
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    starts = sc.broadcast(word_starts(tokenizer))
    coded = stored(texts.mapInArrow(_encode(tokenizer, starts, window, end, bits, seed),
                                    "doc_id long, h long, route long, tokens long, crcs array<long>, tail binary, terms binary, counts binary"), "tails")
    counts = (coded.filter("terms is not null").select("terms", "counts").mapInArrow(_frequencies, "term long, n long")
              .groupBy("term").agg(F.sum("n").alias("n")))
    coded = coded.filter("terms is null").drop("terms", "counts")
    df, n, length = np.zeros(1 << bits, np.float32), 0, 0
    for batch in counts.toArrow().to_batches():  # at most 2 ** bits rows
        at, own = batch.column("term").to_numpy(), batch.column("n").to_numpy()
        df[at[at >= 0]] = own[at >= 0]
        n, length = n + int(own[at == -1].sum()), length + int(own[at == -2].sum())
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    stats = sc.broadcast((starts.value, idf, max(length / max(n, 1), 1.0)))
    shards = max(1, -(-coded.count() // shard_docs))
    # dealt by row in the end, so that rows equal in all else don't stay together
    routed = coded.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, "route", "h", "row")
    routed = routed.drop("row").withColumn("shard", F.spark_partition_id().cast("long"))
    return stored(routed.mapInArrow(_pack(stats, window, query_terms, bits), PIECE), "pieces")
