"""Repeated passages: maximal repeats of at least ``least`` bytes over all documents, and their removal.

Sharding the suffix array.  A document's windows of ``least`` bytes are dealt out by their minimizer, the
smallest hash among their ``gram``-byte substrings; equal windows have equal minimizers, so all
suffixes that share a window meet in one bucket.  Neighbouring windows with one minimizer travel as one
string.  A first pass only exchanges the minimizers' hashes, each once a chunk of documents: strings
are sent only for those that occur in two documents, and each once a chunk, whatever the number of its
occurrences there.  A passage that a third of all documents share is one string a chunk.

Buckets are ranges of the minimizers' hashes.  The smallest of many hashes is small, so it is mixed once
more; else the first range would get most of them.  A bucket is compared in parts, smaller ranges of about
``PART`` bytes of strings.

Enhanced suffix array.  A bucket sorts the suffixes of its distinct strings, takes the common prefix lengths
of neighbours and scans them with a stack: every interval of the common-prefix tree with at least
``least`` bytes is a repeat with all its occurrences.  It is kept as a maximal repeat if the bytes to the
left of its occurrences differ (or are cut off by the string), for else a longer repeat one byte
further left has the same occurrences.  A string without a rival in its bucket is a repeat by itself.
Suffixes are compared over ``width`` bytes; longer repeats come as overlapping ones.  If a minimizer has
very many strings, its suffixes are first dealt by a hash of their first ``least`` bytes: those that are alone
with them are in no repeat, and each repeat has all its suffixes in one slice.

Removal.  Each repeat goes back with its smallest doc_id, and a document loses what it shares with a
smaller one.  Judged is the input, so removals don't depend on each other.

Chunks, of about ``chunk_bytes`` of whole texts, are stored once, compressed, and all passes read them.

Nulls and ties: null and empty texts have no bytes; rows without doc_id take no part and stay whole; rows
that share a doc_id take nothing from each other.  Repeated rows come back as often as they came.  Extra
columns are ignored.  An empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import group_starts, partitions, small_batches, stored, whole_groups

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of this many bytes, which bounds the memory of a very long one.
PIECE = 1 << 20
#: About so many bytes of strings of a bucket are compared at once.
PART = 16 << 20
_BUCKETED = "bucket int, chunk long, first int, n int, packed binary"
_SENT = (np.uint64, np.int64, np.int64, np.int32)


class Hasher:
    """Rolling hashes of byte strings, vectorised: sums of byte codes times powers, modulo 2 ** 64."""

    def __init__(self, gram: int, least: int, seed: int = 1):
        self.gram, self.least, self.span = gram, least, least - gram + 1
        self.codes = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        self.up, self.down = self._powers(_BASE), self._powers(_INVERSE)

    @staticmethod
    def _powers(base: int, n: int = PIECE + 4096) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, text: np.ndarray) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.codes[text] * self.up[: len(text)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.mixed((sums[end] - sums[start]) * self.down[start])

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        """Another number for each number, evenly spread."""
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def strings(self, text: np.ndarray):
        """(minimizer, string hash, start, end) of the strings that a text's windows are grouped into."""
        least, span = self.least, self.span
        parts = []
        for lo in range(0, max(len(text) - least + 1, 0), PIECE):
            part = text[lo : lo + PIECE + least - 1]
            sums = self.sums(part)
            at = np.arange(len(part) - self.gram + 1)
            low = _sliding_min(self.between(sums, at, at + self.gram), span)
            start = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            end = np.append(start[1:], len(low)) + least - 1
            parts.append((self.mixed(low[start]), self.between(sums, start, end), start + lo, end + lo))
        if not parts:
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    out, k, n = values, 1, len(values) - span + 1
    while k * 2 <= span:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[:n], out[span - k : span - k + n])


def suffix_repeats(strings: list[bytes], least: int, width: int):
    """(suffix string, suffix offset, repeats): the suffixes in sorted order and the maximal repeats.

    A repeat is (first, last, length): the sorted suffixes first..last share ``length`` bytes, and no
    more to the left.
    """
    return _Suffixes(strings, least, width).repeats()


class _Suffixes:
    """The suffixes of at least ``least`` bytes of some strings."""

    def __init__(self, strings: list[bytes], least: int, width: int):
        self.least, self.width = least, width
        self.sizes = np.array([len(s) for s in strings])
        count = self.sizes - least + 1
        self.owner = np.repeat(np.arange(len(strings)), count)
        self.offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.text = np.frombuffer(b"".join(strings) + bytes(width), np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def repeats(self, some: np.ndarray | slice = slice(None), block: int = 1 << 16):
        """What ``suffix_repeats`` gives, of some suffixes."""
        owner, offset, width = self.owner[some], self.offset[some], self.width
        at, length = self.begin[owner] + offset, np.minimum(self.sizes[owner] - offset, width)
        view = np.lib.stride_tricks.sliding_window_view(self.text, width)
        grid = np.empty((len(at), width), np.uint8)
        for lo in range(0, len(at), block):
            part = view[at[lo : lo + block]]
            part[np.arange(width) >= length[lo : lo + block, None]] = 0
            grid[lo : lo + block] = part
        order = np.argsort(grid.view(f"S{width}").ravel(), kind="stable")
        owner, offset, length, at = owner[order], offset[order], length[order], at[order]
        common = np.empty(max(len(at) - 1, 0), np.int64)
        for lo in range(0, len(common), block):
            part = grid[order[lo : lo + block + 1]]
            differ = part[1:] != part[:-1]
            common[lo : lo + block] = np.where(differ.any(1), differ.argmax(1), width)
        common = np.minimum(common, np.minimum(length[1:], length[:-1]))
        left = np.where(offset > 0, self.text[at - 1].astype(np.int64), -1 - np.arange(len(owner)))
        return owner, offset, _maximal(common, left, self.least, width)

    def slices(self, at_once: int):
        """The suffixes in slices of about ``at_once`` that have all rivals of theirs; of very many, those without a rival are left out."""
        if len(self.owner) <= 4 * at_once:
            yield slice(None)
            return
        hasher, codes = Hasher(self.least, self.least), np.empty(len(self.owner), np.uint64)
        ends, lo, done = self.begin + self.sizes, 0, 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, self.begin[lo] + PIECE, side="right")))
            start = np.flatnonzero(_window_starts(self.sizes[lo:hi], self.least))
            codes[done : done + len(start)] = hasher.between(hasher.sums(self.text[self.begin[lo] : ends[hi - 1]]), start, start + self.least)
            lo, done = hi, done + len(start)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        members = np.diff(np.append(first, len(order)))
        order, members = order[np.repeat(members > 1, members)], members[members > 1]
        upto, lo = np.append(0, np.cumsum(members)), 0
        while lo < len(members):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + at_once, side="right")) - 1)
            yield order[upto[lo] : upto[hi]]
            lo = hi


def _window_starts(sizes: np.ndarray, least: int) -> np.ndarray:
    """For every byte of joined strings whether a window of its string starts there."""
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    return rest >= least


def _maximal(common: np.ndarray, left: np.ndarray, least: int, width: int) -> np.ndarray:
    """(first, last, length) rows of the common-prefix intervals whose left bytes differ."""
    # other[i]: suffix i and i - 1 have different left bytes; its running sum tells about an interval
    other = np.append(0, np.cumsum(left[1:] != left[:-1]))
    deep = np.append(np.append(False, common >= least), False)
    first, last = np.flatnonzero(deep[1:] & ~deep[:-1]), np.flatnonzero(~deep[1:] & deep[:-1])
    if not len(first):
        return np.empty((0, 3), np.int64)
    low = np.minimum.reduceat(common, first)
    high = np.maximum.reduceat(np.append(common, 0), np.ravel(np.column_stack([first, last])))[::2]
    flat = low == high
    out = [np.column_stack([first, last, low])[flat]]
    nested = []
    for f, t in zip(first[~flat].tolist(), last[~flat].tolist(), strict=True):
        stack: list[tuple[int, int]] = []
        for k, c in enumerate([*common[f:t].tolist(), 0], f):
            begin = k
            while stack and stack[-1][1] > c:
                begin, value = stack.pop()
                nested.append((begin, k, value))
            if c >= least and (not stack or stack[-1][1] < c):
                stack.append((begin, c))
    out.append(np.array(nested, np.int64).reshape(-1, 3))
    found = np.concatenate(out)
    return found[(other[found[:, 1]] > other[found[:, 0]]) | (found[:, 2] >= width)]


def smallest(strings: list[bytes], docs: np.ndarray, lows: np.ndarray, least: int, width: int, at_once: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string the smallest document that holds it, through the maximal repeats.

    Returns them in the order of the strings, and where each string's windows begin.  ``docs`` has the smallest document with each string and ``lows`` its minimizer.  Strings that are alone with
    their minimizer stand for themselves; the others are sorted in slices of whole minimizers, or of a minimizer's suffixes.
    """
    count = np.array([len(s) - least + 1 for s in strings])
    begin = np.cumsum(count) - count
    out = np.repeat(docs, count)
    order = np.argsort(lows, kind="stable")
    edge = np.append(np.flatnonzero(np.append(True, lows[order][1:] != lows[order][:-1])), len(order))
    several = np.flatnonzero(np.diff(edge) > 1)
    held, size = [], 0
    for k in several.tolist():
        own = order[edge[k] : edge[k + 1]]
        held.append(own)
        size += int(count[own].sum())
        if size >= at_once:
            _spread(np.concatenate(held), strings, docs, begin, out, least, width, at_once)
            held, size = [], 0
    if held:
        _spread(np.concatenate(held), strings, docs, begin, out, least, width, at_once)
    return out, begin


def _spread(some: np.ndarray, strings: list[bytes], docs: np.ndarray, begin: np.ndarray, out: np.ndarray, least: int, width: int, at_once: int) -> None:
    """Lower the windows of some strings to the smallest document of each repeat that covers them."""
    suffixes = _Suffixes([strings[k] for k in some], least, width)
    for own in suffixes.slices(at_once):
        owner, offset, repeats = suffixes.repeats(own)
        if not len(repeats):
            continue
        low, at = docs[some][owner], begin[some][owner] + offset
        best = np.minimum.reduceat(np.append(low, 0), np.ravel(np.column_stack([repeats[:, 0], repeats[:, 1] + 1])))[::2]
        members = repeats[:, 1] - repeats[:, 0] + 1
        covers = repeats[:, 2] - least + 1
        for which, member in _expanded(members):
            suffix = repeats[which, 0] + member
            for some_pairs, k in _expanded(covers[which]):
                np.minimum.at(out, at[suffix[some_pairs]] + k, best[which[some_pairs]])


def _expanded(counts: np.ndarray, at_once: int = 250_000):
    """(index, 0 .. count - 1) of every index, as arrays of about ``at_once``; one large count may come alone in parts."""
    upto, lo, skip = np.cumsum(counts), 0, 0
    while lo < len(counts):
        before = (upto[lo - 1] if lo else 0) + skip
        hi = max(lo + 1, int(np.searchsorted(upto, before + at_once, side="right")))
        if hi == lo + 1 and counts[lo] - skip > at_once:
            yield np.full(at_once, lo), np.arange(skip, skip + at_once)
            skip += at_once
            continue
        n = counts[lo:hi].copy()
        n[0] -= skip
        index = np.repeat(np.arange(lo, hi), n)
        place = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
        place[: n[0]] += skip
        if len(index):
            yield index, place
        lo, skip = hi, 0


class Chunk:
    """The strings of a chunk's documents, equal ones numbered once; ``shared``: only those whose minimizer the row has as shared."""

    def __init__(self, row: dict, hasher: Hasher, shared: bool = False):
        self.docs, self.known = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["known"], bool)
        self.text = zstandard.decompress(row["text"]) if row["text"] else b""
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        whole = np.frombuffer(self.text, np.uint8)
        parts = []
        with np.errstate(over="ignore"):
            for k in np.flatnonzero(self.known).tolist():
                low, code, a, b = hasher.strings(whole[self.start[k] : self.end[k]])
                parts.append((low, code, a + self.start[k], b + self.start[k], np.full(len(low), k)))
        empty = [(np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3]
        self.low, code, self.a, self.b, self.doc = (np.concatenate(p) for p in zip(*(parts or empty), strict=True))
        if shared:
            values, place = np.unique(self.low, return_inverse=True)
            ok = _shared_of(row, len(values))[place]
            self.low, code, self.a, self.b, self.doc = (v[ok] for v in (self.low, code, self.a, self.b, self.doc))
        self.ids = self.docs[self.doc] if len(self.doc) else np.empty(0, np.int64)
        # one number for equal strings, in the order of minimizer, hash and length
        order = np.lexsort((self.ids, self.b - self.a, code, self.low))
        new = np.ones(len(order), bool)
        for v in (self.low, code, self.b - self.a):
            new[1:] &= v[order][1:] == v[order][:-1]
        new[1:] = ~new[1:]
        self.first = np.flatnonzero(new)
        self.order, self.number = order, np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1

    def minimizers(self):
        """(distinct minimizers, whether two documents of this chunk have it)"""
        low, ids = self.low[self.order], self.ids[self.order]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.empty(0, np.int64)
        if not len(first):
            return low, np.empty(0, bool)
        return low[first], np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)


def _chunks(chunk_bytes: int):
    def run(batches):
        held, size = [], 0

        def flush():
            ids, texts = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([np.array([i or 0 for i in ids], np.int64).tobytes()], pa.binary()), pa.array([np.array([i is not None for i in ids]).tobytes()], pa.binary()),
                 pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary()),
                 pa.array([sum(map(len, texts))], pa.int64())],
                names=["docs", "known", "sizes", "text", "n_bytes"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                held.append((key, raw))
                size += len(raw) + 64
                if size >= chunk_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return run


def _rows(batch: pa.RecordBatch):
    """The rows as dicts, one copied at a time: they are large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _announce(gram: int, least: int, buckets: int):
    """(bucket, chunk, first, n, packed minimizers and flags) for every chunk and bucket."""
    def run(batches):
        hasher = Hasher(gram, least)
        for batch in batches:
            for row in _rows(batch):
                low, several = Chunk(row, hasher).minimizers()
                yield _by_bucket(low, buckets, row["chunk"], [low, several])
    return run


def _by_bucket(low: np.ndarray, buckets: int, chunk: int, columns: list[np.ndarray], texts: list[bytes] | None = None) -> pa.RecordBatch:
    """A row for each bucket with its slices of the columns; ``low`` is sorted and buckets are its ranges."""
    bounds = [(k << 64) // buckets for k in range(1, buckets)]
    cuts = [0, *np.searchsorted(low, np.array(bounds, np.uint64)).tolist(), len(low)]
    some = [(k, x, y) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
    packed = [_packed([v[x:y] for v in columns], texts[x:y] if texts else ()) for _, x, y in some]
    return pa.RecordBatch.from_arrays([pa.array([k for k, *_ in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([x for _, x, _ in some], pa.int32()),
                                       pa.array([y - x for _, x, y in some], pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "chunk", "first", "n", "packed"])


def _packed(columns: list[np.ndarray], texts=()) -> bytes:
    """Arrays of one length, each by first bytes, second bytes and so on, and texts."""
    raw = (np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes() for v in columns)
    return zstandard.compress(b"".join([*raw, *texts]), 3 if texts else 1)


def _unpacked(blob, n: int, *kinds) -> tuple:
    """The arrays, and what follows them."""
    raw, at, out = zstandard.decompress(blob), 0, []
    for size in (np.dtype(k).itemsize for k in kinds):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T))
        at += n * size
    return (*(v.view(k).ravel() for v, k in zip(out, kinds, strict=True)), memoryview(raw)[at:])


def _agree(batches):
    """(chunk, first, n, bits): which of each chunk's minimizers, from the first on, occur in two documents or more."""
    for table in whole_groups(batches, ["bucket"]):
        starts = group_starts(table, ["bucket"]).tolist()
        for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
            t = table.slice(lo, hi - lo)
            lows, several = zip(*(_unpacked(b.as_buffer(), n.as_py(), np.uint64, bool)[:2] for b, n in zip(t.column("packed"), t.column("n"), strict=True)), strict=True)
            values, n = np.unique(np.concatenate(lows), return_counts=True)
            shared = n > 1
            for own, twice in zip(lows, several, strict=True):
                shared[np.searchsorted(values, own[twice])] = True
            bits = [np.packbits(shared[np.searchsorted(values, own)]).tobytes() for own in lows]
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("chunk", "first", "n")), pa.array(bits, pa.binary())], names=["chunk", "first", "n", "bits"])


def _shared_of(row: dict, n: int) -> np.ndarray:
    """Which of the chunk's ``n`` minimizers, in their order, are shared."""
    out = np.zeros(n, bool)
    for r in row["shared"] or ():
        out[r["first"] : r["first"] + r["n"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"])
    return out


def _send(gram: int, least: int, buckets: int):
    """(bucket, chunk, number of the first, n, packed minimizers, smallest doc, how far the largest is from it, sizes, text) of a chunk's distinct shared strings."""
    def run(batches):
        hasher = Hasher(gram, least)
        for batch in batches:
            for row in _rows(batch):
                c = Chunk(row, hasher, shared=True)
                if not len(c.first):
                    continue
                at = c.order[c.first]
                low, a, b = c.low[at], c.a[at], c.b[at]
                ids = c.ids[c.order]
                least_id, most_id = np.minimum.reduceat(ids, c.first), np.maximum.reduceat(ids, c.first)
                yield _by_bucket(low, buckets, row["chunk"], [low, least_id, most_id - least_id, (b - a).astype(np.int32)],
                                 [c.text[s:e] for s, e in zip(a.tolist(), b.tolist(), strict=True)])
    return run


def _compare(least: int, width: int, buckets: int):
    """(chunk, n, packed doc, number, start, end): windows start..end of a chunk's string are in a smaller document."""
    def run(batches):
        for table in whole_groups(batches, ["bucket"]):
            starts = group_starts(table, ["bucket"]).tolist()
            for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
                own = table.slice(lo, hi - lo)
                rows = own.drop_columns("packed").to_pylist()
                for r, blob in zip(rows, own.column("packed"), strict=True):
                    r["packed"] = blob.as_buffer()
                for bounds in _part_bounds(rows, buckets):
                    yield from _compared(rows, bounds, least, width)
    return run


def _part_bounds(rows: list[dict], buckets: int) -> list[tuple[int, int]]:
    """(first, last) minimizer of the parts of a bucket."""
    n = 1 + sum(zstandard.frame_content_size(r["packed"]) for r in rows) // PART
    lo, hi = ((rows[0]["bucket"] + k << 64) // buckets for k in (0, 1))
    cuts = [lo + (hi - lo) * k // n for k in range(n + 1)]
    return [(x, y - 1) for x, y in zip(cuts, cuts[1:], strict=False)]


def _compared(rows: list[dict], bounds: tuple[int, int], least: int, width: int):
    """Batches of ``_compare`` for the strings of a bucket whose minimizers are within ``bounds``."""
    used, text, sizes, ids, lows = [], [], [], [], []
    for r in rows:
        low, least_id, more, size, joined = _unpacked(r["packed"], r["n"], *_SENT)
        x, y = np.searchsorted(low, np.uint64(bounds[0])), np.searchsorted(low, np.uint64(bounds[1]), side="right")
        if x < y:
            skip = size[:x].sum(dtype=np.int64)
            used.append((r["chunk"], r["first"] + x, least_id[x:y] + more[x:y]))
            sizes.append(size[x:y].copy())
            text.append(bytes(joined[skip : skip + size[x:y].sum(dtype=np.int64)]))
            ids.append(least_id[x:y].copy())
            lows.append(low[x:y].copy())
    if not used:
        return
    ends = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(text))])
    del text
    numbered = whole.dictionary_encode()
    place, strings = numbered.indices.to_numpy(), numbered.dictionary.to_pylist()
    del whole, numbered
    docs, low = np.full(len(strings), np.iinfo(np.int64).max), np.empty(len(strings), np.uint64)
    np.minimum.at(docs, place, np.concatenate(ids))
    low[place] = np.concatenate(lows)
    del ids, lows
    best, begin = smallest(strings, docs, low, least, width)
    del strings
    # runs of windows with the same smallest document
    new = np.append(True, best[1:] != best[:-1])
    new[begin] = True
    run_at = np.flatnonzero(new)
    run_end, value = np.append(run_at[1:], len(best)), best[run_at]
    first = np.searchsorted(run_at, begin)
    runs = np.diff(np.append(first, len(run_at)))
    del best, new
    done = 0
    for chunk, number, most in used:
        mine = place[done : done + len(most)]
        done += len(most)
        n = runs[mine]
        which = np.repeat(np.arange(len(mine)), n)
        at = first[mine][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        ok = value[at] < most[which]
        which, at = which[ok], at[ok]
        if len(at):
            base = begin[mine[which]]
            found = [value[at], (number + which).astype(np.int32), (run_at[at] - base).astype(np.int32), (run_end[at] - base).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(at)], pa.int32()), pa.array([_packed(found)], pa.binary())], names=["chunk", "n", "packed"])


def _remove(gram: int, least: int):
    """(doc_id, n_bytes, spans, kept) of a chunk's documents."""
    def run(batches):
        hasher = Hasher(gram, least)
        for batch in batches:
            for row in _rows(batch):
                c = Chunk(row, hasher, shared=True)
                gone = np.zeros(len(c.text) + 1, np.int32)
                found = [_unpacked(f["packed"], f["n"], np.int64, np.int32, np.int32, np.int32)[:4] for f in row["found"] or ()]
                if found:
                    doc, number, start, end = (np.concatenate(v) for v in zip(*found, strict=True))
                    by = np.argsort(number, kind="stable")
                    number, start, end, doc = number[by], start[by], end[by], doc[by]
                    at = np.searchsorted(number, c.number)
                    n = np.searchsorted(number, c.number, side="right") - at
                    which = np.repeat(np.arange(len(n)), n)
                    f = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    ok = doc[f] < c.ids[which]
                    which, f = which[ok], f[ok]
                    np.add.at(gone, c.a[which] + start[f], 1)
                    np.add.at(gone, c.a[which] + end[f] + least - 1, -1)
                hit = np.cumsum(gone[:-1]) > 0
                whole = np.frombuffer(c.text, np.uint8)
                ids, sizes, spans, kept = [], [], [], []
                for k, (a, b) in enumerate(zip(c.start.tolist(), c.end.tolist(), strict=True)):
                    own = hit[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    ids.append(int(c.docs[k]) if c.known[k] else None)
                    sizes.append(b - a)
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
                    kept.append(whole[a:b][~own].tobytes() if len(edge) else c.text[a:b])
                    if sum(map(len, kept[-256:])) > 1 << 22 or len(ids) >= 2000:
                        yield _removed(ids, sizes, spans, kept)
                        ids, sizes, spans, kept = [], [], [], []
                if ids:
                    yield _removed(ids, sizes, spans, kept)
    return run


def _removed(ids, sizes, spans, kept) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                                      names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, least: int = 50, gram: int = 20, width: int = 80, chunk_bytes: int = 2 << 20,
                   buckets: int | None = None, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start, end) that go, and kept, the bytes that stay.

    ``buckets`` is the number of suffix arrays; by default one for ``bucket_bytes`` of text, and 256 at least.
    """
    small_batches(docs)
    n = partitions(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = stored(texts.mapInArrow(_chunks(chunk_bytes), "docs binary, known binary, sizes binary, text binary, n_bytes long")
                    .withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    if buckets is None:
        total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
        buckets = max(256, total // bucket_bytes)
    said = chunks.mapInArrow(_announce(gram, least, buckets), _BUCKETED)
    shared = (said.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_agree, "chunk long, first int, n int, bits binary")
              .groupBy("chunk").agg(F.collect_list(F.struct("first", "n", "bits")).alias("shared")))  # at most a piece for each bucket
    shared = stored(shared, "shared")
    known = chunks.join(shared.hint("merge"), "chunk", "left")
    sent = known.mapInArrow(_send(gram, least, buckets), _BUCKETED)
    found = (sent.repartition(n, "bucket").sortWithinPartitions("bucket")
             .mapInArrow(_compare(least, width, buckets), "chunk long, n int, packed binary")
             .groupBy("chunk").agg(F.collect_list(F.struct("n", "packed")).alias("found")))
    return (known.join(found.hint("merge"), "chunk", "left")
            .mapInArrow(_remove(gram, least), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"))
