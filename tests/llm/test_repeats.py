"""Removal of repeats against a table of all windows; the common-prefix scan against its definition."""

import hashlib
import random

import numpy as np

from brickyard.llm import repeats


def brute(rows, least):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - least + 1):
                w = b[k : k + least]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        hit = bytearray(len(b))
        for k in range(len(b) - least + 1) if i is not None else ():
            if first[b[k : k + least]] < i:
                hit[k : k + least] = b"\1" * least
        spans = [k for k in range(len(hit)) if hit[k] and (not k or not hit[k - 1])]
        kept = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        out.append((i, len(b), sum(hit), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **how):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                   for r in repeats.remove_repeats(df, **how).collect()), key=str)


def rows(words):
    rng = random.Random(4)
    shared = [words(s, 14) for s in range(5)] + ["é" * 30, "ab" * 90, "a" * 300]
    out = []
    for k in range(40):
        parts = [words(1000 + k, rng.randrange(5, 60))]
        for p in rng.sample(shared, rng.randrange(0, 4)):
            cut = rng.randrange(0, 20)
            parts.insert(rng.randrange(len(parts) + 1), p[cut:])
        out.append((rng.randrange(10**6), " ".join(parts)))
    out += [(5, None), (6, ""), (None, out[0][1]), (None, None), (7, "x" * 49), (8, "x" * 50), (9, "x" * 51), (10, out[1][1]), (10, out[1][1]),
            (11, "\0" * 80 + "z"), (12, "\0" * 70), (13, out[2][1] + out[3][1])]
    return out


def test_against_brute_force(docs, words):
    data = rows(words)
    assert run(docs(data)) == brute(data, 50)


def test_small_chunks_and_other_buckets(docs, words):
    data = rows(words)
    assert run(docs(data), chunk_bytes=1500, buckets=5) == brute(data, 50)


def test_long_text_is_hashed_in_pieces(docs, words, monkeypatch):
    long = words(1, 3000, 100_000)
    hasher = repeats.Hasher(20, 50)
    whole = hasher.strings(np.frombuffer(long.encode(), np.uint8))
    monkeypatch.setattr(repeats, "PIECE", 1000)
    parts = hasher.strings(np.frombuffer(long.encode(), np.uint8))
    windows = lambda s: {w for a, b in zip(s[2], s[3], strict=True) for w in range(a, b - 49)}
    assert windows(whole) == windows(parts) == set(range(len(long) - 49))


def test_empty_table(docs):
    assert run(docs([])) == []


def test_maximal_repeats_by_definition():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(6, 30))).encode() for _ in range(12)]
    least, width = 4, 64
    owner, offset, found = repeats.suffix_repeats(strings, least, width)
    got = {(strings[owner[f]][offset[f] : offset[f] + n], frozenset(zip(owner[f : t + 1].tolist(), offset[f : t + 1].tolist(), strict=True))) for f, t, n in found}
    want = {}
    for i, s in enumerate(strings):
        for a in range(len(s)):
            for b in range(a + least, len(s) + 1):
                want.setdefault(s[a:b], set()).add((i, a))
    keep = set()
    for text, places in want.items():
        ext = [{strings[i][a + len(text)] if a + len(text) < len(strings[i]) else (i, a) for i, a in places},
               {strings[i][a - 1] if a else (i, a) for i, a in places}]
        if len(places) > 1 and all(len(e) > 1 for e in ext):
            keep.add((text, frozenset(places)))
    assert got == keep


def test_expansion_in_parts():
    for counts in ([3, 0, 7, 1, 1, 25, 2], [0], [30], [1] * 40):
        counts = np.array(counts)
        want = [(i, k) for i, n in enumerate(counts) for k in range(n)]
        for at_once in (1, 4, 10, 1000):
            parts = list(repeats._expanded(counts, at_once))
            assert [(i, k) for a, b in parts for i, k in zip(a.tolist(), b.tolist(), strict=True)] == want
            assert all(len(a) <= at_once for a, _ in parts)


def lowered(strings, ids):
    """For every window of every string the smallest document with it."""
    first = {}
    for s, i in zip(strings, ids, strict=True):
        for k in range(len(s) - 49):
            first[s[k : k + 50]] = min(first.get(s[k : k + 50], i), i)
    return [first[s[k : k + 50]] for s in strings for k in range(len(s) - 49)]


def test_buckets_get_like_shares():
    text = np.random.default_rng(3).integers(32, 127, 500_000).astype(np.uint8)
    low = np.sort(repeats.Hasher(20, 50).strings(text)[0])
    edges = np.array([(k << 64) // 64 for k in range(1, 64)], np.uint64)
    sizes = np.diff([0, *np.searchsorted(low, edges).tolist(), len(low)])
    assert sizes.max() < 1.5 * sizes.mean()


def test_one_minimizer_with_many_strings_is_sorted_in_slices(monkeypatch):
    rng = random.Random(5)
    core, other = "the same forty-three bytes in all of strings", ["".join(rng.choices("abcd ", k=40)) for _ in range(12)]
    strings = sorted({(rng.choice(other)[rng.randrange(30) :] + core + rng.choice(other)[: rng.randrange(8, 40)]).encode() for _ in range(400)} | {b"a" * n for n in range(60, 90)})
    ids = np.array([rng.randrange(10**6) for _ in strings])
    most, scan = [], repeats._maximal
    monkeypatch.setattr(repeats, "PIECE", 700)
    monkeypatch.setattr(repeats, "_maximal", lambda common, left, *how: most.append(len(left)) or scan(common, left, *how))
    for at_once in (40, 10**6):
        most.clear()
        got, _ = repeats.smallest(strings, ids, np.zeros(len(strings), np.uint64), 50, 80, at_once=at_once)
        assert got.tolist() == lowered(strings, ids.tolist())
        windows = {s[k : k + 50]: 0 for s in strings for k in range(len(s) - 49)}
        for s in strings:
            for k in range(len(s) - 49):
                windows[s[k : k + 50]] += 1
        assert max(most) <= (max(40, *windows.values()) if at_once == 40 else 10**6)


def test_a_bucket_is_compared_in_parts(words, monkeypatch):
    import pyarrow as pa

    texts = [words(k % 7, 60) + words(100 + k, 200) + words(50 + k % 3, 40) for k in range(60)]
    hasher, sent = repeats.Hasher(20, 50), []
    for number in range(3):
        own = pa.RecordBatch.from_pydict({"doc_id": list(range(number, 60, 3)), "text": texts[number::3]})
        row = next(iter(repeats._chunks(1 << 20)([own]))).to_pylist()[0] | {"chunk": number}
        n = len(np.unique(repeats.Chunk(row, hasher).low))
        row["shared"] = [{"first": 0, "n": n, "bits": np.packbits(np.ones(n, bool)).tobytes()}]
        sent += list(repeats._send(20, 50, 2)([pa.RecordBatch.from_pylist([row])]))
    buckets = [pa.RecordBatch.from_pylist([r for b in sent for r in b.to_pylist() if r["bucket"] == k], schema=sent[0].schema) for k in (0, 1)]

    def found(batches):
        out = []
        for r in (r for b in batches for r in b.to_pylist()):
            doc, number, start, end, _ = repeats._unpacked(r["packed"], r["n"], np.int64, np.int32, np.int32, np.int32)
            out += [(r["chunk"], *x) for x in zip(doc.tolist(), number.tolist(), start.tolist(), end.tolist(), strict=True)]
        return sorted(out)

    sizes, inner = [], repeats.smallest
    monkeypatch.setattr(repeats, "smallest", lambda strings, *how: sizes.append(sum(map(len, strings))) or inner(strings, *how))
    whole = found(repeats._compare(50, 80, 2)(buckets))
    assert whole and len(sizes) == 2
    total, sizes[:] = sum(sizes), []
    monkeypatch.setattr(repeats, "PART", 20_000)
    assert found(repeats._compare(50, 80, 2)(buckets)) == whole
    assert sum(sizes) == total and len(sizes) > 4 and max(sizes) < 30_000
