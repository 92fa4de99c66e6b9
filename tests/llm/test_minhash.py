"""Near duplicates against brute force over all pairs."""

import random
import re

import numpy as np

from brickyard.llm import minhash

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i, _ in sets}


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
    return " ".join(w)


def test_against_brute_force(docs, words):
    rows, key = [], 0
    for g in range(6):
        base = words(g, 150)
        for c in range(12):  # copies around the threshold, exact copies and copies in capitals
            rows.append((key, edited(base, c, 100 * g + c) if c < 9 else base.upper() if c == 9 else base))
            key += 7
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE\ntwo"), (1005, "a b c"), (None, words(0, 150)), (None, None),
             (1006, words(0, 150)), (1006, words(0, 150)), (1007, words(99, 5000)), (1008, edited(words(99, 5000), 40, 5))]
    random.Random(1).shuffle(rows)
    want = brute(rows, 4)
    got = minhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    by_id = {r.doc_id: r.n_shingles for r in got}
    assert all(by_id[i] == len(shingles(t, 4)) for i, t, *_ in rows if i is not None)


def test_blocks_find_the_same_links(docs, words):
    rows = [(k, edited(words(3, 120), k % 9, k)) for k in range(60)]
    whole = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows)).collect()}
    split = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), block=8).collect()}
    assert whole == split == brute(rows, 4)


def test_empty_table(docs):
    assert minhash.near_duplicates(docs([])).collect() == []


def test_guarantee():
    """Signatures that differ in up to 15 of 32 lanes always share a slot."""
    rng = np.random.default_rng(0)
    compare = minhash.slots(32, 4, 1)
    for _ in range(500):
        a = rng.integers(0, 1 << 16, 32)
        b = a.copy()
        b[rng.choice(32, 15, replace=False)] += 1
        assert any((a[list(s)] == b[list(s)]).all() for s in compare)


def test_crowded_buckets_are_tied_by_their_centres(docs, words):
    """Groups of near copies, some too far from any centre, with blocks and slices smaller than the groups."""
    rows = [(g * 1000 + c, edited(words(g, 120), c % 11, 100 * g + c)) for g in range(3) for c in range(70)]
    want = brute(rows, 4)
    assert len(set(want.values())) > 3
    for how in ({"crowd": 3, "block": 16}, {"crowd": 8, "stars": 1, "block": 7}):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), **how).collect()} == want


def test_pairs_of_a_run_are_left_out():
    starts, runs = np.array([0, 5]), np.array([0, 2, 4, 5, 7])
    got = [(int(x), int(y)) for xs, ys in minhash.pairs_within(starts, 8, at_once=3, runs=runs) for x, y in zip(xs, ys, strict=True)]
    run = [0, 0, 1, 1, 2, 3, 3, 4]
    assert sorted(got) == [(x, y) for x in range(8) for y in range(x + 1, 8) if (x < 5) == (y < 5) and run[x] != run[y]]
