"""Targets against resharing step by step; rounding keeps sums, limits and expectations."""

import numpy as np
from pyspark.sql import functions as F

from brickyard.llm import mixing


def want(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def rows(words):
    rng = np.random.default_rng(0)
    return [(k, words(k, int(rng.integers(0, 60))), ("a", "b", "B", "é", None, "zz", "")[int(rng.integers(0, 7)) if k % 3 else 0]) for k in range(500)]


def check(df, data):
    got = df.collect()
    size = {}
    for _, t, s in data:
        size[s] = size.get(s, 0) + len((t or "").split())
    target = want(size)
    taken = dict.fromkeys(size, 0)
    assert len(got) == len(data)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        taken[r.source] += r.taken
    return taken, target


def test_targets_and_sums(docs, words):
    data = rows(words)
    taken, target = check(mixing.mix(docs(data)), data)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in taken)


def test_reduction_tree(docs, words):
    data = rows(words)
    taken, target = check(mixing.mix(docs(data), fan_in=4), data)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in taken)


def test_reruns_agree(docs, words):
    data = rows(words)
    one, two = (sorted((r.doc_id, r.taken) for r in mixing.mix(docs(d).repartition(n), fan_in=16).collect()) for d, n in ((data, 3), (data[::-1], 8)))
    assert one == two


def test_pivotal_steps():
    size = np.array([3.0, 50, 7, 1, 20, 9, 14])
    start = size * np.array([0.2, 0.5, 0.9, 0.4, 0.3, 0.6, 0.0])
    ends = np.array([mixing.settle(size, start, np.random.default_rng(s)) for s in range(4000)])
    assert np.allclose(ends.sum(1), start.sum())
    assert (((ends > 1e-9) & (ends < size - 1e-9)).sum(1) <= 1).all()
    assert np.allclose(ends.mean(0), start, atol=0.06 * size)


def test_odd_rows_and_empty_table(docs):
    data = [(None, None, None), (None, None, None), (1, "", "a"), (1, "one two", "a"), (1, "one two", "a"), (2, None, "b"), (3, "x " * 50_000, "c")]
    got = mixing.mix(docs(data)).collect()
    assert len(got) == len(data) and sum(r.taken for r in got if r.source == "b") == 0
    assert len({r.taken for r in got if r.doc_id == 1 and r.size == 2}) == 1
    assert mixing.mix(docs([])).collect() == []
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(docs([(1, None, "a")])).collect())
