"""Search against brute force; exact where one part holds all."""

import numpy as np
from pyspark.sql import functions as F

from brickyard.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double, raw string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1.0, "r") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def search(df, k=20, every=20, **how):
    return neighbours.search(df, F.col("vec_id") % every == 0, k=k, **how)


def test_recall_with_parts(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32)
    got = search(table(spark, x.tolist()), rows_per_part=256, sample=1500).toPandas()
    ids = np.arange(3000)
    assert (got.groupby("query_id").size() == 20).all()
    assert neighbours.recall(got, x.astype(float), ids, ids[ids % 20 == 0], 20) >= 0.9
    exact = (x[got.query_id].astype(float) * x[got.vec_id].astype(float)).sum(1)
    assert (exact == got.score).all()


def test_odd_rows_ties_and_blocks(spark):
    x = [[1, 0], [2, 0], [2, 0], [0, 0], None, [None, 1], [float("nan"), 1], [float("inf"), 1], [], [-1, 0], [0, 3], [1, 1], [1, 1, 1]]
    rows = [*x, [2, 0], [1, 0]]
    ids = [*range(len(x)), 2, None]
    for how in ({}, {"block": 2}):
        got = [tuple(r) for r in search(table(spark, rows, ids), k=4, every=11, **how).orderBy("query_id", "rank").collect()]
        # 12 has another length than all others; 2 is there twice and comes once
        assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 11, 1.0), (0, 4, 10, 0.0),
                       (11, 1, 10, 3.0), (11, 2, 1, 2.0), (11, 3, 2, 2.0), (11, 4, 0, 1.0)]


def test_equal_vectors_go_by_id(spark):
    got = search(table(spark, [[1.0, 2.0]] * 50), k=5, every=25).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (25, 0), (25, 1), (25, 2), (25, 3), (25, 4)]


def test_empty_table(spark):
    assert search(table(spark, [])).collect() == []
    assert search(table(spark, [None, [0.0, 0.0]])).collect() == []


def test_balanced_parts():
    x = np.random.default_rng(1).normal(size=(640, 8)).astype(np.float32)
    part = neighbours.balanced_parts(x, neighbour_graph := neighbours.neighbour_graph(x, 8), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(640 / 8 * 1.05)
    cut = (part[neighbour_graph] != part[:, None]).mean()
    assert cut < 0.75  # chance is 7 of 8


def test_recall_of_short_queries_where_lengths_differ(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 6000)] + 0.6 * rng.normal(size=(6000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(0.5 * rng.normal(size=(6000, 1)))).astype(np.float32)
    got = search(table(spark, x.tolist()), rows_per_part=256, sample=3000).toPandas()
    ids, length = np.arange(6000), np.linalg.norm(x, axis=1)
    asked = ids[ids % 20 == 0]
    short = asked[length[asked] < np.median(length[asked])]
    assert neighbours.recall(got, x.astype(float), ids, asked, 20) >= 0.9
    assert neighbours.recall(got, x.astype(float), ids, short, 20) >= 0.9


def test_vectors_of_other_lengths_meet_their_like(spark):
    rng = np.random.default_rng(6)
    x = [rng.normal(size=4 if k % 7 else 3).astype(np.float32).tolist() for k in range(400)] + [[1.0, 2.0], [2.0, 1.0]]
    for how in ({}, {"block": 16}):
        got = search(table(spark, x), k=3, every=5, **how).collect()
        for q in range(0, 402, 5):
            like = [i for i in range(402) if len(x[i]) == len(x[q]) and i != q]
            want = sorted(like, key=lambda i: (-float(np.dot(np.array(x[i], float), np.array(x[q], float))), i))[:3]
            assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
