"""Importance resampling: held-out accuracy, the Gumbel top-k against sorting, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from brickyard.llm import quality

LABELS = "doc_id long, quality int, toxic int, good boolean"


def corpus(words):
    rows, truth = [], {}
    for k in range(600):
        text = words(k, 40 + k % 160, 3000)
        if k % 10 == 0:
            text = " ".join([text, *[("nasty", "vile", "awful", "horrid")[(k // 10 + j) % 4] for j in range(3)]])
        elif k % 10 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif k % 10 == 2:
            text = " ".join(w for w in text.split()[:20] for _ in range(8))
        rows.append((k, text))
        truth[k] = k % 10 > 2
    labels = [(k, int(k % 10 not in (1, 2)), int(k % 10 == 0), True) for k in truth if k % 3]
    return rows, truth, labels


def test_held_out_documents(spark, docs, words):
    rows, truth, labels = corpus(words)
    got = {r.doc_id: r.kept for r in quality.resample(docs(rows), spark.createDataFrame(labels, LABELS)).collect()}
    held_out = [k for k in truth if k % 3 == 0]
    assert np.mean([got[k] for k in held_out if truth[k]]) > 0.97
    assert np.mean([got[k] for k in held_out if not truth[k]]) < 0.1


def test_top_k_is_the_largest_scores(spark, docs, words):
    rows, _, labels = corpus(words)
    got = quality.resample(docs(rows + rows[:5]), spark.createDataFrame(labels, LABELS), temperature=3.0).collect()
    kept, gone = [r.score for r in got if r.kept], [r.score for r in got if not r.kept]
    assert len(got) == 605 and gone and min(kept) > max(gone)
    again = quality.resample(docs(rows + rows[:5]).repartition(7), spark.createDataFrame(labels, LABELS), temperature=3.0).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == sorted((r.doc_id, r.kept) for r in again)


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500), np.full(300, 0.5), [-1e9, 1e9, 0.25, 0.25]])
    df = spark.createDataFrame([(float(v),) for v in x], "score double")
    for k in (1, 2, 40, 400, 804):
        low, high, above = quality._kth_largest(df, k)
        assert (x >= high).sum() <= above + (k <= 1) and above < k <= above + ((x >= low) & (x < high)).sum() + (k <= 1 or k == 804)


def test_odd_rows(spark, docs, words):
    rows, _, labels = corpus(words)
    odd = [(None, None), (None, words(1, 50, 3000)), (900, ""), (901, None), (902, "\n \t"), (903, "word " * 30_000), (904, words(2, 20_000, 3000))]
    labels += [(900, None, 0, True), (None, 1, 0, True), (3, 0, 1, True), (10**9, 1, 0, True)]
    got = quality.resample(docs(rows + odd), spark.createDataFrame(labels, LABELS), carry=True)
    assert got.count() == len(rows) + len(odd)
    zero = [r.log_weight for r in got.collect() if not (r._row.text or "").strip()]
    assert zero == [0.0] * 4
    assert got.select("_row.digest").distinct().collect()[0][0] == "digest"


def test_no_labels_keep_all_and_empty_table(spark, docs, words):
    none = spark.createDataFrame([], LABELS)
    good = spark.createDataFrame([(1, 1, 0, True)], LABELS)
    rows = [(1, words(1, 30)), (2, None)]
    for labels in (none, good):
        assert [r.kept for r in quality.resample(docs(rows), labels).collect()] == [True, True]
        assert quality.resample(docs([]), labels).collect() == []


def test_shapes_are_of_whole_words():
    shapes = quality.Shapes()
    shape = lambda w: shapes[w.encode().translate(quality.SHAPE)]
    assert shape("x" * 500) == shape("x") and shape("Ab1" * 30) != shape("Ab1" * 31)
    code = quality.Grams(20)
    code("http://" + "a" * 80 + " http://" + "a" * 80 + "/B7")
    assert code.words.codes[0, 2] != code.words.codes[1, 2]
    assert shape("Hello!!" + "o" * 70) == shape("Hi!o")
