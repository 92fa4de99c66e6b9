"""The pipeline's stages one by one and together."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brickyard.llm import minhash, mixing, packing, quality, surrogates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, docs := stage(spark, docs, SF).cache()))
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "personal data", "mixing", "packing"]
    for before, after in steps[:-1]:
        assert before.schema.simpleString() == after.schema.simpleString()


def test_each_stage_against_its_operator(spark, steps):
    before, after = steps[0]
    kept = {r.doc_id for r in quality.resample(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = steps[1]
    found = minhash.near_duplicates(before, words_each=5).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in found if r.kept)
    before, after = steps[2]
    new = {r.doc_id: r.text for r in surrogates.replace(before, surrogates.key_of(spark)).collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, t in new.items()}
    before, after = steps[3]
    want = {r.doc_id: r.copies + (2 * r.part > r["size"]) for r in mixing.mix(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in want.items() if n})
    before, after = steps[4]
    tokens = before.count() and sum(r.length for r in after.collect())
    assert tokens == sum(r.n for r in packing.pack(before, corpus_pipeline.TOKENIZER).groupBy().agg(F.sum("length").alias("n")).collect())


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert got.columns == steps[-1][1].columns
    assert got.agg(F.sum("length")).first()[0] == steps[-1][1].agg(F.sum("length")).first()[0]
    assert got.select(*key).distinct().agg(F.sum("length")).first()[0] > 0


def test_odd_rows_pass_every_stage(spark, docs, words):
    rows = [(None, None), (None, "x"), (1, ""), (1, ""), (2, words(1, 200)), (2, words(2, 200)), (3, words(1, 200)), (4, None, None), (5, "a.b@example.com " + words(3, 50), None)]
    df = docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.filter("digest <> 'digest'").count() == 0, name
    once = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
    assert Counter(r.doc_id for r in once) == Counter([None, None, 1, 1, 2, 4, 5])
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_the_key_comes_from_the_settings(spark, docs):
    """The same key gives the same surrogates in any application; values without letters or digits pass too."""
    df = docs([(1, "password: ******** ok"), (2, "write ada.brook@firm.org or Mr. Stone")])
    spark.conf.set(surrogates.KEY, "one")
    try:
        out = {r.doc_id: r.text for r in corpus_pipeline.replace_private(spark, df, SF).collect()}
    finally:
        spark.conf.unset(surrogates.KEY)
    assert out == {r.doc_id: r.text for r in surrogates.replace(df, b"one").collect()}
    assert "***" not in out[1] and out[1].endswith(" ok") and "Stone" not in out[2]


def test_a_run_leaves_only_its_result(spark):
    import os

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(folder)) - before
    assert [n.rsplit("-", 1)[0] for n in left] == ["packing"] and got.count() > 0


def test_a_scope_removes_what_was_written_in_it(spark):
    import os

    from brickyard.llm.common import scope, stored

    with pytest.raises(ZeroDivisionError):
        with scope(spark) as files:
            stored(spark.range(3), "lost")
            with scope(spark) as inner:
                kept = stored(spark.range(5), "kept")
                path = inner.pop()
            assert len(files) == 1 and os.path.isdir(files[0].removeprefix("file:"))
            lost = files[0].removeprefix("file:")
            1 / 0
    assert not os.path.exists(lost) and os.path.isdir(path.removeprefix("file:")) and kept.count() == 5
