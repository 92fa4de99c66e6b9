import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use inside.
CLASHING = ("kept", "component_id", "digest", "sig", "_row", "_text", "_key", "size", "shard", "part", "key", "h", "target", "good", "label_id", "copies")


@pytest.fixture()
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with clashing extra columns."""
    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({c: F.lit(c) for c in CLASHING}) if extra else df
    return make


@pytest.fixture(scope="session")
def words():
    """Deterministic invented prose."""
    import random

    def make(seed, n, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
    return make
