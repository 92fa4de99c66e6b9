import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from brickyard.llm import merkle, oracle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def ascii_lower(text):
    return text if text is None else "".join(c.lower() if c.isascii() else c for c in text)


def plain(rows, fanout):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified) of rows (doc_id, source, lang, n_chars, text), one by one."""
    def grow(level):
        """Levels of hashes up to the root."""
        levels = [level]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h("".join(last[k : k + fanout])) for k in range(0, len(last), fanout)])
        return levels

    def climb(levels, k, value):
        proof = ""
        for level in levels[:-1]:
            lo = k - k % fanout
            left, right = "".join(level[lo:k]), "".join(level[k + 1 : lo + fanout])
            proof, value, k = proof + left + right, h(left + value + right), k // fanout
        return proof, value

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in sources}
    trees = {s: grow([leaf_of(r) for r in of[s]]) for s in sources}
    top = grow([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for place, r in enumerate(of[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            value = leaf_of((*r[:4], ascii_lower(r[4]))) if tampered else leaf_of(r)
            proof, value = climb(trees[s], place, value)
            more, value = climb(top, k, value)
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], h(proof + more), value, value == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({c: F.lit(c) for c in ("leaf", "tree", "pos", "idx", "level", "kids", "n", "h", "grp", "id", "_tie", "_at", "part")})


def run(docs, **how):
    tampered = [merkle.encoded(merkle.lower_ascii(F.col(c)) if c == "text" else F.col(c)) for c in COLUMNS]
    changed = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").isNotNull(), merkle.digest(*tampered))
    out = merkle.verified(merkle.manifest(docs, COLUMNS, "doc_id", "source", changed, **how))
    return sorted((tuple(r) for r in out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def made(n, sources, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 3, 40]), rng.choice(["Some Text", "plain", "", None, "ÄÖ Über 東京"])) for k in range(n)]


def test_uneven_tree_against_plain_python(spark):
    rows = made(260, ["a"] * 20 + ["b", "c", "d", "é", None]) + [(1000 + k, f"site{k}", "en", 1, "X") for k in range(20)]
    rows += [(None, "a", "en", 1, "No Id"), (None, "a", "en", 1, "Another"), (7, "a", "en", 1, "same id"), *[(9, "b", "en", 2, "Twice")] * 3]
    got = run(frame(spark, rows))
    assert got == plain(rows, 16)
    assert {r[6] for r in got} == {True, False}


def test_a_deep_tree_needs_many_jumps_and_salts(spark):
    rows = made(90, ["a"] * 9 + ["b"])
    assert run(frame(spark, rows), fanout=2, salts=3) == plain(rows, 2)


def test_one_source_one_row_and_none(spark):
    for rows in (made(40, ["only"]), made(1, ["only"]), [(3, None, None, None, None)], [(k, f"s{k}", "en", 1, "T") for k in range(18)]):
        assert run(frame(spark, rows)) == plain(rows, 16)
    single = plain([(3, None, None, None, None)], 16)[0]
    assert single[1] == single[2] == single[3] and single[4] == h("")
    assert run(frame(spark, made(1, ["x"])).limit(0)) == []


def test_a_changed_sibling_or_root_is_noticed(spark):
    proofs = merkle.manifest(frame(spark, made(30, ["a", "b"])), COLUMNS, "doc_id", "source")
    broken = proofs.withColumn("path", F.transform("path", lambda s: F.struct(F.concat(s["left"], F.lit("0")).alias("left"), s["right"].alias("right"))))
    assert merkle.verified(proofs).filter("not verified").count() == 0
    assert merkle.verified(broken).filter("verified").count() == 0


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(oracle.OP11_MERKLE).fetchall()
    got = [tuple(r) for r in queries.op11_merkle(spark, sf).collect()]
    assert sorted(got) == sorted(want) and want
