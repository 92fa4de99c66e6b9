import random
import re
from collections import Counter, defaultdict

import duckdb

from brickyard.llm import lines, oracle, queries

WORD, SPACE, SYMBOL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"


def norm(line):
    return re.sub(SPACE, " ", line).strip(" ").lower()


def repeated(words):
    at = defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    return len({p + d for ps in at.values() if len(ps) > 1 for p in ps for d in range(5)})


def plain(rows, least_docs, share, symbol_words=10, least_words=10, most_repeated=20, least_left=30):
    """The whole result from (doc_id, text, source), with sets of texts instead of hashes."""
    per_line, hosts = defaultdict(set), defaultdict(set)
    own = []
    for n, (doc, text, source) in enumerate(rows):
        who = ("id", doc) if doc is not None else ("row", n)
        hosts[source].add(who)
        found = {}
        for line in (text or "").split("\n"):
            size = len(re.findall(WORD, line))
            if size and len(re.findall(SYMBOL, line)) * symbol_words <= size:
                found[norm(line)] = size
        own.append(found)
        for line in found:
            per_line[source, line].add(who)
    out = []
    for (doc, text, source), found in zip(rows, own, strict=True):
        text = text or ""
        words = re.findall(WORD, text)
        with_words = [x for x in text.split("\n") if re.search(WORD, x)]
        often = [x for x in found if len(per_line[source, x]) > max(least_docs, len(hosts[source]) * share)]
        left = sum(found.values()) - sum(found[x] for x in often)
        rep = repeated(words)
        failed = len(words) < least_words or 100 * rep > most_repeated * len(words)
        out.append((doc, len(words), sum(map(len, words)), len(re.findall(SYMBOL, text)), len(with_words) - len(set(with_words)), rep,
                    failed, not failed and 100 * left >= least_left * len(words), len(often), left))
    return Counter(out)


def made(seed=3, n=60):
    rng = random.Random(seed)
    prose = lambda m: " ".join(f"w{rng.randrange(300)}" for _ in range(m))
    menu = ["Home | News | About", "Read our  Privacy policy and the terms of use here", "READ our privacy policy\tand the Terms of use here "]
    out = []
    for k in range(n):
        parts = [prose(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))] + rng.sample(menu, rng.randrange(0, 3))
        if k % 7 == 0:
            parts += parts[:1] * 3
        rng.shuffle(parts)
        out.append((k, "\n".join(parts), rng.choice(["a", "a", "b", None])))
    again = prose(6)
    out += [(None, "no id " + prose(20), "a"), (None, menu[1], "a"), (3, menu[1] + "\n" + prose(9), "a"), (3, menu[1] + "\n" + prose(9), "a"), (100, None, "b"), (101, "", None),
            (102, "\n \n\t", "b"), (103, " ".join(["same words again and again"] * 400), "b"), (104, f"{again} x {again} y {prose(60)}", "a"), (105, "###### " * 30, "a"),
            (106, "Ünï Çode ist kein Leerzeichen " * 9, "a"), (107, "one two three four five", "a"), (108, prose(20_000), "b"), (109, "x" * 300_000, "b")]
    return out


def test_against_plain_python(spark, docs):
    rows = made()
    got = Counter(tuple(r) for r in lines.rules(docs(rows), least_docs=4, share=0.1).collect())
    assert got == plain(rows, 4, 0.1)
    kept = [r[7] for r in got]
    assert True in kept and False in kept and any(r[8] for r in got)


def test_share_of_the_host_counts_where_it_is_larger(spark, docs):
    rows = [(k, "a common line of the host\n" + f"own words of number {k} in a line", "big") for k in range(30)]
    rows += [(100 + k, "a common line of the host\n" + f"own words of number {k} in a line", "small") for k in range(8)]
    for share, removed in ((0.5, {"big"}), (0.999, {"big"}), (1.0, set())):
        out = lines.rules(docs(rows), least_docs=10, share=share).collect()
        assert {"big" if r.doc_id < 100 else "small" for r in out if r.n_removed_lines} == removed


def test_salts_and_partitions_change_nothing(spark, docs):
    rows = made(5, 40) + [(500 + k, "the very common line of all pages\nand some own words " + str(k), "a") for k in range(60)]
    want = plain(rows, 4, 0.1)
    assert Counter(tuple(r) for r in lines.rules(docs(rows).repartition(13), least_docs=4, share=0.1).collect()) == want


def test_cleaned_texts_hold_the_lines_that_stay(spark, docs):
    common = "a common line of the host"
    rows = [(k, f"{common}\nThe own text of document number {k} goes on for ten words or more\n\nrep {k}\nRep  {k}\n$$$ ### end", "h") for k in range(12)]
    rows += [(99, common + "\nshort", "h"), (98, None, "h")]
    out = {r.doc_id: r for r in lines.clean(docs(rows), least_docs=5, share=0.0).collect()}
    assert set(out) == set(range(12))
    assert out[3].text == "The own text of document number 3 goes on for ten words or more\n\nrep 3"
    assert out[3].kept == "kept" and out[3].size == "size"  # other columns are as they were


def test_empty_table(spark, docs):
    assert lines.rules(docs([(1, "x", "s")]).limit(0)).collect() == []
    assert lines.clean(docs([(1, "x", "s")]).limit(0)).collect() == []


def test_no_python_in_the_plan(spark, docs):
    plan = lines.rules(docs(made(n=5)))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(oracle.op12_lines(**queries.LINES)).fetchall()
    got = [tuple(r) for r in queries.op12_lines(spark, sf).collect()]
    assert sorted(got) == sorted(want) and want
