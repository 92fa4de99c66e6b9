"""Quality rules by the frequency of lines across documents, in DataFrame functions only.

Each document's lines are normalised (lower case, white space as one space, none at the ends) and hashed.
A line goes if it is above one of three limits:

* it stands in more than ``max(least_docs, share of the host's documents)`` distinct documents of the document's
  host (the source): boilerplate, menus, licences;
* the document had it before;
* it holds more than one symbol for every ``symbol_words`` words.

A document that keeps less than ``least_left`` per cent of its words is depleted and rejected, as is one that
fails a base rule: fewer than ``least_words`` words, or more than ``most_repeated`` per cent of its words in
five-word windows that it has twice or more.

**Scale.**  What is counted inside a text is counted in its row, by sorting arrays: nothing is shuffled for it.
Lines are shuffled as hashes, (host, hash, document), and aggregated; a line that stands in a third of all
documents is spread by document.  The frequent lines are joined back under ``SALTS`` salts, so that no task
has all rows of one line; Spark broadcasts them where their stored size allows it.

Nulls and ties: null and empty texts have no words and fail the base rule.  Documents without a source are a host of
their own.  Rows that share an id are one document in the counts, rows without an id one each; every row is
judged and returned.  Texts of any length are read whole.  Extra columns are ignored, whatever their
names.  An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import WORD, stored

SALTS = 16
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column, width: int) -> Column:
    """First positions of all windows (from 0)."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))


def _twice(pairs: Column) -> Column:
    """Positions ``i``, in order, of the (v, i) whose ``v`` occurs twice or more."""
    def pick(ordered):
        same = lambda x, k: F.coalesce(F.get(ordered, k)["v"] == x["v"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    return _let(F.sort_array(pairs), pick)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words in windows of ``width`` words that the array holds twice or more.

    Hashes find the candidates; windows are the same only if their words are.
    """
    hashes = lambda at: F.transform(at, lambda i: F.xxhash64(F.slice(words, i + 1, width)))
    texts = lambda at: F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("v"), i.alias("i")))
    covered = lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width)))),
                                     F.lit(0).cast("long"), lambda n, m: n + m)
    numbered = lambda h: F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return _let(hashes(_windows(words, width)), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
        _let(_twice(numbered(h)), lambda at: _let(_twice(texts(at)), covered))))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def _in_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def _own_lines(lines: Column) -> Column:
    """The distinct normalised lines of a document: hash, words and symbols of each."""
    each = F.transform(lines, lambda s: F.struct(F.xxhash64(normalised(s)).alias("h"), _in_words(s).alias("w"), F.regexp_count(s, F.lit(SYMBOL)).alias("s")))
    return _let(F.sort_array(each), lambda a: F.filter(a, lambda x, k: F.coalesce(F.get(a, k - 1)["h"] != x["h"], F.lit(True))))


def measures(docs: DataFrame, symbol_words: int = 10) -> DataFrame:
    """(rid, id, host, digest, base measures, n_lines, own_removed, lines) of every row; lines (h, w) are those within the row's own limits."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x["w"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("host"), text.alias("t"))

    def of_words(words):
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                        repeated_words(words).alias("n_repeat_words"))

    def of_lines(lines):
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines"), _own_lines(lines).alias("own"))

    lines = F.filter(F.split("t", "\n", -1), lambda s: s.rlike(WORD))
    rows = rows.select("rid", "id", "host", F.sha2("t", 256).alias("digest"), F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
                       _let(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), of_words).alias("a"), _let(lines, of_lines).alias("b"))
    clean = F.filter("b.own", lambda x: x["s"] * symbol_words <= x["w"])
    rows = rows.select("rid", "id", "host", "digest", "a.n_words", "a.word_chars", "n_symbols", "b.n_dup_lines", "a.n_repeat_words", "b.n_lines",
                       F.transform(clean, lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("lines"))
    return stored(rows, "measures").withColumn("own_removed", F.col("n_words") - total(F.col("lines")))


def frequent_lines(rows: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(host, h, n_docs) of the lines that stand in more distinct documents of a host than the limit."""
    document = F.struct("id", F.when(F.col("id").isNull(), F.col("rid")).alias("row"))
    counts = rows.select("host", document.alias("d"), F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.countDistinct("d").alias("n_docs"))
    hosts = rows.select("host", document.alias("d")).groupBy(F.col("host").alias("of")).agg(F.countDistinct("d").alias("all_docs"))
    often = counts.filter(F.col("n_docs") > least_docs)
    limit = F.greatest(F.lit(float(least_docs)), F.col("all_docs") * F.lit(share))
    return stored(often.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n_docs") > limit).select("host", "h", "n_docs"), "frequent")


def _found(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(rid, h, w) of the rows' lines that are frequent in their hosts."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")
    known = frequent.select(F.col("host").alias("of"), F.col("h").alias("f"), salt)
    each = rows.select("rid", "host", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt"), F.inline("lines"))
    return each.join(known, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("f")) & (F.col("salt") == F.col("s"))).select("rid", "h", "w")


def judge(rows: DataFrame, frequent: DataFrame, least_words: int = 10, most_repeated: int = 20, least_left: int = 30) -> DataFrame:
    """One row per row of ``measures``, with base_failed, kept, n_removed_lines (frequent ones) and words_left."""
    found = _found(rows, frequent).groupBy(F.col("rid").alias("r")).agg(F.sum("w").alias("words"), F.count("*").alias("n"))
    out = rows.join(found, F.col("rid") == F.col("r"), "left")
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    left = F.col("n_words") - F.col("own_removed") - F.coalesce("words", F.lit(0))
    out = out.withColumn("base_failed", failed).withColumn("words_left", left.cast("long"))
    depleted = F.col("words_left") * 100 < F.col("n_words") * least_left
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumn("n_removed_lines", F.coalesce("n", F.lit(0)).cast("long"))


def rules(docs: DataFrame, least_docs: int = 10, share: float = 0.01, symbol_words: int = 10, least_words: int = 10, most_repeated: int = 20, least_left: int = 30) -> DataFrame:
    """One row per document: doc_id, n_words, the base measures, base_failed, kept, n_removed_lines, words_left."""
    rows = measures(docs, symbol_words)
    out = judge(rows, frequent_lines(rows, least_docs, share), least_words, most_repeated, least_left)
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "words_left")


def clean(docs: DataFrame, least_docs: int = 10, share: float = 0.01, symbol_words: int = 10, least_words: int = 10, most_repeated: int = 20, least_left: int = 30) -> DataFrame:
    """The documents kept, all columns, with the lines above a limit taken out of ``text``.

    Texts are matched with their verdict by host and SHA-256 of the text: equal texts of a host have equal verdicts.
    """
    names = docs.columns
    rows = measures(docs, symbol_words)
    frequent = frequent_lines(rows, least_docs, share)
    verdict = judge(rows, frequent, least_words, most_repeated, least_left).filter("kept").select("rid", "host", "digest")
    gone = _found(rows, frequent).groupBy(F.col("rid").alias("r")).agg(F.collect_set("h").alias("gone"))  # at most the lines of a document
    verdict = (verdict.join(gone, F.col("rid") == F.col("r"), "left").groupBy(F.col("host").alias("of"), F.col("digest").alias("d"))
               .agg(F.any_value(F.coalesce("gone", F.array().cast("array<long>"))).alias("gone")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"], F.lit(0).alias("_end")).alias("_row"), text.alias("_text"),
                         F.col("source").cast("string").alias("_host"), F.sha2(text, 256).alias("_digest"))
    kept = packed.join(verdict, (F.col("_digest") == F.col("d")) & F.col("_host").eqNullSafe(F.col("of")))

    def stays(lines, hashes, gone):
        first = lambda k: F.array_position(hashes, F.get(hashes, k)) == k + 1
        wordless = lambda s: ~s.rlike(WORD)
        symbols = lambda s: F.regexp_count(s, F.lit(SYMBOL)) * symbol_words > _in_words(s)
        return F.filter(lines, lambda s, k: wordless(s) | (first(k) & ~symbols(s) & ~F.array_contains(gone, F.get(hashes, k))))

    text = _let(F.split("_text", "\n", -1), lambda a: _let(F.transform(a, lambda s: F.xxhash64(normalised(s))), lambda h: F.array_join(stays(a, h, F.col("gone")), "\n")))
    return kept.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names])
