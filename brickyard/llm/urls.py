"""URL verdicts: host rules first, then naive Bayes over segmented host and path tokens.

Rules are ``host/path`` prefixes with a verdict; a rule fits its host and all subdomains if the path
starts with the rule's, and the longest fitting rule wins.

What no rule covers is judged by its words.  Names such as ``cheappills`` are cut into words by a
unigram Viterbi search: the cut with the most probable words under the counts of all words (two letters or more, of any
script and length) of all pages, where a word not counted costs a factor of ten per letter.  A
multinomial naive Bayes model then weighs the tokens.  It is trained on all
urls, weakly labelled: a url with a word from ``names`` counts for the block class, the others for
allow, so words that go along with blocked names count too.  A token counts as often as a url has it.

All counts stay in tables.  The distinct runs of letters in names are dealt into blocks, and a block is joined to the
counts of its runs' substrings (those as long as some counted word); urls are dealt into blocks too, and a block
is joined to the cuts of its runs and to the weights of its tokens.  So a task holds what one block needs, a
frequent run or token is met once a block, and only sums go to the driver.

Nulls and ties: a null url, or one without ``://``, has an empty host and path and gets the verdict of
no tokens (the prior's: that of most urls).  Null page ids and repeated rows come back as they came.  Null html has
no words.  Extra columns are ignored.  An empty input gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import group_starts, small_batches, stored, whole_groups

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of names that are blocked: betting, adult, pills, loans, advertising, spam.
NAMES = ("bet", "bets", "betting", "casino", "poker", "jackpot", "slots", "win", "lottery",
         "adult", "xxx", "porn", "sex", "escort", "cheap", "pills", "pharmacy", "viagra",
         "loan", "loans", "payday", "ads", "adserver", "track", "tracker", "popup", "spam", "farm", "phish", "malware")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of letters, of names and of pages alike.
LETTERS = r"[^\W0-9_]"
PARTS = re.compile(rf"[0-9]+|{LETTERS}+")


def split_url(url):
    """(host, path) columns of a url column."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host, path, rules: Sequence[tuple[str, str]]):
    """(rule, verdict) columns of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi segmentation of lower-case names."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(sum(counts.values()) if total is None else total, 1)
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.sizes = sorted({len(w) for w in counts})

    def price(self, word: str) -> float:
        known = self.cost.get(word)
        return math.log(self.total) + math.log(10) * len(word) if known is None else known

    def __call__(self, name: str) -> list[str]:
        letter, none = math.log(10), math.log(self.total)
        best, back = [0.0], [0]
        low, at = 0.0, 0  # the best start of a word that isn't counted, less what its letters before cost
        for end in range(1, len(name) + 1):
            cost, start = low + none + letter * end, at
            for size in self.sizes:
                if size > end:
                    break
                known = self.cost.get(name[end - size : end])
                if known is not None:
                    cost, start = min((cost, start), (best[end - size] + known, end - size))
            best.append(cost)
            back.append(start)
            if cost - letter * end < low:
                low, at = cost - letter * end, end
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def parts(host: str, path: str) -> list[str]:
    """Runs of letters and runs of digits of the host's labels and of the path."""
    return PARTS.findall(f"{host} {path}".lower())


def without_tags(html: str) -> str:
    """The text with a space for each tag, and for each script and style with its content; in one pass, whatever is left open."""
    out, at, close = [], 0, {"script": 0, "style": 0}
    while True:
        start = html.find("<", at)
        end = html.find(">", start) if start >= 0 else -1
        if end < 0:
            out.append(html[at:])
            return " ".join(out)
        out.append(html[at:start])
        at = end + 1
        for name in close:
            if html.startswith(name, start + 1):
                # where the next closing tag is; once there is none, none is looked for again
                if 0 <= close[name] < start + 1 + len(name):
                    close[name] = html.find(f"</{name}>", start + 1 + len(name))
                if close[name] >= 0:
                    at = close[name] + len(name) + 3


def _words(batches):
    counts: Counter[str] = Counter()
    word = re.compile(rf"{LETTERS}{{2,}}")
    for batch in batches:
        for html in batch.column(0):
            if html.is_valid:
                counts.update(word.findall(without_tags(html.as_py()).lower()))
        if len(counts) > 200_000:
            yield _counted(counts)
            counts.clear()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _asked(batches):
    """Distinct (block, run of letters) of urls, by batch."""
    for batch in batches:
        own = {(k, p) for k, h, t in zip(*(batch.column(c).to_pylist() for c in ("block", "host", "path")), strict=True) for p in parts(h, t) if not p[0].isdigit()}
        block, part = zip(*own, strict=True) if own else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(part, pa.string())], names=["block", "part"])


def _substrings(sizes):
    """Distinct (block, substring) of runs, of the sizes that counted words have, in batches of bounded size."""
    def made(own):
        block, word = zip(*own, strict=True) if own else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(word, pa.string())], names=["block", "word"])

    def run(batches):
        own: set[tuple[int, str]] = set()
        letters = 0
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
                for size in sizes.value:
                    if size > len(part):
                        break
                    for k in range(len(part) - size + 1):
                        own.add((block, part[k : k + size]))
                        letters += size
                        if letters > 4_000_000:
                            yield made(own)
                            own.clear()
                            letters = 0
        yield made(own)
    return run


def _blocks(batches):
    """Tables of one block each."""
    for table in whole_groups(batches, ["block"]):
        starts = group_starts(table, ["block"]).tolist()
        for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
            yield table.slice(lo, hi - lo)


def _cut(total: int):
    """(part, tokens) of the runs of each block, by its words' counts."""
    def run(batches):
        for t in _blocks(batches):
            word, n, part = (t.column(c).to_pylist() for c in ("word", "n", "part"))
            segment = Segmenter({w: k for w, k in zip(word, n, strict=True) if w is not None}, total)
            own = [p for p in part if p is not None]
            for lo in range(0, len(own), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(own[lo : lo + 1000], pa.string()), pa.array([segment(p) for p in own[lo : lo + 1000]], pa.list_(pa.string()))], names=["part", "tokens"])
    return run


def _tokens(names: frozenset[str]):
    """Adds the tokens of each url, and whether one is a listed name, by the cuts of its block's runs."""
    def run(batches):
        for t in _blocks(batches):
            cuts = {p: c for p, c in zip(t.column("part").to_pylist(), t.column("cut").to_pylist(), strict=True) if p is not None}
            t = t.filter(t.column("host").is_valid())
            for batch in t.select(["block", "page_id", "host", "path"]).to_batches(1000):
                own = []
                for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                    own.append([x for p in parts(host, path) for x in (("<number>",) if p[0].isdigit() else cuts[p])])
                blocked = [not names.isdisjoint(o) for o in own]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.string())), pa.array(blocked, pa.bool_())], names=[*batch.schema.names, "tokens", "blocked"])
    return run


def _score(prior: float):
    def run(batches):
        for t in _blocks(batches):
            weight = {x: w for x, w in zip(t.column("token").to_pylist(), t.column("weight").to_pylist(), strict=True) if x is not None}
            t = t.filter(t.column("host").is_valid())
            for batch in t.select(["page_id", "host", "path", "tokens"]).to_batches(1000):
                odds = [prior + sum(weight[x] for x in own) for own in batch.column("tokens").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(odds, pa.float64())], names=["page_id", "host", "path", "log_odds"])
    return run


def _by_block(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both, with nulls in the columns that one lacks, whole blocks in a task."""
    return a.unionByName(b, allowMissingColumns=True).repartition("block").sortWithinPartitions("block")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, names: Sequence[str] = NAMES,
          smooth: float = 0.5, seed_count: int = 5, block: int = 4_000_000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, log_odds (over 0: block, where no rule fits).

    A block of urls, or of runs, has about ``block`` letters; each of them counts for 64 more.
    """
    small_batches(pages)
    spark = pages.sparkSession
    sc = spark.sparkContext
    kind = pages.schema["page_id"].dataType.simpleString()
    host, path = split_url(F.col("url").cast("string"))
    listed = spark.createDataFrame([(n, seed_count) for n in sorted(set(names))], "word string, n long")
    text = pages.select(F.col("html").cast("string").alias("html"))
    words = stored(text.mapInArrow(_words, "word string, n long").unionAll(listed).groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = int(words.agg(F.sum("n")).first()[0] or 0)
    sizes = sc.broadcast(sorted(r[0] for r in words.select(F.length("word")).distinct().collect()))  # one number for each length

    def dealt(df: DataFrame, letters, by: str) -> DataFrame:
        size = int(df.agg(F.sum(letters + 64)).first()[0] or 0)
        return df.withColumn("block", F.pmod(F.xxhash64(by), F.lit(size // block + 1)).cast("int"))

    # dealt by row, as any number of rows may share a url
    urls = stored(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    urls = dealt(urls, F.length("host") + F.length("path"), "row").drop("row")
    asked = stored(urls.mapInArrow(_asked, "block int, part string").distinct(), "asked")
    runs = dealt(stored(asked.select("part").distinct(), "runs"), F.length("part"), "part")
    known = runs.mapInArrow(_substrings(sizes), "block int, word string").distinct().join(words, "word")
    cuts = stored(_by_block(runs, known).select("block", "part", "word", "n").mapInArrow(_cut(total), "part string, tokens array<string>"), "cuts")
    cut = asked.join(cuts, "part").select("block", "part", F.col("tokens").alias("cut"))
    seen = stored(_by_block(urls, cut).mapInArrow(_tokens(frozenset(names)), f"block int, page_id {kind}, host string, path string, tokens array<string>, blocked boolean"), "tokens")
    n = {r["blocked"]: r["count"] for r in seen.groupBy("blocked").count().collect()}
    prior = math.log((n.get(True, 0) + 1) / (n.get(False, 0) + 1))
    # every token's counts in blocked and other urls
    one = F.col("blocked").cast("long")
    counts = (seen.select(F.explode("tokens").alias("token"), one.alias("b"), (1 - one).alias("a"))
              .unionAll(listed.select("word", "n", F.lit(0).cast("long"))).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")))
    counts = stored(counts, "counts")
    all_b, all_a, k = (int(v or 0) for v in counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first())
    extra = smooth * (k + 1)
    weight = F.log((F.col("b") + smooth) / (all_b + extra)) - F.log((F.col("a") + smooth) / (all_a + extra))
    weights = (seen.select("block", F.explode("tokens").alias("token")).distinct()
               .join(counts.select("token", weight.alias("weight")), "token").select("block", "token", "weight"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    return (_by_block(seen.drop("blocked"), weights).mapInArrow(_score(prior), f"page_id {kind}, host string, path string, log_odds double")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(says, F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds"))
