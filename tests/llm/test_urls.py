"""URL parts, rules and the segmenting classifier."""

import math
import re
from collections import Counter

import pytest

from brickyard.llm import urls

SCHEMA = "page_id long, url string, html string, host string, path string, rule string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(r), r, v) for v, r in urls.RULES for n, _, p in [r.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules(spark):
    given = ["http://A.Example.NET/en/1?x=/de/", "https://example.net/en", "https://example.net/en/", "http://a.net", "http://a.net/", "http://net/x", "http://fakenet/x",
             "http://example.com/de/1", "http://xexample.com/de/1", "http://a.org/fr/#a", "http://a.org/FR/", None, "", "nothing", "mailto:a@b.org", "://", "http://?q", "http://É.ORG/fr/",
             "http://h.com/p?u=http://x.net/", "http://a.org:80/fr/", "ftp://a.org#x/fr/", "http://a.net/en/\n"]
    got = urls.judge(table(spark, [(k, u, None) for k, u in enumerate(given)])).collect()
    assert len(got) == len(given)
    for r in got:
        host, path = parts(given[r.page_id])
        says = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, says[0])
        assert r.verdict == (says[1] or ("block" if r.log_odds > 0 else "allow"))


def test_segmentation_is_the_most_probable():
    counts = {"cheap": 5, "pills": 4, "pill": 3, "s": 2, "the": 50, "rapist": 1, "therapist": 30}
    cut = urls.Segmenter(counts)
    assert cut("cheappills") == ["cheap", "pills"]
    assert cut("therapist") == ["therapist"]

    def all_cuts(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) for rest in all_cuts(s[k:])]

    for name in ("cheapills", "thepills", "xpillx", "thetherapis"):
        best = min(sum(map(cut.price, c)) for c in all_cuts(name))
        assert math.isclose(sum(map(cut.price, cut(name))), best)
    assert "".join(cut("q" * 5000)) == "q" * 5000


def test_classifier_blocks_segmented_names(spark):
    html = "<html><script>casino</script><p>good morning garden news weather cooking recipes travel</p></html>"
    rows = [(k, f"https://www.{n}.example.com/es/{k}", html) for k, n in enumerate(["gardennews", "cookingtravel", "weather-recipes", "goodmorning"] * 40)]
    rows += [(1000 + k, f"https://m.{n}.example.com/es/{k}", html) for k, n in enumerate(["cheappills", "casinobet", "spamfarm", "freecasino", "cheap-loans"] * 3)]
    got = urls.judge(table(spark, rows)).collect()
    assert all(r.verdict == ("block" if r.page_id >= 1000 else "allow") for r in got)


def plain_odds(rows):
    """Every row's log odds in plain Python: all words, all tokens."""
    counts = Counter(dict.fromkeys(urls.NAMES, 5))
    for _, _, html in rows:
        counts.update(re.findall(r"[^\W0-9_]{2,}", re.sub("<[^>]*>", " ", html or "").lower()))
    total = sum(counts.values())

    def cut(s):
        best = [(0.0, [])]
        for e in range(1, len(s) + 1):
            price = lambda w: math.log(total / counts[w]) if w in counts else math.log(total) + math.log(10) * len(w)
            best.append(min((best[b][0] + price(s[b:e]), [*best[b][1], s[b:e]]) for b in range(e)))
        return best[-1][1]

    own = [[w for x in re.findall(r"[0-9]+|[^\W0-9_]+", " ".join(parts(u)).lower()) for w in (["<number>"] if x[0].isdigit() else cut(x))] for _, u, _ in rows]
    bad = [not set(urls.NAMES).isdisjoint(o) for o in own]
    b, a = Counter(dict.fromkeys(urls.NAMES, 5)), Counter()
    for o, is_bad in zip(own, bad, strict=True):
        (b if is_bad else a).update(o)
    known = {*a, *b}
    extra = 0.5 * (len(known) + 1)
    weight = {t: math.log((b[t] + 0.5) / (b.total() + extra)) - math.log((a[t] + 0.5) / (a.total() + extra)) for t in known}
    prior = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    return [prior + sum(weight[t] for t in o) for o in own]


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_every_word_and_token_counts(spark, block):
    """More words and tokens than any bound, words of other scripts and very long ones, against plain Python."""
    name = lambda k: "q" + "".join("aeioubcdfg"[int(d)] for d in f"{k:05d}")
    long = "donaudampfschifffahrtsgesellschaft"
    rare = f"<p>zebra quartz {long} сад погода łąka</p>"
    rows = [(k, f"http://{name(9 * k)}.{name(7 * k + 1)}.info/x/{k}/{k}", " ".join(name(j) for j in range(52_000)) if k < 2 else rare if k == 2 else None) for k in range(60)]
    rows += [(100 + k, f"http://cheap-zebra.cheap-{x}.info/{x}", None) for k, x in enumerate(["quartz", long, "сад", "łąka"])]
    rows += [(200 + k, f"http://{x}.info", None) for k, x in enumerate(["zebraquartz", f"zebra{long}", f"{long}quartz", "садпогода", "łąkazebra", "zz" * 40])]
    got = {r.page_id: r.log_odds for r in urls.judge(table(spark, rows), block=block).collect()}
    for (k, *_), odds in zip(rows, plain_odds(rows), strict=True):
        assert math.isclose(got[k], odds, abs_tol=1e-9), k


def test_odd_rows_and_empty_table(spark):
    assert urls.judge(table(spark, [])).collect() == []
    got = urls.judge(table(spark, [(None, "http://a.org/x", None), (1, None, ""), (1, None, ""), (2, "http://a.com/" + "long" * 20_000, None)])).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}


def test_prior_is_by_class(spark):
    """Where most urls are blocked the prior says block: 30 against 2."""
    rows = [(k, f"http://casino{k}.info", None) for k in range(30)] + [(100, "http://garden.info", None), (101, "http://", None)]
    got = {r.page_id: r for r in urls.judge(table(spark, rows)).collect()}
    assert math.isclose(got[101].log_odds, math.log(31 / 3)) and got[101].verdict == "block"
    for (k, *_), odds in zip(rows, plain_odds(rows), strict=True):
        assert math.isclose(got[k].log_odds, odds, abs_tol=1e-9)


def test_tags_are_taken_out_in_one_pass():
    import random
    import time

    tag = re.compile(r"<script.*?</script>|<style.*?</style>|<[^>]*>", re.S)
    rng, bits = random.Random(6), ["<", ">", "<script", "</script>", "<style", "</style>", "script", "a", " ", "/", "<p>", "\n"]
    for _ in range(4000):
        html = "".join(rng.choices(bits, k=rng.randrange(1, 16)))
        assert urls.without_tags(html) == tag.sub(" ", html), html
    for html in ("<" * 2_000_000, "<script" * 300_000, "<script>" * 250_000, "<style><" * 250_000):
        began = time.process_time()
        urls.without_tags(html)
        assert time.process_time() - began < 5
