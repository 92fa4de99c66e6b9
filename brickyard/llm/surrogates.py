"""Personal data: detected entities get keyed surrogates of their own type and format.

Found are e-mail addresses, telephone numbers, IPv4 addresses, payment-card and account numbers, social
security numbers, secrets (keys, tokens, passwords) and names of persons after a form of address
or a known first name.  A surrogate comes from a keyed hash of the type and the value, letter by
letter: digits become digits, upper-case letters upper-case, hexadecimal digits hexadecimal, and
separators stay, and letters of other scripts become letters of theirs.  A value that holds nothing of the kind
(asterisks, dots) becomes letters of its length.  A card number that passes the check digit still does; an address keeps valid octets; an
e-mail address moves to an example domain of its top domain; a name keeps its script, and a first name the gender of its form
of address, its list or its ending.

The same value gets the same surrogate everywhere (coreference): first and last names, and an address's mailbox and domain, are
entities of their own, so "Ms Ada Brook" and "Ms Brook" still agree.  Distinct values get distinct surrogates.  The
distinct entities of the whole collection are gathered in a table, and while two share a surrogate,
or a surrogate is another entity's real value, all but the first of them are hashed again with the
next attempt number.  From attempt ``LONGER`` on a surrogate gets a keyed ending that grows, so there is
always one left.  Texts without entities aren't shuffled.

The key is the caller's: whoever holds it can rebuild the table of short values, so it belongs in a
secret store and not in the source.

Nulls and ties: null and empty texts come back as they are, as do null ids and all other columns,
whatever their names; repeated rows come back as often as they came.  An empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import string
import unicodedata
from bisect import bisect_left, insort
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.llm.common import small_batches, stored

#: Forms of address and their gender (f, m or n for either).
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "г-н": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "г-жа": "f",
          "Dr": "n", "Prof": "n", "Professor": "n"}
FIRST = {"f": ("Alice", "Anna", "Barbara", "Carla", "Clara", "Emily", "Emma", "Eva", "Grace", "Helen", "Julia", "Laura", "Linda",
               "Maria", "Martha", "Mary", "Nora", "Olivia", "Sarah", "Sophie", "Susan", "Анна", "Елена", "Мария", "Ольга"),
         "m": ("Albert", "Andrew", "Carlos", "Charles", "Daniel", "David", "Edward", "Frank", "George", "Henry", "James", "John", "Karl",
               "Louis", "Michael", "Otto", "Paul", "Peter", "Richard", "Robert", "Thomas", "William", "Иван", "Пётр", "Сергей")}
LAST = ("Abbot", "Baker", "Brook", "Carver", "Dale", "Ellis", "Field", "Garner", "Hill", "Iver", "Keller", "Lang", "Marsh", "North",
        "Olsen", "Porter", "Reed", "Stone", "Turner", "Vance", "Weaver", "York", "Иванов", "Петров", "Соколов")
SYLLABLES = {"latin": ("ba", "be", "do", "fi", "ga", "ha", "jo", "ka", "le", "li", "ma", "mi", "no", "pe", "ra", "ro", "sa", "ti", "va", "we"),
             "cyrillic": ("ба", "ве", "го", "да", "жи", "зо", "ка", "ле", "ма", "ни", "по", "ра", "со", "ти", "фе")}
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "n", ("latin", "n"): "r", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н", ("cyrillic", "n"): "р"}
NAME = r"[^\W\d_a-zа-яё][^\W\d_]+(?:-[^\W\d_a-zа-яё][^\W\d_]+)?"

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_KNOWN = "|".join(n for names in FIRST.values() for n in names)
#: (type, pattern); the group v, where there is one, is what is replaced.  Earlier ones win where they overlap.
PATTERNS = (
    ("secret", r"\bAKIA(?P<v>[A-Z0-9]{16})(?![A-Z0-9])"),
    ("secret", r"\b(?:gh[pousr]_|sk-|xox[abp]-)(?P<v>[A-Za-z0-9_-]{16,})"),
    ("secret", r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d|pwd)\s*[=:]\s*[\"']?(?P<v>[^\s\"']{6,})"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("card", r"(?<![\d.-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("account", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d-]|\.\d)"),
    ("phone", r"(?<![\w.])\+\d{8,15}(?!\d)"),
    ("name", rf"\b(?P<title>{_TITLE})\b\.? +(?P<a>{NAME})(?: +(?P<b>{NAME}))?"),
    ("name", rf"\b(?P<a>{_KNOWN}) +(?P<b>{NAME})"),
)
#: Necessary signs of the slower patterns; each is implied by its patterns, wherever in a text they match.
#: A title or first name, whatever is before it, up to the first letter of the name that follows.
NAMED = re.compile(rf"(?:{_TITLE}|{_KNOWN})\.? +[^\W\d_a-zа-яё]")
#: Seven digits and separators, as ip, card, ssn and phone all have them; in ASCII texts the first is the same and faster.
NUMBER, NUMBER_ANY = re.compile(r"[0-9][0-9 .()-]{5,}[0-9]"), re.compile(r"\d[\d .()-]{5,}\d")
NUMBERS = frozenset(("ip", "card", "ssn", "phone"))
ACCOUNT = re.compile(r"[A-Z]{2}\d{2}")
SIGNED = frozenset(p for _, p in PATTERNS)


def possible(text: str) -> frozenset[str]:
    """The types of entities that a text may hold, by cheap necessary signs of ``PATTERNS``."""
    kinds = set()
    if "@" in text:
        kinds.add("email")
    if "=" in text or ":" in text or "AKIA" in text or any(p in text for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox")):
        kinds.add("secret")
    if (NUMBER if text.isascii() else NUMBER_ANY).search(text):
        kinds |= NUMBERS
    if ACCOUNT.search(text):
        kinds.add("account")
    if NAMED.search(text):
        kinds.add("name")
    return frozenset(kinds)


def entities(text: str, compiled) -> list[tuple[int, int, str, str]]:
    """(start, end, type, gender) of a text's entities in order; they don't overlap."""
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order, without overlaps

    def free(s: int, e: int) -> bool:
        k = bisect_left(taken, (s, e))
        return not (k < len(taken) and taken[k][0] < e) and not (k and taken[k - 1][1] > s)

    kinds = possible(text)
    for kind, pattern in compiled:
        for m in pattern.finditer(text) if kind in kinds or pattern.pattern not in SIGNED else ():
            parts = []
            if kind == "email":
                at = text.rindex("@", m.start(), m.end())
                parts += [(m.start(), at, "mailbox", "n"), (at + 1, m.end(), "domain", "n")]
            elif kind != "name":
                parts.append((*(m.span("v") if "v" in pattern.groupindex else m.span()), kind, "n"))
            else:
                title = m.group("title") if "title" in pattern.groupindex else None
                listed = next((g for g, names in FIRST.items() if m.group("a") in names), None)
                gender = TITLES.get(title or "", "n")
                if m.group("b") or listed:
                    parts.append((*m.span("a"), "first", listed or gender))
                    parts += [(*m.span("b"), "last", "n")] if m.group("b") else []
                else:
                    parts.append((*m.span("a"), "last", "n"))
            if all(free(s, e) for s, e, *_ in parts):
                for s, e, *_ in parts:
                    insort(taken, (s, e))
                found += parts
    return sorted(found)


def _stream(key: bytes, *what: str):
    """Keyed pseudo-random bytes for an entity."""
    block = 0
    while True:
        yield from hmac.new(key, "\0".join((*what, str(block))).encode(), hashlib.sha256).digest()
        block += 1


@lru_cache(maxsize=65536)
def alphabet(c: str) -> str:
    """The letters or digits that may stand for ``c``: of its script, its category and its part of the code table."""
    if c.isascii():
        return string.digits if c.isdigit() else string.ascii_uppercase if c.isupper() else string.ascii_lowercase if c.islower() else ""
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.digit(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if kind[0] != "L":
        return ""
    lo = ord(c) & ~127
    like = (chr(k) for k in range(lo, lo + 128) if unicodedata.category(chr(k)) == kind)
    return "".join(x for x in like if script(x) == script(c))


def script(c: str) -> str:
    """First word of a letter's name in the code table, as LATIN, GREEK, CJK."""
    return unicodedata.name(c, "").split(" ")[0].lower()


def _pick(chars: str, draw) -> str:
    return chars[(next(draw) << 8 | next(draw)) % len(chars)]


def _same_kinds(value: str, draw) -> str:
    """Character by character of the same class and script; hexadecimal values stay hexadecimal."""
    hexa = re.fullmatch(r"(?=\d*[a-f])[0-9a-f]{8,}", value) is not None and value.isascii()
    out = []
    for c in value:
        chars = "0123456789abcdef" if hexa else alphabet(c)
        if chars and c.isdigit() and not hexa and c != chars[0]:
            chars = chars[1:]  # leading zeros stay rare
        out.append(_pick(chars, draw) if chars else c)
    if not any(len(alphabet(c)) > 1 for c in value):
        return "".join(_pick(string.ascii_lowercase, draw) for _ in value)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: From this attempt on a surrogate gets an ending that grows by a sign every second attempt.
LONGER = 8


def surrogate(key: bytes, kind: str, gender: str, value: str, attempt: int) -> str:
    """The replacement of a value; another attempt gives another one."""
    draw = _stream(key, kind, value, str(attempt))
    made = _made(kind, gender, value, attempt, draw)
    if attempt < LONGER:
        return made
    signs = string.digits if kind in NUMBERS else alphabet(made[-1]) if kind in ("first", "last") else string.ascii_uppercase if value.isupper() else string.ascii_lowercase
    ending = "".join(_pick(signs, draw) for _ in range(1 + (attempt - LONGER) // 2))
    return ending + "." + made if kind == "domain" else made + ending


def _made(kind: str, gender: str, value: str, attempt: int, draw) -> str:
    if kind == "domain":
        # one that is reserved for examples
        *names, top = value.split(".")
        return ".".join([*(_same_kinds(n, draw) for n in names[:-1]), _same_kinds(names[-1], draw), "example", top])
    if kind == "ip":
        return ".".join(str(1 + next(draw) % 223) if k == 0 else str(next(draw)) for k in range(4))
    if kind == "card":
        out = list(_same_kinds(value, draw))
        if luhn(re.sub(r"\D", "", value)):
            last = max(k for k, c in enumerate(out) if c.isdigit())
            for d in string.digits:
                out[last] = d
                if luhn("".join(c for c in out if c.isdigit())):
                    break
        return "".join(out)
    if kind == "phone" and value.startswith("+"):
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)
        return value[: code.end()] + _same_kinds(value[code.end() :], draw)
    if kind in ("first", "last"):
        own_script = script(value[0])
        if own_script not in SYLLABLES:
            return _same_kinds(value, draw)
        if gender == "n" and kind == "first":
            gender = "f" if value[-1:].lower() in "aeая" else "n"
        own = [n for n in (FIRST.get(gender, FIRST["f"] + FIRST["m"]) if kind == "first" else LAST) if script(n[0]) == own_script]
        if attempt < 2:
            name = own[(next(draw) << 8 | next(draw)) % len(own)]
        else:
            syllables = SYLLABLES[own_script]
            name = "".join(syllables[next(draw) % len(syllables)] for _ in range(2 + attempt // 4)).capitalize() + ENDINGS[own_script, gender if kind == "first" else "n"]
        return name.upper() if value.isupper() and len(value) > 1 else name
    return _same_kinds(value, draw)


def _flag(patterns):
    """Adds a digest of the text to rows with entities; null to the others."""
    def run(batches):
        compiled = [(k, re.compile(p)) for k, p in patterns]
        for batch in batches:
            key = [xxhash.xxh3_128_digest(t.encode()) if t and entities(t, compiled) else None for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary())], names=[*batch.schema.names, "_key"])
    return run


def _list(patterns):
    def run(batches):
        compiled = [(k, re.compile(p)) for k, p in patterns]
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                if t:
                    key = xxhash.xxh3_128_digest(t.encode())
                    out += {(key, kind, gender, t[s:e]) for s, e, kind, gender in entities(t, compiled)}
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["key", "kind", "gender", "value"])
    return run


def _make(key: bytes):
    def run(batches):
        for batch in batches:
            kind, gender, value, attempt = (batch.column(c).to_pylist() for c in ("kind", "gender", "value", "attempt"))
            made = [surrogate(key, k, g, v, a) for k, g, v, a in zip(kind, gender, value, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "surrogate"])
    return run


def _replace(patterns):
    def run(batches):
        compiled = [(k, re.compile(p)) for k, p in patterns]
        for batch in batches:
            text, count = [], []
            for t, pairs in zip(batch.column("_text").to_pylist(), batch.column("_pairs").to_pylist(), strict=True):
                new = {(p["kind"], p["value"]): p["surrogate"] for p in pairs or ()}
                out, at, n = [], 0, 0
                for s, e, kind, _ in entities(t, compiled) if new else ():
                    out += [t[at:s], new[kind, t[s:e]]]
                    at, n = e, n + (kind != "domain")  # an address counts once
                text.append(t if t is None else "".join([*out, t[at:]]))
                count.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(text, pa.string()), pa.array(count, pa.int64())], names=["_row", "_text", "_n"])
    return run


def mapping(texts: DataFrame, key: bytes, patterns=PATTERNS, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(mentions, surrogates): (key, kind, value) of every text, and (kind, value, surrogate) without collisions."""
    mentions = stored(texts.select("_text").mapInArrow(_list(patterns), "key binary, kind string, gender string, value string"), "mentions")
    cur = (mentions.groupBy("kind", "value").agg(F.min("gender").alias("gender")).withColumn("attempt", F.lit(0)))
    made = "kind string, value string, gender string, attempt int, surrogate string"
    real = mentions.select(F.col("kind").alias("k"), F.col("value").alias("v")).distinct()
    for _ in range(max_rounds):
        cur = stored(cur.select("kind", "value", "gender", "attempt").mapInArrow(_make(key), made), "surrogates")
        first = F.row_number().over(W.partitionBy("kind", "surrogate").orderBy("attempt", "value"))
        judged = (cur.withColumn("first", first).join(real.hint("merge"), (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v")), "left")
                  .withColumn("again", (F.col("first") > 1) | F.col("v").isNotNull()))
        judged = stored(judged.select("kind", "value", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "again"), "judged")
        if not judged.filter("again").limit(1).count():
            return mentions, cur.select("kind", "value", "surrogate")
        cur = judged
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


#: The setting that holds the key of the registered queries.
KEY = "spark.brickyard.surrogates.key"
_OWN_KEYS: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key in the session's settings; without one a random key, the same for all of an application."""
    given = spark.conf.get(KEY, "")
    return given.encode() if given else _OWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def replace(docs: DataFrame, key: bytes, patterns=PATTERNS, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``count``, a column of that name has the number of replacements."""
    if not key:
        raise ValueError("surrogates need a key")
    small_batches(docs)
    names = docs.columns
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"], F.lit(0).alias("_end")).alias("_row"))
    mentions, surrogates = mapping(rows, key, patterns)
    pairs = (mentions.join(surrogates, ["kind", "value"]).groupBy("key")
             .agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("_pairs")))
    schema = T.StructType([rows.schema["_text"], rows.schema["_row"], T.StructField("_key", T.BinaryType())])
    flagged = rows.mapInArrow(_flag(patterns), schema)
    plain = flagged.filter("_key is null").select("_row", "_text", F.lit(0).cast("long").alias("_n"))
    private = flagged.filter("_key is not null").join(pairs.hint("merge"), F.col("_key") == F.col("key")).select("_row", "_text", "_pairs")
    private = private.mapInArrow(_replace(patterns), T.StructType([rows.schema["_row"], rows.schema["_text"], T.StructField("_n", T.LongType())]))
    out = plain.unionByName(private)
    columns = [F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names]
    return out.select(*columns, *([F.col("_n").alias(count)] if count else []))
