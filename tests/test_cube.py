"""The histogram cube: exact, mergeable, and the same bits in any partitioning."""

import datetime as dt
import random
import statistics
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from brickyard.config import Config
from brickyard.operators import cube
from brickyard.plans import market, profiles as P

CFG = Config(focus_place="Dublin", base_year=2020, latest_year=2022)
SCHEMA = ("date_of_sale date, county string, region string, price_eur decimal(12,2), property_type string, "
          "not_full_market boolean, vat_exclusive boolean, year int, month int, quarter string, eircode string")
KINDS = ["New Dwelling house /Apartment", "Second-Hand Apartment", "Second-Hand Dwelling house", "Unknown", None]


def sales(n, seed=1):
    from decimal import Decimal
    rng = random.Random(seed)
    out = []
    for k in range(n):
        y, m = rng.choice([2020, 2021, 2022]), rng.randrange(1, 13)
        place = rng.choice(["Dublin", "Dublin", "Cork", "Kerry"])
        cents = rng.choice([25_000_000, rng.randrange(1_000_001, 499_999_999), 10_000_000 + rng.randrange(300)])
        out.append((dt.date(y, m, rng.choice([1, 2, 15, 28, 31 if m in (1, 3, 5, 7, 8, 10, 12) else 27])), place, "L" if place == "Dublin" else "M", Decimal(cents) / 100, rng.choice(KINDS), rng.random() < 0.1,
                    rng.choice([True, False, None]), y, m, f"Q{(m + 2) // 3}", rng.choice(["D4 X", "D6W X", None])))
    return out


@pytest.mark.parametrize("v", [0, 1, -1, 1023, 1024, 1025, -70_000, 49_999_999_999, 2**40 + 12345, -(2**55) - 1])
def test_buckets(spark, v):
    (low,) = spark.range(1).select(cube.bucket(F.lit(v).cast("bigint"))).first()
    assert abs(low) <= abs(v) < abs(low) + 2**20 and (abs(v) < 1024) <= (low == v) and low * v >= 0
    assert abs(v) - abs(low) <= abs(v) / 512


def test_buckets_ascend(spark):
    values = sorted(random.Random(3).randrange(-(2**45), 2**45) >> random.Random(k).randrange(44) for k in range(2000))
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v bigint").select("v", cube.bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)


def test_all_profiles_against_duckdb(spark):
    rows = sales(3000)
    got = P.profiles(spark.createDataFrame(rows, SCHEMA), CFG)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (d DATE, county VARCHAR, region VARCHAR, price DECIMAL(12,2), kind VARCHAR, flag BOOLEAN, vat BOOLEAN, year INT, month INT, q VARCHAR, e VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?,?,?,?,?,?,?,?,?,?,?)", rows)
    code = "CASE WHEN county = 'Dublin' THEN CASE e WHEN 'D4 X' THEN 'D04' WHEN 'D6W X' THEN 'D06W' END END"
    v = "coalesce(CAST(vat AS VARCHAR), 'unknown')"
    zone = f"CASE WHEN {code} IS NOT NULL THEN 'Inner City' END"
    kind = "CASE kind WHEN 'Second-Hand Apartment' THEN 'Apartment' WHEN 'Second-Hand Dwelling house' THEN 'House' ELSE 'Unknown' END"
    sets = {"place_year": ("county", "region", "''", "year", "0"), "place_month": ("county", "region", "''", "year", "month"),
            "place_type": ("county", "region", "CASE WHEN vat THEN 'New Build' ELSE 'Second-Hand' END", "year", "0"), "place_segment": ("county", "region", kind, "year", "0"),
            "focus": ("CASE WHEN county = 'Dublin' THEN 'focus' ELSE 'rest' END", "''", "''", "year", "0"), "region": ("region", "''", "''", "year", "0"),
            "month": ("''", "''", "''", "year", "month"), "vat": ("county", "''", v, "year", "0"), "postcode": (code, "''", "''", "year", "0"),
            "zone": (zone, "''", v, "year", "0"), "all": ("''", "''", "''", "0", "0")}
    want = {}
    for name, keys in sets.items():
        where = "TRUE" if name == "all" else f"NOT flag AND {keys[0]} IS NOT NULL"
        quantiles = "".join(f", quantile_cont(CAST(price AS DOUBLE), {p})" for p in P.QUANTILES.values())
        sql = f"SELECT {', '.join(keys)}, count(*), CAST(sum(price) AS VARCHAR), min(price), max(price), count(DISTINCT day(d)), list(price){quantiles} FROM t WHERE {where} GROUP BY ALL"
        if name == "all":
            sql = sql.replace("GROUP BY ALL", "")
        for r in con.execute(sql).fetchall():
            want[(name, *r[:5])] = r[5:]
    found = {(r.profile, r.place, r.region, r.part, r.year, r.month): r for r in got.collect()}
    assert set(found) == set(want)
    for key, r in found.items():
        n, total, low, high, days, prices, *qs = want[key]
        assert (r.n, str(r.total), r.min, r.max, r.days) == (n, total, float(low), float(high), days)
        exact = [Fraction(p) for p in prices]
        assert r.mean == float(sum(exact) / n) or abs(r.mean - float(sum(exact) / n)) < 1e-9 * r.mean
        if n > 1:
            assert abs(r.stddev - float(statistics.stdev(exact))) <= 1e-9 * (1 + r.stddev)
        else:
            assert r.stddev is None
        assert r.median == qs[2]
        if r.profile == "place_year":
            assert all(abs(a - b) <= 1e-15 * b for a, b in zip([r.p10, r.p25, r.p75, r.p90], [qs[0], qs[1], qs[3], qs[4]], strict=True))


def test_same_bits_in_one_and_many_partitions(spark):
    df = spark.createDataFrame(sales(1500, seed=5), SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in (1, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(sorted(map(repr, P.profiles(df.repartition(n, "price_eur"), CFG).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and results[0]


def test_histograms_merge(spark):
    a, b = sales(700, seed=8), sales(500, seed=9)
    parts = [P.histogram(spark.createDataFrame(x, SCHEMA), CFG) for x in (a, b)]
    whole = spark.createDataFrame(a + b, SCHEMA)
    merged = cube.rolled(parts[0].unionByName(parts[1]), P.DIMS)
    assert sorted(map(repr, merged.select(*P.DIMS, "b", *cube.COUNTS).collect())) == sorted(map(repr, P.histogram(whole, CFG).select(*P.DIMS, "b", *cube.COUNTS).collect()))
    assert sorted(map(repr, P.profiles(whole, CFG, merged).collect())) == sorted(map(repr, P.profiles(whole, CFG).collect()))


def test_wide_values_and_single_values(spark):
    """Prices up to the type's limit: buckets never hold more than 2^20 numbers."""
    rng = random.Random(2)
    values = [rng.randrange(10**12) for _ in range(300)] + [0, 1, 10**12 - 1, 5, 5, 5]
    rows = spark.createDataFrame([("a", v, 1) for v in values] + [("b", 7, 2)], "g string, v bigint, day int")
    hist = cube.histogram(rows, ["g"])
    sets, names = F.array(F.struct(F.col("g").alias("k"))), {"low": 0.03, "median": 0.5, "top": 1.0}
    got = {r.k: r for r in cube.profiles(rows, hist, ["g"], sets, ["k"], F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in names.items()]), list(names), scale=1).collect()}
    want = sorted(values)
    for name, p in names.items():
        pos = (len(want) - 1) * p
        lo, hi = want[int(pos)], want[min(int(pos) + (pos > int(pos)), len(want) - 1)]
        assert abs(got["a"][name] - (lo + (hi - lo) * (pos - int(pos)))) <= 1e-15 * hi
    assert str(got["a"].total) == f"{sum(values)}.00" and got["b"].median == 7.0 and got["b"].stddev is None


def test_interpolated_quantiles_are_close(spark):
    df = spark.createDataFrame(sales(2000, seed=4), SCHEMA)
    exact = {(r.county, r.year): r.median for r in market.place_year_profile(df, CFG).collect()}
    for r in market.place_year_profile(df, CFG.with_(exact_quantiles=False)).collect():
        assert abs(r.median - exact[r.county, r.year]) <= 0.003 * exact[r.county, r.year]


def test_no_rows(spark):
    assert P.profiles(spark.createDataFrame([], SCHEMA), CFG).collect() == []


@pytest.mark.parametrize("text, want", [("New Dwelling house /Apartment", "Unknown"), ("Second-Hand Apartment", "Apartment"), ("New semi-detached house", "House"),
                                        ("2 bed flat", "Apartment"), ("Cottages", "House"), ("Teach/Árasán Cónaithe Nua", "Unknown"), ("flattened warehouse", "Unknown"), ("", "Unknown"), (None, "Unknown")])
def test_property_class(spark, text, want):
    from brickyard.functions.labels import property_class
    assert spark.createDataFrame([(text,)], "t string").select(property_class("t")).first()[0] == want


def _text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_null_groups_and_groups_without_quantiles(spark):
    """A cell's NULL group is none; a group that wants no quantile keeps its row."""
    rows = spark.createDataFrame([("a", v, 1) for v in (100, 5_000_000, 5_000_001, 70)] + [("b", 7, 2), ("b", 9, 2)], "g string, v bigint, day int")
    key = lambda c: F.struct(c.alias("k"))
    sets = F.array(key(F.col("g")), F.when(F.col("g") == "a", key(F.lit("only a"))))
    wanted = F.when(F.col("k") == "b", F.array().cast("array<struct<name:string,p:double>>")).otherwise(F.array(F.struct(F.lit("median").alias("name"), F.lit(0.5).alias("p"))))
    got = {r.k: r for r in cube.profiles(rows, cube.histogram(rows, ["g"]), ["g"], sets, ["k"], wanted, ["median"], scale=1).collect()}
    assert set(got) == {"a", "only a", "b"}
    assert got["a"].median == got["only a"].median == 2_500_050.0
    assert (got["b"].n, str(got["b"].total), got["b"].median, got["b"].days) == (2, "16.00", None, 1)


def test_shuffled_targets_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(sales(1500, seed=6), SCHEMA)
    sent = sorted(map(repr, P.profiles(df, CFG).collect()))
    monkeypatch.setattr(cube, "FEW", 0)
    assert sorted(map(repr, P.profiles(df, CFG).collect())) == sent


def test_sums_of_squares_are_exact_and_of_longs(spark):
    """Squares close to 2^40 whose sum is beyond a long; no decimal is summed for each sale or each cell's group."""
    off = 2**20 - 1
    rows = spark.range(6_000).select(F.lit("a").alias("g"), F.lit(2**36 + off).cast("bigint").alias("v"), F.lit(1).alias("day"))
    hist = cube.histogram(rows, ["g"])
    assert int(hist.first().q) == 6_000 * off * off
    many = hist.select("g", "b", *[F.col(c).alias(c) if c not in "nsq" else (F.col(c) * (2**20)).cast("decimal(38,0)" if c == "q" else "bigint").alias(c) for c in cube.COUNTS])
    (r,) = cube.profiles(rows, many, ["g"], F.array(F.struct(F.col("g").alias("k"))), ["k"], F.array(), []).select("n", "stddev", "mean").collect()
    assert (r.n, r.stddev, r.mean) == (6_000 * 2**20, 0.0, (2**36 + off) / 100)
    assert "decimal(20,0)" not in _text(hist)


def test_groups_and_patterns_are_made_once(spark):
    df = spark.createDataFrame(sales(10), SCHEMA)
    assert "lambdafunction" not in _text(P.histogram(df, CFG).select(F.explode(P._sets(CFG, P.NAMES))))
    kinds = _text(df.select(P.L.property_class("property_type").alias("x")))
    assert kinds.count("RLIKE") == 3  # one pattern, then the other in one of two branches
