"""Total order over part files, key coverage, stored scores, complete months."""

import csv
import datetime as dt
import glob
import os
import random

import pytest

from brickyard.config import Config
from brickyard.operators.order import with_ordinal
from brickyard.operators.referential import key_coverage
from brickyard.plans import ingest, market
from brickyard.sources.sinks import write_result


def test_ordinals_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, rng.randrange(50)]), f"p{rng.randrange(9)}") for k in range(700)]
    df = spark.createDataFrame(rows, "k long, score int, place string").repartition(7)
    got = {r.k: r.ordinal for r in with_ordinal(df, ("-score", "place", "k"), partitions=13).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2], r[0]))
    assert got == {r[0]: n for n, r in enumerate(order, 1)}


def test_part_files_are_sorted_throughout(spark, tmpdir_path):
    df = spark.createDataFrame([(k * 7919 % 1000, str(k)) for k in range(1000)], "v int, t string")
    out = os.path.join(tmpdir_path, "sorted")
    write_result(with_ordinal(df, ("-v",), partitions=6), out)
    rows = []
    for path in sorted(glob.glob(os.path.join(out, "part-*.csv"))):
        with open(path) as f:
            rows += [(int(r["ordinal"]), int(r["v"])) for r in csv.DictReader(f)]
    assert len(rows) == 1000 and rows == sorted(rows) and [v for _, v in rows] == sorted((v for _, v in rows), reverse=True)
    assert [o for o, _ in rows] == list(range(1, 1001))


def test_ordinals_of_ties_and_of_nothing(spark):
    df = spark.createDataFrame([(1,)] * 50, "v int")
    assert sorted(r.ordinal for r in with_ordinal(df, ("v",)).collect()) == list(range(1, 51))
    assert with_ordinal(df.limit(0), ("v",)).collect() == []


def test_key_coverage_both_ways(spark):
    facts = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 2), (None, 1)], "k string, y int")
    dim = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("d", 1), (None, 1)], "k string, y int")
    r = key_coverage(facts, dim, ["k", "y"]).first().asDict()
    assert r == {"fact_keys": 4, "dimension_keys": 4, "facts_without_dimension": 1, "fact_rows_without_dimension": 1, "dimension_without_facts": 1, "repeated_dimension_keys": 1}
    assert key_coverage(facts.limit(0), dim.limit(0), ["k", "y"]).first().fact_keys == 0


def test_months_that_have_just_begun_are_not_complete(spark):
    schema = ("date_of_sale date, county string, region string, price_eur decimal(12,2), property_type string, not_full_market boolean, vat_exclusive boolean, "
              "year int, month int, quarter string, eircode string")
    days = [(y, m, d) for y, m, n in ((2021, 11, 20), (2021, 12, 15), (2022, 1, 22), (2022, 2, 19), (2022, 3, 3)) for d in range(1, n + 1)]
    from decimal import Decimal
    rows = [(dt.date(y, m, d), c, "R", Decimal(200000 + 1000 * m + d), "x", False, False, y, m, "Q", None) for y, m, d in days for c in ("A", "B")]
    cfg = Config(focus_place="A")
    df = spark.createDataFrame(rows, schema)
    months, monthly = market.side_profile(df, cfg), market.monthly_momentum(market.place_month_profile(df, cfg), cfg)
    got = {str(r.sale_month)[:7]: (r.days_seen, r.complete) for r in market.complete_months(months, cfg).collect()}
    assert got == {"2021-11": (20, True), "2021-12": (15, False), "2022-01": (22, True), "2022-02": (19, True), "2022-03": (3, False)}
    assert {(r.county, str(r.sale_month)) for r in market.momentum_signals_complete(monthly, months, cfg).collect()} == {("A", "2022-02-01"), ("B", "2022-02-01")}
    assert {str(r.sale_month) for r in market.momentum_signals(monthly, cfg).collect()} == {"2022-03-01"}


def test_scores_come_back_from_a_file_as_they_were(spark):
    from brickyard.sources import schemas
    df = spark.createDataFrame([("Cork", "Munster", "250000.50", "300000.25", "20.0", "5.12", "7.5", "60.1", "1.0", "2.5", "3.5", "4.0", "2.8", "Tier 1", "1"),
                                ("Kerry, South", 'Mun"ster', None, "1.00", None, "5.10", "7.5", "60.1", "1.0", "2.5", "3.5", "4.0", None, "Tier 3", "2")],
                               ", ".join(f"`{f.name}` string" for f in schemas.INVESTMENT_SCORES.fields))
    scores = schemas.at_rest(df, schemas.INVESTMENT_SCORES)
    assert sorted(map(repr, ingest.scores_from_file(scores, Config()).collect())) == sorted(map(repr, schemas.for_jobs(scores).collect()))


@pytest.mark.parametrize("name", ["register_load", "register_manifest"])
def test_files_of_a_run_are_new_ones(spark, name):
    customer = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    a, b = (sorted(map(repr, getattr(ingest, name)(customer).drop("bytes").collect())) for _ in range(2))
    assert a == b and a
