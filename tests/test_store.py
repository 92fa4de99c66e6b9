"""The versioned store: nothing is written twice, only what changed is, old versions go, exact types at rest."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F, types as T

from brickyard.config import TEST, Config
from brickyard.plans import catalog, profiles as P
from brickyard.sources import schemas
from brickyard.sources.store import Store
from brickyard.sources.tables import StoredSources, materialize, sync_registers

SF = "/root/testdata/sf0.001"


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def _inputs(spark, where=None):
    d = tempfile.mkdtemp(prefix="brickyard-inputs-", dir="/tmp")
    for t in ("orders", "customer", "nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def stored(spark):
    root = tempfile.mkdtemp(prefix="brickyard-store-", dir="/tmp")
    return materialize(spark, _inputs(spark), root, TEST)


def test_types_at_rest(spark, stored):
    for name, schema in schemas.TABLES.items():
        df = stored.at_rest(name)
        assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields], name
        on_disk = {f.name: f.dataType for f in (stored.store.transactions(stored.manifest, keyed=True) if name == "transactions" else df).schema.fields}
        assert all(on_disk[f.name] == f.dataType for f in schema.fields if f.name not in ("year",))
    assert isinstance(stored.at_rest("transactions").schema["price_eur"].dataType, T.DecimalType)


def test_a_value_that_does_not_fit_fails(spark):
    df = spark.createDataFrame([("A", "R", 2020, 1.0, 1.0, 12345.6, 1.0, 1.0, 5)], [f.name for f in schemas.AFFORDABILITY.fields])
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        schemas.at_rest(df, schemas.AFFORDABILITY).collect()


def test_another_session_writes_nothing(spark, stored):
    before = _files(stored.store.root)
    again = materialize(spark.newSession(), stored.sf_dir, stored.store.root, TEST)
    assert again.manifest == stored.manifest and _files(stored.store.root) == before


def test_only_the_changed_year_is_written(spark):
    inputs, root = _inputs(spark), tempfile.mkdtemp(prefix="brickyard-store-", dir="/tmp")
    first = materialize(spark, inputs, root, TEST, keep=1)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    fewer = orders.where((F.year("o_orderdate") != 1998) | (F.col("o_orderkey") % 3 > 0)).where(F.year("o_orderdate") != 1996)
    fewer.write.mode("overwrite").parquet(f"{inputs}/orders.parquet")
    second = materialize(spark, inputs, root, TEST, keep=1)
    a, b = first.manifest["slices"], second.manifest["slices"]
    assert set(a) - set(b) == {"1996"} and {y for y in b if a[y]["load"] != b[y]["load"]} == {"1998"}
    assert {y for y in second.manifest["profiles"] if first.manifest["profiles"].get(y) != second.manifest["profiles"][y]} == {"1998", "all"}
    # every result is that of a store made from nothing
    fresh = materialize(spark, inputs, tempfile.mkdtemp(prefix="brickyard-store-", dir="/tmp"), TEST)
    assert _rows(second.profiles(*P.NAMES)) == _rows(fresh.profiles(*P.NAMES))
    for name in ("market_pulse", "load_profile", "heat_index", "investment_scorecard", "supply_gap"):
        assert _rows(catalog.jobs_on(second, TEST)[name]()) == _rows(catalog.jobs_on(fresh, TEST)[name]())
    # the old version and what only it named are gone
    assert Store(spark, root, TEST).versions() == [2]
    left = {f.split("load=")[1].split("/")[0] for f in _files(root) if "load=" in f and "slice=1998" in f}
    assert left == {b["1998"]["load"]} and not [f for f in _files(root) if "1996" in f]


def test_older_versions_stay_readable_while_kept(spark):
    inputs, root = _inputs(spark), tempfile.mkdtemp(prefix="brickyard-store-", dir="/tmp")
    first = materialize(spark, inputs, root, TEST)
    want = _rows(first.profiles("all"))
    spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{inputs}/orders.parquet")
    second = materialize(spark, inputs, root, TEST)
    old = StoredSources(second.store, inputs, second.store.manifest(1))
    assert _rows(old.profiles("all")) == want != _rows(second.profiles("all"))
    assert _rows(old.tx().groupBy("year").count()) == _rows(first.tx().groupBy("year").count())


def test_other_parameters_make_another_version(spark):
    inputs, root = _inputs(spark), tempfile.mkdtemp(prefix="brickyard-store-", dir="/tmp")
    materialize(spark, inputs, root, TEST)
    other = materialize(spark, inputs, root, TEST.with_(focus_place="NATION_7"))
    assert other.manifest["version"] == 2
    fresh = materialize(spark, inputs, tempfile.mkdtemp(prefix="brickyard-store-", dir="/tmp"), TEST.with_(focus_place="NATION_7"))
    assert _rows(other.profiles("focus", "postcode")) == _rows(fresh.profiles("focus", "postcode"))


def test_a_lost_run_leaves_the_version_before(spark):
    inputs, root = _inputs(spark), tempfile.mkdtemp(prefix="brickyard-store-", dir="/tmp")
    first = materialize(spark, inputs, root, TEST, keep=1)
    store = Store(spark, root, TEST, keep=1)

    def broken(store, m):
        yield "affordability", spark.range(1).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.sync({**{s: v["source"] for s, v in first.manifest["slices"].items()}, "1995": "new"}, lambda s: first.store.transactions(first.manifest, keyed=True).where("year = 1995").withColumn("slice", F.lit("1995")), broken)
    assert store.manifest() == first.manifest and _rows(StoredSources(store, inputs).profiles("all")) == _rows(first.profiles("all"))
    # the next version takes the leftovers away
    spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{inputs}/orders.parquet")
    materialize(spark, inputs, root, TEST, keep=1)
    loads = {f.split("load=")[1].split("/")[0] for f in _files(root) if "load=" in f}
    assert len(loads) == 1


def test_publishing_twice_fails(spark, stored):
    with pytest.raises(RuntimeError, match="another writer"):
        stored.store.files.publish("versions/00000001.json", json.dumps({}))


HEAD = "Date of Sale (dd/mm/yyyy),Address,County,Eircode,Price (€),Not Full Market Price,VAT Exclusive,Description of Property\n"


def _register(path, rows):
    with open(path, "wb") as f:
        f.write((HEAD + "".join(f'{d},1 Main St,{c},,"€{p}",No,No,Second-Hand Apartment\n' for d, c, p in rows)).encode("cp1252"))


def test_registers_are_read_again_only_where_they_changed(spark, tmpdir_path):
    cfg = Config.register()
    d, root = os.path.join(tmpdir_path, "ppr"), os.path.join(tmpdir_path, "store")
    os.makedirs(d)
    aff, sd = os.path.join(tmpdir_path, "aff.csv"), os.path.join(tmpdir_path, "sd.csv")
    with open(aff, "w") as f:
        f.write("county,region,year,median_price,avg_annual_wage,years_salary_to_buy,monthly_rent_estimate,price_to_income_ratio,population\n"
                + "".join(f"{c},R,{y},300000.5,40000.0,7.5,1200,7.51,1000.0\n" for c in ("Cork", "Dublin") for y in (2020, 2024)))
    with open(sd, "w") as f:
        f.write("county,region,year,new_completions,estimated_demand,supply_deficit,supply_ratio,supply_deficit_pct\n"
                + "".join(f"{c},R,{y},400,1000,600,0.4,60.0\n" for c in ("Cork", "Dublin") for y in (2020, 2024)))
    _register(f"{d}/PPR-2020.csv", [("05/03/2020", "Co. Cork", "250,000.10"), ("06/03/2020", "Dublin 4", "400,000.20")])
    # a sale dated in the year before its file's
    _register(f"{d}/PPR-2021.csv", [("05/03/2021", "Cork", "260,000.00"), ("31/12/2020", "Cork", "270,000.00")])
    a = sync_registers(spark, d, range(2020, 2025), aff, sd, root, cfg)
    pulse = {(r.county, r.year): (r.transaction_count, r.median_price) for r in catalog.jobs_on(a, cfg)["market_pulse"]().collect()}
    assert pulse == {("Cork", 2020): (2, 260000), ("Dublin", 2020): (1, 400000), ("Cork", 2021): (1, 260000)}
    assert str(a.tx().where("county = 'Dublin'").first().price_eur) == "400000.20" and a.tx().where("date_of_sale = date'2020-03-06'").count() == 1
    before = _files(root)
    assert sync_registers(spark, d, range(2020, 2025), aff, sd, root, cfg).manifest == a.manifest and _files(root) == before
    _register(f"{d}/PPR-2022.csv", [("05/03/2022", "Cork", "280,000.00")])
    b = sync_registers(spark, d, range(2020, 2025), aff, sd, root, cfg)
    assert {s for s, v in b.manifest["slices"].items() if v["load"] == b.manifest["load"]} == {"2022"}
    # a file that loses its sale of the year before changes that year's profiles too
    _register(f"{d}/PPR-2021.csv", [("05/03/2021", "Cork", "265,000.00")])
    c = sync_registers(spark, d, range(2020, 2025), aff, sd, root, cfg)
    pulse = {(r.county, r.year): (r.transaction_count, r.median_price) for r in catalog.jobs_on(c, cfg)["market_pulse"]().collect()}
    assert pulse == {("Cork", 2020): (1, 250000), ("Dublin", 2020): (1, 400000), ("Cork", 2021): (1, 265000), ("Cork", 2022): (1, 280000)}
    assert str(c.at_rest("affordability").first().median_price) == "300000.50"
