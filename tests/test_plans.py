"""Plan checks: no Python in the plans, filters reach the scan, no raw-row single partition."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["market_pulse", "monthly_momentum", "heat_index", "register_cleaning", "commuter_belt", "tier_summary"]


@pytest.fixture(autouse=True)
def whole_plans(spark):
    """Plans are printed in full."""
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.set("spark.sql.maxMetadataStringLength", old)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_udf(spark, name):
    p = _plan(E.queries()[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in p


def _orders_scan(plan: str) -> str:
    return next(x for x in plan.splitlines() if "FileScan parquet" in x and "orders.parquet" in x)


def test_price_filter_pushed_and_columns_pruned(spark):
    from brickyard.config import TEST
    from brickyard.sources.tables import DerivedSources
    df = DerivedSources(spark, SF, TEST).ms().select("county", "price_eur")
    scan = _orders_scan(_plan(df))
    pushed = scan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThan(o_totalprice,10000.0)" in pushed and "LessThan(o_totalprice,5000000.0)" in pushed
    assert "o_orderpriority" in pushed                         # the market-sale filter reaches the scan too
    read = scan.split("ReadSchema: struct<")[1]
    assert "o_orderstatus" not in read and "o_orderkey" not in read     # unused columns are not read


def test_profiles_read_the_sales_twice_and_never_sort_a_group_of_them(spark):
    """Two scans for all profiles: the histogram's and the one behind the quantiles."""
    from brickyard.config import TEST
    from brickyard.plans import profiles as P
    from brickyard.sources.tables import stored_for
    src = stored_for(spark, SF, TEST)
    hist = P.histogram(src.tx(), TEST)
    assert _plan(hist).count("FileScan parquet") == 1 and _plan(hist).count("Exchange") == 1
    p = _plan(P.profiles(src.tx(), TEST, src.histogram()))
    assert p.count("price_eur:decimal(12,2)") == 1


def test_every_order_names_existing_columns(spark):
    from brickyard.plans import catalog
    for name, keys in catalog.ORDER.items():
        df = E.queries()[name](spark, SF)
        assert all(k.lstrip("-") in df.columns for k in keys), name


def test_stored_path_prunes_years_and_pushes_market_flag(spark):
    from brickyard.config import TEST
    from brickyard.sources.tables import stored_for
    from pyspark.sql import functions as F
    df = stored_for(spark, SF, TEST).ms().where(F.col("year") == 1998).select("county", "price_eur")
    p = _plan(df)
    scan = next(x for x in p.splitlines() if "FileScan parquet" in x)
    assert "PartitionFilters: [isnotnull(year" in scan and "(year" in scan
    assert "not_full_market" in scan.split("PushedFilters: [")[1].split("]")[0]
    assert "property_type" not in scan.split("ReadSchema: struct<")[1]
