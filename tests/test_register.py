"""Raw register loader: header aliases, byte encodings, cleaning rules, missing years."""

import datetime as dt
import os

import pytest

from brickyard.plans.ingest import load_profile
from brickyard.sources import register as R, schemas

HEAD_2020 = "Date of Sale (dd/mm/yyyy),Address,County,Eircode,Price (€),Not Full Market Price,VAT Exclusive," \
            "Description of Property\n"
ROWS_2020 = [
    '05/03/2020,1 Main St,Dublin 15,D15 AB12,"€320,000.00",No,No,Second-Hand Dwelling house /Apartment',
    '5/3/2020,2 Main St,Co. Cork,T12 X,"€250,000.00",No,Yes,New Dwelling house /Apartment',
    '06/03/2020,3 Main St,Cork,,"€410,000.00",No,No,Second-Hand Dwelling house /Apartment',
    '07/03/2020,4 Main St,County Clare,,"€199,500.00",No,No,Second-Hand Dwelling house /Apartment',
    '08/03/2020,5 Main St,Tipperary North,,"€150,000.00",No,No,Second-Hand Dwelling house /Apartment',
    '09/03/2020,6 Main St,GALWAY CITY,,"€180,000.00",No,No,Second-Hand Dwelling house /Apartment',
    '10/03/2020,7 Main St,Atlantis,,"€180,000.00",No,No,Second-Hand Dwelling house /Apartment',
    '31/02/2020,8 Main St,Mayo,,"€180,000.00",No,No,Second-Hand Dwelling house /Apartment',
    '11/03/2020,9 Main St,Co Mayo,,n/a,No,No,Second-Hand Dwelling house /Apartment',
    '12/03/2020,10 Main St,Kerry,,"€9,999.00",No,No,Second-Hand Dwelling house /Apartment',
    '12/03/2020,11 Main St,Kerry,,"€10,000.00",No,No,Second-Hand Dwelling house /Apartment',
    '12/03/2020,12 Main St,Kerry,,"€5,000,000.00",No,No,Second-Hand Dwelling house /Apartment',
    '13/03/2020,13 Main St,Kerry,,"€300,000.00",Yes,No,Second-Hand Dwelling house /Apartment',
    '14/03/2020,14 Main St,Kerry,,"€300,000.00",,No,Second-Hand Dwelling house /Apartment',
    '15/03/2020,15 Main St,,,"€300,000.00",No,No,Second-Hand Dwelling house /Apartment',
    '16/03/2020,16 Main St,dublin 6w,D6W XY00,"€825,000.00",N,No,Second-Hand Dwelling house /Apartment',
]
# 2021: plain headers, no VAT column, ISO dates, plain numbers
HEAD_2021 = "date_of_sale,county,price_eur,not_full_market_price,property_type\n"
ROWS_2021 = ["2021-04-01,Leitrim,120000,0,Second-Hand Dwelling house /Apartment",
             "2021-04-02,Leitrim,130000.50,FALSE,New Dwelling house /Apartment"]
# 2022: short "Price" header, no market flag and no type column
HEAD_2022 = "Date of Sale,County,Price\n"
ROWS_2022 = ["01/01/2022,Sligo,\"€200,000\""]
# 2024: lacks the county column -> year skipped
HEAD_2024 = "Date of Sale,Price\n"
ROWS_2024 = ["01/01/2024,100000"]


def _write(path, text, encoding):
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


@pytest.fixture(scope="module")
def register_dir():
    import tempfile
    d = tempfile.mkdtemp(prefix="brickyard-register-", dir="/tmp")
    _write(os.path.join(d, "PPR-2020.csv"), HEAD_2020 + "\n".join(ROWS_2020) + "\n", "cp1252")
    _write(os.path.join(d, "PPR-2021.csv"), HEAD_2021 + "\n".join(ROWS_2021) + "\n", "latin-1")
    _write(os.path.join(d, "PPR-2022.csv"), HEAD_2022 + "\n".join(ROWS_2022) + "\n", "utf-8")
    _write(os.path.join(d, "PPR-2024.csv"), HEAD_2024 + "\n".join(ROWS_2024) + "\n", "utf-8")
    return d          # 2023 is missing


def test_resolve_headers_all_currency_byte_forms():
    for h in ["Price (€)", "Price (\x80)", "Price (â\x82¬)", "Price", "price_eur"]:
        assert R.resolve_headers([h, "County"])[h] == "price_eur"


@pytest.fixture(scope="module")
def loaded(spark, register_dir):
    return R.read_register(spark, register_dir, [2020, 2021, 2022, 2023, 2024])


def test_rows_and_cleaning(loaded):
    rows = sorted(loaded.collect(), key=lambda r: (r.date_of_sale, r.county, r.price_eur))
    got = [(r.date_of_sale, r.county, r.region, r.price_eur) for r in rows]
    assert got == [
        (dt.date(2020, 3, 5), "Cork", "Munster", 250000.0),
        (dt.date(2020, 3, 5), "Dublin", "Leinster", 320000.0),
        (dt.date(2020, 3, 6), "Cork", "Munster", 410000.0),     # bare "Cork" survives (Q1)
        (dt.date(2020, 3, 7), "Clare", "Munster", 199500.0),    # "County Clare"
        (dt.date(2020, 3, 8), "Tipperary", "Munster", 150000.0),
        (dt.date(2020, 3, 9), "Galway", "Connacht", 180000.0),
        (dt.date(2020, 3, 16), "Dublin", "Leinster", 825000.0),
        (dt.date(2021, 4, 1), "Leitrim", "Connacht", 120000.0),
        (dt.date(2021, 4, 2), "Leitrim", "Connacht", 130000.5),
        (dt.date(2022, 1, 1), "Sligo", "Connacht", 200000.0),
    ]


def test_canonical_columns(loaded):
    assert loaded.columns == ["date_of_sale", "county", "region", "price_eur", "property_type", "not_full_market",
                              "vat_exclusive", "year", "month", "quarter", "eircode"]
    r = {(x.county, x.price_eur): x for x in loaded.collect()}
    assert r[("Cork", 250000.0)].vat_exclusive is True and r[("Cork", 250000.0)].eircode == "T12 X"
    assert r[("Sligo", 200000.0)].property_type == "Unknown" and r[("Sligo", 200000.0)].vat_exclusive is None
    assert r[("Leitrim", 120000.0)].vat_exclusive is None          # column absent that year
    assert all(x.not_full_market is False for x in r.values())
    assert r[("Dublin", 825000.0)].quarter == "Q1" and r[("Dublin", 825000.0)].month == 3


def test_load_profile(loaded):
    p = load_profile(loaded).first()
    assert (p.transactions, p.counties, p.years) == (10, 7, "2020,2021,2022")
    assert (p.min_price, p.max_price) == (120000.0, 825000.0)
    assert p.median_price == 199750.0          # (199,500 + 200,000) / 2


def test_no_readable_years(spark, register_dir):
    with pytest.raises(FileNotFoundError):
        R.read_register(spark, register_dir, [2023, 2024])


def test_clean_table_roundtrip(spark, loaded, tmpdir_path):
    from brickyard.sources.sinks import write_clean_table
    out = os.path.join(tmpdir_path, "transactions")
    write_clean_table(loaded, out)
    back = R.read_transactions(spark, out)
    assert back.count() == 10
    assert sorted(d for d in os.listdir(out) if d.startswith("year=")) == ["year=2020", "year=2021", "year=2022"]
    plan = back.where("year = 2021")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


QUOTED = HEAD_2020 + (
    '01/02/2023,"The ""Old"" Mill, Main St",Cork,,"€210,000.00",No,No,Second-Hand Dwelling house /Apartment\n'
    '02/02/2023,"Unit 4,\nRiver Court",Kerry,,"€220,000.00",No,No,New Dwelling house /Apartment\n'
    '03/02/2023,1 Main St,Mayo,,"€230,000.00",No,No,Second-Hand Dwelling house /Apartment\n'
    '31/02/2023,2 Main St,Mayo,,"€230,000.00",No,No,x\n'
    '04/02/2023,3 Main St,Atlantis,,"€230,000.00",No,No,x\n'
    '05/02/2023,4 Main St,Mayo,,"€1.00",No,No,x\n'
    '06/02/2023,5 Main St,Mayo,,"€230,000.00",Yes,No,x\n'
    '07/02/2023,6 Main St,,,"€230,000.00",No,No,x\n'
    'broken\n'
    '08/02/2023,8, Main St,Mayo,,,No,No,x,too many\n')


def test_quoted_fields_and_line_breaks_keep_their_rows(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "PPR-2023.csv"), QUOTED, "cp1252")
    rows = R.read_register(spark, tmpdir_path, [2023]).collect()
    assert sorted((r.county, r.price_eur) for r in rows) == [("Cork", 210000.0), ("Kerry", 220000.0), ("Mayo", 230000.0)]


def test_kept_rows_and_counted_rejects_are_all_records(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "PPR-2023.csv"), QUOTED, "cp1252")
    got = {r.reject: r.n for r in R.register_rejects(spark, tmpdir_path, [2023]).collect()}
    assert got.pop(None) == R.read_register(spark, tmpdir_path, [2023]).count() == 3
    assert got == {"unreadable date": 1, "unknown place": 1, "price out of range": 1, "not a full-market sale": 1, "no place": 1, "malformed record": 2}


def test_a_year_in_part_files(spark, tmpdir_path):
    part = os.path.join(tmpdir_path, "PPR-2023.csv")
    os.makedirs(part)
    for k in range(3):
        _write(os.path.join(part, f"part-{k}.csv"), HEAD_2022 + f'0{k + 1}/01/2023,Sligo,"€200,00{k}"\n', "utf-8")
    assert sorted(r.price_eur for r in R.read_register(spark, tmpdir_path, [2023]).collect()) == [200000.0, 200001.0, 200002.0]


def test_unreadable_dimension_values_fail(spark, tmpdir_path):
    head = "county,region,year,new_completions,estimated_demand,supply_deficit,supply_ratio,supply_deficit_pct\n"
    good, bad = os.path.join(tmpdir_path, "good.csv"), os.path.join(tmpdir_path, "bad.csv")
    _write(good, head + "Cork,Munster,2020,1,2,1,0.500,NA\nKerry,Munster,2020,,2,1,0.5,50.0\n", "utf-8")
    _write(bad, head + "Cork,Munster,2020,1,2,1,0.5oo,50\n", "utf-8")
    rows = R.read_dimension_csv(spark, good, schemas.SUPPLY_DEMAND).orderBy("county").collect()
    assert rows[0].supply_deficit_pct is None and rows[1].new_completions is None and rows[1].supply_deficit_pct == 50.0
    with pytest.raises(Exception, match="supply_ratio has an unreadable value"):
        R.read_dimension_csv(spark, bad, schemas.SUPPLY_DEMAND).collect()


def test_clean_csv_equals_the_clean_table(spark, loaded, tmpdir_path):
    path = os.path.join(tmpdir_path, "transactions.csv")
    columns = ["date_of_sale", "county", "region", "price_eur", "property_type", "vat_exclusive", "eircode"]
    loaded.select(columns).write.option("header", True).csv(path)
    back = R.read_transactions(spark, path)
    assert back.schema.simpleString() == schemas.TRANSACTIONS.simpleString()
    key = lambda rows: sorted(map(str, rows))
    assert key(back.select(R.TX_COLUMNS).collect()) == key(loaded.select(R.TX_COLUMNS).collect())


def test_stored_scores_drive_the_score_jobs(spark, tmpdir_path):
    from brickyard.config import Config
    from brickyard.plans import invest
    path = os.path.join(tmpdir_path, "scores.csv")
    _write(path, "county,region,median_price_2020,median_price_2024,price_growth_4yr_pct,rental_yield_est_pct,years_salary_to_buy,supply_deficit_pct,"
           "growth_score,supply_score,yield_score,affordability_score,composite_investment_score,investment_tier,rank\n"
           "Cork,Munster,200000,300000,50.0,5.00,7.0,50.0,80,70,60,50,70.5,My own tier,1\n"
           "Kerry,Munster,210000,250000,19.0,5.50,6.0,48.0,10,20,30,40,22.0,Another,2\n", "utf-8")
    scores = R.read_scores_csv(spark, path, Config.register())
    assert [(r.county, r.investment_tier, r.rank) for r in invest.investment_scorecard(scores).orderBy("rank").collect()] == [("Cork", "My own tier", 1), ("Kerry", "Another", 2)]
    assert {r.investment_tier for r in invest.tier_summary(scores).collect()} == {"My own tier", "Another"}


def test_exact_ties_and_boundaries(spark):
    from brickyard.plans import afford, invest
    rows = [("A", 30.0, 2.0, 3.0), ("B", 32.0, 1.8, 3.0), ("C", 28.0, 2.2, 3.0), ("D", 31.0, 2.0, 4.0)]
    inv = spark.createDataFrame([(c, "r", 1.0, g, y, s) for c, g, y, s in rows],
                                "county string, region string, median_price_latest double, price_growth_pct double, rental_yield_est_pct double, years_salary_to_buy double")
    got = {r.county: (r.risk_adj_return_score, r.risk_adj_rank) for r in invest.risk_adjusted_ranking(inv).collect()}
    assert got == {"A": (18.8, 1), "B": (18.8, 1), "C": (18.8, 1), "D": (18.8, 1)}
    ratios = [("A", 1.3, 3.3), ("B", 1.8, 3.8), ("C", 7.2, 8.2), ("D", 7.2, 8.1)]
    aff = spark.createDataFrame([(c, "r", y, v, 1.0) for c, b, last in ratios for y, v in ((1995, b), (2000, last))],
                                "county string, region string, year int, years_salary_to_buy double, median_price double")
    got = {r.county: (r.yrs_salary_deterioration, r.trend) for r in afford.affordability_deterioration(aff).collect()}
    assert got == {"A": (2.0, "Rapidly Worsening"), "B": (2.0, "Rapidly Worsening"), "C": (1.0, "Worsening"), "D": (0.9, "Stable")}


def test_clean_csv_as_a_database_exports_it(spark, tmpdir_path):
    """Booleans as t and f, a blank flag is the column's default: none of the three market sales is lost."""
    path = os.path.join(tmpdir_path, "transactions.csv")
    with open(path, "w") as f:
        f.write("transaction_id,date_of_sale,county,region,price_eur,property_type,not_full_market,vat_exclusive,year,month,quarter\n"
                "1,2020-03-05,Cork,Munster,250000.10,Second-Hand Apartment,f,t,2020,3,Q1\n2,2020-03-06,Cork,Munster,260000.00,New house,f,,2020,3,Q1\n"
                "3,2020-03-07,Kerry,Munster,270000.5,,,f,2020,3,Q1\n4,2020-03-08,Kerry,Munster,280000,,t,f,2020,3,Q1\n")
    rows = sorted(R.read_transactions(spark, path).where("not not_full_market").collect(), key=lambda r: r.date_of_sale)
    assert [(str(r.price_eur), r.vat_exclusive) for r in rows] == [("250000.10", True), ("260000.00", None), ("270000.50", False)]


def test_unknown_flag_of_a_clean_csv_fails(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "transactions.csv")
    with open(path, "w") as f:
        f.write("date_of_sale,county,region,price_eur,not_full_market\n2020-03-05,Cork,Munster,250000.10,perhaps\n")
    with pytest.raises(Exception, match="not_full_market has an unreadable value: perhaps"):
        R.read_transactions(spark, path).collect()


def test_whole_numbers_of_a_dimension(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "sd.csv")
    head = ",".join(f.name for f in schemas.SUPPLY_DEMAND.fields)
    with open(path, "w") as f:
        f.write(head + "\nCork,Munster,2020,400.0,1000,600,0.4,60.0\n")
    assert R.read_dimension_csv(spark, path, schemas.SUPPLY_DEMAND).first().new_completions == 400
    with open(path, "w") as f:
        f.write(head + "\nCork,Munster,2020,400.5,1000,600,0.4,60.0\n")
    with pytest.raises(Exception, match="new_completions has an unreadable value"):
        R.read_dimension_csv(spark, path, schemas.SUPPLY_DEMAND).collect()


def test_every_record_is_kept_or_counted(spark, register_dir):
    rows = {r.file_year: r.asDict() for r in R.load_manifest(spark, register_dir, [2020, 2021, 2022, 2023, 2024]).collect()}
    assert {y: r["status"] for y, r in rows.items()} == {2020: "read", 2021: "read", 2022: "read", 2023: "missing", 2024: "lacks county"}
    reasons = [k for k in rows[2020] if k not in ("file_year", "status", "bytes", "records", "kept")]
    for y in (2020, 2021, 2022):
        assert rows[y]["records"] == rows[y]["kept"] + sum(rows[y][k] for k in reasons)
        assert rows[y]["bytes"] == os.path.getsize(os.path.join(register_dir, f"PPR-{y}.csv"))
    assert rows[2020]["records"] == len(ROWS_2020) and rows[2020]["price_out_of_range"] == 3 and rows[2020]["unknown_place"] == 1 and rows[2020]["no_place"] == 1
    assert rows[2020]["not_a_full_market_sale"] == 2 and rows[2020]["unreadable_date"] == 1 and rows[2020]["unreadable_price"] == 1
    assert rows[2023]["bytes"] is None and rows[2024]["records"] is None
    clean = R.read_register(spark, register_dir, [2020, 2021, 2022, 2023, 2024])
    assert clean.count() == sum(rows[y]["kept"] for y in (2020, 2021, 2022))
