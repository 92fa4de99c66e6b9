"""The deployment path: clean table + stored dimension CSVs -> every job -> result directories."""

import csv
import datetime as dt
import glob
import os

from brickyard.__main__ import main
from brickyard.sources.sinks import write_clean_table

SCHEMA = ("date_of_sale date, county string, region string, price_eur double, property_type string, "
          "not_full_market boolean, vat_exclusive boolean, year int, month int, quarter string, eircode string")
PLACES = [("Dublin", "Leinster"), ("Kildare", "Leinster"), ("Cork", "Munster"), ("Leitrim", "Connacht")]


def _sales():
    rows = []
    for y in range(2020, 2025):
        for pi, (c, r) in enumerate(PLACES):
            for m in range(1, 13):
                for k in range(3):
                    p = 150000 + 60000 * pi + 8000 * (y - 2020) + 1000 * m + 137 * k
                    new = (m + k) % 3 == 0
                    rows.append((dt.date(y, m, 1 + k), c, r, float(p), "New Dwelling house /Apartment" if new else
                                 "Second-Hand Dwelling house /Apartment", False, new, y, m, f"Q{(m - 1) // 3 + 1}",
                                 f"D{(m % 24) + 1} X" if c == "Dublin" else None))
    return rows


def _write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_run_all_jobs_from_stored_tables(spark, tmpdir_path):
    tx = os.path.join(tmpdir_path, "transactions")
    write_clean_table(spark.createDataFrame(_sales(), SCHEMA), tx)
    aff, sd = os.path.join(tmpdir_path, "aff.csv"), os.path.join(tmpdir_path, "sd.csv")
    _write_csv(aff, ["county", "region", "year", "median_price", "avg_annual_wage", "years_salary_to_buy",
                     "monthly_rent_estimate", "price_to_income_ratio", "population"],
               [(c, r, y, 200000 + 10000 * i + 5000 * (y - 2020), 40000 + 1000 * i, round((200000 + 10000 * i + 5000 * (y - 2020)) / (40000 + 1000 * i), 1),
                 900 + 50 * i, 5.0, 100000) for i, (c, r) in enumerate(PLACES) for y in range(2020, 2025)])
    _write_csv(sd, ["county", "region", "year", "new_completions", "estimated_demand", "supply_deficit",
                    "supply_ratio", "supply_deficit_pct"],
               [(c, r, y, 400 + 100 * i, 1000, 600 - 100 * i, (400 + 100 * i) / 1000, 60.0 - 10 * i)
                for i, (c, r) in enumerate(PLACES) for y in range(2020, 2025)])
    out = os.path.join(tmpdir_path, "out")
    assert main(["run", "--transactions", tx, "--affordability", aff, "--supply", sd, "--out", out]) == 0
    written = sorted(os.path.basename(p) for p in glob.glob(os.path.join(out, "*")))
    assert "market_pulse" in written and "investment_scorecard" in written and "register_cleaning" not in written
    assert len(written) == 60
    pulse = spark.read.option("header", True).csv(os.path.join(out, "market_pulse"))
    assert pulse.count() == 20
    heat = spark.read.option("header", True).csv(os.path.join(out, "heat_index")).collect()
    assert sorted(r.county for r in heat) == sorted(c for c, _ in PLACES)


def test_cli_load_registers(spark, tmpdir_path):
    from brickyard.sources.register import read_transactions
    reg = os.path.join(tmpdir_path, "ppr")
    os.makedirs(reg)
    head = "Date of Sale (dd/mm/yyyy),Address,County,Eircode,Price (€),Not Full Market Price,VAT Exclusive," \
           "Description of Property\n"
    rows = ['05/03/2021,1 Main St,Co. Cork,,"€250,000.00",No,No,Second-Hand Dwelling house /Apartment\n',
            '06/03/2021,2 Main St,Dublin 8,D08 X1,"€410,000.00",No,Yes,New Dwelling house /Apartment\n',
            '07/03/2021,3 Main St,Kerry,,"€300,000.00",Yes,No,Second-Hand Dwelling house /Apartment\n']
    with open(os.path.join(reg, "PPR-2021.csv"), "wb") as f:
        f.write((head + "".join(rows)).encode("cp1252"))
    out = os.path.join(tmpdir_path, "clean")
    assert main(["load", "--register", reg, "--years", "2020-2022", "--out", out]) == 0
    got = sorted((r.county, r.region, r.price_eur, r.vat_exclusive) for r in read_transactions(spark, out).collect())
    assert got == [("Cork", "Munster", 250000.0, False), ("Dublin", "Leinster", 410000.0, True)]


def test_cli_sync_and_run_from_the_store(spark, tmpdir_path):
    from brickyard.sources.store import Store
    reg, store, out = (os.path.join(tmpdir_path, x) for x in ("ppr", "store", "out"))
    os.makedirs(reg)
    aff, sd = os.path.join(tmpdir_path, "aff.csv"), os.path.join(tmpdir_path, "sd.csv")
    head = ["Date of Sale (dd/mm/yyyy)", "County", "Price", "VAT Exclusive", "Description of Property"]
    for y in range(2020, 2025):
        _write_csv(os.path.join(reg, f"PPR-{y}.csv"), head, [(d.strftime("%d/%m/%Y"), c, f"{p:,.2f}", "Yes" if new else "No", t) for d, c, _, p, t, _, new, yy, *_ in _sales() if yy == y])
    _write_csv(aff, ["county", "region", "year", "median_price", "avg_annual_wage", "years_salary_to_buy", "monthly_rent_estimate", "price_to_income_ratio", "population"],
               [(c, r, y, 200000, 40000, 5.0, 900, 5.0, 100000) for c, r in PLACES for y in range(2020, 2025)])
    _write_csv(sd, ["county", "region", "year", "new_completions", "estimated_demand", "supply_deficit", "supply_ratio", "supply_deficit_pct"],
               [(c, r, y, 400, 1000, 600, 0.4, 60.0) for c, r in PLACES for y in range(2020, 2025)])
    sync = ["sync", "--register", reg, "--affordability", aff, "--supply", sd, "--store", store]
    assert main(sync) == 0 and main(sync) == 0
    assert Store(spark, store, None).versions() == [1]
    assert main(["run", "--store", store, "--out", out, "--jobs", "market_pulse,heat_index,load_profile,segment_premium"]) == 0
    pulse = spark.read.option("header", True).csv(os.path.join(out, "market_pulse"))
    assert pulse.count() == 20 and sum(int(r.transaction_count) for r in pulse.collect()) == len(_sales())
    assert spark.read.option("header", True).csv(os.path.join(out, "load_profile")).first().years == "2020,2021,2022,2023,2024"
