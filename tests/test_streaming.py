"""The incremental loader: files landing in a folder are appended exactly once."""

import os
import tempfile

from brickyard.sources.register import read_transactions
from brickyard.streaming.register_stream import REGISTER_LAYOUT, start_register_stream

HEADER = ",".join(f'"{h}"' for h in REGISTER_LAYOUT) + "\n"


def _row(date, county, price, eircode="", not_full="No", vat="No"):
    return f'"{date}","1 Main St","{county}","{eircode}","€{price}","{not_full}","{vat}",' \
           f'"Second-Hand Dwelling house /Apartment",""\n'


def _land(d, name, rows):
    with open(os.path.join(d, name), "wb") as f:
        f.write((HEADER + "".join(rows)).encode("cp1252"))


def test_stream_appends_new_files_once(spark):
    root = tempfile.mkdtemp(prefix="brickyard-stream-", dir="/tmp")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    _land(landing, "a.csv", [_row("05/03/2021", "Co. Cork", "250,000.00"), _row("06/03/2021", "Atlantis", "1")])
    q = start_register_stream(spark, landing, table, ckpt)
    q.awaitTermination(120)
    assert read_transactions(spark, table).count() == 1

    _land(landing, "b.csv", [_row("2022-01-02", "Dublin 6W", "825,000.00", "D6W XY00"),
                             _row("03/01/2022", "Mayo", "120,000.00", not_full="Yes")])
    q = start_register_stream(spark, landing, table, ckpt)          # restart from the checkpoint
    q.awaitTermination(120)
    rows = sorted((r.county, r.price_eur, r.year) for r in read_transactions(spark, table).collect())
    assert rows == [("Cork", 250000.0, 2021), ("Dublin", 825000.0, 2022)]


def test_cli_stream_once(spark):
    from brickyard.__main__ import main
    root = tempfile.mkdtemp(prefix="brickyard-stream-cli-", dir="/tmp")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    _land(landing, "a.csv", [_row("05/03/2021", "Co. Cork", "250,000.00")])
    assert main(["stream", "--landing", landing, "--out", table, "--checkpoint-location", ckpt]) == 0
    assert [r.county for r in read_transactions(spark, table).collect()] == ["Cork"]


def test_another_column_order_fails_before_anything_is_written(spark):
    import pytest
    root = tempfile.mkdtemp(prefix="brickyard-stream-order-", dir="/tmp")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    _land(landing, "a.csv", [_row("05/03/2021", "Co. Cork", "250,000.00")])
    swapped = ["Address", "Date of Sale (dd/mm/yyyy)", *REGISTER_LAYOUT[2:]]
    with open(os.path.join(landing, "b.csv"), "wb") as f:
        f.write((",".join(f'"{h}"' for h in swapped) + '\n"1 Main St","05/03/2021","Kerry","","€1","No","No","x",""\n').encode("cp1252"))
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        start_register_stream(spark, landing, table, ckpt).awaitTermination(120)
    assert not os.path.isdir(os.path.join(table, "_spark_metadata")) or read_transactions(spark, table).count() == 0


def test_stream_keeps_quoted_line_breaks(spark):
    root = tempfile.mkdtemp(prefix="brickyard-stream-quotes-", dir="/tmp")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    _land(landing, "a.csv", ['"05/03/2021","The ""Old"" Mill,\nMain St","Cork","","€250,000.00","No","No","x",""\n', _row("06/03/2021", "Kerry", "260,000.00")])
    start_register_stream(spark, landing, table, ckpt).awaitTermination(120)
    assert sorted(r.county for r in read_transactions(spark, table).collect()) == ["Cork", "Kerry"]


def test_a_header_that_no_alias_knows_fails(spark):
    import pytest
    root = tempfile.mkdtemp(prefix="brickyard-stream-unknown-", dir="/tmp")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    swapped = ["Sale Date", "County", "Address", *REGISTER_LAYOUT[3:]]
    with open(os.path.join(landing, "a.csv"), "wb") as f:
        f.write((",".join(f'"{h}"' for h in swapped) + '\n' + '"05/03/2021","Kerry","1 Main St","","\u20ac250,000.00","No","No","x",""\n' * 3).encode("cp1252"))
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        start_register_stream(spark, landing, table, ckpt).awaitTermination(120)


def test_rejects_are_counted(spark):
    from brickyard.streaming.register_stream import rejects
    root = tempfile.mkdtemp(prefix="brickyard-stream-rejects-", dir="/tmp")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    _land(landing, "a.csv", [_row("05/03/2021", "Co. Cork", "250,000.00"), _row("31/02/2021", "Kerry", "250,000.00"), _row("06/03/2021", "Atlantis", "250,000.00"), "broken\n"])
    _land(landing, "b.csv", [_row("05/03/2021", "Cork", "n/a"), _row("05/03/2021", "Cork", "260,000.00", not_full="Yes")])
    q = start_register_stream(spark, landing, table, ckpt)
    q.awaitTermination(120)
    assert dict(rejects(q)) == {"records": 6, "kept": 1, "unreadable date": 1, "unknown place": 1, "unreadable price": 1, "not a full-market sale": 1, "malformed record": 1}
    assert read_transactions(spark, table).count() == 1


def test_files_in_utf8_need_that_layout(spark):
    root = tempfile.mkdtemp(prefix="brickyard-stream-utf8-", dir="/tmp")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    with open(os.path.join(landing, "a.csv"), "wb") as f:
        f.write((HEADER + _row("05/03/2021", "Co. Cork", "250,000.00")).encode("utf-8"))
    start_register_stream(spark, landing, table, ckpt, encoding="utf-8").awaitTermination(120)
    assert [r.county for r in read_transactions(spark, table).collect()] == ["Cork"]
