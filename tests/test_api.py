import pytest

from tallyspark import api

ROWS = [(1, "A", "2030-01-05 10:00:00", "paid", False), (2, "B", "2030-01-06 10:00:00", "paid", True), (3, "C", "2030-01-06 10:00:00", "failed", None)]


@pytest.fixture
def rows(spark):
    df = spark.createDataFrame(ROWS, "id long, vendor_name string, created_at string, status string, locked boolean")
    f = api.F
    more = {c: f.lit(None).cast("string") for c in ("invoice_number", "customer_name", "original_filename", "plate_number", "category", "currency")}
    return df.withColumns(more | {"created_at": f.col("created_at").cast("timestamp"), "invoice_date": f.lit(None).cast("date"), "date_uploaded": f.lit(None).cast("date"), "total_amount": f.lit(5.0)})


def test_calls(rows, tmp_path):
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(api.list_invoices(rows)) == [3, 2, 1] and ids(api.list_invoices(rows, 1, "paid")) == [2]
    assert ids(api.search_invoices(rows, "b")) == [2] and ids(api.get_invoice(rows, 3)) == [3]
    assert sorted(ids(api.delete_invoice(rows, 1))) == [2, 3] and sorted(ids(api.delete_invoice(rows, 3))) == [1, 2]
    api.export_invoices(rows, str(tmp_path / "out"), "csv", "paid")
    assert any((tmp_path / "out").glob("part-*.csv"))


def test_errors(rows, tmp_path):
    with pytest.raises(LookupError):
        api.get_invoice(rows, 9)
    with pytest.raises(LookupError):
        api.delete_invoice(rows, 9)
    with pytest.raises(api.Locked):
        api.delete_invoice(rows, 2)
    with pytest.raises(ValueError):
        api.search_invoices(rows, " ")
    with pytest.raises(LookupError):
        api.export_invoices(rows, str(tmp_path / "x"), "csv", "pending")
    with pytest.raises(ValueError):
        api.export_invoices(rows, str(tmp_path / "x"), "odt")
