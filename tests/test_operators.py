from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyspark.functions.scalars import duplicate_key
from tallyspark.operators import identity, quality, reconcile, reports, text
from tallyspark.sources import exports
from tallyspark.streaming import audit

ITEM = "array<struct<description:string,quantity:double,unit_price:double,amount:double>>"


def test_currency_totals(spark):
    rows = spark.createDataFrame([("PHP", 120.0), ("₱", 30.0), ("USD", 400.0), (None, float("nan")), ("USD", None)], "currency string, total_amount double")
    assert {r["currency"]: r["total"] for r in reports.totals_by_currency(rows).collect()} == {"PHP": 150.0, "USD": 400.0}


def test_limit_counts_before_currency(spark):
    rows = spark.createDataFrame([(i, datetime(2026, 1, 1 + i), "USD" if i else "PHP", 1.0, "v") for i in range(5)], "id int, created_at timestamp, currency string, total_amount double, vendor_name string")
    assert reports.spend_by_vendor(rows, limit=4, currency="PHP").count() == 0
    assert reports.spend_by_vendor(rows, limit=5, currency="PHP").first()["total"] == 1.0


def test_export_totals_of_nothing(spark):
    rows = spark.createDataFrame([], "id long, invoice_number string, vendor_name string, customer_name string, plate_number string, invoice_date date, date_uploaded date, created_at timestamp, original_filename string, category string, subtotal double, tax_amount double, total_amount double, currency string")
    assert [(r["ID"], r["Total Amount Due"]) for r in exports.export_totals(rows).collect()] == [("TOTAL", 0.0)]


def test_signature_follows_content_not_layout(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id long, v string")
    a, b, c = (exports.signature(r).first()["signature"] for r in (rows, rows.repartition(5), rows.filter("id < 49")))
    assert a == b != c


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    for kind in ("csv", "json", "parquet"):
        exports.write(rows, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    with pytest.raises(ValueError):
        exports.write(rows, str(tmp_path / "x"), "doc")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"x")
    (tmp_path / "in" / "b.exe").write_bytes(b"x")
    assert exports.uploads(spark, str(tmp_path / "in")).count() == 1


def test_admission(spark):
    schema = "id long, vendor string, number string"
    keyed = lambda rows: spark.createDataFrame(rows, schema).withColumn("duplicate_key", duplicate_key(F.col("vendor"), F.col("number")))
    out = identity.admit(keyed([(1, "Alpha", "7")]), keyed([(2, " ALPHA ", "7"), (3, "Beta", "7"), (4, "beta", "7"), (5, None, "7"), (6, None, "7")]), ("duplicate_key",))
    assert sorted(r["id"] for r in out.collect()) == [3, 5, 6]


def test_page_groups(spark):
    schema = "file string, page int, printed int, of int, ids array<string>, confidence double, engine string"
    pages = [("f", 1, 1, 2, ["A"], 0.9, "x"), ("f", 2, 2, 2, ["A"], 0.8, "y"), ("f", 3, 1, 1, ["B"], 0.7, "x")]
    out = identity.page_group_summary(spark.createDataFrame(pages, schema)).orderBy("group").collect()
    assert [(r["pages"], r["confidence"], r["engine"]) for r in out] == [([1, 2], 0.8, "x+y"), ([3], 0.7, "x")]
    other = [pages[0], ("f", 2, 2, 2, ["C"], 0.8, "y"), pages[2]]
    assert identity.page_groups(spark.createDataFrame(other, schema)).agg(F.countDistinct("group")).first()[0] == 3


def test_versions(spark):
    v = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "a", False), (2, 3, "a", True)], "id int, version int, v string, deleted boolean")
    assert [(r["id"], r["v"]) for r in identity.latest(v).collect()] == [(1, "b")]
    assert [(r["id"], r["field"], r["old"], r["new"]) for r in identity.changes(v, ("v",)).collect()] == [(1, "v", "a", "b")]
    rows = spark.createDataFrame([(1, 1, "a", True), (2, 1, "a", False)], "id int, version int, v string, locked boolean")
    edits = spark.createDataFrame([(1, "z"), (2, "z")], "id int, v string")
    assert [(r["id"], r["v"], r["version"]) for r in identity.edited(rows, edits).collect()] == [(2, "z", 2)]
    assert [r["id"] for r in identity.refused(rows, edits).collect()] == [1]


def test_custom_categories(spark):
    profiles = spark.createDataFrame([("Hotel & Lodging", 1, "inn rooms suite"), ("Pets", 2, "dog")], "category string, rank int, example string")
    rows = spark.createDataFrame([(1, "Sunset Inn", ["suite for two"]), (2, "Grab", ["ride"]), (3, "Nobody", ["thing"])], "id int, vendor_name string, descriptions array<string>")
    assert {r["id"]: r["assigned"] for r in identity.custom_category(rows, profiles).collect()} == {1: "Hotel & Lodging", 2: "Transportation", 3: "Others"}


def row(spark, **cells):
    base = {"invoice_number": "A-1", "invoice_date": "2026-01-01", "due_date": None, "vendor_name": "Acme", "customer_name": "Bob", "currency": "PHP", "subtotal": 100.0, "tax_amount": 12.0, "discount": None, "total_amount": 112.0, "current_charges_total": None, "previous_balance": None, "payment_terms": None, "line_items": []} | cells
    kinds = {"line_items": ITEM} | dict.fromkeys(("subtotal", "tax_amount", "discount", "total_amount", "current_charges_total", "previous_balance"), "double")
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in base))


@pytest.mark.parametrize(
    ("cells", "note"),
    [
        ({}, None),
        ({"vendor_name": "n/a"}, "missing vendor_name"),
        ({"invoice_date": "2027-01-01"}, "the invoice date lies after today"),
        ({"invoice_date": "01/02/2026"}, "invoice_date is not a date"),
        ({"discount": -1.0, "total_amount": 113.0}, "discount is negative"),
        ({"total_amount": 112.03}, "amounts do not add up to the charges"),
        ({"total_amount": 112.02}, None),
        ({"subtotal": None}, "subtotal is missing"),
        ({"currency": "P"}, "currency is not a code"),
        ({"invoice_number": "ATP No 5"}, "invoice_number is a printer's permit"),
        ({"invoice_number": "112.00"}, "invoice_number is one of the amounts"),
        ({"invoice_number": "50,920.00"}, "invoice_number looks like an amount"),
        ({"vendor_name": "Received By:"}, "vendor_name is a form label"),
        ({"vendor_name": "DONRNTTNRN"}, "vendor_name is garbled"),
        ({"line_items": [("Pen", 2.0, 50.0, 100.0)]}, None),
        ({"line_items": [("Pen", 2.0, 40.0, 100.0)]}, "item 1: quantity * unit_price is not amount"),
        ({"line_items": [("Pen", 1.0, 50.0, 50.0), ("Ink", 1.0, 50.0, 50.0)]}, "an item equals the sum of the others"),
        ({"line_items": [("Credit", 1.0, -5.0, -5.0), ("Pen", 1.0, 105.0, 105.0)]}, None),
        ({"line_items": [("123", 1.0, 100.0, 100.0)]}, "item 1: description is a bare number"),
        ({"payment_terms": "Net 30", "due_date": "2026-01-30"}, "due date does not fit the terms"),
        ({"current_charges_total": 112.0, "previous_balance": -10.0, "total_amount": 102.0}, None),
    ],
)
def test_validation(spark, cells, note):
    df = row(spark, **cells)
    assert df.select(quality.issues(df, date(2026, 6, 1)).alias("i")).first()["i"] == ([note] if note else [])


def test_confidence(spark):
    df = row(spark, current_charges_total=112.0, previous_balance=0.0, line_items=[("Pen", 2.0, 50.0, 100.0)])
    df = df.withColumns({"issues": F.array().cast("array<string>"), "ocr_confidence": F.lit(0.9), "engine": F.lit("paddle")})
    r = quality.scored(df).first()
    assert r["confidence"] == 1.0 and not r["needs_review"]
    by = {f["field"]: f["confidence"] for f in r["field_confidences"]}
    assert by["total_amount"] == round(min(1.0, 0.66 + 0.18 + 0.06 + 0.07 + 0.04), 3) and by["customer_address"] == 0.0
    worse = quality.scored(df.withColumns({"issues": F.array(F.lit("subtotal is wrong")), "engine": F.lit("trocr"), "total_amount": F.lit(500.0)})).first()
    assert worse["needs_review"] and worse["confidence"] == round(0.52 + 0.18 + 0.18 + 0.07 - 0.10 + 0.03 - 0.15 - 0.25, 3)


RECEIPT = "ACME STORE\nPlate No: abc 1234\nPen 2 50.00 100.00\nVatable Sales 100.00\nVAT (12%)\n12.00\nTOTAL AMOUNT DUE 112.00\nCASH 200.00\nCHANGE 88.00"


def test_text_rules(spark):
    lines = text.lines_of(spark.createDataFrame([(1, RECEIPT), (2, "no amounts"), (3, None)], "id int, text string"))
    assert [tuple(r) for r in text.find_tax(lines).collect()] == [(1, 12.0, 12.0)]
    assert [(r["description"], r["quantity"], r["amount"]) for r in text.table_rows(lines).collect()] == [("Pen", 2.0, 100.0)]
    assert [(r["id"], r["value"]) for r in text.repeated_values(lines).collect()] == [(1, 100.0)]
    stacked = text.lines_of(spark.createDataFrame([(1, "Blue pen\n2\n50.00\n100.00\nend")], "id int, text string"))
    assert text.stacked_rows(stacked).first()["amount"] == 100.0


def test_reconcile(spark):
    df = row(spark, tax_amount=0.0, subtotal=None, total_amount=200.0, invoice_number="O00012").withColumns({"text": F.lit(RECEIPT), "plate_number": F.lit(None).cast("string")})
    r = reconcile.reconcile(df).first()
    assert (r["subtotal"], r["tax_amount"], r["total_amount"], r["plate_number"], r["invoice_number"]) == (100.0, 12.0, 112.0, "ABC 1234", "000012")
    swap = row(spark, subtotal=112.0, total_amount=100.0).withColumns({"text": F.lit("a 112.00 b 100.00"), "plate_number": F.lit("x")})
    assert tuple(reconcile.swapped(swap).select("subtotal", "total_amount").first()) == (100.0, 112.0)
    hurt = row(spark, subtotal=100.0, tax_amount=99.0).withColumn("text", F.lit("100.00 12.00 112.00 0.00"))
    assert tuple(reconcile.weakest_amount(hurt).first()["repair"]) == ("tax_amount", 12.0)


def test_geometry(spark):
    at = lambda page, word, x, y: (page, word, [[x, y], [x + 50.0, y], [x + 50.0, y + 10.0], [x, y + 10.0]])
    words = text.boxes(spark.createDataFrame([at(1, "TOTAL", 0.0, 0.0), at(1, "112.00", 100.0, 1.0), at(1, "9.00", 200.0, 0.0), at(2, "TOTAL", 0.0, 0.0), at(2, "other", 60.0, 0.0), at(2, "5.00", 120.0, 0.0), at(1, "7.00", 100.0, 40.0)], "page long, word string, bbox array<array<double>>"))
    assert [(r["page"], r["value"]) for r in text.right_of_label(words, "^TOTAL$").collect()] == [(1, 112.0)]
    assert {r["page"]: r["height"] for r in text.median_height(words).collect()} == {1: 10.0, 2: 10.0}
    cells = spark.createDataFrame([(1, "A", 0.0, True), (1, "B", 10.0, True), (1, "1", 9.0, False), (1, "2", 2.0, False)], "page long, word string, y double, is_label boolean")
    assert sorted((r["label"], r["cell"]) for r in text.match_cells(cells).collect()) == [("A", "2"), ("B", "1")]
    names = spark.createDataFrame([("ACME STORE", "ACME STORES")], "a string, b string")
    assert names.select(text.similarity(F.col("a"), F.col("b"))).first()[0] > 0.9


def test_streams(spark, tmp_path):
    logs = spark.createDataFrame([(datetime(2026, 1, 1, 5), "EDIT"), (datetime(2026, 1, 1, 6), "EDIT"), (datetime(2026, 1, 9), "EDIT")], "created_at timestamp, action string")
    logs.write.parquet(str(tmp_path / "logs"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs"))
    q = audit.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("daily").collect()) == [1, 2]


def test_entry(spark):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 90
    assert __spark_entry__.entry(spark).count() > 0
