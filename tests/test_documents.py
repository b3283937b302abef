from datetime import date

from pyspark.sql import functions as F

from tallyspark.operators import documents as d

TEXT = """Alpha Trading Corp.
12 Rizal Street, Makati City
TIN 123-456-789-000
OR# 021909
Transaction# ALC081-221
Date: 13-Aug-26
Permit No 7 date issued 2019-01-01
Sold To: Beta Shop
TIN 987-654-321-000
VAT-Exempt Sales 40.00
Delivery fee 25.00
7@P24.00
168.00
CASH 500.00
CHANGE 300.00"""
ITEM = "array<struct<description:string,quantity:double,unit_price:double,amount:double>>"
SCHEMA = f"id int, text string, invoice_number string, invoice_date string, vendor_name string, customer_name string, vendor_tax_id string, customer_tax_id string, subtotal double, tax_amount double, total_amount double, vat_exempt_sales double, discount double, previous_balance double, line_items {ITEM}"


def row(spark, **cells):
    base = {"id": 1, "text": TEXT, "invoice_number": "ALC081-221", "invoice_date": None, "vendor_name": "-", "customer_name": None, "vendor_tax_id": None, "customer_tax_id": None, "subtotal": 193.0, "tax_amount": 5.0, "total_amount": 200.0, "vat_exempt_sales": None, "discount": None, "previous_balance": 10.0, "line_items": [("Pen", 7.0, 24.0, 168.0)]} | cells
    return spark.createDataFrame([tuple(base.values())], SCHEMA)


def test_parties(spark):
    r = d.settle_parties(row(spark)).first()
    assert (r["vendor_name"], r["customer_name"], r["invoice_number"], r["invoice_date"]) == ("Alpha Trading Corp.", "Beta Shop", "021909", "2026-08-13")
    assert (r["vendor_tax_id"], r["customer_tax_id"], r["vat_exempt_sales"], r["discount"]) == ("123-456-789-000", "987-654-321-000", 40.0, None)
    assert len(r["notes"]) == 7
    none = d.settle_parties(row(spark, text=None, vendor_name="Kept", invoice_number="9")).first()
    assert none["vendor_name"] == "Kept" and none["invoice_number"] == "9" and not none["notes"]


def test_items(spark):
    r = d.missing_item(row(spark)).first()["line_items"]
    assert [(x["description"], x["amount"]) for x in r] == [("Pen", 168.0), ("Delivery fee", 25.0)]
    twice = d.balance_item(d.balance_item(row(spark))).first()["line_items"]
    assert [x["description"] for x in twice] == ["Pen", "Remaining Balance"]
    got = row(spark).select(d.retail_quantities(F.col("text")).alias("q"), d.amount_to_pay(F.col("text"), F.lit(None).cast("double")).alias("p")).first()
    assert [tuple(q) for q in got["q"]] == [(7.0, 24.0, 168.0)] and got["p"] == 200.0


def test_reasons_hints_and_edits(spark):
    df = row(spark, invoice_number=None, line_items=[]).withColumns({"engine": F.lit("paddle+trocr"), "ocr_confidence": F.lit(0.5)})
    assert df.select(d.second_pass(df).alias("r")).first()["r"] == ["written by hand", "the reading is uncertain", "missing invoice_number", "missing invoice_date", "missing vendor_name", "amounts do not add up", "no items were read"]
    h = row(spark).select(d.hints(F.col("text")).alias("h")).first()["h"]
    assert h == {"vendor_name": "Alpha Trading Corp.", "vendor_tax_id": "123-456-789-000"}
    maps = spark.createDataFrame([({"a": (0.9, "ok", "x"), "b": (0.8, "ok", "x")}, {"a": "1", "b": "2"}, {"a": "1", "b": "3", "category": "Food"})], f"e {d.EVIDENCE}, o map<string,string>, n map<string,string>")
    out = maps.select(d.after_edit(F.col("e"), F.col("o"), F.col("n")).alias("m")).first()["m"]
    assert out["a"]["status"] == "ok" and out["b"]["status"] == "manual_edit" and out["category"]["status"] == "derived"
    assert row(spark).select(d.dates_in(F.col("text")).alias("x")).first()["x"] == [date(2026, 8, 13)]


def test_master(spark):
    master = spark.createDataFrame([("000-360-916-00000", "Tower Building Ayala Makati"), ("111-111-111-000", "Somewhere else entirely")], "tin string, address string")
    rows = spark.createDataFrame([(1, "300-350-816-000", "Tower Building, Ayala, Makati"), (2, "999-999-999", "Tower Building Ayala Makati"), (3, "300-350-816", "Other place")], "id int, vendor_tax_id string, vendor_address string")
    assert {r["id"]: r["vendor_tax_id"] for r in d.nearest_tin(rows, master).collect()} == {1: "000-360-916-00000", 2: "999-999-999", 3: "300-350-816"}
    pair = spark.createDataFrame([("1 Rizal St, Buyer Tower, Cebu", "Buyer Tower, Cebu")], "v string, c string")
    assert pair.select(d.isolate_address(F.col("v"), F.col("c")).alias("a")).first()["a"] == "1 Rizal St"
