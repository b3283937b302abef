"""A rule cuts a text into lines once for a row, however often it looks at them."""

import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import documents, evidence, identity, layout, ownership, quality

RULES = {
    "retail_table": lambda df, t, n: df.select(ownership.retail_table(t, n)),
    "charge_rows": lambda df, t, n: df.select(ownership.charge_rows(t)),
    "seller_address": lambda df, t, n: df.select(ownership.seller_address(t, t, t)),
    "plan_row": lambda df, t, n: df.select(ownership.plan_row(t)),
    "retail_summary": lambda df, t, n: ownership.retail_summary(df.withColumns({c: n for c in ("subtotal", "tax_amount", "discount", "total_amount")})),
    "vendor_of_page": lambda df, t, n: df.select(ownership.vendor_of_page(t, t)),
    "credit_balance": lambda df, t, n: df.select(ownership.credit_balance(n, n, n, t)),
    "unused_form": lambda df, t, n: df.select(ownership.unused_form(t)),
    "joined_price": lambda df, t, n: df.select(ownership.joined_price(F.array(F.struct(t.alias("description"), n.alias("quantity"), n.alias("unit_price"), n.alias("amount"))), n, t)),
    "document_date": lambda df, t, n: documents.invoice_date(df.withColumn("invoice_date", t)),
}


@pytest.mark.parametrize("name", RULES)
def test_lines_are_cut_once(spark, name):
    df = RULES[name](spark.range(1).selectExpr("CAST(id AS string) AS text"), F.col("text"), F.lit(5.0))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # one cut for the lines, others for the head of the page, where a name is looked for
    assert 1 <= plan.count("split(") <= 4, plan.count("split(")


def test_a_line_is_spelled_out_once(spark):
    lines = spark.sql("SELECT id AS page, id AS n, CAST(id AS string) AS text, 0D AS x1, 0D AS y1, 9D AS x2, 9D AS y2 FROM range(1)")
    plan = layout.financial_evidence(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9%]+") <= 8, plan.count("[^a-z0-9%]+")


def test_a_ledger_is_looked_for_once(spark):
    rows = spark.range(1).selectExpr("CAST(id AS string) AS text", "1D AS previous_balance")
    plan = layout.points_are_no_balance(rows, F.col("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9%]+") == 1


def read_once(df, most_exchanges):
    """A plan that scans its lines once, and deals them so many times at most."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Range (") == 1 and plan.count("Exchange ") <= most_exchanges


LINE = "id AS page, id AS n, CAST(id AS string) AS text, 0D AS x1, 0D AS y1, 9D AS x2, 9D AS y2, 0.9D AS confidence"


def test_a_bill_is_read_once(spark):
    assert read_once(evidence.billing_rows(spark.sql(f"SELECT {LINE} FROM range(9)")), 1)


def test_a_statement_is_read_once(spark):
    lines = spark.sql(f"SELECT {LINE} FROM range(9)")
    assert read_once(layout.statement_summary(lines), 1) and read_once(layout.statement_balances(lines), 1)
    rows = spark.sql("SELECT id AS page, 1D AS subtotal, 1D AS discount, 1D AS current_charges_total, 1D AS previous_balance, 1D AS total_amount FROM VALUES (1L) AS t(id)")
    assert read_once(layout.settle_statement(rows, lines), 2)


def test_a_closed_set_is_sorted_for_no_window(spark):
    plan = evidence.closed_charges(spark.sql(f"SELECT {LINE} FROM range(9)"), ("a", "b"), "c")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange ") <= 1


def test_a_table_is_read_once(spark):
    assert read_once(evidence.table_items(spark.sql(f"SELECT {LINE} FROM range(9)")), 1)


def test_labels_are_looked_for_once(spark):
    labels = spark.createDataFrame([("a", "b", "c")], "family string, field string, label string")
    df = evidence.labelled_cells(spark.sql(f"SELECT {LINE} FROM range(9)"), labels)
    assert df._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


def test_parties_are_read_once(spark):
    rows = spark.sql("SELECT * FROM VALUES (1L, 'a name', 'b name') AS t(page, vendor_name, customer_name)")
    assert read_once(layout.settle_parties(rows, spark.sql(f"SELECT {LINE} FROM range(9)")), 2)


def test_flags_are_worked_out_once_for_all_fields(spark):
    rows = spark.sql("SELECT id, 'n' AS invoice_number, 1D + id AS subtotal, 2D + id AS tax_amount, 3D + id AS total_amount, array('x') AS issues, 0.5D AS ocr_confidence, 'e' AS engine FROM range(1)")
    plan = quality.scored(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("0.002") <= 4, plan.count("0.002")


def test_sales_are_summed_once(spark):
    items = "array<struct<description:string,quantity:double,unit_price:double,amount:double>>"
    rows = spark.range(1).select(F.lit(None).cast(items).alias("line_items"), "id").withColumn("line_items", F.from_json(F.col("id").cast("string"), items))
    plan = rows.select(quality.issues(rows, date(1998, 1, 1)).alias("notes"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_a_key_is_worked_out_once(spark):
    rows = spark.sql("SELECT id, CAST(id AS string) AS text FROM range(1)").select("id", scalars.content_key(F.col("text"), scalars.ascii_folded).alias("content_key"))
    plan = identity.key_groups(rows, "content_key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("sha2(") == 1, plan


def test_rows_without_a_key_are_no_group(spark):
    texts = ["x1 " * 80, ("X1, " * 80).upper(), "short 1", "short 1", None, None, "é\u2212\x00😀x1" * 80, "y " * 200, "y " * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", scalars.content_key(F.col("text"), scalars.ascii_folded).alias("content_key"))
    groups = identity.key_groups(rows, "content_key").collect()
    assert [(g["content_key"], g["first_id"], g["n"]) for g in groups] == [(hashlib.sha256(b"x1" * 80).hexdigest(), 0, 3)]
