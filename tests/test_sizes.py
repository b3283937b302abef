"""Joins that must not pair all with all, and amounts and codes that look like others."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.scalars import amount_in_text
from tallyspark.operators import documents, evidence, layout
from tallyspark.sources import page_files


def test_small_ranges_make_no_more_tasks(spark, tmp_path):
    body = "".join(f"[DOCUMENT PAGE {k}]\nwords of page {k}\n" for k in range(40_000))
    (tmp_path / "a.txt").write_text(body)
    reader = page_files.PageReader({"path": str(tmp_path), "range_bytes": "500"}, page_files.StructType.fromDDL("page long, text string"))
    parts = reader.partitions()
    assert len(parts) <= 3
    assert [r for p in parts for r in reader.read(p)] == [(k, f"words of page {k}") for k in range(40_000)]


def rows_into(df, operator):
    """Rows that the last run of a plan's joins gave out, all of them together."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if operator in kind:
            found += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_addresses_of_common_words_do_not_pair_all(spark):
    master = spark.range(300).selectExpr("lpad(CAST(id * 1001 + 1 AS string), 9, '0') AS tin", "concat('Harbor Tower Building ', 10000 + id) AS address")
    rows = spark.range(300).selectExpr("id", "concat('999', substr(lpad(CAST(id * 1001 + 1 AS string), 9, '0'), 4)) AS vendor_tax_id", "concat('Harbor Tower Building ', 10000 + id) AS vendor_address")
    out = documents.nearest_tin(rows, master, share=1.0)
    assert rows_into(out, "Join") < 20_000
    assert out.join(master.withColumn("id", F.substring_index("address", " ", -1).cast("long") - 10000), "id").filter("vendor_tax_id = tin").count() == 300


@pytest.mark.parametrize("share,found", [(0.8, True), (1.0, False)])
def test_a_missing_word_counts_against_the_share(spark, share, found):
    master = spark.createDataFrame([("123456789", "North Harbor Tower Building Quay")], "tin string, address string")
    rows = spark.createDataFrame([(1, "123456700", "harbor tower building quay")], "id long, vendor_tax_id string, vendor_address string")
    assert documents.nearest_tin(rows, master, share=share).first()["vendor_tax_id"] == ("123456789" if found else "123456700")


def test_a_key_of_all_pages_makes_no_pairs(spark):
    pages = spark.range(300).selectExpr("id AS page", "concat('Shop ', 10000 + id, '. Account No 5') AS text")
    entries = spark.range(300).selectExpr("id AS entry", "array(concat('shop ', 10000 + id), 'Account No') AS keys", "CAST(array() AS array<string>) AS exclusions")
    out = evidence.page_identities(pages, entries)
    assert rows_into(out, "Join") < 20_000
    assert sorted(tuple(r) for r in out.collect()) == [(k, k) for k in range(300)]


def test_part_of_an_amount_is_not_that_amount(spark):
    text = {"VAT 1481.01": False, "1,001.01": False, "1.015": False, "Tax 1.01": True, "P1.01.": True, "..1.01": True}
    df = spark.createDataFrame(list(text.items()), "text string, want boolean")
    assert df.filter(amount_in_text(F.col("text"), F.lit(1.01)) != F.col("want")).collect() == []


def test_a_code_that_multiplies_out_as_well(spark):
    cells = [("Widget", 0), ("4821", 150), ("3", 300), ("4,821.00", 400), ("14,463.00", 600)]
    lines = spark.createDataFrame([(1, n, t, float(x), 0.0, x + 10.0 * len(t), 20.0) for n, (t, x) in enumerate(cells)], "page long, n int, text string, x1 double, y1 double, x2 double, y2 double")
    assert layout.item_cells(lines).select("quantity", "unit_price", "amount").collect() == [(3.0, 4821.0, 14463.0)]
