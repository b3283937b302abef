"""Every query over records, page layout and document rules against its SQL, on the smallest tables; and the writers round trip."""

import os
from datetime import datetime

import duckdb
import pytest

from tallyspark import queries, queries_records, queries_rules
from tallyspark.operators import records

SF = os.environ.get("TALLYSPARK_TEST_DATA", "/root/testdata") + "/sf0.001"
NAMES = sorted(n for n, f in queries.ALL.items() if f.__module__ in (queries_records.__name__, queries_rules.__name__))


def plain(rows, columns):
    def cell(v):
        return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else list(v) if isinstance(v, list) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    got = queries.ALL[name](spark, SF)
    want = db.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_log_and_archive_only_grow(spark, tmp_path):
    changes = spark.createDataFrame([(1, 2, "name", "a", None), (1, 2, "amount", None, "5")], "id long, version long, field string, old string, new string")
    for day in (1, 2):
        records.append_log(records.edit_log(changes, "ines", datetime(1998, 1, day)), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log")).orderBy("created_at").collect()
    assert [r["details"] for r in log] == ["amount: — → 5; name: a → —"] * 2 and [r["created_at"].day for r in log] == [1, 2]
    rows = spark.createDataFrame([(1, "A/1", "1998-01-05"), (2, None, "1998-02-05")], "id long, invoice_number string, invoice_date string").withColumn("invoice_date", records.F.to_date("invoice_date"))
    records.archive(rows, str(tmp_path / "archive"))
    records.archive(rows.filter("id = 2").withColumn("invoice_number", records.F.lit("B")), str(tmp_path / "archive"))
    assert sorted(r["name"] for r in spark.read.json(str(tmp_path / "archive")).collect()) == ["invoice_A_1_1.json", "invoice_B_2.json"]
    records.write_trace(records.trace(rows, rows.withColumn("invoice_number", records.F.lit("B")), "s", ("invoice_number",)), str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace")).count() == 2


def test_unreadable_master(spark, tmp_path):
    (tmp_path / "m.json").write_text("{broken")
    assert records.party_master(spark, str(tmp_path / "m.json")).count() == 0
