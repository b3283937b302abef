"""Export rows, totals rows and writers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import csv_guard, currency_code
from tallyspark.operators.reports import money_sum
from tallyspark.session import materialize
from tallyspark.sources import one_file

SUMS = {"Vatable Sales": "subtotal", "VAT-Exempt Sales": "vat_exempt_sales", "Zero-Rated Sales": "zero_rated_sales", "VAT": "tax_amount", "Withholding Tax": "withholding_tax", "Total Amount Due": "total_amount"}
TEXTS = {"Customer": "customer_name", "Plate #": "plate_number", "Filename": "original_filename", "Category": "category", "Currency": "currency"}
COLUMNS = ("ID", "Invoice #", "Vendor", "Customer", "Plate #", "Invoice Date", "Date Uploaded", "Filename", "Category", *list(SUMS)[:-1], "Total Amount Due", "Currency")


def _or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))


def _cell(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("double")


def export_rows(rows: DataFrame) -> DataFrame:
    """The 16 columns of an export; missing money is 0, but a missing total stays empty."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    cells = {"ID": F.col("id").cast("string"), "Invoice #": F.col("invoice_number"), "Vendor": F.col("vendor_name"), "Invoice Date": _or_dash(day("invoice_date")), "Date Uploaded": _or_dash(F.coalesce(day("date_uploaded"), day("created_at")))}
    cells |= {k: _or_dash(F.col(c)) for k, c in TEXTS.items()} | {k: F.coalesce(_cell(rows, c), F.lit(0.0)) for k, c in SUMS.items()}
    cells["Total Amount Due"] = _cell(rows, "total_amount")
    return rows.select(*[cells[c].alias(c) for c in COLUMNS])


def export_totals(rows: DataFrame) -> DataFrame:
    """A totals row for each currency in order; one of zeros where there is no row."""
    sums = [money_sum(_cell(rows, c)).alias(k) for k, c in SUMS.items()]
    by = rows.groupBy(currency_code(F.col("currency")).alias("Currency")).agg(*sums)
    none = rows.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("").alias("Currency"), *[F.lit(0.0).alias(k) for k in SUMS])
    blank = {c: F.lit("") for c in COLUMNS} | {"ID": F.lit("TOTAL"), "Currency": F.col("Currency")} | {k: F.col(f"`{k}`") for k in SUMS}
    return by.unionByName(none).select(*[blank[c].alias(c) for c in COLUMNS])


def with_totals(rows: DataFrame) -> DataFrame:
    """Details and then totals, in an order that survives the union. The rows are computed once and written down, as three parts read them."""
    names = {"id", "invoice_number", "vendor_name", "invoice_date", "date_uploaded", "created_at", *TEXTS.values(), *SUMS.values()}
    rows = materialize(rows.select(*[c for c in rows.columns if c in names]), "export")
    body = export_rows(rows).withColumns({"part": F.lit(0), "key": F.col("id").cast("long")})
    return body.unionByName(export_totals(rows).withColumns({"part": F.lit(1), "key": F.lit(None).cast("long")})).orderBy("part", "key", "Currency").drop("part", "key")


def log_rows(logs: DataFrame, zone: str = "UTC") -> DataFrame:
    """Log export with cells that no spreadsheet runs."""
    at = F.date_format(F.from_utc_timestamp(F.col("created_at").cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss")
    texts = {"User": "user", "Action": "action", "Type": "entity_type", "Details": "details"}
    return logs.select(at.alias("Date & Time"), *[csv_guard(F.coalesce(F.col(c), F.lit("-"))).alias(k) for k, c in texts.items()], F.col("entity_id").alias("Entity ID"))


def row_text(df: DataFrame) -> Column:
    """A row's cells as one text that any engine writes alike: numbers with six decimals, days as ISO, nothing as a mark of its own."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float") or kind.startswith("decimal"):
            return F.coalesce(c.cast("decimal(30,6)").cast("string"), F.lit("∅"))
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else c.cast("string"), F.lit("∅"))

    return F.concat_ws("|", *[cell(n, k) for n, k in df.dtypes])


def signature(rows: DataFrame) -> DataFrame:
    """One row: a digest of what is in a selection, whatever its order or layout; nothing has a digest too.

    Each row is digested; four parts of the digests are summed, which combines before the shuffle.
    """
    each = rows.select(F.sha2(row_text(rows), 256).alias("d"))
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("d", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return each.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[part(k) for k in range(4)]), 256).alias("signature"))


def file_name(prefix: str, ending: str, now: datetime) -> str:
    return f"{prefix}_{now:%Y%m%d_%H%M%S}.{ending.lstrip('.')}"


def write(rows: DataFrame, path: str, kind: str = "csv", **options: str) -> None:
    """Write an export: csv and xlsx as the one file that a person will open, put together from the tasks' parts; json and parquet as a folder."""
    if kind in ("csv", "xlsx"):
        source = one_file.CsvFile if kind == "csv" else one_file.Sheets
        rows.sparkSession.dataSource.register(source)
        rows.write.format(source.name()).options(**options).mode("append").save(path)
    elif kind in ("json", "parquet"):
        rows.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"unknown export kind {kind!r}")


def uploads(spark, folder: str, endings: tuple[str, ...] = ("png", "jpg", "jpeg", "tiff", "bmp", "pdf"), most: int = 15 << 20) -> DataFrame:
    """Files that may be taken in: known endings, bounded size, each with its digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = files.filter((F.col("length") <= most) & F.lower("path").rlike(rf"\.({'|'.join(endings)})$"))
    return kept.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))
