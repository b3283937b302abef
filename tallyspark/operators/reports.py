"""Scans, spend reports and totals. Amounts are summed as decimals, so order never shows; currencies are never mixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import blank, currency_code

MONEY = "decimal(18,2)"
MONTH = "^[0-9]{4}-(0[1-9]|1[0-2])$"


def money_sum(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(F.coalesce(c, F.lit(0.0)).cast(MONEY)).cast("double")


def newest(rows: DataFrame, limit: int | None = 100, offset: int = 0, status: str | None = None) -> DataFrame:
    """Newest first, ids breaking ties; a page of them."""
    if status:
        rows = rows.filter(F.col("status") == status)
    rows = rows.orderBy(F.desc("created_at"), F.desc("id"))
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def by_number(rows: DataFrame, number: str | None) -> DataFrame:
    """The first row of that document number; a blank number finds nothing."""
    number = (number or "").strip()
    return rows.filter(F.col("invoice_number") == number).orderBy("id").limit(1) if number else rows.limit(0)


def uploaded_on() -> Column:
    return F.coalesce("date_uploaded", F.col("created_at").cast("date"))


def spend(rows: DataFrame, key: Column, name: str, limit: int | None = 500, currency: str | None = None) -> DataFrame:
    """Total per key over the newest rows; the limit counts rows of every currency."""
    latest = rows if limit is None else newest(rows, limit)
    if currency:
        latest = latest.filter(currency_code(F.col("currency")) == currency)
    return latest.groupBy(key.alias(name)).agg(money_sum("total_amount").alias("total"))


def spend_by_vendor(rows: DataFrame, limit: int | None = 500, currency: str | None = None) -> DataFrame:
    return spend(rows, F.col("vendor_name"), "vendor_name", limit, currency).orderBy(F.desc("total"), "vendor_name")


def spend_by_category(rows: DataFrame, limit: int | None = 500, currency: str | None = None) -> DataFrame:
    return spend(rows, F.when(blank(F.col("category")) == "", "Others").otherwise(F.col("category")), "category", limit, currency).orderBy(F.desc("total"), "category")


def spend_by_month(rows: DataFrame, basis: str = "invoice", limit: int | None = 500, currency: str | None = None) -> DataFrame:
    day = F.col("invoice_date") if basis == "invoice" else uploaded_on()
    out = spend(rows, F.date_format(day, "yyyy-MM"), "month", limit, currency)
    return out.filter(F.col("month").rlike(MONTH)).orderBy("month")


def status_breakdown(rows: DataFrame, limit: int | None = 500) -> DataFrame:
    latest = rows if limit is None else newest(rows, limit)
    return latest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def totals_by_currency(rows: DataFrame) -> DataFrame:
    amount = F.col("total_amount")
    finite = rows.filter(amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf")))
    return finite.groupBy(currency_code(F.col("currency")).alias("currency")).agg(money_sum("total_amount").alias("total")).orderBy("currency")


def stats(rows: DataFrame) -> DataFrame:
    """One row: documents, distinct vendors, those that need review."""
    return rows.agg(F.count(F.lit(1)).alias("invoices"), F.countDistinct("vendor_id").alias("vendors"), F.count_if(F.col("status") == "needs_review").alias("needs_review"))


def chart(rows: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Total per combination of Vendor, Category and upload Month, and per currency."""
    parts = {"Vendor": F.col("vendor_name"), "Category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Others")), "Month": F.date_format(uploaded_on(), "yyyy-MM")}
    label = F.concat_ws(" / ", *[parts[d] for d in dimensions])
    return rows.groupBy(label.alias("label"), currency_code(F.col("currency")).alias("currency")).agg(money_sum("total_amount").alias("total")).orderBy(F.desc("total"), "label", "currency")


def flags(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("locked").alias("locked_count"), F.every(F.col("locked")).alias("all_locked"), F.some(F.col("total_amount").isNull()).alias("any_missing_total"))


def month_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce(F.date_format(uploaded_on(), "yyyy-MM"), F.lit("Unknown date")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def month_pool(rows: DataFrame, month: str) -> DataFrame:
    return rows.filter(F.date_format(uploaded_on(), "yyyy-MM") == month)


def facet(rows: DataFrame, column: str, most: int = 100, missing: str | None = None) -> DataFrame:
    """Distinct values for a filter list. Missing currencies are offered as PHP, unlike in totals."""
    c = F.coalesce(F.col(column), F.lit(missing)) if missing else F.col(column)
    return rows.select(c.alias("value")).filter("value is not null and value <> ''").distinct().orderBy("value").limit(most)


def facet_filter(rows: DataFrame, **chosen: list) -> DataFrame:
    """Exact, case-sensitive membership per facet; an empty list does not filter."""
    columns = {"category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Others")), "invoice_month": F.date_format("invoice_date", "yyyy-MM"), "upload_month": F.date_format(uploaded_on(), "yyyy-MM")} if chosen else {}
    for name, values in chosen.items():
        if values:
            rows = rows.filter((columns[name] if name in columns else F.col(name)).isin(*values))
    return rows


def log_filter(logs: DataFrame, users: list | None = None, actions: list | None = None, types: list | None = None, months: list | None = None, entity: str = "") -> DataFrame:
    for column, values in ((F.col("user"), users), (F.col("action"), actions), (F.col("entity_type"), types), (F.date_format("created_at", "yyyy-MM"), months)):
        if values:
            logs = logs.filter(column.isin(*values))
    return logs.filter(F.contains(F.col("entity_id").cast("string"), F.lit(entity.strip()))) if entity.strip() else logs


def local_time(logs: DataFrame, zone: str) -> DataFrame:
    """Audit times, kept in UTC, as the viewer's clock shows them."""
    return logs.withColumn("local_time", F.from_utc_timestamp(F.col("created_at").cast("timestamp"), zone))
