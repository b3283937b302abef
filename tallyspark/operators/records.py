"""Stored records and what is shown of them: previews, visibility, archive, audit log, repairs, migrations, party master.

Everything is a column or a DataFrame; nothing is brought to the driver.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalars import blank, is_missing, safe_component
from tallyspark.operators.quality import Cells, cents

# ---- fixed values -----------------------------------------------------------------------------
INTERNAL = ("current_charges_total", "customer_contact", "due_date", "payment_terms", "previous_balance", "tax_rate")
SHOWN = {
    "Vendor": "vendor_name",
    "Vendor Address": "vendor_address",
    "Vendor TIN": "vendor_tax_id",
    "Customer": "customer_name",
    "Customer Address": "customer_address",
    "Customer TIN": "customer_tax_id",
    "Plate #": "plate_number",
    "Invoice #": "invoice_number",
    "Invoice Date": "invoice_date",
    "Date Uploaded": "date_uploaded",
    "Category": "category",
}
#: Shown only where there is something to show.
OPTIONAL = ("customer_address", "customer_name", "customer_tax_id", "plate_number")
NOTHING = ("", "-", "—")
#: Edits that stored an untouched zero as nothing, as the log words them.
LOST_ZEROS = {
    "discount": "Discount (internal): 0.00 → —",
    "withholding_tax": "Withholding Tax: 0.00 → —",
    "zero_rated_sales": "Zero-Rated Sales: 0.00 → —",
    "vat_exempt_sales": "VAT-Exempt Sales: 0.00 → —",
}
#: Columns that older tables lack.
ADDED = {"plate_number": "string", "vendor_address": "string", "vendor_tax_id": "string", "customer_address": "string", "customer_contact": "string", "customer_tax_id": "string", "raw_text": "string", "vision_notes": "string", "enhanced_image_path": "string", "duplicate_key": "string", "content_key": "string", "validation_issues": "string", "field_confidences": "string", "field_evidence": "string", "date_uploaded": "date", "withholding_tax": "double", "zero_rated_sales": "double", "vat_exempt_sales": "double", "current_charges_total": "double", "previous_balance": "double"}
RETAIL_SIGNS = {"WATSONS": 2, "WATSONS PERSONAL CARE STORES": 2, "SALES INVOICE NO": 1, "VAT REG TIN": 1, "TOTAL DISCOUNTS": 1, "AMOUNT TO PAY": 1}
RETAIL_FROM = 3
PARTY = "name string, tin string, address string"
# -----------------------------------------------------------------------------------------------


def _day(c: Column, otherwise: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.date_format(otherwise, "yyyy-MM-dd"))


def preview(rows: DataFrame) -> DataFrame:
    """The eight cells of a report's preview."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    total = F.trim(F.concat(F.format_number(F.coalesce("total_amount", F.lit(0.0)), 2), F.lit(" "), blank(F.col("currency"))))
    cells = {"ID": F.col("id"), "Invoice #": F.col("invoice_number"), "Vendor": F.col("vendor_name"), "Invoice Date": dash(F.date_format("invoice_date", "yyyy-MM-dd")), "Date Uploaded": dash(_day(F.col("date_uploaded"), F.col("created_at")))}
    cells |= {"Category": dash(F.col("category")), "Total Amount Due": total, "Locked": F.when(F.col("locked"), "Yes").otherwise("No")}
    return rows.select(*[c.alias(k) for k, c in cells.items()])


def shown_fields(df: DataFrame) -> Column:
    """(label, field, value) of what an invoice's page shows, in order; optional fields only where they are filled."""
    c = Cells(df)

    def entry(label: str, name: str) -> Column:
        raw = _day(c("date_uploaded"), c("created_at")) if name == "date_uploaded" else c(name).cast("string")
        value = F.trim(blank(raw))
        row = F.struct(F.lit(label).alias("label"), F.lit(name).alias("field"), F.coalesce(F.nullif(value, F.lit("")), F.lit("-")).alias("value"))
        return F.when(~value.isin(*NOTHING), row) if name in OPTIONAL else row

    return F.array_compact(F.array(*[entry(k, n) for k, n in SHOWN.items()]))


def title(df: DataFrame) -> Column:
    """A page's heading: the file's name, else the number, else the id."""
    c = Cells(df)
    text = lambda n: F.nullif(F.trim(blank(c(n).cast("string"))), F.lit(""))
    return F.coalesce(text("original_filename"), F.concat(F.lit("Invoice "), text("invoice_number")), F.concat(F.lit("Invoice ID "), F.coalesce(c("id").cast("string"), F.lit("unknown"))))


def shown_notes(notes: Column) -> Column:
    """Notes whose first word is no internal field."""
    return F.filter(notes, lambda n: ~F.regexp_extract(n, "^\\s*([^\\s:]*)", 1).isin(*INTERNAL))


def shown_evidence(evidence: Column) -> Column:
    """An evidence map without internal fields; what is stored stays as it is."""
    return F.map_filter(evidence, lambda k, _: ~F.substring_index(k, ".", 1).isin(*INTERNAL))


def archive_rows(rows: DataFrame) -> DataFrame:
    """id, month, name and JSON body of the archive's file for each invoice."""
    name = F.concat(F.lit("invoice_"), safe_component(F.coalesce("invoice_number", F.lit("unknown"))), F.lit("_"), F.col("id").cast("string"), F.lit(".json"))
    return rows.select("id", F.coalesce(F.date_format("invoice_date", "yyyy-MM"), F.lit("undated")).alias("month"), name.alias("name"), F.to_json(F.struct(*rows.columns)).alias("body"))


def archive(rows: DataFrame, folder: str) -> None:
    """Write the archive as JSON lines by month; a month is rewritten whole, others are left."""
    archive_rows(rows).write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(folder)


def trace(before: DataFrame, after: DataFrame, stage: str, fields: tuple[str, ...]) -> DataFrame:
    """id, stage, field, before and after of each field that a stage changed."""
    cell = lambda t, f: F.col(f"{t}.{f}").cast("string")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), cell("b", f).alias("before"), cell("a", f).alias("after")) for f in fields])
    both = before.alias("b").join(after.alias("a"), F.col("a.id") == F.col("b.id")).select(F.col("a.id").alias("id"), F.explode(pairs).alias("x"))
    return both.filter(~F.col("x.before").eqNullSafe(F.col("x.after"))).select("id", F.lit(stage).alias("stage"), "x.field", "x.before", "x.after")


def write_trace(rows: DataFrame, folder: str) -> None:
    rows.write.partitionBy("stage").mode("append").json(folder)


def names_in_order(rows: DataFrame, column: str) -> DataFrame:
    """Distinct names of a small list, in order."""
    return rows.select(F.col(column).alias("name")).filter("name is not null").distinct().orderBy("name")


def party_master(spark: SparkSession, path: str) -> DataFrame:
    """kind, rank, name, tin, address of the parties in a JSON file of vendors and customers; an unreadable file has none."""
    kind = f"array<struct<{PARTY.replace(' string', ':string')}>>"
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", f"vendors {kind}, customers {kind}").alias("m"))
    one = lambda name, column: lists.select(F.lit(name).alias("kind"), F.posexplode(f"m.{column}").alias("rank", "p"))
    return one("vendor", "vendors").union(one("customer", "customers")).select("kind", "rank", "p.*").filter("name is not null")


def edit_log(changes: DataFrame, user: str, at: datetime) -> DataFrame:
    """An audit row for each changed version, from rows (id, version, field, old, new)."""
    word = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    said = F.concat(F.col("field"), F.lit(": "), word("old"), F.lit(" → "), word("new"))
    details = F.array_join(F.sort_array(F.collect_list(said)), "; ")
    rows = changes.groupBy("id", "version").agg(details.alias("details"))
    return rows.select(F.lit(at).cast("timestamp").alias("created_at"), F.lit(user).alias("user"), F.lit("EDIT").alias("action"), F.lit("invoice").alias("entity_type"), F.col("id").alias("entity_id"), "version", "details")


def append_log(rows: DataFrame, folder: str) -> None:
    """The log only grows; a day is a folder."""
    rows.withColumn("day", F.to_date("created_at")).write.partitionBy("day").mode("append").parquet(folder)


def restore_zeros(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """Zeros that an edit stored as nothing, where the log proves that; other gaps stay."""
    edits = logs.filter("action = 'EDIT' and entity_type = 'invoice' and entity_id is not null")
    found = [F.max(F.contains("details", F.lit(mark))).alias(f"__{f}") for f, mark in LOST_ZEROS.items()]
    seen = edits.filter(F.contains("details", F.lit(": 0.00 → —"))).groupBy(F.col("entity_id").alias("__id")).agg(*found)
    out = rows.join(seen, F.col("id") == F.col("__id"), "left")
    fixed = {f: F.when(F.col(f).isNull() & F.col(f"__{f}"), 0.0).otherwise(F.col(f)) for f in LOST_ZEROS if f in rows.columns}
    return out.withColumns(fixed).select(*rows.columns)


def migrate(rows: DataFrame) -> DataFrame:
    """Columns that an older table lacks; upload dates from creation times; names in capitals."""
    out = rows.withColumns({c: F.lit(None).cast(t) for c, t in ADDED.items() if c not in rows.columns})
    filled = {"date_uploaded": F.coalesce("date_uploaded", F.to_date("created_at"))} if "created_at" in out.columns else {}
    return out.withColumns(filled | {c: F.upper(F.trim(F.col(c))) for c in ("vendor_name", "customer_name") if c in out.columns})


def template(text: Column) -> Column:
    """A layout that is known by several signs together, else generic."""
    page = F.upper(blank(text))
    signs = sum((F.when(F.contains(page, F.lit(sign)), n).otherwise(0) for sign, n in RETAIL_SIGNS.items()), F.lit(0))
    return F.when(signs >= RETAIL_FROM, "watsons").otherwise("generic")


def totals_hold(df: DataFrame, share: float = 0.02) -> Column:
    """The stored model's own check: within a share of the target, so a target that is not above 0 never passes."""
    c = Cells(df)
    plus = [c.number("subtotal"), *(c.or_zero(f) for f in ("tax_amount", "zero_rated_sales", "vat_exempt_sales"))]
    minus = [c.or_zero(f) for f in ("discount", "withholding_tax")]
    computed = sum((cents(x) for x in plus[1:]), cents(plus[0])) - sum((cents(x) for x in minus[1:]), cents(minus[0]))
    target = cents(F.coalesce(c.number("current_charges_total"), c.number("total_amount")))
    known = c.number("subtotal").isNotNull() & c.number("total_amount").isNotNull()
    return F.coalesce(known & (target != 0) & (F.abs(computed - target) <= F.lit(str(share)).cast("decimal(4,2)") * target), F.lit(False))


def tidy_address(c: Column) -> Column:
    """One space, no doubled commas or stops, none at the ends."""
    out = F.regexp_replace(blank(c), "\\s+", " ")
    out = F.regexp_replace(F.regexp_replace(out, "\\s+,", ","), ",(?:\\s*,)+", ",")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\\.{2,}", "."), "^[\\s,]+|[\\s,]+$", ""))


def tidy_name(c: Column) -> Column:
    """A space behind an initial that a name is run together with."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(c), "\\b([A-Z]\\.)(?=[A-Z][a-zA-Z]{2,})", "$1 "), "\\s+", " "))


def decoded(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Stored JSON texts as values of a type; nothing, or what does not read, is an empty array or map."""
    empty = lambda t: F.array() if t.startswith("array") else F.create_map()
    return rows.withColumns({c: F.coalesce(F.from_json(F.col(c), t), empty(t).cast(t)) for c, t in columns.items()})


def not_normal(df: DataFrame) -> Column:
    """What of a raw record is no date or no number, before anything is coerced."""
    c = Cells(df)
    raw = lambda f: F.trim(blank(c(f).cast("string")))
    plain = lambda f: F.regexp_replace(raw(f), "[₱$,\\s]|(?i)php", "")
    out = [(~is_missing(raw(f)) & ~raw(f).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), f"{f} is not a date") for f in ("invoice_date", "due_date")]
    money = ("subtotal", "tax_amount", "total_amount", "discount", "withholding_tax", "current_charges_total", "previous_balance")
    out += [(~is_missing(raw(f)) & ~plain(f).rlike("^\\(?-?[0-9]+(\\.[0-9]+)?\\)?-?$"), f"{f} is not a number") for f in money]
    notes = F.array_compact(F.array(*[F.when(rule, note) for rule, note in out]))
    if "line_items" not in c.types:
        return notes
    cell = lambda x, i, f: F.when(x[f].try_cast("double").isNull(), F.concat(F.lit("item "), (i + 1).cast("string"), F.lit(f": {f} is not a number")))
    rows = F.transform(F.coalesce("line_items", F.array().cast(c.types["line_items"])), lambda x, i: F.array_compact(F.array(*[cell(x, i, f) for f in ("quantity", "unit_price", "amount")])))
    return F.concat(notes, F.flatten(rows))
