"""Registered queries over the invoice model, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as s
from tallyspark.operators import documents, identity, quality, reconcile, reports, text
from tallyspark.plans import language, search
from tallyspark.session import read_table
from tallyspark.sources import exports, model

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}
SQL: dict[str, str] = {}
HEADS = ("id", "invoice_number", "total_amount")
TODAY = date(1998, 1, 1)


def query(name: str, sql: str | None = None):
    """Register a query; sql follows the model's common table expressions."""

    def add(f: Query) -> Query:
        ALL[name] = f
        if sql:
            SQL[name] = f"{model.MODEL_SQL} {sql}"
        return f

    return add


def _search(name: str, family: str, cond: dict, where: str, items: bool = False) -> None:
    plan = {family: [cond]}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = model.heads(spark, sf_dir)
        if items:
            rows = rows.join(model.line_items(spark, sf_dir), F.col("id") == F.col("invoice_id"), "left")
        return search.search(rows, plan).select(*HEADS)

    source = "(SELECT h.*, line_items FROM heads h LEFT JOIN nested ON id = invoice_id)" if items else "heads"
    query(name, f"SELECT {', '.join(HEADS)} FROM {source} WHERE {where}")(run)


def _c(field: str, operator: str, value=None, value2=None, values=None) -> dict:
    return {k: v for k, v in {"field": field, "operator": operator, "value": value, "value2": value2, "values": values}.items() if v is not None}


_number = "lower(coalesce(invoice_number, ''))"
_file = "lower(original_filename)"
_day = "DATE '1997-03-05'"
_search("text_contains", "text", _c("original_filename", "contains", "a%B"), f"contains({_file}, 'a%b')")
_search("text_contains_any", "text", _c("customer_name", "contains_any", values=["00012", "00007"]), "contains(lower(customer_name), '00012') OR contains(lower(customer_name), '00007')")
_search("text_equals", "text", _c("invoice_number", "equals", "inv-00000101"), f"{_number} = 'inv-00000101'")
_search("text_not_contains_null", "text", _c("invoice_number", "not_contains", "1"), f"NOT contains({_number}, '1')")
_search("text_not_equals_null", "text", _c("invoice_number", "not_equals", "INV-00000101"), f"{_number} <> 'inv-00000101'")
_search("text_starts_with", "text", _c("original_filename", "starts_with", "scan_1"), f"starts_with({_file}, 'scan_1')")
_search("text_ends_with", "text", _c("original_filename", "ends_with", ".PNG"), f"ends_with({_file}, '.png')")
_search("line_items_text", "text", _c("line_items", "contains", "Grocery 10.0 "), "len(list_filter(line_items, lambda x: contains(lower(x.description), 'grocery') AND x.quantity = 10)) > 0", items=True)
for _op, _sign in (("on", "="), ("before", "<"), ("on_or_before", "<="), ("after", ">"), ("on_or_after", ">=")):
    _search(f"date_{_op}", "dates", _c("invoice_date", _op, "1997-03-05"), f"invoice_date {_sign} {_day}")
_search("date_between", "dates", _c("due_date", "between", "1997-03-05", "1996-03-05"), f"due_date BETWEEN DATE '1996-03-05' AND {_day}")
_search("upload_date_fallback", "dates", _c("date_uploaded", "between", "1997-01-01", "1997-01-31"), "coalesce(date_uploaded, CAST(created_at AS date)) BETWEEN DATE '1997-01-01' AND DATE '1997-01-31'")
for _name, _sign in (("eq", "="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _search(f"num_{_name}", "numbers", _c("id" if _name == "eq" else "total_amount", _sign, 101 if _name == "eq" else 250_000), f"{'id' if _name == 'eq' else 'total_amount'} {_sign} {101 if _name == 'eq' else 250000}")
_search("num_between", "numbers", _c("total_amount", "between", 1000, 50_000), "total_amount BETWEEN 1000 AND 50000")
_search("choice_in", "choices", _c("currency", "in", values=["php", "₱"]), "lower(coalesce(currency, '')) IN ('php', '₱')")
_search("choice_not_in_null", "choices", _c("category", "not_in", values=["FOOD", "Insurance"]), "lower(coalesce(category, '')) NOT IN ('food', 'insurance')")
_search("bool_locked", "booleans", {"field": "locked", "value": False}, "NOT coalesce(locked, false)")
_gone = "(plate_number IS NULL OR lower(trim(plate_number)) IN ('', '-', '—', '–', '0', '0.0', '0.00', 'n/a', 'na', 'none', 'null'))"
_search("presence_present", "presence", _c("plate_number", "present"), f"NOT {_gone}")
_search("presence_missing", "presence", _c("plate_number", "missing"), _gone)
_search("presence_numeric_zero", "presence", _c("total_amount", "present"), "total_amount IS NOT NULL")


@query("num_ne_null", "SELECT id, current_charges_total FROM invoices WHERE current_charges_total <> 0")
def num_ne_null(spark, d):
    return search.search(model.invoices(spark, d), {"numbers": [_c("current_charges_total", "!=", 0)]}).select("id", "current_charges_total")


PLAN = {"choices": [_c("status", "in", values=["needs_review", "processed"]), _c("currency", "in", values=["PHP"])], "numbers": [_c("total_amount", ">", 5000)], "dates": [_c("invoice_date", "between", "1997-01-01", "1997-03-31")]}
_plan_sql = "status IN ('needs_review', 'processed') AND currency = 'PHP' AND total_amount > 5000 AND invoice_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'"


@query("plan_conjunction", f"SELECT id, status, total_amount FROM heads WHERE {_plan_sql}")
def plan_conjunction(spark, d):
    return search.search(model.heads(spark, d), PLAN).select("id", "status", "total_amount")


@query("flagship", f"SELECT vendor_name, CAST(sum(CAST(total_amount AS decimal(18,2))) AS double) AS total FROM invoices WHERE {_plan_sql} GROUP BY 1")
def flagship(spark, d):
    """Needs-review or processed invoices in PHP above 5 000 of a quarter, by vendor."""
    rows = search.search(model.heads(spark, d), PLAN).select("id", "total_amount")
    # amounts need the lines of the selected invoices only
    lines = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey").join(rows.select("id"), "id", "left_semi")
    vendor = lines.groupBy("id").agg(F.min("l_suppkey").alias("s_suppkey")).join(read_table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    named = rows.join(vendor, "id", "left").withColumn("vendor_name", F.coalesce("s_name", F.lit("UNKNOWN VENDOR")))
    return reports.spend(named, F.col("vendor_name"), "vendor_name", limit=None)


@query("nl_flagship", f"SELECT id, total_amount FROM heads WHERE {_plan_sql.replace(' needs_review', '')}".replace("status IN ('needs_review', 'processed')", "status = 'processed'"))
def nl_flagship(spark, d):
    plan = language.parse("show processed invoices from January to March 1997 above PHP 5,000", page="history", today=TODAY)
    return search.search(model.heads(spark, d), plan).select("id", "total_amount")


@query("keyword_search", "SELECT id FROM invoices WHERE contains(lower(coalesce(invoice_number, '')), '0012') OR contains(lower(vendor_name), '0012') OR contains(lower(customer_name), '0012') OR contains(lower(original_filename), '0012')")
def keyword_search(spark, d):
    return search.keyword(model.invoices(spark, d), " 0012 ", identity=s.ascii_identity).select("id")


@query("api_keyword_search", "SELECT id, created_at FROM invoices WHERE contains(lower(coalesce(invoice_number, '')), '77') OR contains(lower(vendor_name), '77') OR contains(lower(customer_name), '77')")
def api_keyword_search(spark, d):
    rows = search.keyword(model.invoices(spark, d), "77", ("invoice_number", "vendor_name", "customer_name"), s.ascii_identity)
    return reports.newest(rows, None).select("id", "created_at")


@query("scan_newest_page", "SELECT id, created_at FROM heads ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 40")
def scan_newest_page(spark, d):
    return reports.newest(model.heads(spark, d), 100, 40).select("id", "created_at")


@query("filter_status", "SELECT id FROM heads WHERE status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 250")
def filter_status(spark, d):
    return reports.newest(model.heads(spark, d), 250, status="pending").select("id")


@query("point_lookup", "SELECT id, invoice_number FROM heads WHERE invoice_number = 'INV-00000042'")
def point_lookup(spark, d):
    return reports.by_number(model.heads(spark, d), " INV-00000042 ").select("id", "invoice_number")


@query("facet_distinct_vendors", "SELECT DISTINCT vendor_name AS value FROM invoices ORDER BY 1 LIMIT 100")
def facet_distinct_vendors(spark, d):
    return reports.facet(model.invoices(spark, d), "vendor_name")


@query("facet_currencies", "SELECT DISTINCT coalesce(currency, 'PHP') AS value FROM heads")
def facet_currencies(spark, d):
    return reports.facet(model.heads(spark, d), "currency", missing="PHP")


@query("facet_filters", "SELECT id FROM heads WHERE status IN ('processed') AND (category IS NULL OR category = '' OR category = 'Food') AND strftime(invoice_date, '%Y-%m') IN ('1996-05', '1997-05')")
def facet_filters(spark, d):
    return reports.facet_filter(model.heads(spark, d), status=["processed"], category=["Others", "Food"], invoice_month=["1996-05", "1997-05"]).select("id")


_up = "coalesce(date_uploaded, CAST(created_at AS date))"


@query("facet_months", f"SELECT strftime({_up}, '%Y-%m') AS month, count(*) AS n FROM heads GROUP BY 1")
def facet_months(spark, d):
    return reports.month_counts(model.heads(spark, d))


@query("month_pool", f"SELECT id FROM heads WHERE strftime({_up}, '%Y-%m') = '1997-06'")
def month_pool(spark, d):
    return reports.month_pool(model.heads(spark, d), "1997-06").select("id")


_sum = "CAST(sum(CAST(total_amount AS decimal(18,2))) AS double) AS total"
_code = "CASE WHEN currency IN ('PHP', '₱', 'P') THEN 'PHP' WHEN currency IN ('USD', 'EUR') THEN currency ELSE 'UNSPECIFIED' END"
_latest = "(SELECT * FROM invoices ORDER BY created_at DESC, id DESC LIMIT 500)"


@query("spend_by_vendor_500", f"SELECT vendor_name, {_sum} FROM {_latest} WHERE {_code} = 'PHP' GROUP BY 1")
def spend_by_vendor_500(spark, d):
    return reports.spend_by_vendor(model.invoices_of(spark, d, reports.newest(model.heads(spark, d), 500)), currency="PHP")


@query("spend_by_vendor_all", f"SELECT vendor_name, {_sum} FROM invoices GROUP BY 1")
def spend_by_vendor_all(spark, d):
    return reports.spend_by_vendor(model.invoices(spark, d), limit=None)


@query("spend_by_month_invoice", f"SELECT strftime(invoice_date, '%Y-%m') AS month, {_sum} FROM heads WHERE {_code} = 'USD' GROUP BY 1")
def spend_by_month_invoice(spark, d):
    return reports.spend_by_month(model.heads(spark, d), limit=None, currency="USD")


@query("spend_by_month_upload", f"SELECT strftime({_up}, '%Y-%m') AS month, {_sum} FROM heads GROUP BY 1")
def spend_by_month_upload(spark, d):
    return reports.spend_by_month(model.heads(spark, d), basis="uploaded", limit=None)


@query("spend_by_category", f"SELECT CASE WHEN coalesce(category, '') = '' THEN 'Others' ELSE category END AS category, {_sum} FROM heads GROUP BY 1")
def spend_by_category(spark, d):
    return reports.spend_by_category(model.heads(spark, d), limit=None)


@query("status_breakdown", "SELECT status, count(*) AS n FROM heads GROUP BY 1")
def status_breakdown(spark, d):
    return reports.status_breakdown(model.heads(spark, d), limit=None)


@query("totals_by_currency", f"SELECT {_code} AS currency, {_sum} FROM heads GROUP BY 1")
def totals_by_currency(spark, d):
    return reports.totals_by_currency(model.heads(spark, d))


@query("dashboard_stats", "SELECT count(*) AS invoices, count(DISTINCT vendor_id) AS vendors, count(*) FILTER (WHERE status = 'needs_review') AS needs_review FROM invoices")
def dashboard_stats(spark, d):
    return reports.stats(model.invoices(spark, d))


@query("chart_vendor_category", f"SELECT vendor_name || ' / ' || CASE WHEN coalesce(category, '') = '' THEN 'Others' ELSE category END AS label, {_code} AS currency, {_sum} FROM invoices GROUP BY 1, 2")
def chart_vendor_category(spark, d):
    return reports.chart(model.invoices(spark, d), ("Vendor", "Category"))


@query("chart_month", f"SELECT strftime({_up}, '%Y-%m') AS label, {_code} AS currency, {_sum} FROM heads GROUP BY 1, 2")
def chart_month(spark, d):
    return reports.chart(model.heads(spark, d).withColumn("vendor_name", F.lit(None).cast("string")), ("Month",))


@query("top15_vendors", f"SELECT vendor_name, {_sum} FROM invoices GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top15_vendors(spark, d):
    return reports.spend_by_vendor(model.invoices(spark, d), limit=None).limit(15)


@query("row_flags", "SELECT count(*) FILTER (WHERE locked) AS locked_count, bool_and(locked) AS all_locked, bool_or(total_amount IS NULL) AS any_missing_total FROM heads")
def row_flags(spark, d):
    return reports.flags(model.heads(spark, d))


_export = f"""SELECT CAST(id AS varchar) AS "ID", invoice_number AS "Invoice #", vendor_name AS "Vendor", customer_name AS "Customer", coalesce(plate_number, '-') AS "Plate #",
    strftime(invoice_date, '%Y-%m-%d') AS "Invoice Date", strftime({_up}, '%Y-%m-%d') AS "Date Uploaded", original_filename AS "Filename",
    CASE WHEN coalesce(category, '') = '' THEN '-' ELSE category END AS "Category", coalesce(subtotal, 0) AS "Vatable Sales", 0.0::double AS "VAT-Exempt Sales", 0.0::double AS "Zero-Rated Sales",
    coalesce(tax_amount, 0) AS "VAT", 0.0::double AS "Withholding Tax", total_amount AS "Total Amount Due", coalesce(currency, '-') AS "Currency" FROM invoices"""
_dec = "CAST(sum(CAST(coalesce({}, 0) AS decimal(18,2))) AS double)"
_totals = f"""SELECT 'TOTAL' AS "ID", '' AS "Invoice #", '' AS "Vendor", '' AS "Customer", '' AS "Plate #", '' AS "Invoice Date", '' AS "Date Uploaded", '' AS "Filename", '' AS "Category",
    {_dec.format("subtotal")} AS "Vatable Sales", 0.0::double AS "VAT-Exempt Sales", 0.0::double AS "Zero-Rated Sales", {_dec.format("tax_amount")} AS "VAT", 0.0::double AS "Withholding Tax",
    {_dec.format("total_amount")} AS "Total Amount Due", {_code} AS "Currency" FROM invoices GROUP BY {_code}"""


@query("export_rows", _export)
def export_rows(spark, d):
    return exports.export_rows(model.invoices(spark, d))


@query("export_totals", _totals)
def export_totals(spark, d):
    return exports.export_totals(model.invoices(spark, d))


@query("export_with_totals", f"{_export} UNION ALL {_totals}")
def export_with_totals(spark, d):
    return exports.with_totals(model.invoices(spark, d))


_row_text = "id || '|' || coalesce(invoice_number, '∅') || '|' || coalesce(CAST(CAST(total_amount AS decimal(30,6)) AS varchar), '∅') || '|' || coalesce(strftime(invoice_date, '%Y-%m-%d'), '∅')"
_parts = " || ':' || ".join(f"coalesce(sum(CAST(CAST('0x' || substr(d, {15 * k + 1}, 15) AS bigint) AS hugeint)), 0)" for k in range(4))


@query("report_signature", f"SELECT k, (SELECT sha256(count(*) || ':' || {_parts}) FROM (SELECT sha256({_row_text}) AS d FROM heads WHERE k = 0 AND id % 3 = 0 OR k = 1 AND id = 5)) AS signature FROM (VALUES (0), (1), (2)) v(k)")
def report_signature(spark, d):
    """Of many rows, of one, and of none."""
    rows = model.heads(spark, d).select("id", "invoice_number", "total_amount", "invoice_date")
    parts = [exports.signature(rows.filter(w)).select(F.lit(k).alias("k"), "signature") for k, w in enumerate(("id % 3 = 0", "id = 5", "id < 0"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("log_newest", 'SELECT id, "user", action FROM audit_logs ORDER BY created_at DESC, id DESC LIMIT 2000')
def log_newest(spark, d):
    return reports.newest(model.audit_logs(spark, d), 2000).select("id", "user", "action")


@query("log_filters", "SELECT id FROM audit_logs WHERE action IN ('EDIT', 'LOCK') AND strftime(created_at, '%Y-%m') = '2024-01' AND contains(CAST(entity_id AS varchar), '7')")
def log_filters(spark, d):
    return reports.log_filter(model.audit_logs(spark, d), actions=["EDIT", "LOCK"], months=["2024-01"], entity="7").select("id")


@query("log_search_plan", "SELECT id FROM audit_logs WHERE lower(\"user\") = 'user_7' AND CAST(created_at AS date) BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' AND entity_id >= 20")
def log_search_plan(spark, d):
    plan = {"text": [_c("user", "equals", "USER_7")], "dates": [_c("date_time", "between", "2024-01-05", "2024-01-15")], "numbers": [_c("entity_id", ">=", 20)]}
    return search.search(model.audit_logs(spark, d).withColumnRenamed("created_at", "date_time"), plan, "log").select("id")


@query("log_local_time", "SELECT id, strftime(created_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM audit_logs")
def log_local_time(spark, d):
    return reports.local_time(model.audit_logs(spark, d), "Asia/Manila").select("id", F.date_format("local_time", "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("csv_injection_guard", "SELECT id, CASE WHEN id % 3 = 0 THEN '''=cmd(' || id ELSE 'ok' || id END AS cell FROM audit_logs")
def csv_injection_guard(spark, d):
    cell = F.concat(F.when(F.col("id") % 3 == 0, "=cmd(").otherwise("ok"), F.col("id").cast("string"))
    return model.audit_logs(spark, d).select("id", s.csv_guard(cell).alias("cell"))


@query("vendor_normalize", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9_ ]', '', 'g') AS key FROM supplier")
def vendor_normalize(spark, d):
    return read_table(spark, d, "supplier").select("s_suppkey", s.vendor_key(F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " Corp.").otherwise(", Inc"))).alias("key"))


@query("vendor_dimension", "SELECT regexp_replace(lower(vendor_name), '[^a-z0-9_ ]', '', 'g') AS normalized_name, min(vendor_name) AS name, count(*) AS n FROM invoices GROUP BY 1")
def vendor_dimension(spark, d):
    return identity.vendor_dimension(model.invoices(spark, d))


_dup = "(SELECT id, customer_name AS vendor, 'N' || (id % 400) AS number FROM heads)"


def _keyed(spark, d):
    rows = model.heads(spark, d).select("id", "status", F.col("customer_name").alias("vendor"), F.concat(F.lit("N"), (F.col("id") % 400).cast("string")).alias("number"))
    return rows.withColumn("duplicate_key", s.duplicate_key(F.col("vendor"), F.col("number"), s.ascii_identity))


@query("duplicate_key_groups", f"SELECT min(id) AS first_id, count(*) AS n FROM {_dup} GROUP BY vendor, number HAVING count(*) > 1")
def duplicate_key_groups(spark, d):
    return identity.key_groups(_keyed(spark, d), "duplicate_key").select("first_id", "n")


@query("first_seen_dedup", f"SELECT min(id) AS id FROM {_dup} GROUP BY vendor, number")
def first_seen_dedup(spark, d):
    return identity.first_seen(_keyed(spark, d), "duplicate_key").select("id")


@query("backfill_keys", f"SELECT id, id > first AS late FROM (SELECT id, min(id) OVER (PARTITION BY vendor, number) AS first FROM {_dup})")
def backfill_keys(spark, d):
    return identity.backfill(_keyed(spark, d), "duplicate_key").select("id", F.col("duplicate_key").isNull().alias("late"))


@query("duplicate_anti_join", f"SELECT min(id) AS id FROM {_dup} b WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM {_dup} a WHERE a.id % 2 = 0 AND a.vendor = b.vendor AND a.number = b.number) GROUP BY vendor, number")
def duplicate_anti_join(spark, d):
    rows = _keyed(spark, d)
    return identity.admit(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ("duplicate_key",)).select("id")


_content = "regexp_replace(lower(text), '[^a-z0-9.+-]', '', 'g')"


@query("content_key_groups", f"SELECT min(doc_id) AS first_id, count(*) AS n FROM documents WHERE length({_content}) >= 120 AND regexp_matches({_content}, '[0-9]') GROUP BY {_content} HAVING count(*) > 1")
def content_key_groups(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), s.content_key(F.col("text"), s.ascii_folded).alias("content_key"))
    return identity.key_groups(docs, "content_key").select("first_id", "n")


@query("semi_join_ids", "SELECT id FROM heads WHERE id IN (SELECT entity_id FROM audit_logs WHERE action = 'LOCK')")
def semi_join_ids(spark, d):
    ids = model.audit_logs(spark, d).filter("action = 'LOCK'").select(F.col("entity_id").alias("id"))
    return model.heads(spark, d).join(ids, "id", "left_semi").select("id")


@query("line_item_rollup", "SELECT id, len(line_items) AS n, line_items[1].description AS first_item, CAST(list_sum(list_transform(line_items, lambda x: CAST(x.amount AS decimal(18,2)))) AS double) AS amount FROM heads JOIN nested ON id = invoice_id")
def line_item_rollup(spark, d):
    rows = model.heads(spark, d).join(model.line_items(spark, d), F.col("id") == F.col("invoice_id"))
    total = F.aggregate("line_items", F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x["amount"].cast("decimal(18,2)")).cast("decimal(18,2)"))
    return rows.select("id", F.size("line_items").cast("long").alias("n"), F.col("line_items")[0]["description"].alias("first_item"), total.cast("double").alias("amount"))


@query("line_item_dedup", "SELECT invoice_id AS id, regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g') AS item, max(amount) AS amount FROM lines GROUP BY 1, 2")
def line_item_dedup(spark, d):
    items = model.lines(spark, d).select(F.col("invoice_id").alias("id"), "line", "description", "amount", *[F.lit(None).cast("double").alias(c) for c in ("subtotal", "tax_amount", "total_amount")])
    return identity.dedupe_items(items).select("id", F.lower("description").alias("item"), "amount")


@query("currency_normalize", f"SELECT id, {_code} AS code FROM heads")
def currency_normalize(spark, d):
    return model.heads(spark, d).select("id", s.currency_code(F.col("currency")).alias("code"))


@query("to_float", "SELECT id, CASE id % 6 WHEN 0 THEN -total_amount WHEN 1 THEN -total_amount WHEN 5 THEN NULL ELSE total_amount END AS amount FROM heads WHERE total_amount >= 1")
def to_float(spark, d):
    shown, i = F.format_number("total_amount", 2), F.col("id")
    swap = F.translate(shown, ",.", ".,")
    printed = F.when(i % 6 == 0, F.concat(F.lit("("), shown, F.lit(")"))).when(i % 6 == 1, F.concat(shown, F.lit("-"))).when(i % 6 == 2, F.concat(F.lit("₱ "), shown))
    printed = printed.when(i % 6 == 3, swap).when(i % 6 == 4, shown).otherwise(F.concat(shown, F.lit(".9.9")).substr(F.lit(1), F.lit(40)))
    printed = F.when(i % 6 == 5, F.concat(F.replace(shown, F.lit(","), F.lit("")), F.lit(".9"))).otherwise(printed)
    return model.heads(spark, d).filter("total_amount >= 1").select("id", s.to_float(printed).alias("amount"))


@query("parse_date", "SELECT id, invoice_date AS day FROM heads")
def parse_date(spark, d):
    i, day = F.col("id"), F.col("invoice_date")
    out = F.date_format(day, "yyyy-MM-dd")
    for k, p in enumerate(("d/M/yyyy", "d MMM yyyy", "MMMM d, yyyy", "dd-MMM-yyyy", "ddMMMyyyy", "d.M.yyyy", "yyyy/MM/dd"), 1):
        out = F.when(i % 8 == k, F.date_format(day, p)).otherwise(out)
    return model.heads(spark, d).select("id", s.parse_date(out).alias("day"))


@query("tin_normalize", "SELECT id, CASE WHEN vendor_tax_id IS NULL THEN NULL ELSE substr(vendor_tax_id, 1, 3) || '-' || substr(vendor_tax_id, 4, 3) || '-' || substr(vendor_tax_id, 7, 3) END AS tin FROM invoices")
def tin_normalize(spark, d):
    return model.invoices(spark, d).select("id", s.normalize_tin(F.concat(F.lit("VAT Reg "), "vendor_tax_id")).alias("tin"))


_hay = "lower(array_to_string(list_transform(line_items, lambda x: x.description), ' '))"
_auto = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({_hay}, '{w}')''' for w in ws)} THEN '{k}'" for k, ws in (("Food", ["grocery"]), ("Furnitures", ["desk"]), ("Office Supplies", ["bond paper"]), ("Transportation", ["fuel"]), ("Insurance", ["insurance"]))) + " ELSE 'Others' END"


def _described(spark, d):
    items = model.line_items(spark, d)
    return items.select(F.col("invoice_id").alias("id"), F.lit("SUPPLIER").alias("vendor_name"), F.transform("line_items", lambda x: x["description"]).alias("descriptions"))


@query("auto_categorize", f"SELECT invoice_id AS id, {_auto} AS category FROM nested")
def auto_categorize(spark, d):
    return _described(spark, d).select("id", s.auto_category(F.col("vendor_name"), F.col("descriptions")).alias("category"))


@query("custom_categorize", f"SELECT invoice_id AS id, CASE WHEN {_auto} <> 'Others' THEN {_auto} WHEN contains({_hay}, 'misc') THEN 'Sundry' ELSE 'Others' END AS assigned FROM nested")
def custom_categorize(spark, d):
    profiles = spark.createDataFrame([("Sundry", 1, "misc things"), ("Gadgets", 2, "camera")], "category string, rank int, example string")
    return identity.custom_category(_described(spark, d), profiles).select("id", "assigned")


@query("validate_totals", "SELECT id, abs(CAST(subtotal AS decimal(18,4)) + CAST(tax_amount AS decimal(18,4)) - CAST(discount AS decimal(18,4)) - CAST(coalesce(current_charges_total, total_amount) AS decimal(18,4))) > 0.02 AS broken FROM invoices WHERE subtotal IS NOT NULL")
def validate_totals(spark, d):
    rows = model.invoices(spark, d).filter("subtotal is not null")
    return rows.select("id", F.array_contains(quality.issues(rows, TODAY), "amounts do not add up to the charges").alias("broken"))


@query("billing_identity", "SELECT id, true AS charges, CASE WHEN previous_balance IS NULL THEN NULL ELSE true END AS bill FROM invoices WHERE current_charges_total IS NOT NULL")
def billing_identity(spark, d):
    rows = model.invoices(spark, d).filter("current_charges_total is not null")
    charges, bill = quality.consistency(rows)
    return rows.select("id", charges.alias("charges"), bill.alias("bill"))


@query("item_arith", "SELECT invoice_id AS id, bool_and(abs(quantity * unit_price - amount) <= greatest(0.05, abs(amount) * 0.01)) AS consistent FROM lines GROUP BY 1")
def item_arith(spark, d):
    return model.line_items(spark, d).select(F.col("invoice_id").alias("id"), quality.items_consistent(F.col("line_items")).alias("consistent"))


@query("item_equals_sum_of_others", "SELECT invoice_id AS id, count(*) >= 2 AND count(*) FILTER (WHERE c > 0 AND t - c > 0 AND abs(t - c - c) < 0.01) > 0 AS suspect FROM (SELECT invoice_id, CAST(amount AS decimal(18,4)) AS c, sum(CAST(amount AS decimal(18,4))) OVER (PARTITION BY invoice_id) AS t FROM lines) GROUP BY 1")
def item_equals_sum_of_others(spark, d):
    rows = model.line_items(spark, d).withColumnRenamed("invoice_id", "id")
    return rows.select("id", F.array_contains(quality.issues(rows, TODAY), "an item equals the sum of the others").alias("suspect"))


@query("validation_issues", """SELECT id, list_filter([CASE WHEN invoice_number IS NULL THEN 'missing invoice_number' END, CASE WHEN vendor_name = 'UNKNOWN VENDOR' THEN 'missing vendor_name' END, CASE WHEN currency IS NULL THEN 'missing currency' END,
    CASE WHEN invoice_date > DATE '1998-01-01' THEN 'the invoice date lies after today' END,
    CASE WHEN tax_amount > total_amount THEN 'there is more tax than total' END,
    CASE WHEN abs(CAST(subtotal AS decimal(18,4)) + CAST(tax_amount AS decimal(18,4)) - CAST(discount AS decimal(18,4)) - CAST(coalesce(current_charges_total, total_amount) AS decimal(18,4))) > 0.02 THEN 'amounts do not add up to the charges' END,
    CASE WHEN subtotal IS NULL AND total_amount > 0 THEN 'subtotal is missing' END, CASE WHEN currency IN ('₱', 'P') THEN 'currency is not a code' END,
    CASE WHEN due_date - invoice_date <> CAST(substr(payment_terms, 5) AS integer) THEN 'due date does not fit the terms' END], lambda x: x IS NOT NULL) AS issues FROM invoices""")
def validation_issues(spark, d):
    rows = model.invoices(spark, d)
    return rows.select("id", quality.issues(rows, TODAY).alias("issues"))


_fits = "abs(CAST(subtotal AS decimal(18,4)) + CAST(tax_amount AS decimal(18,4)) - CAST(discount AS decimal(18,4)) - CAST(target AS decimal(18,4)))"
_bill = "abs(CAST(current_charges_total AS decimal(18,4)) + CAST(previous_balance AS decimal(18,4)) - CAST(total_amount AS decimal(18,4)))"


@query("confidence_score", f"""SELECT id, round(least(1, greatest(0, 0.52 + 0.20 * ocr + 0.18 * present / 5 + CASE WHEN charges THEN 0.07 WHEN NOT charges THEN -0.14 ELSE 0 END + CASE WHEN bill THEN 0.03 WHEN NOT bill THEN -0.10 ELSE 0 END
        - least(0.5, 0.15 * n) - CASE WHEN id % 7 = 0 THEN 0.08 ELSE 0 END)), 3) AS confidence,
    CASE WHEN subtotal IS NULL THEN 0 ELSE round(least(1, greatest(0, (0.66 + 0.20 * ocr + CASE WHEN named THEN 0 ELSE 0.06 END + CASE WHEN charges THEN 0.07 WHEN NOT charges THEN -0.18 ELSE 0 END) * CASE WHEN named THEN 0.58 ELSE 1 END)), 3) END AS subtotal_confidence
    FROM (SELECT *, (id % 100) / 100 AS ocr, {_fits} <= greatest(0.05, abs(target) * 0.002) AS charges, CASE WHEN subtotal IS NOT NULL THEN {_bill} <= greatest(0.05, abs(total_amount) * 0.002) END AS bill,
            {_fits} > 0.02 OR subtotal IS NULL AND total_amount > 0 AS named,
            CAST(invoice_number IS NOT NULL AS integer) + 1 + CAST(vendor_name <> 'UNKNOWN VENDOR' AS integer) + 1 + CAST(currency IS NOT NULL AS integer) AS present,
            CAST(invoice_number IS NULL AS integer) + CAST(vendor_name = 'UNKNOWN VENDOR' AS integer) + CAST(currency IS NULL AS integer) + CAST(invoice_date > DATE '1998-01-01' AS integer) + CAST(coalesce(tax_amount > total_amount, false) AS integer)
            + CAST(coalesce({_fits} > 0.02, false) AS integer) + CAST(subtotal IS NULL AND total_amount > 0 AS integer) + CAST(coalesce(currency IN ('₱', 'P'), false) AS integer) + CAST(coalesce(due_date - invoice_date <> CAST(substr(payment_terms, 5) AS integer), false) AS integer) AS n
        FROM (SELECT *, coalesce(current_charges_total, total_amount) AS target FROM invoices))""")
def confidence_score(spark, d):
    """A field's score falls where a note is about it, whether the note says its name or not."""
    rows = model.invoices(spark, d)
    rows = rows.withColumns({"issues": quality.issues(rows, TODAY), "ocr_confidence": (F.col("id") % 100) / 100, "engine": F.when(F.col("id") % 7 == 0, "paddle+trocr").otherwise("paddle")})
    one = lambda f: F.filter("field_confidences", lambda x: x["field"] == f)[0]["confidence"]
    return quality.scored(rows).select("id", "confidence", one("subtotal").alias("subtotal_confidence"))


_runs = "list_max(list_transform(regexp_extract_all(text, '[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]+'), lambda x: length(x)))"


@query("consonant_run", f"SELECT doc_id, coalesce({_runs}, 0) AS run FROM documents")
def consonant_run(spark, d):
    return read_table(spark, d, "documents").select("doc_id", s.consonant_run(F.col("text")).cast("long").alias("run"))


_text_lines = "texts AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)"


@query("repeated_amounts", f"SELECT * FROM (WITH {_text_lines}, each AS (SELECT id, unnest(regexp_extract_all(line, '(?:^|[^0-9.,])([0-9]+\\.[0-9][0-9])(?:$|[^0-9%])', 1)) AS v FROM texts) SELECT id, CAST(v AS double) AS value, count(*) AS n FROM each GROUP BY 1, 2 HAVING count(*) >= 2)")
def repeated_amounts(spark, d):
    return text.repeated_values(text.lines_of(read_table(spark, d, "documents"), "doc_id"))


def _receipts(spark, d):
    """Constructed receipts, one for each invoice with sums."""
    money = lambda c: F.format_number(c, 2)
    rows = model.invoices(spark, d).filter("subtotal is not null")
    t = F.concat_ws("\n", F.lit("OFFICIAL RECEIPT"), F.concat(F.lit("Plate No: ABC 1234")), F.concat(F.lit("Widget 2 "), money(F.col("subtotal") / 2), F.lit(" "), money("subtotal")), F.concat(F.lit("Vatable Sales "), money("subtotal")), F.lit("VAT (12%)"), money("tax_amount"), F.concat(F.lit("TOTAL AMOUNT DUE "), money("total_amount")), F.lit("CASH 9,999,999.00"))
    return rows.withColumn("text", t)


@query("label_proximity", "SELECT id, subtotal AS amount FROM invoices WHERE subtotal IS NOT NULL")
def label_proximity(spark, d):
    found = text.near_label(text.lines_of(_receipts(spark, d)), reconcile.SUBTOTAL_LABELS)
    return found.select("id", F.element_at("amounts", -1).alias("amount"))


@query("tax_finder", "SELECT id, tax_amount, CAST(12 AS double) AS tax_rate FROM invoices WHERE subtotal IS NOT NULL")
def tax_finder(spark, d):
    return text.find_tax(text.lines_of(_receipts(spark, d)))


@query("table_rows", "SELECT id, 'Widget' AS description, subtotal AS amount FROM invoices WHERE subtotal IS NOT NULL")
def table_rows(spark, d):
    return text.table_rows(text.lines_of(_receipts(spark, d))).select("id", "description", "amount")


@query("reconcile_receipts", "SELECT id, tax_amount, total_amount, 'ABC 1234' AS plate_number FROM invoices WHERE subtotal IS NOT NULL AND plate_number IS NULL")
def reconcile_receipts(spark, d):
    """Invoices whose tax was lost and whose total was read off the cash line."""
    rows = _receipts(spark, d).filter("plate_number is null").withColumns({"tax_amount": F.lit(0.0), "subtotal": F.lit(None).cast("double"), "total_amount": F.lit(9999999.0)})
    return reconcile.reconcile(rows).select("id", "tax_amount", "total_amount", "plate_number")


@query("page_groups", "SELECT file, count(*) AS groups FROM (SELECT id // 5 AS file, id % 5 AS page FROM heads) WHERE page IN (0, 2, 4) GROUP BY 1")
def page_groups(spark, d):
    i = F.col("id")
    pages = model.heads(spark, d).select(F.floor(i / 5).cast("long").alias("file"), (i % 5).alias("page"), F.when(i % 5 < 4, i % 5 % 2 + 1).otherwise(1).alias("printed"), F.when(i % 5 < 4, 2).otherwise(1).alias("of"), F.array().cast("array<string>").alias("ids"), F.lit(0.9).alias("confidence"), F.lit("paddle").alias("engine"))
    # an order without its last page keeps what it has
    return identity.page_groups(pages).groupBy("file").agg(F.countDistinct("group").alias("groups"))


def _versions(spark, d):
    v = model.audit_logs(spark, d).filter("action <> 'UPLOAD'")
    return v.select(F.col("entity_id").alias("id"), F.col("id").alias("version"), F.col("user").alias("owner"), (F.col("action") == "DELETE").alias("deleted"), F.col("action"))


_v = "(SELECT entity_id AS id, id AS version, \"user\" AS owner, action = 'DELETE' AS deleted, action FROM audit_logs WHERE action <> 'UPLOAD')"


@query("latest_version", f"SELECT id, version, owner FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM {_v}) WHERE r = 1 AND NOT deleted")
def latest_version(spark, d):
    return identity.latest(_versions(spark, d)).select("id", "version", "owner")


@query("change_diff", f"SELECT id, version, f AS field, old, new FROM (SELECT id, version, lag(version) OVER w AS before, unnest([{{'f': 'owner', 'old': lag(owner) OVER w, 'new': owner}}, {{'f': 'action', 'old': lag(action) OVER w, 'new': action}}], recursive := true) FROM {_v} WINDOW w AS (PARTITION BY id ORDER BY version)) WHERE before IS NOT NULL AND old IS DISTINCT FROM new")
def change_diff(spark, d):
    return identity.changes(_versions(spark, d), ("owner", "action"))


@query("category_reassign", f"SELECT id, {_auto} AS category FROM heads JOIN nested ON id = invoice_id WHERE heads.category = 'Insurance'")
def category_reassign(spark, d):
    """Invoices of a deleted category get the category of what they say, locked or not."""
    affected = model.heads(spark, d).filter("category = 'Insurance'").select("id")
    return _described(spark, d).join(affected, "id", "left_semi").select("id", s.auto_category(F.col("vendor_name"), F.col("descriptions")).alias("category"))


@query("locked_edits", "SELECT id, CASE WHEN id % 5 = 0 THEN 'EDITED' ELSE customer_name END AS customer_name FROM heads WHERE id % 5 = 0 AND NOT locked")
def locked_edits(spark, d):
    rows = model.heads(spark, d).withColumn("version", F.lit(1))
    edits = rows.filter("id % 5 = 0").select("id", F.lit("EDITED").alias("customer_name"))
    return identity.edited(rows, edits).select("id", "customer_name")


@query("item_classes", "SELECT invoice_id AS id, line, description FROM lines")
def item_classes(spark, d):
    rows = model.lines(spark, d)
    return rows.filter(reconcile.item_class(F.col("description")).isNull()).select(F.col("invoice_id").alias("id"), "line", "description")


@query("master_by_tin", "SELECT id, vendor_name AS canonical_name FROM invoices WHERE vendor_id IS NOT NULL")
def master_by_tin(spark, d):
    master = read_table(spark, d, "supplier").select(F.lpad((F.col("s_suppkey") + 1).cast("string"), 9, "0").alias("tin"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("rank"))
    return reconcile.by_tin(model.invoices(spark, d).filter("vendor_id is not null"), master).select("id", "canonical_name")


@query("text_evidence", "SELECT id, 1.0::double AS vendor, true AS total FROM invoices WHERE subtotal IS NOT NULL")
def text_evidence(spark, d):
    rows = _receipts(spark, d)
    return rows.select("id", quality.text_support(F.lit("official receipt"), F.col("text")).alias("vendor"), quality.number_support(F.col("total_amount"), F.col("text")).alias("total"))


_gap = "abs(CAST(subtotal AS decimal(18,4)) + CAST(tax_amount AS decimal(18,4)) - CAST(discount AS decimal(18,4)) - CAST(coalesce(current_charges_total, total_amount) AS decimal(18,4)))"


@query("second_pass_reasons", f"SELECT id, list_filter([CASE WHEN invoice_number IS NULL THEN 'missing invoice_number' END, CASE WHEN vendor_name = 'UNKNOWN VENDOR' THEN 'missing vendor_name' END, CASE WHEN {_gap} > greatest(0.05, abs(coalesce(current_charges_total, total_amount)) * 0.002) THEN 'amounts do not add up' END], lambda x: x IS NOT NULL) AS reasons FROM invoices")
def second_pass_reasons(spark, d):
    rows = model.invoices(spark, d)
    return rows.select("id", documents.second_pass(rows).alias("reasons"))


@query("text_hints", "SELECT id, total_amount, subtotal, tax_amount FROM invoices WHERE subtotal IS NOT NULL")
def text_hints(spark, d):
    found = documents.hints(F.col("text"))
    return _receipts(spark, d).select("id", *[F.element_at(found, c).cast("double").alias(c) for c in ("total_amount", "subtotal", "tax_amount")])


@query("balance_items", "SELECT id, len(line_items) + CASE WHEN abs(previous_balance) > 0.005 THEN 1 ELSE 0 END AS n FROM invoices JOIN nested ON id = invoice_id")
def balance_items(spark, d):
    rows = model.invoices(spark, d).join(model.line_items(spark, d), F.col("id") == F.col("invoice_id"))
    return documents.balance_item(documents.balance_item(rows)).select("id", F.size("line_items").cast("long").alias("n"))


@query("evidence_map", "SELECT id, 'supported' AS subtotal_status, 'missing' AS number_status FROM invoices WHERE subtotal IS NOT NULL AND invoice_number IS NULL")
def evidence_map(spark, d):
    rows = _receipts(spark, d).filter("invoice_number is null")
    e = quality.field_evidence(rows, ("subtotal", "invoice_number"), F.col("text"))
    return rows.select("id", F.element_at(e, "subtotal")["status"].alias("subtotal_status"), F.element_at(e, "invoice_number")["status"].alias("number_status"))


@query("storage_defaults", "SELECT id, CASE WHEN invoice_number IS NULL THEN 'UNVERIFIED-' || substr(sha256(CAST(id AS varchar)), 1, 10) ELSE invoice_number END AS invoice_number, coalesce(tax_amount, 0) AS tax_amount FROM invoices")
def storage_defaults(spark, d):
    return quality.storage_defaults(model.invoices(spark, d)).select("id", "invoice_number", "tax_amount")


@query("file_name_parts", "SELECT DISTINCT regexp_replace(trim(original_filename), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM heads")
def file_name_parts(spark, d):
    return model.heads(spark, d).select(s.safe_component(F.col("original_filename")).alias("name")).distinct()
