"""Registered queries over header fields, items and repairs of documents, over texts made from invoices, and over what surrounds a search."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import documents, identity, quality, reconcile, text
from tallyspark.plans import language, search
from tallyspark.queries import query
from tallyspark.queries_records import _page
from tallyspark.queries_rules import X, cases, money
from tallyspark.session import read_table
from tallyspark.sources import model

_c, _t = F.col, F.lit
_D2 = "CAST({} AS decimal(18,2))"
_GROSS, _VAT = f"{_D2.format('n')} * 1.12", f"{_D2.format('n')} * 0.12"

# ---- header fields ------------------------------------------------------------------------------------
cases(
    "document_amounts",
    "subtotal double, total_amount double, zero_rated_sales double, vat_exempt_sales double, discount double, text string",
    "zero_rated_sales double, vat_exempt_sales double, discount double",
    (
        (X("n"), X("n + 5"), None, None, None, f"Zero Rated Sales {money('n + 1')}\nVAT-Exempt Sales {money('n + 2')}\nLess: Discount 7.50", X("n + 1"), X("n + 2"), 7.5),
        (X("n"), X("n + 5"), None, None, None, "VAT-Exempt Sales 0.00\nDiscounts 5.00\nDiscount 6.00", None, None, None),
        (X("n"), X("n + 5"), None, None, None, f"VAT Exempt Sales {money('n')}\nZero-rated {money('n + 5')}", None, None, None),
        (X("n"), X("n + 5"), 1.0, X("n"), 3.0, "Zero Rated Sales 9.00\nVAT-Exempt 8.00\nDiscount 7.00", 1.0, X("n"), 3.0),
    ),
    None,
    documents.fill_amounts,
)
cases(
    "document_vendor",
    "vendor_name string, text string",
    "vendor_name varchar",
    (("-", "HARBOR ‹id› TRADING CORP\n12 Main Street", "HARBOR ‹id› TRADING CORP"), ("‹c›", "HARBOR ‹id› TRADING CORP", "‹c›"), (None, "no name\n‹id› Main Street Inc, Quay City", None), ("n/a", "x\nx\nx\nx\nx\nx\nx\nx\nx\nx\nx\nx\nx\nx\nx\nLATE ‹id› CORP", "n/a")),
    None,
    documents.vendor_name,
)
cases(
    "document_number",
    "invoice_number string, text string",
    "invoice_number varchar",
    (("9‹id›", "Transaction# 9‹id›\nOR# 0217‹id›", "0217‹id›"), ("7777‹id›", "OR# 007777‹id›", "7777‹id›"), (None, "SI No. 5555‹id›\nInvoice No. 6666‹id›", None), ("A-‹id›", "OR# 55512", "A-‹id›"), ("-", "Official Receipt No. : AB-123‹id›", "AB-123‹id›")),
    None,
    documents.invoice_number,
)
_DD = "‹lpad(CAST(id % 28 + 1 AS string), 2, '0')›"
cases(
    "document_date",
    "invoice_date string, text string",
    "invoice_date varchar",
    ((None, f"Date: {_DD}-Aug-2025\nPermit No 7 date issued 2019-01-01", f"2025-08-{_DD}"), (None, f"Due 2024-04-05\nInvoice Date 2024-03-{_DD}", f"2024-03-{_DD}"), (None, f"2024-03-{_DD}\n2024-04-06", None), ("2020-01-01", f"Date: 2024-03-{_DD}", "2020-01-01"), ("n/a", f"printed 2024-03-{_DD}\nValid until 2029-01-01", f"2024-03-{_DD}")),
    None,
    documents.invoice_date,
)
cases(
    "document_customer",
    "customer_name string, text string",
    "customer_name varchar",
    ((None, "Sold To: Delta ‹id›", "Delta ‹id›"), ("-", "Bill to:\nDelta ‹id›", "Delta ‹id›"), (None, "Sold to: Delta ‹id›\nBilled to: Omega ‹id›", None), ("‹c›", "Sold To: Delta ‹id›", "‹c›"), (None, "Bill to:\n‹id› Hill Road", None)),
    None,
    documents.customer_name,
)
_TIN = "‹id % 900 + 100›-‹n % 900 + 100›-‹id % 89 + 110›"
cases(
    "document_tax_ids",
    "vendor_tax_id string, customer_tax_id string, text string",
    "vendor_tax_id varchar, customer_tax_id varchar",
    (
        (None, None, f"Acme Corp\nTIN {_TIN}-000\nSold To: Delta\nTIN 987-654-321-000", f"{_TIN}-000", "987-654-321-000"),
        (f"{_TIN}-000", f"{_TIN}-000", f"TIN {_TIN}-000\nSold To: Delta\nTIN 987-654-321-000", f"{_TIN}-000", "987-654-321-000"),
        ("111-222-333-000", None, f"TIN {_TIN}-000\nSold To: Delta\nTIN 987-654-321-000\nTIN 987-654-322-000", "111-222-333-000", None),
        ("-", "444-555-666-000", "nothing", "-", "444-555-666-000"),
    ),
    None,
    documents.tax_ids,
)
cases(
    "isolated_address",
    "vendor string, customer string",
    "address varchar",
    (("‹id› Quay St, Buyer Tower, Cebu", "Buyer Tower, Cebu", "‹id› Quay St"), ("Buyer Tower, Cebu", "BUYER TOWER; Cebu", "Buyer Tower, Cebu"), ("‹id› Quay St, Ce", "Ce", "‹id› Quay St, Ce"), (None, "Cebu", None)),
    lambda df: [documents.isolate_address(_c("vendor"), _c("customer"))],
)

# ---- amounts and items ------------------------------------------------------------------------------------
cases(
    "exchanged_totals",
    "subtotal double, total_amount double, text string",
    "subtotal double, total_amount double",
    (
        (X(_GROSS), X("n"), f"{money('n')} and {money(_GROSS)}", X("n"), X(_GROSS)),
        (X(_GROSS), X("n"), f"{money('n')} and {money(_GROSS)}\nsenior citizen discount", X(_GROSS), X("n")),
        (X(_GROSS), X("n"), f"only {money('n')}", X(_GROSS), X("n")),
        (X("n * 2"), X("n"), f"{money('n')} and {money('n * 2')}", X("n * 2"), X("n")),
    ),
    None,
    reconcile.swapped,
)
cases(
    "document_tax",
    "tax_amount double, text string",
    "tax_amount double",
    ((None, f"VAT {money(_VAT)}\nVATable sales 9.00", X(_VAT)), (0.0, f"12% VAT {money(_VAT)}", X(_VAT)), (None, f"VAT {money(_VAT)}\nTax {money('n')}", None), (X("n"), f"VAT {money(_VAT)}", X("n")), (0.0, "VAT exempt 5.00", 0.0)),
    None,
    reconcile.tax,
)
cases(
    "tax_by_rate",
    "subtotal double, tax_amount double, total_amount double, text string",
    "tax_amount double",
    ((X("n"), 1.0, X(_GROSS), f"tax {money(_VAT)}", X(_VAT)), (X("n"), 1.0, X(_GROSS), "tax not printed", 1.0), (X("n"), X(_VAT), X(_GROSS), f"{money(_VAT)}", X(_VAT)), (X("n"), 1.0, X(f"{_GROSS} + 1"), f"{money(_VAT)}", 1.0)),
    None,
    reconcile.tax_identity,
)


def _repair(df: DataFrame) -> DataFrame:
    out = reconcile.weakest_amount(df)
    return out.select("id", _c("repair.field").alias("field"), F.round(_c("repair.value"), 2).alias("value"))


cases(
    "weakest_amount",
    "subtotal double, tax_amount double, discount double, total_amount double, text string",
    "field varchar, value double",
    (
        (X("n"), 1.01, 0.0, X(_GROSS), f"{money('n')} {money(_VAT)} 0.00 {money(_GROSS)}", "tax_amount", X(_VAT)),
        (X("n"), 1.01, 0.0, X(_GROSS), f"{money('n')} 0.00 {money(_GROSS)}", None, None),
        (X("n"), X(_VAT), 0.0, X(_GROSS), f"{money('n')}", None, None),
        (X("n"), 1.01, 0.0, X("n + 77777.77"), f"{money('n')} {money(_VAT)} 0.00 {money(_GROSS)}", None, None),
    ),
    None,
    _repair,
)
_ITEMS = "array<struct<description:string,quantity:double,unit_price:double,amount:double>>"


def _pen(df: DataFrame) -> DataFrame:
    return df.withColumns({"line_items": F.expr("array(named_struct('description', 'Pen', 'quantity', 2D, 'unit_price', 10D, 'amount', 20D))").cast(_ITEMS), "withholding_tax": F.lit(None).cast("double")})


def _missing_item(df: DataFrame) -> DataFrame:
    last = F.element_at("line_items", -1)
    return documents.missing_item(_pen(df)).select("id", last["description"].alias("description"), last["amount"].alias("amount"))


cases(
    "missing_item",
    "subtotal double, tax_amount double, total_amount double, text string",
    "description varchar, amount double",
    (
        (X("n + 20"), 5.0, X("n + 25"), f"Delivery fee {money('n')}\nTotal {money('n + 25')}", "Delivery fee", X("n")),
        (X("n + 20"), 5.0, X("n + 25"), f"Delivery fee {money('n')}\nService fee {money('n')}", "Pen", 20.0),
        (X("n + 20"), 5.0, X("n + 25"), f"Net amount {money('n')}", "Pen", 20.0),
        (20.0, 5.0, 25.0, f"Delivery fee {money('n')}", "Pen", 20.0),
        (0.0, 0.0, X("n + 20"), f"Repair ‹id› : {money('n')}", "Repair ‹id›", X("n")),
    ),
    None,
    _missing_item,
)


def _twice(df: DataFrame) -> DataFrame:
    out = documents.balance_item(documents.balance_item(_pen(df)))
    return out.select("id", F.size("line_items").cast("long").alias("k"), F.element_at("line_items", -1)["amount"].alias("amount"))


cases("balance_item", "previous_balance double", "k bigint, amount double", ((X("n"), 2, X("n")), (0.0, 1, 20.0), (None, 1, 20.0), (X("-n"), 2, X("-n"))), None, _twice)
_QTY = "(id % 90 + 2)"
cases(
    "retail_quantities",
    "text string",
    "quantity double, unit_price double, amount double",
    ((f"‹{_QTY}›@P24.00\n{money(f'{_QTY} * 24')}", X(_QTY), 24.0, X(f"{_QTY} * 24")), (f"‹{_QTY}›@P24.00\n{money(f'{_QTY} * 24 + 1')}", None, None, None), (f"code ‹{_QTY}›@P24.00\n{money(f'{_QTY} * 24')}", None, None, None)),
    lambda df: [F.get(documents.retail_quantities(_c("text")), _t(0))[k] for k in ("quantity", "unit_price", "amount")],
)
cases(
    "amount_to_pay",
    "expected double, text string",
    "amount double",
    ((1.0, f"AMOUNT TO PAY {money('n')}\nCASH 900000.00", X("n")), (X("n"), "CASH 9.00\nCHANGE 1.00", X("n")), (None, f"CASH {money('n + 8')}\nCHANGE 8.00", X("n")), (None, "CASH 5.00\nCHANGE 5.00", None)),
    lambda df: [documents.amount_to_pay(_c("text"), _c("expected"))],
)
cases(
    "printed_hints",
    "text string",
    "total_amount double, vendor_name varchar, vendor_tax_id varchar",
    ((f"HARBOR ‹id› CORP\nTIN {_TIN}\nTotal amount due {money('n')}", X("n"), "HARBOR ‹id› CORP", _TIN), (f"subtotal {money('n')}", None, None, None)),
    lambda df: [(h := documents.hints(_c("text")))["total_amount"].cast("double"), h["vendor_name"], h["vendor_tax_id"]],
)
cases("named_totals", "total double, description string", "kind varchar", ((X("n"), "Grand total", "summary"), (X("n"), "‹id›", "bare number"), (X("n"), "Desk ‹id›", None)), lambda df: [reconcile.item_class(_c("description"))])

# ---- scalars -------------------------------------------------------------------------------------------------
cases("discounts", "raw string", "amount double", ((f"({money('n')})", X("n")), (f"-{money('n')}", X("n")), (money("n"), X("n")), ("none", None), (None, None)), lambda df: [scalars.normalize_discount(_c("raw"))])
cases("shown_money", "n2 double", "shown varchar", ((X("id % 1000 + 0.5"), "‹id % 1000›.50"), (None, "Not available"), (X("id % 1000 * 1.0"), "‹id % 1000›.00")), lambda df: [scalars.money_display(_c("n2"))])
cases("read_digits", "raw string", "number varchar", (("INV-1O‹id›lS", "INV-10‹id›15"), ("OIl‹id›", "OIl‹id›"), ("SOLO", "SOLO"), (None, None)), lambda df: [scalars.lookalike_digits(_c("raw"))])
_MD = "‹id % 12 + 1›"
cases(
    "dates_in_context",
    "raw string, page string",
    "day varchar",
    ((f"{_MD}/5/2024", "Date (MM/DD/YYYY)", "2024-‹lpad(CAST(id % 12 + 1 AS string), 2, '0')›-05"), (f"5/{_MD}/2024", "Date (dd / mm / yyyy)", "2024-‹lpad(CAST(id % 12 + 1 AS string), 2, '0')›-05"), (f"2024-03-{_DD}", "day/month/year", f"2024-03-{_DD}"), (f"13/{_MD}/2024", "MM/DD/YYYY", None)),
    lambda df: [F.date_format(scalars.parse_date_with_context(_c("raw"), _c("page")), "yyyy-MM-dd")],
)
cases(
    "text_support",
    "value string, page string",
    "support double",
    (("Harbor ‹id› Corp", "x\nHARBOR, ‹id› corp. y", 1.0), ("Harbor ‹id› Corp", "Harbor ‹id›\nCorp", 0.85), ("Harbor ‹id› Corp", "Corp of ‹id› Harbor", 0.62), ("Harbor ‹id› Corp", "Corp ‹id›", 0.0), ("‹id % 90 + 10›", "‹id % 90 + 10›", 0.0)),
    lambda df: [quality.text_support(_c("value"), _c("page"))],
)


# ---- records ---------------------------------------------------------------------------------------------------
@query("content_notes", """SELECT id, CASE WHEN k IS NULL OR id = first THEN k END AS k, CASE WHEN k IS NOT NULL AND id > first THEN 'needs_review' ELSE status END AS status,
    CASE WHEN k IS NOT NULL AND id > first THEN list_append(notes, 'Same content as invoice ' || first) ELSE notes END AS notes FROM (SELECT *, min(id) OVER (PARTITION BY k) AS first FROM (SELECT id, status, CASE WHEN id % 9 <> 0 THEN customer_name END AS k, ['old'] AS notes FROM heads))""")
def content_notes(spark, d):
    """The first invoice of a content keeps its key, later ones say which it is; rows without a key are left alone."""
    rows = model.heads(spark, d).select("id", "status", F.when(_c("id") % 9 != 0, _c("customer_name")).alias("k"), F.array(_t("old")).alias("validation_issues"))
    return identity.backfill(rows, "k", issue=True).select("id", "k", "status", _c("validation_issues").alias("notes"))


@query("locked_rows", "SELECT id, id % 2 = 0 AS locked, CASE WHEN id % 2 = 0 THEN 'processed' ELSE status END AS status FROM heads")
def locked_rows(spark, d):
    rows = model.heads(spark, d)
    both = identity.lock(rows.filter("id % 2 = 0"), True).unionByName(identity.lock(rows.filter("id % 2 = 1"), False))
    return both.select("id", "locked", "status")


@query("manual_edits", "SELECT id, 'ok' AS number_status, CASE WHEN id % 3 = 0 THEN 'manual_edit' ELSE 'ok' END AS customer_status, CASE WHEN id % 4 = 0 THEN 'derived' END AS category_status FROM heads")
def manual_edits(spark, d):
    """A changed field's evidence becomes a manual edit, a changed category's derived; the others' stays."""
    i = _c("id")
    text_map = lambda name, cat: F.create_map(_t("invoice_number"), F.coalesce("invoice_number", _t("-")), _t("customer_name"), name, _t("category"), cat)
    name, cat = F.coalesce("customer_name", _t("-")), F.coalesce("category", _t("-"))
    old, new = text_map(name, cat), text_map(F.when(i % 3 == 0, F.concat(name, _t("!"))).otherwise(name), F.when(i % 4 == 0, _t("Changed")).otherwise(cat))
    ok = F.struct(_t(0.9).alias("score"), _t("ok").alias("status"), _t("text").alias("source"))
    got = documents.after_edit(F.create_map(_t("invoice_number"), ok, _t("customer_name"), ok).cast(documents.EVIDENCE), old, new)
    rows = model.heads(spark, d).select("id", got.alias("e"))
    return rows.select("id", _c("e.invoice_number.status").alias("number_status"), _c("e.customer_name.status").alias("customer_status"), _c("e.category.status").alias("category_status"))


@query("page_documents", "SELECT id // 4 AS file, CAST(g + 1 AS bigint) AS \"group\", min(0.9 - id % 4 * 0.1) AS confidence, string_agg(DISTINCT CASE WHEN id % 4 = 1 THEN 'trocr' ELSE 'paddle' END, '+' ORDER BY CASE WHEN id % 4 = 1 THEN 'trocr' ELSE 'paddle' END) AS engine, string_agg(CAST(id % 4 AS varchar), ',' ORDER BY id) AS pages FROM (SELECT id, (id % 4) // 2 AS g FROM heads) GROUP BY 1, 2")
def page_documents(spark, d):
    """Files of four pages, printed 1 of 2, 2 of 2 and again: two documents, each with its least confidence and its engines."""
    i = _c("id")
    pages = model.heads(spark, d).select(F.floor(i / 4).cast("long").alias("file"), (i % 4).alias("page"), (i % 2 + 1).alias("printed"), _t(2).alias("of"), F.array((i % 4 / 2).cast("int").cast("string")).alias("ids"), (0.9 - i % 4 * 0.1).alias("confidence"), F.when(i % 4 == 1, "trocr").otherwise("paddle").alias("engine"))
    return identity.page_group_summary(pages).select("file", "group", "confidence", "engine", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("reading_order", "SELECT id AS page, w.word, w.rank FROM (SELECT id, unnest([{'word': 'C' || id, 'rank': 1}, {'word': 'A' || id, 'rank': 2}, {'word': 'B', 'rank': 3}, {'word': 'D', 'rank': 4}]) AS w FROM heads)")
def reading_order(spark, d):
    """By row, then by place: rows whose heights differ by less than a row are one."""
    i = _c("id").cast("string")
    words = _page(model.heads(spark, d), [(F.concat(_t("A"), i), 300, 6), (_t("B"), 600, 0), (F.concat(_t("C"), i), 0, 3), (_t("D"), 0, 60)])
    return text.reading_order(words.withColumnRenamed("text", "word"), 60.0).select("page", "word", "rank")


@query("line_height", "SELECT id AS page, CASE WHEN id % 2 = 0 THEN 30.0 ELSE 20.0 END::double AS height FROM heads")
def line_height(spark, d):
    words = _page(model.heads(spark, d), [(_t("a"), 0, 0), (_t("b"), 0, 50), (_t("c"), 0, 100), (_t("d"), 0, 150)])
    high = (_c("page") % 2 == 0) & _c("text").isin("c", "d") | (_c("text") == "d")
    return text.median_height(words.withColumn("y2", F.when(high, _c("y1") + 30).otherwise(_c("y2"))))


@query("master_repairs", "SELECT id, CASE WHEN vendor_id IS NULL OR id % 4 IN (2, 3) THEN raw ELSE right_tin END AS tin FROM (SELECT *, lpad(CAST(vendor_id + 1 AS varchar), 9, '0') AS right_tin, CASE WHEN id % 4 = 1 THEN lpad(CAST(vendor_id + 1 AS varchar), 9, '0') WHEN id % 4 = 2 THEN '9999' || substr(lpad(CAST(vendor_id + 1 AS varchar), 9, '0'), 5) ELSE '999' || substr(lpad(CAST(vendor_id + 1 AS varchar), 9, '0'), 4) END AS raw FROM invoices)")
def master_repairs(spark, d):
    """Up to three wrong digits are mended from the master entry whose address words the row shares; four, or another address, are not."""
    master = read_table(spark, d, "supplier").select(F.lpad((_c("s_suppkey") + 1).cast("string"), 9, "0").alias("tin"), F.concat(_t("Harbor Tower Building "), F.lpad(_c("s_suppkey").cast("string"), 5, "7")).alias("address"))
    i, right = _c("id"), _c("vendor_tax_id")
    raw = F.when(i % 4 == 1, right).when(i % 4 == 2, F.concat(_t("9999"), F.substring(right, 5, 5))).otherwise(F.concat(_t("999"), F.substring(right, 4, 6)))
    address = F.when(i % 4 == 3, "Elsewhere Street").otherwise(F.concat(_t("harbor tower, building "), F.lpad(_c("vendor_id").cast("string"), 5, "7")))
    rows = model.invoices(spark, d).select("id", raw.alias("vendor_tax_id"), address.alias("vendor_address"))
    return documents.nearest_tin(rows, master, share=1.0).select("id", _c("vendor_tax_id").alias("tin"))


@query("similar_names", "SELECT id, id % 3 <> 2 AS alike FROM heads")
def similar_names(spark, d):
    """Names by matching blocks: one letter lost or changed is alike to 0.9, another name is not."""
    name = F.concat(_t("Harbor Trading Company "), _c("id").cast("string"))
    other = F.when(_c("id") % 3 == 0, F.replace(name, _t("Trading"), _t("Tradng"))).when(_c("id") % 3 == 1, F.replace(name, _t("Harbor"), _t("Harbur"))).otherwise("Oxbow Cafe")
    return model.heads(spark, d).select("id", (text.similarity(name, other) >= 0.9).alias("alike"))


# ---- what surrounds a search -----------------------------------------------------------------------------------
_WORDED = (
    ("unlocked invoices of q2 1996", "NOT locked AND invoice_date BETWEEN DATE '1996-04-01' AND DATE '1996-06-30'"),
    ("at least 150000 usd", "currency = 'USD' AND total_amount >= 150000"),
    ("without plate number", "plate_number IS NULL OR plate_number IN ('-', '0', 'N/A')"),
)


@query("worded_searches", " UNION ALL ".join(f"SELECT {k} AS request, count(*) AS n, true AS told FROM heads WHERE {w}" for k, (_, w) in enumerate(_WORDED)))
def worded_searches(spark, d):
    """A request, its plan in words that name each of its fields, and how many invoices it selects."""
    rows = model.heads(spark, d)
    out = []
    for k, (q, _) in enumerate(_WORDED):
        plan = language.parse(q, page="history", today=date(1998, 1, 1))
        told = all(search.label(c["field"]).lower() in search.wording(plan).lower() for conditions in plan.values() for c in conditions)
        out.append(search.search(rows, plan).agg(F.count(_t(1)).alias("n")).select(_t(k).alias("request"), "n", _t(told).alias("told")))
    return out[0].unionByName(out[1]).unionByName(out[2])


_ASKED = (("over 150000", True), ("over 150000 usd", False), ("what a lovely day", None), ("unlocked", False), ("rows of interest", "model"))


@query("interpreted", """SELECT 0 AS request, CASE WHEN k > 1 THEN 'refused' ELSE 'found' END AS outcome, CASE WHEN k <= 1 THEN (SELECT count(*) FROM heads WHERE total_amount > 150000) END AS n FROM (SELECT count(DISTINCT currency) AS k FROM heads) c
    UNION ALL SELECT 1, 'found', count(*) FROM heads WHERE total_amount > 150000 AND currency = 'USD'
    UNION ALL SELECT 2, 'refused', NULL UNION ALL SELECT 3, 'found', count(*) FROM heads WHERE NOT locked
    UNION ALL SELECT 4, 'found', count(*) FROM heads WHERE status = 'pending'""")
def interpreted(spark, d):
    """A request by rules, else by a model; amounts over several currencies, and what neither understands, are refused and select nothing."""
    rows = model.heads(spark, d)
    context = {"currencies": [r[0] for r in rows.select("currency").filter("currency is not null").distinct().limit(20).collect()], "categories": [], "vendors": [], "users": [], "actions": [], "types": []}
    out = []
    for k, (q, kind) in enumerate(_ASKED):
        by_model = (lambda *_: search.empty() | {"choices": [{"field": "status", "operator": "in", "values": ["pending"]}]}) if kind == "model" else None
        try:
            found = search.search(rows, language.interpret(q, page="history", context=context, today=date(1998, 1, 1), model=by_model))
        except ValueError:
            out.append(rows.limit(1).select(_t(k).alias("request"), _t("refused").alias("outcome"), _t(None).cast("long").alias("n")))
            continue
        out.append(found.agg(F.count(_t(1)).alias("n")).select(_t(k).alias("request"), _t("found").alias("outcome"), "n"))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total
