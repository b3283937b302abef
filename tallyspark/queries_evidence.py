"""Registered queries over rules that weigh printed evidence, and over page and export files, each with SQL that checks it and rows on which its rule must refuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import evidence, ownership
from tallyspark.queries import SQL, query
from tallyspark.queries_records import _money, _page
from tallyspark.session import read_table, scratch_path
from tallyspark.sources import exports, model, one_file, page_files

_t = F.lit

# ---- identities by all of their evidence ------------------------------------------------------------
_FOREIGN = "id % 11 = 0"


def _identity_pages(spark, d):
    rows = model.invoices(spark, d)
    text = F.concat_ws(
        "\n",
        F.when(F.col("id") % 5 != 0, F.replace(F.lower("vendor_name"), _t("#"), _t(" - "))),
        F.concat(_t("ACCOUNT  no: "), F.col("id").cast("string")),
        F.when(F.col("id") % 3 != 0, F.concat(_t("Vat Reg. TIN "), "vendor_tax_id")),
        F.when(F.col("id") % 7 == 0, "Reading No. 5"),
    )
    return rows.withColumns({"page": F.col("id"), "foreign": F.expr(_FOREIGN)}), rows.select(F.col("id").alias("page"), text.alias("text"))


def _identities(spark, d):
    k = F.col("s_suppkey")
    tin = F.concat(_t("VAT-REG TIN "), F.lpad((k + 1).cast("string"), 9, "0"))
    keys = F.when(k % 4 == 0, F.array("s_name", _t("Account No"), tin)).when(k % 4 == 3, F.array(_t("..."), _t(" "))).otherwise(F.array("s_name", _t("Account No")))
    entries = read_table(spark, d, "supplier").select(k.alias("entry"), keys.alias("keys"), F.when(k % 4 == 1, F.array(_t("reading no"), _t(""))).otherwise(F.array().cast("array<string>")).alias("exclusions"))
    return entries.withColumns({"vendor_name": F.concat(_t("Reviewed "), F.col("entry").cast("string")), "currency": F.when(F.col("entry") % 2 == 0, "EUR")})


_applies = "vendor_id IS NOT NULL AND id % 5 <> 0 AND CASE vendor_id % 4 WHEN 0 THEN id % 3 <> 0 WHEN 1 THEN id % 7 <> 0 WHEN 2 THEN true ELSE false END"


@query("page_identities", f"SELECT id AS page, vendor_id AS entry FROM invoices WHERE {_applies}")
def page_identities(spark, d):
    """An entry needs all its keys in the page and none of its exclusions; an entry whose keys have no letters applies nowhere."""
    return evidence.page_identities(_identity_pages(spark, d)[1], _identities(spark, d))


@query("settled_identities", f"SELECT id, CASE WHEN {_applies} THEN 'Reviewed ' || vendor_id ELSE vendor_name END AS vendor_name, CASE WHEN {_applies} AND NOT ({_FOREIGN}) AND vendor_id % 2 = 0 THEN 'EUR' ELSE currency END AS currency FROM invoices")
def settled_identities(spark, d):
    rows, pages = _identity_pages(spark, d)
    return evidence.settle_identities(rows, pages, _identities(spark, d)).select("id", "vendor_name", "currency")


# ---- a table under four headings, on a page that is askew -----------------------------------------------
_HEADINGS = (("Description", 0), ("Qty", 400), ("Unit Price", 520), ("Amount", 700))


def _tables(spark, d):
    """Each order's lines under four headings; every page has its own slope."""
    item = model.lines(spark, d).groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("line", "description", "quantity", F.floor("unit_price").alias("price"), "amount"))).alias("items"))
    price = F.floor("x.price").cast("double")
    items = item.select(F.col("invoice_id").alias("id"), F.posexplode("items").alias("k", "x"), F.size("items").alias("of"))
    last = F.col("k") == F.col("of") - 1
    heads = item.select(F.col("invoice_id").alias("id"))
    swapped = F.col("id") % 9 == 4
    cell = lambda n, text, x, y, show: F.when(show, F.struct(n.cast("long").alias("n"), text.alias("text"), x.cast("double").alias("x1"), y.cast("double").alias("y")))
    yes = F.lit(True)
    head = [cell(_t(j), _t(w), F.when(swapped & (j in (1, 2)), _t(920 - x)).otherwise(_t(x)), _t(0), yes) for j, (w, x) in enumerate(_HEADINGS)]
    top = heads.select("id", F.explode(F.array_compact(F.array(*head, cell(_t(9000), _t("Subtotal"), _t(520), _t(9000), yes), cell(_t(9001), _t("5.00"), _t(700), _t(9040), yes), cell(_t(9002), _t("Late words"), _t(0), _t(9040), yes)))).alias("c"))
    y = 60 + 40 * F.col("k")
    n = 10 + 10 * F.col("k")
    row = [
        cell(n, F.col("x.description"), _t(0), y, yes),
        cell(n + 1, F.col("x.quantity").cast("int").cast("string"), _t(405), y + 2, yes),
        cell(n + 2, _money(price), _t(520), y - 2, ~(last & (F.col("id") % 7 == 3))),
        cell(n + 3, _money("x.amount"), _t(695), y, yes),
        cell(n + 4, _t("77.00"), _t(620), y + 3, last & (F.col("id") % 7 == 5)),
        cell(n + 5, _t("REF-12"), _t(0), y + 20, (F.col("k") == 0) & (F.col("id") % 2 == 0)),
    ]
    cells = items.select("id", F.explode(F.array_compact(F.array(*row))).alias("c")).unionByName(top)
    lines = cells.select(F.col("id").alias("page"), "c.*").withColumn("x2", F.col("x1") + 10 * F.length("text"))
    askew = F.col("y") + (F.col("page") % 5 - 2) * 0.02 * (F.col("x1") + F.col("x2")) / 2
    return lines.select("page", "n", "text", "x1", askew.alias("y1"), "x2", (askew + 20).alias("y2"))


@query("table_items", "SELECT invoice_id AS page, description, quantity, floor(unit_price)::double AS unit_price, amount FROM lines WHERE NOT (invoice_id % 7 IN (3, 5) OR invoice_id % 9 = 4)")
def table_items(spark, d):
    """A page with a price missing, with two of them, or with headings in another order has no rows; codes and what follows the subtotal are no items."""
    return evidence.table_items(_tables(spark, d)).drop("n")


# ---- charges of a bill: labels and amounts one to one, then their points ------------------------------------
_c1, _c2, _c3 = "round(subtotal)", "round(subtotal) + 20.25", "(id % 97 + 10)"


def _bills(spark, d):
    """Three charges whose heights are off so that the middle label is near two amounts; the third amount lost its point."""
    rows = model.invoices(spark, d).filter("subtotal is not null")
    c1, c2, c3 = F.round("subtotal"), F.round("subtotal") + 20.25, (F.col("id") % 97 + 10).cast("double")
    total = c1 + c2 + c3 / 100
    cells = [
        (_t("Charges for this  billing period"), 0, 0),
        (_money(total), 600, 4, F.col("id") % 6 != 5),
        (_t("Generation"), 0, 40),
        (_t("Transmission"), 0, 56),
        (_t("System Loss"), 0, 84),
        (_money(c1), 600, 44),
        (_money(c2), 600, 62),
        (F.format_string("%d", c3.cast("int")), 600, 86),
        (_t("7"), 300, 84, F.col("id") % 2 == 0),
        (_t("Total Amount Due"), 0, 140, F.col("id") % 10 != 9),
        (_t("1.00"), 600, 160),
    ]
    return _page(rows, cells).withColumn("confidence", _t(0.9))


@query("billing_rows", f"""SELECT id AS page, r.label, r.amount FROM (SELECT id, unnest([{{'label': 'Generation', 'amount': {_c1}}}, {{'label': 'Transmission', 'amount': {_c2}}}, {{'label': 'System Loss', 'amount': {_c3} / 100}}]) AS r
    FROM invoices WHERE subtotal IS NOT NULL AND id % 10 <> 9)""")
def billing_rows(spark, d):
    """Each label meets one amount, the nearest pairs first; an amount without its point is hundredths. Without the bill's total line there are no rows."""
    rows = evidence.billing_rows(_bills(spark, d))
    fixed = ownership.with_decimals(F.col("rows"), F.coalesce("target", F.aggregate(F.transform("rows", lambda x: F.when(x["decimals"], x["value"]).otherwise(x["value"] / 100)), _t(0.0), lambda s, v: s + v)))
    each = rows.select("page", F.explode(F.arrays_zip(F.transform("rows", lambda x: x["label"]).alias("label"), fixed.alias("amount"))).alias("r"))
    return each.select("page", F.col("r.label").alias("label"), F.round(F.col("r.amount"), 2).alias("amount"))


# ---- a page read against itself ----------------------------------------------------------------------
_town = "translate(CAST(100000000 + id AS varchar), '0123456789', 'abcdefghij') || 'x'"


@query("respelled", f"SELECT id AS page, upper(substr(town, 1, 3) || 'z' || substr(town, 5, 3) || CASE WHEN id % 3 = 0 THEN 'z' ELSE substr(town, 8, 1) END || substr(town, 9)) AS word, upper(town) AS spelling FROM (SELECT id, {_town} AS town FROM heads) WHERE id % 5 <> 4")
def respelled(spark, d):
    """A word that one or two of ten letters set apart from a clean reading of its page is that word; three letters, and words of other pages, do not count."""
    town = F.concat(F.translate((100000000 + F.col("id")).cast("string"), "0123456789", "abcdefghij"), _t("x"))
    cut = lambda a, n: F.substring(town, a, n)
    misread = F.concat(cut(1, 3), _t("z"), cut(5, 3), F.when(F.col("id") % 3 == 0, "z").otherwise(cut(8, 1)), F.when(F.col("id") % 5 == 4, _t("zz")).otherwise(cut(9, 2)))
    words = model.heads(spark, d).select(F.col("id").alias("page"), F.posexplode(F.array(F.struct(F.upper(misread).alias("word"), _t(False).alias("clean")), F.struct(town.alias("word"), _t(True).alias("clean")), F.struct(_t("PRIME").alias("word"), _t(True).alias("clean")))).alias("n", "w"))
    return evidence.respelled(words.select("page", "n", "w.*"))


@query("without_overlap", "SELECT id AS page, CASE id % 4 WHEN 0 THEN customer_name WHEN 1 THEN customer_name WHEN 2 THEN customer_name || 'Prime Avenue' ELSE 'Prime Avenue' END AS text FROM heads WHERE customer_name IS NOT NULL")
def without_overlap(spark, d):
    """A seller's line at the end of a buyer's goes, also without its first letter; of another page's line, or where nothing would stay, the text stays."""
    rows = model.heads(spark, d).filter("customer_name is not null")
    text = F.when(F.col("id") % 4 == 0, F.concat("customer_name", _t(" Prime Avenue"))).when(F.col("id") % 4 == 1, F.concat("customer_name", _t("RIME avenue"))).when(F.col("id") % 4 == 2, F.concat("customer_name", _t("Prime Avenue"))).otherwise("Prime Avenue")
    buyer = rows.select(F.col("id").alias("page"), _t(0).alias("n"), text.alias("text"))
    seller = rows.filter("id % 4 <> 2").select(F.col("id").alias("page"), F.explode(F.array(_t("Prime  Avenue"), _t("nue"), _t("St"))).alias("text"))
    return evidence.without_overlap(buyer, seller).select("page", "text")


# ---- labelled cells, closed sets, columns of a head ------------------------------------------------------
LABELS = (
    ("telecom", "invoice_number", "Bill Number"),
    ("telecom", "due_date", "Pay By"),
    ("services", "invoice_number", "Service Invoice No."),
    ("services", "total_amount", "Amount Payable"),
    ("marketplace", "total_amount", "Order Total"),
    ("marketplace", "vendor_name", "Sold By"),
    ("wallet", "invoice_number", "Reference No."),
    ("utility", "due_date", "Due Date"),
    ("withholding", "vendor_name", "Payee"),
)


@query("labelled_cells", """SELECT id AS page, f.field, f.value FROM (SELECT id, unnest([
    {'field': 'invoice_number', 'value': 'N' || id, 'ok': id % 6 <> 5},
    {'field': 'due_date', 'value': 'D' || id, 'ok': id % 4 <> 3},
    {'field': 'total_amount', 'value': 'T' || id, 'ok': id % 5 <> 4},
    {'field': 'vendor_name', 'value': customer_name, 'ok': customer_name IS NOT NULL AND id % 3 <> 2}]) AS f FROM heads) WHERE f.ok""")
def labelled_cells(spark, d):
    """A label's value stands after its colon, to its right, alone under it or on the next line; labels that disagree, a label in between and two cells under it leave a field out."""
    rows = model.heads(spark, d)
    num = F.concat(_t("N"), F.col("id").cast("string"))
    cells = [
        (F.concat(_t("Bill Number: "), num), 0, 0),
        (_t("Service Invoice No."), 0, 40),
        (F.when(F.col("id") % 6 == 5, "other").otherwise(num), 400, 42),
        (_t("Pay By"), 0, 100, F.col("id") % 4 != 3),
        (_t("Due Date"), 0, 100, F.col("id") % 4 == 3),
        (_t("Order Total"), 300, 100, F.col("id") % 4 == 3),
        (F.concat(_t("D"), F.col("id").cast("string")), 500, 101, F.col("id") % 4 != 3),
        (F.concat(_t("T"), F.col("id").cast("string")), 300, 130, (F.col("id") % 4 == 3) & (F.col("id") % 5 != 4)),
        (_t("x"), 300, 135, (F.col("id") % 4 == 3) & (F.col("id") % 5 == 4)),
        (_t("y"), 305, 125, (F.col("id") % 4 == 3) & (F.col("id") % 5 == 4)),
        (_t("Amount Payable :"), 0, 300, (F.col("id") % 4 != 3) & (F.col("id") % 5 != 4)),
        (F.concat(_t("T"), F.col("id").cast("string")), 5, 340, (F.col("id") % 4 != 3) & (F.col("id") % 5 != 4)),
        (_t("Sold by"), 0, 500, F.col("id") % 3 != 2),
        (F.col("customer_name"), 90, 700, F.col("customer_name").isNotNull() & (F.col("id") % 3 != 2)),
        (_t("Reference no."), 0, 900, F.lit(False)),
    ]
    labels = spark.createDataFrame(list(LABELS), "family string, field string, label string")
    return evidence.labelled_cells(_page(rows, cells), labels)


_CLOSED = ("generation", "transmission", "system loss")


@query("closed_charges", """SELECT id AS page, r.label, r.amount FROM (SELECT id, unnest([{'label': 'generation', 'amount': round(subtotal)}, {'label': 'transmission', 'amount': 20.25}, {'label': 'system loss', 'amount': -5.0}]) AS r
    FROM invoices WHERE subtotal IS NOT NULL AND id % 5 <> 1 AND id % 7 <> 2 AND id % 9 <> 3) WHERE r.amount IS NOT NULL""")
def closed_charges(spark, d):
    """All labels once, with one amount each, and the printed total is their sum; else none of them."""
    rows = model.invoices(spark, d).filter("subtotal is not null")
    a = F.round("subtotal")
    cells = [
        (_t("Generation"), 0, 0),
        (_money(a), 0, 40),
        (F.when(F.col("id") % 5 == 1, "Transmission").otherwise("Transmission  20.25"), 0, 80),
        (_t("System Loss: -5.00"), 0, 120),
        (_t("System Loss -5.00"), 0, 160, F.col("id") % 7 == 2),
        (F.concat(_t("Total Current Charges "), _money(a + 15.25 + F.when(F.col("id") % 9 == 3, 1).otherwise(0))), 0, 200),
        (_t("Other 9.00"), 0, 240),
    ]
    return evidence.closed_charges(_page(rows, cells), _CLOSED, "total current charges")


@query("lost_adjustment", "SELECT id, CASE WHEN abs(rest) > 0.01 AND abs(rest) <= 0.5 * cur THEN rest::double END AS amount, CASE WHEN abs(rest) > 0.01 AND abs(rest) <= 0.5 * cur THEN true END AS derived FROM (SELECT id, CAST(subtotal AS decimal(18,4)) AS cur, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 12.5 WHEN 2 THEN -CAST(subtotal AS decimal(18,4)) END AS rest FROM invoices WHERE subtotal IS NOT NULL)")
def lost_adjustment(spark, d):
    """What three printed amounts leave, with a flag; not where one is missing, nothing is left, or it is too much."""
    cur = F.col("subtotal").cast("decimal(18,4)")
    rest = F.when(F.col("id") % 4 == 0, 0).when(F.col("id") % 4 == 1, 12.5).when(F.col("id") % 4 == 2, -cur)
    got = evidence.lost_adjustment(F.lit(100.0), F.col("subtotal"), (rest.cast("decimal(18,4)") + cur + 100).cast("double"))
    return model.invoices(spark, d).filter("subtotal is not null").select("id", got["amount"].alias("amount"), got["derived"].alias("derived"))


@query("header_columns", "SELECT id AS page, h.side, h.parts FROM (SELECT id, unnest([{'side': 'left', 'parts': customer_name || ' | 5 Hill Road'}, {'side': 'right', 'parts': 'No. ' || id || CASE WHEN id % 2 = 0 THEN ' | 1998' ELSE '' END}]) AS h FROM heads WHERE id % 6 <> 0 AND customer_name IS NOT NULL)")
def header_columns(spark, d):
    """Two columns of a head that reading order mixes, parted left of the right one's heading, down to where the body begins; without that heading nothing."""
    rows = model.heads(spark, d).filter("customer_name is not null")
    cells = [
        (F.col("customer_name"), 0, 0),
        (_t("Billing Information"), 500, 0, F.col("id") % 6 != 0),
        (_t("5 Hill Road"), 10, 40),
        (F.concat(_t("No. "), F.col("id").cast("string")), 495, 30),
        (_t("1998"), 700, 60, F.col("id") % 2 == 0),
        (_t("Account Summary"), 0, 100),
        (_t("1999"), 600, 120),
    ]
    return evidence.header_columns(_page(rows, cells), "billing information", "account")


@query("below_label", "SELECT id AS page, 'N' || id AS value FROM heads WHERE id % 4 <> 3")
def below_label(spark, d):
    """The nearest line under a label that shares part of its width; one beside it or too far down is none."""
    rows = model.heads(spark, d)
    num = F.concat(_t("N"), F.col("id").cast("string"))
    cells = [(_t("Bill Date:"), 300, 0), (_t("beside"), 500, 30), (num, 350, 50, F.col("id") % 4 != 3), (_t("later"), 300, 80, F.col("id") % 2 == 0), (num, 350, 300, F.col("id") % 4 == 3)]
    return evidence.below_label(_page(rows, cells), "bill date", 60)


@query("calendar_readings", """SELECT id, CASE id % 4 WHEN 3 THEN NULL ELSE strftime(invoice_date, '%Y-%m-%d') END AS day,
    CASE id % 4 WHEN 3 THEN 'no such day' WHEN 0 THEN CASE WHEN day(invoice_date) <= 12 AND day(invoice_date) <> month(invoice_date) THEN 'day and month may be exchanged' END END AS note FROM heads WHERE id % 4 <> 1 OR day(invoice_date) > 12""")
def calendar_readings(spark, d):
    """Month first, else day first, else by the month's name; a day that is real in no way is flagged and stays empty."""
    day = F.col("invoice_date")
    text = F.when(F.col("id") % 4 == 0, F.date_format(day, "MM/dd/yyyy")).when(F.col("id") % 4 == 1, F.date_format(day, "dd/MM/yyyy")).when(F.col("id") % 4 == 2, F.date_format(day, "d MMM yyyy")).otherwise(F.concat(_t("31/14/"), F.year(day)))
    rows = model.heads(spark, d).filter("id % 4 <> 1 or day(invoice_date) > 12")
    got = evidence.calendar_reading(text)
    return rows.select("id", F.date_format(got["day"], "yyyy-MM-dd").alias("day"), got["note"].alias("note"))


# ---- files ---------------------------------------------------------------------------------------------
@query("document_pages", "SELECT id AS page, 'Customer ' || coalesce(customer_name, '') || chr(10) || chr(10) || repeat('é total ', CAST(id % 50 AS integer)) || CAST(id AS varchar) AS text FROM heads")
def document_pages(spark, d):
    """Page files written from the invoices and read back by ranges of two kilobytes, so that most pages are cut by a border."""
    folder = scratch_path(spark, "pages")
    body = F.concat(_t("Customer "), F.coalesce("customer_name", _t("")), _t("\n\n"), F.repeat(_t("é total "), (F.col("id") % 50).cast("int")), F.col("id").cast("string"))
    model.heads(spark, d).select(F.concat(_t("[DOCUMENT PAGE "), F.col("id").cast("string"), _t("]\n"), body)).write.text(folder)
    spark.dataSource.register(page_files.PageFiles)
    return spark.read.format("page_files").schema("page long, text string").option("range_bytes", 2000).load(folder)


@query("page_numbers", "SELECT id AS page FROM heads")
def page_numbers(spark, d):
    """The numbers alone: no page is put together for them."""
    folder = scratch_path(spark, "pages")
    model.heads(spark, d).select(F.concat(_t("[DOCUMENT PAGE "), F.col("id").cast("string"), _t("]\n[DOCUMENT PAGE x]\n"), F.repeat(_t("words "), 30))).write.text(folder)
    spark.dataSource.register(page_files.PageFiles)
    return spark.read.format("page_files").schema("page long").option("range_bytes", 5000).load(folder)


@query("sheet_export", SQL["export_with_totals"].removeprefix(model.MODEL_SQL))
def sheet_export(spark, d):
    """The export as one spreadsheet, written by all tasks and read back."""
    path = f"{scratch_path(spark, 'export')}.xlsx"
    rows = exports.with_totals(model.invoices(spark, d))
    exports.write(rows, path, "xlsx")
    spark.dataSource.register(one_file.Sheets)
    return spark.read.format("sheets").schema(rows.schema).load(path)


@query("log_file", "SELECT id AS \"Entity ID\", \"user\" AS \"User\", action AS \"Action\" FROM (SELECT entity_id AS id, \"user\", action FROM audit_logs)")
def log_file(spark, d):
    """The log as one text file, with the mark by which spreadsheets know its encoding, read back by its headings."""
    path = f"{scratch_path(spark, 'log')}.csv"
    exports.write(exports.log_rows(model.audit_logs(spark, d)), path, "csv", bom="true")
    back = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return back.select(F.col("Entity ID").cast("long").alias("Entity ID"), "User", "Action")
