"""More rules over a document's text: party fields, document numbers and dates, items that a bill implies,
second-pass reasons and evidence after edits. All are columns; a rule that finds several answers keeps none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import blank, is_missing, let, normalize_tin, parse_date
from tallyspark.operators.quality import CARRIED, Cells, cents, consistency, items_consistent
from tallyspark.operators.reconcile import NOT_TOTAL, SUBTOTAL_LABELS, TOTAL_LABELS, _lines, _settle, labelled, labelled_in
from tallyspark.operators.text import amounts_on, only_one
from tallyspark.session import materialize

# ---- fixed values -----------------------------------------------------------------------------
BUSINESS = "(?i)\\b(?:inc|corp|corporation|company|co|ltd|llc|enterprises?|trading|services|association|bank)\\b\\.?"
ADDRESS = "(?i)\\b(?:street|st\\.?|ave\\.?|avenue|road|rd\\.?|city|tel|fax|tin)\\b"
ZERO_RATED = "(?i)zero[\\s-]*rated"
EXEMPT = "(?i)vat[\\s-]*exempt"
DISCOUNTS = "(?i)\\b(?:less\\s*)?discounts?\\b|sc/pwd"
NUMBER = "(?i)\\b(?:O\\.?R\\.?|S\\.?I\\.?|sales\\s*invoice|official\\s*receipt|invoice)\\s*(?:no\\.?|number|#)\\s*:?\\s*([A-Z]{0,3}-?[0-9]{3,})"
NOT_NUMBER = "(?i)transaction\\s*#|terminal|min\\s*#?|serial|s/n|trace"
PERMIT = "(?i)permit|accredit|authority|atp|date\\s*issued|valid"
DATE = "([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{1,2}[ -]?[A-Za-z]{3,9}[ -]?[0-9]{2,4}|[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4})"
TIN = "([0-9]{3}-[0-9]{3}-[0-9]{3}(?:-[0-9]{3,5})?)"
CUSTOMER = "(?i)^\\s*(?:sold\\s*to|bill(?:ed)?\\s*to|customer(?:\\s*name)?|registered\\s*name)\\s*:?\\s*"
#: What an item recovered from a line of its own must not be called.
NO_ITEM = "(?i)total|vat|tax|cash|change|due|balance|net|amount|tin|date"
RETAIL = "(?i)^\\s*([0-9]{1,3})\\s*(?:@\\s*P?|P|x\\s*P?)\\s*([0-9]+(?:\\.[0-9]{1,2})?)\\s*$"
EVIDENCE = "map<string,struct<score:double,status:string,source:string>>"
# -----------------------------------------------------------------------------------------------


def fill_amounts(df: DataFrame) -> DataFrame:
    """Zero-rated, exempt and discount amounts that the text prints and the row lacks; a zero is not taken."""
    for field, label in (("zero_rated_sales", ZERO_RATED), ("vat_exempt_sales", EXEMPT), ("discount", DISCOUNTS)):
        if field in df.columns:
            found = only_one(F.filter(labelled(F.col("text"), label), lambda v: v > 0))
            other = F.coalesce((found == F.col("subtotal")) | (found == F.col("total_amount")), F.lit(False))
            df = _settle(df, field, found, F.col(field).isNull() & found.isNotNull() & ~other, "taken from its label")
    return df


def business_line(text: Column, most: int = 15) -> Column:
    """The first line near the top that reads as a business name."""
    lines = F.filter(F.slice(_lines(text), 1, most), lambda x: x.rlike(BUSINESS) & ~x.rlike(ADDRESS))
    return F.trim(F.regexp_replace(F.get(lines, F.lit(0)), "\\s+", " "))


def vendor_name(df: DataFrame) -> DataFrame:
    found = business_line(F.col("text"))
    return _settle(df, "vendor_name", found, is_missing(F.col("vendor_name")) & found.isNotNull(), "taken from the head of the page")


def invoice_number(df: DataFrame) -> DataFrame:
    """A number that stands by a terminal or transaction label gives way to the one explicit document number."""
    lines, current = _lines(F.col("text")), F.col("invoice_number")
    suspect = F.exists(lines, lambda x: F.contains(x, current) & x.rlike(NOT_NUMBER))
    found = only_one(F.transform(F.filter(lines, lambda x: x.rlike(NUMBER) & ~x.rlike(NOT_NUMBER)), lambda x: F.regexp_extract(x, NUMBER, 1)))
    return _settle(df, "invoice_number", found, (is_missing(current) | suspect) & found.isNotNull() & ~F.coalesce(F.ltrim(current, F.lit("0")) == F.ltrim(found, F.lit("0")), F.lit(False)), "explicit document number")


def dated_lines(text: Column) -> Column:
    """Lines with a date, and their dates; those beside permit words are none."""
    dates = lambda x: F.array_compact(F.transform(F.regexp_extract_all(x, F.lit(DATE), F.lit(1)), parse_date))
    lines = F.filter(_lines(text), lambda x: ~x.rlike(PERMIT))
    return F.filter(F.transform(lines, lambda x: F.struct(x.alias("line"), dates(x).alias("dates"))), lambda r: F.size(r["dates"]) > 0)


def dates_of(rows: Column, label: str | None = None) -> Column:
    """Dates of the dated lines with a label, or of all."""
    return F.flatten(F.transform(F.filter(rows, lambda r: r["line"].rlike(label)) if label else rows, lambda r: r["dates"]))


def dates_in(text: Column, label: str | None = None) -> Column:
    """Dates of a text's lines with a label, or of all lines; those beside permit words are none."""
    return dates_of(dated_lines(text), label)


def invoice_date(df: DataFrame) -> DataFrame:
    """A date from its label, else the only date of the page."""
    labels = ("(?i)^\\s*date\\b", "(?i)(?:invoice|bill|billing|statement)\\s*date", None)
    found = let(dated_lines(F.col("text")), lambda rows: F.coalesce(*[only_one(dates_of(rows, label)) for label in labels]))
    if dict(df.dtypes)["invoice_date"] == "string":
        found = F.date_format(found, "yyyy-MM-dd")
    df, found = df.withColumn("__found", found), F.col("__found")
    return _settle(df, "invoice_date", found, is_missing(F.col("invoice_date").cast("string")) & found.isNotNull(), "taken from print").drop("__found")


def customer_name(df: DataFrame) -> DataFrame:
    """The name behind its label, or on the line below."""
    lines = _lines(F.col("text"))
    at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(CUSTOMER))

    def value(i: Column) -> Column:
        here = F.trim(F.regexp_replace(F.element_at(lines, i), CUSTOMER, ""))
        below = F.trim(F.get(lines, i))
        return F.when(here != "", here).otherwise(F.when((below != "") & ~below.rlike(ADDRESS) & ~below.rlike(CUSTOMER), below))

    found = only_one(F.transform(at, value))
    return _settle(df, "customer_name", found, is_missing(F.col("customer_name")) & found.isNotNull(), "taken from its label")


def tax_ids(df: DataFrame) -> DataFrame:
    """Seller's and buyer's tax ids: the first before the buyer's label, and the only one after it; equal ones cannot both stand."""
    lines = _lines(F.col("text"))
    split_at = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(CUSTOMER))), F.size(lines) + 1)
    ids = lambda part: F.transform(F.flatten(F.transform(part, lambda x: F.regexp_extract_all(x, F.lit(TIN), F.lit(1)))), normalize_tin)
    seller, buyer = F.get(ids(F.slice(lines, 1, F.greatest(split_at - 1, F.lit(0)))), F.lit(0)), only_one(ids(F.slice(lines, F.least(split_at, F.size(lines) + 1), F.size(lines) + 1)))
    same = F.coalesce(F.col("vendor_tax_id") == F.col("customer_tax_id"), F.lit(False))
    df = _settle(df, "vendor_tax_id", seller, (is_missing(F.col("vendor_tax_id")) | same) & seller.isNotNull(), "seller's block")
    return _settle(df, "customer_tax_id", buyer, (is_missing(F.col("customer_tax_id")) | F.coalesce(F.col("customer_tax_id") == F.col("vendor_tax_id"), F.lit(False))) & buyer.isNotNull(), "buyer's block")


def balance_item(df: DataFrame) -> DataFrame:
    """A carried balance shows as an item, once, however often this runs."""
    kind = dict(df.dtypes)["line_items"]
    items = F.filter(F.coalesce("line_items", F.array().cast(kind)), lambda x: ~F.trim(F.lower(blank(x["description"]))).isin(*CARRIED))
    b = F.round("previous_balance", 2)
    row = F.struct(F.lit("Remaining Balance").alias("description"), F.lit(1.0).alias("quantity"), b.alias("unit_price"), b.alias("amount"))
    return df.withColumn("line_items", F.when(F.abs("previous_balance") > 0.005, F.array_append(items, row)).otherwise(items))


def missing_item(df: DataFrame) -> DataFrame:
    """An item that is missing by exactly the amount of one labelled line."""
    c = Cells(df)
    target = F.when((c.or_zero("tax_amount") > 0) & (c.or_zero("subtotal") > 0), c.number("subtotal")).otherwise(c.or_zero("total_amount") + c.or_zero("withholding_tax"))
    have = F.aggregate("line_items", F.lit(0).cast("decimal(18,4)"), lambda s, x: (s + cents(F.coalesce(x["amount"], F.lit(0.0)))).cast("decimal(18,4)"))
    gap = (cents(target) - have).cast("double")
    label = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[₱$P]?\\s*[0-9][0-9,]*\\.[0-9]{2}", " "), "[\\s:.-]+$", ""))
    hits = F.filter(_lines(F.col("text")), lambda x: F.exists(amounts_on(x), lambda v: F.abs(v - gap) < 0.005) & label(x).rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]") & ~x.rlike(NO_ITEM))
    found = only_one(F.transform(hits, label))
    row = F.struct(found.alias("description"), F.lit(1.0).alias("quantity"), gap.alias("unit_price"), gap.alias("amount"))
    when = (F.size("line_items") > 0) & (F.abs(gap) >= 0.01) & found.isNotNull()
    return df.withColumn("line_items", F.when(when, F.array_append("line_items", row)).otherwise(F.col("line_items")))


def retail_quantities(text: Column) -> Column:
    """(quantity, unit price, amount) of lines such as 7@P24.00 whose product the text prints as well."""
    lines = F.filter(_lines(text), lambda x: x.rlike(RETAIL))
    number = lambda x, i: F.regexp_extract(x, RETAIL, i).cast("double")
    rows = F.transform(lines, lambda x: F.struct(number(x, 1).alias("quantity"), number(x, 2).alias("unit_price"), F.round(number(x, 1) * number(x, 2), 2).alias("amount")))
    printed = F.flatten(F.transform(_lines(text), lambda x: amounts_on(x)))
    return F.filter(rows, lambda r: F.exists(printed, lambda v: F.abs(v - r["amount"]) <= 0.03))


def amount_to_pay(text: Column, expected: Column) -> Column:
    """What a receipt asks for: beside its label, else net and VAT, else cash less change."""
    label = "(?i)amount\\s+to\\s+pay"
    own = F.flatten(F.transform(F.filter(_lines(text), lambda x: x.rlike(label)), lambda x: amounts_on(x)))
    cash, change = (F.get(labelled(text, w), F.lit(0)) for w in ("(?i)\\bcash\\b", "(?i)\\bchange\\b"))
    paid = F.when(cash - change > 0, F.round(cash - change, 2))
    return F.coalesce(F.get(own, F.lit(0)), F.round(expected, 2), paid)


def hints(text: Column) -> Column:
    """What a text says outright, before any reading of it: a map of field to value."""
    return let(_lines(text), lambda lines: _hints(text, lines))


def _hints(text: Column, lines: Column) -> Column:
    first = lambda label, exclude=None: F.get(labelled_in(lines, label, exclude), F.lit(0)).cast("string")
    pairs = {"total_amount": first(TOTAL_LABELS, NOT_TOTAL), "subtotal": first(SUBTOTAL_LABELS), "tax_amount": first("(?i)\\b(?:vat|tax)\\b", "(?i)vatable|exempt|zero|reg|tin|net of|excl"), "vendor_name": business_line(text), "vendor_tax_id": F.get(F.regexp_extract_all(blank(text), F.lit(TIN), F.lit(1)), F.lit(0))}
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values())), lambda k, v: v.isNotNull())


def second_pass(df: DataFrame) -> Column:
    """Why a document deserves a costlier reading; empty if it does not."""
    c = Cells(df)
    charges, bill = consistency(df)
    engine = F.lower(blank(c("engine")))
    reasons = [(F.contains(engine, F.lit("trocr")) | F.contains(engine, F.lit("handwrit")), "written by hand"), (c.number("ocr_confidence") < 0.75, "the reading is uncertain")]
    reasons += [(c.missing(f), f"missing {f}") for f in ("invoice_number", "invoice_date", "vendor_name", "total_amount")]
    reasons.append((~F.coalesce(charges, F.lit(True)) | ~F.coalesce(bill, F.lit(True)), "amounts do not add up"))
    if "line_items" in c.types:
        reasons += [(~F.coalesce(items_consistent(F.col("line_items")), F.lit(True)), "an item does not multiply out"), (F.coalesce(F.size("line_items"), F.lit(0)) <= 0, "no items were read")]
    return F.array_compact(F.array(*[F.when(rule, why) for rule, why in reasons]))


def after_edit(evidence: Column, old: Column, new: Column) -> Column:
    """Evidence maps after an edit: a changed field is a manual edit, a changed category derived. old, new: maps of texts."""
    edit = lambda k: F.struct(F.lit(None).cast("double").alias("score"), F.when(k == "category", "derived").otherwise("manual_edit").alias("status"), F.when(k == "category", "manual_category").otherwise("user_edit").alias("source"))
    changed = F.map_filter(new, lambda k, v: ~F.element_at(old, k).eqNullSafe(v))
    marks = F.transform_values(changed, lambda k, v: edit(k))
    kept = F.map_filter(evidence, lambda k, v: ~F.map_contains_key(changed, k))
    return F.map_concat(kept, marks).cast(EVIDENCE)


def nearest_tin(rows: DataFrame, master: DataFrame, bits: int = 3, share: float = 0.8) -> DataFrame:
    """Repair (id, vendor_tax_id, vendor_address) from a master (tin, address): at most three wrong digits and most words of the address.

    A row that has so many of an address's words has at least one of any few that are more than may be missing: the rarest
    of the master file are taken. Digits that differ in so many places are the same in one of one piece more. Rows meet
    masters where both agree, and only then words and digits are counted.
    """
    base = lambda c: F.substring(F.regexp_replace(blank(F.col(c)), "[^0-9]", ""), 1, 9)
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(blank(F.col(c))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 4))
    known = master.select(F.col("tin").alias("m_tin"), base("tin").alias("m_base"), words("address").alias("m_words")).filter((F.length("m_base") == 9) & (F.size("m_words") > 0))
    asked = rows.select("id", base("vendor_tax_id").alias("base"), words("vendor_address").alias("words")).filter(F.length("base") == 9)
    asked = asked.join(known.select(F.col("m_base").alias("base")), "base", "left_anti")
    each = known.select("m_tin", "m_base", "m_words", F.explode("m_words").alias("w"))
    often = each.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    missing = F.size("m_words") - F.greatest(F.ceil(F.size("m_words") * F.lit(share) - 1e-9), F.lit(1))
    kept = each.join(often, "w").groupBy("m_tin", "m_base", "m_words").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("by"))
    kept = materialize(kept.select("m_tin", "m_base", "m_words", F.explode(F.transform(F.slice("by", F.lit(1), (missing + 1).cast("int")), lambda x: x["w"])).alias("w")), "master_words")
    start = lambda i: F.lit(9 * i // (bits + 1) + 1)
    pieces = lambda c: F.explode(F.array(*[F.concat(F.lit(f"{i}:"), F.substring(F.col(c), start(i), start(i + 1) - start(i))) for i in range(bits + 1)])).alias("piece")
    some = asked.select("id", "base", "words", F.explode("words").alias("w")).join(kept.select("w").distinct(), "w", "left_semi")
    met = some.select("id", "base", "words", "w", pieces("base")).join(kept.select("*", pieces("m_base")), ["w", "piece"])
    score = met.withColumn("hit", F.size(F.array_intersect("m_words", "words")) / F.size("m_words")).filter(F.col("hit") >= share)
    wrong = F.size(F.filter(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substring(F.col("base"), i, F.lit(1)) != F.substring(F.col("m_base"), i, F.lit(1))))
    near = score.withColumn("wrong", wrong).filter(F.col("wrong") <= bits).select("id", "m_tin", "hit", "wrong").distinct()
    rank = F.struct(F.col("wrong"), (-F.col("hit")).alias("h"))
    best = near.groupBy("id").agg(F.min(rank).alias("best"))
    one = near.withColumn("rank", rank).join(best, "id").filter("rank = best").groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("m_tin").alias("m_tin")).filter("k = 1")
    return rows.join(one.select("id", "m_tin"), "id", "left").withColumn("vendor_tax_id", F.coalesce("m_tin", "vendor_tax_id")).drop("m_tin")


def isolate_address(vendor: Column, customer: Column) -> Column:
    """A seller's address without the comma-separated parts that are the buyer's."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(blank(x)), "[^\\p{L}\\p{N}]+", " "))
    parts = F.transform(F.split(blank(vendor), ","), lambda x: F.trim(x))  # a bare F.trim would take the index for the characters to trim
    kept = F.filter(parts, lambda p: ~F.contains(norm(customer), norm(p)) | (F.length(norm(p)) < 4))
    return F.when(vendor.isNotNull(), F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(vendor))


STEPS = (fill_amounts, vendor_name, invoice_number, invoice_date, customer_name, tax_ids)


def settle_parties(df: DataFrame) -> DataFrame:
    """The party and header rules in order."""
    for step in STEPS:
        df = df.transform(step)
    return df
