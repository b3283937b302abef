"""Validation rules, consistency checks and confidence of an extracted invoice, one Column each.

Every rule adds at most one note to an array; a row without notes is valid. ``today`` is a
parameter, so results do not depend on the day they run.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import CURRENCIES, amount_in_text, blank, clamp, finite_number, is_missing, let, says

# ---- fixed values -----------------------------------------------------------------------------
REQUIRED = ("invoice_number", "invoice_date", "vendor_name", "total_amount", "currency")
MONEY = ("subtotal", "tax_amount", "total_amount", "discount", "withholding_tax", "zero_rated_sales", "vat_exempt_sales", "current_charges_total", "previous_balance")
FORM_LABELS = ("received by", "sold to", "bill to", "billed to", "customer", "registered name", "business address", "business name", "customer signature over printed name", "attention")
NUMBER_LABELS = ("accreditation", "authority to print", "ll no", "permit no", "atp no", "loose-leaf", "looseleaf")
CARRIED = ("remaining balance", "previous balance", "carried balance", "balance forward")
CREDIT = "(?i)\\b(?:remaining balance|previous balance|carried balance|balance forward|credits?|adjustments?|discounts?|subsidies|rebates?)\\b"
CHECKBOXES = ("cash sales", "charge sales", "cash sale", "charge sale", "cash", "charge")
GARBLED = 7  # consonants in a row
CONFIDENT = 0.75
#: Notes that are about fields which they do not name.
ABOUT = {
    "amounts do not add up to the charges": ("subtotal", "discount"),
    "current charges and previous balance are not the total": ("current_charges_total", "previous_balance", "total_amount"),
    "subtotal is missing": ("subtotal", "total_amount"),
    "total_amount is not in the text": ("total_amount", "subtotal"),
    "due date does not fit the terms": ("invoice_date",),
    "amounts are not numbers": ("subtotal",),
}
#: Parts of a document's score: where it begins, and what reading, completeness, sums and notes change.
BASE_SCORE, BY_OCR, BY_COMPLETENESS = 0.52, 0.20, 0.18
SUMS_HOLD, SUMS_FAIL = {"charges": 0.07, "bill": 0.03, "items": 0.03}, {"charges": 0.14, "bill": 0.10, "items": 0.06}
BY_NOTE, MOST_BY_NOTES, HAND_ONLY, HAND_TOO = 0.15, 0.5, 0.25, 0.08
#: Parts of a field's score.
FIELD_BASE, UNNAMED, FIELD_SUMS_FAIL, BILL_HOLDS, KEY_FIELD, NAMED_SHARE = 0.66, 0.06, 0.18, 0.04, 0.03, 0.58
KEY_FIELDS = ("invoice_number", "invoice_date", "vendor_name", "vendor_tax_id")
SCORED = (*REQUIRED, "vendor_tax_id", "customer_name", "customer_address", "subtotal", "tax_amount", "discount", "withholding_tax", "zero_rated_sales", "vat_exempt_sales", "current_charges_total", "previous_balance")
# -----------------------------------------------------------------------------------------------


class Cells:
    """Columns of a row; one that the table lacks is null."""

    def __init__(self, df: DataFrame):
        self.types = dict(df.dtypes)

    def __call__(self, name: str) -> Column:
        return F.col(name) if name in self.types else F.lit(None).cast("string")

    def number(self, name: str) -> Column:
        return finite_number(self(name)) if name in self.types else F.lit(None).cast("double")

    def or_zero(self, name: str) -> Column:
        return F.coalesce(self.number(name), F.lit(0.0))

    def missing(self, name: str) -> Column:
        return is_missing(self(name).cast("string"))


def cents(c: Column) -> Column:
    """Amounts compare as decimals, so a tolerance of two cents is two cents."""
    return c.cast("decimal(18,4)")


def off(a: Column, b: Column, by: float) -> Column:
    return F.abs(cents(a) - cents(b)) > F.lit(by).cast("decimal(18,4)")


def identity_total(c: Cells) -> Column:
    plus = [c.number("subtotal"), *(c.or_zero(n) for n in ("tax_amount", "zero_rated_sales", "vat_exempt_sales"))]
    return reduce(lambda a, b: a - b, [cents(c.or_zero(n)) for n in ("discount", "withholding_tax")], reduce(lambda a, b: a + b, map(cents, plus)))


def residual(df: DataFrame) -> Column:
    """How far the printed amounts are from adding up."""
    c = Cells(df)
    return F.abs(identity_total(c) - cents(F.coalesce(c.number("current_charges_total"), c.number("total_amount")))).cast("double")


def _is_form_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(blank(c))), "\\s*:+\\s*$", "").isin(*FORM_LABELS)


def _garbled(c: Column) -> Column:
    return blank(c).rlike(f"[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{{{GARBLED},}}")


def _sales(items: Column) -> Column:
    return F.filter(items, lambda x: ~F.trim(F.lower(blank(x["description"]))).isin(*CARRIED))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("decimal(18,4)"), lambda s, x: (s + F.coalesce(cents(x["amount"]), F.lit(0).cast("decimal(18,4)"))).cast("decimal(18,4)"))


def _item_notes(items: Column) -> Column:
    def notes(x: Column, i: Column) -> Column:
        read = F.struct(*[finite_number(x[f]).alias(f) for f in ("quantity", "unit_price", "amount")], F.trim(blank(x["description"])).alias("desc"))
        return let(read, lambda n: noted(x, i, n, n["desc"]))

    def noted(x: Column, i: Column, n: Column, desc: Column) -> Column:
        at = F.concat(F.lit("item "), (i + 1).cast("string"), F.lit(": "))
        credit = desc.rlike(CREDIT)
        rules = [(n[f].isNull(), f"{f} is not a number") for f in ("quantity", "unit_price", "amount")]
        rules += [((n["quantity"] < 0), "quantity is negative"), ((n["unit_price"] < 0) & ~credit, "unit_price is negative"), ((n["amount"] < 0) & ~credit, "amount is negative")]
        product = (F.round(n["quantity"] * n["unit_price"], 2)).cast("decimal(18,4)")
        rules.append((F.abs(product - cents(n["amount"])) > F.lit(0.02).cast("decimal(18,4)"), "quantity * unit_price is not amount"))
        rules.append((is_missing(x["description"]), "description is missing"))
        kind = F.when(desc == "", None).when(desc.rlike("^[0-9][0-9.,\\-/ ]*$"), "description is a bare number").when(desc.rlike("(?i)nothing\\s*follows"), "description is the end-of-table mark")
        kind = kind.when(F.lower(desc).isin(*CHECKBOXES), "description is a form option").when(_garbled(desc), "description is garbled")
        return F.transform(F.array_compact(F.array(*[F.when(c, m) for c, m in rules], kind)), lambda m: F.concat(at, m))

    return F.flatten(F.transform(items, notes))


def issues(df: DataFrame, today: date, text: Column | None = None, template: str | None = None) -> Column:
    """The notes of all rules, in order."""
    c = Cells(df)
    n = c.number
    out: list[tuple[Column, str]] = [(c.missing(f), f"missing {f}") for f in REQUIRED]
    for f in ("invoice_date", "due_date"):
        if f in c.types:
            day = F.col(f) if c.types[f] == "date" else F.when(F.col(f).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(F.col(f), F.lit("yyyy-MM-dd")).cast("date"))
            if f == "invoice_date":
                out.append((day > F.lit(today), "the invoice date lies after today"))
            if c.types[f] == "string":
                out.append((~c.missing(f) & day.isNull(), f"{f} is not a date"))
    for f in MONEY:
        if f in c.types:
            out.append((c(f).isNotNull() & n(f).isNull(), f"{f} is not a finite number"))
            if f != "previous_balance":
                out.append((n(f) < 0, f"{f} is negative"))
    total, sub, current, before = n("total_amount"), n("subtotal"), n("current_charges_total"), n("previous_balance")
    out.append((n("tax_amount") > total, "there is more tax than total"))
    out.append(((total < 0) & (sub >= 0) & (current.isNull() | before.isNull() | off(current + before, total, 0.05)), "negative total does not reconcile"))
    out.append((total <= 0, "total_amount is not above 0"))
    if text is not None:
        out.append(((total > 0) & (blank(text) != "") & ~amount_in_text(text, total), "total_amount is not in the text"))
    target = F.coalesce(current, total)
    out.append((F.abs(identity_total(c) - cents(target)) > F.lit(0.02).cast("decimal(18,4)"), "amounts do not add up to the charges"))
    out.append((sub.isNotNull() & off(current + before, total, 0.02), "current charges and previous balance are not the total"))
    words = [c(f).isNotNull() & n(f).isNull() for f in ("tax_amount", "zero_rated_sales", "vat_exempt_sales", "discount", "withholding_tax") if c.types.get(f) == "string"]
    if words:
        out.append((c("subtotal").isNotNull() & target.isNotNull() & reduce(lambda a, b: a | b, words), "amounts are not numbers"))
    out.append((sub.isNull() & (total > 0), "subtotal is missing"))
    out.append(((blank(c("currency")) != "") & ~c("currency").isin(*CURRENCIES), "currency is not a code"))
    number = F.trim(blank(c("invoice_number").cast("string")))
    boiler = reduce(lambda a, b: a | b, [F.contains(F.lower(number), F.lit(x)) for x in NUMBER_LABELS])
    money_like = number.rlike("^[$₱P]?[0-9]{1,3}(,[0-9]{3})*\\.[0-9]{2}$") & ~boiler
    as_amount = F.regexp_replace(number, "[$₱P,]", "").try_cast("double")
    same = reduce(lambda a, b: a | b, [F.coalesce(~off(as_amount, n(f), 0.0099), F.lit(False)) for f in ("total_amount", "subtotal", "tax_amount")])
    out += [(boiler, "invoice_number is a printer's permit"), (money_like & same, "invoice_number is one of the amounts"), (money_like & ~same, "invoice_number looks like an amount")]
    out += [(_is_form_label(c("vendor_name")), "vendor_name is a form label"), (~_is_form_label(c("vendor_name")) & _garbled(c("vendor_name")), "vendor_name is garbled"), (_is_form_label(c("customer_name")), "customer_name is a form label")]
    notes = F.array_compact(F.array(*[F.when(rule, note) for rule, note in out]))
    if "line_items" in c.types:
        items = F.coalesce("line_items", F.array().cast(c.types["line_items"]))
        # the items that are sales, and their sum, are worked out once for a row
        added = let(_sales(items), lambda sales: F.struct(sales.alias("items"), _sum(sales).alias("sum")))
        adjusts = lambda x: says(x["description"], ("adjustment current bill", "adjustments current bill"))

        def weighed(sales: Column) -> Column:
            sum_ = sales["sum"]
            other = F.exists(sales["items"], lambda x: (x["amount"] > 0) & (sum_ - cents(x["amount"]) > 0) & (F.abs(sum_ - cents(x["amount"]) - cents(x["amount"])) < F.lit(0.01).cast("decimal(18,4)")))
            unequal = F.abs(sum_ - cents(sub)) > F.lit(0.02).cast("decimal(18,4)")
            # words are read only where sums differ, and an adjustment would explain it
            bridge = unequal & ~off(sum_ + cents(n("tax_amount")), current, 0.02) & F.exists(sales["items"], adjusts)
            marks = [F.when((F.size(items) >= 2) & other, "an item equals the sum of the others")]
            if template != "retail":
                marks.append(F.when((F.size(items) > 0) & unequal & ~F.coalesce(bridge, F.lit(False)), "items do not add up to subtotal"))
            return F.array_compact(F.array(*marks))

        notes = F.concat(notes, _item_notes(items), let(added, weighed))
    days = F.regexp_extract(blank(c("payment_terms")), "(?i)net\\s*([0-9]{1,3})", 1).try_cast("int")
    terms = F.when(F.datediff(c("due_date").try_cast("date"), c("invoice_date").try_cast("date")) != days, "due date does not fit the terms")
    if template == "retail":
        vat = c.or_zero("tax_amount")
        retail = [F.when(off(sub, total - vat, 0.01), "net is not the total less VAT"), F.when(off(total, sub + vat, 0.01), "the total is not net and VAT")]
        if "line_items" in c.types:
            summed = F.aggregate("line_items", F.lit(0).cast("decimal(18,4)"), lambda s, x: (s + F.coalesce(cents(x["amount"]), F.lit(0).cast("decimal(18,4)"))).cast("decimal(18,4)"))
            retail.append(F.when(F.abs(summed - cents(c.or_zero("discount")) - cents(total)) > F.lit("0.01").cast("decimal(18,4)"), "items less discount are not the total"))
        return F.concat(notes, F.array_compact(F.array(terms, *retail)))
    return F.concat(notes, F.array_compact(F.array(terms)))


def consistency(df: DataFrame) -> tuple[Column, Column]:
    """Whether the charges add up, and whether the bill does; null where that cannot be told."""
    c = Cells(df)
    total, current, before = (c.number(f) for f in ("total_amount", "current_charges_total", "previous_balance"))
    near = lambda a, b: F.abs(cents(a) - cents(b)) <= cents(F.greatest(F.lit(0.05), F.abs(b) * 0.002))
    charges = F.when(c.number("subtotal").isNotNull() & total.isNotNull(), near(identity_total(c), F.coalesce(current, total)))
    return charges, F.when(charges.isNotNull() & current.isNotNull() & before.isNotNull(), near(current + before, total))


def items_consistent(items: Column) -> Column:
    """Whether every item that can be checked multiplies out; null if none can."""
    checked = F.filter(_sales(items), lambda x: (x["quantity"] > 0) & (x["unit_price"] >= 0) & (x["amount"] >= 0))
    fits = F.forall(checked, lambda x: F.abs(x["quantity"] * x["unit_price"] - x["amount"]) <= F.greatest(F.lit(0.05), F.abs(x["amount"]) * 0.01))
    return F.when(F.size(checked) > 0, fits)


def about(issues: Column, field: str, charged: Column | None = None) -> Column:
    """Whether a note is about a field: by its name, or because of what the note compares."""
    notes = [n for n, fields in ABOUT.items() if field in fields]
    hit = F.exists(issues, lambda n: F.contains(n, F.lit(field)) | (n.isin(*notes) if notes else F.lit(False)))
    return hit if charged is None else hit | (charged & F.array_contains(issues, "amounts do not add up to the charges"))


def scored(df: DataFrame, issues_col: str = "issues", ocr_col: str = "ocr_confidence", engine_col: str = "engine") -> DataFrame:
    """Add confidence, needs_review and field_confidences; cells of items follow the fields where the table has evidence of them."""
    c = Cells(df)
    # columns of their own, which many fields read: an expression would be worked out again for each
    charges, bill = consistency(df)
    seen = {"__ocr": clamp(F.coalesce(F.col(ocr_col), F.lit(0.0))), "__charges": charges, "__bill": bill, "__items": items_consistent(F.col("line_items")) if "line_items" in c.types else F.lit(None).cast("boolean")}
    engines = F.split(blank(c(engine_col)), "\\+")
    seen |= {"__hand": F.array_contains(engines, "trocr"), "__alone": F.size(F.array_distinct(engines)) == 1}
    charged = {"current_charges_total": c("current_charges_total").isNotNull(), "total_amount": c("current_charges_total").isNull()}
    seen |= {f"__no_{f}": c.missing(f) for f in SCORED} | {f"__hit_{f}": about(F.col(issues_col), f, charged.get(f)) for f in SCORED}
    kept, df = df.columns, df.withColumns(seen)
    ocr, hand, flags = F.col("__ocr"), F.col("__hand"), {k: F.col(f"__{k}") for k in ("charges", "bill", "items")}
    present = reduce(lambda a, b: a + b, [F.when(F.col(f"__no_{f}"), 0).otherwise(1) for f in REQUIRED])
    score = F.lit(BASE_SCORE) + BY_OCR * ocr + BY_COMPLETENESS * present / len(REQUIRED)
    for name, flag in flags.items():
        score = score + F.when(flag, SUMS_HOLD[name]).when(~flag, -SUMS_FAIL[name]).otherwise(0.0)
    score = score - F.least(F.lit(MOST_BY_NOTES), BY_NOTE * F.size(issues_col)) - F.when(hand & F.col("__alone"), HAND_ONLY).when(hand, HAND_TOO).otherwise(0.0)

    def of(field: str) -> Column:
        hit, missing = F.col(f"__hit_{field}"), F.col(f"__no_{field}")
        conf = F.lit(FIELD_BASE) + BY_OCR * ocr + F.when(hit, 0.0).otherwise(UNNAMED + (KEY_FIELD if field in KEY_FIELDS else 0.0))
        if field in MONEY:
            conf = conf + F.when(flags["charges"], SUMS_HOLD["charges"]).when(~flags["charges"], -FIELD_SUMS_FAIL).otherwise(0.0)
        if field in ("current_charges_total", "previous_balance", "total_amount"):
            conf = conf + F.when(flags["bill"], BILL_HOLDS).otherwise(0.0)
        held = let(conf, lambda x: F.round(clamp(F.when(hit, x * NAMED_SHARE).otherwise(x)), 3))
        return F.struct(F.lit(field).alias("field"), c(field).cast("string").alias("value"), F.when(missing, 0.0).otherwise(held).alias("confidence"), F.when(missing, "missing").otherwise("final_evidence").alias("source"))

    fields = F.array(*[of(f) for f in SCORED])
    if c.types.get("item_evidence", "").startswith("map<string,struct<score:double"):
        cells = F.map_entries(F.coalesce("item_evidence", F.create_map().cast(c.types["item_evidence"])))
        fields = F.concat(fields, F.transform(cells, lambda e: F.struct(e["key"].alias("field"), F.lit(None).cast("string").alias("value"), F.coalesce(e["value"]["score"], F.lit(0.0)).alias("confidence"), F.lit("unverified").alias("source"))))
    out = df.withColumns({"confidence": F.round(clamp(score), 3), "field_confidences": fields})
    review = (F.col("confidence") < CONFIDENT) | (F.size(issues_col) > 0) | hand
    new = {"confidence": F.col("confidence"), "needs_review": review, "field_confidences": F.col("field_confidences")}
    return out.select(*[F.col(k) for k in kept if k not in new], *[x.alias(k) for k, x in new.items()])


def low_confidence(c: Column, least: float = CONFIDENT) -> Column:
    return F.transform(F.filter(c, lambda x: x["confidence"] < least), lambda x: x["field"])


def text_support(value: Column, text: Column) -> Column:
    """How well a text backs a value: on one line, across lines, or most of its words."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(blank(x)), "[^\\p{L}\\p{N}]+", " "))
    want, flat = norm(value), norm(text)
    lines = F.transform(F.split(blank(text), "\n"), norm)
    words = F.array_distinct(F.split(want, " "))
    share = F.size(F.filter(words, lambda w: F.array_contains(F.split(flat, " "), w))) / F.size(words)
    return F.when(F.length(want) <= 2, 0.0).when(F.exists(lines, lambda x: F.contains(x, want)), 1.0).when(F.contains(flat, want), 0.85).when(share >= 0.85, 0.62).otherwise(0.0)


def number_support(value: Column, text: Column, by: float = 0.005) -> Column:
    """Whether an amount is printed, up to rounding."""
    printed = F.transform(F.regexp_extract_all(blank(text), F.lit("[0-9][0-9,]*(?:\\.[0-9]+)?"), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    return F.exists(printed, lambda v: F.abs(v - F.abs(value)) <= by)


def field_evidence(df: DataFrame, fields: tuple[str, ...], text: Column) -> Column:
    """Map of field to how the text backs it."""
    c = Cells(df)

    def entry(f: str) -> Column:
        score = F.when(c.missing(f), 0.0).otherwise(F.when(number_support(c.number(f), text), 1.0).otherwise(0.0) if f in MONEY else text_support(c(f).cast("string"), text))
        status = F.when(c.missing(f), "missing").when(score >= 0.85, "supported").when(score > 0, "partial").otherwise("unsupported")
        return F.struct(F.lit(f), F.struct(score.alias("score"), status.alias("status")))

    return F.map_from_entries(F.array(*[entry(f) for f in fields]))


def storage_defaults(df: DataFrame) -> DataFrame:
    """What is stored for what was not found; stand-in numbers come from the row's id, so reruns agree."""
    fills = {f: F.coalesce(F.col(f), F.lit(0.0)) for f in ("tax_amount", "discount", "withholding_tax", "zero_rated_sales", "vat_exempt_sales") if f in df.columns}
    number = F.when(is_missing(F.col("invoice_number")), F.concat(F.lit("UNVERIFIED-"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 10))).otherwise(F.col("invoice_number"))
    return df.withColumns(fills | {"invoice_number": number, "vendor_name": F.when(is_missing(F.col("vendor_name")), "UNKNOWN VENDOR").otherwise(F.col("vendor_name"))})
