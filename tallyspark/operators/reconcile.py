"""Reconciliation: a printed fact replaces a read one only where exactly one candidate fits.

Each step takes a table of invoices and returns it with the field settled and a note in
``notes``; ``STEPS`` is their order, which matters (a swap before the subtotal, that before the rest).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import amount_in_text, blank, let, normalize_tin
from tallyspark.operators.quality import cents, off
from tallyspark.operators.text import amounts_on, only_one

TOTAL_LABELS = "(?i)\\b(?:grand\\s*total|total\\s*(?:amount)?\\s*(?:due)?|amount\\s*due)\\b"
NOT_TOTAL = "(?i)sub\\s*-?total|vatable|total\\s*(?:sales|items|qty|discount|vat|savings)|zero|exempt"
CASH = "(?i)\\b(?:cash|change|tendered|payment)\\b"
SUBTOTAL_LABELS = "(?i)\\b(?:sub\\s*-?total|vatable\\s*sales?|net\\s*amount|amount\\s*net\\s*of\\s*vat)\\b"
SENIOR = "(?i)\\b(?:senior|pwd|discount)"
TABLE_HEADER = "(?i)^(?:qty|quantity|unit(?:\\s*price)?|description|item|amount|price|particulars|total)(?:[\\s/|]+(?:qty|quantity|unit(?:\\s*price)?|description|item|amount|price|particulars|total))*$"
SUMMARY = "(?i)^(?:sub\\s*-?total|total|grand\\s*total|vat(?:able)?(?:\\s*sales)?|vat\\s*exempt.*|zero\\s*rated.*|less.*vat|amount\\s*due|cash|change|12\\s*%\\s*vat|withholding\\s*tax|net\\s*amount)\\b.*$"
BARE = "^[0-9][0-9.,\\-/ ]*$"
FORM = "(?i)^(?:received\\s*by|prepared\\s*by|sold\\s*to|authori[sz]ed\\s*signature|date|tin|address|terms|nothing\\s*follows.*|\\*+.*\\*+)\\s*:?\\s*$"
REFERENCE = "(?i)^(?:ref(?:erence)?|p\\.?o\\.?|d\\.?r\\.?|account|invoice)\\s*(?:no\\.?|number|#)\\s*:?.*$"
PLATE = "(?i)\\b(?:plate|vehicle\\s*plate)\\s*(?:no\\.?|number|#)?\\s*:?\\s*([A-Z]{2,3}[- ]?[0-9]{3,4})\\b"


def _lines(text: Column) -> Column:
    return F.split(blank(text), "\n")


def labelled(text: Column, label: str, exclude: str | None = None) -> Column:
    """Last amounts of the lines with a label; of the line below where a label stands alone."""
    return let(_lines(text), lambda lines: labelled_in(lines, label, exclude))


def labelled_in(lines: Column, label: str, exclude: str | None = None) -> Column:
    """The same over lines that are cut already."""
    at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: let(F.element_at(lines, i), lambda x: x.rlike(label) & (~x.rlike(exclude) if exclude else F.lit(True))))

    def value(i: Column) -> Column:
        below = F.get(amounts_on(F.get(lines, i)), F.lit(0))
        return let(amounts_on(F.element_at(lines, i)), lambda here: F.when(F.size(here) > 0, F.element_at(here, -1)).otherwise(below))

    return F.array_compact(F.transform(at, value))


def _settle(df: DataFrame, field: str, value: Column, when: Column, note: str) -> DataFrame:
    """Set a field where a condition holds, and note it. The decision is a column of its own first: inside a
    lambda function, a name that the same projection redefines would stand for the new value."""
    decided = df.withColumns({"__when": F.coalesce(when, F.lit(False)), "__value": value})
    notes = F.coalesce("notes", F.array().cast("array<string>")) if "notes" in df.columns else F.array().cast("array<string>")
    noted = F.when(F.col("__when"), F.array_append(notes, F.lit(f"{field}: {note}"))).otherwise(notes)
    return decided.withColumns({"notes": noted, field: F.when(F.col("__when"), F.col("__value")).otherwise(F.col(field))}).drop("__when", "__value")


def tax(df: DataFrame) -> DataFrame:
    """Fill a tax of nothing from the one amount that tax lines print."""
    found = only_one(labelled(F.col("text"), "(?i)\\b(?:vat|tax)\\b", "(?i)vatable|exempt|zero|reg|tin|net of|excl"))
    empty = F.coalesce(F.col("tax_amount") == 0, F.lit(True))
    df = _settle(df, "tax_amount", found, found.isNotNull() & empty, "taken from its label")
    return df


def swapped(df: DataFrame) -> DataFrame:
    """Subtotal above total at a plausible tax rate, both printed, no discount in sight: they changed places."""
    t, s = F.col("total_amount"), F.col("subtotal")
    rate = s / t - 1
    when = (t > 0) & (rate > 0) & (rate <= 0.25) & amount_in_text(F.col("text"), t) & amount_in_text(F.col("text"), s) & ~blank(F.col("text")).rlike(SENIOR)
    df = df.withColumn("__t", t)
    df = _settle(df, "total_amount", s, when, "exchanged with subtotal")
    return df.withColumn("subtotal", F.when(F.coalesce(F.col("total_amount") != F.col("__t"), F.lit(False)), F.col("__t")).otherwise(s)).drop("__t")


def plausible_subtotal(s: Column, total: Column) -> Column:
    return (s > 0) & (s <= total) & (s >= 0.5 * total)


def subtotal(df: DataFrame) -> DataFrame:
    """A missing subtotal from its label, or from total - tax + discount if that is printed; only if one value results."""
    c = F.col
    total = c("total_amount")
    derived = (cents(total) - cents(F.coalesce("tax_amount", F.lit(0.0))) + cents(F.coalesce("discount", F.lit(0.0)))).cast("double")
    own = F.filter(labelled(c("text"), SUBTOTAL_LABELS), lambda v: plausible_subtotal(v, total))
    found = only_one(F.concat(own, F.array(F.when(amount_in_text(c("text"), derived) & plausible_subtotal(derived, total) & (c("tax_amount") > 0), derived))))
    return _settle(df, "subtotal", found, c("subtotal").isNull() & found.isNotNull(), "taken from print")


def total(df: DataFrame) -> DataFrame:
    """A total that is only a cash or change figure gives way to the one amount on a total line."""
    c = F.col("total_amount")
    has = lambda values: F.exists(values, lambda v: F.abs(v - c) < 0.005)
    totals = labelled(F.col("text"), TOTAL_LABELS, NOT_TOTAL)
    found = only_one(totals)
    return _settle(df, "total_amount", found, has(labelled(F.col("text"), CASH)) & ~has(totals) & found.isNotNull(), "was a payment, not the total")


def tax_identity(df: DataFrame) -> DataFrame:
    """A tax that breaks the sum where 12 % of the subtotal mends it and is printed."""
    c = F.col
    want = F.round(c("subtotal") * 0.12, 2)
    mends = ~off(c("subtotal") + want, c("total_amount"), 0.02) & off(c("subtotal") + F.coalesce("tax_amount", F.lit(0.0)), c("total_amount"), 0.02)
    return _settle(df, "tax_amount", want, mends & amount_in_text(c("text"), want), "12 % of subtotal")


def plate(df: DataFrame) -> DataFrame:
    """A plate only from an explicit label."""
    found = F.regexp_extract(blank(F.col("text")), PLATE, 1)
    return _settle(df, "plate_number", F.upper(found), (found != "") & F.col("plate_number").isNull(), "taken from its label")


def number_letters(df: DataFrame) -> DataFrame:
    """A leading letter O before digits is a zero."""
    n = F.col("invoice_number")
    return _settle(df, "invoice_number", F.regexp_replace(n, "^[Oo](?=[0-9]{4,}$)", "0"), n.rlike("^[Oo][0-9]{4,}$"), "letter O read for zero")


def tins(df: DataFrame) -> DataFrame:
    return df.withColumns({c: normalize_tin(F.col(c)) for c in ("vendor_tax_id", "customer_tax_id") if c in df.columns})


STEPS: tuple[Callable[[DataFrame], DataFrame], ...] = (swapped, total, tax, subtotal, tax_identity, plate, number_letters, tins)


def reconcile(df: DataFrame) -> DataFrame:
    """All steps in order."""
    for step in STEPS:
        df = df.transform(step)
    return df


def item_class(description: Column) -> Column:
    """What a row that is no item is; null for an item."""
    d = F.trim(blank(description))
    return F.when(d.rlike(TABLE_HEADER), "table header").when(d.rlike(SUMMARY), "summary").when(d.rlike(BARE), "bare number").when(d.rlike(FORM), "form label").when(d.rlike(REFERENCE), "reference")


def clean_items(items: Column) -> Column:
    return F.filter(items, lambda x: item_class(x["description"]).isNull())


def weakest_amount(df: DataFrame) -> DataFrame:
    """Add the one amount that the others determine, where the sum is off and only one value is not printed."""
    fields = ("subtotal", "tax_amount", "discount", "total_amount")
    d = {f: cents(F.coalesce(F.col(f), F.lit(0.0))) for f in fields}
    gap = d["subtotal"] + d["tax_amount"] - d["discount"] - d["total_amount"]
    sign = {"subtotal": -1, "tax_amount": -1, "discount": 1, "total_amount": 1}
    options = F.array(*[F.when(~amount_in_text(F.col("text"), F.col(f)), F.struct(F.lit(f).alias("field"), (d[f] + gap * sign[f]).cast("double").alias("value"))) for f in fields])
    doubtful = F.array_compact(options)
    printed = lambda x: amount_in_text(F.col("text"), x["value"])
    return df.withColumn("repair", F.when((F.abs(gap) > F.lit(0.02).cast("decimal(18,4)")) & (F.size(doubtful) == 1) & printed(doubtful[0]), doubtful[0]))


def by_tin(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Canonical names from a vendor master by the first nine digits of the tax id; the master's first entry wins."""
    digits = lambda c: F.substring(F.regexp_replace(blank(F.col(c)), "[^0-9]", ""), 1, 9)
    first = master.withColumn("__base", digits("tin")).filter(F.length("__base") == 9).groupBy("__base").agg(F.min_by("name", "rank").alias("canonical_name"))
    return rows.withColumn("__base", digits("vendor_tax_id")).join(first, "__base", "left").drop("__base")
