"""Which party a printed text belongs to, and what statements and receipts say about their own amounts.

Rules over a row's text, as columns: a value moves only where the page says so in one way. Names and
addresses of the head of a page are the seller's; what stands beside staff, printers or terminals is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import blank, let, normalize_tin, parse_date, says, says_in, spaced
from tallyspark.operators.documents import TIN, business_line
from tallyspark.operators.quality import cents
from tallyspark.operators.reconcile import _lines
from tallyspark.operators.text import amounts_on, only_one

# ---- fixed values -----------------------------------------------------------------------------
TERMINAL = "(?i)\\b(?:ptu|acc(?:r(?:editation)?)?\\s*(?:no)?\\s*:|pos\\s*provider|min\\s*#?\\s*:)"
STAFF = "(?i)\\b(?:cashier|served\\s*by|serviced\\s*by)\\b"
PRINTER = "(?i)authority\\s*to\\s*print|date\\s*of\\s*atp|printer'?s?\\s*accreditation|accreditation\\s*date|nonvat\\s*reg"
BUYER = "(?i)\\b(?:bill(?:ed)?\\s*to|sold\\s*to|ship\\s*to|customer|buyer|client|account\\s*(?:name|number))\\b"
HEAD_ENDS = "(?i)\\b(?:vat\\s*reg|tin\\b|service\\s*invoice|sales\\s*invoice|official\\s*receipt|serial\\s*#|invoice\\s*no)"
PLACE = "(?i)\\b(?:street|st\\.|avenue|ave\\.?|road|rd\\.?|tower|bldg|building|floor|city|barangay|brgy\\.?|district|highway|philippines)\\b"
CONTACT = "(?i)\\b(?:tel(?:ephone)?\\.?|fax|e-?mail|www\\.)"
COUNTRY = "(?i)\\bPhilippines\\b(?:\\s*[, ]\\s*[0-9]{4})?[.,]*\\s*$"
FORM_LABEL = {
    "customer_name": "(?:(?:registered|customer|cust\\.?|buyer)\\s+)?name",
    "customer_tax_id": "(?:(?:customer|buyer)\\s+)?(?:tin|tax\\s*id)",
    "customer_address": "(?:(?:business|customer|buyer)\\s+)?address",
    "plate_number": "(?:vehicle\\s+)?plate\\s*(?:no\\.?|number|#)?",
}
CHARGES = "(?i)^(?:generation|transmission|system\\s+loss|distribution|subsidies|government\\s+taxes|universal\\s+charges|fit[\\s-]*all|other\\s+charges)\\b"
FEWEST_CHARGES = 4
PLAN = "(?i)(?:\\bg?fib(?:er|re)|\\bbusiness\\s+plan|\\bbroadband)\\b"
VAT_PRINTED = ("vat sale", "vat sales", "vat amount", "vat zero*", "vatable*", "value added")
MONTH_DATE = "(?i)\\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?\\s+[0-9]{1,2},?\\s+[0-9]{4})\\b"
NOT_ISSUE = ("date issued", "acknowledg*", "atp", "accredit*", "permit*", "valid until", "expir*")
PAYMENTS_FROM, PAYMENTS_MADE, BILL_SUMMARY = ("balance from previous bill", "balance from previous bil"), ("less payments received",), ("bill summary", "statement summary")
# -----------------------------------------------------------------------------------------------


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank(c), "\\s+", " "))


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]", "")


def _places(lines: Column, hit) -> Column:
    """1-based numbers of the lines for which a condition holds."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: F.coalesce(hit(F.get(lines, i - 1)), F.lit(False)))


def _below(lines: Column, label: str | tuple[str, ...], ahead: int, stop: str = "^$") -> Column:
    """The amount on the first line with the label (a pattern, or phrases), or on one of the next lines before a stop."""
    at = F.get(_places(lines, lambda x: says(x, label) if isinstance(label, tuple) else x.rlike(label)), F.lit(0))

    def first(window: Column) -> Column:
        upto = F.coalesce(F.get(F.filter(F.sequence(F.lit(2), F.greatest(F.size(window), F.lit(2))), lambda i: F.get(window, i - 1).rlike(stop)), F.lit(0)), F.lit(ahead + 2))
        return F.get(F.flatten(F.transform(F.slice(window, 1, upto - 1), lambda x: amounts_on(x))), F.lit(0))

    return let(at, lambda i: F.when(i.isNotNull(), let(F.slice(lines, i, ahead + 1), first)))


def _tidied(text: Column) -> Column:
    return F.transform(_lines(text), _tidy)


def _filled(text: Column) -> Column:
    """The lines that are not empty."""
    return F.filter(_tidied(text), lambda x: x != "")


# ---- names and addresses ------------------------------------------------------------------------
def vendor_of_page(vendor: Column, text: Column) -> Column:
    """The business at the head of the page where the name that was read stands beside a terminal's permit, staff, or in the printer's footer."""


    def settled(lines: Column, s: Column) -> Column:
        at, footer, terminal = s["at"], s["footer"], s["terminal"]
        wrong = F.coalesce(terminal | s["staff"] | (at >= footer), F.lit(False))
        own = F.when(terminal, let(F.get(_places(lines, lambda x: F.lower(x).rlike("^name\\s*:?$")), F.lit(0)), lambda named: F.when(named.isNotNull(), F.get(lines, named))))
        upper = F.array_join(F.slice(lines, 1, F.greatest(F.least(at, F.coalesce(footer, at)) - 1, F.lit(0))), "\n")
        found = F.coalesce(F.nullif(own, F.lit("")), business_line(upper, 24))
        return F.when(wrong, let(found, lambda f: F.when(f.isNotNull() & (_letters(f) != _letters(vendor)), f)))

    def seen(lines: Column, at: Column) -> Column:
        around = lambda before, after: F.slice(lines, F.greatest(at - before, F.lit(1)), before + after + 1)
        footer = F.get(_places(lines, lambda x: x.rlike(PRINTER)), F.lit(0))
        return F.struct(at.alias("at"), footer.alias("footer"), F.exists(around(2, 4), lambda x: x.rlike(TERMINAL)).alias("terminal"), F.exists(around(3, 3), lambda x: x.rlike(STAFF)).alias("staff"))

    def of(lines: Column) -> Column:
        name = F.when(_letters(vendor) != "", _letters(F.substring_index(vendor, ",", 1)))
        at = let(name, lambda n: F.get(_places(lines, lambda x: F.contains(_letters(x), n)), F.lit(0)))
        return let(let(at, lambda i: seen(lines, i)), lambda s: settled(lines, s))

    return F.coalesce(let(_tidied(text), of), vendor)


def seller_lines(text: Column) -> Column:
    """Lines of the page's head that read as places, in order, each once: up to the buyer, the invoice's own data or the country."""
    return let(F.transform(F.slice(_lines(text), 1, 40), lambda x: F.trim(F.regexp_replace(_tidy(x), "^[ ,;|]+|[ ,;|]+$", ""))), _seller_lines)


def _seller_lines(lines: Column) -> Column:
    ends = lambda hit: F.coalesce(F.get(_places(lines, hit), F.lit(0)), F.size(lines) + 1)
    last = F.least(ends(lambda x: x.rlike(BUYER)), ends(lambda x: x.rlike(HEAD_ENDS)), ends(lambda x: x.rlike(COUNTRY) & (F.length(x) >= 8) & ~x.rlike("(?i)\\b(?:inc|corp)\\.?$")) + 1)
    head = F.slice(lines, 1, F.greatest(last - 1, F.lit(0)))
    return F.array_distinct(F.filter(head, lambda x: (F.length(x) >= 8) & x.rlike(PLACE) & ~x.rlike(CONTACT) & ~x.rlike("(?i)\\b(?:incorporated|inc\\.?|corporation|corp\\.?)\\s*$")))


def seller_address(address: Column, vendor: Column, text: Column) -> Column:
    """The head's address where none was read, the read one is much shorter, or the seller's name stands in it; cut at the country if the head ends there."""
    return let(let(F.array_join(seller_lines(text), ", "), lambda x: F.when(x != "", x)), lambda built: _seller_address(address, vendor, built))


def _seller_address(address: Column, vendor: Column, built: Column) -> Column:
    letters = lambda c: F.length(F.regexp_replace(blank(c), "[^A-Za-z]", ""))
    named = (_letters(vendor) != "") & F.startswith(_letters(address), _letters(vendor))
    cut = F.regexp_extract(blank(address), "(?i)^(.*?\\bPhilippines\\b(?:\\s*[, ]\\s*[0-9]{4})?)", 1)
    ends = (cut != "") & (_letters(cut) == _letters(built)) & (F.length(_letters(cut)) >= 25)
    return F.when(ends, cut).when(built.isNotNull() & (F.coalesce(F.trim(address) == "", F.lit(True)) | (letters(built) >= letters(address) + 10) | named), built).otherwise(address)


def first_site(address: Column) -> Column:
    """The first of two sites: one that ends in a postcode before another floor begins."""
    one = F.regexp_extract(blank(address), "(?is)^(.+?\\b[0-9]{4})\\s*[,;\\n]?\\s+(?=[0-9]{1,3}\\s*/\\s*F\\b|[0-9]{1,3}(?:st|nd|rd|th)\\s+floor\\b)", 1)
    return F.when(one != "", F.regexp_replace(_tidy(one), "^[ ,;]+|[ ,;]+$", "")).otherwise(address)


def filled_in(df: DataFrame) -> DataFrame:
    """Party fields that hold only their label or a writing line are empty."""
    return df.withColumns({f: F.when(F.trim(F.col(f)).rlike(f"(?i)^(?:{label})?\\s*[:#]?\\s*[_\\-—–. :]*$"), F.lit(None)).otherwise(F.col(f)) for f, label in FORM_LABEL.items() if f in df.columns})


def buyer_address(address: Column, text: Column) -> Column:
    """Nothing, where the Address line of the form is followed by the next label and not by an address."""
    empty = lambda lines: F.exists(_places(lines, lambda x: x.rlike("(?i)^address\\s*:?$")), lambda i: F.exists(F.slice(lines, i + 1, 2), lambda x: x.rlike("(?i)^(?:tin|bus(?:iness)?\\s*style)\\b")))
    return F.when(let(_filled(text), empty), F.lit(None)).otherwise(address)


def seller_tin(vendor: Column, customer: Column, text: Column) -> Column:
    """A seller's tax id that is the buyer's gives way to the one other that stands behind VAT, TIN or REG, else to nothing."""
    digits = lambda c: F.regexp_replace(blank(c), "[^0-9]", "")
    same = (F.length(digits(vendor)) >= 9) & (F.substring(digits(vendor), 1, 9) == F.substring(digits(customer), 1, 9))
    behind = F.regexp_extract_all(blank(text), F.lit(f"(?i)(?:vat|tin|reg)[^0-9\\n]{{0,30}}{TIN}"), F.lit(1))
    other = only_one(F.filter(F.transform(behind, normalize_tin), lambda t: F.substring(digits(t), 1, 9) != F.substring(digits(vendor), 1, 9)))
    return F.when(same, other).otherwise(vendor)


def issue_date(current: Column, text: Column) -> Column:
    """The date by an Issue Date label; the earlier of two where a due date is printed too; not those of permits."""
    page = blank(text)
    found = F.array_compact(F.flatten(F.transform(F.filter(_lines(text), lambda x: ~says(x, NOT_ISSUE)), lambda x: F.transform(F.regexp_extract_all(x, F.lit(MONTH_DATE), F.lit(1)), parse_date))))
    first = let(found, lambda days: F.when(page.rlike("(?i)\\bdue\\s+date\\b"), F.array_min(F.slice(days, 1, 2))).otherwise(F.get(days, F.lit(0))))
    return F.when(page.rlike("(?i)\\bissue\\s+date\\b") & ~page.rlike("(?i)\\binvoice\\s+date\\b"), F.coalesce(first, current)).otherwise(current)


# ---- amounts of receipts and statements ---------------------------------------------------------------
def retail_summary(df: DataFrame) -> DataFrame:
    """Net, VAT, discount and total of a till's tax lines: VAT that is deducted is none, and VAT sales with a printed sum imply the VAT."""
    labels = {"less": ("(?i)^less\\s*12\\s*%?\\s*vat$", 2), "pay": ("(?i)^amount\\s+to\\s+pay$", 3, "(?i)^(?:cash|change)\\b"), "net": ("(?i)^vat\\s+sale$", 1), "sum": ("(?i)^subtotal\\.?$", 2)}
    df = df.withColumn("__till", let(_filled(F.col("text")), lambda lines: F.struct(*[F.abs(_below(lines, *how)).alias(k) for k, how in labels.items()])))
    less, pay, net, sum_ = (F.col(f"__till.{k}") for k in labels)
    implied = cents(sum_) - cents(net)
    fits = F.coalesce(less.isNull() & (implied >= 0) & (implied <= cents(sum_ * 0.30 + 0.05)), F.lit(False))
    deducted = less.isNotNull()
    new = {
        "subtotal": F.when(fits, net).otherwise(F.col("subtotal")),
        "tax_amount": F.when(deducted, 0.0).when(fits, implied.cast("double")).otherwise(F.col("tax_amount")),
        "discount": F.when(deducted, F.when(F.col("discount") > 0, F.col("discount")).otherwise(less)).otherwise(F.col("discount")),
        "total_amount": F.when(deducted, F.coalesce(pay, "total_amount")).when(fits, sum_).otherwise(F.col("total_amount")),
    }
    return df.withColumns({f"__{k}": v for k, v in new.items()}).withColumns({k: F.col(f"__{k}") for k in new}).drop("__till", *[f"__{k}" for k in new])


def retail_table(text: Column, total: Column) -> Column:
    """(net, vat) of a till's tax table: both numbers on the VAT SALE row, or, column by column, the pair that makes the total."""
    pair = lambda n, v: F.struct(n.alias("net"), v.alias("vat"))

    def by_column(all_: Column) -> Column:
        pairs = F.flatten(F.transform(F.slice(all_, 1, 4), lambda n: F.transform(F.slice(all_, 5, 4), lambda v: pair(n, v))))
        return F.when(F.size(all_) >= 8, only_one(F.filter(pairs, lambda p: (F.abs(p["net"] + p["vat"] - total) <= 0.01) & (p["vat"] > 0))))

    def below(lines: Column, start: Column) -> Column:
        end = F.coalesce(F.get(_places(lines, lambda x: x.rlike("(?i)^(?:cashier|sales\\s+invoice)")), F.lit(0)), F.size(lines) + 1)
        return F.when(start.isNotNull(), let(F.flatten(F.transform(F.slice(lines, start, F.greatest(end - start, F.lit(0))), lambda x: amounts_on(x))), by_column))

    def of(lines: Column) -> Column:
        row = F.get(F.transform(F.filter(lines, lambda x: x.rlike("(?i)^vat\\s+sale\\b")), lambda x: amounts_on(x)), F.lit(0))
        start = F.get(_places(lines, lambda x: x.rlike("(?i)^tax\\s+code\\b|^vat\\s+sale\\b")), F.lit(0))
        return let(row, lambda r: F.when(F.size(r) >= 2, pair(r[0], r[1])).otherwise(let(start, lambda i: below(lines, i))))

    return let(_tidied(text), of)


def parking_tax(tax: Column, total: Column, text: Column) -> Column:
    """The VAT of a parking receipt: the one printed amount that the printed rate makes of the total."""
    label = "(?i)\\bvat\\s*amount\\s*\\(?\\s*([0-9]{1,2}(?:\\.[0-9]+)?)\\s*%\\)?"

    def printed(lines: Column, i: Column) -> Column:
        rate = F.regexp_extract(F.element_at(lines, i), label, 1).cast("double")
        near = F.concat(F.array(F.regexp_replace(F.element_at(lines, i), label, " ")), F.slice(lines, i + 1, 6))
        return let(total * rate / (100 + rate), lambda want: F.filter(F.flatten(F.transform(near, lambda x: amounts_on(x))), lambda v: F.abs(v - want) <= 0.03))

    found = only_one(let(_lines(text), lambda lines: F.flatten(F.transform(_places(lines, lambda x: x.rlike(label)), lambda i: printed(lines, i)))))
    return F.when(blank(text).rlike("(?i)\\bparking\\s+fee\\b"), F.coalesce(found, tax)).otherwise(tax)


def stated_subtotal(subtotal: Column, tax: Column, total: Column, text: Column) -> Column:
    """Nothing, where a page prints no VAT line and the subtotal only repeats the total."""
    repeats = (F.abs(subtotal - total) <= 0.05) & (F.coalesce(tax, F.lit(0.0)) == 0) & ~says(text, VAT_PRINTED)
    return F.when(F.coalesce(repeats, F.lit(False)), F.lit(None)).otherwise(subtotal)


def charge_rows(text: Column) -> Column:
    """(description, amount) of a bill's breakdown: known labels that an amount follows; fewer than four are none."""
    lone = lambda x: F.when(x.rlike("^\\(?-?[0-9][0-9,]*\\.[0-9]{2}\\)?$"), F.get(amounts_on(x), F.lit(0)) * F.when(x.rlike("^\\(|^-"), -1).otherwise(1))

    def of(lines: Column) -> Column:
        first = F.get(_places(lines, lambda x: x.rlike("(?i)breakdown\\s+of\\s+\\w*\\s*charges")), F.lit(0))
        last = F.coalesce(F.get(_places(lines, lambda x: x.rlike("(?i)^total\\s+current\\s+charges")), F.lit(0)), F.size(lines) + 1)
        at = let(F.struct(first.alias("first"), last.alias("last")), lambda s: F.filter(_places(lines, lambda x: x.rlike(CHARGES)), lambda i: (i > s["first"]) & (i < s["last"])))
        rows = F.transform(at, lambda i: F.struct(F.element_at(lines, i).alias("description"), lone(F.get(lines, i)).alias("amount")))
        return F.filter(rows, lambda r: r["amount"].isNotNull())

    return let(let(_filled(text), of), lambda rows: F.when(F.size(rows) >= FEWEST_CHARGES, rows))


def checked_charges(rows: Column, current: Column) -> Column:
    """A breakdown counts only if it adds up to the current charges."""
    total = lambda kept: F.aggregate(kept, F.lit(0).cast("decimal(18,4)"), lambda s, x: (s + cents(x["amount"])).cast("decimal(18,4)"))
    return let(rows, lambda kept: F.when(F.abs(total(kept) - cents(current)) <= F.lit("0.02").cast("decimal(18,4)"), kept))


def plan_row(text: Column) -> Column:
    """(description, amount) of a named service plan above a statement's summary whose name holds its monthly charge."""

    def named(lines: Column, start: Column, amount: Column) -> Column:
        above = F.slice(lines, F.greatest(start - 9, F.lit(1)), F.least(start - 1, F.lit(9)))
        name = F.get(F.filter(above, lambda x: x.rlike(PLAN) & F.array_contains(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), F.floor(amount).cast("string"))), F.lit(0))
        return let(name, lambda n: F.when(n.isNotNull(), F.struct(n.alias("description"), amount.alias("amount"))))

    def below(lines: Column, start: Column) -> Column:
        return F.when(start.isNotNull(), let(let(F.slice(lines, start, 15), lambda part: _below(part, "(?i)^monthly\\s+plan$", 3)), lambda amount: named(lines, start, amount)))

    return let(_filled(text), lambda lines: let(F.get(_places(lines, lambda x: x.rlike("(?i)^statement\\s+summary$")), F.lit(0)), lambda start: below(lines, start)))


def credit_balance(balance: Column, current: Column, total: Column, text: Column) -> Column:
    """A carried balance whose sign was lost: the total is the charges less it, or payments printed exceed the bill before by it."""
    d = {k: cents(v) for k, v in {"b": balance, "c": current, "t": total}.items()}
    near = lambda x, y: F.abs(x - y) <= F.lit("0.05").cast("decimal(18,4)")
    sums = near(d["c"] - d["b"], d["t"]) & ~near(d["c"] + d["b"], d["t"])
    bill = let(_filled(text), lambda lines: F.struct(_below(lines, PAYMENTS_FROM, 1).alias("before"), _below(lines, PAYMENTS_MADE, 1).alias("paid")))
    printed = says(text, BILL_SUMMARY) & let(bill, lambda x: (x["paid"] > x["before"]) & near(cents(x["paid"]) - cents(x["before"]), d["b"]))
    return F.when((balance > 0.005) & F.coalesce(sums | F.coalesce(printed, F.lit(False)), F.lit(False)), -balance).otherwise(balance)


def joined_price(items: Column, total: Column, text: Column) -> Column:
    """Items, one of them mended: a price printed in two pieces behind its name that is exactly what the total lacks without it."""
    whole = F.aggregate(items, F.lit(0).cast("decimal(18,4)"), lambda s, x: (s + cents(x["amount"])).cast("decimal(18,4)"))

    def mended(lines: Column, x: Column, want: Column) -> Column:
        name = F.when(F.length(_letters(x["description"])) >= 10, _letters(x["description"]))
        return let(let(name, lambda n: F.get(_places(lines, lambda y: F.contains(_letters(y), n)), F.lit(0))), lambda at: priced(lines, x, want, at))

    def priced(lines: Column, x: Column, want: Column, at: Column) -> Column:
        pieces = F.flatten(F.transform(F.slice(lines, F.coalesce(at, F.lit(1)), 4), lambda y: F.regexp_extract_all(y, F.lit("(?<![0-9])([0-9]{1,2}\\s+[0-9]{3}\\.[0-9]{2})(?![0-9])"), F.lit(1))))
        hit = at.isNotNull() & F.exists(pieces, lambda p: F.abs(F.regexp_replace(p, "\\s", "").cast("double") - want) < 0.02) & (F.abs(x["amount"] - want) > 0.02)
        return F.when(F.coalesce(hit, F.lit(False)), F.struct(x["description"].alias("description"), F.lit(1.0).alias("quantity"), want.alias("unit_price"), want.alias("amount"))).otherwise(x)

    each = lambda lines, sum_: F.transform(items, lambda x: let((cents(total) - (sum_ - cents(x["amount"]))).cast("double"), lambda want: mended(lines, x, want)))
    return F.when(F.size(items) >= 2, let(_lines(text), lambda lines: let(whole, lambda sum_: each(lines, sum_)))).otherwise(items)


def with_decimals(rows: Column, total: Column) -> Column:
    """Amounts (value, decimals, confidence) of a bill that lost their points: such a value is hundredths; if the sum is still
    off, the least certain of them takes what is missing. Null where that does not settle it."""
    money = "decimal(18,4)"
    fixed = F.transform(rows, lambda x: F.when(x["decimals"], cents(x["value"])).otherwise((cents(x["value"]) / 100).cast(money)))
    doubtful = F.filter(F.transform(rows, lambda x, i: F.struct(x["confidence"].alias("c"), i.alias("i"), x["decimals"].alias("d"))), lambda x: ~x["d"])

    def mended(values: Column, gap: Column) -> Column:
        least = F.get(F.array_sort(F.filter(doubtful, lambda x: F.get(values, x["i"]) + gap > 0)), F.lit(0))["i"]
        taken = lambda k: F.when(k.isNotNull(), F.transform(values, lambda v, i: F.when(i == k, (v + gap).cast(money)).otherwise(v)))
        return F.when(F.abs(gap) <= F.lit("0.011").cast(money), values).otherwise(let(least, taken))

    gap = lambda values: cents(total) - F.aggregate(values, F.lit(0).cast(money), lambda s, v: (s + v).cast(money))
    return F.transform(let(fixed, lambda values: let(gap(values), lambda g: mended(values, g))), lambda v: v.cast("double"))


def marketplace_number(number: Column) -> Column:
    """A number whose prefix was read with a one for its last letter."""
    return F.when(F.trim(number).rlike("(?i)^ISS[1l][0-9]{12}$"), F.concat(F.lit("ISSI"), F.substring(F.trim(number), 5, 12))).otherwise(number)


def shown_quantity(c: Column) -> Column:
    """A quantity without needless decimals; what is no number is shown as it is, nothing as a dash."""
    text = F.trim(blank(c.cast("string")))
    plain = F.regexp_replace(text, ",", "")
    number = plain.rlike("^-?[0-9]+(?:\\.[0-9]+)?$")
    short = F.regexp_replace(F.regexp_replace(plain, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    return F.when(text == "", "—").when(number & (plain.try_cast("double") == 0), "0").when(number, F.when(F.contains(plain, F.lit(".")), short).otherwise(plain)).when(F.lower(plain).isin("nan", "inf", "infinity", "-inf", "-infinity"), "—").otherwise(text)


# ---- fields as the page shows them --------------------------------------------------------------------
def plain_number(number: Column, text: Column) -> Column:
    """An invoice number without the label it was read with; where there is none, the only one that stands behind SI No."""
    stripped = F.regexp_replace(F.trim(number), "(?i)^s\\.?\\s*i\\.?\\s*(?:#|no\\.?|number)\\s*:?\\s*", "")
    printed = only_one(F.regexp_extract_all(blank(text), F.lit("(?im)^\\s*s\\.?\\s*i\\.?\\s*(?:#|no\\.?)\\s*:?\\s*([0-9][0-9-]{2,})\\s*$"), F.lit(1)))
    return F.coalesce(F.nullif(stripped, F.lit("")), printed)


def owner(vendor: Column, text: Column) -> Column:
    """The company that a shop says it is owned and operated by, where no seller was read."""
    said = F.trim(F.regexp_extract(blank(text), "(?im)^\\s*(?:owned\\s*(?:and|&)\\s*operated|operated)\\s*by\\s*:?\\s*([^\\n]*[A-Za-z]{3}[^\\n]*)$", 1))
    return F.when(F.trim(blank(vendor)) == "", F.nullif(said, F.lit(""))).otherwise(vendor)


def buyer_name(name: Column, text: Column) -> Column:
    """Nothing, where the form's Registered Name is followed by the next label."""
    empty = lambda lines: F.exists(_places(lines, lambda x: x.rlike("(?i)^registered\\s+name\\s*:?\\s*_*$")), lambda i: F.coalesce(F.get(lines, i).rlike("(?i)^(?:tin|business\\s+address|address|date)\\b"), F.lit(False)))
    return F.when(let(_filled(text), empty), F.lit(None)).otherwise(name)


def unused_form(text: Column) -> Column:
    """Whether a receipt is only printed, not filled in: its labels are there, no digit between them and no amount."""
    labels = let(spaced(text), lambda words: reduce(lambda a, b: a & b, [says_in(words, (x,)) for x in ("received from", "address of buyer", "total receipts")]))

    def filled(rest: Column) -> Column:
        end = F.get(_places(rest, lambda x: says(x, ("seller*",))), F.lit(0))
        return F.exists(F.slice(rest, 1, F.coalesce(end - 1, F.size(rest))), lambda x: x.rlike("[0-9]"))

    def below(lines: Column) -> Column:
        begin = F.get(_places(lines, lambda x: says(x, ("in payment for the following",))), F.lit(0))
        return F.slice(lines, F.coalesce(begin, F.lit(1)), F.greatest(F.size(lines), F.lit(1)))

    return labels & ~let(let(_lines(text), below), filled) & (F.size(amounts_on(text)) == 0)
