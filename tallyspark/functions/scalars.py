"""Scalar rules of the invoice model as Column expressions: money, currency, dates, ids, categories."""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values -----------------------------------------------------------------------------
CURRENCIES = ("AUD", "CAD", "CNY", "EUR", "GBP", "INR", "JPY", "KRW", "PHP", "SGD", "USD")
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₱": "PHP", "₹": "INR", "₩": "KRW"}
PESO_WORDS = ("P", "PESO", "PESOS", "PHILIPPINE PESO", "PHILIPPINE PESOS")
MISSING = ("", "-", "--", "—", "–", "n/a", "na", "null", "none", "unknown", "unknown vendor", "not available")
CATEGORIES = {
    "Food": (
        "grocery", "groceries", "supermarket", "mini mart", "minimart", "sari-sari", "restaurant", "catering", "cafe", "diner", "eatery", "pantry", "bakery", "canteen",
        "coffee", "jollibee", "mcdo", "mcdonald", "kfc", "chowking", "greenwich", "starbucks", "shakey", "mang inasal", "bonchon", "jco",
    ),
    "Utilities": (
        "electric bill", "electricity", "power bill", "water bill", "water district", "internet", "broadband", "wifi", "telephone", "phone bill", "postpaid plan",
        "meralco", "maynilad", "manila water", "pldt", "globe", "converge", "sky cable", "cignal", "smart", "dito",
    ),
    "Furnitures": (
        "desk", "chair", "cabinet", "fitting", "furniture", "table", "bookshelf", "sofa", "shelving", "filing cabinet", "steel cabinet",
    ),
    "Office Supplies": (
        "stationery", "bond paper", "printer ink", "ink cartridge", "toner", "ballpen", "pencil", "paper clip", "folder", "envelope", "office supplies", "photocopier",
        "scanner", "calculator", "stapler", "national bookstore", "office depot", "office warehouse",
    ),
    "Transportation": (
        "fuel", "gasoline", "diesel", "petron", "shell", "caltex", "seaoil", "phoenix petroleum", "courier", "delivery fee", "freight", "cargo", "lbc", "jrs express",
        "2go", "j&t express", "ninja van", "grab", "lalamove", "vehicle maintenance", "car repair", "auto repair", "tire", "oil change", "toll fee", "parking",
        "parking fee", "parking ticket", "parking charge", "car park", "travel agency", "travel", "air ticket", "airfare", "flight", "ticketing", "service fee (ticket)",
        "ticket fee", "booking fee",
    ),
    "Insurance": (
        "insurance", "life insurance", "health insurance", "vehicle insurance", "car insurance", "property insurance", "insurance premium", "pru life", "sunlife",
        "philam", "axa", "manulife", "insular life", "malayan insurance",
    ),
    "Medical & Health Supplies": (
        "pharmacy", "drugstore", "mercury drug", "watsons", "clinic", "first aid", "first-aid", "medical supplies", "medicine", "hospital", "diagnostic", "st. luke's",
        "makati med", "medical", "med depot", "medical depot", "medical center", "vitamins", "supplement", "softgel",
    ),
}
#: ASCII that a content key leaves out: all but a to z, digits and . + -
NOT_CONTENT = "".join(c for c in map(chr, range(128)) if c not in string.ascii_lowercase + string.digits + ".+-")
VENDOR_ENDINGS = (" inc", " llc", " ltd", " corp", " co")
#: Date patterns in order of preference; day before month where both would do.
DATE_PATTERNS = (
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d", "d.M.yyyy",
    "dMMMyyyy", "MMM d yyyy", "MMMM d yyyy", "d-MMM-yy", "d-MMMM-yy", "d/M/yy", "d MMM yy", "d MMMM yy", "d-MMM-yyyy", "d-MMMM-yyyy",
)
# -----------------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What body makes of a value that is worked out once for a row.

    A plain expression is worked out again wherever it is named, in a lambda function for each element; the variable of one is not.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fold(c: Column) -> Column:
    """Case folding as far as the JVM has it, and the one expansion that matters in names."""
    return F.replace(F.lower(blank(c)), F.lit("ß"), F.lit("ss"))


def is_missing(c: Column) -> Column:
    """Missing in the sense of validation and identity."""
    return c.isNull() | F.trim(F.lower(c)).isin(*MISSING)


def finite_number(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), n)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def to_float(c: Column) -> Column:
    """A printed amount as a double; null where its separators make no number."""
    s = F.trim(c)
    kept = F.regexp_replace(s, "[^0-9.,\\-()]", "")
    dots, commas = (F.length(kept) - F.length(F.replace(kept, F.lit(x), F.lit(""))) for x in (".", ","))
    grouped = F.regexp_replace(kept, "^[-()]+|[-()]+$", "").rlike("^[0-9]+(,[0-9]{3})*$")
    broken = ((dots > 1) & (commas == 0)) | ((commas > 1) & (dots == 0) & ~grouped)
    bracketed = s.startswith("(") & s.endswith(")") & (F.length(s) > 1)
    inner = F.when(bracketed, F.trim(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)
    trailing = inner.endswith("-")
    digits = F.regexp_replace(F.when(trailing, F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner), "[^0-9.,\\-]", "")
    no = lambda x, mark: F.replace(x, F.lit(mark), F.lit(""))
    point = lambda x: F.replace(x, F.lit(","), F.lit("."))
    both, comma = F.contains(digits, F.lit(",")) & F.contains(digits, F.lit(".")), F.contains(digits, F.lit(","))
    plain = (
        F.when(both & digits.rlike(",[^.]*$"), point(no(digits, ".")))
        .when(both, no(digits, ","))
        .when(comma & digits.rlike(",[^,]{2}$"), point(digits))
        .otherwise(no(digits, ","))
    )
    n = plain.try_cast("double")
    return F.when(~broken & (s != ""), F.when((bracketed | trailing) & (n > 0), -n).otherwise(n))


def normalize_discount(c: Column) -> Column:
    return F.abs(to_float(c))


def normalize_currency(c: Column) -> Column:
    """An ISO code where the text is one, or a symbol or peso notation; else the text in capitals."""
    raw = blank(c)
    v = F.upper(F.trim(raw))
    out = F.when(v == "", "").when(v.isin(*CURRENCIES), v)
    for symbol, code in SYMBOLS.items():
        out = out.when(F.trim(raw) == symbol, code)
    out = out.when(v.isin(*PESO_WORDS) | raw.rlike("(?i)(?<![A-Za-z])P\\s*(?=[0-9][0-9,]*(?:\\.[0-9]{1,2})?\\b)"), "PHP")
    for symbol, code in SYMBOLS.items():
        out = out.when(F.contains(raw, F.lit(symbol)), code)
    return out.otherwise(v)


def currency_code(c: Column) -> Column:
    code = normalize_currency(c)
    return F.when(code.isin(*CURRENCIES), code).otherwise("UNSPECIFIED")


def _century(d: Column) -> Column:
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def _shape(pattern: str) -> str:
    """What every text has that a date pattern can read."""
    return "^" + re.sub("MMM+|y+|M+|d+|[^A-Za-z]", lambda m: "[^0-9]+" if m[0].startswith("MMM") else "[+-]?[0-9]+" if m[0][0].isalpha() else re.escape(m[0]), pattern) + "$"


def _try_date(s: Column, pattern: str) -> Column:
    """A text of another shape is not tried: a failing parse costs a thousand times as much as the look at it."""
    d = F.when(s.rlike(_shape(pattern)), F.try_to_timestamp(s, F.lit(pattern)).cast("date"))
    return _century(d) if pattern.endswith("yy") and not pattern.endswith("yyyy") else d


def parse_date(c: Column) -> Column:
    return let(F.trim(c), _parsed)


def _parsed(s: Column) -> Column:
    short = "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$"
    first, second = (F.regexp_extract(s, short, i).try_cast("int") for i in (1, 2))
    listed = F.coalesce(*[_try_date(s, p) for p in DATE_PATTERNS], F.try_to_timestamp(F.regexp_extract(s, "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit("yyyy-MM-dd")).cast("date"))
    return F.when(s.rlike(short) & (first <= 12) & (second > 12), _try_date(s, "M/d/yy")).when(s.rlike(short) & (second <= 12) & (first > 12), _try_date(s, "d/M/yy")).otherwise(listed)


def parse_date_with_context(c: Column, context: Column) -> Column:
    """A slashed date read in the order that the document prints, if it prints one."""
    s = F.trim(c)
    slashed = s.rlike("^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})$")
    month_first = blank(context).rlike("(?i)\\bmm\\s*/\\s*dd\\s*/\\s*(?:yy|yyyy)\\b|month\\s*/\\s*day\\s*/\\s*year")
    day_first = blank(context).rlike("(?i)\\bdd\\s*/\\s*mm\\s*/\\s*(?:yy|yyyy)\\b|day\\s*/\\s*month\\s*/\\s*year")
    short = s.rlike("/[0-9]{2}$")
    read = lambda order: F.when(short, _try_date(s, f"{order}/yy")).otherwise(_try_date(s, f"{order}/yyyy"))
    return F.when(slashed & month_first & ~day_first, read("M/d")).when(slashed & day_first & ~month_first, read("d/M")).otherwise(parse_date(c))


TIN = "^[0-9]{3}-[0-9]{3}-[0-9]{3}(-[0-9]{3,5})?$"


def normalize_tin(c: Column) -> Column:
    raw = F.trim(c)
    d = F.regexp_replace(raw, "[^0-9]", "")
    part = lambda a, n=3: F.substring(d, a, n)
    nine = F.concat_ws("-", part(1), part(4), part(7))
    return F.when(raw == "", c).when(raw.rlike(TIN), raw).when(F.length(d) == 9, nine).when(F.length(d).between(12, 14), F.concat_ws("-", nine, part(10, 5))).otherwise(c)


def is_valid_tin(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(TIN), F.lit(False))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def folded_text(c: Column) -> Column:
    """Compatibility form, folded. Only text beyond ASCII leaves the JVM."""
    raw = blank(c)
    wide = F.when(raw.rlike("[^\\x00-\\x7F]"), raw)
    return fold(F.coalesce(_nfkc(wide), raw))


def identity_text(c: Column) -> Column:
    """Compatibility form, single spaces, folded."""
    return F.trim(F.regexp_replace(folded_text(c), "\\s+", " "))


def ascii_folded(c: Column) -> Column:
    """folded_text for columns known to be ASCII."""
    return F.lower(blank(c))


def ascii_identity(c: Column) -> Column:
    """identity_text for columns known to be ASCII."""
    return F.trim(F.regexp_replace(ascii_folded(c), "\\s+", " "))


def duplicate_key(vendor: Column, number: Column, identity=identity_text) -> Column:
    """One key for a vendor's document number; null where either is missing or the number is a stand-in."""
    tight = lambda c: F.regexp_replace(identity(c), "\\s*([.,])\\s*", "$1")
    usable = ~is_missing(vendor) & ~is_missing(number) & ~F.upper(F.trim(number)).startswith("UNVERIFIED-")
    return F.when(usable, F.sha2(F.to_json(F.array(tight(vendor), tight(number))), 256))


def content_key(text: Column, folded=folded_text) -> Column:
    """Key of what a document says, white space and marks aside; null below 120 characters or without a digit."""
    # nearly all that goes is ASCII, and a pattern takes several times as long to remove it as translate
    plain = F.translate(folded(text), NOT_CONTENT, "")
    kept = let(plain, lambda c: F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(c, "[^\\x00-\\x7F]+", "")).otherwise(c))
    return let(kept, lambda c: F.when((F.length(c) >= 120) & c.rlike("[0-9]"), F.sha2(c, 256)))


def vendor_key(c: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(blank(c)), "[^\\p{L}\\p{N}_\\s]", ""))
    for ending in VENDOR_ENDINGS:
        out = F.when(out.endswith(ending), F.substring(out, F.lit(1), F.length(out) - len(ending))).otherwise(out)
    return F.trim(out)


def consonant_run(c: Column) -> Column:
    """Longest run of letters without a vowel; Y counts as a consonant."""
    runs = F.regexp_extract_all(blank(c), F.lit("[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def amount_in_text(text: Column, amount: Column) -> Column:
    """Whether a text prints an amount, with or without commas, as a whole number and not as a part of a longer one."""
    shown = F.format_number(amount, 2)
    either = lambda x: F.concat(F.lit("(?<![0-9])(?<![0-9][.,])(?:\\Q"), x, F.lit("\\E|\\Q"), F.replace(x, F.lit(","), F.lit("")), F.lit("\\E)(?![0-9])"))
    return F.rlike(blank(text), either(shown))


def auto_category(vendor: Column, descriptions: Column) -> Column:
    """First category any of whose words the vendor or an item contains."""
    hay = F.lower(F.concat_ws(" ", blank(vendor), F.array_join(descriptions, " ")))
    out = None
    for name, words in CATEGORIES.items():
        hit = reduce(lambda a, b: a | b, [F.contains(hay, F.lit(w)) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Others")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 3))


def csv_guard(c: Column) -> Column:
    """A text cell that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(F.ltrim(c).rlike("^[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def safe_component(c: Column) -> Column:
    """A name that is safe as part of a path."""
    return F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "_")


def month_key(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM"), F.lit("Unknown date"))


def money_display(c: Column) -> Column:
    return F.when(c.isNull(), "Not available").otherwise(F.format_number(c, 2))


def _object(depth: int) -> str:
    """Pattern of an object whose braces are nested so deep at most; braces in strings do not count."""
    inner = "[^{}\"]|\"(?:[^\"\\\\]|\\\\.)*+\""
    return "\\{(?:" + inner + ("|" + _object(depth - 1) if depth else "") + ")*+\\}"


def first_json(c: Column, schema: str) -> Column:
    """The first JSON object of a model's answer, nested eight deep at most; braces that hold no JSON are passed over."""
    found = F.regexp_extract_all(blank(c), F.lit(f"(?s){_object(7)}"), F.lit(0))
    return F.from_json(F.get(F.filter(found, lambda x: F.get_json_object(x, "$").isNotNull()), F.lit(0)), schema)


def lookalike_digits(c: Column) -> Column:
    """Letters that are read for digits, in the part after the first digit."""
    head, tail = F.regexp_extract(c, "^([^0-9]*)", 1), F.regexp_replace(c, "^[^0-9]*", "")
    return F.concat(head, F.translate(tail, "OoIlS", "00115"))


def spaced(c: Column) -> Column:
    """Words of letters and digits in lower case, a space before and behind each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(blank(c)), "[^a-z0-9%]+", " "), F.lit(" "))


def says(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text says one of some phrases, word for word; one that ends in * goes on as it likes."""
    return let(spaced(c), lambda words: says_in(words, phrases))


def says_in(words: Column, phrases: tuple[str, ...]) -> Column:
    """The same for words that are spaced already."""
    one = lambda p: F.contains(words, F.lit(f" {p[:-1]}" if p.endswith("*") else f" {p} "))
    return functools.reduce(lambda a, b: a | b, map(one, phrases))
