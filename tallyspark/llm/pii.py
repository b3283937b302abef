"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

DataFrame functions only. A pattern's matches (``regexp_extract_all``) and the text between
them (``split``) together give every position, without a row-at-a-time function.

Patterns carry look-behinds and possessive repeats so that they find the same spans as the
plain forms, but in one linear scan: a plain ``[a-z]+@`` restarts at every letter of a long run
without an @, and a plain card pattern would return every number of a table.

Context words stand whole, within ``NEAR`` characters on either side of a span, and raise its score
by ``RAISE``. The contract's base kinds stay whatever their score; a span of an added kind counts only
from ``ACCEPT``: an account code passes by its checksum alone, a quoted value only beside a word such
as token or password.

Defined results: a null text counts as empty and has no span; a null score does not occur;
spans of different kinds may overlap; repeated rows give the same result twice; an empty table
gives an empty result. ``find_pii`` keeps all columns and adds one (replacing one of that name);
``mask_pii`` keeps all columns, one named pii too, and changes only the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on either side of a match in which context words count, what they add, and the score from which added kinds count.
NEAR, RAISE, ACCEPT = 24, 0.3, 0.5
#: Elements that a running total appends to one array before it starts another.
STRIDE = 128


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)
    at = F.sequence(F.lit(1), F.length(digits))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(at, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(code: Column) -> Column:
    """Whether an account code, its first four characters moved to the end, leaves 1 modulo 97."""
    plain = F.regexp_replace(code, "\\x20", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    rest = F.aggregate(chars, F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return rest == 1


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, "\\."), lambda p: p.try_cast("double") <= 255)


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a pattern without which nothing can match, cheaper than the whole; empty: none
    valid: Callable[[Column], Column] | None
    score: float  # of a match that the validator has confirmed
    context: tuple[str, ...]


#: The four base kinds, then those that this method adds.
KINDS = (
    Kind("email", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", None, 0.7, ("mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel")),
    Kind("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]", _octets, 0.6, ("ip", "addr", "address", "host", "server")),
    Kind("card", "[0-9](?<![0-9]{2})(?<![0-9][\\x20-][0-9])(?:[\\x20-]?[0-9]){15,18}+(?![\\x20-]?[0-9])", "[0-9][\\x20-]?[0-9][\\x20-]?[0-9][\\x20-]?[0-9][\\x20-]?[0-9]", lambda m: luhn(_digits(m)), 0.7, ("card", "visa", "karte", "carte", "tarjeta", "credit")),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9]", _phone, 0.6, ("tel", "phone", "call", "fax", "mobil", "mobile")),
    Kind("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}+(?:\\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])", "[A-Z][A-Z][0-9][0-9]", mod97, 0.6, ("iban", "konto", "account", "compte", "cuenta")),
    Kind("secret", "(?<=[=:]\\x20{0,2}[\"'])[^\"'\\x20\\x09-\\x0D]{16,}+(?=[\"'])", "[=:]\\x20{0,2}[\"']", _mixed, 0.3, ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "auth")),
)
BASE = tuple(k.name for k in KINDS[:4])
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], kind: str = "bigint") -> Column:
    """For each element, the fold of those before it. Long arrays are folded in strides, so appends stay cheap."""

    def before(part: Column, first: Column) -> Column:
        start = F.struct(first.cast(kind).alias("v"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, start, lambda s, x: F.struct(op(s["v"], x).cast(kind).alias("v"), F.array_append(s["out"], s["v"]).alias("out")), lambda s: s["out"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE).cast("int")), lambda c: F.slice(values, c * STRIDE + 1, STRIDE))
    totals = F.transform(parts, lambda p: F.aggregate(p, zero.cast(kind), lambda s, x: op(s, x).cast(kind)))
    return F.flatten(F.zip_with(parts, before(totals, zero), before))


def _said(k: Kind, before: Column, after: Column) -> Column:
    """Whether a context word of the kind stands whole on either side."""
    words = f"(?<!\\p{{L}})(?:{'|'.join(k.context)})(?!\\p{{L}})"
    # where the text goes on beyond the window, a letter stands for it, so that no word is cut to another
    left = F.concat(F.when(F.length(before) > NEAR, F.lit("x")).otherwise(F.lit("")), F.right(before, F.lit(NEAR)))
    right = F.concat(F.left(after, F.lit(NEAR)), F.when(F.length(after) > NEAR, F.lit("x")).otherwise(F.lit("")))
    return F.lower(left).rlike(words) | F.lower(right).rlike(words)


def _spans(k: Kind, text: Column, found: Column) -> Column:
    """Confirmed, scored and accepted spans of one kind, from the array of its matches."""
    gaps = F.transform(F.split(text, k.pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(NEAR + 1)).alias("end"), F.left(g, F.lit(NEAR + 1)).alias("begin")))
    items = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(m).alias("n"), g["n"].alias("gap"), g["end"].alias("before")))
    items = F.zip_with(items, F.slice(gaps, 2, F.size(found)), lambda x, g: F.struct(x["m"].alias("m"), x["n"].alias("n"), x["gap"].alias("gap"), x["before"].alias("before"), g["begin"].alias("after")))
    starts = running(F.transform(items, lambda x: (x["gap"] + x["n"]).cast("bigint")), F.lit(0), lambda a, b: a + b)
    placed = F.zip_with(items, starts, lambda x, s: F.struct(x["m"].alias("m"), x["n"].alias("n"), x["before"].alias("before"), x["after"].alias("after"), (s + x["gap"]).alias("at")))
    if k.valid:
        placed = F.filter(placed, lambda x: k.valid(x["m"]))
    scored = F.transform(
        placed,
        lambda x: F.struct(
            F.lit(k.name).alias("kind"),
            x["at"].cast("bigint").alias("start"),
            (x["at"] + x["n"]).cast("bigint").alias("end"),
            F.when(_said(k, x["before"], x["after"]), F.lit(min(1.0, k.score + RAISE))).otherwise(F.lit(k.score)).alias("score"),
        ),
    )
    if k.name not in BASE:
        scored = F.filter(scored, lambda x: x["score"] >= ACCEPT)
    return F.when(F.size(found) > 0, scored.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_pii(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Add an array of (kind, start, end, score) in code points, end exclusive, by kind and start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = {}
    for k in KINDS:
        hits = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        can = F.contains(text, F.lit(k.needs)) if len(k.needs) == 1 else text.rlike(k.needs)
        found[f"__{k.name}"] = F.when(can, hits).otherwise(F.array().cast("array<string>"))
    return df.withColumns(found).withColumn(spans_col, F.concat(*[_spans(k, text, F.col(f"__{k.name}")) for k in KINDS])).drop(*found)


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets; overlapping spans share one mark."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = F.sort_array(F.transform("__pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    reach = running(F.transform(F.col("__spans"), lambda s: -s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    pieces = F.zip_with(
        F.col("__spans"),
        reach,
        lambda s, r: F.when(s["start"] >= r, F.concat(F.substring(text, (r + 1).cast("int"), (s["start"] - r).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit("")),
    )
    tail = F.substring(text, (-F.array_min(F.transform(F.col("__spans"), lambda s: s["end"])) + 1).cast("int"), F.length(text))
    masked = F.when(F.size("__spans") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text_col))
    return find_pii(df, text_col, "__pii").withColumn("__spans", spans).withColumn(text_col, masked).select(*df.columns)


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of each document."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return find_pii(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
