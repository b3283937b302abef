"""Plain requests to search plans, by rules alone: a request is taken only if every word of it is understood.

A request is read once, from left to right, as tokens. At each token the phrases below are tried; a
phrase reads as many tokens as it understands and adds to the plan. A token that begins no phrase
has to be filler, else the request goes to the model that the caller passes in. Dates count from
``today``.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from tallyspark.plans import search

# ---- fixed values: words of the language ------------------------------------------------------
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
QUARTERS = {"q1": 1, "q2": 2, "q3": 3, "q4": 4}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "1st": 1, "2nd": 2, "3rd": 3, "4th": 4}
COMPARISONS = {
    ("above",): ">",
    ("over",): ">",
    ("greater", "than"): ">",
    ("more", "than"): ">",
    ("at", "least"): ">=",
    ("minimum",): ">=",
    ("below",): "<",
    ("under",): "<",
    ("less", "than"): "<",
    ("at", "most"): "<=",
    ("maximum",): "<=",
    ("equal", "to"): "=",
    ("exactly",): "=",
    ("of",): "=",
}
CURRENCIES = {
    ("₱",): "PHP",
    ("php",): "PHP",
    ("peso",): "PHP",
    ("pesos",): "PHP",
    ("philippine", "peso"): "PHP",
    ("philippine", "pesos"): "PHP",
    ("$",): "USD",
    ("usd",): "USD",
    ("dollar",): "USD",
    ("dollars",): "USD",
    ("us", "dollar"): "USD",
    ("us", "dollars"): "USD",
}
STATUSES = {("paid",): "paid", ("unpaid",): "unpaid", ("processed",): "processed", ("failed",): "failed", ("pending",): "pending", ("need", "review"): "need_review", ("needs", "review"): "needs_review", ("needs_review",): "needs_review", ("need_review",): "need_review"}
LOCKS = {("locked",): True, ("unlocked",): False}
HAVING = {"with": "present", "has": "present", "missing": "missing", "without": "missing", "no": "missing"}
NAMED_FIELDS = {
    ("invoice", "number"): "invoice_number",
    ("invoice", "#"): "invoice_number",
    ("vendor", "name"): "vendor_name",
    ("customer", "name"): "customer_name",
    ("vendor", "tin"): "vendor_tax_id",
    ("vendor", "tax", "id"): "vendor_tax_id",
    ("customer", "tin"): "customer_tax_id",
    ("customer", "tax", "id"): "customer_tax_id",
    ("plate", "number"): "plate_number",
    ("plate", "no"): "plate_number",
    ("plate", "#"): "plate_number",
    ("vehicle", "plate"): "plate_number",
    ("invoice", "date"): "invoice_date",
    ("total", "amount", "due"): "total_amount",
}
EVERYTHING = ("invoice", "invoices", "record", "records", "log", "logs", "activity", "entries")
FILLERS = frozenset((
    "action", "actions", "activity", "all", "amount", "amounts", "and", "are", "audit", "bill", "bills", "by", "category", "costing", "currency", "date", "dated", "display", "due", "during",
    "entries", "expense", "expenses", "filter", "filtered", "find", "for", "from", "give", "having", "in", "invoice", "invoices", "is", "list", "log", "logs", "matching", "me", "of", "on", "only",
    "performed", "period", "please", "receipt", "receipts", "record", "records", "search", "show", "spending", "status", "that", "the", "total", "totals", "transaction", "transactions", "upload",
    "uploaded", "user", "was", "were", "where", "whose", "with", "worth",
))
PRESENCE_NAMES = {"plate_number": "plate number", "vendor_tax_id": "vendor tin", "customer_tax_id": "customer tin"}
# -----------------------------------------------------------------------------------------------
_TOKEN = re.compile(r"\b(?:p|php|usd)(?=\d)|\d{4}-\d\d-\d\d|\d[\d,]*(?:\.\d+)?(?!\w)|\d[\d,]*(?:\.\d+)?k\b|[^\W_]\w*|\S", re.I)
_SILENT = frozenset(",.!?;:()[]{}-–—/")


class NotUnderstood(Exception):
    """The request needs more than the rules."""


def tokens_of(text: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(text)]


def _amount(token: str) -> float | None:
    """Value of a number, thousands marked by k."""
    plain = token.replace(",", "")
    try:
        return float(plain[:-1]) * 1000 if plain.endswith("k") else float(plain)
    except ValueError:
        return None


def _year(token: str) -> int | None:
    return int(token) if len(token) == 4 and token.isdigit() else None


def _month(token: str) -> int | None:
    """A month by its name or an abbreviation of three letters (four for September)."""
    for n, name in enumerate(MONTHS, 1):
        if token in (name, name[:3]) or (token == "sept" and n == 9):
            return n
    return None


@dataclass
class Reader:
    """The tokens of a request, how far it has been read, and the plan so far."""

    tokens: list[str]
    today: date
    names: list[tuple[tuple[str, ...], str, str]]
    log: bool
    at: int = 0
    plan: dict = field(default_factory=search.empty)
    found: dict = field(default_factory=dict)

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def skip(self, *words: str, ahead: int = 0) -> int:
        """The place behind ``ahead``, or one further if one of the words stands there."""
        return ahead + (self.peek(ahead) in words)

    def longest(self, phrases: dict[tuple[str, ...], object], ahead: int = 0) -> tuple[int, object] | None:
        """Number of tokens and meaning of the longest of the phrases that stands here."""
        for n in range(max(map(len, phrases)), 0, -1):
            phrase = tuple(self.tokens[self.at + ahead : self.at + ahead + n])
            if phrase in phrases:
                return n, phrases[phrase]
        return None

    def add(self, family: str, **condition: object) -> None:
        self.plan[family].append(condition)

    def period(self, first: date, last: date) -> None:
        if first > last:
            raise NotUnderstood("dates run backwards")
        uploaded = any(t in ("upload", "uploaded") for t in self.tokens)
        name = "date_time" if self.log else "date_uploaded" if uploaded else "invoice_date"
        self.add("dates", field=name, operator="between", value=first.isoformat(), value2=last.isoformat())

    def currency(self, code: str) -> None:
        if self.found.setdefault("currency", code) != code:
            raise NotUnderstood("more than one currency")

    def money(self, ahead: int) -> tuple[int, float] | None:
        """Place behind an amount and its value; a currency before or behind it is noted."""
        before = self.longest(CURRENCIES, ahead)
        code = before[1] if before else "PHP" if self.peek(ahead) == "p" else None
        at = ahead + (before[0] if before else code is not None)
        value = _amount(self.peek(at))
        if value is None:
            return None
        if self.peek(at + 1) == "k":
            at, value = at + 1, value * 1000
        if code:
            self.found.setdefault("pending", []).append(code)
        return at + 1, value


def _months(year: int, first: int, last: int) -> tuple[date, date]:
    return date(year, first, 1), date(year, last, calendar.monthrange(year, last)[1])


# ---- phrases: each returns the number of tokens it has read, 0 if it does not stand here ----------
def calendar_phrase(r: Reader) -> int:
    """A month, a range of months, or a quarter, each with or without its year."""
    at = r.skip("from", "between")
    if first := _month(r.peek(at)):
        year = _year(r.peek(at + 1))
        end = at + 1 + (year is not None)
        if r.peek(end) in ("to", "through", "until", "and", "-") and (last := _month(r.peek(end + 1))):
            last_year = _year(r.peek(end + 2))
            begin = year or last_year or r.today.year
            r.period(_months(begin, first, first)[0], _months(last_year or year or r.today.year, last, last)[1])
            return end + 2 + (last_year is not None)
        if r.plan["dates"]:
            return 0
        r.period(*_months(year or r.today.year, first, first))
        return end
    quarter, at = QUARTERS.get(r.peek()), 1
    if not quarter and r.peek(1) == "quarter":
        quarter, at = ORDINALS.get(r.peek()), 2
    if not quarter:
        return 0
    after = r.skip("of", ahead=at)
    year = _year(r.peek(after))
    r.period(*_months(year or r.today.year, 3 * quarter - 2, 3 * quarter))
    return after + 1 if year else at


def relative_phrase(r: Reader) -> int:
    """Today, yesterday, this or last week, month or year, the last days."""
    word, unit, back = r.peek(), r.peek(1), int(r.peek() == "last")
    if word in ("today", "yesterday"):
        day = r.today - timedelta(days=int(word == "yesterday"))
        r.period(day, day)
        return 1
    if back and unit.isdigit() and r.peek(2) in ("day", "days"):
        r.period(r.today - timedelta(days=int(unit) - 1), r.today)
        return 3
    if word not in ("this", "last") or unit not in ("week", "month", "year"):
        return 0
    if unit == "week":
        monday = r.today - timedelta(days=r.today.weekday() + 7 * back)
        r.period(monday, monday + timedelta(days=6))
    elif unit == "year":
        r.period(*_months(r.today.year - back, 1, 12))
    else:
        before = r.today.replace(day=1) - timedelta(days=back)
        r.period(*_months(before.year, before.month, before.month))
    return 2


def range_phrase(r: Reader) -> int:
    """From or between two days or two amounts."""
    if r.peek() not in ("from", "between"):
        return 0
    if "-" in r.peek(1)[1:]:
        if r.peek(2) not in ("and", "to", "through") or r.plan["dates"]:
            return 0
        try:
            r.period(date.fromisoformat(r.peek(1)), date.fromisoformat(r.peek(3)))
        except ValueError as e:
            raise NotUnderstood(str(e)) from e
        return 4
    if r.log or "range" in r.found or not (low := r.money(1)) or r.peek(low[0]) not in ("and", "to") or not (high := r.money(low[0] + 1)):
        return 0
    if low[1] > high[1]:
        raise NotUnderstood("amounts run backwards")
    r.found["range"] = r.add("numbers", field="total_amount", operator="between", value=low[1], value2=high[1])
    return high[0]


def comparison_phrase(r: Reader) -> int:
    """An amount above, below or equal to another."""
    if r.log or "comparison" in r.found or not (said := r.longest(COMPARISONS)) or not (amount := r.money(said[0])):
        return 0
    r.found["comparison"] = r.add("numbers", field="total_amount", operator=said[1], value=amount[1])
    return amount[0]


def currency_phrase(r: Reader) -> int:
    said = None if r.log else r.longest(CURRENCIES)
    if not said:
        return 0
    r.currency(said[1])
    return said[0]


def presence_phrase(r: Reader) -> int:
    """A field that is missing, or there."""
    if r.log or r.peek() not in HAVING:
        return 0
    at = r.skip("a", "an", ahead=1)
    said = r.longest(NAMED_FIELDS, at)
    if not said:
        return 0
    r.add("presence", field=said[1], operator=HAVING[r.peek()])
    return at + said[0]


def state_phrase(r: Reader) -> int:
    """A status, or whether the invoice is locked."""
    if r.log:
        return 0
    if said := r.longest({**STATUSES, ("needs", "-", "review"): "needs_review", ("need", "-", "review"): "need_review"}):
        if "status" not in r.found:
            r.found["status"] = said[1]
            return said[0]
    if said := r.longest(LOCKS):
        if "locked" not in r.found:
            r.found["locked"] = said[1]
            return said[0]
    return 0


def name_phrase(r: Reader) -> int:
    """A known name, the longest that stands here; a name is never guessed. Only vendors may be several."""
    for words, kind, name in r.names:
        if tuple(r.tokens[r.at : r.at + len(words)]) == words:
            got = r.found.setdefault(kind, [])
            if name not in got:
                got.append(name)
            return len(words) if kind == "vendors" or got == [name] else 0
    return 0


PHRASES = (name_phrase, presence_phrase, calendar_phrase, relative_phrase, range_phrase, comparison_phrase, currency_phrase, state_phrase)


def _known(context: dict, kinds: tuple[str, ...]) -> list[tuple[tuple[str, ...], str, str]]:
    """Tokens, kind and spelling of all known names, longest first."""
    names = {(tuple(tokens_of(str(n))), kind, str(n).strip()) for kind in kinds for n in context.get(kind) or [] if str(n).strip()}
    return sorted(names, key=lambda n: (-len(n[2]), kinds.index(n[1]), n[2]))


def _read(r: Reader) -> None:
    while r.at < len(r.tokens):
        step = 0
        for phrase in PHRASES:
            r.found.pop("pending", None)
            if step := phrase(r):
                for code in r.found.pop("pending", []):  # currencies of the amounts that were read
                    r.currency(code)
                break
        if not step and r.peek() not in FILLERS and r.peek() not in _SILENT:
            raise NotUnderstood(r.peek())
        r.at += step or 1


def parse(query: str, *, page: str, context: dict | None = None, today: date | None = None) -> dict | None:
    """The plan of a request that is understood to the last word, else None."""
    kind = page.lower()
    if kind not in ("history", "reports", "log", "logs"):
        return None
    log, tokens = kind.startswith("log"), tokens_of(query)
    rest = [t for t in tokens if t not in ("show", "list", "display", "find", "me", "the")]
    if len(rest) == 2 and rest[0] in ("all", "every") and rest[1] in EVERYTHING:
        return search.empty()
    kinds = ("users", "actions", "types") if log else ("vendors", "categories")
    r = Reader(tokens, today or date.today(), _known(context or {}, kinds), log)
    try:
        _read(r)
    except NotUnderstood:
        return None
    if "currency" in r.found:
        r.add("choices", field="currency", operator="in", values=[r.found["currency"]])
    if "status" in r.found:
        r.add("choices", field="status", operator="in", values=[r.found["status"]])
    if "locked" in r.found:
        r.add("booleans", field="locked", value=r.found["locked"])
    for name, found in (("user", "users"), ("action", "actions"), ("entity_type", "types")):
        for value in r.found.get(found, []):
            r.add("text", field=name, operator="equals", value=value)
    vendors = sorted(r.found.get("vendors", []), key=lambda n: (-len(n), n))
    if len(vendors) == 1:
        r.add("text", field="vendor_name", operator="contains", value=vendors[0])
    elif vendors:
        r.add("text", field="vendor_name", operator="contains_any", values=vendors)
    for value in r.found.get("categories", []):
        r.add("choices", field="category", operator="in", values=[value])
    if not any(r.plan.values()):
        return None
    plan, warnings = search.checked(r.plan, kind)
    return None if warnings else plan


def with_presence(query: str, plan: dict) -> dict:
    """Add what a request says outright about fields being there; the longest name wins, and it outranks other conditions on the field."""
    said = {**HAVING, "lacking": "missing", "having": "present"}
    names = {tuple(PRESENCE_NAMES.get(f, f.replace("_", " ")).split()): f for f in search.INVOICE["presence"]}
    names |= {(*words[:-1], words[-1] + "s"): f for words, f in names.items() if not words[-1].endswith("s")}
    bounds = ("above", "over", "below", "under", "of", "equal", "between")  # then it is about a value
    tokens, out = tokens_of(query), {k: list(v) for k, v in plan.items()}
    r = Reader(tokens, date.min, [], False)
    while r.at < len(tokens):
        at = r.skip("a", "an", "any", ahead=1)
        got = r.longest(names, at) if r.peek() in said else None
        if got and r.peek(at + got[0]) not in bounds:
            out = {k: [c for c in v if c["field"] != got[1]] for k, v in out.items()}
            out["presence"].append({"field": got[1], "operator": said[r.peek()]})
            r.at += at + got[0]
        else:
            r.at += 1
    return out


def currency_scope(plan: dict, currencies: list[str]) -> str | None:
    """Why an amount condition over several currencies is refused, or None."""
    money = [c for c in plan["numbers"] if c["field"] not in ("id", "tax_rate")]
    named = [c for c in plan["choices"] if c["field"] == "currency" and c["operator"] == "in"]
    if money and len(set(currencies)) > 1 and not (len(named) == 1 and len(named[0]["values"]) == 1):
        return "Amounts of different currencies cannot be compared; name one of them."
    return None


def interpret(query: str, *, page: str, context: dict | None = None, today: date | None = None, model: Callable[[str, str, dict], dict] | None = None) -> dict:
    """A plan from rules, else from the model; anything doubtful is an error, never a search for everything."""
    context = context or {}
    plan = parse(query, page=page, context=context, today=today)
    if plan is None:
        if model is None:
            raise ValueError("The rules do not understand this request, and no model was given.")
        plan, warnings = search.checked(model(query, page, context), page)
        if warnings:
            raise ValueError(" ".join(warnings))
        if search.schema_for(page) is search.INVOICE:
            plan = with_presence(query, plan)
        if not any(plan.values()):
            raise ValueError("Nothing in this request can be searched for.")
    if problem := currency_scope(plan, context.get("currencies", [])):
        raise ValueError(problem)
    return plan
