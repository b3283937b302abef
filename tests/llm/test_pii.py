import hashlib
import re

import pytest

from tallyspark.llm import pii
from tallyspark.llm.pii import find_pii, mask_pii, pii_digest

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = {
        "email": list(EMAIL.finditer(text)),
        "ip": [m for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and _luhn(digits(m))],
        "phone": [m for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }
    spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in kinds.items() for m in ms)
    return {f"n_{k}": len(ms) for k, ms in kinds.items()} | {"base_sha256": hashlib.sha256(spans.encode()).hexdigest()}


CASES = [
    None,
    "",
    "mail a.b@c.de and x@y (none) a@b.c_d@e.f",
    "é😀 card 4111 1111 1111 1111, 4111-1111-1111-1112 and 12345",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 000255.0.0.1 1.2.3",
    "+1 (017) 555-7713 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "4111  1111 1111 1111 1111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 5",
    "a" * 50_000 + " @ " + "1.1.1." * 3000 + "9" * 20_000 + " a@b" + ".c" * 20_000,
    "x@y.zz " * 700,
    "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433 token = \"24be64439e3e49cf46b2d7c90f3602a3\"",
]


def test_matches_plain_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r["doc_id"]: r.asDict() for r in pii_digest(rows).collect()}
    for i, text in enumerate(CASES):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, text and text[:60]
    assert "iban:5:32" in got[9]["spans"] and got[9]["spans"].count("iban") == 1 and "secret" in got[9]["spans"]


def test_mask(spark):
    rows = spark.createDataFrame([(1, "to a@b.cc or 1.2.3.4!", "k"), (2, None, "k"), (3, "clean", "k")], "doc_id long, text string, kind string")
    out = {r["doc_id"]: r["text"] for r in mask_pii(rows).collect()}
    assert out == {1: "to <EMAIL> or <IP>!", 2: None, 3: "clean"}
    assert mask_pii(rows).columns == rows.columns
    assert mask_pii(rows.limit(0)).count() == 0


def test_long_secrets(spark):
    """A quoted token of any length is one span and is masked whole."""
    tokens = {n: ("aB3-" * n)[:n] for n in (15, 16, 256, 257, 300, 100_000)}
    rows = spark.createDataFrame([(n, f"token = '{t}' end") for n, t in tokens.items()], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii_digest(rows).collect()}
    assert spans == {n: f"secret:9:{9 + n}" if n >= 16 else "" for n in tokens}
    masked = {r["doc_id"]: r["text"] for r in mask_pii(rows).collect()}
    assert masked == {n: "token = '<SECRET>' end" if n >= 16 else f"token = '{t}' end" for n, t in tokens.items()}


def mod97(code):
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
QUOTED = re.compile(r"(?<=[\"'])[^\"'\s]{16,}(?=[\"'])")


def said(text, start, end, words):
    """A context word that stands whole and lies within the characters on one side of a span."""
    for m in re.finditer(f"(?<![^\\W\\d_])(?:{'|'.join(words)})(?![^\\W\\d_])", text.lower()):
        if start - pii.NEAR <= m.start() and m.end() <= start or end <= m.start() and m.end() <= end + pii.NEAR:
            return True
    return False


def added(text):
    kinds = {k.name: k for k in pii.KINDS}
    out = []
    for m in IBAN.finditer(text):
        if mod97(m.group()):
            out.append(("iban", m.start(), m.end(), 0.9 if said(text, *m.span(), kinds["iban"].context) else 0.6))
    for m in QUOTED.finditer(text):
        if re.search(r"[=:] {0,2}.$", text[: m.start()]) and re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()) and said(text, *m.span(), kinds["secret"].context):
            out.append(("secret", m.start(), m.end(), 0.6))
    return out


SECRET = "a1b2c3d4e5f6a7b8c9d0"
CONTEXTS = [
    f"token = '{SECRET}'",
    f"x = '{SECRET}' is the secret",
    f"tokens = '{SECRET}'",
    f"x = '{SECRET}'",
    f"my Password: \"{SECRET}\" and token:'{SECRET[::-1]}'",
    f"password {'.' * 9} x = '{SECRET}'",
    f"password {'.' * 10} x = '{SECRET}'",
    f"betoken {'.' * 13} x= '{SECRET}'",
    f"x = '{SECRET}' {'.' * 16} token",
    f"x = '{SECRET}' {'.' * 17} token",
    f"x = '{SECRET}' {'.' * 16} tokens",
    f"key = '{'a' * 20}', key = '{'1' * 20}', key = '{SECRET[:15]}'",
    "IBAN GB82WEST12345698765432, GB82WEST12345698765432, account GB82WEST12345698765433",
    "The librarian GB82WEST12345698765432",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame(list(enumerate(CONTEXTS)), "doc_id long, text string")
    return {r["doc_id"]: [tuple(s) for s in r["pii"]] for r in find_pii(rows).collect()}


@pytest.mark.parametrize("i", range(len(CONTEXTS)))
def test_added_kinds_by_context(found, i):
    got = [(k, a, b, round(x, 6)) for k, a, b, x in found[i] if k not in pii.BASE]
    assert got == added(CONTEXTS[i])


def test_context_decides():
    assert [bool([s for s in added(t) if s[0] == "secret"]) for t in CONTEXTS[:11]] == [True, True, False, False, True, True, False, False, True, False, False]


def test_base_kinds_keep_their_spans_and_gain_by_context(spark):
    texts = ["call +1 (017) 555-7713", "recall +1 (017) 555-7713", "+1 (017) 555-7713 (mobile)", "hotel 1.2.3.4 recipe", "host 1.2.3.4"]
    got = [[round(s["score"], 6) for s in r["pii"]] for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").orderBy("doc_id")).collect()]
    assert got == [[0.9], [0.6], [0.9], [0.6], [0.9]]


def test_a_column_named_pii_is_kept(spark):
    rows = spark.createDataFrame([(1, "a@b.cc", "mine"), (1, "a@b.cc", None), (None, None, "x")], "doc_id long, text string, pii string")
    assert sorted(map(str, mask_pii(rows).collect())) == sorted(map(str, spark.createDataFrame([(1, "<EMAIL>", "mine"), (1, "<EMAIL>", None), (None, None, "x")], rows.schema).collect()))
    assert pii_digest(rows).count() == 3 and mask_pii(rows.limit(0)).columns == rows.columns
