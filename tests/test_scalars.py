import re
import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as s


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["r"] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_to_float(spark):
    cases = {"$1,234.56": 1234.56, "1.234,56": 1234.56, "(400.00)": -400.0, "40.15-": -40.15, "-400.00": -400.0, "1.9603.40": None, "1,234,567": 1234567.0, "1,23,4567": None, "12,50": 12.5, "1,234": 1234.0, "": None, "abc": None, None: None, "1.234.567,89": 1234567.89, " ₱ 7 ": 7.0}
    assert apply(spark, s.to_float, list(cases)) == list(cases.values())
    assert apply(spark, s.normalize_discount, ["(400.00)", "x"]) == [400.0, None]


def test_currency(spark):
    cases = {"php": "PHP", "₱": "PHP", "P": "PHP", "Pesos": "PHP", "P1,200.00": "PHP", "P 90.00": "PHP", "PARKING": "PARKING", "US$": "USD", "": "", None: "", "xyz": "XYZ"}
    assert apply(spark, s.normalize_currency, list(cases)) == list(cases.values())
    assert apply(spark, s.currency_code, ["₱", "EUR", "PARKING", None]) == ["PHP", "EUR", "UNSPECIFIED", "UNSPECIFIED"]


def plain_date(v):
    v = v.strip()
    m = re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{2})", v)
    if m and (int(m[1]) > 12) != (int(m[2]) > 12):
        return datetime.strptime(v, "%m/%d/%y" if int(m[2]) > 12 else "%d/%m/%y").date()
    for f in "%Y-%m-%d|%d/%m/%Y|%m/%d/%Y|%d-%m-%Y|%m-%d-%Y|%d %b %Y|%d %B %Y|%b %d, %Y|%B %d, %Y|%Y/%m/%d|%d.%m.%Y|%d%b%Y|%b %d %Y|%B %d %Y|%d-%b-%y|%d-%B-%y|%d/%m/%y|%d %b %y|%d %B %y|%d-%b-%Y|%d-%B-%Y".split("|"):
        try:
            return datetime.strptime(v, f).date()
        except ValueError:
            pass
    m = re.search(r"\d{4}-\d{2}-\d{2}", v)
    return date.fromisoformat(m.group()) if m else None


def test_dates(spark):
    cases = ["2026-03-05", "05/03/2026", "13/01/2026", "01/13/2026", "8/24/26", "24/8/26", "03/04/26", "16AUG2026", "Nov 5 2025", "November 5, 2025", "13-Aug-26", "22-July-2026", "5.3.2026", "2026/3/5", "issued 2026-03-05 at", "nonsense", " 1-2-2026 ", "5 Mar 70", "5 Mar 68"]
    assert apply(spark, s.parse_date, cases) == [plain_date(c) for c in cases]
    hint = lambda c: s.parse_date_with_context(c, F.lit("Billing Period (mm/dd/yy)"))
    assert apply(spark, hint, ["08/05/26", "08/05/2026"]) == [date(2026, 8, 5)] * 2


def test_ids(spark):
    assert apply(spark, s.normalize_tin, ["VATRg000-360-916-00000", "00036091600000", "123456789", "123-456-789", "12", None]) == ["000-360-916-00000", "000-360-916-00000", "123-456-789", "123-456-789", "12", None]
    assert apply(spark, s.is_valid_tin, ["123-456-789-000", "1", None]) == [True, False, False]
    assert apply(spark, s.lookalike_digits, ["SI OO1O5", "A1O"]) == ["SI OO105", "A10"]
    assert apply(spark, s.vendor_key, ["Alpha, Inc.", "Beta Co Corp", "  Gamma LLC"]) == ["alpha", "beta", "gamma"]


@pytest.mark.parametrize(("text", "run"), [("DONRNTTNRN PPIATTRNNNNPPNNN", 12), ("PLDT Home", 4), ("Aé-bc", 2), ("", 0), (None, 0)])
def test_consonants(spark, text, run):
    assert apply(spark, s.consonant_run, [text]) == [run]


def test_identity(spark):
    values = ["  ＡＢＣ  Ｓhop ", "Straße", "ascii  text", None]
    want = [" ".join(unicodedata.normalize("NFKC", v or "").split()).casefold() for v in values]
    assert apply(spark, s.identity_text, values) == want
    rows = spark.createDataFrame([(1, " ALPHA ", "1 . 5"), (2, "alpha", "1.5"), (3, "Beta", "1.5"), (4, "n/a", "1"), (5, "Alpha", "UNVERIFIED-1")], "id int, v string, n string")
    keys = {r["id"]: r["k"] for r in rows.select("id", s.duplicate_key(F.col("v"), F.col("n")).alias("k")).collect()}
    assert keys[1] == keys[2] != keys[3] and keys[4] is None and keys[5] is None
    long = "x1 " * 80
    assert apply(spark, s.content_key, [long, long.upper() + "!", "short 1", "y " * 200])[:2] == [apply(spark, s.content_key, [long])[0]] * 2
    assert apply(spark, s.content_key, ["short 1", "y " * 200]) == [None, None]


def test_small_ones(spark):
    assert apply(spark, s.csv_guard, ["=1", "  -x", "ok", None]) == ["'=1", "'  -x", "ok", None]
    assert apply(spark, s.safe_component, [" a/b:c "]) == ["a_b_c"]
    assert apply(spark, s.money_display, [None, 1234.5], "double") == ["Not available", "1,234.50"]
    texts = ['{no} then {"a": 3} and {"a": 4}', '{"a": 5, "b": {"c": "}{", "d": [{"e": "\\""}]}} {x', '{"a": 6', None]
    assert apply(spark, lambda c: s.first_json(c, "a int")["a"], texts) == [3, 5, None, None]
    assert apply(spark, lambda c: s.first_json(c, "a int")["a"], ['```json\n{"a": 1}\n```', 'so {"a": 2} it is', "none"]) == [1, 2, None]
    assert apply(spark, lambda c: s.auto_category(c, F.array(F.lit("2 Parking slots"))), ["Acme", "Jollibee"]) == ["Transportation", "Food"]
    assert apply(spark, s.finite_number, ["nan", "inf", "1e3", "x"]) == [None, None, 1000.0, None]
    assert apply(spark, s.is_missing, ["Unknown Vendor", " - ", "x", None]) == [True, True, False, True]
    assert apply(spark, s.clamp, [-1.0, 0.5, 2.0], "double") == [0.0, 0.5, 1.0]
