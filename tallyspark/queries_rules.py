"""Registered queries over the rules of documents: texts made from invoices, and by turns cases in which a rule must leave things alone.

A query reads the invoices; by its id a row is one of the rule's cases. Texts and values of a case hold ``‹expressions›`` of
the row's columns (SQL that both engines understand): ``id``, ``n`` (its net amount, rounded), ``c`` (its customer), so what is to come out
is computed from the table. The constructed cases with fixed values are in tests/test_rules.py.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import ownership
from tallyspark.queries import query
from tallyspark.sources import model


@dataclass(frozen=True)
class X:
    """A number by its expression."""

    sql: str


def money(sql: str) -> str:
    """An amount as it is printed, with two decimals."""
    return f"‹CAST(CAST({sql} AS decimal(18,2)) AS string)›"


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, X):
        return f"({value.sql})"
    if isinstance(value, bool) or not isinstance(value, str):
        return str(value)
    parts = re.split("‹(.*?)›", value)
    texts = [f"'{p}'" if i % 2 == 0 else f"CAST({p} AS string)" for i, p in enumerate(parts) if p or len(parts) == 1]
    return "(" + " || ".join(texts) + ")"


def _choose(values: list, kind: str) -> str:
    return f"CASE {' '.join(f'WHEN id % {len(values)} = {i} THEN CAST({_sql(v)} AS {kind})' for i, v in enumerate(values))} END"


def cases(name: str, inputs: str, outputs: str, rows: tuple, rule: Callable[[DataFrame], list[Column]] | None, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register a rule: inputs and outputs are schemas (the latter in the types of the SQL), a row holds the inputs and then the outputs.

    rule gives a column for each output; change, in its place, a table with columns of those names.
    """
    given, wanted = ([x.split(maxsplit=1) for x in schema.split(", ")] for schema in (inputs, outputs))
    names = [o for o, _ in wanted]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = model.invoices(spark, sf_dir).filter("subtotal is not null").selectExpr("id", "CAST(round(subtotal) AS bigint) AS n", "coalesce(customer_name, 'Nobody') AS c")
        df = base.select("id", *[F.expr(_choose([r[k] for r in rows], kind)).alias(c) for k, (c, kind) in enumerate(given)])
        if change:
            return change(df).select("id", *names)
        return df.select("id", *[c.alias(o) for o, c in zip(names, rule(df), strict=True)])

    run.__module__ = __name__
    cells = ", ".join(f"{_choose([r[len(given) + k] for r in rows], kind)} AS {o}" for k, (o, kind) in enumerate(wanted))
    query(name, f"SELECT id, {cells} FROM (SELECT id, CAST(round(subtotal) AS bigint) AS n, coalesce(customer_name, 'Nobody') AS c FROM invoices WHERE subtotal IS NOT NULL) t")(run)


_c = F.col
_NET, _VAT, _GROSS = "n", "CAST(n AS decimal(18,2)) * 0.12", "CAST(n AS decimal(18,2)) * 1.12"

cases(
    "vendor_of_page",
    "vendor string, text string",
    "name varchar",
    (
        ("CHASE ‹id› TECH CORP", "SM PARK\nName:\nHARBOR ‹id› DEV CORP\nTotal 5.00\nPTU No 12\nChase ‹id› Tech Corp", "HARBOR ‹id› DEV CORP"),
        ("Ana Reyes", "DEPOT ‹n› INC\n12 Main Street\nTotal 9.00\nCashier\nAna Reyes", "DEPOT ‹n› INC"),
        ("‹c›", "Some shop\nCashier\n‹c›", "‹c›"),
        ("Fast Print ‹id› Co, 9 Hill Road", "EMERALD ‹n› ASSOCIATION INC\nItem 1\nAuthority to Print 77\nFAST PRINT ‹id› CO\n9 Hill Road", "EMERALD ‹n› ASSOCIATION INC"),
        ("EMERALD ‹n› ASSOCIATION INC", "EMERALD ‹n› ASSOCIATION INC\nItem 1\nx\nx\nx\nAuthority to Print 77\nFAST PRINT CO", "EMERALD ‹n› ASSOCIATION INC"),
        ("‹c›", "DEPOT INC\nCashier\nAna", "‹c›"),
        (None, "DEPOT INC\nCashier", None),
    ),
    lambda df: [ownership.vendor_of_page(_c("vendor"), _c("text"))],
)

cases(
    "seller_address",
    "address string, vendor string, text string",
    "address varchar",
    (
        (None, "Acme", "ACME INC\n‹id› Quay Street\nUnit 5 Harbor Tower\nTel 555\nTIN 1\n99 Other Road", "‹id› Quay Street, Unit 5 Harbor Tower"),
        ("Acme ‹id› Quay Street", "Acme", "ACME INC\n‹id› Quay Street\n‹id› Quay Street\nBill to ‹c›\n99 Other Road", "‹id› Quay Street"),
        ("‹id› Long Avenue, Northern District, Pasig City", "Acme", "ACME INC\n12 Quay Street", "‹id› Long Avenue, Northern District, Pasig City"),
        ("‹id› Quay Street, Harbor City, Philippines 1200 ask us about loans", "Acme", "‹id› Quay Street\nHarbor City, Philippines 1200\n5 Second Road", "‹id› Quay Street, Harbor City, Philippines 1200"),
        ("‹id› Quay Street, Philippines", "Acme", "no place here", "‹id› Quay Street, Philippines"),
    ),
    lambda df: [ownership.seller_address(_c("address"), _c("vendor"), _c("text"))],
)

cases(
    "first_site",
    "address string",
    "address varchar",
    (("‹id› Quay St, Pasig 1600, 3/F Other Bldg, Makati", "‹id› Quay St, Pasig 1600"), ("‹id› Quay St,  Pasig 1600\n2nd floor Tower", "‹id› Quay St, Pasig 1600"), ("2nd floor Tower ‹id›, Pasig 1600", "2nd floor Tower ‹id›, Pasig 1600"), (None, None)),
    lambda df: [ownership.first_site(_c("address"))],
)

cases(
    "filled_in",
    "customer_name string, customer_tax_id string, customer_address string, plate_number string",
    "customer_name varchar, customer_tax_id varchar, customer_address varchar, plate_number varchar",
    (
        ("Name: ______", "TIN:", "Business Address ....", "Plate No. : ", None, None, None, None),
        ("‹c›", "‹id›", "Address Road ‹id›", "ABC ‹id›", "‹c›", "‹id›", "Address Road ‹id›", "ABC ‹id›"),
        ("", "-", " : ", "___", None, None, None, None),
    ),
    None,
    ownership.filled_in,
)

cases(
    "buyer_address",
    "address string, text string",
    "address varchar",
    ((money("n"), f"Name\nAddress:\n\nTIN:\nTotal {money('n')}", None), ("‹id› Hill", "Address:\n‹id› Hill\nTIN:", None), ("‹id› Hill", "Address: ‹id› Hill\nTIN:", "‹id› Hill"), ("‹id› Hill", "Address:\n‹id› Hill\nUnit 2\nTIN:", "‹id› Hill"), ("‹id›", "Address\nBusiness Style\n‹id›", None)),
    lambda df: [ownership.buyer_address(_c("address"), _c("text"))],
)

_TIN = "‹id % 900 + 100›-‹n % 900 + 100›-‹id % 89 + 110›"
cases(
    "seller_tin",
    "vendor string, customer string, text string",
    "tin varchar",
    (
        ("123-456-789", "123456789000", f"VAT REG TIN {_TIN}-000\nTIN 123-456-789", f"{_TIN}-000"),
        ("123-456-789", "123456789000", f"VAT REG TIN {_TIN}\nTIN 555-666-777", None),
        ("123-456-789", "123-456-789", f"no other here {_TIN}", None),
        (_TIN, "999-456-789", "VAT REG TIN 222-333-444", _TIN),
        ("12-‹id % 90 + 10›", "12-‹id % 90 + 10›", f"TIN {_TIN}", "12-‹id % 90 + 10›"),
    ),
    lambda df: [ownership.seller_tin(_c("vendor"), _c("customer"), _c("text"))],
)

_DAY = "‹id % 28 + 1›"
cases(
    "issue_date",
    "current string, text string",
    "day varchar",
    (
        (None, f"Issue Date: March {_DAY}, 2024\nDue Date: April 4, 2024", "2024-03-‹lpad(CAST(id % 28 + 1 AS string), 2, '0')›"),
        (None, f"Due Date: April 4, 2024\nIssue Date: Mar {_DAY} 2024", "2024-03-‹lpad(CAST(id % 28 + 1 AS string), 2, '0')›"),
        ("2020-01-‹lpad(CAST(id % 28 + 1 AS string), 2, '0')›", "Issue Date\nDate Issued: March 5, 2020", "2020-01-‹lpad(CAST(id % 28 + 1 AS string), 2, '0')›"),
        ("2020-01-01", f"Issue Date: March {_DAY}, 2024\nInvoice Date: March 30, 2024", "2020-01-01"),
        ("2020-01-01", f"March {_DAY}, 2024", "2020-01-01"),
    ),
    lambda df: [F.date_format(ownership.issue_date(_c("current").cast("date"), _c("text")), "yyyy-MM-dd")],
)

cases(
    "retail_summary",
    "subtotal double, tax_amount double, discount double, total_amount double, text string",
    "subtotal double, tax_amount double, discount double, total_amount double",
    (
        (1.0, 2.0, None, 3.0, f"VAT SALE\n{money(_NET)}\nSUBTOTAL\n{money(_GROSS)}\nCASH\n500.00", X(_NET), X(_VAT), None, X(_GROSS)),
        (1.0, 2.0, None, 3.0, f"VAT SALE\n{money(_NET)}\nSUBTOTAL\n{money('n * 1.9')}", 1.0, 2.0, None, 3.0),
        (1.0, 2.0, None, 3.0, f"LESS 12% VAT\n10.71\nAMOUNT TO PAY\n{money('n')}", 1.0, 0.0, 10.71, X("n")),
        (1.0, 2.0, X("n"), 3.0, "LESS 12%VAT\n-10.71\nAMOUNT TO PAY\nCASH\n100.00", 1.0, 0.0, X("n"), 3.0),
        (1.0, 2.0, None, X("n"), f"SUBTOTAL\n{money(_GROSS)}", 1.0, 2.0, None, X("n")),
    ),
    None,
    ownership.retail_summary,
)

cases(
    "retail_table",
    "total double, text string",
    "net double, vat double",
    (
        (X(_GROSS), f"TAX CODE AMOUNT VAT AMT\nVAT SALE {money(_NET)} {money(_VAT)}\nTOTAL {money(_GROSS)}", X(_NET), X(_VAT)),
        (X(_GROSS), f"TAX CODE\nVAT SALE\nVAT EXEMPT SALE\nZERO RATED SALE\nTOTAL\n{money(_NET)}\n0.00\n0.00\n{money(_NET)}\n{money(_VAT)}\n0.00\n0.00\n{money(_VAT)}\nCASHIER NAME\n500.00", X(_NET), X(_VAT)),
        (X(f"{_GROSS} + 1"), f"TAX CODE\nVAT SALE\nTOTAL\n{money(_NET)}\n0.00\n0.00\n{money(_NET)}\n{money(_VAT)}\n0.00\n0.00\n{money(_VAT)}", None, None),
        (X(_GROSS), f"no table {money(_NET)} {money(_VAT)}", None, None),
    ),
    None,
    lambda df: df.withColumn("t", ownership.retail_table(_c("text"), _c("total"))).select("id", "t.net", "t.vat"),
)

_PARK, _PARK_VAT = "(id % 97 + 3) * 28", "(id % 97 + 3) * 3"
cases(
    "parking_tax",
    "tax double, total double, text string",
    "tax double",
    ((1.0, X(_PARK), f"Parking Fee {money(_PARK)}\nVAT Amount (12%)\n{money(_PARK_VAT)}", X(_PARK_VAT)), (X("n"), X(_PARK), f"Parking Fee {money(_PARK)}\nVAT Amount 12% {money(f'{_PARK_VAT} - 1')}", X("n")), (X("n"), X(_PARK), f"VAT Amount (12%) {money(_PARK_VAT)}", X("n")), (None, X(_PARK), f"Parking fee\nVAT Amount 12%\n{money(_PARK_VAT)}\n{money(f'{_PARK_VAT} + 0.02')}", None)),
    lambda df: [ownership.parking_tax(_c("tax"), _c("total"), _c("text"))],
)

cases(
    "stated_subtotal",
    "subtotal double, tax double, total double, text string",
    "subtotal double",
    ((X("n"), None, X("n"), f"Charges {money('n')}", None), (X("n"), 0.0, X("n + 0.04"), "Charges", None), (X("n"), 0.0, X("n"), "VATable Sales", X("n")), (X("n"), 12.0, X("n"), "Charges", X("n")), (X("n"), None, X("n + 10"), "Charges", X("n"))),
    lambda df: [ownership.stated_subtotal(_c("subtotal"), _c("tax"), _c("total"), _c("text"))],
)

_BREAKDOWN = f"Breakdown of electricity charges\nGeneration\n{money('n')}\n40%%\nTransmission\n20.00\nSystem Loss\n(5.00)\n%sTotal Current Charges\n%s"
cases(
    "charge_rows",
    "current double, text string",
    "n double, checked double",
    (
        (X("n + 40"), _BREAKDOWN % ("Distribution\n25.00\n", money("n + 40")), 4, 4),
        (X("n + 41"), _BREAKDOWN % ("Distribution\n25.00\n", money("n + 41")), 4, None),
        (X("n + 15"), _BREAKDOWN % ("Distribution\nsee over\n", money("n + 15")), None, None),
        (X("n + 40"), f"Generation\n{money('n')}\nTransmission\n20.00\nSystem Loss\n10.00\nDistribution\n10.00", None, None),
    ),
    None,
    lambda df: df.withColumn("rows", ownership.charge_rows(_c("text"))).withColumn("kept", ownership.checked_charges(_c("rows"), _c("current"))).select("id", *[F.when(_c(k).isNotNull(), F.size(k).cast("double")).alias(c) for c, k in (("n", "rows"), ("checked", "kept"))]),
)

_PLAN = "(id % 900 + 100)"
cases(
    "plan_row",
    "text string",
    "description varchar, amount double",
    (
        (f"GFiber Plan ‹{_PLAN}›\nStatement Summary\nMonthly Plan\n{money(_PLAN)}\nTotal", f"GFiber Plan ‹{_PLAN}›", X(_PLAN)),
        (f"GFiber Plan ‹{_PLAN} + 1›\nStatement Summary\nMonthly Plan\n{money(_PLAN)}", None, None),
        (f"Statement Summary\nGFiber Plan ‹{_PLAN}›\nMonthly Plan\n{money(_PLAN)}", None, None),
        (f"GFiber Plan ‹{_PLAN}›\nMonthly Plan\n{money(_PLAN)}", None, None),
    ),
    None,
    lambda df: df.withColumn("p", ownership.plan_row(_c("text"))).select("id", "p.description", "p.amount"),
)

cases(
    "credit_balance",
    "balance double, current double, total double, text string",
    "balance double",
    (
        (X("n"), X("n + 100"), 100.0, "", X("-n")),
        (X("n"), 100.0, X("n + 100"), "", X("n")),
        (X("n"), 100.0, 99.0, f"Bill Summary\nBalance from Previous Bill\n200.00\nLess: Payments Received\n{money('n + 200')}", X("-n")),
        (X("n"), 100.0, 99.0, f"Balance from Previous Bill\n200.00\nLess: Payments Received\n{money('n + 200')}", X("n")),
        (X("n"), 100.0, 99.0, f"Bill Summary\nBalance from Previous Bill\n{money('n + 200')}\nLess: Payments Received\n200.00", X("n")),
        (X("-n"), X("n + 100"), 100.0, "", X("-n")),
    ),
    lambda df: [ownership.credit_balance(_c("balance"), _c("current"), _c("total"), _c("text"))],
)

_ITEM = "array<struct<description:string,quantity:double,unit_price:double,amount:double>>"


def _items(df: DataFrame) -> list[Column]:
    items = F.expr("array(named_struct('description', name, 'quantity', 2D, 'unit_price', 1D, 'amount', amount), named_struct('description', 'Other thing here', 'quantity', 1D, 'unit_price', 100D, 'amount', 100D))").cast(_ITEM)
    return [F.get(ownership.joined_price(items, _c("total"), _c("text")), F.lit(0))["amount"]]


_PART = "(id % 800 + 100)"
cases(
    "joined_price",
    "name string, amount double, total double, text string",
    "amount double",
    (
        ("Travel suitcase", X(_PART), X(f"1100 + {_PART}"), f"Travel suitcase\n1 {money(_PART)}\n", X(f"1000 + {_PART}")),
        ("Travel suitcase", X(_PART), X(f"1101 + {_PART}"), f"Travel suitcase\n1 {money(_PART)}\n", X(_PART)),
        ("Suitcase", X(_PART), X(f"1100 + {_PART}"), f"Suitcase\n1 {money(_PART)}\n", X(_PART)),
        ("Travel suitcase", X(_PART), X(f"1100 + {_PART}"), f"1 {money(_PART)}\nTravel suitcase\n", X(_PART)),
    ),
    _items,
)


def _decimals(df: DataFrame) -> list[Column]:
    rows = F.expr("transform(arrays_zip(split(v, ' '), split(c, ' ')), x -> named_struct('value', double(x['0']), 'decimals', contains(x['0'], '.'), 'confidence', double(x['1'])))")
    return [F.array_join(F.transform(ownership.with_decimals(rows, _c("total")), lambda v: F.regexp_replace(F.format_number(v, 2), ",", "")), " ")]


_LOST = "(id % 8000 + 1000)"
cases(
    "with_decimals",
    "v string, c string, total double",
    "v varchar",
    (
        (f"{money('n')} ‹{_LOST}›", "0.9 0.9", X(f"n + {_LOST} / 100.0"), f"{money('n')} {money(f'{_LOST} / 100.0')}"),
        (f"{money('n')} ‹{_LOST}› 300", "0.9 0.8 0.5", X(f"n + {_LOST} / 100.0 + 3.58"), f"{money('n')} {money(f'{_LOST} / 100.0')} 3.58"),
        (f"{money('n')} ‹{_LOST}› 300", "0.9 0.4 0.5", X(f"n + {_LOST} / 100.0 + 3.58"), f"{money('n')} {money(f'{_LOST} / 100.0 + 0.58')} 3.00"),
        (f"{money('n')} 20.00", "0.9 0.9", X("n + 80"), None),
        (f"{money('n')} 20.00", "0.9 0.9", X("n + 20"), f"{money('n')} 20.00"),
    ),
    _decimals,
)

_DIGITS = "‹lpad(CAST(id AS string), 12, '7')›"
cases("marketplace_number", "number string", "number varchar", ((f"ISS1{_DIGITS}", f"ISSI{_DIGITS}"), (f"ISSI{_DIGITS}", f"ISSI{_DIGITS}"), ("ISS1‹lpad(CAST(id AS string), 11, '7')›", "ISS1‹lpad(CAST(id AS string), 11, '7')›"), (f"issl{_DIGITS}", f"ISSI{_DIGITS}"), (None, None)), lambda df: [ownership.marketplace_number(_c("number"))])
cases(
    "shown_quantity",
    "q string",
    "q varchar",
    (("‹id›.000", "‹id›"), ("1,‹id % 900 + 100›.50", "1‹id % 900 + 100›.5"), ("0.00", "0"), ("-0.0", "0"), (None, "—"), (" ", "—"), ("no. ‹id›", "no. ‹id›"), ("‹id›0", "‹CASE WHEN id = 0 THEN 0 ELSE id * 10 END›"), ("‹id + 1›00", "‹id + 1›00"), ("NaN", "—")),
    lambda df: [ownership.shown_quantity(_c("q"))],
)

cases(
    "plain_number",
    "number string, text string",
    "number varchar",
    (("SI# 00‹id›", "", "00‹id›"), ("S.I. No.: ‹id›-1", "", "‹id›-1"), (None, "Total 5\nSI No. 45‹id + 10›\n", "45‹id + 10›"), (None, "SI No. 45‹id + 10›\nSI No. 56‹id + 10›", None), ("A-‹id›", "SI No. 4521", "A-‹id›"), (None, "see SI No. 45‹id + 10› of May", None)),
    lambda df: [ownership.plain_number(_c("number"), _c("text"))],
)
cases("owner", "vendor string, text string", "vendor varchar", ((None, "DATA SHOP\nOwned & Operated by: Orion ‹id› Inc.\nx", "Orion ‹id› Inc."), ("‹c›", "Operated by Orion Inc.", "‹c›"), (" ", "Operated by: ‹id›", None), (None, "nothing", None)), lambda df: [ownership.owner(_c("vendor"), _c("text"))])
cases("buyer_name", "name string, text string", "name varchar", (("‹c›", "Registered Name: ____\nTIN: 1", None), ("‹c›", "Registered Name: ‹c›\nTIN", "‹c›"), ("‹c›", "Registered Name\n‹c›\nTIN", "‹c›"), ("‹c›", "Registered Name:", "‹c›")), lambda df: [ownership.buyer_name(_c("name"), _c("text"))])
_FORM = "No. 77\nReceived from\nAddress of buyer\nin payment for the following\n%s\nSeller\nTotal receipts %s\nAccredited ‹2000 + id %% 20›"
cases("unused_form", "text string", "unused boolean", ((_FORM % ("item", ""), True), (_FORM % ("item ‹id›", ""), False), (_FORM % ("item", money("n")), False), ("Received from\nTotal receipts", False)), lambda df: [ownership.unused_form(_c("text"))])

cases(
    "first_json",
    "text string",
    "a double",
    (('```json\n{"a": ‹id›}\n```', X("id")), ('{no} then {"a": ‹n›} and {"a": 4}', X("n")), ('so {"b": {"c": "}"}, "a": ‹id›} it is', X("id")), ("none ‹id›", None), ('{"a": ‹id›', None), (None, None)),
    lambda df: [scalars.first_json(_c("text"), "a double")["a"]],
)
