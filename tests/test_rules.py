"""Rules of documents on constructed cases: each rule's answer, and the cases in which it must leave things alone."""

import math

import pytest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import ownership

CASES = {}


def cases(name, inputs, outputs, rows, rule, change=None):
    """inputs and outputs are schemas; a row holds the inputs and then the outputs. rule gives a column for each output; change, in its place, a table."""
    CASES[name] = inputs, [o.split()[0] for o in outputs.split(", ")], rows, rule, change


_c = F.col

cases(
    "vendor_of_page",
    "vendor string, text string",
    "name varchar",
    (
        ("CHASE TECH CORP", "SM PARK\nName:\nHARBOR DEV CORP\nTotal 5.00\nPTU No 12\nChase Tech Corp", "HARBOR DEV CORP"),
        ("Ana Reyes", "CGI DEPOT INC\n12 Main Street\nTotal 9.00\nCashier\nAna Reyes", "CGI DEPOT INC"),
        ("Ana Reyes", "Some shop\nCashier\nAna Reyes", "Ana Reyes"),
        ("Fast Print Co, 9 Hill Road", "EMERALD ASSOCIATION INC\nItem 1\nAuthority to Print 77\nFAST PRINT CO\n9 Hill Road", "EMERALD ASSOCIATION INC"),
        ("EMERALD ASSOCIATION INC", "EMERALD ASSOCIATION INC\nItem 1\nx\nx\nx\nAuthority to Print 77\nFAST PRINT CO", "EMERALD ASSOCIATION INC"),
        ("Elsewhere Ltd", "CGI DEPOT INC\nCashier\nAna", "Elsewhere Ltd"),
        (None, "CGI DEPOT INC\nCashier", None),
    ),
    lambda df: [ownership.vendor_of_page(_c("vendor"), _c("text"))],
)

cases(
    "seller_address",
    "address string, vendor string, text string",
    "address varchar",
    (
        (None, "Acme", "ACME INC\n12 Quay Street\nUnit 5 Harbor Tower\nTel 555\nTIN 1\n99 Other Road", "12 Quay Street, Unit 5 Harbor Tower"),
        ("Acme 12 Quay Street", "Acme", "ACME INC\n12 Quay Street\n12 Quay Street\nBill to Delta\n99 Other Road", "12 Quay Street"),
        ("7 Long Avenue, Northern District, Pasig City", "Acme", "ACME INC\n12 Quay Street", "7 Long Avenue, Northern District, Pasig City"),
        ("12 Quay Street, Harbor City, Philippines 1200 ask us about loans", "Acme", "12 Quay Street\nHarbor City, Philippines 1200\n5 Second Road", "12 Quay Street, Harbor City, Philippines 1200"),
        ("12 Quay Street, Philippines", "Acme", "no place here", "12 Quay Street, Philippines"),
    ),
    lambda df: [ownership.seller_address(_c("address"), _c("vendor"), _c("text"))],
)

cases(
    "first_site",
    "address string",
    "address varchar",
    (("12 Quay St, Pasig 1600, 3/F Other Bldg, Makati", "12 Quay St, Pasig 1600"), ("12 Quay St,  Pasig 1600\n2nd floor Tower", "12 Quay St, Pasig 1600"), ("2nd floor Tower, Pasig 1600", "2nd floor Tower, Pasig 1600"), (None, None)),
    lambda df: [ownership.first_site(_c("address"))],
)

cases(
    "filled_in",
    "customer_name string, customer_tax_id string, customer_address string, plate_number string",
    "customer_name varchar, customer_tax_id varchar, customer_address varchar, plate_number varchar",
    (
        ("Name: ______", "TIN:", "Business Address ....", "Plate No. : ", None, None, None, None),
        ("Named Ltd", "123", "Address Road 5", "ABC 123", "Named Ltd", "123", "Address Road 5", "ABC 123"),
        ("", "-", " : ", "___", None, None, None, None),
    ),
    None,
    ownership.filled_in,
)

cases(
    "buyer_address",
    "address string, text string",
    "address varchar",
    (("123.45", "Name\nAddress:\n\nTIN:\nTotal 123.45", None), ("9 Hill", "Address:\n9 Hill\nTIN:", None), ("9 Hill", "Address: 9 Hill\nTIN:", "9 Hill"), ("9 Hill", "Address:\n9 Hill\nUnit 2\nTIN:", "9 Hill"), ("5", "Address\nBusiness Style\n5", None)),
    lambda df: [ownership.buyer_address(_c("address"), _c("text"))],
)

cases(
    "seller_tin",
    "vendor string, customer string, text string",
    "tin varchar",
    (
        ("123-456-789", "123456789000", "VAT REG TIN 222-333-444-000\nTIN 123-456-789", "222-333-444-000"),
        ("123-456-789", "123456789000", "VAT REG TIN 222-333-444\nTIN 555-666-777", None),
        ("123-456-789", "123-456-789", "no other here 222-333-444", None),
        ("123-456-789", "999-456-789", "VAT REG TIN 222-333-444", "123-456-789"),
        ("12-34", "12-34", "TIN 222-333-444", "12-34"),
    ),
    lambda df: [ownership.seller_tin(_c("vendor"), _c("customer"), _c("text"))],
)

cases(
    "issue_date",
    "current string, text string",
    "day varchar",
    (
        (None, "Issue Date: March 5, 2024\nDue Date: April 4, 2024", "2024-03-05"),
        (None, "Due Date: April 4, 2024\nIssue Date: Mar 5 2024", "2024-03-05"),
        ("2020-01-01", "Issue Date\nDate Issued: March 5, 2020", "2020-01-01"),
        ("2020-01-01", "Issue Date: March 5, 2024\nInvoice Date: March 6, 2024", "2020-01-01"),
        ("2020-01-01", "March 5, 2024", "2020-01-01"),
    ),
    lambda df: [F.date_format(ownership.issue_date(_c("current").cast("date"), _c("text")), "yyyy-MM-dd")],
)

cases(
    "retail_summary",
    "subtotal double, tax_amount double, discount double, total_amount double, text string",
    "subtotal double, tax_amount double, discount double, total_amount double",
    (
        (1.0, 2.0, None, 3.0, "VAT SALE\n100.00\nSUBTOTAL\n112.00\nCASH\n500.00", 100.0, 12.0, None, 112.0),
        (1.0, 2.0, None, 3.0, "VAT SALE\n100.00\nSUBTOTAL\n190.00", 1.0, 2.0, None, 3.0),
        (1.0, 2.0, None, 3.0, "LESS 12% VAT\n10.71\nAMOUNT TO PAY\n80.00", 1.0, 0.0, 10.71, 80.0),
        (1.0, 2.0, 25.0, 3.0, "LESS 12%VAT\n-10.71\nAMOUNT TO PAY\nCASH\n100.00", 1.0, 0.0, 25.0, 3.0),
        (1.0, 2.0, None, 3.0, "SUBTOTAL\n112.00", 1.0, 2.0, None, 3.0),
    ),
    None,
    ownership.retail_summary,
)

cases(
    "retail_table",
    "total double, text string",
    "net double, vat double",
    (
        (112.0, "TAX CODE AMOUNT VAT AMT\nVAT SALE 100.00 12.00\nTOTAL 112.00", 100.0, 12.0),
        (112.0, "TAX CODE\nVAT SALE\nVAT EXEMPT SALE\nZERO RATED SALE\nTOTAL\n100.00\n0.00\n0.00\n100.00\n12.00\n0.00\n0.00\n12.00\nCASHIER NAME\n500.00", 100.0, 12.0),
        (113.0, "TAX CODE\nVAT SALE\nTOTAL\n100.00\n0.00\n0.00\n100.00\n12.00\n0.00\n0.00\n12.00", None, None),
        (112.0, "no table 100.00 12.00", None, None),
    ),
    lambda df: [ownership.retail_table(_c("text"), _c("total"))[k] for k in ("net", "vat")],
)

cases(
    "parking_tax",
    "tax double, total double, text string",
    "tax double",
    ((12.0, 60.0, "Parking Fee 60.00\nVAT Amount (12%)\n6.43", 6.43), (12.0, 60.0, "Parking Fee 60.00\nVAT Amount 12% 6.00", 12.0), (12.0, 60.0, "VAT Amount (12%) 6.43", 12.0), (None, 60.0, "Parking fee\nVAT Amount 12%\n6.43\n6.45", None)),
    lambda df: [ownership.parking_tax(_c("tax"), _c("total"), _c("text"))],
)

cases(
    "stated_subtotal",
    "subtotal double, tax double, total double, text string",
    "subtotal double",
    ((100.0, None, 100.0, "Charges 100.00", None), (100.0, 0.0, 100.04, "Charges", None), (100.0, 0.0, 100.0, "VATable Sales", 100.0), (100.0, 12.0, 100.0, "Charges", 100.0), (90.0, None, 100.0, "Charges", 90.0)),
    lambda df: [ownership.stated_subtotal(_c("subtotal"), _c("tax"), _c("total"), _c("text"))],
)

_BREAKDOWN = "Breakdown of electricity charges\nGeneration\n60.00\n40%\nTransmission\n20.00\nSystem Loss\n(5.00)\n{}Total Current Charges\n{}"
cases(
    "charge_rows",
    "current double, text string",
    "n double, checked double",
    (
        (100.0, _BREAKDOWN.format("Distribution\n25.00\n", "100.00"), 4, 4),
        (101.0, _BREAKDOWN.format("Distribution\n25.00\n", "101.00"), 4, None),
        (75.0, _BREAKDOWN.format("Distribution\nsee over\n", "75.00"), None, None),
        (100.0, "Generation\n60.00\nTransmission\n20.00\nSystem Loss\n10.00\nDistribution\n10.00", None, None),
    ),
    lambda df: [F.when((rows := ownership.charge_rows(_c("text"))).isNotNull(), F.size(rows).cast("double")), F.when((kept := ownership.checked_charges(rows, _c("current"))).isNotNull(), F.size(kept).cast("double"))],
)

cases(
    "plan_row",
    "text string",
    "description varchar, amount double",
    (
        ("GFiber Plan 1499\nStatement Summary\nMonthly Plan\n1,499.00\nTotal", "GFiber Plan 1499", 1499.0),
        ("GFiber Plan 1599\nStatement Summary\nMonthly Plan\n1,499.00", None, None),
        ("Statement Summary\nGFiber Plan 1499\nMonthly Plan\n1,499.00", None, None),
        ("GFiber Plan 1499\nMonthly Plan\n1,499.00", None, None),
    ),
    lambda df: [ownership.plan_row(_c("text"))[k] for k in ("description", "amount")],
)

cases(
    "credit_balance",
    "balance double, current double, total double, text string",
    "balance double",
    (
        (30.0, 100.0, 70.0, "", -30.0),
        (30.0, 100.0, 130.0, "", 30.0),
        (30.0, 100.0, 99.0, "Bill Summary\nBalance from Previous Bill\n200.00\nLess: Payments Received\n230.00", -30.0),
        (30.0, 100.0, 99.0, "Balance from Previous Bill\n200.00\nLess: Payments Received\n230.00", 30.0),
        (30.0, 100.0, 99.0, "Bill Summary\nBalance from Previous Bill\n200.00\nLess: Payments Received\n170.00", 30.0),
        (-30.0, 100.0, 70.0, "", -30.0),
    ),
    lambda df: [ownership.credit_balance(_c("balance"), _c("current"), _c("total"), _c("text"))],
)

_ITEM = "array<struct<description:string,quantity:double,unit_price:double,amount:double>>"


def _items(df: DataFrame) -> list[Column]:
    items = F.expr("array(named_struct('description', name, 'quantity', 2D, 'unit_price', 1D, 'amount', amount), named_struct('description', 'Other thing here', 'quantity', 1D, 'unit_price', 100D, 'amount', 100D))").cast(_ITEM)
    return [F.get(ownership.joined_price(items, _c("total"), _c("text")), F.lit(0))["amount"]]


cases(
    "joined_price",
    "name string, amount double, total double, text string",
    "amount double",
    (
        ("Travel suitcase", 250.0, 1350.0, "Travel suitcase\n1 250.00\n", 1250.0),
        ("Travel suitcase", 250.0, 1351.0, "Travel suitcase\n1 250.00\n", 250.0),
        ("Suitcase", 250.0, 1350.0, "Suitcase\n1 250.00\n", 250.0),
        ("Travel suitcase", 250.0, 1350.0, "1 250.00\nTravel suitcase\n", 250.0),
    ),
    _items,
)


def _decimals(df: DataFrame) -> list[Column]:
    rows = F.expr("transform(arrays_zip(split(v, ' '), split(c, ' ')), x -> named_struct('value', double(x['0']), 'decimals', contains(x['0'], '.'), 'confidence', double(x['1'])))")
    return [F.array_join(F.transform(ownership.with_decimals(rows, _c("total")), lambda v: F.format_number(v, 2)), " ")]


cases(
    "with_decimals",
    "v string, c string, total double",
    "v varchar",
    (("10.50 6592", "0.9 0.9", 76.42, "10.50 65.92"), ("10.50 6592 300", "0.9 0.8 0.5", 80.0, "10.50 65.92 3.58"), ("10.50 6592 300", "0.9 0.4 0.5", 80.0, "10.50 66.50 3.00"), ("10.50 20.00", "0.9 0.9", 80.0, None), ("10.50 20.00", "0.9 0.9", 30.5, "10.50 20.00")),
    _decimals,
)

cases("marketplace_number", "number string", "number varchar", (("ISS1123456789012", "ISSI123456789012"), ("ISSI123456789012", "ISSI123456789012"), ("ISS112345678901", "ISS112345678901"), ("issl123456789012", "ISSI123456789012"), (None, None)), lambda df: [ownership.marketplace_number(_c("number"))])
cases("shown_quantity", "q string", "q varchar", (("2.000", "2"), ("1,250.50", "1250.5"), ("0.00", "0"), ("-0.0", "0"), (None, "—"), (" ", "—"), ("three", "three"), ("10", "10"), ("100", "100"), ("NaN", "—")), lambda df: [ownership.shown_quantity(_c("q"))])

cases(
    "plain_number",
    "number string, text string",
    "number varchar",
    (("SI# 00123", "", "00123"), ("S.I. No.: 77-1", "", "77-1"), (None, "Total 5\nSI No. 4521\n", "4521"), (None, "SI No. 4521\nSI No. 4522", None), ("A-9", "SI No. 4521", "A-9"), (None, "see SI No. 4521 of May", None)),
    lambda df: [ownership.plain_number(_c("number"), _c("text"))],
)
cases("owner", "vendor string, text string", "vendor varchar", ((None, "DATA SHOP\nOwned & Operated by: Orion Inc.\nx", "Orion Inc."), ("DATA SHOP", "Operated by Orion Inc.", "DATA SHOP"), (" ", "Operated by: 12", None), (None, "nothing", None)), lambda df: [ownership.owner(_c("vendor"), _c("text"))])
cases("buyer_name", "name string, text string", "name varchar", (("Delta", "Registered Name: ____\nTIN: 1", None), ("Delta", "Registered Name: Delta\nTIN", "Delta"), ("Delta", "Registered Name\nDelta\nTIN", "Delta"), ("Delta", "Registered Name:", "Delta")), lambda df: [ownership.buyer_name(_c("name"), _c("text"))])
_FORM = "No. 77\nReceived from\nAddress of buyer\nin payment for the following\n{}\nSeller\nTotal receipts {}\nAccredited 2019"
cases("unused_form", "text string", "unused boolean", ((_FORM.format("item", ""), True), (_FORM.format("item 5", ""), False), (_FORM.format("item", "1.00"), False), ("Received from\nTotal receipts", False)), lambda df: [ownership.unused_form(_c("text"))])

cases(
    "first_json",
    "text string",
    "a double",
    (('```json\n{"a": 1}\n```', 1.0), ('{no} then {"a": 3} and {"a": 4}', 3.0), ('so {"b": {"c": "}"}, "a": 5} it is', 5.0), ("none", None), ('{"a": 6', None), (None, None)),
    lambda df: [scalars.first_json(_c("text"), "a double")["a"]],
)


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    inputs, names, rows, rule, change = CASES[name]
    n = len(inputs.split(", "))
    df = spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(rows)], f"id int, {inputs}")
    out = change(df).select("id", *names) if change else df.select("id", *[c.alias(o) for o, c in zip(names, rule(df), strict=True)])
    for got, want in zip(out.orderBy("id").collect(), rows, strict=True):
        for a, b in zip(got[1:], want[n:], strict=True):
            assert math.isclose(a, b) if isinstance(b, float) and a is not None else a == b, (name, got, want)
