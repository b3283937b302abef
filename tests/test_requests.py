"""Requests in plain words: the plan of each, or none."""

from datetime import date

import pytest

from tallyspark.plans import language, search

_CONTEXT = {"vendors": ["North Pier", "North Pier Cafe", "Oxbow"], "categories": ["Repairs", "Rent"], "users": ["ines"], "actions": ["RENAME"], "types": ["ledger"]}
#: Page, request, and what it comes to on Wednesday, 12 March 2031: family:field:operator:value:value2, in order of family.
_REQUESTS = (
    ("history", "list all records", ""),
    ("history", "bills may 2029", "dates:invoice_date:between:2029-05-01:2029-05-31"),
    ("history", "uploaded may 2029", "dates:date_uploaded:between:2029-05-01:2029-05-31"),
    ("logs", "may 2029", "dates:date_time:between:2029-05-01:2029-05-31"),
    ("history", "from feb through apr 2028", "dates:invoice_date:between:2028-02-01:2028-04-30"),
    ("history", "from nov to jan", None),
    ("history", "second quarter of 2027", "dates:invoice_date:between:2027-04-01:2027-06-30"),
    ("history", "q5 2027", None),
    ("history", "yesterday", "dates:invoice_date:between:2031-03-11:2031-03-11"),
    ("history", "last week", "dates:invoice_date:between:2031-03-03:2031-03-09"),
    ("history", "this month", "dates:invoice_date:between:2031-03-01:2031-03-31"),
    ("history", "last year", "dates:invoice_date:between:2030-01-01:2030-12-31"),
    ("history", "last 10 days", "dates:invoice_date:between:2031-03-03:2031-03-12"),
    ("history", "between 2030-02-03 and 2030-02-09", "dates:invoice_date:between:2030-02-03:2030-02-09"),
    ("history", "between 2030-02-09 and 2030-02-03", None),
    ("history", "without an invoice number", "presence:invoice_number:missing"),
    ("history", "with plate no", "presence:plate_number:present"),
    ("history", "without a sequel", None),
    ("history", "between php 5 and 1k", "numbers:total_amount:between:5.0:1000.0|choices:currency:in:PHP"),
    ("history", "at least $3,000.50", "numbers:total_amount:>=:3000.5|choices:currency:in:USD"),
    ("history", "under ₱99", "numbers:total_amount:<:99.0|choices:currency:in:PHP"),
    ("history", "over 3 dollars and under 4 pesos", None),
    ("history", "oxbow and north pier cafe", "text:vendor_name:contains_any:North Pier Cafe,Oxbow"),
    ("history", "Bayview bills", None),
    ("history", "needs-review rent", "choices:status:in:needs_review|choices:category:in:Rent"),
    ("history", "unlocked", "booleans:locked:False"),
    ("log", "RENAME by user ines, ledger", "text:user:equals:ines|text:action:equals:RENAME|text:entity_type:equals:ledger"),
    ("log", "over 70", None),
    ("vendors", "may 2029", None),
)




def _said(plan: dict | None) -> str | None:
    if plan is None:
        return None
    show = lambda c: ":".join([",".join(v) if isinstance(v, list) else str(v) for k, v in c.items()])
    return "|".join(f"{family}:{show(c)}" for family, conditions in plan.items() for c in conditions)


@pytest.mark.parametrize(("page", "request_", "want"), _REQUESTS)
def test_request(page, request_, want):
    assert _said(language.parse(request_, page=page, context=_CONTEXT, today=date(2031, 3, 12))) == want


PRESENCE = (
    ("odd ones without any plate number", {"text": [{"field": "vendor_name", "operator": "contains", "value": "x"}], "numbers": []}, "text:vendor_name:contains:x|presence:plate_number:missing"),
    ("having a vendor tin", {"text": [{"field": "vendor_tax_id", "operator": "equals", "value": "9"}]}, "presence:vendor_tax_id:present"),
    ("with total amount over 5", {"numbers": [{"field": "total_amount", "operator": ">", "value": 5}]}, "numbers:total_amount:>:5"),
    ("no line items, has due date", {}, "presence:line_items:missing|presence:due_date:present"),
    ("vendor names of interest", {"text": [{"field": "vendor_name", "operator": "contains", "value": "x"}]}, "text:vendor_name:contains:x"),
)


@pytest.mark.parametrize(("request_", "plan", "want"), PRESENCE)
def test_presence_outranks_a_model(request_, plan, want):
    assert _said(language.with_presence(request_, search.empty() | plan)) == want


def test_an_invoice_without_an_upload_day_was_not_uploaded_then(spark):
    from datetime import date

    from tallyspark import queries_records as q
    from tallyspark.plans import language

    rows = spark.sql("SELECT 1L AS id, DATE '1997-05-03' AS date_uploaded UNION ALL SELECT 2L, NULL")
    plan = language.parse("uploaded may 1997", page="history", today=date(1998, 1, 1))
    assert [tuple(r) for r in q._selected(rows, [plan]).collect()] == [(0, 1, 1)]
