"""The service's calls as plain functions over tables: list, statistics, search, one, delete, export.

Each returns a DataFrame; what a caller asks for and is not there, or may not be touched, is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import reports
from tallyspark.plans import search as plans
from tallyspark.sources import exports


class Locked(Exception):
    """The invoice is locked and stays."""


def list_invoices(rows: DataFrame, limit: int | None = 100, status: str | None = None) -> DataFrame:
    """The newest invoices, of a status if one is given."""
    return reports.newest(rows, limit, status=status)


def search_invoices(rows: DataFrame, text: str) -> DataFrame:
    """Invoices that hold a text in one of the searched fields; an empty text is an error."""
    if not text.strip():
        raise ValueError("search for at least one character")
    return plans.keyword(rows, text)


def get_invoice(rows: DataFrame, id: int) -> DataFrame:
    found = rows.filter(F.col("id") == id)
    if found.isEmpty():
        raise LookupError(f"no invoice {id}")
    return found


def delete_invoice(rows: DataFrame, id: int) -> DataFrame:
    """The table without an invoice, which must be there and not locked."""
    if get_invoice(rows, id).filter("locked").limit(1).count():
        raise Locked(f"invoice {id} is locked")
    return rows.filter(F.col("id") != id)


def export_invoices(rows: DataFrame, folder: str, kind: str, status: str | None = None) -> None:
    """Write all invoices of a status with their totals; none is an error."""
    chosen = rows.filter(F.col("status") == status) if status else rows
    if chosen.isEmpty():
        raise LookupError("no invoices to export")
    exports.write(exports.with_totals(chosen), folder, kind)
