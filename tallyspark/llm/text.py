"""Text conventions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that separate words; a word is a run of anything else.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns with their names, so that rows are equal where it is; a null is none of the texts."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
