"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.decontamination import find_leaks
from tallyspark.llm.filter_audit import AUDIT_SQL, audit_filters
from tallyspark.llm.mixing import mix
from tallyspark.llm.pii import pii_digest
from tallyspark.llm.pitman_yor import score_with_model
from tallyspark.llm.quality import judge_quality
from tallyspark.llm.ranked_search import RANKED_SQL, ranked_search
from tallyspark.llm.simhash import near_duplicates
from tallyspark.llm.suffixes import remove_copies
from tallyspark.llm.toxicity import score_documents
from tallyspark.llm.url_filters import listed_pages, listed_pages_sql
from tallyspark.llm.warc import warc_round_trip
from tallyspark.llm.windows import remove_repeats
from tallyspark.session import read_table, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, on all cores even where the table is a single file."""
    return spread(read_table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_copies(documents(spark, sf_dir))


def op10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_pages(spark, read_table(spark, sf_dir, "pages"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_with_model(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op9_pii": op9_pii, "op4_simhash": op4_simhash, "op3_warc": op3_warc, "op8_suffixes": op8_suffixes, "op10_windows": op10_windows, "op7_quality": op7_quality, "op6_decontamination": op6_decontamination, "op2_toxicity": op2_toxicity, "op5_url_filters": op5_url_filters, "op11_language_model": op11_language_model, "op12_filter_audit": op12_filter_audit, "op13_ranked_search": op13_ranked_search}


#: op3: who stores an equal payload first; sizes and digests of the whole payload.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(n AS bigint) AS payload_bytes, d.digest AS payload_digest, CASE WHEN first < page_id OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id OR page_id IS NULL THEN first END AS refers_to
FROM d LEFT JOIN f ON f.digest = d.digest
"""

#: op8: 50-byte strings by their hex digits, and what is left outside the runs that they cover.
SUFFIXES_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
starts AS (SELECT doc_id, t, unnest(range(0, length(t) // 2 - 49)) AS i FROM h WHERE length(t) >= 100),
keyed AS (SELECT doc_id, i, substr(t, 2 * i + 1, 100) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM keyed JOIN firsts ON keyed.k = firsts.k WHERE first < doc_id),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS opens, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits),
runs AS (SELECT doc_id, i, sum(CAST(opens AS integer)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS free FROM spans),
kept AS (
    SELECT e.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(t, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) AS head, max(z) AS last
    FROM edges e JOIN h ON h.doc_id = e.doc_id GROUP BY e.doc_id
)
SELECT h.doc_id, CAST(length(t) // 2 AS bigint) AS n_bytes, CAST(coalesce(n_removed, 0) AS bigint) AS n_removed, CAST(coalesce(n_spans, 0) AS bigint) AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(t, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN kept ON kept.doc_id = h.doc_id
"""

#: op10: windows of 35 words, each as one string.
WINDOWS_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS k FROM starts),
twice AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM keyed SEMI JOIN twice ON keyed.k = twice.k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM hits),
kept AS (
    SELECT doc_id, array_to_string(list(word ORDER BY i), ' ') AS text, count(*) AS n
    FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i
    GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS bigint) AS n_words, CAST(len(words) - coalesce(n, 0) AS bigint) AS n_removed, sha256(encode(coalesce(kept.text, ''))) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can state the result; the others are tested against plain versions in tests/llm."""
    return {"op3_warc": WARC_SQL, "op5_url_filters": listed_pages_sql(), "op8_suffixes": SUFFIXES_SQL, "op10_windows": WINDOWS_SQL, "op12_filter_audit": AUDIT_SQL, "op13_ranked_search": RANKED_SQL}
