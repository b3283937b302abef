"""Ranked lexical search over a tiered index, exact.

The index holds a posting for each document and term: the term's contribution to a score. Postings
lie in tiers by contribution, the highest first, and for each term and tier the index has the
residual bound: the most that a posting of a lower tier adds. A search reads tier 0 of every term.
The ten best partial sums of an item are a floor; a document that was not met scores at most the sum
of the residual bounds of the item's terms. Once the floor is above that sum, only documents that
were met can be among the best: those whose partial sum and the bounds of the terms not met reach the
floor are completed from all tiers, and ranked. Items without that proof fall through to the next
tier, as deep as it takes; terms whose bounds together stay below the floor need not go deeper
(they are read for the documents to be completed only). In the last tier the bounds are zero, so
every item ends with a proof.

Weights, contributions and scores are 64-bit integers. Terms are runs of ASCII letters (lower-cased),
digits and any characters beyond ASCII. Documents are numbered where they are indexed, so rows that
repeat an id, or have none, are documents of their own.

Defined results: a null text has no term; items without terms, or whose terms no document has, have
no rows; equal scores rank by doc_id, documents without id last; rows that repeat an item are
searched as items of their own; an empty table gives an empty result; other columns are ignored.
Terms that no item has are counted into the length of a document, and not kept in the index.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import materialize, scratch_path

#: A posting's tier is the first whose least contribution (thousandths of a nat at full saturation, times 10^6) it reaches.
TIERS = (2_000_000_000, 1_000_000_000, 500_000_000, 250_000_000, 0)
BEST = 10
#: Pairs of item and term, and documents to be completed, up to this number are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Terms sent to the JVM at once.
SEND = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_LOWER).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, text) to a row for each term of it, and one of the empty term with the number of all terms."""
    schema = ["row", "id", "term", "tf", "n"]
    for b in batches:
        text = b.column(2).cast(pa.binary())
        at, words, often, size = [], [], [], []
        held = 0
        for i in range(b.num_rows):
            counts = Counter(terms(text[i].as_py() or b""))
            total = counts.total()
            at.append((i, len(counts) + 1, total))
            words.append(b"")
            words += counts.keys()
            often.append(total)
            often += counts.values()
            held += len(counts)
            if held < SEND and i + 1 < b.num_rows:
                continue
            of, each, n = (np.array(x, np.int64) for x in zip(*at, strict=True))
            of = np.repeat(of, each)
            size = pa.array(np.repeat(n, each))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(often, pa.int64()), size], schema)
            at, words, often, held = [], [], [], 0


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own for each row of the table), id, term, tf, n; the empty term stands for the row itself, with tf = n terms."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted, "row long, id long, term string, tf long, n long")


@dataclass
class Index:
    """postings (tid, row, id, tier, gain) in folders by tier; bounds (tid, tier, bound): the most that a lower tier's posting of the term adds."""

    postings: DataFrame
    bounds: DataFrame


def build_index(docs: DataFrame, vocabulary: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index all documents for the terms of a vocabulary (term, tid)."""
    spark = docs.sparkSession
    # terms outside the vocabulary end here: only the join's hits are written
    known = vocabulary.select("term", "tid").unionByName(spark.createDataFrame([("", -1)], "term string, tid long"))
    hits = materialize(term_counts(docs, id_col, text_col).join(_small(known), "term").select("tid", "row", "id", "tf", "n"), "hits")
    total = hits.filter("tid = -1").agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    found = hits.filter("tid >= 0")
    # doubles only for the weight; (2N + 2) / (2 df + 1) is above 1
    df = found.groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    weights = materialize(df.select("tid", F.floor(1000 * F.log(F.lit(2.0 * total["N"] + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("w")), "weights")
    m = F.expr(f"10L + (90L * n * {total['N']}L) div {max(total['L'], 1)}L")
    gain = F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")
    tier = F.lit(len(TIERS) - 1)
    for k in range(len(TIERS) - 2, -1, -1):
        tier = F.when(F.col("gain") >= TIERS[k], k).otherwise(tier)
    gains = found.join(_small(weights), "tid").withColumn("m", m).withColumn("gain", gain).filter("gain > 0").select("tid", "row", "id", "gain", tier.alias("tier"))
    path = scratch_path(spark, "postings")
    gains.write.partitionBy("tier").parquet(path)
    postings = spark.read.schema("tid long, row long, id long, gain long, tier int").parquet(path)
    tops = postings.groupBy("tid", "tier").agg(F.max("gain").alias("top"))
    lower = Window.partitionBy("tid").orderBy(F.desc("tier")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each tier t that the term has: the most of tiers t and below bounds what a search that ended above t has not seen
    return Index(postings, materialize(tops.select("tid", F.col("tier"), F.max("top").over(lower).alias("bound")), "bounds"))


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _residuals(plan: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pairs (item, tid, depth) with the bound of what lies below the tiers that were read."""
    below = plan.join(bounds, "tid", "left").groupBy("item", "tid", "depth").agg(F.max(F.when(F.col("tier") > F.col("depth"), F.col("bound"))).alias("bound"))
    return below.withColumn("bound", F.coalesce("bound", F.lit(0).cast("long")))


def _best(sums: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(score), F.asc_nulls_last("id"), "row")
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, *, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item, by score and then by doc_id."""
    asked = materialize(term_counts(items, item_col, text_col).filter("term <> ''").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term"), "item_terms")
    vocabulary = materialize(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary")
    index = build_index(docs, vocabulary, id_col=id_col, text_col=text_col)
    pairs = materialize(asked.join(vocabulary, "term").select("item", "item_id", "tid"), "pairs")
    plan = _residuals(pairs.select("item", "tid", F.lit(0).alias("depth")), index.bounds)
    done = []
    for tier in range(len(TIERS)):
        plan = materialize(plan, "plan")
        met = index.postings.filter(F.col("tier") <= tier).join(_small(plan), "tid").filter(F.col("tier") <= F.col("depth"))
        met = materialize(met.groupBy("item", "row").agg(F.first("id").alias("id"), F.sum("gain").alias("part"), F.sum("bound").alias("met_bound")), "met")
        floor = _best(met, "part", best).groupBy("item").agg(F.min("part").alias("floor"), F.count(F.lit(1)).alias("n"))
        floor = floor.select("item", F.when(F.col("n") == best, F.col("floor")).otherwise(0).alias("floor"))
        rest = plan.groupBy("item").agg(F.sum("bound").alias("rest")).join(floor, "item", "left").select("item", "rest", F.coalesce("floor", F.lit(0)).alias("floor"))
        rest = materialize(rest.withColumn("proved", (F.col("rest") < F.col("floor")) | (F.col("rest") == 0)), "proofs")
        few = _small(rest)
        candidates = met.join(few.filter("proved"), "item").filter(F.col("part") + F.col("rest") - F.col("met_bound") >= F.col("floor"))
        done.append(candidates.select("item", "row"))
        if tier == len(TIERS) - 1 or not rest.filter(~F.col("proved")).limit(1).count():
            break
        # the smallest bounds that together stay below the floor: their terms are not read further down
        open_ = plan.join(few.filter(~F.col("proved")), "item")
        running = F.sum("bound").over(Window.partitionBy("item").orderBy("bound", "tid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        deeper = F.when(running < F.col("floor"), F.col("depth")).otherwise(F.lit(tier + 1))
        plan = _residuals(open_.select("item", "tid", deeper.alias("depth")), index.bounds)
    candidates = done[0]
    for d in done[1:]:
        candidates = candidates.unionByName(d)
    candidates = materialize(candidates, "candidates")
    wanted = index.postings.join(_small(candidates.select("row").distinct()), "row").select("tid", "row", "id", "gain")
    full = wanted.join(candidates, "row").join(_small(pairs), ["item", "tid"]).groupBy("item", "row").agg(F.first("item_id").alias("item_id"), F.first("id").alias("id"), F.sum("gain").alias("score"))
    return _best(full.filter("score > 0"), "score", best).select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


#: Every document scored for every item, without tiers.
RANKED_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM benchmark),
s AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS bigint) AS all_docs, CAST(greatest(coalesce(sum(len(ts)), 0), 1) AS bigint) AS all_terms FROM d),
p AS (
    SELECT row, doc_id, n, t, count(*) AS tf FROM (
        SELECT row, doc_id, CAST(len(ts) AS bigint) AS n, translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM d
    ) x GROUP BY ALL
),
q AS (SELECT DISTINCT item, item_id, t FROM (SELECT item, item_id, translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM b) x),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS double) / CAST(2 * count(*) + 1 AS double))) AS bigint) AS w FROM p, s GROUP BY t, all_docs),
g AS (SELECT row, doc_id, p.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))) AS gain FROM p JOIN w ON w.t = p.t, s),
r AS (SELECT q.item, item_id, row, doc_id, sum(gain) AS score FROM q JOIN g ON g.t = q.t GROUP BY q.item, item_id, row, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS integer) AS rank, doc_id, CAST(score AS bigint) AS score FROM k WHERE rank <= 10
"""
