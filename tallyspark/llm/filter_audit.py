"""Audit of how five document filters interact, in every order of application.

Each document gets five failure flags. Counts of documents by part and flags go through one
``CUBE`` over the flags and the part: the grouping-set row in which the selected flags are all
false counts what survives that subset of filters. A filter applied after others removes what
survives the others and not all of them, so each step of each order is a join of two subsets.

Texts are read once, to flags and a digest. Equal texts are found by digest with their rows counted
before anything is gathered, so a text that a third of the rows share is a few counts from each
task; of a document that stands in the table several times each row counts. The cube runs over
counts (32 for each part and label), not over documents.

Defined results: a null text is empty; an empty text has no words and fails A; a null part is the
empty string; a document without id is later than all others, so it repeats any equal text that has
an id, and rows without id do not repeat each other; several labels of a document count if any is
set; labels without id are ignored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.text import WORD, n_words
from tallyspark.session import materialize

FILTERS = "ABCDE"
#: A: fewest words; B: least share of distinct words; C: most share of capitals, both in percent; D: symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
_LAST = 2**63 - 1


def text_flags(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at the text alone."""
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})"))))
    words = n_words(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": words < LEAST_WORDS,
        "B": 100 * distinct.cast("long") < LEAST_DISTINCT * words,
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def flag_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, flags A to E, and the numbers of documents n, of good and of toxic ones."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    flags = text_flags(F.col("text"))
    rows = materialize(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in flags.items()]), "flags")
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    known = known.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = F.lit(False)
    # rows without id have no labels, and would all meet under one key of the join
    with_id = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    rows = with_id.unionByName(rows.filter("doc_id IS NULL").withColumns({"good": no, "toxic": no}))

    kind = ["digest", "part", *flags, "good", "toxic"]
    # rows of one id and text first, so that the rows that share the smallest id are counted; then one row from each task for a text and kind
    same = rows.groupBy(*kind, F.coalesce("doc_id", F.lit(_LAST)).alias("order")).agg(F.count(F.lit(1)).alias("n"))
    texts = same.groupBy(*kind).agg(F.min(F.struct("order", "n")).alias("first"), F.sum("n").alias("n"))
    least = F.min("first.order").over(Window.partitionBy("digest"))
    texts = texts.withColumn("firsts", F.when(F.col("first.order") == least, F.col("first.n")).otherwise(F.lit(0)))
    both = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("firsts").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("firsts")).alias("n"))))
    counted = texts.select("part", *flags, "good", "toxic", both.alias("e")).select("part", *flags, "e.E", "good", "toxic", "e.n")
    return counted.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def subset_survivors(counts: DataFrame) -> DataFrame:
    """part, subset (its letters in order) and n, good, toxic of the documents that fail no filter of it, zeros included."""
    cube = counts.cube("part", *FILTERS).agg(F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # bits of the grouping id: part, A, .. E; a set bit is a column that is not selected
    bits = {k: F.shiftright(F.col("gid"), len(FILTERS) - 1 - i).bitwiseAND(1) for i, k in enumerate(FILTERS)}
    selected = F.concat(*[F.when(bits[k] == 0, F.lit(k)).otherwise(F.lit("")) for k in FILTERS])
    passed = F.shiftright(F.col("gid"), len(FILTERS)) == 0
    for k in FILTERS:
        passed = passed & ~F.coalesce(F.col(k), F.lit(False))
    rows = cube.filter(passed).select("part", selected.alias("subset"), "n", "good", "toxic")
    subsets = ["".join(c) for r in range(len(FILTERS) + 1) for c in combinations(FILTERS, r)]
    every = counts.select("part").distinct().select("part", F.explode(F.array(*map(F.lit, subsets))).alias("subset"))
    zero = F.lit(0).cast("long")
    return every.join(rows, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, zero).alias(c) for c in ("n", "good", "toxic")])


def _steps(df: DataFrame) -> DataFrame:
    """All 120 orders by five steps: the filters before, and those with the step's own (600 rows whatever the input)."""
    rows = []
    for p in permutations(FILTERS):
        for i, k in enumerate(p):
            rows.append(("".join(p), i + 1, k, *["".join(sorted(x)) for x in (p[:i], p[: i + 1], (k,), set(FILTERS) - {k})]))
    return df.sparkSession.createDataFrame(rows, "filter_order string, step int, filter string, before string, after string, alone string, others string")


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    survivors = materialize(subset_survivors(materialize(flag_counts(docs, labels, **columns), "flag_counts")), "survivors")

    def of(name: str) -> DataFrame:
        return survivors.select(F.col("part").alias("p"), F.col("subset").alias(name), F.struct("n", "good", "toxic").alias(f"{name}_left"))

    out = F.broadcast(_steps(docs)).join(of("before"), "before").withColumnRenamed("p", "part")
    for name in ("after", "alone", "others"):
        out = out.join(of(name).withColumnRenamed("p", "part"), ["part", name])
    everything = survivors.filter(F.col("subset") == FILTERS).select("part", F.col("n").alias("survive_all"))
    whole = survivors.filter(F.col("subset") == "").select("part", F.col("n").alias("documents"))
    out = out.join(everything, "part").join(whole, "part")
    removed = F.col("before_left.n") - F.col("after_left.n")
    out = out.select(
        "part",
        "filter_order",
        "step",
        "filter",
        F.col("after_left.n").alias("kept"),
        removed.alias("removed"),
        (F.col("documents") - F.col("alone_left.n") - removed).alias("redundant"),
        (F.col("others_left.n") - F.col("survive_all")).alias("unique_fails"),
        (F.col("before_left.good") - F.col("after_left.good")).alias("good_lost"),
        (F.col("before_left.toxic") - F.col("after_left.toxic")).alias("toxic_lost"),
    )
    total = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(total, ["part", "filter"]).drop("filter")


#: Every order applied to every document, without the cube: the step that removes a document is its first failure in the order.
AUDIT_SQL = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
    SELECT row_number() OVER () AS row, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN w.doc_id > first OR w.doc_id IS NULL AND first IS NOT NULL THEN 'E' ELSE '' END AS fails
    FROM w JOIN firsts ON firsts.text = w.text LEFT JOIN l ON l.doc_id = w.doc_id
),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
orders AS (
    SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e
    WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k
),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
seen AS (
    SELECT part, filter_order, step, f, fails, good, toxic, contains(fails, f) AS failing,
        earlier <> '' AND len(list_intersect(string_split(earlier, ''), string_split(fails, ''))) > 0 AND fails <> '' AS gone
    FROM d, steps
),
counts AS (
    SELECT part, filter_order, CAST(step AS integer) AS step, f, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed, count(*) FILTER (gone AND failing) AS redundant,
        count(*) FILTER (fails = f) AS unique_fails, count(*) FILTER (NOT gone AND failing AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND failing AND toxic = 1) AS toxic_lost
    FROM seen GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS bigint) AS shapley FROM counts
"""
