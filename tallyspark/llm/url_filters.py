"""URL filters over time: dated list entries become validity intervals, captures are joined as of their fetch.

An entry is (list, kind, rule, action, dated_at): at that time the list adds or removes the rule. A
rule is a host with an optional path; it covers the host's subdomains and whatever lies below the
path. An add is valid until the rule's next entry on that list. A capture's keys are its host's
suffixes of no more labels than the longest rule's host, each with the beginnings of its path down to
the deepest rule, so matching is an equality join, whatever the host's length; intervals are dealt by month as well, so a long history meets only its captures' months.
Of the rules active at the fetch the longest decides, allowing before blocking.

Intervals up to ``BROADCAST_ROWS`` rows are broadcast. More are joined by shuffle, captures salted
and intervals repeated for each salt, as one host may hold a third of all captures.

Defined results: a null or malformed url and a null fetch time match
nothing and are not blocked; entries with a null field are ignored; of entries with one time the
removal comes last; repeated captures get a row each; no entries block nothing; an empty table
gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import materialize

BROADCAST_ROWS = 100_000
SALTS = 16
#: The lists of the registered query.
ENTRIES = (
    ("ads", "block", "ads-track.example.com", "add", "2024-01-10"),
    ("ads", "block", "ads-track.example.com", "remove", "2024-05-01"),
    ("ads", "block", "ads-track.example.com", "add", "2024-08-15"),
    ("spam", "block", "spam-farm.example.com", "add", "2023-11-01"),
    ("spam", "block", "example.net", "add", "2024-06-01"),
    ("spam", "block", "example.net", "remove", "2024-07-01"),
    ("spam", "block", "blog.tionsh.example.com", "add", "2024-03-01"),
    ("spam", "block", "blog.tionsh.example.com", "add", "2024-04-01"),
    ("spam", "block", "blog.tionsh.example.com", "remove", "2024-10-01"),
    ("lang", "block", "example.org/de", "add", "2024-02-01"),
    ("lang", "block", "example.com/es", "add", "2024-09-01"),
    ("trusted", "allow", "tionble.example.org", "add", "2024-01-01"),
    ("trusted", "allow", "spam-farm.example.com/en", "add", "2024-04-01"),
    ("trusted", "allow", "spam-farm.example.com/en", "remove", "2024-11-01"),
)
ENTRY = "list string, kind string, rule string, action string, dated_at string"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, rule, since, until (null: still valid) for each add."""
    rows = entries.select("list", "kind", F.lower(F.rtrim(F.regexp_replace("rule", "/+$", ""))).alias("rule"), "action", F.col("dated_at").cast("timestamp").alias("since")).dropna()
    over = Window.partitionBy("list", "rule").orderBy("since", "action")
    rows = rows.withColumn("until", F.lead("since").over(over))
    return rows.filter((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("since")))).drop("action")


def _month(t: Column) -> Column:
    return (F.year(t) * 12 + F.month(t)).cast("int")


def _keys(host: Column, path: Column, labels_in_rules: int, depth: int) -> Column:
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, labels_in_rules)))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    if not depth:
        return suffixes
    parts = F.filter(F.slice(F.split(path, "/"), 2, depth), lambda p: p != "")
    ways = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.when(d == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.lower(F.array_join(F.slice(parts, 1, d), "/")))))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(ways, lambda w: F.concat(s, w)))))


def url_verdicts(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """page_id, host, fetched_at, n_active, lists, rule (the deciding one), blocked for each capture."""
    base = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("fetched_at"), F.monotonically_increasing_id().alias("row"))
    base = materialize(base.withColumn("host", host_of(F.col("url"))), "captures")  # rows keep their numbers from here on
    valid = materialize(intervals(entries), "intervals")
    bounds = base.agg(F.min("fetched_at").alias("low"), F.max("fetched_at").alias("high")).first()
    rules = valid.agg(F.max(F.size(F.split("rule", "/")) - 1), F.max(F.size(F.split(F.substring_index("rule", "/", 1), "\\.")))).first()
    low, high = (F.lit(bounds[k]).cast("timestamp") for k in ("low", "high"))
    last = F.least(F.coalesce("until", high), high)
    dealt = valid.filter((F.col("since") <= high) & (F.col("until").isNull() | (F.col("until") > low)))
    dealt = dealt.withColumn("month", F.explode(F.sequence(_month(F.greatest("since", low)), _month(last))))
    asked = base.filter((F.col("host") != "") & F.col("fetched_at").isNotNull())
    asked = asked.select("row", "fetched_at", _month(F.col("fetched_at")).alias("month"), F.explode(_keys(F.col("host"), path_of(F.col("url")), rules[1] or 0, rules[0] or 0)).alias("rule"))
    on = ["rule", "month"]
    if dealt.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on.append("salt")
    active = asked.join(dealt, on).filter((F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("until") > F.col("fetched_at"))))
    found = active.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.max(F.struct(F.length("rule").alias("n"), (F.col("kind") == "allow").alias("allow"), F.col("rule"))).alias("top"),
    )
    return base.join(found, "row", "left").select(
        "page_id",
        "host",
        "fetched_at",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.col("top.rule").alias("rule"),
        F.coalesce(~F.col("top.allow"), F.lit(False)).alias("blocked"),
    )


def listed_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The registered query: pages have no fetch time, so each gets a day of 2024 by its id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)) * 37, F.lit(366)).cast("int"))
    entries = spark.createDataFrame(list(ENTRIES), ENTRY)
    out = url_verdicts(pages.select("page_id", "url", day.cast("timestamp").alias("fetched_at")), entries)
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd"))


def listed_pages_sql() -> str:
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in e) + ")" for e in ENTRIES)
    return f"""
    WITH entries(list, kind, rule, action, dated_at) AS (VALUES {values}),
    valid AS (
        SELECT list, kind, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rule_path, action,
            CAST(dated_at AS date) AS since, lead(CAST(dated_at AS date)) OVER (PARTITION BY list, rule ORDER BY dated_at, action) AS until
        FROM entries
    ),
    captures AS (
        SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host, lower(regexp_extract(url, '{PATH}', 1)) AS path,
            DATE '2024-01-01' + CAST(page_id * 37 % 366 AS integer) AS fetched
        FROM pages
    ),
    active AS (
        SELECT page_id, list, kind, v.rule FROM captures c JOIN valid v
        ON v.action = 'add' AND v.since <= c.fetched AND (v.until IS NULL OR v.until > c.fetched)
            AND (c.host = v.rule_host OR ends_with(c.host, '.' || v.rule_host))
            AND (v.rule_path = '' OR c.path = v.rule_path OR starts_with(c.path, v.rule_path || '/'))
    ),
    found AS (
        SELECT page_id, count(*) AS n_active, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
            arg_max(rule, length(rule) * 2 + CASE kind WHEN 'allow' THEN 1 ELSE 0 END) AS rule,
            arg_max(kind, length(rule) * 2 + CASE kind WHEN 'allow' THEN 1 ELSE 0 END) AS kind
        FROM active GROUP BY page_id
    )
    SELECT c.page_id, c.host, strftime(c.fetched, '%Y-%m-%d') AS fetched_at, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, f.rule,
        coalesce(f.kind = 'block', false) AS blocked
    FROM captures c LEFT JOIN found f ON f.page_id = c.page_id
    """
