"""The invoice model over the order tables: deterministic rules that turn orders, lines and events into
invoices, line items and an audit log, as DataFrames and as the SQL text that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import read_table

LINE_ITEM = "array<struct<description:string,quantity:double,unit_price:double,amount:double>>"
#: Fixed values of the mapping.
WORDS = {"ECONOMY": "grocery", "STANDARD": "bond paper", "PROMO": "fuel", "SMALL": "desk", "MEDIUM": "insurance"}
NAMES = ("Food", "Utilities", "Furnitures", "Office Supplies", "Transportation", "Insurance", "Medical & Health Supplies", "")
UNITS = ("PHP", "USD", "EUR", "₱", "P")
ACTIONS = {"view": "UPLOAD", "click": "EDIT", "purchase": "LOCK", "error": "DELETE"}


def _choose(key, options, default=None):
    items = list(options.items()) if isinstance(options, dict) else list(enumerate(options))
    out = F.when(key == items[0][0], items[0][1])
    for k, v in items[1:]:
        out = out.when(key == k, v)
    return out.otherwise(default)


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices without what only their lines tell: one scan of orders, customers and nations."""
    o, c, n = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    i, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    people = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_regionkey")
    return o.join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        i.alias("id"),
        F.when(i % 23 != 0, F.concat(F.lit("INV-"), F.lpad(i.cast("string"), 8, "0"))).alias("invoice_number"),
        day.alias("invoice_date"),
        F.col("o_orderdate").alias("created_at"),
        F.when(i % 11 != 0, F.date_add(day, (i % 45).cast("int"))).alias("date_uploaded"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), F.date_add(day, 30)).alias("due_date"),
        F.upper("c_name").alias("customer_name"),
        F.when(i % 17 != 0, _choose(F.col("n_regionkey"), UNITS)).alias("currency"),
        F.when(i % 10 == 0, None).when(i % 10 == 1, "-").when(i % 10 == 2, "0").when(i % 10 == 3, "N/A").otherwise(F.concat(F.lit("ABC-"), i.cast("string"))).alias("plate_number"),
        F.when(i % 9 != 8, _choose(i % 9, NAMES)).alias("category"),
        _choose(F.col("o_orderstatus"), {"F": "processed", "O": "pending", "P": "needs_review"}).alias("status"),
        (i % 4 == 0).alias("locked"),
        F.concat(F.lit("Scan_"), (i % 1000).cast("string"), F.when(i % 2 == 0, "_A%B.pdf").otherwise(".png")).alias("original_filename"),
        F.when(i % 5 == 0, F.concat(F.lit("Net "), F.when(i % 10 == 0, "30").otherwise("15"))).alias("payment_terms"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("total_amount"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, supplier and the item's cells, a row per line."""
    li, p = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    named = p.select("p_partkey", F.concat_ws(" ", "p_name", _choose(F.col("p_type"), WORDS, "misc")).alias("description"))
    return li.join(named, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_linenumber").alias("line"),
        "description",
        F.col("l_quantity").cast("double").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_discount").alias("discount_rate"),
        F.col("l_tax").alias("tax_rate"),
    )


def amounts(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Per invoice: vendor id and exact decimal sums, combined before the shuffle; no line is collected. only: ids of the invoices asked for."""
    lines = read_table(spark, sf_dir, "lineitem")
    if only is not None:
        lines = lines.join(only, F.col("l_orderkey") == F.col("id"), "left_semi")
    price, disc, tax = (F.col(c).cast("decimal(12,2)") for c in ("l_extendedprice", "l_discount", "l_tax"))
    money = lambda c: F.sum(c.cast("decimal(18,4)")).cast("decimal(18,2)").cast("double")
    return lines.groupBy(F.col("l_orderkey").alias("invoice_id")).agg(
        F.min("l_suppkey").alias("vendor_id"), money(price).alias("subtotal"), money(price * tax).alias("tax_amount"), money(price * disc).alias("discount")
    )


def invoices(spark: SparkSession, sf_dir: str, items: bool = False) -> DataFrame:
    """Invoices with vendor and sums; with items, the array of line items as well."""
    return _summed(spark, sf_dir, heads(spark, sf_dir), amounts(spark, sf_dir), items)


def invoices_of(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    """Invoices for chosen heads; only their lines are summed."""
    return _summed(spark, sf_dir, chosen, amounts(spark, sf_dir, chosen.select("id")), False)


def _summed(spark: SparkSession, sf_dir: str, chosen: DataFrame, sums: DataFrame, items: bool) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    a = sums.join(s, F.col("vendor_id") == F.col("s_suppkey"), "left")
    a = a.select("invoice_id", "vendor_id", F.col("s_name").alias("vendor_name"), F.lpad((F.col("vendor_id") + 1).cast("string"), 9, "0").alias("vendor_tax_id"), "subtotal", "tax_amount", "discount")
    i = F.col("id")
    current = F.when(i % 3 == 0, (F.col("subtotal").cast("decimal(18,2)") + F.col("tax_amount").cast("decimal(18,2)") - F.col("discount").cast("decimal(18,2)")).cast("double"))
    out = chosen.join(a, F.col("id") == F.col("invoice_id"), "left").drop("invoice_id")
    out = out.withColumn("vendor_name", F.coalesce("vendor_name", F.lit("UNKNOWN VENDOR"))).withColumn("current_charges_total", current)
    out = out.withColumn("previous_balance", F.when(i % 6 == 0, (F.col("total_amount").cast("decimal(18,2)") - F.col("current_charges_total").cast("decimal(18,2)")).cast("double")))
    if items:
        nested = line_items(spark, sf_dir)
        out = out.join(nested, F.col("id") == F.col("invoice_id"), "left").drop("invoice_id").withColumn("line_items", F.coalesce("line_items", F.array().cast(LINE_ITEM)))
    return out


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id and its items in order of line, then of all cells."""
    cell = F.struct("line", "description", "quantity", "unit_price", "amount")
    nested = F.transform(F.sort_array(F.collect_list(cell)), lambda x: F.struct(*[x[c].alias(c) for c in ("description", "quantity", "unit_price", "amount")]))
    return lines(spark, sf_dir).groupBy("invoice_id").agg(nested.alias("line_items"))


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        _choose(F.col("event_type"), ACTIONS, "DOWNLOAD EXPORT").alias("action"),
        F.lit("invoice").alias("entity_type"),
        F.get_json_object("props", "$.k").cast("long").alias("entity_id"),
        F.col("props").alias("details"),
    )


def _case(key: str, options, default: str = "NULL") -> str:
    items = options.items() if isinstance(options, dict) else enumerate(options)
    q = lambda v: v if isinstance(v, int) else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN '{v}'" for k, v in items) + f" ELSE {default} END"


#: The same mapping for the checking engine; queries are written behind it.
MODEL_SQL = f"""
WITH heads AS (
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 <> 0 THEN 'INV-' || lpad(CAST(o_orderkey AS varchar), 8, '0') END AS invoice_number,
        CAST(o_orderdate AS date) AS invoice_date, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS date) + CAST(o_orderkey % 45 AS integer) END AS date_uploaded,
        CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN CAST(o_orderdate AS date) + 30 END AS due_date,
        upper(c_name) AS customer_name, CASE WHEN o_orderkey % 17 <> 0 THEN {_case("n_regionkey", UNITS)} END AS currency,
        CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '-' WHEN 2 THEN '0' WHEN 3 THEN 'N/A' ELSE 'ABC-' || o_orderkey END AS plate_number,
        {_case("o_orderkey % 9", NAMES)} AS category,
        {_case("o_orderstatus", {"F": "processed", "O": "pending", "P": "needs_review"})} AS status,
        o_orderkey % 4 = 0 AS locked, 'Scan_' || (o_orderkey % 1000) || CASE WHEN o_orderkey % 2 = 0 THEN '_A%B.pdf' ELSE '.png' END AS original_filename,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Net ' || CASE WHEN o_orderkey % 10 = 0 THEN '30' ELSE '15' END END AS payment_terms,
        CAST(CAST(o_totalprice AS decimal(18,2)) AS double) AS total_amount
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
),
lines AS (
    SELECT l_orderkey AS invoice_id, l_suppkey AS supplier, l_linenumber AS line, p_name || ' ' || {_case("p_type", WORDS, "'misc'")} AS description,
        CAST(l_quantity AS double) AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS amount
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
amounts AS (
    SELECT l_orderkey AS invoice_id, min(l_suppkey) AS vendor_id,
        sum(CAST(CAST(l_extendedprice AS decimal(12,2)) AS decimal(18,4))) AS s,
        sum(CAST(CAST(l_extendedprice AS decimal(12,2)) * CAST(l_tax AS decimal(4,2)) AS decimal(18,4))) AS t,
        sum(CAST(CAST(l_extendedprice AS decimal(12,2)) * CAST(l_discount AS decimal(4,2)) AS decimal(18,4))) AS d
    FROM lineitem GROUP BY 1
),
summed AS (
    SELECT invoice_id, vendor_id, s_name, lpad(CAST(vendor_id + 1 AS varchar), 9, '0') AS vendor_tax_id,
        CAST(s AS decimal(18,2)) AS s, CAST(t AS decimal(18,2)) AS t, CAST(d AS decimal(18,2)) AS d
    FROM amounts LEFT JOIN supplier ON vendor_id = s_suppkey
),
nested AS (
    SELECT invoice_id, list({{'description': description, 'quantity': quantity, 'unit_price': unit_price, 'amount': amount}} ORDER BY line, description, quantity, unit_price, amount) AS line_items
    FROM lines GROUP BY 1
),
invoices AS (
    SELECT h.*, vendor_id, coalesce(s_name, 'UNKNOWN VENDOR') AS vendor_name, vendor_tax_id, CAST(s AS double) AS subtotal, CAST(t AS double) AS tax_amount, CAST(d AS double) AS discount,
        CASE WHEN id % 3 = 0 THEN CAST(s + t - d AS double) END AS current_charges_total,
        CASE WHEN id % 6 = 0 THEN CAST(CAST(total_amount AS decimal(18,2)) - (s + t - d) AS double) END AS previous_balance
    FROM heads h LEFT JOIN summed ON id = invoice_id
),
audit_logs AS (
    SELECT event_id AS id, ts AS created_at, 'user_' || user_id AS "user", {_case("event_type", ACTIONS, "'DOWNLOAD EXPORT'")} AS action,
        'invoice' AS entity_type, CAST(json_extract_string(props, '$.k') AS bigint) AS entity_id, props AS details
    FROM events
)
"""
