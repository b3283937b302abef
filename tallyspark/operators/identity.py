"""Duplicates, dimensions, versions and page groups: keys, ranks over keys, and gaps in sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import auto_category, blank, tokens, vendor_key


def _rank(key: str, *order: Column | str) -> Column:
    """Place within a key; rows without a key are never ranked together."""
    return F.when(F.col(key).isNotNull(), F.row_number().over(Window.partitionBy(F.coalesce(F.col(key), F.concat(F.lit("row "), F.col("id").cast("string")))).orderBy(*order))).otherwise(1)


def key_groups(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has. Counts combine before the shuffle; rows without a key count none, so no filter works the key out a second time."""
    return rows.groupBy(key).agg(F.count(key).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def first_seen(rows: DataFrame, key: str) -> DataFrame:
    """Rows that are the first of their key, and all rows without one."""
    return rows.withColumn("__n", _rank(key, "id")).filter("__n = 1").drop("__n")


def admit(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("duplicate_key", "content_key")) -> DataFrame:
    """Rows of a batch whose keys neither the store nor an earlier row of the batch has."""
    for k in keys:
        batch = batch.join(stored.filter(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        batch = first_seen(batch, k)
    return batch


def backfill(rows: DataFrame, key: str, issue: bool = False) -> DataFrame:
    """The first id keeps a key; later ones lose it and need review."""
    first = F.min("id").over(Window.partitionBy(F.coalesce(F.col(key), F.concat(F.lit("row "), F.col("id").cast("string")))))
    rows = rows.withColumn("__first", first)
    late = F.col(key).isNotNull() & (F.col("id") > F.col("__first"))
    out = {key: F.when(~late, F.col(key)), "status": F.when(late, "needs_review").otherwise(F.col("status"))}
    if issue:
        note = F.concat(F.lit("Same content as invoice "), F.col("__first").cast("string"))
        out["validation_issues"] = F.when(late, F.array_union(F.coalesce("validation_issues", F.array().cast("array<string>")), F.array(note))).otherwise(F.col("validation_issues"))
    return rows.withColumns(out).drop("__first")


def vendor_dimension(rows: DataFrame, name: str = "vendor_name") -> DataFrame:
    """One vendor for each normalised name, with the least spelling of it."""
    return rows.filter(blank(F.col(name)) != "").groupBy(vendor_key(F.col(name)).alias("normalized_name")).agg(F.min(name).alias("name"), F.count(F.lit(1)).alias("n"))


def new_vendors(vendors: DataFrame, rows: DataFrame) -> DataFrame:
    return vendor_dimension(rows).join(vendors.select("normalized_name"), "normalized_name", "left_anti")


def latest(versions: DataFrame, key: str = "id", version: str = "version", deleted: str | None = "deleted") -> DataFrame:
    """The last state of each row of a change log, without those deleted since."""
    columns = [c for c in versions.columns if c != key]
    last = versions.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("s")).select(key, "s.*")
    return last.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted and deleted in versions.columns else last


def changes(versions: DataFrame, fields: tuple[str, ...], key: str = "id", version: str = "version") -> DataFrame:
    """What each version changed: (field, old, new) of the fields that differ from the version before."""
    over = Window.partitionBy(key).orderBy(version)
    text = lambda c: F.col(c).cast("string")
    diffs = [F.when(~text(f).eqNullSafe(F.lag(text(f)).over(over)), F.struct(F.lit(f).alias("field"), F.lag(text(f)).over(over).alias("old"), text(f).alias("new"))) for f in fields]
    numbered = versions.withColumns({"changed": F.array_compact(F.array(*diffs)), "__n": F.row_number().over(over)})
    return numbered.filter("__n > 1").select(key, version, F.explode("changed").alias("c")).select(key, version, "c.*")


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Next versions of the rows that edits name; a locked row is refused (see ``refused``)."""
    names = [c for c in edits.columns if c != "id"]
    e = edits.select("id", *[F.col(c).alias(f"__{c}") for c in names])
    kept = rows.join(e, "id").filter(~F.coalesce("locked", F.lit(False)))
    out = kept.withColumns({c: F.coalesce(f"__{c}", c) for c in names} | {"version": F.col("version") + 1})
    return out.select(*rows.columns)


def refused(rows: DataFrame, edits: DataFrame) -> DataFrame:
    return rows.filter("locked").join(edits.select("id"), "id", "left_semi")


def lock(rows: DataFrame, locked: bool) -> DataFrame:
    """Locking settles the status; unlocking leaves it."""
    return rows.withColumns({"locked": F.lit(locked), "status": F.lit("processed") if locked else F.col("status")})


def custom_category(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Category of (id, vendor_name, descriptions): the built-in one, else the custom one that shares most words, the first on ties.

    profiles: (category, rank, example). Words are joined, never every row with every profile.
    """
    base = rows.withColumn("builtin", auto_category(F.col("vendor_name"), F.col("descriptions")))
    words = profiles.groupBy("category").agg(F.min("rank").alias("rank"), F.array_distinct(F.flatten(F.collect_set(tokens(F.concat_ws(" ", "category", "example"))))).alias("words"))
    words = words.select("category", "rank", F.explode("words").alias("word"))
    open_ = base.filter("builtin = 'Others'").select("id", F.explode(tokens(F.concat_ws(" ", blank(F.col("vendor_name")), F.array_join("descriptions", " ")))).alias("word"))
    score = open_.join(words, "word").groupBy("id", "category", "rank").agg(F.count(F.lit(1)).alias("n"))
    best = score.groupBy("id").agg(F.max_by("category", F.struct(F.col("n"), (-F.col("rank")).alias("r"))).alias("custom"))
    return base.join(best, "id", "left").select(*rows.columns, F.coalesce("custom", "builtin").alias("assigned"))


def page_groups(pages: DataFrame) -> DataFrame:
    """Number pages (file, page, printed, of, ids, confidence, engine) into documents.

    A page goes on with the document before it if it is printed as the next of as many pages and its
    identities overlap or are absent. A boundary flag and a running sum make the groups.
    """
    over = Window.partitionBy("file").orderBy("page")
    prev = lambda c: F.lag(c).over(over)
    overlap = (F.size("ids") == 0) | (F.size(prev("ids")) == 0) | F.arrays_overlap("ids", prev("ids"))
    goes_on = (F.col("printed") == prev("printed") + 1) & (F.col("of") == prev("of")) & overlap
    numbered = pages.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return numbered.withColumn("group", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def page_group_summary(pages: DataFrame) -> DataFrame:
    return page_groups(pages).groupBy("file", "group").agg(F.min("confidence").alias("confidence"), F.array_join(F.sort_array(F.collect_set("engine")), "+").alias("engine"), F.sort_array(F.collect_list("page")).alias("pages"))


def dedupe_items(items: DataFrame) -> DataFrame:
    """Of an invoice's items with one description, keep the one that equals subtotal + tax, else the total, else the largest.

    items: (id, line, description, amount, subtotal, tax_amount, total_amount).
    """
    near = lambda v: F.coalesce(F.abs(F.col("amount") - v) <= 0.02, F.lit(False))
    best = F.when(near(F.col("subtotal") + F.coalesce("tax_amount", F.lit(0.0))), 0).when(near(F.col("total_amount")), 1).otherwise(2)
    key = F.trim(F.regexp_replace(F.lower(blank(F.col("description"))), "[^\\p{L}\\p{N}]+", " "))
    over = Window.partitionBy("id", "__key").orderBy(best, F.desc("amount"), "line")
    return items.withColumn("__key", key).withColumn("__n", F.row_number().over(over)).filter("__n = 1").drop("__key", "__n")
