"""Rules over the lines of a document's text, and over the boxes of its words."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from tallyspark.functions.scalars import blank, let
from tallyspark.session import materialize

AMOUNT = "(?<![0-9.,])[0-9]{1,3}(?:,[0-9]{3})+\\.[0-9]{2}(?![0-9%])|(?<![0-9.,])[0-9]+\\.[0-9]{2}(?![0-9%])"
BARE = AMOUNT + "|(?<![0-9.,])[0-9]{1,3}(?:,[0-9]{3})*(?![0-9%.,])|(?<![0-9.,])[0-9]+(?![0-9%.,])"
TAX_LABELS = "(?i)\\b(?:vat|value added tax|sales tax|tax amount|output tax|gst)\\b"
NOT_TAX = "(?i)vatable|vat[- ]?exempt|zero[- ]?rated|reg|tin|net of vat|excl"
ROW = "^\\s*(.+?)\\s+([0-9]+(?:\\.[0-9]+)?)\\s+[$₱P]?\\s*([0-9][0-9,]*\\.[0-9]{2})\\s+[$₱P]?\\s*([0-9][0-9,]*\\.[0-9]{2})\\s*$"


def lines_of(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, n, line: a row for each line of a text."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(blank(F.col(text_col)), "\n")).alias("n", "line"))


def amounts_on(line: Column, bare: bool = False) -> Column:
    """Amounts of a line in order; percentages are none."""
    found = F.regexp_extract_all(blank(line), F.lit(BARE if bare else AMOUNT), F.lit(0))
    return F.transform(found, lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double"))


def with_next(lines: DataFrame) -> DataFrame:
    return lines.withColumn("next", F.lead("line").over(Window.partitionBy("id").orderBy("n")))


def near_label(lines: DataFrame, label: str, exclude: str | None = None, bare: bool = False, same_line: bool = False) -> DataFrame:
    """id, n, amounts on labelled lines, or else on the line below that is not itself excluded."""
    rows = with_next(lines).filter(F.col("line").rlike(label))
    if exclude:
        rows = rows.filter(~F.col("line").rlike(exclude))
    here = amounts_on(F.col("line"), bare)
    below = F.array().cast("array<double>") if same_line else F.when(~F.coalesce(F.col("next").rlike(exclude), F.lit(False)) if exclude else F.lit(True), amounts_on(F.col("next"), bare)).otherwise(F.array().cast("array<double>"))
    rows = rows.select("id", "n", F.when(F.size(here) > 0, here).otherwise(below).alias("amounts"))
    return rows.filter(F.size("amounts") > 0)


def find_tax(lines: DataFrame) -> DataFrame:
    """id, tax_amount, tax_rate: the last amount of the first tax line, and the first percentage beside a tax label."""
    amount = near_label(lines, TAX_LABELS, NOT_TAX).groupBy("id").agg(F.min_by(F.element_at("amounts", -1), "n").alias("tax_amount"))
    percent = F.regexp_extract(F.col("line"), "([0-9]{1,2}(?:\\.[0-9]+)?)\\s*%", 1)
    rate = lines.filter(F.col("line").rlike(TAX_LABELS) & (percent != "")).groupBy("id").agg(F.min_by(percent.cast("double"), "n").alias("tax_rate"))
    return amount.join(rate, "id", "full")


def table_rows(lines: DataFrame) -> DataFrame:
    """Lines that read as description, quantity, price and amount."""
    part = lambda i: F.regexp_extract("line", ROW, i)
    number = lambda i: F.replace(part(i), F.lit(","), F.lit("")).cast("double")
    return lines.filter(F.col("line").rlike(ROW)).select("id", "n", F.trim(part(1)).alias("description"), number(2).alias("quantity"), number(3).alias("unit_price"), number(4).alias("amount"))


def stacked_rows(lines: DataFrame) -> DataFrame:
    """Tables whose cells stand below each other: a description, then quantity, price and amount on a line each."""
    over = Window.partitionBy("id").orderBy("n")
    rows = lines.withColumns({f"l{k}": F.lead("line", k).over(over) for k in (1, 2, 3)})
    lone = lambda c: F.when(F.trim(F.col(c)).rlike("^[$₱P]?[0-9][0-9,]*(?:\\.[0-9]+)?$"), F.regexp_replace(F.col(c), "[$₱P,\\s]", "").try_cast("double"))
    rows = rows.withColumns({"quantity": lone("l1"), "unit_price": lone("l2"), "amount": lone("l3")})
    fits = F.abs(F.col("quantity") * F.col("unit_price") - F.col("amount")) <= F.greatest(F.lit(0.03), F.abs("amount") * 0.003)
    return rows.filter(F.col("line").rlike("[A-Za-z]{2}") & fits).select("id", "n", F.trim("line").alias("description"), "quantity", "unit_price", "amount")


def repeated_values(lines: DataFrame, times: int = 2) -> DataFrame:
    """Amounts that a text prints more than once."""
    each = lines.select("id", F.explode(amounts_on(F.col("line"))).alias("value"))
    return each.groupBy("id", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def only_one(values: Column) -> Column:
    """The value that all candidates agree on, else null."""
    return let(F.array_distinct(F.array_compact(values)), lambda kept: F.when(F.size(kept) == 1, kept[0]))


def boxes(words: DataFrame) -> DataFrame:
    """Add x1, y1, x2, y2 from four-cornered boxes."""
    side = lambda i, f: f(F.transform("bbox", lambda p: p[i]))
    return words.withColumns({"x1": side(0, F.array_min), "y1": side(1, F.array_min), "x2": side(0, F.array_max), "y2": side(1, F.array_max)})


def reading_order(words: DataFrame, bucket: float) -> DataFrame:
    """Rank words by row, then by place in it; rows are heights rounded half to even."""
    row = F.bround((F.col("y1") + F.col("y2")) / 2 / bucket)
    return words.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(row, (F.col("x1") + F.col("x2")) / 2, "word")))


def median_height(words: DataFrame) -> DataFrame:
    """The upper median of line heights of a page."""
    heights = F.sort_array(F.collect_list(F.col("y2") - F.col("y1")))
    return words.groupBy("page").agg(F.element_at(heights, (F.floor(F.size(heights) / 2) + 1).cast("int")).alias("height"))


def right_of_label(words: DataFrame, label: str, overlap: float = 0.6) -> DataFrame:
    """page, label_word, value: the nearest amount to the right of a label on its row, if no other label stands between.

    A page is a key and holds a hundred words or so, so the join is within pages only.
    """
    number = F.replace(F.col("word"), F.lit(","), F.lit("")).try_cast("double")
    labels = words.filter(F.col("word").rlike(label)).select("page", *[F.col(c).alias(f"l_{c}") for c in ("word", "x1", "x2", "y1", "y2")])
    values = words.filter(number.isNotNull()).select("page", number.alias("value"), *[F.col(c).alias(f"v_{c}") for c in ("x1", "y1", "y2")])
    shared = F.least("l_y2", "v_y2") - F.greatest("l_y1", "v_y1")
    on_row = shared >= overlap * F.least(F.col("l_y2") - F.col("l_y1"), F.col("v_y2") - F.col("v_y1"))
    pairs = labels.join(values, "page").filter(on_row & (F.col("v_x1") >= F.col("l_x2")))
    near = pairs.groupBy("page", "l_word", "l_x1", "l_x2", "l_y1", "l_y2").agg(F.min_by(F.struct("value", "v_x1"), "v_x1").alias("v"))
    others = words.filter(F.col("word").rlike("[A-Za-z]{3}")).select("page", F.col("x1").alias("o_x1"), F.col("y1").alias("o_y1"), F.col("y2").alias("o_y2"))
    same = F.least("l_y2", "o_y2") - F.greatest("l_y1", "o_y1") >= overlap * (F.col("l_y2") - F.col("l_y1"))
    blocked = near.join(others, "page").filter(same & (F.col("o_x1") >= F.col("l_x2")) & (F.col("o_x1") < F.col("v.v_x1"))).select("page", "l_x1", "l_y1").distinct()
    return near.join(blocked, ["page", "l_x1", "l_y1"], "left_anti").select("page", F.col("l_word").alias("label_word"), F.col("v.value").alias("value"))


def nearest_pairs(pairs: DataFrame, within: str, left: str, right: str, distance: str) -> DataFrame:
    """One-to-one pairs, the nearest first: what a greedy walk through all pairs in order of distance would take.

    A pair that is the nearest both for its left and for its right is in that walk whatever comes before it, so each
    round takes all such pairs at once and drops what shares a side with them. Of equal distances the smaller
    left, then the smaller right is nearer. Everything is dealt by ``within``; a round is one exchange.
    """
    order = F.struct(distance, left, right)
    state = materialize(pairs.select(within, left, right, distance).distinct(), "pairs")
    taken = []
    while True:
        for_left, for_right = Window.partitionBy(within, left), Window.partitionBy(within, right)
        best = (F.min(order).over(for_left) == order) & (F.min(order).over(for_right) == order)
        state = state.withColumn("__take", best)
        gone = F.max("__take").over(for_left) | F.max("__take").over(for_right)
        state = materialize(state.withColumn("__gone", gone), "pairs")
        taken.append(state.filter("__take").select(*pairs.columns))
        state = state.filter("not __gone").select(within, left, right, distance)
        if not state.limit(1).count():
            break
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def nearest_of(pairs: Column, left: str, right: str) -> Column:
    """The same walk within a row: of pairs that are sorted by distance, left and right those whose sides are both still free."""
    free = lambda taken, x: ~F.exists(taken, lambda t: (t[left] == x[left]) | (t[right] == x[right]))
    first = F.slice(pairs, 1, 0)
    return F.aggregate(pairs, first, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))


def match_cells(words: DataFrame) -> DataFrame:
    """One-to-one pairs of labels and cells of a page, nearest in height first."""
    side = lambda is_label, name: words.filter(F.col("is_label") == is_label).select("page", F.col("word").alias(name), F.col("y").alias(f"{name}_y"))
    pairs = side(True, "label").join(side(False, "cell"), "page").select("page", "label", "cell", F.abs(F.col("label_y") - F.col("cell_y")).alias("distance"))
    return nearest_pairs(pairs, "page", "label", "cell", "distance")


def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Matching-block ratio of two names; no built-in measure is the same, so this one runs in Python by batch."""
    return F.pandas_udf(_ratio, "double", PandasUDFType.SCALAR_ITER)(a, b)


def any_label(*labels: str) -> str:
    """One pattern for several printed labels."""
    return "(?i)(?:" + "|".join(reduce(lambda s, c: s.replace(c, "\\" + c), ".()", x).replace(" ", "\\s*") for x in labels) + ")"
