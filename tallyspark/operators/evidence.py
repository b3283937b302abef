"""Rules that weigh several printed pieces of evidence against each other, as joins.

A page is a table of rows (page, n, text, x1, y1, x2, y2), as in ``layout``, or (page, text). Everything meets by
equality of a page, a key or a piece of text; conditions on places only narrow such a join. A rule that
finds less than all of its evidence leaves the page out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import blank, let
from tallyspark.operators.layout import printed_amount, tidy
from tallyspark.operators.quality import cents
from tallyspark.operators.text import nearest_of
from tallyspark.session import materialize

# ---- fixed values -----------------------------------------------------------------------------
#: Headings of an item table, column by column.
ITEM_HEADINGS = {"description": ("description", "item summary"), "quantity": ("qty", "qty."), "unit_price": ("unit price", "rate"), "amount": ("amount", "total")}
#: Words that begin the line under the last item.
AFTER_ITEMS = ("subtotal", "invoice total", "to pay by", "total amount", "vatable")
CHARGES_HEAD, CHARGES_FOOT = "charges for this billing period", "total amount due"
# -----------------------------------------------------------------------------------------------
GRAM = 5
#: Keys that are sent to all tasks at most.
MOST_BROADCAST = 1_000_000


def compact(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", "")


def _grams(text: str, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, size)))


def page_identities(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """page, entry: the entries all of whose keys a page holds, and none of whose exclusions.

    pages: (page, text); entries: (entry, keys, exclusions), arrays of texts, compared by letters and digits. A
    containment join: each distinct key waits at its rarest piece of ``GRAM`` characters for the pages that have that
    piece, and only there the whole key is looked for. Of an entry's keys the one that the fewest pages hold brings it to those
    pages, and there all of its keys and exclusions are compared: a key that every page holds makes no pairs.
    Keys without letters and digits are none, and an entry without keys applies nowhere.
    """
    key = lambda c, out: F.explode(F.transform(c, lambda k: F.struct(F.lit(out).alias("out"), compact(k).alias("key"))))
    wanted = entries.select("entry", key("keys", False).alias("k")).unionByName(entries.select("entry", key("exclusions", True).alias("k")))
    wanted = materialize(wanted.select("entry", "k.*").filter("key <> ''").distinct(), "identity_keys")
    # equal keys of several entries are looked for once
    keys = wanted.select("key").distinct().withColumn("size", F.least(F.length("key"), F.lit(GRAM)))
    pieces = keys.select("key", "size", F.explode(_grams("key", F.col("size"))).alias("gram"))
    sizes = [r[0] for r in keys.select("size").distinct().collect()]  # GRAM numbers at most
    texts = pages.select("page", compact(F.col("text")).alias("text"))
    cut = texts.select("page", F.explode(F.array_distinct(F.flatten(F.array(*[_grams("text", F.lit(s)) for s in sizes])))).alias("gram")) if sizes else texts.select("page", F.col("text").alias("gram")).limit(0)
    often = cut.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(often, "gram").groupBy("key").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    rarest = materialize(rarest, "identity_grams")
    met = cut.join(F.broadcast(rarest) if rarest.count() <= MOST_BROADCAST else rarest, "gram")
    found = materialize(met.join(texts, "page").filter(F.contains("text", F.col("key"))).select("page", "key"), "identity_found")
    times = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))
    rules = wanted.filter("not out").join(times, "key", "left").groupBy("entry").agg(least.alias("least"), F.collect_set("key").alias("keys")).filter("least.n > 0")
    against = wanted.filter("out").groupBy("entry").agg(F.collect_set("key").alias("exclusions"))
    rules = rules.join(against, "entry", "left").select("entry", F.col("least.key").alias("key"), "keys", "exclusions")
    held = found.groupBy("page").agg(F.collect_set("key").alias("held"))
    likely = found.join(rules, "key").join(held, "page")
    fits = (F.size(F.array_except("keys", "held")) == 0) & ~F.coalesce(F.arrays_overlap("exclusions", "held"), F.lit(False))
    return likely.filter(fits).select("page", "entry")


def settle_identities(rows: DataFrame, pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (with a page) named by the entry that applies to their page; of several the last. entries have vendor_name and currency too.

    A currency is set only where the page prints no foreign one (the column ``foreign``).
    """
    best = page_identities(pages, entries).join(entries.select("entry", "vendor_name", "currency"), "entry")
    best = best.groupBy("page").agg(F.max_by(F.struct("vendor_name", "currency"), "entry").alias("__best"))
    out = rows.join(best, "page", "left")
    money = F.when(F.col("__best").isNotNull() & ~F.col("foreign"), F.coalesce("__best.currency", "currency")).otherwise(F.col("currency"))
    return out.withColumns({"vendor_name": F.coalesce("__best.vendor_name", "vendor_name"), "currency": money}).select(*rows.columns)


def table_items(lines: DataFrame) -> DataFrame:
    """page, n, description, quantity, unit_price, amount of the items under four headings, on a page that may be askew.

    The headings' centres give the columns (borders half way between neighbours) and the page's slope, which is
    taken out of all heights. A cell belongs to the column that its centre lies in and to the item whose height it
    shares. The table counts only if every item has exactly one number in each column; else the page has no row.
    """
    word, text = F.lower(F.trim("text")), F.trim("text")
    kind = F.coalesce(*[F.when(word.isin(*words), k) for k, words in ITEM_HEADINGS.items()])
    ends = F.coalesce(*[F.when(F.startswith(word, F.lit(w)), True) for w in AFTER_ITEMS], F.lit(False))
    places = {"c": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2, "h": F.col("y2") - F.col("y1")}
    rows = lines.withColumns(places | {"kind": kind, "end": ends, "value": printed_amount(F.col("text")), "description": F.when(F.col("text").rlike("[A-Za-z]") & ~text.rlike("^[A-Z]+-[0-9]+$"), text)})
    head = lambda k: F.min_by(F.struct("n", "x1", "c", "y", "h"), F.when(F.col("kind") == k, F.col("n"))).alias(k)
    line = F.when(F.col("end") | F.col("value").isNotNull() | F.col("description").isNotNull(), F.struct("n", "x1", "c", "y", "h", "end", "value", "description"))

    def borders(page: Column) -> Column:
        d, q, p, a = heads = [page[k] for k in ITEM_HEADINGS]
        slope = (a["y"] - d["y"]) / F.greatest(F.lit(1.0), a["c"] - d["c"])
        top = let(slope, lambda s: F.greatest(*[h["y"] - s * (h["c"] - d["c"]) for h in heads]) + F.greatest(*[h["h"] for h in heads]) * 0.6)
        between = [((x["c"] + z["c"]) / 2).alias(f"b{i}") for i, (x, z) in enumerate([(d, q), (q, p), (p, a)])]
        return F.when((d["x1"] < q["x1"]) & (q["x1"] < p["x1"]) & (p["x1"] < a["x1"]), F.struct(slope.alias("slope"), d["c"].alias("c0"), (d["x1"] - d["h"]).alias("left"), top.alias("top"), *between))

    def of(page: Column) -> Column:
        return let(borders(page), lambda m: F.when(m.isNotNull(), let(flattened(page["ls"], m), lambda ls: let(body(ls), lambda rows: whole(rows, m)))))

    def flattened(ls: Column, m: Column) -> Column:
        flat = F.transform(ls, lambda x: F.struct(*[x[k].alias(k) for k in ("n", "x1", "c", "h", "end", "value", "description")], (x["y"] - m["slope"] * (x["c"] - m["c0"])).alias("flat")))
        return F.filter(flat, lambda x: x["flat"] > m["top"])

    def body(ls: Column) -> Column:
        return let(F.array_min(F.transform(F.filter(ls, lambda x: x["end"]), lambda x: x["flat"])), lambda end: F.filter(ls, lambda x: end.isNull() | (x["flat"] < end)))

    def whole(rows: Column, m: Column) -> Column:
        items = F.filter(rows, lambda x: (x["x1"] > m["left"]) & (x["x1"] < m["b0"]) & x["description"].isNotNull())
        column = lambda x: F.when(x["c"] < m["b0"], 0).when(x["c"] < m["b1"], 1).when(x["c"] < m["b2"], 2).otherwise(3)
        cells = F.filter(F.transform(F.filter(rows, lambda x: x["value"].isNotNull()), lambda x: F.struct(column(x).alias("column"), x["value"].alias("value"), x["flat"].alias("at"), x["h"].alias("high"))), lambda x: x["column"] > 0)

        def filled(x: Column, near: Column) -> Column:
            one = lambda k: let(F.filter(near, lambda v: v["column"] == k), lambda vs: F.when(F.size(vs) == 1, F.get(vs, F.lit(0))["value"]))
            return F.struct(x["n"].alias("n"), x["description"].alias("description"), one(1).alias("quantity"), one(2).alias("unit_price"), one(3).alias("amount"))

        near = lambda x, cells: F.filter(cells, lambda v: F.abs(v["at"] - x["flat"]) < F.greatest(x["h"], v["high"]) * 0.85)
        all_ = let(cells, lambda cells: F.transform(items, lambda x: let(near(x, cells), lambda vs: filled(x, vs))))
        lacking = lambda made: F.exists(made, lambda x: x["quantity"].isNull() | x["unit_price"].isNull() | x["amount"].isNull())
        return let(all_, lambda made: F.when(~lacking(made), made))

    # within the aggregate, so that no condition on the outcome works it out again
    page = F.struct(*[head(k) for k in ITEM_HEADINGS], F.collect_list(line).alias("ls"))
    return rows.groupBy("page").agg(let(page, of).alias("rows")).select("page", F.explode("rows").alias("r")).select("page", "r.*")


def billing_rows(lines: DataFrame) -> DataFrame:
    """page, target, rows: the charges between a bill's heading and its total, each label with one amount, in order of height.

    Labels stand left of the middle one of the amounts' columns and meet amounts to their right on about their own
    height, one to one, the nearest first. target: the amount in the heading's row. rows: (label, value, decimals,
    confidence); an amount of two digits and more without its point is one that may have lost it. One exchange: a page's
    amounts and labels come together as a row, and are paired in it.
    """
    text = F.trim("text")
    shown = {"word": tidy(F.col("text")), "y": (F.col("y1") + F.col("y2")) / 2, "value": printed_amount(F.col("text")), "decimals": text.rlike("\\.[0-9]{2}$"), "named": F.length(F.regexp_replace("text", "[^A-Za-z]+", "")) >= 3}
    rows = lines.withColumns(shown).withColumn("value", F.when(F.col("decimals") | text.rlike("[0-9]{2}|[0-9],[0-9]"), F.col("value")))
    place = lambda word: F.min_by(F.struct("n", "x2", "y1", "y2", "y"), F.when(F.col("word") == word, F.col("n")))
    # what is neither an amount nor a label stays behind
    cell = F.when(F.col("value").isNotNull() | F.col("named"), F.struct("n", "x1", "x2", "y1", "y2", "y", F.when(F.col("value").isNull(), text).alias("label"), "value", "decimals", "confidence"))
    valued = lambda cells: F.filter(cells, lambda x: x["value"].isNotNull())

    def meeting(label: Column, amounts: Column) -> Column:
        high = F.greatest(label["y2"] - label["y1"], F.lit(8.0))
        near = F.filter(amounts, lambda v: (v["x1"] >= label["x2"]) & (F.abs(v["y"] - label["y"]) <= 0.9 * high + 4))
        row = lambda v: F.struct(label["label"].alias("label"), v["value"].alias("value"), v["decimals"].alias("decimals"), v["confidence"].alias("confidence"))
        return F.transform(near, lambda v: F.struct(F.abs(v["y"] - label["y"]).alias("far"), label["n"].alias("label_n"), v["n"].alias("cell"), label["y1"].alias("y1"), row(v).alias("row")))

    def paired(cells: Column, amounts: Column) -> Column:
        middle = F.get(F.sort_array(F.transform(amounts, lambda v: v["x1"])), F.floor(F.size(amounts) / 2).cast("int"))
        labels = let(middle, lambda m: F.filter(cells, lambda x: x["value"].isNull() & (x["x2"] <= m + 2)))
        return F.sort_array(F.flatten(F.transform(labels, lambda x: meeting(x, amounts))))

    def of(page: Column) -> Column:
        head, foot = page["head"], page["foot"]
        beside = F.filter(valued(page["cells"]), lambda x: x["decimals"] & (x["x1"] > head["x2"]) & (F.abs(x["y"] - head["y"]) <= 8))
        target = F.array_max(F.transform(beside, lambda x: F.struct(x["n"].alias("n"), x["value"].alias("value"))))["value"]
        band = F.filter(page["cells"], lambda x: (x["y"] > head["y2"] - 2) & (x["y"] < foot["y1"] + 2) & (x["n"] != head["n"]))
        pairs = let(band, lambda cells: let(valued(cells), lambda amounts: paired(cells, amounts)))
        listed = F.sort_array(F.transform(nearest_of(pairs, "label_n", "cell"), lambda x: F.struct(x["y1"].alias("y1"), x["label_n"].alias("label_n"), x["row"].alias("row"))))
        return F.when(head.isNotNull() & foot.isNotNull(), F.struct(target.alias("target"), F.transform(listed, lambda x: x["row"]).alias("rows")))

    # within the aggregate, so that no condition on the outcome works it out again
    page = F.struct(place(CHARGES_HEAD).alias("head"), place(CHARGES_FOOT).alias("foot"), F.collect_list(cell).alias("cells"))
    return rows.groupBy("page").agg(let(page, of).alias("bill")).filter(F.size("bill.rows") > 0).select("page", "bill.target", "bill.rows")


# ---- a page read against itself ---------------------------------------------------------------
def respelled(words: DataFrame, least: int = 8, alike: float = 0.8) -> DataFrame:
    """page, word, spelling: words of a page that are another word of the same page misread, and that word.

    words: (page, n, word, clean); ``clean`` marks readings to go by. Letters alone are compared: words of one length of
    at least ``least`` that have that share of their places in common. A word in k + 1 pieces has one whole piece where
    at most k places differ, so words meet under their pieces, and then places are counted. Of several the first in the page counts.
    """
    letters = words.withColumn("core", F.lower(F.regexp_replace("word", "[^A-Za-z]+", ""))).filter(F.length("core") >= least)
    size = F.length("core")
    differing = F.floor(size * F.lit(1 - alike) + 1e-9).cast("int")
    start = lambda i: F.floor(i * size / (differing + 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), differing), lambda i: F.concat_ws(":", size, i, F.substring("core", start(i), start(i + 1) - start(i))))
    keyed = letters.select("page", "n", "word", "core", "clean", differing.alias("differing"), F.explode(pieces).alias("key"))
    wrong, right = keyed.filter("not clean").alias("w"), keyed.filter("clean").alias("r")
    met = wrong.join(right, (F.col("w.page") == F.col("r.page")) & (F.col("w.key") == F.col("r.key"))).filter(F.col("w.core") != F.col("r.core"))
    differ = F.aggregate(F.sequence(F.lit(1), F.length("w.core")), F.lit(0), lambda s, i: s + (F.substring("w.core", i, F.lit(1)) != F.substring("r.core", i, F.lit(1))).cast("int"))
    near = met.filter(differ <= F.col("w.differing")).groupBy(F.col("w.page").alias("page"), F.col("w.word").alias("word")).agg(F.min(F.struct(F.col("r.n").alias("n"), F.col("r.core").alias("core"))).alias("best"))
    capitals = F.regexp_replace("word", "[^A-Z]+", "") == F.regexp_replace("word", "[^A-Za-z]+", "")
    return near.select("page", "word", F.when(capitals, F.upper("best.core")).otherwise(F.col("best.core")).alias("spelling"))


def without_overlap(buyer: DataFrame, seller: DataFrame, least: int = 5) -> DataFrame:
    """Buyer lines (page, n, text) without the end that is a seller line (page, text), whole or without its first letter.

    Lines meet under the last ``least`` letters and digits; the longest such end goes, if more than that many characters stay before it.
    """
    tail = lambda c: F.right(compact(c), F.lit(least))
    tidy_end = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    ends = seller.select("page", tidy_end(F.col("text")).alias("whole")).withColumn("end", F.explode(F.array("whole", F.substring("whole", F.lit(2), F.length("whole")))))
    ends = ends.filter(F.length(compact(F.col("end"))) >= least).select("page", "end", tail(F.col("end")).alias("key"))
    lines = buyer.withColumns({"own": tidy_end(F.col("text")), "key": tail(F.col("text"))})
    met = lines.alias("b").join(ends.alias("s"), (F.col("b.page") == F.col("s.page")) & (F.col("b.key") == F.col("s.key")))
    fits = F.endswith(F.lower("b.own"), F.lower("s.end")) & (F.length("b.own") > F.length("s.end") + least)
    longest = met.filter(fits).groupBy(F.col("b.page").alias("page"), F.col("b.n").alias("n")).agg(F.max(F.length("s.end")).alias("cut"))
    left = F.rtrim(F.regexp_replace(F.substring("own", F.lit(1), F.length("own") - F.col("cut")), "[ ,;]+$", ""))
    return lines.join(longest, ["page", "n"], "left").select("page", "n", F.when(F.col("cut").isNotNull(), left).otherwise(F.col("text")).alias("text"))


# ---- labelled cells and closed sets -------------------------------------------------------------
def labelled_cells(lines: DataFrame, labels: DataFrame, reach: float = 450.0, drop: float = 60.0) -> DataFrame:
    """page, field, value: what stands by a field's labels, for every layout of a table of labels (family, field, label).

    A label is a whole line, or the beginning of one before a colon. Its candidates in order: the rest of its own line;
    the nearest line to its right on its row, unless another label of the table stands before it; the one line
    under it that shares its left edge; the next line in reading order. The first that is there and is no label is
    the label's value. A field's value counts if all its labels on the page, of one family, agree on one.
    """
    words = lines.withColumns({"word": tidy(F.col("text")), "own": F.trim(F.regexp_extract("text", "^[^:]*:\\s*(.+)$", 1))}).withColumn("word", F.trim(F.regexp_replace("word", "\\s*:.*$", "")))
    kinds = labels.select(tidy(F.col("label")).alias("word"), "field").groupBy("word").agg(F.collect_set("field").alias("fields"))
    named = words.join(F.broadcast(kinds), "word", "left") if labels.limit(10_001).count() <= 10_000 else words.join(kinds, "word", "left")
    line = F.struct("n", "x1", "y1", "x2", "y2", "text", "fields", F.when(F.col("fields").isNotNull(), F.nullif("own", F.lit(""))).alias("own"))

    def read(x: Column, ls: Column) -> Column:
        first = lambda vs: F.get(vs, F.lit(0))
        plain = lambda v: v["fields"].isNull()
        shared = lambda v: F.least(x["y2"], v["y2"]) - F.greatest(x["y1"], v["y1"])
        right = F.filter(ls, lambda v: (v["n"] != x["n"]) & (v["x1"] >= x["x2"] - 3) & (v["x1"] - x["x2"] <= reach) & (shared(v) >= 0.5 * (x["y2"] - x["y1"])))
        nearest = F.array_min(F.transform(right, lambda v: F.struct(v["x1"].alias("x1"), v["n"].alias("n"), v["text"].alias("text"), plain(v).alias("plain"))))
        right = let(nearest, lambda v: F.when(v["plain"], v["text"]))
        below = F.filter(ls, lambda v: (v["n"] != x["n"]) & plain(v) & (F.abs(v["x1"] - x["x1"]) <= 12) & (v["y1"] >= x["y2"] - 2) & (v["y1"] - x["y2"] <= drop))
        below = let(below, lambda vs: F.when(F.size(vs) == 1, first(vs)["text"]))
        after = F.array_max(F.transform(F.filter(ls, lambda v: (v["n"] == x["n"] + 1) & plain(v)), lambda v: v["text"]))
        value = F.trim(F.coalesce(x["own"], right, below, after))
        return let(value, lambda v: F.transform(x["fields"], lambda f: F.struct(f.alias("field"), v.alias("value"))))

    of = lambda ls: F.flatten(F.transform(F.filter(ls, lambda x: x["fields"].isNotNull()), lambda x: read(x, ls)))
    # within the aggregate, so that no condition on the outcome works it out again
    pages = named.groupBy("page").agg(let(F.collect_list(line), of).alias("read"))
    # labels of one family or of several: one value for the field
    each = pages.select("page", F.explode("read").alias("r")).filter("r.value is not null").groupBy("page", "r.field").agg(F.min("r.value").alias("least"), F.max("r.value").alias("most"))
    return each.filter("least = most").select("page", "field", F.col("least").alias("value"))


def closed_charges(lines: DataFrame, labels: tuple[str, ...], total: str) -> DataFrame:
    """page, label, amount: the rows of a closed set of labels, if each has exactly one amount on the page and they add up to the printed total.

    The amount is on the label's own line or alone on the next one. A label that is missing, stands twice or has two amounts, or a
    sum that is off by more than a cent, leaves the page out.
    """
    own = F.regexp_extract("text", "(-?[0-9][0-9,]*\\.[0-9]{2})\\s*$", 1)
    own = F.replace(F.nullif(own, F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    name = F.trim(F.regexp_replace(tidy(F.col("text")), "[:\\s]*-?[0-9][0-9,]*\\.[0-9]{2}\\s*$", ""))
    rows = lines.select("page", "n", name.alias("name"), own.alias("own"), printed_amount(F.col("text")).alias("alone"))
    rows = rows.select("page", "n", F.when(F.col("name").isin(*labels, total), F.col("name")).alias("label"), "own", "alone")

    def of(ls: Column) -> Column:
        amount = lambda x, i: F.when(x["label"].isNotNull(), F.struct(x["label"].alias("label"), F.coalesce(x["own"], F.get(ls, i + 1)["alone"]).alias("amount")))
        return let(F.array_compact(F.transform(ls, amount)), closed)

    def closed(hits: Column) -> Column:
        signed = lambda x: F.when(x["label"] == total, -cents(x["amount"])).otherwise(cents(x["amount"]))
        off = F.aggregate(hits, F.lit(0).cast("decimal(18,4)"), lambda s, x: (s + signed(x)).cast("decimal(18,4)"))
        fine = (F.size(hits) == len(labels) + 1) & (F.size(F.array_distinct(F.transform(hits, lambda x: x["label"]))) == len(labels) + 1)
        return F.when(fine & (F.abs(off) <= F.lit("0.01").cast("decimal(18,4)")), F.filter(hits, lambda x: x["label"] != total))

    # within the aggregate, so that no condition on the outcome works it out again
    pages = rows.groupBy("page").agg(let(F.sort_array(F.collect_list(F.struct("n", "label", "own", "alone"))), of).alias("rows"))
    return pages.select("page", F.explode("rows").alias("r")).select("page", "r.label", "r.amount")


def lost_adjustment(previous: Column, current: Column, due: Column, share: float = 0.5) -> Column:
    """The adjustment that three printed amounts leave, with a flag; null where one is missing, nothing is left or it is more than that share of the current charges.

    A struct of ``amount`` and ``derived`` (always true: it was never printed).
    """
    rest = cents(due) - cents(previous) - cents(current)
    fits = (F.abs(rest) > F.lit("0.01").cast("decimal(18,4)")) & (F.abs(rest) <= F.abs(cents(current)) * F.lit(str(share)).cast("decimal(4,2)"))
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(F.round(rest, 2).cast("double").alias("amount"), F.lit(True).alias("derived")))


def header_columns(lines: DataFrame, anchor: str, lower: str) -> DataFrame:
    """page, side, parts: lines of a page's head in two columns that reading order has mixed, parted by the gap left of an anchor.

    The anchor is a heading of the right column; lines that begin left of it by more than its height are the left column's. Both end at the
    first line that begins with ``lower``, on its height.
    """
    rows = lines.withColumn("word", tidy(F.col("text")))
    at = rows.filter(F.col("word") == anchor).groupBy("page").agg(F.min_by(F.struct("x1", "y1", (F.col("y2") - F.col("y1")).alias("h")), "n").alias("a"))
    end = rows.filter(F.startswith("word", F.lit(lower))).groupBy("page").agg(F.min("y1").alias("end"))
    head = rows.join(at, "page").join(end, "page", "left").filter((F.col("word") != anchor) & (F.col("y1") >= F.col("a.y1") - 1) & (F.col("end").isNull() | (F.col("y1") < F.col("end"))))
    side = F.when(F.col("x1") < F.col("a.x1") - F.col("a.h"), "left").otherwise("right")
    parts = head.groupBy("page", side.alias("side")).agg(F.sort_array(F.collect_list(F.struct("y1", "x1", "n", F.trim("text").alias("t")))).alias("p"))
    return parts.select("page", "side", F.array_join(F.transform("p", lambda x: x["t"]), " | ").alias("parts"))


def below_label(lines: DataFrame, label: str, span: float) -> DataFrame:
    """page, value: the nearest line below a label whose extent overlaps the label's, within so much height."""
    rows = lines.withColumn("word", F.trim(F.regexp_replace(tidy(F.col("text")), "\\s*:+$", "")))
    pairs = rows.filter(F.col("word") == label).alias("l").join(rows.alias("v"), (F.col("l.page") == F.col("v.page")) & (F.col("v.y1") >= F.col("l.y2") - 2) & (F.col("v.y1") <= F.col("l.y2") + span))
    over = F.least("l.x2", "v.x2") - F.greatest("l.x1", "v.x1")
    return pairs.filter(over > 0).groupBy(F.col("l.page").alias("page")).agg(F.min_by(F.trim("v.text"), F.struct("v.y1", "v.x1", "v.n")).alias("value"))


def calendar_reading(text: Column) -> Column:
    """A printed day (two numbers and a year, or a month's name) as (day, note): read as month first, else as day first; what is real in neither way is flagged and never repaired."""
    part = lambda i: F.regexp_extract(F.trim(text), "^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$", i)
    made = lambda m, d: F.try_make_timestamp(part(3).try_cast("int"), part(m).try_cast("int"), part(d).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    named = F.try_to_timestamp(F.initcap(F.lower(F.trim(text))), F.lit("d MMM yyyy")).cast("date")
    month_first, day_first = made(1, 2), made(2, 1)
    both = month_first.isNotNull() & day_first.isNotNull() & (month_first != day_first)
    day = F.coalesce(named, month_first, day_first)
    note = F.when(F.trim(text) == "", F.lit(None)).when(day.isNull(), "no such day").when(named.isNull() & both, "day and month may be exchanged")
    return F.struct(day.alias("day"), note.alias("note"))
