"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document enters with a fractional number of copies, its source's target divided by its
source's size. The whole part is kept; the fraction is rounded by pivoting: two documents of
one source exchange word mass (not mere probability, so the expected number of *words* of the
source never changes) until one of them is integral, and the other goes on to the next
document. Blocks of about ``BLOCK`` documents are folded independently, from the largest document
to the smallest, as the larger of a pair tends to stay fractional: a block's single leftover is then
small. Leftovers form the next, 64 times smaller level of the tree. One leftover remains per source
and is rounded to the nearer side, so a source misses its target by half of that document.

Equal rows are counted before anything is dealt out and numbered where they enter the tree, so a
document that is there many times, or many rows without id, fill blocks like any others.

Defined results: a null text has size 0, and documents of size 0 take 0 words; a null source is
a source of its own, last in order; rows that repeat a doc_id are rounded independently; an
empty table gives an empty result. ``mix`` ignores columns other than id, text and source;
``mixed_documents`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.ranks import with_rank
from tallyspark.llm.text import n_words, row_digest
from tallyspark.session import materialize

BLOCK = 64
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: A source table with at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, n_docs, target for a table of (source, size, n), n being the number of such documents.

    Targets rise with one water level per unit of weight until they hold ``share`` times all
    sizes; a source that reaches ``cap`` times its own size stops there and the others take the
    rest. Each round is one distributed aggregate; rounds end when no further source stops.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    ranked = with_rank(sources, [F.asc_nulls_last("source")])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(
        ranked.select(
            "source",
            "source_size",
            "n_docs",
            F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(float(cap))).alias("most"),
        ),
        "sources",
    )
    level, stopped = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        r = ranked.agg(
            F.sum("source_size").alias("total"),
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if not r["total"] or r["n"] == stopped or not r["weight"]:
            break
        stopped = r["n"]
        level = (share * r["total"] - r["held"]) / r["weight"]
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def _fold(items: str, tie: str) -> str:
    """SQL for pivoting through an array of (r, k, u, id, tie, size, whole, part) structs; tie: its type."""
    cur = f"struct<id:bigint,tie:{tie},size:bigint,whole:bigint,part:double>"
    done = f"array<struct<id:bigint,tie:{tie},size:bigint,copies:bigint>>"

    def ended(who: str, up: int) -> str:
        return f"named_struct('id', {who}.id, 'tie', {who}.tie, 'size', {who}.size, 'copies', {who}.whole + {up}L)"

    def on(who: str, part: str) -> str:
        return f"named_struct('id', {who}.id, 'tie', {who}.tie, 'size', {who}.size, 'whole', {who}.whole, 'part', {part})"

    def step(new: str, out: str) -> str:
        return f"named_struct('cur', {new}, 'out', array_append(s.out, {out}))"

    up_cur, down_x = "s.cur.size * (1 - s.cur.part)", "x.size * x.part"
    down_cur, up_x = "s.cur.size * s.cur.part", "x.size * (1 - x.part)"
    gain, loss = f"least({up_cur}, {down_x})", f"least({down_cur}, {up_x})"
    return f"""aggregate({items}, named_struct('cur', cast(null as {cur}), 'out', cast(array() as {done})), (s, x) -> CASE
        WHEN s.cur IS NULL THEN named_struct('cur', {on("x", "x.part")}, 'out', s.out)
        WHEN x.u * ({gain} + {loss}) < {loss} THEN
            CASE WHEN {up_cur} <= {down_x} THEN {step(on("x", f"greatest(0D, x.part - {up_cur} / x.size)"), ended("s.cur", 1))}
                 ELSE {step(on("s.cur", f"least(1D, s.cur.part + {down_x} / s.cur.size)"), ended("x", 0))} END
        ELSE
            CASE WHEN {down_cur} <= {up_x} THEN {step(on("x", f"least(1D, x.part + {down_cur} / x.size)"), ended("s.cur", 0))}
                 ELSE {step(on("s.cur", f"greatest(0D, s.cur.part - {up_x} / s.cur.size)"), ended("x", 1))} END
        END)"""


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tie"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return _mixed(rows, weights, share, cap, seed).drop("tie")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """All documents with their columns, and size, source_size, target, copies and taken (replacing columns of those names)."""
    added = ["size", "source_size", "target", "copies", "taken"]
    kept = docs.select(*[c for c in docs.columns if c not in added])
    keyed = kept.withColumn("__tie", row_digest(*kept.columns))
    rows = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__tie").alias("tie"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    mixed = _mixed(rows, how.get("weights", WEIGHTS), how.get("share", SHARE), how.get("cap", CAP), how.get("seed", SEED))
    # equal rows differ in copies at most, by one: a plan and how often it is there, for as many rows as there are
    plans = mixed.groupBy(F.col("tie").alias("__tie"), *added).agg(F.count(F.lit(1)).alias("__times"))
    plans = plans.groupBy("__tie").agg(F.collect_list(F.struct("__times", *added)).alias("__plans"))
    one = keyed.dropDuplicates(["__tie"]).join(plans, "__tie").withColumn("__plan", F.explode("__plans"))
    each = one.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__plan.__times"))))
    return each.select(*kept.columns, *[F.col(f"__plan.{c}").alias(c) for c in added])


def _mixed(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: int) -> DataFrame:
    base = materialize(rows.groupBy("doc_id", "tie", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = materialize(source_targets(base, weights, share, cap), "targets")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    rows = base.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", "n_docs")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.round(ratio)
    ratio = F.when(F.abs(ratio - near) < 1e-12, near).otherwise(ratio)
    rows = rows.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("long")).withColumn("part", F.col("ratio") - F.col("whole"))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    keys = ["source", "source_size", "target"]
    settled = (F.col("size") == 0) | (F.col("part") == 0)
    outs = [rows.filter(settled).select(*keys, "doc_id", "tie", "size", F.col("whole").alias("copies"))]
    left, level = rows.filter(~settled).select(*keys, "n_docs", "doc_id", "tie", "nth", "size", "whole", "part"), 0
    while True:
        blocks = F.greatest(F.ceil(F.col("n_docs") / F.lit(float(BLOCK) ** (level + 1))), F.lit(1)).cast("long")
        key = F.xxhash64("doc_id", "tie", "nth", F.lit(seed), F.lit(level))
        draw = F.pmod(F.xxhash64("doc_id", "tie", "nth", "size", F.lit(level), F.lit(seed + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        item = F.struct((-F.col("size")).alias("r"), key.alias("k"), draw.alias("u"), F.col("doc_id").alias("id"), "tie", "size", "whole", "part")
        folded = (
            left.withColumn("block", F.pmod(key, blocks))
            .groupBy(*keys, "n_docs", "block")
            .agg(F.sort_array(F.collect_list(item)).alias("items"))
            .select(*keys, "n_docs", "block", F.expr(_fold("items", dict(rows.dtypes)["tie"])).alias("f"))
        )
        folded = materialize(folded, "level")
        outs.append(folded.select(*keys, F.explode("f.out").alias("o")).select(*keys, F.col("o.id").alias("doc_id"), "o.tie", "o.size", "o.copies"))
        # leftovers of equal rows are told apart by their block
        left = folded.select(*keys, "n_docs", F.col("f.cur.id").alias("doc_id"), "f.cur.tie", F.col("block").alias("nth"), "f.cur.size", "f.cur.whole", "f.cur.part")
        level += 1
        if not left.filter(F.col("n_docs") > F.lit(float(BLOCK) ** level)).limit(1).count():
            break
    outs.append(left.select(*keys, "doc_id", "tie", "size", (F.col("whole") + F.when(F.col("part") >= 0.5, 1).otherwise(0)).alias("copies")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out.select(
        "doc_id",
        "tie",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        F.col("copies").cast("long").alias("copies"),
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )
