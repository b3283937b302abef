import random

from tallyspark.llm.mixing import mix, mixed_documents, source_targets


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), share * sum(sizes.values())
    while open_:
        unit = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= unit * w[s]}
        if not full:
            return target | {s: unit * w[s] for s in open_}
        target |= {s: float(cap * sizes[s]) for s in full}
        rest -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def table(seed, n=3000):
    rng = random.Random(seed)
    names = ["hot"] * 12 + ["b", "é", "", None, "\U0001f600", "Z", "empty"]
    rows = []
    for i in range(n):
        s = rng.choice(names)
        words = 0 if s == "empty" else min(3000, int(rng.paretovariate(1.2) * 5))
        rows.append((i, None if i % 97 == 0 else "wörd \n" * words, s, "x"))
    return rows + [(5, "a b c", "b", "x")] * 3 + [(None, "a b", "b", "x")]


def test_targets_and_taken(spark):
    rows = table(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mix(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken, most = {}, {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    # the leftover is a small document: sources of 150 documents or more miss by half a percent at most
    assert all(abs(taken[s] - want[s]) <= max(5, 0.005 * want[s]) for s in sizes), {s: (taken[s], want[s]) for s in sizes}
    again = mix(df.repartition(13)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_expected_copies(spark):
    """Over seeds, a document's copies average its source's ratio."""
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    total = {}
    for seed in range(4):
        for r in mix(df, seed=seed).collect():
            total.setdefault((r["doc_id"] % 4, r["target"] / r["source_size"]), []).append(r["copies"])
    for (_, ratio), copies in total.items():
        assert abs(sum(copies) / len(copies) - ratio) < 0.12


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(blank).collect()] == [0, 0]
    assert source_targets(spark.createDataFrame([("a", 10, 1), ("b", 0, 1)], "source string, size long, n long"), (5, 2, 1), 1.5, 2.0).count() == 2


def test_rows_without_id_and_repeated_rows(spark):
    """Thousands of rows under one id, or none, fill blocks like others and are rounded one by one."""
    rows = [(None, "a b c", "x")] * 3000 + [(7, "a b c d", "x")] * 2000 + [(i, "a " * (i % 9 + 1), "y") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(df).collect()
    assert len(out) == len(rows)
    for source in ("x", "y"):
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    assert len({r["copies"] for r in out if r["doc_id"] is None}) == 2


def test_documents_keep_their_columns(spark):
    rows = [(i % 40, f"t{i % 50} b c", "x" if i % 3 else None, i % 2) for i in range(400)] + [(None, None, "x", None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    out = mixed_documents(df)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    got = out.collect()
    assert sorted(map(repr, [(r["doc_id"], r["text"], r["source"]) for r in got])) == sorted(repr(r[:3]) for r in rows)
    assert all(r["taken"] == r["copies"] * r["size"] and r["size"] == len((r["text"] or "").split()) for r in got)
    for source in ("x", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3
    assert mixed_documents(df.limit(0)).count() == 0
