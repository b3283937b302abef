"""The pipeline against a plain version of each stage, on the smallest table."""

import os

import pytest

import corpus_pipeline
from tallyspark.llm.decontamination import normalise
from tallyspark.llm.pii import pii_digest
from tallyspark.llm.toxicity import score_documents
from tallyspark.session import shared_dir

SF = os.environ.get("TALLYSPARK_TEST_DATA", "/root/testdata") + "/sf0.001"


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    results = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        results.append(out.toPandas())
        if len(results) < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = spark.createDataFrame(results[-1], docs.schema)
    start = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: set(df["doc_id"])
    scores = score_documents(start, labels).toPandas()
    assert ids(results[0]) == ids(scores[scores.predicted == 0])
    kinds = {d: shingles(t) for d, t in zip(results[0].doc_id, results[0].text, strict=True)}
    alike = lambda a, b: len(kinds[a] & kinds[b]) / len(kinds[a] | kinds[b])
    kept, gone = ids(results[1]), ids(results[0]) - ids(results[1])
    assert gone and not [(a, b) for a in kept for b in kept if a < b and alike(a, b) >= 0.8]
    assert all(max(alike(d, o) for o in kinds if o < d) >= 0.65 for d in gone)
    passages = [normalise(t) for t in benchmark.toPandas()["text"]]
    leaks = {d for d, t in zip(results[1].doc_id, results[1].text, strict=True) if any(p in normalise(t) for p in passages)}
    assert ids(results[1]) - ids(results[2]) == leaks
    left = pii_digest(spark.createDataFrame(results[3], start.schema)).toPandas()
    assert ids(results[3]) == ids(results[2]) and not left[["n_email", "n_ip", "n_card", "n_phone"]].to_numpy().any()
    mix = results[4]
    assert ids(mix) == ids(results[3]) and (mix.taken <= 2 * mix["size"]).all()
    by = mix.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()
    assert abs(by.target.sum() - 1.5 * mix["size"].sum()) < 1e-6 * mix["size"].sum()


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, columns with the stages' own names, and an empty table: no stage loses a clean document."""
    words = [f"w{i}" for i in range(60)]
    clean = [(i, " ".join(words[(i * 7 + k * (i + 3)) % 60] for k in range(80)), "xy"[i % 2]) for i in range(12)]
    rows = [*clean, clean[3], (None, clean[4][1], "x"), (None, "lonely text without any id at all", None), (None, None, None), (20, "", "y"), (21, "nasty nasty " * 30, "x"), (22, "mail me@example.com now", "y"), (23, "say the benchmark passage of some length here", "x")]
    schema = "doc_id long, text string, source string, pii string, fp long, hits string"
    docs = spark.createDataFrame([(*r, "mine", 1, "h") for r in rows], schema)
    labels = [(i, int(i >= 100)) for i in [*range(12), *range(100, 112)]]
    trained = docs.unionByName(spark.createDataFrame([(i, "nasty nasty " * 30, "x", "mine", 1, "h") for i in range(100, 112)], schema))
    spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 AS quality").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "The benchmark passage of some length"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = trained
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, str(tmp_path))
        out = spark.createDataFrame(out.collect(), out.schema)
        if name != "mixing":
            assert out.columns == before.columns
        assert stage(spark, before.limit(0), str(tmp_path)).count() == 0
    kept = {(r["doc_id"], r["text"]) for r in out.collect()}
    ids = {i for i, _ in kept}
    assert {i for i, _, _ in clean} <= ids and (22, "mail <EMAIL> now") in kept and (None, "lonely text without any id at all") in kept
    assert not ids & {21, 23, *range(100, 112)} and len([1 for i, t in kept if t == clean[4][1]]) == 1 and out.count() == len(kept)
    assert {"pii", "fp", "hits", "copies", "taken"} <= set(out.columns) and {r["pii"] for r in out.collect()} == {"mine"}


def test_rows_that_differ_in_which_column_is_null(spark):
    """Each of them stays itself in mixing, and near-dedup keeps one of them, whichever."""
    rows = [(1, "a b c", "x", None, None), (1, "a b c", None, "x", None), (1, "a b c", None, None, "x"), (1, "a b c", None, None, "x"), (2, None, "x", None, None), (2, "", "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tag string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing"](spark, docs, "")
    text = lambda df: sorted(repr(tuple(r)) for r in df.select(*docs.columns).collect())
    assert text(mixed) == sorted(map(repr, rows))
    target = {r["source"]: r["target"] for r in mixed.collect()}
    assert all(r["target"] == target[r["source"]] for r in mixed.collect()) and len(target) == 2
    kept = stages["near_dedup"](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2] and all(repr(tuple(r)) in text(docs) for r in kept)


def test_run_leaves_only_its_stages(spark, tmp_path):
    for name, rows, schema in [("labels", [(1, 0, 1)], "doc_id long, toxic int, quality int"), ("benchmark", [(1, "never said in any text here")], "item_id long, text string")]:
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([(i, f"text number {i} of a small table", "x") for i in range(8)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    shared = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 8
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
    assert {name for name, _ in corpus_pipeline.STAGES[:-1]} <= left and not left & {"near_features", "near_nodes", "near_sets", "near_labels"}
