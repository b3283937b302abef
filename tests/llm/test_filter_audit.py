import random
import re
from collections import Counter
from itertools import permutations

from tallyspark.llm.filter_audit import FILTERS, audit_filters, flag_counts, subset_survivors

WORD = re.compile("[^\x20\x09-\x0d]+")
LAST = 2**63 - 1


def brute(rows, labels):
    firsts = {}
    for i, t, _ in rows:
        firsts[t or ""] = min(firsts.get(t or "", LAST), LAST if i is None else i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": (LAST if i is None else i) > firsts[t],
        }
        docs.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = Counter()
    shapley = Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for p in permutations(FILTERS):
            left = own
            for step, k in enumerate(p, 1):
                removed = [d for d in left if k in d[1]]
                left = [d for d in left if k not in d[1]]
                out[part, "".join(p), step, k] = (len(left), len(removed), sum(k in d[1] for d in own) - len(removed), sum(d[1] == {k} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed))
                shapley[part, k] += len(removed)
    return sorted((part, order, step, *v, shapley[part, k]) for (part, order, step, k), v in out.items())


def columns(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def corpus():
    rng = random.Random(4)
    words = ["wort", "und", "Ünder", "DAS", "ist", "a$b", "x|y", "ein", "\x85", "日本"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 10, 310])]) for _ in range(rng.choice([0, 5, 199, 200, 201, 400]))) for _ in range(60)]
    texts += texts[:25] * 2 + ["", None, " \n", "w " * 200, "W" * 3 + "w" * 97, "W" * 4 + "w" * 97, "z " * 5000]
    rows = [(rng.choice([i, i, i, 5, None]), t, rng.choice(["de", "en", "", None])) for i, t in enumerate(texts)]
    rows += rows[:4] + [(7, texts[0], "de"), (7, texts[0], "en"), (None, texts[0], "en"), (-3, texts[1], None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, good string").repartition(5)
    return docs, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")


def test_against_every_order(spark):
    rows, labels = corpus()
    assert columns(audit_filters(*frames(spark, rows, labels))) == brute(rows, labels)
    got = audit_filters(*frames(spark, rows, []))
    assert columns(got) == brute(rows, [])
    assert columns(audit_filters(*frames(spark, [], labels))) == []


def test_subsets(spark):
    rows, labels = corpus()
    out = {(r["part"], r["subset"]): r["n"] for r in subset_survivors(flag_counts(*frames(spark, rows, labels))).collect()}
    parts = Counter(r[2] or "" for r in rows)
    assert len(out) == 32 * len(parts) and all(out[p, ""] == n for p, n in parts.items())
    assert all(out[p, "A"] >= out[p, "AB"] >= out[p, "ABE"] >= out[p, "ABCDE"] for p in parts)


def test_one_text_everywhere(spark):
    rows = [(i, "w " * 300, "de") for i in range(500)] + [(None, "w " * 300, "de")] * 3
    docs, labels = frames(spark, rows, [(0, 1, 0)])
    got = {r["step"]: r for r in audit_filters(docs, labels).filter("filter_order = 'EABCD'").collect()}
    assert (got[1]["kept"], got[1]["removed"], got[1]["good_lost"]) == (1, 502, 0)
    assert (got[3]["kept"], got[3]["removed"], got[3]["redundant"], got[3]["good_lost"]) == (0, 1, 502, 1)
