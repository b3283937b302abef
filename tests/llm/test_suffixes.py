import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import suffixes
from tallyspark.llm.suffixes import _words, remove_copies, suffix_order


def brute(rows):
    """rows: (doc_id, text)"""
    docs = [(d if d is not None else 2**63 - 1, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for (d, t), (doc_id, _) in zip(docs, rows, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["an", "thé", "tion", "of", "xx", "a" * 30, "\x00", "zz\n", "😀"]
    base = ["".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(n)]
    for i in range(0, n, 3):
        j, a = rng.randrange(n), rng.randint(0, 60)
        base[i] = base[i][:40] + base[j][a : a + rng.randint(20, 300)] + base[i][40:]
    return base


def test_against_brute_force(spark):
    texts = [*corpus(1), *corpus(1)[:5], "a" * 500, "a" * 49, "a" * 50, "b" + "a" * 60, None, "", "the same line of text, longer than fifty bytes, again and again\n" * 8]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "a" * 70), (7, texts[7]), (7, texts[8])]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, order int").repartition(7)
    got = sorted((tuple(r) for r in remove_copies(df).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    assert remove_copies(df.limit(0)).count() == 0


def test_small_sorts_and_parts(spark, monkeypatch):
    texts = corpus(2, 30)
    texts.append("".join(texts))
    parts = suffixes.prepare(texts[-1].encode())
    assert len(parts) == 1
    monkeypatch.setattr(suffixes, "PART_BYTES", 100)
    cut = suffixes.prepare(texts[-1].encode())
    whole = {texts[-1].encode()[i : i + 50] for i in range(len(texts[-1].encode()) - 49)}
    assert {p[i : i + 50] for _, p in cut for i in range(len(p) - 49)} == whole
    assert all(texts[-1].encode()[at : at + len(p)] == p for at, p in cut)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([97, 98, 99, 255, 0]), min_size=1, max_size=400))
def test_suffix_order(values):
    t = np.array(values, np.uint8)
    order = suffix_order(t, _words(np.concatenate((t, np.zeros(80, np.uint8)))))
    raw = bytes(values)
    got = [raw[i : i + 50] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(raw)))
    padded = [g + bytes(50 - len(g)) for g in got]
    assert padded == sorted(padded)


def test_strings_with_many_documents_and_runs(spark):
    """The sort decides for strings that many documents, or one document many times, have, in one batch and over several."""
    line = "a line that is longer than fifty bytes, and that stands in many documents at once.\n"
    other = "another line of more than fifty bytes, of which one document has nearly all first.\n"
    texts = [(None, line * 3), (9, line * 4 + other), (3, other[:60]), (4, line[5:] * 2), (5, line * 30), (5, line + other * 2), (2, "x" * 200), (8, "x" * 120), (2, other[20:])]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, key string")
    for parts in (1, 6):
        got = sorted((tuple(r) for r in remove_copies(df.repartition(parts)).collect()), key=repr)
        assert got == sorted(brute(texts), key=repr)
