import math
import random
import re
from collections import Counter

import pytest

from tallyspark.llm import ranked_search as module
from tallyspark.llm.ranked_search import ranked_search, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def split(t):
    return [x.translate(LOWER) for x in TERM.findall(t or "")]


def brute(docs, items):
    counts = [(i, Counter(split(t))) for i, t in docs]
    N, L = sum(bool(c) for _, c in counts), max(1, sum(c.total() for _, c in counts))
    df = Counter(x for _, c in counts for x in c)
    w = {x: math.floor(1000 * math.log((2 * N + 2) / (2 * n + 1))) for x, n in df.items()}
    out = []
    for item, t in items:
        scored = []
        for i, c in counts:
            m = 10 + (90 * c.total() * N) // L
            s = sum(w[x] * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in set(split(t)) if x in c)
            if s:
                scored.append((-s, LAST if i is None else i))
        out += [(item, k, None if i == LAST else i, -s) for k, (s, i) in enumerate(sorted(scored)[:10], 1)]
    return sorted(out, key=repr)


def test_terms():
    rng = random.Random(3)
    for t in ["", "a", "A-b_C.d\x00e", "Zoë ß 日本語!x", "\x7f\x80\x85é", *("".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x2FF)])) for _ in range(80)) for _ in range(50))]:
        assert [x.decode() for x in terms(t.encode())] == split(t)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    pick = lambda n: [words[min(399, int(rng.expovariate(1 / 40)))] for _ in range(n)]
    items = [(i, " ".join(pick(rng.randint(1, 25)))) for i in range(30)]
    docs = [(i, " ".join(pick(rng.choice([0, 3, 20, 60, 300])))) for i in range(250)]
    docs += [(300 + i, " ".join(pick(20)) + " " + items[i % 9][1] + "!") for i in range(40)]
    docs += [(i, docs[5][1]) for i in (900, 901, 901, None, None, 5)] + [(950, None), (951, " -- "), (952, "w1 " * 20000)]
    items += [(90, None), (91, ""), (92, "nowhere else"), (93, "W1, w1; W2"), (93, "w3 w399"), (None, "w7 w8"), (94, docs[5][1]), (95, docs[5][1] * 40)]
    return docs, items


@pytest.mark.parametrize("tiers", [module.TIERS, (4_000_000_000, 3_000_000_000, 2_000_000_000, 1_000_000_000, 700_000_000, 0), (0,)])
def test_against_brute_force(spark, monkeypatch, tiers):
    monkeypatch.setattr(module, "TIERS", tiers)
    docs, items = corpus(1)
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, tid int, term string").repartition(5)
    q = spark.createDataFrame([(*x, "r", 3) for x in items], "item_id long, text string, row string, rank int").repartition(3)
    out = ranked_search(d, q)
    assert sorted((tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute(docs, items)


def test_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    docs, items = corpus(2)
    d, q = spark.createDataFrame(docs[:120], "doc_id long, text string"), spark.createDataFrame(items[:9], "item_id long, text string")
    assert sorted((tuple(r) for r in ranked_search(d, q).collect()), key=repr) == brute(docs[:120], items[:9])


def test_empty_tables(spark):
    docs, items = corpus(3)
    d, q = spark.createDataFrame(docs[:9], "doc_id long, text string"), spark.createDataFrame(items[:9], "item_id long, text string")
    assert ranked_search(d.limit(0), q).count() == 0
    assert ranked_search(d, q.limit(0)).count() == 0
