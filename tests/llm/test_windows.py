import hashlib
import random
from collections import Counter

import numpy as np

from tallyspark.llm import windows
from tallyspark.llm.hashing import word_hashes
from tallyspark.llm.windows import remove_repeats


def brute(rows):
    docs = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + 35]) for w in docs for i in range(len(w) - 34))
    out = []
    for (doc_id, _), w in zip(rows, docs, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [[rng.choice(["an", "of", "thé", "tion", "x", "😀", "\x85"]) for _ in range(rng.randint(0, 150))] for _ in range(n)]
    for i in range(0, n, 2):
        j, a = rng.randrange(n), rng.randint(0, 60)
        base[i][10:10] = base[j][a : a + rng.randint(20, 80)]
    return [rng.choice([" ", "\n", "  "]).join(w) for w in base]


def test_against_brute_force(spark):
    texts = [*corpus(1), corpus(1)[3], corpus(1)[3], "w " * 34, "w " * 35, "w " * 36, "v " * 200, None, "", " \n", "a b c d e f g h i j\n" * 9, "Ü" * 5000]
    rows = list(enumerate(texts)) + [(None, texts[4]), (7, texts[7]), (7, texts[8])]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(7)
    assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=repr) == brute(rows)
    assert remove_repeats(df.limit(0)).count() == 0


def test_long_document_in_parts(monkeypatch):
    monkeypatch.setattr(windows, "PART_WORDS", 50)
    words = [str(i % 61).encode() for i in range(400)]
    parts = windows.prepare(b" ".join(words))
    assert len(parts) > 3 and all(p.split() == words[at : at + len(p.split())] for at, p in parts)
    assert {(at + i) for at, p in parts for i in range(len(p.split()) - 34)} == set(range(400 - 34))


def test_word_hashes():
    raw = b"one two three one two twoo one"
    words = raw.split()
    first = [i for i in range(len(raw)) if (i == 0 or raw[i - 1] == 32)]
    h = word_hashes(np.frombuffer(raw, np.uint8), np.array(first), np.array(first) + np.array([len(w) for w in words]))
    assert len(set(h.tolist())) == 4 and h[0] == h[3] == h[6] and h[1] == h[4]
