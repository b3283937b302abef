import math
import random
import re
from collections import Counter

import numpy as np

from tallyspark.llm import quality
from tallyspark.llm.quality import base_counts, best_cut, judge_quality, ngrams

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + d for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_counts():
    rng = random.Random(1)
    cases = ["", " \n", "a", "a b c a b c", "x\nx\n \n \nx ", "é😀 ### | <b>\n\x85 é😀", "w " * 80]
    cases += [" ".join(rng.choice(["a", "b", "ç", "d\n", "##"]) for _ in range(rng.randint(0, 300))) for _ in range(50)]
    for t in cases:
        assert base_counts(t.encode()) == brute(t)


def test_ngrams_in_parts(monkeypatch):
    text = " ".join(f"wort{i % 97}!! é" for i in range(3000)).encode()
    whole = np.bincount(np.concatenate(list(ngrams(text))))
    monkeypatch.setattr("tallyspark.llm.quality.PART", 1000)
    assert (np.bincount(np.concatenate(list(ngrams(text)))) == whole).all()
    assert not [g for t in (b"", b"  ") for g in ngrams(t) if len(g)]


def test_cut():
    assert best_cut([(-100, 0, 9), (10, 5, 0)]) == (-99 + 10) / 2 / 50
    assert best_cut([(1, 4, 0)]) == float("-inf")


def test_separates_junk(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(120))
    junk = lambda: " | ".join(rng.choice(words).upper() + "!!" for _ in range(120))
    rows = [(i, prose() if i % 4 else junk(), "k") for i in range(200)] + [(900, None, "k"), (901, "", "k"), (7, "few words", "k")]
    labels = [(i, 1 if i % 4 else 0) for i in range(0, 120)] + [(3, 0), (None, 1), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = judge_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = r["doc_id"] < 900 and r["n_words"] > 2 and bool(r["doc_id"] % 4)
        assert r["kept"] == want
    none = judge_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.filter("kept <> (not base_failed)").count() == 0
    assert judge_quality(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


ODD, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def plain_hash(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & ALL
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & ALL
    return h ^ h >> 33


def plain_grams(text):
    """Buckets of tokens and of pairs of tokens, one at a time."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", (text or "").encode())
    hashes = [plain_hash(sum((b + 1) * pow(ODD, i, 1 << 64) for i, b in enumerate(t)) & ALL) for t in tokens]
    return [h % quality.BUCKETS for h in hashes] + [plain_hash((a * 3 + b) & ALL) % quality.BUCKETS for a, b in zip(hashes, hashes[1:], strict=False)]


def plain_verdicts(rows, labels):
    good = {i for i, y in labels if i is not None and y is not None and max(v for d, v in labels if d == i and v is not None) == 1}
    bad = {i for i, y in labels if i is not None and y is not None} - good
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(plain_grams(t))
        if i in good:
            target.update(plain_grams(t))
    p = lambda c, g: math.log((c[g] + 1) / (c.total() + quality.BUCKETS))
    scores, failed = [], []
    for _, t in rows:
        grams = plain_grams(t)
        scores.append(sum(p(target, g) - p(raw, g) for g in grams) / len(grams) if grams else 0.0)
        n, *_, again = brute(t)
        failed.append(n < 50 or 100 * again > 50 * n)
    bins = [math.floor(max(-10, min(10, s)) * 50) for s in scores]
    known = [(b, i in good) for b, f, (i, _) in zip(bins, failed, rows, strict=True) if not f and i in good | bad]
    n_good, n_bad = sum(y for _, y in known), sum(not y for _, y in known)
    cut = -math.inf
    if n_good and n_bad:
        # the first cut of the highest mean hit rate, put in the middle of the empty bins before it
        at = sorted({b for b, _ in known})
        rate = {c: sum(y and b >= c for b, y in known) / n_good + sum(not y and b < c for b, y in known) / n_bad for c in at}
        best = max(at, key=lambda c: (rate[c], -c))
        before = [b for b in at if b < best]
        cut = ((before[-1] + 1 if before else best) + best) / 100
    return [(s, cut, not f and s >= cut) for s, f in zip(scores, failed, strict=True)]


def test_verdicts_as_a_plain_version(spark):
    rng = random.Random(5)
    words = [f"wört{i}" for i in range(60)] + ["|", "<<", "é!"]
    rows = [(i, " ".join(rng.choice(words[: 30 + 33 * (i % 3 == 0)]) for _ in range(rng.randint(30, 160)))) for i in range(90)]
    rows += [(200, None), (201, ""), (None, rows[4][1]), (7, rows[8][1]), (202, "a b c " * 40), (203, "x" * 5000)]
    labels = [(i, int(i % 3 != 0) if i % 7 else i % 2) for i in range(70)] + [(7, 0), (None, 1), (3, None), (200, 1)]
    docs, known = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")
    for marks in (known, known.filter("quality = 1"), known.limit(0)):
        want = plain_verdicts(rows, [tuple(r) for r in marks.collect()])
        got = judge_quality(docs, marks).collect()
        key = lambda r: (repr(r[0]), repr(r[1]), r[2])
        got = sorted(((r["doc_id"], r["n_words"], round(r["score"], 7), r["threshold"], r["kept"]) for r in got), key=key)
        want = sorted(((i, len(WORD.findall(t or "")), round(s, 7), c, k) for (i, t), (s, c, k) in zip(rows, want, strict=True)), key=key)
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-6)


def test_tokens_are_never_cut(monkeypatch):
    text = b"ab " + b"q" * 5000 + b" cd" + b"#" * 3000
    whole = sorted(np.concatenate(list(ngrams(text))).tolist())
    assert whole == sorted(plain_grams(text.decode()))
    for size in (2, 1000, 4999, 5000, 5001):
        monkeypatch.setattr(quality, "PART", size)
        assert sorted(np.concatenate(list(ngrams(text))).tolist()) == whole
