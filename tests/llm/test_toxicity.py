import random
import re
import zlib

import numpy as np

from tallyspark.llm import toxicity as t


def prose(rng, n, bad):
    words = [rng.choice(["stone", "river", "light", "über", "grünt", "paper", "run"]) + rng.choice(["", "s", "ed"]) for _ in range(n)]
    if bad:
        for _ in range(max(2, n // 12)):
            words[rng.randrange(n)] = rng.choice(["awfulness", "awfulish", "nasty!", "NASTY"])
    return " ".join(words)


def sample(n=240, seed=1):
    rng = random.Random(seed)
    label = np.array([int(i % 3 == 0) for i in range(n)])
    return [prose(rng, rng.randint(20, 200), y).lower().encode() for y in label], label


def test_windows_cover_every_word():
    counts = np.array([0, 1, 47, 48, 49, 100, 1000])
    text, first, n = t.windows_of(counts)
    base = np.cumsum(counts) - counts
    for i, c in enumerate(counts):
        spans = sorted((f - base[i], f - base[i] + k) for f, k in zip(first[text == i], n[text == i], strict=True))
        assert spans[0][0] == 0 and spans[-1][1] == c
        assert all(b[0] <= a[1] - t.STRIDE for a, b in zip(spans, spans[1:], strict=False))


def some_windows(label, texts, n=5, seed=0):
    words, rng = t.words_of(texts), np.random.default_rng(seed)
    model = t.start(words, np.arange(len(texts)), rng)
    model.w = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in model.w.items()}
    text, first, size = t.windows_of(words.counts)
    return model, words, text[:n], first[:n], size[:n]


def test_gradients():
    texts, label = sample(6)
    model, words, text, first, size = some_windows(label, texts)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    ids, mask = t.window_ids(words.ids, first, size)
    own = model.vectors(words.keys)
    assert (own > 0).any() and (own == 0).any()
    args = (words, own, ids, mask, label[text].astype(float), np.array([1.0, 2, 1, 1, 3]))
    _, d = t.gradients(model, *args)
    per_vector = np.zeros_like(model.w["embed"])
    np.add.at(per_vector, own, d["embed"])
    d["embed"], rng = per_vector, np.random.default_rng(1)
    for name, w in model.w.items():
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name == "conv":
                at = (at[0], int(words.chars[rng.integers(len(words.chars))]), at[2])
            keep, losses = w[at], []
            for e in (1e-3, -1e-3):
                w[at] = keep + e
                losses.append(t.gradients(model, *args)[0])
            w[at] = keep
            assert abs((losses[0] - losses[1]) / 2e-3 - d[name][at]) < 2e-3 + 0.03 * abs(d[name][at]), name


def plain_logit(model, words):
    """The forward pass of one window, word by word and character by character."""
    w, sig = model.w, lambda x: 1 / (1 + np.exp(-x))
    known = {int(k): i + 1 for i, k in enumerate(model.known)}
    inputs = []
    for word in words:
        chars = [256, *word, 257]
        chars += [257] * (t.REACH - len(chars))
        best = np.max([sum(w["conv"][k][chars[p + k]] for k in range(t.REACH)) for p in range(len(chars) - t.REACH + 1)], axis=0)
        inputs.append(np.concatenate((w["embed"][known.get(int(t.words_of([word]).keys[0]), 0)], np.tanh(best + w["bc"]))))
    states = [[None, None] for _ in words]
    for side, order in ((0, range(len(words))), (1, range(len(words) - 1, -1, -1))):
        h = np.zeros(t.HIDDEN)
        for i in order:
            g, hu = inputs[i] @ w[f"w{side}"] + w[f"b{side}"], h @ w[f"u{side}"]
            z, r = sig(g[: t.HIDDEN] + hu[: t.HIDDEN]), sig(g[t.HIDDEN : 2 * t.HIDDEN] + hu[t.HIDDEN : 2 * t.HIDDEN])
            h = (1 - z) * h + z * np.tanh(g[2 * t.HIDDEN :] + r * hu[2 * t.HIDDEN :])
            states[i][side] = h
    states = [np.concatenate(s) for s in states]
    e = np.exp([np.tanh(s @ w["wa"] + w["ba"]) @ w["va"] for s in states])
    return float(sum(a * s for a, s in zip(e / e.sum(), states, strict=True)) @ w["wo"] + w["bo"][0])


def test_scores_as_a_plain_version():
    texts, label = sample(30)
    texts += [b"a", b"i i i", b"y" * 300, "ß".encode() * 3]
    model, words, *_ = some_windows(label, texts)
    model.final = np.array([0.7, 1.3, -0.2])
    got = t.score_texts(model, texts)
    for text, score in zip(texts, got, strict=True):
        own = re.findall(rb"[0-9a-z\x80-\xff]+", text)
        last = max(len(own) - t.WINDOW, 0)
        starts = [*range(0, last, t.STRIDE), last]
        logits = sorted((plain_logit(model, own[i : i + t.WINDOW]) for i in starts), reverse=True)[:3]
        want = 1 / (1 + np.exp(-(0.7 * logits[0] + 1.3 * np.mean(logits) - 0.2)))
        assert abs(want - score) < 1e-4


def test_long_texts_have_the_same_windows(monkeypatch):
    texts, label = sample(30)
    model, *_ = some_windows(label, texts)
    rng = random.Random(9)
    longs = [prose(rng, n, n % 2).lower().encode() for n in (49, 72, 73, 500, 2000)]
    longs += [b" ".join([*texts[:9], b"z" * 30_000, *texts[9:12], b"q" * 9_000, *texts[12:]]), b"  " * 4000 + texts[0] + b"." * 9000]
    monkeypatch.setattr(t, "BYTES_AT_ONCE", 1 << 20)
    want = t.raw_summary(model, longs)
    for size in (64, 700, 5000):
        monkeypatch.setattr(t, "BYTES_AT_ONCE", size)
        assert np.allclose(t.raw_summary(model, longs), want, atol=1e-5)
    monkeypatch.setattr(t, "BYTES_AT_ONCE", 1 << 14)
    for n in (-1, 0, 1):  # around the size at which a text is read in stretches
        text = (texts[1] * 200)[: (1 << 14) + n]
        monkeypatch.setattr(t, "BYTES_AT_ONCE", 1 << 20)
        want = t.raw_summary(model, [text])
        monkeypatch.setattr(t, "BYTES_AT_ONCE", 1 << 14)
        assert np.allclose(t.raw_summary(model, [text]), want, atol=1e-5)


def test_learns_and_scores_all_of_a_text(monkeypatch):
    model = t.train(*sample(), rounds=5)
    texts, label = sample(90, seed=2)
    score = t.score_texts(model, texts)
    assert ((score >= t.THRESHOLD) == label).mean() > 0.95
    rng = random.Random(5)
    clean = prose(rng, 4000, False).lower().encode()
    bad = " nasty awfulish nasty awfulness nasty awfulish ".encode()
    long = clean + bad + clean
    assert t.score_texts(model, [long])[0] > t.THRESHOLD > t.score_texts(model, [clean])[0]
    monkeypatch.setattr(t, "BYTES_AT_ONCE", 6000)
    assert t.score_texts(model, [long])[0] > t.THRESHOLD > t.score_texts(model, [clean])[0]
    assert len(t.score_texts(model, [b"", b" !", b"x" * 70_000])) == 3


def test_queries(spark):
    texts, label = sample(300)
    rows = [(i, x.decode(), "k") for i, x in enumerate(texts)] + [(500, None, "k"), (None, "nasty", "k"), (501, "", "k"), (3, texts[3].decode(), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(label)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    out = t.score_documents(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    judged = [(r["predicted"], label[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] < 300]
    assert len(judged) > 50 and np.mean([p == y for p, y in judged]) > 0.95
    kept = t.drop_toxic(docs, labels)
    gone = {r["doc_id"] for r in out if r["predicted"]}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out} - gone
    again = docs.union(spark.createDataFrame([(i, "nasty " * 50, "k") for i in range(0, 120, 7)], docs.schema))  # ids with two texts
    two = [sorted((r["doc_id"], r["score"]) for r in t.score_documents(again.repartition(n), labels).collect() if r["doc_id"] is not None) for n in (1, 5)]
    assert [i for i, _ in two[0]] == [i for i, _ in two[1]] and np.allclose([x for _, x in two[0]], [x for _, x in two[1]], atol=1e-4)
    assert t.score_documents(docs.limit(0), labels).count() == 0
    assert t.score_documents(docs, labels.limit(0)).filter("predicted = 1").count() == 0
