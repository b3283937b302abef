import random

from tallyspark.llm import decontamination as d
from tallyspark.llm.decontamination import align, budget, build, codes, drop_leaks, find_leaks, normalise, search


def brute_distance(pattern, text):
    """Fewest edits of the pattern in any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edit(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "é" + text[i + 1 :]])
    return text


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "tion", "é", "ou", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_align():
    rng = random.Random(1)
    for _ in range(200):
        p = prose(rng, 6)
        t = prose(rng, 3) + edit(rng, p, rng.randint(0, 5)) + prose(rng, 3)
        best = brute_distance(p, t)
        got = align(codes(p), codes(t), 4)
        if best > 4:
            assert got is None
        else:
            assert got[0] == best and brute_distance(p, t[got[1] : got[2]]) == best


def test_against_brute_force():
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(4, 50))) for i in range(25)] + [(90, ""), (91, "short"), (92, "中文" * 40)]
    b = build(items)
    texts = []
    for i, t in items[:25]:
        n = budget(len(normalise(t)))
        texts.append(prose(rng, 30) + " " + edit(rng, t, rng.randint(0, n + 4)).upper().replace(" ", "\n ") + " " + prose(rng, 30))
    texts += [prose(rng, 300), "", "x", items[3][1], items[3][1] + " " + items[3][1], "汉字" * 300, "中文" * 45]
    for text in texts:
        want = {i for i, t in items if len(normalise(t)) >= d.SHORTEST and brute_distance(normalise(t), normalise(text)) <= budget(len(normalise(t)))}
        assert {h[0] for h in search(b, text)} == want


def test_stretches(monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(rng, 30)) for i in range(4)]
    b = build(items)
    text = " ".join(prose(rng, 40) + " " + t for _, t in items)
    whole = search(b, text)
    monkeypatch.setattr(d, "STRETCH", 97)
    assert search(b, text) == whole and {h[0] for h in whole} == {0, 1, 2, 3}


def test_queries(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, 30), "k") for i in range(6)] + [(7, None, "k")]
    docs = [(1, prose(rng, 20) + items[2][1] + prose(rng, 9), "a"), (2, None, "a"), (3, prose(rng, 200), "a"), (None, items[5][1], "a"), (1, "", "a")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string, hits string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    want = {(1, 2), (None, 5)}
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()} == want
    assert sorted((r["doc_id"] for r in drop_leaks(docs, items).collect())) == [1, 2, 3] and drop_leaks(docs, items).columns == docs.columns
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0
    monkeypatch.setattr(d, "BLOCK_CHARS", 300)
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()} == want


def test_short_passages(monkeypatch):
    """Passages down to one character are found wherever they stand as they are."""
    rng = random.Random(5)
    text = prose(rng, 400)
    items = [(n, normalise(text[at : at + n])) for n in range(1, 30) for at in [rng.randrange(len(text) - 30)]]
    items += [(100, "no such"), (101, "zz"), (102, "the  AN"), (103, ""), (104, "中文"), (105, items[4][1])]
    places = {}
    for stretch in (1 << 19, 40):
        monkeypatch.setattr(d, "STRETCH", stretch)
        for t in (text, text[:60].upper(), "", "中文 the an"):
            want = {i for i, p in items if p and normalise(p) in normalise(t)}
            hits = search(build(items), t)
            assert {h[0] for h in hits if len(normalise(dict(items)[h[0]])) < d.Q or not h[3]} == want
            assert all(normalise(t)[s:e] == normalise(dict(items)[i]) for i, s, e, x in hits if not x)
            assert places.setdefault(t, [h for h in hits if h[2] - h[1] < d.Q]) == [h for h in hits if h[2] - h[1] < d.Q]
    assert len([h for h in search(build([(1, "ab")]), "ab abab b")]) == 3


def test_every_occurrence_is_reported():
    """Places side by side, in prose and in texts that repeat themselves, verbatim and edited."""
    rng = random.Random(7)
    for passage in ("ha " * 20 + "ha", "ab" * 30, prose(rng, 30), "x" * 50):
        b = build([(1, passage)])
        p = normalise(passage)
        for n in (1, 2, 5):
            text = prose(rng, 20) + " # " + " # ".join([p] * n) + " # " + prose(rng, 20)
            hits = search(b, text)
            assert len([h for h in hits if h[3] == 0]) == n and [normalise(text)[s:e] for _, s, e, x in hits if not x] == [p] * n
        edited = [edit(rng, p, 2).strip() for _ in range(3)]
        text = " 0123456789 98765 ".join(["", p, *edited, p, ""])
        hits = search(b, text)
        assert len(hits) == 5 and [h[3] == 0 for h in hits] == [True, *[e == p for e in edited], True]
        for _, s, e, x in hits:
            assert brute_distance(p, normalise(text)[s:e]) == x
    tiled = "ab" * 400
    assert len(search(build([(1, "ab" * 30)]), tiled)) == 800 // 60


def test_very_long_passages():
    rng = random.Random(8)
    item = prose(rng, 160_000)
    assert len(item) > 1 << 20
    short = prose(rng, 30)
    b = build([(1, short), (2, item)])
    changed = list(item)
    for i in range(0, len(changed), len(changed) // 90):
        changed[i] = "#"
    text = prose(rng, 50) + " @ " + item + " @ " + short + " @ " + "".join(changed)
    hits = search(b, text)
    assert [(h[0], h[3]) for h in hits] == [(1, 0), (2, 0), (2, len([i for i in range(len(item)) if changed[i] != item[i]]))]


def test_blocks(spark, monkeypatch):
    """Several blocks give what one block gives, whichever entry point is used."""
    rng = random.Random(9)
    items = [(i, prose(rng, 25)) for i in range(9)]
    docs = [(i, prose(rng, 20) + (" " + items[i % 9][1] if i % 2 else ""), "a") for i in range(20)] + [(3, items[3][1], "a"), (3, items[3][1], "b")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string, hits2 string"), spark.createDataFrame(items, "item_id long, text string")
    one = [sorted(map(str, f(docs, items).collect())) for f in (find_leaks, drop_leaks, d.with_hits)]
    monkeypatch.setattr(d, "BLOCK_CHARS", 400)
    many = [sorted(map(str, f(docs, items).collect())) for f in (find_leaks, drop_leaks, d.with_hits)]
    assert one[:2] == many[:2] and len(one[0]) == 12 and one[2] == many[2]
