import random

import numpy as np
import xxhash

from tallyspark.llm import components, simhash
from tallyspark.llm.components import connected_components
from tallyspark.llm.simhash import BRUTE, alike, keep_one_of_copies, link_group, links, near_duplicates, shingle_set, sketch_of


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_documents(spark):
    rng = random.Random(1)
    words = [f"wörd{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts = base + [t.replace("wörd1 ", "WÖRD1\t") for t in base[:20]] + [b + " extra" for b in base] + [None, "", " \n", "a", "A", "a b", "Ünder \x85 x y z"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    random.Random(2).shuffle(rows)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [brute_fp(t) for _, t in rows]
    want = {(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, brute_components([d for d, _ in rows], fps), strict=True)}
    assert got == want


def test_links_keep_every_connection(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:100]:
        for _ in range(4):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(f)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    parts = connected_components(links(spark.createDataFrame([(s,) for s in signed], "fp long")))
    comp = dict(parts.collect())
    got = [comp.get(s, s) for s in signed]
    assert got == brute_components(signed, fps)


def test_hot_key():
    rng = random.Random(4)
    top = 0xABCD1234 << 32
    fps = sorted({top | rng.getrandbits(12) << rng.randint(0, 20) for _ in range(3 * BRUTE)})
    edges = link_group(np.array(fps, np.uint64), 1)
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))
    for a, b in edges:
        assert (a ^ b).bit_count() <= 3
        ra, rb = root[at[a]], root[at[b]]
        if ra != rb:
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    assert [fps[r] for r in root] == brute_components(fps, fps)


def test_one_of_copies_stays_whatever_the_rows(spark):
    """Null ids, repeated rows and ids, ties and a clashing column; the row that stays does not depend on the partitions."""
    rows = [(5, "a b c d", 1), (2, "a b c d", 3), (2, "a b c d", 2), (2, "a b c d", 2), (9, "other words in here", 3), (None, "a b c d", 4), (None, "lonely text with no id", 5), (None, "another text that has none", 6), (None, "another text that has none", 6), (9, None, 7), (8, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = [sorted(map(str, keep_one_of_copies(df.repartition(n)).collect())) for n in (1, 4)]
    assert kept[0] == kept[1] and len(kept[0]) == 5 and keep_one_of_copies(df).columns == df.columns
    out = [tuple(r) for r in keep_one_of_copies(df).collect()]
    assert sorted(r[2] for r in out if r[0] is None) == [5, 6] and {r[0] for r in out if r[0]} == {2, 8, 9} and [r[1] for r in out if r[0] == 8] == [""]
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one_of_copies(df.limit(0)).count() == 0


def test_components(spark, monkeypatch):
    """Rounds of joins and the last task give the same; chains, stars and rings."""
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, rng.randrange(200, 300)) for _ in range(60)] + [(400, 401), (401, 402), (402, 400), (7, 7), (401, 400)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = sorted(map(tuple, connected_components(df).collect()))
    monkeypatch.setattr(components, "SMALL", -1)
    many = sorted(map(tuple, connected_components(df).collect()))
    assert one == many and dict(one)[160] == 100 and dict(one)[402] == 400 and 7 not in dict(one)
    assert connected_components(df.limit(0)).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies(spark):
    """Documents alike to 0.85 or more lose all but one; those below 0.6 stay."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    texts = {}
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        texts[i] = " ".join(base)
        if i % 2:
            copy = list(base)
            for _ in range(max(1, len(copy) // 80)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[1000 + i] = " ".join(copy)
        if i % 3 == 0:
            texts[2000 + i] = texts[i].upper()
        if i % 5 == 0:
            texts[3000 + i] = " ".join(base[: len(base) // 2]) + " " + " ".join(rng.choice(words) for _ in range(len(base) // 2))
    rows = [(i, t, "x") for i, t in texts.items()] + [(7, texts[7], "x"), (None, "no id here at all", "x"), (None, None, "x"), (None, "", "x")]
    out = keep_one_of_copies(spark.createDataFrame(rows, "doc_id long, text string, fps string"))
    kept = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    near = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    gone = [i for i in texts if i >= 1000 and near(texts[i], texts[i % 1000]) >= 0.85]
    stay = [i for i in texts if i < 1000 or near(texts[i], texts[i % 1000]) < 0.6]
    assert len(gone) > 40 and not set(gone) & set(kept) and set(stay) <= set(kept)
    assert len(kept) == len(set(kept)) and out.filter("doc_id is null").count() == 2 and out.columns == ["doc_id", "text", "fps"]
    assert keep_one_of_copies(out.limit(0)).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_at_the_threshold(spark):
    """Pairs alike to 0.80 to 0.85 are found, short texts too."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(9000)]
    rows = []
    for n in (12, 20, 60, 200, 1000):
        found = 0
        while found < 40:
            a = [rng.choice(words) for _ in range(n)]
            b = a + [rng.choice(words) for _ in range(rng.randint(1, max(1, n // 5)))] if n < 50 else [rng.choice(words) if rng.random() < 0.02 else w for w in a]
            if 0.8 <= jaccard(shingles(" ".join(a)), shingles(" ".join(b))) < (0.9 if n < 20 else 0.85):
                rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
                found += 1
    kept = {r["doc_id"] for r in keep_one_of_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, len(rows), 2))


def test_edited_copies_of_one_text(spark, monkeypatch):
    """In a large group of edited copies exactly the connected ones go, by all pairs; also when a key is dealt in blocks."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(9000)]
    base = [rng.choice(words) for _ in range(300)]
    copies = []
    for _ in range(200):
        c = list(base)
        for _ in range(rng.randint(4, 9)):
            c[rng.randrange(300)] = rng.choice(words)
        copies.append(" ".join(c))
    sets = [shingles(c) for c in copies]
    root = list(range(len(copies)))
    for i in range(len(copies)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 100 < len(set(root)) < len(copies) - 20
    rows = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    assert {r["doc_id"] for r in keep_one_of_copies(rows).collect()} == set(root)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert {r["doc_id"] for r in keep_one_of_copies(rows).collect()} == set(root)


def test_long_texts():
    """Sketches of long texts agree no more than their shingles do; what decides are the shingles."""
    rng = np.random.default_rng(9)
    a, b = (np.unique(rng.integers(0, 2**64, 400_000, np.uint64)) for _ in range(2))
    x, y = (np.frombuffer(sketch_of(s), np.uint8) for s in (a, b))
    assert (x == y).mean() < 0.05
    half = np.union1d(a[:200_000], b[:200_000])
    (share,) = alike(simhash.pa.array([a.tobytes()]), simhash.pa.array([half.tobytes()])).to_pylist()
    assert abs(share - 200_000 / 600_000) < 0.01
    assert shingle_set("").size == 0 and shingle_set("A b\tc").size == 1 and shingle_set("a b c d e f").size == 2
