import glob
import hashlib

import numpy as np

from tallyspark.llm import warc
from tallyspark.llm.warc import read_warc, warc_round_trip, write_warc

LONG = "é" * 80
ROWS = [
    (1, "http://a/1", "short", 0),
    (2, "http://a/2", "short", 0),
    (7, "http://a/7 x\r\nX: y", LONG, 0),
    (5, None, LONG, 0),
    (5, None, LONG, 0),
    (9, "http://a/9", LONG, 1),
    (None, "http://a/n", LONG, 1),
    (4, "http://a/4", None, 1),
    (3, "http://ü/3", "x" * 300_000, 1),
    (8, "http://a/8", "", 1),
    (6, "http://a/6", "x" * 300_000, 1),
]
SCHEMA = "page_id long, url string, html string, size int"


def brute(rows):
    first = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        ref = first.get(b)
        again = ref is not None and (i is None or i > ref)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [tuple(r) for r in warc_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute(ROWS)
    assert warc_round_trip(df.limit(0)).count() == 0


def test_same_files_from_any_partitioning(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    seen = []
    for k, d in enumerate((df.repartition(1), df.repartition(7))):
        m = write_warc(d, str(tmp_path / str(k)), shard_bytes=100_000, roll_bytes=300)
        seen.append(sorted(tuple(r) for r in m.collect()))
        assert not glob.glob(str(tmp_path / str(k) / "_tmp*"))
    assert seen[0] == seen[1] and len(seen[0]) > 4
    back = {r["page_id"]: r for r in read_warc(spark, str(tmp_path / "1")).collect()}
    assert bytes(back[3]["payload"]) == b"x" * 300_000 and back[6]["payload"] is None and back[3]["url"] == "http://%C3%BC/3"


def test_shards_are_cut_by_bytes(spark, tmp_path):
    """Every shard holds about as many bytes; pages without id and of one id fall to several; each has a task of its own."""
    rows = [(None, f"u{i}", f"{i} " * 300, 0) for i in range(300)] + [(7, f"v{i}", f"{i} " * 200, 0) for i in range(200)] + [(i, "w", "z" * (i % 50) * 40, 0) for i in range(1000, 1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (60_000, 10**9):
        folder = str(tmp_path / str(limit))
        manifest = write_warc(df, folder, shard_bytes=limit, roll_bytes=1 << 30).collect()
        assert sum(r["records"] for r in manifest) == len(rows) and len({r["shard"] for r in manifest}) == len(manifest)
        sizes = {}
        for r in read_warc(spark, folder).select("page_id", "payload_bytes", "refers_to").collect():
            sizes[r["page_id"]] = sizes.get(r["page_id"], 0) + 1
        assert sizes[None] == 300 and sizes[7] == 200
        if limit == 60_000:
            total = sum(len(r[2]) + warc.HEAD for r in rows)
            assert abs(len(manifest) - total / limit) <= 2
    n = 37
    places = warc._places(spark, n)
    got = [r[0] for r in spark.createDataFrame([(int(x),) for x in places], "x long").select(warc.F.pmod(warc.F.hash("x"), warc.F.lit(n))).collect()]
    assert got == list(range(n))


def test_shard_borders():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 6, (2, 40))
    borders = np.unique(pairs.T, axis=0)[::3].T
    order, tie = rng.integers(-1, 7, (2, 200))
    want = [sum((a, b) <= (x, y) for a, b in borders.T.tolist()) for x, y in zip(order.tolist(), tie.tolist(), strict=True)]
    assert warc.shards_of(borders, order, tie).tolist() == want
