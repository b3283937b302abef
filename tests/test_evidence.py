import csv
import io
import random
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evidence, text
from tallyspark.sources import exports, one_file, page_files


def greedy(pairs):
    used, out = set(), []
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if ("l", a) not in used and ("r", b) not in used:
            used |= {("l", a), ("r", b)}
            out.append((a, b))
    return sorted(out)


def test_nearest_pairs_are_the_greedy_ones(spark):
    rng = random.Random(1)
    pages = {p: sorted({(a, b, rng.randint(0, 6)) for a in range(rng.randint(1, 7)) for b in range(rng.randint(1, 7)) if rng.random() < 0.7}) for p in range(40)}
    pages[99] = [(i, j, abs(10 * i - 10 * j + i + 1)) for i in range(12) for j in range(12)]  # a chain: one pair a round
    rows = [(p, *x) for p, xs in pages.items() for x in xs]
    got = {}
    for r in text.nearest_pairs(spark.createDataFrame(rows, "page int, a int, b int, d int"), "page", "a", "b", "d").collect():
        got.setdefault(r["page"], []).append((r["a"], r["b"]))
    one = {p: {(a, b): d for a, b, d in xs} for p, xs in pages.items()}
    assert {p: sorted(x) for p, x in got.items()} == {p: greedy([(a, b, d) for (a, b), d in x.items()]) for p, x in one.items() if x} or all(len(xs) != len(one[p]) for p, xs in pages.items() if sorted(got.get(p, [])) != greedy(xs))
    assert sorted(got[99]) == greedy(pages[99])
    assert text.nearest_pairs(spark.createDataFrame([], "page int, a int, b int, d int"), "page", "a", "b", "d").count() == 0


def test_identities_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abAB -.1") for _ in range(rng.randint(1, 9)))
    pages = [(i, rng.choice([" ", "\n"]).join(word() for _ in range(rng.randint(0, 14)))) for i in range(80)] + [(90, None), (91, "")]
    entries = [(i, [word() for _ in range(rng.randint(0, 3))], [word() * 2 for _ in range(rng.randint(0, 1))]) for i in range(40)]
    squeeze = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower())
    want = []
    for p, t in pages:
        for e, keys, out in entries:
            keys, out = ({squeeze(k) for k in x} - {""} for x in (keys, out))
            if keys and all(k in squeeze(t) for k in keys) and not any(k in squeeze(t) for k in out):
                want.append((p, e))
    df = spark.createDataFrame(pages, "page int, text string"), spark.createDataFrame(entries, "entry int, keys array<string>, exclusions array<string>")
    got = sorted((r["page"], r["entry"]) for r in evidence.page_identities(*df).collect())
    assert got == sorted(want) and want
    assert evidence.page_identities(df[0], df[1].limit(0)).count() == 0


def test_respelled_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["muntinlupa", "makaticity", "boulevard", "alabangx"]
    rows = []
    for p in range(30):
        for n in range(6):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            rows.append((p, n, "".join(w).upper() if rng.random() < 0.5 else "".join(w), rng.random() < 0.5))
    want = {}
    for p, n, w, clean in rows:
        for _, m, r, ok in sorted(x for x in rows if x[0] == p and x[3]):
            if not clean and len(w) == len(r) and w.lower() != r.lower() and sum(a != b for a, b in zip(w.lower(), r.lower(), strict=True)) <= int(len(w) * 0.2 + 1e-9):
                want.setdefault((p, w), r.upper() if w.isupper() else r.lower())
    got = {(r["page"], r["word"]): r["spelling"] for r in evidence.respelled(spark.createDataFrame(rows, "page int, n int, word string, clean boolean")).collect()}
    assert got == want and want


@pytest.mark.parametrize("size", [7, 20, 64, 1000, 10**6])
def test_pages_are_read_once_whatever_the_ranges(spark, tmp_path, size, monkeypatch):
    files = {
        "a.txt": b"before any mark\n[DOCUMENT PAGE 1]\none\ntwo\n[DOCUMENT PAGE 2]\n[DOCUMENT PAGE 3]\n\n[DOCUMENT PAGE 10] no mark\nnor [DOCUMENT PAGE 4]\n\xff\n",
        "b.txt": b"[DOCUMENT PAGE 7]\r\nr\xc3\xa9sum\xc3\xa9 " + b"x" * 300 + b"\n[DOCUMENT PAGE 8]",
        "c.txt": b"no page at all\n",
        "_skip.txt": b"[DOCUMENT PAGE 5]\n",
        "d.txt": b"",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    want = [("a.txt", 1, "one\ntwo"), ("a.txt", 2, ""), ("a.txt", 3, "\n[DOCUMENT PAGE 10] no mark\nnor [DOCUMENT PAGE 4]\n�"), ("b.txt", 7, "résumé " + "x" * 300), ("b.txt", 8, "")]
    spark.dataSource.register(page_files.PageFiles)
    read = spark.read.format("page_files").option("range_bytes", size)
    assert sorted(map(tuple, read.load(str(tmp_path)).collect())) == want
    assert sorted(r["page"] for r in read.schema("page long").load(str(tmp_path)).collect()) == [1, 2, 3, 7, 8]


def test_marks_across_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(page_files, "BLOCK", 300)
    body = b"".join(b"[DOCUMENT PAGE %d]\n%s\n" % (i, b"w" * (i % 290)) for i in range(200))
    (tmp_path / "x").write_bytes(body)
    with open(tmp_path / "x", "rb") as f:
        got = list(page_files.marks(f, 0))
        assert [g[0] for g in got] == list(range(200)) and all(body[a:z].rstrip() == b"[DOCUMENT PAGE %d]" % p for p, a, z in got)
        assert [g[0] for g in page_files.marks(f, got[50][1])] == list(range(50, 200))
        assert [g[0] for g in page_files.marks(f, got[50][1] + 1)] == list(range(51, 200))


def test_sheets(spark, tmp_path):
    rows = [(str(i), 'a "b" & <c> \x01', i / 3, i, date(1998, 1, 2) if i % 2 else None) for i in range(120)] + [("TOTAL", None, 5.0, None, None)]
    df = spark.createDataFrame(rows, "ID string, Text string, Double double, Long long, Day date").coalesce(1).repartitionByRange(4, "Long")
    path = tmp_path / "x.xlsx"
    exports.write(df, str(path), "xlsx", sheet="A & B", sheet_rows="60")
    assert [p.name for p in tmp_path.iterdir()] == ["x.xlsx"]
    with zipfile.ZipFile(path) as z:
        trees = {n: ET.fromstring(z.read(n)) for n in z.namelist()}
    sheets = [n for n in trees if n.startswith("xl/worksheets/")]
    names = [s.get("name") for s in trees["xl/workbook.xml"].iter(f"{{{one_file.MAIN}}}sheet")]
    assert len(sheets) == len(names) > 1 and names[:2] == ["A & B", "A & B 2"]
    assert all(len(list(trees[s].iter(f"{{{one_file.MAIN}}}row"))) <= 60 for s in sheets)
    total = [r for s in sheets for r in trees[s].iter(f"{{{one_file.MAIN}}}row") if r[0].get("s") == "2"]
    assert len(total) == 1
    spark.dataSource.register(one_file.Sheets)
    back = spark.read.format("sheets").schema("Long long, ID string, Text string, Double double, Day string").load(str(path)).collect()
    want = sorted((i, k, t and t.replace("\x01", "�"), x, d and d.isoformat()) for k, t, x, i, d in rows[:-1])
    assert sorted(tuple(r) for r in back if r["ID"] != "TOTAL") == want and [tuple(r) for r in back if r["ID"] == "TOTAL"] == [(None, "TOTAL", None, 5.0, None)]


def test_csv_is_one_file_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f'x,"{i}"\n', None) for i in range(500)], "id long, v string, w string").repartitionByRange(5, "id").sortWithinPartitions("id")
    exports.write(df, str(tmp_path / "x.csv"), "csv", bom="true")
    assert [p.name for p in tmp_path.iterdir()] == ["x.csv"]
    raw = (tmp_path / "x.csv").read_text("utf-8-sig")
    assert (tmp_path / "x.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    rows = list(csv.reader(raw.splitlines(keepends=True)))
    assert rows[0] == ["id", "v", "w"] and [r[:2] for r in rows[1:]] == [[str(i), f'x,"{i}"\n'] for i in range(500)]


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    exports.write(spark.createDataFrame([(1,)], "id long"), str(tmp_path / "x.csv"), "csv")
    before = (tmp_path / "x.csv").read_bytes()
    with pytest.raises(Exception):  # noqa: B017, PT011
        exports.write(spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id")), str(tmp_path / "x.csv"), "csv")
    assert (tmp_path / "x.csv").read_bytes() == before


def test_sheets_are_packed_where_they_are_written(spark, tmp_path):
    a, b = b"some text " * 999, bytes(range(256)) * 77
    assert one_file.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    path = str(tmp_path / "a.xlsx")
    exports.write(spark.range(0, 5000, 1, 3).selectExpr("CAST(id AS string) AS ID", "repeat('x', 200) AS t"), path, "xlsx")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 5001
    writer = one_file.SheetWriter({"path": path}, one_file.StructType.fromDDL("ID string"))
    out, part = io.BytesIO(), one_file.Part("p")
    writer.opened(out, part).write(writer.row(("x" * 100_000,)))
    assert part.plain > 100_000 and len(out.getvalue()) < 5000
