import random

import pytest

from tallyspark.llm import url_filters
from tallyspark.llm.url_filters import ENTRY, url_verdicts


def brute(captures, entries):
    hist = {}
    for lst, kind, rule, action, at in entries:
        if None not in (lst, kind, rule, action, at):
            hist.setdefault((lst, rule), []).append((at, action, kind))
    out = []
    for i, host, path, t in captures:
        active = []
        for (lst, rule), events in hist.items():
            before = sorted(e for e in events if t is not None and e[0] <= t)
            h, _, p = rule.partition("/")
            under = path.lower() == "/" + p or path.lower().startswith("/" + p + "/")
            if before and before[-1][1] == "add" and host and ("." + host.lower()).endswith("." + h) and (not p or under):
                active.append((len(rule), before[-1][2] == "allow", rule, lst))
        top = max(active, default=None)
        out.append((i, host.lower() if host else "", len(active), ",".join(sorted({a[3] for a in active})), top and top[2], bool(top) and not top[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ba.com", "com"]
    rules = ["a.com", "x.a.com", "a.com/p", "a.com/p/q", "b.org/p", "com"]
    day = lambda: f"20{rng.randint(22, 24)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    kinds = {"l1": "block", "l2": "block", "ok": "allow"}
    entries = []
    for _ in range(60):
        lst = rng.choice(list(kinds))
        entries.append((lst, kinds[lst], rng.choice(rules), rng.choice(["add", "add", "remove"]), day()))
    entries += [(None, "block", "a.com", "add", "2022-01-01"), ("l1", "block", "a.com", "add", None)]
    captures = [(i, rng.choice(hosts), rng.choice(["", "/", "/p", "/P/q/r", "/pq", "/p/x"]), day()) for i in range(300)]
    captures += [(400, "z." * n + "x.a.com", "/p", "2023-05-05") for n in (122, 123, 130, 3000)]  # around and beyond the longest name of the DNS
    captures += [(None, "X.a.com", "/p", "2023-05-05"), (1, None, "/p", "2023-05-05"), (2, "a.com", "/p", None), (3, "a.com", "", "2023-01-01"), (3, "a.com", "", "2023-01-01")]
    rows = [(i, f"https://u@{h}:80{p}?q#f" if h else None, t, "x") for i, h, p, t in captures]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_at string, host string")
    out = url_verdicts(df, spark.createDataFrame(entries, ENTRY))
    got = sorted(((r["page_id"], r["host"], r["n_active"], r["lists"], r["rule"], r["blocked"]) for r in out.collect()), key=repr)
    assert got == brute(captures, entries)


def test_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "2024-01-01"), (2, "nonsense", "2024-01-01")], "page_id long, url string, fetched_at string")
    none = spark.createDataFrame([], ENTRY)
    assert [r["blocked"] for r in url_verdicts(df, none).collect()] == [False, False]
    assert url_verdicts(df.limit(0), none).count() == 0
