"""Benchmark decontamination by the q-gram lemma: count in diagonal bands, then align in a band.

Texts are lower-cased and white space is brought to single spaces. A passage of m characters may
occur with k edits, ``RATE`` * m of them and at most ``MOST_EDITS``; any such occurrence shares at
least m + 1 - q * (k + 1) q-grams with the passage, all on at most k + 1 neighbouring diagonals
(place in text minus place in passage). Diagonals are grouped in bands of twice that width that
overlap by half, so one band holds all of them. Bands that reach the count are kept as regions and
verified: verbatim occurrences by comparison, the rest by an alignment along the region's diagonals
that leaves the text's ends free and yields every place where the passage ends within k edits.

Passages below q characters have no q-gram: every stretch of their length is looked up by its key.
The benchmark is dealt in blocks of at most ``BLOCK_CHARS`` characters. One block, the usual case, is
broadcast; of several, each takes a pass over the corpus, so memory is bounded by one block. The
corpus is never shuffled. Texts are searched in overlapping stretches, so memory is bounded there too.

Defined results: null and empty texts hold no passage, and empty passages are in none; passages too
short for any edit must occur as they are, anywhere in the text like longer ones; equal
passages are reported under each of their ids; repeated rows give repeated hits; empty tables give
an empty result; other columns are kept by ``with_hits`` and ignored by ``find_leaks``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import materialize

Q = 10
RATE, MOST_EDITS = 0.08, 256
#: Only empty passages are left out.
SHORTEST = 1
BLOCK_CHARS = 1 << 20
#: Characters searched at once, and diagonals extended at once.
STRETCH, DIAGONALS = 1 << 19, 1 << 14
#: Places in the table that tells whether a q-gram may be the benchmark's.
SIEVE = 22
HIT = "array<struct<item_id:bigint,start:bigint,end:bigint,distance:int>>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit key of each q-gram, of characters folded to a byte (Latin characters to themselves)."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    folded = np.zeros(len(chars) + 16, np.uint8)
    folded[: len(chars)] = chars ^ (chars >> 8) * 29
    at = lambda d: np.ndarray((n,), "<u8", buffer=folded.data, offset=d, strides=(1,))
    return at(0) * _ODD + at(Q - 8)


def budget(m: int) -> int:
    """Edits allowed in a passage of m characters: its share, but no more than the lemma can bound."""
    return max(0, min(int(RATE * m), MOST_EDITS, (m - Q) // Q))


@dataclass
class Benchmark:
    ids: list[int]
    texts: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    place: np.ndarray
    width: np.ndarray
    need: np.ndarray
    sieve: np.ndarray
    #: Of the passages below q characters, by length: their keys in order, and their items.
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def short_grams(chars: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each stretch of n characters."""
    out = np.zeros(max(0, len(chars) - n + 1), np.uint64)
    for i in range(n):
        out = (out + chars[i : i + len(out)]) * _ODD
    return out


def build(items: list[tuple[int, str]]) -> Benchmark | None:
    """The q-grams of the passages, by key."""
    kept = [(i, codes(t)) for i, t in ((i, normalise(t)) for i, t in items) if len(t) >= SHORTEST]
    if not kept:
        return None
    g = [grams(t) for _, t in kept]
    key = np.concatenate(g)
    item = np.repeat(np.arange(len(g), dtype=np.int32), [len(x) for x in g])
    place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in g])
    by = np.argsort(key, kind="stable")
    keys, first, count = np.unique(key[by], return_index=True, return_counts=True)
    size = np.array([len(t) for _, t in kept])
    k = np.array([budget(int(m)) for m in size])
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[(keys >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
    short = {}
    for n in range(SHORTEST, Q):
        own = np.flatnonzero(size == n)
        if len(own):
            key = np.concatenate([short_grams(kept[i][1], n) for i in own])
            short[n] = np.sort(key), own[np.argsort(key, kind="stable")]
    return Benchmark([i for i, _ in kept], [t for _, t in kept], keys, first, count, item[by], place[by], k + 1, size + 1 - Q * (k + 1), sieve, short)


def _extend(pattern: np.ndarray, text: np.ndarray, row: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Rows reached from (row, row + diagonal) over equal characters; both sides end in marks that differ."""
    row, size = row.copy(), 16
    active = np.arange(len(row))
    while len(active):
        step = np.arange(size)
        going = []
        for lo in range(0, len(active), max(1, (DIAGONALS << 4) // size)):
            part = active[lo : lo + max(1, (DIAGONALS << 4) // size)]
            at = row[part]
            same = pattern[at[:, None] + step] == text[(at + diagonal[part])[:, None] + step]
            run = np.where(same.all(axis=1), size, same.argmin(axis=1))
            row[part] += run
            going.append(part[run == size])
        active, size = np.concatenate(going), min(2 * size, 1 << 10)
    return row


def ends(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, begin and end of the pattern for each end in the text that at most so many edits reach.

    For each number of edits and each diagonal the furthest row is kept, with the place where the path began.
    """
    m, n = len(pattern), len(text)
    pad = 1 << 10
    p = np.concatenate((pattern.astype(np.int64), np.full(pad, -1)))
    t = np.concatenate((text.astype(np.int64), np.full(pad, -2)))
    diagonal = np.arange(-most, n - m + most + 1)
    never = -(1 << 40)
    row = np.where(diagonal >= 0, 0, never)
    begin = np.maximum(diagonal, 0)
    cost = np.full(len(diagonal), -1)
    source = begin.copy()
    for e in range(most + 1):
        if e:
            # a character replaced, one that the pattern lacks, one that the text lacks
            ways = np.full((3, len(row)), never)
            ways[0] = row + 1
            ways[1, 1:] = row[:-1]
            ways[2, :-1] = row[1:] + 1
            from_ = np.stack((begin, np.concatenate((begin[:1], begin[:-1])), np.concatenate((begin[1:], begin[-1:]))))
            valid = (ways <= m) & (ways + diagonal <= n) & (ways + diagonal >= 0) & (ways >= 0)
            ways = np.where(valid, ways, never)
            best = ways.argmax(axis=0)
            new, began = np.take_along_axis(ways, best[None], 0)[0], np.take_along_axis(from_, best[None], 0)[0]
            row, begin = np.where(new > row, new, row), np.where(new > row, began, begin)
        live = np.flatnonzero((row >= 0) & (row < m))
        row[live] = _extend(p, t, row[live], diagonal[live])
        done = (row >= m) & (cost < 0)
        cost[done], source[done] = e, begin[done]
    at = np.flatnonzero(cost >= 0)
    return cost[at], source[at], m + diagonal[at]


def align(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Fewest edits (at most ``most``) of the pattern within the text, and where; the text's ends are free."""
    cost, begin, end = ends(pattern, text, most)
    if not len(cost):
        return None
    i = int(cost.argmin())
    return int(cost[i]), int(begin[i]), int(end[i])


def verbatim(pattern: np.ndarray, text: np.ndarray) -> list[int]:
    """Every place where the text holds the pattern as it is."""
    line, want, out = text.tobytes(), pattern.tobytes(), []
    at = line.find(want)
    while at >= 0:
        if at % 4 == 0:
            out.append(at // 4)
        at = line.find(want, at + 1)
    return out


def occurrences(pattern: np.ndarray, text: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(edits, begin, end) of all occurrences; those with edits only where no chosen verbatim one lies."""
    m, exact = len(pattern), verbatim(pattern, text)
    out = [(0, at, at + m) for at in exact]
    if most:
        gaps, free = [], 0
        for at in exact:
            if at >= free:
                gaps.append((free, at))
                free = at + m
        for a, z in [*gaps, (free, len(text))]:
            if z - a >= m - most:
                out += [(c, a + b, a + e) for c, b, e in zip(*(x.tolist() for x in ends(pattern, text[a:z], most)), strict=True)]
    return out


def regions(b: Benchmark, chars: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, lowest diagonal, diagonal behind the highest) of bands that share enough q-grams."""
    g = grams(chars)
    at = np.flatnonzero(b.sieve[(g >> np.uint64(64 - SIEVE)).astype(np.int64)])
    slot = np.minimum(np.searchsorted(b.keys, g[at]), len(b.keys) - 1)
    real = b.keys[slot] == g[at]
    at, slot = at[real], slot[real]
    each = b.count[slot]
    if not len(each):
        return []
    entry = np.repeat(b.first[slot] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
    item = b.item[entry]
    # diagonals are counted from that of the text's start and the longest passage's end, so none is negative
    below = max(len(t) for t in b.texts)
    band = (np.repeat(at, each) - b.place[entry] + below) // b.width[item]
    n_bands = len(chars) + below + 2
    key = item.astype(np.int64) * n_bands + band + 1
    found, shared = np.unique(np.concatenate((key, key - 1)), return_counts=True)
    who, band = found // n_bands, found % n_bands - 1
    enough = shared >= np.maximum(b.need[who], 1)
    out: list[tuple[int, int, int]] = []
    for i, x in zip(who[enough].tolist(), band[enough].tolist(), strict=True):
        w = int(b.width[i])
        lo, hi = x * w - below, (x + 2) * w - below
        if out and out[-1][0] == i and lo <= out[-1][2]:
            out[-1] = (i, out[-1][1], hi)
        else:
            out.append((i, lo, hi))
    return out


def short_hits(b: Benchmark, chars: np.ndarray) -> list[tuple[int, int]]:
    """(item, place) of passages below q characters."""
    out = []
    for n, (keys, items) in b.short.items():
        g = short_grams(chars, n)
        at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g)
        lows, highs = (np.searchsorted(keys, g[at], side=side) for side in ("left", "right"))
        for p, lo, hi in zip(at.tolist(), lows.tolist(), highs.tolist(), strict=True):
            out += [(i, p) for i in items[lo:hi].tolist() if np.array_equal(b.texts[i], chars[p : p + n])]
    return out


def search(b: Benchmark, text: str | None) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, distance) of passages in a text; places count normalised characters."""
    text = normalise(text)
    chars = codes(text)
    reach = 2 * max(len(t) for t in b.texts) + 2
    step = max(STRETCH, reach)
    hits: list[tuple[int, int, int, int]] = []
    for base in range(0, max(1, len(chars)), step):
        part = chars[base : base + step + reach]
        hits += [(0, base + p, base + p + len(b.texts[i]), i) for i, p in short_hits(b, part[: step + Q])]
        for i, lo, hi in regions(b, part):
            a, z = max(0, lo), min(len(part), hi + len(b.texts[i]))
            hits += [(c, base + a + s, base + a + e, i) for c, s, e in occurrences(b.texts[i], part[a:z], int(b.width[i]) - 1)]
    taken: dict[int, list[tuple[int, int, int]]] = {}
    for d, s, e, i in sorted(set(hits)):  # of a passage's overlapping places the one with fewest edits
        own = taken.setdefault(i, [])
        k = bisect.bisect(own, (s, e, d))
        if (k == 0 or own[k - 1][1] <= s) and (k == len(own) or e <= own[k][0]):
            own.insert(k, (s, e, d))
    return sorted((b.ids[i], *hit) for i, own in taken.items() for hit in own)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size, each brought to the driver when its turn comes."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    for k in range(n):
        if block := build([tuple(r) for r in items.filter(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == k).orderBy("id", "text").collect()]):
            yield block


def _searcher(block: Broadcast[Benchmark]):
    @F.arrow_udf(HIT)
    def hits(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32())]))
        rows = ([{"item_id": i, "start": s, "end": e, "distance": d} for i, s, e, d in search(block.value, t.as_py())] for t in text)
        return pa.array(rows, kind)

    return hits


def with_hits(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", hits_col: str = "hits", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add the array of (item_id, start, end, distance) of the benchmark passages in each text."""
    out = docs.withColumn(hits_col, F.array().cast(HIT))
    for n, block in enumerate(_blocks(benchmark, item_id, item_text)):
        out = materialize(out, "hits") if n else out  # one block in memory at a time
        out = out.withColumn(hits_col, F.concat(hits_col, _searcher(docs.sparkSession.sparkContext.broadcast(block))(F.col(text_col).cast("string"))))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage found: doc_id, item_id, place in the normalised text, edits."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, last = None, None
    for block in _blocks(benchmark, "item_id", "text"):
        if last is not None:
            last = materialize(last, "leaks")
            out = last if out is None else out.unionByName(last)
        hits = _searcher(docs.sparkSession.sparkContext.broadcast(block))(F.col("text"))
        last = rows.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.item_id", "h.start", "h.end", "h.distance")
    if last is None:
        return rows.select("doc_id", F.explode(F.array().cast(HIT)).alias("h")).select("doc_id", "h.item_id", "h.start", "h.end", "h.distance")
    return last if out is None else out.unionByName(last)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without any passage of the benchmark."""
    out = docs
    for n, block in enumerate(_blocks(benchmark, "item_id", "text")):
        out = materialize(out, "clean") if n else out
        out = out.filter(F.size(_searcher(docs.sparkSession.sparkContext.broadcast(block))(F.col(text_col).cast("string"))) == 0)
    return out
