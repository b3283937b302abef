"""Super-k-mers: runs of consecutive windows that share a minimiser, packed and dealt to buckets.

A window of N units (bytes or words) belongs to its leftmost piece of M units with the smallest
hash. Equal windows have equal pieces, so they meet in one bucket; consecutive windows mostly
share that piece, so they travel as one packed string. Nothing here decides equality: hashes only
choose the bucket and tell minimisers apart, and the buckets compare the strings themselves.

The plan has two exchanges of packed rows. ``deal`` cuts documents and sends each batch's strings
to buckets, each string once with the runs that have it; a bucket's judge returns
the runs of windows that are to go; ``apply_marks`` sends those back to the documents.
Hot strings are merged before they travel, so a bucket gets at most one copy from each batch. The
number of buckets follows the bytes of the texts, so a bucket stays about as large at any size.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.hashing import hash_longs, mix
from tallyspark.session import shuffle_partitions

#: zstd level of packed strings and texts: shuffled bytes are the budget here, not seconds.
LEVEL = 6
#: Bytes of text that a task cuts before it sends strings off.
BATCH_BYTES = 16 << 20
#: Units cut at once, so that the working arrays stay in cache.
CHUNK = 1 << 18
#: Bytes of text for each shuffle partition and for each bucket, and buckets for each partition at least; memory is bounded by a bucket.
PART_BYTES, BUCKET_BYTES, SPREAD = 64 << 20, 8 << 20, 2
#: Order of a document without id: after all others.
NO_ID = 2**63 - 1
_PLACE = np.uint64((1 << 24) - 1)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(h[i : i + width]), for each i where that fits."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


@dataclass
class Runs:
    """Per run: document (index in the batch), first window, windows, units before its piece, 40 bits of the piece's hash."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    piece: np.ndarray
    hash: np.ndarray


def cut(pieces: Callable[[int, int], np.ndarray], sizes: np.ndarray, window: int, piece: int) -> Runs:
    """Super-k-mers of documents of so many units that lie one after the other.

    pieces(lo, hi): hash of the piece that starts at each unit from lo to hi.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    valid = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
    whole = sizes >= window
    np.add.at(valid, begins[whole], 1)
    np.add.at(valid, ends[whole] - window + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(valid), CHUNK):
        hi = min(lo + CHUNK, len(valid))
        at = np.flatnonzero(valid[lo:hi])
        if not len(at):
            continue
        h = pieces(lo, min(hi + window - piece, len(valid)))
        # the smallest hash, and of equal ones the leftmost: the place takes the low bits
        h = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(h, window - piece + 1)[at]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (least[1:] != least[:-1]))))
        least = least[first]
        out.append((at[first] + lo, np.diff(np.concatenate((first, [len(at)]))), (least & _PLACE).astype(np.int64) - at[first], least >> np.uint64(24)))
    start, windows, place, hashes = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    doc = np.searchsorted(ends, start, side="right")
    return Runs(doc, start - begins[doc] if len(doc) else start, windows, place, hashes)


def _planes(a: np.ndarray, width: int) -> bytes:
    """The bytes of integers one place at a time, which compresses better."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<i8")


def _ids(ids: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return _planes(np.diff(np.concatenate((np.zeros(1, np.int64), ids))), 8)


#: extra: bytes of a string beyond one for each window; again: whether the string is that of the run before, and not sent once more.
FIELDS = (("tag", 3), ("start", 4), ("windows", 4), ("piece", 4), ("extra", 4), ("again", 1))
#: Bytes of a row key, which tells rows of one doc_id apart.
KEY = 7


def pack(order: np.ndarray, key: np.ndarray, fields: dict[str, np.ndarray], strings: bytes = b"") -> bytes:
    """Runs of one batch, sorted by document: order and row key of each document once, the fields of each run, the strings."""
    change = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (order[1:] != order[:-1])))) if len(key) else np.empty(0, np.int64)
    head = struct.pack("<qq", len(change), len(key))
    each = np.diff(np.concatenate((change, [len(key)])))
    body = [_ids(order[change]), _planes(key[change], KEY), _planes(each, 4), *[_planes(fields[f], w) if f in fields else _planes(np.zeros(len(key)), w) for f, w in FIELDS], strings]
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(body))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], bytes]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n, m = struct.unpack("<qq", data[:16])
    at = 16

    def take(k: int) -> memoryview:
        nonlocal at
        at += k
        return data[at - k : at]

    with np.errstate(over="ignore"):
        order = np.cumsum(_unplanes(take(8 * n), n, 8))
    key = _unplanes(take(KEY * n), n, KEY)
    each = _unplanes(take(4 * n), n, 4)
    fields = {f: _unplanes(take(w * m), m, w) for f, w in FIELDS}
    return np.repeat(order, each), np.repeat(key, each), fields, bytes(data[at:])


@dataclass
class Batch:
    """Documents of a batch in order of id: their order, row key and units, and how to cut and slice them."""

    order: np.ndarray
    key: np.ndarray
    base: np.ndarray  # unit at which each entry starts in its document: long documents come in parts
    runs: Runs
    text: bytes
    bounds: Callable[[Runs], tuple[np.ndarray, np.ndarray]]  # bytes of each run's string


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, its order, a row key that tells repeated ids apart, and the text."""
    doc_id = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("order"), F.xxhash64(text).bitwiseAND(F.lit((1 << 8 * KEY) - 1)).alias("key"), text.alias("text"))


def deal(rows: DataFrame, prepare: Callable[[bytes], list[tuple[int, bytes]]], load: Callable[[list[bytes]], tuple], buckets: int, repeats: bool) -> DataFrame:
    """Send the super-k-mers of (order, key, text) rows to their buckets: rows (bucket, kind, blob).

    prepare: a text's parts as (first unit, text); load: the parts' runs, joined text and bounds.
    repeats: whether a second copy anywhere makes both go; else a copy goes if a smaller order has it.
    Kind 0 holds strings, kind 1 windows that the batch could judge on its own.
    """

    def send(parts: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        parts.sort(key=lambda p: (p[0], p[1], p[2]))
        order, key, base = (np.array([p[i] for p in parts], np.int64) for i in range(3))
        runs, text, bounds = load([p[3] for p in parts])
        if not len(runs.doc):
            return
        spread = mix(runs.hash.copy())
        bucket = ((spread >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        tag = (spread & _PLACE).astype(np.int64)
        start = runs.start + base[runs.doc]
        lo, hi = bounds(runs)
        own: list[int] = []
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
        for group in np.split(by_bucket, cuts):
            alike: dict[bytes, list[int]] = {}
            for i, a, b in zip(group.tolist(), lo[group].tolist(), hi[group].tolist(), strict=True):
                alike.setdefault(text[a:b], []).append(i)
            if repeats:  # both copies go, whatever else there is
                own += [i for same in alike.values() if len(same) > 1 for i in same]
                alike = {s: same[:1] for s, same in alike.items()}
            # a string goes with the first of its runs; the others follow it and name it
            g = np.array([i for same in alike.values() for i in same])
            again = np.array([k > 0 for same in alike.values() for k in range(len(same))])
            fields = {"tag": tag[g], "start": start[g], "windows": runs.windows[g], "piece": runs.piece[g], "extra": hi[g] - lo[g] - runs.windows[g], "again": again}
            yield int(bucket[group[0]]), 0, pack(order[runs.doc[g]], key[runs.doc[g]], fields, b"".join(alike))
        if own:
            g = np.unique(np.array(own))
            yield int(bucket[0]), 1, pack(order[runs.doc[g]], key[runs.doc[g]], {"start": start[g], "windows": runs.windows[g]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, int, int, bytes]] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for b, k, blob in send(parts):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "kind", "blob"])

        for batch in batches:
            order, key, text = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                for at, part in prepare(text[i].as_py()):
                    parts.append((order[i], key[i], at, part))
                    held += len(part)
                    if held >= BATCH_BYTES:
                        yield from out()
                        parts, held = [], 0
        if parts:
            yield from out()

    return rows.select("order", "key", "text").mapInArrow(run, "bucket int, kind int, blob binary")


@dataclass
class Bucket:
    """All strings of a bucket, sorted by order."""

    order: np.ndarray
    key: np.ndarray
    tag: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    piece: np.ndarray
    strings: list[bytes]


#: A judge returns the run, first window and number of windows of what is to go.
Judge = Callable[[Bucket], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _load(blobs: list[bytes]) -> Bucket:
    """The runs whose minimiser another run of the bucket shares; the others cannot hold a repeat. Equal strings of a batch are one object."""
    loaded = [unpack(b) for b in blobs]
    order, key = (np.concatenate([x[i] for x in loaded]) for i in range(2))
    f = {k: np.concatenate([x[2][k] for x in loaded]) for k, _ in FIELDS}
    _, inverse, count = np.unique(f["tag"], return_inverse=True, return_counts=True)
    held = count[inverse] > 1
    strings: list[bytes] = []
    at = 0
    for _, _, g, text in loaded:
        own = g["again"] == 0
        size = np.where(own, g["windows"] + g["extra"], 0)
        n, ends = len(size), np.cumsum(size)
        at_string = np.maximum.accumulate(np.where(own, np.arange(n), 0))  # the run whose string it is
        keep = np.flatnonzero(held[at : at + n])
        last = None
        for k, a, b in zip(at_string[keep].tolist(), (ends - size)[at_string[keep]].tolist(), ends[at_string[keep]].tolist(), strict=True):
            if k != last:
                last, string = k, text[a:b]
            strings.append(string)
        at += n
    k = np.flatnonzero(held)
    k = k[(by := np.argsort(order[k], kind="stable"))]
    return Bucket(order[k], key[k], f["tag"][k], f["start"][k], f["windows"][k], f["piece"][k], [strings[i] for i in by.tolist()])


def judge_buckets(dealt: DataFrame, judge: Judge, parts: int, targets: int) -> DataFrame:
    """Rows (target, blob) of the windows that are to go, for the documents whose key falls to the target."""
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[tuple[np.ndarray, ...]] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            order, key, start, windows = (np.concatenate(x) for x in zip(*marks, strict=True))
            target = np.mod(hash_longs(key, hash_longs(order)), targets)
            by = np.lexsort((start, key, order, target))
            for g in np.split(by, np.flatnonzero(np.diff(target[by])) + 1):
                blob = pack(order[g], key[g], {"start": start[g], "windows": windows[g]})
                yield pa.RecordBatch.from_arrays([pa.array([int(target[g[0]])], pa.int32()), pa.array([blob], pa.binary())], ["target", "blob"])

        def close(blobs: list[bytes]) -> None:
            nonlocal held
            b = _load(blobs)
            if len(b.order):
                run_, first, n = judge(b)
                if len(run_):
                    marks.append((b.order[run_], b.key[run_], b.start[run_] + first, n))
                    held += len(run_)

        now, blobs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, kind, blob = (batch.column(c)[i].as_py() for c in range(3))
                if kind == 1:
                    order, key, f, _ = unpack(blob)
                    marks.append((order, key, f["start"], f["windows"]))
                    held += len(key)
                    continue
                if bucket != now and blobs:
                    close(blobs)
                    blobs = []
                    if held > 1 << 21:
                        yield from out()
                        marks, held = [], 0
                now = bucket
                blobs.append(blob)
        if blobs:
            close(blobs)
        if marks:
            yield from out()

    return dealt.mapInArrow(run, "target int, blob binary")


def apply_marks(rows: DataFrame, marks: DataFrame, finish: Callable[[bytes, np.ndarray, np.ndarray], tuple], schema: str, names: list[str], parts: int, targets: int) -> DataFrame:
    """finish(text, first units, windows) for each document, with everything that was marked in it.

    Marks and texts of a target meet in one partition; the marks, a few bytes for each run, are
    held for one target at a time and the texts stream by.
    """

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            text = pa.array([z.compress(t.as_py()) for t in b.column(3).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], text], ["doc_id", "order", "key", "blob"])

    texts = rows.select("doc_id", "order", "key", "text").mapInArrow(squeeze, "doc_id long, order long, key long, blob binary")
    texts = texts.select(F.pmod(F.xxhash64("order", "key"), F.lit(targets)).cast("int").alias("target"), F.lit(1).alias("kind"), "doc_id", "order", "key", "blob")
    notes = marks.select("target", F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("doc_id", "order", "key")], "blob")
    both = notes.unionByName(texts).repartition(parts, "target").sortWithinPartitions("target", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        loaded: list[tuple[np.ndarray, ...]] = []
        place: tuple[np.ndarray, ...] | None = None
        z = zstandard.ZstdDecompressor()
        empty = np.empty(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                t, kind, doc_id, order, key, blob = (batch.column(c)[i].as_py() for c in range(6))
                if t != now:
                    now, loaded, place = t, [], None
                if kind == 0:
                    o, k, f, _ = unpack(blob)
                    loaded.append((o, k, f["start"], f["windows"]))
                    continue
                if place is None:
                    o, k, s, w = (np.concatenate(x) for x in zip(*loaded, strict=True)) if loaded else (empty,) * 4
                    by = np.lexsort((s, k, o))
                    place = (o[by], k[by], s[by], w[by])
                a, b = np.searchsorted(place[0], order, "left"), np.searchsorted(place[0], order, "right")
                a, b = a + np.searchsorted(place[1][a:b], key, "left"), a + np.searchsorted(place[1][a:b], key, "right")
                out.append((doc_id, *finish(z.decompress(blob) if blob else b"", place[2][a:b], place[3][a:b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)

    return both.mapInArrow(run, schema)


def plan(rows: DataFrame) -> tuple[int, int]:
    """Shuffle partitions, and buckets or targets: as many as the session has, or as the texts need."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(rows.sparkSession), -(-total // PART_BYTES))
    return parts, max(parts * SPREAD, -(-total // BUCKET_BYTES))
