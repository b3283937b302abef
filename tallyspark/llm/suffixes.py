"""Removal of byte strings that an earlier document holds, by two-stage suffix sorting.

Documents are cut into super-k-mers over bytes (``superkmers``), so every 50-byte string and all
its copies are in one bucket. A bucket sorts the suffixes of its strings in two stages: suffixes
smaller than their successors are sorted directly, eight bytes at a time; all others are induced
by scanning the buckets of first bytes from low to high, each scan placing the predecessors of
what it meets. Adjacent common prefixes of 50 bytes or more then form the groups of equal
strings, and every member whose document is not the group's smallest is to go.

A string that several documents have enters the sort once, with all of them: the sort tells for
each of its windows the smallest document that has it anywhere, and each of the string's documents
that is not the smallest loses the window. Before the sort a bucket drops only what cannot hold a repeat: a string
whose minimiser no other shares, and one that one document has and that
shares neither the 31 bytes up to its minimiser's end nor the 31 from its start (equal 50-byte
strings share at least one of them).

Defined results: a null or empty text has no bytes and the digest of nothing; a null doc_id comes
after all others; rows that repeat a doc_id are no smaller than each other, so neither removes
the other's bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tallyspark.llm.hashing import mix
from tallyspark.llm.superkmers import Bucket, Runs, apply_marks, cut, deal, judge_buckets, plan, rows_of

WINDOW = 50
PIECE = 12
#: Bytes on either side of a minimiser of which equal windows share at least one side.
SIDE = (WINDOW - PIECE) // 2
#: Bytes of text whose suffixes are sorted together; strings of one minimiser are never parted.
SORT_BYTES = 1 << 20
#: Bytes of a long document that are cut together.
PART_BYTES = 8 << 20
#: Never part of UTF-8 text, and above all bytes that are.
END = 255


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; text has eight bytes to spare."""
    n = len(text) - 8
    return np.ndarray((n,), "<u8", buffer=np.ascontiguousarray(text).data, strides=(1,)).byteswap()


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last is not."""
    n = len(t)
    differs = np.concatenate((t[1:] != t[:-1], [True]))
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the end of each run of one byte decides for the run
    up = np.concatenate((t[1:] > t[:-1], [False]))
    return up[at]


def _direct(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their first ``depth`` bytes: radix passes of eight bytes over what is still tied."""
    at = at[np.argsort(words[at])]
    w = words[at]
    group = np.concatenate(([0], np.cumsum(w[1:] != w[:-1]))) if len(at) else at
    for d in [*range(8, depth - 7, 8), depth - 8]:
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(tied):
            break
        sub = at[tied]
        w = words[sub + d]
        rank = np.empty(len(w), np.int64)
        by = np.argsort(w)
        rank[by] = np.concatenate(([0], np.cumsum(w[by][1:] != w[by][:-1])))
        key = (group[tied] << 32) | rank
        by = np.argsort(key)
        at[tied], key = sub[by], key[by]
        # a tied stretch keeps its places; new borders inside it start new groups
        border = np.zeros(len(at), bool)
        border[0] = True
        border[1:] = ~same
        border[tied[1:][key[1:] != key[:-1]]] = True
        group = np.cumsum(border) - 1
    return at


def suffix_order(t: np.ndarray, words: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """All suffixes of t, in order of at least their first ``depth`` bytes."""
    n = len(t)
    small = smaller_than_next(t)
    direct = _direct(np.flatnonzero(small), words, depth)
    firsts = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))  # the whole text's end comes before everything
    out: list[np.ndarray] = []

    def induced(at: np.ndarray) -> np.ndarray:
        before = at[at > 0] - 1
        return before[~small[before]]

    for c in range(256):
        larger = waiting[c]
        k = 0
        while k < len(larger):  # runs of the byte itself: each wave is placed behind the one that induced it
            wave = induced(larger[k])
            wave = wave[t[wave] == c]
            if len(wave):
                larger.append(wave)
            k += 1
        bucket = np.concatenate([*larger, direct[firsts[c] : firsts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = induced(bucket)
        byte = t[before]
        before, byte = before[byte > c], byte[byte > c]
        by = np.argsort(byte, kind="stable")
        byte = byte[by]
        for g in np.split(by, np.flatnonzero(np.diff(byte)) + 1):
            if len(g):
                waiting[t[before[g[0]]]].append(before[g])
    return np.concatenate(out)


def least_owners(t: np.ndarray, starts: np.ndarray, windows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each byte of t from which a window of a string starts, the smallest order of a string that has an equal window; elsewhere the largest number."""
    words = _words(np.concatenate((t, np.zeros(WINDOW + 16, np.uint8))))
    edge = np.zeros(len(t) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + windows, -1)
    inside = np.cumsum(edge)[:-1] > 0
    at = suffix_order(t, words)
    at = at[inside[at]]
    # adjacent common prefixes, eight bytes at a time up to the window
    equal = np.arange(1, len(at))
    for d in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
        equal = equal[words[at[equal] + d] == words[at[equal - 1] + d]]
    same = np.zeros(len(at), bool)
    same[equal] = True
    owner = order[np.searchsorted(starts, at, side="right") - 1]
    heads = np.flatnonzero(~same)
    out = np.full(len(t), np.iinfo(np.int64).max)
    if len(at):
        out[at] = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.concatenate((heads, [len(at)]))))
    return out


def _shared(text: np.ndarray, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Whether the PIECE + SIDE bytes from each position occur at another position as well."""
    words = _words(np.concatenate((text, np.zeros(WINDOW + 16, np.uint8))))
    h = np.zeros(len(at), np.uint64)
    for d in (0, 8, 16, PIECE + SIDE - 8):
        h = mix(h * np.uint64(31) + words[np.where(ok, at, 0) + d])
    _, inverse, count = np.unique(h[ok], return_inverse=True, return_counts=True)
    out = np.zeros(len(at), bool)
    out[ok] = count[inverse] > 1
    return out


def judge(b: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a bucket whose bytes a document of smaller order holds."""
    number: dict[bytes, int] = {}
    string_of = np.fromiter((number.setdefault(s, len(number)) for s in b.strings), np.int64, len(b.strings))
    # runs by string, then by document: the first run of each string stands for it in the sort
    by = np.lexsort((b.order, string_of))
    first = np.flatnonzero(np.diff(string_of[by], prepend=-1))
    each = np.diff(np.concatenate((first, [len(by)])))
    head = by[first]
    i = np.argsort(b.tag[head], kind="stable")
    sizes = np.array([len(b.strings[k]) + 1 for k in head[i].tolist()], np.int64)
    if len(i):
        text = np.frombuffer(bytes([END]).join([*(b.strings[k] for k in head[i].tolist()), b""]), np.uint8)
        begin = np.cumsum(sizes) - sizes
        piece = b.piece[head[i]]
        left = _shared(text, begin + piece - SIDE, piece >= SIDE)
        right = _shared(text, begin + piece, piece + PIECE + SIDE < sizes)
        kept = left | right | (each[i] > 1)
        i, sizes = i[kept], sizes[kept]
    none = np.empty(0, np.int64)
    out = [(none, none, none)]
    lo = 0
    ends = np.cumsum(sizes)
    while lo < len(i):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SORT_BYTES)) + 1
        while hi < len(i) and b.tag[head[i[hi]]] == b.tag[head[i[hi - 1]]]:
            hi += 1
        part = i[lo:hi]
        t = np.frombuffer(bytes([END]).join([*(b.strings[k] for k in head[part].tolist()), b""]), np.uint8)
        starts = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        least = least_owners(t, starts, b.windows[head[part]], b.order[head[part]])
        # the string's smallest document loses what a smaller one has elsewhere
        owner = np.repeat(b.order[head[part]], sizes[lo:hi])
        edge = np.diff(np.concatenate(([0], (least < owner).astype(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run = np.searchsorted(starts, begin, side="right") - 1
        out.append((head[part[run]], begin - starts[run], end - begin))
        # a further document with the string has that smallest one before it in every window
        further = each[part] - 1
        string = np.repeat(np.arange(len(part)), further)
        other = by[np.repeat(first[part] + 1, further) + np.arange(len(string)) - np.repeat(np.cumsum(further) - further, further)]
        most = np.maximum.reduceat(np.where(least < np.iinfo(np.int64).max, least, -1), starts)
        whole = most[string] < b.order[other]
        out.append((other[whole], np.zeros(int(whole.sum()), np.int64), b.windows[other[whole]]))
        # a further run of the smallest document itself loses what its first run does
        other, string = other[~whole], string[~whole]
        marks = np.bincount(run, minlength=len(part))
        n = marks[string]
        at = np.repeat((np.cumsum(marks) - marks)[string], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out.append((np.repeat(other, n), begin[at] - starts[run[at]], (end - begin)[at]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def prepare(text: bytes) -> list[tuple[int, bytes]]:
    return [(at, text[at : at + PART_BYTES + WINDOW - 1]) for at in range(0, max(1, len(text) - WINDOW + 1), PART_BYTES)]


def load(parts: list[bytes]):
    text = b"".join(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    padded = np.frombuffer(text + bytes(32), np.uint8)

    def pieces(lo: int, hi: int) -> np.ndarray:
        at = lambda d: np.ndarray((hi - lo,), "<u8", buffer=padded.data, offset=lo + d, strides=(1,))
        return mix(at(0) * np.uint64(0x9E3779B97F4A7C15) + at(PIECE - 8))

    def bounds(r: Runs) -> tuple[np.ndarray, np.ndarray]:
        lo = begins[r.doc] + r.start
        return lo, lo + r.windows + WINDOW - 1

    return cut(pieces, sizes, WINDOW, PIECE), text, bounds


def finish(text: bytes, start: np.ndarray, windows: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and digest of what is left."""
    if not len(start):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    spans = merge(start, start + windows + WINDOW - 1)
    digest, at, removed = hashlib.sha256(), 0, 0
    for a, b in spans:
        digest.update(text[at:a])
        removed += b - a
        at = b
    digest.update(text[at:])
    return len(text), removed, len(spans), digest.hexdigest()


def merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans; touching spans are one run."""
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[first].tolist(), end[np.concatenate((first[1:] - 1, [len(end) - 1]))].tolist(), strict=True))


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = rows_of(docs, id_col, text_col)
    parts, targets = plan(rows)
    dealt = deal(rows, prepare, load, targets, repeats=False)
    marks = judge_buckets(dealt, judge, parts, targets)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return apply_marks(rows, marks, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", names, parts, targets)
