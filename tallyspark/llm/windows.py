"""Removal of word windows that occur more than once, by super-k-mers over words.

Texts are brought to single spaces, so windows compare as words. Consecutive windows of 35 words
that share their minimiser (the leftmost run of ``PIECE`` words with the smallest hash) travel to
its bucket as one packed string; strings that a batch holds twice are settled there and travel
once. A bucket numbers its distinct words and sorts its windows by doubling ranks (1, 2, 4, .. 35
words), so windows are counted by their words and never by a hash; whatever is counted twice goes.

Defined results: a null or empty text has no words and keeps the empty string; a document shorter
than a window loses nothing; repeated rows are occurrences of their own; a null doc_id is kept as
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tallyspark.llm.hashing import mix, word_hashes
from tallyspark.llm.suffixes import merge
from tallyspark.llm.superkmers import Bucket, Runs, apply_marks, cut, deal, judge_buckets, plan, rows_of

WINDOW = 35
PIECE = 6
#: Words of a long document that are cut together, and of a bucket that are sorted together.
PART_WORDS = 1 << 20
SORT_WORDS = 1 << 18


def prepare(text: bytes) -> list[tuple[int, bytes]]:
    words = text.split()
    if len(words) <= PART_WORDS:
        return [(0, b" ".join(words))]
    return [(at, b" ".join(words[at : at + PART_WORDS + WINDOW - 1])) for at in range(0, len(words) - WINDOW + 1, PART_WORDS)]


def load(parts: list[bytes]):
    text = b"\n".join(parts) + b"\n"
    raw = np.frombuffer(text, np.uint8)
    gap = (raw == 32) | (raw == 10)
    last = np.flatnonzero(gap)
    first = np.concatenate(([0], last[:-1] + 1))
    # a part without words is an empty line: its lone gap is no word
    real = last > first
    sizes = np.diff(np.concatenate(([0], np.cumsum(real)[raw[last] == 10])))
    first, last = first[real], last[real]
    h = word_hashes(raw, first, last) if len(first) else np.empty(0, np.uint64)
    begins = np.cumsum(sizes) - sizes

    def pieces(lo: int, hi: int) -> np.ndarray:
        out = np.zeros(hi - lo, np.uint64)
        for d in range(PIECE):
            part = h[lo + d : hi + d]
            out[: len(part)] += part * np.uint64(2 * d + 3)
        return mix(out)

    def bounds(r: Runs) -> tuple[np.ndarray, np.ndarray]:
        at = begins[r.doc] + r.start
        return first[at], last[at + r.windows + WINDOW - 2]

    return cut(pieces, sizes, WINDOW, PIECE), text, bounds


def counted_twice(ids: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Whether the window of words from each place (where ``inside``) has an equal one at another place."""
    rank, have = ids, 1

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        by = np.argsort(key)
        k = key[by]
        out = np.empty(len(k), np.int64)
        out[by] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        return out

    while have < WINDOW:
        step = min(have, WINDOW - have)
        rank = joined(rank[: len(rank) - step], rank[step:])
        have += step
    at = np.flatnonzero(inside[: len(rank)])
    _, inverse, count = np.unique(rank[at], return_inverse=True, return_counts=True)
    out = np.zeros(len(ids), bool)
    out[at[count[inverse] > 1]] = True
    return out


def judge(b: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a bucket that occur more than once in it."""
    seen: dict[bytes, int] = {}
    twice: set[int] = set()
    for i, s in enumerate(b.strings):
        if (j := seen.setdefault(s, i)) != i:
            twice |= {i, j}
    whole = np.array(sorted(twice), np.int64)
    out = [(whole, np.zeros(len(whole), np.int64), b.windows[whole])]
    i = np.array(list(seen.values()), np.int64)
    tags, count = np.unique(b.tag[i], return_counts=True)
    i = i[np.isin(b.tag[i], tags[count > 1])]
    i = i[np.argsort(b.tag[i], kind="stable")]
    sizes = b.windows[i] + WINDOW  # its words and one mark behind them
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(i):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SORT_WORDS)) + 1
        while hi < len(i) and b.tag[i[hi]] == b.tag[i[hi - 1]]:
            hi += 1
        part, size = i[lo:hi], sizes[lo:hi]
        number: dict[bytes, int] = {}
        words = b" \n ".join([*(b.strings[k] for k in part.tolist()), b""]).split(b" ")[:-1]
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        starts = np.cumsum(size) - size
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + b.windows[part], -1)
        gone = counted_twice(ids, np.cumsum(edge)[:-1] > 0).astype(np.int8)
        edge = np.diff(np.concatenate(([0], gone, [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run = np.searchsorted(starts, first, side="right") - 1
        out.append((part[run], first - starts[run], last - first))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def finish(text: bytes, start: np.ndarray, windows: np.ndarray) -> tuple[int, int, str]:
    """n_words, n_removed and digest of the kept words joined by one space."""
    words = text.split()
    if not len(start):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    kept, at, removed = [], 0, 0
    for a, b in merge(start, start + windows + WINDOW - 1):
        kept += words[at:a]
        removed += b - a
        at = b
    kept += words[at:]
    return len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    rows = rows_of(docs, id_col, text_col)
    parts, targets = plan(rows)
    dealt = deal(rows, prepare, load, targets, repeats=True)
    marks = judge_buckets(dealt, judge, parts, targets)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return apply_marks(rows, marks, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", names, parts, targets)
