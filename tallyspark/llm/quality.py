"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams.

Tokens are runs of letters, digits and bytes above 127, and runs of other marks; single tokens and
pairs are hashed to ``BUCKETS`` places. Two multinomials are counted over all documents: the raw
corpus, and the trusted target (documents labelled good). A document's score is the mean over its
n-grams of log p(target) - log p(raw), so length does not matter. Counting combines within each
task; ``BUCKETS`` pairs of sums go to the driver whatever the size of the corpus.

The threshold is the cut that best separates labelled good from labelled bad documents (mean of
both hit rates, over a histogram of ``BINS`` scores; of equal cuts the middle one). Every document
at or above it is kept, unless a base rule failed it.

Defined results: a null text has no words and fails; without labelled bad or good documents no
score fails a document; several labels of a document count as the best of them; rows that repeat a
doc_id are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.hashing import mix, word_hashes
from tallyspark.session import materialize

BUCKETS = 1 << 14
SMOOTH = 1.0
#: Histogram of scores: bins per unit, and the range either side of zero.
BINS, REACH = 50, 10
#: Labels up to this number of documents are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Bytes of one text that are tokenised at once.
PART = 1 << 22
SYMBOLS = b"#*$%&|<>"

_KIND = np.ones(256, np.uint8)  # 1: marks
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def ngrams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of a text's tokens and pairs of tokens."""
    raw = np.frombuffer(text, np.uint8)
    end = np.zeros(0, np.uint64)
    lo = 0
    while lo < len(raw):
        hi = lo + PART
        while hi < len(raw) and _KIND[raw[hi]]:  # not within a token, however long
            gap = np.flatnonzero(_KIND[raw[hi : hi + PART]] == 0)
            hi += int(gap[0]) if len(gap) else PART
        kind = _KIND[raw[lo:hi]]
        change = np.flatnonzero(np.diff(kind)) + 1
        first = np.concatenate(([0], change))
        last = np.concatenate((change, [len(kind)]))
        real = kind[first] > 0
        h = word_hashes(raw[lo:hi], first[real], last[real])
        chain = np.concatenate((end, h))
        yield (h % np.uint64(BUCKETS)).astype(np.int64)
        yield (mix(chain[:-1] * np.uint64(3) + chain[1:]) % np.uint64(BUCKETS)).astype(np.int64)
        end = h[-1:] if len(h) else end
        lo = hi


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = sum(map(len, words)) - _continuations(text)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)


_INNER = bytes(range(0x80, 0xC0))


def _continuations(text: bytes) -> int:
    return len(text) - len(text.translate(None, _INNER))


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) < 1 << 21:
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        _, pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)
        key = pair[:-1] << 32 | ids[2:]
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n + 2, bool)
    again = by[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    hit[again] = hit[again + 1] = hit[again + 2] = True
    return int(hit.sum())


def _bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def log_ratios(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) for each bucket; good: the trusted doc_ids, each once."""
    small = good.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = docs.join((F.broadcast(good) if small else good).withColumn("good", F.lit(True)), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            text, trusted = b.column(0).cast(pa.binary()), b.column(1).to_pylist()
            for i in range(b.num_rows):
                for grams in ngrams(text[i].as_py()):
                    one = np.bincount(grams, minlength=BUCKETS)
                    counts[0] += one
                    if trusted[i]:
                        counts[1] += one
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    counts = np.zeros((2, BUCKETS))
    for bucket, raw, target in sums:
        counts[:, bucket] = raw, target
    p = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Base counts, number of n-grams and mean log ratio of each document."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).cast(pa.binary())
            out = []
            for i in range(b.num_rows):
                t = text[i].as_py()
                total, n = 0.0, 0
                for grams in ngrams(t):
                    total += float(ratios[grams].sum())
                    n += len(grams)
                out.append((*base_counts(t), total / n if n else 0.0))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*out, strict=True))], names)

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")


def best_cut(histogram: list[tuple[int, int, int]]) -> float:
    """The score from which documents are kept, from (bin, good, bad) counts."""
    bins = sorted(histogram)
    good, bad = sum(g for _, g, _ in bins), sum(x for _, _, x in bins)
    if not good or not bad:
        return float("-inf")
    at, rates, below_good, below_bad = [], [], 0, 0
    for b, g, x in bins:
        at.append(b)
        rates.append((good - below_good) / good + below_bad / bad)
        below_good, below_bad = below_good + g, below_bad + x
    most = max(rates)
    i = rates.index(most)
    low = at[i - 1] + 1 if i else at[i]
    return (low + at[i]) / 2 / BINS


def judge_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, base counts, base_failed, score, threshold and kept for each document."""
    rows = _bytes(docs, id_col, text_col)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).alias("label"))
    ratios = log_ratios(rows, known.filter("label = 1").select("doc_id"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = materialize(scored(rows, ratios).withColumn("base_failed", failed), "scores")
    bins = F.floor(F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), F.col("score"))) * BINS).cast("int")
    counts = judged.filter(~F.col("base_failed")).join(known, "doc_id").groupBy(bins.alias("bin")).agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    cut = best_cut([tuple(r) for r in counts.collect()])
    return judged.withColumn("threshold", F.lit(cut)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold")))
