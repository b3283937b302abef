"""Hierarchical Pitman-Yor language model over words, scored on whole documents.

Each word that precedes others is a restaurant of its own, whose dishes are the words that follow it;
all of them share one parent, the restaurant of single words, whose base is uniform over the
training vocabulary and one unknown word. A table of a context's restaurant is a customer of the
parent. Seatings are sampled by Gibbs (``seating``), level by level: an epoch seats the contexts with
the parent's probabilities of the epoch before, and then the parent with the tables that the contexts
have. The samples of the last epoch each give predictive probabilities, and their mean is the model.
A word after a context u has

    p(w | u) = (c_uw - d t_uw + (s + d t_u) p(w)) / (s + c_u),    p(w) = (c_w - d' t_w + (s' + d' t) / (V + 1)) / (s' + c)

The discounts d, d' are those of the counts of ones and twos; a pair seen once sits at one table
whatever is sampled, so only pairs seen twice and more are kept and seated.

Plan: texts become batches of word numbers, written once. Each batch sends its distinct pairs with
their training counts to the bucket of the context, where they are counted over all batches; what
grows with the corpus stays in buckets and tables. A context that alone would outgrow a bucket is
dealt to several by its next word. Buckets keep, for each batch, which of their pairs and words it
asked for, and after sampling send it their counts and tables; the batch has everything it needs to
score its documents. Words are told apart by 64 bits of hash.

Tokens are words, A-Z lower-cased, and one end for each text; a text's first token follows a start.
Defined results: a null text is empty and has its end; a document without id is held out; without
training documents every token has probability 1; rows that repeat a doc_id are scored each on its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.hashing import word_hashes
from tallyspark.llm.seating import seatings
from tallyspark.session import materialize, release, scratch_path, scratch_scope, shuffle_partitions

#: Bytes of text of a batch, and for each bucket; a longer text comes in stretches.
BATCH_BYTES, BUCKET_BYTES = 15 << 19, 16 << 20
#: Dishes of the shared restaurant that a task seats at once.
DISHES = 1 << 18
EPOCHS, BURN, SAMPLES, STRENGTH = 2, 1, 2, 1.0  # burn: sweeps of the contexts that are not kept, in the last epoch
SMOOTH = 0.1
SEED = 11
START, END = 1, 2  # hashes that stand for the start and the end of a text
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def pack(*arrays: np.ndarray) -> bytes:
    """Integers by byte planes of the least width that holds them, compressed."""
    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a).astype("<i8", copy=False)
        top = int(a.max()) if len(a) else 0
        width = 8 if len(a) and int(a.min()) < 0 else max(1, -(-top.bit_length() // 8))
        out += [struct.pack("<qi", len(a), width), np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    (n,), at, out = struct.unpack_from("<i", data), 4, []
    for _ in range(n):
        size, width = struct.unpack_from("<qi", data, at)
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, size * width, at + 12).reshape(width, size).T
        out.append(wide.reshape(-1).view("<i8"))
        at += 12 + size * width
    return out


def _gaps(hashes: np.ndarray) -> np.ndarray:
    """Hashes in order as differences; ``_sum`` undoes it."""
    return np.diff(hashes.view(np.int64), prepend=np.int64(0))


def _sum(gaps: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(gaps).view(np.uint64)


def home(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a word's hash, as ``home_column`` has it."""
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def home_column(word: str, buckets: int) -> Column:
    return (F.shiftrightunsigned(word, 20) % buckets).cast("int")


# --- batches of documents ---------------------------------------------------------------------


def stretches(text: bytes, most: int) -> Iterator[bytes]:
    """The text in pieces of about that size, cut in white space only."""
    lo = 0
    while len(text) - lo > most:
        hi = lo + most
        while hi < len(text) and not _SPACE[text[hi]]:
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a lower-cased text."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    first, last = edge[::2], edge[1::2]
    return word_hashes(np.frombuffer(text, np.uint8), first, last), first


def write_batches(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, held, text) as batches: parts (row, doc_id, held, size, ends), word hashes in order, and the parts' words by number.

    Each part begins with the word before it, so pairs of neighbours are its contexts and words.
    """
    schema = "batch long, row array<long>, doc_id array<long>, held array<boolean>, size array<long>, words binary, stream binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, number = TaskContext.get().partitionId() << 32, 0, 0
        parts: list[tuple[int, int | None, bool, bytes, bool, bool]] = []
        held = 0
        before = np.uint64(START)

        def out() -> pa.RecordBatch:
            nonlocal before
            texts = [p[3] for p in parts]
            joined = b"\n".join(texts).translate(_LOWER)
            h, first = _words(joined)
            starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
            cuts = np.append(np.searchsorted(first, starts), len(h))
            pieces, sizes = [], []
            for i, p in enumerate(parts):
                mine = h[cuts[i] : cuts[i + 1]]
                begin = np.uint64(START) if p[4] else before
                pieces += [[begin], mine] + ([[np.uint64(END)]] if p[5] else [])
                sizes.append(1 + len(mine) + p[5])
                before = mine[-1] if len(mine) else begin
            words, stream = np.unique(np.concatenate([np.asarray(x, np.uint64) for x in pieces]), return_inverse=True)
            columns = [[task | number], [[p[0] for p in parts]], [[p[1] for p in parts]], [[p[2] for p in parts]], [sizes], [pack(_gaps(words))], [pack(stream)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

        for b in batches:
            ids, kept_out, text = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())
            for i in range(b.num_rows):
                pieces = list(stretches(text[i].as_py(), BATCH_BYTES))
                for j, piece in enumerate(pieces):
                    parts.append((task | n, ids[i], kept_out[i], piece, j == 0, j == len(pieces) - 1))
                    held += len(piece) + 1
                    if held >= BATCH_BYTES:
                        yield out()
                        parts, held, number = [], 0, number + 1
                n += 1
        if parts:
            yield out()

    return materialize(rows.select("doc_id", "held", "text").mapInArrow(run, schema), "lm_batches")


@dataclass
class Pairs:
    """Distinct pairs (context u, word w) of a batch by number, their training counts, and of each token the pair and part."""

    u: np.ndarray
    w: np.ndarray
    trained: np.ndarray
    pair: np.ndarray
    part: np.ndarray


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, each key's place among them, the keys' order and where each distinct one begins in it; as np.unique, in half the memory."""
    by = np.argsort(keys)
    ordered = keys[by]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    distinct = ordered[first]
    del ordered
    place = np.empty(len(by), np.int32)
    place[by] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(by)))
    return distinct, place, by, first


def pairs_of(stream: bytes, size: np.ndarray, held: np.ndarray) -> Pairs:
    s = unpack(stream)[0]
    part = np.repeat(np.arange(len(size), dtype=np.int32), size)
    inside = part[1:] == part[:-1]
    keys = (s[:-1] << 32 | s[1:])[inside]
    part = part[1:][inside]
    del s, inside
    key, pair, *_ = numbered(keys)
    del keys, _
    trained = np.bincount(pair, ~held[part], len(key)).astype(np.int64)
    return Pairs(key >> 32, key & 0xFFFFFFFF, trained, pair, part)


def places(words: np.ndarray, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bucket, and into how many slices it is cut as a context (hot: hashes, slices)."""
    slices = np.ones(len(words), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], words), len(hot[0]) - 1)
        slices = np.where(hot[0][at] == words, hot[1][at], 1)
    return home(words, buckets), slices


def dealt_to(p: Pairs, of: np.ndarray, slices: np.ndarray, buckets: int) -> np.ndarray:
    """Each pair's bucket: that of its context, which is one of several by the word if the context is cut."""
    return (of[p.u] + of[p.w] % slices[p.u]) % buckets


def _read(b: pa.RecordBatch, i: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    return b["stream"][i].as_py(), np.array(b["size"][i].as_py(), np.int64), np.array(b["held"][i].as_py(), bool)


def hot_contexts(batches: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that have more than a bucket's share of all tokens, and into how many slices each is cut.

    A batch reports words with at least a quarter of that share, 4 * buckets at most; at most ``buckets`` words return.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                h, s = _sum(unpack(b["words"][i].as_py())[0]), unpack(b["stream"][i].as_py())[0]
                n = np.bincount(s, minlength=len(h))
                k = np.flatnonzero(n * 4 * buckets >= len(s))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(h[k].view(np.int64), 0)), pa.array(np.append(n[k], len(s)))], ["word", "n"])

    counts = batches.select("words", "stream").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.filter("word = 0").agg(F.sum("n")).first()[0] or 0  # no hash is 0: it stands for all tokens
    large = [(r[0], -(-r[1] * buckets // total)) for r in counts.filter(F.col("word") != 0).filter(F.col("n") * buckets > total).collect()]
    hashes, slices = np.array([x[0] for x in large], np.int64).view(np.uint64), np.array([x[1] for x in large], np.int64)
    by = np.argsort(hashes)
    return hashes[by], slices[by]


# --- counting in buckets ----------------------------------------------------------------------


def requests(batches: DataFrame, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row (bucket, batch, blob) for each bucket that a batch has words or pairs for."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                p, h = pairs_of(*_read(b, i)), _sum(unpack(b["words"][i].as_py())[0])
                of, slices = places(h, buckets, hot)
                to = dealt_to(p, of, slices, buckets)
                by_word, by_pair = np.argsort(of, kind="stable"), np.argsort(to, kind="stable")
                words_at, pairs_at = (np.searchsorted(x, np.arange(buckets + 1)) for x in (of[by_word], to[by_pair]))
                full = np.flatnonzero(np.diff(words_at) + np.diff(pairs_at))
                blobs = []
                for k in full.tolist():
                    own, mine = by_word[words_at[k] : words_at[k + 1]], by_pair[pairs_at[k] : pairs_at[k + 1]]
                    contexts, n = np.unique(p.u[mine], return_counts=True)
                    following, place = np.unique(p.w[mine], return_inverse=True)
                    blobs.append(pack(_gaps(h[own]), _gaps(h[contexts]), n, _gaps(h[following]), place, p.trained[mine]))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.repeat(b["batch"][i].as_py(), len(full))), pa.array(blobs, pa.binary())], ["bucket", "batch", "blob"])

    return batches.select("batch", "held", "size", "words", "stream").mapInArrow(run, "bucket int, batch long, blob binary")


def by_bucket(rows: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each bucket, from rows in order of bucket."""
    now, held = None, []
    for b in rows:
        k = b[key].to_numpy()
        cuts = np.flatnonzero(np.diff(k)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
            if hi > lo:
                if held and k[lo] != now:
                    yield now, held
                    held = []
                now = int(k[lo])
                held.append(b.slice(lo, hi - lo))
    if held:
        yield now, held


def count_pairs(asked: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, batch, state, words, asked), with pairs counted over all batches.

    One row of each bucket has its state and the counts of its pairs by word; the others have what each batch asked of it.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in by_bucket(rows):
            batch, own, contexts, following, each, place, trained = [], [], [], [], [], [], []
            for b in held:
                batch += b["batch"].to_pylist()
                for x in b["blob"]:
                    words_, u_, n_, w_, place_, trained_ = unpack(x.as_py())
                    own.append(_sum(words_))
                    contexts.append(_sum(u_))
                    following.append(_sum(w_))
                    each.append(n_.astype(np.int32))
                    place.append(place_.astype(np.int32))
                    trained.append(trained_.astype(np.int32))
            known, after = np.unique(np.concatenate(own + contexts)), np.unique(np.concatenate(following))
            ends = np.cumsum([len(x) for x in trained])
            asked_pairs = np.empty(int(ends[-1]), np.int64)
            for i, to in enumerate(ends.tolist()):
                mine = asked_pairs[to - len(trained[i]) : to]
                mine[:] = np.repeat(np.searchsorted(known, contexts[i]), each[i])
                mine <<= 32
                mine |= np.searchsorted(after, following[i])[place[i]]
            key, pair, by, first = numbered(asked_pairs)
            del asked_pairs, place
            c = np.add.reduceat(np.concatenate(trained)[by], first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
            del by, trained
            u, w = key >> 32, key & 0xFFFFFFFF
            several = c > 1
            code = np.where(several, np.cumsum(several) + 1, c)  # 0: not in training, 1: once, else 2 + number of the pair
            customers, once = (np.bincount(u, x, len(known)).astype(np.int64) for x in (c, c == 1))
            count, alone = (np.bincount(w, x, len(after)).astype(np.int64) for x in (c, c == 1))
            needed, place = np.unique(w[several], return_inverse=True)
            state = pack(_gaps(known), customers, once, u[several], place, c[several], _gaps(after[needed]), np.array([(c == 1).sum(), (c == 2).sum()]))
            seen = np.flatnonzero(count)
            echoes = [pack(np.diff(np.searchsorted(known, o), prepend=0), code[x]) for o, x in zip(own, np.split(pair, ends[:-1]), strict=True)]
            columns = [[bucket] * (len(batch) + 1), [None, *batch], [state] + [None] * len(batch), [pack(_gaps(after[seen]), count[seen], alone[seen])] + [None] * len(batch), [None, *echoes]]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["bucket", "batch", "state", "words", "asked"])

    return asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, batch long, state binary, words binary, asked binary")


def word_counts(counted: DataFrame) -> DataFrame:
    """(word, n, once): each bucket's training tokens of a word, and its pairs that are there once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for x in b["words"]:
                word, n, once = unpack(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(_sum(word).view(np.int64)), pa.array(n), pa.array(once)], ["word", "n", "once"])

    return counted.filter("words IS NOT NULL").select("words").mapInArrow(run, "word long, n long, once long")


def needed_words(states: DataFrame) -> DataFrame:
    """(bucket, word): words of which a bucket seats customers."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for bucket, x in zip(b["bucket"].to_pylist(), b["state"], strict=True):
                word = _sum(unpack(x.as_py())[6]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), bucket, np.int32)), pa.array(word)], ["bucket", "word"])

    return states.mapInArrow(run, "bucket int, word long")


# --- sampling ---------------------------------------------------------------------------------


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def seat_contexts(states: DataFrame, chances: DataFrame, d: float, parts: int, burn: int, samples: int, seed: int, split: dict[int, int]) -> DataFrame:
    """Rows (bucket, word, tables, blob): of each bucket the tables of its pairs and contexts by sample, and each word's sum of tables.

    chances: (bucket, word, p), the parent's probability of the words that the bucket needs. split: tables in all
    buckets of the contexts that are dealt to several.
    """
    first = states.select("bucket", F.lit(None).cast("long").alias("word"), F.lit(None).cast("double").alias("p"), F.col("state").alias("blob"))
    rows = first.unionByName(chances.withColumn("blob", F.lit(None).cast("binary"))).repartition(parts, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("word"))
    hot = np.sort(np.array(list(split), np.int64).view(np.uint64))
    total = np.array([split[int(x)] for x in hot.view(np.int64)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in by_bucket(batches):
            known, _, once, u, place, c, needed, _ = unpack(held[0]["blob"][0].as_py())
            known, needed = _sum(known), _sum(needed)
            word = np.concatenate([b["word"].slice(int(not j)).to_numpy() for j, b in enumerate(held)])
            p = np.concatenate([b["p"].slice(int(not j)).to_numpy() for j, b in enumerate(held)])
            by = np.argsort(word.view(np.uint64))
            chance = p[by][np.searchsorted(word.view(np.uint64)[by], needed)]
            elsewhere = once.copy()
            mine = once + np.bincount(u, minlength=len(known))
            if len(hot):
                at = np.minimum(np.searchsorted(hot, known), len(hot) - 1)
                elsewhere += np.where(hot[at] == known, total[at] - mine, 0)
            out = list(seatings(c, u, chance[place], np.maximum(elsewhere, 0), d, STRENGTH, burn, samples, np.random.default_rng([seed, bucket])))
            sums = np.stack([np.bincount(place, t, len(needed)).astype(np.int64) for t in out], axis=1)
            by_context = [once + np.bincount(u, t, len(known)).astype(np.int64) for t in out]
            blob = pack(*out, *by_context)
            tables = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), samples).cast(pa.list_(pa.int64()))
            n = len(needed)
            names = ["bucket", "word", "tables", "blob"]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), pa.array(needed.view(np.int64)), tables, pa.array([None] * n, pa.binary())], names)

    return rows.mapInArrow(run, "bucket int, word long, tables array<long>, blob binary")


def seat_words(words: DataFrame, d: float, samples: int, seed: int) -> DataFrame:
    """(word, n, customers by sample) with the tables of the shared restaurant by sample.

    Dishes are dealt by hash, so a task takes the whole restaurant to have tables in proportion to its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done = 0

        def out() -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            customers = b["customers"].flatten().to_numpy().reshape(-1, samples)
            share = len(customers) / b["words"][0].as_py()
            rng = np.random.default_rng([seed, TaskContext.get().partitionId(), done])
            tables = np.empty_like(customers)
            for s in range(samples):
                c = customers[:, s]
                zero = np.zeros(len(c), np.int64)
                # a share of the strength for a share of the dishes: (strength + tables of all) = (share * strength + own tables) / share
                *_, tables[:, s] = seatings(c, zero, np.full(len(c), b["base"][0].as_py() / share), np.zeros(1), d, STRENGTH * share, 0, 1, rng)
            sat = pa.FixedSizeListArray.from_arrays(pa.array(tables.ravel()), samples).cast(pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([b["word"], b["n"], b["customers"], sat], ["word", "n", "customers", "tables"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= DISHES:
                yield out()
                held, done = [], done + 1
        if held:
            yield out()

    return words.mapInArrow(run, "word long, n long, customers array<long>, tables array<long>")


@dataclass
class Model:
    """Globals of the model: discounts, tokens, vocabulary, and of the shared restaurant customers and tables by sample."""

    d: float
    parent_d: float
    tokens: int
    vocabulary: int
    customers: list[int]
    tables: list[int]

    def parent(self, s: int, customers: Column | np.ndarray, tables: Column | np.ndarray) -> Column | np.ndarray:
        """Probability of words with so many customers and tables in sample s."""
        return (customers - self.parent_d * tables + (STRENGTH + self.parent_d * self.tables[s]) / (self.vocabulary + 1)) / (STRENGTH + self.customers[s])


def _sampled_words(words: DataFrame, model: Model, samples: int, seed: int, parts: int, path: str | None = None) -> DataFrame:
    """Seat (word, n, customers) and set the model's sums."""
    ready = words.repartition(parts, "word").withColumns({"base": F.lit(1.0 / (model.vocabulary + 1)), "words": F.lit(model.vocabulary)})
    sat = materialize(seat_words(ready, model.parent_d, samples, seed), "lm_words", path)
    sums = [F.coalesce(F.sum(F.col(c)[s]), F.lit(0)) for c in ("customers", "tables") for s in range(samples)]
    got = list(sat.agg(*sums).first())
    model.customers, model.tables = got[:samples], got[samples:]
    return sat


def _split_tables(sampled: DataFrame, states: DataFrame, hot: tuple[np.ndarray, np.ndarray], samples: int) -> dict[int, list[int]]:
    """Customers and tables by sample, in all buckets, of the contexts that are dealt to several."""
    if not len(hot[0]):
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                known, customers, *_ = unpack(b["state"][i].as_py())
                sat = unpack(b["blob"][i].as_py())[samples:]
                at = np.flatnonzero(np.isin(_sum(known), hot[0]))
                values = np.stack([customers, *sat], axis=1)[at]
                yield pa.RecordBatch.from_arrays([pa.array(_sum(known)[at].view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), samples + 1).cast(pa.list_(pa.int64()))], ["word", "v"])

    both = sampled.filter("word IS NULL").select("bucket", "blob").join(states, "bucket")
    rows = both.select("state", "blob").mapInArrow(run, "word long, v array<long>").groupBy("word").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(samples + 1)])
    return {r[0]: list(r)[1:] for r in rows.collect()}


# --- scoring ----------------------------------------------------------------------------------


def answers(counted: DataFrame, sampled: DataFrame, words: DataFrame, buckets: int, parts: int, samples: int, split: dict[int, list[int]]) -> DataFrame:
    """Rows (batch, bucket, blob): what a batch needs of a bucket, in the order in which it asked."""
    none = {"word": "long", "n": "long", "customers": "array<long>", "tables": "array<long>", "blob": "binary"}

    def rows_of(kind: int, df: DataFrame, **columns: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "bucket", *[columns.get(c, F.lit(None).cast(t)).alias(c) for c, t in none.items()])

    state = rows_of(0, counted.filter("state IS NOT NULL"), blob=F.col("state"))
    sat = rows_of(1, sampled.filter("word IS NULL"), blob=F.col("blob"))
    dishes = rows_of(2, words.withColumn("bucket", home_column("word", buckets)), word=F.col("word"), n=F.col("n"), customers=F.col("customers"), tables=F.col("tables"))
    asked = rows_of(3, counted.filter("asked IS NOT NULL"), word=F.col("batch"), blob=F.col("asked"))
    rows = state.unionByName(sat).unionByName(dishes).unionByName(asked).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    hot = np.sort(np.array(list(split), np.int64).view(np.uint64))
    whole = np.array([split[int(x)] for x in hot.view(np.int64)], np.int64).reshape(-1, samples + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in by_bucket(batches):
            t = pa.Table.from_batches(held)
            kind = t["kind"].to_numpy()
            first = np.searchsorted(kind, np.arange(5))
            if first[1] == first[0]:  # words of a bucket that no batch asks for
                continue
            known, customers, once, _, _, c, _, _ = unpack(t["blob"][0].as_py())
            known = _sum(known)
            out = unpack(t["blob"][int(first[1])].as_py())
            at_pair = [np.concatenate(([0, 1], x)) for x in (c, *out[:samples])]  # by code: pairs not in training, seen once, the others
            columns = np.zeros((len(known), 2 + 3 * samples), np.int64)  # n, customers in the parent, tables there, customers as context, tables as context
            dish = t.slice(int(first[2]), int(first[3] - first[2])).combine_chunks()
            if dish.num_rows:
                h = dish["word"].to_numpy().view(np.uint64)
                here = np.searchsorted(known, h)
                fits = (here < len(known)) & (known[np.minimum(here, len(known) - 1)] == h)
                lists = [pa.concat_arrays(dish[x].chunks).flatten().to_numpy().reshape(-1, samples) for x in ("customers", "tables")]
                columns[here[fits], : 1 + 2 * samples] = np.column_stack((dish["n"].to_numpy(), *lists))[fits]
            columns[:, 1 + 2 * samples :] = np.column_stack((customers, *out[samples:]))
            if len(hot):
                at = np.minimum(np.searchsorted(hot, known), len(hot) - 1)
                same = hot[at] == known
                columns[same, 1 + 2 * samples :] = whole[at[same]]
            for i in range(int(first[3]), len(kind)):
                words_at, code = unpack(t["blob"][i].as_py())
                mine = columns[np.cumsum(words_at)]
                blob = pack(*mine.T, *[x[code] for x in at_pair])
                yield pa.RecordBatch.from_arrays([pa.array([t["word"][i].as_py()], pa.int64()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["batch", "bucket", "blob"])

    return rows.mapInArrow(run, "batch long, bucket int, blob binary")


def score_batches(batches: DataFrame, replies: DataFrame, model: Model, buckets: int, parts: int, samples: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (row, doc_id, held, n_tokens, n_known, base_score, score) of each part of a document."""
    names = ["row", "doc_id", "held", "size", "stream", "words"]

    def slim(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the hashes only what tells where their answers come from."""
        at = len(names)  # behind the batch
        for b in rows:
            where = [pack(*places(_sum(unpack(x.as_py())[0]), buckets, hot)) for x in b["words"]]
            yield b.set_column(at, "words", pa.array(where, pa.binary()))

    kept = batches.select("batch", *names)
    own = kept.mapInArrow(slim, kept.schema).select("batch", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("blob"), *names)
    other = replies.select("batch", "bucket", "blob", *[F.lit(None).cast(dict(batches.dtypes)[c]).alias(c) for c in names])
    rows = own.unionByName(other).repartition(parts, "batch").sortWithinPartitions("batch", "bucket")

    def run(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in by_bucket(held, "batch"):
            first = got[0]
            p, (of, slices) = pairs_of(*_read(first, 0)), unpack(first["words"][0].as_py())
            to = dealt_to(p, of, slices, buckets)
            by_word, by_pair = np.argsort(of, kind="stable"), np.argsort(to, kind="stable")
            words_at, pairs_at = (np.searchsorted(x, np.arange(buckets + 1)) for x in (of[by_word], to[by_pair]))
            word, pair = np.zeros((2 + 3 * samples, len(of)), np.int64), np.zeros((1 + samples, len(p.u)), np.int64)
            for b in got:
                for k, blob in zip(b["bucket"].to_pylist(), b["blob"], strict=True):
                    if k >= 0:
                        values = unpack(blob.as_py())
                        word[:, by_word[words_at[k] : words_at[k + 1]]] = values[: len(word)]
                        pair[:, by_pair[pairs_at[k] : pairs_at[k + 1]]] = values[len(word) :]
            n, customers, tables, seated, sat = word[0], word[1 : 1 + samples], word[1 + samples : 1 + 2 * samples], word[1 + 2 * samples], word[2 + 2 * samples :]
            chance = np.zeros(len(p.u))
            for s in range(samples):
                parent = model.parent(s, customers[s], tables[s])[p.w]
                c, t = pair[0], pair[1 + s]
                inside = c - model.d * t + (STRENGTH + model.d * sat[s][p.u]) * parent
                chance += np.where(seated[p.u] > 0, inside / (STRENGTH + seated[p.u]), parent)
            logs = np.log10(chance / samples)[p.pair]
            base = np.log10((n + SMOOTH) / (model.tokens + SMOOTH * (model.vocabulary + 1)))[p.w][p.pair]
            parts_ = len(first["row"][0])
            size = np.bincount(p.part, minlength=parts_)
            sums = [np.bincount(p.part, x, parts_) for x in ((n > 0)[p.w][p.pair], base, logs)]
            yield pa.RecordBatch.from_arrays([*[first[x][0].values for x in ("row", "doc_id", "held")], pa.array(size), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_with_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Callable[[Column], Column] | None = None, epochs: int = EPOCHS, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each document.

    held_out: from the id's column whether a document is kept from training; else those whose crc32 of the id leaves 0 by 10.
    """
    doc_id = F.col(id_col).cast("long")
    held = held_out(doc_id) if held_out else F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(held, F.lit(True)).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a bucket for each core at least; more than the text fills would only make the packed pairs larger
    parts = buckets = max(min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), -(-total // BUCKET_BYTES))
    batches = write_batches(rows)
    hot = hot_contexts(batches, buckets)
    counts = scratch_path(spark, "lm_counts")
    with scratch_scope(spark):
        counted = materialize(count_pairs(requests(batches, buckets, hot), parts), path=counts)
    states = counted.filter("state IS NOT NULL").select("bucket", "state")

    seats, dishes_path = scratch_path(spark, "lm_seats"), scratch_path(spark, "lm_words")
    with scratch_scope(spark):  # of what sampling writes only the last tables stay
        ones = states.mapInArrow(_ones_and_twos, "ones long, twos long").agg(F.sum("ones"), F.sum("twos")).first()
        needed = needed_words(states)
        # the first guess: a table for each context of a word
        degree = needed.groupBy("word").agg(F.count(F.lit(1)).alias("m"))
        dishes = word_counts(counted).groupBy("word").agg(F.sum("n").alias("n"), F.sum("once").alias("once"))
        words = materialize(dishes.join(degree, "word", "left").select("word", "n", "once", (F.col("once") + F.coalesce("m", F.lit(0))).alias("guess")), "lm_dishes")
        release(spark)
        r = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("guess") == 1), F.count_if(F.col("guess") == 2)).first()
        model = Model(discount(ones[0] or 0, ones[1] or 0), discount(r[2], r[3]), r[0], r[1], [0] * samples, [0] * samples)

        parent = _sampled_words(words.select("word", "n", F.array("guess").alias("customers")), model, 1, seed, parts)
        split: dict[int, int] = {}
        at_most = 1
        for epoch in range(epochs):
            p = sum((model.parent(s, F.col("customers")[s], F.col("tables")[s]) for s in range(at_most)), F.lit(0.0)) / at_most
            chances = needed.join(parent.select("word", p.alias("p")), "word").select("bucket", "word", "p")
            at_most = samples if epoch == epochs - 1 else 1
            sampled = materialize(seat_contexts(states, chances, model.d, parts, BURN if epoch == epochs - 1 else 0, at_most, seed + epoch + 1, split), "lm_seats", seats if epoch == epochs - 1 else None)
            release(spark)
            whole = _split_tables(sampled, states, hot, at_most)
            split = {k: v[-1] for k, v in whole.items()}
            tables = sampled.filter("word IS NOT NULL").groupBy("word").agg(F.array(*[F.sum(F.col("tables")[s]) for s in range(at_most)]).alias("tables"))
            more = F.array(*[F.col("once") + F.coalesce(F.col("tables")[s], F.lit(0)) for s in range(at_most)])
            parent = _sampled_words(words.join(tables, "word", "left").select("word", "n", more.alias("customers")), model, at_most, seed + 100 + epoch, parts, dishes_path if epoch == epochs - 1 else None)
    replies = answers(counted, sampled, parent, buckets, parts, samples, whole)
    scored = score_batches(batches, replies, model, buckets, parts, samples, hot)
    out = scored.groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _ones_and_twos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = np.array([unpack(x.as_py())[-1] for x in b["state"]], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["ones", "twos"])
