"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into words (runs of letters and digits). Each word enters twice: by a vector of its
own (one shared vector for words that training did not see often) and by its characters, through
``FILTERS`` convolutions over the word's bytes with marks at both ends, of which the highest value
counts. Windows of ``WINDOW`` words that overlap by half go through a gated recurrent network in
both directions; attention pools a window's states to one logit. Every window of every text is
scored, whatever its length; a logistic of the highest logit and of the mean of the three highest
gives the document's score. All weights start at random: no statistic of labels enters as input.

Training takes labelled documents only from a bounded sample: of each class the first
``TRAIN_ROWS`` by hash of doc_id, of at most ``TRAIN_CHARS`` characters, up to ``TRAIN_WINDOWS``
windows each. It runs in one task, and only weights return. A fifth of the sample is kept for the
final logistic. Windows carry their document's label at first; later rounds train on the windows
that score highest, as a toxic document need not be toxic throughout. Scores use nothing but the text.

Defined results: a null or empty text is one window of padding and gets the score of having no
word; a null doc_id is never trained on and is not held out; of several labels of a document the
highest counts, of several texts the smallest; repeated rows get the same score; without both
classes in the sample every score is that of the class that is there; an empty table gives an empty
result; other columns are kept by ``with_score`` and ignored by ``score_documents``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.hashing import _INVERSE, _ODD, mix, powers

WINDOW, STRIDE = 48, 24
TRAIN_ROWS = {1: 3000, 0: 4000}
TRAIN_CHARS = 20_000
TRAIN_WINDOWS = 8
THRESHOLD = 0.3
#: A word in fewer training documents has no vector of its own; a share of the others goes without it in each step.
LEAST, DROPPED = 3, 0.3
EMBED, HIDDEN, ATTEND = 12, 12, 8
#: Convolutions over characters, and the characters that each sees; two marks stand for a word's ends.
FILTERS, REACH, MARKS = 24, 5, 2
BATCH, RATE, SEED = 256, 0.01, 7
#: Steps in a round of training, however small the sample.
LEAST_STEPS = 80
#: Windows scored at once, distinct words whose inputs are computed at once, and bytes of text tokenised at once.
WINDOWS_AT_ONCE, WORDS_AT_ONCE, BYTES_AT_ONCE = 1 << 12, 1 << 13, 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start .. start + size - 1 of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@dataclass
class Words:
    """Distinct words (hash, characters between marks and their number), the words of all texts in order, words per text."""

    keys: np.ndarray
    chars: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    def take(self, at: np.ndarray) -> Words:
        first = (np.cumsum(self.sizes) - self.sizes)[at]
        return Words(self.keys[at], self.chars[_places(first, self.sizes[at])], self.sizes[at], self.ids[:0], self.counts[:0])


def words_of(texts: list[bytes]) -> Words:
    """Words of any number of texts, read a bounded stretch at a time."""
    parts, at = [], 0
    while at < len(texts) or not parts:
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BYTES_AT_ONCE):
            size += len(texts[end])
            end += 1
        parts.append(_words(texts[at:end])[0])
        at = max(end, 1)
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([w.keys for w in parts])
    keys, at, place = np.unique(keys, return_index=True, return_inverse=True)
    base = np.cumsum([0, *(len(w.keys) for w in parts)])
    ids = np.concatenate([place[b : b + len(w.keys)][w.ids].astype(np.int32) for b, w in zip(base, parts, strict=False)])
    every = Words(np.concatenate([w.keys for w in parts]), np.concatenate([w.chars for w in parts]), np.concatenate([w.sizes for w in parts]), ids, np.concatenate([w.counts for w in parts]))
    kept = every.take(at)
    return Words(keys, kept.chars, kept.sizes, every.ids, every.counts)


def _words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of texts that are read together, and where each begins in the texts joined by one byte."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    letter = np.concatenate(([False], _LETTER[raw], [False]))
    first = np.flatnonzero(letter[1:-1] & ~letter[:-2])
    last = np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    counts = np.diff(np.concatenate(([0], np.searchsorted(first, ends))))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(raw)))))
        whole = mix((total[last] - total[first]) * powers(_INVERSE, len(raw) + 1)[first])
    keys, at, ids = np.unique(whole, return_index=True, return_inverse=True)
    size = last[at] - first[at]
    sizes = np.maximum(size + 2, REACH)
    begins = np.cumsum(sizes) - sizes
    chars = np.full(sizes.sum(), 257, np.int16)
    chars[begins] = 256
    chars[_places(begins + 1, size)] = raw[_places(first[at], size)]
    return Words(keys, chars, sizes, ids.astype(np.int32), counts), first


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each window; the last one of a text is flush with its end."""
    each = np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    base = np.cumsum(counts) - counts
    start = np.minimum(nth * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return text, base[text] + start, np.minimum(WINDOW, counts[text] - start)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Hashes of the words that have vectors (the first vector is everyone else's), weights by name, and the final logistic."""

    known: np.ndarray
    w: dict[str, np.ndarray]
    final: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Place of each word's vector."""
        if not len(self.known):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, at + 1, 0)

    def convolved(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each filter at each place of the words' characters, the place where each word's values begin, and the places in the characters."""
        sizes = words.sizes - (REACH - 1)
        place = _places(np.cumsum(words.sizes) - words.sizes, sizes)
        out = self.w["conv"][0][words.chars[place]]
        for k in range(1, REACH):
            out += self.w["conv"][k][words.chars[place + k]]
        return out, np.cumsum(sizes) - sizes, place

    def inputs(self, words: Words) -> np.ndarray:
        """Input vector of each distinct word."""
        if not len(words.keys):  # padding needs a row to point at
            return np.zeros((1, EMBED + FILTERS), np.float32)
        out = np.empty((len(words.keys), EMBED + FILTERS), np.float32)
        out[:, :EMBED] = self.w["embed"][self.vectors(words.keys)]
        for lo in range(0, len(out), WORDS_AT_ONCE):
            part = words if len(out) <= WORDS_AT_ONCE else words.take(np.arange(lo, min(lo + WORDS_AT_ONCE, len(out))))
            conv, begin, _ = self.convolved(part)
            out[lo : lo + WORDS_AT_ONCE, EMBED:] = np.tanh(np.maximum.reduceat(conv, begin, axis=0) + self.w["bc"])
        return out

    def states(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """Hidden state after each word of each window, in one direction."""
        u = self.w[f"u{side}"]
        h = np.zeros((len(ids), HIDDEN), np.float32)
        out = np.empty((len(ids), WINDOW, HIDDEN), np.float32)
        for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
            g, hu, m = gates[ids[:, t]], h @ u, mask[:, t : t + 1]
            zr = sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN] * m, zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, zr[:, :HIDDEN], r, n, hu[:, 2 * HIDDEN :], m))
            h = h + z * (n - h)
            out[:, t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        a = np.tanh(states @ self.w["wa"] + self.w["ba"])
        s = np.where(mask > 0, a @ self.w["va"], np.float32(-1e4))
        e = np.exp(s - s.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", alpha, states)
        return pooled @ self.w["wo"] + self.w["bo"], a, alpha, pooled

    def logits(self, words: Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Logit of each window (its first word and number of words)."""
        x = self.inputs(words)
        gates = [x @ self.w[f"w{s}"] + self.w[f"b{s}"] for s in (0, 1)]
        out = [np.empty(0, np.float32)]
        for lo in range(0, len(first), WINDOWS_AT_ONCE):
            ids, mask = window_ids(words.ids, first[lo : lo + WINDOWS_AT_ONCE], n[lo : lo + WINDOWS_AT_ONCE])
            out.append(self.pool(np.concatenate([self.states(gates[s], ids, mask, s) for s in (0, 1)], axis=2), mask)[0])
        return np.concatenate(out)


def window_ids(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word at each place of each window, and whether there is one."""
    at = first[:, None] + np.arange(WINDOW)
    mask = np.arange(WINDOW) < n[:, None]
    out = ids[np.where(mask, at, 0)] if len(ids) else np.zeros(at.shape, np.int32)
    return np.where(mask, out, 0).astype(np.int32), mask.astype(np.float32)


def gradients(model: Model, words: Words, own: np.ndarray, ids: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted cross-entropy of windows and its derivative by each weight; own: which vector each word uses.

    The derivative of the vectors is that of the words' own ones, in the order of the words.
    """
    w = model.w
    conv, begin, place = model.convolved(words)
    top = np.maximum.reduceat(conv, begin, axis=0)
    chars = np.tanh(top + w["bc"])
    x = np.concatenate((w["embed"][own], chars), axis=1)
    keep: list[list] = [[], []]
    states = np.concatenate([model.states(x @ w[f"w{s}"] + w[f"b{s}"], ids, mask, s, keep[s]) for s in (0, 1)], axis=2)
    logit, a, alpha, pooled = model.pool(states, mask)
    p = sigmoid(logit)
    loss = float(-(weight * (label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7))).sum() / weight.sum())
    d: dict[str, np.ndarray] = {}
    out = (weight * (p - label) / weight.sum()).astype(np.float32)
    d["wo"], d["bo"] = pooled.T @ out, out.sum(keepdims=True)
    pooled_d = out[:, None] * w["wo"]
    states_d = alpha[:, :, None] * pooled_d[:, None]
    alpha_d = np.einsum("bh,bth->bt", pooled_d, states)
    s_d = alpha * (alpha_d - (alpha * alpha_d).sum(axis=1, keepdims=True)) * (mask > 0)
    d["va"] = np.einsum("bt,bta->a", s_d, a)
    a_d = s_d[:, :, None] * w["va"] * (1 - a * a)
    d["wa"], d["ba"] = np.einsum("bth,bta->ha", states, a_d, optimize=True), a_d.sum(axis=(0, 1))
    states_d = states_d + a_d @ w["wa"].T
    x_d = np.zeros_like(x)
    for s in (0, 1):
        u = w[f"u{s}"]
        d[f"u{s}"] = np.zeros_like(u)
        gates_d = np.zeros((len(x), 3 * HIDDEN), np.float32)
        dh = np.zeros((len(ids), HIDDEN), np.float32)
        for t, h, z, r, new, hn, m in reversed(keep[s]):
            dh = dh + states_d[:, t, s * HIDDEN : (s + 1) * HIDDEN]
            dz, dn = dh * m * (new - h) * z * (1 - z), dh * m * z * (1 - new * new)
            dr = dn * hn * r * (1 - r)
            np.add.at(gates_d, ids[:, t], np.concatenate((dz, dr, dn), axis=1))
            g = np.concatenate((dz, dr, dn * r), axis=1)
            d[f"u{s}"] += h.T @ g
            dh = dh * (1 - m * z) + g @ u.T
        d[f"w{s}"], d[f"b{s}"] = x.T @ gates_d, gates_d.sum(axis=0)
        x_d += gates_d @ w[f"w{s}"].T
    d["embed"] = x_d[:, :EMBED]
    top_d = x_d[:, EMBED:] * (1 - chars * chars)
    d["bc"] = top_d.sum(axis=0)
    # the highest value of a word and filter comes from one place, the first if several are equal
    at = np.where(conv == np.repeat(top, words.sizes - (REACH - 1), axis=0), np.arange(len(conv))[:, None], len(conv))
    at = place[np.minimum.reduceat(at, begin, axis=0)]
    d["conv"] = np.stack([np.bincount((words.chars[at + k].astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), top_d.ravel(), (256 + MARKS) * FILTERS).reshape(-1, FILTERS) for k in range(REACH)]).astype(np.float32)
    return loss, d


def start(words: Words, docs: np.ndarray, rng: np.random.Generator) -> Model:
    """Small random weights, and a vector for each word of LEAST documents."""
    base = np.cumsum(words.counts) - words.counts
    seen = np.zeros(len(words.keys), np.int64)
    for i in docs.tolist():
        seen[np.unique(words.ids[base[i] : base[i] + words.counts[i]])] += 1
    known = words.keys[seen >= LEAST]  # in order, like the words
    draw = lambda size, *shape: (rng.standard_normal(shape) * size).astype(np.float32)
    w = {"embed": draw(0.1, len(known) + 1, EMBED), "conv": draw(0.2, REACH, 256 + MARKS, FILTERS), "bc": np.full(FILTERS, -0.5, np.float32)}
    w |= {"wa": draw(0.3, 2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": draw(0.3, ATTEND), "wo": draw(0.3, 2 * HIDDEN), "bo": np.zeros(1, np.float32)}
    for s in (0, 1):
        w |= {f"w{s}": draw(0.3, EMBED + FILTERS, 3 * HIDDEN), f"u{s}": draw(0.3, HIDDEN, 3 * HIDDEN), f"b{s}": np.zeros(3 * HIDDEN, np.float32)}
    return Model(known, w)


def _summary(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Highest logit and mean of the three highest of each text, whose windows lie together."""
    by = np.lexsort((-logits, text))
    first = np.searchsorted(text[by], np.arange(n))
    last = np.searchsorted(text[by], np.arange(n), side="right")
    total = np.concatenate(([0.0], np.cumsum(logits[by].astype(np.float64))))
    top = np.minimum(first + 3, last)
    return np.stack((logits[by][first], (total[top] - total[first]) / (top - first)), axis=1)


class _Steps:
    """Adam's moments; of the vectors only those in use are moved."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.n = w, 0
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}

    def move(self, d: dict[str, np.ndarray], own: np.ndarray, rate: float) -> None:
        self.n += 1
        rows, at = np.unique(own, return_inverse=True)
        g = np.zeros((len(rows), EMBED), np.float32)
        np.add.at(g, at, d["embed"])
        for name, w in self.w.items():
            m, v = self.moment[name]
            here = rows if name == "embed" else slice(None)
            x = g if name == "embed" else d[name]
            m[here] += 0.1 * (x - m[here])
            v[here] += 0.001 * (x * x - v[here])
            w[here] -= (rate * (m[here] / (1 - 0.9**self.n)) / (np.sqrt(v[here] / (1 - 0.999**self.n)) + 1e-8)).astype(w.dtype)


def train(texts: list[bytes], label: np.ndarray, rounds: int = 6) -> Model:
    """Fit the network and the final logistic to labelled texts."""
    rng = np.random.default_rng(SEED)
    words = words_of(texts)
    fold = rng.permutation(len(texts)) % 5 == 0
    if min(label[fold].sum(), (1 - label[fold]).sum()) < 10:  # too few to spare
        fold[:] = False
    docs = np.flatnonzero(~fold)
    model = start(words, docs, rng)
    rate = label[docs].mean() if len(docs) else 0.0
    if not 0 < rate < 1:
        model.final = np.array([0.0, 0.0, 4.0 if rate else -4.0])
        return model
    text, first, n = windows_of(words.counts)
    chosen = np.flatnonzero(~fold[text])
    nth = np.arange(len(text)) - np.searchsorted(text, text)
    each = np.bincount(text, minlength=len(texts))[text]
    chosen = chosen[(nth[chosen] * TRAIN_WINDOWS // np.maximum(each[chosen], 1)) != ((nth[chosen] - 1) * TRAIN_WINDOWS // np.maximum(each[chosen], 1))]
    first, n, owner = first[chosen], n[chosen], text[chosen]
    weight = np.where(label == 1, np.sqrt((1 - rate) / rate), 1.0).astype(np.float32)
    place, steps = model.vectors(words.keys), _Steps(model.w)
    for k in range(rounds):
        use = np.arange(len(owner))
        if k >= 2:
            scores = model.logits(words, first, n)
            by = np.lexsort((-scores, owner))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
            use = np.flatnonzero(rank < 2)
        order = rng.permutation(use)
        for part in np.array_split(order, min(max(len(order) // BATCH, LEAST_STEPS), len(order))):
            ids, mask = window_ids(words.ids, first[part], n[part])
            here, local = np.unique(ids, return_inverse=True)
            own = np.where(rng.random(len(here)) < DROPPED, 0, place[here])
            _, d = gradients(model, words.take(here), own, local.reshape(ids.shape), mask, label[owner[part]].astype(np.float32), weight[owner[part]])
            steps.move(d, own, RATE * (0.5 if k >= 3 else 1.0) * (0.5 if k >= 5 else 1.0))
    at = np.flatnonzero(fold) if fold.any() else np.arange(len(texts))
    model.final = _logistic(raw_summary(model, [texts[i] for i in at.tolist()]), label[at])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights and constant of a logistic regression, by Newton's method."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(w)), g)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def raw_summary(model: Model, texts: list[bytes]) -> np.ndarray:
    """What the final logistic sees of each text; all windows of all texts are scored."""
    out, at = [np.empty((0, 2))], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BYTES_AT_ONCE):
            size += len(texts[end])
            end += 1
        if size > BYTES_AT_ONCE:
            out.append(_in_stretches(model, texts[at]))
        else:
            words = words_of(texts[at:end])
            text, first, n = windows_of(words.counts)
            out.append(_summary(model.logits(words, first, n), text, end - at))
        at = end
    return np.concatenate(out)


def _in_stretches(model: Model, text: bytes) -> np.ndarray:
    """A long text a stretch at a time; its windows are those of the whole text.

    A stretch ends between words, and leaves its last whole window to the next one, which begins
    with that window: so every stretch but the last has its windows at the same words, and the last
    has at least a window's words.
    """
    best = np.empty(0)
    lo, size = 0, BYTES_AT_ONCE
    while True:
        hi = min(len(text), lo + size)
        while hi < len(text) and _LETTER[text[hi]]:  # not within a word
            gap = np.flatnonzero(~_LETTER[np.frombuffer(text, np.uint8, min(BYTES_AT_ONCE, len(text) - hi), hi)])
            hi += int(gap[0]) if len(gap) else min(BYTES_AT_ONCE, len(text) - hi)
        words, begin = _words([text[lo:hi]])
        if hi == len(text):
            _, first, n = windows_of(words.counts)
            best = np.sort(np.concatenate((best, model.logits(words, first, n))))[-3:]
            return np.array([[best[-1], best.mean()]])
        whole = (len(begin) - WINDOW) // STRIDE  # windows of this stretch
        if whole < 1:  # words too long: a longer stretch is needed
            size *= 2
            continue
        first = np.arange(whole) * STRIDE
        best = np.sort(np.concatenate((best, model.logits(words, first, np.full(whole, WINDOW)))))[-3:]
        lo, size = lo + int(begin[whole * STRIDE]), BYTES_AT_ONCE


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    x = raw_summary(model, texts)
    return 1 / (1 + np.exp(-np.clip(x @ model.final[:2] + model.final[2], -30, 30)))


def _lower(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, label and text of at most so many labelled documents of each class that are not held out."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    first = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k, most in TRAIN_ROWS.items()]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") <= TRAIN_CHARS)
    # the sample has a fixed number of rows at most
    return rows.join(F.broadcast(first[0].union(first[1])), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train in one task on a bounded sample of the labelled documents that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = train([_lower(t) for _, _, t in rows], np.array([y for y, _, _ in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = training_sample(docs, labels, id_col, text_col, label_col)
    got = sample.select("label", "id", "text").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got["model"]) if got else train([], np.empty(0, np.int64))  # without any row there may be no task


def _scorer(model: Broadcast[Model]):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(score_texts(model.value, [_lower(t.as_py()) for t in b]), pa.float64())

    return score


def with_score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score of each text."""
    return docs.withColumn(score_col, _scorer(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col).cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_score(rows, fit(docs, labels, id_col=id_col, text_col=text_col))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold."""
    name = "__toxicity"
    return with_score(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col=text_col, score_col=name).filter(F.col(name) < THRESHOLD).select(*docs.columns)
