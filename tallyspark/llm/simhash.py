"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. If two fingerprints differ in at most three
bits, one of the segments differs in at most one bit, so both share one of that segment's
one-wildcard variants (the segment with one bit blanked). Variants are the join key: equal
fingerprints are merged first, each distinct one is dealt out under its 64 variants, and rows
that meet under a key are verified by the number of differing bits. A key's rows are linked
into a spanning forest on the spot, so neither pairs nor groups leave the task; keys with many
rows are cut again by pieces of the other segment, which loses no link.

Defined results: a text that is null, empty or white space has fingerprint zero and is linked
like any other; a null doc_id takes part as a document without id and never names a component
unless all its members lack one; repeated rows are kept and share a component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import connected_components
from tallyspark.llm.hashing import mix
from tallyspark.llm.text import row_digest
from tallyspark.session import materialize, shuffle_partitions

MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: Shingle hashes counted at once; longer texts are counted in parts of this many.
PART = 1 << 16
#: Rows under one key up to which all are compared with all, a block at a time.
BRUTE = 512
#: The bits of a segment, and the pieces in which hot keys are cut: of five pieces of the other segment at least two agree.
SEGMENT = 32
PIECES = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))
UPPER = bytes(range(256)).lower()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingle hashes, shingles counted with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not words:
        return 0
    size = min(shingle, len(words))
    total, counts = len(words) - size + 1, np.zeros(64, np.int64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, PART):
        stop = min(at + PART, total)
        spans = zip(starts[at:stop].tolist(), ends[at + size - 1 : stop + size - 1].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Add fp, the fingerprint of the text as a signed long."""

    @F.arrow_udf("long")
    def fp(text: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py(), shingle) for t in text), np.uint64, len(text)).view(np.int64))

    return df.withColumn("fp", fp(F.col(text_col).cast("string")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_fingerprint(rows, "text", shingle).select("doc_id", "fp")


def _forest(fps: np.ndarray, bits: int, link: list[tuple[int, int]]) -> None:
    """Append to link the edges of a spanning forest of fingerprints that differ in at most so many bits."""
    n = len(fps)
    root = np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits) + i + 1
        other = near[root[near] != root[i]]
        while len(other):
            j = other[0]
            link.append((int(fps[i]), int(fps[j])))
            root[root == root[j]] = root[i]
            other = other[root[other] != root[i]]


def link_group(fps: np.ndarray, side: int, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges that connect whatever is linked among distinct fingerprints under one key of segment ``side``."""
    link: list[tuple[int, int]] = []
    if len(fps) <= BRUTE:
        _forest(fps, bits, link)
        return link
    rest = (fps >> np.uint64(SEGMENT if side == 0 else 0)) & np.uint64(2**SEGMENT - 1)
    for i, (at, n) in enumerate(PIECES):
        for at2, n2 in PIECES[i + 1 :]:
            key = ((rest >> np.uint64(at)) & np.uint64(2**n - 1)) << np.uint64(8) | ((rest >> np.uint64(at2)) & np.uint64(2**n2 - 1))
            order = np.argsort(key, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(run) > 1:
                    _forest(fps[run], bits, link)
    return link


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that keep every connection by at most three bits."""
    parts = shuffle_partitions(fps.sparkSession)
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT)
    keys = []
    for side, seg in ((0, low), (1, high)):
        for bit in range(SEGMENT):
            # key: side, blanked bit and the segment without that bit
            keys.append(F.shiftleft(F.lit(side * SEGMENT + bit).cast("long"), SEGMENT).bitwiseOR(seg.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << bit)))))
    dealt = fps.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_fps = None, np.empty(0, np.uint64)

        def out(link: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(link, np.uint64).view(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            cuts = np.flatnonzero(np.diff(key)) + 1
            firsts = np.concatenate(([0], cuts))
            lasts = np.concatenate((cuts, [len(key)]))
            link: list[tuple[int, int]] = []
            if key[0] == open_key:  # the group goes on from the batch before
                open_fps = np.concatenate((open_fps, fp[: lasts[0]]))
                firsts, lasts = firsts[1:], lasts[1:]
            if len(firsts):
                if len(open_fps) > 1:
                    link += link_group(open_fps, int(open_key) >> SEGMENT >= SEGMENT)
                several = np.flatnonzero(lasts[:-1] - firsts[:-1] > 1)
                for a, b, k in zip(firsts[several].tolist(), lasts[several].tolist(), key[firsts[several]].tolist(), strict=True):
                    link += link_group(fp[a:b], (k >> SEGMENT) >= SEGMENT)
                open_key, open_fps = key[firsts[-1]], fp[firsts[-1] : lasts[-1]].copy()
            if link:
                yield out(link)
        if len(open_fps) > 1 and (link := link_group(open_fps, (int(open_key) >> SEGMENT) >= SEGMENT)):
            yield out(link)

    return dealt.mapInArrow(run, "a long, b long")


def components(fps: DataFrame) -> DataFrame:
    """(fp, component) for each distinct fingerprint (column fp); one without a link is a component of its own."""
    groups = materialize(fps.select("fp").distinct(), "distinct_fingerprints")
    parts = connected_components(links(groups))
    return materialize(groups.join(parts, groups["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("component")), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = components(rows)
    # the smallest id is taken per fingerprint first, so a hot component meets few rows
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies: five-word shingles; candidates by deletion variants and by bands of minima, confirmed on the shingles ----
#: Near copies share this much of their distinct five-word shingles.
SIMILAR, WIDE = 0.8, 5
#: Minima of the shingles, a byte each, in bands; documents meet that agree in all minima of a band. Of pairs alike to 0.8 all but 7 in 100,000 do.
BANDS, ROWS = 24, 5
LANES = BANDS * ROWS
#: Share of equal minima below which a pair that met is not looked at: four standard deviations of the estimate below 0.8.
LIKELY = 0.65
#: Nodes compared with each other in one task, and bytes of their sets; more nodes under a key are dealt as pairs of blocks.
BLOCK, BLOCK_BYTES = 512, 8 << 20
_LANE = (np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
NEAR = "struct<node:bigint,fp:bigint,sketch:binary>"


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct five-word shingles in order; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(UPPER).split()
    size = min(WIDE, len(words))
    if not size:
        return np.empty(0, np.uint64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    w = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))[ids]
    total = len(words) - size + 1
    return np.unique(mix(sum((w[d : d + total] * np.uint64(2 * d + 3) for d in range(size)), np.zeros(total, np.uint64))))


def set_fingerprint(shingles: np.ndarray) -> int:
    """Bits set in over half of the hashes of a set, as a signed long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), PART):
        counts += np.unpackbits(shingles[at : at + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def sketch_of(shingles: np.ndarray) -> bytes:
    """A byte of each of the minima; the whole minimum is mixed first, for those of long texts have only low bits."""
    low = np.full(LANES, 2**32 - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        x = short[at : at + 2048, None] * _LANE
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        low = np.minimum(low, x.min(axis=0))
    return (mix(low.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()


def with_near_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add near: node, a hash of the whole shingle set, its fingerprint, and the sketch."""

    @F.arrow_udf(NEAR)
    def near(text: pa.Array) -> pa.Array:
        nodes, fps, sketches = np.zeros(len(text), np.uint64), np.zeros(len(text), np.int64), []
        for i, t in enumerate(text):
            s = shingle_set(t.as_py())
            nodes[i], fps[i] = xxhash.xxh64_intdigest(s.tobytes()), set_fingerprint(s)
            sketches.append(sketch_of(s))
        return pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), pa.array(fps), pa.array(sketches, pa.binary())], ["node", "fp", "sketch"])

    return df.withColumn("near", near(F.col(text_col).cast("string")))


def variant_stars(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of nodes whose fingerprints are equal or linked by deletion variants."""
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprint_heads")
    same = nodes.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    far = links(heads.select("fp"))
    for side in ("a", "b"):
        far = far.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_node")), side).drop(side)
    return same.union(far.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, LANES)


def node_links(nodes: DataFrame) -> DataFrame:
    """(key, head, node), from rows (node, sketch): each node under a band's key beside the smallest node there."""
    parts = shuffle_partitions(nodes.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.zeros((batch.num_rows, BANDS, 8), np.uint8)
            wide[:, :, :ROWS] = _matrix(batch.column(1)).reshape(-1, BANDS, ROWS)
            key = wide.view("<i8")[:, :, 0] | np.arange(BANDS, dtype=np.int64) << 48
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            first = np.concatenate(([key[0] != now], key[1:] != key[:-1]))
            start = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            heads = node[np.maximum(start, 0)]
            if head is not None:  # the group goes on from the batch before
                heads = np.where(start < 0, head, heads)
            now, head = key[-1], heads[-1]
            if not first.all():
                yield pa.RecordBatch.from_arrays([pa.array(key[~first]), pa.array(heads[~first]), pa.array(node[~first])], ["key", "head", "node"])

    dealt = nodes.select("node", "sketch").mapInArrow(deal, "key long, node long").repartition(parts, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "key long, head long, node long")


def common_share(x: np.ndarray, y: np.ndarray) -> float:
    """Share of common members of two sets in order."""
    if not len(x) or not len(y):
        return 0.0
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


def crossings(links: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between components (node, component, size) of which two nodes under a key are alike to SIMILAR.

    Where a key's nodes are not all of one component, they meet in pairs of blocks of bounded bytes, with their
    sets (node, sketch, short). Pairs that agree first in this band and are likely by their sketches are held
    against each other on the spot; what is confirmed joins components there, so that no further pair of them is
    looked at, and only such joins leave the task.
    """
    members = links.select("key", "node").union(links.groupBy("key").agg(F.min("head").alias("node"))).join(labels, "node")
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("long")
    rows = members.drop("size").join(several.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.join(sets.select("node", "sketch", "short"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "component", "sketch", "short")
    dealt = rows.repartition(shuffle_partitions(links.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        band, same = t["key"][0].as_py() >> 48, t["lo"][0] == t["hi"][0]
        own, component = (t[c].to_numpy() for c in ("own", "component"))
        sketch, sets = _matrix(t["sketch"]), [np.frombuffer(x.as_buffer(), np.uint32) for x in t["short"]]
        root, joined = component.copy(), []
        for i in range(len(own) - 1):
            j = np.flatnonzero((root[i + 1 :] != root[i]) & (same | (own[i + 1 :] != own[i]))) + i + 1
            equal = sketch[j] == sketch[i]
            share = equal.mean(axis=1)
            likely = np.flatnonzero(share >= LIKELY)
            likely = likely[equal[likely].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
            for k in j[likely[np.argsort(-share[likely], kind="stable")]].tolist():
                if root[k] != root[i] and common_share(sets[i], sets[k]) >= SIMILAR:
                    joined.append((component[i], component[k]))
                    root[root == root[k]] = root[i]
        if joined:
            e = np.array(joined, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            by = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if to == at:
                    continue
                if held and tuple(by[:, at]) != now:
                    yield from compare(held)
                    held = []
                now = tuple(by[:, at])
                held.append(batch.slice(at, to - at))
        if held:
            yield from compare(held)

    return dealt.mapInArrow(run, "a long, b long")


def alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of common shingles of two sets, each the bytes of its hashes in order."""
    return pa.array([common_share(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)) for pair in zip(a, b, strict=True)], pa.float64())


def set_columns(text: pa.Array) -> pa.Array:
    """Each text's set of shingle hashes as bytes, and the upper halves of the hashes, which is enough to compare two sets."""
    sets = [shingle_set(t.as_py()) for t in text]
    short = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets]
    return pa.StructArray.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(short, pa.binary())], ["shingles", "short"])


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) whose shingle sets (node, shingles) are alike to SIMILAR."""
    share = F.arrow_udf(alike, "double")
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.filter(share("sa", "sb") >= SIMILAR).select(*edges.columns)


def keep_one_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies: five-word shingles alike to 0.8 or more.

    Documents of the same shingles are one node. Nodes whose fingerprints are linked by deletion
    variants are candidates, and so are those that agree in a band of minima, as most pairs alike to
    0.8 differ in more bits than the variants reach; each edge is confirmed on the shingle sets. First
    every node is held against the smallest one under its key; where a key's nodes are not all linked by
    that, all likely pairs of different components are compared, a block with a block at a time. The document of smallest id stays, one
    without id only where none has one; of several rows of that id the one of smallest text hash, then
    of smallest digest of its columns; of rows that are equal throughout one stays.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    key = ["__order", "__key", "__rest"]
    keyed = docs.withColumns({"__order": order, "__key": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "__rest": row_digest(*docs.columns)})
    rows = with_near_features(keyed.select(*key, F.col(text_col).alias("text"))).select(*key, "near.*")
    rows = materialize(rows, "near_features")
    nodes = materialize(rows.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("fp").alias("fp"), F.min(F.struct(*key)).alias("first")), "near_nodes")
    links = materialize(node_links(nodes), "near_links")
    stars = materialize(links.select(F.col("head").alias("a"), F.col("node").alias("b")).union(variant_stars(nodes)).distinct(), "near_candidates")
    met = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    want = nodes.join(met, "node").select("node", "sketch", "first.*")
    columns = F.arrow_udf(set_columns, "struct<shingles:binary,short:binary>")
    # rows that are equal throughout become one before they meet anything by key
    texts = keyed.select(*key, F.col(text_col).cast("string").alias("text")).dropDuplicates(key).join(want, key)
    sets = materialize(texts.select("node", "sketch", columns("text").alias("s")).select("node", "sketch", "s.*"), "near_sets")
    parts = connected_components(confirmed(stars, sets))
    sized = sets.select("node", F.octet_length("short").alias("size"))
    labels = materialize(sized.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "size"), "near_labels")
    # the components that the crossings join are few beside the nodes
    joined = connected_components(crossings(links, labels, sets)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    labels = labels.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    named = nodes.select("node", "first").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    winners = named.groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    return keyed.dropDuplicates(key).join(winners, key, "left_semi").select(*docs.columns)
