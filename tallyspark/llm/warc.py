"""Deterministic sharded WARC writer, and the reader that proves it.

Pages are cut into shards of about ``shard_bytes`` of payload at exact places of the order by page_id,
so shard borders do not depend on sampling or on the cluster. Pages of one id, or of none, are
ordered by a hash of what they hold, so they fall to several shards too; only pages that are equal
throughout stay together. One task writes one shard, and no two shards share a task: records in order of page_id, each its own gzip
member, a new file as soon as the current one reaches ``roll_bytes`` compressed. Headers, record
ids and digests are computed anew from the page, never copied. A file is written under a
temporary name in the target folder and renamed when whole; a task that is run again writes the
same bytes to the same name. The manifest is written last, and the reader takes only files that
it lists, checking their size and digest.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once, by the page of smallest id; the
others become revisit records that name it.

Defined results: a null payload is empty; a null page_id sorts first and is never referred to; a
null url becomes ``urn:page:unknown``; rows that repeat the smallest page_id of a payload are all
responses; an empty table gives an empty manifest and result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.ranks import with_rank
from tallyspark.session import materialize, scratch_path

MIN_REVISIT = 100
ROLL_BYTES = 32 << 20
SHARD_BYTES = 16 << 20
#: Numbers tried for each partition when looking for one that Spark's hash sends there.
TRIES = 16
#: Manifests of up to so many files are broadcast to the reader's scan.
BROADCAST_FILES = 100_000
SALTS = 16
LEVEL = 4
#: Bytes that a record takes beside its payload, about.
HEAD = 600
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard long, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member whose header has no time
    return z.compress(raw) + z.flush()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def _uri(url: str | None) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127)))) if url else "urn:page:unknown"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _record_id(page_id, url, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    headers += [("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        return _record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to))]
    return _record("revisit", headers, http)


class Files:
    """The few file operations the writer needs, on a local path or any filesystem that pyarrow opens."""

    def __init__(self, folder: str):
        parsed = urlparse(folder)
        self.local = parsed.scheme in ("", "file")
        self.folder = (parsed.path if self.local else folder).rstrip("/")
        if not self.local:
            self.fs, self.folder = pafs.FileSystem.from_uri(folder)

    def put(self, name: str, data: bytes) -> None:
        temporary = f"{self.folder}/_tmp-{uuid.uuid4().hex}-{name}"
        if self.local:
            os.makedirs(self.folder, exist_ok=True)
            with open(temporary, "wb") as f:
                f.write(data)
            os.replace(temporary, f"{self.folder}/{name}")
        else:
            self.fs.create_dir(self.folder)
            with self.fs.open_output_stream(temporary) as f:
                f.write(data)
            self.fs.move(temporary, f"{self.folder}/{name}")


def _borders(meta: DataFrame, shard_bytes: int) -> np.ndarray:
    """The smallest (order, tie) of each shard after the first: two longs for each shard_bytes of payload.

    A shard ends at the first page that brings the bytes before it to a multiple of shard_bytes. They are
    summed exactly along the order: within each sorted part file, and over the files before it.
    """
    ranked = materialize(with_rank(meta.groupBy("order", "tie").agg(F.sum(F.col("n") + HEAD).alias("n")), [F.col("order"), F.col("tie")]), "ranked_pages")
    block = F.floor(F.col("rank") / 4096)
    sums = materialize(ranked.groupBy(block.alias("block")).agg(F.sum("n").alias("n")), "page_bytes")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row for 4096 pages is summed in order
    starts = sums.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranked.withColumn("block", block).join(starts, "block").withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    shard = F.floor(F.col("start") / shard_bytes)
    cut = rows.groupBy(shard.alias("shard")).agg(F.min(F.struct("order", "tie")).alias("at")).filter("shard > 0").select("at.order", "at.tie")
    got = cut.toArrow()
    both = np.stack([got.column(c).to_numpy() for c in ("order", "tie")]).astype(np.int64)
    return both[:, np.lexsort(both[::-1])]


def shards_of(borders: np.ndarray, order: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Number of borders that are not above each (order, tie)."""
    low, high = (np.searchsorted(borders[0], order, side=side) for side in ("left", "right"))
    for i in np.flatnonzero(high > low).tolist():
        low[i] += np.searchsorted(borders[1][low[i] : high[i]], tie[i], side="right")
    return low


def _places(spark: SparkSession, n: int) -> np.ndarray:
    """For each partition of n a number that Spark's hash partitioning sends there, as far as there is one among those tried."""
    tried = spark.range(n * TRIES).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("to")).agg(F.min("id").alias("id")).toArrow()
    out = np.arange(n)
    out[tried.column(0).to_numpy()] = tried.column(1).to_numpy()
    return out


def _revisits(meta: DataFrame, min_bytes: int) -> DataFrame:
    """order, digest, refers_to of the pages whose payload a smaller page_id has; salted, as one payload may be very common."""
    first = meta.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1 and first is not null")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = meta.withColumn("salt", F.pmod(F.xxhash64("order"), F.lit(SALTS)).cast("int"))
    return rows.join(first, ["digest", "salt"]).filter("page_id is null or page_id > first").select("order", "tie", "digest", F.col("first").alias("refers_to"))


def write_warc(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = MIN_REVISIT,
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write the pages as WARC files into ``folder``, a path that all executors share; returns the manifest."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("order", F.coalesce("page_id", F.lit(-(2**63)))).withColumn("tie", F.xxhash64("digest", "url"))
    meta = materialize(base.select("page_id", "order", "tie", "digest", F.octet_length("payload").alias("n")), "page_meta")
    borders = _borders(meta, shard_bytes)
    shards = borders.shape[1] + 1
    places = _places(pages.sparkSession, shards)

    @F.pandas_udf("shard long, place long")
    def shard_of(order: pd.Series, tie: pd.Series) -> pd.DataFrame:
        shard = shards_of(borders, order.to_numpy(np.int64), tie.to_numpy(np.int64))
        return pd.DataFrame({"shard": shard, "place": places[shard]})

    # a revisit's note sorts right before its page, so payloads are shuffled once and joined to nothing
    notes = _revisits(meta, min_revisit).select("order", "tie", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    rows = base.select("order", "tie", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "page_id", "url", "payload")
    rows = rows.unionByName(notes).withColumn("to", shard_of("order", "tie")).select("*", "to.shard", "to.place").drop("to")
    rows = rows.repartition(shards, "place").sortWithinPartitions("shard", "order", "tie", "kind", F.asc_nulls_first("url")).drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done = Files(folder), []
        shard, number, noted = None, 0, (None, None, None)
        parts: list[bytes] = []
        size = count = 0

        def close() -> None:
            nonlocal number, size, count
            if count:
                data = b"".join(parts)
                name = f"pages-{shard:06d}-{number:05d}.warc.gz"
                files.put(name, data)
                done.append((name, shard, count, len(data), hashlib.sha256(data).hexdigest()))
                number += 1
            parts.clear()
            size = count = 0

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    noted = (r["order"], r["digest"], r["refers_to"])
                    continue
                if r["shard"] != shard:
                    close()
                    shard, number = r["shard"], 0
                if not count:
                    parts.append(_record("warcinfo", [("WARC-Record-ID", _record_id("file", shard, number)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    size = len(parts[0])
                refers = noted[2] if noted[:2] == (r["order"], r["digest"]) else None
                parts.append(page_record(r["page_id"], r["url"], r["payload"], r["digest"], refers))
                size += len(parts[-1])
                count += 1
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "records", "bytes", "sha256"])

    path = f"{folder.rstrip('/')}/_manifest"
    rows.mapInArrow(run, MANIFEST).write.json(path)
    return pages.sparkSession.read.schema(MANIFEST).json(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzipped WARC file."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                k, _, v = line.partition(b":")
                headers[k.decode().lower()] = v.strip().decode()
            block = f.read(int(headers["content-length"]))
            if headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                raise ValueError(f"block digest of {headers.get('warc-record-id')} differs")
            yield headers, block


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of every file in the manifest of ``folder``; payload is null for revisits."""
    folder = folder.rstrip("/")
    listed = spark.read.schema(MANIFEST).json(f"{folder}/_manifest")
    n = listed.count()
    if not n:
        return spark.createDataFrame([], RECORD)
    listed = listed.select("file", "sha256")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    files = content.join(F.broadcast(listed) if n <= BROADCAST_FILES else listed, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                name, data, digest = (batch.column(c)[i].as_py() for c in range(3))
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} is not the file that the manifest lists")
                out: list[tuple] = []
                held = 0
                for h, block in records(data):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    body = block.split(b"\r\n\r\n", 1)[1] if h["warc-type"] == "response" else None
                    want = h["warc-payload-digest"].removeprefix("sha256:")
                    if body is not None and (hashlib.sha256(body).hexdigest() != want or len(body) != int(h["x-payload-length"])):
                        raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
                    whole = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    out.append((whole("x-page-id"), h["warc-target-uri"], h["warc-type"], whole("x-refers-to-page-id"), int(h["x-payload-length"]), want, body))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return files.select("file", "content", "sha256").mapInArrow(run, RECORD)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new folder in the shared place and read the archives back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_warc(pages, folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
