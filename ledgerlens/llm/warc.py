"""WARC: a deterministic sharded writer, and a reader for what it wrote.

Writing takes three steps.

1. One pass computes length and SHA-1 of every payload. Among records with
   equal payloads the one with the largest id is the response, the others
   become revisits of it. Ids in order and their payload lengths, summed up,
   give the shard bounds: a function of the data alone, however Spark cut it.
2. Records go to their shard, sorted by id. The task writes gzip members (one
   per record, time stamp 0) to files, begins a new file when the compressed
   size reaches ``roll_bytes``, and regenerates headers and digests from the
   payload. A file is written under a temporary name and renamed when it is
   whole; a task that runs again writes the same bytes to the same name.
3. The files' names, sizes and checksums are committed as a manifest table, by
   Spark's own commit. Readers follow the manifest, so what a failed or
   repeated task left is never read.

Definitions: a null payload is empty. Rows with the same id and payload are
separate records: the first is what the id stands for, the others revisit it.
A null id sorts first and leaves out the id header. Only the columns named are
used; others do not matter. An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import new_folder, qualified, shuffle_partitions, stored

ROLL_BYTES = 64 << 20
MOST_SHARD_BYTES = 256 << 20
LEAST_SHARD_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
_MANIFEST = "shard long, part int, file string, records long, bytes long, crc32 long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}/{digest}/{copy}')}>"


def record(page: int | None, url: str | None, payload: bytes, copy: int, response: tuple[int | None, int] | None) -> bytes:
    """One WARC record. ``response``: (id, copy number) of the record that has
    the payload, for a revisit."""
    digest = payload_digest(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if response is None else b"")
    uri = "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in (url or "").encode("utf-8", "replace")) or "urn:x-none"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page, digest, copy)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if response is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_record_id(response[0], digest, response[1])}"]
        if response[0] is not None:
            lines.append(f"X-Refers-To-Page-ID: {response[0]}")
    lines += [f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)  # zlib writes no time stamp
    return c.compress(data) + c.flush()


class _Files:
    """The files of one shard, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.part, self.out, self.done = shard, roll_bytes, 0, None, []

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:08d}-{self.part:04d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.records, self.size, self.crc = self.fs.open_output_stream(self.temporary), 0, 0, 0
        self.out.write(member)
        self.records, self.size, self.crc = self.records + 1, self.size + len(member), zlib.crc32(member, self.crc)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append((self.shard, self.part, self.name, self.records, self.size, self.crc))
            self.out, self.part = None, self.part + 1


def _writer(folder: str, roll_bytes: int):
    """Rows (shard, id, digest, kind, response id, url, payload), sorted; per
    (shard, id, digest) the row of kind 0 tells the response's id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, copy, response = None, None, 0, None
        for batch in batches:
            for shard, page, digest, kind, head, url, payload in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield _manifest(files.done)
                    files = _Files(folder, shard, roll_bytes)
                if kind == 0:
                    key, copy, response = (page, digest), 0, head
                    continue
                if (page, digest) != key:
                    raise ValueError("a record came without its place among equal payloads")
                first = copy == 0 and response == page
                files.write(_member(record(page, url, payload or b"", copy, None if first else (response, 0))))
                copy += 1
        if files is not None:
            files.close()
            yield _manifest(files.done)

    return run


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "part", "file", "records", "bytes", "crc32"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payload = [p or b"" for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([payload_digest(p) for p in payload], pa.string()),
                                          pa.array([len(p) for p in payload], pa.int64())], ["id", "digest", "bytes"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, bytes, partition) -> with the bytes before each row in its partition."""
    before = 0
    for batch in batches:
        size = np.asarray(batch.column(1), np.int64)
        ends = before + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - size)], ["id", "bytes", "p", "before"])
        before = int(ends[-1]) if len(ends) else before


def shard_bounds(records: DataFrame, shard_bytes: int | None) -> list[int]:
    """The least id of every shard but the first.

    A shard begins with the first id at or after every multiple of the shard
    size, in bytes of payload in order of id. The default size is 1/64 of all,
    but between 1 MB and 256 MB; so there are 64 bounds or one per 256 MB.
    """
    spark = records.sparkSession
    order = records.select("id", "bytes").repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "bytes")
    order = order.withColumn("p", F.spark_partition_id()).mapInArrow(_running, "id long, bytes long, p int, before long")
    order = stored(order, "warc-order")
    sums = order.groupBy("p").agg(F.sum("bytes").alias("n")).orderBy("p").collect()  # one row per partition
    total = sum(r["n"] for r in sums)
    size = shard_bytes or min(MOST_SHARD_BYTES, max(LEAST_SHARD_BYTES, total // 64))
    offsets, at = [], 0
    for r in sums:
        offsets.append((r["p"], at))
        at += r["n"]
    ahead = F.broadcast(spark.createDataFrame(offsets, "p int, ahead long"))
    firsts = (order.join(ahead, "p").filter("id IS NOT NULL")
              .groupBy(F.floor((F.col("ahead") + F.col("before")) / size).alias("shard")).agg(F.min("id").alias("id")))
    return sorted({r["id"] for r in firsts.collect()})[1:]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               roll_bytes: int = ROLL_BYTES, shard_bytes: int | None = None) -> DataFrame:
    """Write one record per row under ``folder`` (a URI); returns the committed manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.col(payload_col).cast("string"), "UTF-8").alias("payload"))
    records = stored(rows.select("id", "payload").mapInArrow(_digests, "id long, digest string, bytes long"), "warc-digests")
    heads = stored(records.groupBy("digest").agg(F.max("id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("digest", "head"), "warc-heads")
    bounds = np.array(shard_bounds(records, shard_bytes), np.int64)  # at most 64, or one per 256 MB
    n = 1 + len(bounds)
    shared = spark.sparkContext.broadcast((bounds, places(spark, n)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, payload = batch.column(0), [p or b"" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*_shards(page, *shared.value), page, pa.array([payload_digest(p) for p in payload], pa.string()), pa.array(np.ones(len(page), np.int32)),
                 pa.nulls(len(page), pa.int64()), batch.column(1), pa.array(payload, pa.binary())],
                ["shard", "place", "id", "digest", "kind", "head", "url", "payload"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*_shards(batch.column(0), *shared.value), batch.column(0), batch.column(1), pa.array(np.zeros(n, np.int32)), batch.column(2),
                 pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], ["shard", "place", "id", "digest", "kind", "head", "url", "payload"])

    schema = "shard long, place long, id long, digest string, kind int, head long, url string, payload binary"
    known = records.select("id", "digest").join(heads, "digest", "left").select("id", "digest", F.coalesce("head", "id").alias("head")).distinct()
    both = rows.select("id", "url", "payload").mapInArrow(placed, schema).unionByName(known.mapInArrow(told, schema))
    both = both.repartition(n, "place").sortWithinPartitions("shard", "id", "digest", "kind", "url").drop("place")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    manifest = both.mapInArrow(_writer(folder, roll_bytes), _MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def places(spark: SparkSession, n: int) -> np.ndarray:
    """Per shard a number that ``repartition(n, ...)`` puts into the partition
    of the shard's number, so that no two shards meet in one task. (Numbers
    enough for every partition to be hit; a miss would cost balance only.)"""
    tried = spark.range(n * (20 + n.bit_length())).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
    out = np.arange(n, dtype=np.int64)
    for r in tried.toLocalIterator():
        out[r["at"]] = r["id"]
    return out


def _shards(page: pa.Array, bounds: np.ndarray, place: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Shard and place of every page id."""
    ids = np.array([v if v is not None else -(2**63) for v in page.to_pylist()], np.int64)
    shard = np.searchsorted(bounds, ids, side="right").astype(np.int64)
    return pa.array(shard), pa.array(place[shard])


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of a WARC file."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data))
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a WARC record")
        headers = {}
        while (line := stream.readline().decode("utf-8").rstrip("\r\n")):
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a WARC record ends early")
        yield headers, block


_READ = "file string, type string, record_id string, page_id long, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data, size, crc in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if len(data) != size or zlib.crc32(data) != crc:
                raise ValueError(f"{path} differs from its manifest")
            rows = []
            for h, block in parse(data):
                if payload_digest(block) != h["warc-block-digest"].removeprefix("sha1:"):
                    raise ValueError(f"{path}: block digest of {h['warc-record-id']}")
                http, _, payload = block.partition(b"\r\n\r\n")
                length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                number = lambda name, h=h: int(h[name]) if name in h else None
                rows.append((path, h["warc-type"], h["warc-record-id"], number("x-page-id"), h["warc-target-uri"], length,
                             h["warc-payload-digest"].removeprefix("sha1:"), number("x-refers-to-page-id"),
                             payload if h["warc-type"] == "response" else None))
                if len(rows) >= 2000:
                    yield _read_batch(rows)
                    rows = []
            yield _read_batch(rows)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) if rows else [[]] * 9, kinds, strict=True)], names)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files in the manifest; every file and block digest is
    checked. Revisits have no payload."""
    manifest = read_manifest(spark, folder)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))
    named = files.join(F.broadcast(manifest.select("file", "bytes", "crc32")), "file")  # one short row per file
    return named.select("file", "content", "bytes", "crc32").mapInArrow(_records, _READ)


def round_trip(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Write ``pages`` to a new folder of the shared store and read them back."""
    folder = qualified(pages.sparkSession, new_folder(pages.sparkSession, name))
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder)
