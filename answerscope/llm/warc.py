"""WARC archives: write pages as records, normalise monolithic gzip files, read them back by index.

Writers often put a whole archive into one gzip stream, which can only be read from its
start. ``normalise`` inflates such a file once, as a stream, and writes every record as a
gzip member of its own, with a sidecar index (one JSON line for each record: page, offset,
length). A record can then be read, and a failed read repeated, without the rest of the file.

Files hold ``FILE_BYTES`` of payload at most (or one record). They go to the folder that all
machines share, under names with the task attempt in them, and a table written by Spark
lists those of the attempts that counted; a task run twice leaves a file that nobody reads.

Records with equal payloads (by SHA-1 and length) of ``MIN_REVISIT`` bytes or more are
stored once, by the row with the largest page_id; the others are revisits without payload.
Nulls: a null html is an empty payload, a null url leaves the target header out. A null
page_id is smaller than any other; where a group has no page_id at all, every row is a
response. Rows repeated with the largest page_id are all responses. An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm.common import Scratch, shared_folder, table

MIN_REVISIT = 1000
FILE_BYTES = 32 << 20
LEVEL = 6
DATE = "2020-01-01T00:00:00Z"  # pages carry no time of capture
BLOCK_END = b"\r\n\r\n"
_FILES = pa.schema([("path", pa.string()), ("records", pa.int64())])


def _files(uri: str):
    """File system and path of a shared folder's URI; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + BLOCK_END + block + BLOCK_END


def _headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def read_record(record: bytes) -> dict:
    """Fields of one record: page_id, kind, refers_to, digest, payload_bytes and payload (None for a revisit)."""
    head, _, rest = record.partition(BLOCK_END)
    fields = _headers(head)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(BLOCK_END)
    number = lambda text: None if text is None or text == "<urn:page:None>" else int(text[len("<urn:page:"):-1])
    kind = fields["WARC-Type"]
    digest, size = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), int(_headers(http)["Content-Length"])
    if kind != "revisit" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "kind": kind, "refers_to": number(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"),
        "digest": digest, "payload_bytes": size, "payload": None if kind == "revisit" else payload}


def records_of(stream: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Whole records of a gzip stream, one member or many, inflated piece by piece."""
    inflate, held = zlib.decompressobj(wbits=31), bytearray()
    ended = False
    while not ended or held:
        head = held.find(BLOCK_END)
        if head >= 0:
            end = head + len(BLOCK_END) + int(_headers(bytes(held[:head]))["Content-Length"]) + len(BLOCK_END)
            if len(held) >= end:
                yield bytes(held[:end])
                del held[:end]
                continue
        if ended:
            raise ValueError("archive ends inside a record")
        data = stream.read(chunk)
        ended = not data
        while data:
            held += inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(wbits=31)


class _Archive:
    """One gzip stream over many records."""

    def __init__(self, folder: str, name: str):
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        self.path, self.records, self.held = f"{folder}/{name}", 0, 0
        self.out, self.deflate = files.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)

    def add(self, record: bytes) -> None:
        self.out.write(self.deflate.compress(record))
        self.records, self.held = self.records + 1, self.held + len(record)

    def close(self) -> tuple[str, int]:
        self.out.write(self.deflate.flush())
        self.out.close()
        return self.path, self.records


def _attempt() -> str:
    context = TaskContext.get()
    return f"part-{context.partitionId():05d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    paths, counts = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], schema=_FILES)


def write_archives(records: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Rows of (page_id, url, payload, digest, kind, refers_to) to monolithic archives; (path, records) of each."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, name, count = None, _attempt(), 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "kind", "refers_to")), strict=True):
                record = record_bytes(*row)
                if archive and archive.held + len(record) > FILE_BYTES:
                    yield _listed([archive.close()])
                    archive = None
                if archive is None:
                    archive, count = _Archive(folder, f"{name}-{count:04d}.warc.gz"), count + 1
                archive.add(record)
        if archive:
            yield _listed([archive.close()])

    return scratch.keep(records.mapInArrow(write, "path string, records bigint"))


def normalise_file(path: str, folder: str, name: str) -> tuple[str, int]:
    """Rewrite an archive with one member for each record, and its index beside it."""
    source, at = _files(path)
    files, to = _files(folder)
    files.create_dir(to, recursive=True)
    count = offset = 0
    with source.open_input_stream(at, compression=None) as stream, files.open_output_stream(f"{to}/{name}.warc.gz", compression=None) as out, \
            files.open_output_stream(f"{to}/{name}.index", compression=None) as index:
        for record in records_of(stream):
            deflate = zlib.compressobj(LEVEL, wbits=31)
            member = deflate.compress(record) + deflate.flush()
            out.write(member)
            index.write(json.dumps({"page": _headers(record.partition(BLOCK_END)[0])["WARC-Record-ID"], "offset": offset, "length": len(member)}).encode() + b"\n")
            offset, count = offset + len(member), count + 1
    return f"{folder}/{name}", count


def normalise(archives: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """(path, records) of the normalised archives; ``path`` + ``.warc.gz`` and ``.index``."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, count = _attempt(), 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield _listed([normalise_file(path, folder, f"{name}-{count:04d}")])
                count += 1

    spread = max(archives.sparkSession.sparkContext.defaultParallelism, archives.count())
    return scratch.keep(archives.repartition(spread, "path").mapInArrow(rewrite, "path string, records bigint"))


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, at = _files(path)
            with files.open_input_stream(f"{at}.index", compression=None) as index:
                entries = [json.loads(x) for x in index.read().splitlines()]
            with files.open_input_file(f"{at}.warc.gz") as archive:
                for k in range(0, len(entries), 500):
                    rows = []
                    for entry in entries[k:k + 500]:
                        archive.seek(entry["offset"])
                        r = read_record(zlib.decompress(archive.read(entry["length"]), wbits=31))
                        rows.append((r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["digest"], r["kind"], r["refers_to"]))
                    columns = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                     names=["page_id", "url", "payload", "payload_bytes", "digest", "kind", "refers_to"])


def read_archives(normalised: DataFrame) -> DataFrame:
    """All records of normalised archives, each read at its offset."""
    spread = max(normalised.sparkSession.sparkContext.defaultParallelism, normalised.count())
    return normalised.repartition(spread, "path").mapInArrow(
        _read_rows, "page_id bigint, url string, payload binary, payload_bytes bigint, digest string, kind string, refers_to bigint")


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to): which rows store their payload and which refer to another."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    large = rows.where(F.col("size") >= MIN_REVISIT)
    groups = large.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("holder")).where("n > 1 AND holder IS NOT NULL")
    joined = rows.join(groups.select("digest", "size", "holder"), ["digest", "size"], "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("holder")).alias("refers_to"))


def op5_warc_normalise(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "op5")
    base = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(page_records(table(spark, folder, "pages", "page_id", "url", "html")), f"{base}/raw", scratch)
    records = read_archives(normalise(archives, f"{base}/members", scratch))
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to FROM g"""

QUERIES = {"op5_warc_normalise": op5_warc_normalise}
ORACLES = {"op5_warc_normalise": _SQL}
