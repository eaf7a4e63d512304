"""WARC archives, index first.

Each row becomes a record of its own gzip member: `response` with an HTTP header and the payload, or, where an earlier
equal payload of at least `least_bytes` has a response, `revisit` with the HTTP header only, which keeps the payload's
length. Writing gives an index of file, offset, length, URL and digest of each record, as Parquet beside the archives.
Reading starts from the index: the selected records are dealt out by file and stretch, sorted by offset, and
neighbours are read in one range each before they are cut into records again.

Null html is an empty payload, a null url is "about:blank", a null page_id is written empty and never a reference
while a page with an id has the payload. Rows of one page_id and payload are alike: all responses, or all revisits.
An empty table gives an empty index. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, materialise, scratch, shuffle_partitions
from .common import open_fs

#: Records this near are read together; a stretch of a file is read by one task.
GAP, STRETCH, LEVEL = 64 << 10, 8 << 20, 1
#: Payloads that more than one in HOT of all pages has are joined apart.
HOT = 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def classified(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with the same payload, for rows that revisit it."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("_sha1"))
    first = rows.select("page_id", "_sha1").groupBy(F.col("_sha1").alias("_same")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialise(first, "payloads")
    # at most HOT payloads have a part of all pages that is over 1 / HOT; their pages stay where they are
    total = first.agg(F.sum("_n")).first()[0] or 0
    hot = first.where(F.col("_n") * HOT > total).select(F.col("_same").alias("_hot"), F.col("_first").alias("_hot_first"), F.lit(True).alias("_is_hot"))
    # ids only meet their payload's first page; the pages themselves are joined by id and payload
    ids = rows.select(F.col("page_id").alias("_id"), F.col("_sha1").alias("_of")).distinct()
    ids = ids.join(F.broadcast(hot), F.col("_of") == F.col("_hot"), "left")
    key = F.when(F.col("_is_hot"), F.concat_ws(":", F.lit("hot"), F.col("_id").cast("string"))).otherwise(F.col("_of"))
    rest = first.where(F.col("_n") * HOT <= total).drop("_n")
    ids = ids.withColumn("_key", key).join(rest, F.col("_key") == F.col("_same"), "left")
    ids = ids.select("_id", "_of", F.coalesce("_first", "_hot_first").alias("_first"))
    rows = rows.join(ids, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha1") == F.col("_of")), "left")
    again: Column = (F.col("page_id").isNull() | (F.col("page_id") > F.col("_first"))) & F.col("_first").isNotNull()
    return rows.select("page_id", "url", "html", F.when(again & (F.octet_length("html") >= least_bytes), F.col("_first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """One record and its payload's digest."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    uri = " ".join((url or "about:blank").split()) or "about:blank"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page {page_id} {digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-Id: {'' if page_id is None else page_id}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        target = uuid.uuid5(uuid.NAMESPACE_URL, f"page {refers_to} {digest}")
        head[-1:-1] = [f"WARC-Refers-To: <urn:uuid:{target}>", f"WARC-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """What a record says; the payload's bytes and digest are measured where it is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != said or base32_sha1(payload) != digest):
        raise ValueError(f"record of {fields['WARC-Target-URI']} is damaged")
    ids = [fields.get(k) for k in ("WARC-Page-Id", "WARC-Refers-To-Page-Id")]
    page_id, refers_to = (int(x) if x else None for x in ids)
    return {"page_id": page_id, "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": said, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers_to}


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for b in batches:
            if out is None:
                store, path = open_fs(uri)
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(path, compression=None)
            members, rows = [], []
            for page_id, url, html, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                data, digest = record(page_id, url, html.encode(), ref, date)
                members.append(gzip.compress(data, LEVEL, mtime=0))
                rows.append((uri, at, len(members[-1]), url, digest, page_id, "response" if ref is None else "revisit"))
                at += len(members[-1])
            out.write(b"".join(members))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    return run


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write the archives and their index under `folder`; returns the index, read back.

    A file carries its task attempt; only files of attempts that ended well are in the index.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = classified(pages, least_bytes)
    rows.mapInArrow(_write(f"{folder}/archive", date), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """(file, offset, bytes, first row, last row + 1) of coalesced reads over rows sorted by file and offset."""
    a = 0
    for z in range(1, len(rows) + 1):
        start, last = rows[a], rows[z - 1]
        if z < len(rows) and rows[z][0] == start[0] and rows[z][1] - (last[1] + last[2]) <= GAP and rows[z][1] + rows[z][2] - start[1] <= STRETCH:
            continue
        yield start[0], start[1], last[1] + last[2] - start[1], a, z
        a = z


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, source = None, None
    for b in batches:
        rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        for name, at, n, a, z in _ranges(rows):
            if name != file:
                store, path = open_fs(name)
                file, source = name, store.open_input_file(path)
            block = source.read_at(n, at)
            found = [parse(zlib.decompress(block[o - at : o - at + m], 31)) for _, o, m in rows[a:z]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f["page_id"] for f in found], pa.int64()),
                    pa.array([f["url"] for f in found], pa.string()),
                    pa.array([f["payload"] for f in found], pa.binary()).cast(pa.string()),
                    pa.array([f["payload_bytes"] for f in found], pa.int64()),
                    pa.array([f["payload_digest"] for f in found], pa.string()),
                    pa.array([f["record_type"] for f in found], pa.string()),
                    pa.array([f["refers_to"] for f in found], pa.int64()),
                ],
                names=["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )


RECORD = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(index: DataFrame) -> DataFrame:
    """The records of the selected rows of an index."""
    spark = index.sparkSession
    bounded_batches(spark)
    rows = index.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("_part"))
    rows = rows.repartition(shuffle_partitions(spark), "file", "_part").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_read, RECORD)


def default_folder(spark) -> str:
    return scratch(spark, "warc")
