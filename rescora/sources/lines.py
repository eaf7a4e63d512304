"""Spark data sources for text of one header: byte ranges of many files, and one file in order.

`match-lines` reads the lines of tab-separated files that begin with a header. Its plan cuts files into byte ranges; a
range has the lines that begin in it, whatever the other ranges are, so a line's offset is known where it is read, and
the number of its file and its offset are an id without any shuffle. Options: files (JSON of path, bytes and the
offset of the first line after the header, in order), first (the first file's number) and range (bytes). Files whose names end as compressed ones do are one range each.

`ordered-text` writes the `value` column of range-sorted partitions as one file: tasks write parts beside it, and the
commit joins them in order and moves the whole to its place; an aborted write deletes what there is.

Both go through Arrow's file systems, so a path needs a scheme that Arrow knows (local files, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range, of a read, and the most lines of a batch.
RANGE, READ, BATCH = 64 << 20, 4 << 20, 4096
#: Bits of an offset in a row's id; a file's number is above them.
OFFSET_BITS = 42
PACKED = (".gz", ".bz2", ".zst", ".lz4")
# Fixed value: how a line of default directions begins.
DIRECTION = b"DefaultDirection"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def _chunks(uri: str, at: int) -> Iterator[bytes]:
    """The file's bytes from `at` on."""
    store, path = open_fs(uri)
    if uri.endswith(PACKED):
        with store.open_input_stream(path, compression="detect") as f:
            while block := f.read(READ):
                yield block
        return
    with store.open_input_file(path) as f:
        f.seek(at)
        while block := f.read(READ):
            yield block


def lines_of(uri: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each line that begins in [start, end), without its end; no end: all that follow."""
    if uri.endswith(PACKED):
        yield from ((at, line) for at, line in _split(_chunks(uri, 0), 0, False, end) if at >= start)
    else:
        # from the byte before on, so that a line that begins at start is seen to begin
        yield from _split(_chunks(uri, max(start - 1, 0)), max(start - 1, 0), start > 0, end)


def _split(blocks: Iterator[bytes], at: int, skip: bool, end: int | None) -> Iterator[tuple[int, bytes]]:
    rest = b""
    for block in blocks:
        rest += block
        own = rest.split(b"\n")
        rest = own.pop()
        for line in own:
            if not skip:
                if end is not None and at >= end:
                    return
                yield at, line.removesuffix(b"\r")
            skip = False
            at += len(line) + 1
        if end is not None and at >= end and not skip:
            return
    if rest and not skip and (end is None or at < end):
        yield at, rest.removesuffix(b"\r")


def head_of(uri: str) -> tuple[str | None, str | None, int]:
    """The header, the line of default directions if the first line with anything in it is one, and where the rest begins."""
    found = lines_of(uri, 0, None)
    header = next(found, None)
    if header is None:
        return None, None, 0
    first = next(((at, line) for at, line in found if line), None)
    if first is None:
        return header[1].decode(errors="replace"), None, header[0] + len(header[1]) + 1
    if not first[1].startswith(DIRECTION):
        return header[1].decode(errors="replace"), None, first[0]
    after = next(found, None)
    return header[1].decode(errors="replace"), first[1].decode(errors="replace"), after[0] if after else first[0] + len(first[1]) + 1


@dataclass
class ByteRange(InputPartition):
    number: int
    path: str
    start: int
    end: int | None


class MatchLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "match-lines"

    def schema(self) -> str:
        return "number int, file string, row_id long, value string"

    def reader(self, schema) -> MatchLinesReader:
        return MatchLinesReader(self.options)


class MatchLinesReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.first, self.range = json.loads(options["files"]), int(options.get("first", 0)), int(options.get("range", RANGE))

    def partitions(self) -> list[ByteRange]:
        out = []
        for number, (path, size, body) in enumerate(self.files, self.first):
            if path.endswith(PACKED):
                out.append(ByteRange(number, path, body, None))
            else:
                out += [ByteRange(number, path, at, min(at + self.range, size)) for at in range(body, size, self.range)]
        # a table without lines is one empty range
        return out or [ByteRange(self.first, "", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        for at, line in lines_of(part.path, part.start, part.end) if part.path else ():
            if line:
                held.append((at, line))
            if len(held) == BATCH:
                yield _batch(part, held)
                held = []
        if held:
            yield _batch(part, held)


def _batch(part: ByteRange, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(held)
    if held[-1][0] >> OFFSET_BITS:
        raise ValueError(f"{part.path} is longer than row ids allow")
    ids = [part.number << OFFSET_BITS | at for at, _ in held]
    text = [line.decode(errors="replace") for _, line in held]
    return pa.RecordBatch.from_arrays([pa.array([part.number] * n, pa.int32()), pa.array([part.path] * n, pa.string()), pa.array(ids, pa.int64()), pa.array(text, pa.string())], names=["number", "file", "row_id", "value"])


def read_lines(spark: SparkSession, files: list[tuple[str, int, int]], first: int = 0, bytes_: int = RANGE) -> DataFrame:
    """number, file, row_id and value of all lines with anything in them after the headers of (path, bytes, offset)."""
    if first + len(files) > 1 << (63 - OFFSET_BITS):
        raise ValueError(f"{len(files)} files are more than row ids allow")
    spark.dataSource.register(MatchLines)
    return spark.read.format("match-lines").options(files=json.dumps(files), first=first, range=bytes_).load()


@dataclass
class Part(WriterCommitMessage):
    order: int
    path: str


class OrderedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered-text"

    def writer(self, schema, overwrite: bool) -> OrderedTextWriter:
        return OrderedTextWriter(self.options, overwrite)


class OrderedTextWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"], options.get("header"), overwrite
        self.folder = f"{self.path}.parts-{options['run']}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        store, folder = open_fs(self.folder)
        store.create_dir(folder, recursive=True)
        path = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with store.open_output_stream(path, compression=None) as out:
            for b in batches:
                out.write("".join(f"{v}\n" for v in b.column("value").to_pylist()).encode())
        return Part(task.partitionId(), path)

    def commit(self, messages: list[Part | None]) -> None:
        store, path = open_fs(self.path)
        _, folder = open_fs(self.folder)
        store.create_dir(folder, recursive=True)
        whole = f"{folder}/whole"
        with store.open_output_stream(whole, compression=None) as out:
            if self.header:
                out.write(f"{self.header}\n".encode())
            for part in sorted((m for m in messages if m), key=lambda m: m.order):
                with store.open_input_stream(part.path, compression=None) as f:
                    while block := f.read(READ):
                        out.write(block)
        if store.get_file_info(path).type != fs.FileType.NotFound and not self.overwrite:
            store.delete_dir(folder)
            raise FileExistsError(f"{self.path} is there already")
        store.move(whole, path)
        store.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = open_fs(self.folder)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


def write_ordered(rows: DataFrame, path: str, header: str | None = None, overwrite: bool = False) -> None:
    """`value` of the rows, in the order of their partitions and within them, as one file."""
    rows.sparkSession.dataSource.register(OrderedText)
    options = {"run": uuid.uuid4().hex} | ({} if header is None else {"header": header})
    rows.select("value").write.format("ordered-text").mode("overwrite" if overwrite else "append").options(**options).save(path)
