"""What the document operators share: word counts, files in the shared folder, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI in the shared folder; works for any scheme that Arrow knows."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def write_atomically(uri: str, attempt: str, write) -> None:
    """Call write(stream) on a file of this attempt, then move it to its place: a retried task leaves whole files."""
    store, path = open_fs(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{attempt}.part"
    with store.open_output_stream(own, compression=None) as out:
        write(out)
    store.move(own, path)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for x in column.cast(pa.binary()).to_pylist():
        yield x or b""
