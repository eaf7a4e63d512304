"""Session services every operator shares: the shared folder, written tables and Arrow batch limits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches handed to Python hold at most so many bytes and rows, so that a run of very long texts stays small.
ARROW_BYTES, ARROW_ROWS = 4 << 20, 4096

#: Whether Spark deletes the shuffle files of a plan once it has run, and not only when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}
_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and one process runs everything, a temporary folder is made, once per application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="rescora-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rescora/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under a folder of this application that goes when its Python ends."""
    folder = _own_folder(spark)
    if folder not in _swept:
        _swept.add(folder)
        atexit.register(_at_end, spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete every scratch table and file of this application; results that read them must be written before."""
    _delete(spark, _own_folder(spark))


def _at_end(spark: SparkSession) -> None:
    with suppress(Exception):  # a context that was stopped already can't reach the store; its folder stays
        sweep(spark)


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more, such as those of a finished round."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            _delete(t.sparkSession, path)


def materialise(df: DataFrame, name: str, compression: str = "uncompressed") -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there and survives lost executors.

    Tables of ids and hashes hardly compress, and each compressed column of each file takes memory outside the heap.
    What was shuffled for the table goes once it is written: nothing else reads the plan of a write.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators in this session; lower bounds of the caller stay.

    Spark reads these settings when a plan runs, after the operator has returned, so they can't be put back here.
    """
    for name, most in (("maxBytesPerBatch", ARROW_BYTES), ("maxRecordsPerBatch", ARROW_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def ipc_bytes(b: pa.RecordBatch) -> bytes:
    """An Arrow batch as one value, whatever the types of its columns."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as out:
        out.write_batch(b)
    return sink.getvalue().to_pybytes()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
