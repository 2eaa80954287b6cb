"""What the operators of this package share: scratch tables, size checks, batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and found below this many bytes.
BROADCAST_BYTES = 32 << 20
#: Text handled at once by a vectorised step inside a task.
CHUNK_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where none is named and no other machine takes part."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fathomlog-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/fathomlog-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


#: Folders written within each open ``scratch_scope``.
_scopes: list[list[str]] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the scratch folders that are written within it, but for those of the materialized frames put on the list that it yields.

    For steps whose result is materialized: what led there is read no more. Shuffles of frames that are gone are dropped, too, which Spark
    does as the driver collects garbage.
    """
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        own, stays = _scopes.pop(), {df._scratch for df in kept}
        if _scopes:
            _scopes[-1].extend(stays)
        _delete(spark, [p for p in own if p not in stays])
        gc.collect()
        spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete the folders of materialized frames that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, [df._scratch])


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` into the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._scratch = path
    return held


def broadcast_if_small(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialized ``df`` for broadcast if its counted rows fit ``limit``; else leave it to a shuffle."""
    return F.broadcast(df) if df.count() * bytes_per_row <= limit else df


def with_text(df: DataFrame, text: str) -> DataFrame:
    """The column under its own name as a string, nulls as the empty text."""
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores after them as far as ``df`` has columns so called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        start, held = 0, 0
        lengths = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def release() -> None:
    """Hand memory that is free but held by allocators back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, freeing memory as its task ends: Spark keeps workers, and what each kept would add up from stage to stage."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def pack(raw: bytes, level: int = 1) -> bytes:
    """Compressed bytes that know their size."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def with_packed_text(df: DataFrame, text: str) -> DataFrame:
    """``df`` with its text packed, null for null, so that a shuffle moves less than half of it."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            packed = pa.array([None if t is None else pack(t.encode()) for t in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if n == text else batch.column(n) for n in names], names)

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn(text, F.col(text).cast("string")).mapInArrow(released(run), schema)
