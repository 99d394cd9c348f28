"""Shared folder, materialised tables and packed-array helpers of the operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


#: What one Arrow batch between the JVM and a Python worker may hold while a table is written; texts differ in length by orders, so rows alone don't bound memory.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for the actions inside; the session's own settings are put back."""
    before = {key: spark.conf.get(key) for key in BATCH}
    try:
        for key, value in BATCH.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table is deleted when the application ends, or earlier by ``settled``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with bounded_batches(spark):
        df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    for scope in _scopes.get():
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of ``make`` as a written table; all tables that were written on the way to it are deleted."""
    own: list[str] = []
    outer = _scopes.get()
    token = _scopes.set((*outer, own))
    try:
        made = make()
        _scopes.set(outer)
        kept = materialize(made, name)
    finally:
        _scopes.reset(token)
    for path in own:
        discard(made.sparkSession, path)
    return kept


def discard(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Hand freed memory back to the system: workers are reused and would keep the most that any task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``; memory is released when a task ends."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def group_arrow(df: DataFrame, key: str, run: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """``applyInArrow`` by one key; memory is released after a group."""

    def lean(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            release()

    return df.groupBy(key).applyInArrow(lean, schema)


def cogroup_arrow(left: DataFrame, right: DataFrame, key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``applyInArrow`` on both sides' rows of one key; memory is released after a group."""

    def lean(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return run(a, b)
        finally:
            release()

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(lean, schema)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, exactly; sizes sketches and bucket counts."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def hash01(column, salt: str):
    """A uniform number in [0, 1) that depends on the value alone; the same in DuckDB (see ``hash01_sql``)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash01_sql(column: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || coalesce({column}::varchar, '')), 1, 8))::bigint / 4294967296.0::double)"


def split_batch(batch: pa.RecordBatch, texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``texts`` hold about ``max_bytes``, so that what a task holds at once is bounded; a row is never split."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + max_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


def row_blocks(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of consecutive rows whose ``column`` holds ``max_bytes`` or, for the last, what is left. Only the rows decide where a block ends, not the batches."""
    held, size, number = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < len(sizes):
            before = int(sizes[at - 1]) if at else 0
            end = int(np.searchsorted(sizes, before + max_bytes - size)) + 1
            held.append(batch.slice(at, end - at))
            size += int(sizes[min(end, len(sizes)) - 1]) - before
            at = end
            if end <= len(sizes):
                yield number, pa.Table.from_batches(held).combine_chunks()
                held, size, number = [], 0, number + 1
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


_GAP_KINDS = {1: (255, np.uint8), 2: (65535, np.uint16), 4: (2**32 - 1, np.uint32)}


def pack_gaps(sorted_positions: np.ndarray) -> bytes:
    """Sorted integers as gaps of one, two or four bytes by their mean; a gap over the base is written as repeated base marks."""
    if not len(sorted_positions):
        return b"\x00"
    gaps = np.diff(sorted_positions.astype(np.int64), prepend=0)
    mean = float(gaps.mean())
    width = 1 if mean < 350 else 2 if mean < 60_000 else 4  # about where marks cost as much as wider gaps
    base, kind = _GAP_KINDS[width]
    marks, rest = np.divmod(gaps, base)
    out = np.full(int(marks.sum()) + len(gaps), base, kind)
    out[np.cumsum(marks + 1) - 1] = rest
    return bytes([width]) + out.tobytes()


def unpack_gaps(blob: bytes) -> np.ndarray:
    """The inverse of ``pack_gaps``."""
    if blob[0] == 0:
        return np.empty(0, np.int64)
    base, kind = _GAP_KINDS[blob[0]]
    out = np.frombuffer(blob, kind, offset=1)
    return np.cumsum(out, dtype=np.int64)[out != base]


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as differences of the least width that holds them, after a byte for the width; cheap for rising ids."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    far = max(abs(int(steps.min())), abs(int(steps.max()))) if len(steps) else 0
    width = next(w for w in (1, 2, 4, 8) if w == 8 or far < 1 << (8 * w - 1))
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpack_ints(blob: bytes) -> np.ndarray:
    """The inverse of ``pack_ints``."""
    return np.cumsum(np.frombuffer(blob, f"<i{blob[0]}", offset=1), dtype=np.int64)


def blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
