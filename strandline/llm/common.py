"""Shared plumbing of the training-data operators: scratch folders, text blocks and appended columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.words import forget_powers

#: Bytes of text that the vectorised scanners hold at once; one longer text forms a block of its own.
BLOCK_BYTES = 1 << 20


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder in the one that every executor shares (``spark.checkpoint.dir``).

    Where none is named, a session within one process, as in tests, gets a temporary one; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:  # a bare path is one of Spark's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = "file://" + root[5:] if root.startswith("file:/") and not root.startswith("file://") else root
    return f"{root.rstrip('/')}/strandline-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them must have been written elsewhere."""
    remove_path(spark, scratch_root(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder, and its path; that cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written by :func:`stored` and read back."""
    return stored(df, label)[0]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Give freed memory back to the system; workers live on after a task, and would hold it beside the next stage's."""
    forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(scan: Callable, *broadcasts: Broadcast) -> Callable:
    """A scan of Arrow batches that ends with :func:`release`.

    What it has read of ``broadcasts`` goes as well, as workers without a task would hold it beside those that have one; the
    next task reads it anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            for x in broadcasts:
                vars(x).pop("_value", None)
            release()

    return run


def shrink_heaps(spark: SparkSession) -> None:
    """Let every executor's JVM collect its garbage and give free heap back to the system, as :func:`release` does for workers.

    A heap stays as large as an earlier stage has made it, beside the Python workers of the next.
    """
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Limits Arrow batches to ``rows`` for what runs inside; the session's own limit holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    own = int(before)
    spark.conf.set(name, str(min(own, rows) if own > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh_name(stem: str) -> str:
    """A column name that no caller's column bears."""
    return f"_{stem}_{uuid.uuid4().hex}"


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves no remainder by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the int64 offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES, most_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) so that a block holds whole texts of about ``block_bytes``, and at
    most ``most_rows``."""
    raw, offs = string_buffers(column)
    rows, first = len(offs) - 1, 0
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + block_bytes, side="right")) - 1)
        end = min(end, rows, first + most_rows)
        yield first, end, raw[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def cut_text(text: str, ranges: list[tuple[int, int]], mask: str = "") -> str:
    """``text`` with the union of half-open ``ranges`` of characters taken out, or ``mask`` in place of each piece of it.

    Ranges that overlap are one piece; those that only touch are two.
    """
    out, at = [], 0
    for a, b in sorted(ranges):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def append_columns(df: DataFrame, fields: list[T.StructField], scan: Callable[[pa.RecordBatch], list[pa.Array]], needs: str) -> DataFrame:
    """Run ``scan`` over Arrow batches and append its arrays as ``fields``.

    Input columns that bear a name of ``fields``, in either case, are replaced, unless it is ``needs``, the column that
    is scanned. ``scan`` is built once per task by calling it through a zero-argument factory.
    """
    names = {f.name.lower() for f in fields}
    if needs.lower() in names:
        raise ValueError(f"the scanned column {needs!r} bears the name of a result column")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = T.StructType([*df.schema.fields, *fields])
    kept = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = scan()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *work(batch)], names=schema.names)

    return df.mapInArrow(releasing(run), schema)
