"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import posixpath
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: What separates words everywhere in this subpackage: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a character class for Java and Python regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Texts handed to a Python function at once, in bytes; one longer text goes alone.
SLICE_BYTES = 2 << 20
#: Tasks that write a table of few rows at most; a table of more rows has a task for each TASK_ROWS of them.
FEW_TASKS, TASK_ROWS = 24, 4000


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for an executor with two Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, or the context's checkpoint folder; without either, below a temporary folder of a local session only.

    The folder stays until its user removes it, because lazily read results depend on it.
    """
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagequarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df, written once to the shared folder and read back: later jobs start from the files, also after executors are lost.

    rows: about so many rows it was derived from. A few are written by a few tasks, however many partitions a shuffle has: each
    file costs an executor several processes where Hadoop has no native library.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    (df if rows is None else df.coalesce(max(FEW_TASKS, rows // TASK_ROWS))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Removes the files of materialised frames that no later job reads."""
    for df in written:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of frames that nothing refers to any more; it does when the driver collects its garbage."""
    for _ in range(2):  # the driver hears of frames that Python has dropped a moment later
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


_remembered: dict[str, Callable[[], None]] = {}


def only(operator: str, forget: Callable[[], None] | None = None) -> None:
    """A Python worker, which serves one stage after another, remembers the tables of one operator at a time: those of others are forgotten."""
    for other in [o for o in _remembered if o != operator]:
        _remembered.pop(other)()
    if forget is not None:
        _remembered[operator] = forget


def open_filesystem(uri: str):
    """(Arrow file system, path) of a shared folder; executors write their files by it."""
    from pyarrow import fs

    if "://" not in uri:
        uri = ("file://" if uri.startswith("/") else "") + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def publish(filesystem, path: str, write: Callable) -> None:
    """write(stream) to a name of its own, then rename: a lost or doubled task never leaves half a file under path."""
    filesystem.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part, compression=None) as out:
        write(out)
    filesystem.move(part, path)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about limit bytes each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start, n = np.cumsum(sizes), 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def with_columns(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType, pa.DataType]], make: Callable[[], Callable[[list], list]], keep_text: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """df with columns that a Python function derives from text_col.

    make() is called once per task and gives a function from a list of texts (None for null) to one list per field.
    A column of df that has a field's name is replaced. Without keep_text, texts are not sent back. Texts of slice_bytes come at once.
    """
    bounded_batches(df.sparkSession)
    taken = {name.lower() for name, _, _ in fields}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
    at = [c.lower() for c in base.columns].index(text_col.lower())
    kept = [i for i in range(len(base.columns)) if keep_text or i != at]
    schema = T.StructType([*(base.schema.fields[i] for i in kept), *(T.StructField(n, t) for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for lo, hi in slices(batch.column(at), slice_bytes):
                part = batch.slice(lo, hi - lo)
                made = work(part.column(at).to_pylist())
                arrays = [pa.array(values, type=kind) for values, (_, _, kind) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *arrays], names=schema.names)

    return base.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Words of a text between SPACES; 0 for null or blank texts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_CLASS.replace("[", "[^") + "+")).cast("long")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file by its name; an existing path stays as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
