"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that a Python worker holds at once beyond its incoming batch.
SLICE_BYTES = 4 << 20
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditspark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that would clash (Spark compares names without case) with new ones."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Consecutive row ranges of a batch whose text stays near `limit` bytes; one row at least."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start), values.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start), values.slice(start).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Let fewer rows go to a Python worker at once where the session has Spark's default: ten thousand long texts would
    fill a worker."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")


def append_columns(
    df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list[list]]], fields: list[T.StructField]
) -> DataFrame:
    """Add columns computed in Arrow batches from one text column, keeping all others.

    `make` runs once per task and returns a function from a list of texts (None for null) to one list of
    values per new field; what it holds goes with the task, and its `done`, if it has one, is called at the end. Existing columns with the names of new fields are replaced.
    """
    out = T.StructType([*without(df, [f.name for f in fields]).schema.fields, *fields])
    source = df
    if text_col.lower() in {f.name.lower() for f in fields}:
        raise ValueError("an output column may not replace the text column")
    source = without(df, [f.name for f in fields])
    added = to_arrow_schema(T.StructType(fields))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part, texts in slices(batch, text_col):
                new = [pa.array(v, type=added.field(i).type) for i, v in enumerate(apply(texts))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *new], schema=pa.schema([*part.schema, *added])
                )
                del new
        getattr(apply, "done", lambda: None)()
        apply = None
        trim()

    return source.mapInArrow(run, out)


def trim(cycles: bool = True) -> None:
    """Give a Python worker's free memory back to the system: workers outlive tasks, and two share an executor.

    Without `cycles` only what nothing refers to any more; that is enough for arrays, and quick.
    """
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle and checkpoint files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
