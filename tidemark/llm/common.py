"""Helpers shared by the operators: shipping the code, batches of text, samples."""

from __future__ import annotations

import ctypes
import functools
import gc
import io
import os
import zipfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import ensure_checkpoint_dir, scratch_path

#: Text that a Python worker handles at a time; one longer text makes a batch of its own.
BATCH_BYTES = 2 << 20
_TEXT = "__text"
#: Longer texts that a class of a training sample may hold, counted in the bytes of a short one.
LONG_TEXTS = 50


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes and give executors this package's code."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))
    context = spark.sparkContext
    if _shipped.get("to") != context.applicationId:
        _ship(context)
        _shipped["to"] = context.applicationId
    return spark


_shipped: dict[str, str] = {}


def _ship(context: SparkContext) -> None:
    package = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    target = Path(SparkFiles.getRootDirectory(), "package", "tidemark.zip")
    os.makedirs(target.parent, exist_ok=True)
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage there."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read them back."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def cut(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


_kept: dict[tuple[str, Hashable], object] = {}


def kept(owner: str, name: Hashable, make: Callable):
    """What a worker process keeps for later tasks of a module, made when first asked for."""
    if (owner, name) not in _kept:
        _kept[owner, name] = make()
    return _kept[owner, name]


def keep_only(owner: str) -> None:
    """Drop what other modules keep.  (A task's own function has copies of this module's names.)"""
    for other in [k for k in _kept if k[0] != owner]:
        del _kept[other]


def give_back() -> None:
    """Return memory that is free to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable, owner: str | None = None) -> Callable:
    """``run``, for ``mapInArrow``, in a process that holds what its module needs only.

    Operators of one job run in the same worker processes: a task first drops what other
    modules than ``owner`` (that of ``run``) keep, and gives back what it has freed when it
    ends, as the process then waits while the JVM beside it works.
    """
    owner = owner or run.__module__

    @functools.wraps(run)
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return done


def map_texts(
    frame: DataFrame, keep: list[str], text: str, outputs: T.StructType, start: Callable, *args
) -> DataFrame:
    """Columns ``keep`` and, for each row, the outputs worked out from its text.

    ``start(*args)`` runs once in each task and returns a function from a list of
    UTF-8 texts (``None`` for null) to one list or array for each output column.
    """
    prepare(frame.sparkSession)
    kept = T.StructType([T.StructField(f"k{i}", frame.schema[c].dataType) for i, c in enumerate(keep)])
    source = frame.select(
        *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)),
        F.col(f"`{text}`").cast("string").cast("binary").alias(_TEXT),
    )
    schema = T.StructType(kept.fields + [T.StructField(f"o_{f.name}", f.dataType) for f in outputs])
    arrow, width = to_arrow_schema(schema), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start(*args)
        for batch in batches:
            for part in cut(batch, width):
                made = work(part.column(width).to_pylist())
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(width)]
                columns += [
                    x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(width + i).type)
                    for i, x in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = source.mapInArrow(tidy(run, start.__module__), schema)
    names = [*keep, *(f.name for f in outputs)]
    return out.toDF(*names)


def keep_rows(frame: DataFrame, text: str, start: Callable, *args) -> DataFrame:
    """The rows, all columns as they were, whose text ``start(*args)`` accepts."""
    prepare(frame.sparkSession)
    schema = frame.schema
    arrow, at = to_arrow_schema(schema), schema.fieldNames().index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start(*args)
        for batch in batches:
            if pa.types.is_null(batch.column(at).type):
                part_texts = [(batch, [None] * batch.num_rows)]
            else:
                part_texts = (
                    (p, p.column(at).cast(pa.binary()).to_pylist()) for p in cut(batch, at)
                )
            for part, texts in part_texts:
                mask = pa.array(np.asarray(work(texts), dtype=bool))
                kept = part.filter(mask)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(i).cast(arrow.field(i).type) for i in range(len(arrow))],
                    schema=arrow,
                )

    return frame.mapInArrow(tidy(run, start.__module__), schema)


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, per_class: int,
    max_bytes: int, classes: list,
) -> list[tuple[bytes, object]]:
    """A bounded training sample: at most ``per_class`` texts of each class.

    Only labels whose text is there and not null count.  Texts of at most ``max_bytes``
    come first, in the order of a hash of their key; longer ones fill up what is left of
    ``per_class``, as long as they take ``LONG_TEXTS * max_bytes`` together at most.  So the
    driver holds ``(per_class + LONG_TEXTS) * max_bytes`` of each class at most.  A key with
    two labels takes the larger, with two texts the shorter, then the smaller.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(list(classes)))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).alias("label"))
    )
    most = LONG_TEXTS * max_bytes
    size = F.octet_length("text")
    usable = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(
        F.col("text").isNotNull() & (size <= max(max_bytes, most))
    )
    order = F.col("bytes") > max_bytes, F.xxhash64("key"), F.col("key")
    # keys and lengths only; each class is cut to per_class rows before the shuffle
    first = Window.partitionBy("label").orderBy(*order)
    long = F.when(F.col("bytes") > max_bytes, F.col("bytes")).otherwise(0)
    chosen = (
        usable.select("key", size.alias("bytes")).join(known, "key")
        .groupBy("key", "label").agg(F.min("bytes").alias("bytes"))
        .withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_class)
        .withColumn("long", F.sum(long).over(first)).where(F.col("long") <= most)
        .select("key", "label", "bytes")
    )
    # at most per_class rows a class: small enough to broadcast by construction
    rows = (
        usable.withColumn("bytes", size).join(F.broadcast(chosen), ["key", "bytes"])
        .groupBy("key", "label")
        .agg(F.min("text").alias("text"))
    )
    prepare(docs.sparkSession)
    found = rows.toPandas().sort_values("key", kind="stable")
    return [(t.encode(), y) for t, y in zip(found["text"], found["label"], strict=True)]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``starts[i] .. starts[i] + counts[i]``."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    """Adaptive-moment gradient steps over a list of arrays, in place."""

    def __init__(self, values: list[np.ndarray], rate: float) -> None:
        self.values, self.rate, self.step = values, rate, 0
        self.first = [np.zeros_like(v) for v in values]
        self.second = [np.zeros_like(v) for v in values]

    def __call__(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for v, g, m, s in zip(self.values, gradients, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            a, b = 1 - 0.9**self.step, 1 - 0.999**self.step
            v -= self.rate * (m / a) / (np.sqrt(s / b) + 1e-8)
