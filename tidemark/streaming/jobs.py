"""Incremental jobs.

Every job is a file-source stream with its own checkpoint, so a file is read
once however often the job runs.  File order is not event order, so no result
depends on a watermark: batches go into stored tables, and what depends on them
is recomputed from those tables for the partitions a batch touched.  ``available_now=True`` (the scheduled form)
drains what is there and stops; otherwise the stream keeps running with the
given trigger.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.sources.tables import (
    apply_changes, full_replace, in_touched_partitions, read_table,
    read_text, upsert,
)

FILES_PER_BATCH = 1000


def file_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    fmt: str = "parquet",
    pattern: str = "*",
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """New files of a folder whose name fits the pattern; the number of files
    per batch is bounded."""
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern)
        .load(path)
    )


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of a checkpoint: the same after a restart, another after a reset."""
    return json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]


def _start(writer, checkpoint: str, available_now: bool, every: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    query = writer.trigger(**trigger).start()
    if available_now:
        query.awaitTermination()
    return query


def ingest_new_files(
    spark: SparkSession,
    path: str,
    schema: StructType,
    sink: str,
    checkpoint: str,
    fmt: str = "parquet",
    pattern: str = "*",
    available_now: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    """Append the rows of files not loaded before, with file name and load time."""
    rows = file_stream(spark, path, schema, fmt, pattern).select(
        "*",
        F.col("_metadata.file_path").alias("filename"),
        F.current_timestamp().cast("timestamp_ntz").alias("ingestion_time"),
    )
    writer = rows.writeStream.format("parquet").option("path", sink)
    return _start(writer, checkpoint, available_now, every)


def run_bronze_silver(
    stream: DataFrame,
    clean: Callable[[DataFrame], DataFrame],
    silver: str,
    keys: Sequence[str],
    partition_by: str,
    checkpoint: str,
    newest_by: str | None = None,
    after: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = True,
    every: str = "1 hour",
) -> StreamingQuery:
    """Clean each batch of raw rows and upsert it into the silver table.

    ``after`` runs on the cleaned batch (refresh of dependent tables, quality
    metrics on change).
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = clean(batch).persist()  # read by the upsert and by what follows
        change = stream_id(batch.sparkSession, checkpoint), batch_id
        try:
            upsert(rows, silver, keys, partition_by, change, newest_by)
            if after is not None:
                after(rows, batch_id)
        finally:
            rows.unpersist()

    return _start(
        stream.writeStream.foreachBatch(apply), checkpoint, available_now, every
    )


def refresh_touched(
    silver: str,
    schema: StructType,
    target: str,
    day: str,
    target_day: str,
    build: Callable[[DataFrame], DataFrame],
    reach: int = 0,
) -> Callable[[DataFrame, int], None]:
    """An ``after`` step: rebuild the partitions of ``target`` a batch touched.

    Both tables are partitioned by a date.  A result row of one day depends on
    silver rows of that day and of ``reach`` days after it (windows that go past
    midnight), so a batch touches its own days and as many before.  Whole days are
    rebuilt from the stored rows: the result is that of a batch job however files
    arrive, groups that vanish go, and a repeated batch gives the same.
    """

    def refresh(batch: DataFrame, _batch_id: int) -> None:
        days = batch.select(
            F.explode(F.sequence(F.date_sub(day, reach), F.col(day))).alias(target_day)
        ).distinct()
        source = days.select(
            F.explode(
                F.sequence(F.col(target_day), F.date_add(target_day, reach))
            ).alias(day)
        )
        stored = read_table(batch.sparkSession, silver, schema)
        rows = build(in_touched_partitions(stored, source, day))
        wanted = in_touched_partitions(rows, days, target_day)
        wanted.hint("rebalance", target_day).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(target_day).parquet(target)

    return refresh


def apply_change_stream(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    sequence: str,
    checkpoint: str,
    available_now: bool = True,
    every: str = "5 minutes",
) -> StreamingQuery:
    """Add a change feed to the log of its table, batch by batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        change = stream_id(batch.sparkSession, checkpoint), batch_id
        apply_changes(batch, path, keys, sequence, change)

    return _start(
        stream.writeStream.foreachBatch(apply), checkpoint, available_now, every
    )


#: Keys live on disk with the executors and only what a batch changed is checkpointed.
_KEY_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings that hold while a query is started; the session gets its own back."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def dedup_stream(
    stream: DataFrame,
    sink: str,
    keys: Sequence[str],
    partition_by: str,
    checkpoint: str,
    available_now: bool = True,
    every: str = "5 minutes",
) -> StreamingQuery:
    """Keep each key once, however late it comes again.

    Keys are state, without a watermark, so none is ever forgotten: a batch reads and
    writes the state of its own keys, never the sink.  The sink's log makes every batch
    appear once, also after a restart.  Of the rows of a key the first to arrive stays; a
    null key equals a null key.
    """
    once = stream.dropDuplicates(list(keys))
    writer = once.writeStream.format("parquet").option("path", sink).partitionBy(partition_by)
    with _settings(stream.sparkSession, _KEY_STATE):
        return _start(writer, checkpoint, available_now, every)


def append_stream(
    stream: DataFrame,
    sink: str,
    partition_by: str,
    checkpoint: str,
    after: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = True,
    every: str = "5 minutes",
) -> StreamingQuery:
    """Append every batch to a stored table, then run ``after`` on it.

    A batch is a folder of its partitions that a repeated run overwrites, so no
    row is appended twice.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        name = f"{stream_id(batch.sparkSession, checkpoint)}-{batch_id}"
        try:
            rows.withColumn("_batch", F.lit(name)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy(partition_by, "_batch").parquet(sink)
            if after is not None:
                after(rows, batch_id)
        finally:
            rows.unpersist()

    return _start(
        stream.writeStream.foreachBatch(apply), checkpoint, available_now, every
    )


def sliding_counts(
    rows: DataFrame, ts: str, width: str, step: str, by: Sequence[Column | str] = ()
) -> DataFrame:
    """Row counts per sliding window."""
    return rows.groupBy(F.window(ts, width, step), *by).agg(
        F.count(F.lit(1)).alias("n")
    )


def refresh_all(steps: Sequence[tuple[str, Callable[[], DataFrame], str]]) -> None:
    """Run refresh steps (name, build, path) in dependency order."""
    for _name, build, path in steps:
        full_replace(build(), path)
