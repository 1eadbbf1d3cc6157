"""Tables kept as Parquet folders.

A table that is changed in place is split by a partition column, so a change
reads and rewrites the touched partitions only, never the whole table.  The new
content of those partitions is first written in full to a staging folder next to
the table, then put in place with a dynamic partition overwrite.  A change that
names its stream and number is applied once: a run that died half way is repeated
from its staged rows, a run that ended leaves a mark and is not repeated.  Stages
are deleted as soon as they are in place, so no later change can find them.

One writer changes a table at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.dedupe import latest_per_key
from tidemark.session import stored

BUCKET = "key_bucket"
CURRENT = "_CURRENT"

#: A change of a table: the stream it belongs to and its number there.
Change = tuple[str, int]


# -- files --------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    return _fs(spark, path).exists(_path(spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none when it is not there."""
    if not path_exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file as a whole."""
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    stream = _fs(spark, path).create(_path(spark, path), True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def _is_complete(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


# -- reading ------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, empty when nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def in_touched_partitions(
    old: DataFrame, change: DataFrame, partition_by: str
) -> DataFrame:
    """Rows of the table in the partitions a change has rows for.

    The partition values of the change come as a scalar subquery, which makes
    the condition a partition filter: other partitions are not even opened.
    There are never more values than the table has partitions.
    """
    values = change.agg(F.collect_set(partition_by).alias("touched")).scalar()
    return old.where(F.array_contains(values, F.col(partition_by)))


# -- tables replaced as a whole -----------------------------------------------


def full_replace(df: DataFrame, path: str) -> None:
    """Replace a reference table as a whole; read it with :func:`read_current`.

    The rows are written as a new version, then a pointer is set to it.  Until
    then, and if the run fails, readers see the version before, which is kept
    until the next replacement.
    """
    spark = df.sparkSession
    before = _current(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    _write_text(spark, f"{path}/{CURRENT}", version)
    for name in _names(spark, path):
        if name.startswith("v-") and name not in (version, before):
            _delete(spark, f"{path}/{name}")


def _current(spark: SparkSession, path: str) -> str | None:
    pointer = f"{path}/{CURRENT}"
    return read_text(spark, pointer) if path_exists(spark, pointer) else None


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that :func:`full_replace` writes."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path}: nothing was written yet")
    return spark.read.parquet(f"{path}/{version}")


# -- appends ------------------------------------------------------------------


def append_dedup(
    new: DataFrame,
    path: str,
    keys: Sequence[str],
    partition_by: str,
    order: Sequence[Column] = (),
) -> None:
    """Append rows whose key is neither in the table nor earlier in the load.

    The partition column is part of the row's identity, so only partitions that
    occur in the load are looked up.  A null key equals a null key.  Of several
    rows of one key in the load the first by ``order`` is kept, then by the
    other columns.
    """
    spark = new.sparkSession
    on = list(dict.fromkeys([*keys, partition_by]))
    rest = [F.col(c) for c in new.columns if c not in on]
    once = latest_per_key(new, on, [*order, *rest, F.lit(1)])
    old = read_table(spark, path, new.schema)
    known = in_touched_partitions(old, new, partition_by).select(
        *[F.col(c).alias(f"_known_{c}") for c in on]
    )
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_known_{c}"))
    fresh = once.join(known, same, "left_anti")
    fresh.write.mode("append").partitionBy(partition_by).parquet(path)


# -- upserts ------------------------------------------------------------------


def upsert(
    src: DataFrame,
    path: str,
    keys: Sequence[str],
    partition_by: str,
    change: Change | None = None,
    newest_by: str | None = None,
) -> None:
    """Insert new keys, replace matching ones.

    A null in a key matches nothing, as in a MERGE condition.  With ``newest_by``
    a matching row is replaced only by one that is not older, so the result does
    not depend on the order in which changes arrive.  Without it, two source rows
    of one key are an error.

    If the partition column is one of ``keys``, the partitions of the source are
    looked up only.  Else a key may have moved: the key columns of the whole table
    are read, and the row goes from the partition that held it.

    ``change`` makes a repeated call apply once.
    """
    spark = src.sparkSession
    old = read_table(spark, path, src.schema)
    touched = src.select(partition_by)
    held = None
    if partition_by not in keys:
        held = old.join(src.select(*keys).distinct(), list(keys), "left_semi").select(partition_by)
        touched = touched.union(held)

    def merged() -> DataFrame:
        nearby = in_touched_partitions(old, touched, partition_by).select(*src.columns)
        if newest_by is None:
            kept = nearby.join(src.select(*keys), list(keys), "left_anti")
            return kept.select(*src.columns).unionByName(_one_per_key(src, keys))
        both = nearby.withColumn("_new", F.lit(0)).unionByName(
            src.withColumn("_new", F.lit(1))
        )
        order = [F.desc_nulls_last(newest_by), F.desc("_new")]
        whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        newest = latest_per_key(both.where(whole), list(keys), order)
        return newest.unionByName(both.where(~whole)).drop("_new")

    _swap_partitions(spark, merged, src.schema, path, partition_by, change, held)


def _one_per_key(src: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    error = F.raise_error(F.lit("two source rows of one key: give newest_by"))
    checked = src.withColumn("_several", whole & several)
    fine = F.when(F.col("_several"), error.cast("boolean")).otherwise(F.lit(True))
    return checked.where(fine).select(*src.columns)


def _swap_partitions(
    spark, build, schema, path, partition_by, change: Change | None, held: DataFrame | None
) -> None:
    """Write what ``build`` makes over the partitions it has rows for.

    ``held`` has the partitions that may be left without rows; those are removed.
    """
    stream, number = change or (uuid.uuid4().hex, 0)
    marks, stage = f"{path}__applied/{stream}", f"{path}__staged/{stream}-{number}"
    if change and path_exists(spark, f"{marks}/{number}"):
        _delete(spark, stage)
        return
    if not (change and _is_complete(spark, stage)):
        build().write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).parquet(stage)
    staged = spark.read.schema(schema).parquet(stage)
    emptied = []
    if held is not None:
        left = held.distinct().join(staged.select(partition_by).distinct(), partition_by, "left_anti")
        # at most the partitions of the table
        emptied = [r[0] for r in left.select(F.col(partition_by).cast("string")).collect()]
    # The rebalance hint lets AQE split large partitions and merge small ones,
    # so one busy day is written by many tasks and a quiet one by few.
    staged.hint("rebalance", partition_by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(partition_by).parquet(path)
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for value in emptied:
        _delete(spark, f"{path}/{utils.getPartitionPathString(partition_by, value)}")
    if change:
        _write_text(spark, f"{marks}/{number}", "")
        for old in _names(spark, marks):  # only the last change of a stream can come again
            if old.isdigit() and int(old) < number - 1:
                _delete(spark, f"{marks}/{old}")
    _delete(spark, stage)


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    """Stable bucket of a key, for tables without a natural partition."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


# -- change feeds -------------------------------------------------------------


def apply_changes(
    changes: DataFrame,
    path: str,
    keys: Sequence[str],
    sequence: str,
    change: Change | None = None,
) -> None:
    """Add changes to the log of a change-driven table.

    ``changes`` has a boolean ``is_deleted``.  A batch is reduced to its last row
    per key and becomes a folder of the log, so its cost does not depend on the
    table.  Repeating a change writes its folder again.  Read the table with
    :func:`live_rows` and run :func:`compact_changes` from time to time.
    """
    stream, number = change or (uuid.uuid4().hex, 0)
    name = f"{stream}-{number}"
    if name in _folded(changes.sparkSession, path):
        return
    last = _last_change(changes, keys, sequence)
    last.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        f"{path}/log/{name}"
    )


def _last_change(rows: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    rest = [F.col(c).desc() for c in rows.columns if c not in keys]
    return latest_per_key(rows, list(keys), [F.col(sequence).desc(), *rest])


def _state(spark: SparkSession, path: str) -> dict:
    text = _current(spark, path)
    return json.loads(text) if text else {"base": None, "folded": []}


def _folded(spark: SparkSession, path: str) -> set[str]:
    return set(_state(spark, path)["folded"])


def _all_changes(
    spark: SparkSession, path: str, schema: StructType
) -> tuple[DataFrame, list[str]]:
    """Base and log rows, and the log folders among them."""
    state = _state(spark, path)
    logs = [n for n in _names(spark, f"{path}/log")
            if n not in state["folded"] and _is_complete(spark, f"{path}/log/{n}")]
    folders = [f"{path}/log/{n}" for n in logs]
    if state["base"]:
        folders.append(f"{path}/{state['base']}")
    if not folders:
        return spark.createDataFrame([], schema), []
    return spark.read.schema(schema).parquet(*folders), logs


def live_rows(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], sequence: str
) -> DataFrame:
    """Rows of a change-driven table that are not deleted.

    Per key the highest sequence wins, deletes included.  Deleted keys stay as
    tombstones, so an older change that arrives late cannot bring a row back.
    """
    rows, _logs = _all_changes(spark, path, schema)
    return _last_change(rows, keys, sequence).where(~F.col("is_deleted")).drop("is_deleted")


def compact_changes(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], sequence: str
) -> None:
    """Fold the log into a new base.

    The pointer names the base and the changes it holds; it is set when the base
    is complete, so readers see each change once at any time.
    """
    before = _state(spark, path)
    rows, logs = _all_changes(spark, path, schema)
    if not logs:
        return
    base = f"base-{uuid.uuid4().hex}"
    _last_change(rows, keys, sequence).write.parquet(f"{path}/{base}")
    # a stream repeats its last change at most: older ones need not be remembered
    last: dict[str, int] = {}
    for name in [*before["folded"], *logs]:
        stream, _, number = name.rpartition("-")
        last[stream] = max(last.get(stream, -1), int(number))
    folded = sorted({*logs, *(f"{s}-{n}" for s, n in last.items())})
    _write_text(spark, f"{path}/{CURRENT}", json.dumps({"base": base, "folded": folded}))
    for name in logs:
        _delete(spark, f"{path}/log/{name}")
    for name in _names(spark, path):
        if name.startswith("base-") and name not in (base, before["base"]):
            _delete(spark, f"{path}/{name}")


# -- incremental pulls --------------------------------------------------------


def incremental_since(df: DataFrame, column: str, high_water: Column) -> DataFrame:
    """Rows changed at or after the stored high-water mark; all when it is null.

    Rows at the mark itself come again, as others of that instant may have been
    committed later: load them with :func:`append_dedup` or :func:`upsert`.
    """
    return df.where(high_water.isNull() | (F.col(column) >= high_water))


def store_high_water(df: DataFrame, column: str, path: str) -> None:
    """Keep the largest value seen as a one-row table."""
    full_replace(df.agg(F.max(column).alias("high_water")), path)


# -- archive and erasure ------------------------------------------------------


def archive_log(df: DataFrame, ts: str, path: str, older_than: Column) -> None:
    """Export the days of a log before a date, one partition per day.

    The log is trimmed later on and may get late rows, so a day of the archive becomes
    the bag union of what it holds and what the log has: a row stands in it as often as
    in the one that has more of it.  Nothing that was archived goes, and running it again
    changes nothing.  Days without a new row are not written.  Rows are equal if all
    columns are; columns of a map type cannot be compared.
    """
    spark = df.sparkSession
    dated = df.where(F.col(ts) < older_than.cast("timestamp_ntz")).withColumn(
        "log_date", F.to_date(ts)
    )
    archived = in_touched_partitions(
        read_table(spark, path, dated.schema), dated.select("log_date"), "log_date"
    ).select(*dated.columns)
    one, none = F.lit(1), F.lit(0)
    counted = (
        dated.withColumns({"_log": one, "_kept": none})
        .unionByName(archived.withColumns({"_log": none, "_kept": one}))
        .groupBy(*dated.columns).agg(F.sum("_log").alias("_log"), F.sum("_kept").alias("_kept"))
    )
    counted = stored(counted, "archive")  # the archive is read before it is written
    # fixed before the archive changes; a row per day
    found = [r[0] for r in counted.where("_log > _kept").select("log_date").distinct().collect()]
    if not found:
        return
    copies = F.sequence(F.lit(1), F.greatest("_log", "_kept").cast("int"))
    rows = counted.where(F.col("log_date").isin(found)).withColumn("_copy", F.explode(copies))
    rows.select(*dated.columns).hint("rebalance", "log_date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("log_date").parquet(path)


def erase_subjects(
    spark: SparkSession,
    path: str,
    schema: StructType,
    erasures: DataFrame,
    key: str,
    partition_by: str,
    audit_path: str,
    request: str,
) -> None:
    """Remove the rows of the listed subjects from a partitioned table.

    Only partitions that hold one are rewritten.  Before, the rows to go are
    counted per subject in the audit table, once for each ``request``.
    """
    old = read_table(spark, path, schema)
    gone = erasures.select(key).distinct()
    audit = f"{audit_path}/request={request}"
    if not _is_complete(spark, audit):
        erasure_audit({path.rstrip("/").rpartition("/")[2]: old}, erasures, key).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "static").parquet(audit)
    held = old.join(gone, key, "left_semi").select(partition_by)

    def rest() -> DataFrame:
        nearby = in_touched_partitions(old, held, partition_by)
        return nearby.join(gone, key, "left_anti").select(*schema.fieldNames())

    _swap_partitions(spark, rest, schema, path, partition_by, None, held)


def erasure_audit(
    tables: dict[str, DataFrame], erasures: DataFrame, key: str
) -> DataFrame:
    """Rows to be erased per table and subject."""
    listed = erasures.select(key).distinct()
    parts = [
        df.select(key)
        .join(listed, key, "left_semi")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("erased_rows"))
        .select(F.lit(name).alias("table_name"), key, "erased_rows")
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
