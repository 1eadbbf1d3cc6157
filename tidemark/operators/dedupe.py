"""Keys: latest row per key, duplicates, surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


def latest_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]
) -> DataFrame:
    """One row per key, the first by ``order`` (end it with a tiebreaker).

    ``row_number() = 1`` makes Catalyst cut every key to one row on the map
    side as well (WindowGroupLimit), so copies of a hot key are not shuffled.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def duplicate_excess(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One row: rows beyond the first of each distinct key.

    A null key part leaves the row out of the distinct count, as
    ``count(*) - count(distinct ...)`` does.
    """
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(whole)).alias("metric_value")
    ).select(F.lit(label).alias("metric_name"), "metric_value")


def with_surrogate_key(
    df: DataFrame, order_by: Sequence[str], name: str = "surrogate_key"
) -> DataFrame:
    """Consecutive keys 1..n in the given order, without one global sort task.

    Rows are range-partitioned and sorted, then checkpointed so that positions
    cannot shift if an executor is lost.  A key is the position inside its
    partition plus the row count of the partitions before it; that table of
    counts has one row per partition, hence the broadcast.
    """
    ensure_checkpoint_dir(df.sparkSession)
    frozen = (
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).checkpoint()
    )
    placed = frozen.withColumn("_id", F.monotonically_increasing_id()).withColumns(
        {
            "_part": F.shiftright("_id", 33),
            "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
        )
    )
    keyed = placed.join(F.broadcast(starts), "_part")
    return keyed.withColumn(name, F.col("_start") + F.col("_pos") + 1).select(
        name, *df.columns
    )


def hash_key(*columns: str) -> Column:
    """Surrogate key that does not depend on other rows or on load order."""
    return F.xxhash64(*columns)
