"""Joins.

None of these hints a broadcast of data: Catalyst's size threshold, re-checked
by AQE on real sizes, decides.  Facts are aggregated to their foreign key before
they meet a dimension wherever the measures allow it, so a key that owns a
third of the rows becomes one row before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def star_join(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str,
    columns: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Fact rows with the named dimension columns attached."""
    slim = dim.select(F.col(dim_key).alias(fact_key), *columns)
    return fact.join(slim, fact_key, how)


def star_rollup(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str,
    by: Sequence[str],
    sums: dict[str, Column],
    how: str = "inner",
) -> DataFrame:
    """Additive measures of a fact by attributes of a dimension.

    The fact is summed per foreign key first (combined on the map side), then
    joined and summed again.
    """
    per_key = fact.groupBy(fact_key).agg(
        *[F.sum(expr).alias(name) for name, expr in sums.items()]
    )
    joined = star_join(per_key, dim, fact_key, dim_key, list(by), how)
    return joined.groupBy(*by).agg(*[F.sum(name).alias(name) for name in sums])


def dim_left_fact(
    dim: DataFrame, fact: DataFrame, key: str, aggs: dict[str, Column]
) -> DataFrame:
    """Every dimension row with aggregates of its fact rows (null when none)."""
    per_key = fact.groupBy(key).agg(*[a.alias(n) for n, a in aggs.items()])
    return dim.join(per_key, key, "left")


def missing_in(
    df: DataFrame, reference: DataFrame, key: str, reference_key: str | None = None
) -> DataFrame:
    """Rows whose key does not occur in ``reference`` (null keys never occur)."""
    other = reference.select(F.col(reference_key or key).alias(key))
    return df.join(other, key, "left_anti")


def orphan_count(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str,
    label: str,
    nullable: bool = False,
) -> DataFrame:
    """One row: how many fact rows point at no dimension row.

    Counted per key before the anti-join.  A null key is an orphan unless the
    column is ``nullable``.
    """
    rows = fact.where(F.col(fact_key).isNotNull()) if nullable else fact
    per_key = rows.groupBy(fact_key).agg(F.count(F.lit(1)).alias("n"))
    lost = missing_in(per_key, dim, fact_key, dim_key)
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_count")).select(
        F.lit(label).alias("fk_check"), "orphan_count"
    )


def present_in(
    df: DataFrame, reference: DataFrame, key: str, reference_key: str | None = None
) -> DataFrame:
    """Rows whose key occurs in ``reference``; never multiplies rows."""
    other = reference.select(F.col(reference_key or key).alias(key))
    return df.join(other, key, "left_semi")


def with_boundary(df: DataFrame, **scalars: Column) -> DataFrame:
    """Attach one-row aggregates (scalar subqueries) as columns; no join."""
    return df.withColumns(scalars)


def resolve_key(
    df: DataFrame,
    crossref: DataFrame,
    entity_type: str,
    source_column: str,
    id_column: str,
    output: str,
    how: str = "inner",
) -> DataFrame:
    """Replace a source-system id by the curated key of the given entity type."""
    mapping = crossref.where(F.col("entity_type") == entity_type).select(
        F.col(source_column).alias(id_column), F.col("curated_key").alias(output)
    )
    return df.join(mapping, id_column, how)


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    slice_by: str | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before its time, or nulls.

    No pair of a left and a right row of one key is ever formed.  The distinct
    (key, time) points of the left are merged with the right rows into one line
    per key, and the last rate seen is carried forward.  With dates a line holds
    at most two entries per calendar day whatever the number of rows.  For
    finer times pass ``slice_by`` (``day``, ``month``): lines are then cut into
    slices handled apart, and each slice opens with the closing rate of the
    last slice before it.
    """
    by = list(by)
    on = [*by, "_t"]
    rates = (
        right.where(F.col(right_time).isNotNull())
        .groupBy(*by, F.col(right_time).alias("_t"))
        .agg(F.max(F.struct(*values)).alias("_rate"))
        .withColumn("_probe", F.lit(0))
    )
    probes = (
        left.where(F.col(left_time).isNotNull())
        .select(*by, F.col(left_time).alias("_t"))
        .distinct()
        .withColumn("_rate", F.lit(None).cast(rates.schema["_rate"].dataType))
        .withColumn("_probe", F.lit(1))
    )
    line = rates.unionByName(probes)
    keys = by
    if slice_by:
        line = line.withColumn("_slice", F.date_trunc(slice_by, "_t"))
        keys = [*by, "_slice"]
    seen = Window.partitionBy(*keys).orderBy("_t", "_probe").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    filled = line.withColumn("_rate", F.last("_rate", ignorenulls=True).over(seen))
    filled = filled.where(F.col("_probe") == 1)
    if slice_by:
        closing = line.groupBy(*keys).agg(
            F.max_by("_rate", F.when(F.col("_rate").isNotNull(), F.col("_t"))).alias(
                "_close"
            )
        )
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(
            Window.unboundedPreceding, -1
        )
        opening = closing.select(
            *keys, F.last("_close", ignorenulls=True).over(before).alias("_open")
        )
        filled = filled.join(opening, keys, "left").withColumn(
            "_rate", F.coalesce("_rate", "_open")
        )
    answers = filled.select(*on, "_rate")
    return (
        left.withColumn("_t", F.col(left_time))
        .join(answers, on, "left")
        .select(*left.columns, *[F.col(f"_rate.{v}").alias(v) for v in values])
    )
