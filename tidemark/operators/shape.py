"""Counting, reshaping, ranking and listing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import ratio


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(DataFrame.unionByName, frames)


def labelled_counts(
    tables: dict[str, DataFrame], label: str = "table_name", count: str = "row_count"
) -> DataFrame:
    """One row per table: its name and row count."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias(count)).select(F.lit(n).alias(label), count)
            for n, df in tables.items()
        ]
    )


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """Wide to long in one scan."""
    return df.unpivot(list(ids), list(values), name, value)


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules counted in one pass."""
    counted = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], list(rules), "check_name", "fail_count")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows by order; planned as a per-task top-k, not a full sort."""
    return df.orderBy(*order).limit(k)


def list_distinct(
    df: DataFrame, by: Sequence[str], column: str, output: str, separator: str = ", "
) -> DataFrame:
    """Distinct values of a column per group, sorted, as one text.

    Copies are dropped before the lists are built, so the only thing that grows
    is the list itself, which is the answer.
    """
    once = df.select(*by, column).where(F.col(column).isNotNull()).distinct()
    return once.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_list(column)), separator).alias(output)
    )


def share_of_total(df: DataFrame, value: str, output: str, digits: int) -> DataFrame:
    """Share of each row of a small result in the total, in percent."""
    total = df.agg(F.sum(value).alias("total")).scalar()
    return df.withColumn(output, F.round(ratio(F.col(value), total) * 100, digits))


def domain_violations(
    df: DataFrame, column: str, allowed: Sequence[str], label: str
) -> DataFrame:
    """Distinct values outside the allowed set (nulls are not judged)."""
    outside = df.select(F.col(column).alias("value")).where(
        ~F.col(column).isin(list(allowed))
    )
    return outside.distinct().select(F.lit(label).alias("check_name"), "value")


def equal_width_histogram(
    df: DataFrame, column: str, bins: int, by: str
) -> DataFrame:
    """Integer values per class in ``bins`` equal-width bins of that class.

    Bounds are the minimum and maximum of each class; the last bin is closed.
    Values are first counted, so the join back to the bounds sees one row per
    distinct value.  A class with a single value is given a unit-wide range
    centred on it, the value falling into the middle bin.
    """
    counts = df.groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.groupBy(by).agg(
        F.min(column).alias("lo"), F.max(column).alias("hi")
    )
    width = F.col("hi") - F.col("lo")
    inside = F.expr(f"(({column} - lo) * {bins}) div nullif(hi - lo, 0)")
    bin_no = F.when(width == 0, F.lit(bins // 2)).otherwise(
        F.least(inside, F.lit(bins - 1))
    )
    return (
        counts.join(bounds, by)
        .groupBy(by, bin_no.cast("int").alias("bin"), "lo", "hi")
        .agg(F.sum("n").alias("user_count"))
    )


def filter_eq(df: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """Rows with the value; all rows for ``None`` or ``All``."""
    return df if value in (None, "All") else df.where(F.col(column) == value)
