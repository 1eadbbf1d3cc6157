"""Window operators for series that are already aggregated to day or month.

The un-partitioned ones need one task; a series has one row per day or month,
so that task stays small whatever the size of the fact behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import ratio


def mom_change(series: DataFrame, order: str, value: str) -> DataFrame:
    """Previous value, change and change in percent along the series."""
    along = Window.orderBy(order)
    previous = F.lag(value).over(along)
    return series.withColumns(
        {
            "prev_month_revenue": previous,
            "mom_change": F.round(F.col(value) - previous, 2),
            "mom_change_pct": F.round(
                ratio(F.col(value) - previous, previous) * 100, 2
            ),
        }
    )


def rolling_average(
    series: DataFrame, order: str, columns: dict[str, str], rows: int
) -> DataFrame:
    """Mean of the last ``rows`` rows including the current one."""
    last = Window.orderBy(order).rowsBetween(1 - rows, Window.currentRow)
    return series.withColumns(
        {out: F.avg(col).over(last) for col, out in columns.items()}
    )


def gap_runs(
    series: DataFrame, order: str, has_data: str, by: Sequence[str] = ()
) -> DataFrame:
    """Runs of consecutive rows without data (gaps and islands), within each group."""
    so_far = Window.partitionBy(*by).orderBy(order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    grouped = series.withColumn("_group", F.sum(has_data).over(so_far))
    return (
        grouped.where(F.col(has_data) == 0)
        .groupBy(*by, "_group")
        .agg(
            F.min(order).alias("gap_start"),
            F.max(order).alias("gap_end"),
            F.count(F.lit(1)).alias("consecutive_missing_days"),
        )
        .drop("_group")
    )


def previous_in_group(
    df: DataFrame, keys: Sequence[str], order: str, value: str
) -> Column:
    """Value of the previous period of the same group.

    Call it on one row per group and period: group size is then bounded by the
    number of periods.
    """
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(order))


def newest_first_rank(order: Sequence[Column]) -> Column:
    """Row number over a whole (aggregated) result."""
    return F.row_number().over(Window.orderBy(*order))
