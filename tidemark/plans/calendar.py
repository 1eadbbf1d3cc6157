"""Calendar dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.temporal import date_key, iso_weekday, sunday_weekday


def day_sequence(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """One row per day, both ends included; bounds may be scalar subqueries."""
    return spark.range(1).select(
        F.explode(
            F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 1 day"))
        ).alias("calendar_date")
    )


def calendar(
    spark: SparkSession,
    start: Column,
    end: Column,
    weekday: str = "sunday",
    key: str = "yyyymmdd",
) -> DataFrame:
    """Calendar and fiscal attributes (fiscal year = calendar year).

    Variants: ``weekday`` is ``sunday`` (Sunday 0) or ``iso`` (Monday 1);
    ``key`` is ``yyyymmdd`` or ``running`` (1 for the first day).
    """
    d = F.col("calendar_date")
    days = day_sequence(spark, start, end)
    quarter_end = F.last_day(
        F.add_months(F.trunc(d, "quarter"), 2)
    )
    year_end = F.make_date(F.year(d), F.lit(12), F.lit(31))
    number = sunday_weekday(d) if weekday == "sunday" else iso_weekday(d)
    keys = (
        date_key(d) if key == "yyyymmdd" else F.datediff(d, F.to_date(start)) + 1
    )
    return days.select(
        keys.cast("int").alias("date_key"),
        d,
        number.cast("int").alias("day_of_week"),
        F.date_format(d, "EEE").alias("day_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMM").alias("month_name"),
        F.quarter(d).alias("quarter_number"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_name"),
        F.year(d).alias("year_number"),
        F.quarter(d).alias("fiscal_quarter"),
        F.year(d).alias("fiscal_year"),
        (d == F.last_day(d)).alias("is_month_end"),
        (d == quarter_end).alias("is_quarter_end"),
        (d == year_end).alias("is_year_end"),
        (iso_weekday(d) <= 5).alias("is_business_day"),
    )
