"""Quality metrics kept up to date by what a batch changed.

The state has, for each partition of a table, how many nulls a column has there and how
often each value of a column occurs; both add up over partitions.  A batch counts the
partitions it touched again, takes the difference from what they held before, and adds it
to the metrics of the batch before.  For repeated values only keys whose count changed
are looked up in the other partitions, in the state, never in the table.

State and log are partitions of their batch, and a batch looks at earlier batches only:
run again, it writes the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.shape import union_all
from tidemark.session import stored
from tidemark.sources.tables import in_touched_partitions, read_table

_STATE = "day date, metric_name string, value string, n long, batch int"
_LOG = "metric_name string, metric_value long, batch int"


@dataclass(frozen=True)
class MetricLog:
    """Metrics of a table partitioned by the date ``day``: label to column, nulls and repeated values."""

    folder: str
    day: str
    nulls: dict[str, str]
    repeated: dict[str, str]

    def counted(self, rows: DataFrame) -> DataFrame:
        """(day, metric_name, value, n) of every day of ``rows``, and a line that says the day was counted."""
        dated = rows.withColumnRenamed(self.day, "day")
        name = F.lit("").alias("metric_name")
        none = F.lit(None).cast("string").alias("value")
        parts = []
        if self.nulls:
            sums = dated.groupBy("day").agg(
                *(F.count_if(F.col(c).isNull()).alias(label) for label, c in self.nulls.items())
            )
            parts.append(sums.unpivot("day", list(self.nulls), "metric_name", "n").select("day", "metric_name", none, "n"))
        for label, column in self.repeated.items():
            parts.append(
                dated.groupBy("day", F.col(column).cast("string").alias("value"))
                .agg(F.count(F.lit(1)).alias("n")).select("day", F.lit(label).alias("metric_name"), "value", "n")
            )
        return union_all([dated.select("day").distinct().select("day", name, none, F.lit(0).cast("long").alias("n")), *parts])

    def _state(self, spark: SparkSession, before: int) -> DataFrame:
        """The newest counts of every day that earlier batches left."""
        rows = _read(spark, f"{self.folder}/state", _STATE).where(F.col("batch") < before)
        # the line of a counted day is in each of its batches, so a day has one newest
        last = rows.where("metric_name = ''").groupBy("day").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["day", "batch"], "left_semi")

    def log(self, spark: SparkSession) -> DataFrame:
        """(metric_name, metric_value, batch): a row for each metric and batch."""
        return _read(spark, f"{self.folder}/log", _LOG)

    def latest(self, spark: SparkSession) -> DataFrame:
        rows = self.log(spark)
        return rows.groupBy("metric_name").agg(F.max_by("metric_value", "batch").alias("metric_value"))

    def update(self, table: DataFrame, days: DataFrame, batch: int) -> None:
        """Count the days in ``days`` (a column named as the table's) of ``table`` again."""
        spark = table.sparkSession
        touched = days.select(F.col(self.day).alias("day")).distinct()
        fresh = self.counted(in_touched_partitions(table, days, self.day))
        # a day that lost all its rows is counted as well
        marks = touched.select("day", F.lit("").alias("metric_name"), F.lit(None).cast("string").alias("value"),
                               F.lit(0).cast("long").alias("n"))
        new = stored(fresh.where("metric_name <> ''").unionByName(marks), "metric-state")
        state = self._state(spark, batch)
        old = state.join(touched, "day", "left_semi")
        keys = ["metric_name", "value"]
        moved = (
            new.select(*keys, "n").unionByName(old.select(*keys, (-F.col("n")).alias("n")))
            .groupBy(*keys).agg(F.sum("n").alias("change")).where("change <> 0")
        )
        repeated = F.col("metric_name").isin(list(self.repeated))
        changed = stored(moved, "metric-change")
        # a null value never is the first of its kind, so all its rows count
        excess = lambda n: n - F.when((n > 0) & F.col("value").isNotNull(), 1).otherwise(0)
        mark = F.lit("\u0000")
        named = lambda df: df.withColumn("_value", F.coalesce("value", mark))
        held = (
            named(state.where(repeated)).join(named(changed).select("metric_name", "_value").distinct(),
                                              ["metric_name", "_value"], "left_semi")
            .groupBy("metric_name", "_value").agg(F.sum("n").alias("before"))
        )
        before = F.coalesce("before", F.lit(0).cast("long"))
        per_key = named(changed.where(repeated)).join(held, ["metric_name", "_value"], "left").select(
            "metric_name", (excess(before + F.col("change")) - excess(before)).alias("change")
        )
        labels = [*self.nulls, *self.repeated]
        base = spark.createDataFrame([(x, 0) for x in labels], "metric_name string, change long")
        earlier = self.log(spark).where(F.col("batch") < batch)
        last = earlier.groupBy("metric_name").agg(F.max_by("metric_value", "batch").alias("change"))
        values = (
            union_all([base, last, changed.where(~repeated).select("metric_name", "change"), per_key])
            .groupBy("metric_name").agg(F.sum("change").alias("metric_value")).where("metric_name <> ''")
        )
        values.write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
        new.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")

    def after(self, path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
        """A step behind a job that changed the table at ``path``."""

        def step(batch: DataFrame, batch_id: int) -> None:
            self.update(read_table(batch.sparkSession, path, schema), batch.select(self.day), batch_id)

        return step


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    parsed = spark.createDataFrame([], schema).schema
    return read_table(spark, path, parsed)
