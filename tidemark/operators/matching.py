"""Approximate name matching without a cross join and without caps.

Two texts within ``edits`` Levenshtein steps share a text that can be reached
from each by deleting at most ``edits`` characters.  Joining on those deletion
variants therefore finds every pair, and a variant can only come from a bounded
number of distinct names, however large the tables are.  Copies of a name are
collapsed before, so a name that owns a third of the rows is one row here.
Variants meet by a hash of eight bytes, which sorts fast; the city and the
distance of a pair are compared in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


def with_variants(df: DataFrame, text: str, edits: int) -> DataFrame:
    """A row, with ``v``, for the text and each text left after deleting up to ``edits`` (1 or 2)."""
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    found = df.withColumns({"v": F.col(text), "_from": F.lit(1)})
    for _ in range(edits):
        # characters go from left to right, the first of a run for all of it; 0 deletes none
        end = F.when(F.col("_from") > 0, F.length("v"))
        places = F.when(F.col("_from") <= end, F.sequence("_from", end)).otherwise(F.array().cast("array<int>"))
        found = (
            found.withColumn("_at", F.explode(F.concat(F.array(F.lit(0)), places)))
            .where((F.col("_at") < 2) | (F.substring("v", F.col("_at"), F.lit(1)) != F.substring("v", F.col("_at") - 1, F.lit(1))))
            .withColumn("v", F.when(F.col("_at") == 0, F.col("v")).otherwise(
                F.concat(F.substring("v", F.lit(1), F.col("_at") - 1), F.substring("v", F.col("_at") + 1, F.length("v")))
            ))
            .withColumn("_from", F.col("_at"))
        )
    return found.drop("_from", "_at")


def _spellings(rows: DataFrame, name: str, side: str, edits: int) -> DataFrame:
    """(city, name, only, v): a row for each variant of a name; ``only`` is its side, if it has one."""
    only = F.when(F.min(side) == F.max(side), F.min(side)).alias(f"only_{side}")
    spelled = with_variants(rows.groupBy("city", name).agg(only), name, edits)
    return spelled.withColumn("v", F.xxhash64("city", "v"))


def propose_matches(
    left: DataFrame, right: DataFrame, edits: int = 1, apart: str | None = None
) -> DataFrame:
    """Best right row for each left row with the same city and a similar name.

    Both sides have ``id``, ``name``, ``city``.  Result: ``left_id``,
    ``right_id``, ``distance``, ``similarity``; the nearest name wins, then the
    smallest id.  Left rows without a match are not in the result.  With ``apart``,
    a column of few values, only rows that differ in it match.
    """
    left_side, right_side = (F.col(apart), F.col(apart)) if apart else (F.lit("left"), F.lit("right"))
    left = left.select(
        "city", F.col("name").alias("left_name"), left_side.alias("left_side"), F.col("id").alias("left_id")
    )
    keys = ["city", "left_name", "left_side"]
    names = left.select(*keys).distinct()
    candidates = stored(
        right.groupBy("city", F.col("name").alias("right_name"), right_side.alias("right_side"))
        .agg(F.min("id").alias("right_id")), "candidates",
    )
    differ = F.col("left_side") != F.col("right_side")
    # an equal name is the nearest there is
    nearest = stored(
        names.join(candidates.withColumnRenamed("right_name", "left_name"), ["city", "left_name"], "left")
        .groupBy(*keys).agg(F.min(F.when(differ, F.col("right_id"))).alias("right_id")), "nearest",
    )
    equal = nearest.where("right_id is not null").select(
        *keys, F.lit(0).alias("distance"), "right_id", F.lit(1.0).alias("similarity")
    )
    others = nearest.where("right_id is null").select(*keys)
    a, b = _spellings(others, "left_name", "left_side", edits), _spellings(candidates, "right_name", "right_side", edits)
    same_side = F.coalesce(F.col("only_left_side") == F.col("only_right_side"), F.lit(False))
    pairs = (
        a.join(b.withColumnRenamed("city", "right_city"), "v")
        .where((F.col("city") == F.col("right_city")) & (F.col("left_name") != F.col("right_name")) & ~same_side)
        .withColumn("distance", F.levenshtein("left_name", "right_name", edits))
        .where("distance >= 0").select("city", "left_name", "right_name", "distance").distinct()
    )
    longer = F.greatest(F.length("left_name"), F.length("right_name"))
    near = (
        pairs.join(others, ["city", "left_name"]).join(candidates, ["city", "right_name"]).where(differ)
        .groupBy(*keys).agg(
            F.min(F.struct("distance", "right_id", (1 - F.col("distance") / longer).alias("similarity"))).alias("b")
        ).select(*keys, "b.*")
    )
    return left.join(equal.unionByName(near), keys).select("left_id", "right_id", "distance", "similarity")
