"""Loads of the loyalty star: dimensions whose keys stay, a fact that loses no visit.

A load appends the rows it changes, with their keys, as the partition of its batch; the
newest row of an id is taken when the dimension is read.  A batch looks up the keys of its
own ids only, and running it again puts the same rows in their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.temporal import date_key
from tidemark.operators.components import allocate_keys
from tidemark.operators.dedupe import hash_key, latest_per_key
from tidemark.operators.shape import union_all
from tidemark.plans.staging import first_reason, looked_up
from tidemark.session import stored

# The fields of the staging views, as the payloads name them.
USER_FIELDS = {
    "user_id": "string", "first_name": "string", "last_name": "string", "email": "string",
    "phone": "string", "registration_date": "date", "status": "string", "preferred_zone": "string",
}
BUSINESS_FIELDS = {
    "business_id": "string", "business_name": "string", "category": "string", "subcategory": "string",
    "loyalty_type": "string", "cashback_pct": "decimal(5,2)", "punch_goal": "int", "lat": "double",
    "long": "double", "google_rating": "decimal(3,1)", "google_place_id": "string", "address": "string",
    "neighborhood": "string",
}


def staged_view(raw: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The fields of JSON payloads; one that is missing or of the wrong type is null."""
    return raw.select(
        *[F.try_variant_get("raw_data", f"$.{name}", kind).alias(name) for name, kind in fields.items()]
    )


@dataclass(frozen=True)
class Dimension:
    """A dimension below ``folder``: ``id`` is the source's, ``key`` the surrogate."""

    folder: str
    id: str
    key: str

    def _batches(self, like: DataFrame, before: int | None = None) -> DataFrame | None:
        if before == 0:
            return None
        rows = like.sparkSession.read.parquet(self.folder)
        return rows if before is None else rows.where(F.col("batch") < before)

    def load(self, staged: DataFrame, batch: int) -> None:
        """Add batch ``batch``; batches are numbered from 0 in the order they are loaded.

        Rows without an id are left out.  Of an id's rows in the batch the one that is last
        by all its fields counts, as nothing else tells them apart.
        """
        rest = [F.desc_nulls_last(c) for c in staged.columns if c != self.id]
        rows = latest_per_key(staged.where(F.col(self.id).isNotNull()), [self.id], [*rest, F.lit(1)])
        ids = rows.select(F.col(self.id).alias("id"))
        before, known = self._batches(staged, batch), None
        if before is not None:
            held = before.select(F.col(self.id).alias("id"), F.col(self.key).alias("key"))
            last = held.agg(F.max("key")).first()[0] or 0
            # the keys of this batch's ids, and one row that says where new keys begin
            found = held.join(ids, "id", "left_semi").groupBy("id").agg(F.min("key").alias("key"))
            fresh = allocate_keys(ids.join(found, "id", "left_anti"))
            known = found.unionByName(fresh.withColumn("key", F.col("key") + F.lit(last)))
        else:
            known = allocate_keys(ids)
        keyed = rows.join(known.withColumnsRenamed({"id": self.id, "key": self.key}), self.id)
        stored(keyed, "dimension").write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def read(self, like: DataFrame) -> DataFrame:
        """The newest row of each id."""
        return latest_per_key(self._batches(like), [self.id], [F.desc("batch")]).drop("batch")


def keyed_visits(visits: DataFrame, users: DataFrame, businesses: DataFrame, types: DataFrame) -> DataFrame:
    """Every visit once with the keys of its dimensions, and ``reason`` if one is missing."""
    kinds = businesses.select("business_id", "loyalty_type")
    rows = looked_up(visits, users, "user_id", "user_key", "user_key")
    rows = looked_up(rows, businesses, "business_id", "business_key", "business_key")
    rows = looked_up(rows, kinds, "business_id", "loyalty_type", "_type")
    named = types.select(F.col("loyalty_type_name").alias("_type"), "loyalty_type_key")
    rows = looked_up(rows, named, "_type", "loyalty_type_key", "loyalty_type_key")
    return rows.withColumn(
        "reason",
        first_reason(
            no_visit_id=F.col("visit_id").isNull(), unknown_user=F.col("user_key").isNull(),
            unknown_business=F.col("business_key").isNull(), unknown_programme=F.col("loyalty_type_key").isNull(),
            no_time=F.col("visit_timestamp").isNull(),
        ),
    )


def visit_rows(keyed: DataFrame) -> DataFrame:
    """The visit fact's columns; the key is a hash of the visit id, so it never changes."""
    return keyed.select(
        hash_key("visit_id").alias("visit_key"), "visit_id", date_key(F.col("visit_timestamp")).alias("date_key"),
        "user_key", "business_key", "loyalty_type_key", "visit_type", "visit_timestamp", "points_earned",
        "cashback_amount", "punch_count",
    )


def load_checks(loads: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(check_name, raw_rows, loaded_rows, fail_count) of each load.

    A load is the staged raw rows, the loaded table and the id they share.  Rows of raw
    without an id, ids of raw that are not loaded, loaded ids that raw does not have and
    ids loaded more than once are failures, each counted apart.
    """
    parts = []
    for name, (raw, loaded, key) in loads.items():
        sides = (
            raw.select(F.col(key).alias("id"), F.lit(1).alias("raw"), F.lit(0).alias("loaded"))
            .unionAll(loaded.select(key, F.lit(0), F.lit(1)))
            .groupBy("id").agg(F.sum("raw").alias("raw"), F.sum("loaded").alias("loaded"))
        )
        known = F.col("id").isNotNull()
        counts = sides.agg(
            F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_rows"),
            F.coalesce(F.sum("loaded"), F.lit(0)).alias("loaded_rows"),
            F.coalesce(F.sum(F.when(~known, F.col("raw"))), F.lit(0)).alias("without an id"),
            F.count_if(known & (F.col("loaded") == 0)).alias("not loaded"),
            F.count_if(F.col("raw") == 0).alias("not in raw"),
            F.count_if(known & (F.col("loaded") > 1)).alias("loaded twice"),
        )
        parts.append(
            counts.unpivot(
                ["raw_rows", "loaded_rows"], ["without an id", "not loaded", "not in raw", "loaded twice"],
                "check_name", "fail_count",
            ).select(
                F.concat(F.lit(f"{name}: "), "check_name").alias("check_name"), "raw_rows", "loaded_rows", "fail_count"
            )
        )
    return union_all(parts)
