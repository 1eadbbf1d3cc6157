"""Bike-share lakehouse: raw payloads, clean stations, gold aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import percent, ratio
from tidemark.functions.temporal import hour_floor, latest, parse_instant
from tidemark.functions.text import clean_address
from tidemark.operators.dedupe import duplicate_excess, latest_per_key
from tidemark.operators.shape import top_k, union_all

# Payload path and type of each clean column.
PAYLOAD = {
    "station_id": ("id", "string"),
    "station_name": ("name", "string"),
    "station_number": ("extra.number", "string"),
    "station_uid": ("extra.uid", "bigint"),
    "latitude": ("latitude", "double"),
    "longitude": ("longitude", "double"),
    "free_bikes": ("free_bikes", "bigint"),
    "empty_slots": ("empty_slots", "bigint"),
    "total_slots": ("extra.slots", "bigint"),
    "address": ("extra.address", "string"),
    "is_online": ("extra.online", "boolean"),
    "availability_light": ("extra.light", "string"),
    "api_timestamp": ("timestamp", "string"),
    "extraction_at": ("extraction_at", "timestamp_ntz"),
}
SILVER_KEYS = ["station_id", "extraction_at"]
SILVER_PARTITION = "extraction_date"

# Colour per availability, as red, green, blue, alpha.
GREEN, ORANGE, RED = [34, 139, 34, 180], [255, 165, 0, 180], [220, 20, 60, 180]


def _field(name: str, strict: bool) -> Column:
    path, kind = PAYLOAD[name]
    get = F.variant_get if strict else F.try_variant_get
    return get("raw_data", f'$["{path}"]', kind)


def project_payload(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Typed columns of the payload.

    A value of the wrong type becomes null, or fails the job when ``strict``.
    """
    return _cleaned(
        raw.select(
            *[_field(name, strict).alias(name) for name in PAYLOAD], "ingestion_time"
        )
    )


def project_columns(rows: DataFrame) -> DataFrame:
    """The same from rows landed as columns, such as a typed Parquet feed.

    Only the columns a query needs are read then.
    """
    return _cleaned(
        rows.select(
            *[
                F.col(f"`{path}`").try_cast(kind).alias(name)
                for name, (path, kind) in PAYLOAD.items()
            ],
            "ingestion_time",
        )
    )


def _cleaned(typed: DataFrame) -> DataFrame:
    return typed.withColumns(
        {
            "address": clean_address(F.col("address")),
            "api_timestamp": parse_instant(F.col("api_timestamp")),
        }
    )


def usable(rows: DataFrame) -> DataFrame:
    """Stations with a position and at least one slot."""
    return rows.where(
        F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
        & (F.col("total_slots") > 0)
    )


def silver_clean(
    raw: DataFrame, strict: bool = False, with_ingestion: bool = False
) -> DataFrame:
    """Clean rows of raw payloads; ``with_ingestion`` keeps their load time."""
    rows = silver_latest(usable(project_payload(raw, strict)))
    return rows if with_ingestion else rows.drop("ingestion_time")


def silver_latest(rows: DataFrame) -> DataFrame:
    """One row per station and snapshot: the last ingested.

    Equal ingestion times are settled by the remaining columns.
    """
    order = [F.desc("ingestion_time"), F.desc("free_bikes"), F.desc("total_slots"),
             F.desc("availability_light")]
    return latest_per_key(rows, SILVER_KEYS, order)


def with_partition(silver: DataFrame) -> DataFrame:
    """Silver rows with the day their partition is named after."""
    return silver.withColumn(SILVER_PARTITION, F.to_date("extraction_at"))


def network_summary(silver: DataFrame) -> DataFrame:
    """One row per snapshot."""
    return silver.groupBy("extraction_at").agg(
        F.count_distinct("station_id").alias("total_stations"),
        F.count_if("is_online").alias("online_stations"),
        F.sum("free_bikes").alias("total_free_bikes"),
        F.sum("empty_slots").alias("total_empty_slots"),
        F.sum("total_slots").alias("total_slots"),
        percent(F.sum("free_bikes"), F.sum("total_slots"), 2).alias(
            "network_occupancy_pct"
        ),
    )


STATION = ["station_id", "station_name", "station_number", "latitude", "longitude",
           "address"]


def station_hourly(silver: DataFrame) -> DataFrame:
    """Averages and extremes per station and hour.

    Name and address are part of the group: a renamed station starts anew.
    """
    def average(column: str) -> Column:
        return ratio(F.sum(column), F.count(column))

    hour = hour_floor(F.col("extraction_at"))
    return silver.groupBy(*STATION, hour.alias("hour_bucket")).agg(
        average("free_bikes").alias("avg_free_bikes"),
        average("empty_slots").alias("avg_empty_slots"),
        F.min("free_bikes").alias("min_free_bikes"),
        F.max("free_bikes").alias("max_free_bikes"),
        average("total_slots").alias("avg_total_slots"),
        F.round(ratio(average("free_bikes"), average("total_slots")) * 100, 2).alias(
            "avg_occupancy_pct"
        ),
        F.count(F.lit(1)).alias("snapshot_count"),
    )


# -- dashboard ----------------------------------------------------------------


def latest_snapshot(network: DataFrame) -> DataFrame:
    return top_k(network, [F.desc("extraction_at")], 1)


def newest_hour(rows: DataFrame) -> DataFrame:
    """Rows of the newest hour, found before anything is aggregated."""
    newest = hour_floor(latest(rows, "extraction_at"))
    return rows.where(F.col("extraction_at") >= newest)


def latest_hour(hourly: DataFrame) -> DataFrame:
    newest = hourly.agg(F.max("hour_bucket").alias("h")).scalar()
    return hourly.where(F.col("hour_bucket") == newest)


def availability_band(occupancy: Column) -> Column:
    """Marker colour."""
    def colour(rgba: list[int]) -> Column:
        return F.array(*[F.lit(v) for v in rgba])

    return (
        F.when(occupancy >= 60, colour(GREEN))
        .when(occupancy >= 30, colour(ORANGE))
        .otherwise(colour(RED))
    )


def map_rows(hourly: DataFrame) -> DataFrame:
    """Stations of the newest hour with colour and radius of their marker."""
    return latest_hour(hourly).withColumns(
        {
            "color": availability_band(F.col("avg_occupancy_pct")),
            "radius": F.greatest(F.col("avg_total_slots") * 3, F.lit(30.0)),
        }
    )


def top_bottom_stations(hourly: DataFrame, k: int = 10) -> DataFrame:
    """Fullest and emptiest stations of the newest hour."""
    rows = latest_hour(hourly).select("station_name", "avg_occupancy_pct")
    top = top_k(rows, [F.desc_nulls_last("avg_occupancy_pct"), F.asc("station_name")], k)
    low = top_k(rows, [F.asc_nulls_last("avg_occupancy_pct"), F.asc("station_name")], k)
    return union_all(
        [
            top.select(F.lit("top").alias("side"), "*"),
            low.select(F.lit("bottom").alias("side"), "*"),
        ]
    )


def occupancy_series(network: DataFrame) -> DataFrame:
    return network.select("extraction_at", "network_occupancy_pct").orderBy(
        "extraction_at"
    )


# -- quality metrics ----------------------------------------------------------


def null_count(df: DataFrame, column: str, label: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("metric_value")).select(
        F.lit(label).alias("metric_name"), "metric_value"
    )


def duplicate_count(df: DataFrame, column: str, label: str) -> DataFrame:
    """Rows beyond the first of each value."""
    return duplicate_excess(df, [column], label)


def duplicate_raw_count(raw: DataFrame, label: str) -> DataFrame:
    """Payload and file repeated: a file loaded twice.

    Payloads are compared by their text, shortened to a hash before the shuffle.
    """
    text = F.to_json("raw_data")
    hashed = raw.select(
        F.when(F.col("raw_data").isNotNull(), F.sha2(text, 256)).alias("payload"),
        "filename",
    )
    return duplicate_excess(hashed, ["payload", "filename"], label)


Metric = Callable[[DataFrame], DataFrame]

# Metrics attached to each layer; they run whenever the layer changes.
LAYER_METRICS: dict[str, list[Metric]] = {
    "bronze": [
        lambda df: null_count(df, "raw_data", "bronze null raw_data"),
        lambda df: null_count(df, "filename", "bronze null filename"),
        lambda df: duplicate_raw_count(df, "bronze duplicate rows"),
    ],
    "silver": [
        lambda df: null_count(df, "station_id", "silver null station_id"),
        lambda df: null_count(df, "latitude", "silver null latitude"),
        lambda df: null_count(df, "longitude", "silver null longitude"),
        lambda df: duplicate_count(df, "station_id", "silver repeated station_id"),
    ],
    "gold": [
        lambda df: null_count(df, "total_stations", "gold null total_stations"),
        lambda df: null_count(df, "network_occupancy_pct", "gold null occupancy"),
    ],
}


# The same metrics for tables kept by jobs: label to column, nulls and repeated values.
SILVER_NULLS = {
    "silver null station_id": "station_id", "silver null latitude": "latitude",
    "silver null longitude": "longitude",
}
SILVER_REPEATED = {"silver repeated station_id": "station_id"}
GOLD_NULLS = {"gold null total_stations": "total_stations", "gold null occupancy": "network_occupancy_pct"}


def layer_metrics(layer: str, df: DataFrame) -> DataFrame:
    return union_all([metric(df) for metric in LAYER_METRICS[layer]])
