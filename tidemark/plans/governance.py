"""Governed views, access reviews, audit filters and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.masks import (
    ANALYST, COMPLIANCE, EXECUTIVE, OPS, SERVICE, masked,
)
from tidemark.functions.temporal import day_diff, in_zone, iso_weekday, last_minutes, last_n_days
from tidemark.functions.text import name_matches_any
from tidemark.operators.shape import labelled_counts, list_distinct
from tidemark.streaming.jobs import sliding_counts

# Who sees all rows, and which columns each tag hides from whom.
ALL_ROWS = {OPS, COMPLIANCE, EXECUTIVE}
VISIBLE_TO = {
    "PUBLIC": {OPS, COMPLIANCE, EXECUTIVE, ANALYST, SERVICE},
    "RESTRICTED": {COMPLIANCE},
    "CONFIDENTIAL": {OPS, COMPLIANCE, EXECUTIVE, ANALYST},
    "INTERNAL": {OPS, COMPLIANCE},
}
ADMIN_ROLE = "ACCOUNTADMIN"
FAILED_LOGINS, BULK_ROWS = 5, 10_000
OFFICE_HOURS, OFFICE_ZONE = (6, 22), "America/New_York"


def masked_view(df: DataFrame, columns: dict[str, str], role: str) -> DataFrame:
    """The table as a role sees it; ``columns`` maps a column to its mask."""
    return df.select(
        *[
            masked(columns[c], F.col(c), role).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def row_access(
    df: DataFrame, access_map: DataFrame, user: str, role: str
) -> DataFrame:
    """Client rows a user may see.

    In the map a null office means all offices and a null client all clients.
    The entries of the user are split by which parts they name, so every lookup
    is a plain semi-join on equal keys.
    """
    if role in ALL_ROWS:
        return df
    mine = access_map.where(F.col("user_email") == user)
    office, client = F.col("office_location"), F.col("client_key")
    named = ["client_key", "office_location"]
    everything = mine.agg(
        F.count_if(office.isNull() & client.isNull()).alias("n")
    ).scalar()
    both = mine.where(office.isNotNull() & client.isNotNull())
    by_office = mine.where(office.isNotNull() & client.isNull())
    by_client = mine.where(office.isNull() & client.isNotNull())

    def marked(keys: list[str], entries: DataFrame, mark: str) -> DataFrame:
        return entries.select(*keys).distinct().withColumn(mark, F.lit(True))

    tagged = (
        df.join(marked(named, both, "_b"), named, "left")
        .join(marked(["office_location"], by_office, "_o"), "office_location", "left")
        .join(marked(["client_key"], by_client, "_c"), "client_key", "left")
    )
    allowed = F.coalesce("_b", "_o", "_c", F.lit(False)) | (everything > 0)
    return tagged.where(allowed).select(*df.columns)


def row_access_by_client(
    fact: DataFrame, access_map: DataFrame, user: str, role: str
) -> DataFrame:
    """Fact rows of the clients a user is mapped to."""
    if role in ALL_ROWS:
        return fact
    mine = access_map.where(
        (F.col("user_email") == user) & F.col("client_key").isNotNull()
    )
    return fact.join(mine.select("client_key"), "client_key", "left_semi")


def visible_columns(df: DataFrame, tags: dict[str, str], role: str) -> DataFrame:
    """Columns whose tag the role may read; untagged columns are public."""
    return df.select(
        *[c for c in df.columns if role in VISIBLE_TO[tags.get(c, "PUBLIC")]]
    )


# -- access review ------------------------------------------------------------


def access_review(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Live users with the roles they hold, newest login first."""
    roles = list_distinct(
        grants.where(F.col("deleted_on").isNull()), ["grantee_name"], "role", "roles"
    )
    return (
        users.where(F.col("deleted_on").isNull())
        .join(roles, F.col("name") == F.col("grantee_name"), "left")
        .select(
            F.col("name").alias("user_name"), "email", "disabled",
            "last_success_login", F.coalesce("roles", F.lit("")).alias("roles"),
        )
        .orderBy(F.desc_nulls_last("last_success_login"), "user_name")
    )


def inactive_users(users: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    idle = day_diff(F.col("last_success_login"), as_of)
    return users.where(
        F.col("deleted_on").isNull()
        & (F.col("disabled") == "false")
        & (F.col("last_success_login").isNull() | (idle > days))
    ).select("name", "email", "last_success_login", idle.alias("days_inactive"))


def admin_grants(grants: DataFrame) -> DataFrame:
    return grants.where(
        (F.col("role") == ADMIN_ROLE) & F.col("deleted_on").isNull()
    ).select("grantee_name", "role", "granted_on")


# -- audit --------------------------------------------------------------------


def pii_queries(log: DataFrame, as_of: Column) -> DataFrame:
    """Successful queries that mention client data, last 30 days."""
    return last_n_days(log, "start_time", 30, as_of).where(
        name_matches_any(F.col("query_text"), ["%DIM_CLIENT%", "%CLIENT_NAME%"])
        & (F.col("execution_status") == "SUCCESS")
    ).select("user_name", "role_name", "query_text", "start_time", "rows_produced")


def admin_use(log: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return last_n_days(log, "start_time", days, as_of).where(
        F.col("role_name") == ADMIN_ROLE
    ).select("user_name", "role_name", "query_text", "start_time")


def tagged_queries(log: DataFrame, tag_pattern: str, as_of: Column) -> DataFrame:
    """Queries with a tag (written by an assistant), last 7 days."""
    return last_n_days(log, "start_time", 7, as_of).where(
        F.col("query_tag").ilike(tag_pattern)
    ).select(
        "user_name", "role_name", "query_text", "rows_produced", "start_time",
        (F.col("total_elapsed_time").cast("double") / 1000).alias("duration_sec"),
    )


def failed_logins_by_day(log: DataFrame, as_of: Column) -> DataFrame:
    """Failed logins per day with users and source addresses, last 90 days.

    Counting per day, user and address first leaves one small row per
    combination for the distinct counts and the list.
    """
    failed = last_n_days(log, "event_timestamp", 90, as_of).where(
        F.col("is_success") == "NO"
    ).select(F.to_date("event_timestamp").alias("day"), "user_name", "client_ip")
    once = failed.groupBy("day", "user_name", "client_ip").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = once.groupBy("day").agg(
        F.sum("n").alias("failed_logins"),
        F.count_distinct("user_name").alias("distinct_users"),
    )
    return counts.join(
        list_distinct(once, ["day"], "client_ip", "source_ips"), "day", "left"
    )


def log_coverage(
    logs: dict[str, tuple[DataFrame, str, int]], as_of: Column
) -> DataFrame:
    """Rows each log received lately; a silent log is a finding."""
    return labelled_counts(
        {n: last_n_days(df, ts, days, as_of) for n, (df, ts, days) in logs.items()},
        "log_name", "events",
    )


# -- alerts -------------------------------------------------------------------


def failed_login_spikes(
    logins: DataFrame, threshold: int = FAILED_LOGINS, width: str = "10 minutes",
    step: str = "5 minutes",
) -> DataFrame:
    """Sliding windows with too many failed logins."""
    failed = logins.where(F.col("is_success") == "NO")
    counted = sliding_counts(failed, "event_timestamp", width, step)
    return counted.where(F.col("n") > threshold).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        F.col("n").alias("failed_logins"),
    )


def off_hours_access(
    log: DataFrame, database: str, as_of: Column, minutes: int = 30
) -> DataFrame:
    """Access of the last minutes outside 6-22 h on weekdays, local time of the office.

    Hour and weekday are both taken from the local time.
    """
    local = in_zone(F.col("start_time"), OFFICE_ZONE)
    outside = ~F.hour(local).between(*OFFICE_HOURS) | (iso_weekday(local) > 5)
    return last_minutes(log, "start_time", minutes, as_of).where(
        (F.col("database_name") == database)
        & outside
        & (F.col("role_name") != SERVICE)
    ).select(
        "user_name", "role_name", "start_time", local.alias("local_time")
    )


def bulk_exports(
    log: DataFrame, database: str, as_of: Column, minutes: int = 15, rows: int = BULK_ROWS
) -> DataFrame:
    """Large results of the last minutes."""
    return last_minutes(log, "start_time", minutes, as_of).where(
        (F.col("database_name") == database)
        & (F.col("rows_produced") > rows)
        & ~F.col("role_name").isin(SERVICE, OPS)
    ).select("user_name", "role_name", "start_time", "rows_produced")


def admin_alerts(log: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Use of the administrator role in the last minutes."""
    recent = last_minutes(log, "start_time", minutes, as_of)
    return recent.where(F.col("role_name") == ADMIN_ROLE).select(
        "user_name", "role_name", "start_time"
    )
