"""Resource-usage monitoring for one user.

Time filters compare the raw column with a constant or scalar subquery, so they
are pushed to the scan together with the user filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import mean, ratio
from tidemark.functions.temporal import days_before, last_n_days
from tidemark.functions.text import map_values, owned_by_suffix
from tidemark.operators.shape import melt, top_k, union_all

# Statement types that name their object.
TYPED_STATEMENTS = {
    "CREATE_TABLE": "TABLE",
    "CREATE_TABLE_AS_SELECT": "TABLE (CTAS)",
    "CREATE_VIEW": "VIEW",
    "CREATE_SEMANTIC_VIEW": "SEMANTIC VIEW",
    "CREATE_ICEBERG_TABLE": "ICEBERG TABLE",
    "CREATE_STREAM": "STREAM",
    "CREATE_TASK": "TASK",
    "CREATE_ROLE": "ROLE",
}
# Words to look for, in this order, in other CREATE statements.
CREATE_WORDS = {
    "STREAMLIT": "STREAMLIT APP",
    "AGENT": "AGENT",
    "NOTEBOOK": "NOTEBOOK",
    "DASHBOARD": "DASHBOARD",
    "STAGE": "STAGE",
    "DATABASE": "DATABASE",
    "SCHEMA": "SCHEMA",
    "PROCEDURE": "PROCEDURE",
    "FUNCTION": "FUNCTION",
    "FILE FORMAT": "FILE FORMAT",
    "WORKSPACE": "WORKSPACE",
}
MIB, GIB = 1024**2, 1024**3


def _of_user(
    df: DataFrame, user: str, ts: str, days: int, as_of: Column, column: str
) -> DataFrame:
    return last_n_days(df.where(F.col(column) == user), ts, days, as_of)


def _sum0(column: str, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.sum(column), F.lit(0)), digits)


def user_list(users: DataFrame, prefix_pattern: str) -> DataFrame:
    return users.where(
        F.col("name").like(prefix_pattern) & F.col("deleted_on").isNull()
    ).select("name").orderBy("name")


def credit_summary(log: DataFrame, user: str, as_of: Column) -> DataFrame:
    rows = _of_user(log, user, "start_time", 30, as_of, "user_name")
    return rows.agg(
        _sum0("credits_attributed_compute").alias("total_compute_credits"),
        _sum0("credits_used_query_acceleration").alias("total_qas_credits"),
        F.count_distinct("query_id").alias("total_queries"),
        F.count_distinct("warehouse_name").alias("warehouses_used"),
    )


def assistant_summary(log: DataFrame, user: str, as_of: Column) -> DataFrame:
    rows = _of_user(log, user, "start_time", 30, as_of, "username")
    return rows.agg(
        _sum0("credits").alias("total_ai_credits"),
        F.coalesce(F.sum("request_count"), F.lit(0)).alias("total_requests"),
        F.count_distinct(F.to_date("start_time")).alias("active_days"),
    )


def week_over_week(log: DataFrame, user: str, as_of: Column) -> DataFrame:
    """Both weeks in one scan of the last fourteen days."""
    rows = _of_user(log, user, "start_time", 14, as_of, "user_name")
    this_week = F.col("start_time") >= days_before(as_of, 7)
    credits = F.col("credits_attributed_compute")

    def total(which: Column) -> Column:
        return F.round(F.coalesce(F.sum(F.when(which, credits)), F.lit(0)), 4)

    both = rows.agg(total(this_week).alias("c"), total(~this_week).alias("p"))
    change = F.col("c") - F.col("p")
    return both.select(
        F.col("c").alias("current_week_credits"),
        F.col("p").alias("previous_week_credits"),
        F.round(change, 4).alias("change"),
        F.when(
            F.col("p") > 0, F.round(ratio(change, F.col("p")) * 100, 2)
        ).alias("pct_change"),
    )


def daily_credits(log: DataFrame, user: str, as_of: Column) -> DataFrame:
    rows = _of_user(log, user, "start_time", 30, as_of, "user_name")
    return rows.groupBy(F.to_date("start_time").alias("usage_date")).agg(
        F.round(F.sum("credits_attributed_compute"), 4).alias("daily_compute_credits"),
        _sum0("credits_used_query_acceleration").alias("daily_qas_credits"),
        F.count_distinct("query_id").alias("daily_query_count"),
    ).orderBy("usage_date")


def daily_assistant_credits(log: DataFrame, user: str, as_of: Column) -> DataFrame:
    rows = _of_user(log, user, "start_time", 30, as_of, "username")
    return rows.groupBy(F.to_date("start_time").alias("usage_date")).agg(
        F.round(F.sum("credits"), 4).alias("daily_credits"),
        F.sum("request_count").alias("daily_requests"),
    ).orderBy("usage_date")


def credits_by_warehouse(log: DataFrame, user: str, as_of: Column) -> DataFrame:
    rows = _of_user(log, user, "start_time", 30, as_of, "user_name")
    credits = "credits_attributed_compute"
    return rows.groupBy("warehouse_name").agg(
        F.round(F.sum(credits), 4).alias("total_credits"),
        F.count_distinct("query_id").alias("query_count"),
        mean(F.sum(credits), F.count(credits), 6).alias("avg_credits_per_query"),
    ).orderBy(F.desc("total_credits"), "warehouse_name")


def query_type_stats(log: DataFrame, user: str, as_of: Column) -> DataFrame:
    rows = _of_user(log, user, "start_time", 7, as_of, "user_name")
    elapsed, scanned = "total_elapsed_time", "bytes_scanned"
    return rows.groupBy("query_type").agg(
        F.count(F.lit(1)).alias("execution_count"),
        F.round(ratio(F.sum(elapsed), F.count(elapsed)) / 1000, 2).alias(
            "avg_duration_sec"
        ),
        F.round(F.max(elapsed).cast("double") / 1000, 2).alias("max_duration_sec"),
        F.round(ratio(F.sum(scanned), F.count(scanned)) / MIB, 2).alias(
            "avg_mb_scanned"
        ),
    ).orderBy(F.desc("execution_count"), "query_type")


def classify_object(query_type: Column, query_text: Column) -> Column:
    """Object kind a CREATE statement makes."""
    text = F.upper(query_text)
    label = map_values(query_type, TYPED_STATEMENTS)
    for word, kind in CREATE_WORDS.items():
        label = label.when((query_type == "CREATE") & text.contains(word), kind)
    return label.otherwise("OTHER")


def objects_created(log: DataFrame, user: str, as_of: Column) -> DataFrame:
    """Distinct statements per kind, so repeated CREATE OR REPLACE counts once."""
    rows = _of_user(log, user, "start_time", 90, as_of, "user_name").where(
        F.col("query_type").like("CREATE%") & (F.col("execution_status") == "SUCCESS")
    )
    kind = classify_object(F.col("query_type"), F.col("query_text"))
    return rows.groupBy(kind.alias("object_type")).agg(
        F.count_distinct("query_hash").alias("objects_created")
    ).orderBy(F.desc("objects_created"), "object_type")


def live_objects(listings: dict[str, DataFrame], suffix: str) -> DataFrame:
    """Objects not deleted, per kind, in databases carrying the suffix.

    A listing with a ``table_type`` holds views as well: base tables count only.
    """
    def of_kind(df: DataFrame) -> DataFrame:
        return df.where("table_type = 'BASE TABLE'") if "table_type" in df.columns else df

    parts = [
        of_kind(df)
        .where(F.col("deleted").isNull() & owned_by_suffix(F.col("catalog"), suffix))
        .agg(F.count(F.lit(1)).alias("object_count"))
        .select(F.lit(kind).alias("object_type"), "object_count")
        for kind, df in listings.items()
    ]
    return union_all(parts).orderBy(F.desc("object_count"), "object_type")


def storage_averages(history: DataFrame, suffix: str, as_of: Column) -> DataFrame:
    rows = last_n_days(history, "sampled_at", 30, as_of).where(
        owned_by_suffix(F.col("database_name"), suffix)
    )
    base, safe = "average_database_bytes", "average_failsafe_bytes"
    whole = F.col(base) + F.col(safe) + F.coalesce(
        "average_hybrid_table_storage_bytes", F.lit(0)
    )

    def gb(value: Column) -> Column:
        return F.round(ratio(F.sum(value), F.count(value)) / GIB, 4)

    return rows.groupBy("database_name").agg(
        gb(F.col(base)).alias("avg_storage_gb"),
        gb(F.col(safe)).alias("avg_failsafe_gb"),
        gb(whole).alias("total_avg_gb"),
    ).orderBy(F.desc("total_avg_gb"), "database_name")


def login_days(log: DataFrame, user: str, as_of: Column) -> DataFrame:
    rows = _of_user(log, user, "event_timestamp", 7, as_of, "user_name")
    return rows.groupBy(F.to_date("event_timestamp").alias("login_date")).agg(
        F.count(F.lit(1)).alias("login_count"),
        F.count_if(F.col("is_success") == "YES").alias("successful_logins"),
        F.count_if(F.col("is_success") == "NO").alias("failed_logins"),
    ).orderBy("login_date")


def melt_logins(logins: DataFrame) -> DataFrame:
    return melt(
        logins, ["login_date"], ["successful_logins", "failed_logins"], "status",
        "count",
    )


def expensive_queries(
    log: DataFrame, user: str, as_of: Column, k: int = 15
) -> DataFrame:
    credits = F.col("credits_attributed_compute")
    rows = _of_user(log, user, "start_time", 30, as_of, "user_name").where(credits > 0)
    top = top_k(rows, [credits.desc(), F.asc("query_id")], k)
    return top.select(
        "query_id", "warehouse_name",
        F.round(credits, 6).alias("credits_compute"),
        F.round(
            F.coalesce("credits_used_query_acceleration", F.lit(0)), 6
        ).alias("credits_qas"),
        "start_time",
    )
