"""Loyalty programme: churn, visits, programmes and merchants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import mean, percent
from tidemark.functions.temporal import date_key, day_diff, month_floor
from tidemark.operators.joins import (
    dim_left_fact, missing_in, star_join, star_rollup,
)
from tidemark.operators.shape import (
    equal_width_histogram, rule_violations, share_of_total, top_k, union_all,
)

# Bounding box of the city.
LAT_RANGE, LNG_RANGE = (20.90, 21.05), (-89.70, -89.50)
INACTIVE_DAYS = 30

_NAME = "loyalty_type_name"


def flatten_users(raw: DataFrame) -> DataFrame:
    """User rows of JSON payloads; a field of the wrong type becomes null."""
    return _flatten(raw, {
        "user_id": "string", "first_name": "string", "last_name": "string",
        "email": "string", "registration_date": "date", "status": "string",
        "preferred_zone": "string",
    })


def flatten_businesses(raw: DataFrame) -> DataFrame:
    return _flatten(raw, {
        "business_id": "string", "business_name": "string", "category": "string",
        "loyalty_type": "string", "lat": "double", "long": "double",
        "google_rating": "double", "neighborhood": "string",
    })


def flatten_visits(raw: DataFrame) -> DataFrame:
    return _flatten(raw, {
        "visit_id": "string", "user_id": "string", "business_id": "string",
        "visit_timestamp": "timestamp_ntz", "visit_type": "string",
        "points_earned": "bigint", "cashback_amount": "decimal(12,2)",
        "punch_count": "int",
    })


def _flatten(raw: DataFrame, fields: dict[str, str]) -> DataFrame:
    return raw.select(
        *[
            F.try_variant_get("raw_data", f"$.{name}", kind).alias(name)
            for name, kind in fields.items()
        ]
    )


def load_fact_visits(
    visits: DataFrame, users: DataFrame, businesses: DataFrame, types: DataFrame
) -> DataFrame:
    """Visit fact: source ids replaced by the surrogate keys of the dimensions.

    Payloads weigh far more in memory than in their files, so file sizes must not
    choose a side to broadcast: visits meet users and businesses in merge joins.
    The programmes are a handful; they go to the businesses first, as a join of the
    visits by programme would put all of them in as many tasks.
    """
    typed = star_join(
        businesses, F.broadcast(types), "loyalty_type", _NAME, ["loyalty_type_key"]
    )
    keyed = star_join(visits.hint("merge"), users, "user_id", "user_id", ["user_key"])
    keyed = star_join(
        keyed.hint("merge"), typed, "business_id", "business_id",
        ["business_key", "loyalty_type_key"],
    )
    return keyed.select(
        "visit_id", date_key(F.col("visit_timestamp")).alias("date_key"), "user_key",
        "business_key", "loyalty_type_key", "visit_type", "visit_timestamp",
        "points_earned", "cashback_amount", "punch_count",
    )


# -- churn --------------------------------------------------------------------


def churn_flags(
    users: DataFrame, visits: DataFrame, as_of: Column,
    inactive_days: int = INACTIVE_DAYS,
) -> DataFrame:
    """Activity and churn status per user.

    Visits are aggregated per user before the join.  A user without visits has
    zero of them (counting joined rows would give one).
    """
    active = dim_left_fact(
        users.select(
            "user_key", "user_id",
            F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
            "status", "registration_date", "preferred_zone",
        ),
        visits,
        "user_key",
        {
            "first_visit": F.to_date(F.min("visit_timestamp")),
            "last_visit": F.to_date(F.max("visit_timestamp")),
            "total_visits": F.count("visit_key"),
            "distinct_businesses": F.count_distinct("business_key"),
            "total_points": F.sum("points_earned"),
            "total_cashback": F.sum("cashback_amount"),
        },
    ).fillna(0, ["total_visits", "distinct_businesses"])
    days = day_diff(F.col("last_visit"), as_of)
    return active.withColumns(
        {
            "days_since_last_visit": days,
            "churn_status": churn_status(F.col("last_visit"), days, inactive_days),
        }
    )


def churn_status(last_visit: Column, days: Column, inactive_days: int) -> Column:
    return (
        F.when(last_visit.isNull(), "never_visited")
        .when(days > inactive_days, "churned")
        .otherwise("active")
    )


def churn_report(flags: DataFrame) -> DataFrame:
    """Flags with the longest absent first, never-visitors on top."""
    return flags.orderBy(F.desc_nulls_first("days_since_last_visit"), "user_key")


def churn_summary(flags: DataFrame) -> DataFrame:
    """Users per status with averages and the share of all users."""
    groups = flags.groupBy("churn_status").agg(
        F.count("user_key").alias("user_count"),
        F.sum("total_visits").alias("_visits"),
        F.sum("total_points").alias("_points"),
        F.count("total_points").alias("_with_points"),
        F.sum("total_cashback").alias("_cashback"),
        F.count("total_cashback").alias("_with_cashback"),
    ).select(
        "churn_status", "user_count",
        mean(F.col("_visits"), F.col("user_count"), 4).alias("avg_total_visits"),
        mean(F.col("_points"), F.col("_with_points"), 4).alias("avg_points"),
        mean(F.col("_cashback"), F.col("_with_cashback"), 4).alias("avg_cashback"),
    )
    return share_of_total(groups, "user_count", "pct_of_total", 1)


def _churn_by(
    per_user: DataFrame, by: str, as_of: Column, inactive_days: int
) -> DataFrame:
    gone = day_diff(F.col("last_visit"), as_of) > inactive_days
    return (
        per_user.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("total_users"),
            F.count_if(gone).alias("churned_users"),
        )
        .withColumn(
            "churn_rate_pct", percent(F.col("churned_users"), F.col("total_users"), 1)
        )
        .orderBy(F.desc("churn_rate_pct"), by)
    )


def churn_by_loyalty_type(
    visits: DataFrame, types: DataFrame, as_of: Column,
    inactive_days: int = INACTIVE_DAYS,
) -> DataFrame:
    """Per user and programme first, per programme next."""
    last = visits.groupBy("user_key", "loyalty_type_key").agg(
        F.to_date(F.max("visit_timestamp")).alias("last_visit")
    )
    named = star_join(last, types, "loyalty_type_key", "loyalty_type_key", [_NAME])
    return _churn_by(named, _NAME, as_of, inactive_days)


def churn_by_category(
    visits: DataFrame, businesses: DataFrame, as_of: Column,
    inactive_days: int = INACTIVE_DAYS,
) -> DataFrame:
    """Per user and business, per user and category, then per category."""
    last = visits.groupBy("user_key", "business_key").agg(
        F.max("visit_timestamp").alias("last")
    )
    named = star_join(last, businesses, "business_key", "business_key", ["category"])
    per_user = named.groupBy("user_key", "category").agg(
        F.to_date(F.max("last")).alias("last_visit")
    )
    return _churn_by(per_user, "category", as_of, inactive_days)


def monthly_churn(visits: DataFrame) -> DataFrame:
    """Net loss of monthly active users, never below zero.

    A month after a gap has no predecessor and is left out.
    """
    active = visits.groupBy(month_floor(F.col("visit_timestamp")).alias("month")).agg(
        F.count_distinct("user_key").alias("users")
    )
    before = active.select(
        F.add_months("month", 1).alias("month"), F.col("users").alias("prev_active")
    )
    lost = F.greatest(F.col("prev_active") - F.col("users"), F.lit(0))
    return active.join(before, "month").select(
        "month", "prev_active", F.col("users").alias("curr_active"),
        lost.alias("lost_users"),
        percent(lost, F.col("prev_active"), 1).alias("monthly_churn_rate_pct"),
    ).orderBy("month")


def inactivity_histogram(flags: DataFrame, bins: int = 30) -> DataFrame:
    visited = flags.where(F.col("churn_status") != "never_visited")
    return equal_width_histogram(
        visited, "days_since_last_visit", bins, "churn_status"
    )


# -- dashboard ----------------------------------------------------------------


def kpis(visits: DataFrame, businesses: DataFrame, users: DataFrame) -> DataFrame:
    """All headline numbers as one row."""
    rated = businesses.agg(
        F.struct(
            mean(F.sum("google_rating"), F.count("google_rating"), 1).alias("avg"),
            F.count(F.lit(1)).alias("n"),
        ).alias("s")
    ).scalar()
    user_count = users.agg(F.count(F.lit(1)).alias("n")).scalar()

    def distinct(key: str) -> Column:
        """Exact count from one column: several at once multiply the fact."""
        return visits.agg(F.count_distinct(key).alias("n")).scalar()

    return visits.agg(
        F.sum("points_earned").alias("total_points"),
        F.sum("cashback_amount").alias("total_cashback"),
    ).withColumn("_b", rated).select(
        distinct("visit_key").alias("total_visits"),
        distinct("user_key").alias("active_users"),
        "total_points", "total_cashback",
        distinct("business_key").alias("businesses_visited"),
        F.col("_b.avg").alias("avg_rating"),
        F.col("_b.n").alias("total_businesses"), user_count.alias("total_users"),
    )


def visits_by_month(visits: DataFrame, dim_time: DataFrame) -> DataFrame:
    """Distinct users need the user in the grain: one row per day and user."""
    by = ["year", "month", "month_name"]
    per_day_user = visits.groupBy("date_key", "user_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cashback_amount").alias("cashback")
    )
    dated = star_join(per_day_user, dim_time, "date_key", "date_key", by)
    return dated.groupBy(*by).agg(
        F.sum("n").alias("visits"),
        F.count_distinct("user_key").alias("unique_users"),
        F.sum("cashback").alias("cashback"),
    ).orderBy("year", "month")


def visits_by_weekday(visits: DataFrame, dim_time: DataFrame) -> DataFrame:
    return star_rollup(
        visits, dim_time, "date_key", "date_key",
        ["day_of_week", "day_name", "is_weekend"], {"visits": F.lit(1)},
    ).orderBy("day_of_week")


def visits_by_hour(visits: DataFrame) -> DataFrame:
    return visits.groupBy(F.hour("visit_timestamp").alias("visit_hour")).agg(
        F.count(F.lit(1)).alias("visits")
    ).orderBy("visit_hour")


def visit_heatmap(visits: DataFrame, dim_time: DataFrame) -> DataFrame:
    per_hour = visits.groupBy(
        "date_key", F.hour("visit_timestamp").alias("visit_hour")
    ).agg(F.count(F.lit(1)).alias("n"))
    return (
        star_join(per_hour, dim_time, "date_key", "date_key",
                  ["day_name", "day_of_week"])
        .groupBy("day_name", "day_of_week", "visit_hour")
        .agg(F.sum("n").alias("visits"))
        .orderBy("day_of_week", "visit_hour")
    )


def loyalty_performance(visits: DataFrame, types: DataFrame) -> DataFrame:
    per_key = visits.groupBy("loyalty_type_key", "visit_type").agg(
        F.count(F.lit(1)).alias("visit_count"),
        F.sum("points_earned").alias("total_points"),
        F.sum("cashback_amount").alias("total_cashback"),
        F.sum("punch_count").alias("total_punches"),
    )
    return star_join(
        per_key, types, "loyalty_type_key", "loyalty_type_key", [_NAME]
    ).drop("loyalty_type_key").orderBy(_NAME, "visit_type")


def loyalty_rollup(performance: DataFrame) -> DataFrame:
    return performance.groupBy(_NAME).agg(
        *[
            F.sum(c).alias(c)
            for c in ("visit_count", "total_points", "total_cashback", "total_punches")
        ]
    )


def _per_business_user(visits: DataFrame) -> DataFrame:
    """Visit sums per business and user: the grain distinct users need."""
    return visits.groupBy("business_key", "user_key").agg(
        F.count("visit_key").alias("n"),
        F.sum("points_earned").alias("points"),
        F.sum("cashback_amount").alias("cashback"),
    )


def category_breakdown(visits: DataFrame, businesses: DataFrame) -> DataFrame:
    named = star_join(
        _per_business_user(visits), businesses, "business_key", "business_key",
        ["category"],
    )
    return named.groupBy("category").agg(
        F.sum("n").alias("visits"),
        F.count_distinct("user_key").alias("unique_users"),
        F.count_distinct("business_key").alias("business_count"),
        F.sum("points").alias("total_points"),
        F.sum("cashback").alias("total_cashback"),
    ).orderBy(F.desc("visits"), "category")


_MERCHANT = [
    "business_name", "category", "neighborhood", "loyalty_type", "google_rating",
]


def top_merchants(visits: DataFrame, businesses: DataFrame, k: int = 15) -> DataFrame:
    named = star_join(
        _per_business_user(visits), businesses, "business_key", "business_key",
        _MERCHANT,
    )
    sums = named.groupBy(*_MERCHANT).agg(
        F.sum("n").alias("total_visits"),
        F.count_distinct("user_key").alias("unique_visitors"),
        F.sum("cashback").alias("cashback_given"),
    )
    return top_k(sums, [F.desc("total_visits"), F.asc("business_name")], k)


def business_map(visits: DataFrame, businesses: DataFrame) -> DataFrame:
    counted = dim_left_fact(
        businesses, visits, "business_key", {"n": F.count("visit_key")}
    )
    return counted.groupBy(
        *_MERCHANT, F.col("lat").alias("latitude"), F.col("lng").alias("longitude")
    ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_visits"))


def neighborhood_stats(visits: DataFrame, businesses: DataFrame) -> DataFrame:
    """The rating is averaged over joined rows, as published: a business counts
    once per visit, and once when it has none."""
    per_user = _per_business_user(visits)
    joined = businesses.select("business_key", "neighborhood", "google_rating").join(
        per_user, "business_key", "left"
    )
    weight = F.coalesce(F.col("n"), F.lit(1))
    return joined.groupBy("neighborhood").agg(
        F.count_distinct("business_key").alias("businesses"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("visits"),
        F.count_distinct("user_key").alias("unique_users"),
        mean(
            F.sum(F.col("google_rating") * weight),
            F.sum(F.when(F.col("google_rating").isNotNull(), weight)), 1,
        ).alias("avg_rating"),
    ).orderBy(F.desc("visits"), "neighborhood")


def loyalty_checks(
    loads: dict[str, tuple[DataFrame, DataFrame]], visits: DataFrame, users: DataFrame,
    businesses: DataFrame, dim_time: DataFrame,
) -> DataFrame:
    """Completeness, foreign keys, bounding box and programme rules.

    ``loads`` names the landed rows and the loaded table of each source.
    """
    def lost(dim: DataFrame, key: str, label: str) -> DataFrame:
        per_key = visits.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return missing_in(per_key, dim, key).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("fail_count")
        ).select(F.lit(label).alias("check_name"), "fail_count")

    complete = [
        loaded.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(f"{name}: rows missing from raw").alias("check_name"),
            F.abs(raw.agg(F.count(F.lit(1)).alias("n")).scalar() - F.col("n")).alias(
                "fail_count"
            ),
        )
        for name, (raw, loaded) in loads.items()
    ]
    box = rule_violations(
        businesses,
        {
            "business: latitude outside box": ~F.col("lat").between(*LAT_RANGE),
            "business: longitude outside box": ~F.col("lng").between(*LNG_RANGE),
        },
    )
    # Conditions on the visit are counted per business before they meet its type.
    per_business = visits.groupBy("business_key").agg(
        F.count_if(F.col("cashback_amount") > 0).alias("paid"),
        F.count_if(F.col("punch_count") > 0).alias("punched"),
        F.count_if(F.col("points_earned") < 0).alias("negative"),
    )
    typed = star_join(
        per_business, businesses, "business_key", "business_key", ["loyalty_type"]
    ).agg(
        F.sum(F.when(F.col("loyalty_type") != "Cashback", F.col("paid")).otherwise(0))
        .alias("visit: cashback outside Cashback"),
        F.sum(F.when(F.col("loyalty_type") != "Punch Card", F.col("punched"))
              .otherwise(0)).alias("visit: punch outside Punch Card"),
        F.sum("negative").alias("visit: negative points"),
    )
    first = visits.groupBy("user_key", F.to_date("visit_timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    early = star_join(first, users, "user_key", "user_key", ["registration_date"]).agg(
        F.coalesce(
            F.sum(F.when(F.col("day") < F.col("registration_date"), F.col("n"))),
            F.lit(0),
        ).alias("fail_count")
    ).select(F.lit("visit: before registration").alias("check_name"), "fail_count")
    return union_all(
        [
            *complete,
            lost(users, "user_key", "visit: unknown user"),
            lost(businesses, "business_key", "visit: unknown business"),
            lost(dim_time, "date_key", "visit: unknown date"),
            box,
            typed.unpivot([], typed.columns, "check_name", "fail_count"),
            early,
        ]
    )


def redemption_rate(visits: DataFrame, types: DataFrame) -> DataFrame:
    """Share of visits that redeem a reward, per programme."""
    return star_rollup(
        visits, types, "loyalty_type_key", "loyalty_type_key", [_NAME],
        {
            "visits": F.lit(1),
            "redemptions": F.when(F.col("visit_type") == "redemption", 1).otherwise(0),
        },
    ).withColumn(
        "redemption_rate_pct", percent(F.col("redemptions"), F.col("visits"), 1)
    )


def foot_traffic(visits: DataFrame, businesses: DataFrame) -> DataFrame:
    """Visits by hour of day and business category."""
    per_hour = visits.groupBy(
        "business_key", F.hour("visit_timestamp").alias("visit_hour")
    ).agg(F.count(F.lit(1)).alias("n"))
    named = star_join(
        per_hour, businesses, "business_key", "business_key", ["category"]
    )
    return named.groupBy("visit_hour", "category").agg(F.sum("n").alias("visits"))
