"""Registry of runnable queries: name -> (spark, folder) -> DataFrame.

Names start with the inventory id of what they run.  ``as_of`` is always the
newest timestamp of the table in question.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DecimalType, DoubleType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)

from tidemark.functions.masks import ANALYST, OPS
from tidemark.functions.money import cents
from tidemark.functions.temporal import (
    day_diff, hour_floor, latest, minute_diff,
)
from tidemark.functions.text import suffix_after_last
from tidemark.operators import shape
from tidemark.operators.dedupe import duplicate_keys, latest_per_key
from tidemark.operators.joins import asof_latest, present_in, with_boundary
from tidemark.plans import (
    bikes, curation, entities, finance, governance, loyalty, loyalty_load, model, staging, usage,
    validation,
)
from tidemark.plans.adapters import Tables
from tidemark.session import scratch_path, stored
from tidemark.sources import files, tables
from tidemark.streaming import jobs
from tidemark.streaming.metric_log import MetricLog

Query = Callable[[SparkSession, str], DataFrame]
USER = "USER_8"
SUFFIX = "8"

REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {}


def register(name: str):
    def add(build: Callable[[Tables], DataFrame]):
        REGISTRY[name] = build
        return build

    return add


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for engines that type sums differently."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def queries() -> dict[str, Query]:
    def runner(build: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, folder: comparable(build(Tables(spark, folder)))

    return {name: runner(build) for name, build in REGISTRY.items()}


def _ship_day(t: Tables) -> Column:
    return F.to_date(latest(t.lineitem, "l_shipdate"))


def _since(t: Tables, days: int = 0, months: int = 0) -> Column:
    """First day a check over the last days or months looks at."""
    day = _ship_day(t)
    if days:
        return F.date_sub(day, days)
    return F.add_months(F.trunc(day, "month"), -months)


def _event_time(t: Tables) -> Column:
    return latest(t.events, "ts")


# -- sources and sinks --------------------------------------------------------


def _base_name(column: str) -> Column:
    return F.substring_index(column, "/", -1)


@register("s01_land_parquet")
def _(t: Tables) -> DataFrame:
    raw = files.land_parquet(t.spark, f"{t.folder}/orders.parquet")
    return raw.select(
        F.variant_get("raw_data", "$.o_orderkey", "bigint").alias("o_orderkey"),
        F.variant_get("raw_data", "$.o_orderstatus", "string").alias("o_orderstatus"),
        _base_name("filename").alias("filename"),
    )


@register("s02_land_csv")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    t.customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, "NULL")
        .when(F.col("c_nationkey") == 3, "")
        .otherwise(F.concat(F.col("c_name"), F.lit(', "the" client'))).alias("c_name"),
        F.col("c_acctbal"),
    ).write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    schema = StructType([
        StructField("c_custkey", LongType()), StructField("c_name", StringType()),
        StructField("c_acctbal", DoubleType()),
    ])
    good, _bad = files.split_bad_rows(files.land_csv(t.spark, path, schema))
    return good.drop("filename")


def _json_lines(t: Tables) -> str:
    """Orders as JSON lines; the pending ones are cut and do not parse."""
    path = scratch_path(t.spark, "json")
    text = F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))
    t.orders.select(
        F.when(F.col("o_orderstatus") == "P", F.rtrim(text, F.lit("}")))
        .otherwise(text).alias("value")
    ).write.text(path)
    return path


@register("s03_land_json")
def _(t: Tables) -> DataFrame:
    good, _bad = files.split_bad_rows(files.land_json(t.spark, _json_lines(t)))
    return good.select(
        F.variant_get("raw_data", "$.o_orderkey", "bigint").alias("o_orderkey"),
        F.variant_get("raw_data", "$.o_custkey", "bigint").alias("o_custkey"),
    )


@register("s05_quarantine")
def _(t: Tables) -> DataFrame:
    good, bad = files.split_bad_rows(files.land_json(t.spark, _json_lines(t)))
    return shape.labelled_counts({"good": good, "bad": bad}, "side", "n_rows")


@register("s04_ingest_new_files")
def _(t: Tables) -> DataFrame:
    sink, mark = scratch_path(t.spark, "bronze"), scratch_path(t.spark, "mark")
    schema = t.orders.schema
    for _run in range(2):  # the second run finds nothing new
        jobs.ingest_new_files(
            t.spark, t.folder, schema, sink, mark, pattern="orders.parquet"
        )
    return t.spark.read.parquet(sink).select(
        "o_orderkey", "o_custkey", _base_name("filename").alias("filename")
    )


@register("s06_full_replace")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "reference")
    tables.full_replace(t.nation.where("n_regionkey = 0"), path)
    tables.full_replace(t.nation, path)
    return tables.read_current(t.spark, path)


def _dated_orders(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.year("o_orderdate").alias("order_year"),
    )


@register("s07_append_dedup")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "append")
    rows = _dated_orders(t)
    for load in (rows.where("o_orderstatus != 'P'"), rows):
        tables.append_dedup(load, path, ["o_orderkey"], "order_year")
    return tables.read_table(t.spark, path, rows.schema)


@register("s08_upsert")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "upsert")
    rows = _dated_orders(t)
    tables.upsert(rows.where("o_orderstatus != 'F'"), path, ["o_orderkey"],
                  "order_year")
    paid = rows.where("o_orderstatus != 'O'").withColumn("o_orderstatus", F.lit("X"))
    tables.upsert(paid, path, ["o_orderkey"], "order_year")
    return tables.read_table(t.spark, path, rows.schema)


@register("s10_flatten_snapshot")
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    station = F.struct(
        F.col("user_id").alias("id"), F.floor("value").alias("free_bikes"),
        F.struct(k.alias("slots"), F.col("event_type").alias("light")).alias("extra"),
    )
    snapshots = t.events.select(
        F.struct(F.array(station).alias("stations")).alias("network"),
        F.col("ts").alias("extraction_at"),
    )
    return files.flatten_snapshot(snapshots).withColumnsRenamed(
        {"extra.slots": "extra_slots", "extra.light": "extra_light"}
    )


# -- joins, windows and shapes of their own ----------------------------------


@register("j06_exists")
def _(t: Tables) -> DataFrame:
    busy = t.orders.where(F.col("o_totalprice") > 400000)
    return present_in(t.customer, busy, "c_custkey", "o_custkey").select(
        "c_custkey", "c_name"
    )


@register("j07_boundary")
def _(t: Tables) -> DataFrame:
    dated = with_boundary(
        t.orders.select("o_orderkey", "o_orderdate"),
        newest=latest(t.orders, "o_orderdate"),
    )
    return dated.select(
        "o_orderkey", day_diff(F.col("o_orderdate"), F.col("newest")).alias("age_days")
    )


@register("j11_asof_rates")
def _(t: Tables) -> DataFrame:
    """Latest returned-line rate of the part at or before each shipping date."""
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.to_date("l_shipdate").alias("ship_date"),
    )
    rates = t.lineitem.where("l_returnflag = 'R'").groupBy(
        "l_partkey", F.to_date("l_shipdate").alias("effective_date")
    ).agg((F.max(cents(F.col("l_discount"))) * 10000).cast("bigint").alias("rate_bps"))
    return asof_latest(
        lines, rates, ["l_partkey"], "ship_date", "effective_date", ["rate_bps"]
    )


@register("j11_asof_events")
def _(t: Tables) -> DataFrame:
    """Latest sign-up value of the user at or before each event, to the
    microsecond; lines are cut by day."""
    events = t.events.select("event_id", "user_id", "ts")
    signups = t.events.where("event_type = 'signup'").groupBy(
        "user_id", F.col("ts").alias("since")
    ).agg(F.max("value").alias("signup_value"))
    return asof_latest(
        events, signups, ["user_id"], "ts", "since", ["signup_value"], slice_by="day"
    ).select("event_id", "user_id", "signup_value")


@register("a06_duplicate_keys")
def _(t: Tables) -> DataFrame:
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@register("a09_list_distinct")
def _(t: Tables) -> DataFrame:
    return shape.list_distinct(t.orders, ["o_custkey"], "o_orderpriority", "priorities")


@register("w01_latest_per_key")
def _(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    return latest_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")])


@register("w07_previous_in_group")
def _(t: Tables) -> DataFrame:
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.sum(cents(F.col("value"))).alias("total")
    )
    before = F.lag("total").over(Window.partitionBy("user_id").orderBy("day"))
    return daily.select("user_id", "day", "total", before.alias("previous_total"))


@register("a12_domain_check")
def _(t: Tables) -> DataFrame:
    return validation.segment_domain(
        t.dim_client(), ["HOUSEHOLD", "MACHINERY", "BUILDING"]
    )


@register("p12_filter_segment")
def _(t: Tables) -> DataFrame:
    clients = shape.filter_eq(t.dim_client(), "client_segment", "BUILDING")
    return finance.client_profitability(t.fact_revenue(True), clients)


@register("f09_boundary_diffs")
def _(t: Tables) -> DataFrame:
    end = _event_time(t)
    return t.events.select(
        "event_id", day_diff(F.col("ts"), end).alias("days"),
        minute_diff(F.col("ts"), end).alias("minutes"),
        hour_floor(F.col("ts")).alias("hour_start"),
    )


@register("f04_user_suffix")
def _(t: Tables) -> DataFrame:
    return t.login_history().select(
        "user_name", suffix_after_last(F.col("user_name")).alias("suffix")
    ).distinct()


# -- bike share ---------------------------------------------------------------


@register("b01_silver_clean")
def _(t: Tables) -> DataFrame:
    silver = bikes.silver_clean(t.bike_stations_raw())
    return silver.withColumn("api_timestamp", F.col("api_timestamp").cast("timestamp_ntz"))


def _usable(t: Tables) -> DataFrame:
    return bikes.usable(bikes.project_columns(t.station_payloads()))


def _silver(t: Tables) -> DataFrame:
    return bikes.silver_latest(_usable(t))


def _newest_hourly(t: Tables) -> DataFrame:
    return bikes.station_hourly(bikes.silver_latest(bikes.newest_hour(_usable(t))))


@register("b02_network_summary")
def _(t: Tables) -> DataFrame:
    return bikes.network_summary(_silver(t))


@register("b03_station_hourly")
def _(t: Tables) -> DataFrame:
    return bikes.station_hourly(_silver(t))


@register("b04_latest_snapshot")
def _(t: Tables) -> DataFrame:
    """The newest snapshot is found before anything is aggregated."""
    rows = _usable(t)
    newest = rows.where(F.col("extraction_at") == latest(rows, "extraction_at"))
    return bikes.latest_snapshot(bikes.network_summary(bikes.silver_latest(newest)))


@register("b04_map_rows")
def _(t: Tables) -> DataFrame:
    rows = bikes.map_rows(_newest_hourly(t))
    return rows.select(
        "station_name", "avg_occupancy_pct", "radius",
        F.array_join(F.col("color").cast("array<string>"), ",").alias("color"),
    )


@register("b04_top_bottom")
def _(t: Tables) -> DataFrame:
    return bikes.top_bottom_stations(_newest_hourly(t))


@register("b04_occupancy_series")
def _(t: Tables) -> DataFrame:
    return bikes.occupancy_series(bikes.network_summary(_silver(t)))


@register("d01_quality_metrics")
def _(t: Tables) -> DataFrame:
    silver = _silver(t)
    return shape.union_all([
        bikes.layer_metrics("bronze", t.bike_stations_raw()),
        bikes.layer_metrics("silver", silver),
        bikes.layer_metrics("gold", bikes.network_summary(silver)),
    ])


# -- finance ------------------------------------------------------------------


@register("q01_kpi_revenue")
def _(t: Tables) -> DataFrame:
    return finance.kpi_with_change(t.fact_revenue(), t.dim_date(), "revenue_amount")


@register("q02_kpi_expenses")
def _(t: Tables) -> DataFrame:
    return finance.kpi_with_change(t.fact_expense(), t.dim_date(), "expense_amount")


@register("q03_pl_trend")
def _(t: Tables) -> DataFrame:
    return finance.pl_trend(t.fact_revenue(), t.fact_expense(), t.dim_date())


@register("q04_kpi_net_income")
def _(t: Tables) -> DataFrame:
    return finance.kpi_net_income(t.fact_revenue(), t.fact_expense())


@register("q05_kpi_clients")
def _(t: Tables) -> DataFrame:
    return finance.kpi_clients(t.dim_client(), t.fact_revenue())


@register("q06_revenue_by_segment")
def _(t: Tables) -> DataFrame:
    return finance.revenue_by_segment(t.fact_revenue(True), t.dim_client())


@register("q07_revenue_by_product")
def _(t: Tables) -> DataFrame:
    return finance.revenue_by_product(t.fact_revenue(), t.dim_product())


@register("q08_top_expenses")
def _(t: Tables) -> DataFrame:
    return finance.top_expense_categories(
        t.fact_expense(), t.dim_cost_center(), t.dim_expense_category()
    )


@register("q09_client_profitability")
def _(t: Tables) -> DataFrame:
    return finance.client_profitability(t.fact_revenue(True), t.dim_client())


@register("q09_client_profitability_text")
def _(t: Tables) -> DataFrame:
    return finance.client_profitability_text(t.fact_revenue(True), t.dim_client())


@register("q10_monthly_overview")
def _(t: Tables) -> DataFrame:
    return finance.monthly_overview(t.fact_revenue())


@register("q10_grand_total")
def _(t: Tables) -> DataFrame:
    return finance.grand_total(t.fact_revenue())


@register("q10_peak_and_low")
def _(t: Tables) -> DataFrame:
    return finance.peak_and_low(t.fact_revenue())


@register("q10_monthly_change")
def _(t: Tables) -> DataFrame:
    return finance.monthly_change(t.fact_revenue())


# -- validation ---------------------------------------------------------------


@register("q11_row_counts")
def _(t: Tables) -> DataFrame:
    return validation.row_counts({
        "DIM_DATE": t.dim_date(), "DIM_CLIENT": t.dim_client(),
        "DIM_PRODUCT": t.dim_product(), "DIM_COST_CENTER": t.dim_cost_center(),
        "DIM_GL_ACCOUNT": t.dim_gl_account(), "FACT_REVENUE": t.fact_revenue(),
        "FACT_EXPENSE": t.fact_expense(), "FACT_BUDGET": t.fact_budget(),
        "FACT_CLIENT_AUM": t.fact_client_aum(),
    })


@register("q11_raw_vs_curated_counts")
def _(t: Tables) -> DataFrame:
    return validation.row_counts({
        "CRM accounts (raw)": t.crm_accounts(),
        "DIM_CLIENT (curated)": _clients(t),
        "Ledger lines (raw)": t.ledger_lines(),
        "FACT_EXPENSE (curated)": _expense(t),
    }, "source")


@register("q12_daily_row_trend")
def _(t: Tables) -> DataFrame:
    return validation.daily_row_trend(
        t.dim_date(), t.fact_revenue(since=_since(t, days=7)),
        t.fact_expense(since=_since(t, days=7)), _ship_day(t),
    )


@register("q13_revenue_reconciliation")
def _(t: Tables) -> DataFrame:
    return validation.raw_vs_curated_revenue(
        t.portfolio_transactions(False), t.fact_revenue(since=_since(t)), t.dim_date(),
        _ship_day(t),
    )


@register("q13_expense_reconciliation")
def _(t: Tables) -> DataFrame:
    as_of = F.to_date(latest(t.orders, "o_orderdate"))
    return validation.raw_vs_curated_expense(
        t.ledger_lines(), t.ledger_transactions(), t.ledger_accounts(), _expense(t),
        t.dim_date(), as_of,
    )


@register("q13_expense_tolerance")
def _(t: Tables) -> DataFrame:
    """The month's expenses must agree within ten dollars."""
    return validation.within_tolerance(REGISTRY["q13_expense_reconciliation"](t), 10)


@register("q14_revenue_by_month")
def _(t: Tables) -> DataFrame:
    return validation.revenue_by_month(
        t.fact_revenue(since=_since(t, months=6)), t.dim_date(), _ship_day(t)
    )


@register("q14_expense_by_month")
def _(t: Tables) -> DataFrame:
    return validation.expense_by_month(
        t.fact_expense(since=_since(t, months=6)), t.dim_date(), _ship_day(t)
    )


@register("q15_profitability_band")
def _(t: Tables) -> DataFrame:
    return validation.profitability_band(
        t.fact_revenue(since=_since(t, months=12)),
        t.fact_expense(since=_since(t, months=12)), t.dim_date(), _ship_day(t),
    )


@register("q16_calendar_continuity")
def _(t: Tables) -> DataFrame:
    """Dates of all orders taken as the calendar."""
    days = t.orders.select(F.to_date("o_orderdate").alias("calendar_date"))
    return validation.missing_calendar_days(days.distinct())


@register("q17_days_without_revenue")
def _(t: Tables) -> DataFrame:
    return validation.business_days_without_rows(
        t.dim_date(), t.fact_revenue(), _ship_day(t), 365, ["gl_account_key"]
    )


@register("q18_expense_gaps")
def _(t: Tables) -> DataFrame:
    return validation.expense_gap_runs(
        t.dim_date(), t.fact_expense(), _ship_day(t), 365, ["gl_account_key"]
    )


@register("q19_latest_dates")
def _(t: Tables) -> DataFrame:
    return validation.latest_dates(
        {"FACT_REVENUE": t.fact_revenue(), "FACT_EXPENSE": t.fact_expense(),
         "FACT_CLIENT_AUM": t.fact_client_aum()},
        t.dim_date(), _ship_day(t),
    )


@register("q20_orphan_keys")
def _(t: Tables) -> DataFrame:
    dates, products = t.dim_date(), t.dim_product()
    accounts, centers = t.dim_gl_account(), t.dim_cost_center()
    clients = t.customer.withColumnRenamed("c_custkey", "client_key")
    date = ("date_key", dates, "date_key", False)
    client = ("client_key", clients, "client_key", False)
    account = ("gl_account_key", accounts, "gl_account_key", False)
    return shape.union_all([
        # the client of a revenue row takes a join, the other keys do not
        validation.orphan_checks(t.fact_revenue(True), "FACT_REVENUE", {
            "DIM_CLIENT": client,
        }),
        validation.orphan_checks(t.fact_revenue(), "FACT_REVENUE", {
            "DIM_DATE": date,
            "DIM_PRODUCT": ("product_key", products, "product_key", False),
            "DIM_GL_ACCOUNT": account,
        }),
        validation.orphan_checks(t.fact_expense(), "FACT_EXPENSE", {
            "DIM_DATE": date,
            "DIM_COST_CENTER": ("cost_center_key", centers, "cost_center_key", False),
            "DIM_GL_ACCOUNT": account,
        }),
        validation.orphan_checks(t.fact_budget(), "FACT_BUDGET", {
            "DIM_DATE": date, "DIM_GL_ACCOUNT": account,
            "DIM_COST_CENTER": ("cost_center_key", centers, "cost_center_key", True),
            "DIM_PRODUCT": ("product_key", products, "product_key", True),
        }),
        validation.orphan_checks(t.fact_client_aum(), "FACT_CLIENT_AUM", {
            "DIM_DATE": date, "DIM_CLIENT": client,
            "DIM_PRODUCT": ("product_key", products, "product_key", False),
        }),
    ])


@register("q21_crossref_coverage")
def _(t: Tables) -> DataFrame:
    return validation.crossref_coverage(t.dim_client(), t.entity_crossref())


@register("q22_raw_freshness")
def _(t: Tables) -> DataFrame:
    feeds = {
        "PORTFOLIO_TRANSACTIONS": (t.portfolio_transactions(False), "portfolio"),
        "LEDGER_TRANSACTIONS": (
            t.orders.select(F.col("o_orderdate").alias("loaded_at")), "ledger"),
        "CRM_ACCOUNTS": (
            t.crm_accounts().select(F.col("created_date").alias("loaded_at")), "crm"),
    }
    return validation.raw_freshness(feeds, latest(t.lineitem, "l_shipdate"))


@register("q23_refresh_status")
def _(t: Tables) -> DataFrame:
    """Run log taken from orders: newest run per client."""
    runs = latest_per_key(
        t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]
    ).select(
        F.col("o_custkey").cast("string").alias("name"),
        F.when(F.col("o_orderpriority") == "5-LOW", "SUSPENDED").otherwise("ACTIVE")
        .alias("scheduling_state"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCEEDED")
        .alias("last_state"),
        F.col("o_orderdate").alias("last_end"),
        F.lit("1 hour").alias("target_lag"),
    )
    return validation.refresh_status(runs, latest(t.orders, "o_orderdate"))


@register("q23_load_errors")
def _(t: Tables) -> DataFrame:
    loads = t.events.select(
        F.col("event_id").alias("file_id"), F.col("ts").alias("last_load_time"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("error_count"),
    )
    return validation.load_errors(loads, _event_time(t))


@register("q23_sync_status")
def _(t: Tables) -> DataFrame:
    syncs = t.events.select(
        F.concat(F.lit("Feed "), F.col("event_type"), F.lit(" "),
                 (F.col("user_id") % 5).cast("string")).alias("feed_name"),
        F.col("ts").alias("last_successful_sync"),
        F.when(F.col("value") > 100, "FAILED").otherwise("SUCCESS").alias("sync_status"),
    )
    cadence = {
        "%PURCHASE%": (300, "STALE (>5 hrs, expect 4-hr cadence)"),
        "%view%": (30, "STALE (>30 min, expect near real-time)"),
    }
    return validation.sync_status(syncs, _event_time(t), cadence)


@register("q24_latency")
def _(t: Tables) -> DataFrame:
    since = latest(t.lineitem, "l_shipdate") - F.expr("interval 30 days")
    # rows are created within a day of their date, which prunes the scan
    shipped = latest(t.lineitem, "l_shipdate") - F.expr("interval 31 days")
    raw = t.portfolio_transactions(False).select("transaction_id", "loaded_at")
    lines = t.ledger_lines().select(
        F.concat_ws("-", F.lit("NS"), "transaction", "line_sequence").alias(
            "transaction_id"), "loaded_at",
    )
    return shape.union_all([
        validation.latency(t.fact_revenue(since=shipped), raw, "transaction_id",
                           "Revenue", since),
        validation.latency(t.fact_expense(since=shipped), lines, "transaction_id",
                           "Expenses", since),
    ])


@register("q25_health")
def _(t: Tables) -> DataFrame:
    return validation.health(
        t.fact_revenue(), t.fact_expense(),
        t.customer.withColumnRenamed("c_custkey", "client_key"),
        t.dim_product(), t.dim_date(), t.dim_cost_center(), t.dim_gl_account(),
        latest(t.lineitem, "l_shipdate"), revenue_clients=t.fact_revenue(True),
    )


@register("q26_revenue_drift")
def _(t: Tables) -> DataFrame:
    return validation.revenue_drift(t.fact_revenue(), t.dim_date())


@register("q27_client_rules")
def _(t: Tables) -> DataFrame:
    clients = t.dim_client().withColumn(
        "client_name", F.when(F.col("is_active"), F.col("client_name"))
    )
    return validation.client_rules(clients)


@register("q27_revenue_rules")
def _(t: Tables) -> DataFrame:
    return validation.revenue_rules(t.fact_revenue())


@register("q27_expense_rules")
def _(t: Tables) -> DataFrame:
    return validation.expense_rules(t.fact_expense(), t.dim_gl_account())


@register("q27_expense_lines")
def _(t: Tables) -> DataFrame:
    """Documents with more lines than any order has, and repeated lines."""
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("line")
    )
    return validation.repeated_lines(lines, "document", "line")


@register("q27_client_count")
def _(t: Tables) -> DataFrame:
    return validation.count_within(_clients(t), t.crm_accounts(), "client: row count", 0.01)


# -- curation -----------------------------------------------------------------


def _clients(t: Tables) -> DataFrame:
    return curation.curate_clients(
        t.crm_accounts(), t.crm_users(), t.crm_financial_accounts(), ["client"]
    )


def _expense(t: Tables) -> DataFrame:
    return curation.curate_expense(
        t.ledger_lines(), t.ledger_transactions(), t.ledger_accounts(), t.dim_date(),
        t.ledger_gl_accounts(), t.ledger_cost_centers(), t.ledger_vendors(),
    )


def _rated(t: Tables) -> DataFrame:
    return curation.curate_revenue(
        t.portfolio_transactions(), t.portfolio_fee_schedules(), t.portfolio_nav(),
        t.entity_crossref(), t.dim_date(), t.dim_gl_account(),
    )


@register("t01_dim_client")
def _(t: Tables) -> DataFrame:
    return _clients(t)


@register("t02_fact_revenue")
def _(t: Tables) -> DataFrame:
    return _rated(t)


def _unmapped(t: Tables) -> DataFrame:
    return curation.unmapped_fees(
        t.portfolio_transactions(), t.portfolio_fee_schedules(), t.entity_crossref(),
        t.dim_date(), t.dim_gl_account(),
    )


@register("t02_unmapped_fees")
def _(t: Tables) -> DataFrame:
    return _unmapped(t).drop("transaction_date")


@register("t02_unmapped_counts")
def _(t: Tables) -> DataFrame:
    return curation.per_cause(_unmapped(t))


@register("t02_unrated_fees")
def _(t: Tables) -> DataFrame:
    return curation.unrated_fees(
        t.portfolio_transactions(), t.portfolio_fee_schedules()
    )


@register("t03_fact_expense")
def _(t: Tables) -> DataFrame:
    return _expense(t)


@register("t04_dim_product")
def _(t: Tables) -> DataFrame:
    return curation.curate_products(t.portfolio_fee_schedules(), t.entity_crossref())


@register("t04_dim_cost_center")
def _(t: Tables) -> DataFrame:
    return curation.curate_cost_centers(t.ledger_departments())


@register("t04_dim_gl_account")
def _(t: Tables) -> DataFrame:
    return curation.curate_gl_accounts(t.ledger_accounts())


@register("t04_fact_budget")
def _(t: Tables) -> DataFrame:
    return curation.curate_budget(
        t.ledger_budgets(), curation.curate_gl_accounts(t.ledger_accounts()),
        curation.curate_cost_centers(t.ledger_departments()), t.entity_crossref(),
        t.dim_date(),
    )


@register("t05_fact_client_aum")
def _(t: Tables) -> DataFrame:
    return curation.curate_client_aum(t.portfolio_valuations(), t.dim_date())


@register("t06_fee_check")
def _(t: Tables) -> DataFrame:
    return curation.fee_check(
        t.fact_revenue().select("transaction_id", "revenue_amount", "aum_amount",
                                "fee_basis_points")
    )


@register("t07_calendar")
def _(t: Tables) -> DataFrame:
    return t.dim_date()


@register("t07_calendar_iso_running")
def _(t: Tables) -> DataFrame:
    return t.dim_date(weekday="iso", key="running")


@register("t08_crossref")
def _(t: Tables) -> DataFrame:
    """CRM customers against portfolio accounts spelled a little differently."""
    key = F.col("c_custkey")
    city = F.concat(F.lit("City "), F.col("c_nationkey").cast("string"))
    crm = t.customer.select(
        key.alias("id"), F.col("c_name").alias("name"), city.alias("city"),
        F.when(key % 7 != 0, key.cast("string")).alias("business_id"),
    )
    portfolio = t.customer.select(
        key.alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.col("c_name"), F.lit("x")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.upper("c_name"))
        .otherwise(F.concat(F.lit("Another "), F.col("c_name"))).alias("name"),
        city.alias("city"),
        F.when(F.col("c_acctbal") > 0, key.cast("string")).alias("business_id"),
    )
    return curation.build_crossref(crm, portfolio)


def _members(t: Tables) -> DataFrame:
    return entities.entity_members(t.entity_accounts(), t.entity_known(), t.entity_reviews())


@register("t08_entity_members")
def _(t: Tables) -> DataFrame:
    """Every account of three systems with its entity's key."""
    return _members(t)


@register("t08_entity_crossref")
def _(t: Tables) -> DataFrame:
    return entities.entity_crossref(_members(t))


@register("t08_coverage")
def _(t: Tables) -> DataFrame:
    return entities.coverage(t.entity_accounts(), entities.entity_crossref(_members(t)))


def _products(t: Tables) -> DataFrame:
    return t.entity_crossref().where("entity_type = 'PRODUCT'").select(
        "entity_type", "portfolio_id", "curated_key"
    )


def _batch_time(batch: int) -> Column:
    return F.lit(f"2024-01-0{batch + 1} 06:00:00")


@register("t02_staged_revenue")
def _(t: Tables) -> DataFrame:
    """Three batches of fees; half of the clients are mapped from the first, the rest from the second."""
    clients = entities.entity_crossref(_members(t)).select("entity_type", "portfolio_id", "curated_key")
    known = stored(clients.unionByName(_products(t)), "crossref")
    fees = stored(t.portfolio_transactions().where(F.col("transaction_type") == "FEE"), "fees")
    schedules, nav, days = (
        stored(df, "lookup") for df in (t.portfolio_fee_schedules(), t.portfolio_nav(), t.dim_date())
    )
    part = F.substring_index("transaction_id", "-", -1).cast("int") % 3
    folder = scratch_path(t.spark, "revenue")
    early = known.where("entity_type = 'PRODUCT' or curated_key % 2 = 0")
    for batch in range(3):
        load = staging.StagedFact(
            folder,
            lambda rows, crossref=known if batch else early: staging.keyed_fees(
                rows, schedules, nav, crossref, days, t.dim_gl_account()
            ),
            staging.revenue_rows,
        )
        load.run(fees.where(part == batch), batch, batch - 1 if batch else None, _batch_time(batch))
    keys = ["date_key", "client_key", "product_key", "gl_account_key"]
    fact = staging.newest_revenue(load.fact(fees)).select(
        "transaction_id", *keys, "aum_amount", "revenue_amount", "fee_basis_points",
        F.col("batch").alias("loaded_in"), "created_at", F.lit(None).cast("int").alias("staged_in"),
        F.lit(None).cast("string").alias("reason"),
    )
    waiting = load.staged(fees, 2).select("transaction_id", "staged_in", "reason")
    return fact.unionByName(waiting, allowMissingColumns=True)


@register("t04_staged_budgets")
def _(t: Tables) -> DataFrame:
    """Two batches of budget lines; most products are mapped from the second only."""
    budgets, products = t.ledger_budgets(), _products(t).where("curated_key < 24")
    accounts = curation.curate_gl_accounts(t.ledger_accounts())
    centers = curation.curate_cost_centers(t.ledger_departments())
    folder = scratch_path(t.spark, "budgets")
    for batch, version in enumerate(("Original", "Revised")):
        crossref = products if batch else products.where("curated_key < 12")
        load = staging.StagedFact(
            folder,
            lambda rows, crossref=crossref: staging.keyed_budgets(rows, accounts, centers, crossref, t.dim_date()),
            staging.budget_rows,
        )
        load.run(budgets.where(F.col("budget_version") == version), batch, batch - 1 if batch else None,
                 _batch_time(batch))
    fact = load.fact(budgets).withColumnRenamed("batch", "loaded_in").withColumns(
        {"staged_in": F.lit(None).cast("int"), "reason": F.lit(None).cast("string")}
    )
    waiting = load.staged(budgets, 1).select(
        F.col("account").alias("gl_account_key"), F.col("amount").cast("decimal(18,2)").alias("budget_amount"),
        "budget_version", "staged_in", "reason",
    )
    return fact.unionByName(waiting, allowMissingColumns=True)


@register("t04_product_details")
def _(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    strategies = t.nation.where(key % 7 != 3).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("S"), key.cast("string")).alias("strategy_id"),
        F.concat(F.lit("  Fund "), "n_name").alias("strategy_name"), F.col("r_name").alias("asset_class"),
        F.when(key % 3 == 1, F.make_date(F.lit(1994) + key, F.lit(6), F.lit(30))).alias("closed_on"),
    )
    return staging.product_details(
        t.portfolio_fee_schedules(), strategies, _products(t).where("curated_key <> 5"), _ship_day(t), _batch_time(0)
    )


def _loyalty_raw(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    def landed(df: DataFrame, *fields: Column) -> DataFrame:
        value = F.parse_json(F.to_json(F.struct(*fields)))
        return df.select(F.explode(F.array(value)).alias("raw_data"))

    users = landed(
        t.dim_users(), "user_id", "first_name", "last_name",
        F.col("registration_date"), "status", "preferred_zone",
    )
    shops = landed(
        t.dim_businesses(), F.col("business_key").cast("string").alias("business_id"),
        "business_name", "category", "loyalty_type", "lat",
        F.col("lng").alias("long"), "neighborhood",
    )
    k = F.get_json_object("props", "$.k")
    visits = landed(
        t.events, F.col("event_id").cast("string").alias("visit_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        k.alias("business_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("visit_timestamp"),
        F.col("event_type").alias("visit_type"),
        F.floor("value").alias("points_earned"),
        cents(F.col("value")).alias("cashback_amount"),
        F.when(k == "7", F.lit("many")).otherwise(F.lit("1")).alias("punch_count"),
    )
    return users, shops, visits


@register("t09_stg_visits")
def _(t: Tables) -> DataFrame:
    return loyalty.flatten_visits(_loyalty_raw(t)[2])


@register("t09_fact_visits")
def _(t: Tables) -> DataFrame:
    users, shops, visits = _loyalty_raw(t)
    keyed_users = loyalty.flatten_users(users).join(
        t.dim_users().select("user_id", "user_key"), "user_id"
    )
    keyed_shops = loyalty.flatten_businesses(shops).withColumn(
        "business_key", F.col("business_id").cast("int")
    )
    return loyalty.load_fact_visits(
        loyalty.flatten_visits(visits), keyed_users, keyed_shops, t.dim_loyalty_type()
    )


def _raw_users(t: Tables) -> list[DataFrame]:
    """Two landings of user payloads: most users, then changed and new ones."""
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")

    def landed(rows: DataFrame, status: str) -> DataFrame:
        payload = rows.select(F.parse_json(F.to_json(F.struct(
            F.when(key % 97 != 0, F.concat(F.lit("U"), text)).alias("user_id"),
            F.substring_index("c_name", "#", 1).alias("first_name"),
            F.substring_index("c_name", "#", -1).alias("last_name"),
            F.concat(F.lit("user"), text, F.lit("@mail.test")).alias("email"),
            F.concat(F.lit("+52 999 "), text).alias("phone"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey") % 5).alias("registration_date"),
            F.lit(status).alias("status"), F.concat(F.lit("Zone "), F.col("c_nationkey").cast("string"))
            .alias("preferred_zone"),
        ))).alias("raw_data"))
        return loyalty_load.staged_view(payload, loyalty_load.USER_FIELDS)

    return [landed(t.customer.where(key % 3 != 0), "active"), landed(t.customer.where(key % 2 == 0), "inactive")]


def _raw_businesses(t: Tables) -> list[DataFrame]:
    shops = t.dim_businesses()
    k, text = F.col("business_key"), F.col("business_key").cast("string")

    def landed(rows: DataFrame, extra: int) -> DataFrame:
        kind = F.col("loyalty_type")
        payload = rows.select(F.parse_json(F.to_json(F.struct(
            text.alias("business_id"), "business_name", "category",
            F.concat(F.col("category"), F.lit(" "), (k % 3).cast("string")).alias("subcategory"), "loyalty_type",
            F.when(kind == "Cashback", k % 10 + F.lit(0.5)).alias("cashback_pct"),
            F.when(kind == "Punch Card", k % 6 + F.lit(5 + extra)).alias("punch_goal"),
            "lat", F.col("lng").alias("long"), "google_rating",
            F.concat(F.lit("P"), F.left(F.md5(text.cast("binary")), F.lit(8))).alias("google_place_id"),
            F.concat(F.lit("Calle "), text).alias("address"), "neighborhood",
        ))).alias("raw_data"))
        return loyalty_load.staged_view(payload, loyalty_load.BUSINESS_FIELDS)

    return [landed(shops.where(k % 2 == 0), 0), landed(shops.where(k >= 50), 10)]


def _dimension(t: Tables, landings: list[DataFrame], key_id: str, key: str) -> DataFrame:
    dimension = loyalty_load.Dimension(scratch_path(t.spark, key), key_id, key)
    for batch, staged in enumerate(landings):
        dimension.load(staged, batch)
    return dimension.read(landings[0])


@register("t09_dim_users")
def _(t: Tables) -> DataFrame:
    return _dimension(t, _raw_users(t), "user_id", "user_key")


@register("t09_dim_businesses")
def _(t: Tables) -> DataFrame:
    return _dimension(t, _raw_businesses(t), "business_id", "business_key")


def _loyalty_star(t: Tables) -> tuple[dict, staging.StagedFact]:
    """The three loads; visits of users and businesses that are not loaded stay staged."""
    raw_users, raw_shops = _raw_users(t), _raw_businesses(t)
    users = _dimension(t, raw_users, "user_id", "user_key")
    shops = _dimension(t, raw_shops, "business_id", "business_key")
    visits = stored(loyalty.flatten_visits(_loyalty_raw(t)[2]), "visits")
    load = staging.StagedFact(
        scratch_path(t.spark, "visits"),
        lambda rows: loyalty_load.keyed_visits(rows, users, shops, t.dim_loyalty_type()), loyalty_load.visit_rows,
    )
    load.run(visits, 0, None, _batch_time(0))
    loads = {
        "users": (raw_users[0].unionByName(raw_users[1]).dropDuplicates(["user_id"]), users, "user_id"),
        "businesses": (raw_shops[0].unionByName(raw_shops[1]).dropDuplicates(["business_id"]), shops, "business_id"),
        "visits": (visits, load.fact(visits), "visit_id"),
    }
    return loads, load


@register("t09_loaded_visits")
def _(t: Tables) -> DataFrame:
    loads, load = _loyalty_star(t)
    fact = loads["visits"][1].drop("batch", "visit_key", "created_at").withColumn("reason", F.lit(None).cast("string"))
    waiting = load.staged(fact, 0).select("visit_id", "visit_type", "reason")
    return fact.unionByName(waiting, allowMissingColumns=True)


@register("v08_load_checks")
def _(t: Tables) -> DataFrame:
    """Raw payloads against what was loaded from them; these can fail, and some do."""
    return loyalty_load.load_checks(_loyalty_star(t)[0])


# -- loyalty ------------------------------------------------------------------


def _flags(t: Tables) -> DataFrame:
    visits = t.order_visits()
    return loyalty.churn_flags(t.dim_users(), visits, latest(visits, "visit_timestamp"))


@register("c01_churn_flags")
def _(t: Tables) -> DataFrame:
    return loyalty.churn_report(_flags(t))


@register("c01_churn_flags_events")
def _(t: Tables) -> DataFrame:
    visits = t.fact_visits()
    return loyalty.churn_flags(
        t.dim_users(), visits, latest(visits, "visit_timestamp"), 1
    )


@register("c02_churn_summary")
def _(t: Tables) -> DataFrame:
    return loyalty.churn_summary(_flags(t))


@register("c02_churn_by_loyalty_type")
def _(t: Tables) -> DataFrame:
    visits = t.order_visits()
    return loyalty.churn_by_loyalty_type(
        visits, t.dim_loyalty_type(), latest(visits, "visit_timestamp")
    )


@register("c03_churn_by_category")
def _(t: Tables) -> DataFrame:
    visits = t.order_visits()
    return loyalty.churn_by_category(
        visits, t.dim_businesses(), latest(visits, "visit_timestamp")
    )


@register("c04_monthly_churn")
def _(t: Tables) -> DataFrame:
    return loyalty.monthly_churn(t.order_visits())


@register("c05_inactivity_histogram")
def _(t: Tables) -> DataFrame:
    return loyalty.inactivity_histogram(_flags(t))


@register("v01_kpis")
def _(t: Tables) -> DataFrame:
    return loyalty.kpis(t.fact_visits(), t.dim_businesses(), t.dim_users())


@register("v02_visits_by_month")
def _(t: Tables) -> DataFrame:
    return loyalty.visits_by_month(t.fact_visits(), t.dim_time())


@register("v02_visits_by_weekday")
def _(t: Tables) -> DataFrame:
    return loyalty.visits_by_weekday(t.fact_visits(), t.dim_time())


@register("v02_visits_by_hour")
def _(t: Tables) -> DataFrame:
    return loyalty.visits_by_hour(t.fact_visits())


@register("v03_loyalty_performance")
def _(t: Tables) -> DataFrame:
    return loyalty.loyalty_performance(t.fact_visits(), t.dim_loyalty_type())


@register("v03_loyalty_rollup")
def _(t: Tables) -> DataFrame:
    return loyalty.loyalty_rollup(
        loyalty.loyalty_performance(t.fact_visits(), t.dim_loyalty_type())
    )


@register("v04_category_breakdown")
def _(t: Tables) -> DataFrame:
    return loyalty.category_breakdown(t.fact_visits(), t.dim_businesses())


@register("v05_top_merchants")
def _(t: Tables) -> DataFrame:
    return loyalty.top_merchants(t.fact_visits(), t.dim_businesses())


@register("v06_business_map")
def _(t: Tables) -> DataFrame:
    return loyalty.business_map(t.fact_visits(), t.dim_businesses())


@register("v06_neighborhood_stats")
def _(t: Tables) -> DataFrame:
    return loyalty.neighborhood_stats(t.fact_visits(), t.dim_businesses())


@register("v07_heatmap")
def _(t: Tables) -> DataFrame:
    return loyalty.visit_heatmap(t.fact_visits(), t.dim_time())


@register("v08_loyalty_checks")
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    # the columns the load resolves; what it lands from JSON is the same rows
    visits = t.events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"), k.alias("business_id"),
        *(F.lit(None).alias(c) for c in ("visit_id", "visit_type", "points_earned", "cashback_amount", "punch_count")),
        F.col("ts").alias("visit_timestamp"),
    )
    shops = t.dim_businesses().withColumn("business_id", F.col("business_key").cast("string"))
    loads = {
        "users": (t.customer, t.dim_users()),
        "businesses": (shops, t.dim_businesses()),
        "visits": (t.events, loyalty.load_fact_visits(visits, t.dim_users(), shops, t.dim_loyalty_type())),
    }
    return loyalty.loyalty_checks(
        loads, t.fact_visits(), t.dim_users(), t.dim_businesses(), t.dim_time()
    )


@register("v09_redemption_rate")
def _(t: Tables) -> DataFrame:
    return loyalty.redemption_rate(t.fact_visits(), t.dim_loyalty_type())


@register("v09_foot_traffic")
def _(t: Tables) -> DataFrame:
    return loyalty.foot_traffic(t.fact_visits(), t.dim_businesses())


# -- usage --------------------------------------------------------------------


@register("m01_user_list")
def _(t: Tables) -> DataFrame:
    return usage.user_list(t.users(), "USER_%")


@register("m02_credit_summary")
def _(t: Tables) -> DataFrame:
    return usage.credit_summary(t.attribution_history(), USER, _event_time(t))


@register("m02_assistant_summary")
def _(t: Tables) -> DataFrame:
    return usage.assistant_summary(t.assistant_usage(), USER, _event_time(t))


@register("m03_week_over_week")
def _(t: Tables) -> DataFrame:
    return usage.week_over_week(t.attribution_history(), USER, _event_time(t))


@register("m04_daily_credits")
def _(t: Tables) -> DataFrame:
    return usage.daily_credits(t.attribution_history(), USER, _event_time(t))


@register("m04_daily_assistant_credits")
def _(t: Tables) -> DataFrame:
    return usage.daily_assistant_credits(t.assistant_usage(), USER, _event_time(t))


@register("m05_credits_by_warehouse")
def _(t: Tables) -> DataFrame:
    return usage.credits_by_warehouse(t.attribution_history(), USER, _event_time(t))


@register("m06_query_types")
def _(t: Tables) -> DataFrame:
    return usage.query_type_stats(t.query_history(), USER, _event_time(t))


@register("m07_objects_created")
def _(t: Tables) -> DataFrame:
    return usage.objects_created(t.query_history(), USER, _event_time(t))


@register("m07_live_objects")
def _(t: Tables) -> DataFrame:
    return usage.live_objects(t.inventory(), SUFFIX)


@register("m08_storage")
def _(t: Tables) -> DataFrame:
    return usage.storage_averages(t.storage_history(), SUFFIX, _event_time(t))


@register("m09_logins")
def _(t: Tables) -> DataFrame:
    return usage.login_days(t.login_history(), USER, _event_time(t))


@register("m09_logins_long")
def _(t: Tables) -> DataFrame:
    return usage.melt_logins(usage.login_days(t.login_history(), USER, _event_time(t)))


@register("m10_expensive_queries")
def _(t: Tables) -> DataFrame:
    return usage.expensive_queries(t.attribution_history(), USER, _event_time(t))


# -- governance ---------------------------------------------------------------


def _sensitive_clients(t: Tables) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return t.customer.select(
        F.col("c_custkey").alias("client_key"),
        F.col("c_name").alias("client_name"),
        F.concat(F.lit("123-45-"), F.lpad(key, 4, "0")).alias("ssn"),
        F.when(F.col("c_acctbal") >= 0, key).alias("account_number"),
        F.concat(key, F.lit("@example.org")).alias("email"),
        F.concat(F.lit("(555) 010-"), F.lpad(key, 4, "0")).alias("phone"),
    )


_MASKED = {"client_name": "name", "ssn": "ssn", "account_number": "account",
           "email": "email", "phone": "phone"}


@register("g01_masked_view")
def _(t: Tables) -> DataFrame:
    return governance.masked_view(_sensitive_clients(t), _MASKED, ANALYST)


@register("g01_masked_view_ops")
def _(t: Tables) -> DataFrame:
    return governance.masked_view(_sensitive_clients(t), _MASKED, OPS)


@register("g02_row_access")
def _(t: Tables) -> DataFrame:
    return governance.row_access(
        t.dim_client(), t.client_access_map(), "manager3", ANALYST
    ).select("client_key", "client_name", "office_location")


@register("g02_row_access_revenue")
def _(t: Tables) -> DataFrame:
    return governance.row_access_by_client(
        t.fact_revenue(True), t.client_access_map(), "manager3", ANALYST
    ).select("transaction_id", "client_key", "revenue_amount")


@register("g02_visible_columns")
def _(t: Tables) -> DataFrame:
    tags = {"ssn": "RESTRICTED", "account_number": "INTERNAL",
            "client_name": "CONFIDENTIAL"}
    return governance.visible_columns(_sensitive_clients(t), tags, ANALYST)


@register("g03_access_review")
def _(t: Tables) -> DataFrame:
    return governance.access_review(t.users(), t.grants_to_users())


@register("g03_inactive_users")
def _(t: Tables) -> DataFrame:
    return governance.inactive_users(t.users(), latest(t.orders, "o_orderdate"))


@register("g03_admin_grants")
def _(t: Tables) -> DataFrame:
    return governance.admin_grants(t.grants_to_users())


@register("g04_pii_queries")
def _(t: Tables) -> DataFrame:
    return governance.pii_queries(t.query_history(), _event_time(t))


@register("g04_admin_use")
def _(t: Tables) -> DataFrame:
    return governance.admin_use(t.query_history(), _event_time(t))


@register("g04_tagged_queries")
def _(t: Tables) -> DataFrame:
    return governance.tagged_queries(t.query_history(), "%AI_ANALYST%", _event_time(t))


@register("g04_failed_logins")
def _(t: Tables) -> DataFrame:
    return governance.failed_logins_by_day(t.login_history(), _event_time(t))


@register("g05_log_coverage")
def _(t: Tables) -> DataFrame:
    return governance.log_coverage(
        {"logins": (t.login_history(), "event_timestamp", 1),
         "queries": (t.query_history(), "start_time", 1),
         "grants": (t.attribution_history(), "start_time", 30)},
        _event_time(t),
    )


def _erasures(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("subject"))


@register("g06_erasure")
def _(t: Tables) -> DataFrame:
    path, audit = scratch_path(t.spark, "orders"), scratch_path(t.spark, "audit")
    orders = t.orders.select(
        F.col("o_custkey").alias("subject"), "o_orderkey", "o_orderstatus",
        F.year("o_orderdate").alias("order_year"),
    )
    orders.write.partitionBy("order_year").parquet(path)
    for _run in range(2):  # repeating a request must not change its audit
        tables.erase_subjects(t.spark, path, orders.schema, _erasures(t), "subject",
                              "order_year", audit, "1")
    return tables.read_table(t.spark, path, orders.schema).drop("order_year")


@register("g06_erasure_audit")
def _(t: Tables) -> DataFrame:
    subject = F.col("c_custkey").alias("subject")
    return tables.erasure_audit(
        {"orders": t.orders.select(F.col("o_custkey").alias("subject")),
         "customer": t.customer.select(subject)},
        _erasures(t), "subject",
    )


def _archived(t: Tables, log: DataFrame, ts: str) -> DataFrame:
    """Days of a log that is trimmed between two runs."""
    path = scratch_path(t.spark, "archive")
    limit = F.date_sub(F.to_date(_event_time(t)), 10)
    trimmed = log.where(F.col(ts) >= F.date_sub(F.to_date(_event_time(t)), 20) + F.expr(
        "interval 12 hours"))
    for rows in (log, log, trimmed):
        tables.archive_log(rows, ts, path, limit)
    return t.spark.read.parquet(path).groupBy("log_date").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@register("g07_log_archive")
def _(t: Tables) -> DataFrame:
    return _archived(t, t.login_history(), "event_timestamp")


@register("g07_query_archive")
def _(t: Tables) -> DataFrame:
    return _archived(t, t.query_history().select("user_name", "start_time"), "start_time")


@register("l01_failed_login_spikes")
def _(t: Tables) -> DataFrame:
    return governance.failed_login_spikes(t.login_history(), 5, "2 hours", "1 hour")


#: The test log has few rows, so alerts look back two weeks.
ALERT_MINUTES = 14 * 24 * 60


@register("l02_off_hours")
def _(t: Tables) -> DataFrame:
    return governance.off_hours_access(
        t.query_history(), "FINANCE", _event_time(t), ALERT_MINUTES)


@register("l03_bulk_exports")
def _(t: Tables) -> DataFrame:
    return governance.bulk_exports(
        t.query_history(), "FINANCE", _event_time(t), ALERT_MINUTES)


@register("l04_admin_alerts")
def _(t: Tables) -> DataFrame:
    return governance.admin_alerts(t.query_history(), _event_time(t), ALERT_MINUTES)


# -- metric layer -------------------------------------------------------------


def _model(t: Tables, with_client: bool = True) -> model.MetricModel:
    return model.finance_model(
        t.dim_date(), t.dim_client(), t.dim_product(), t.dim_cost_center(),
        t.fact_revenue(with_client), t.fact_expense(), t.fact_budget(),
    )


@register("k01_metrics_by_quarter")
def _(t: Tables) -> DataFrame:
    return _model(t, with_client=False).query(
        ["total_revenue", "total_expenses", "net_income", "profit_margin",
         "expense_ratio", "budget_variance"],
        by=["year_number", "quarter_name"],
    )


@register("k01_metrics_by_segment")
def _(t: Tables) -> DataFrame:
    return _model(t).query(
        ["total_revenue", "total_aum", "avg_fee_rate", "revenue_per_client"],
        by=["client_segment", "product_category"],
        where={"quarter_name": "Q4", "year_number": 1999},
    )


@register("k01_metrics_total")
def _(t: Tables) -> DataFrame:
    return _model(t, with_client=False).query(
        ["total_revenue", "total_expenses", "net_income", "total_budget"]
    )


@register("k02_monthly_rollup")
def _(t: Tables) -> DataFrame:
    return model.monthly_rollup(_model(t))


# -- incremental jobs ---------------------------------------------------------

STREAM_BATCHES = 4
#: A file is read by one task, so its rows are bounded and a large batch has many files.
FILE_ROWS = 100_000


def _event_stream(t: Tables) -> Tables:
    """The same views over the events as a stream of several batches.

    Rows are dealt to files by key, so none follows another in time.
    """
    return _streamed(t, "events", t.events, "event_id")


def _streamed(t: Tables, name: str, rows: DataFrame, *by: str) -> Tables:
    source = scratch_path(t.spark, "files")
    files = max(1, math.ceil(rows.count() / (STREAM_BATCHES * FILE_ROWS)))
    rows.repartition(STREAM_BATCHES * files, *by).write.parquet(source)
    stream = Tables(t.spark, t.folder)
    stream.__dict__[name] = jobs.file_stream(
        t.spark, source, rows.schema, files_per_batch=files
    )
    return stream


def _silver_schema(t: Tables) -> StructType:
    raw = t.bike_stations_raw()
    return bikes.with_partition(bikes.silver_clean(raw, with_ingestion=True)).schema


def _run_silver(t: Tables, after=None) -> str:
    silver = scratch_path(t.spark, "silver")
    jobs.run_bronze_silver(
        _event_stream(t).bike_stations_raw(),
        lambda raw: bikes.with_partition(bikes.silver_clean(raw, with_ingestion=True)),
        silver, [*bikes.SILVER_KEYS, bikes.SILVER_PARTITION], bikes.SILVER_PARTITION,
        scratch_path(t.spark, "mark"), newest_by="ingestion_time",
        after=after(silver) if after else None,
    )
    return silver


@register("r01_bronze_silver")
def _(t: Tables) -> DataFrame:
    silver = tables.read_table(t.spark, _run_silver(t), _silver_schema(t))
    return silver.drop(bikes.SILVER_PARTITION, "ingestion_time").withColumn(
        "api_timestamp", F.col("api_timestamp").cast("timestamp_ntz")
    )


def _gold(t: Tables, build: Callable[[DataFrame], DataFrame], day: Column) -> DataFrame:
    """A gold table kept up to date behind the silver stream."""
    schema, gold = _silver_schema(t), scratch_path(t.spark, "gold")
    _run_silver(
        t,
        after=lambda silver: jobs.refresh_touched(
            silver, schema, gold, bikes.SILVER_PARTITION, "gold_date",
            lambda rows: build(rows).withColumn("gold_date", day),
        ),
    )
    return t.spark.read.parquet(gold).drop("gold_date")


@register("x03_metric_log")
def _(t: Tables) -> DataFrame:
    """Metrics behind the silver and gold jobs, a row for each batch; the last are those of a full count."""
    schema, gold = _silver_schema(t), scratch_path(t.spark, "gold")
    of_silver = MetricLog(
        scratch_path(t.spark, "metrics"), bikes.SILVER_PARTITION, bikes.SILVER_NULLS, bikes.SILVER_REPEATED
    )
    of_gold = MetricLog(scratch_path(t.spark, "metrics"), "gold_date", bikes.GOLD_NULLS, {})

    def steps(silver: str):
        refresh = jobs.refresh_touched(
            silver, schema, gold, bikes.SILVER_PARTITION, "gold_date",
            lambda rows: bikes.network_summary(rows).withColumn("gold_date", F.to_date("extraction_at")),
        )

        def after(batch: DataFrame, batch_id: int) -> None:
            of_silver.after(silver, schema)(batch, batch_id)
            refresh(batch, batch_id)
            days = batch.select(F.col(bikes.SILVER_PARTITION).alias("gold_date"))
            of_gold.update(t.spark.read.parquet(gold), days, batch_id)

        return after

    _run_silver(t, after=steps)
    return of_silver.latest(t.spark).unionByName(of_gold.latest(t.spark))


@register("r02_network_summary_stream")
def _(t: Tables) -> DataFrame:
    return _gold(t, bikes.network_summary, F.to_date("extraction_at"))


@register("r03_station_hourly_stream")
def _(t: Tables) -> DataFrame:
    return _gold(t, bikes.station_hourly, F.to_date("hour_bucket"))


@register("r05_apply_changes")
def _(t: Tables) -> DataFrame:
    """Events as a change feed of users: an error event deletes the user."""
    path, mark = scratch_path(t.spark, "cdc"), scratch_path(t.spark, "mark")
    feed = _event_stream(t).events.select(
        "user_id", F.col("event_id").alias("seq"), "event_type",
        (F.col("event_type") == "error").alias("is_deleted"),
    )
    jobs.apply_change_stream(feed, path, ["user_id"], "seq", mark)
    tables.compact_changes(t.spark, path, feed.schema, ["user_id"], "seq")
    return tables.live_rows(t.spark, path, feed.schema, ["user_id"], "seq")


@register("r06_incremental_since")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "high-water")
    tables.store_high_water(t.orders, "o_orderdate", path)
    mark = tables.read_current(t.spark, path).select("high_water").scalar()
    return tables.incremental_since(t.lineitem, "l_shipdate", mark).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"
    )


@register("r07_refresh_all")
def _(t: Tables) -> DataFrame:
    """Dimension, fact, rollup: each step reads what the one before wrote."""
    root = scratch_path(t.spark, "layers")

    def read(path: str) -> DataFrame:
        return tables.read_current(t.spark, path)

    jobs.refresh_all([
        ("dim_client", t.dim_client, f"{root}/dim_client"),
        ("fact_revenue", lambda: t.fact_revenue(True), f"{root}/fact_revenue"),
        ("segment_totals",
         lambda: finance.revenue_by_segment(
             read(f"{root}/fact_revenue"), read(f"{root}/dim_client")),
         f"{root}/segment_totals"),
    ])
    return read(f"{root}/segment_totals")


@register("r08_failed_login_stream")
def _(t: Tables) -> DataFrame:
    sink, alerts = scratch_path(t.spark, "logins"), scratch_path(t.spark, "alerts")
    logins = _event_stream(t).login_history().withColumn(
        "log_date", F.to_date("event_timestamp")
    )

    def build(rows: DataFrame) -> DataFrame:
        found = governance.failed_login_spikes(rows, 5, "2 hours", "1 hour")
        return found.withColumn("window_date", F.to_date("window_start"))

    jobs.append_stream(
        logins, sink, "log_date", scratch_path(t.spark, "mark"),
        after=jobs.refresh_touched(
            sink, logins.schema, alerts, "log_date", "window_date", build, reach=1
        ),
    )
    schema = StructType([
        StructField("window_start", TimestampNTZType()),
        StructField("window_end", TimestampNTZType()),
        StructField("failed_logins", LongType()),
    ])
    return tables.read_table(t.spark, alerts, schema).drop("window_date")


@register("r09_dedup_stream")
def _(t: Tables) -> DataFrame:
    sink, mark = scratch_path(t.spark, "once"), scratch_path(t.spark, "mark")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    # every line comes twice, in different files
    keys = ["l_orderkey", "l_linenumber"]
    stream = _streamed(t, "lineitem", lines.unionAll(lines)).lineitem.select(
        *keys, tables.key_bucket(keys, 8).alias(tables.BUCKET)
    )
    jobs.dedup_stream(stream, sink, keys, tables.BUCKET, mark)
    return t.spark.read.parquet(sink).drop(tables.BUCKET)
