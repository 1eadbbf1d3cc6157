"""Reconciliation, continuity, integrity and freshness checks.

Each fact is reduced to one row per day or per key before anything is joined to
it, so the checks cost one aggregation per fact whatever they compare.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import mean, ratio
from tidemark.functions.temporal import day_diff, minute_diff, month_floor
from tidemark.functions.text import name_matches_any
from tidemark.operators.dedupe import duplicate_keys, latest_per_key
from tidemark.operators.joins import (
    missing_in, orphan_count, star_join, star_rollup,
)
from tidemark.operators.shape import (
    domain_violations, labelled_counts, rule_violations, union_all,
)
from tidemark.operators.windows import gap_runs, rolling_average
from tidemark.plans.calendar import day_sequence
from tidemark.plans.curation import EXPENSE_ACCOUNTS, in_account_range

# Tolerances and thresholds.
DAILY_TOLERANCE, MONTHLY_TOLERANCE = 1, 100
ROW_COUNT_DRIFT, REVENUE_DRIFT = 0.20, 0.50
EXPENSE_RATIO_BAND = (0.55, 0.75)
STALE_AFTER_MINUTES = {
    "portfolio": (1500, "STALE (>25 hrs)", "OK (daily batch)"),
    "ledger": (300, "STALE (>5 hrs)", "OK (4-hr sync)"),
    "crm": (60, "STALE (>1 hr)", "OK (CDC ~5 min)"),
}

row_counts = labelled_counts


def on_days(fact: DataFrame, days: DataFrame) -> DataFrame:
    """Fact rows between the first and last of some calendar days.

    The bounds come from the calendar, whatever its keys look like, and are
    plain comparisons with the stored key: old files and row groups are skipped.
    """
    bounds = days.agg(
        F.struct(F.min("date_key").alias("lo"), F.max("date_key").alias("hi"))
    ).scalar()
    return fact.where(F.col("date_key").between(bounds["lo"], bounds["hi"]))


def per_day(fact: DataFrame, dim_date: DataFrame, sums: dict) -> DataFrame:
    """Additive measures per calendar date."""
    return star_rollup(fact, dim_date, "date_key", "date_key", ["calendar_date"], sums)


def daily_row_trend(
    dim_date: DataFrame, revenue: DataFrame, expense: DataFrame, as_of: Column,
    days: int = 7,
) -> DataFrame:
    """Rows per day with the mean of the last seven days, and a drift flag."""
    recent = dim_date.where(
        F.col("calendar_date").between(F.date_sub(as_of, days), as_of)
    ).select("date_key", "calendar_date")

    def counts(fact: DataFrame, name: str) -> DataFrame:
        return on_days(fact, recent).groupBy("date_key").agg(
            F.count(F.lit(1)).alias(name)
        )

    daily = (
        recent.join(counts(revenue, "revenue_rows"), "date_key", "left")
        .join(counts(expense, "expense_rows"), "date_key", "left")
        .select(
            "calendar_date",
            F.coalesce("revenue_rows", F.lit(0)).alias("revenue_rows"),
            F.coalesce("expense_rows", F.lit(0)).alias("expense_rows"),
        )
    )
    smoothed = rolling_average(
        daily, "calendar_date",
        {"revenue_rows": "revenue_7d_avg", "expense_rows": "expense_7d_avg"}, 7,
    )

    def drift(rows: str, average: str) -> Column:
        away = F.abs(ratio(F.col(rows) - F.col(average), F.col(average)))
        return F.when(away > ROW_COUNT_DRIFT, "ANOMALY").otherwise("OK")

    return smoothed.withColumns(
        {
            "revenue_status": drift("revenue_rows", "revenue_7d_avg"),
            "expense_status": drift("expense_rows", "expense_7d_avg"),
        }
    )


def raw_vs_curated_revenue(
    transactions: DataFrame, revenue: DataFrame, dim_date: DataFrame, as_of: Column
) -> DataFrame:
    """Fee total of the current month on both sides."""
    start = month_floor(as_of)
    raw = transactions.where(
        (F.col("transaction_type") == "FEE") & (F.col("transaction_date") >= start)
    ).agg(F.round(F.sum("fee_amount"), 2).cast("decimal(28,2)").alias("total"))
    days = dim_date.where(F.col("calendar_date") >= start)
    curated = per_day(on_days(revenue, days), days, {"v": F.col("revenue_amount")}).agg(
        F.sum("v").cast("decimal(28,2)").alias("total")
    )
    return union_all(
        [
            raw.select(F.lit("raw (current month)").alias("source"), "total"),
            curated.select(F.lit("curated (current month)").alias("source"), "total"),
        ]
    )


def raw_vs_curated_expense(
    lines: DataFrame, headers: DataFrame, accounts: DataFrame, expense: DataFrame,
    dim_date: DataFrame, as_of: Column,
) -> DataFrame:
    """Expense total of the current month on both sides."""
    start = month_floor(as_of)
    posting = accounts.where(
        in_account_range(F.col("acctnumber"), EXPENSE_ACCOUNTS)
    ).select(F.col("id").alias("account"))
    documents = headers.where(
        (F.col("voided") == "No") & (F.col("trandate") >= start.cast("timestamp_ntz"))
    ).select(F.col("id").alias("transaction"))
    zero = F.lit(0).cast("decimal(18,4)")
    raw = lines.join(documents, "transaction").join(posting, "account").agg(
        F.round(
            F.sum(F.coalesce("debitamount", zero) - F.coalesce("creditamount", zero)), 2
        ).cast("decimal(28,2)").alias("total")
    )
    days = dim_date.where(F.col("calendar_date") >= start)
    curated = per_day(on_days(expense, days), days, {"v": F.col("expense_amount")}).agg(
        F.sum("v").cast("decimal(28,2)").alias("total")
    )
    return union_all(
        [
            raw.select(F.lit("raw (current month)").alias("source"), "total"),
            curated.select(F.lit("curated (current month)").alias("source"), "total"),
        ]
    )


def within_tolerance(totals: DataFrame, tolerance: int) -> DataFrame:
    """PASS when the totals of a reconciliation differ by at most ``tolerance``."""
    gap = F.max("total") - F.min("total")
    return totals.agg(gap.alias("difference")).withColumn(
        "status", F.when(F.col("difference") <= tolerance, "PASS").otherwise("FAIL")
    )


def _last_months(dim_date: DataFrame, as_of: Column, months: int) -> DataFrame:
    return dim_date.where(
        F.col("calendar_date") >= F.add_months(month_floor(as_of), -months)
    )


_MONTH = ["year_number", "month_name", "month_number"]


def revenue_by_month(
    revenue: DataFrame, dim_date: DataFrame, as_of: Column
) -> DataFrame:
    days = _last_months(dim_date, as_of, 6)
    sums = {
        "transaction_count": F.lit(1),
        "total_revenue": F.col("revenue_amount"),
        "total_aum": F.col("aum_amount"),
        "bps": F.col("fee_basis_points"),
        "bps_rows": F.when(F.col("fee_basis_points").isNotNull(), 1),
    }
    return star_rollup(
        on_days(revenue, days), days, "date_key", "date_key", _MONTH, sums
    ).select(
        *_MONTH, "transaction_count", "total_revenue", "total_aum",
        mean(F.col("bps"), F.col("bps_rows"), 2).alias("avg_fee_bps"),
    )


def expense_by_month(
    expense: DataFrame, dim_date: DataFrame, as_of: Column
) -> DataFrame:
    days = _last_months(dim_date, as_of, 6)
    sums = {"transaction_count": F.lit(1), "total_expenses": F.col("expense_amount")}
    return star_rollup(
        on_days(expense, days), days, "date_key", "date_key", _MONTH, sums
    )


def profitability_band(
    revenue: DataFrame, expense: DataFrame, dim_date: DataFrame, as_of: Column
) -> DataFrame:
    """Expense ratio per quarter of the last year against its usual band.

    Both facts are summed per quarter before they are compared, so no expense
    is counted once per revenue row.
    """
    days = dim_date.where(F.col("calendar_date") >= F.add_months(as_of, -12))
    quarter = ["year_number", "quarter_name"]
    earned = star_rollup(on_days(revenue, days), days, "date_key", "date_key", quarter,
                         {"total_revenue": F.col("revenue_amount")})
    spent = star_rollup(on_days(expense, days), days, "date_key", "date_key", quarter,
                        {"total_expenses": F.col("expense_amount")})
    share = ratio(F.col("total_expenses"), F.col("total_revenue"))
    low, high = EXPENSE_RATIO_BAND
    return earned.join(spent, quarter, "left").select(
        *quarter, "total_revenue", "total_expenses",
        (F.col("total_revenue") - F.col("total_expenses")).alias("net_income"),
        F.round(share * 100, 1).alias("expense_ratio_pct"),
        F.when(share < low, "WARNING: Ratio below 55%")
        .when(share > high, "WARNING: Ratio above 75%")
        .otherwise("OK")
        .alias("status"),
    )


def missing_calendar_days(dim_date: DataFrame) -> DataFrame:
    """Dates between the first and last one that the calendar lacks."""
    spark = dim_date.sparkSession
    lo = dim_date.agg(F.min("calendar_date")).scalar()
    hi = dim_date.agg(F.max("calendar_date")).scalar()
    expected = day_sequence(spark, lo, hi)
    return missing_in(expected, dim_date, "calendar_date").select(
        F.col("calendar_date").alias("missing_date"),
        F.date_format("calendar_date", "EEE").alias("day_name"),
    )


def _recent_business_days(dim_date: DataFrame, as_of: Column, days: int) -> DataFrame:
    return dim_date.where(
        F.col("calendar_date").between(F.date_sub(as_of, days), as_of)
        & F.col("is_business_day")
    )


def _expected_days(
    dim_date: DataFrame, fact: DataFrame, as_of: Column, days: int, by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Recent business days for each group of the fact, and those with rows.

    The days come as one array of at most ``days`` entries, so each group is
    expanded by them without a join of everything with everything.
    """
    recent = _recent_business_days(dim_date, as_of, days)
    present = on_days(fact, recent).select(*by, "date_key").distinct()
    if not by:
        return recent.select("date_key", "calendar_date", "day_name"), present
    calendar = recent.agg(
        F.collect_list(F.struct("date_key", "calendar_date", "day_name")).alias("d")
    ).scalar()
    groups = fact.select(*by).distinct().withColumn("_day", F.explode(calendar))
    return groups.select(*by, "_day.*"), present


def business_days_without_rows(
    dim_date: DataFrame, fact: DataFrame, as_of: Column, days: int = 30,
    by: Sequence[str] = (),
) -> DataFrame:
    """Business days without rows, for each group of ``by`` that has any row."""
    expected, present = _expected_days(dim_date, fact, as_of, days, by)
    return expected.join(present, [*by, "date_key"], "left_anti").select(
        *by, "calendar_date", "day_name", F.lit("NO REVENUE DATA").alias("status")
    )


def expense_gap_runs(
    dim_date: DataFrame, expense: DataFrame, as_of: Column, days: int = 30,
    by: Sequence[str] = (),
) -> DataFrame:
    """Runs of business days without expenses, for each group of ``by``."""
    expected, present = _expected_days(dim_date, expense, as_of, days, by)
    present = present.withColumn("has_data", F.lit(1))
    series = expected.join(present, [*by, "date_key"], "left").select(
        *by, "calendar_date", F.coalesce("has_data", F.lit(0)).alias("has_data")
    )
    return gap_runs(series, "calendar_date", "has_data", by).withColumn(
        "status",
        F.when(F.col("consecutive_missing_days") >= 3,
               "ALERT: 3+ consecutive days missing").otherwise("INFO: minor gap"),
    )


def latest_dates(
    facts: dict[str, DataFrame], dim_date: DataFrame, as_of: Column
) -> DataFrame:
    """Newest date of each fact and how many days it lags."""
    parts = []
    for name, fact in facts.items():
        dates = fact.select("date_key").distinct()
        newest = star_join(dates, dim_date, "date_key", "date_key", ["calendar_date"])
        parts.append(
            newest.agg(F.max("calendar_date").alias("latest_date")).select(
                F.lit(name).alias("table_name"), "latest_date",
                day_diff(F.col("latest_date"), as_of).alias("days_behind"),
            )
        )
    return union_all(parts)


def orphan_checks(
    fact: DataFrame, name: str,
    references: dict[str, tuple[str, DataFrame, str, bool]],
) -> DataFrame:
    """Orphan counts of one fact; references map a label to
    (fact key, dimension, dimension key, nullable)."""
    return union_all(
        [
            orphan_count(fact, dim, fk, pk, f"{name} -> {label}", nullable)
            for label, (fk, dim, pk, nullable) in references.items()
        ]
    )


def crossref_coverage(dim_client: DataFrame, crossref: DataFrame) -> DataFrame:
    """Clients without an id in a source system, and unreviewed mappings."""
    clients = crossref.where(F.col("entity_type") == "CLIENT").select(
        F.col("curated_key").alias("client_key"), "portfolio_id", "crm_id"
    )
    joined = dim_client.select("client_key").join(clients, "client_key", "left")
    unmapped = rule_violations(
        joined,
        {
            "Unmapped Clients (no portfolio ID)": F.col("portfolio_id").isNull(),
            "Unmapped Clients (no CRM ID)": F.col("crm_id").isNull(),
        },
    )
    unverified = rule_violations(
        crossref, {"Unverified Crossref Entries": F.col("verified") == F.lit(False)}
    )
    return unmapped.unionByName(unverified).withColumnRenamed(
        "fail_count", "unmapped_count"
    )


def raw_freshness(
    feeds: dict[str, tuple[DataFrame, str]], as_of: Column
) -> DataFrame:
    """Newest load per raw table; the source sets what counts as stale."""
    parts = []
    for table, (df, source) in feeds.items():
        limit, stale, fresh = STALE_AFTER_MINUTES[source]
        ago = minute_diff(F.col("last_loaded"), as_of)
        parts.append(
            df.agg(F.max("loaded_at").alias("last_loaded")).select(
                F.lit(table).alias("raw_table"), "last_loaded",
                ago.alias("minutes_ago"),
                F.when(ago > limit, stale).otherwise(fresh).alias("status"),
            )
        )
    return union_all(parts)


def refresh_status(runs: DataFrame, as_of: Column) -> DataFrame:
    """Health of refreshed tables from a run log: (name, scheduling_state,
    last_state, last_end, target_lag)."""
    since = minute_diff(F.col("last_end"), as_of)
    return runs.select(
        "name", "scheduling_state", "last_state", "last_end",
        since.alias("minutes_since_refresh"), "target_lag",
        F.when(F.col("scheduling_state") != "ACTIVE", "ALERT: Not active")
        .when(F.col("last_state") == "FAILED", "ALERT: Last refresh failed")
        .when(since > 30, "WARNING: Behind target lag")
        .otherwise("OK")
        .alias("status"),
    )


def load_errors(loads: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Loaded files with errors in the last hours."""
    since = as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return loads.where((F.col("last_load_time") >= since) & (F.col("error_count") > 0))


def sync_status(syncs: DataFrame, as_of: Column, cadence: dict) -> DataFrame:
    """Newest sync per feed; ``cadence`` maps a name pattern to (minutes, text)."""
    wanted = syncs.where(name_matches_any(F.col("feed_name"), list(cadence)))
    newest = latest_per_key(
        wanted, ["feed_name"],
        [F.desc("last_successful_sync"), F.asc("sync_status")],
    )
    since = minute_diff(F.col("last_successful_sync"), as_of)
    status = F.when(F.col("sync_status") != "SUCCESS", "ALERT: Sync failed")
    for pattern, (minutes, text) in cadence.items():
        status = status.when(
            F.col("feed_name").ilike(pattern) & (since > minutes), text
        )
    return newest.select(
        "feed_name", "last_successful_sync", since.alias("minutes_since_sync"),
        "sync_status", status.otherwise("OK").alias("status"),
    )


def latency(
    curated: DataFrame, raw: DataFrame, key: str, name: str, since: Column
) -> DataFrame:
    """Minutes from raw arrival to curated write, for rows created since.

    Raw rows are cut to the keys of those before they are grouped.  Copies of a
    key on either side are counted before the join: pairs are weighted, not built.
    """
    left = (
        curated.where(F.col("created_at") >= since)
        .groupBy(key, "created_at")
        .agg(F.count(F.lit(1)).alias("_l"))
    )
    near = raw.join(left.select(key), key, "left_semi")
    right = near.groupBy(key, "loaded_at").agg(F.count(F.lit(1)).alias("_r"))
    weight = F.col("_l") * F.col("_r")
    minutes = minute_diff(F.col("loaded_at"), F.col("created_at"))
    return (
        left.join(right, key)
        .agg(
            F.sum(minutes * weight).alias("_sum"),
            F.sum(weight).alias("_n"),
            F.max(minutes).alias("max_latency_min"),
        )
        .select(
            F.lit(name).alias("flow"),
            mean(F.col("_sum"), F.col("_n"), 1).alias("avg_latency_min"),
            "max_latency_min",
        )
    )


def health(
    revenue: DataFrame, expense: DataFrame, dim_client: DataFrame,
    dim_product: DataFrame, dim_date: DataFrame, dim_cost_center: DataFrame,
    dim_gl_account: DataFrame, as_of: Column, expense_key: list[str] | None = None,
    revenue_clients: DataFrame | None = None,
) -> DataFrame:
    """Eleven checks, each PASS or FAIL.

    Null and sign checks of a fact share one pass.  ``expense_key`` is what
    makes an expense row unique: the document, or the document line.  If the
    client of a revenue row takes a join, ``revenue_clients`` has the clients
    and ``revenue`` can do without.
    """
    def orphans(fact, label, fk, dim, pk) -> DataFrame:
        return orphan_count(fact, dim, fk, pk, label).select(
            F.col("fk_check").alias("check_name"),
            F.col("orphan_count").alias("fail_count"),
        )

    def repeated(fact: DataFrame, keys: list[str], label: str) -> DataFrame:
        return duplicate_keys(fact, keys).agg(
            F.count(F.lit(1)).alias("fail_count")
        ).select(F.lit(label).alias("check_name"), "fail_count")

    checks = union_all(
        [
            orphans(revenue if revenue_clients is None else revenue_clients,
                    "FK: Revenue -> Client", "client_key", dim_client, "client_key"),
            orphans(revenue, "FK: Revenue -> Product", "product_key", dim_product,
                    "product_key"),
            orphans(revenue, "FK: Revenue -> Date", "date_key", dim_date, "date_key"),
            orphans(expense, "FK: Expense -> Cost Center", "cost_center_key",
                    dim_cost_center, "cost_center_key"),
            orphans(expense, "FK: Expense -> GL Account", "gl_account_key",
                    dim_gl_account, "gl_account_key"),
            rule_violations(
                revenue,
                {"NULL: Revenue Amount": F.col("revenue_amount").isNull(),
                 "NEG: Revenue Amount": F.col("revenue_amount") < 0},
            ),
            rule_violations(
                expense,
                {"NULL: Expense Amount": F.col("expense_amount").isNull(),
                 "NEG: Expense Amount": F.col("expense_amount") < 0},
            ),
            repeated(revenue, ["transaction_id"], "DUP: Revenue Transactions"),
            repeated(expense, expense_key or ["transaction_id"],
                     "DUP: Expense Transactions"),
        ]
    )
    return checks.select(
        "check_name", "fail_count",
        F.when(F.col("fail_count") == 0, "PASS").otherwise("FAIL").alias("status"),
        as_of.alias("checked_at"),
    )


def revenue_drift(
    revenue: DataFrame, dim_date: DataFrame
) -> DataFrame:
    """Daily revenue against the day before and the same day a month before."""
    daily = per_day(revenue, dim_date, {"revenue": F.col("revenue_amount")})

    def shifted(days: Column, name: str) -> DataFrame:
        return daily.select(days.alias("calendar_date"),
                            F.col("revenue").alias(name))

    joined = daily.join(
        shifted(F.date_add("calendar_date", 1), "prior_day"), "calendar_date", "left"
    ).join(
        daily.select(
            F.col("calendar_date").alias("_before"),
            F.col("revenue").alias("prior_month_day"),
        ),
        F.add_months("calendar_date", -1) == F.col("_before"), "left",
    )

    def away(name: str) -> Column:
        return F.abs(ratio(F.col("revenue") - F.col(name), F.col(name)))

    odd = F.coalesce(away("prior_day") > REVENUE_DRIFT, F.lit(False)) | F.coalesce(
        away("prior_month_day") > REVENUE_DRIFT, F.lit(False)
    )
    return joined.select(
        "calendar_date", "revenue", "prior_day", "prior_month_day",
        F.when(odd, "ANOMALY").otherwise("OK").alias("status"),
    )


# -- column rules -------------------------------------------------------------

CLIENT_SEGMENTS = ["Individual", "Institutional", "Family Office", "Other"]
AUM_TIERS = ["Platinum", "Gold", "Silver"]
PAYMENT_STATES = ["Paid", "Pending", "Accrued"]


def _duplicates(df: DataFrame, key: str, label: str) -> DataFrame:
    return duplicate_keys(df, [key]).agg(F.count(F.lit(1)).alias("fail_count")).select(
        F.lit(label).alias("check_name"), "fail_count"
    )


def client_rules(dim_client: DataFrame) -> DataFrame:
    counted = rule_violations(
        dim_client,
        {
            "client: null name": F.col("client_name").isNull(),
            "client: unknown segment": ~F.col("client_segment").isin(CLIENT_SEGMENTS),
            "client: unknown tier": ~F.col("aum_tier").isin(AUM_TIERS),
        },
    )
    return counted.unionByName(
        _duplicates(dim_client, "client_id", "client: duplicate id")
    )


def revenue_rules(revenue: DataFrame) -> DataFrame:
    expected = F.col("aum_amount") * F.col("fee_basis_points") / 10000 / 12
    counted = rule_violations(
        revenue,
        {
            "revenue: null amount": F.col("revenue_amount").isNull(),
            "revenue: negative amount": F.col("revenue_amount") < 0,
            "revenue: fee rate out of range": ~F.col("fee_basis_points").between(0, 500),
            "revenue: differs from rate": F.abs(F.col("revenue_amount") - expected)
            > MONTHLY_TOLERANCE,
        },
    )
    return counted.unionByName(
        _duplicates(revenue, "transaction_id", "revenue: duplicate transaction")
    )


def expense_rules(expense: DataFrame, gl_accounts: DataFrame) -> DataFrame:
    counted = rule_violations(
        expense,
        {
            "expense: null amount": F.col("expense_amount").isNull(),
            "expense: negative amount": F.col("expense_amount") < 0,
            "expense: unknown status": ~F.col("payment_status").isin(PAYMENT_STATES),
        },
    )
    posted = star_rollup(
        expense, gl_accounts, "gl_account_key", "gl_account_key", ["gl_account_id"],
        {"n": F.lit(1)},
    )
    outside = ~in_account_range(F.col("gl_account_id"), EXPENSE_ACCOUNTS)
    ranged = posted.agg(
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("fail_count")
    ).select(F.lit("expense: account out of range").alias("check_name"), "fail_count")
    return counted.unionByName(ranged)


def repeated_lines(lines: DataFrame, document: str, line: str) -> DataFrame:
    """Lines that a document holds more than once, and documents with more rows
    than their highest line number."""
    per_line = lines.groupBy(document, line).agg(F.count(F.lit(1)).alias("n"))
    per_document = per_line.groupBy(document).agg(
        F.sum("n").alias("rows"), F.max(line).alias("highest"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )
    counted = per_document.agg(
        F.coalesce(F.sum("repeated"), F.lit(0)).alias("expense: repeated line"),
        F.count_if(F.col("rows") > F.col("highest")).alias("expense: too many lines"),
    )
    return counted.unpivot([], counted.columns, "check_name", "fail_count")


def count_within(
    curated: DataFrame, source: DataFrame, label: str, share: float
) -> DataFrame:
    """Whether two tables have the same number of rows up to a share of the source."""
    there = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    away = F.abs(F.col("curated_rows") - F.col("source_rows"))
    return curated.agg(F.count(F.lit(1)).alias("curated_rows")).select(
        F.lit(label).alias("check_name"), "curated_rows", there.alias("source_rows")
    ).withColumn(
        "status", F.when(away <= F.col("source_rows") * share, "PASS").otherwise("FAIL")
    )


def segment_domain(dim_client: DataFrame, allowed: list[str]) -> DataFrame:
    return domain_violations(dim_client, "client_segment", allowed, "client_segment")
