"""Raw feeds to the curated star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import money, monthly_fee
from tidemark.functions.text import (
    first_matching_pattern, map_values, normalised_name, padded_code,
)
from tidemark.operators.dedupe import latest_per_key, with_surrogate_key
from tidemark.operators.joins import asof_latest, resolve_key, star_join
from tidemark.operators.matching import propose_matches
from tidemark.operators.windows import previous_in_group

# Picklists, thresholds and codes the curated tables must carry.
SEGMENTS = {
    "Individual": "Individual",
    "Institution": "Institutional",
    "Family Office": "Family Office",
}
OFFICES = {
    "%new york%": "New York",
    "%boston%": "Boston",
    "%san fran%": "San Francisco",
}
PLATINUM_ABOVE, GOLD_ABOVE = 50_000_000, 10_000_000
FEE_TYPE_ACCOUNTS = {
    "Management": "4010",
    "Performance": "4020",
    "Advisory": "4030",
    "Transaction": "4040",
}
PAYMENT_STATUS = {
    "Paid In Full": "Paid",
    "Open": "Pending",
    "Pending Approval": "Pending",
}
EXPENSE_ACCOUNTS = ("5000", "8000")
REVENUE_ACCOUNTS = ("4000", "5000")


def aum_tier(total: Column) -> Column:
    """Tier of a client's total assets; no assets known is the lowest tier."""
    return (
        F.when(total > PLATINUM_ABOVE, "Platinum")
        .when(total > GOLD_ABOVE, "Gold")
        .otherwise("Silver")
    )


def in_account_range(account: Column, bounds: tuple[str, str]) -> Column:
    """Account numbers are text and compare as text."""
    return (account >= bounds[0]) & (account < bounds[1])


def curate_clients(
    accounts: DataFrame,
    users: DataFrame,
    financial_accounts: DataFrame,
    record_types: list[str],
) -> DataFrame:
    """Client dimension.  Keys run in id order; see ``hash_key`` for keys that
    survive inserts."""
    totals = financial_accounts.groupBy(F.col("account_id").alias("id")).agg(
        F.sum("total_aum").alias("client_aum")
    )
    owners = users.select(F.col("user_id").alias("owner_id"), "user_name")
    rows = (
        accounts.where(F.col("record_type").isin(record_types))
        .join(owners, "owner_id", "left")
        .join(totals, "id", "left")
    )
    return with_surrogate_key(
        rows.select(
            "id",
            F.coalesce(
                "account_number", F.concat(F.lit("SF-"), F.left("id", F.lit(15)))
            ).alias("client_id"),
            F.trim("name").alias("client_name"),
            map_values(F.col("type"), SEGMENTS, F.lit("Other")).alias("client_segment"),
            F.to_date("created_date").alias("relationship_start_date"),
            F.col("user_name").alias("relationship_manager"),
            first_matching_pattern(
                F.col("billing_city"), OFFICES, F.col("billing_city")
            ).alias("office_location"),
            aum_tier(F.col("client_aum")).alias("aum_tier"),
            F.coalesce("is_active", F.lit(True)).alias("is_active"),
        ),
        ["id"],
        "client_key",
    ).drop("id")


def curate_revenue(
    transactions: DataFrame,
    schedules: DataFrame,
    nav: DataFrame,
    crossref: DataFrame,
    dim_date: DataFrame,
    gl_accounts: DataFrame,
) -> DataFrame:
    """Revenue fact.  Fees without a rate in force have no fee type, hence no
    account, and drop out; :func:`unrated_fees` counts them."""
    fees = transactions.where(F.col("transaction_type") == "FEE")
    # The only whole-row work before the joins is narrowing: the dimension
    # lookups are small tables, the as-of step and the valuations share a key.
    rated = asof_latest(
        fees, schedules, ["account_id", "strategy_id"],
        "transaction_date", "effective_date", ["fee_type", "fee_rate_bps"],
    ).where(F.col("fee_type").isNotNull())
    valued = rated.join(
        nav.withColumnRenamed("valuation_date", "transaction_date"),
        ["account_id", "transaction_date"], "left",
    )
    keyed = resolve_key(
        valued, crossref, "CLIENT", "portfolio_id", "account_id", "client_key"
    )
    keyed = resolve_key(
        keyed, crossref, "PRODUCT", "portfolio_id", "strategy_id", "product_key"
    )
    dated = star_join(
        keyed, dim_date, "transaction_date", "calendar_date", ["date_key"]
    )
    posted = star_join(
        dated.withColumn(
            "gl_account_id", map_values(F.col("fee_type"), FEE_TYPE_ACCOUNTS)
        ),
        gl_accounts, "gl_account_id", "gl_account_id", ["gl_account_key"],
    )
    rows = posted.select(
        "date_key", "client_key", "product_key", "gl_account_key", "transaction_id",
        F.col("market_value").cast("decimal(18,2)").alias("aum_amount"),
        money(F.col("fee_amount")).alias("revenue_amount"),
        F.col("fee_rate_bps").alias("fee_basis_points"),
        F.lit(1).alias("transaction_count"),
        "loaded_at",
    )
    order = [F.desc("loaded_at"), F.desc("revenue_amount"), F.desc("date_key"),
             F.desc("product_key"), F.desc("fee_basis_points"),
             F.desc("gl_account_key"), F.desc("aum_amount")]
    return latest_per_key(rows, ["transaction_id"], order).drop("loaded_at")


def unmapped_fees(
    transactions: DataFrame,
    schedules: DataFrame,
    crossref: DataFrame,
    dim_date: DataFrame,
    gl_accounts: DataFrame,
) -> DataFrame:
    """Fees that :func:`curate_revenue` leaves out, each with its first cause.

    This is the staging table for manual resolution; :func:`per_cause` counts it.
    """
    fees = transactions.where(F.col("transaction_type") == "FEE")
    rows = asof_latest(
        fees, schedules, ["account_id", "strategy_id"],
        "transaction_date", "effective_date", ["fee_type"],
    ).withColumn("gl_account_id", map_values(F.col("fee_type"), FEE_TYPE_ACCOUNTS))

    def known(df: DataFrame, source: str, key: str, flag: str) -> DataFrame:
        return df.where(F.col(source).isNotNull()).select(
            F.col(source).alias(key), F.lit(True).alias(flag)
        ).distinct()

    def mapped(entity: str) -> DataFrame:
        return crossref.where(F.col("entity_type") == entity)

    lookups = [
        ("unknown client", known(mapped("CLIENT"), "portfolio_id", "account_id", "_client"),
         "account_id", "_client"),
        ("unknown product", known(mapped("PRODUCT"), "portfolio_id", "strategy_id", "_product"),
         "strategy_id", "_product"),
        ("unknown date", known(dim_date, "calendar_date", "transaction_date", "_date"),
         "transaction_date", "_date"),
        ("unknown account", known(gl_accounts, "gl_account_id", "gl_account_id", "_account"),
         "gl_account_id", "_account"),
    ]
    reason = F.when(F.col("fee_type").isNull(), "no rate in force")
    for label, table, key, flag in lookups:
        rows = rows.join(table, key, "left")
        reason = reason.when(F.col(flag).isNull(), label)
    return rows.withColumn("reason", reason).where("reason is not null").select(
        "transaction_id", "account_id", "strategy_id", "transaction_date",
        money(F.col("fee_amount")).alias("fee_amount"), "reason",
    )


def per_cause(unmapped: DataFrame) -> DataFrame:
    """Rows left out and their amount, per cause."""
    return unmapped.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("fee_amount").alias("fee_amount")
    )


def unrated_fees(transactions: DataFrame, schedules: DataFrame) -> DataFrame:
    """One row: fee transactions without a rate in force on their date."""
    fees = transactions.where(F.col("transaction_type") == "FEE")
    rated = asof_latest(
        fees, schedules, ["account_id", "strategy_id"],
        "transaction_date", "effective_date", ["fee_type"],
    )
    return rated.agg(
        F.count(F.lit(1)).alias("fees"),
        F.count_if(F.col("fee_type").isNull()).alias("unrated"),
    )


def curate_expense(
    lines: DataFrame,
    headers: DataFrame,
    accounts: DataFrame,
    dim_date: DataFrame,
    gl_accounts: DataFrame,
    cost_centers: DataFrame,
    vendors: DataFrame,
) -> DataFrame:
    """Expense fact, one row per document line.

    Account range and void filters are applied before the line-header join, and
    the line side is cut to one row per document line right after it.
    """
    posting = accounts.where(
        in_account_range(F.col("acctnumber"), EXPENSE_ACCOUNTS)
    ).select(F.col("id").alias("account"), F.col("acctnumber").alias("gl_account_id"))
    posting = posting.join(
        gl_accounts.select("gl_account_id", "gl_account_key"), "gl_account_id"
    )
    documents = headers.where(F.col("voided") == "No").select(
        F.col("id").alias("transaction"), "tranid", "entity", "status",
        F.col("memo").alias("header_memo"),
        F.to_date("trandate").alias("calendar_date"),
    )
    joined = lines.join(posting, "account").join(documents, "transaction")
    dated = star_join(joined, dim_date, "calendar_date", "calendar_date", ["date_key"])
    amount = F.coalesce("debitamount", F.lit(0).cast("decimal(18,4)")) - F.coalesce(
        "creditamount", F.lit(0).cast("decimal(18,4)")
    )
    priced = dated.withColumn("expense_amount", money(amount))
    once = latest_per_key(
        priced, ["tranid", "line_sequence"],
        [F.desc("loaded_at"), F.desc("expense_amount"), F.desc("gl_account_key"),
         F.desc_nulls_last("department"), F.desc_nulls_last("line_memo")],
    )
    centers = cost_centers.select("cost_center_id", "cost_center_key")
    sellers = vendors.select(
        F.col("id").alias("entity"), F.col("companyname").alias("vendor_name")
    )
    return (
        once.withColumn(
            "cost_center_id", padded_code("CC-", F.col("department"), 3)
        )
        .join(centers, "cost_center_id", "left")
        .join(sellers, "entity", "left")
        .select(
            "date_key", "cost_center_key", "gl_account_key",
            F.concat(F.lit("NS-"), "tranid").alias("transaction_id"),
            "line_sequence", "expense_amount", "vendor_name",
            F.coalesce("line_memo", "header_memo", F.lit("No description")).alias(
                "description"
            ),
            map_values(F.col("status"), PAYMENT_STATUS, F.lit("Accrued")).alias(
                "payment_status"
            ),
        )
    )


def curate_products(schedules: DataFrame, crossref: DataFrame) -> DataFrame:
    """Product dimension: the strategies of the fee schedules.

    The category is the fee type of the newest schedule of the strategy.
    """
    newest = schedules.groupBy("strategy_id").agg(
        F.max_by("fee_type", F.struct("effective_date", "fee_type", "account_id"))
        .alias("fee_type"),
        F.max("effective_date").alias("last_effective_date"),
    )
    return resolve_key(
        newest, crossref, "PRODUCT", "portfolio_id", "strategy_id", "product_key"
    ).select(
        "product_key",
        F.col("strategy_id").alias("product_id"),
        F.concat("fee_type", F.lit(" Fee")).alias("product_category"),
        map_values(F.col("fee_type"), FEE_TYPE_ACCOUNTS).alias("gl_account_id"),
        "last_effective_date",
    )


def curate_cost_centers(departments: DataFrame) -> DataFrame:
    return departments.select(
        F.col("id").alias("cost_center_key"),
        padded_code("CC-", F.col("id"), 3).alias("cost_center_id"),
        F.trim("name").alias("cost_center_name"),
        F.col("classification").alias("expense_category"),
        F.col("location").alias("office_location"),
    )


def account_type(account: Column) -> Column:
    return F.when(in_account_range(account, REVENUE_ACCOUNTS), "Revenue").when(
        in_account_range(account, EXPENSE_ACCOUNTS), "Expense"
    )


def curate_gl_accounts(accounts: DataFrame) -> DataFrame:
    """Active ledger accounts; type and balance side follow the number range."""
    kind = account_type(F.col("acctnumber"))
    return accounts.where("is_active").select(
        F.col("id").alias("gl_account_key"),
        F.col("acctnumber").alias("gl_account_id"),
        F.col("acctname").alias("gl_account_name"),
        kind.alias("account_type"),
        map_values(kind, {"Revenue": "Credit", "Expense": "Debit"}).alias(
            "normal_balance"
        ),
    )


def curate_budget(
    budgets: DataFrame,
    gl_accounts: DataFrame,
    cost_centers: DataFrame,
    crossref: DataFrame,
    dim_date: DataFrame,
) -> DataFrame:
    """Budget fact; cost centre and product may be missing."""
    posted = star_join(
        budgets, gl_accounts, "account", "gl_account_key",
        ["gl_account_id", "account_type"],
    )
    dated = star_join(posted, dim_date, "period_start", "calendar_date",
                      ["date_key", "fiscal_year"])
    keyed = resolve_key(
        dated, crossref, "PRODUCT", "portfolio_id", "strategy_id", "product_key",
        "left",
    )
    centers = cost_centers.select("cost_center_id", "cost_center_key")
    return (
        keyed.withColumn("cost_center_id", padded_code("CC-", F.col("department"), 3))
        .join(centers, "cost_center_id", "left")
        .select(
            "date_key", "cost_center_key", F.col("account").alias("gl_account_key"),
            "product_key", F.col("account_type").alias("budget_type"),
            money(F.col("amount")).alias("budget_amount"), "budget_version",
            "fiscal_year",
        )
    )


def curate_client_aum(valuations: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Assets per client, product and day with the change since the valuation
    before, split into client flows and market movement."""
    keys = ["client_key", "product_key"]
    daily = valuations.groupBy(*keys, "valuation_date").agg(
        F.sum("market_value").cast("decimal(18,2)").alias("aum_amount"),
        F.sum("cash_flow").cast("decimal(18,2)").alias("net_flows"),
    )
    changed = daily.withColumn(
        "aum_change",
        (
            F.col("aum_amount")
            - previous_in_group(daily, keys, "valuation_date", "aum_amount")
        ).cast("decimal(18,2)"),
    )
    return star_join(
        changed, dim_date, "valuation_date", "calendar_date", ["date_key"]
    ).select(
        "date_key", *keys, "aum_amount", "aum_change", "net_flows",
        (F.col("aum_change") - F.col("net_flows")).cast("decimal(18,2)").alias(
            "market_change"
        ),
    )


def fee_check(revenue: DataFrame) -> DataFrame:
    """Revenue next to the fee its assets and rate would give."""
    return revenue.select(
        "transaction_id", "revenue_amount",
        monthly_fee(F.col("aum_amount"), F.col("fee_basis_points")).alias(
            "expected_fee"
        ),
    )


def build_crossref(crm: DataFrame, portfolio: DataFrame, edits: int = 1) -> DataFrame:
    """Portfolio accounts mapped to CRM accounts.

    Both sides have ``id``, ``business_id``, ``name``, ``city``.  Business ids
    are tried first, names of the same city next; the rest stays unmatched.
    Proposals are unverified until somebody reviews them.
    """
    by_id = crm.where(F.col("business_id").isNotNull()).groupBy("business_id").agg(
        F.min("id").alias("crm_by_id")
    )
    tried = portfolio.join(by_id, "business_id", "left")

    def comparable(df: DataFrame) -> DataFrame:
        return df.select(
            "id", normalised_name(F.col("name")).alias("name"),
            normalised_name(F.col("city")).alias("city"),
        )

    rest = comparable(tried.where(F.col("crm_by_id").isNull()))
    by_name = propose_matches(rest, comparable(crm), edits).select(
        F.col("left_id").alias("id"), F.col("right_id").alias("crm_by_name"),
        "similarity",
    )
    method = (
        F.when(F.col("crm_by_id").isNotNull(), "ID_MATCH")
        .when(F.col("crm_by_name").isNotNull(), "NAME_MATCH")
        .otherwise("UNMATCHED")
    )
    return tried.join(by_name, "id", "left").select(
        F.lit("CLIENT").alias("entity_type"),
        F.col("id").alias("portfolio_id"),
        F.coalesce("crm_by_id", "crm_by_name").alias("crm_id"),
        method.alias("match_method"),
        F.round("similarity", 4).alias("similarity"),
        F.lit(False).alias("verified"),
    )


