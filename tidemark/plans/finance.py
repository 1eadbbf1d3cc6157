"""Finance dashboard queries over the star schema.

Facts are summed per date or per foreign key in one pass; everything after that
works on a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import (
    change_label, dollars, mean, one_place, ratio,
)
from tidemark.functions.temporal import key_to_date, month_label
from tidemark.operators.joins import star_rollup
from tidemark.operators.shape import melt, top_k
from tidemark.operators.windows import mom_change, newest_first_rank

MONTH = ["year_number", "month_number"]


def monthly_totals(fact: DataFrame, dim_date: DataFrame, sums: dict) -> DataFrame:
    """Additive measures per calendar month."""
    return star_rollup(fact, dim_date, "date_key", "date_key", MONTH, sums)


def kpi_with_change(fact: DataFrame, dim_date: DataFrame, amount: str) -> DataFrame:
    """Total as text, and the change of the newest month against the one before."""
    monthly = monthly_totals(fact, dim_date, {"amount": F.col(amount)})
    ranked = monthly.withColumn(
        "rn", newest_first_rank([F.desc("year_number"), F.desc("month_number")])
    )

    def nth(n: int) -> Column:
        return F.max(F.when(F.col("rn") == n, F.col("amount")))

    return ranked.agg(
        F.sum("amount").alias("total"), nth(1).alias("now"), nth(2).alias("before")
    ).select(
        dollars(F.col("total")).alias("value"),
        change_label(F.col("now"), F.col("before")).alias("diff"),
    )


def pl_trend(revenue: DataFrame, expense: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Revenue, expenses and net income per month, one row per metric."""
    rev = monthly_totals(revenue, dim_date, {"revenue": F.col("revenue_amount")})
    exp = monthly_totals(expense, dim_date, {"spent": F.col("expense_amount")})
    spent = F.coalesce(F.col("spent"), F.lit(0).cast("decimal(18,2)"))
    month = F.concat_ws(
        "-", F.col("year_number").cast("string"),
        F.lpad(F.col("month_number").cast("string"), 2, "0"), F.lit("01"),
    )
    wide = rev.join(exp, MONTH, "left").select(
        month.alias("month"),
        F.col("revenue").cast("decimal(28,2)").alias("Revenue"),
        spent.cast("decimal(28,2)").alias("Expenses"),
        (F.col("revenue") - spent).cast("decimal(28,2)").alias("Net Income"),
    )
    return melt(wide, ["month"], ["Revenue", "Expenses", "Net Income"], "metric",
                "amount")


def kpi_net_income(revenue: DataFrame, expense: DataFrame) -> DataFrame:
    """Revenue less expenses, and the margin."""
    spent = expense.agg(F.sum("expense_amount").alias("e")).scalar()
    earned = F.sum("revenue_amount")
    return revenue.agg(earned.alias("r")).withColumn("e", spent).select(
        dollars(F.col("r") - F.col("e")).alias("value"),
        F.concat(
            one_place(ratio(F.col("r") - F.col("e"), F.col("r")) * 100),
            F.lit("% margin"),
        ).alias("diff"),
    )


def kpi_clients(dim_client: DataFrame, revenue: DataFrame) -> DataFrame:
    """Active clients, and assets in billions."""
    aum = revenue.agg(F.sum("aum_amount").alias("a")).scalar()
    return dim_client.agg(F.count_if("is_active").alias("n")).select(
        F.col("n").cast("string").alias("value"),
        F.concat(
            F.lit("$"), one_place(aum.cast("double") / 1e9), F.lit("B AUM")
        ).alias("diff"),
    )


def revenue_by_segment(revenue: DataFrame, dim_client: DataFrame) -> DataFrame:
    return (
        star_rollup(
            revenue, dim_client, "client_key", "client_key", ["client_segment"],
            {"revenue": F.col("revenue_amount")},
        )
        .select(F.col("client_segment").alias("segment"),
                F.round("revenue", 0).alias("revenue"))
        .orderBy(F.desc("revenue"), "segment")
    )


def _fee_sums() -> dict[str, Column]:
    return {
        "revenue": F.col("revenue_amount"),
        "aum": F.col("aum_amount"),
        "bps": F.col("fee_basis_points"),
        "bps_rows": F.when(F.col("fee_basis_points").isNotNull(), 1),
    }


def revenue_by_product(revenue: DataFrame, dim_product: DataFrame) -> DataFrame:
    return (
        star_rollup(
            revenue, dim_product, "product_key", "product_key", ["product_category"],
            _fee_sums(),
        )
        .select(
            F.col("product_category").alias("category"),
            F.round("revenue", 0).alias("revenue"),
            mean(F.col("bps"), F.col("bps_rows"), 1).alias("avg_bps"),
        )
        .orderBy(F.desc("revenue"), "category")
    )


def top_expense_categories(
    expense: DataFrame, dim_cost_center: DataFrame, dim_category: DataFrame, k: int = 10
) -> DataFrame:
    """Largest expense categories: per cost centre, then per category."""
    per_center = star_rollup(
        expense, dim_cost_center, "cost_center_key", "cost_center_key",
        ["expense_category_key"], {"amount": F.col("expense_amount")},
    )
    named = star_rollup(
        per_center, dim_category, "expense_category_key", "expense_category_key",
        ["expense_category_name"], {"amount": F.col("amount")},
    )
    return top_k(
        named.select(F.col("expense_category_name").alias("category"),
                     F.round("amount", 0).alias("amount")),
        [F.desc("amount"), F.col("category")], k,
    )


def client_profitability(revenue: DataFrame, dim_client: DataFrame) -> DataFrame:
    by = ["client_name", "client_segment", "aum_tier"]
    return (
        star_rollup(revenue, dim_client, "client_key", "client_key", by, _fee_sums())
        .select(
            *by,
            F.round("revenue", 0).alias("total_revenue"),
            F.round(F.col("aum").cast("double") / 1e6, 1).alias("aum_millions"),
            mean(F.col("bps"), F.col("bps_rows"), 1).alias("avg_bps"),
        )
        .orderBy(F.desc("total_revenue"), "client_name")
    )


def client_profitability_text(revenue: DataFrame, dim_client: DataFrame) -> DataFrame:
    """The same with amounts as text."""
    return client_profitability(revenue, dim_client).select(
        "client_name", "client_segment", "aum_tier",
        dollars(F.col("total_revenue")).alias("total_revenue"),
        F.format_number("aum_millions", 1).alias("aum_millions"),
        "avg_bps",
    )


# -- monthly revenue report ---------------------------------------------------


def _by_key_month(revenue: DataFrame) -> DataFrame:
    return revenue.groupBy(F.floor(F.col("date_key") / 100).alias("year_month")).agg(
        F.min("date_key").alias("first_key"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("revenue_amount").alias("total_revenue"),
        F.count("revenue_amount").alias("amounts"),
        F.sum("aum_amount").alias("total_aum_at_billing"),
    ).withColumn("month_date", key_to_date(F.col("first_key"))).withColumn(
        "month_label", month_label(F.col("month_date"))
    )


def monthly_overview(revenue: DataFrame) -> DataFrame:
    return _by_key_month(revenue).select(
        "month_date", "month_label", "transaction_count", "total_revenue",
        mean(F.col("total_revenue"), F.col("amounts"), 2).alias("avg_revenue_per_txn"),
        "total_aum_at_billing",
    ).orderBy("month_date")


def grand_total(revenue: DataFrame) -> DataFrame:
    return revenue.agg(
        F.round(F.sum("revenue_amount"), 2).alias("total_revenue_all_months")
    )


def peak_and_low(revenue: DataFrame) -> DataFrame:
    """Best and worst month in one pass over the monthly rows."""
    monthly = _by_key_month(revenue)
    row = F.struct("month_label", "total_revenue")
    order = F.struct("total_revenue", "year_month")
    both = monthly.agg(F.max_by(row, order).alias("Peak"), F.min_by(row, order)
                       .alias("Lowest"))
    return melt(both, [], ["Peak", "Lowest"], "which", "m").select(
        "which", "m.month_label", "m.total_revenue"
    )


def monthly_change(revenue: DataFrame) -> DataFrame:
    monthly = _by_key_month(revenue).select("year_month", "month_label",
                                            "total_revenue")
    return mom_change(monthly, "year_month", "total_revenue").orderBy("year_month")
