"""The finance metric model and its month-grain rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import FINANCE_METRICS, Dimension, Fact, MetricModel


def finance_model(
    dim_date: DataFrame,
    dim_client: DataFrame,
    dim_product: DataFrame,
    dim_cost_center: DataFrame,
    revenue: DataFrame,
    expense: DataFrame,
    budget: DataFrame,
) -> MetricModel:
    return MetricModel(
        facts={
            "revenue": Fact(
                revenue,
                {"date": "date_key", "client": "client_key", "product": "product_key"},
                {
                    "amount": F.col("revenue_amount"),
                    "aum": F.col("aum_amount"),
                    "bps": F.col("fee_basis_points"),
                    "bps_rows": F.when(F.col("fee_basis_points").isNotNull(), 1),
                },
                {"clients": "client_key"},
            ),
            "expense": Fact(
                expense,
                {"date": "date_key", "cost_center": "cost_center_key"},
                {"amount": F.col("expense_amount")},
            ),
            "budget": Fact(
                budget,
                {"date": "date_key", "cost_center": "cost_center_key",
                 "product": "product_key"},
                {"amount": F.col("budget_amount")},
            ),
        },
        dimensions={
            "date": Dimension(
                dim_date, "date_key",
                ("calendar_date", "year_number", "quarter_name", "month_number"),
                early=True,
            ),
            "client": Dimension(
                dim_client, "client_key",
                ("client_segment", "office_location", "aum_tier", "client_name"),
            ),
            "product": Dimension(
                dim_product, "product_key", ("product_category", "asset_class")
            ),
            "cost_center": Dimension(
                dim_cost_center, "cost_center_key", ("cost_center_name",)
            ),
        },
        metrics=FINANCE_METRICS,
    )


def monthly_rollup(model: MetricModel) -> DataFrame:
    """The metrics of the analytics layer at month grain."""
    return model.query(
        ["total_revenue", "total_aum", "avg_fee_rate", "revenue_per_client",
         "total_expenses", "net_income", "profit_margin", "expense_ratio",
         "total_budget", "budget_variance"],
        by=["year_number", "month_number"],
    )
