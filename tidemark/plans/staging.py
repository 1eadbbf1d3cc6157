"""Facts whose keys are not known yet wait in a staging table and move once, when they are.

A batch reads the staging rows the batch before it left and its own rows, looks their
keys up, appends what is complete to the fact and leaves the rest, with its cause, as the
new staging rows.  Both are folders of that batch, so a batch that died half way is run
again over the same input and puts the same rows in their place.  After every batch, fact
and staging together hold each input row exactly once, in whatever order batches come.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import money
from tidemark.functions.text import map_values, padded_code
from tidemark.operators.dedupe import latest_per_key
from tidemark.operators.joins import asof_latest
from tidemark.plans.curation import FEE_TYPE_ACCOUNTS, account_type
from tidemark.session import stored


def looked_up(df: DataFrame, reference: DataFrame, source: str, key: str, output: str) -> DataFrame:
    """``df``, every row once, with ``output``: the smallest key of its id, null if unknown."""
    keys = reference.where(F.col(source).isNotNull()).groupBy(source).agg(F.min(key).alias(output))
    return df.join(keys, source, "left")


def _mapped(crossref: DataFrame, entity_type: str, name: str) -> DataFrame:
    return crossref.where(F.col("entity_type") == entity_type).select(
        F.col("portfolio_id").alias(name), "curated_key"
    )


def first_reason(**causes: Column) -> Column:
    """The first cause that holds, blanks for underscores; null if none does."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(causes.items()):
        reason = F.when(holds, name.replace("_", " ")).otherwise(reason)
    return reason


def keyed_fees(
    fees: DataFrame, schedules: DataFrame, nav: DataFrame, crossref: DataFrame,
    dim_date: DataFrame, gl_accounts: DataFrame,
) -> DataFrame:
    """Every fee once, with its keys, rate and valuation, and ``reason`` if something is missing.

    One as-of join serves the fact and the staging table.
    """
    rows = asof_latest(
        fees, schedules, ["account_id", "strategy_id"], "transaction_date", "effective_date",
        ["fee_type", "fee_rate_bps"],
    ).withColumn("gl_account_id", map_values(F.col("fee_type"), FEE_TYPE_ACCOUNTS))
    days = dim_date.select(F.col("calendar_date").alias("transaction_date"), "date_key")
    rows = looked_up(rows, _mapped(crossref, "CLIENT", "account_id"), "account_id", "curated_key", "client_key")
    rows = looked_up(rows, _mapped(crossref, "PRODUCT", "strategy_id"), "strategy_id", "curated_key", "product_key")
    rows = looked_up(rows, days, "transaction_date", "date_key", "date_key")
    rows = looked_up(rows, gl_accounts, "gl_account_id", "gl_account_key", "gl_account_key")
    values = nav.groupBy("account_id", F.col("valuation_date").alias("transaction_date")).agg(
        F.max("market_value").alias("market_value")
    )
    return rows.join(values, ["account_id", "transaction_date"], "left").withColumn(
        "reason",
        first_reason(
            no_rate_in_force=F.col("fee_type").isNull(), unknown_client=F.col("client_key").isNull(),
            unknown_product=F.col("product_key").isNull(), unknown_date=F.col("date_key").isNull(),
            unknown_account=F.col("gl_account_key").isNull(),
        ),
    )


def revenue_rows(keyed: DataFrame) -> DataFrame:
    """The revenue fact's columns of complete fees."""
    return keyed.select(
        "date_key", "client_key", "product_key", "gl_account_key", "transaction_id",
        F.col("market_value").cast("decimal(18,2)").alias("aum_amount"),
        money(F.col("fee_amount")).alias("revenue_amount"),
        F.col("fee_rate_bps").alias("fee_basis_points"), F.lit(1).alias("transaction_count"), "loaded_at",
    )


def newest_revenue(fact: DataFrame) -> DataFrame:
    """One row for each transaction: reprocessed ones by their newest load."""
    order = ["loaded_at", "revenue_amount", "date_key", "product_key", "fee_basis_points",
             "gl_account_key", "aum_amount", "client_key"]
    return latest_per_key(fact, ["transaction_id"], [F.desc(c) for c in order])


def keyed_budgets(
    budgets: DataFrame, gl_accounts: DataFrame, cost_centers: DataFrame, crossref: DataFrame, dim_date: DataFrame,
) -> DataFrame:
    """Every budget line once, with its keys, and ``reason`` if its account is closed or unknown,
    its period lies outside the calendar, or it names a strategy without a product."""
    accounts = gl_accounts.select(F.col("gl_account_key").alias("account"), "gl_account_id")
    days = dim_date.select(F.col("calendar_date").alias("period_start"), "date_key")
    rows = budgets.withColumn("cost_center_id", padded_code("CC-", F.col("department"), 3))
    rows = looked_up(rows, accounts, "account", "gl_account_id", "gl_account_id")
    rows = looked_up(rows, days, "period_start", "date_key", "date_key")
    rows = looked_up(rows, _mapped(crossref, "PRODUCT", "strategy_id"), "strategy_id", "curated_key", "product_key")
    rows = looked_up(rows, cost_centers, "cost_center_id", "cost_center_key", "cost_center_key")
    return rows.withColumn(
        "reason",
        first_reason(
            closed_account=F.col("gl_account_id").isNull(), unknown_date=F.col("date_key").isNull(),
            unknown_product=F.col("strategy_id").isNotNull() & F.col("product_key").isNull(),
        ),
    )


def budget_rows(keyed: DataFrame) -> DataFrame:
    """The budget fact's columns of complete lines."""
    return keyed.select(
        "date_key", "cost_center_key", F.col("account").alias("gl_account_key"), "product_key",
        account_type(F.col("gl_account_id")).alias("budget_type"),
        money(F.col("amount")).alias("budget_amount"), "budget_version",
        F.floor(F.col("date_key") / 10000).cast("int").alias("fiscal_year"),
    )


@dataclass(frozen=True)
class StagedFact:
    """A fact and its staging table below ``folder``.

    ``keyed`` adds keys and ``reason`` to raw rows, keeping each once; ``shaped`` takes the
    fact's columns from complete ones.
    """

    folder: str
    keyed: Callable[[DataFrame], DataFrame]
    shaped: Callable[[DataFrame], DataFrame]

    def run(self, rows: DataFrame, batch: int, after: int | None, created_at: Column) -> None:
        """Load a batch.  ``after`` is the batch whose staging rows are tried again, none for the first.

        ``created_at`` goes to every new fact row; ``staged_in`` says since which batch a row waits.
        """
        spark, columns = rows.sparkSession, rows.columns
        pending = rows.withColumn("staged_in", F.lit(batch))
        if after is not None:
            pending = spark.read.parquet(f"{self.folder}/staged/batch={after}").select(
                *columns, "staged_in"
            ).unionByName(pending)
        judged = stored(self.keyed(pending), "keyed")
        (
            self.shaped(judged.where("reason is null")).withColumn("created_at", created_at.cast("timestamp_ntz"))
            .write.mode("overwrite").parquet(f"{self.folder}/fact/batch={batch}")
        )
        (
            judged.where("reason is not null").select(*columns, "staged_in", "reason")
            .write.mode("overwrite").parquet(f"{self.folder}/staged/batch={batch}")
        )

    def fact(self, like: DataFrame) -> DataFrame:
        """All fact rows so far, with the batch that loaded them."""
        return like.sparkSession.read.parquet(f"{self.folder}/fact")

    def staged(self, like: DataFrame, batch: int) -> DataFrame:
        """What waits after a batch: the staging table for manual resolution."""
        return like.sparkSession.read.parquet(f"{self.folder}/staged/batch={batch}")


def product_details(
    schedules: DataFrame, strategies: DataFrame, crossref: DataFrame, as_of: Column, created_at: Column,
) -> DataFrame:
    """Product dimension with every column: name, category, fee type, asset class, activity.

    The strategies of the fee schedules are the products.  The fee type is that of the
    newest schedule; name, asset class and closing date come from ``strategies``
    (``strategy_id``, ``strategy_name``, ``asset_class``, ``closed_on``).  A strategy that is
    not described there goes by its id and counts as active; without a mapping its key is null.
    """
    newest = schedules.groupBy("strategy_id").agg(
        F.max_by("fee_type", F.struct("effective_date", "fee_type", "account_id")).alias("fee_type")
    )
    described = strategies.groupBy("strategy_id").agg(
        F.min(F.struct("strategy_name", "asset_class", "closed_on")).alias("s")
    )
    keyed = looked_up(
        newest.join(described, "strategy_id", "left"), _mapped(crossref, "PRODUCT", "strategy_id"),
        "strategy_id", "curated_key", "product_key",
    )
    return keyed.select(
        "product_key", F.col("strategy_id").alias("product_id"),
        F.coalesce(F.trim("s.strategy_name"), "strategy_id").alias("product_name"),
        F.concat("fee_type", F.lit(" Fee")).alias("product_category"), "fee_type",
        F.col("s.asset_class").alias("asset_class"),
        F.coalesce(F.col("s.closed_on") > as_of, F.lit(True)).alias("is_active"),
        created_at.cast("timestamp_ntz").alias("created_at"),
    )
