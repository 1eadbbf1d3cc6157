"""Domain tables derived from the driver's test tables.

Each method is a lazy view, so a query reads only the columns and rows it
needs.  A user with real tables passes those to the domain functions instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.money import (
    cents, from_hundredths, half_up_hundredths, hundredths,
)
from tidemark.functions.temporal import date_key, earliest, hour_floor, latest
from tidemark.functions.text import map_values, padded_code
from tidemark.plans.calendar import calendar

# The four loyalty programmes.
LOYALTY_TYPES = {0: "Cashback", 1: "Punch Card", 2: "VIP Pass", 3: "None"}
# Business categories.
CATEGORIES = {
    0: "Restaurant", 1: "Cafe", 2: "Taqueria", 3: "Bakery", 4: "Bar",
    5: "Food Truck", 6: "Ice Cream Shop",
}
FEE_TYPES = {0: "Management", 1: "Performance", 2: "Advisory", 3: "Transaction"}


def _hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


class Tables:
    """The tables of one folder and the domain views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- finance, curated ---------------------------------------------------

    def dim_date(self, **variant: str) -> DataFrame:
        days = self.orders.select(F.col("o_orderdate").alias("d")).unionAll(
            self.lineitem.select("l_shipdate")
        )
        return calendar(self.spark, earliest(days, "d"), latest(days, "d"), **variant)

    def dim_client(self) -> DataFrame:
        balance = F.col("c_acctbal")
        return self.customer.join(
            self.nation, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("c_custkey").alias("client_key"),
            F.concat(F.lit("CL-"), F.col("c_custkey").cast("string")).alias("client_id"),
            F.col("c_name").alias("client_name"),
            F.col("c_mktsegment").alias("client_segment"),
            F.col("n_name").alias("office_location"),
            F.when(balance > 5000, "Platinum")
            .when(balance > 1000, "Gold")
            .otherwise("Silver")
            .alias("aum_tier"),
            (balance >= 0).alias("is_active"),
        )

    def dim_product(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("product_key"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("product_category"),
            F.col("p_brand").alias("asset_class"),
        )

    def dim_gl_account(self) -> DataFrame:
        revenue = self.region.select(
            (F.lit(4010) + F.col("r_regionkey") * 10).alias("gl_account_key"),
            F.concat(F.lit("Fees "), F.col("r_name")).alias("gl_account_name"),
        )
        expense = self.nation.select(
            (F.lit(5000) + F.col("n_nationkey") * 100).alias("gl_account_key"),
            F.concat(F.lit("Cost "), F.col("n_name")).alias("gl_account_name"),
        )
        return revenue.unionByName(expense).withColumn(
            "gl_account_id", F.col("gl_account_key").cast("string")
        )

    def dim_cost_center(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("cost_center_key"),
            F.col("s_name").alias("cost_center_name"),
            F.col("s_nationkey").alias("expense_category_key"),
        )

    def dim_expense_category(self) -> DataFrame:
        return self.nation.join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            F.col("n_nationkey").alias("expense_category_key"),
            F.col("n_name").alias("expense_category_name"),
            F.col("r_name").alias("expense_group"),
        )

    def _lines(self, since: Column | None) -> DataFrame:
        """Lines shipped from a date on; the raw column is compared, so files
        and row groups before it are skipped."""
        if since is None:
            return self.lineitem
        return self.lineitem.where(F.col("l_shipdate") >= since.cast("timestamp_ntz"))

    def fact_revenue(
        self, with_client: bool = False, since: Column | None = None
    ) -> DataFrame:
        """Fee revenue; the client needs a join with orders, so only on demand."""
        lines = self._lines(since)
        client: list[Column] = []
        if with_client:
            owners = self.orders.select(
                F.col("o_orderkey").alias("l_orderkey"),
                F.col("o_custkey").alias("client_key"),
            )
            lines = lines.join(owners, "l_orderkey", "left")
            client = [F.col("client_key")]
        price = hundredths(F.col("l_extendedprice"))
        discount = hundredths(F.col("l_discount"))
        return lines.select(
            F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias(
                "transaction_id"
            ),
            date_key(F.col("l_shipdate")).alias("date_key"),
            *client,
            F.col("l_partkey").alias("product_key"),
            (F.lit(4010) + F.col("l_linenumber") % 4 * 10).alias("gl_account_key"),
            from_hundredths(price).alias("aum_amount"),
            from_hundredths(half_up_hundredths(price * (100 - discount))).alias(
                "revenue_amount"
            ),
            (discount * 100).cast("decimal(8,4)").alias("fee_basis_points"),
            _hours(F.col("l_shipdate"), F.col("l_linenumber")).alias("created_at"),
        )

    def fact_expense(self, since: Column | None = None) -> DataFrame:
        price = hundredths(F.col("l_extendedprice"))
        tax = hundredths(F.col("l_tax"))
        status = (
            F.when(F.col("l_linestatus") == "F", "Paid")
            .when(F.col("l_returnflag") == "R", "Pending")
            .otherwise("Accrued")
        )
        return self._lines(since).select(
            F.concat_ws(
                "-", F.lit("NS"), F.col("l_orderkey"), F.col("l_linenumber")
            ).alias("transaction_id"),
            date_key(F.col("l_shipdate")).alias("date_key"),
            F.col("l_suppkey").alias("cost_center_key"),
            (F.lit(5000) + F.col("l_suppkey") % 25 * 100).alias("gl_account_key"),
            from_hundredths(half_up_hundredths(price * tax)).alias("expense_amount"),
            status.alias("payment_status"),
            _hours(F.col("l_shipdate"), F.col("l_linenumber")).alias("created_at"),
        )

    def fact_budget(self) -> DataFrame:
        return self.orders.select(
            date_key(F.trunc("o_orderdate", "month")).alias("date_key"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_custkey"))
            .alias("cost_center_key"),
            (F.lit(5000) + F.col("o_custkey") % 25 * 100).alias("gl_account_key"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias(
                "product_key"
            ),
            from_hundredths(hundredths(F.col("o_totalprice"))).alias("budget_amount"),
        )

    def fact_client_aum(self) -> DataFrame:
        return self.orders.select(
            date_key(F.col("o_orderdate")).alias("date_key"),
            F.col("o_custkey").alias("client_key"),
            F.left("o_orderpriority", F.lit(1)).cast("bigint").alias("product_key"),
            from_hundredths(hundredths(F.col("o_totalprice"))).alias("aum_amount"),
        )

    def entity_crossref(self) -> DataFrame:
        key = F.col("c_custkey")
        clients = self.customer.select(
            F.lit("CLIENT").alias("entity_type"),
            F.when(key % 7 != 0, F.concat(F.lit("A"), key.cast("string"))).alias(
                "portfolio_id"
            ),
            F.when(key % 11 != 0, padded_code("ACC", key, 12)).alias("crm_id"),
            key.alias("curated_key"),
            (key % 5 != 0).alias("verified"),
        )
        products = self.nation.select(
            F.lit("PRODUCT").alias("entity_type"),
            F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias(
                "portfolio_id"
            ),
            F.lit(None).cast("string").alias("crm_id"),
            F.col("n_nationkey").cast("bigint").alias("curated_key"),
            F.lit(True).alias("verified"),
        )
        return clients.unionByName(products)

    def entity_accounts(self) -> DataFrame:
        """Accounts of the three systems: shared business ids, misspelt names, doubles."""
        key = F.col("c_custkey")
        text = key.cast("string")
        name = F.concat(F.lit("Firm "), F.left(F.md5(text.cast("binary")), F.lit(10)))
        city = F.concat(F.lit("City "), F.col("c_nationkey").cast("string"))
        business = F.concat(F.lit("B"), text)

        def side(system: str, prefix: str, held: Column, known: Column, called: Column) -> DataFrame:
            return self.customer.where(held).select(
                F.lit(system).alias("system"), F.concat(F.lit(prefix), text).alias("id"),
                F.when(known, business).alias("business_id"), called.alias("name"), city.alias("city"),
            )

        respelt = (
            F.when(key % 5 == 0, F.concat(F.upper(name), F.lit("!")))
            .when(key % 5 == 1, F.left(name, F.length(name) - 1))
            .otherwise(F.concat(F.lit("Unit "), text))
        )
        ledger = F.when(key % 5 == 2, F.concat(name, F.lit("x"))).otherwise(name)
        sides = [
            side("crm", "ACC", key % 11 != 0, key % 7 != 0, name),
            side("portfolio", "A", key % 13 != 0, key % 3 != 0, respelt),
            side("ledger", "L", key % 4 != 0, key % 2 == 0, ledger).withColumn(
                "business_id",
                F.when(F.substring("id", 2, 9).cast("long") % 40 == 1, "NONE").otherwise(F.col("business_id")),
            ),
            side("ledger", "LX", key % 17 == 0, F.lit(True), F.concat(F.lit("Old "), name)),
        ]
        return sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])

    def entity_known(self) -> DataFrame:
        """Keys of an earlier cross-reference."""
        key = F.col("c_custkey")
        return self.customer.where((key % 3 == 0) & (key % 11 != 0)).select(
            F.lit("crm").alias("system"), F.concat(F.lit("ACC"), key.cast("string")).alias("account"),
            key.alias("curated_key"),
        )

    def entity_reviews(self) -> DataFrame:
        """Links that people confirmed, and proposed names that they refused."""
        key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
        return self.customer.where((key % 19 == 0) | (key % 23 == 0)).select(
            F.lit("portfolio").alias("left_system"), F.concat(F.lit("A"), text).alias("left_id"),
            F.when(key % 19 == 0, "crm").otherwise("ledger").alias("right_system"),
            F.concat(F.when(key % 19 == 0, "ACC").otherwise("L"), text).alias("right_id"),
            (key % 19 == 0).alias("accepted"),
        )

    # -- finance, raw -------------------------------------------------------

    def _lines_with_account(self) -> DataFrame:
        owners = self.orders.select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("account_id"),
        )
        return self.lineitem.join(owners, "l_orderkey").withColumn(
            "strategy_id", F.concat(F.lit("S"), F.col("l_linenumber").cast("string"))
        )

    def portfolio_transactions(self, with_account: bool = True) -> DataFrame:
        price, discount = cents(F.col("l_extendedprice")), cents(F.col("l_discount"))
        rows = self._lines_with_account() if with_account else self.lineitem
        account = [F.col("account_id"), F.col("strategy_id")] if with_account else []
        return rows.select(
            F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias(
                "transaction_id"
            ),
            *account,
            F.to_date("l_shipdate").alias("transaction_date"),
            F.when(F.col("l_returnflag") == "R", "REFUND")
            .otherwise("FEE")
            .alias("transaction_type"),
            (price * (1 - discount)).alias("fee_amount"),
            _hours(F.col("l_shipdate"), F.col("l_suppkey") % 24).alias("loaded_at"),
        )

    def portfolio_fee_schedules(self) -> DataFrame:
        """One rate per account, strategy and effective date."""
        repriced = self._lines_with_account().where(F.col("l_returnflag") == "R")
        return repriced.groupBy(
            "account_id", "strategy_id", F.to_date("l_shipdate").alias("effective_date")
        ).agg(
            map_values(F.max(F.col("l_suppkey")) % 4, FEE_TYPES).alias("fee_type"),
            (F.max(cents(F.col("l_discount"))) * 10000)
            .cast("decimal(8,4)")
            .alias("fee_rate_bps"),
        )

    def portfolio_nav(self) -> DataFrame:
        return self.orders.groupBy(
            F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("account_id"),
            F.to_date("o_orderdate").alias("valuation_date"),
        ).agg(F.sum(cents(F.col("o_totalprice"))).alias("market_value"))

    def portfolio_valuations(self) -> DataFrame:
        """Valuations and cash flows per client, product and day."""
        price = cents(F.col("o_totalprice"))
        flow = (
            F.when(F.col("o_orderstatus") == "F", price)
            .when(F.col("o_orderstatus") == "O", -price)
            .otherwise(F.lit(0).cast("decimal(12,2)"))
        )
        return self.orders.select(
            F.col("o_custkey").alias("client_key"),
            F.left("o_orderpriority", F.lit(1)).cast("bigint").alias("product_key"),
            F.to_date("o_orderdate").alias("valuation_date"),
            price.alias("market_value"),
            flow.alias("cash_flow"),
        )

    def ledger_transactions(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderkey").cast("string").alias("tranid"),
            F.col("o_orderdate").alias("trandate"),
            F.col("o_custkey").alias("entity"),
            map_values(
                F.col("o_orderstatus"), {"F": "Paid In Full", "O": "Open"},
                F.lit("Pending Approval"),
            ).alias("status"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias(
                "memo"
            ),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Yes")
            .otherwise("No")
            .alias("voided"),
        )

    def ledger_lines(self) -> DataFrame:
        price = cents(F.col("l_extendedprice"))
        return self.lineitem.select(
            F.col("l_orderkey").alias("transaction"),
            (F.col("l_suppkey") % 25).alias("account"),
            F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias(
                "department"
            ),
            F.when(F.col("l_linestatus") == "F", price * cents(F.col("l_tax"))).alias(
                "debitamount"
            ),
            F.when(
                F.col("l_returnflag") == "R", price * cents(F.col("l_discount"))
            ).alias("creditamount"),
            F.when(F.col("l_linestatus") == "O", F.lit("line note")).alias("line_memo"),
            F.col("l_linenumber").alias("line_sequence"),
            _hours(F.col("l_shipdate"), F.col("l_suppkey") % 24).alias("loaded_at"),
        )

    def ledger_accounts(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            (F.lit(4000) + F.col("n_nationkey") * 200).cast("string").alias("acctnumber"),
            F.col("n_name").alias("acctname"),
            (F.col("n_regionkey") != 4).alias("is_active"),
        )

    def ledger_departments(self) -> DataFrame:
        return self.nation.join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("classification"),
            F.concat(F.lit("Office "), F.col("r_name")).alias("location"),
        )

    def ledger_vendors(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("companyname")
        )

    def ledger_gl_accounts(self) -> DataFrame:
        """GL dimension over the ledger's accounts, keyed by account id."""
        return self.ledger_accounts().select(
            F.col("id").alias("gl_account_key"),
            F.col("acctnumber").alias("gl_account_id"),
        )

    def ledger_cost_centers(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").cast("bigint").alias("cost_center_key"),
            padded_code("CC-", F.col("n_nationkey"), 3).alias("cost_center_id"),
        )

    def ledger_budgets(self) -> DataFrame:
        key = F.col("o_custkey")
        return self.orders.select(
            (key % 25).alias("account"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", key % 25).alias(
                "department"
            ),
            F.when(
                F.col("o_orderstatus") != "P",
                F.concat(F.lit("S"), (key % 25).cast("string")),
            ).alias("strategy_id"),
            F.to_date(F.trunc("o_orderdate", "month")).alias("period_start"),
            cents(F.col("o_totalprice")).alias("amount"),
            F.when(F.col("o_orderstatus") == "F", "Original")
            .otherwise("Revised")
            .alias("budget_version"),
        )

    def crm_accounts(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.customer.select(
            padded_code("ACC", key, 12).alias("id"),
            F.when(key % 7 != 0, F.concat(F.lit("AN-"), key.cast("string"))).alias(
                "account_number"
            ),
            F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("name"),
            map_values(
                F.col("c_mktsegment"),
                {
                    "HOUSEHOLD": "Individual",
                    "MACHINERY": "Institution",
                    "BUILDING": "Family Office",
                },
                F.col("c_mktsegment"),
            ).alias("type"),
            _hours(F.lit("1995-01-01").cast("timestamp_ntz"), key % 10000).alias(
                "created_date"
            ),
            F.col("c_nationkey").cast("bigint").alias("owner_id"),
            map_values(
                F.col("c_nationkey") % 4,
                {0: "New York City", 1: "south BOSTON", 2: "San Francisco"},
                F.lit("Chicago"),
            ).alias("billing_city"),
            F.when(F.col("c_acctbal") < 0, F.lit(False))
            .when(F.col("c_acctbal") > 5000, F.lit(True))
            .alias("is_active"),
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", "prospect")
            .otherwise("client")
            .alias("record_type"),
        )

    def crm_users(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").cast("bigint").alias("user_id"),
            F.concat(F.lit("Manager "), F.col("n_name")).alias("user_name"),
        )

    def crm_financial_accounts(self) -> DataFrame:
        return self.orders.select(
            padded_code("ACC", F.col("o_custkey"), 12).alias("account_id"),
            (cents(F.col("o_totalprice")) * 10).alias("total_aum"),
        )

    # -- loyalty ------------------------------------------------------------

    def _k(self) -> Column:
        return F.get_json_object("props", "$.k").cast("int")

    def fact_visits(self) -> DataFrame:
        """Visits from the event table."""
        k = self._k()
        return self.events.select(
            F.col("event_id").alias("visit_key"),
            date_key(F.col("ts")).alias("date_key"),
            F.col("user_id").alias("user_key"),
            k.alias("business_key"),
            (k % 4).alias("loyalty_type_key"),
            map_values(
                F.col("event_type"),
                {"purchase": "redemption", "signup": "referral"},
                F.lit("check-in"),
            ).alias("visit_type"),
            F.col("ts").alias("visit_timestamp"),
            F.floor("value").alias("points_earned"),
            F.when(k % 4 == 0, cents(F.col("value")))
            .otherwise(F.lit(0).cast("decimal(12,2)"))
            .alias("cashback_amount"),
            F.when((k % 4 == 1) | (k == 3), 1).otherwise(0).alias("punch_count"),
        )

    def order_visits(self) -> DataFrame:
        """Visits from orders: years of history, users that left or never came."""
        business = (F.col("o_orderkey") % 100).cast("int")
        return self.orders.select(
            F.col("o_orderkey").alias("visit_key"),
            F.col("o_custkey").alias("user_key"),
            business.alias("business_key"),
            (business % 4).alias("loyalty_type_key"),
            F.col("o_orderdate").alias("visit_timestamp"),
            F.floor(F.col("o_totalprice") / 1000).alias("points_earned"),
            cents(F.col("o_totalprice")).alias("cashback_amount"),
        )

    def dim_users(self) -> DataFrame:
        return self.customer.join(
            self.nation, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("c_custkey").alias("user_key"),
            F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("user_id"),
            F.substring_index("c_name", "#", 1).alias("first_name"),
            F.substring_index("c_name", "#", -1).alias("last_name"),
            F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey") % 5).alias(
                "registration_date"
            ),
            F.col("n_name").alias("preferred_zone"),
        )

    def dim_businesses(self) -> DataFrame:
        k = F.col("business_key")
        return self.events.select(self._k().alias("business_key")).distinct().select(
            k,
            F.concat(F.lit("Business "), k.cast("string")).alias("business_name"),
            map_values(k % 7, CATEGORIES).alias("category"),
            map_values(k % 4, LOYALTY_TYPES).alias("loyalty_type"),
            F.concat(F.lit("Zone "), (k % 9).cast("string")).alias("neighborhood"),
            (F.lit(30) + k % 21).cast("decimal(4,1)").alias("_tenths"),
            (F.lit(2090000) + k * 160).cast("bigint").alias("_lat_e5"),
            (F.lit(-8970000) + k * 210).cast("bigint").alias("_lng_e5"),
        ).select(
            "business_key", "business_name", "category", "loyalty_type", "neighborhood",
            (F.col("_tenths") / 10).cast("decimal(3,1)").alias("google_rating"),
            (F.col("_lat_e5") / 100000).alias("lat"),
            (F.col("_lng_e5") / 100000).alias("lng"),
        )

    def dim_loyalty_type(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(k, n) for k, n in LOYALTY_TYPES.items()],
            "loyalty_type_key int, loyalty_type_name string",
        )

    def dim_time(self) -> DataFrame:
        days = calendar(
            self.spark, earliest(self.events, "ts"), latest(self.events, "ts"), "iso"
        )
        return days.select(
            "date_key", "calendar_date",
            F.col("year_number").alias("year"),
            F.col("month_number").alias("month"),
            "month_name", "day_of_week", "day_name",
            (~F.col("is_business_day")).alias("is_weekend"),
        )

    # -- usage and audit ----------------------------------------------------

    def _user(self, key: str = "user_id") -> Column:
        return F.concat(F.lit("USER_"), F.col(key).cast("string"))

    def attribution_history(self) -> DataFrame:
        k = self._k()
        return self.events.select(
            F.col("event_id").alias("query_id"),
            self._user().alias("user_name"),
            F.col("event_type").alias("warehouse_name"),
            F.col("ts").alias("start_time"),
            cents(F.col("value")).cast("decimal(18,4)").alias(
                "credits_attributed_compute"
            ),
            F.when(k % 3 != 0, (k / F.lit(1000)).cast("decimal(18,4)")).alias(
                "credits_used_query_acceleration"
            ),
        )

    def assistant_usage(self) -> DataFrame:
        """Natural-language requests: the purchase events."""
        return self.events.where(F.col("event_type") == "purchase").select(
            self._user().alias("username"),
            F.col("ts").alias("start_time"),
            cents(F.col("value")).alias("credits"),
            (self._k() + 1).alias("request_count"),
        )

    def query_history(self) -> DataFrame:
        k = self._k()
        kinds = {
            0: ("CREATE_TABLE", "create table t"),
            1: ("CREATE_TABLE_AS_SELECT", "create table t as select * from DIM_CLIENT"),
            2: ("CREATE_VIEW", "create view v"),
            3: ("CREATE", "create streamlit app_one"),
            4: ("CREATE", "create notebook n"),
            5: ("CREATE", "create or replace stage s"),
            6: ("CREATE", "create schema s"),
            7: ("CREATE", "create function f"),
            8: ("SELECT", "select client_name from dim_client"),
            9: ("INSERT", "insert into t values (1)"),
        }
        return self.events.select(
            self._user().alias("user_name"),
            map_values(k % 10, {i: v[0] for i, v in kinds.items()}).alias("query_type"),
            map_values(k % 10, {i: v[1] for i, v in kinds.items()}).alias("query_text"),
            F.concat(F.lit("h"), k.cast("string")).alias("query_hash"),
            F.when(F.col("event_type") == "error", "FAIL")
            .otherwise("SUCCESS")
            .alias("execution_status"),
            F.col("ts").alias("start_time"),
            F.floor(F.col("value") * 100).alias("total_elapsed_time"),
            (k.cast("bigint") * 65536).alias("bytes_scanned"),
            map_values(
                k % 6,
                {0: "SERVICE", 1: "OPS", 2: "ACCOUNTADMIN", 3: "COMPLIANCE"},
                F.lit("ANALYST"),
            ).alias("role_name"),
            (k.cast("bigint") * 200).alias("rows_produced"),
            F.when(k % 8 == 0, F.lit("app=ai_analyst;v=1")).alias("query_tag"),
            F.lit("FINANCE").alias("database_name"),
        )

    def login_history(self) -> DataFrame:
        return self.events.select(
            F.col("ts").alias("event_timestamp"),
            self._user().alias("user_name"),
            F.when(F.col("event_type") == "error", "NO").otherwise("YES").alias(
                "is_success"
            ),
            F.concat(F.lit("10.0.0."), self._k().cast("string")).alias("client_ip"),
        )

    def storage_history(self) -> DataFrame:
        k = self._k()
        return self.events.select(
            F.concat(
                F.lit("DB_"), (F.col("user_id") % 40).cast("string"),
                F.when(k % 2 == 0, F.lit("_DEV")).otherwise(F.lit("")),
            ).alias("database_name"),
            F.to_date("ts").alias("usage_date"),
            F.col("ts").alias("sampled_at"),
            (F.floor(F.col("value") * 100) * 1048576).alias("average_database_bytes"),
            (k.cast("bigint") * 1048576).alias("average_failsafe_bytes"),
            F.when(k % 3 == 0, k.cast("bigint") * 524288).alias(
                "average_hybrid_table_storage_bytes"
            ),
        )

    def users(self) -> DataFrame:
        """Accounts with last login: the customers and their last order."""
        last = self.orders.groupBy("o_custkey").agg(
            F.max("o_orderdate").alias("last_success_login")
        )
        key = F.col("c_custkey")
        return self.customer.join(last, key == F.col("o_custkey"), "left").select(
            F.concat(F.lit("USER_"), key.cast("string")).alias("name"),
            F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias(
                "email"
            ),
            F.when(F.col("c_acctbal") < 0, "true").otherwise("false").alias("disabled"),
            "last_success_login",
            F.when(F.col("c_mktsegment") == "FURNITURE",
                   F.lit("2001-01-01").cast("date")).alias("deleted_on"),
        )

    def grants_to_users(self) -> DataFrame:
        return self.orders.select(
            F.concat(F.lit("USER_"), F.col("o_custkey").cast("string")).alias(
                "grantee_name"
            ),
            map_values(
                F.col("o_orderpriority"), {"1-URGENT": "ACCOUNTADMIN", "2-HIGH": "OPS"},
                F.col("o_orderpriority"),
            ).alias("role"),
            F.col("o_orderdate").alias("granted_on"),
            F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias(
                "deleted_on"
            ),
        )

    def inventory(self) -> dict[str, DataFrame]:
        """Catalog listings by object kind: (catalog, deleted), and the type of tables."""
        def listing(df: DataFrame, owner: str, gone: Column, *more: Column) -> DataFrame:
            return df.select(
                *more,
                F.concat(
                    F.lit("DB_"), (F.col(owner) % 40).cast("string"),
                    F.when(F.col(owner) % 3 == 0, "_DEV").otherwise(""),
                ).alias("catalog"),
                F.when(gone, F.lit(1)).alias("deleted"),
            )

        return {
            "TABLE": listing(
                self.part, "p_partkey", F.col("p_size") > 40,
                F.when(F.col("p_size") % 4 == 0, "VIEW").otherwise("BASE TABLE")
                .alias("table_type"),
            ),
            "VIEW": listing(self.customer, "c_custkey", F.col("c_acctbal") < 0),
            "FUNCTION": listing(self.supplier, "s_suppkey", F.col("s_acctbal") < 0),
            "PROCEDURE": listing(
                self.orders, "o_orderkey", F.col("o_orderstatus") == "P"
            ),
            "STAGE": listing(self.documents, "doc_id", F.col("n_chars") > 2000),
            "SEMANTIC VIEW": listing(self.pages, "page_id", F.col("page_id") < 0),
        }

    def client_access_map(self) -> DataFrame:
        """Who sees which clients: an office each for nation managers, and one
        named client for each customer."""
        offices = self.nation.select(
            F.concat(F.lit("manager"), F.col("n_nationkey").cast("string")).alias(
                "user_email"
            ),
            F.col("n_name").alias("office_location"),
            F.lit(None).cast("bigint").alias("client_key"),
        )
        named = self.customer.select(
            F.concat(F.lit("manager"), F.col("c_nationkey").cast("string")).alias(
                "user_email"
            ),
            F.lit(None).cast("string").alias("office_location"),
            F.when(F.col("c_acctbal") > 9000, F.col("c_custkey")).alias("client_key"),
        ).where(F.col("client_key").isNotNull())
        return offices.unionByName(named)

    # -- bike share ---------------------------------------------------------

    def station_payloads(self) -> DataFrame:
        """Station rows as fetched: dotted names, dirty addresses and times."""
        k = self._k()
        station = F.col("user_id")
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
        return self.events.select(
            station.cast("string").alias("id"),
            F.concat(F.lit("Station "), station.cast("string")).alias("name"),
            F.when(k % 10 != 9, F.lit(40.0) + station / 100000).alias("latitude"),
            F.when(k % 10 != 8, F.lit(-3.0) - station / 100000).alias("longitude"),
            (F.floor("value") % (k + 1)).alias("free_bikes"),
            (k - F.floor("value") % (k + 1)).alias("empty_slots"),
            map_values(
                k % 4,
                {0: "Z", 1: "+00:00Z", 2: "+02:00"},
                F.lit(" junk"),
            ).alias("_zone"),
            stamp.alias("_stamp"),
            hour_floor(F.col("ts")).alias("extraction_at"),
            F.concat(F.lit("N"), station.cast("string")).alias("extra.number"),
            station.alias("extra.uid"),
            k.alias("extra.slots"),
            F.concat(F.lit("Calle "), station.cast("string"), F.lit(" , ,,")).alias(
                "extra.address"
            ),
            (F.col("event_type") != "error").alias("extra.online"),
            F.col("event_type").alias("extra.light"),
            F.col("ts").alias("ingestion_time"),
        ).withColumn("timestamp", F.concat("_stamp", "_zone")).drop("_stamp", "_zone")

    def bike_stations_raw(self) -> DataFrame:
        rows = self.station_payloads()
        payload = [F.col(f"`{c}`") for c in rows.columns if c != "ingestion_time"]
        # A landed table stores the value; here it is built on the fly.  Passing
        # it through a one-element array keeps Catalyst from repeating the build
        # for each field read from it.
        built = F.to_variant_object(F.struct(*payload))
        return rows.select(
            F.explode(F.array(built)).alias("raw_data"),
            F.lit("events.parquet").alias("filename"),
            "ingestion_time",
        )


