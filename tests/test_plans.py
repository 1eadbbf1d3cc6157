"""Hand-made edge cases of the domain queries."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions.masks import ANALYST, COMPLIANCE, OPS, SERVICE
from tidemark.plans import (
    bikes, calendar, curation, finance, governance, loyalty, usage, validation,
)


def day(text):
    return F.lit(text).cast("date")


@pytest.fixture(scope="module")
def dim_date(spark):
    return calendar.calendar(spark, day("2023-11-01"), day("2024-04-30"))


# -- bike share ---------------------------------------------------------------


def raw_stations(spark, *payloads):
    """(json, ingestion second) pairs as landed rows."""
    df = spark.createDataFrame(
        [(p, datetime(2024, 1, 1, 0, 0, s)) for p, s in payloads],
        "j string, ingestion_time timestamp_ntz")
    return df.select(F.try_parse_json("j").alias("raw_data"), F.lit("f").alias("filename"),
                     "ingestion_time")


def station(ident, slots, **more):
    fields = {"id": f'"{ident}"', "latitude": "1.5", "longitude": "2.5",
              '"extra.slots"': slots, "extraction_at": '"2024-01-01 10:00:00"', **more}
    return "{" + ", ".join(
        f"{k if k.startswith(chr(34)) else chr(34) + k + chr(34)}: {v}"
        for k, v in fields.items()) + "}"


def test_slots_guard_and_tolerant_casts(spark):
    raw = raw_stations(
        spark, (station("null", "null"), 1), (station("zero", "0"), 1),
        (station("neg", "-3"), 1), (station("text", '"many"'), 1),
        (station("digits", '"12"'), 1), (station("ok", "7"), 1),
        (station("nolat", "7", latitude="null"), 1), ("{broken", 1))
    got = bikes.silver_clean(raw)
    assert rows(got, "station_id", "total_slots") == [("digits", 12), ("ok", 7)]


def test_strict_mode_fails_on_a_bad_cast(spark):
    with pytest.raises(Exception):
        bikes.silver_clean(raw_stations(spark, (station("t", '"many"'), 1)),
                           strict=True).collect()


def test_last_ingested_wins_and_ties_are_settled(spark):
    raw = raw_stations(
        spark, (station("a", "5", free_bikes="1"), 1), (station("a", "5", free_bikes="2"), 9),
        (station("b", "5", free_bikes="3"), 4), (station("b", "5", free_bikes="8"), 4))
    got = bikes.silver_clean(raw)
    assert rows(got, "station_id", "free_bikes") == [("a", 2), ("b", 8)]


def test_occupancy_without_slots_is_null(spark):
    silver = spark.createDataFrame(
        [("a", datetime(2024, 1, 1), True, 0, 0, 0)],
        "station_id string, extraction_at timestamp_ntz, is_online boolean, "
        "free_bikes bigint, empty_slots bigint, total_slots bigint")
    assert rows(bikes.network_summary(silver), "network_occupancy_pct") == [(None,)]


def test_typed_landing_gives_the_same_silver(spark):
    from conftest import SMALL

    from tidemark.plans.adapters import Tables

    t = Tables(spark, SMALL)
    typed = bikes.silver_latest(bikes.usable(bikes.project_columns(t.station_payloads())))
    variant = bikes.silver_clean(t.bike_stations_raw())
    assert rows(typed, *variant.columns) == rows(variant)


def test_raw_duplicates_and_null_metrics(spark):
    one = station("a", "5")
    raw = raw_stations(spark, (one, 1), (one, 2), (station("b", "5"), 1), ("{", 1))
    got = {r["metric_name"]: r["metric_value"]
           for r in bikes.layer_metrics("bronze", raw).collect()}
    # The unparseable line has no payload to compare and counts as excess, as
    # count(*) - count(distinct) does.
    assert got == {"bronze null raw_data": 1, "bronze null filename": 0,
                   "bronze duplicate rows": 2}


def test_availability_colours(spark):
    df = spark.createDataFrame([(60.0,), (59.9,), (29.9,), (None,)], "o double")
    got = df.select(bikes.availability_band(F.col("o"))[0].alias("red"))
    assert [r["red"] for r in got.collect()] == [34, 255, 220, 220]


# -- finance ------------------------------------------------------------------


def test_pl_trend_month_without_expenses(spark, dim_date):
    revenue = spark.createDataFrame([(20240105, Decimal("10.00"))],
                                    "date_key int, revenue_amount decimal(18,2)")
    expense = spark.createDataFrame([(20240205, Decimal("3.00"))],
                                    "date_key int, expense_amount decimal(18,2)")
    got = finance.pl_trend(revenue, expense, dim_date)
    assert rows(got) == [("2024-01-01", "Expenses", Decimal("0.00")),
                         ("2024-01-01", "Net Income", Decimal("10.00")),
                         ("2024-01-01", "Revenue", Decimal("10.00"))]


def test_calendar_variants(spark):
    def one(**variant):
        return calendar.calendar(spark, day("2024-03-30"), day("2024-04-01"), **variant)

    sunday = one().where("calendar_date = '2024-03-31'").first()
    assert (sunday["day_of_week"], sunday["is_business_day"]) == (0, False)
    assert (sunday["is_month_end"], sunday["is_quarter_end"], sunday["is_year_end"]) == (
        True, True, False)
    iso = rows(one(weekday="iso", key="running"), "date_key", "day_of_week", "day_name")
    assert iso == [(1, 6, "Sat"), (2, 7, "Sun"), (3, 1, "Mon")]


def test_profitability_is_not_fanned_out(spark, dim_date):
    revenue = spark.createDataFrame(
        [(20240105, Decimal("50.00")), (20240105, Decimal("50.00"))],
        "date_key int, revenue_amount decimal(18,2)")
    expense = spark.createDataFrame([(20240105, Decimal("60.00"))],
                                    "date_key int, expense_amount decimal(18,2)")
    got = validation.profitability_band(revenue, expense, dim_date, day("2024-04-30"))
    assert rows(got, "expense_ratio_pct", "status") == [(60.0, "OK")]


# -- validation ---------------------------------------------------------------


def test_gaps_count_days_not_rows(spark, dim_date):
    expense = spark.createDataFrame(
        [(20240401,), (20240401,), (20240405,)], "date_key int")
    got = validation.expense_gap_runs(dim_date, expense, day("2024-04-05"), 4)
    assert rows(got, "gap_start", "gap_end", "consecutive_missing_days", "status") == [
        (date(2024, 4, 2), date(2024, 4, 4), 3, "ALERT: 3+ consecutive days missing")]


def test_missing_calendar_days(spark, dim_date):
    holed = dim_date.where("calendar_date != '2024-02-29'")
    assert rows(validation.missing_calendar_days(holed)) == [(date(2024, 2, 29), "Thu")]


def test_health_on_dirty_facts(spark, dim_date):
    revenue = spark.createDataFrame(
        [("t1", 20240105, 1, 1, Decimal("5.00")), ("t1", 20240105, 9, 1, None),
         ("t2", 20990101, None, 1, Decimal("-1.00"))],
        "transaction_id string, date_key int, client_key int, product_key int, "
        "revenue_amount decimal(18,2)")
    expense = spark.createDataFrame(
        [("e1", 1, 1, 1, Decimal("5.00")), ("e1", 2, 1, 7, Decimal("2.00"))],
        "transaction_id string, line int, cost_center_key int, gl_account_key int, "
        "expense_amount decimal(18,2)")

    def dim(key):
        return spark.createDataFrame([(1,)], f"{key} int")

    def run(**more):
        got = validation.health(
            revenue, expense, dim("client_key"), dim("product_key"), dim_date,
            dim("cost_center_key"), dim("gl_account_key"), day("2024-04-30"), **more)
        return {r["check_name"]: r["fail_count"] for r in got.collect()}

    by_document = run()
    assert by_document == {
        "FK: Revenue -> Client": 2, "FK: Revenue -> Product": 0, "FK: Revenue -> Date": 1,
        "FK: Expense -> Cost Center": 0, "FK: Expense -> GL Account": 1,
        "NULL: Revenue Amount": 1, "NULL: Expense Amount": 0,
        "DUP: Revenue Transactions": 1, "DUP: Expense Transactions": 1,
        "NEG: Revenue Amount": 1, "NEG: Expense Amount": 0}
    assert run(expense_key=["transaction_id", "line"])["DUP: Expense Transactions"] == 0


def test_latency_weighs_copies(spark):
    at = datetime(2024, 1, 1, 10, 0, 30)
    curated = spark.createDataFrame([("a", at), ("a", at), ("b", at)],
                                    "k string, created_at timestamp_ntz")
    raw = spark.createDataFrame(
        [("a", datetime(2024, 1, 1, 9, 59, 59)), ("b", datetime(2024, 1, 1, 9, 50))],
        "k string, loaded_at timestamp_ntz")
    got = validation.latency(curated, raw, "k", "x",
                             F.lit("2024-01-01").cast("timestamp_ntz"))
    assert rows(got) == [("x", 4.0, 10)]


def test_tolerance(spark):
    df = spark.createDataFrame([("raw", 10.0), ("curated", 11.5)], "source string, total double")
    assert rows(validation.within_tolerance(df, 1), "status") == [("FAIL",)]
    assert rows(validation.within_tolerance(df, 2), "status") == [("PASS",)]


# -- curation -----------------------------------------------------------------


@pytest.mark.parametrize(
    "total, tier", [(None, "Silver"), (10_000_000, "Silver"), (10_000_001, "Gold"),
                    (50_000_000, "Gold"), (50_000_001, "Platinum")])
def test_aum_tier(spark, total, tier):
    df = spark.range(1).select(curation.aum_tier(F.lit(total).cast("bigint")).alias("t"))
    assert df.first()["t"] == tier


def test_account_range_is_textual(spark):
    df = spark.createDataFrame([("5000",), ("7999",), ("8000",), ("60",), ("49999",)], "a string")
    inside = df.where(curation.in_account_range(F.col("a"), curation.EXPENSE_ACCOUNTS))
    assert rows(inside) == [("5000",), ("60",), ("7999",)]


def test_revenue_without_a_rate_vanishes_but_is_counted(spark, dim_date):
    transactions = spark.createDataFrame(
        [("t1", "A1", "S1", date(2024, 1, 5), "FEE", Decimal("9.995"), datetime(2024, 1, 6)),
         ("t1", "A1", "S1", date(2024, 1, 5), "FEE", Decimal("7.00"), datetime(2024, 1, 7)),
         ("t2", "A1", "S1", date(2024, 1, 1), "FEE", Decimal("1.00"), datetime(2024, 1, 6)),
         ("t3", "A1", "S1", date(2024, 1, 5), "REFUND", Decimal("1.00"), datetime(2024, 1, 6))],
        "transaction_id string, account_id string, strategy_id string, "
        "transaction_date date, transaction_type string, fee_amount decimal(18,4), "
        "loaded_at timestamp_ntz")
    schedules = spark.createDataFrame(
        [("A1", "S1", date(2024, 1, 2), "Advisory", Decimal("80.0000")),
         ("A1", "S1", date(2024, 1, 5), "Management", Decimal("90.0000")),
         ("A1", "S1", date(2024, 2, 1), "Performance", Decimal("99.0000"))],
        "account_id string, strategy_id string, effective_date date, fee_type string, "
        "fee_rate_bps decimal(8,4)")
    nav = spark.createDataFrame([], "account_id string, valuation_date date, "
                                    "market_value decimal(18,2)")
    crossref = spark.createDataFrame(
        [("CLIENT", "A1", 11), ("PRODUCT", "S1", 22), ("PRODUCT", "A1", 33)],
        "entity_type string, portfolio_id string, curated_key int")
    gl = spark.createDataFrame([("4010", 1), ("4030", 3)],
                               "gl_account_id string, gl_account_key int")
    got = curation.curate_revenue(transactions, schedules, nav, crossref, dim_date, gl)
    assert rows(got, "transaction_id", "client_key", "product_key", "gl_account_key",
                "revenue_amount", "fee_basis_points", "aum_amount") == [
        ("t1", 11, 22, 1, Decimal("7.00"), Decimal("90.0000"), None)]
    assert rows(curation.unrated_fees(transactions, schedules)) == [(3, 1)]


def test_crossref_prefers_ids_and_flags_the_rest(spark):
    schema = "id int, business_id string, name string, city string"
    crm = spark.createDataFrame(
        [(1, "b1", "Alpha Ltd.", "York"), (2, None, "Beta & Co", "York"),
         (3, None, "Beta & Co", "Leeds")], schema)
    portfolio = spark.createDataFrame(
        [(10, "b1", "Omega", "York"), (11, "zz", "beta co", "york"),
         (12, None, "Beta Coo", "YORK"), (13, None, "Gamma", "York")], schema)
    got = curation.build_crossref(crm, portfolio)
    assert rows(got, "portfolio_id", "crm_id", "match_method") == [
        (10, 1, "ID_MATCH"), (11, 2, "NAME_MATCH"), (12, 2, "NAME_MATCH"),
        (13, None, "UNMATCHED")]


# -- loyalty ------------------------------------------------------------------


def test_visits_are_never_broadcast_and_keep_their_copies(spark, tmp_path):
    at = datetime(2024, 1, 2, 3, 4, 5)

    def table(name, data, schema):
        """Stored rows: their size is known and small."""
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    visits = table(
        "visits", [("1", "U1", "10", at), ("1", "U1", "10", at), ("2", "U9", "10", at), ("3", "U2", "11", at),
                   (None, "U2", "12", at), ("5", None, "10", at)],
        "visit_id string, user_id string, business_id string, visit_timestamp timestamp_ntz",
    ).withColumns({"visit_type": F.lit("x"), "points_earned": F.lit(1), "cashback_amount": F.lit(2),
                   "punch_count": F.lit(3)})
    users = table("users", [("U1", 1), ("U2", 2), ("U2", 3)], "user_id string, user_key int")
    shops = table("shops", [("10", 10, "VIP"), ("11", 11, None), ("12", 12, "VIP"), ("12", 13, "None")],
                  "business_id string, business_key int, loyalty_type string")
    types = table("types", [(0, "VIP"), (1, "None")], "loyalty_type_key int, loyalty_type_name string")
    fact = loyalty.load_fact_visits(visits, users, shops, types)
    plan = fact._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 1
    assert rows(fact, "visit_id", "date_key", "user_key", "business_key", "loyalty_type_key") == sorted(
        [("1", 20240102, 1, 10, 0)] * 2
        + [(None, 20240102, u, b, t) for u in (2, 3) for b, t in ((12, 0), (13, 1))], key=repr)



@pytest.fixture(scope="module")
def churn(spark):
    users = spark.createDataFrame(
        [(i, f"u{i}", "A", "B", "active", date(2024, 1, 1), "z") for i in range(1, 5)],
        "user_key int, user_id string, first_name string, last_name string, "
        "status string, registration_date date, preferred_zone string")
    visits = spark.createDataFrame(
        [(1, 1, 5, datetime(2024, 3, 31, 8)), (2, 2, 5, datetime(2024, 3, 1, 23)),
         (3, 3, 5, datetime(2024, 2, 29, 1)), (4, 3, 6, datetime(2024, 1, 2, 1))],
        "visit_key int, user_key int, business_key int, visit_timestamp timestamp_ntz"
    ).withColumns({"points_earned": F.lit(2), "cashback_amount": F.lit(1)})
    return loyalty.churn_flags(users, visits, F.lit("2024-03-31").cast("date")), visits


def test_churn_at_thirty_and_thirty_one_days(churn):
    got = rows(churn[0], "user_key", "days_since_last_visit", "churn_status", "total_visits")
    assert got == [(1, 0, "active", 1), (2, 30, "active", 1), (3, 31, "churned", 2),
                   (4, None, "never_visited", 0)]


def test_churn_report_puts_never_visited_first(churn):
    assert [r["user_key"] for r in loyalty.churn_report(churn[0]).collect()] == [4, 3, 2, 1]


def test_churn_summary_shares(churn):
    got = rows(loyalty.churn_summary(churn[0]), "churn_status", "user_count", "pct_of_total")
    assert got == [("active", 2, 50.0), ("churned", 1, 25.0), ("never_visited", 1, 25.0)]


def test_monthly_churn_skips_a_month_after_a_gap(spark):
    months = [(1, "2024-01-05"), (2, "2024-01-09"), (1, "2024-02-01"), (1, "2024-04-01"),
              (1, "2024-05-01"), (2, "2024-05-01")]
    visits = spark.createDataFrame(months, "user_key int, t string").select(
        "user_key", F.col("t").cast("timestamp_ntz").alias("visit_timestamp"))
    got = loyalty.monthly_churn(visits)
    assert rows(got) == [(date(2024, 2, 1), 2, 1, 1, 50.0), (date(2024, 5, 1), 1, 2, 0, 0.0)]


# -- usage --------------------------------------------------------------------


@pytest.mark.parametrize(
    "kind, text, expected",
    [("CREATE_TABLE", "streamlit", "TABLE"), ("CREATE", "create Streamlit agent", "STREAMLIT APP"),
     ("CREATE", "create agent x", "AGENT"), ("CREATE", "create file  format", "OTHER"),
     ("CREATE", "create file format", "FILE FORMAT"), ("CREATE", None, "OTHER"),
     ("CREATE_ROLE", None, "ROLE"), ("SELECT", "stage", "OTHER")])
def test_classify_object(spark, kind, text, expected):
    column = usage.classify_object(F.lit(kind), F.lit(text).cast("string"))
    assert spark.range(1).select(column.alias("c")).first()["c"] == expected


def test_week_over_week_without_a_previous_week(spark):
    log = spark.createDataFrame([("u", datetime(2024, 1, 30), Decimal("2.0000"))],
                                "user_name string, start_time timestamp_ntz, "
                                "credits_attributed_compute decimal(18,4)")
    got = usage.week_over_week(log, "u", F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"))
    assert [None if v is None else float(v) for v in rows(got)[0]] == [2.0, 0.0, 2.0, None]


# -- governance ---------------------------------------------------------------


@pytest.mark.parametrize(
    "user, role, seen",
    [("office", ANALYST, [1, 2]), ("client", ANALYST, [3]), ("all", ANALYST, [1, 2, 3]),
     ("both", ANALYST, [1]), ("nobody", ANALYST, []), ("nobody", SERVICE, []),
     ("nobody", OPS, [1, 2, 3]), ("nobody", COMPLIANCE, [1, 2, 3])])
def test_row_access(spark, user, role, seen):
    clients = spark.createDataFrame([(1, "NY"), (2, "NY"), (3, "SF")],
                                    "client_key int, office_location string")
    access = spark.createDataFrame(
        [("office", "NY", None), ("office", "NY", None), ("client", None, 3),
         ("all", None, None), ("both", "NY", 1), ("both", "NY", 3)],
        "user_email string, office_location string, client_key int")
    got = governance.row_access(clients, access, user, role)
    assert rows(got, "client_key") == [(k,) for k in seen]


def test_visible_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ssn int, amount int, other int")
    tags = {"ssn": "RESTRICTED", "amount": "CONFIDENTIAL"}
    assert governance.visible_columns(df, tags, COMPLIANCE).columns == df.columns
    assert governance.visible_columns(df, tags, ANALYST).columns == ["amount", "other"]
    assert governance.visible_columns(df, tags, SERVICE).columns == ["other"]


def test_off_hours_uses_the_local_weekday(spark):
    log = spark.createDataFrame(
        # Friday 20:30, Friday 23:30 and Sunday 20:00 in New York.
        [("in", datetime(2024, 1, 6, 1, 30)), ("late", datetime(2024, 1, 6, 4, 30)),
         ("weekend", datetime(2024, 1, 8, 1, 0))],
        "user_name string, start_time timestamp_ntz"
    ).withColumns({"role_name": F.lit("ANALYST"), "database_name": F.lit("D")})
    now = F.lit(datetime(2024, 1, 8, 1, 10)).cast("timestamp_ntz")
    week = governance.off_hours_access(log, "D", now, minutes=7 * 24 * 60)
    assert rows(week, "user_name") == [("late",), ("weekend",)]
    recent = governance.off_hours_access(log, "D", now)  # the last half hour
    assert rows(recent, "user_name") == [("weekend",)]


def test_gaps_per_group(spark):
    days = spark.sql("""select cast(date_format(d, 'yyyyMMdd') as int) as date_key,
        d as calendar_date, date_format(d, 'EEE') as day_name, true as is_business_day
        from (select explode(sequence(date'2024-01-01', date'2024-01-06')) as d)""")
    fact = spark.createDataFrame(
        [(1, 20240101), (1, 20240102), (1, 20240105), (2, 20240106)], "g int, date_key int")
    as_of = F.lit("2024-01-06").cast("date")
    lost = validation.business_days_without_rows(days, fact, as_of, 30, ["g"])
    assert [(r.g, r.calendar_date.day) for r in lost.orderBy("g", "calendar_date").collect()] == [
        (1, 3), (1, 4), (1, 6), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5)]
    runs = validation.expense_gap_runs(days, fact, as_of, 30, ["g"])
    assert rows(runs, "g", "consecutive_missing_days") == [(1, 1), (1, 2), (2, 5)]


def test_line_and_count_rules(spark):
    lines = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1)], "d int, l int")
    assert rows(validation.repeated_lines(lines, "d", "l")) == [
        ("expense: repeated line", 1), ("expense: too many lines", 1)]
    for n, status in ((99, "PASS"), (98, "FAIL")):
        got = validation.count_within(spark.range(n), spark.range(100), "c", 0.01)
        assert rows(got) == [("c", n, 100, status)]
