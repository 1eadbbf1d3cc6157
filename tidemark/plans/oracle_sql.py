"""The registered queries as DuckDB SQL over the same tables.

``VIEWS`` are the adapter tables as SQL; a query gets the ones it mentions as
common table expressions.
"""

from __future__ import annotations

import re

_PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"
_DISC = "CAST(l_discount AS DECIMAL(12,2))"
_TAX = "CAST(l_tax AS DECIMAL(12,2))"
_DAY = "CAST(strftime({0}, '%Y%m%d') AS INT)"
_TXN = "l_orderkey || '-' || l_linenumber"

_CAL_COLUMNS = """
  CAST(isodow(d) % 7 AS INT) AS day_of_week, strftime(d, '%a') AS day_name,
  day(d) AS day_of_month, dayofyear(d) AS day_of_year, weekofyear(d) AS week_of_year,
  month(d) AS month_number, strftime(d, '%b') AS month_name,
  quarter(d) AS quarter_number, 'Q' || quarter(d) AS quarter_name,
  year(d) AS year_number, quarter(d) AS fiscal_quarter, year(d) AS fiscal_year,
  d = last_day(d) AS is_month_end,
  d = last_day(d) AND month(d) IN (3, 6, 9, 12) AS is_quarter_end,
  month(d) = 12 AND day(d) = 31 AS is_year_end,
  isodow(d) <= 5 AS is_business_day
"""

VIEWS = {
    "ev": "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events",
    "all_days": """
      SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
      FROM (SELECT min(x) AS lo, max(x) AS hi FROM (
        SELECT o_orderdate AS x FROM orders UNION ALL SELECT l_shipdate FROM lineitem))""",
    "dim_date": f"""
      SELECT {_DAY.format('d')} AS date_key, d AS calendar_date, {_CAL_COLUMNS}
      FROM all_days""",
    "dim_client": """
      SELECT c_custkey AS client_key, 'CL-' || c_custkey AS client_id,
        c_name AS client_name, c_mktsegment AS client_segment,
        n_name AS office_location,
        CASE WHEN c_acctbal > 5000 THEN 'Platinum' WHEN c_acctbal > 1000 THEN 'Gold'
             ELSE 'Silver' END AS aum_tier,
        c_acctbal >= 0 AS is_active
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "dim_gl_account": """
      SELECT *, CAST(gl_account_key AS VARCHAR) AS gl_account_id FROM (
        SELECT 4010 + r_regionkey * 10 AS gl_account_key, 'Fees ' || r_name AS gl_account_name
        FROM region UNION ALL
        SELECT 5000 + n_nationkey * 100, 'Cost ' || n_name FROM nation)""",
    "fact_revenue": f"""
      SELECT {_TXN} AS transaction_id, {_DAY.format('l_shipdate')} AS date_key,
        o_custkey AS client_key, l_partkey AS product_key,
        4010 + l_linenumber % 4 * 10 AS gl_account_key,
        CAST({_PRICE} AS DECIMAL(18,2)) AS aum_amount,
        CAST({_PRICE} * (1 - {_DISC}) AS DECIMAL(18,2)) AS revenue_amount,
        CAST({_DISC} * 10000 AS DECIMAL(8,4)) AS fee_basis_points,
        l_shipdate + to_hours(l_linenumber) AS created_at
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "fact_expense": f"""
      SELECT 'NS-' || {_TXN} AS transaction_id, {_DAY.format('l_shipdate')} AS date_key,
        l_suppkey AS cost_center_key, 5000 + l_suppkey % 25 * 100 AS gl_account_key,
        CAST({_PRICE} * {_TAX} AS DECIMAL(18,2)) AS expense_amount,
        CASE WHEN l_linestatus = 'F' THEN 'Paid' WHEN l_returnflag = 'R' THEN 'Pending'
             ELSE 'Accrued' END AS payment_status,
        l_shipdate + to_hours(l_linenumber) AS created_at
      FROM lineitem""",
    "fact_budget": f"""
      SELECT {_DAY.format("date_trunc('month', o_orderdate)")} AS date_key,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey END AS cost_center_key,
        5000 + o_custkey % 25 * 100 AS gl_account_key,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS product_key,
        CAST(o_totalprice AS DECIMAL(18,2)) AS budget_amount
      FROM orders""",
    "fact_client_aum": f"""
      SELECT {_DAY.format('o_orderdate')} AS date_key, o_custkey AS client_key,
        CAST(left(o_orderpriority, 1) AS BIGINT) AS product_key,
        CAST(o_totalprice AS DECIMAL(18,2)) AS aum_amount FROM orders""",
    "entity_crossref": """
      SELECT 'CLIENT' AS entity_type,
        CASE WHEN c_custkey % 7 <> 0 THEN 'A' || c_custkey END AS portfolio_id,
        CASE WHEN c_custkey % 11 <> 0
             THEN 'ACC' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS crm_id,
        c_custkey AS curated_key, c_custkey % 5 <> 0 AS verified
      FROM customer
      UNION ALL
      SELECT 'PRODUCT', 'S' || n_nationkey, NULL, n_nationkey, TRUE FROM nation""",
    "portfolio_transactions": f"""
      SELECT {_TXN} AS transaction_id, 'A' || o_custkey AS account_id,
        'S' || l_linenumber AS strategy_id, CAST(l_shipdate AS DATE) AS transaction_date,
        CASE WHEN l_returnflag = 'R' THEN 'REFUND' ELSE 'FEE' END AS transaction_type,
        {_PRICE} * (1 - {_DISC}) AS fee_amount,
        l_shipdate + to_hours(l_suppkey % 24) AS loaded_at
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fee_schedules": f"""
      SELECT 'A' || o_custkey AS account_id, 'S' || l_linenumber AS strategy_id,
        CAST(l_shipdate AS DATE) AS effective_date,
        CASE max(l_suppkey) % 4 WHEN 0 THEN 'Management' WHEN 1 THEN 'Performance'
             WHEN 2 THEN 'Advisory' ELSE 'Transaction' END AS fee_type,
        CAST(max({_DISC}) * 10000 AS DECIMAL(8,4)) AS fee_rate_bps
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE l_returnflag = 'R' GROUP BY ALL""",
    "nav": """
      SELECT 'A' || o_custkey AS account_id, CAST(o_orderdate AS DATE) AS valuation_date,
        sum(CAST(o_totalprice AS DECIMAL(12,2))) AS market_value
      FROM orders GROUP BY ALL""",
    "rated_fees": """
      SELECT gt.*, fs.fee_type, fs.fee_rate_bps
      FROM portfolio_transactions gt ASOF LEFT JOIN fee_schedules fs
        ON gt.account_id = fs.account_id AND gt.strategy_id = fs.strategy_id
        AND gt.transaction_date >= fs.effective_date
      WHERE gt.transaction_type = 'FEE'""",
    "ledger_accounts": """
      SELECT CAST(n_nationkey AS BIGINT) AS id,
        CAST(4000 + n_nationkey * 200 AS VARCHAR) AS acctnumber,
        n_name AS acctname, n_regionkey <> 4 AS is_active FROM nation""",
    "ledger_headers": """
      SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS tranid,
        o_orderdate AS trandate, o_custkey AS entity,
        CASE o_orderstatus WHEN 'F' THEN 'Paid In Full' WHEN 'O' THEN 'Open'
             ELSE 'Pending Approval' END AS status,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS memo,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END AS voided
      FROM orders""",
    "ledger_lines": f"""
      SELECT l_orderkey AS transaction_no, l_suppkey % 25 AS account,
        CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS department,
        CASE WHEN l_linestatus = 'F' THEN {_PRICE} * {_TAX} END AS debitamount,
        CASE WHEN l_returnflag = 'R' THEN {_PRICE} * {_DISC} END AS creditamount,
        CASE WHEN l_linestatus = 'O' THEN 'line note' END AS line_memo,
        l_linenumber AS line_sequence,
        l_shipdate + to_hours(l_suppkey % 24) AS loaded_at
      FROM lineitem""",
    "curated_expense": """
      SELECT d.date_key, cc.n_nationkey AS cost_center_key, na.id AS gl_account_key,
        'NS-' || nt.tranid AS transaction_id, ntl.line_sequence,
        CAST(coalesce(ntl.debitamount, 0) - coalesce(ntl.creditamount, 0)
             AS DECIMAL(18,2)) AS expense_amount,
        v.s_name AS vendor_name,
        coalesce(ntl.line_memo, nt.memo, 'No description') AS description,
        CASE nt.status WHEN 'Paid In Full' THEN 'Paid' WHEN 'Open' THEN 'Pending'
             WHEN 'Pending Approval' THEN 'Pending' ELSE 'Accrued' END AS payment_status
      FROM ledger_lines ntl
      JOIN ledger_headers nt ON nt.id = ntl.transaction_no
      JOIN dim_date d ON d.calendar_date = CAST(nt.trandate AS DATE)
      JOIN ledger_accounts na ON na.id = ntl.account
      LEFT JOIN nation cc ON 'CC-' || lpad(CAST(cc.n_nationkey AS VARCHAR), 3, '0')
        = 'CC-' || lpad(CAST(ntl.department AS VARCHAR), 3, '0')
      LEFT JOIN supplier v ON v.s_suppkey = nt.entity
      WHERE na.acctnumber >= '5000' AND na.acctnumber < '8000' AND nt.voided = 'No'
      QUALIFY row_number() OVER (PARTITION BY nt.tranid, ntl.line_sequence
        ORDER BY ntl.loaded_at DESC, expense_amount DESC, na.id DESC,
          ntl.department DESC NULLS LAST, ntl.line_memo DESC NULLS LAST) = 1""",
    "crm_clients": """
      SELECT row_number() OVER (ORDER BY id) AS client_key, * EXCLUDE (id) FROM (
        SELECT 'ACC' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id,
          CASE WHEN c_custkey % 7 <> 0 THEN 'AN-' || c_custkey
            ELSE 'SF-' || left('ACC' || lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 15)
          END AS client_id,
          trim('  ' || c_name || ' ') AS client_name,
          CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Individual'
            WHEN 'MACHINERY' THEN 'Institutional' WHEN 'BUILDING' THEN 'Family Office'
            ELSE 'Other' END AS client_segment,
          CAST(TIMESTAMP '1995-01-01' + to_hours(c_custkey % 10000) AS DATE)
            AS relationship_start_date,
          'Manager ' || n_name AS relationship_manager,
          CASE c_nationkey % 4 WHEN 0 THEN 'New York' WHEN 1 THEN 'Boston'
            WHEN 2 THEN 'San Francisco' ELSE 'Chicago' END AS office_location,
          CASE WHEN aum > 50000000 THEN 'Platinum' WHEN aum > 10000000 THEN 'Gold'
            ELSE 'Silver' END AS aum_tier,
          c_acctbal >= 0 AS is_active
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(12,2)) * 10) AS aum
                   FROM orders GROUP BY 1) ON o_custkey = c_custkey
        WHERE c_mktsegment <> 'AUTOMOBILE')""",
    "visits": """
      SELECT event_id AS visit_key, CAST(strftime(ts, '%Y%m%d') AS INT) AS date_key,
        user_id AS user_key, k AS business_key, k % 4 AS loyalty_type_key,
        CASE event_type WHEN 'purchase' THEN 'redemption' WHEN 'signup' THEN 'referral'
          ELSE 'check-in' END AS visit_type,
        ts AS visit_timestamp, CAST(floor(value) AS BIGINT) AS points_earned,
        CASE WHEN k % 4 = 0 THEN CAST(value AS DECIMAL(12,2)) ELSE 0 END AS cashback_amount,
        CASE WHEN k % 4 = 1 OR k = 3 THEN 1 ELSE 0 END AS punch_count
      FROM ev""",
    "order_visits": """
      SELECT o_orderkey AS visit_key, o_custkey AS user_key,
        o_orderkey % 100 AS business_key, o_orderkey % 100 % 4 AS loyalty_type_key,
        o_orderdate AS visit_timestamp,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS points_earned,
        CAST(o_totalprice AS DECIMAL(12,2)) AS cashback_amount
      FROM orders""",
    "dim_users": """
      SELECT c_custkey AS user_key, 'U' || c_custkey AS user_id,
        split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
        CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status,
        DATE '2024-01-01' + CAST(c_nationkey % 5 AS INT) AS registration_date,
        n_name AS preferred_zone
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "dim_businesses": """
      SELECT k AS business_key, 'Business ' || k AS business_name,
        CASE k % 7 WHEN 0 THEN 'Restaurant' WHEN 1 THEN 'Cafe' WHEN 2 THEN 'Taqueria'
          WHEN 3 THEN 'Bakery' WHEN 4 THEN 'Bar' WHEN 5 THEN 'Food Truck'
          ELSE 'Ice Cream Shop' END AS category,
        CASE k % 4 WHEN 0 THEN 'Cashback' WHEN 1 THEN 'Punch Card' WHEN 2 THEN 'VIP Pass'
          ELSE 'None' END AS loyalty_type,
        'Zone ' || k % 9 AS neighborhood,
        CAST((30 + k % 21) / 10.0 AS DECIMAL(3,1)) AS google_rating,
        CAST(2090000 + k * 160 AS DOUBLE) / 100000 AS lat,
        CAST(-8970000 + k * 210 AS DOUBLE) / 100000 AS lng
      FROM (SELECT DISTINCT k FROM ev)""",
    "dim_loyalty_type": """
      SELECT * FROM (VALUES (0, 'Cashback'), (1, 'Punch Card'), (2, 'VIP Pass'),
        (3, 'None')) t(loyalty_type_key, loyalty_type_name)""",
    "dim_time": """
      SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, year(d) AS year,
        month(d) AS month, strftime(d, '%b') AS month_name, isodow(d) AS day_of_week,
        strftime(d, '%a') AS day_name, isodow(d) > 5 AS is_weekend
      FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (
        SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) AS hi
        FROM events))""",
    "flags": """
      SELECT u.user_key, u.user_id, first_name || ' ' || last_name AS full_name,
        u.status, u.registration_date, u.preferred_zone,
        CAST(min(visit_timestamp) AS DATE) AS first_visit,
        CAST(max(visit_timestamp) AS DATE) AS last_visit,
        count(visit_key) AS total_visits,
        count(DISTINCT business_key) AS distinct_businesses,
        CAST(sum(points_earned) AS BIGINT) AS total_points,
        sum(cashback_amount) AS total_cashback,
        date_diff('day', CAST(max(visit_timestamp) AS DATE), max(now))
          AS days_since_last_visit,
        CASE WHEN max(visit_timestamp) IS NULL THEN 'never_visited'
          WHEN days_since_last_visit > 30 THEN 'churned' ELSE 'active' END AS churn_status
      FROM dim_users u LEFT JOIN order_visits v ON u.user_key = v.user_key,
        (SELECT CAST(max(o_orderdate) AS DATE) AS now FROM orders)
      GROUP BY 1, 2, 3, 4, 5, 6""",
    "attribution": """
      SELECT event_id AS query_id, 'USER_' || user_id AS user_name,
        event_type AS warehouse_name, ts AS start_time,
        CAST(value AS DECIMAL(18,4)) AS compute,
        CASE WHEN k % 3 <> 0 THEN CAST(k / 1000.0 AS DECIMAL(18,4)) END AS qas,
        (SELECT max(ts) FROM events) AS as_of FROM ev""",
    "assistant": """
      SELECT 'USER_' || user_id AS username, ts AS start_time,
        CAST(value AS DECIMAL(12,2)) AS credits, k + 1 AS request_count,
        (SELECT max(ts) FROM events) AS as_of
      FROM ev WHERE event_type = 'purchase'""",
    "query_history": """
      SELECT 'USER_' || user_id AS user_name,
        CASE k % 10 WHEN 0 THEN 'CREATE_TABLE' WHEN 1 THEN 'CREATE_TABLE_AS_SELECT'
          WHEN 2 THEN 'CREATE_VIEW' WHEN 8 THEN 'SELECT' WHEN 9 THEN 'INSERT'
          ELSE 'CREATE' END AS query_type,
        CASE k % 10 WHEN 0 THEN 'create table t'
          WHEN 1 THEN 'create table t as select * from DIM_CLIENT'
          WHEN 2 THEN 'create view v' WHEN 3 THEN 'create streamlit app_one'
          WHEN 4 THEN 'create notebook n' WHEN 5 THEN 'create or replace stage s'
          WHEN 6 THEN 'create schema s' WHEN 7 THEN 'create function f'
          WHEN 8 THEN 'select client_name from dim_client'
          ELSE 'insert into t values (1)' END AS query_text,
        'h' || k AS query_hash,
        CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status,
        ts AS start_time, CAST(floor(value * 100) AS BIGINT) AS total_elapsed_time,
        k * 65536 AS bytes_scanned,
        CASE k % 6 WHEN 0 THEN 'SERVICE' WHEN 1 THEN 'OPS' WHEN 2 THEN 'ACCOUNTADMIN'
          WHEN 3 THEN 'COMPLIANCE' ELSE 'ANALYST' END AS role_name,
        k * 200 AS rows_produced,
        CASE WHEN k % 8 = 0 THEN 'app=ai_analyst;v=1' END AS query_tag,
        (SELECT max(ts) FROM events) AS as_of
      FROM ev""",
    "logins": """
      SELECT ts AS event_timestamp, 'USER_' || user_id AS user_name,
        CASE WHEN event_type = 'error' THEN 'NO' ELSE 'YES' END AS is_success,
        '10.0.0.' || k AS client_ip, (SELECT max(ts) FROM events) AS as_of FROM ev""",
    "app_users": """
      SELECT 'USER_' || c_custkey AS name, 'user' || c_custkey || '@example.com' AS email,
        CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END AS disabled,
        last_success_login,
        CASE WHEN c_mktsegment = 'FURNITURE' THEN DATE '2001-01-01' END AS deleted_on
      FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_success_login
        FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "grants": """
      SELECT 'USER_' || o_custkey AS grantee_name,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'ACCOUNTADMIN' WHEN '2-HIGH' THEN 'OPS'
          ELSE o_orderpriority END AS role, o_orderdate AS granted_on,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_on FROM orders""",
    "silver": """
      SELECT CAST(user_id AS VARCHAR) AS station_id, 'Station ' || user_id AS station_name,
        'N' || user_id AS station_number, user_id AS station_uid,
        40.0::DOUBLE + user_id / 100000.0::DOUBLE AS latitude,
        -3.0::DOUBLE - user_id / 100000.0::DOUBLE AS longitude,
        CAST(floor(value) AS BIGINT) % (k + 1) AS free_bikes,
        k - CAST(floor(value) AS BIGINT) % (k + 1) AS empty_slots, k AS total_slots,
        trim(rtrim('Calle ' || user_id || ' , ,,', ',')) AS address,
        event_type <> 'error' AS is_online, event_type AS availability_light,
        CASE k % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
          WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS api_timestamp,
        date_trunc('hour', ts) AS extraction_at
      FROM ev WHERE k % 10 <> 9 AND k % 10 <> 8 AND k > 0
      QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts)
        ORDER BY ts DESC, free_bikes DESC, k DESC, event_type DESC) = 1""",
    "network": """
      SELECT extraction_at, count(DISTINCT station_id) AS total_stations,
        count(*) FILTER (is_online) AS online_stations,
        CAST(sum(free_bikes) AS BIGINT) AS total_free_bikes,
        CAST(sum(empty_slots) AS BIGINT) AS total_empty_slots,
        CAST(sum(total_slots) AS BIGINT) AS total_slots,
        round(sum(free_bikes)::DOUBLE / nullif(sum(total_slots), 0)::DOUBLE * 100, 2)
          AS network_occupancy_pct
      FROM silver GROUP BY 1""",
    "hourly": """
      SELECT station_id, station_name, station_number, latitude, longitude, address,
        date_trunc('hour', extraction_at) AS hour_bucket,
        avg(free_bikes) AS avg_free_bikes, avg(empty_slots) AS avg_empty_slots,
        min(free_bikes) AS min_free_bikes, max(free_bikes) AS max_free_bikes,
        avg(total_slots) AS avg_total_slots,
        round(avg(free_bikes) / nullif(avg(total_slots), 0) * 100, 2) AS avg_occupancy_pct,
        count(*) AS snapshot_count
      FROM silver GROUP BY ALL""",
    "last_hour": """
      SELECT * FROM hourly WHERE hour_bucket = (SELECT max(hour_bucket) FROM hourly)""",
    "month_rev": """
      SELECT date_key // 100 AS year_month, min(date_key) AS k0, count(*) AS n,
        sum(revenue_amount) AS rev, sum(aum_amount) AS aum,
        CAST(strptime(CAST(min(date_key) AS VARCHAR), '%Y%m%d') AS DATE) AS month_date,
        strftime(strptime(CAST(min(date_key) AS VARCHAR), '%Y%m%d'), '%b %Y') AS month_label
      FROM fact_revenue GROUP BY 1""",
    "ship_day": "SELECT CAST(max(l_shipdate) AS DATE) AS as_of FROM lineitem",
    "access_map": """
      SELECT 'manager' || n_nationkey AS user_email, n_name AS office_location,
        CAST(NULL AS BIGINT) AS client_key FROM nation
      UNION ALL SELECT 'manager' || c_nationkey, NULL, c_custkey FROM customer
      WHERE c_acctbal > 9000""",
    "sensitive": """
      SELECT c_custkey AS client_key, c_name AS client_name,
        '123-45-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS ssn,
        CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey AS VARCHAR) END AS account_number,
        c_custkey || '@example.org' AS email,
        '(555) 010-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS phone
      FROM customer""",
}


def _kpi(fact: str, amount: str) -> str:
    return f"""
      WITH m AS (SELECT year_number, month_number, sum({amount}) AS amt,
          row_number() OVER (ORDER BY year_number DESC, month_number DESC) AS rn
        FROM {fact} JOIN dim_date USING (date_key) GROUP BY 1, 2),
      x AS (SELECT sum(amt) AS total, max(amt) FILTER (rn = 1) AS a,
          max(amt) FILTER (rn = 2) AS b FROM m)
      SELECT '$' || format('{{:,}}', CAST(round(total, 0) AS BIGINT)) AS value,
        (CASE WHEN a >= b THEN '+' ELSE '' END)
          || CAST(CAST(round((a - b)::DOUBLE / b::DOUBLE * 100, 1) AS DECIMAL(18,1)) AS VARCHAR)
          || '% MoM' AS diff FROM x"""


def _months(fact: str, extra: str) -> str:
    return f"""
      SELECT year_number, month_name, month_number, count(*) AS transaction_count, {extra}
      FROM {fact} JOIN dim_date USING (date_key), ship_day
      WHERE calendar_date >= date_trunc('month', as_of) - INTERVAL 6 MONTH
      GROUP BY 1, 2, 3"""


def _orphans(rows: list[tuple[str, str, str, str, str, bool]]) -> str:
    parts = []
    for label, fact, fk, dim, pk, nullable in rows:
        guard = f"f.{fk} IS NOT NULL AND" if nullable else ""
        parts.append(
            f"SELECT '{label}' AS fk_check, count(*) AS orphan_count FROM {fact} f "
            f"WHERE {guard} NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{pk} = f.{fk})"
        )
    return " UNION ALL ".join(parts)


def _churn_rate(by: str, join: str) -> str:
    return f"""
      SELECT {by}, count(*) AS total_users,
        count(*) FILTER (gone) AS churned_users,
        round(count(*) FILTER (gone) / count(*)::DOUBLE * 100, 1) AS churn_rate_pct
      FROM (SELECT user_key, {by}, date_diff('day', CAST(max(visit_timestamp) AS DATE),
          (SELECT CAST(max(visit_timestamp) AS DATE) FROM order_visits)) > 30 AS gone
        FROM order_visits v JOIN {join} GROUP BY 1, 2)
      GROUP BY 1"""


def _counts(tables: dict[str, str], label: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS {label}, count(*) AS row_count FROM {t}"
        for n, t in tables.items()
    )


_SINCE = "start_time >= CAST(as_of AS DATE) - {0} AND user_name = 'USER_8'"
_RATE = "{0}::DOUBLE / nullif({1}, 0)::DOUBLE"

_UNIT = {
    "s01_land_parquet":
        "SELECT o_orderkey, o_orderstatus, 'orders.parquet' AS filename FROM orders",
    "s02_land_csv": """
      SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_nationkey = 3 THEN NULL
        ELSE c_name || ', "the" client' END AS c_name, c_acctbal FROM customer""",
    "s03_land_json":
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'",
    "s04_ingest_new_files":
        "SELECT o_orderkey, o_custkey, 'orders.parquet' AS filename FROM orders",
    "s05_quarantine": """
      SELECT CASE WHEN o_orderstatus = 'P' THEN 'bad' ELSE 'good' END AS side,
        count(*) AS n_rows FROM orders GROUP BY 1""",
    "s06_full_replace": "SELECT * FROM nation",
    "s07_append_dedup": """
      SELECT o_orderkey, o_custkey, o_orderstatus, year(o_orderdate) AS order_year
      FROM orders""",
    "s08_upsert": """
      SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE 'X' END AS o_orderstatus,
        year(o_orderdate) AS order_year FROM orders""",
    "s10_flatten_snapshot": """
      SELECT user_id AS id, CAST(floor(value) AS BIGINT) AS free_bikes,
        k AS extra_slots, event_type AS extra_light, ts AS extraction_at FROM ev""",
    "j06_exists": """
      SELECT c_custkey, c_name FROM customer WHERE EXISTS (
        SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
    "j07_boundary": """
      SELECT o_orderkey, date_diff('day', o_orderdate, (SELECT max(o_orderdate)
        FROM orders)) AS age_days FROM orders""",
    "j11_asof_rates": f"""
      SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
        CAST(l.l_shipdate AS DATE) AS ship_date, r.rate_bps
      FROM lineitem l ASOF LEFT JOIN (
        SELECT l_partkey, CAST(l_shipdate AS DATE) AS effective_date,
          CAST(max({_DISC}) * 10000 AS BIGINT) AS rate_bps
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) r
      ON l.l_partkey = r.l_partkey AND CAST(l.l_shipdate AS DATE) >= r.effective_date""",
    "j11_asof_events": """
      SELECT e.event_id, e.user_id, s.signup_value FROM events e ASOF LEFT JOIN (
        SELECT user_id, ts, max(value) AS signup_value FROM events
        WHERE event_type = 'signup' GROUP BY 1, 2) s
      ON e.user_id = s.user_id AND e.ts >= s.ts""",
    "a06_duplicate_keys": """
      SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
      GROUP BY 1, 2 HAVING count(*) > 1""",
    "a09_list_distinct": """
      SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', '
        ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1""",
    "w01_latest_per_key": """
      SELECT user_id, event_id, event_type, ts FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "w07_previous_in_group": """
      SELECT user_id, day, total::DOUBLE AS total,
        lag(total) OVER (PARTITION BY user_id ORDER BY day)::DOUBLE AS previous_total
      FROM (SELECT user_id, CAST(ts AS DATE) AS day,
        sum(CAST(value AS DECIMAL(12,2))) AS total FROM events GROUP BY 1, 2)""",
    "a12_domain_check": """
      SELECT DISTINCT 'client_segment' AS check_name, c_mktsegment AS value FROM customer
      WHERE c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY', 'BUILDING')""",
    "f09_boundary_diffs": """
      SELECT event_id, date_diff('day', ts, m) AS days,
        date_diff('minute', ts, m) AS minutes, date_trunc('hour', ts) AS hour_start
      FROM events, (SELECT max(ts) AS m FROM events)""",
    "f04_user_suffix": """
      SELECT DISTINCT 'USER_' || user_id AS user_name,
        CAST(user_id AS VARCHAR) AS suffix FROM events""",
}

_BIKES = {
    "b01_silver_clean": "SELECT * FROM silver",
    "b02_network_summary": "SELECT * FROM network",
    "b03_station_hourly": "SELECT * FROM hourly",
    "b04_latest_snapshot": "SELECT * FROM network ORDER BY extraction_at DESC LIMIT 1",
    "b04_map_rows": """
      SELECT station_name, avg_occupancy_pct,
        greatest(avg_total_slots * 3, 30.0::DOUBLE) AS radius,
        CASE WHEN avg_occupancy_pct >= 60 THEN '34,139,34,180'
          WHEN avg_occupancy_pct >= 30 THEN '255,165,0,180' ELSE '220,20,60,180' END AS color
      FROM last_hour""",
    "b04_top_bottom": """
      (SELECT 'top' AS side, station_name, avg_occupancy_pct FROM last_hour
       ORDER BY avg_occupancy_pct DESC NULLS LAST, station_name LIMIT 10) UNION ALL
      (SELECT 'bottom', station_name, avg_occupancy_pct FROM last_hour
       ORDER BY avg_occupancy_pct NULLS LAST, station_name LIMIT 10)""",
    "b04_occupancy_series": "SELECT extraction_at, network_occupancy_pct FROM network",
    "d01_quality_metrics": """
      SELECT 'bronze null raw_data' AS metric_name, 0 AS metric_value
      UNION ALL SELECT 'bronze null filename', 0
      UNION ALL SELECT 'bronze duplicate rows', count(*) - count(DISTINCT
        (user_id, k, value::INT, ts)) FROM (SELECT user_id, k, floor(value) AS value,
        date_trunc('second', ts) AS ts, event_type FROM ev)
      UNION ALL SELECT 'silver null station_id', count(*) FILTER (station_id IS NULL) FROM silver
      UNION ALL SELECT 'silver null latitude', count(*) FILTER (latitude IS NULL) FROM silver
      UNION ALL SELECT 'silver null longitude', count(*) FILTER (longitude IS NULL) FROM silver
      UNION ALL SELECT 'silver repeated station_id', count(*) - count(DISTINCT station_id)
        FROM silver
      UNION ALL SELECT 'gold null total_stations',
        count(*) FILTER (total_stations IS NULL) FROM network
      UNION ALL SELECT 'gold null occupancy',
        count(*) FILTER (network_occupancy_pct IS NULL) FROM network""",
}

_PROFIT = """
      SELECT client_name, client_segment, aum_tier,
        round(sum(revenue_amount), 0)::DOUBLE AS total_revenue,
        round(sum(aum_amount)::DOUBLE / 1e6, 1) AS aum_millions,
        round(sum(fee_basis_points)::DOUBLE / count(fee_basis_points), 1) AS avg_bps
      FROM fact_revenue JOIN dim_client USING (client_key) {0} GROUP BY 1, 2, 3"""

_FINANCE = {
    "q01_kpi_revenue": _kpi("fact_revenue", "revenue_amount"),
    "q02_kpi_expenses": _kpi("fact_expense", "expense_amount"),
    "q03_pl_trend": """
      WITH r AS (SELECT year_number AS y, month_number AS m, sum(revenue_amount) AS amt
          FROM fact_revenue JOIN dim_date USING (date_key) GROUP BY 1, 2),
      x AS (SELECT year_number AS y, month_number AS m, sum(expense_amount) AS amt
          FROM fact_expense JOIN dim_date USING (date_key) GROUP BY 1, 2),
      c AS (SELECT r.y || '-' || lpad(CAST(r.m AS VARCHAR), 2, '0') || '-01' AS month,
          r.amt AS rev, coalesce(x.amt, 0) AS spent
        FROM r LEFT JOIN x ON r.y = x.y AND r.m = x.m)
      SELECT month, 'Revenue' AS metric, rev::DOUBLE AS amount FROM c
      UNION ALL SELECT month, 'Expenses', spent::DOUBLE FROM c
      UNION ALL SELECT month, 'Net Income', (rev - spent)::DOUBLE FROM c""",
    "q04_kpi_net_income": """
      SELECT '$' || format('{:,}', CAST(round(r - e, 0) AS BIGINT)) AS value,
        CAST(CAST(round((r - e)::DOUBLE / r::DOUBLE * 100, 1) AS DECIMAL(18,1)) AS VARCHAR)
          || '% margin' AS diff
      FROM (SELECT sum(revenue_amount) AS r FROM fact_revenue),
        (SELECT sum(expense_amount) AS e FROM fact_expense)""",
    "q05_kpi_clients": """
      SELECT CAST((SELECT count(*) FROM dim_client WHERE is_active) AS VARCHAR) AS value,
        '$' || CAST(CAST(round(sum(aum_amount)::DOUBLE / 1e9, 1) AS DECIMAL(18,1)) AS VARCHAR)
          || 'B AUM' AS diff FROM fact_revenue""",
    "q06_revenue_by_segment": """
      SELECT client_segment AS segment, round(sum(revenue_amount), 0)::DOUBLE AS revenue
      FROM fact_revenue JOIN dim_client USING (client_key) GROUP BY 1""",
    "q07_revenue_by_product": """
      SELECT p_type AS category, round(sum(revenue_amount), 0)::DOUBLE AS revenue,
        round(sum(fee_basis_points)::DOUBLE / count(fee_basis_points), 1) AS avg_bps
      FROM fact_revenue JOIN part ON product_key = p_partkey GROUP BY 1""",
    "q08_top_expenses": """
      SELECT n_name AS category, round(sum(expense_amount), 0)::DOUBLE AS amount
      FROM fact_expense JOIN supplier ON cost_center_key = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey
      GROUP BY 1 ORDER BY amount DESC, category LIMIT 10""",
    "q09_client_profitability": _PROFIT.format(""),
    "p12_filter_segment": _PROFIT.format("WHERE client_segment = 'BUILDING'"),
    "q09_client_profitability_text": f"""
      SELECT client_name, client_segment, aum_tier,
        '$' || format('{{:,}}', CAST(total_revenue AS BIGINT)) AS total_revenue,
        format('{{:,.1f}}', aum_millions) AS aum_millions, avg_bps
      FROM ({_PROFIT.format('')})""",
    "q10_monthly_overview": """
      SELECT month_date, month_label, n AS transaction_count, rev::DOUBLE AS total_revenue,
        round(rev::DOUBLE / n, 2) AS avg_revenue_per_txn,
        aum::DOUBLE AS total_aum_at_billing FROM month_rev""",
    "q10_grand_total":
        "SELECT sum(revenue_amount)::DOUBLE AS total_revenue_all_months FROM fact_revenue",
    "q10_peak_and_low": """
      (SELECT 'Peak' AS which, month_label, rev::DOUBLE AS total_revenue FROM month_rev
       ORDER BY rev DESC LIMIT 1) UNION ALL
      (SELECT 'Lowest', month_label, rev::DOUBLE FROM month_rev ORDER BY rev LIMIT 1)""",
    "q10_monthly_change": """
      SELECT year_month, month_label, rev::DOUBLE AS total_revenue,
        lag(rev) OVER w::DOUBLE AS prev_month_revenue,
        (rev - lag(rev) OVER w)::DOUBLE AS mom_change,
        round((rev - lag(rev) OVER w)::DOUBLE / lag(rev) OVER w::DOUBLE * 100, 2)
          AS mom_change_pct
      FROM month_rev WINDOW w AS (ORDER BY year_month)""".replace(
        "lag(rev) OVER w::DOUBLE", "CAST(lag(rev) OVER w AS DOUBLE)"),
}

_RECON = """
      SELECT 'raw (current month)' AS source, CAST(({0}) AS DOUBLE) AS total
      UNION ALL SELECT 'curated (current month)', CAST(({1}) AS DOUBLE)"""

_CHECKS = {
    "q11_row_counts": _counts(
        {"DIM_DATE": "dim_date", "DIM_CLIENT": "customer", "DIM_PRODUCT": "part",
         "DIM_COST_CENTER": "supplier", "DIM_GL_ACCOUNT": "dim_gl_account",
         "FACT_REVENUE": "fact_revenue", "FACT_EXPENSE": "fact_expense",
         "FACT_BUDGET": "fact_budget", "FACT_CLIENT_AUM": "fact_client_aum"},
        "table_name"),
    "q11_raw_vs_curated_counts": _counts(
        {"CRM accounts (raw)": "customer", "DIM_CLIENT (curated)": "crm_clients",
         "Ledger lines (raw)": "lineitem", "FACT_EXPENSE (curated)": "curated_expense"},
        "source"),
    "q12_daily_row_trend": """
      WITH c AS (SELECT calendar_date,
          (SELECT count(*) FROM fact_revenue r WHERE r.date_key = d.date_key) AS revenue_rows,
          (SELECT count(*) FROM fact_expense e WHERE e.date_key = d.date_key) AS expense_rows
        FROM dim_date d, ship_day WHERE calendar_date BETWEEN as_of - 7 AND as_of),
      a AS (SELECT *, avg(revenue_rows) OVER w AS revenue_7d_avg,
          avg(expense_rows) OVER w AS expense_7d_avg FROM c
        WINDOW w AS (ORDER BY calendar_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
      SELECT *, CASE WHEN abs(revenue_rows - revenue_7d_avg) / nullif(revenue_7d_avg, 0) > 0.2
          THEN 'ANOMALY' ELSE 'OK' END AS revenue_status,
        CASE WHEN abs(expense_rows - expense_7d_avg) / nullif(expense_7d_avg, 0) > 0.2
          THEN 'ANOMALY' ELSE 'OK' END AS expense_status FROM a""",
    "q13_revenue_reconciliation": _RECON.format(
        """SELECT round(sum(fee_amount), 2) FROM portfolio_transactions, ship_day
           WHERE transaction_type = 'FEE' AND transaction_date >= date_trunc('month', as_of)""",
        """SELECT sum(revenue_amount) FROM fact_revenue JOIN dim_date USING (date_key), ship_day
           WHERE calendar_date >= date_trunc('month', as_of)"""),
    "q13_expense_reconciliation": _RECON.format(
        """SELECT round(sum(coalesce(debitamount, 0) - coalesce(creditamount, 0)), 2)
           FROM ledger_lines l JOIN ledger_headers h ON h.id = l.transaction_no
           JOIN ledger_accounts a ON a.id = l.account
           WHERE acctnumber >= '5000' AND acctnumber < '8000' AND voided = 'No'
           AND trandate >= (SELECT date_trunc('month', max(o_orderdate)) FROM orders)""",
        """SELECT sum(expense_amount) FROM curated_expense JOIN dim_date USING (date_key)
           WHERE calendar_date >= (SELECT date_trunc('month', max(o_orderdate)) FROM orders)"""),
    "q14_revenue_by_month": _months("fact_revenue", """
        sum(revenue_amount)::DOUBLE AS total_revenue, sum(aum_amount)::DOUBLE AS total_aum,
        round(sum(fee_basis_points)::DOUBLE / count(*), 2) AS avg_fee_bps"""),
    "q14_expense_by_month": _months("fact_expense",
        "sum(expense_amount)::DOUBLE AS total_expenses"),
    "q15_profitability_band": """
      WITH r AS (SELECT year_number, quarter_name, sum(revenue_amount) AS rev
          FROM fact_revenue JOIN dim_date USING (date_key), ship_day
          WHERE calendar_date >= as_of - INTERVAL 12 MONTH GROUP BY 1, 2),
      e AS (SELECT year_number, quarter_name, sum(expense_amount) AS spent
          FROM fact_expense JOIN dim_date USING (date_key), ship_day
          WHERE calendar_date >= as_of - INTERVAL 12 MONTH GROUP BY 1, 2)
      SELECT year_number, quarter_name, rev::DOUBLE AS total_revenue,
        spent::DOUBLE AS total_expenses, (rev - spent)::DOUBLE AS net_income,
        round(spent::DOUBLE / rev::DOUBLE * 100, 1) AS expense_ratio_pct,
        CASE WHEN spent / rev < 0.55 THEN 'WARNING: Ratio below 55%'
          WHEN spent / rev > 0.75 THEN 'WARNING: Ratio above 75%' ELSE 'OK' END AS status
      FROM r LEFT JOIN e USING (year_number, quarter_name)""",
    "q16_calendar_continuity": """
      WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
      x AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d
        FROM d)
      SELECT d AS missing_date, strftime(d, '%a') AS day_name FROM x
      WHERE d NOT IN (SELECT d FROM d)""",
    "q17_days_without_revenue": """
      SELECT gl_account_key, calendar_date, day_name, 'NO REVENUE DATA' AS status
      FROM (SELECT DISTINCT gl_account_key FROM fact_revenue), dim_date, ship_day
      WHERE calendar_date BETWEEN as_of - 365 AND as_of AND is_business_day
        AND (gl_account_key, date_key) NOT IN
          (SELECT (gl_account_key, date_key) FROM fact_revenue)""",
    "q18_expense_gaps": """
      WITH p AS (SELECT DISTINCT gl_account_key, date_key, 1 AS has FROM fact_expense),
      s AS (SELECT gl_account_key, calendar_date, coalesce(has, 0) AS has
        FROM (SELECT * FROM (SELECT DISTINCT gl_account_key FROM fact_expense), ship_day,
          dim_date) LEFT JOIN p USING (gl_account_key, date_key)
        WHERE calendar_date BETWEEN as_of - 365 AND as_of AND is_business_day),
      g AS (SELECT *, sum(has) OVER (PARTITION BY gl_account_key ORDER BY calendar_date)
        AS grp FROM s)
      SELECT gl_account_key, min(calendar_date) AS gap_start, max(calendar_date) AS gap_end,
        count(*) AS consecutive_missing_days,
        CASE WHEN count(*) >= 3 THEN 'ALERT: 3+ consecutive days missing'
          ELSE 'INFO: minor gap' END AS status
      FROM g WHERE has = 0 GROUP BY gl_account_key, grp""",
    "q19_latest_dates": " UNION ALL ".join(
        f"""SELECT '{n.upper()}' AS table_name, max(calendar_date) AS latest_date,
          date_diff('day', max(calendar_date), (SELECT as_of FROM ship_day)) AS days_behind
          FROM {n} JOIN dim_date USING (date_key)"""
        for n in ("fact_revenue", "fact_expense", "fact_client_aum")),
    "q20_orphan_keys": _orphans([
        ("FACT_REVENUE -> DIM_DATE", "fact_revenue", "date_key", "dim_date", "date_key", False),
        ("FACT_REVENUE -> DIM_CLIENT", "fact_revenue", "client_key", "customer", "c_custkey", False),
        ("FACT_REVENUE -> DIM_PRODUCT", "fact_revenue", "product_key", "part", "p_partkey", False),
        ("FACT_REVENUE -> DIM_GL_ACCOUNT", "fact_revenue", "gl_account_key", "dim_gl_account", "gl_account_key", False),
        ("FACT_EXPENSE -> DIM_DATE", "fact_expense", "date_key", "dim_date", "date_key", False),
        ("FACT_EXPENSE -> DIM_COST_CENTER", "fact_expense", "cost_center_key", "supplier", "s_suppkey", False),
        ("FACT_EXPENSE -> DIM_GL_ACCOUNT", "fact_expense", "gl_account_key", "dim_gl_account", "gl_account_key", False),
        ("FACT_BUDGET -> DIM_DATE", "fact_budget", "date_key", "dim_date", "date_key", False),
        ("FACT_BUDGET -> DIM_GL_ACCOUNT", "fact_budget", "gl_account_key", "dim_gl_account", "gl_account_key", False),
        ("FACT_BUDGET -> DIM_COST_CENTER", "fact_budget", "cost_center_key", "supplier", "s_suppkey", True),
        ("FACT_BUDGET -> DIM_PRODUCT", "fact_budget", "product_key", "part", "p_partkey", True),
        ("FACT_CLIENT_AUM -> DIM_DATE", "fact_client_aum", "date_key", "dim_date", "date_key", False),
        ("FACT_CLIENT_AUM -> DIM_CLIENT", "fact_client_aum", "client_key", "customer", "c_custkey", False),
        ("FACT_CLIENT_AUM -> DIM_PRODUCT", "fact_client_aum", "product_key", "part", "p_partkey", False),
    ]),
    "q21_crossref_coverage": """
      WITH j AS (SELECT x.portfolio_id, x.crm_id FROM customer LEFT JOIN entity_crossref x
        ON x.curated_key = c_custkey AND x.entity_type = 'CLIENT')
      SELECT 'Unmapped Clients (no portfolio ID)' AS check_name,
        count(*) FILTER (portfolio_id IS NULL) AS unmapped_count FROM j
      UNION ALL SELECT 'Unmapped Clients (no CRM ID)', count(*) FILTER (crm_id IS NULL) FROM j
      UNION ALL SELECT 'Unverified Crossref Entries', count(*) FROM entity_crossref
        WHERE NOT verified""",
    "q22_raw_freshness": """
      WITH a AS (SELECT max(l_shipdate) AS now FROM lineitem),
      f AS (SELECT 'PORTFOLIO_TRANSACTIONS' AS raw_table, max(loaded_at) AS last_loaded,
          1500 AS lim, 'STALE (>25 hrs)' AS bad, 'OK (daily batch)' AS good
        FROM portfolio_transactions
        UNION ALL SELECT 'LEDGER_TRANSACTIONS', max(o_orderdate), 300, 'STALE (>5 hrs)',
          'OK (4-hr sync)' FROM orders
        UNION ALL SELECT 'CRM_ACCOUNTS',
          max(TIMESTAMP '1995-01-01' + to_hours(c_custkey % 10000)), 60, 'STALE (>1 hr)',
          'OK (CDC ~5 min)' FROM customer)
      SELECT raw_table, last_loaded, date_diff('minute', last_loaded, now) AS minutes_ago,
        CASE WHEN date_diff('minute', last_loaded, now) > lim THEN bad ELSE good END AS status
      FROM f, a""",
    "q23_refresh_status": """
      WITH r AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
      x AS (SELECT CAST(o_custkey AS VARCHAR) AS name,
          CASE WHEN o_orderpriority = '5-LOW' THEN 'SUSPENDED' ELSE 'ACTIVE' END
            AS scheduling_state,
          CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCEEDED' END AS last_state,
          o_orderdate AS last_end, date_diff('minute', o_orderdate,
            (SELECT max(o_orderdate) FROM orders)) AS minutes_since_refresh,
          '1 hour' AS target_lag FROM r)
      SELECT *, CASE WHEN scheduling_state <> 'ACTIVE' THEN 'ALERT: Not active'
        WHEN last_state = 'FAILED' THEN 'ALERT: Last refresh failed'
        WHEN minutes_since_refresh > 30 THEN 'WARNING: Behind target lag'
        ELSE 'OK' END AS status FROM x""",
    "q23_load_errors": """
      SELECT event_id AS file_id, ts AS last_load_time, 1 AS error_count FROM events
      WHERE event_type = 'error'
        AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""",
    "q23_sync_status": """
      WITH n AS (SELECT 'Feed ' || event_type || ' ' || user_id % 5 AS feed_name,
          ts AS last_successful_sync,
          CASE WHEN value > 100 THEN 'FAILED' ELSE 'SUCCESS' END AS sync_status
        FROM events WHERE event_type ILIKE '%purchase%' OR event_type ILIKE '%view%'
        QUALIFY row_number() OVER (PARTITION BY feed_name
          ORDER BY ts DESC, sync_status) = 1),
      m AS (SELECT *, date_diff('minute', last_successful_sync,
          (SELECT max(ts) FROM events)) AS minutes_since_sync FROM n)
      SELECT *, CASE WHEN sync_status <> 'SUCCESS' THEN 'ALERT: Sync failed'
        WHEN feed_name ILIKE '%PURCHASE%' AND minutes_since_sync > 300
          THEN 'STALE (>5 hrs, expect 4-hr cadence)'
        WHEN feed_name ILIKE '%view%' AND minutes_since_sync > 30
          THEN 'STALE (>30 min, expect near real-time)' ELSE 'OK' END AS status FROM m""",
    "q24_latency": " UNION ALL ".join(
        f"""SELECT '{name}' AS flow, round(sum(m)::DOUBLE / count(*), 1) AS avg_latency_min,
          max(m) AS max_latency_min FROM (
          SELECT date_diff('minute', g.loaded_at, f.created_at) AS m
          FROM {fact} f JOIN portfolio_transactions g
            ON {join} = f.transaction_id
          WHERE f.created_at >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY)"""
        for name, fact, join in (
            ("Revenue", "fact_revenue", "g.transaction_id"),
            ("Expenses", "fact_expense", "'NS-' || g.transaction_id"))),
    "q25_health": "SELECT check_name, fail_count, CASE WHEN fail_count = 0 THEN 'PASS' "
        "ELSE 'FAIL' END AS status, (SELECT max(l_shipdate) FROM lineitem) AS checked_at FROM ("
        "SELECT fk_check AS check_name, orphan_count AS fail_count FROM ("
        + _orphans([
            ("FK: Revenue -> Client", "fact_revenue", "client_key", "customer", "c_custkey", False),
            ("FK: Revenue -> Product", "fact_revenue", "product_key", "part", "p_partkey", False),
            ("FK: Revenue -> Date", "fact_revenue", "date_key", "dim_date", "date_key", False),
            ("FK: Expense -> Cost Center", "fact_expense", "cost_center_key", "supplier", "s_suppkey", False),
            ("FK: Expense -> GL Account", "fact_expense", "gl_account_key", "dim_gl_account", "gl_account_key", False),
        ])
        + """) UNION ALL SELECT 'NULL: Revenue Amount', count(*) FROM fact_revenue
            WHERE revenue_amount IS NULL
          UNION ALL SELECT 'NULL: Expense Amount', count(*) FROM fact_expense
            WHERE expense_amount IS NULL
          UNION ALL SELECT 'DUP: Revenue Transactions', count(*) FROM (
            SELECT transaction_id FROM fact_revenue GROUP BY 1 HAVING count(*) > 1)
          UNION ALL SELECT 'DUP: Expense Transactions', count(*) FROM (
            SELECT transaction_id FROM fact_expense GROUP BY 1 HAVING count(*) > 1)
          UNION ALL SELECT 'NEG: Revenue Amount', count(*) FROM fact_revenue
            WHERE revenue_amount < 0
          UNION ALL SELECT 'NEG: Expense Amount', count(*) FROM fact_expense
            WHERE expense_amount < 0)""",
    "q26_revenue_drift": """
      WITH d AS (SELECT calendar_date, sum(revenue_amount) AS rev
        FROM fact_revenue JOIN dim_date USING (date_key) GROUP BY 1)
      SELECT d.calendar_date, d.rev::DOUBLE AS revenue, p.rev::DOUBLE AS prior_day,
        m.rev::DOUBLE AS prior_month_day,
        CASE WHEN abs(d.rev - p.rev) / nullif(p.rev, 0) > 0.5
            OR abs(d.rev - m.rev) / nullif(m.rev, 0) > 0.5
          THEN 'ANOMALY' ELSE 'OK' END AS status
      FROM d LEFT JOIN d p ON d.calendar_date = p.calendar_date + 1
      LEFT JOIN d m ON m.calendar_date = CAST(d.calendar_date - INTERVAL 1 MONTH AS DATE)""",
    "q27_client_rules": """
      SELECT 'client: null name' AS check_name, count(*) FILTER (NOT is_active) AS fail_count
        FROM dim_client
      UNION ALL SELECT 'client: unknown segment', count(*) FILTER (client_segment NOT IN
        ('Individual', 'Institutional', 'Family Office', 'Other')) FROM dim_client
      UNION ALL SELECT 'client: unknown tier', count(*) FILTER (aum_tier NOT IN
        ('Platinum', 'Gold', 'Silver')) FROM dim_client
      UNION ALL SELECT 'client: duplicate id', count(*) FROM (
        SELECT client_id FROM dim_client GROUP BY 1 HAVING count(*) > 1)""",
    "q27_revenue_rules": """
      SELECT 'revenue: null amount' AS check_name,
        count(*) FILTER (revenue_amount IS NULL) AS fail_count FROM fact_revenue
      UNION ALL SELECT 'revenue: negative amount', count(*) FILTER (revenue_amount < 0)
        FROM fact_revenue
      UNION ALL SELECT 'revenue: fee rate out of range',
        count(*) FILTER (fee_basis_points < 0 OR fee_basis_points > 500) FROM fact_revenue
      UNION ALL SELECT 'revenue: differs from rate', count(*) FILTER (abs(revenue_amount
        - aum_amount * fee_basis_points / 10000 / 12) > 100) FROM fact_revenue
      UNION ALL SELECT 'revenue: duplicate transaction', count(*) FROM (
        SELECT transaction_id FROM fact_revenue GROUP BY 1 HAVING count(*) > 1)""",
    "q27_expense_rules": """
      SELECT 'expense: null amount' AS check_name,
        count(*) FILTER (expense_amount IS NULL) AS fail_count FROM fact_expense
      UNION ALL SELECT 'expense: negative amount', count(*) FILTER (expense_amount < 0)
        FROM fact_expense
      UNION ALL SELECT 'expense: unknown status', count(*) FILTER (payment_status NOT IN
        ('Paid', 'Pending', 'Accrued')) FROM fact_expense
      UNION ALL SELECT 'expense: account out of range', count(*) FROM fact_expense
        JOIN dim_gl_account USING (gl_account_key)
        WHERE (gl_account_id < '5000' OR gl_account_id >= '8000')""",
}

_CHECKS["q13_expense_tolerance"] = f"""
      SELECT max(total) - min(total) AS difference,
        CASE WHEN max(total) - min(total) <= 10 THEN 'PASS' ELSE 'FAIL' END AS status
      FROM ({_CHECKS["q13_expense_reconciliation"]})"""

_CHECKS["q27_expense_lines"] = """
      WITH l AS (SELECT l_orderkey AS d, l_linenumber AS line, count(*) AS n
        FROM lineitem GROUP BY 1, 2),
      d AS (SELECT d, sum(n) AS n, max(line) AS highest, count(*) FILTER (n > 1) AS twice
        FROM l GROUP BY 1)
      SELECT 'expense: repeated line' AS check_name, sum(twice)::BIGINT AS fail_count FROM d
      UNION ALL SELECT 'expense: too many lines', count(*) FILTER (n > highest) FROM d"""

#: Accounts of three systems up to their entities; see ``plans/entities.py``.
_ENTITIES = """
      WITH RECURSIVE k AS (
        SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS t, 'B' || c_custkey AS b,
          'firm ' || left(md5(CAST(c_custkey AS VARCHAR)), 10) AS nm,
          'city ' || c_nationkey AS city FROM customer),
      acc AS MATERIALIZED (
        SELECT system || ':' || account AS id, * FROM (
          SELECT 'crm' AS system, 'ACC' || t AS account, CASE WHEN k % 7 <> 0 THEN b END AS biz,
            nm AS name, city FROM k WHERE k % 11 <> 0
          UNION ALL SELECT 'portfolio', 'A' || t, CASE WHEN k % 3 <> 0 THEN b END,
            CASE k % 5 WHEN 0 THEN nm WHEN 1 THEN left(nm, 14) ELSE 'unit ' || t END, city
            FROM k WHERE k % 13 <> 0
          UNION ALL SELECT 'ledger', 'L' || t,
            CASE WHEN k % 40 = 1 THEN 'NONE' WHEN k % 2 = 0 THEN b END,
            CASE WHEN k % 5 = 2 THEN nm || 'x' ELSE nm END, city FROM k WHERE k % 4 <> 0
          UNION ALL SELECT 'ledger', 'LX' || t, b, 'old ' || nm, city FROM k WHERE k % 17 = 0)),
      hub AS (SELECT biz, min(id) AS dst FROM acc WHERE biz IS NOT NULL
        GROUP BY biz HAVING count(DISTINCT system) > 1),
      by_id AS MATERIALIZED (SELECT id AS src, dst FROM acc JOIN hub USING (biz)),
      judged AS (
        SELECT 'portfolio:A' || t AS src,
          CASE WHEN k % 19 = 0 THEN 'crm:ACC' ELSE 'ledger:L' END || t AS dst, k % 19 = 0 AS accepted
        FROM k WHERE k % 19 = 0 OR k % 23 = 0),
      reviewed AS MATERIALIZED (
        SELECT * FROM (SELECT * FROM judged UNION ALL SELECT dst, src, accepted FROM judged)
        WHERE src IN (SELECT id FROM acc) AND dst IN (SELECT id FROM acc)),
      by_name AS MATERIALIZED (
        SELECT src, dst, similarity FROM (
          SELECT a.id AS src, o.id AS dst, round(1 - levenshtein(a.name, o.name)
            / greatest(length(a.name), length(o.name))::DOUBLE, 4) AS similarity
          FROM acc a JOIN acc o ON a.city = o.city AND a.system <> o.system
            AND a.id NOT IN (SELECT src FROM by_id) AND levenshtein(a.name, o.name) <= 1
          QUALIFY row_number() OVER (PARTITION BY a.id
            ORDER BY levenshtein(a.name, o.name), o.id) = 1)
        WHERE (src, dst) NOT IN (SELECT src, dst FROM reviewed)),
      links AS MATERIALIZED (
        SELECT src, dst, 1 AS rank FROM reviewed WHERE accepted
        UNION SELECT src, dst, 2 FROM by_id UNION SELECT src, dst, 3 FROM by_name),
      both_ways AS MATERIALIZED (
        SELECT src, dst, rank FROM links UNION SELECT dst, src, rank FROM links),
      reach(a, b) AS (
        SELECT id, id FROM acc UNION SELECT r.a, e.dst FROM reach r JOIN both_ways e ON r.b = e.src),
      comp AS MATERIALIZED (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
      ranked AS (SELECT src AS id, min(rank) AS rank, max(rank) AS weakest FROM both_ways GROUP BY 1),
      m AS MATERIALIZED (
        SELECT acc.id, system, account, component, coalesce(rank, 4) AS rank, weakest, n.similarity
        FROM acc JOIN comp USING (id) LEFT JOIN ranked USING (id) LEFT JOIN by_name n ON n.src = acc.id),
      e AS (
        SELECT component, max(n) > 1 AS conflict,
          coalesce(min(rank) = 1 AND max(weakest) < 3, FALSE) AS verified
        FROM (SELECT component, system, count(*) AS n, min(rank) AS rank, max(weakest) AS weakest
              FROM m GROUP BY ALL) GROUP BY component),
      known AS (SELECT 'crm:ACC' || t AS id, k AS curated_key FROM k WHERE k % 3 = 0 AND k % 11 <> 0),
      had AS (SELECT component, min(curated_key) AS curated_key FROM m JOIN known USING (id) GROUP BY component),
      fresh AS (
        SELECT component, (SELECT max(curated_key) FROM known) + row_number() OVER (ORDER BY component) AS curated_key
        FROM (SELECT DISTINCT component FROM m WHERE component NOT IN (SELECT component FROM had))),
      keys AS (SELECT * FROM had UNION ALL SELECT * FROM fresh),
      members AS MATERIALIZED (
        SELECT system, account, curated_key, rank, similarity, verified, conflict,
          ['MANUAL', 'ID_MATCH', 'NAME_MATCH', 'UNMATCHED'][rank] AS match_method
        FROM m JOIN e USING (component) JOIN keys USING (component)),
      wide AS (
        SELECT 'CLIENT' AS entity_type, max(account) FILTER (system = 'portfolio') AS portfolio_id,
          max(account) FILTER (system = 'ledger') AS ledger_id, max(account) FILTER (system = 'crm') AS crm_id,
          curated_key, ['MANUAL', 'ID_MATCH', 'NAME_MATCH', 'UNMATCHED'][min(rank)] AS match_method,
          any_value(verified) AS verified, any_value(conflict) AS conflict
        FROM (SELECT *, row_number() OVER (PARTITION BY curated_key, system ORDER BY account) AS nth FROM members)
        GROUP BY curated_key, nth)"""

#: Two landings of users and businesses, and the keys they get; see ``plans/loyalty_load.py``.
_LOADS = """
      WITH u AS (
        SELECT c_custkey AS c, 'U' || c_custkey AS user_id, split_part(c_name, '#', 1) AS first_name,
          split_part(c_name, '#', -1) AS last_name, 'user' || c_custkey || '@mail.test' AS email,
          '+52 999 ' || c_custkey AS phone, DATE '2024-01-01' + CAST(c_nationkey % 5 AS INT) AS registration_date,
          CASE WHEN c_custkey % 2 = 0 THEN 'inactive' ELSE 'active' END AS status,
          'Zone ' || c_nationkey AS preferred_zone
        FROM customer WHERE c_custkey % 97 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 2 = 0)),
      loaded_users AS (
        SELECT row_number() OVER (ORDER BY c % 3 = 0, user_id) AS user_key, * EXCLUDE (c) FROM u),
      b AS (
        SELECT CAST(business_key AS INT) AS k, CAST(business_key AS VARCHAR) AS business_id, * FROM dim_businesses
        WHERE business_key % 2 = 0 OR business_key >= 50),
      loaded_shops AS (
        SELECT row_number() OVER (ORDER BY k % 2 <> 0, business_id) AS business_key, business_id, business_name,
          category, category || ' ' || k % 3 AS subcategory, loyalty_type,
          CASE WHEN loyalty_type = 'Cashback' THEN (k % 10 + 0.5)::DOUBLE END AS cashback_pct,
          CAST(CASE WHEN loyalty_type = 'Punch Card' THEN k % 6 + CASE WHEN k >= 50 THEN 15 ELSE 5 END END AS INT) AS punch_goal,
          lat, lng AS long, google_rating::DOUBLE AS google_rating, 'P' || left(md5(business_id), 8) AS google_place_id,
          'Calle ' || business_id AS address, neighborhood
        FROM b)"""

_LOADED_VISITS = f"""{_LOADS}
      SELECT visit_id, date_key, user_key, business_key, loyalty_type_key, visit_type, visit_timestamp, points_earned,
        cashback_amount, punch_count, reason
      FROM (
        SELECT CAST(event_id AS VARCHAR) AS visit_id, CASE WHEN reason IS NULL THEN CAST(strftime(ts, '%Y%m%d') AS INT) END AS date_key,
          CASE WHEN reason IS NULL THEN user_key END AS user_key, CASE WHEN reason IS NULL THEN business_key END AS business_key,
          CASE WHEN reason IS NULL THEN CAST(k % 4 AS INT) END AS loyalty_type_key, event_type AS visit_type,
          CASE WHEN reason IS NULL THEN date_trunc('second', ts) END AS visit_timestamp,
          CASE WHEN reason IS NULL THEN CAST(floor(value) AS BIGINT) END AS points_earned,
          CASE WHEN reason IS NULL THEN CAST(value AS DECIMAL(12,2))::DOUBLE END AS cashback_amount,
          CASE WHEN reason IS NULL AND k <> 7 THEN 1 END AS punch_count, reason
        FROM (
          SELECT ev.*, uu.user_key, s.business_key, CASE WHEN uu.user_key IS NULL THEN 'unknown user'
            WHEN s.business_key IS NULL THEN 'unknown business' END AS reason
          FROM ev LEFT JOIN loaded_users uu ON uu.user_id = 'U' || ev.user_id
          LEFT JOIN loaded_shops s ON s.business_id = CAST(ev.k AS VARCHAR)))"""

_CURATION = {
    "t09_dim_users": f"{_LOADS} SELECT * FROM loaded_users",
    "t09_dim_businesses": f"{_LOADS} SELECT * FROM loaded_shops",
    "t09_loaded_visits": _LOADED_VISITS,
    "v08_load_checks": f"""
      WITH v AS ({_LOADED_VISITS}),
      c AS (SELECT
        (SELECT count(*) FROM customer WHERE c_custkey % 97 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 2 = 0)) AS users,
        (SELECT count(*) FROM customer WHERE c_custkey % 97 = 0 AND (c_custkey % 3 <> 0 OR c_custkey % 2 = 0)) AS nameless,
        (SELECT count(DISTINCT k) FROM ev WHERE k % 2 = 0 OR k >= 50) AS shops,
        (SELECT count(*) FROM ev) AS visits, (SELECT count(*) FROM v WHERE reason IS NULL) AS loaded),
      r AS (
        SELECT 'users' AS name, users + least(nameless, 1) AS raw_rows, users AS loaded_rows, least(nameless, 1) AS no_id, 0 AS lost FROM c
        UNION ALL SELECT 'businesses', shops, shops, 0, 0 FROM c
        UNION ALL SELECT 'visits', visits, loaded, 0, visits - loaded FROM c)
      SELECT name || ': ' || x.kind AS check_name, raw_rows, loaded_rows,
        CASE x.kind WHEN 'without an id' THEN no_id WHEN 'not loaded' THEN lost ELSE 0 END AS fail_count
      FROM r, (VALUES ('without an id'), ('not loaded'), ('not in raw'), ('loaded twice')) x(kind)""",
    "t02_staged_revenue": f"""{_ENTITIES},
      x AS (SELECT portfolio_id, min(curated_key) AS client_key FROM wide
        WHERE portfolio_id IS NOT NULL GROUP BY 1),
      f AS (
        SELECT gt.*, CAST(string_split(transaction_id, '-')[2] AS INT) % 3 AS b, client_key,
          CAST(substr(strategy_id, 2) AS BIGINT) AS product_key, date_key, market_value,
          CASE fee_type WHEN 'Management' THEN 4010 WHEN 'Performance' THEN 4020
            WHEN 'Advisory' THEN 4030 WHEN 'Transaction' THEN 4040 END AS gl_account_key,
          CASE WHEN fee_type IS NULL THEN 'no rate in force' WHEN client_key IS NULL THEN 'unknown client' END AS reason
        FROM rated_fees gt LEFT JOIN x ON x.portfolio_id = gt.account_id
        LEFT JOIN dim_date d ON d.calendar_date = gt.transaction_date
        LEFT JOIN nav ON nav.account_id = gt.account_id AND nav.valuation_date = gt.transaction_date),
      l AS (SELECT *, CAST(CASE WHEN b > 0 OR client_key % 2 = 0 THEN b ELSE 1 END AS INT) AS loaded_in FROM f)
      SELECT transaction_id, CAST(date_key AS INT) AS date_key, client_key, product_key,
        CAST(gl_account_key AS BIGINT) AS gl_account_key, CAST(market_value AS DECIMAL(18,2))::DOUBLE AS aum_amount,
        CAST(fee_amount AS DECIMAL(18,2))::DOUBLE AS revenue_amount, fee_rate_bps::DOUBLE AS fee_basis_points,
        loaded_in, TIMESTAMP '2024-01-01 06:00:00' + to_days(loaded_in) AS created_at,
        CAST(NULL AS INT) AS staged_in, NULL AS reason
      FROM l WHERE reason IS NULL
      QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY loaded_at DESC,
        CAST(fee_amount AS DECIMAL(18,2)) DESC, date_key DESC, product_key DESC, fee_rate_bps DESC,
        gl_account_key DESC, market_value DESC NULLS LAST, client_key DESC) = 1
      UNION ALL
      SELECT transaction_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(b AS INT), reason
      FROM l WHERE reason IS NOT NULL""",
    "t04_staged_budgets": """
      WITH b AS (
        SELECT o_custkey % 25 AS account, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey % 25 END AS center,
          CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 25 END AS product,
          CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS amount,
          CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS batch FROM orders),
      l AS (
        SELECT b.*, date_key, acctnumber, year(day) AS y, CASE batch WHEN 0 THEN 'Original' ELSE 'Revised' END AS version,
          CASE WHEN acctnumber IS NULL THEN 'closed account' WHEN date_key IS NULL THEN 'unknown date'
            WHEN product = 24 THEN 'unknown product' END AS reason
        FROM b LEFT JOIN ledger_accounts a ON a.id = account AND a.is_active
        LEFT JOIN dim_date d ON d.calendar_date = day)
      SELECT CAST(date_key AS INT) AS date_key, center AS cost_center_key, account AS gl_account_key,
        product AS product_key, CASE WHEN acctnumber < '5000' THEN 'Revenue' WHEN acctnumber < '8000' THEN 'Expense' END AS budget_type,
        amount AS budget_amount, version AS budget_version, CAST(y AS INT) AS fiscal_year,
        CAST(loaded AS INT) AS loaded_in, TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(loaded AS INT)) AS created_at,
        CAST(NULL AS INT) AS staged_in, NULL AS reason
      FROM (SELECT *, CASE WHEN batch = 0 AND coalesce(product, 0) < 12 THEN 0 ELSE 1 END AS loaded FROM l)
      WHERE reason IS NULL
      UNION ALL
      SELECT NULL, NULL, account, NULL, NULL, amount, version, NULL, NULL, NULL, CAST(batch AS INT), reason
      FROM l WHERE reason IS NOT NULL""",
    "t04_product_details": """
      WITH newest AS (
        SELECT strategy_id, fee_type, CAST(substr(strategy_id, 2) AS BIGINT) AS k FROM fee_schedules
        QUALIFY row_number() OVER (PARTITION BY strategy_id
          ORDER BY effective_date DESC, fee_type DESC, account_id DESC) = 1)
      SELECT CASE WHEN k <> 5 THEN k END AS product_key, strategy_id AS product_id,
        CASE WHEN k % 7 <> 3 THEN 'Fund ' || n_name ELSE strategy_id END AS product_name,
        fee_type || ' Fee' AS product_category, fee_type,
        CASE WHEN k % 7 <> 3 THEN r_name END AS asset_class,
        CASE WHEN k % 7 <> 3 AND k % 3 = 1 THEN make_date(1994 + k, 6, 30)
          > (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) ELSE TRUE END AS is_active,
        TIMESTAMP '2024-01-01 06:00:00' AS created_at
      FROM newest JOIN nation ON n_nationkey = k JOIN region ON n_regionkey = r_regionkey""",
    "t08_entity_members": f"{_ENTITIES} SELECT * EXCLUDE (rank) FROM members",
    "t08_entity_crossref": f"{_ENTITIES} SELECT * FROM wide",
    "t08_coverage": f"""{_ENTITIES},
      listed AS (
        SELECT s.system, count(*) AS n_mapped, count(*) FILTER (match_method <> 'UNMATCHED') AS n_shared
        FROM wide JOIN (VALUES ('portfolio'), ('ledger'), ('crm')) s(system) ON
          CASE s.system WHEN 'portfolio' THEN portfolio_id WHEN 'ledger' THEN ledger_id ELSE crm_id END IS NOT NULL
        GROUP BY s.system)
      SELECT system, n_accounts, coalesce(n_mapped, 0) AS n_mapped, coalesce(n_shared, 0) AS n_shared
      FROM (SELECT system, count(*) AS n_accounts FROM acc GROUP BY system) LEFT JOIN listed USING (system)""",
    "t01_dim_client": "SELECT * FROM crm_clients",
    "t02_fact_revenue": """
      SELECT d.date_key, xc.curated_key AS client_key, xp.curated_key AS product_key,
        gl.gl_account_key, gt.transaction_id,
        CAST(nav.market_value AS DECIMAL(18,2))::DOUBLE AS aum_amount,
        CAST(gt.fee_amount AS DECIMAL(18,2))::DOUBLE AS revenue_amount,
        gt.fee_rate_bps::DOUBLE AS fee_basis_points, 1 AS transaction_count
      FROM rated_fees gt
      JOIN dim_date d ON d.calendar_date = gt.transaction_date
      JOIN entity_crossref xc ON xc.portfolio_id = gt.account_id AND xc.entity_type = 'CLIENT'
      JOIN entity_crossref xp ON xp.portfolio_id = gt.strategy_id
        AND xp.entity_type = 'PRODUCT'
      LEFT JOIN nav ON nav.account_id = gt.account_id
        AND nav.valuation_date = gt.transaction_date
      JOIN dim_gl_account gl ON gl.gl_account_id = CASE gt.fee_type
        WHEN 'Management' THEN '4010' WHEN 'Performance' THEN '4020'
        WHEN 'Advisory' THEN '4030' WHEN 'Transaction' THEN '4040' END
      QUALIFY row_number() OVER (PARTITION BY gt.transaction_id ORDER BY gt.loaded_at DESC,
        CAST(gt.fee_amount AS DECIMAL(18,2)) DESC, d.date_key DESC, xp.curated_key DESC,
        gt.fee_rate_bps DESC, gl.gl_account_key DESC, nav.market_value DESC NULLS LAST) = 1""",
    "t02_unmapped_fees": """
      SELECT transaction_id, account_id, strategy_id,
        CAST(fee_amount AS DECIMAL(18,2))::DOUBLE AS fee_amount, reason FROM (
        SELECT *, CASE WHEN fee_type IS NULL THEN 'no rate in force'
          WHEN account_id NOT IN (SELECT portfolio_id FROM entity_crossref
            WHERE entity_type = 'CLIENT' AND portfolio_id IS NOT NULL) THEN 'unknown client'
          WHEN strategy_id NOT IN (SELECT portfolio_id FROM entity_crossref
            WHERE entity_type = 'PRODUCT') THEN 'unknown product'
          WHEN transaction_date NOT IN (SELECT calendar_date FROM dim_date)
            THEN 'unknown date' END AS reason FROM rated_fees)
      WHERE reason IS NOT NULL""",
    "t02_unrated_fees":
        "SELECT count(*) AS fees, count(*) FILTER (fee_type IS NULL) AS unrated FROM rated_fees",
    "t03_fact_expense":
        "SELECT * REPLACE (expense_amount::DOUBLE AS expense_amount) FROM curated_expense",
    "t04_dim_product": """
      SELECT CAST(substr(strategy_id, 2) AS BIGINT) AS product_key,
        strategy_id AS product_id, fee_type || ' Fee' AS product_category,
        CASE fee_type WHEN 'Management' THEN '4010' WHEN 'Performance' THEN '4020'
          WHEN 'Advisory' THEN '4030' ELSE '4040' END AS gl_account_id,
        effective_date AS last_effective_date
      FROM fee_schedules QUALIFY row_number() OVER (PARTITION BY strategy_id
        ORDER BY effective_date DESC, fee_type DESC, account_id DESC) = 1""",
    "t04_dim_cost_center": """
      SELECT CAST(n_nationkey AS BIGINT) AS cost_center_key,
        'CC-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS cost_center_id,
        n_name AS cost_center_name, r_name AS expense_category,
        'Office ' || r_name AS office_location
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "t04_dim_gl_account": """
      SELECT id AS gl_account_key, acctnumber AS gl_account_id, acctname AS gl_account_name,
        CASE WHEN acctnumber < '5000' THEN 'Revenue' WHEN acctnumber < '8000' THEN 'Expense'
          END AS account_type,
        CASE WHEN acctnumber < '5000' THEN 'Credit' WHEN acctnumber < '8000' THEN 'Debit'
          END AS normal_balance FROM ledger_accounts WHERE is_active""",
    "t04_fact_budget": """
      SELECT d.date_key,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey % 25 END
          AS cost_center_key, o_custkey % 25 AS gl_account_key,
        CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 25 END AS product_key,
        CASE WHEN acctnumber < '5000' THEN 'Revenue' WHEN acctnumber < '8000' THEN 'Expense'
          END AS budget_type,
        CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS budget_amount,
        CASE WHEN o_orderstatus = 'F' THEN 'Original' ELSE 'Revised' END AS budget_version,
        d.fiscal_year
      FROM orders JOIN ledger_accounts a ON a.id = o_custkey % 25 AND a.is_active
      JOIN dim_date d ON d.calendar_date = CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "t05_fact_client_aum": """
      WITH v AS (SELECT o_custkey AS client_key,
          CAST(left(o_orderpriority, 1) AS BIGINT) AS product_key,
          CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS aum,
          sum(CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(12,2))
            WHEN 'O' THEN -CAST(o_totalprice AS DECIMAL(12,2)) ELSE 0 END) AS flow
        FROM orders GROUP BY 1, 2, 3),
      c AS (SELECT *, aum - lag(aum) OVER (PARTITION BY client_key, product_key
        ORDER BY day) AS change FROM v)
      SELECT date_key, client_key, product_key, aum::DOUBLE AS aum_amount,
        change::DOUBLE AS aum_change, flow::DOUBLE AS net_flows,
        (change - flow)::DOUBLE AS market_change
      FROM c JOIN dim_date ON calendar_date = day""",
    "t06_fee_check": """
      SELECT transaction_id, revenue_amount::DOUBLE AS revenue_amount,
        CAST((CAST(CAST(aum_amount * fee_basis_points AS DECIMAL(38,6)) * 1000000 AS HUGEINT)
          + 600000000)
          // 1200000000 AS DOUBLE) / 100 AS expected_fee FROM fact_revenue""",
    "t07_calendar": "SELECT * FROM dim_date",
    "t07_calendar_iso_running": """
      SELECT * REPLACE (date_diff('day', (SELECT min(calendar_date) FROM dim_date),
        calendar_date) + 1 AS date_key, isodow(calendar_date) AS day_of_week) FROM dim_date""",
    "t08_crossref": """
      WITH p AS (SELECT c_custkey AS id, c_nationkey AS city,
          trim(regexp_replace(lower(CASE c_mktsegment WHEN 'BUILDING' THEN c_name || 'x'
            WHEN 'FURNITURE' THEN c_name ELSE 'Another ' || c_name END),
            '[^a-z0-9]+', ' ', 'g')) AS name,
          CASE WHEN c_acctbal > 0 THEN c_custkey END AS biz FROM customer),
      c AS (SELECT c_custkey AS id, c_nationkey AS city,
          trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name,
          CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS biz FROM customer),
      t AS (SELECT p.*, c.id AS by_id FROM p LEFT JOIN c ON p.biz = c.biz),
      n AS (SELECT t.id, c.id AS by_name, round(1 - levenshtein(t.name, c.name)
            / greatest(length(t.name), length(c.name))::DOUBLE, 4) AS similarity
        FROM t JOIN c ON t.city = c.city AND t.by_id IS NULL
          AND abs(length(t.name) - length(c.name)) <= 1
          AND levenshtein(t.name, c.name) <= 1
        QUALIFY row_number() OVER (PARTITION BY t.id
          ORDER BY levenshtein(t.name, c.name), c.id) = 1)
      SELECT 'CLIENT' AS entity_type, t.id AS portfolio_id,
        coalesce(t.by_id, n.by_name) AS crm_id,
        CASE WHEN t.by_id IS NOT NULL THEN 'ID_MATCH' WHEN n.by_name IS NOT NULL
          THEN 'NAME_MATCH' ELSE 'UNMATCHED' END AS match_method,
        n.similarity, FALSE AS verified
      FROM t LEFT JOIN n ON n.id = t.id""",
    "t09_stg_visits": """
      SELECT CAST(event_id AS VARCHAR) AS visit_id, 'U' || user_id AS user_id,
        CAST(k AS VARCHAR) AS business_id, date_trunc('second', ts) AS visit_timestamp,
        event_type AS visit_type, CAST(floor(value) AS BIGINT) AS points_earned,
        CAST(value AS DECIMAL(12,2))::DOUBLE AS cashback_amount,
        CASE WHEN k <> 7 THEN 1 END AS punch_count FROM ev""",
    "t09_fact_visits": """
      SELECT CAST(event_id AS VARCHAR) AS visit_id,
        CAST(strftime(ts, '%Y%m%d') AS INT) AS date_key, user_id AS user_key,
        k AS business_key, k % 4 AS loyalty_type_key, event_type AS visit_type,
        date_trunc('second', ts) AS visit_timestamp,
        CAST(floor(value) AS BIGINT) AS points_earned,
        CAST(value AS DECIMAL(12,2))::DOUBLE AS cashback_amount,
        CASE WHEN k <> 7 THEN 1 END AS punch_count
      FROM ev JOIN customer ON user_id = c_custkey""",
}

_LOYALTY = {
    "c01_churn_flags":
        "SELECT * REPLACE (total_cashback::DOUBLE AS total_cashback) FROM flags",
    "c01_churn_flags_events": """
      SELECT u.user_key, u.user_id, first_name || ' ' || last_name AS full_name,
        u.status, u.registration_date, u.preferred_zone,
        CAST(min(visit_timestamp) AS DATE) AS first_visit,
        CAST(max(visit_timestamp) AS DATE) AS last_visit,
        count(visit_key) AS total_visits,
        count(DISTINCT business_key) AS distinct_businesses,
        CAST(sum(points_earned) AS BIGINT) AS total_points,
        sum(cashback_amount)::DOUBLE AS total_cashback,
        date_diff('day', CAST(max(visit_timestamp) AS DATE), max(now))
          AS days_since_last_visit,
        CASE WHEN max(visit_timestamp) IS NULL THEN 'never_visited'
          WHEN days_since_last_visit > 1 THEN 'churned' ELSE 'active' END AS churn_status
      FROM dim_users u LEFT JOIN visits v ON u.user_key = v.user_key,
        (SELECT CAST(max(ts) AS DATE) AS now FROM events) GROUP BY 1, 2, 3, 4, 5, 6""",
    "c02_churn_summary": """
      SELECT churn_status, count(*) AS user_count,
        round(sum(total_visits)::DOUBLE / count(*), 4) AS avg_total_visits,
        round(sum(total_points)::DOUBLE / count(total_points), 4) AS avg_points,
        round(sum(total_cashback)::DOUBLE / count(total_cashback), 4) AS avg_cashback,
        round(count(*)::DOUBLE / (SELECT count(*) FROM flags) * 100, 1) AS pct_of_total
      FROM flags GROUP BY 1""",
    "c02_churn_by_loyalty_type": _churn_rate(
        "loyalty_type_name", "dim_loyalty_type USING (loyalty_type_key)"),
    "c03_churn_by_category": _churn_rate("category", "dim_businesses USING (business_key)"),
    "c04_monthly_churn": """
      WITH m AS (SELECT CAST(date_trunc('month', visit_timestamp) AS DATE) AS month,
        count(DISTINCT user_key) AS n FROM order_visits GROUP BY 1)
      SELECT c.month, p.n AS prev_active, c.n AS curr_active,
        greatest(p.n - c.n, 0) AS lost_users,
        round(greatest(p.n - c.n, 0)::DOUBLE / p.n * 100, 1) AS monthly_churn_rate_pct
      FROM m c JOIN m p ON c.month = CAST(p.month + INTERVAL 1 MONTH AS DATE)""",
    "c05_inactivity_histogram": """
      WITH v AS (SELECT *, days_since_last_visit AS d FROM flags
          WHERE churn_status <> 'never_visited'),
      b AS (SELECT churn_status, min(d) AS lo, max(d) AS hi FROM v GROUP BY 1)
      SELECT churn_status, CASE WHEN hi = lo THEN 15
          ELSE least((d - lo) * 30 // (hi - lo), 29) END AS bin, lo, hi,
        count(*) AS user_count FROM v JOIN b USING (churn_status) GROUP BY ALL""",
    "v01_kpis": """
      SELECT count(DISTINCT visit_key) AS total_visits, count(DISTINCT user_key) AS active_users,
        CAST(sum(points_earned) AS BIGINT) AS total_points,
        sum(cashback_amount)::DOUBLE AS total_cashback,
        count(DISTINCT business_key) AS businesses_visited,
        (SELECT round(sum(google_rating)::DOUBLE / count(*), 1) FROM dim_businesses)
          AS avg_rating,
        (SELECT count(*) FROM dim_businesses) AS total_businesses,
        (SELECT count(*) FROM dim_users) AS total_users FROM visits""",
    "v02_visits_by_month": """
      SELECT year, month, month_name, count(*) AS visits,
        count(DISTINCT user_key) AS unique_users, sum(cashback_amount)::DOUBLE AS cashback
      FROM visits JOIN dim_time USING (date_key) GROUP BY 1, 2, 3""",
    "v02_visits_by_weekday": """
      SELECT day_of_week, day_name, is_weekend, count(*) AS visits
      FROM visits JOIN dim_time USING (date_key) GROUP BY 1, 2, 3""",
    "v02_visits_by_hour":
        "SELECT hour(visit_timestamp) AS visit_hour, count(*) AS visits FROM visits GROUP BY 1",
    "v03_loyalty_performance": """
      SELECT loyalty_type_name, visit_type, count(*) AS visit_count,
        CAST(sum(points_earned) AS BIGINT) AS total_points,
        sum(cashback_amount)::DOUBLE AS total_cashback,
        CAST(sum(punch_count) AS BIGINT) AS total_punches
      FROM visits JOIN dim_loyalty_type USING (loyalty_type_key) GROUP BY 1, 2""",
    "v03_loyalty_rollup": """
      SELECT loyalty_type_name, count(*) AS visit_count,
        CAST(sum(points_earned) AS BIGINT) AS total_points,
        sum(cashback_amount)::DOUBLE AS total_cashback,
        CAST(sum(punch_count) AS BIGINT) AS total_punches
      FROM visits JOIN dim_loyalty_type USING (loyalty_type_key) GROUP BY 1""",
    "v04_category_breakdown": """
      SELECT category, count(*) AS visits, count(DISTINCT user_key) AS unique_users,
        count(DISTINCT business_key) AS business_count,
        CAST(sum(points_earned) AS BIGINT) AS total_points,
        sum(cashback_amount)::DOUBLE AS total_cashback
      FROM visits JOIN dim_businesses USING (business_key) GROUP BY 1""",
    "v05_top_merchants": """
      SELECT business_name, category, neighborhood, loyalty_type,
        google_rating::DOUBLE AS google_rating, count(*) AS total_visits,
        count(DISTINCT user_key) AS unique_visitors,
        sum(cashback_amount)::DOUBLE AS cashback_given
      FROM visits JOIN dim_businesses USING (business_key) GROUP BY 1, 2, 3, 4, 5
      ORDER BY total_visits DESC, business_name LIMIT 15""",
    "v06_business_map": """
      SELECT business_name, category, neighborhood, loyalty_type,
        google_rating::DOUBLE AS google_rating, lat AS latitude, lng AS longitude,
        count(visit_key) AS total_visits
      FROM dim_businesses LEFT JOIN visits USING (business_key) GROUP BY ALL""",
    "v06_neighborhood_stats": """
      SELECT neighborhood, count(DISTINCT b.business_key) AS businesses,
        count(visit_key) AS visits, count(DISTINCT user_key) AS unique_users,
        round(sum(google_rating)::DOUBLE / count(google_rating), 1) AS avg_rating
      FROM dim_businesses b LEFT JOIN visits v ON v.business_key = b.business_key GROUP BY 1""",
    "v07_heatmap": """
      SELECT day_name, day_of_week, hour(visit_timestamp) AS visit_hour, count(*) AS visits
      FROM visits JOIN dim_time USING (date_key) GROUP BY 1, 2, 3""",
    "v08_loyalty_checks": """
      SELECT 'users: rows missing from raw' AS check_name, 0 AS fail_count
      UNION ALL SELECT 'businesses: rows missing from raw', 0
      UNION ALL SELECT 'visits: rows missing from raw',
        abs((SELECT count(*) FROM events) - (SELECT count(*) FROM (LOADED_VISITS)))
      UNION ALL SELECT 'visit: unknown user', count(*) FROM visits
        WHERE user_key NOT IN (SELECT user_key FROM dim_users)
      UNION ALL SELECT 'visit: unknown business', count(*) FROM visits
        WHERE business_key NOT IN (SELECT business_key FROM dim_businesses)
      UNION ALL SELECT 'visit: unknown date', count(*) FROM visits
        WHERE date_key NOT IN (SELECT date_key FROM dim_time)
      UNION ALL SELECT 'business: latitude outside box', count(*) FROM dim_businesses
        WHERE lat NOT BETWEEN 20.90::DOUBLE AND 21.05::DOUBLE
      UNION ALL SELECT 'business: longitude outside box', count(*) FROM dim_businesses
        WHERE lng NOT BETWEEN -89.70::DOUBLE AND -89.50::DOUBLE
      UNION ALL SELECT 'visit: cashback outside Cashback', count(*) FROM visits
        JOIN dim_businesses USING (business_key)
        WHERE cashback_amount > 0 AND loyalty_type <> 'Cashback'
      UNION ALL SELECT 'visit: punch outside Punch Card', count(*) FROM visits
        JOIN dim_businesses USING (business_key)
        WHERE punch_count > 0 AND loyalty_type <> 'Punch Card'
      UNION ALL SELECT 'visit: negative points', count(*) FROM visits WHERE points_earned < 0
      UNION ALL SELECT 'visit: before registration', count(*) FROM visits
        JOIN dim_users USING (user_key)
        WHERE CAST(visit_timestamp AS DATE) < registration_date""",
    "v09_redemption_rate": """
      SELECT loyalty_type_name, count(*) AS visits,
        count(*) FILTER (visit_type = 'redemption') AS redemptions,
        round(count(*) FILTER (visit_type = 'redemption')::DOUBLE / count(*) * 100, 1)
          AS redemption_rate_pct
      FROM visits JOIN dim_loyalty_type USING (loyalty_type_key) GROUP BY 1""",
    "v09_foot_traffic": """
      SELECT hour(visit_timestamp) AS visit_hour, category, count(*) AS visits
      FROM visits JOIN dim_businesses USING (business_key) GROUP BY 1, 2""",
}


def _live(kind: str, table: str, owner: str, gone: str) -> str:
    return f"""SELECT '{kind}' AS object_type, count(*) AS object_count FROM (
      SELECT 'DB_' || {owner} % 40 || CASE WHEN {owner} % 3 = 0 THEN '_DEV' ELSE '' END
        AS catalog FROM {table} WHERE NOT ({gone}))
      WHERE catalog LIKE '%_8' OR catalog LIKE '%_8_%'"""


_LOYALTY["v08_loyalty_checks"] = _LOYALTY["v08_loyalty_checks"].replace(
    "LOADED_VISITS", _CURATION["t09_fact_visits"])

_CHECKS["q27_client_count"] = f"""
      WITH c AS (SELECT count(*) AS n FROM ({_CURATION["t01_dim_client"]})),
      s AS (SELECT count(*) AS n FROM customer)
      SELECT 'client: row count' AS check_name, c.n AS curated_rows, s.n AS source_rows,
        CASE WHEN abs(c.n - s.n) <= s.n * 0.01 THEN 'PASS' ELSE 'FAIL' END AS status
      FROM c, s"""

_CURATION["t02_unmapped_counts"] = f"""
      SELECT reason, count(*) AS n_rows, sum(CAST(fee_amount AS DECIMAL(18,2)))::DOUBLE AS fee_amount
      FROM ({_CURATION["t02_unmapped_fees"]}) GROUP BY 1"""

_USAGE = {
    "m01_user_list":
        "SELECT name FROM app_users WHERE name LIKE 'USER_%' AND deleted_on IS NULL",
    "m02_credit_summary": f"""
      SELECT coalesce(sum(compute), 0)::DOUBLE AS total_compute_credits,
        coalesce(sum(qas), 0)::DOUBLE AS total_qas_credits,
        count(DISTINCT query_id) AS total_queries,
        count(DISTINCT warehouse_name) AS warehouses_used
      FROM attribution WHERE {_SINCE.format(30)}""",
    "m02_assistant_summary": f"""
      SELECT coalesce(sum(credits), 0)::DOUBLE AS total_ai_credits,
        CAST(coalesce(sum(request_count), 0) AS BIGINT) AS total_requests,
        count(DISTINCT CAST(start_time AS DATE)) AS active_days
      FROM assistant WHERE {_SINCE.format(30).replace('user_name', 'username')}""",
    "m03_week_over_week": """
      WITH c AS (SELECT coalesce(sum(compute), 0) AS v FROM attribution
          WHERE user_name = 'USER_8' AND start_time >= CAST(as_of AS DATE) - 7),
      p AS (SELECT coalesce(sum(compute), 0) AS v FROM attribution
          WHERE user_name = 'USER_8' AND start_time >= CAST(as_of AS DATE) - 14
            AND start_time < CAST(as_of AS DATE) - 7)
      SELECT c.v::DOUBLE AS current_week_credits, p.v::DOUBLE AS previous_week_credits,
        (c.v - p.v)::DOUBLE AS change,
        CASE WHEN p.v > 0 THEN round((c.v - p.v)::DOUBLE / p.v::DOUBLE * 100, 2) END
          AS pct_change FROM c, p""",
    "m04_daily_credits": f"""
      SELECT CAST(start_time AS DATE) AS usage_date,
        sum(compute)::DOUBLE AS daily_compute_credits,
        coalesce(sum(qas), 0)::DOUBLE AS daily_qas_credits,
        count(DISTINCT query_id) AS daily_query_count
      FROM attribution WHERE {_SINCE.format(30)} GROUP BY 1""",
    "m04_daily_assistant_credits": f"""
      SELECT CAST(start_time AS DATE) AS usage_date, sum(credits)::DOUBLE AS daily_credits,
        CAST(sum(request_count) AS BIGINT) AS daily_requests
      FROM assistant WHERE {_SINCE.format(30).replace('user_name', 'username')} GROUP BY 1""",
    "m05_credits_by_warehouse": f"""
      SELECT warehouse_name, sum(compute)::DOUBLE AS total_credits,
        count(DISTINCT query_id) AS query_count,
        round(sum(compute)::DOUBLE / count(compute), 6) AS avg_credits_per_query
      FROM attribution WHERE {_SINCE.format(30)} GROUP BY 1""",
    "m06_query_types": f"""
      SELECT query_type, count(*) AS execution_count,
        round(sum(total_elapsed_time)::DOUBLE / count(*) / 1000, 2) AS avg_duration_sec,
        round(max(total_elapsed_time)::DOUBLE / 1000, 2) AS max_duration_sec,
        round(sum(bytes_scanned)::DOUBLE / count(*) / 1048576, 2) AS avg_mb_scanned
      FROM query_history WHERE {_SINCE.format(7)} GROUP BY 1""",
    "m07_objects_created": f"""
      SELECT CASE WHEN query_type = 'CREATE_TABLE' THEN 'TABLE'
          WHEN query_type = 'CREATE_TABLE_AS_SELECT' THEN 'TABLE (CTAS)'
          WHEN query_type = 'CREATE_VIEW' THEN 'VIEW'
          WHEN upper(query_text) LIKE '%STREAMLIT%' THEN 'STREAMLIT APP'
          WHEN upper(query_text) LIKE '%NOTEBOOK%' THEN 'NOTEBOOK'
          WHEN upper(query_text) LIKE '%STAGE%' THEN 'STAGE'
          WHEN upper(query_text) LIKE '%SCHEMA%' THEN 'SCHEMA'
          WHEN upper(query_text) LIKE '%FUNCTION%' THEN 'FUNCTION'
          ELSE 'OTHER' END AS object_type, count(DISTINCT query_hash) AS objects_created
      FROM query_history WHERE {_SINCE.format(90)} AND query_type LIKE 'CREATE%'
        AND execution_status = 'SUCCESS' GROUP BY 1""",
    "m07_live_objects": " UNION ALL ".join([
        _live("TABLE", "part", "p_partkey", "p_size > 40 OR p_size % 4 = 0"),
        _live("VIEW", "customer", "c_custkey", "c_acctbal < 0"),
        _live("FUNCTION", "supplier", "s_suppkey", "s_acctbal < 0"),
        _live("PROCEDURE", "orders", "o_orderkey", "o_orderstatus = 'P'"),
        _live("STAGE", "documents", "doc_id", "n_chars > 2000"),
        _live("SEMANTIC VIEW", "pages", "page_id", "page_id < 0"),
    ]),
    "m08_storage": """
      WITH s AS (SELECT 'DB_' || user_id % 40 || CASE WHEN k % 2 = 0 THEN '_DEV' ELSE '' END
          AS database_name, CAST(floor(value * 100) AS BIGINT) * 1048576 AS a,
          k * 1048576 AS f, CASE WHEN k % 3 = 0 THEN k * 524288 END AS h
        FROM ev WHERE ts >= (SELECT CAST(max(ts) AS DATE) - 30 FROM events))
      SELECT database_name, round(sum(a)::DOUBLE / count(*) / 1073741824, 4) AS avg_storage_gb,
        round(sum(f)::DOUBLE / count(*) / 1073741824, 4) AS avg_failsafe_gb,
        round(sum(a + f + coalesce(h, 0))::DOUBLE / count(*) / 1073741824, 4) AS total_avg_gb
      FROM s WHERE database_name LIKE '%_8' OR database_name LIKE '%_8_%' GROUP BY 1""",
    "m09_logins": """
      SELECT CAST(event_timestamp AS DATE) AS login_date, count(*) AS login_count,
        count(*) FILTER (is_success = 'YES') AS successful_logins,
        count(*) FILTER (is_success = 'NO') AS failed_logins
      FROM logins WHERE user_name = 'USER_8' AND event_timestamp >= CAST(as_of AS DATE) - 7
      GROUP BY 1""",
    "m09_logins_long": """
      WITH d AS (SELECT CAST(event_timestamp AS DATE) AS login_date,
          count(*) FILTER (is_success = 'YES') AS a, count(*) FILTER (is_success = 'NO') AS b
        FROM logins WHERE user_name = 'USER_8'
          AND event_timestamp >= CAST(as_of AS DATE) - 7 GROUP BY 1)
      SELECT login_date, 'successful_logins' AS status, a AS count FROM d
      UNION ALL SELECT login_date, 'failed_logins', b FROM d""",
    "m10_expensive_queries": f"""
      SELECT query_id, warehouse_name, compute::DOUBLE AS credits_compute,
        coalesce(qas, 0)::DOUBLE AS credits_qas, start_time
      FROM attribution WHERE {_SINCE.format(30)} AND compute > 0
      ORDER BY compute DESC, query_id LIMIT 15""",
}

_GOVERNANCE = {
    "g01_masked_view": """
      SELECT client_key,
        left(client_name, 1) || regexp_replace(substr(client_name, 2), '[A-Za-z]', '*', 'g')
          AS client_name,
        '***-**-' || right(replace(ssn, '-', ''), 4) AS ssn,
        repeat('*', CAST(greatest(length(account_number) - 4, 0) AS INT))
          || right(account_number, 4) AS account_number,
        left(email, 1) || '***@***.com' AS email,
        '***-***-' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) AS phone
      FROM sensitive""",
    "g01_masked_view_ops": """
      SELECT * REPLACE ('***-**-' || right(replace(ssn, '-', ''), 4) AS ssn)
      FROM sensitive""",
    "g02_row_access": """
      SELECT c.client_key, c.client_name, c.office_location FROM dim_client c
      WHERE EXISTS (SELECT 1 FROM access_map m WHERE m.user_email = 'manager3'
        AND (m.client_key IS NULL OR m.client_key = c.client_key)
        AND (m.office_location IS NULL OR m.office_location = c.office_location))""",
    "g02_row_access_revenue": """
      SELECT transaction_id, client_key, revenue_amount::DOUBLE AS revenue_amount
      FROM fact_revenue f WHERE EXISTS (SELECT 1 FROM access_map m
        WHERE m.user_email = 'manager3' AND m.client_key = f.client_key)""",
    "g02_visible_columns": "SELECT client_key, client_name, email, phone FROM sensitive",
    "g03_access_review": """
      SELECT name AS user_name, email, disabled, last_success_login,
        coalesce(string_agg(DISTINCT role, ', ' ORDER BY role), '') AS roles
      FROM app_users u LEFT JOIN grants g ON g.grantee_name = u.name
        AND g.deleted_on IS NULL
      WHERE u.deleted_on IS NULL GROUP BY 1, 2, 3, 4""",
    "g03_inactive_users": """
      SELECT name, email, last_success_login,
        date_diff('day', last_success_login, m) AS days_inactive
      FROM app_users, (SELECT max(o_orderdate) AS m FROM orders)
      WHERE deleted_on IS NULL AND disabled = 'false' AND (last_success_login IS NULL
        OR date_diff('day', last_success_login, m) > 90)""",
    "g03_admin_grants": """
      SELECT grantee_name, role, granted_on FROM grants
      WHERE role = 'ACCOUNTADMIN' AND deleted_on IS NULL""",
    "g04_pii_queries": """
      SELECT user_name, role_name, query_text, start_time, rows_produced FROM query_history
      WHERE start_time >= CAST(as_of AS DATE) - 30 AND execution_status = 'SUCCESS'
        AND (query_text ILIKE '%DIM_CLIENT%' OR query_text ILIKE '%CLIENT_NAME%')""",
    "g04_admin_use": """
      SELECT user_name, role_name, query_text, start_time FROM query_history
      WHERE role_name = 'ACCOUNTADMIN' AND start_time >= CAST(as_of AS DATE) - 90""",
    "g04_tagged_queries": """
      SELECT user_name, role_name, query_text, rows_produced, start_time,
        total_elapsed_time::DOUBLE / 1000 AS duration_sec FROM query_history
      WHERE query_tag ILIKE '%AI_ANALYST%' AND start_time >= CAST(as_of AS DATE) - 7""",
    "g04_failed_logins": """
      SELECT CAST(event_timestamp AS DATE) AS day, count(*) AS failed_logins,
        count(DISTINCT user_name) AS distinct_users,
        string_agg(DISTINCT client_ip, ', ' ORDER BY client_ip) AS source_ips
      FROM logins WHERE is_success = 'NO' AND event_timestamp >= CAST(as_of AS DATE) - 90
      GROUP BY 1""",
    "g05_log_coverage": """
      SELECT 'logins' AS log_name, count(*) AS events FROM logins
        WHERE event_timestamp >= CAST(as_of AS DATE) - 1
      UNION ALL SELECT 'queries', count(*) FROM query_history
        WHERE start_time >= CAST(as_of AS DATE) - 1
      UNION ALL SELECT 'grants', count(*) FROM attribution
        WHERE start_time >= CAST(as_of AS DATE) - 30""",
    "g06_erasure": """
      SELECT o_custkey AS subject, o_orderkey, o_orderstatus FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "g06_erasure_audit": """
      WITH e AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
      SELECT 'orders' AS table_name, o_custkey AS subject, count(*) AS erased_rows
      FROM orders WHERE o_custkey IN (SELECT c_custkey FROM e) GROUP BY 1, 2
      UNION ALL SELECT 'customer', c_custkey, count(*) FROM e GROUP BY 1, 2""",
    "g07_log_archive": """
      SELECT CAST(event_timestamp AS DATE) AS log_date, count(*) AS n_rows FROM logins
      WHERE event_timestamp < CAST(as_of AS DATE) - 10 GROUP BY 1""",
    "g07_query_archive": """
      SELECT CAST(start_time AS DATE) AS log_date, count(*) AS n_rows FROM query_history
      WHERE start_time < CAST(as_of AS DATE) - 10 GROUP BY 1""",
    "l01_failed_login_spikes": """
      SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS failed_logins
      FROM (SELECT unnest([date_trunc('hour', event_timestamp),
          date_trunc('hour', event_timestamp) - INTERVAL 1 HOUR]) AS w
        FROM logins WHERE is_success = 'NO')
      GROUP BY 1 HAVING count(*) > 5""",
    "l02_off_hours": """
      SELECT user_name, role_name, start_time, start_time - INTERVAL 5 HOUR AS local_time
      FROM query_history
      WHERE start_time > as_of - INTERVAL 14 DAY AND role_name <> 'SERVICE' AND (hour(start_time - INTERVAL 5 HOUR) NOT BETWEEN 6 AND 22
        OR isodow(start_time - INTERVAL 5 HOUR) > 5)""",
    "l03_bulk_exports": """
      SELECT user_name, role_name, start_time, rows_produced FROM query_history
      WHERE start_time > as_of - INTERVAL 14 DAY AND rows_produced > 10000
        AND role_name NOT IN ('SERVICE', 'OPS')""",
    "l04_admin_alerts": """
      SELECT user_name, role_name, start_time FROM query_history
      WHERE role_name = 'ACCOUNTADMIN' AND start_time > as_of - INTERVAL 14 DAY""",
}


def _grain(by: str) -> str:
    """Revenue, expense and budget at a date grain, each summed alone."""
    return f"""
      WITH r AS (SELECT {by}, sum(revenue_amount) AS rev, sum(aum_amount) AS aum,
          sum(fee_basis_points)::DOUBLE / count(*) AS bps,
          count(DISTINCT client_key) AS clients
        FROM fact_revenue JOIN dim_date USING (date_key) GROUP BY {by}),
      e AS (SELECT {by}, sum(expense_amount) AS spent
        FROM fact_expense JOIN dim_date USING (date_key) GROUP BY {by}),
      b AS (SELECT {by}, sum(budget_amount) AS planned
        FROM fact_budget JOIN dim_date USING (date_key) GROUP BY {by}),
      j AS (SELECT {by}, coalesce(rev, 0) AS rev, coalesce(aum, 0) AS aum, bps, clients,
          coalesce(spent, 0) AS spent, coalesce(planned, 0) AS planned, rev AS rev0
        FROM r FULL JOIN e USING ({by}) FULL JOIN b USING ({by}))"""


_METRICS = {
    "k01_metrics_by_quarter": _grain("year_number, quarter_name") + """
      SELECT year_number, quarter_name, rev::DOUBLE AS total_revenue,
        spent::DOUBLE AS total_expenses, (rev - spent)::DOUBLE AS net_income,
        round((rev - spent)::DOUBLE / rev0::DOUBLE * 100, 2) AS profit_margin,
        round(spent::DOUBLE / rev0::DOUBLE * 100, 2) AS expense_ratio,
        (spent - planned)::DOUBLE AS budget_variance FROM j""",
    "k01_metrics_by_segment": """
      SELECT client_segment, p_type AS product_category,
        sum(revenue_amount)::DOUBLE AS total_revenue, sum(aum_amount)::DOUBLE AS total_aum,
        round(sum(fee_basis_points)::DOUBLE / count(*), 4) AS avg_fee_rate,
        round(sum(revenue_amount)::DOUBLE / count(DISTINCT client_key), 2)
          AS revenue_per_client
      FROM fact_revenue JOIN dim_client USING (client_key)
      JOIN part ON product_key = p_partkey JOIN dim_date USING (date_key)
      WHERE quarter_name = 'Q4' AND year_number = 1999 GROUP BY 1, 2""",
    "k01_metrics_total": """
      SELECT r::DOUBLE AS total_revenue, e::DOUBLE AS total_expenses,
        (r - e)::DOUBLE AS net_income, b::DOUBLE AS total_budget
      FROM (SELECT sum(revenue_amount) AS r FROM fact_revenue),
        (SELECT sum(expense_amount) AS e FROM fact_expense),
        (SELECT sum(budget_amount) AS b FROM fact_budget)""",
    "k02_monthly_rollup": _grain("year_number, month_number") + """
      SELECT year_number, month_number, rev::DOUBLE AS total_revenue,
        aum::DOUBLE AS total_aum, round(bps, 4) AS avg_fee_rate,
        round(rev0::DOUBLE / clients, 2) AS revenue_per_client,
        spent::DOUBLE AS total_expenses, (rev - spent)::DOUBLE AS net_income,
        round((rev - spent)::DOUBLE / rev0::DOUBLE * 100, 2) AS profit_margin,
        round(spent::DOUBLE / rev0::DOUBLE * 100, 2) AS expense_ratio,
        planned::DOUBLE AS total_budget, (spent - planned)::DOUBLE AS budget_variance
      FROM j""",
}

_STREAMS = {
    "x03_metric_log": f"""SELECT metric_name, CAST(metric_value AS BIGINT) AS metric_value
      FROM ({_BIKES["d01_quality_metrics"]}) WHERE metric_name NOT LIKE 'bronze%'""",
    "r01_bronze_silver": _BIKES["b01_silver_clean"],
    "r02_network_summary_stream": _BIKES["b02_network_summary"],
    "r03_station_hourly_stream": _BIKES["b03_station_hourly"],
    "r05_apply_changes": """
      SELECT user_id, event_id AS seq, event_type FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
        AND event_type <> 'error'""",
    "r06_incremental_since": """
      SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem
      WHERE l_shipdate >= (SELECT max(o_orderdate) FROM orders)""",
    "r07_refresh_all": _FINANCE["q06_revenue_by_segment"],
    "r08_failed_login_stream": _GOVERNANCE["l01_failed_login_spikes"],
    "r09_dedup_stream": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem",
}

QUERIES = {
    **_UNIT, **_BIKES, **_FINANCE, **_CHECKS, **_CURATION, **_LOYALTY, **_USAGE,
    **_GOVERNANCE, **_METRICS, **_STREAMS,
}


def _with_views(body: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    return f"WITH {ctes} SELECT * FROM ({body})"


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL."""
    return {name: _with_views(body) for name, body in QUERIES.items()}
