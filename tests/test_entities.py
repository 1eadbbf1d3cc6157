"""Components, key allocation, entities over three systems, and staged facts."""

import datetime
import itertools
import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.components import allocate_keys, connected_components
from tidemark.plans import entities, staging
from tidemark.session import scratch_path

ACCOUNTS = "system string, id string, business_id string, name string, city string"
REVIEWS = "left_system string, left_id string, right_system string, right_id string, accepted boolean"


def unions(pairs, vertices):
    """Each vertex with the smallest that it is connected with."""
    root = {v: v for v in vertices}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("shape", ["chain", "hub", "random", "none"])
def test_connected_components(spark, shape):
    rnd = random.Random(shape)
    n = 300
    if shape == "chain":
        order = rnd.sample(range(n), n)
        pairs = list(itertools.pairwise(order))
    elif shape == "hub":
        pairs = [(7, i) for i in range(n)] + [(i, i) for i in range(5)]
    else:
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(120 if shape == "random" else 0)]
    ids = [*range(n + 3)]
    edges = spark.createDataFrame([*pairs, *pairs[:9], (None, 3), (4, None)], "src long, dst long")
    got = connected_components(spark.createDataFrame([(i, "x") for i in ids], "id long, kept string"), edges)
    assert got.columns == ["id", "kept", "component"]
    assert {r.id: r.component for r in got.collect()} == unions(pairs, ids)


def test_keys_stay_whatever_the_order_of_loads(spark):
    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "id string")

    first = allocate_keys(ids("m", "c", "x", "c", None))
    assert rows(first) == [("c", 1), ("m", 2), ("x", 3)]
    second = allocate_keys(ids("b", "m", "z", "a"), first)
    assert rows(second) == [("a", 4), ("b", 5), ("c", 1), ("m", 2), ("x", 3), ("z", 6)]
    assert rows(allocate_keys(ids("x", "a", "z", "b", "m"), second)) == rows(second)
    assert rows(allocate_keys(ids())) == [] and rows(allocate_keys(ids(), first)) == rows(first)


# -- entities -----------------------------------------------------------------


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
    return line[-1]


def plain_members(accounts, known=(), reviews=()):
    """Members by looking at every pair."""
    acc = {}
    for system, i, biz, name, city in accounts:
        if system is None or i is None:
            continue
        row = (biz is not None, biz or "", (name or "").lower(), (city or "").lower())
        acc[f"{system}:{i}"] = min(acc.get(f"{system}:{i}", row), row)
    system = {v: v.split(":")[0] for v in acc}
    links = []
    by_biz = {}
    for v, (has, biz, *_) in acc.items():
        if has:
            by_biz.setdefault(biz, []).append(v)
    shared = {b: vs for b, vs in by_biz.items() if len({system[v] for v in vs}) > 1}
    matched = {v for vs in shared.values() for v in vs}
    links += [(v, min(vs), "ID_MATCH") for vs in shared.values() for v in vs]
    judged = {}
    for a, i, b, j, yes in reviews:
        x, y = f"{a}:{i}", f"{b}:{j}"
        if x in acc and y in acc:
            judged[x, y] = judged[y, x] = yes
    links += [(x, y, "MANUAL") for (x, y), yes in judged.items() if yes]
    for v in acc:
        if v in matched or not acc[v][2] or not acc[v][3]:
            continue
        near = [(distance(acc[v][2], acc[o][2]), o) for o in acc
                if system[o] != system[v] and acc[o][3] == acc[v][3] and acc[o][2]]
        near = [x for x in near if x[0] <= 1]
        if near and (v, min(near)[1]) not in judged:
            links.append((v, min(near)[1], "NAME_MATCH"))
    component = unions([(a, b) for a, b, _ in links], acc)
    methods = {v: {m for a, b, m in links if v in (a, b)} for v in acc}
    groups = {}
    for v, c in component.items():
        groups.setdefault(c, []).append(v)
    had = {f"{s}:{i}": k for s, i, k in known}
    owner = {}
    for k in set(had.values()):
        holders = [v for v in acc if had.get(v) == k]
        if holders:
            owner.setdefault(component[min(holders)], []).append(k)
    last = max(had.values(), default=0)
    keys = {c: min(ks) for c, ks in owner.items()}
    for n, c in enumerate(sorted(set(groups) - set(keys)), 1):
        keys[c] = last + n
    out = []
    for c, vs in groups.items():
        found = set().union(*(methods[v] for v in vs))
        verified = "MANUAL" in found and "NAME_MATCH" not in found
        conflict = len({system[v] for v in vs}) < len(vs)
        for v in vs:
            best = next((m for m in entities.METHODS if m in methods[v]), "UNMATCHED")
            out.append((*v.split(":"), keys[c], best, verified, conflict))
    return sorted(out)


def members(spark, accounts, known=(), reviews=()):
    frame = spark.createDataFrame(list(accounts), ACCOUNTS)
    found = entities.entity_members(
        frame,
        spark.createDataFrame(list(known), "system string, account string, curated_key long") if known else None,
        spark.createDataFrame(list(reviews), REVIEWS) if reviews else None,
    )
    return found, sorted(tuple(r) for r in found.drop("similarity").collect())


def test_entities_equal_brute_force(spark):
    rnd = random.Random(11)
    base = ["".join(rnd.choices("abcdefgh", k=7)) for _ in range(40)]
    accounts = []
    for k in range(150):
        name = list(rnd.choice(base))
        if rnd.random() < 0.4:
            name[rnd.randrange(len(name))] = rnd.choice(["x", ""])
        accounts.append((rnd.choice(entities.SYSTEMS), f"{k:03}", rnd.choice([None, None, f"B{k % 45}"]),
                         "".join(name), f"c{rnd.randrange(3)}"))
    accounts += [("crm", f"h{k}", "HOT", None, None) for k in range(40)] + [("ledger", "h", "HOT", "", "")]
    accounts += [("ledger", f"n{k}", "NONE", "", "c1") for k in range(5)]  # one system only: no link
    accounts += [accounts[0], accounts[0], (None, "1", None, "a", "b"), ("crm", None, None, "a", "b"),
                 ("other system", "1", "B1", "a", "b")]
    known = [("crm", "h3", 900), ("crm", "h9", 12), ("ledger", "n1", 5), ("ledger", "n2", 5), ("crm", "gone", 77)]
    reviews = [("ledger", "n1", "ledger", "n3", True), ("crm", "h1", "portfolio", "nobody", True),
               *(("crm", a[1], o[0], o[1], False) for a in accounts[:40] if a[0] == "crm" for o in accounts[40:60])]
    listed = [a for a in accounts if a[0] != "other system"]
    frame, got = members(spark, accounts, known, reviews)
    assert got == plain_members(listed, known, reviews)
    assert {m for *_, m, _, _ in got} == set(entities.METHODS)
    # each account stands in exactly one row, and a second run gives the same keys
    wide = entities.entity_crossref(frame).collect()
    placed = sorted((s, r[f"{s}_id"], r.curated_key) for r in wide for s in entities.SYSTEMS if r[f"{s}_id"])
    assert placed == sorted((s, a, k) for s, a, k, *_ in got)
    _, again = members(spark, listed[::-1], [(s, a, k) for s, a, k, *_ in got], reviews)
    assert again == got


def test_keys_of_joined_and_divided_entities(spark):
    one = [("crm", "1", "B1", "alpha", "x"), ("ledger", "1", "B1", "bravo", "x"), ("portfolio", "1", None, "delta", "x")]
    _, first = members(spark, one)
    assert [r[2] for r in first] == [1, 1, 2]
    joined = [*one[:2], ("portfolio", "1", "B1", "delta", "x")]
    _, second = members(spark, joined, [r[:3] for r in first])
    assert [r[2] for r in second] == [1, 1, 1]
    _, third = members(spark, one, [r[:3] for r in second])
    assert [r[2] for r in third] == [1, 1, 2]  # the first part keeps the key, the other is new
    assert members(spark, [])[1] == []


def test_coverage_counts_every_system(spark):
    accounts = spark.createDataFrame([("crm", "1", "B", "alpha", "x"), ("ledger", "2", "B", "bravo", "x"),
                                      ("ledger", "3", None, "quebec", "x")], ACCOUNTS)
    crossref = entities.entity_crossref(entities.entity_members(accounts))
    assert rows(entities.coverage(accounts, crossref)) == [("crm", 1, 1, 1), ("ledger", 2, 2, 1)]


# -- staged facts -------------------------------------------------------------

FEES = ("transaction_id string, account_id string, strategy_id string, transaction_date date, "
        "transaction_type string, fee_amount decimal(18,4), loaded_at timestamp_ntz")


def lookups(spark):
    day = datetime.date(2024, 1, 1)
    rate = spark.createDataFrame([(f"A{i}", "S1", day, "Management", 5.0) for i in range(6)],
                                 "account_id string, strategy_id string, effective_date date, fee_type string, fee_rate_bps double")
    nav = spark.createDataFrame([("A1", day, 100.0), ("A1", day, 90.0)], "account_id string, valuation_date date, market_value double")
    days = spark.range(40).select(F.date_add(F.lit(day), F.col("id").cast("int")).alias("calendar_date"),
                                  (F.lit(20240101) + F.col("id")).cast("int").alias("date_key"))
    gl = spark.createDataFrame([("4010", 9)], "gl_account_id string, gl_account_key long")
    return rate, nav, days, gl


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_staged_fees_move_once_in_any_order(spark, order):
    rate, nav, days, gl = lookups(spark)
    stamp = datetime.datetime(2024, 2, 1)
    fees = [(f"T{i}", f"A{i % 8}" if i % 9 else None, "S1" if i % 5 else "S9",
             datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 45), "FEE", Decimal(10 + i), stamp) for i in range(60)]
    fees += fees[:2]
    mapped = ["A1", "A1", "A4"], ["A1", "A2", "A4", "A5"], [f"A{i}" for i in range(6)]
    frame, folder, after, done = spark.createDataFrame(fees, FEES), scratch_path(spark, "fees"), None, []
    for step, batch in enumerate(order):
        crossref = spark.createDataFrame(
            [("CLIENT", a, int(a[1:])) for a in mapped[step]] + [("PRODUCT", "S1", 1), ("CLIENT", None, 3)],
            "entity_type string, portfolio_id string, curated_key long")
        load = staging.StagedFact(
            folder, lambda r, c=crossref: staging.keyed_fees(r, rate, nav, c, days, gl), staging.revenue_rows)
        part = frame.where(F.substring("transaction_id", 2, 9).cast("int") % 3 == batch)
        for _ in range(2 if step == 1 else 1):  # a repeated run changes nothing
            load.run(part, batch, after, F.lit("2024-03-01"))
        done += [f for f in fees if int(f[0][1:]) % 3 == batch]
        after = batch
        fact, waiting = load.fact(frame), load.staged(frame, batch)
        ids = [r.transaction_id for r in fact.collect()] + [r.transaction_id for r in waiting.collect()]
        assert sorted(ids) == sorted(f[0] for f in done)
        loaded = {r.transaction_id for r in fact.collect()}
        known = set(mapped[step])
        assert loaded == {f[0] for f in done if f[1] in known and f[2] == "S1" and (f[3] - datetime.date(2024, 1, 1)).days < 40}
    causes = {r.reason for r in waiting.collect()}
    assert causes == {"no rate in force", "unknown date"} and waiting.where("staged_in is null").count() == 0
    assert {str(r.created_at) for r in fact.collect()} == {"2024-03-01 00:00:00"}
    newest = staging.newest_revenue(fact)
    assert newest.count() == len(loaded)
    assert {r.aum_amount for r in newest.where("client_key = 1 and date_key = 20240101").collect()} <= {None, 100}


def test_closed_accounts_wait_for_their_budget(spark):
    _, _, days, _ = lookups(spark)
    day = datetime.date(2024, 1, 1)
    budgets = spark.createDataFrame(
        [(1, 2, "S1", day, Decimal(5), "Original"), (2, None, None, day, Decimal(6), "Original"), (1, 9, "S2", day, Decimal(7), "Original"),
         (1, 2, None, datetime.date(2030, 1, 1), Decimal(8), "Original")],
        "account long, department long, strategy_id string, period_start date, amount decimal(12,2), budget_version string")
    centers = spark.createDataFrame([("CC-002", 2)], "cost_center_id string, cost_center_key long")
    crossref = spark.createDataFrame([("PRODUCT", "S1", 1)], "entity_type string, portfolio_id string, curated_key long")
    folder = scratch_path(spark, "budgets")

    def load(accounts):
        gl = spark.createDataFrame(accounts, "gl_account_key long, gl_account_id string")
        return staging.StagedFact(folder, lambda r: staging.keyed_budgets(r, gl, centers, crossref, days), staging.budget_rows)

    load([(1, "4010")]).run(budgets, 0, None, F.lit("2024-03-01"))
    first = load([]).staged(budgets, 0)
    assert rows(first, "account", "reason") == [(1, "unknown date"), (1, "unknown product"), (2, "closed account")]
    load([(1, "4010"), (2, "5100")]).run(budgets.where("false"), 1, 0, F.lit("2024-03-02"))
    fact = load([]).fact(budgets)
    assert rows(fact, "gl_account_key", "budget_type", "cost_center_key", "batch") == [(1, "Revenue", 2, 0), (2, "Expense", None, 1)]
    assert load([]).staged(budgets, 1).count() == 2
