import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import dedupe, joins, matching, metrics, shape, windows


# -- as-of join ---------------------------------------------------------------


def brute_asof(left, right):
    found = []
    for key, at, ident in left:
        fits = [(t, v) for k, t, v in right if k == key and t is not None and t <= at]
        found.append((ident, max(fits)[1] if fits else None))
    return sorted(found, key=repr)


@pytest.mark.parametrize("slice_by", [None, "day", "month"])
def test_asof_against_brute_force_with_a_hot_key(spark, slice_by):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)

    def moment():
        return start + timedelta(hours=rng.randrange(24 * 80))

    def key():
        return "hot" if rng.random() < 0.4 else rng.choice("abc")

    left = [(key(), moment(), i) for i in range(400)]
    right = {(key(), moment()): i for i in range(60)}
    right = [(k, t, v) for (k, t), v in right.items()]
    got = joins.asof_latest(
        spark.createDataFrame(left, "k string, at timestamp_ntz, id int"),
        spark.createDataFrame(right, "k string, since timestamp_ntz, rate int"),
        ["k"], "at", "since", ["rate"], slice_by=slice_by,
    )
    assert rows(got, "id", "rate") == brute_asof(left, right)


def test_asof_on_before_after_and_none(spark):
    left = spark.createDataFrame(
        [("a", date(2024, 1, 5), 1), ("a", date(2024, 1, 1), 2), ("b", date(2024, 1, 9), 3),
         (None, date(2024, 1, 9), 4)], "k string, at date, id int")
    right = spark.createDataFrame(
        [("a", date(2024, 1, 5), 10), ("a", date(2024, 1, 6), 11), (None, date(2024, 1, 1), 12)],
        "k string, since date, rate int")
    got = joins.asof_latest(left, right, ["k"], "at", "since", ["rate"])
    assert rows(got, "id", "rate") == [(1, 10), (2, None), (3, None), (4, None)]


# -- integrity ----------------------------------------------------------------


def test_orphans_with_null_and_missing_keys(spark):
    fact = spark.createDataFrame([(1,), (1,), (9,), (9,), (None,)], "fk int")
    dim = spark.createDataFrame([(1,), (2,)], "pk int")
    strict = joins.orphan_count(fact, dim, "fk", "pk", "x")
    relaxed = joins.orphan_count(fact, dim, "fk", "pk", "x", nullable=True)
    assert rows(strict) == [("x", 3)]
    assert rows(relaxed) == [("x", 2)]


def test_orphans_of_an_empty_fact_are_zero(spark):
    fact = spark.createDataFrame([], "fk int")
    dim = spark.createDataFrame([(1,)], "pk int")
    assert rows(joins.orphan_count(fact, dim, "fk", "pk", "x")) == [("x", 0)]


def test_rollup_equals_join_then_group(spark):
    fact = spark.createDataFrame(
        [(i % 5 if i % 3 else 0, i) for i in range(200)], "fk int, v int")
    dim = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(4)],
                                "pk int, kind string")
    got = joins.star_rollup(fact, dim, "fk", "pk", ["kind"],
                            {"total": F.col("v"), "n": F.lit(1)})
    plain = fact.join(dim, fact.fk == dim.pk).groupBy("kind").agg(
        F.sum("v").alias("total"), F.count("*").alias("n"))
    assert rows(got, "kind", "total", "n") == rows(plain, "kind", "total", "n")


# -- keys ---------------------------------------------------------------------


def test_latest_per_key_uses_the_tiebreaker(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("b", 2, 1)], "k string, t int, v int")
    got = dedupe.latest_per_key(df, ["k"], [F.desc("t"), F.desc("v")])
    assert rows(got) == [("a", 1, 7), ("b", 2, 1)]


def test_latest_per_key_is_cut_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = dedupe.latest_per_key(df, ["k"], [F.desc("id")])._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "row_number(), 1, Partial" in text


def test_surrogate_keys_are_consecutive_and_ordered(spark):
    ids = [f"id{i:04d}" for i in range(500)]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(7)
    got = dedupe.with_surrogate_key(df, ["id"], "key")
    assert rows(got, "key", "id") == sorted(
        ((i + 1, s) for i, s in enumerate(sorted(ids))), key=repr)


def test_duplicate_excess_ignores_null_keys_in_the_distinct_count(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert rows(dedupe.duplicate_excess(df, ["k"], "m")) == [("m", 2)]


# -- series -------------------------------------------------------------------


def test_gap_runs(spark):
    series = spark.createDataFrame(
        [(date(2024, 1, d), h) for d, h in
         [(1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (8, 1), (9, 0)]], "d date, has int")
    got = windows.gap_runs(series, "d", "has")
    assert rows(got) == [
        (date(2024, 1, 1), date(2024, 1, 1), 1), (date(2024, 1, 3), date(2024, 1, 5), 3),
        (date(2024, 1, 9), date(2024, 1, 9), 1)]


def test_month_change_with_a_zero_month(spark):
    series = spark.createDataFrame([(1, 0), (2, 10), (3, 5)], "m int, v int")
    got = windows.mom_change(series, "m", "v")
    assert rows(got, "m", "mom_change", "mom_change_pct") == [
        (1, None, None), (2, 10, None), (3, -5, -50.0)]


# -- shape --------------------------------------------------------------------


def test_histogram_matches_numpy(spark):
    import numpy as np

    values = [0, 1, 2, 3, 29, 30, 31, 60, 90, 90, 90]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4), ("b", 4)],
                               "c string, v int")
    got = shape.equal_width_histogram(df, "v", 30, "c")
    counts = {(r["c"], r["bin"]): r["user_count"] for r in got.collect()}
    expected, _ = np.histogram(values, bins=30)
    assert [counts.get(("a", i), 0) for i in range(30)] == expected.tolist()
    assert counts[("b", 15)] == 2


def test_list_distinct_is_sorted(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y"), ("b", None)],
                               "g string, v string")
    assert rows(shape.list_distinct(df, ["g"], "v", "vs")) == [("a", "x, y")]


def test_rule_violations_skip_nulls(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    got = shape.rule_violations(df, {"neg": F.col("v") < 0, "null": F.col("v").isNull()})
    assert rows(got) == [("neg", 1), ("null", 1)]


def test_filter_eq(spark):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    assert shape.filter_eq(df, "v").count() == 2
    assert shape.filter_eq(df, "v", "All").count() == 2
    assert rows(shape.filter_eq(df, "v", "a")) == [("a",)]


# -- matching -----------------------------------------------------------------


def levenshtein(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, before = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(before[j] + 1, line[-1] + 1, before[j - 1] + (x != y)))
    return line[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_matches_against_brute_force(spark, edits):
    rng = random.Random(edits)

    def name():
        return "".join(rng.choice("abé") for _ in range(rng.randrange(0, 6)))

    left = [(i, "same" if i % 3 == 0 else name(), rng.choice("xy")) for i in range(60)]
    right = [(i, "sane" if i % 3 == 0 else name(), rng.choice("xy")) for i in range(60)]
    expected = []
    for i, a, c in left:
        fits = [(levenshtein(a, b), j) for j, b, d in right
                if d == c and levenshtein(a, b) <= edits]
        if fits:
            expected.append((i, min(fits)[1], min(fits)[0]))
    schema = "id int, name string, city string"
    got = matching.propose_matches(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), edits)
    assert rows(got, "left_id", "right_id", "distance") == sorted(expected, key=repr)


@pytest.mark.parametrize("edits", [1, 2])
def test_variants_are_all_texts_left_once(spark, edits):
    for text in ("", "a", "aab", "abab", "éaaé"):
        left = {text}
        for _ in range(edits):
            left |= {t[:i] + t[i + 1:] for t in left for i in range(len(t))}
        found = [r.v for r in matching.with_variants(spark.createDataFrame([(text,)], "t string"), "t", edits).collect()]
        assert set(found) == left
        assert edits == 2 or len(found) == len(left)


def test_matches_of_sides_that_differ_by_one_join(spark):
    rng = random.Random(3)
    table = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 5))), "x", rng.choice("pqr")) for i in range(80)]
    table += [(100 + i, "long name", "x", "p") for i in range(20)] + [(200, None, "x", "q"), (201, "a", None, "r"), (202, "a", "x", None)]
    expected = []
    for i, a, c, s in table:
        fits = [(levenshtein(a, b), j) for j, b, d, o in table
                if None not in (a, b, c, d, s, o) and c == d and s != o and levenshtein(a, b) <= 1]
        if fits:
            expected.append((i, min(fits)[1], min(fits)[0]))
    df = spark.createDataFrame(table, "id int, name string, city string, system string")
    got = matching.propose_matches(df, df, apart="system")
    assert rows(got, "left_id", "right_id", "distance") == sorted(expected, key=repr)
    # all sides spell their names once: one explode for each end of a pair
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2


# -- metrics ------------------------------------------------------------------


@pytest.fixture
def metric_model(spark):
    revenue = spark.createDataFrame([(1, 7, 10), (1, 7, 20), (2, 8, 5)],
                                    "d int, c int, v int")
    expense = spark.createDataFrame([(1, 3), (1, 4), (3, 9)], "d int, v int")
    return metrics.MetricModel(
        facts={
            "revenue": metrics.Fact(revenue, {"date": "d", "client": "c"},
                                    {"amount": F.col("v")}, {"clients": "c"}),
            "expense": metrics.Fact(expense, {"date": "d"}, {"amount": F.col("v")}),
        },
        dimensions={
            "date": metrics.Dimension(
                spark.createDataFrame([(1, "jan"), (2, "feb"), (3, None)],
                                      "k int, month string"), "k", ("month",)),
            "client": metrics.Dimension(
                spark.createDataFrame([(7, "s"), (8, "t")], "k int, segment string"),
                "k", ("segment",)),
        },
        metrics=metrics.FINANCE_METRICS,
    )


def test_no_fan_out_across_facts(metric_model):
    got = metric_model.query(["total_revenue", "total_expenses", "net_income"], ["month"])
    assert [(m, int(a), int(b), int(c)) for m, a, b, c in rows(got)] == [
        ("feb", 5, 0, 5), ("jan", 30, 7, 23), (None, 0, 9, -9)]


def test_metrics_without_dimensions_and_with_filter(metric_model):
    total = metric_model.query(["total_revenue", "total_expenses", "revenue_per_client"])
    assert [float(v) for v in rows(total)[0]] == [35.0, 16.0, 17.5]
    jan = metric_model.query(["total_revenue"], ["segment"], {"month": "jan"})
    assert [(s, int(v)) for s, v in rows(jan)] == [("s", 30)]


def test_unreachable_dimension_is_refused(metric_model):
    with pytest.raises(ValueError):
        metric_model.query(["net_income"], ["segment"])
