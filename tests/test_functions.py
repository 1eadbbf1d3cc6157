from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import masks, money, temporal, text


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "start, end, expected",
    [
        ("2024-01-01 00:00:59", "2024-01-01 00:01:01", 1),
        ("2024-01-01 00:00:00", "2024-01-01 00:00:59", 0),
        ("2023-12-31 23:59:59", "2024-01-01 00:00:00", 1),
        ("2024-03-01 10:00:00", "2024-02-28 10:00:00", -2880),
    ],
)
def test_minute_diff_counts_boundaries(spark, start, end, expected):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    assert one(spark, temporal.minute_diff(a, b)) == expected


def test_day_diff_counts_midnights(spark):
    a = F.lit("2024-01-01 23:59:00").cast("timestamp_ntz")
    b = F.lit("2024-01-02 00:01:00").cast("timestamp_ntz")
    assert one(spark, temporal.day_diff(a, b)) == 1


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2024-05-01T10:00:00Z", "2024-05-01 10:00:00"),
        ("2024-05-01T10:00:00+00:00Z", "2024-05-01 10:00:00"),
        ("2024-05-01T10:00:00+02:00", "2024-05-01 08:00:00"),
        ("2024-05-01T10:00:00.250+02:00", "2024-05-01 08:00:00.25"),
        ("not a time", None),
        (None, None),
    ],
)
def test_parse_instant(spark, value, expected):
    parsed = temporal.parse_instant(F.lit(value).cast("string")).cast("string")
    assert one(spark, parsed) == expected


def test_calendar_keys_and_weekdays(spark):
    friday = F.lit("2024-03-01").cast("date")
    sunday = F.lit("2024-03-03").cast("date")
    assert one(spark, temporal.date_key(friday)) == 20240301
    assert one(spark, temporal.key_to_date(F.lit(20240301))) == date(2024, 3, 1)
    assert one(spark, temporal.iso_weekday(sunday)) == 7
    assert one(spark, temporal.sunday_weekday(sunday)) == 0
    assert one(spark, temporal.month_label(friday)) == "Mar 2024"


def test_local_time_moves_the_day(spark):
    saturday_utc = F.lit("2024-01-06 04:30:00").cast("timestamp_ntz")
    local = temporal.in_zone(saturday_utc, "America/New_York")
    assert one(spark, local) == datetime(2024, 1, 5, 23, 30)


def test_text(spark):
    assert one(spark, text.clean_address(F.lit("Calle 1, ,"))) == "Calle 1,"
    assert one(spark, text.clean_address(F.lit(" Calle 2,,,"))) == "Calle 2"
    assert one(spark, text.suffix_after_last(F.lit("A_USER_33"))) == "33"
    assert one(spark, text.suffix_after_last(F.lit("plain"))) == "plain"
    assert one(spark, text.padded_code("CC-", F.lit(7), 3)) == "CC-007"


@pytest.mark.parametrize(
    "name, owned", [("DB_33", True), ("DBX33", True), ("33", False), ("DB_33_DEV", True),
                    ("DB_3", False), ("DB_330", True)],
)
def test_owned_by_suffix_underscore_is_a_wildcard(spark, name, owned):
    assert one(spark, text.owned_by_suffix(F.lit(name), "33")) is owned


def test_map_values(spark):
    mapped = text.map_values(F.lit("b"), {"a": 1, "b": 2})
    assert one(spark, mapped) == 2
    assert one(spark, text.map_values(F.lit("z"), {"a": 1})) is None
    assert one(spark, text.map_values(F.lit("z"), {"a": 1}, F.lit(9))) == 9


def test_money(spark):
    assert one(spark, money.dollars(F.lit(Decimal("1234567.50")))) == "$1,234,568"
    assert one(spark, money.dollars(F.lit(Decimal("-1234.4")))) == "-$1,234"
    assert one(spark, money.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, money.change_label(F.lit(110), F.lit(100))) == "+10.0% MoM"
    assert one(spark, money.change_label(F.lit(90), F.lit(100))) == "-10.0% MoM"
    assert one(spark, money.monthly_fee(F.lit(12000000), F.lit(100))) == Decimal("10000.00")


def test_hundredths_are_exact(spark):
    # 1.005 * 0.5 style halves: 123.45 * 0.10 = 12.345 rounds up to 12.35.
    price, discount = money.hundredths(F.lit(123.45)), money.hundredths(F.lit(0.9))
    product = money.from_hundredths(money.half_up_hundredths(price * (100 - discount)))
    assert one(spark, product) == Decimal("12.35")
    assert one(spark, money.from_hundredths(money.hundredths(F.lit(-17.29)))) == Decimal(
        "-17.29"
    )


@pytest.mark.parametrize(
    "kind, value, expected",
    [
        ("name", "Jane Doe", "J*** ***"),
        ("name", "Zoë Ärz", "Z*ë Ä**"),
        ("name", "J", "J"),
        ("ssn", "123-45-6789", "***-**-6789"),
        ("account", "12345678", "****5678"),
        ("account", "123", "123"),
        ("email", "ann@x.org", "a***@***.com"),
        ("phone", "(555) 010-5678", "***-***-5678"),
        ("name", None, None),
        ("ssn", None, None),
    ],
)
def test_masks(spark, kind, value, expected):
    column = F.lit(value).cast("string")
    assert one(spark, masks.masked(kind, column, masks.ANALYST)) == expected
    assert one(spark, masks.masked(kind, column, masks.COMPLIANCE)) == value


def test_only_compliance_sees_ssn(spark):
    ssn = F.lit("123-45-6789")
    assert one(spark, masks.masked("ssn", ssn, masks.OPS)) == "***-**-6789"
    assert one(spark, masks.masked("name", F.lit("Jane"), masks.OPS)) == "Jane"
