"""Money and ratio expressions.  Sums run on decimals: order does not matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: Column) -> Column:
    """Two decimal places, half up."""
    return value.cast("decimal(18,2)")


def cents(value: Column) -> Column:
    """A double holding a two-place amount, made exact before any arithmetic."""
    return value.cast("decimal(12,2)")


def hundredths(value: Column) -> Column:
    """A two-place amount held in a double, as a whole number of hundredths.

    Integer arithmetic is exact and far cheaper than going through decimals.
    """
    return F.floor(value * 100 + 0.5)


def from_hundredths(count: Column) -> Column:
    """Hundredths back to money."""
    unit = F.lit("0.01").cast("decimal(2,2)")
    return money(count.cast("decimal(18,0)") * unit)


def half_up_hundredths(ten_thousandths: Column) -> Column:
    """A non-negative product of two amounts in hundredths, rounded half up."""
    return F.floor((ten_thousandths + 50) / F.lit(100).cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; null when the denominator is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Share in percent, rounded."""
    return F.round(ratio(part, whole) * 100, digits)


def mean(total: Column, count: Column, digits: int) -> Column:
    """Rounded mean from an exact sum and a count."""
    return F.round(ratio(total, count), digits)


def dollars(value: Column) -> Column:
    """Whole dollars with thousands separators, such as ``$1,234``."""
    whole = value.cast("decimal(38,0)")
    return F.concat(
        F.when(whole < 0, F.lit("-")).otherwise(F.lit("")),
        F.lit("$"),
        F.format_number(F.abs(whole), 0),
    )


def one_place(value: Column) -> Column:
    """Text with exactly one decimal place."""
    return F.round(value.cast("double"), 1).cast("decimal(18,1)").cast("string")


def change_label(current: Column, previous: Column) -> Column:
    """Signed month-over-month change, such as ``+3.2% MoM``."""
    sign = F.when(current >= previous, F.lit("+")).otherwise(F.lit(""))
    change = ratio(current - previous, previous) * 100
    return F.concat(sign, one_place(change), F.lit("% MoM"))


def monthly_fee(aum: Column, basis_points: Column) -> Column:
    """Fee accrual: assets times a yearly rate in basis points, one month."""
    yearly = aum.cast("decimal(18,2)") * basis_points.cast("decimal(8,4)")
    return money(yearly / (10000 * 12))
