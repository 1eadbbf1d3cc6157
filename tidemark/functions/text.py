"""Text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_address(address: Column) -> Column:
    """Drop trailing commas, then surrounding blanks."""
    return F.trim(F.rtrim(address, F.lit(",")))


def suffix_after_last(value: Column, separator: str = "_") -> Column:
    """Text after the last separator; the whole text when there is none."""
    return F.substring_index(value, separator, -1)


def owned_by_suffix(name: Column, suffix: str) -> Column:
    """Names ending in, or containing, ``?suffix``.

    The underscore is a LIKE wildcard here, as in the queries this serves:
    any one character may stand before (and after) the suffix.
    """
    return name.like(f"%_{suffix}") | name.like(f"%_{suffix}_%")


def name_matches_any(value: Column, patterns: list[str]) -> Column:
    """Case-insensitive LIKE against any of the patterns."""
    return reduce(lambda a, b: a | b, [value.ilike(p) for p in patterns])


def map_values(value: Column, mapping: dict, default: Column | None = None) -> Column:
    """Simple CASE: replace listed values, else ``default`` (null if omitted)."""
    if not mapping:
        return default if default is not None else F.lit(None)
    branches = None
    for source, target in mapping.items():
        hit = value == F.lit(source)
        branches = (
            F.when(hit, F.lit(target))
            if branches is None
            else branches.when(hit, F.lit(target))
        )
    return branches if default is None else branches.otherwise(default)


def first_matching_pattern(value: Column, mapping: dict, default: Column) -> Column:
    """Searched CASE: the label of the first case-insensitive pattern that fits."""
    branches = None
    for pattern, label in mapping.items():
        hit = value.ilike(pattern)
        branches = (
            F.when(hit, F.lit(label))
            if branches is None
            else branches.when(hit, F.lit(label))
        )
    return branches.otherwise(default)


def padded_code(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` followed by the zero-padded number."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def normalised_name(value: Column) -> Column:
    """Lower case, runs of anything but letters and digits turned to one blank."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))
