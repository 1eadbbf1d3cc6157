"""Role-dependent masking.  The role is known when the view is built, so each
mask is a plain expression over the column and stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles and what each may see.
OPS, COMPLIANCE, EXECUTIVE, ANALYST, SERVICE = (
    "OPS", "COMPLIANCE", "EXECUTIVE", "ANALYST", "SERVICE",
)
UNMASKED_ROLES = {
    "name": {OPS, COMPLIANCE},
    "ssn": {COMPLIANCE},
    "account": {OPS, COMPLIANCE},
    "email": {OPS, COMPLIANCE},
    "phone": {OPS, COMPLIANCE},
}


def mask_name(value: Column) -> Column:
    """First character kept, later ASCII letters starred."""
    rest = F.substring(value, F.lit(2), F.length(value))
    return F.concat(F.left(value, F.lit(1)), F.regexp_replace(rest, "[A-Za-z]", "*"))


def mask_ssn(value: Column) -> Column:
    """Last four digits kept."""
    digits = F.replace(value, F.lit("-"), F.lit(""))
    return F.concat(F.lit("***-**-"), F.right(digits, F.lit(4)))


def mask_account(value: Column) -> Column:
    """Last four characters kept, one star for each other."""
    hidden = F.greatest(F.length(value) - 4, F.lit(0))
    return F.concat(F.repeat(F.lit("*"), hidden), F.right(value, F.lit(4)))


def mask_email(value: Column) -> Column:
    """First character kept."""
    return F.concat(F.left(value, F.lit(1)), F.lit("***@***.com"))


def mask_phone(value: Column) -> Column:
    """Last four digits kept."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))


MASKS = {
    "name": mask_name,
    "ssn": mask_ssn,
    "account": mask_account,
    "email": mask_email,
    "phone": mask_phone,
}


def masked(kind: str, value: Column, role: str) -> Column:
    """The value as ``role`` may see it; nulls stay null."""
    return value if role in UNMASKED_ROLES[kind] else MASKS[kind](value)
