"""Predicates of the quality checks and of the validity filters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .clean import as_col

# --- is a masked value what its rule should have made of it? (after, before, parameters) -> boolean, never null --------

# a check gives {reason code: the value is right}; it passes when all of them hold
Check = Callable[..., dict[int, Column]]
CHECKS: dict[str, Check] = {}


def register_check(rule: str) -> Callable[[Check], Check]:
    """Add a check of your own for the columns of a rule."""

    def add(check: Check) -> Check:
        CHECKS[rule] = check
        return check

    return add


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@register_check("ZIP_CODE")
def zip_masked(after: Column, before: Column | None = None, **_) -> dict[int, Column]:
    text = F.trim(after.cast("string"))
    return {8: sure(text.isNull() | F.lower(text).isin("none", "null", "nan") | (F.length(text) <= 3))}


@register_check("DOB")
def dob_masked(after: Column, before: Column | None = None, **_) -> dict[int, Column]:
    text = F.trim(after.cast("string"))
    return {6: sure(text.isNull() | (text == "") | text.rlike(r"^\d{4}$"))}


@register_check("STATIC_OFFSET")
def static_shifted(after: Column, before: Column, days: int = P.DEFAULT_STATIC_OFFSET, **_) -> dict[int, Column]:
    return {4: sure(F.datediff(after, before) == F.lit(days))}


@register_check("MASK")
def masked(after: Column, before: Column | None = None, mask: str = "", **_) -> dict[int, Column]:
    return {5: sure(after == F.lit(f"<<{mask}>>"))}


@register_check("DATE_OFFSET")
def patient_shifted(
    after: Column, before: Column, offset: Column | None = None, default: int = P.DEFAULT_STATIC_OFFSET, **_
) -> dict[int, Column]:
    days = F.coalesce(offset, F.lit(default)) if offset is not None else F.lit(default)
    return {7: sure(F.datediff(after, before) == days)}


def _id_shape(after: Column, length: int | None, prefix: str | None) -> dict[int, Column]:
    text = after.cast("string")
    return {
        2: sure(F.length(text) == length) if length else F.lit(True),
        3: sure(text.startswith(prefix)) if prefix else F.lit(True),
    }


@register_check("PATIENT_ID")
def patient_id_shape(after: Column, before: Column | None = None, length: int | None = None, prefix: str | None = None, **_):
    return _id_shape(after, length, prefix)


@register_check("ENCOUNTER_ID")
def encounter_id_shape(after: Column, before: Column | None = None, length: int | None = None, prefix: str | None = None, **_):
    return _id_shape(after, length, prefix)


def all_hold(parts: dict[int, Column]) -> Column:
    out = F.lit(True)
    for part in parts.values():
        out = out & part
    return out


# --- validity of source values: true means the value is bad -----------------------------------------------------------


def _no_match(c: str | Column, pattern: str) -> Column:
    return ~sure(as_col(c).cast("string").rlike(pattern))


def bad_age(dob: str | Column, as_of: date) -> Column:
    age = F.floor(F.datediff(F.lit(as_of), as_col(dob)) / 365)
    return ~sure(age.between(0, 120))


def bad_dob(dob: str | Column, as_of: date) -> Column:
    return ~sure(as_col(dob).try_cast("date") < F.lit(as_of))


def bad_zip(c):
    return _no_match(c, P.VALID_ZIP)


def bad_identifier(c):
    return as_col(c).isNull() | (as_col(c).cast("string") == "")


def bad_icd10(c):
    return _no_match(c, P.VALID_ICD10)


def bad_phone(c):
    return _no_match(c, P.VALID_PHONE)


def bad_email(c):
    return _no_match(c, P.VALID_EMAIL)


def bad_ssn(c):
    return _no_match(c, P.VALID_SSN)


def bad_sex(c):
    return ~sure(F.lower(as_col(c)).isin(*P.VALID_SEX))


def bad_state(c):
    return ~sure(F.upper(as_col(c)).isin(*P.US_STATES))
