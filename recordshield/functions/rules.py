"""Masking rules for structured columns: a registry of name -> (column, context) -> column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import as_col
from .dates import add_days, birth_year, parse_date, shift_column
from .patterns import DEFAULT_STATIC_OFFSET
from .text import generic_mask


@dataclass(frozen=True)
class RuleContext:
    """What a rule may need besides the column itself."""

    dtype: T.DataType = field(default_factory=T.StringType)
    mask: str | None = None
    patient: str = "sur_patient_id"
    encounter: str = "sur_encounter_id"
    appointment: str = "sur_appointment_id"
    offset: str = "day_offset"
    static_days: int = DEFAULT_STATIC_OFFSET
    keep_unmapped: bool = False
    date_format: str | None = None
    options: dict[str, Any] = field(default_factory=dict)

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)


Rule = Callable[[Column, RuleContext], Column]
RULES: dict[str, Rule] = {}
OUTPUT_TYPES: dict[str, str] = {}


def register_rule(name: str, output_type: str | None = None) -> Callable[[Rule], Rule]:
    """Add a rule of your own; ``output_type`` is the type the target table gives the column."""

    def add(rule: Rule) -> Rule:
        RULES[name] = rule
        if output_type:
            OUTPUT_TYPES[name] = output_type
        return rule

    return add


def rule_key(name: str) -> str:
    """Every ``PATIENT_<KIND>`` is the patient rule."""
    upper = name.strip().upper()
    return "PATIENT_ID" if upper.startswith("PATIENT_") else upper


def apply_rule(name: str, column: str | Column, ctx: RuleContext) -> Column:
    key = rule_key(name)
    if key not in RULES:
        raise KeyError(f"unknown masking rule {name!r}; known: {sorted(RULES)}")
    return RULES[key](as_col(column), ctx)


def output_type(name: str) -> str | None:
    return OUTPUT_TYPES.get(rule_key(name))


def _surrogate(resolved: str, c: Column, ctx: RuleContext) -> Column:
    new = F.col(resolved).cast("bigint")
    return F.coalesce(new, c.try_cast("bigint")) if ctx.keep_unmapped else new


@register_rule("PATIENT_ID", "bigint")
def patient_id(c: Column, ctx: RuleContext) -> Column:
    return _surrogate(ctx.patient, c, ctx)


@register_rule("ENCOUNTER_ID", "bigint")
def encounter_id(c: Column, ctx: RuleContext) -> Column:
    return _surrogate(ctx.encounter, c, ctx)


@register_rule("APPOINTMENT_ID", "bigint")
def appointment_id(c: Column, ctx: RuleContext) -> Column:
    return _surrogate(ctx.appointment, c, ctx)


@register_rule("MASK", "string")
def mask(c: Column, ctx: RuleContext) -> Column:
    """The same constant on every row, nulls included, so that not even the presence of a value shows."""
    return F.lit(f"<<{ctx.mask}>>")


@register_rule("DATE_OFFSET", "timestamp_ntz")
def date_offset(c: Column, ctx: RuleContext) -> Column:
    if ctx.date_format:
        stamp = parse_date(c) if ctx.is_text else c
        return F.date_format(add_days(stamp.cast("timestamp_ntz"), ctx.offset), ctx.date_format)
    return shift_column(c, ctx.offset, ctx.is_text)


@register_rule("STATIC_OFFSET", "timestamp_ntz")
def static_offset(c: Column, ctx: RuleContext) -> Column:
    return shift_column(c, ctx.static_days, ctx.is_text)


@register_rule("DOB", "int")
def dob(c: Column, ctx: RuleContext) -> Column:
    return birth_year(c, ctx.is_text)


@register_rule("ZIP_CODE", "string")
def zip_code(c: Column, ctx: RuleContext) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "none"), F.substring(text, 1, 3))


@register_rule("GENERIC_NOTES", "string")
def generic_notes(c: Column, ctx: RuleContext) -> Column:
    return generic_mask(c, days=F.col(ctx.offset) if ctx.options.get("shift_dates", True) else None, **ctx.options.get("generic", {}))
