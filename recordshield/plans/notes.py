"""Note text from start to end, the steps in their fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import collapse_note
from ..functions.patterns import XML_TAG_MASKS
from ..functions.text import (
    CONTACT_RULES,
    combined_names,
    generic_mask,
    java_replacement,
    mask_combined_names,
    mask_markup,
    mask_regexes,
    replace_words,
)
from ..operators.notes import mask_birth_dates, mask_near_values, mask_patient_values, pii_terms


@dataclass(frozen=True)
class NotesOptions:
    """``masks``: PII column -> mask; ``combine``: (PII columns joined to names, mask); ``dob``: PII column of the birth date."""

    pii: DataFrame | None = None
    masks: Mapping[str, str] = field(default_factory=dict)
    combine: tuple[tuple[str, ...], str] | None = None
    dob: str | None = None
    secondary: Sequence[tuple[DataFrame, Mapping[str, str]]] = ()
    contact_rules: Sequence = tuple(CONTACT_RULES)
    replacements: Sequence[tuple[str, str]] = ()
    tags: Mapping[str, str] = field(default_factory=lambda: XML_TAG_MASKS)
    facilities: Sequence[str] = ()
    fuzzy: bool = False
    limit: int = 200
    patient: str = "sur_patient_id"
    offset: str = "day_offset"


def mask_notes(df: DataFrame, row_id: str, text: str, options: NotesOptions) -> DataFrame:
    """Clean, markup, the person's own values, contact patterns, further PII tables, fixed words, generic patterns."""
    out = df.withColumn(text, mask_markup(collapse_note(text), dict(options.tags)))
    if options.pii is not None:
        out = mask_person(out, row_id, text, options)
    out = out.withColumn(text, mask_regexes(text, options.contact_rules))
    for table, masks in options.secondary:
        out = mask_patient_values(out, row_id, text, pii_terms(table, dict(masks), options.patient), options.patient, options.limit)
    out = out.withColumn(text, replace_words(text, options.replacements))
    return out.withColumn(text, generic_mask(text, days=F.col(options.offset), facilities=options.facilities))


def mask_person(df: DataFrame, row_id: str, text: str, options: NotesOptions) -> DataFrame:
    """The person's own values, their name parts written as one word, near matches, birth dates."""
    values = pii_terms(options.pii, dict(options.masks), options.patient)
    terms = values
    if options.combine:
        # a single name part keeps the mask of its own column
        both = values.withColumn("rank", F.lit(0)).unionByName(joined_names(options).withColumn("rank", F.lit(1)))
        first = both.groupBy(options.patient, F.lower("value").alias("key")).agg(F.min(F.struct("rank", "value", "mask")).alias("t"))
        terms = first.select(options.patient, "t.value", "t.mask")
    out = mask_patient_values(df, row_id, text, terms, options.patient, options.limit)
    if options.fuzzy:
        out = mask_near_values(out, row_id, text, values, options.patient)
    if options.dob:
        births = options.pii.select(options.patient, F.col(options.dob).try_cast("date").alias("dob"))
        out = mask_birth_dates(out, text, births, options.patient)
    return out


def joined_names(options: NotesOptions) -> DataFrame:
    """(patient, value, mask): every ordered join of the person's name parts is a value to mask."""
    parts, mask = options.combine
    names = options.pii.select(options.patient, F.explode(combined_names(parts)).alias("value"))
    return names.withColumn("mask", F.lit(mask))


def mask_row_notes(df: DataFrame, text: str, order: Sequence[str], parts: Sequence[str], mask: str, options: NotesOptions) -> DataFrame:
    """The row-wise variant: name parts stand in the row itself, and the order of the steps is a parameter."""
    steps = {
        "generic": lambda c: generic_mask(c, facilities=options.facilities),
        "pii": lambda c: replace_words(
            mask_combined_names(mask_regexes(c, options.contact_rules), parts, java_replacement(mask)), options.replacements
        ),
        "dates": lambda c: generic_mask(c, days=F.col(options.offset)),
        "xml": lambda c: mask_markup(c, dict(options.tags)),
    }
    column = F.col(text)
    for step in order:
        column = steps[step](column)
    return df.withColumn(text, column)
