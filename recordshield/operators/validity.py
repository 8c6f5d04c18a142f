"""Validity filters: each returns the bad rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_term
from ..session import store
from .notes import mask_dictionary

Validator = Callable[[DataFrame], DataFrame]


def bad_rows(df: DataFrame, bad: Column) -> DataFrame:
    return df.where(bad)


def validate_all(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Bad rows per check, counted in one pass: (check, bad_rows)."""
    counted = df.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("bad_rows")) for n in checks])
    return counted.select(F.explode(pairs).alias("r")).select("r.*")


def without_partner(df: DataFrame, other: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Completeness: rows nothing refers to, such as a patient without a visit."""
    side = other.select(F.col(right_on).alias("__k"))
    return df.join(side, df[left_on] == side["__k"], "left_anti")


def missing_fields(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Rows with at least one empty field, with the list of them."""
    empty = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns]
    listed = df.select(key, F.array_join(F.array_compact(F.array(*empty)), ",").alias("missing"))
    return listed.where(F.col("missing") != "")


def outliers(df: DataFrame, column: str, by: Sequence[str], deviations: float = 3.0) -> DataFrame:
    """Rows further from the mean of their group than so many standard deviations. The group figures are joined back."""
    figures = df.groupBy(*by).agg(F.avg(column).alias("__mean"), F.stddev(column).alias("__sd"))
    far = F.abs(F.col(column) - F.col("__mean")) > F.lit(deviations) * F.col("__sd")
    return df.join(figures, list(by)).where(far).drop("__mean", "__sd")


def events_per_month(df: DataFrame, patient: str, at: str) -> DataFrame:
    return df.groupBy(patient, F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("events"))


def contradictions(df: DataFrame, rules: Sequence[tuple[str, str, str, Sequence[str]]]) -> DataFrame:
    """(attribute, value, code column, codes that this value excludes): rows that break a rule."""
    broken = F.lit(False)
    for attribute, value, code, excluded in rules:
        broken = broken | F.coalesce((F.lower(attribute) == value) & F.col(code).isin(list(excluded)), F.lit(False))
    return df.where(broken)


def standardise_terms(notes: DataFrame, note_id: str, text: str, terminology: DataFrame, most: int | None = None) -> DataFrame:
    """Known terms in cleaned text replaced by their standard display.

    ``terminology``: (term, code, display, priority); of several systems the least priority wins.
    """
    known = terminology.select(clean_term("term").alias("value"), "display", "priority").where(F.col("value") != "")
    best = known.groupBy("value").agg(F.min_by("display", "priority").alias("mask"))
    # written once: the look-up and the masking both read it
    cleaned = store(notes.withColumn(text, clean_term(text)), "cleaned")
    return mask_dictionary(cleaned, note_id, text, best, most)


def standard_codes(terms: DataFrame, column: str, terminology: DataFrame) -> DataFrame:
    """Each term with code and display, by cleaned text; unknown terms get nulls."""
    known = terminology.select(clean_term("term").alias("__t"), F.struct("priority", "code", "display").alias("s"))
    best = known.where(F.col("__t") != "").groupBy("__t").agg(F.min("s").alias("s"))
    keyed = terms.withColumn("__t", clean_term(column))
    return keyed.join(best, "__t", "left").select(*terms.columns, F.col("s.code").alias("code"), F.col("s.display").alias("display"))
