"""Count checks and column checks: nothing leaked, nothing lost."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import CHECKS, all_hold, sure
from ..functions.dates import parse_date
from ..functions.patterns import NOTE_DATE, QC_REASONS
from ..functions.text import ANY_CASE, LEFT_EDGE, WORD_END, values_pattern


# --- expected ignored rows --------------------------------------------------------------------------------------------


def ignored_direct(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Rows whose id is not in the map; a null id counts as ignored."""
    side = known.select(F.col(known_column).alias("__k"))
    return df.join(side, df[column] == side["__k"], "left_anti").agg(F.count(F.lit(1)).alias("ignored_rows"))


def ignored_via_hop(
    df: DataFrame, row_id: str, column: str, hops: Sequence[tuple[DataFrame, str, str]], known: DataFrame, known_column: str
) -> DataFrame:
    """Distinct rows that reach a patient over one hop or a chain, when that patient is not in the map.

    Rows whose reference cannot be followed are not counted.
    """
    at = df.where(F.col(column).isNotNull()).select(row_id, F.col(column).alias("__at"))
    for table, key, nxt in hops:
        # distinct pairs: a key that repeats on both sides must not multiply
        step = table.select(F.col(key).alias("__k"), F.col(nxt).alias("__next")).dropna().distinct()
        at = at.join(step, at["__at"] == step["__k"], "inner").select(row_id, F.col("__next").alias("__at"))
    reached = at.where(F.col("__at").isNotNull())
    side = known.select(F.col(known_column).alias("__k"))
    lost = reached.join(side, reached["__at"] == side["__k"], "left_anti")
    return lost.agg(F.count_distinct(row_id).alias("ignored_rows"))


@dataclass(frozen=True)
class IgnoreSpec:
    """How to count expected ignored rows of a table: direct, or over hops [(table, key, next)]."""

    column: str
    hops: tuple = ()
    row_id: str | None = None


def choose_strategy(df: DataFrame, spec: IgnoreSpec | None, preferred: Sequence[str]) -> tuple[str, IgnoreSpec | None]:
    """The given spec, else the first preferred column that is there and not all null, else not available."""
    if spec is not None:
        return ("hop" if spec.hops else "direct"), spec
    for column in preferred:
        if column in df.columns and not df.where(F.col(column).isNotNull()).select(column).limit(1).isEmpty():
            return "direct", IgnoreSpec(column)
    return "not available", None


def count_qc(table: str, before: DataFrame, after: DataFrame, ignored: DataFrame) -> DataFrame:
    """Before, after, difference, expected ignored and status of one table; an empty table gives no row."""
    b = before.agg(F.count(F.lit(1)).alias("before_rows")).withColumn("table_name", F.lit(table))
    a = after.agg(F.count(F.lit(1)).alias("after_rows")).withColumn("table_name", F.lit(table))
    joined = b.join(a, "table_name").join(ignored.withColumn("table_name", F.lit(table)), "table_name")
    diff = F.col("before_rows") - F.col("after_rows")
    status = (
        F.when(diff == F.col("ignored_rows"), "PASS")
        .when((diff > 0) & (F.col("ignored_rows") > 0), "NEED_TO_CHECK")
        .otherwise("FAILED")
    )
    return joined.where(F.col("before_rows") > 0).select(
        "table_name", "before_rows", "after_rows", diff.alias("diff"), "ignored_rows", status.alias("status")
    )


# --- column checks ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnCheck:
    column: str
    rule: str
    params: dict[str, Any] = field(default_factory=dict)


def _parts(check: ColumnCheck) -> dict[int, Column]:
    return CHECKS[check.rule](F.col(f"{check.column}_after"), F.col(f"{check.column}_before"), **check.params)


def check_columns(pairs: DataFrame, checks: Sequence[ColumnCheck], table: str) -> DataFrame:
    """All checks of a table in one pass over the paired rows ``<column>_before``, ``<column>_after``."""
    aggregates, rows = [], []
    for i, check in enumerate(checks):
        parts = _parts(check)
        good = all_hold(parts)
        aggregates += [F.count_if(good).alias(f"__p{i}"), F.count_if(~good).alias(f"__f{i}")]
        aggregates += [F.count_if(~part).alias(f"__f{i}_{code}") for code, part in parts.items()]
        reasons = F.array(*[F.when(F.col(f"__f{i}_{code}") > 0, F.lit(QC_REASONS.get(code, str(code)))) for code in parts])
        rows.append(
            F.struct(
                F.lit(check.column).alias("column_name"),
                F.lit(check.rule).alias("rule"),
                F.col(f"__p{i}").alias("passed"),
                F.col(f"__f{i}").alias("failed"),
                F.array_compact(reasons).alias("reasons"),
            )
        )
    counted = pairs.agg(*aggregates)
    return counted.select(F.lit(table).alias("table_name"), F.explode(F.array(*rows)).alias("r")).select("table_name", "r.*")


def failing_rows(pairs: DataFrame, check: ColumnCheck, row_id: str) -> DataFrame:
    return pairs.where(~all_hold(_parts(check))).select(F.lit(check.column).alias("column_name"), row_id)


# --- text checks ------------------------------------------------------------------------------------------------------


def leaked_values(text: str | Column, terms: str | Column) -> Column:
    """The values of the person that still stand in the text, as whole words in any case."""
    body = F.col(text) if isinstance(text, str) else text
    terms = F.col(terms) if isinstance(terms, str) else terms
    left = F.filter(terms, lambda t: F.rlike(body, values_pattern(F.array(t["value"]))))
    return F.coalesce(F.transform(left, lambda t: t["value"]), F.array().cast("array<string>"))


def text_dates_follow(before: str, after: str, days: str | Column | int, dob: str | None = None) -> Column:
    """Date by date, the text after must be the text before moved by the signed offset; the date of birth must be gone."""
    offset = F.lit(days) if isinstance(days, int) else (F.col(days) if isinstance(days, str) else days)

    def found(c: str) -> Column:
        raw = F.regexp_extract_all(F.col(c), F.lit(NOTE_DATE), F.lit(0))
        return F.filter(F.transform(raw, lambda d: parse_date(d).cast("date")), lambda d: d.isNotNull())

    b, a = found(before), found(after)
    if dob:
        b = F.filter(b, lambda d: ~sure(d == F.col(dob).cast("date")))
    moved = F.zip_with(b, a, lambda x, y: sure(F.datediff(y, x) == offset))
    return (F.size(b) == F.size(a)) & F.forall(moved, lambda ok: ok)


def occurrences(text: str | Column, word: str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    quoted = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in word)
    return F.size(F.split(text, f"{ANY_CASE}{LEFT_EDGE}{quoted}{WORD_END}", -1)) - 1


def replacement_done(before: str, after: str, old: str, new: str) -> Column:
    """The old word is gone and the new one stands at least as often as the old one did."""
    return sure((occurrences(after, old) == 0) & (occurrences(after, new) >= occurrences(before, old)))


def text_verdict(rows: DataFrame, checks: dict[str, Column], table: str, column: str) -> DataFrame:
    """Failing rows are counted one by one, per reason and in all."""
    flags = [~sure(ok) for ok in checks.values()]
    any_failed = reduce(lambda a, b: a | b, flags)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_failed).alias("failed"),
        *[F.count_if(f).alias(f"failed_{name}") for name, f in zip(checks, flags)],
    ).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "*")
