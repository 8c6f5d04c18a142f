"""Projections, row and cell rules, reject split."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Condition = tuple[str, str, Any]

PREDICATES: dict[str, Callable[[Column, Any], Column]] = {
    "lt": lambda c, v: c < v,
    "gt": lambda c, v: c > v,
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
}


def condition(rule: Condition) -> Column:
    """(column, operator, value) as a boolean that is false, never null, when the cell is null."""
    column, op, value = rule
    return F.coalesce(PREDICATES[op.lower()](F.col(column), value), F.lit(False))


def any_or_all(rules: Sequence[Condition], operation: str) -> Column:
    parts = [condition(r) for r in rules]
    return reduce(lambda a, b: a & b, parts) if operation.lower() == "and" else reduce(lambda a, b: a | b, parts)


def ignore_rows(df: DataFrame, rules: Sequence[Condition], operation: str = "or") -> DataFrame:
    """Drop the rows the rules hit."""
    return df.where(~any_or_all(rules, operation)) if rules else df


def ignore_cell(original: Column, masked: Column, rules: Sequence[Condition], operation: str = "and") -> Column:
    """Keep the original value where the rules hit."""
    return F.when(any_or_all(rules, operation), original).otherwise(masked) if rules else masked


def common_columns(left: DataFrame, right: DataFrame, system: Iterable[str] = ()) -> list[str]:
    system = set(system)
    return sorted(c for c in left.columns if c in set(right.columns) and c not in system)


def rename(df: DataFrame, mapping: dict[str, str], keep_others: bool = True) -> DataFrame:
    if keep_others:
        return df.withColumnsRenamed(mapping)
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def with_missing_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Add absent columns as typed nulls: {name: type}."""
    absent = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def stamp(df: DataFrame, column: str, value: Any) -> DataFrame:
    """A literal load date or run time on all rows; always a parameter, never the clock."""
    return df.withColumn(column, F.lit(value))


def stack_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_rejects(
    df: DataFrame, resolved: str, key_columns: Sequence[str], table: str, run: str
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects). A row is rejected when no surrogate was found; a table without key columns rejects none."""
    if not key_columns:
        empty = df.where(F.lit(False))
        return df, _as_reject(empty, table, run)
    missing = F.col(resolved).isNull()
    return df.where(~missing), _as_reject(df.where(missing), table, run)


def _as_reject(df: DataFrame, table: str, run: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(run).alias("run"), F.to_json(F.struct("*")).alias("row_json"))
