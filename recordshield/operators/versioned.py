"""A history with one active row per key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import common_columns
from .numbering import next_ids

SYSTEM_COLUMNS = ("row_id", "active_flag", "extracted_date")


def lower_flags(history: DataFrame, increment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``active_flag`` N where the increment brings a new version of the key. Null keys match nothing, as in SQL."""
    hit = increment.select(*keys).dropna(subset=list(keys)).distinct().withColumn("__hit", F.lit(True))
    return (
        history.join(hit, list(keys), "left")
        .withColumn("active_flag", F.when(F.col("__hit"), F.lit("N")).otherwise(F.col("active_flag")))
        .select(*history.columns)
    )


def append_versions(history: DataFrame, increment: DataFrame, system: Sequence[str] = SYSTEM_COLUMNS) -> DataFrame:
    """Increment rows behind the history, as active rows, on the columns both have plus the system columns."""
    shared = common_columns(increment, history, system)
    kept = [c for c in system if c in increment.columns and c != "active_flag"]
    fresh = increment.select(*shared, *kept).withColumn("active_flag", F.lit("Y"))
    return history.unionByName(fresh, allowMissingColumns=True)


def newest_rows(df: DataFrame, keys: Sequence[str], order: str | None = "last_updated", row_id: str = "row_id") -> DataFrame:
    """Row id of the newest version of each key: one ``max_by``, combined before the shuffle."""
    known = df.select(*keys, row_id, *([order] if order else []))
    if not order:
        return known.groupBy(*keys).agg(F.max(row_id).alias(row_id))
    # nulls of the order column come last
    rank = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"), F.col(row_id).alias("id"))
    return known.groupBy(*keys).agg(F.max(rank).alias("__m")).select(*keys, F.col("__m.id").alias(row_id))


def repair_flags(df: DataFrame, keys: Sequence[str], order: str | None = "last_updated", row_id: str = "row_id") -> DataFrame:
    """Exactly one Y per key, on the newest version. Winners are matched by row id, so no key is a hot join key."""
    if order and order not in df.columns:
        order = None
    winners = newest_rows(df, keys, order, row_id).select(F.col(row_id).alias("__w"))
    return (
        df.join(winners, df[row_id] == winners["__w"], "left")
        .withColumn("active_flag", F.when(F.col("__w").isNotNull(), F.lit("Y")).otherwise(F.lit("N")))
        .select(*df.columns)
    )


def one_active_check(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Distinct keys against active rows, with a verdict in words."""
    counted = df.agg(
        F.count_distinct(*[F.col(k) for k in keys]).alias("distinct_keys"),
        F.count_if(F.col("active_flag") == "Y").alias("active_rows"),
    )
    gap = F.col("active_rows") - F.col("distinct_keys")
    reason = (
        F.when(gap == 0, F.lit("one active row per key"))
        .when(gap > 0, F.format_string("%d active rows too many", gap))
        .otherwise(F.format_string("%d keys without an active row", -gap))
    )
    return counted.select(
        F.lit(table).alias("table_name"), "distinct_keys", "active_rows", (gap == 0).alias("valid"), reason.alias("reason")
    )


def keys_not_one_active(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stronger check: the keys that do not have exactly one active row, with their count."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count_if(F.col("active_flag") == "Y").alias("active_rows"))
        .where(F.col("active_rows") != 1)
    )


@dataclass(frozen=True)
class MergeResult:
    table: DataFrame
    check: DataFrame


def versioned_merge(
    history: DataFrame,
    increment: DataFrame,
    keys: Sequence[str],
    order: str = "last_updated",
    id_order: Sequence[str] | None = None,
    repair: bool = True,
    table: str = "table",
) -> MergeResult:
    """Flags down, ids on, rows appended, flags repaired, result checked."""
    numbered = next_ids(history, increment, id_order or [*keys, order])
    merged = append_versions(lower_flags(history, increment, keys), numbered)
    if repair:
        merged = repair_flags(merged, keys, order)
    return MergeResult(merged, one_active_check(merged, keys, table))


def merge_dump_difference(main: DataFrame, difference: DataFrame, load_date, row_id: str = "row_id") -> DataFrame:
    """Rows of a dump difference whose id the main table lacks, stamped with a fixed load date, absent columns null."""
    new = difference.join(main.select(row_id), row_id, "left_anti")
    shared = [c for c in main.columns if c in new.columns and c != "extracted_date"]
    return main.unionByName(new.select(*shared).withColumn("extracted_date", F.lit(load_date)), allowMissingColumns=True)
