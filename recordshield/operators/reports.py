"""Counts and comparisons over tables. A report is a DataFrame; nothing runs before it is asked for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_counts(tables: dict[str, DataFrame], flag: str = "active_flag") -> DataFrame:
    """(table_name, total_rows, active_rows); a table without flags counts every row as active."""
    return union_all(
        [
            df.agg(
                F.count(F.lit(1)).alias("total_rows"),
                (F.count_if(F.col(flag) == "Y") if flag in df.columns else F.count(F.lit(1))).alias("active_rows"),
            ).select(F.lit(name).alias("table_name"), "total_rows", "active_rows")
            for name, df in tables.items()
        ]
    )


def table_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(df.columns)).cast("bigint").alias("column_count"),
                F.when(F.col("row_count") > 0, "filled").otherwise("empty").alias("state"),
            )
            for name, df in tables.items()
        ]
    )


def extreme_tables(counts: DataFrame, rows: str = "row_count") -> DataFrame:
    """Largest and smallest table; the name decides between equal counts."""
    sized = F.struct(F.col(rows), F.col("table_name"))
    return counts.agg(F.max(sized).alias("a"), F.min(sized).alias("b")).select(
        F.col("a.table_name").alias("largest"),
        F.col(f"a.{rows}").alias("largest_rows"),
        F.col("b.table_name").alias("smallest"),
        F.col(f"b.{rows}").alias("smallest_rows"),
    )


def distinct_keys(df: DataFrame, keys: Sequence[str], as_text: bool = False) -> DataFrame:
    """Distinct composite keys, rows with a null part skipped; ``as_text`` counts joined texts, which skips null parts only."""
    counted = F.count_distinct(F.concat_ws(",", *keys)) if as_text else F.count_distinct(*[F.col(k) for k in keys])
    return df.agg(counted.alias("distinct_keys"))


def high_water_mark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("mark"))


def id_span(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return union_all(
        [
            df.agg(F.min(c).cast("bigint").alias("first_id"), F.max(c).cast("bigint").alias("last_id")).select(
                F.lit(name).alias("table_name"), "first_id", "last_id"
            )
            for name, (df, c) in tables.items()
        ]
    )


def latest_per_group(df: DataFrame, group: str, created: str, status: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.max(created).alias("last_created"), F.count(F.lit(1)).alias("records"), F.max(status).alias("last_status")
    )


def rolled_status(df: DataFrame, by: Sequence[str], status: str, done: str, running: str, failed: str) -> DataFrame:
    """One state per group: all done, else any running, else any failed, else pending."""
    s = F.col(status)
    return df.groupBy(*by).agg(
        F.when(F.bool_and(s == done), "COMPLETED")
        .when(F.bool_or(s == running), "RUNNING")
        .when(F.bool_or(s == failed), "FAILED")
        .otherwise("PENDING")
        .alias("state")
    )


def status_counts(df: DataFrame, by: str, status: str, values: Sequence[str]) -> DataFrame:
    """Rows per status as columns; the list of statuses is given, so no pass is needed to find them."""
    return df.groupBy(by).pivot(status, list(values)).count().fillna(0, list(values))


def stage_state(counts: DataFrame, by: str, failed: str, completed: str, running: str, interrupted: str) -> DataFrame:
    """Failed before Completed (when nothing else is left) before In Progress before Interrupted before Pending."""
    total = sum((F.col(c) for c in (completed, running, interrupted)), F.lit(0))
    state = (
        F.when(F.col(failed) > 0, "Failed")
        .when((F.col(completed) > 0) & (F.col(completed) == total), "Completed")
        .when(F.col(running) > 0, "In Progress")
        .when(F.col(interrupted) > 0, "Interrupted")
        .otherwise("Pending")
    )
    return counts.select(by, state.alias("stage_state"))


def merge_qc(chunks: DataFrame) -> DataFrame:
    """Chunk results (table, column, passed, failed, reasons) to one row per column. Reasons are joined, not overwritten."""
    return chunks.groupBy("table_name", "column_name").agg(
        F.sum("passed").alias("passed"),
        F.sum("failed").alias("failed"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("reasons")))), "; ").alias("reasons"),
    )


def table_verdict(columns: DataFrame, counts: DataFrame) -> DataFrame:
    """A table passes when source = target + ignored and no column failed. ``counts``: (table_name, source, target, ignored)."""
    clean = columns.groupBy("table_name").agg(F.bool_and(F.col("failed") == 0).alias("columns_clean"))
    balanced = F.col("source_rows") == F.col("target_rows") + F.col("ignored_rows")
    return counts.join(clean, "table_name", "left").select(
        "table_name", "source_rows", "target_rows", "ignored_rows", (balanced & F.coalesce("columns_clean", F.lit(True))).alias("passed")
    )


def key_lists(keys: DataFrame) -> DataFrame:
    """(table_name, column_name) rows to one comma list per table; a table has few key columns."""
    return keys.groupBy("table_name").agg(F.array_join(F.sort_array(F.collect_set("column_name")), ",").alias("key_columns"))


def source_history_report(tables: dict[str, tuple[str, DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table {name: (schema, source, history, keys)} counts and OK or DIFF, with totals per schema and over all."""
    rows = []
    for name, (schema, source, history, keys) in tables.items():
        s = source.agg(F.count(F.lit(1)).alias("source_rows")).withColumn("table_name", F.lit(name))
        h = history.agg(
            F.count(F.lit(1)).alias("history_rows"),
            F.count_if(F.col("active_flag") == "Y").alias("active_rows"),
            F.count_distinct(*[F.col(k) for k in keys]).alias("distinct_keys"),
        ).withColumn("table_name", F.lit(name))
        rows.append(s.join(h, "table_name").withColumn("schema_name", F.lit(schema)))
    flat = union_all(rows)
    sums = [F.sum(c).alias(c) for c in ("source_rows", "history_rows", "active_rows", "distinct_keys")]
    rolled = flat.rollup("schema_name", "table_name").agg(*sums)
    return rolled.select(
        F.coalesce("schema_name", F.lit("TOTAL")).alias("schema_name"),
        F.coalesce("table_name", F.lit("TOTAL")).alias("table_name"),
        "source_rows",
        "history_rows",
        "active_rows",
        "distinct_keys",
        (F.col("source_rows") - F.col("active_rows")).alias("diff"),
        F.when(F.col("source_rows") == F.col("active_rows"), "OK").otherwise("DIFF").alias("verdict"),
    )


def wide_counts(first: DataFrame, second: DataFrame, sites: Sequence[str], labels: tuple[str, str]) -> DataFrame:
    """Counts of two systems, one column per site and system, full outer by table name. Input: (table_name, site, row_count)."""

    def wide(df: DataFrame, label: str) -> DataFrame:
        pivoted = df.groupBy(F.lower("table_name").alias("table_name")).pivot("site", list(sites)).agg(F.sum("row_count"))
        return pivoted.withColumnsRenamed({s: f"{s}_{label}" for s in sites})

    return wide(first, labels[0]).join(wide(second, labels[1]), "table_name", "full")


def structure_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(table_name, row_count, column_count) of two systems; only the unequal rows."""
    other = second.select("table_name", F.col("row_count").alias("other_rows"), F.col("column_count").alias("other_columns"))
    joined = first.join(other, "table_name", "left")
    same = F.col("row_count").eqNullSafe(F.col("other_rows")) & F.col("column_count").eqNullSafe(F.col("other_columns"))
    return joined.where(~same)


def image_overview(headers: DataFrame, levels: dict[str, Sequence[str]], state: str, states: Sequence[str]) -> DataFrame:
    """Distinct counts per level of a header hierarchy and instances per state.

    Levels go from the top down, each with the columns of the one above. Rows are grouped by the lowest level once and its groups
    counted upwards, so no row is multiplied as by several distinct counts. A key with a null in it is not counted.
    """
    names, sums = list(levels), [f"state_{s.lower()}" for s in states]
    if any(not set(levels[a]) <= set(levels[b]) for a, b in zip(names, names[1:])):
        raise ValueError("each level needs the columns of the level above")
    rows = headers.groupBy(*levels[names[-1]]).agg(*[F.count_if(F.col(state) == s).alias(c) for s, c in zip(states, sums)])
    counted: list[str] = []
    for place, level in reversed(list(enumerate(names))):
        if counted:
            rows = rows.groupBy(*levels[level]).agg(*[F.sum(c).alias(c) for c in counted + sums])
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in levels[level]])
        rows = rows.withColumn(f"__{place}", whole.cast("bigint"))
        counted.append(f"__{place}")
    return rows.agg(
        *[F.coalesce(F.sum(f"__{place}"), F.lit(0)).alias(level) for place, level in enumerate(names)],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct()


def running_before(amount: Column, window) -> Column:
    return F.coalesce(F.sum(amount).over(window), F.lit(0))
