"""Scans: every bound becomes a literal, so that it reaches the file or database scan."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, datetime, time
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import moment
from ..functions.rules import output_type
from ..spec import TableSpec


def incremental_scan(
    source: DataFrame, history: DataFrame | None, column: str, today: date, tenant: tuple[str, Sequence[Any]] | None = None, closed: bool = False
) -> DataFrame:
    """Rows changed since the day of the newest history row (that day is read again) and before today.

    Without history it is a full scan. ``closed`` takes today's midnight in, as an older form of the scan did.
    """
    out = tenant_filter(source, *tenant) if tenant else source
    mark = history.agg(F.max(column)).first()[0] if history is not None else None
    if mark is None:
        return out
    at = F.col(column)
    dtype = source.schema[column].dataType
    low, high = moment(day_start(mark), dtype), moment(day_start(today), dtype)
    return out.where((at > low) & ((at <= high) if closed else (at < high)))


#: Rows of a task whose work is heavy per row.
TASK_ROWS = 25_000


def row_tasks(df: DataFrame) -> int:
    """The tasks for heavy work on each row of a scan: as many as there are cores, and more as its rows grow. Counts the rows, for files by their footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than heavy work on its rows needs (a few large row groups) dealt out, so that no task grows with the table."""
    tasks = row_tasks(df)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def day_start(at: date | datetime) -> datetime:
    return datetime.combine(at.date() if isinstance(at, datetime) else at, time())


def tenant_filter(df: DataFrame, column: str, tenants: Sequence[Any]) -> DataFrame:
    return df.where(F.col(column).isin(list(tenants)))


# fixed values: source types and the types they become; NUMBER(p, s) with s > 0 is DECIMAL(p, s)
SOURCE_TYPES = {
    "BOOLEAN": "boolean",
    "BIT": "boolean",
    "TINYINT": "tinyint",
    "SMALLINT": "smallint",
    "INT": "int",
    "BIGINT": "bigint",
    "FLOAT": "double",
    "REAL": "float",
    "MONEY": "decimal(19,4)",
    "DATE": "date",
    "DATETIME": "timestamp_ntz",
    "DATETIME2": "timestamp_ntz",
    "TIMESTAMP_NTZ": "timestamp_ntz",
    "TIMESTAMP_LTZ": "timestamp",
    "TIMESTAMP_TZ": "timestamp",
    "VARCHAR": "string",
    "NVARCHAR": "string",
    "CHAR": "string",
    "TEXT": "string",
}
NUMBER_WIDTHS = [(3, "tinyint"), (4, "smallint"), (11, "int"), (18, "bigint")]


def target_type(source_type: str) -> str:
    """Unknown types become text. Whole numbers too wide for their integer stay exact as DECIMAL(p, 0)."""
    m = re.match(r"^\s*(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", source_type.upper())
    name, precision, scale = m.group(1), m.group(2), int(m.group(3) or 0)
    if name in ("NUMBER", "DECIMAL", "NUMERIC"):
        p = int(precision or 38)
        if scale > 0:
            return f"decimal({p},{scale})"
        return next((t for width, t in NUMBER_WIDTHS if p <= width), f"decimal({p},0)")
    return SOURCE_TYPES.get(name, "string")


def typed_select(df: DataFrame, source_types: dict[str, str]) -> DataFrame:
    """Columns cast to their target types; text that does not fit gives null."""
    return df.select(*[F.col(c).try_cast(target_type(t)).alias(c) for c, t in source_types.items()])


def id_range(df: DataFrame, id_column: str, low: int, high: int) -> DataFrame:
    """Rows with low <= id < high."""
    return df.where((F.col(id_column) >= low) & (F.col(id_column) <= high - 1))


def read_jdbc_range(spark: SparkSession, options: dict[str, str], id_column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in parallel id ranges; the caller brings url, dbtable and credentials."""
    bounds = {"partitionColumn": id_column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options, **bounds).load()


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Key config CSV (table_name, primary_key with ``a|b``) as (table_name, key_columns array)."""
    raw = spark.read.option("header", True).schema("table_name string, primary_key string").csv(path)
    return parse_keys(raw)


def parse_keys(raw: DataFrame) -> DataFrame:
    parts = F.filter(F.transform(F.split("primary_key", r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return raw.select(F.trim("table_name").alias("table_name"), parts.alias("key_columns")).where(F.size("key_columns") > 0)


def rule_sheet(raw: DataFrame) -> DataFrame:
    """Sheet rows (table_name, column_name, is_phi, rule, mask_value) to one nested config per table."""
    one = F.struct(
        "column_name",
        (F.lower(F.trim("is_phi")) == "yes").alias("is_phi"),
        F.upper(F.trim("rule")).alias("rule"),
        F.nullif(F.trim("mask_value"), F.lit("")).alias("mask_value"),
    )
    return raw.groupBy("table_name").agg(
        F.sort_array(F.collect_set(one)).alias("columns_details"), F.count_if(F.lower(F.trim("is_phi")) == "yes").alias("phi_columns")
    )


def typed_for_rules(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Masked columns in the type their rule gives them in the target table; the others as they are."""
    types = {r.column: output_type(r.rule) for r in spec.phi_rules}
    return df.select(
        *[
            F.col(c).try_cast(types[c]).alias(c) if types.get(c) and df.schema[c].dataType.simpleString() != types[c] else F.col(c)
            for c in df.columns
        ]
    )


def without_range(df: DataFrame, id_column: str, low: int, high: int) -> DataFrame:
    """All rows but those of an id range, null ids included, so that a range can be written again."""
    inside = (F.col(id_column) >= low) & (F.col(id_column) < high)
    return df.where(~F.coalesce(inside, F.lit(False)))


def match_tables(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested table names against existing ones, any case: (requested, found_name, found)."""
    joined = requested.join(existing, F.upper("requested") == F.upper("found_name"), "left")
    return joined.withColumn("found", F.col("found_name").isNotNull())


def table_sets(increment: DataFrame, history: DataFrame) -> DataFrame:
    """(table_name, membership): common, increment only or remaining; names compared in lower case."""
    i = increment.select(F.lower("table_name").alias("table_name")).distinct()
    h = history.select(F.lower("table_name").alias("table_name")).distinct()
    return (
        i.intersect(h)
        .withColumn("membership", F.lit("common"))
        .unionByName(i.subtract(h).withColumn("membership", F.lit("increment only")))
        .unionByName(h.subtract(i).withColumn("membership", F.lit("remaining")))
    )


def copy_filtered(df: DataFrame, condition: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    out = df.where(condition) if condition is not None else df
    return out.select(*columns) if columns else out


def newest_runs(runs: DataFrame, run: str, keep: int) -> DataFrame:
    """Distinct runs with a keep flag on the newest ``keep``; runs are few, rows were reduced before the ranking."""
    distinct = runs.select(run).distinct()
    rank = F.dense_rank().over(W.orderBy(F.col(run).desc()))
    return distinct.withColumn("rank", rank).select(run, (F.col("rank") <= keep).alias("keep"))


def since_mark(history: DataFrame, processed: DataFrame | None, column: str = "extracted_date") -> DataFrame:
    """Rows newer than the mark of the processed layer. No mark: all rows; with a mark, rows without a date are left out."""
    mark = processed.agg(F.max(column)).first()[0] if processed is not None else None
    return history if mark is None else history.where(F.col(column) > moment(mark, history.schema[column].dataType))


def image_inventory(headers: DataFrame, levels: dict[str, Sequence[str]], path: str) -> DataFrame:
    """One row per series with the number of files and a sample path; counts of the levels above."""
    patient, study, series = (list(levels[k]) for k in ("patient", "study", "series"))
    per_series = headers.groupBy(*patient, *study, *series).agg(F.count(F.lit(1)).alias("files"), F.min(path).alias("first_path"))
    return per_series.groupBy(*patient).agg(
        F.count_distinct(*[F.col(c) for c in study]).alias("studies"),
        F.count(F.lit(1)).alias("series"),
        F.sum("files").alias("files"),
        F.min("first_path").alias("first_path"),
    )
