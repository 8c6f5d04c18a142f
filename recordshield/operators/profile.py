"""Column profiles and the masking rules they suggest."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import normalise_id
from ..functions.dates import parse_date
from .reports import union_all

# fixed values
OVERLAP_THRESHOLD = 0.7
DATE_SHARE = 0.5
FIRST_YEAR = 1800
NOTE_LENGTH = 200


def type_family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.StringType):
        return "string"
    return "other"


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, family) from the schemas; no data is read."""
    rows = [(t, f.name, f.dataType.simpleString(), type_family(f.dataType)) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, family string")


def value_overlap(df: DataFrame, table: str, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Share of the non-null values that are known ids, both sides normalised.

    Values are counted first, so a value that fills a third of the rows is one row of the join.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(normalise_id(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ids = known.select(normalise_id(known_column).alias("v")).distinct().withColumn("hit", F.lit(1))
    joined = counted.join(ids, "v", "left")
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("values"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("hits"),
    ).select(
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        "values",
        "hits",
        F.round(F.try_divide("hits", "values"), 6).alias("overlap"),
    )


def detect_id_columns(
    tables: dict[str, DataFrame], known: dict[str, tuple[DataFrame, str]], name_pattern: str, kind: str, threshold: float = OVERLAP_THRESHOLD
) -> DataFrame:
    """Numeric columns whose name fits and whose values are known ids: one row per (column, identifier kind).

    Names come from the schema, so only columns whose name fits are read. ``kind`` is the rule that a hit suggests;
    ``{kind}`` in it becomes the identifier kind.
    """
    named = re.compile(name_pattern)
    chosen = {
        t: [f.name for f in df.schema.fields if type_family(f.dataType) == "numeric" and named.search(f.name.lower())] for t, df in tables.items()
    }
    chosen = {t: names for t, names in chosen.items() if names}
    kinds = list(known)
    spark = next(iter(tables.values())).sparkSession
    if not chosen or not kinds:
        return spark.createDataFrame([], "table_name string, column_name string, id_kind string, overlap double, proposed_rule string")
    # one scan a table whatever the number of columns and kinds; a value that fills a third of the rows is one row from here on
    stacked = []
    for t, names in chosen.items():
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), normalise_id(c).alias("v"), F.col(c).isNotNull().alias("held")) for c in names])
        held = tables[t].select(F.explode(cells).alias("r")).select(F.lit(t).alias("table_name"), "r.*").where("held")
        stacked.append(held.groupBy("table_name", "column_name", "v").agg(F.count(F.lit(1)).alias("n")))
    ids = union_all([df.select(normalise_id(c).alias("v"), F.lit(k).alias("id_kind")) for k, (df, c) in known.items()])
    marks = [F.max(F.when(F.col("id_kind") == k, 1).otherwise(0)).alias(f"k{i}") for i, k in enumerate(kinds)]
    joined = union_all(stacked).join(ids.groupBy("v").agg(*marks), "v", "left")
    hits = [F.sum(F.when(F.col(f"k{i}") == 1, F.col("n")).otherwise(0)).alias(f"h{i}") for i in range(len(kinds))]
    counted = joined.groupBy("table_name", "column_name").agg(F.sum("n").alias("values"), *hits)
    # columns without any value have a row, too
    names = spark.createDataFrame([(t, c) for t, cs in chosen.items() for c in cs], "table_name string, column_name string")
    each = F.array(*[F.struct(F.lit(k).alias("id_kind"), F.col(f"h{i}").alias("hits")) for i, k in enumerate(kinds)])
    long = names.join(counted, ["table_name", "column_name"], "left").select("table_name", "column_name", "values", F.explode(each).alias("r"))
    rules = F.create_map(*[F.lit(x) for k in kinds for x in (k, kind.replace("{kind}", k.upper()))])
    overlap = F.round(F.try_divide("r.hits", "values"), 6)
    return long.select(
        "table_name", "column_name", "r.id_kind", overlap.alias("overlap"),
        F.when(F.coalesce(overlap > threshold, F.lit(False)), rules[F.col("r.id_kind")]).alias("proposed_rule"),
    )


def dob_columns(columns: DataFrame) -> DataFrame:
    """A name is one of a birth date if it holds ``dob``, or birth (born) and date in either order."""
    hit = F.lower("column_name").rlike("dob|birth.*date|date.*birth|born.*dat|date.*bor")
    return columns.withColumn("is_dob", hit)


def date_share(df: DataFrame, table: str, columns: Sequence[str], as_of: date) -> DataFrame:
    """Per column the share of values that are dates of a plausible year; a date-typed column is one without a look.

    A column whose name speaks of a birth is left to the birth-date rule: it is no date column here.
    """
    parts, aggregates = [], []
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        if type_family(dtype) == "date":
            aggregates += [F.count(c).alias(f"n{i}"), F.count(c).alias(f"d{i}")]
        else:
            year = F.year(parse_date(c))
            aggregates += [F.count(c).alias(f"n{i}"), F.count_if(year.between(FIRST_YEAR, as_of.year)).alias(f"d{i}")]
        share = F.round(F.try_divide(F.col(f"d{i}"), F.col(f"n{i}")), 6)
        birth = any(word in c.lower() for word in ("dob", "birth"))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("values"), share.alias("date_share"), F.lit(birth).alias("birth")))
    return (
        df.agg(*aggregates)
        .select(F.lit(table).alias("table_name"), F.explode(F.array(*parts)).alias("r"))
        .select(
            "table_name", "r.column_name", "r.values", "r.date_share",
            (F.coalesce(F.col("r.date_share") > DATE_SHARE, F.lit(False)) & ~F.col("r.birth")).alias("is_date"),
        )
    )


def zip_columns(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """A postal-code column by name, or when every value has the shape."""
    shape = r"^\d{5}(-\d{4})?$"
    aggregates = [F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]
    aggregates += [F.count_if(F.col(c).cast("string").rlike(shape)).alias(f"z{i}") for i, c in enumerate(columns)]
    parts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.round(F.try_divide(F.col(f"z{i}"), F.col(f"n{i}")), 6).alias("zip_share"),
            F.lit("zip" in c.lower() or "postal" in c.lower()).alias("name_fits"),
        )
        for i, c in enumerate(columns)
    ]
    rows = df.agg(*aggregates).select(F.lit(table).alias("table_name"), F.explode(F.array(*parts)).alias("r")).select("table_name", "r.*")
    return rows.withColumn("is_zip", F.col("name_fits") | F.coalesce(F.col("zip_share") == 1.0, F.lit(False)))


def propose_rules(profile: DataFrame) -> DataFrame:
    """Final rule per column. Input: (table_name, column_name, is_phi, base_rule, confirmed).

    Dates and notes need a person: a table without a confirmed patient or encounter column gets the rule that does without.
    """
    rule = F.upper(F.trim(F.coalesce("base_rule", F.lit(""))))
    owner = (rule.startswith("PATIENT_") | (rule == "ENCOUNTER_ID")) & F.coalesce("confirmed", F.lit(False))
    # the columns of one table are few
    has_owner = F.bool_or(owner).over(W.partitionBy("table_name"))
    final = (
        F.when(~F.col("is_phi"), F.lit(""))
        .when(rule == "DATE_OFFSET", F.when(has_owner, "DATE_OFFSET").otherwise("STATIC_OFFSET"))
        .when(rule == "NOTES", F.when(has_owner, "NOTES").otherwise("GENERIC_NOTES"))
        .otherwise(rule)
    )
    return profile.select("table_name", "column_name", "is_phi", final.alias("rule")).withColumn(
        "mask_value", F.when(F.col("rule") == "MASK", F.col("column_name")).otherwise(F.lit(""))
    )


def reuse_rules(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rules of the latest earlier run of the same table, if the column sets are equal.

    ``current``: (table_name, columns array); ``earlier``: (table_name, run, columns array, config).
    """
    last = earlier.groupBy("table_name").agg(F.max(F.struct("run", "columns", "config")).alias("e"))
    joined = current.join(last, "table_name", "left")
    same = F.array_sort(F.col("columns")) == F.array_sort(F.col("e.columns"))
    status = F.when(F.col("e").isNull(), "new table").when(same, "reused").otherwise("column mismatch")
    return joined.select("table_name", status.alias("status"), F.when(same, F.col("e.config")).alias("config"))


def classification_summary(profile: DataFrame) -> DataFrame:
    """Columns, PHI columns, share and confirmed columns per table."""
    return profile.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if("is_phi").alias("phi_columns"),
        F.round(F.try_divide(F.count_if("is_phi"), F.count(F.lit(1))), 6).alias("phi_share"),
        F.count_if(F.coalesce("confirmed", F.lit(False))).alias("confirmed_columns"),
    )


def value_sample(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """``n`` values for a look, the same ones at every run: those whose digests are least."""
    return df.where(F.col(column).isNotNull()).select(column).orderBy(F.md5(F.col(column).cast("string").cast("binary")), column).limit(n)
