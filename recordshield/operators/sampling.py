"""Samples, first-per-key rows, previews. Every random choice is a keyed hash, so a rerun gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import one_per_key, present_rows


def draw(key: str | Column, seed: str) -> Column:
    """A repeatable random order key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))


def sample_size(rows: Column) -> Column:
    """Rows to check for a population; inside a step the middle of its range."""
    n = rows
    return (
        F.when(n <= 300, n)
        .when(n <= 1000, F.lit(400))
        .when(n <= 5000, F.lit(650))
        .when(n <= 10000, F.lit(900))
        .when(n <= 100000, F.least(3000 + F.floor((n - 10000) / 30000) * 1000, F.lit(5000)))
        .otherwise(F.lit(5000))
        .cast("bigint")
    )


def random_sample(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows by hash order: every task keeps its own best n, only those travel."""
    return df.orderBy(draw(key, seed), key).limit(n)


def strata(df: DataFrame, column: str, accuracy: int = 1_000_000) -> Column:
    """Quartile 1..4 of a numeric column (one pass for the bounds), else the value itself."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        q1, q2, q3 = df.agg(F.percentile_approx(column, [0.25, 0.5, 0.75], accuracy).alias("q")).first()["q"] or (0, 0, 0)
        c = F.col(column)
        return F.when(c <= q1, "1").when(c <= q2, "2").when(c <= q3, "3").when(c.isNotNull(), "4")
    return F.col(column).cast("string")


def stratified_sample(df: DataFrame, columns: Sequence[str], per_stratum: int, total: int, key: str, seed: str) -> DataFrame:
    """Up to ``per_stratum`` rows of each stratum of each column, filled up at random to ``total``, cut there."""
    keyed = df.select("*", draw(key, seed).alias("__d"))
    picked = None
    for column in columns:
        ranked = keyed.select(key, "__d", strata(df, column).alias("__s")).where(F.col("__s").isNotNull())
        rank = F.row_number().over(W.partitionBy("__s").orderBy("__d", key))
        rows = ranked.withColumn("__rn", rank).where(F.col("__rn") <= per_stratum).select(key)
        picked = rows if picked is None else picked.unionByName(rows)
    # at most `total` rows can come from the fill, so both key lists are small by construction
    fill = keyed.orderBy("__d", key).limit(total).select(key, F.lit(1).alias("__class"))
    chosen = picked.select(key, F.lit(0).alias("__class")).unionByName(fill).groupBy(key).agg(F.min("__class").alias("__class"))
    chosen = chosen.orderBy("__class", draw(key, seed), key).limit(total).select(key)
    return df.join(chosen, key, "left_semi")


def paired_sample(before: DataFrame, after: DataFrame, key: str, low: int, high: int, n: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The same rows of an id range [low, high) from both sides."""
    in_range = (F.col(key) >= low) & (F.col(key) < high)
    ids = random_sample(before.where(in_range).select(key), n, key, seed)
    return present_rows(before, ids, key, key), present_rows(after, ids, key, key)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return one_per_key(df, keys, order)


def dedup_by_row_id(df: DataFrame, row_id: str, order: Sequence[Column]) -> DataFrame:
    return one_per_key(df, [row_id], order)


def single_row_for(df: DataFrame, key: str, listed: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One row for each listed key, all rows of the others."""
    names = listed.select(F.col(listed.columns[0]).alias("__k"))
    single = one_per_key(df.join(names, df[key] == names["__k"], "left_semi"), [key], order)
    return df.join(names, df[key] == names["__k"], "left_anti").unionByName(single)


def capped_ids(df: DataFrame, by: Sequence[str], id_column: str, cap: int = 25) -> DataFrame:
    """The least ``cap`` failing ids of each group as an array, cut to that size in every task before the shuffle."""
    distinct = df.select(*by, id_column).distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy(id_column))
    kept = distinct.withColumn("__rn", rank).where(F.col("__rn") <= cap)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list(id_column)).alias("failing_ids"))


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)
