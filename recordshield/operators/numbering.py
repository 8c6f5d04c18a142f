"""Dense numbers 1..n over a total order, without a window that puts one group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path

_POSITION_BITS = 33


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str = "row_id",
    start: int = 1,
    within: Sequence[str] = (),
) -> DataFrame:
    """``row_number()`` by ``order``, over the whole frame or within the ``within`` columns, starting at ``start``.

    Rows are range-partitioned by (within, order) and sorted, so a group of any size spreads over as many partitions as it
    needs. Each row keeps its partition and its place there; the frame is written once to the shared folder, because the
    bounds of a range partitioning must not be drawn a second time. A second, narrow pass counts the rows of each
    (group, partition) and turns the counts into offsets.

    ``order`` must be total for the numbers to be repeatable. Rows that are equal in it are told apart by a running mark,
    so that even one value in a third of the rows does not end up in one partition.
    """
    spark = df.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(c) for c in within]
    placed = (
        df.withColumn("__mark", F.monotonically_increasing_id())
        .repartitionByRange(*keys, *order, F.col("__mark"))
        .sortWithinPartitions(*keys, *order, "__mark")
        .drop("__mark")
        .select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("__place"),
        )
    )
    path = scratch_path(spark, "numbered")
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)

    runs = stored.groupBy(*within, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__place").alias("__first"))
    # at most one row per partition in a group of this window
    earlier = W.partitionBy(*within).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        *within,
        "__part",
        (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    if within:
        # a hot group lies in many partitions, so the pair (group, partition) is no hot join key
        on = F.col("s.__part") == F.col("r.__part")
        for c in within:
            on = on & F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
        joined = stored.alias("s").join(runs.alias("r"), on, "inner")
        columns = [F.col(f"s.{c}") for c in df.columns]
        place, shift = F.col("s.__place"), F.col("r.__shift")
    else:
        # one row per partition of `stored`: small by construction, whatever the data
        joined = stored.join(F.broadcast(runs), "__part")
        columns = [F.col(c) for c in df.columns]
        place, shift = F.col("__place"), F.col("__shift")
    return joined.select(*columns, (place + shift + F.lit(start)).cast("bigint").alias(name))


def next_ids(history: DataFrame, increment: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """The increment with ids that go on after the highest id of the history."""
    highest = history.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"]
    return number_rows(increment, order, name=name, start=int(highest) + 1)


def id_ranges(df: DataFrame, id_column: str, batch_size: int) -> DataFrame:
    """Dense batches of ``batch_size`` ids as (batch, first_id, last_id, rows); null ids are left out."""
    numbered = number_rows(df.select(id_column).where(F.col(id_column).isNotNull()), [id_column], name="__n")
    return (
        numbered.groupBy(F.floor((F.col("__n") - 1) / F.lit(batch_size)).cast("bigint").alias("batch"))
        .agg(
            F.min(id_column).alias("first_id"),
            F.max(id_column).alias("last_id"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
