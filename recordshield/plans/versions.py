"""Versioned tables on plain parquet that never rewrite closed versions: as whole copies, or in buckets of keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import one_per_key
from ..operators.numbering import number_rows
from ..session import store
from ..sources.sink import path_exists


@dataclass(frozen=True)
class VersionedTable:
    """``current/run=<n>`` holds the active row of each key as of a run, ``closed/run=<n>`` the rows that run replaced.

    A merge reads the newest ``current`` before its run, writes its own two partitions and touches nothing else, so a rerun
    of a run replaces exactly what it wrote. Closed rows, the bulk of a long history, are never read by a merge. ``ids/run=<n>``
    holds the highest row id given so far, so that no id is given twice, whatever later runs bring. A null key is a key.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: str = "last_updated"

    def runs(self) -> list[int]:
        folder = f"{self.path}/current"
        if not path_exists(self.spark, folder):
            return []
        # run numbers come from the folder names; retention keeps them few
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        statuses = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(jpath)
        names = [s.getPath().getName() for s in statuses]
        done = [n for n in names if n.startswith("run=") and path_exists(self.spark, f"{folder}/{n}/_SUCCESS")]
        return sorted(int(n.removeprefix("run=")) for n in done)

    def current(self, before: int | None = None) -> DataFrame | None:
        runs = [r for r in self.runs() if before is None or r < before]
        return self.spark.read.parquet(f"{self.path}/current/run={runs[-1]}") if runs else None

    def merge(self, increment: DataFrame, run: int) -> None:
        """One row per key of the increment becomes active; all its other rows go to the closed side."""
        before = self.current(before=run)
        top = self._highest_id(before=run)
        numbered = number_rows(increment, [*self.keys, self.order], start=top + 1)
        newest = [F.col(self.order).desc_nulls_last(), F.col("row_id").desc()]
        if before is None:
            active = one_per_key(numbered, list(self.keys), newest)
            closed = numbered.join(active.select("row_id"), "row_id", "left_anti")
        else:
            touched = numbered.select(*[F.col(k).alias(f"__{k}") for k in self.keys]).distinct()
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys])
            rest = before.join(touched, same, "left_anti")
            replaced = before.join(touched, same, "left_semi")
            versions = replaced.unionByName(numbered, allowMissingColumns=True)
            winners = store(one_per_key(versions, list(self.keys), newest), "winners")
            closed = versions.join(winners.select("row_id"), "row_id", "left_anti")
            active = rest.unionByName(winners, allowMissingColumns=True)
        highest = int(numbered.agg(F.max("row_id")).first()[0] or top)
        self.spark.createDataFrame([(highest,)], "highest bigint").write.mode("overwrite").parquet(f"{self.path}/ids/run={run}")
        closed.write.mode("overwrite").parquet(f"{self.path}/closed/run={run}")
        active.write.mode("overwrite").parquet(f"{self.path}/current/run={run}")

    def _highest_id(self, before: int) -> int:
        runs = [r for r in self.runs() if r < before]
        return self.spark.read.parquet(f"{self.path}/ids/run={runs[-1]}").first()["highest"] if runs else 0

    def retain(self, copies: int) -> None:
        """Remove all but the newest ``copies`` of ``current``. Closed rows and ids stay; older runs can then not be run again."""
        for run in self.runs()[: -max(copies, 1)]:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current/run={run}")
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)

    def history(self) -> DataFrame:
        """All versions with their flag."""
        closed = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/closed")
        closed = closed.where(F.col("run") <= max(self.runs())).drop("run").withColumn("active_flag", F.lit("N"))
        return self.current().withColumn("active_flag", F.lit("Y")).unionByName(closed, allowMissingColumns=True)


@dataclass(frozen=True)
class BucketedTable:
    """A versioned table whose active rows lie in buckets by the hash of their key; a merge writes the buckets its keys fall into and no other.

    ``current/run=<n>/bucket=<b>`` holds the active rows of a bucket as of the run that last touched it, ``places/run=<n>`` which run that is for every bucket,
    written last: a run without it has not happened. ``closed/run=<n>`` and ``ids/run=<n>`` are as in :class:`VersionedTable`. Folders of other runs are
    never changed, so a rerun replaces exactly what it wrote, and files of untouched buckets stay as they are. A null key is a key.

    The work of a merge is bounded by the increment and the buckets it touches: choose ``buckets`` so that one bucket is a fair task.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: str = "last_updated"
    buckets: int = 64

    def runs(self) -> list[int]:
        return sorted(int(n.removeprefix("run=")) for n in _folders(self.spark, f"{self.path}/places") if path_exists(self.spark, f"{self.path}/places/{n}/_SUCCESS"))

    def places(self, before: int | None = None) -> dict[int, int]:
        """The run that holds each bucket; there are at most ``buckets``."""
        runs = [r for r in self.runs() if before is None or r < before]
        return {r["bucket"]: r["held_by"] for r in self.spark.read.parquet(f"{self.path}/places/run={runs[-1]}").collect()} if runs else {}

    def current(self, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """The active rows with their ``bucket``, of some buckets if named."""
        paths = [f"{self.path}/current/run={run}/bucket={b}" for b, run in sorted(self.places(before).items()) if only is None or b in only]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/current").option("mergeSchema", True).parquet(*paths)
        return rows.drop("run")

    def merge(self, increment: DataFrame, run: int) -> set[int]:
        """One row per key of the increment becomes active, all its other rows go to the closed side; returns the buckets written."""
        places = self.places(before=run)
        top = max([0, *[self._highest(r) for r in self.runs() if r < run][-1:]])
        numbered = number_rows(increment, [*self.keys, self.order], start=top + 1)
        fresh = numbered.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        counted = fresh.groupBy("bucket").agg(F.max("row_id").alias("highest")).collect()  # at most `buckets` rows
        touched = {r["bucket"] for r in counted}
        before = self.current(before=run, only=touched)
        versions = fresh if before is None else before.unionByName(fresh, allowMissingColumns=True)
        newest = [F.col(self.order).desc_nulls_last(), F.col("row_id").desc()]
        winners = one_per_key(versions, ["bucket", *self.keys], newest)
        folder = f"{self.path}/current/run={run}"
        winners.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        # from the files just written, so that both sides have the same winners
        written = self.spark.read.parquet(folder).select("row_id") if touched else winners.select("row_id")
        closed = versions.join(written, "row_id", "left_anti").drop("bucket")
        closed.write.mode("overwrite").parquet(f"{self.path}/closed/run={run}")
        highest = max([top, *[r["highest"] for r in counted]])
        self.spark.createDataFrame([(highest,)], "highest bigint").write.mode("overwrite").parquet(f"{self.path}/ids/run={run}")
        rows = sorted({**places, **dict.fromkeys(touched, run)}.items())
        self.spark.createDataFrame(rows, "bucket int, held_by int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/places/run={run}")
        return touched

    def _highest(self, run: int) -> int:
        return self.spark.read.parquet(f"{self.path}/ids/run={run}").first()["highest"]

    def retain(self, copies: int) -> None:
        """Remove the bucket folders that none of the newest ``copies`` runs holds. Closed rows and ids stay; older runs can then not be run again."""
        runs = self.runs()
        kept = {(run, b) for r in runs[-max(copies, 1) :] for b, run in self.places(before=r + 1).items()}
        for run in runs:
            for name in _folders(self.spark, f"{self.path}/current/run={run}"):
                if name.startswith("bucket=") and (run, int(name.removeprefix("bucket="))) not in kept:
                    _remove(self.spark, f"{self.path}/current/run={run}/{name}")
        for run in runs[: -max(copies, 1)]:
            _remove(self.spark, f"{self.path}/places/run={run}")

    def history(self) -> DataFrame:
        """All versions with their flag."""
        closed = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/closed")
        closed = closed.where(F.col("run") <= max(self.runs())).drop("run").withColumn("active_flag", F.lit("N"))
        return self.current().drop("bucket").withColumn("active_flag", F.lit("Y")).unionByName(closed, allowMissingColumns=True)


def _folders(spark: SparkSession, path: str) -> list[str]:
    if not path_exists(spark, path):
        return []
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath) if s.isDirectory()]


def _remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
