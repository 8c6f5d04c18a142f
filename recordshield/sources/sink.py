"""Writers. A run writes its own partition, so a rerun replaces it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import md5_files


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def shaped_for(df: DataFrame, target_columns: Sequence[str], stamp_column: str, stamp) -> DataFrame:
    """Target columns only, plus the run time; NaN becomes null, as a database would hold it."""
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    kept = [
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in target_columns if c in df.columns and c != stamp_column
    ]
    return df.select(*kept, F.lit(stamp).alias(stamp_column))


def append(df: DataFrame, path: str, target_columns: Sequence[str], stamp_column: str, stamp) -> None:
    shaped_for(df, target_columns, stamp_column, stamp).write.mode("append").parquet(path)


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Idempotent: the partition of the run is replaced, others stay."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}")


def snapshot(df: DataFrame, path: str, run: str) -> DataFrame:
    """Copy of a table before it is rewritten; the same run replaces its own copy."""
    write_run(df, path, run)
    return df.sparkSession.read.parquet(f"{path}/run={run}")


def row_width(df: DataFrame) -> float:
    """Mean bytes of a row as plain values: texts by their bytes, nested values as JSON, all else 8. 0 for an empty table."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind.startswith(("array", "map", "struct")):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            parts.append(F.lit(8))
    total = reduce(lambda a, b: a + b, parts, F.lit(0))
    return float(df.agg(F.coalesce(F.avg(total), F.lit(0.0))).first()[0])


def export(
    df: DataFrame, path: str, fmt: str = "parquet", rows_per_file: int = 5_000_000, bytes_per_file: int | None = 1 << 30, header: bool = True
) -> None:
    """One set of files per table, each of at most ``rows_per_file`` rows and about ``bytes_per_file`` bytes.

    The byte limit becomes a limit of rows by the mean width of a row, which one aggregate over the table measures; None leaves it out.
    """
    rows = rows_per_file
    if bytes_per_file is not None:
        rows = max(1, min(rows, int(bytes_per_file / max(row_width(df), 1.0))))
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows)
    (writer.option("header", header).csv(path) if fmt == "csv" else writer.parquet(path))


#: Bytes that one task of a manifest reads, as far as whole files allow.
MANIFEST_BYTES = 256 << 20


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5, bytes) of every data file below a folder; files without a byte are not listed.

    Only names and lengths are listed; the files are dealt over tasks, as many as their bytes ask for, and each task
    hashes its files as streams in chunks, so that a file may be of any size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    data = files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]")).select("path", F.col("length").alias("bytes"))
    size = data.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size["n"], -(-size["bytes"] // MANIFEST_BYTES)))
    return data.repartition(tasks).mapInArrow(md5_files, "path string, md5 string, bytes long")
