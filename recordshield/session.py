"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}


def build_session(app: str = "recordshield", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RECORDSHIELD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-master session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="recordshield-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/recordshield/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends in files that survive lost executors."""
    return store_at(df, label)[0]


def once(df: DataFrame, label: str) -> DataFrame:
    """A frame that several steps read: written by ``store``, unless it is a scan that costs less to read again than to write."""
    return df if is_scan(df) else store(df, label)


def is_scan(df: DataFrame) -> bool:
    """Whether a frame only picks from files, row by row: no exchange, no subquery, nothing that differs from one reading to the next."""
    if df.isStreaming:
        return False
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic() or not plan.subqueriesAll().isEmpty():
        return False
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def store_at(df: DataFrame, label: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """As ``store``, with the path, for frames of a loop that :func:`discard` removes once the next round is written."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch that nothing reads any more; only paths below the scratch folder are taken."""
    root = f"{scratch_folder(spark)}/recordshield/"
    for path in paths:
        if not path.startswith(root) or ".." in path:
            raise ValueError(f"{path} is no scratch of this library")
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
