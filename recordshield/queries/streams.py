"""Streams, run to the end of the given files; the result table is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.deidentify import Maps
from ..plans.versions import VersionedTable
from ..session import scratch_path
from ..spec import ColumnRule, TableSpec
from ..streaming.changes import ChangeLog
from ..streaming.merge import mask_stream, merge_stream
from .base import PATIENTS_SQL, patients, query, table


def _event_files(spark, sf):
    """The event table as a feed: one file per day, read one file per micro-batch group."""
    path = scratch_path(spark, "feed")
    events = table(spark, sf, "events")
    events.repartition(F.to_date("ts")).write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query(
    "g1_streamed_merge",
    """
SELECT user_id, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'Y' ELSE 'N' END AS active_flag FROM events
""",
)
def g1(spark, sf):
    store = VersionedTable(spark, scratch_path(spark, "stream-versions"), ("user_id",), order="ts")
    merge_stream(_event_files(spark, sf), store, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return store.history().select("user_id", "event_id", "active_flag")


@query(
    "g1_stateful_changes",
    """
SELECT user_id, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'Y' ELSE 'N' END AS active_flag FROM events
""",
)
def g1_changes(spark, sf):
    """All events, each delivered twice and out of order, over several micro-batches."""
    path = scratch_path(spark, "late-feed")
    events = table(spark, sf, "events")
    sent = events.withColumn("turn", F.lit(1)).unionByName(events.withColumn("turn", F.lit(2)))
    sent.repartition(8, "event_id", "turn").drop("turn").write.parquet(path)
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(path)
    log = ChangeLog(spark, scratch_path(spark, "changes"), events.schema, ("user_id",), "ts", "event_id", lanes=4)
    log.follow(feed, scratch_path(spark, "changes-checkpoint")).awaitTermination()
    return log.flags().select("user_id", "event_id", "active_flag")


@query(
    "g2_streamed_masking",
    f"""
WITH pmap AS ({PATIENTS_SQL})
SELECT event_id, ts + to_days(day_offset) AS ts, sur_patient_id AS user_id, '<<TYPE>>' AS event_type, value, props FROM events JOIN pmap ON user_id = custkey
""",
)
def g2(spark, sf):
    rules = (ColumnRule("user_id", "PATIENT_CUSTKEY"), ColumnRule("ts", "DATE_OFFSET"), ColumnRule("event_type", "MASK", "TYPE"))
    masked = mask_stream(_event_files(spark, sf), TableSpec("events", rules), Maps(patients(spark, sf)))
    path = scratch_path(spark, "masked-events")
    writer = masked.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "mask-checkpoint"))
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(masked.schema).parquet(path)
