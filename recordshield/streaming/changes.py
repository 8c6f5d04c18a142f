"""Changes of the active version of each key, kept as state of the stream.

Nothing but the newest version of a key, two numbers, is state; a micro-batch reads neither the history nor the active rows
again. The stream appends to a log of changes: ``Y`` where a version becomes active, ``N`` where one is replaced or comes
late. A version that was lowered never becomes active again, so the log needs no order: the least flag of a version holds,
and an event that is delivered again changes nothing. No event is dropped, however late it comes.

State is kept per key and lane, lanes being dealt by the event's id, so that a key with a third of all events fills as many
tasks as there are lanes. The newest of a key's lanes is found when the log is read, from at most one active row a lane.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.joins import one_per_key

# the function below travels whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANES = 16
#: Versions without a time are older than all others.
OLDEST = -(1 << 63)
CHANGES = "key string, lane int, at long, id long, change string"
_STATE = "at long, id long"


def newest_so_far(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The changes that the events of one key and lane bring, chunk by chunk; ties in time go to the greater id."""
    top = tuple(state.get) if state.exists else None
    for chunk in chunks:
        # one frame a chunk: groups are many and small, and steps on frames cost more than their rows
        versions = set(zip(chunk["at"].tolist(), chunk["id"].tolist()))
        last = max(versions)
        lowered = versions if top is None else versions | {top}
        if top is None or last > top:
            top, change = last, ["Y"]
        else:
            # the active version, come once more or not, stays as it is
            change = []
        out = [*([top] if change else []), *sorted(lowered - {top})]
        if out:
            at, number = zip(*out)
            flags = change + ["N"] * (len(out) - len(change))
            yield pd.DataFrame({"key": [key[0]] * len(out), "lane": [key[1]] * len(out), "at": at, "id": number, "change": flags})
    state.update(top)


@dataclass(frozen=True)
class ChangeLog:
    """The log at ``path``: versions are told apart by ``order`` (a time or a whole number) and ``event`` (a whole number).

    A null key is a key, a null order is older than all others, and null events of one key and order are one version.
    ``schema`` is that of the events.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: str
    event: str
    lanes: int = LANES

    def _at(self) -> Column:
        at, kind = F.col(self.order), self.schema[self.order].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            at = F.unix_micros(at.cast("timestamp"))
        return F.coalesce(at.cast("bigint"), F.lit(OLDEST))

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Append the changes that the stream brings; a restart goes on from ``checkpoint``, which holds the state."""
        number = F.coalesce(F.col(self.event).cast("bigint"), F.lit(OLDEST))
        lane = F.pmod(F.xxhash64(number), F.lit(self.lanes)).cast("int")
        events = stream.select(F.to_json(F.struct(*self.keys)).alias("key"), lane.alias("lane"), self._at().alias("at"), number.alias("id"))
        changes = events.groupBy("key", "lane").applyInPandasWithState(
            newest_so_far, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout
        )
        writer = changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start(self.path)

    def changes(self) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(self.path)

    def flags(self) -> DataFrame:
        """(keys, ``at``, event, active_flag), one row per version; flags are folded by version, so no key is hot."""
        folded = self.changes().groupBy("key", "at", "id").agg(F.min("change").alias("change"))
        # at most one version a lane is left
        best = one_per_key(folded.where("change = 'Y'"), ["key"], [F.col("at").desc(), F.col("id").desc()])
        best = best.select("key", "at", "id", F.lit("Y").alias("active_flag"))
        told = folded.drop("change").join(best, ["key", "at", "id"], "left").fillna("N", ["active_flag"])
        key = F.from_json("key", T.StructType([self.schema[k] for k in self.keys]))
        none = F.lit(OLDEST)
        return told.withColumn("key", key).select(
            "key.*", F.nullif(F.col("at"), none).alias("at"), F.nullif(F.col("id"), none).alias(self.event), "active_flag"
        )
