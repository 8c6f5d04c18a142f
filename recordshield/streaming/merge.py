"""Continuous load and continuous masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.deidentify import Maps, Options, apply_rules, identify
from ..plans.versions import VersionedTable
from ..spec import TableSpec


def merge_stream(stream: DataFrame, table: VersionedTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is one run of the versioned merge; a replayed batch replaces its own run."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, run=batch_id)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def mask_stream(stream: DataFrame, spec: TableSpec, maps: Maps, options: Options | None = None) -> DataFrame:
    """Masking of a stream: the maps are the static side of left joins, the rules one projection."""
    options = options or Options()
    identified, used = identify(stream, spec, maps, options.default_offset)
    known = identified.where(identified["sur_patient_id"].isNotNull()) if used else identified
    types = {c: stream.schema[c].dataType for c in stream.columns}
    return apply_rules(known, spec, options, types).drop("sur_patient_id", "sur_encounter_id", "sur_appointment_id", "day_offset")
