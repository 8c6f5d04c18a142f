"""A whole table masked as one lazy plan: bridge, maps, identity, reject split, rules, target types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import DEFAULT_STATIC_OFFSET
from ..functions.rules import RuleContext, apply_rule
from ..operators.filters import ignore_cell, ignore_rows, split_rejects
from ..operators.joins import PatientKey, bridge_join, map_encounter, map_patient, resolve_identity
from ..sources.scan import typed_for_rules
from ..spec import TableSpec
from .notes import NotesOptions, mask_notes


@dataclass(frozen=True)
class Maps:
    """Mapping tables. Patient: one column per identifier kind, sur_patient_id, day_offset."""

    patient: DataFrame
    encounter: DataFrame | None = None
    appointment: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    run: str = "run"
    default_offset: int = DEFAULT_STATIC_OFFSET
    keep_unmapped: bool = False
    date_format: str | None = None
    stamp: object | None = None
    notes: NotesOptions | None = None
    extra: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Masked:
    table: DataFrame
    rejects: DataFrame


WORK = ("sur_patient_id", "sur_encounter_id", "sur_appointment_id", "day_offset")


def identify(df: DataFrame, spec: TableSpec, maps: Maps, default_offset: int) -> tuple[DataFrame, list[str]]:
    """Surrogates and day offset beside each row; also the key columns that were used."""
    patient_keys = [PatientKey(r.column, r.patient_kind) for r in spec.phi_rules if r.patient_kind in maps.patient.columns]
    used = [k.column for k in patient_keys]
    out = map_patient(df, maps.patient, patient_keys)
    for key, visits, name in (("ENCOUNTER_ID", maps.encounter, "encounter"), ("APPOINTMENT_ID", maps.appointment, "appointment")):
        columns = spec.columns_with(key)
        if columns and visits is not None:
            out = map_encounter(out, visits, maps.patient, columns[0], f"{name}_id", name)
            used.append(columns[0])
    return resolve_identity(out, [k.kind for k in patient_keys], default_offset), used


def apply_rules(df: DataFrame, spec: TableSpec, options: Options, source_types: Mapping[str, object]) -> DataFrame:
    """All column rules in one projection, in the source's column order."""
    by_column = {r.column: r for r in spec.phi_rules if r.rule and r.key != "NOTES"}
    out = []
    for name, dtype in source_types.items():
        rule = by_column.get(name)
        if rule is None:
            out.append(F.col(name))
            continue
        ctx = RuleContext(
            dtype=dtype, mask=rule.mask, keep_unmapped=options.keep_unmapped, date_format=options.date_format, options=dict(options.extra)
        )
        masked = apply_rule(rule.rule, name, ctx)
        if rule.ignore.conditions:
            masked = ignore_cell(F.col(name).cast("string"), masked.cast("string"), rule.ignore.conditions, rule.ignore.operation)
        out.append(masked.alias(name))
    return df.select(*out, *[c for c in WORK if c in df.columns])


def deidentify_table(
    df: DataFrame,
    spec: TableSpec,
    maps: Maps,
    options: Options | None = None,
    bridge: tuple[DataFrame, str, str, str] | None = None,
    keep_work_columns: Sequence[str] = (),
) -> Masked:
    """Mask one table.

    ``bridge`` is (bridge table, source key, target key, column of ``df``): its target joins the table as a column named
    like the target key before the maps are looked up.
    """
    options = options or Options()
    rows = ignore_rows(df, spec.ignore_rows.conditions, spec.ignore_rows.operation)
    if bridge is not None:
        table, source, target, column = bridge
        rows = bridge_join(rows, table, column, source, target, target)
    identified, used = identify(rows, spec, maps, options.default_offset)
    if options.keep_unmapped:
        good, rejects = split_rejects(identified, "sur_patient_id", [], spec.name, options.run)
    else:
        good, rejects = split_rejects(identified, "sur_patient_id", used, spec.name, options.run)
    if options.notes is not None:
        for column in spec.columns_with("NOTES"):
            good = mask_notes(good, spec.row_id, column, options.notes)
    types = {c: rows.schema[c].dataType for c in rows.columns}
    masked = typed_for_rules(apply_rules(good, spec, options, types), spec)
    kept = [c for c in masked.columns if c not in WORK or c in keep_work_columns]
    masked = masked.select(*kept)
    if options.stamp is not None:
        masked = masked.withColumn("deid_ts", F.lit(options.stamp))
    return Masked(masked, rejects)
