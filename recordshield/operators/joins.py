"""Joins that trace any table back to its subject. All are equi joins; Spark picks broadcast or shuffle by measured size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import store


def enrich(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "left",
    suffix: str = "",
    drop_left_key: bool = False,
    drop_right_key: bool = False,
) -> DataFrame:
    """Join with the right columns suffixed, so that no name is met twice."""
    renamed = right.withColumnsRenamed({c: c + suffix for c in right.columns}) if suffix else right
    key = right_on + suffix
    out = left.join(renamed, left[left_on] == renamed[key], how)
    if drop_right_key:
        out = out.drop(renamed[key])
    if drop_left_key:
        out = out.drop(left[left_on])
    return out


NULL_SALTS = 1024


def left_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, spread_by: Sequence[str] | None = None) -> DataFrame:
    """A left join that spreads rows with a null key; the right key is dropped.

    Null keys match nothing, yet a shuffle would send them all to one task. They get a salt as a second join key, which is
    0 on every other row and on the right side. The salt is a hash of ``spread_by``, by default the first columns of the
    row: ids stand there, and hashing all columns would make the scan read them all.
    """
    key, other = F.col(left_on), F.col(right_on)
    spread_by = spread_by or [c for c in left.columns if c != left_on][:3] or [left_on]
    salt = 1 + F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SALTS))
    salted = left.withColumn("__salt", F.when(key.isNull(), salt).otherwise(F.lit(0).cast("bigint")))
    # always 0, but not a literal that the optimizer could move out of the join keys
    side = right.withColumn("__zero", F.pmod(F.xxhash64(other), F.lit(1).cast("bigint")))
    joined = salted.join(side, (salted[left_on] == side[right_on]) & (salted["__salt"] == side["__zero"]), "left")
    return joined.drop(side[right_on]).drop("__salt", "__zero")


@dataclass(frozen=True)
class PatientKey:
    """A column of the table that holds one kind of patient identifier."""

    column: str
    kind: str


def map_patient(df: DataFrame, patient_map: DataFrame, keys: Sequence[PatientKey]) -> DataFrame:
    """One left join per identifier kind: adds ``sur_patient_id_from_<kind>`` and ``day_offset_from_<kind>``."""
    for key in keys:
        side = patient_map.where(F.col(key.kind).isNotNull()).select(
            F.col(key.kind).alias("__k"),
            F.col("sur_patient_id").alias(f"sur_patient_id_from_{key.kind}"),
            F.col("day_offset").alias(f"day_offset_from_{key.kind}"),
        )
        df = left_join(df, side, key.column, "__k")
    return df


def map_encounter(
    df: DataFrame, visit_map: DataFrame, patient_map: DataFrame, column: str, key: str = "encounter_id", kind: str = "encounter"
) -> DataFrame:
    """Two hops: visit -> patient surrogate -> patient row. ``kind`` is encounter or appointment."""
    surrogate = f"sur_{kind}_id"
    people = patient_map.select("sur_patient_id", F.col("day_offset").alias(f"day_offset_from_{kind}"))
    side = visit_map.select(F.col(key).alias("__k"), surrogate, "sur_patient_id").join(people, "sur_patient_id", "left")
    side = side.withColumnRenamed("sur_patient_id", f"sur_patient_id_from_{kind}")
    return left_join(df, side, column, "__k")


def resolve_identity(df: DataFrame, kinds: Sequence[str], default_offset: int) -> DataFrame:
    """First known value of encounter, the identifier kinds in order, appointment; the sources are dropped.

    The default offset is used only when the table has no source of an offset at all.
    """
    ordered = ["encounter", *kinds, "appointment"]
    patients = [c for k in ordered if (c := f"sur_patient_id_from_{k}") in df.columns]
    offsets = [c for k in ordered if (c := f"day_offset_from_{k}") in df.columns]
    patient = F.coalesce(*patients) if patients else F.lit(None)
    offset = F.coalesce(*offsets) if offsets else F.lit(default_offset)
    return df.withColumns({"sur_patient_id": patient.cast("bigint"), "day_offset": offset.cast("int")}).drop(*patients, *offsets)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Spark cuts each task to one row per key before the shuffle (window group limit)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).where(F.col("__rn") == 1).drop("__rn")


def bridge_join(df: DataFrame, bridge: DataFrame, column: str, source: str, target: str, result: str) -> DataFrame:
    """Join to a bridge on the text form of the key; rows that reach no target, or an empty one, are dropped."""
    keys = bridge.select(F.col(source).cast("string").alias("__k"), F.col(target).alias(result))
    keys = keys.where(F.col(result).isNotNull() & (F.col(result).cast("string") != ""))
    keys = keys.groupBy("__k").agg(F.min(result).alias(result))
    return df.join(keys, df[column].cast("string") == keys["__k"], "inner").drop("__k")


@dataclass(frozen=True)
class Hop:
    """One step of a reference path: match ``key`` of ``table`` and go on with ``next_column``."""

    table: DataFrame
    key: str
    next_column: str
    order: str


def hops_of(reference: Mapping[str, Any], tables: Mapping[str, DataFrame], order: Mapping[str, str] | None = None) -> list[Hop]:
    """Hops of a reference path in config form.

    ``reference``: {conditions: [{source_column, reference_table, column_name}], destination_column}. Each condition leads
    to a row of its table; the next condition's source column, at last the destination column, is taken from it.
    """
    steps = reference["conditions"]
    nexts = [c["source_column"] for c in steps[1:]] + [reference["destination_column"]]
    order = order or {}
    return [
        Hop(tables[c["reference_table"]], c["column_name"], nxt, order.get(c["reference_table"], nxt)) for c, nxt in zip(steps, nexts)
    ]


def first_known(hop: Hop) -> DataFrame:
    """Per key the first value that is not null, by the hop's order column."""
    known = hop.table.where(F.col(hop.next_column).isNotNull() & F.col(hop.key).isNotNull())
    return known.groupBy(F.col(hop.key).alias("__k")).agg(F.min_by(hop.next_column, hop.order).alias("__next"))


def follow_path(df: DataFrame, column: str, hops: Sequence[Hop], result: str) -> DataFrame:
    """Follow n hops from ``column``; a row whose chain breaks gets null."""
    out = df.withColumn("__at", F.col(column))
    for hop in hops:
        step = first_known(hop)
        out = left_join(out, step, "__at", "__k").drop("__at").withColumnRenamed("__next", "__at")
    return out.withColumnRenamed("__at", result)


def build_bridge(source: DataFrame, column: str, hops: Sequence[Hop], existing: DataFrame | None, key: str, target: str) -> DataFrame:
    """New bridge rows: one per source key that the bridge does not hold yet and that reaches a target."""
    keys = source.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct()
    if existing is not None:
        keys = keys.join(existing.select(key), key, "left_anti")
    return follow_path(keys, key, hops, target).where(F.col(target).isNotNull())


def or_of_chains(groups: Sequence[DataFrame]) -> DataFrame:
    """Results of several inner-join chains, combined as a distinct union."""
    return reduce(lambda a, b: a.unionByName(b), groups).distinct()


def absent_rows(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other frame does not hold; rows with a null key stay."""
    return df.join(other.select(*keys).distinct() if len(keys) > 1 else other.select(*keys), list(keys), "left_anti")


def present_rows(df: DataFrame, keys: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Rows whose column is in a key list of any size."""
    listed = keys.select(F.col(right_on).alias("__k"))
    return df.join(listed, df[left_on] == listed["__k"], "left_semi")


def dump_difference(newer: DataFrame, older: DataFrame, system: Sequence[str] = ()) -> DataFrame:
    """Rows of the newer dump that the older one does not hold, by all common columns, null equal to null.

    Duplicates of the newer side stay. The rows are joined on a hash of the columns plus the columns themselves.
    """
    columns = [c for c in newer.columns if c in older.columns and c not in set(system)]
    seen = older.select(F.xxhash64(*columns).alias("__h"), *[F.col(c).alias(f"__o_{c}") for c in columns])
    keyed = newer.withColumn("__h", F.xxhash64(*columns))
    same = keyed["__h"] == seen["__h"]
    for c in columns:
        same = same & keyed[c].eqNullSafe(seen[f"__o_{c}"])
    return keyed.join(seen, same, "left_anti").drop("__h")


#: Key ranges that two copies are compared by; bounds the digests and what is broadcast of them.
RANGES = 1 << 14


def _range_of(key: str, span: tuple[int, int] | None, ranges: int) -> Column:
    """The key's range: by value where the span of an integer key is known, else by hash; -1 for a null key."""
    if span is None:
        place = F.pmod(F.xxhash64(key), F.lit(ranges))
    else:
        low, width = span[0], -(-(span[1] - span[0] + 1) // ranges)
        place = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("bigint")
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place)


def _digests(df: DataFrame, place: Column, columns: Sequence[str], side: str) -> DataFrame:
    """Rows and sums of row hashes per range, whatever the order of the rows. Sums of halves cannot overflow below 2^31 rows."""
    h = F.xxhash64(F.array(*[F.col(c).isNull() for c in columns]), *columns)
    return df.groupBy(place.alias("range")).agg(
        F.count(F.lit(1)).alias(f"{side}_rows"),
        F.sum(h.bitwiseAND(F.lit((1 << 32) - 1))).alias(f"{side}_low"),
        F.sum(F.shiftrightunsigned(h, 32)).alias(f"{side}_high"),
    )


def unequal_ranges(newer: DataFrame, older: DataFrame, key: str, system: Sequence[str] = (), ranges: int = RANGES) -> tuple[DataFrame, Column]:
    """(range, newer_rows, older_rows) of the key ranges in which two copies differ, and the expression that gives a row's range.

    Each copy is read once and only sums per range are shuffled. The columns that both have, minus ``system``, decide, repeated rows included.
    """
    columns = [c for c in newer.columns if c in older.columns and c not in set(system)]
    span = None
    if newer.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        ends = [df.agg(F.min(key), F.max(key)).first() for df in (newer, older)]
        met = [v for e in ends for v in e if v is not None]
        span = (min(met), max(met)) if met else None
    place = _range_of(key, span, ranges)
    both = _digests(newer, place, columns, "newer").join(_digests(older, place, columns, "older"), "range", "full")
    same = F.lit(True)
    for part in ("rows", "low", "high"):
        same = same & F.col(f"newer_{part}").eqNullSafe(F.col(f"older_{part}"))
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("newer_rows", "older_rows")]
    return both.where(~same).select("range", *counts), place


def dump_difference_by_range(newer: DataFrame, older: DataFrame, key: str, system: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """As :func:`dump_difference`, but only ranges of the key whose digests differ are opened and joined.

    Of equal ranges no row is shuffled, so two copies that differ in a few places cost two scans. What is broadcast are the numbers
    of the unequal ranges, ``ranges + 1`` at most. Both copies need the key as one of the compared columns, of one type.
    """
    opened, place = unequal_ranges(newer, older, key, system, ranges)
    opened = F.broadcast(store(opened.select(F.col("range").alias("__range")), "ranges"))
    left, right = [df.withColumn("__range", place).join(opened, "__range", "left_semi").drop("__range") for df in (newer, older)]
    return dump_difference(left, right, system)


def pair_by_id(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Before and after values side by side."""
    b = before.select(F.col(key), *[F.col(c).alias(f"{c}_before") for c in columns])
    a = after.select(F.col(key), *[F.col(c).alias(f"{c}_after") for c in columns])
    return b.join(a, key, "inner")


IDENTIFIER_WORDS = {"patient": ["custkey", "patient_id", "patientid", "user_id"], "encounter": ["orderkey", "encounter_id", "encounterid"]}


def pick_identifier(columns: Sequence[str], words: dict[str, list[str]] = IDENTIFIER_WORDS) -> tuple[str, str] | None:
    """(kind, column) by keyword: exact before partial, patient before encounter."""
    lowered = {c.lower(): c for c in columns}
    for kind in ("patient", "encounter"):
        for exact in (True, False):
            for word in words[kind]:
                for low, name in lowered.items():
                    if (low == word) if exact else (word in low):
                        return kind, name
    return None


def cohort_copy(tables: dict[str, DataFrame], cohort: dict[str, DataFrame], words: dict[str, list[str]] = IDENTIFIER_WORDS) -> dict[str, DataFrame]:
    """Per table the rows that belong to the cohort; ``cohort`` holds one id column ``id`` per kind."""
    out = {}
    for name, df in tables.items():
        picked = pick_identifier(df.columns, words)
        if picked:
            kind, column = picked
            out[name] = present_rows(df, cohort[kind], column, "id")
    return out
