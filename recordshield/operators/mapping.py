"""Identity maps: who is the same person, and which surrogate stands for whom."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import normalise_id
from ..session import discard, store, store_at
from .filters import rename
from .numbering import number_rows

MIN_OFFSET, MAX_OFFSET = 10, 30  # fixed values: range of the day shift


def keyed_offset(key: str | Column, salt: str) -> Column:
    """A day shift of 10 to 30 that only the holder of the salt can compute again."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(salt), key.cast("string")), 256), 1, 8)
    return (F.lit(MIN_OFFSET) + F.conv(digest, 16, 10).cast("bigint") % (MAX_OFFSET - MIN_OFFSET + 1)).cast("int")


def identifier_nodes(sources: Sequence[DataFrame], kinds: Sequence[str]) -> DataFrame:
    """Rows of all sources as an array of ``kind:value`` nodes; ids are normalised, rows without any id left out."""
    parts = []
    for source in sources:
        present = [k for k in kinds if k in source.columns]
        nodes = F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), normalise_id(k))) for k in present])
        parts.append(source.select(F.array_sort(F.array_compact(nodes)).alias("nodes")))
    return reduce(lambda a, b: a.unionByName(b), parts).where(F.size("nodes") > 0)


def components(rows: DataFrame) -> DataFrame:
    """(node, component): nodes that share a row, directly or through others, get one component, the least node of it.

    Alternating star contraction: each round hangs the neighbours of every node onto the least one, first the larger
    neighbours, then the smaller ones. The number of rounds grows with the logarithm of the longest chain; every round
    that changes an edge lowers a node, so the loop ends. Edges and the least neighbours are written to the shared folder,
    and a round's files go when the next one is written. The join back to the edges reads both sides from files, so that
    a hub (one identifier shared by a third of the rows) can be split over tasks by the adaptive skew join.
    """
    spark = rows.sparkSession
    first = F.col("nodes")[0]
    # a row of k ids needs k - 1 edges; a single id keeps an edge to itself
    edges, _ = store_at(rows.select(F.explode("nodes").alias("u"), first.alias("v")).distinct(), "edges")
    nodes_only = edges.where(F.col("u") == F.col("v")).select("u")
    edges, path, before = edges.where(F.col("u") != F.col("v")), None, None
    while True:
        now = _signature(edges)
        if now == before or now[0] == 0:
            break
        before = now
        large, large_path = _large_star(edges)
        edges, new_path = store_at(_small_star(large), "edges")
        discard(spark, *large_path, *([path] if path else []))
        path = new_path
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = hung.select(F.col("component").alias("node"))
    alone = nodes_only.select(F.col("u").alias("node")).unionByName(roots).distinct()
    alone = alone.join(hung.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return hung.unionByName(alone)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, least_path = store_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved, moved_path = store_at(moved, "edges")
    return moved, (least_path, moved_path)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def patient_map(labels: DataFrame, kinds: Sequence[str], start: int, salt: str, dates: DataFrame | None = None) -> DataFrame:
    """One row per component: the least value of each identifier kind, a dense surrogate from ``start``, a keyed offset.

    ``dates`` may bring (node, registration_date); the earliest of the component is kept.
    """
    kind, value = F.substring_index("node", ":", 1), F.expr("substring(node, instr(node, ':') + 1)")
    wide = labels.select("component", kind.alias("kind"), value.alias("value"))
    people = wide.groupBy("component").agg(*[F.min(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in kinds])
    if dates is not None:
        earliest = labels.join(dates, "node").groupBy("component").agg(F.min("registration_date").alias("registration_date"))
        people = people.join(earliest, "component", "left")
    numbered = number_rows(people, ["component"], name="sur_patient_id", start=start)
    return numbered.withColumn("day_offset", keyed_offset("component", salt)).drop("component")


def identity_index(labels: DataFrame, people: DataFrame, anchor: str) -> DataFrame:
    """(kind, value, sur_patient_id) for every identifier of a person, not only the one kept in the map."""
    node = F.concat(F.lit(f"{anchor}:"), F.col(anchor))
    anchors = people.where(F.col(anchor).isNotNull()).select(node.alias("node"), "sur_patient_id")
    owned = anchors.join(labels, "node").select("component", "sur_patient_id")
    return labels.join(owned, "component").select(
        F.substring_index("node", ":", 1).alias("kind"),
        F.expr("substring(node, instr(node, ':') + 1)").alias("value"),
        "sur_patient_id",
    )


def met_links(known: Sequence[DataFrame], source_rows: DataFrame, own: str, kinds: Sequence[str]) -> DataFrame:
    """(nodes) of two, a known person and one of the person's identifiers, for the identifiers that occur in the sources.

    The map is scanned, but what leaves the scan is bounded by the increment: its identifiers times the persons that hold each.
    """
    asked = source_rows.select(F.explode("nodes").alias("node")).distinct()
    mark = F.lit(f"{own}:")
    held = identifier_nodes(known, [own, *kinds])
    person = F.get(F.filter("nodes", lambda n: n.startswith(mark)), F.lit(0))
    links = held.select(person.alias("person"), F.explode(F.filter("nodes", lambda n: ~n.startswith(mark))).alias("node"))
    met = links.where(F.col("person").isNotNull()).join(asked, "node", "left_semi").distinct()
    return met.select(F.array_sort(F.array("person", "node")).alias("nodes"))


def update_patient_map(
    existing: DataFrame, sources: Sequence[DataFrame], kinds: Sequence[str], primary: str, salt: str, index: DataFrame | None = None
) -> DataFrame:
    """The map with new people added: who is joined to a known person by an identifier of any kind, directly or through other rows, is that
    person; ids of the others go on after the highest.

    ``index`` brings the identifiers that the map does not keep, see :func:`identity_index`. A known person's row stays, and identifiers it lacks are
    filled in from the sources, unless these join several known persons: such keep their rows as they are. Components are made of the rows of the
    sources and of the known identifiers that occur in them, so their work grows with the increment and not with the map.
    """
    own = "sur_patient_id"
    held = existing.select(own, *[k for k in dict.fromkeys([primary, *kinds]) if k in existing.columns])
    known = [held] if index is None else [held, *[index.where(F.col("kind") == k).select(own, F.col("value").alias(k)) for k in kinds]]
    rows = store(identifier_nodes(sources, kinds), "increment")
    labels = store(components(rows.unionByName(met_links(known, rows, own, kinds))), "labels")
    mark = f"{own}:"
    owned = labels.where(F.col("node").startswith(mark)).groupBy("component").agg(
        F.min(F.expr(f"substring(node, {len(mark) + 1})")).alias("__sur"), F.count(F.lit(1)).alias("__n")
    )
    fresh = labels.join(owned, "component", "left_anti")
    highest = existing.agg(F.max(own)).first()[0]
    new = patient_map(fresh, kinds, int(highest or 0) + 1, salt)
    kind, value = F.substring_index("node", ":", 1), F.expr("substring(node, instr(node, ':') + 1)")
    found = labels.join(owned.where("__n = 1"), "component").groupBy("__sur").agg(
        *[F.min(F.when(kind == k, value)).alias(f"__{k}") for k in kinds]
    )
    met = existing.join(found, normalise_id(own) == F.col("__sur"), "left")
    kept = [c for c in existing.columns if c not in kinds]
    filled = {k: F.coalesce(F.col(k), F.col(f"__{k}").cast(existing.schema[k].dataType)) if k in existing.columns else F.col(f"__{k}") for k in kinds}
    columns = [*existing.columns, *[k for k in kinds if k not in existing.columns]]
    met = met.select(*[F.col(c) if c in kept else filled[c].alias(c) for c in columns])
    return met.unionByName(new, allowMissingColumns=True)


def visit_map(
    visits: DataFrame, patients: DataFrame, existing: DataFrame | None, width: int, key: str, surrogate: str
) -> DataFrame:
    """New rows of an encounter or appointment map.

    ``visits`` holds (patient key, visit key, visit_date) as ``patient_key``, ``key``, ``visit_date``; ``patients`` maps
    ``patient_key`` to ``sur_patient_id``. New visits of a person are numbered by (date, key) after the count of visits
    already mapped; the surrogate is the person's surrogate followed by that number with ``width`` digits. A number with more digits
    stands behind ``width`` zeros, which no shorter number is: any number of visits fits, and surrogates of persons with equally many
    digits never meet.
    """
    fresh = visits.where(F.col(key).isNotNull())
    if existing is not None:
        fresh = fresh.join(existing.select(key), key, "left_anti")
    fresh = fresh.groupBy(key).agg(F.min(F.struct("visit_date", "patient_key")).alias("v"))
    fresh = fresh.select(key, F.col("v.visit_date").alias("visit_date"), F.col("v.patient_key").alias("patient_key"))
    owned = fresh.join(patients.select("patient_key", "sur_patient_id"), "patient_key").drop("patient_key")
    numbered = number_rows(owned, ["visit_date", key], name="__n", within=["sur_patient_id"])
    if existing is not None:
        used = existing.groupBy("sur_patient_id").agg(F.count(F.lit(1)).alias("__used"))
        numbered = numbered.join(used, "sur_patient_id", "left").fillna(0, ["__used"])
        numbered = numbered.withColumn("__n", F.col("__n") + F.col("__used")).drop("__used")
    limit = 10**width - 1
    digits = F.col("__n").cast("string")
    counter = F.when(F.col("__n") <= limit, F.lpad(digits, width, "0")).otherwise(F.concat(F.lit("0" * width), digits))
    return numbered.select(
        "sur_patient_id", key, F.concat(F.col("sur_patient_id").cast("string"), counter).cast("bigint").alias(surrogate), "visit_date"
    )


def encounter_map(visits: DataFrame, patients: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return visit_map(visits, patients, existing, 4, "encounter_id", "sur_encounter_id")


def appointment_map(visits: DataFrame, patients: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return visit_map(visits, patients, existing, 3, "appointment_id", "sur_appointment_id")


def pii_rows(
    source: DataFrame, columns: dict[str, str], patients: DataFrame, patient_column: str, map_column: str
) -> DataFrame:
    """PII columns of one source under their roles, keyed by surrogate; rows of unknown people are dropped."""
    picked = rename(source.select(patient_column, *columns), columns)
    side = patients.select(F.col(map_column).alias("__k"), "sur_patient_id")
    joined = picked.join(side, picked[patient_column] == side["__k"], "inner")
    return joined.select("sur_patient_id", *[F.col(c).cast("string").alias(c) for c in columns.values()])


def pii_table(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def reverse_map(df: DataFrame, surrogate: str, mapping: DataFrame, original: str) -> DataFrame:
    """Surrogate back to the original key, for an authorised audit."""
    side = mapping.select(F.col(surrogate).alias("__s"), F.col(original))
    return df.join(side, df[surrogate] == side["__s"], "left").drop("__s")


def lookup_ids(direct: DataFrame, visits: DataFrame, visit_ids: DataFrame) -> DataFrame:
    """Patient ids asked for directly together with those that the asked visits imply."""
    implied = visits.join(visit_ids, "encounter_id", "left_semi").select("patient_id")
    return direct.select("patient_id").unionByName(implied).where(F.col("patient_id").isNotNull()).distinct()
