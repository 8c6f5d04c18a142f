"""Operators on small frames, hot groups and nulls included."""

import hashlib
import os
import pathlib
import random
from datetime import date

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordshield import session
from recordshield.operators import filters, joins, mapping, notes, numbering, profile, quality, sampling, validity, versioned
from recordshield.operators.reports import merge_qc
from recordshield.plans.deidentify import Maps, Options, deidentify_table
from recordshield.plans.notes import NotesOptions, mask_notes
from recordshield.plans.versions import BucketedTable, VersionedTable
from recordshield.queries import base
from recordshield.sources import scan, sink
from recordshield.spec import ColumnRule, IgnoreRule, TableSpec


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# --- numbering --------------------------------------------------------------------------------------------------------


def test_number_rows_matches_row_number_with_a_hot_group(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(40)}", rnd.randrange(1000), i) for i in range(3000)]
    data += [(None, 1, 9001), (None, 2, 9000)]
    df = spark.createDataFrame(data, "k string, at int, id int").repartition(7)
    got = numbering.number_rows(df, ["at", "id"], name="n", within=["k"])
    want = df.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("at", "id")).cast("bigint"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_number_rows_spreads_one_group_over_partitions(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), "id").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbering.number_rows(df, ["id"], name="n", within=["k"])
        assert got.where(F.col("n") != F.col("id") + 1).count() == 0
        assert got.count() == 20000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_number_rows_of_equal_values_in_many_partitions(spark):
    got = numbering.number_rows(spark.range(5000).select(F.lit(7).alias("v")).repartition(6), ["v"], name="n")
    assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 5000, 5000)


def test_number_rows_of_nothing(spark):
    assert numbering.number_rows(spark.range(0), ["id"]).count() == 0


def test_id_ranges(spark):
    df = spark.range(0, 20, 2).union(spark.createDataFrame([(None,)], "id bigint"))
    assert rows(numbering.id_ranges(df, "id", 4)) == [(0, 0, 6, 4), (1, 8, 14, 4), (2, 16, 18, 2)]


# --- filters and joins ------------------------------------------------------------------------------------------------


def test_ignore_rows_keeps_nulls(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (3, 4)], "a int, id int")
    assert rows(filters.ignore_rows(df, [("a", "eq", 1)]), "id") == [(1,), (4,)]
    assert rows(filters.ignore_rows(df, [("a", "not_in", [1])]), "id") == [(1,), (2,)]


def test_left_join_spreads_null_keys(spark):
    left = spark.createDataFrame([(i, None if i % 3 else i) for i in range(300)], "id int, k int")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 200, 3)], "rk int, v int")
    out = joins.left_join(left, right, "k", "rk")
    assert out.columns == ["id", "k", "v"]
    want = [(i, None if i % 3 else i, i * 10 if i % 3 == 0 and i < 200 else None) for i in range(300)]
    assert sorted(map(str, out.collect())) == sorted(str(T.Row(id=a, k=b, v=c)) for a, b, c in want)


def test_left_join_plan_keeps_the_salt_as_key(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(9).select("id", F.when(F.col("id") > 4, F.col("id")).alias("k"))
        out = joins.left_join(left, spark.range(9).select(F.col("id").alias("rk"), F.col("id").alias("v")), "k", "rk")
        assert "__salt" in [l for l in out._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in l][0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_follow_path_takes_the_first_known_value(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    hop1 = spark.createDataFrame([("a", None, 1), ("a", "x", 3), ("a", "y", 2), ("b", "z", 1)], "k string, nxt string, pos int")
    hop2 = spark.createDataFrame([("y", 7, 1)], "k string, nxt int, pos int")
    out = joins.follow_path(df, "k", [joins.Hop(hop1, "k", "nxt", "pos"), joins.Hop(hop2, "k", "nxt", "pos")], "r")
    assert {(r["k"], r["r"]) for r in out.collect()} == {("a", 7), ("b", None), ("c", None), (None, None)}


def test_hops_from_config(spark):
    tables = {
        "visits": spark.createDataFrame([(1, 7), (2, 8)], "visit int, person int"),
        "people": spark.createDataFrame([(7, "c7"), (8, None)], "id int, chart string"),
    }
    reference = {
        "source_table": "lines",
        "conditions": [
            {"source_column": "visit_id", "reference_table": "visits", "column_name": "visit"},
            {"source_column": "person", "reference_table": "people", "column_name": "id"},
        ],
        "destination_column": "chart",
    }
    df = spark.createDataFrame([(1,), (2,), (3,)], "visit_id int")
    out = joins.follow_path(df, "visit_id", joins.hops_of(reference, tables), "chart")
    assert {(r[0], r[1]) for r in out.collect()} == {(1, "c7"), (2, None), (3, None)}


def test_bridge_join_drops_rows_without_target(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    bridge = spark.createDataFrame([("1", "p"), ("1", "p"), ("2", ""), ("3", None)], "src string, dst string")
    assert rows(joins.bridge_join(df, bridge, "k", "src", "dst", "t")) == [(1, "p")]
    assert rows(joins.bridge_join(df, bridge.limit(0), "k", "src", "dst", "t")) == []


def test_dump_difference_nulls_equal_duplicates_stay(spark):
    newer = spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (3, "b")], "id int, v string")
    older = spark.createDataFrame([(1, None), (3, "b"), (3, "b")], "id int, v string")
    assert rows(joins.dump_difference(newer, older)) == [(2, "a"), (2, "a")]


def test_resolve_identity_default_only_without_any_source(spark):
    df = spark.createDataFrame([(1, None)], "id int, day_offset_from_chart int")
    assert joins.resolve_identity(df, ["chart"], 34).first()["day_offset"] is None
    assert joins.resolve_identity(df.select("id"), [], 34).first()["day_offset"] == 34


def test_pick_identifier():
    words = {"patient": ["patient_id", "pid"], "encounter": ["enc_id"]}
    assert joins.pick_identifier(["x", "ENC_ID", "my_pid_x"], words) == ("patient", "my_pid_x")
    assert joins.pick_identifier(["ENC_ID"], words) == ("encounter", "ENC_ID")
    assert joins.pick_identifier(["x"], words) is None


# --- versions ---------------------------------------------------------------------------------------------------------


def _history(spark):
    return spark.createDataFrame(
        [(1, "a", 1, date(2020, 1, 1), "Y"), (2, "b", 2, date(2020, 1, 1), "Y"), (None, "n", 3, date(2020, 1, 1), "Y")],
        "k int, v string, row_id bigint, last_updated date, active_flag string",
    )


def test_versioned_merge_leaves_one_active_row_per_key(spark):
    increment = spark.createDataFrame([(1, "a2", date(2020, 2, 1)), (1, "a3", date(2020, 3, 1)), (4, "d", date(2020, 2, 1))], "k int, v string, last_updated date")
    result = versioned.versioned_merge(_history(spark), increment, ["k"])
    active = {r["v"] for r in result.table.where("active_flag = 'Y'").collect()}
    assert active == {"a3", "b", "d", "n"}
    assert sorted(r["row_id"] for r in result.table.collect()) == [1, 2, 3, 4, 5, 6]
    assert versioned.keys_not_one_active(result.table, ["k"]).count() == 0


def test_repair_prefers_dated_rows_and_high_ids(spark):
    df = spark.createDataFrame([(1, 1, None, "N"), (1, 2, date(2020, 1, 1), "N"), (1, 3, date(2020, 1, 1), "Y"), (1, 4, None, "Y")], "k int, row_id int, last_updated date, active_flag string")
    assert rows(versioned.repair_flags(df, ["k"]), "row_id", "active_flag") == [(1, "N"), (2, "N"), (3, "Y"), (4, "N")]


def test_versioned_table_rerun_changes_nothing(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"), ("k",))
    first = spark.createDataFrame([(1, "a", date(2020, 1, 1)), (2, "b", date(2020, 1, 1))], "k int, v string, last_updated date")
    second = spark.createDataFrame([(1, "a2", date(2020, 2, 1)), (3, "c", date(2020, 2, 1)), (2, "old", date(2019, 1, 1))], "k int, v string, last_updated date")
    store.merge(first, 1)
    store.merge(second, 2)
    once = rows(store.history(), "k", "v", "row_id", "active_flag")
    store.merge(second, 2)
    assert rows(store.history(), "k", "v", "row_id", "active_flag") == once
    assert {(k, v) for k, v, _, f in once if f == "Y"} == {(1, "a2"), (2, "b"), (3, "c")}
    assert len({r for _, _, r, _ in once}) == 5


# --- mapping ----------------------------------------------------------------------------------------------------------


def test_components_long_chain_hub_and_singles(spark):
    chain = [(f"a{i}", f"b{i}") for i in range(60)]
    links = [(f"b{i}", f"a{i + 1}") for i in range(59)]
    first = spark.createDataFrame(chain + [(f"h{i}", "hub") for i in range(200)] + [("alone", None)], "chart string, patient string")
    second = spark.createDataFrame(links, "patient string, chart string")
    labels = mapping.components(mapping.identifier_nodes([first, second], ["chart", "patient"]))
    found = {r["node"]: r["component"] for r in labels.collect()}
    assert labels.count() == len(found) == 120 + 201 + 1
    assert {v for k, v in found.items() if k.split(":")[1][0] in "ab" and k != "chart:alone"} == {"chart:a0"}
    assert {v for k, v in found.items() if k.startswith("chart:h") or k == "patient:hub"} == {"chart:h0"}
    assert found["chart:alone"] == "chart:alone"


def test_patient_map_is_dense_and_repeatable(spark):
    src = spark.createDataFrame([("1.0", "c1"), ("1", "c2"), ("5", None)], "patient string, chart string")
    labels = mapping.components(mapping.identifier_nodes([src], ["patient", "chart"]))
    one = rows(mapping.patient_map(labels, ["patient", "chart"], 100, "s"))
    assert [r[2] for r in sorted(one, key=lambda r: r[2])] == [100, 101]
    assert all(10 <= r[3] <= 30 for r in one)
    assert one == rows(mapping.patient_map(labels, ["patient", "chart"], 100, "s"))


def test_encounter_numbers_go_on(spark):
    visits = spark.createDataFrame([(7, 1, date(2020, 1, 1)), (7, 2, date(2020, 1, 2)), (7, 3, date(2019, 1, 1))], "patient_key int, encounter_id int, visit_date date")
    people = spark.createDataFrame([(7, 1001)], "patient_key int, sur_patient_id bigint")
    known = spark.createDataFrame([(1001, 1), (1001, 2)], "sur_patient_id bigint, encounter_id int")
    assert rows(mapping.encounter_map(visits, people, known), "encounter_id", "sur_encounter_id") == [(3, 10010003)]


@pytest.mark.parametrize("build, n", [(mapping.appointment_map, 1_500), (mapping.encounter_map, 12_000)])
def test_any_number_of_visits_gets_surrogates(spark, build, n):
    key = "appointment_id" if n == 1_500 else "encounter_id"
    visits = spark.range(n + 5).select(
        F.when(F.col("id") < n, 1).otherwise(2).alias("patient_key"), F.col("id").alias(key), F.lit(date(2020, 1, 1)).alias("visit_date")
    )
    people = spark.createDataFrame([(1, 7000001), (2, 7000002)], "patient_key int, sur_patient_id bigint")
    out = build(visits, people)
    surrogate = [c for c in out.columns if c.startswith("sur_") and c != "sur_patient_id"][0]
    got = out.agg(F.count(surrogate).alias("n"), F.count_distinct(surrogate).alias("d")).first()
    assert (got["n"], got["d"]) == (n + 5, n + 5)


# --- notes ------------------------------------------------------------------------------------------------------------

NAMES = ["Ann", "Bob Lee", "O'Neil", "a.b", "Al", "Mary Ann Smith Jones", "###"]


def _notes(spark):
    data = [
        (1, 10, "Ann met Annabel and bob  lee, BOB LEE."),
        (2, 10, "Mr. O'Neil wrote Mary Ann Smith Jones; al, alone ###"),
        (3, 20, "Ann and Bob Lee are not known here"),
        (4, None, "Ann"),
        (5, 10, None),
    ]
    return spark.createDataFrame(data, "note_id int, sur_patient_id int, note string")


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_all_ways_of_masking_give_the_same(spark, limit):
    pii = spark.createDataFrame([(10, n) for n in NAMES] + [(20, "Zed"), (10, None), (10, " none ")], "sur_patient_id int, name string")
    terms = notes.pii_terms(pii, {"name": "((N))"})
    got = {r["note_id"]: r["note"] for r in notes.mask_patient_values(_notes(spark), "note_id", "note", terms, limit=limit).collect()}
    assert got[1] == "((N)) met Annabel and bob  lee, ((N))."
    assert got[2] == "Mr. ((N)) wrote ((N)); ((N)), alone ((N))"
    assert got[3] == "Ann and Bob Lee are not known here"
    assert got[4] == "Ann" and got[5] is None


@pytest.mark.parametrize("limit", [1, 200])
def test_longest_value_wins_over_all_masks(spark, limit):
    texts = ["saw ann lee today", "patient Name is ann", "§§ and §§x, 'lee'", "LEE ann/lee; ann lee-x", "ann@mail.org annx"]
    df = spark.createDataFrame([(i, 10, t) for i, t in enumerate(texts)], "note_id int, sur_patient_id int, note string")
    terms = [("a much longer value", "((A))"), ("ann", "((A))"), ("ann lee", "((B))"), ("lee", "((C))"), ("patient", "((NAME))"), ("name", "((B))"), ("§§", "((S))")]
    for extra in ([], [("unrelated", "((0))"), ("zz", "((9))")]):
        frame = spark.createDataFrame([(10, v, m) for v, m in terms + extra], "sur_patient_id int, value string, mask string")
        got = dict(rows(notes.mask_patient_values(df, "note_id", "note", frame, limit=limit)[["note_id", "note"]]))
        assert list(got.values()) == [
            "saw ((B)) today", "((NAME)) ((B)) is ((A))", "§§ and §§x, ((C))", "((C)) ((A))/((C)); ((B))-x", "ann@mail.org annx",
        ]
        assert dict(rows(notes.mask_dictionary(df, "note_id", "note", frame.drop("sur_patient_id"))[["note_id", "note"]])) == got


@pytest.mark.parametrize("chunk", [1, 200])
def test_near_values(spark, chunk):
    df = spark.createDataFrame([(1, 10, "Jonson saw Johnson, mary ane and Bob"), (2, 10, "nothing here")], "note_id int, sur_patient_id int, note string")
    pii = spark.createDataFrame([(10, "Johnson"), (10, "Mary Anne"), (10, "Unrelated")], "sur_patient_id int, name string")
    out = notes.mask_near_values(df, "note_id", "note", notes.pii_terms(pii, {"name": "((N))"}), chunk=chunk)
    assert rows(out, "note_id", "note") == [(1, "((N)) saw ((N)), ((N)) and Bob"), (2, "nothing here")]


def test_rows_with_long_work_are_dealt_to_tasks_of_bounded_size(spark, tmp_path):
    spark.range(5 * scan.TASK_ROWS, numPartitions=1).write.parquet(str(tmp_path / "t"))
    assert scan.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() == 5


def test_near_values_reads_its_notes_once(spark):
    """Exact masking and what made the notes run once, not again for the pairs and the result; runs that stand twice count once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def note(text):
        made.add(1)
        return text

    texts = [(1, 10, "nam sent nam, then nam"), (2, 10, "x"), (None, 10, "nam")]
    df = spark.createDataFrame(texts, "note_id int, sur_patient_id int, t string").withColumn("note", note("t"))
    terms = spark.createDataFrame([(10, "name", "((NAME))"), (10, "nam sent", "((B))")], "sur_patient_id int, value string, mask string")
    got = {r.t: r.note for r in notes.mask_near_values(df, "note_id", "note", terms).collect()}
    assert got == {"nam sent nam, then nam": "((B)) ((NAME)), then ((NAME))", "x": "x", "nam": "nam"}
    assert made.value == 3


def test_notes_are_dealt_out_behind_their_join(spark, tmp_path):
    """Also where the join shuffles and Spark would leave a few large tasks."""
    many = spark.range(5 * scan.TASK_ROWS)
    many.selectExpr("id AS o_orderkey", "id AS o_custkey", "TIMESTAMP '2000-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    many.selectExpr("id AS c_custkey", "'x' AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = base.notes(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(dealt) == 5 and sum(r["count"] for r in dealt) == 5 * scan.TASK_ROWS


def made_once(spark, df, column):
    """The frame with a column that counts how often it is made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(text):
        made.add(1)
        return text

    return df.withColumn(column, same(column)), made


@pytest.mark.parametrize("limit", [0, 1])
def test_notes_and_values_of_people_with_many_values_are_made_once(spark, limit):
    df, noted = made_once(spark, spark.createDataFrame([(1, 10, "ann lee 7"), (2, 11, "bob"), (3, None, "ann")], "note_id int, sur_patient_id int, note string"), "note")
    terms, valued = made_once(spark, spark.createDataFrame([(10, "ann", "((A))"), (10, "lee", "((B))"), (11, "bob", "((A))")], "sur_patient_id int, value string, mask string"), "value")
    assert rows(notes.mask_patient_values(df, "note_id", "note", terms, limit=limit).select("note_id", "note")) == [(1, "((A)) ((B)) 7"), (2, "((A))"), (3, "ann")]
    assert (noted.value, valued.value) == (3, 3)


def test_texts_are_cleaned_once_for_standard_terms(spark):
    df, made = made_once(spark, spark.createDataFrame([(1, "Größe: ALPHA–Beta\t(alpha)"), (2, None)], "id int, t string"), "t")
    terms = spark.createDataFrame([("Alpha", "1", "ONE", 1), ("grosse", "2", "TWO", 1)], "term string, code string, display string, priority int")
    got = dict(rows(validity.standardise_terms(df, "id", "t", terms)))
    assert got[2] == "" and got[1].split(" ")[1:] == ["alphabeta", "ONE"]
    assert made.value == 2


def test_dictionary_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30)))) for i in range(200)]
    terms = ["beta", "gamma delta", "eps zeta alpha beta"]
    df = spark.createDataFrame(texts, "id int, t string")
    dictionary = spark.createDataFrame([(t, "#") for t in terms], "value string, mask string")
    got = dict(rows(notes.mask_dictionary(df, "id", "t", dictionary)))
    for i, t in texts:
        left, out = t.split(" "), []
        while left:
            hit = next((w for w in sorted(terms, key=len, reverse=True) if left[: len(w.split())] == w.split()), None)
            out.append("#" if hit else left[0])
            left = left[len(hit.split()) if hit else 1 :]
        assert got[i] == " ".join(out)


def test_entities(spark):
    docs = spark.createDataFrame([(1, "Ann Lee on 2020-01-02 and 1990-05-06 at Rome", "Ann Lee", "1990-05-06"), (2, "none", "X", None)], "id int, t string, name string, dob string")
    found = notes.find_entities(docs, "id", "t", {"PERSON": r"Ann Lee|Rome", "DATE": r"\d{4}-\d{2}-\d{2}"})
    assert (1, "PERSON", 0, 7, "Ann Lee") in rows(found)
    out = notes.anonymise_entities(docs, "id", "t", found, 10, name="name", dob="dob")
    assert rows(out, "id", "t") == [(1, "<PERSON> on 2020-01-12 and 1990 at Rome"), (2, "none")]


def test_whole_note_leaves_no_value(spark):
    pii = spark.createDataFrame([(10, "Ann", "Lee", "1980-03-04")], "sur_patient_id int, first string, last string, dob string")
    df = spark.createDataFrame([(1, 10, 5, "AnnLee (Ann, lee) born 03/04/1980,\n seen 2020-01-01; a@b.org ^ 716-555-0101")], "note_id int, sur_patient_id int, day_offset int, note string")
    options = NotesOptions(pii=pii, masks={"first": "((F))", "last": "((L))"}, combine=(("first", "last"), "((FULL))"), dob="dob")
    out = mask_notes(df, "note_id", "note", options)
    assert out.first()["note"] == "((FULL)) (((F)), ((L))) born 1980, seen    2020-01-06   ; ((EMAIL_ID)) ((PHONE_NUMBER))"
    terms = notes.pii_terms(pii, {"first": "f", "last": "l"})
    checked = notes.attach_terms(out, "note_id", "note", terms)
    assert checked.select(F.size(quality.leaked_values("note", "terms")).alias("n")).first()["n"] == 0


# --- whole tables, samples, sources -----------------------------------------------------------------------------------


def test_before_is_after_plus_rejects(spark):
    df = spark.createDataFrame([(1, 10, "x"), (2, 11, "y"), (3, None, "z")], "id int, pid int, name string")
    people = spark.createDataFrame([(10, 500, 12)], "pid int, sur_patient_id bigint, day_offset int")
    spec = TableSpec("t", (ColumnRule("pid", "PATIENT_PID"), ColumnRule("name", "MASK", "N", ignore=IgnoreRule((("id", "eq", 1),), "and"))))
    done = deidentify_table(df, spec, Maps(people), Options(run="r7"))
    assert rows(done.table) == [(1, 500, "x")]
    assert sorted(r["row_json"] for r in done.rejects.collect()) == ['{"id":2,"pid":11,"name":"y"}', '{"id":3,"name":"z"}'] or done.rejects.count() == 2
    no_keys = deidentify_table(df, TableSpec("t", (ColumnRule("name", "MASK", "N"),)), Maps(people))
    assert no_keys.table.count() == 3 and no_keys.rejects.count() == 0


def test_spec_from_json_and_sheet():
    text = '{"table_name": "t", "columns_details": [{"column_name": "a", "is_phi": true, "de_identification_rule": "PATIENT_CHART", "ignore_column": {"operation": "or", "columns": [{"name": "b", "condition": "gt", "value": 1}]}}], "ignore_rows": {"columns": [{"name": "b", "condition": "eq", "value": 0}]}}'
    spec = TableSpec.from_json(text)
    assert spec.rules[0].patient_kind == "chart" and spec.rules[0].ignore.operation == "or"
    assert spec.ignore_rows.conditions == (("b", "eq", 0),)
    sheet = TableSpec.from_sheet([{"TABLE_NAME": "t", "COLUMN_NAME": "z", "IS_PHI": "Yes", "DE_IDENTIFICATION_RULE": "ZIP_CODE", "MASK_VALUE": ""}])
    assert sheet["t"].columns_with("ZIP_CODE") == ["z"]


@pytest.mark.parametrize(
    "source, want",
    [("NUMBER(3,0)", "tinyint"), ("NUMBER(10,0)", "int"), ("NUMBER(22,0)", "decimal(22,0)"), ("NUMBER(38,10)", "decimal(38,10)"),
     ("VARCHAR(16777216)", "string"), ("TIMESTAMP_NTZ(9)", "timestamp_ntz"), ("GEOGRAPHY", "string"), ("FLOAT", "double")],
)
def test_target_type(source, want):
    assert scan.target_type(source) == want


def test_stratified_sample_holds_every_stratum(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1990, "big").otherwise("rare").alias("s"), (F.col("id") % 100).alias("x"))
    out = sampling.stratified_sample(df, ["s", "x"], 5, 60, "id", "seed")
    assert out.count() == 60 and out.where("s = 'rare'").count() >= 5
    assert rows(out, "id") == rows(sampling.stratified_sample(df, ["s", "x"], 5, 60, "id", "seed"), "id")


def test_merge_qc_joins_reasons(spark):
    chunks = spark.createDataFrame([("t", "c", 1, 2, ["b"]), ("t", "c", 3, 0, []), ("t", "c", 0, 1, ["a", "b"])], "table_name string, column_name string, passed int, failed int, reasons array<string>")
    assert rows(merge_qc(chunks)) == [("t", "c", 4, 3, "a; b")]


def test_export_and_manifest(spark, tmp_path):
    df = spark.range(10)
    sink.export(df, str(tmp_path / "a"), rows_per_file=3)
    sink.export(df, str(tmp_path / "b"), fmt="csv")
    files = sink.manifest(spark, str(tmp_path))
    assert files.where("bytes > 0 AND length(md5) = 32").count() == files.count() >= 2


def test_manifest_hashes_every_file(spark, tmp_path):
    spark.range(5000).selectExpr("id", "repeat('x', 100) AS text").repartition(3).write.parquet(str(tmp_path / "in put" / "t"))
    (tmp_path / "in put" / "empty.bin").write_bytes(b"")
    found = {os.path.basename(r["path"]): (r["md5"], r["bytes"]) for r in sink.manifest(spark, str(tmp_path / "in put")).collect()}
    files = [f for f in (tmp_path / "in put").rglob("*") if f.is_file() and f.name[0] not in "._" and f.stat().st_size]
    assert found == {f.name: (hashlib.md5(f.read_bytes()).hexdigest(), f.stat().st_size) for f in files} and len(found) == 3


def test_export_limits_bytes_per_file(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "repeat('x', 92) AS text").coalesce(1)
    assert sink.row_width(df) == 100.0
    sink.export(df, str(tmp_path / "t"), "csv", bytes_per_file=20_000)
    assert sink.manifest(spark, str(tmp_path / "t")).count() == 5
    sink.export(df.limit(0), str(tmp_path / "none"))
    assert sink.row_width(df.limit(0)) == 0.0


def test_id_columns_in_one_scan(spark):
    t = spark.createDataFrame([(1, 7, None), (1, 8, None), (2, 9, None), (None, 7, None)], "a_id int, b_id long, c_id int")
    people = spark.createDataFrame([(1,), (1,), (2,)], "p int")
    visits = spark.createDataFrame([(7,), (8,)], "v long")
    out = profile.detect_id_columns({"t": t, "none": spark.range(1).toDF("x")}, {"person": (people, "p"), "visit": (visits, "v")}, "_id$", "IS_{kind}")
    assert rows(out) == [
        ("t", "a_id", "person", 1.0, "IS_PERSON"), ("t", "a_id", "visit", 0.0, None), ("t", "b_id", "person", 0.0, None),
        ("t", "b_id", "visit", 0.75, "IS_VISIT"), ("t", "c_id", "person", None, None), ("t", "c_id", "visit", None, None),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("a_id") and plan.count("LogicalRDD") <= 4  # one scan a table, one a kind and the names


@pytest.mark.parametrize("ranges", [1, 7, joins.RANGES])
@pytest.mark.parametrize("key", ["int", "string"])
def test_difference_by_range_equals_plain(spark, ranges, key):
    base = spark.range(300).selectExpr(f"CAST(id AS {key}) AS k", "id % 5 AS v", "CAST(NULL AS string) AS n")
    newer = base.unionByName(base.where("v = 3 AND k < 40")).unionByName(spark.sql(f"SELECT CAST(NULL AS {key}) AS k, 1L AS v, 'x' AS n"))
    older = base.where("k <> 17").withColumn("v", F.expr("IF(k = 250, 9, v)"))
    want = rows(joins.dump_difference(newer, older).select(F.coalesce(F.col("k").cast("string"), F.lit("none")).alias("k"), "v"), "k", "v")
    got = rows(joins.dump_difference_by_range(newer, older, "k", (), ranges).select(F.coalesce(F.col("k").cast("string"), F.lit("none")).alias("k"), "v"), "k", "v")
    assert got == want and {r[0] for r in want} == {"17", "250", "none"}


def test_equal_copies_open_no_range(spark):
    df = spark.range(1000).selectExpr("id AS k", "id % 3 AS v")
    again = df.unionByName(df.where("v = 1"))
    assert joins.unequal_ranges(df, df.orderBy(F.desc("k")), "k")[0].isEmpty()
    assert joins.unequal_ranges(again, df, "k")[0].count() == 333
    assert joins.dump_difference_by_range(df.limit(0), df.limit(0), "k").isEmpty()


def test_read_keys(spark, tmp_path):
    (tmp_path / "k.csv").write_text("table_name,primary_key\nt1,a|b\nt2, c \nt3,\n")
    keys = {r["table_name"]: r["key_columns"] for r in scan.read_keys(spark, str(tmp_path / "k.csv")).collect()}
    assert keys == {"t1": ["a", "b"], "t2": ["c"]}


def test_incremental_scan_without_history_reads_all(spark):
    df = spark.createDataFrame([(1, date(2020, 1, 1)), (2, date(2020, 1, 3))], "id int, at date")
    assert scan.incremental_scan(df, df.limit(0), "at", date(2020, 1, 2)).count() == 2
    assert rows(scan.incremental_scan(df, df.where("id = 1"), "at", date(2020, 1, 4)), "id") == [(2,)]


def test_column_checks_report_both_reasons(spark):
    pairs = spark.createDataFrame([(1, "x", "700"), (2, "y", "81"), (3, "z", None)], "id int, c_before string, c_after string")
    out = quality.check_columns(pairs, [quality.ColumnCheck("c", "PATIENT_ID", {"length": 3, "prefix": "7"})], "t").first()
    assert (out["passed"], out["failed"], len(out["reasons"])) == (1, 2, 2)


def test_versions_null_keys_and_ids_never_given_twice(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "v"), ("k",))
    runs = [
        [(None, 1, "a"), (1, 1, "b")], [(None, 2, "c"), (1, 0, "late")], [], [(2, 1, "d"), (None, None, "unknown"), (None, 3, "e")], [], [(1, 9, "f")],
    ]
    for n, rows_ in enumerate(runs):
        table.merge(spark.createDataFrame(rows_, "k int, last_updated int, v string"), n)
    history = table.history().collect()
    ids = [r["row_id"] for r in history]
    assert len(ids) == len(set(ids)) == 8 and max(ids) == 8
    assert sorted((str(r["k"]), r["v"]) for r in history if r["active_flag"] == "Y") == [("1", "f"), ("2", "d"), ("None", "e")]
    table.retain(2)
    assert table.runs() == [4, 5] and table.history().count() == 8


def test_clean_term_folds_letters_beyond_latin_1(spark):
    from recordshield.functions.clean import clean_term

    df = spark.createDataFrame([("Čapek ŞİŞ ő Ǆ ệ ß",)], "t string")
    assert df.select(clean_term("t").alias("c")).first()["c"].startswith("capek sis o d e")


def test_update_knows_persons_by_any_identifier(spark):
    old = spark.createDataFrame([("1", "c1", 5, 11), (None, "c2", 6, 12), ("3", "c3", 7, 13)], "patient string, chart string, sur_patient_id long, day_offset int")
    first = spark.createDataFrame([("c1", "p1"), ("c9", "p9"), (None, "p2")], "chart string, profile string")
    second = spark.createDataFrame([("20", "c2"), ("30", "c3"), ("31", "c3"), ("90", "c90"), ("91", "c8")], "patient string, chart string")
    third = spark.createDataFrame([("p2", "c2"), ("p9", "c90"), ("p4", "c44")], "profile string, chart string")
    index = spark.createDataFrame([("chart", "c8", 7)], "kind string, value string, sur_patient_id long")
    kinds = ["chart", "patient", "profile"]
    got = mapping.update_patient_map(old, [first, second, third], kinds, "patient", "salt", index)
    rows = {(r["patient"], r["chart"], r["profile"], r["sur_patient_id"]) for r in got.collect()}
    assert rows == {("1", "c1", "p1", 5), ("20", "c2", "p2", 6), ("3", "c3", None, 7), ("90", "c9", "p9", 9), (None, "c44", "p4", 8)}
    # the same sources once more add nobody
    assert mapping.update_patient_map(got, [first, second, third], kinds, "patient", "salt", index).count() == 5


def test_map_update_is_bounded_by_its_increment(spark):
    """Of a map of 20,000 persons only what the increment names goes into the components; two known persons are joined through new rows."""
    old = spark.range(20000).selectExpr("CONCAT('c', id) AS chart", "CONCAT('p', id) AS profile", "id AS sur_patient_id")
    fresh = spark.createDataFrame([("c5", "p77"), ("c9", "new"), ("x1", "x2"), (None, None)], "chart string, profile string")
    rows_ = mapping.identifier_nodes([fresh], ["chart", "profile"])
    links = mapping.met_links([old], rows_, "sur_patient_id", ["chart", "profile"])
    assert sorted(r["nodes"] for r in links.collect()) == [
        ["chart:c5", "sur_patient_id:5"], ["chart:c9", "sur_patient_id:9"], ["profile:p77", "sur_patient_id:77"],
    ]
    got = mapping.update_patient_map(old, [fresh], ["chart", "profile"], "chart", "salt")
    changed = got.select(*old.columns).exceptAll(old)
    assert rows(changed) == [("x1", "x2", 20000)] and got.count() == 20001
    assert mapping.update_patient_map(old, [fresh.limit(0)], ["chart", "profile"], "chart", "salt").count() == 20000


def test_only_runs_that_may_be_terms_leave_the_scan(spark):
    texts = spark.range(40).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(30)]).alias("note"))
    terms = spark.createDataFrame([("w3x7", "#"), ("W4X8 w5x8 w6x8 w7x8", "##"), ("not there", "#")], "value string, mask string")
    table = notes._lookup_table(terms.select(notes._head(F.col("value"), 3).alias("__gram")))
    grams = texts.select(F.explode(F.transform(notes._grams(F.col("note"), 3), lambda g: F.xxhash64(g))).alias("g"))
    kept = grams.withColumn("t", table).where(notes._may_be(F.col("g"), F.col("t"))).count()
    assert 2 <= kept <= 4 and grams.count() == 40 * 87
    got = {r["id"]: r["note"] for r in notes.mask_dictionary(texts, "id", "note", terms).collect()}
    assert got[7].split()[3] == "#" and got[8].split()[3:6] == ["w3x8", "##", "w8x8"] and "#" not in got[9]


def _files(folder):
    return {str(f): f.stat().st_mtime_ns for f in pathlib.Path(folder).rglob("part-*.parquet")}


def test_a_merge_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "table")
    store = BucketedTable(spark, path, ("k", "l"), buckets=8)
    whole = VersionedTable(spark, str(tmp_path / "whole"), ("k", "l"))
    schema = "k long, l string, v string, last_updated long"
    first = spark.createDataFrame([(i % 50, "a" if i % 3 else None, f"v{i}", i) for i in range(200)] + [(None, None, "n", 1)], schema)
    assert store.merge(first, 1) == set(range(8))
    before = _files(f"{path}/current")
    one = spark.createDataFrame([(7, "a", "new", 500), (7, "a", "late", 2)], schema)
    touched = store.merge(one, 2)
    after = _files(f"{path}/current")
    assert len(touched) == 1 and {k: after[k] for k in before} == before
    assert {p.split("bucket=")[1].split("/")[0] for p in set(after) - set(before)} == {str(b) for b in touched}
    assert store.merge(one, 2) == touched and {k: _files(f"{path}/current")[k] for k in before} == before
    # a later run with a column more, then the same runs as whole copies
    third = spark.createDataFrame([(None, None, "n2", 2, "x"), (99, "b", "v", None, "y")], schema + ", w string")
    store.merge(third, 3)
    for run, rows_of in enumerate((first, one, third), 1):
        whole.merge(rows_of, run)
    columns = ["k", "l", "v", "last_updated", "w", "row_id", "active_flag"]
    assert sorted(map(repr, store.history().select(columns).collect())) == sorted(map(repr, whole.history().select(columns).collect()))
    assert store.merge(first.limit(0), 4) == set() and store.current().count() == whole.current().count()
    store.retain(1)
    assert store.current().count() == whole.current().count() and store.runs() == [4]


def _exchanges(plan, column):
    """The exchanges of a plan that carry a column."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.initialPlan()
    carried = any(plan.output().apply(i).name() == column for i in range(plan.output().size()))
    below = sum(_exchanges(plan.children().apply(i), column) for i in range(plan.children().size()))
    return below + (carried and plan.nodeName() == "Exchange")


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_the_text_of_a_note_is_moved_once_and_not_written(spark, tmp_path, monkeypatch, limit):
    """Notes without a value stay in their scan; ids that repeat, null ids and null persons included."""
    data = [(1, 1, "ann MET Ann Lee at Öz"), (1, 2, "ANN met bo"), (2, 2, "bo, ann lee"), (3, 3, "ann bo"), (None, 1, "ann"), (4, None, "ann"), (5, 1, None)]
    spark.createDataFrame(data, "id long, who long, note string").write.parquet(str(tmp_path / "notes"))
    terms = spark.createDataFrame([(1, "Ann", "((N))"), (1, "Ann Lee", "((N))"), (1, "öz", "((P))"), (2, "bo", "((N))"), (None, "bo", "((N))")], "who long, value string, mask string")
    monkeypatch.setattr(session, "scratch_folder", lambda spark: str(tmp_path / "scratch"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = spark.read.parquet(str(tmp_path / "notes")).select("id", "who", F.trim("note").alias("note"))
        done = notes.mask_patient_values(read, "id", "note", terms, "who", limit)
        assert _exchanges(done._jdf.queryExecution().executedPlan(), "note") == 1
        got = sorted(map(str, (tuple(r) for r in done.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not list((tmp_path / "scratch" / "recordshield").glob("notes-*"))
    # a note without an id is looked up by nothing, notes of one id are looked up together
    shared, unnamed = (("((N)) met ((N))", "ann") if limit == 0 else ("ANN met ((N))", "((N))"))
    want = [(1, 1, "((N)) MET ((N)) at ((P))"), (1, 2, shared), (2, 2, "((N)), ann lee"), (3, 3, "ann bo"), (None, 1, unnamed), (4, None, "ann"), (5, 1, None)]
    assert got == sorted(map(str, want))


def test_frames_that_are_scans_are_not_written(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert session.is_scan(read) and session.is_scan(read.where("id > 1").select((F.col("id") + 1).alias("n")))
    for other in (read.repartition(2), read.distinct(), read.join(read, "id"), read.select(F.rand().alias("r")), spark.range(5), read.limit(2)):
        assert not session.is_scan(other)
    stream = spark.readStream.format("rate").load().selectExpr("value AS id", "value AS who", "'Ann' AS note")
    assert not session.is_scan(stream)
    assert notes.mask_patient_values(stream, "id", "note", spark.createDataFrame([(1, "Ann", "#")], "who long, value string, mask string"), "who").isStreaming
