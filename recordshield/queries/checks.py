"""Quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import RuleContext, apply_rule
from ..functions.text import replace_words
from ..operators import quality as Q
from ..operators.joins import PatientKey, map_patient, pair_by_id, resolve_identity
from ..operators.notes import attach_terms, mask_patient_values, pii_terms
from ..operators.numbering import number_rows
from ..operators.reports import union_all
from .base import LINE_KEY, MAPS_SQL, NOTES_SQL, PATIENTS_SQL, encounters, patients, query, table, text_table
from .masking import whole_table
from .texts import NAME_MASK, owned_notes, pii

_STATUS = """CASE WHEN before_rows - after_rows = ignored_rows THEN 'PASS' WHEN before_rows > after_rows AND ignored_rows > 0 THEN 'NEED_TO_CHECK' ELSE 'FAILED' END"""


@query(
    "q1_count_qc",
    f"""
WITH pmap AS ({PATIENTS_SQL}), c AS (
  SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS before_rows, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT custkey FROM pmap) AND o_totalprice >= 5000) AS after_rows,
         (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT custkey FROM pmap)) AS ignored_rows
  UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM pmap), (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT custkey FROM pmap))
  UNION ALL SELECT 'events', (SELECT count(*) FROM events), (SELECT count(*) FROM events), 0
  UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier WHERE s_acctbal > 0), 0)
SELECT table_name, before_rows, after_rows, before_rows - after_rows AS diff, ignored_rows, {_STATUS} AS status FROM c
""",
)
def q1(spark, sf):
    orders, cust, events, supp = (table(spark, sf, t) for t in ("orders", "customer", "events", "supplier"))
    people = patients(spark, sf)
    none = events.where(F.lit(False)).agg(F.count(F.lit(1)).alias("ignored_rows"))
    return union_all(
        [
            Q.count_qc("orders", orders, whole_table(spark, sf).table, Q.ignored_direct(orders, "o_custkey", people, "custkey")),
            Q.count_qc("customer", cust, people, Q.ignored_direct(cust, "c_custkey", people, "custkey")),
            Q.count_qc("events", events, events, none),
            Q.count_qc("supplier", supp, supp.where("s_acctbal > 0"), none),
            Q.count_qc("empty", events.where(F.lit(False)), events, none),
        ]
    )


def _numbered_lines(spark, sf):
    return number_rows(table(spark, sf, "lineitem").select(*LINE_KEY), LINE_KEY)


@query(
    "q2_expected_ignored",
    f"""
WITH {MAPS_SQL},
o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS k FROM orders)
SELECT 'direct' AS strategy, (SELECT count(*) FROM o WHERE k IS NULL OR k NOT IN (SELECT custkey FROM pmap)) AS ignored_rows
UNION ALL SELECT 'mapping', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT encounter_id FROM emap))
UNION ALL SELECT 'hop', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT custkey FROM pmap))
UNION ALL SELECT 'chain', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2))
""",
)
def q2(spark, sf):

    people, orders = patients(spark, sf), table(spark, sf, "orders")
    some_null = orders.withColumn("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    lines = _numbered_lines(spark, sf)
    to_customer = (some_null, "o_orderkey", "o_custkey")
    to_nation = (table(spark, sf, "customer"), "c_custkey", "c_nationkey")
    regions = table(spark, sf, "nation").where("n_regionkey <> 2")
    counts = {
        "direct": Q.ignored_direct(some_null, "o_custkey", people, "custkey"),
        "mapping": Q.ignored_direct(orders, "o_orderkey", encounters(spark, sf), "encounter_id"),
        "hop": Q.ignored_via_hop(lines, "row_id", "l_orderkey", [to_customer], people, "custkey"),
        "chain": Q.ignored_via_hop(lines, "row_id", "l_orderkey", [(orders, "o_orderkey", "o_custkey"), to_nation], regions, "n_nationkey"),
    }
    return union_all([c.select(F.lit(n).alias("strategy"), "ignored_rows") for n, c in counts.items()])


@query(
    "q3_strategy_choice",
    f"""
WITH pmap AS ({PATIENTS_SQL})
SELECT 'orders' AS table_name, 'direct' AS strategy, count(*) AS ignored_rows FROM orders WHERE o_custkey NOT IN (SELECT custkey FROM pmap)
UNION ALL SELECT 'lineitem', 'hop', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT custkey FROM pmap)
UNION ALL SELECT 'part', 'not available', NULL
UNION ALL SELECT 'all_null', 'not available', NULL
""",
)
def q3(spark, sf):
    people, orders = patients(spark, sf), table(spark, sf, "orders")
    preferred = ["patient_id", "o_custkey", "user_id"]
    lines = _numbered_lines(spark, sf)
    specs = {
        "orders": (orders, None),
        "lineitem": (lines, Q.IgnoreSpec("l_orderkey", ((orders, "o_orderkey", "o_custkey"),), "row_id")),
        "part": (table(spark, sf, "part"), None),
        "all_null": (orders.withColumn("o_custkey", F.lit(None).cast("bigint")), None),
    }
    rows = []
    for name, (df, given) in specs.items():
        strategy, spec = Q.choose_strategy(df, given, preferred)
        if spec is None:
            counted = df.agg(F.lit(None).cast("bigint").alias("ignored_rows"))
        elif spec.hops:
            counted = Q.ignored_via_hop(df, spec.row_id, spec.column, spec.hops, people, "custkey")
        else:
            counted = Q.ignored_direct(df, spec.column, people, "custkey")
        rows.append(counted.select(F.lit(name).alias("table_name"), F.lit(strategy).alias("strategy"), "ignored_rows"))
    return union_all(rows)


def _shown(results):
    return results.select("table_name", "column_name", "rule", "passed", "failed", F.array_join("reasons", "; ").alias("reasons"))


def _check_sql(source, column, rule, good, reason):
    return f"""SELECT '{source}' AS table_name, '{column}' AS column_name, '{rule}' AS rule, count(*) FILTER ({good}) AS passed, count(*) FILTER (NOT ({good})) AS failed,
       CASE WHEN count(*) FILTER (NOT ({good})) > 0 THEN '{reason}' ELSE '' END AS reasons"""


def _customers(spark, sf):
    """Masked customers, wrongly so for some segments."""
    cust = table(spark, sf, "customer").withColumn("zip", F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))
    wrong = F.col("c_mktsegment") == "BUILDING"
    after = cust.withColumns(
        {
            "zip": F.when(wrong, F.col("zip")).otherwise(apply_rule("ZIP_CODE", "zip", RuleContext())),
            "c_name": F.when(wrong, F.col("c_name")).otherwise(apply_rule("MASK", "c_name", RuleContext(mask="NAME"))),
        }
    )
    return pair_by_id(cust, after, "c_custkey", ["zip", "c_name"])


_ZIP_REASON, _MASK_REASON = "zip code rule not applied correctly for some rows", "mask not applied"


@query("q4_zip_check", _check_sql("customer", "zip", "ZIP_CODE", "c_mktsegment <> 'BUILDING'", _ZIP_REASON) + " FROM customer")
def q4(spark, sf):
    return _shown(Q.check_columns(_customers(spark, sf), [Q.ColumnCheck("zip", "ZIP_CODE")], "customer"))


@query(
    "q5_dob_check",
    _check_sql("orders", "dob", "DOB", "o_orderpriority <> '5-LOW'", "dob rule not correctly applied") + " FROM orders",
)
def q5(spark, sf):
    orders = table(spark, sf, "orders").withColumn("dob", F.col("o_orderdate").cast("date").cast("string"))
    year = apply_rule("DOB", "dob", RuleContext()).cast("string")
    after = orders.withColumn("dob", F.when(F.col("o_orderpriority") == "5-LOW", F.col("dob")).when(F.col("o_orderstatus") != "P", year))
    return _shown(Q.check_columns(pair_by_id(orders, after, "o_orderkey", ["dob"]), [Q.ColumnCheck("dob", "DOB")], "orders"))


@query(
    "q6_static_offset_check",
    _check_sql("lineitem", "l_shipdate", "STATIC_OFFSET", "l_returnflag = 'N'", "static offset not applied") + " FROM lineitem",
)
def q6(spark, sf):
    before = number_rows(table(spark, sf, "lineitem").select(*LINE_KEY, "l_returnflag"), LINE_KEY)
    good = apply_rule("STATIC_OFFSET", "l_shipdate", RuleContext(T.TimestampNTZType()))
    after = before.withColumn("l_shipdate", F.when(F.col("l_returnflag") == "N", good).when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    return _shown(
        Q.check_columns(pair_by_id(before, after, "row_id", ["l_shipdate"]), [Q.ColumnCheck("l_shipdate", "STATIC_OFFSET")], "lineitem")
    )


@query("q7_mask_check", _check_sql("customer", "c_name", "MASK", "c_mktsegment <> 'BUILDING'", _MASK_REASON) + " FROM customer")
def q7(spark, sf):
    return _shown(Q.check_columns(_customers(spark, sf), [Q.ColumnCheck("c_name", "MASK", {"mask": "NAME"})], "customer"))


def _order_pairs(spark, sf):
    """Orders before and after: one status keeps its dates, so that the check has something to find."""
    mapped = map_patient(table(spark, sf, "orders"), patients(spark, sf), [PatientKey("o_custkey", "custkey")])
    owned = resolve_identity(mapped, ["custkey"], 34)
    known = owned.where("sur_patient_id IS NOT NULL")
    shifted = apply_rule("DATE_OFFSET", "o_orderdate", RuleContext(T.TimestampNTZType()))
    after = known.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).otherwise(shifted).alias("o_orderdate"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("sur_patient_id") + 1000000000000).otherwise(F.col("sur_patient_id")).alias("o_custkey"),
        "day_offset",
    )
    pairs = pair_by_id(known, after.drop("day_offset"), "o_orderkey", ["o_orderdate", "o_custkey"])
    return pairs.join(after.select("o_orderkey", "day_offset"), "o_orderkey")


_MAPPED = f"FROM orders WHERE o_custkey IN (SELECT custkey FROM ({PATIENTS_SQL}))"
_OFFSET_REASON = "date offset not correctly applied for some rows"


@query("q8_patient_offset_check", _check_sql("orders", "o_orderdate", "DATE_OFFSET", "o_orderstatus <> 'P'", _OFFSET_REASON) + " " + _MAPPED)
def q8(spark, sf):
    check = Q.ColumnCheck("o_orderdate", "DATE_OFFSET", {"offset": F.col("day_offset")})
    return _shown(Q.check_columns(_order_pairs(spark, sf), [check], "orders"))


_SHAPE = "length verification failed; prefix verification failed"


@query("q9_patient_id_shape", _check_sql("orders", "o_custkey", "PATIENT_ID", "o_orderpriority <> '5-LOW'", _SHAPE) + " " + _MAPPED)
def q9(spark, sf):
    check = Q.ColumnCheck("o_custkey", "PATIENT_ID", {"length": 7, "prefix": "70"})
    return _shown(Q.check_columns(_order_pairs(spark, sf), [check], "orders"))


@query(
    "q10_encounter_id_shape",
    f"WITH {MAPS_SQL} " + _check_sql("orders", "encounter", "ENCOUNTER_ID", "sur_encounter_id IS NOT NULL", _SHAPE) + " FROM orders LEFT JOIN emap ON o_orderkey = encounter_id",
)
def q10(spark, sf):

    visits = encounters(spark, sf).select("encounter_id", "sur_encounter_id")
    orders = table(spark, sf, "orders")
    pairs = orders.join(visits, orders["o_orderkey"] == visits["encounter_id"], "left").select(
        F.col("o_orderkey").alias("encounter_before"), F.col("sur_encounter_id").alias("encounter_after")
    )
    check = Q.ColumnCheck("encounter", "ENCOUNTER_ID", {"length": 8, "prefix": "9"})
    return _shown(Q.check_columns(pairs, [check], "orders"))


def _half_masked(spark, sf):
    """Notes of which one year was left unmasked."""
    owned = owned_notes(spark, sf)
    masked = mask_patient_values(owned, "note_id", "note", pii_terms(pii(spark, sf), NAME_MASK))
    both = owned.withColumnRenamed("note", "before").join(masked.select("note_id", F.col("note").alias("after")), "note_id")
    return both.withColumn("after", F.when(F.year("noted_at") == 1999, F.col("before")).otherwise(F.col("after")))


@query(
    "q11_text_leak",
    f"""
WITH pmap AS ({PATIENTS_SQL}), notes AS ({NOTES_SQL})
SELECT note_id, regexp_extract(note, 'Customer#[0-9]+') AS leaked FROM notes JOIN pmap USING (custkey) WHERE year(noted_at) = 1999
""",
)
def q11(spark, sf):
    terms = pii_terms(pii(spark, sf), NAME_MASK)
    rows = attach_terms(_half_masked(spark, sf), "note_id", "after", terms)
    leaked = rows.select("note_id", Q.leaked_values("after", "terms").alias("leaked")).where(F.size("leaked") > 0)
    return leaked.select("note_id", F.array_join("leaked", ",").alias("leaked"))


@query(
    "q12_text_dates",
    """
SELECT o_orderkey, o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW') AS follows FROM orders
""",
)
def q12(spark, sf):
    d, s = "o_orderdate", F.col("o_orderstatus")
    before = F.concat(F.lit("from "), F.date_format(d, "yyyy-MM-dd"), F.lit(" to "), F.date_format(d, "MM/dd/yyyy"), F.lit(" ok"))
    moved = F.date_format(F.date_add(d, 12), "yyyy-MM-dd")
    back = F.date_format(F.date_sub(F.col(d).cast("date"), 12), "yyyy-MM-dd")
    good = F.concat(F.lit("from "), moved, F.lit(" to "), moved, F.lit(" ok"))
    wrong_way = F.concat(F.lit("from "), back, F.lit(" to "), back, F.lit(" ok"))
    lost = F.concat(F.lit("from "), moved, F.lit(" on"))
    low = F.col("o_orderpriority") == "5-LOW"
    rows = text_table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(low & (s == "O"), F.concat(before, F.lit(" born 1990-01-01"))).otherwise(before).alias("before"),
        F.when(s == "F", good).when(low & (s == "O"), F.concat(good, F.lit(" born 1990"))).when(s == "O", wrong_way).otherwise(lost).alias("after"),
        F.lit("1990-01-01").alias("dob"),
    )
    return rows.select("o_orderkey", Q.text_dates_follow("before", "after", 12, "dob").alias("follows"))


@query(
    "q13_replacement_check",
    r"SELECT doc_id, NOT (lang = 'de' AND regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])und([^\p{L}\p{M}\p{N}_]|$)')) AS done FROM documents",
)
def q13(spark, sf):
    docs = text_table(spark, sf, "documents")
    after = F.when(F.col("lang") == "de", F.col("text")).otherwise(replace_words("text", [("und", "UNDX")]))
    rows = docs.select("doc_id", F.col("text").alias("before"), F.regexp_replace(after, "UNDX", "et").alias("after"))
    return rows.select("doc_id", Q.replacement_done("before", "after", "und", "et").alias("done"))


@query(
    "q14_text_verdict",
    f"""
WITH pmap AS ({PATIENTS_SQL}), notes AS ({NOTES_SQL}), n AS (SELECT year(noted_at) = 1999 AS leak, note_id FROM notes JOIN pmap USING (custkey))
SELECT 'notes' AS table_name, 'note' AS column_name, count(*) AS rows, count(*) FILTER (leak) AS failed, count(*) FILTER (leak) AS failed_leak, 0::BIGINT AS failed_length FROM n
""",
)
def q14(spark, sf):
    terms = pii_terms(pii(spark, sf), NAME_MASK)
    rows = attach_terms(_half_masked(spark, sf), "note_id", "after", terms)
    checks = {"leak": F.size(Q.leaked_values("after", "terms")) == 0, "length": F.length("after") > 0}
    return Q.text_verdict(rows, checks, "notes", "note")


@query(
    "q15_column_qc",
    _check_sql("orders", "o_orderdate", "DATE_OFFSET", "o_orderstatus <> 'P'", _OFFSET_REASON)
    + f" {_MAPPED} UNION ALL "
    + _check_sql("orders", "o_custkey", "PATIENT_ID", "o_orderpriority <> '5-LOW'", _SHAPE)
    + f" {_MAPPED}",
)
def q15(spark, sf):
    checks = [
        Q.ColumnCheck("o_orderdate", "DATE_OFFSET", {"offset": F.col("day_offset")}),
        Q.ColumnCheck("o_custkey", "PATIENT_ID", {"length": 7, "prefix": "70"}),
    ]
    return _shown(Q.check_columns(_order_pairs(spark, sf), checks, "orders"))


@query(
    "q15_failing_rows",
    f"SELECT 'o_orderdate' AS column_name, o_orderkey {_MAPPED} AND o_orderstatus = 'P'",
)
def q15_failing(spark, sf):
    check = Q.ColumnCheck("o_orderdate", "DATE_OFFSET", {"offset": F.col("day_offset")})
    return Q.failing_rows(_order_pairs(spark, sf), check, "o_orderkey")


