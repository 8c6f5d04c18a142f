"""Building and using identity maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping as M
from ..operators.joins import or_of_chains
from ..operators.numbering import number_rows
from .base import MAPS_SQL, PATIENTS_SQL, SALT, encounters, patients, query, table

KINDS = ["chart", "patient", "profile"]

# customers of one nation and segment share a profile, a customer's name is the chart: chains of patient - chart - profile
_NODES_SQL = """
cust AS (SELECT CAST(c_custkey AS VARCHAR) AS patient, c_name AS chart, 'P' || c_nationkey || c_mktsegment AS profile, c_acctbal < 0 AS loner FROM customer),
node AS (SELECT 'patient:' || patient AS n, CASE WHEN loner THEN 'chart:' || chart ELSE profile END AS grp FROM cust
  UNION SELECT 'chart:' || chart, CASE WHEN loner THEN 'chart:' || chart ELSE profile END FROM cust
  UNION SELECT 'profile:' || profile, profile FROM cust WHERE NOT loner),
comp AS (SELECT n AS node, min(n) OVER (PARTITION BY grp) AS component, grp FROM node)
"""


def sources(spark, sf):
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("patient"),
        F.col("c_name").alias("chart"),
        F.concat(F.lit("P"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("profile"),
        (F.col("c_acctbal") < 0).alias("loner"),
    )
    # the second source writes the same ids as decimals
    first = cust.select(F.concat(F.col("patient").cast("string"), F.lit(".0")).alias("patient"), "chart")
    return [first, cust.where("NOT loner").select("chart", "profile")]


@query("m1_unify_patients", f"WITH {_NODES_SQL} SELECT node, component FROM comp")
def m1(spark, sf):
    return M.components(M.identifier_nodes(sources(spark, sf), KINDS))


_PEOPLE_SQL = f"""
WITH {_NODES_SQL},
p AS (SELECT component, min(substr(node, 7)) FILTER (node LIKE 'chart:%') AS chart, min(substr(node, 9)) FILTER (node LIKE 'patient:%') AS patient,
  min(substr(node, 9)) FILTER (node LIKE 'profile:%') AS profile FROM comp GROUP BY component)
SELECT chart, patient, profile, 5000 + row_number() OVER (ORDER BY component) AS sur_patient_id,
  CAST(10 + (('0x' || substr(sha256('{SALT}|' || component), 1, 8))::BIGINT % 21) AS INTEGER) AS day_offset FROM p
"""


@query("m2_patient_map", _PEOPLE_SQL)
def m2(spark, sf):
    return M.patient_map(M.components(M.identifier_nodes(sources(spark, sf), KINDS)), KINDS, 5001, SALT)


@query(
    "m2_identity_index",
    f"""
WITH people AS ({_PEOPLE_SQL}), {_NODES_SQL.replace('cust AS', 'cust2 AS').replace('FROM cust', 'FROM cust2').replace('node AS', 'node2 AS').replace('FROM node', 'FROM node2').replace('comp AS', 'comp2 AS').replace('FROM cust2omer', 'FROM customer')}
SELECT split_part(a.node, ':', 1) AS kind, substr(a.node, strpos(a.node, ':') + 1) AS value, sur_patient_id
FROM comp2 a JOIN people ON a.component = 'chart:' || people.chart
""",
)
def m2_index(spark, sf):
    labels = M.components(M.identifier_nodes(sources(spark, sf), KINDS))
    return M.identity_index(labels, M.patient_map(labels, KINDS, 5001, SALT), "chart")


@query(
    "m3_update_patient_map",
    f"""
WITH old AS (SELECT CAST(custkey AS VARCHAR) AS patient, sur_patient_id, day_offset FROM ({PATIENTS_SQL})),
fresh AS (SELECT CAST(c_custkey AS VARCHAR) AS patient FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT * FROM old UNION ALL
SELECT patient, (SELECT max(sur_patient_id) FROM old) + row_number() OVER (ORDER BY 'patient:' || patient),
  CAST(10 + (('0x' || substr(sha256('{SALT}|patient:' || patient), 1, 8))::BIGINT % 21) AS INTEGER) FROM fresh
""",
)
def m3(spark, sf):
    old = patients(spark, sf).select(F.col("custkey").cast("string").alias("patient"), "sur_patient_id", "day_offset")
    source = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient"))
    return M.update_patient_map(old, [source], ["patient"], "patient", SALT)


@query(
    "m3_update_without_primary",
    f"""
WITH old AS (SELECT c_name AS chart, CAST(c_custkey AS VARCHAR) AS patient, 7000 + row_number() OVER (ORDER BY c_custkey) AS sur_patient_id,
  CAST(10 + c_custkey % 21 AS INTEGER) AS day_offset FROM customer WHERE c_custkey % 2 = 0)
SELECT chart, patient, sur_patient_id, day_offset, 'V' || patient AS profile FROM old UNION ALL
SELECT c_name, NULL, (SELECT max(sur_patient_id) FROM old) + row_number() OVER (ORDER BY 'chart:' || c_name),
  CAST(10 + (('0x' || substr(sha256('{SALT}|chart:' || c_name), 1, 8))::BIGINT % 21) AS INTEGER), 'V' || c_custkey FROM customer WHERE c_custkey % 2 = 1
""",
)
def m3_without_primary(spark, sf):
    """The source has no patient id: half of its persons are known by their chart."""
    customer = table(spark, sf, "customer")
    old = customer.where("c_custkey % 2 = 0").select(F.col("c_name").alias("chart"), F.col("c_custkey").cast("string").alias("patient"), "c_custkey")
    old = number_rows(old, ["c_custkey"], name="sur_patient_id", start=7001)
    old = old.select("chart", "patient", "sur_patient_id", (F.lit(10) + F.col("c_custkey") % 21).cast("int").alias("day_offset"))
    source = customer.select(F.col("c_name").alias("chart"), F.concat(F.lit("V"), F.col("c_custkey").cast("string")).alias("profile"))
    return M.update_patient_map(old, [source], KINDS, "patient", SALT)


@query(
    "m3_update_delta",
    f"""
WITH old AS (SELECT c_name AS chart, CAST(c_custkey AS VARCHAR) AS patient, 7000 + row_number() OVER (ORDER BY c_custkey) AS sur_patient_id,
  CAST(10 + c_custkey % 21 AS INTEGER) AS day_offset, CASE WHEN c_custkey % 10 = 0 THEN 'V' || c_custkey END AS profile FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM old UNION ALL
SELECT c_name, NULL, (SELECT max(sur_patient_id) FROM old) + row_number() OVER (ORDER BY 'chart:' || c_name),
  CAST(10 + (('0x' || substr(sha256('{SALT}|chart:' || c_name), 1, 8))::BIGINT % 21) AS INTEGER), 'V' || c_custkey FROM customer WHERE c_custkey % 10 = 1
""",
)
def m3_delta(spark, sf):
    """An increment that meets one known person in five, with rows that repeat, and brings as many new ones."""
    customer = table(spark, sf, "customer")
    old = customer.where("c_custkey % 2 = 0").select(F.col("c_name").alias("chart"), F.col("c_custkey").cast("string").alias("patient"), "c_custkey")
    old = number_rows(old, ["c_custkey"], name="sur_patient_id", start=7001)
    old = old.select("chart", "patient", "sur_patient_id", (F.lit(10) + F.col("c_custkey") % 21).cast("int").alias("day_offset"))
    profile = F.concat(F.lit("V"), F.col("c_custkey").cast("string")).alias("profile")
    increment = customer.where("c_custkey % 10 IN (0, 1)").select(F.col("c_name").alias("chart"), profile)
    return M.update_patient_map(old, [increment, increment], KINDS, "patient", SALT)


@query(
    "m4_encounter_map",
    f"""
WITH pmap AS ({PATIENTS_SQL})
SELECT sur_patient_id, o_orderkey AS encounter_id, o_orderdate AS visit_date,
  CAST(sur_patient_id || lpad(CAST(row_number() OVER (PARTITION BY sur_patient_id ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 4, '0') AS BIGINT) AS sur_encounter_id
FROM orders JOIN pmap ON o_custkey = custkey
""",
)
def m4(spark, sf):
    visits = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("patient_key"), F.col("o_orderkey").alias("encounter_id"), F.col("o_orderdate").alias("visit_date")
    )
    # every visit arrives twice: one row per visit is mapped
    return M.encounter_map(visits.unionByName(visits), patients(spark, sf).withColumnRenamed("custkey", "patient_key"))


@query(
    "m5_appointment_map_update",
    f"""
WITH pmap AS ({PATIENTS_SQL}), e AS (SELECT event_id, ts, sur_patient_id FROM events JOIN pmap ON user_id = custkey),
old AS (SELECT sur_patient_id, count(*) AS c FROM e WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1),
new AS (SELECT *, row_number() OVER (PARTITION BY sur_patient_id ORDER BY ts, event_id) AS n FROM e WHERE ts < TIMESTAMP '2024-01-15')
SELECT new.sur_patient_id, event_id AS appointment_id, ts AS visit_date,
  CAST(new.sur_patient_id || lpad(CAST(n + coalesce(c, 0) AS VARCHAR), 3, '0') AS BIGINT) AS sur_appointment_id
FROM new LEFT JOIN old ON new.sur_patient_id = old.sur_patient_id
""",
)
def m5(spark, sf):
    """Appointments that arrive late get numbers after the ones in use, whatever their date."""
    people = patients(spark, sf).withColumnRenamed("custkey", "patient_key")
    visits = table(spark, sf, "events").select(
        F.col("user_id").alias("patient_key"), F.col("event_id").alias("appointment_id"), F.col("ts").alias("visit_date")
    )
    known = visits.where("visit_date >= '2024-01-15'").join(people, "patient_key").select("sur_patient_id", "appointment_id")
    return M.appointment_map(visits, people, known)


@query(
    "m6_pii_table",
    f"""
WITH {MAPS_SQL}
SELECT sur_patient_id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS priority FROM customer JOIN pmap ON c_custkey = custkey
UNION ALL
SELECT sur_patient_id, NULL, NULL, o_orderpriority FROM (
  SELECT DISTINCT o_custkey, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
  UNION SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P') JOIN pmap ON o_custkey = custkey
""",
)
def m6(spark, sf):
    people, orders, lines = patients(spark, sf), table(spark, sf, "orders"), table(spark, sf, "lineitem")
    direct = M.pii_rows(table(spark, sf, "customer"), {"c_name": "name", "c_mktsegment": "segment"}, people, "c_custkey", "custkey")
    returned = orders.join(lines.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderpriority")
    pending = orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderpriority")
    linked = M.pii_rows(or_of_chains([returned, pending]), {"o_orderpriority": "priority"}, people, "o_custkey", "custkey")
    return M.pii_table([direct, linked])


@query(
    "m7_reverse_map",
    f"WITH {MAPS_SQL} SELECT e.sur_encounter_id, e.sur_patient_id, p.custkey, e.encounter_id FROM emap e LEFT JOIN pmap p ON e.sur_patient_id = p.sur_patient_id",
)
def m7(spark, sf):
    masked = encounters(spark, sf).select("sur_encounter_id", "sur_patient_id")
    back = M.reverse_map(masked, "sur_patient_id", patients(spark, sf), "custkey")
    return M.reverse_map(back, "sur_encounter_id", encounters(spark, sf), "encounter_id")


@query(
    "m8_lookup_ids",
    """
SELECT c_custkey AS patient_id FROM customer WHERE c_mktsegment = 'BUILDING'
UNION SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1)
""",
)
def m8(spark, sf):
    direct = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patient_id"))
    visits = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("encounter_id"))
    asked = table(spark, sf, "lineitem").where("l_discount >= 0.1").select(F.col("l_orderkey").alias("encounter_id"))
    return M.lookup_ids(direct, visits, asked)
