"""Column profiles and rule proposals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import profile as P
from .base import PATIENTS_SQL, patients, query, table

AS_OF = date(2001, 6, 1)


@query(
    "d1_patient_id_columns",
    f"""
WITH pmap AS ({PATIENTS_SQL}), o AS (
  SELECT 'orders' AS table_name, 'o_custkey' AS column_name, round(count(*) FILTER (o_custkey IN (SELECT custkey FROM pmap)) / count(*), 6) AS overlap FROM orders
  UNION ALL SELECT 'events', 'user_id', round(count(*) FILTER (user_id IN (SELECT custkey FROM pmap)) / count(*), 6) FROM events
  UNION ALL SELECT 'lineitem', 'l_suppkey', round(count(*) FILTER (l_suppkey IN (SELECT custkey FROM pmap)) / count(*), 6) FROM lineitem)
SELECT table_name, column_name, 'custkey' AS id_kind, overlap, CASE WHEN overlap > 0.7 THEN 'PATIENT_CUSTKEY' END AS proposed_rule FROM o
""",
)
def d1(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("orders", "events", "lineitem", "part")}
    return P.detect_id_columns(tables, {"custkey": (patients(spark, sf), "custkey")}, "custkey|user_id|suppkey", "PATIENT_{kind}")


@query(
    "d2_encounter_id_columns",
    """
WITH e AS (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW'), o AS (
  SELECT 'lineitem' AS table_name, 'l_orderkey' AS column_name, round(count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM e)) / count(*), 6) AS overlap FROM lineitem
  UNION ALL SELECT 'events', 'event_id', round(count(*) FILTER (event_id IN (SELECT o_orderkey FROM e)) / count(*), 6) FROM events)
SELECT table_name, column_name, 'encounter' AS id_kind, overlap, CASE WHEN overlap > 0.7 THEN 'ENCOUNTER_ID' END AS proposed_rule FROM o
""",
)
def d2(spark, sf):
    known = table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'")
    tables = {t: table(spark, sf, t) for t in ("lineitem", "events")}
    return P.detect_id_columns(tables, {"encounter": (known, "o_orderkey")}, "orderkey|event_id", "ENCOUNTER_ID")


# names and whether they are birth dates, by hand
DOB_NAMES = {
    "DOB": True, "pt_dob": True, "birth_date": True, "DateOfBirth": True, "patientdob": True, "PatientDOB": True, "born_date": True,
    "birth_dt_date": True, "date_birth": True, "DATE_BORN": True, "dobson": True, "order_date": False, "birthplace": False, "newborn": False,
    "dateline": False, "update_board": False,
}


@query(
    "d3_dob_columns",
    "SELECT DISTINCT p_type AS table_name, n AS column_name, b AS is_dob FROM part, (VALUES "
    + ", ".join(f"('{n}', {b})" for n, b in DOB_NAMES.items())
    + ") v(n, b)",
)
def d3(spark, sf):
    names = F.explode(F.array(*[F.lit(n) for n in DOB_NAMES]))
    columns = table(spark, sf, "part").select(F.col("p_type").alias("table_name")).distinct()
    return P.dob_columns(columns.withColumn("column_name", names))


@query(
    "d4_date_columns",
    """
SELECT 'orders' AS table_name, unnest(['o_orderdate', 'as_text', 'half', 'o_orderpriority']) AS column_name, unnest([count(*), count(*), count(*), count(*)]) AS "values",
  unnest([1.0::DOUBLE, 1.0, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6), 0.0]) AS date_share,
  unnest([true, true, count(*) FILTER (o_orderstatus = 'F') / count(*) > 0.5, false]) AS is_date FROM orders
""",
)
def d4(spark, sf):
    orders = table(spark, sf, "orders").withColumns(
        {
            "as_text": F.date_format("o_orderdate", "MMM d, yyyy"),
            "half": F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyyMMdd")).otherwise("3150-01-01"),
        }
    )
    return P.date_share(orders, "orders", ["o_orderdate", "as_text", "half", "o_orderpriority"], AS_OF)


@query(
    "d5_zip_columns",
    """
SELECT 'customer' AS table_name, unnest(['code', 'home_zip', 'c_mktsegment']) AS column_name, unnest([1.0::DOUBLE, round(count(*) FILTER (c_acctbal > 0) / count(*), 6), 0.0]) AS zip_share,
  unnest([false, true, false]) AS name_fits, unnest([true, true, false]) AS is_zip FROM customer
""",
)
def d5(spark, sf):
    five = F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")
    cust = table(spark, sf, "customer").withColumns(
        {"code": F.when(F.col("c_acctbal") > 0, five).otherwise(F.concat(five, F.lit("-1234"))), "home_zip": F.when(F.col("c_acctbal") > 0, five).otherwise("?")}
    )
    return P.zip_columns(cust, "customer", ["code", "home_zip", "c_mktsegment"])


_PROFILE_SQL = """
profile AS (SELECT p_brand AS table_name, p_type AS column_name, max(p_size) > 40 AS is_phi,
  CASE p_type WHEN 'SMALL' THEN 'date_offset' WHEN 'LARGE' THEN 'NOTES' WHEN 'ECONOMY' THEN 'PATIENT_ID' ELSE 'MASK' END AS base_rule, min(p_size) < 3 AS confirmed
  FROM part GROUP BY ALL)
"""


def _profile(spark, sf):
    t = F.col("p_type")
    rule = F.when(t == "SMALL", "date_offset").when(t == "LARGE", "NOTES").when(t == "ECONOMY", "PATIENT_ID").otherwise("MASK")
    return (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("table_name"), F.col("p_type").alias("column_name"))
        .agg((F.max("p_size") > 40).alias("is_phi"), (F.min("p_size") < 3).alias("confirmed"))
        .withColumn("p_type", F.col("column_name"))
        .withColumn("base_rule", rule)
        .drop("p_type")
    )


@query(
    "d6_propose_rules",
    f"""
WITH {_PROFILE_SQL}, o AS (SELECT *, bool_or(base_rule = 'PATIENT_ID' AND confirmed) OVER (PARTITION BY table_name) AS own FROM profile),
r AS (SELECT table_name, column_name, is_phi, CASE WHEN NOT is_phi THEN '' WHEN base_rule = 'date_offset' THEN CASE WHEN own THEN 'DATE_OFFSET' ELSE 'STATIC_OFFSET' END
  WHEN base_rule = 'NOTES' THEN CASE WHEN own THEN 'NOTES' ELSE 'GENERIC_NOTES' END ELSE base_rule END AS rule FROM o)
SELECT *, CASE WHEN rule = 'MASK' THEN column_name ELSE '' END AS mask_value FROM r
""",
)
def d6(spark, sf):
    return P.propose_rules(_profile(spark, sf))


@query(
    "d7_value_sample",
    "SELECT o_custkey AS v FROM orders WHERE o_orderstatus = 'P' ORDER BY md5(CAST(o_custkey AS VARCHAR)), o_custkey LIMIT 15",
)
def d7(spark, sf):
    return P.value_sample(table(spark, sf, "orders").withColumn("v", F.when(F.col("o_orderstatus") == "P", F.col("o_custkey"))), "v")


@query(
    "d8_reuse_rules",
    """
WITH now AS (SELECT p_brand AS t, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS cols FROM part WHERE p_size < 30 GROUP BY 1),
runs AS (SELECT p_brand AS t, CASE WHEN p_size < 20 THEN 1 ELSE 2 END AS run, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS cols FROM part WHERE p_brand <> 'Brand#3' GROUP BY ALL),
last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY t ORDER BY run DESC) = 1)
SELECT now.t AS table_name, CASE WHEN last.t IS NULL THEN 'new table' WHEN now.cols = last.cols THEN 'reused' ELSE 'column mismatch' END AS status,
  CASE WHEN now.cols = last.cols THEN last.t || '/run ' || run END AS config
FROM now LEFT JOIN last ON now.t = last.t
""",
)
def d8(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_brand", "table_name")
    current = part.where("p_size < 30").groupBy("table_name").agg(F.collect_set("p_type").alias("columns"))
    run = F.when(F.col("p_size") < 20, 1).otherwise(2)
    earlier = part.where("table_name <> 'Brand#3'").groupBy("table_name", run.alias("run")).agg(F.collect_set("p_type").alias("columns"))
    earlier = earlier.withColumn("config", F.concat("table_name", F.lit("/run "), F.col("run").cast("string")))
    return P.reuse_rules(current, earlier)


@query(
    "a18_classification_summary",
    f"""
WITH {_PROFILE_SQL}
SELECT table_name, count(*) AS columns, count(*) FILTER (is_phi) AS phi_columns, round(count(*) FILTER (is_phi) / count(*), 6) AS phi_share, count(*) FILTER (confirmed) AS confirmed_columns
FROM profile GROUP BY 1
""",
)
def a18(spark, sf):
    return P.classification_summary(_profile(spark, sf))


