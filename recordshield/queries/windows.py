"""Numbering and ranking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import versioned
from ..operators.mapping import appointment_map, encounter_map
from ..operators.numbering import next_ids, number_rows
from ..operators.reports import running_before
from .base import LAYERS_SQL, PATIENTS_SQL, VERSIONED_SQL, history, increment, patients, query, table
from .base import versioned as versioned_orders


@query(
    "w1_repair_flags",
    f"""
WITH {LAYERS_SQL}, v AS ({VERSIONED_SQL})
SELECT order_key, row_id, CASE WHEN row_number() OVER (PARTITION BY order_key ORDER BY last_updated DESC NULLS LAST, row_id DESC) = 1 THEN 'Y' ELSE 'N' END AS active_flag FROM v
""",
)
def w1(spark, sf):
    return versioned.repair_flags(versioned_orders(spark, sf), ["order_key"]).select("order_key", "row_id", "active_flag")


@query(
    "w1_repair_flags_no_date",
    f"""
WITH {LAYERS_SQL}, v AS ({VERSIONED_SQL})
SELECT order_key, row_id, CASE WHEN row_number() OVER (PARTITION BY order_key ORDER BY row_id DESC) = 1 THEN 'Y' ELSE 'N' END AS active_flag FROM v
""",
)
def w1_no_date(spark, sf):
    return versioned.repair_flags(versioned_orders(spark, sf).drop("last_updated"), ["order_key"]).select("order_key", "row_id", "active_flag")


@query(
    "w2_next_ids_after_history",
    f"""
WITH {LAYERS_SQL}
SELECT order_key, status, (SELECT max(row_id) FROM h) + row_number() OVER (ORDER BY order_key, last_updated) AS row_id FROM i
""",
)
def w2_next(spark, sf):
    return next_ids(history(spark, sf), increment(spark, sf), ["order_key", "last_updated"]).select("order_key", "status", "row_id")


@query(
    "w3_encounter_surrogates",
    f"""
WITH pmap AS ({PATIENTS_SQL}), o AS (SELECT o_orderkey, o_orderdate, sur_patient_id FROM orders JOIN pmap ON o_custkey = custkey),
old AS (SELECT *, row_number() OVER (PARTITION BY sur_patient_id ORDER BY o_orderdate, o_orderkey) AS n FROM o WHERE o_orderdate < TIMESTAMP '1998-01-01'),
used AS (SELECT sur_patient_id, count(*) AS c FROM old GROUP BY 1),
new AS (SELECT *, row_number() OVER (PARTITION BY sur_patient_id ORDER BY o_orderdate, o_orderkey) AS n FROM o WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT new.sur_patient_id, o_orderkey AS encounter_id, CAST(new.sur_patient_id || lpad(CAST(n + coalesce(c, 0) AS VARCHAR), 4, '0') AS BIGINT) AS sur_encounter_id,
       o_orderdate AS visit_date FROM new LEFT JOIN used ON new.sur_patient_id = used.sur_patient_id
""",
)
def w3(spark, sf):
    visits = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("patient_key"), F.col("o_orderkey").alias("encounter_id"), F.col("o_orderdate").alias("visit_date")
    )
    people = patients(spark, sf).withColumnRenamed("custkey", "patient_key")
    old = visits.where("visit_date < '1998-01-01'").join(people, "patient_key").select("sur_patient_id", "encounter_id")
    return encounter_map(visits, people, old)


@query(
    "w4_appointment_surrogates",
    f"""
WITH pmap AS ({PATIENTS_SQL}), e AS (SELECT event_id, ts, sur_patient_id FROM events JOIN pmap ON user_id = custkey)
SELECT sur_patient_id, event_id AS appointment_id, ts AS visit_date,
       CAST(sur_patient_id || lpad(CAST(row_number() OVER (PARTITION BY sur_patient_id ORDER BY ts, event_id) AS VARCHAR), 3, '0') AS BIGINT) AS sur_appointment_id
FROM e
""",
)
def w4(spark, sf):
    visits = table(spark, sf, "events").select(
        F.col("user_id").alias("patient_key"), F.col("event_id").alias("appointment_id"), F.col("ts").alias("visit_date")
    )
    return appointment_map(visits, patients(spark, sf).withColumnRenamed("custkey", "patient_key"))


@query(
    "w5_nth_row_per_patient",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders",
)
def w5(spark, sf):
    return number_rows(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], name="nth", within=["o_custkey"])


@query(
    "w6_id_allotment",
    """
WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS run, count(*) AS rows FROM events GROUP BY ALL),
s AS (SELECT *, CAST(coalesce(sum(rows) OVER (PARTITION BY event_type ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prev FROM d)
SELECT event_type, run, prev + 1 AS start_value, prev + rows AS end_value FROM s
""",
)
def w6(spark, sf):
    per_run = (
        table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(F.count(F.lit(1)).alias("rows"))
    )
    # one row per table and run
    earlier = W.partitionBy("event_type").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    before = running_before(F.col("rows"), earlier)
    return per_run.select("event_type", "run", (before + 1).alias("start_value"), (before + F.col("rows")).alias("end_value"))


@query(
    "w7_latest_record",
    """
SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""",
)
def w7(spark, sf):
    latest = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("r"))
    return latest.select("user_id", "r.event_id", "r.event_type", "r.ts")
