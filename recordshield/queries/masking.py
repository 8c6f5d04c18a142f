"""Masking rules on structured columns and whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import moment
from ..functions.dates import shift_split_date
from ..functions.rules import RuleContext, apply_rule
from ..operators.images import mask_headers
from ..operators.joins import PatientKey, map_encounter, map_patient, resolve_identity
from ..operators.mapping import encounter_map, keyed_offset
from ..operators.numbering import number_rows
from ..operators.quality import count_qc, ignored_direct
from ..plans.deidentify import Maps, Options, deidentify_table
from ..spec import ColumnRule, IgnoreRule, TableSpec
from .base import LINE_KEY, LINE_ORDER, MAPS_SQL, PATIENTS_SQL, SALT, encounters, patients, query, table
from .joining import APPOINTMENTS_SQL, appointments

NTZ = T.TimestampNTZType()


def _owned(df, spark, sf, column):
    return resolve_identity(map_patient(df, patients(spark, sf), [PatientKey(column, "custkey")]), ["custkey"], 34)


@query(
    "r1_rule_dispatch",
    f"""
WITH pmap AS ({PATIENTS_SQL})
SELECT sur_patient_id AS c_custkey, '<<NAME>>' AS c_name, c_nationkey, substr(CAST(c_acctbal AS VARCHAR), 1, 3) AS c_acctbal, c_mktsegment
FROM customer JOIN pmap ON c_custkey = custkey
""",
)
def r1(spark, sf):
    cust = table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("string"))
    rules = (ColumnRule("c_custkey", "PATIENT_CUSTKEY"), ColumnRule("c_name", "MASK", "NAME"), ColumnRule("c_acctbal", "ZIP_CODE"))
    return deidentify_table(cust, TableSpec("customer", rules), Maps(patients(spark, sf))).table


@query("r2_patient_id", f"WITH pmap AS ({PATIENTS_SQL}) SELECT o_orderkey, sur_patient_id AS o_custkey FROM orders LEFT JOIN pmap ON o_custkey = custkey")
def r2(spark, sf):
    owned = _owned(table(spark, sf, "orders"), spark, sf, "o_custkey")
    return owned.select("o_orderkey", apply_rule("PATIENT_CUSTKEY", "o_custkey", RuleContext(T.LongType())).alias("o_custkey"))


@query(
    "r3_encounter_id",
    f"WITH {MAPS_SQL} SELECT l_linenumber, l_partkey, sur_encounter_id AS l_orderkey FROM lineitem LEFT JOIN emap ON l_orderkey = encounter_id",
)
def r3(spark, sf):
    out = map_encounter(table(spark, sf, "lineitem"), encounters(spark, sf), patients(spark, sf), "l_orderkey")
    return out.select("l_linenumber", "l_partkey", apply_rule("ENCOUNTER_ID", "l_orderkey", RuleContext(T.LongType())).alias("l_orderkey"))


@query(
    "r4_appointment_id",
    f"WITH pmap AS ({PATIENTS_SQL}), amap AS ({APPOINTMENTS_SQL}) SELECT ts, sur_appointment_id AS event_id FROM events LEFT JOIN amap ON event_id = appointment_id",
)
def r4(spark, sf):
    out = map_encounter(
        table(spark, sf, "events"), appointments(spark, sf), patients(spark, sf), "event_id", "appointment_id", "appointment"
    )
    return out.select("ts", apply_rule("APPOINTMENT_ID", "event_id", RuleContext(T.LongType())).alias("event_id"))


@query("r5_mask", "SELECT c_custkey, '<<NAME>>' AS c_name FROM customer")
def r5(spark, sf):
    some_null = F.when(F.col("c_acctbal") > 0, F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", apply_rule("MASK", some_null, RuleContext(mask="NAME")).alias("c_name"))


@query(
    "r6_date_offset",
    f"""
WITH pmap AS ({PATIENTS_SQL})
SELECT o_orderkey, o_orderdate + to_days(day_offset) AS typed, strftime(o_orderdate + to_days(day_offset), '%Y-%m-%d %H:%M:%S') AS from_text,
       CASE WHEN o_orderstatus = 'P' THEN '10:15' WHEN o_orderstatus = 'F' THEN NULL ELSE strftime(o_orderdate + to_days(day_offset), '%Y-%m-%d %H:%M:%S') END AS mixed
FROM orders LEFT JOIN pmap ON o_custkey = custkey
WHERE day_offset IS NOT NULL
""",
)
def r6(spark, sf):
    owned = _owned(table(spark, sf, "orders"), spark, sf, "o_custkey").where("day_offset IS NOT NULL")
    us_text = F.date_format("o_orderdate", "M/d/yyyy")
    mixed = F.when(F.col("o_orderstatus") == "P", "10:15").when(F.col("o_orderstatus") == "F", "no date").otherwise(us_text)
    return owned.select(
        "o_orderkey",
        apply_rule("DATE_OFFSET", "o_orderdate", RuleContext(NTZ)).alias("typed"),
        apply_rule("DATE_OFFSET", us_text, RuleContext()).alias("from_text"),
        apply_rule("DATE_OFFSET", mixed, RuleContext()).alias("mixed"),
    )


_TIMED_FORMS = {
    "us": ("M/d/yyyy HH:mm:ss", "%H:%M:%S"), "half": ("M/d/yyyy h:mm a", "%H:%M:00"), "iso": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%H:%M:%S"),
    "named": ("MMM d, yyyy HH:mm", "%H:%M:00"), "short": ("yyyy-MM-dd hh:mm:ss a", "%H:%M:%S"),
}


@query(
    "r6_date_offset_with_time",
    f"WITH pmap AS ({PATIENTS_SQL}), clocks AS (SELECT o_orderkey, o_orderdate + to_days(day_offset) + to_seconds(o_orderkey * 7919 % 86400) AS moved FROM orders JOIN pmap ON o_custkey = custkey) SELECT o_orderkey, "
    + ", ".join(f"strftime(moved, '%Y-%m-%d {shown}') AS \"{name}\"" for name, (_, shown) in _TIMED_FORMS.items())
    + " FROM clocks",
)
def r6_timed(spark, sf):
    """Dates written with a time of day keep it."""
    owned = _owned(table(spark, sf, "orders"), spark, sf, "o_custkey").where("day_offset IS NOT NULL")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") * 7919 % 86400).cast("decimal(18,6)"))
    moved = [apply_rule("DATE_OFFSET", F.date_format(at, form), RuleContext()).alias(name) for name, (form, _) in _TIMED_FORMS.items()]
    return owned.select("o_orderkey", *moved)


@query("r7_static_offset", f"SELECT {LINE_ORDER}, l_shipdate + to_days(34) AS shifted FROM lineitem")
def r7(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_KEY, apply_rule("STATIC_OFFSET", "l_shipdate", RuleContext(NTZ)).alias("shifted"))


@query(
    "r8_dob",
    """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS typed, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS from_text FROM orders
""",
)
def r8(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", "None").when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MM/dd/yyyy"))
    text = text.otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        apply_rule("DOB", "o_orderdate", RuleContext(NTZ)).alias("typed"),
        apply_rule("DOB", text, RuleContext()).alias("from_text"),
    )


@query(
    "r9_zip_code",
    """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN CAST(c_nationkey AS VARCHAR)
  ELSE substr(lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'), 1, 3) END AS zip FROM customer
""",
)
def r9(spark, sf):
    five = F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")
    seg = F.col("c_mktsegment")
    zips = F.when(seg == "BUILDING", "None").when(seg == "MACHINERY", F.col("c_nationkey").cast("string"))
    zips = zips.when(seg == "AUTOMOBILE", F.concat(five, F.lit("-6789"))).otherwise(five)
    return table(spark, sf, "customer").select("c_custkey", apply_rule("ZIP_CODE", zips, RuleContext()).alias("zip"))


@query(
    "r10_split_date",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(day(o_orderdate + INTERVAL 20 DAY) AS INTEGER) END AS day,
       CAST(month(CASE WHEN o_orderstatus = 'P' THEN o_orderdate ELSE o_orderdate + INTERVAL 20 DAY END) AS INTEGER) AS month,
       CAST(year(CASE WHEN o_orderstatus = 'P' THEN o_orderdate ELSE o_orderdate + INTERVAL 20 DAY END) AS INTEGER) AS year FROM orders
""",
)
def r10(spark, sf):
    d = "o_orderdate"
    parts = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.dayofmonth(d)).alias("d"),
        F.month(d).alias("m"),
        F.year(d).alias("y"),
    )
    moved = shift_split_date("d", "m", "y", F.lit(20))
    return parts.select("o_orderkey", *[c.alias(n) for n, c in moved.items()])


@query(
    "r11_keep_unmapped",
    f"WITH pmap AS ({PATIENTS_SQL}) SELECT o_orderkey, coalesce(sur_patient_id, o_custkey) AS o_custkey FROM orders LEFT JOIN pmap ON o_custkey = custkey",
)
def r11(spark, sf):
    spec = TableSpec("orders", (ColumnRule("o_custkey", "PATIENT_CUSTKEY"),))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return deidentify_table(orders, spec, Maps(patients(spark, sf)), Options(keep_unmapped=True)).table


@query(
    "r12_date_offset_us_format",
    f"WITH pmap AS ({PATIENTS_SQL}) SELECT o_orderkey, strftime(o_orderdate + to_days(day_offset), '%m-%d-%Y') AS o_orderdate FROM orders JOIN pmap ON o_custkey = custkey",
)
def r12(spark, sf):
    owned = _owned(table(spark, sf, "orders"), spark, sf, "o_custkey").where("sur_patient_id IS NOT NULL")
    ctx = RuleContext(NTZ, date_format="MM-dd-yyyy")
    return owned.select("o_orderkey", apply_rule("DATE_OFFSET", "o_orderdate", ctx).alias("o_orderdate"))


ORDER_RULES = (
    ColumnRule("o_orderkey", "ENCOUNTER_ID"),
    ColumnRule("o_custkey", "PATIENT_CUSTKEY"),
    ColumnRule("o_orderpriority", "MASK", "PRIORITY"),
    ColumnRule("o_orderdate", "DATE_OFFSET"),
)

WHOLE_SQL = f"""
WITH {MAPS_SQL}
SELECT e.sur_encounter_id AS o_orderkey, coalesce(e.sur_patient_id, p.sur_patient_id) AS o_custkey, o_orderstatus, o_totalprice,
       o_orderdate + to_days(coalesce(pe.day_offset, p.day_offset)) AS o_orderdate, '<<PRIORITY>>' AS o_orderpriority, TIMESTAMP '2001-06-01 08:00:00' AS deid_ts
FROM orders LEFT JOIN pmap p ON o_custkey = p.custkey LEFT JOIN emap e ON o_orderkey = e.encounter_id LEFT JOIN pmap pe ON e.sur_patient_id = pe.sur_patient_id
WHERE coalesce(e.sur_patient_id, p.sur_patient_id) IS NOT NULL AND NOT (o_totalprice < 5000)
"""


def whole_table(spark, sf):
    spec = TableSpec("orders", ORDER_RULES, ignore_rows=IgnoreRule((("o_totalprice", "lt", 5000),)))
    stamp = moment(datetime(2001, 6, 1, 8))
    return deidentify_table(table(spark, sf, "orders"), spec, Maps(patients(spark, sf), encounters(spark, sf)), Options(stamp=stamp))


@query("r13_whole_table", WHOLE_SQL)
def r13(spark, sf):
    return whole_table(spark, sf).table


@query(
    "r13_whole_table_rejects",
    f"""
WITH {MAPS_SQL}
SELECT 'orders' AS table_name, 'run' AS run, o_orderkey FROM orders LEFT JOIN pmap p ON o_custkey = p.custkey
WHERE p.custkey IS NULL AND o_totalprice >= 5000
""",
)
def r13_rejects(spark, sf):
    rejects = whole_table(spark, sf).rejects
    return rejects.select("table_name", "run", F.get_json_object("row_json", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


@query(
    "r13_whole_table_with_bridge",
    f"""
WITH pmap AS ({PATIENTS_SQL})
SELECT l_orderkey, l_linenumber, l_shipdate + to_days(day_offset) AS l_shipdate, sur_patient_id AS custkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN pmap ON o_custkey = custkey
""",
)
def r13_bridge(spark, sf):
    bridge = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("custkey"))
    spec = TableSpec("lineitem", (ColumnRule("custkey", "PATIENT_CUSTKEY"), ColumnRule("l_shipdate", "DATE_OFFSET")))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return deidentify_table(lines, spec, Maps(patients(spark, sf)), bridge=(bridge, "src", "custkey", "l_orderkey")).table


@query(
    "r14_image_headers",
    f"""
WITH pmap AS ({PATIENTS_SQL})
SELECT sur_patient_id AS patient_id, '1.2.9.' || CAST(('0x' || substr(sha256('{SALT}|' || o_custkey || '|' || l_orderkey), 1, 14))::BIGINT AS VARCHAR) || lpad(CAST(('0x' || substr(sha256('{SALT}|' || o_custkey || '|' || l_orderkey), 15, 14))::BIGINT AS VARCHAR), 17, '0') AS study_uid,
       '1.2.9.' || CAST(('0x' || substr(sha256('{SALT}|' || o_custkey || '|' || l_orderkey || '|' || l_suppkey), 1, 14))::BIGINT AS VARCHAR) || lpad(CAST(('0x' || substr(sha256('{SALT}|' || o_custkey || '|' || l_orderkey || '|' || l_suppkey), 15, 14))::BIGINT AS VARCHAR), 17, '0') AS series_uid,
       'ANONYMOUS' AS patient_name, CAST(year(o_orderdate) AS INTEGER) AS birth_date, l_shipdate + to_days(day_offset) AS study_date, '' AS comment, l_linestatus AS modality
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN pmap ON o_custkey = custkey
""",
)
def r14(spark, sf):
    lines, orders, cust = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    headers = (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(cust, F.col("o_custkey") == cust["c_custkey"])
        .select(
            F.col("o_custkey").alias("patient_id"),
            F.col("l_orderkey").alias("study_uid"),
            F.col("l_suppkey").alias("series_uid"),
            F.col("c_name").alias("patient_name"),
            F.col("o_orderdate").alias("birth_date"),
            F.col("l_shipdate").alias("study_date"),
            F.col("o_orderpriority").alias("comment"),
            F.col("l_linestatus").alias("modality"),
        )
    )
    levels = {"study_uid": ["patient_id", "study_uid"], "series_uid": ["patient_id", "study_uid", "series_uid"]}
    return mask_headers(
        headers,
        levels,
        SALT,
        "1.2.9",
        patients(spark, sf),
        "patient_id",
        "custkey",
        names={"patient_name": "ANONYMOUS"},
        births=["birth_date"],
        shifted=["study_date"],
        blanked=["comment"],
    )


FLAGSHIP_SQL = f"""
WITH numbered AS (SELECT c_custkey AS custkey, 7000000 + row_number() OVER (ORDER BY c_custkey) AS sur_patient_id,
    CAST(10 + (('0x' || substr(sha256('{SALT}|' || c_custkey), 1, 8))::BIGINT % 21) AS INTEGER) AS day_offset FROM customer WHERE c_mktsegment <> 'MACHINERY'),
emap AS (SELECT o_orderkey AS encounter_id, sur_patient_id, CAST(sur_patient_id || lpad(CAST(row_number() OVER (PARTITION BY sur_patient_id ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 4, '0') AS BIGINT) AS sur_encounter_id
  FROM orders JOIN numbered ON o_custkey = custkey)
SELECT sur_encounter_id AS o_orderkey, sur_patient_id AS o_custkey, o_orderstatus, o_totalprice, o_orderdate + to_days(day_offset) AS o_orderdate, '<<PRIORITY>>' AS o_orderpriority
FROM orders JOIN emap ON o_orderkey = encounter_id JOIN numbered USING (sur_patient_id)
"""


def _flagship_maps(spark, sf):
    people = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("custkey"))
    people = number_rows(people, ["custkey"], name="sur_patient_id", start=7000001).withColumn("day_offset", keyed_offset("custkey", SALT))
    visits = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("patient_key"), F.col("o_orderkey").alias("encounter_id"), F.col("o_orderdate").alias("visit_date")
    )
    return Maps(people, encounter_map(visits, people.withColumnRenamed("custkey", "patient_key")))


@query("flagship_deidentify_orders", FLAGSHIP_SQL)
def flagship(spark, sf):
    return deidentify_table(table(spark, sf, "orders"), TableSpec("orders", ORDER_RULES), _flagship_maps(spark, sf)).table


@query(
    "flagship_count_check",
    """
SELECT 'orders' AS table_name, count(*) AS before_rows, count(*) FILTER (c_mktsegment <> 'MACHINERY') AS after_rows,
       count(*) FILTER (c_mktsegment = 'MACHINERY') AS diff, count(*) FILTER (c_mktsegment = 'MACHINERY') AS ignored_rows, 'PASS' AS status
FROM orders JOIN customer ON o_custkey = c_custkey
""",
)
def flagship_check(spark, sf):
    maps, orders = _flagship_maps(spark, sf), table(spark, sf, "orders")
    masked = deidentify_table(orders, TableSpec("orders", ORDER_RULES), maps).table
    return count_qc("orders", orders, masked, ignored_direct(orders, "o_custkey", maps.patient, "custkey"))
