"""Projection, predicates, cleaning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..operators import filters
from ..operators.joins import PatientKey, map_patient
from .base import LAYERS_SQL, PATIENTS_SQL, history, increment, patients, query, table, text_table


@query(
    "p1_common_columns",
    f"""
WITH {LAYERS_SQL}
SELECT cust_key, last_updated, order_key, price, status, 'h' AS side FROM h
UNION ALL SELECT cust_key, last_updated, order_key, price, status, 'i' FROM i
""",
)
def p1(spark, sf):
    h, i = history(spark, sf), increment(spark, sf)
    shared = filters.common_columns(h, i, ("row_id", "active_flag", "extracted_date"))
    return h.select(*shared, F.lit("h").alias("side")).unionByName(i.select(*shared, F.lit("i").alias("side")))


@query(
    "p2_ignore_rows",
    """
SELECT c_custkey, c_nationkey, c_mktsegment FROM customer
WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 500 OR c_nationkey IN (1, 2))
""",
)
def p2(spark, sf):
    rules = [("c_mktsegment", "eq", "BUILDING"), ("c_acctbal", "lt", 500), ("c_nationkey", "in", [1, 2])]
    return filters.ignore_rows(table(spark, sf, "customer"), rules).select("c_custkey", "c_nationkey", "c_mktsegment")


@query(
    "p2_ignore_rows_and",
    """
SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 500)
""",
)
def p2_and(spark, sf):
    rules = [("c_mktsegment", "eq", "BUILDING"), ("c_acctbal", "gt", 500)]
    return filters.ignore_rows(table(spark, sf, "customer"), rules, "and").select("c_custkey", "c_nationkey")


@query(
    "p3_ignore_cell",
    """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 500 THEN c_name ELSE '<<NAME>>' END AS c_name FROM customer
""",
)
def p3(spark, sf):
    rules = [("c_mktsegment", "eq", "BUILDING"), ("c_acctbal", "gt", 500)]
    return table(spark, sf, "customer").select(
        "c_custkey", filters.ignore_cell(F.col("c_name"), F.lit("<<NAME>>"), rules).alias("c_name")
    )


@query(
    "p4_predicates",
    """
SELECT p_partkey, p_size < 10 AS lt, p_size > 40 AS gt, p_brand = 'Brand#2' AS eq, p_brand <> 'Brand#2' AS neq,
       p_type IN ('SMALL', 'ECONOMY') AS is_in, p_type NOT IN ('SMALL', 'ECONOMY') AS not_in FROM part
""",
)
def p4(spark, sf):
    rules = {
        "lt": ("p_size", "lt", 10),
        "gt": ("p_size", "gt", 40),
        "eq": ("p_brand", "eq", "Brand#2"),
        "neq": ("p_brand", "neq", "Brand#2"),
        "is_in": ("p_type", "in", ["SMALL", "ECONOMY"]),
        "not_in": ("p_type", "not_in", ["SMALL", "ECONOMY"]),
    }
    return table(spark, sf, "part").select("p_partkey", *[filters.condition(r).alias(n) for n, r in rules.items()])


@query("p5_rename", "SELECT c_custkey AS patient_id, c_name AS patient_name, c_nationkey AS region_code FROM customer")
def p5(spark, sf):
    roles = {"c_custkey": "patient_id", "c_name": "patient_name", "c_nationkey": "region_code"}
    return filters.rename(table(spark, sf, "customer"), roles, keep_others=False)


@query(
    "p6_missing_columns",
    """
SELECT c_custkey AS patient_id, c_name AS name, CAST(NULL AS BIGINT) AS chart_id, c_mktsegment AS segment FROM customer
UNION ALL SELECT CAST(NULL AS BIGINT), s_name, s_suppkey, CAST(NULL AS VARCHAR) FROM supplier
""",
)
def p6(spark, sf):
    a = filters.rename(
        table(spark, sf, "customer"), {"c_custkey": "patient_id", "c_name": "name", "c_mktsegment": "segment"}, keep_others=False
    )
    b = filters.rename(table(spark, sf, "supplier"), {"s_suppkey": "chart_id", "s_name": "name"}, keep_others=False)
    wanted = {"patient_id": "bigint", "name": "string", "chart_id": "bigint", "segment": "string"}
    return filters.with_missing_columns(a, wanted).unionByName(filters.with_missing_columns(b, wanted))


@query(
    "p7_placeholder_to_null",
    """
WITH t AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'None' WHEN p_size < 15 THEN ' nan ' WHEN p_size < 20 THEN '0000-00-00'
  WHEN p_size < 25 THEN '' WHEN p_size < 30 THEN 'NULL' ELSE p_name END AS v FROM part)
SELECT p_partkey, CASE WHEN lower(trim(v)) IN ('', 'none', 'nan', 'null', '0000-00-00') THEN NULL ELSE v END AS v FROM t
""",
)
def p7(spark, sf):
    s = F.col("p_size")
    v = F.when(s < 10, "None").when(s < 15, " nan ").when(s < 20, "0000-00-00").when(s < 25, "").when(s < 30, "NULL").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", clean.placeholder_to_null(v).alias("v"))


ID_TEXT_SQL = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CAST(o_custkey AS VARCHAR) WHEN 'F' THEN o_custkey || '.0' ELSE 'A' || o_custkey END AS v FROM orders
"""


def _id_text():
    k = F.col("o_custkey").cast("string")
    return F.when(F.col("o_orderstatus") == "O", k).when(F.col("o_orderstatus") == "F", F.concat(k, F.lit(".0"))).otherwise(F.concat(F.lit("A"), k))


@query("p8_normalise_id", f"WITH t AS ({ID_TEXT_SQL}) SELECT o_orderkey, regexp_replace(v, '\\.0$', '') AS v FROM t")
def p8(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", clean.normalise_id(_id_text()).alias("v"))


@query("p9_coerce_key", f"WITH t AS ({ID_TEXT_SQL}) SELECT o_orderkey, TRY_CAST(regexp_replace(v, '\\.0$', '') AS BIGINT) AS v FROM t")
def p9(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", clean.coerce_key(_id_text()).alias("v"))


@query(
    "p10_comparable",
    """
SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS part, CAST(CAST(l_extendedprice AS DECIMAL(38,6)) AS VARCHAR) AS price,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipped, CASE WHEN l_discount > 0.05 THEN '1' ELSE '0' END AS discounted,
       CASE WHEN l_returnflag = 'R' THEN '0' ELSE CAST(l_linenumber AS VARCHAR) END AS line
FROM lineitem
""",
)
def p10(spark, sf):
    df = table(spark, sf, "lineitem").withColumns(
        {"discounted": F.col("l_discount") > 0.05, "line": F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))}
    )
    t = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        "l_orderkey",
        clean.comparable("l_partkey", t["l_partkey"]).alias("part"),
        clean.comparable("l_extendedprice", t["l_extendedprice"]).alias("price"),
        clean.comparable("l_shipdate", t["l_shipdate"]).alias("shipped"),
        clean.comparable("discounted", t["discounted"]).alias("discounted"),
        clean.comparable("line", T.IntegerType(), null_integer_as_zero=True).alias("line"),
    )


@query("p10_comparable_fraction", "SELECT event_id, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS ts FROM events")
def p10_fraction(spark, sf):
    df = table(spark, sf, "events")
    return df.select("event_id", clean.comparable("ts", df.schema["ts"].dataType).alias("ts"))


@query("p11_stamp", "SELECT o_orderkey, DATE '2001-06-01' AS extracted_date FROM orders")
def p11(spark, sf):
    return filters.stamp(table(spark, sf, "orders").select("o_orderkey"), "extracted_date", date(2001, 6, 1))


@query(
    "p12_collapse_note",
    "SELECT doc_id, trim(replace(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^', ' '), ' ') AS text FROM documents",
)
def p12(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", clean.collapse_note("text").alias("text"))


@query("p13_strip_control", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g') AS text FROM documents")
def p13(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", clean.strip_control("text").alias("text"))


@query(
    "p14_clean_term",
    f"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(translate(text, '{clean.MARKED}', '{clean.PLAIN}'),
  '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9 %/.\\-]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS term FROM documents
""",
)
def p14(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", clean.clean_term("text").alias("term"))


def _split(spark, sf):
    mapped = map_patient(table(spark, sf, "orders"), patients(spark, sf), [PatientKey("o_custkey", "custkey")])
    return filters.split_rejects(mapped, "sur_patient_id_from_custkey", ["o_custkey"], "orders", "r1")


@query(
    "p15_reject_split_good",
    f"WITH pmap AS ({PATIENTS_SQL}) SELECT o_orderkey, sur_patient_id FROM orders JOIN pmap ON o_custkey = custkey",
)
def p15_good(spark, sf):
    return _split(spark, sf)[0].select("o_orderkey", F.col("sur_patient_id_from_custkey").alias("sur_patient_id"))


@query(
    "p15_reject_split_rejects",
    f"""
WITH pmap AS ({PATIENTS_SQL})
SELECT 'orders' AS table_name, 'r1' AS run, o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE o_custkey NOT IN (SELECT custkey FROM pmap)
""",
)
def p15_rejects(spark, sf):
    rejects = _split(spark, sf)[1]
    back = F.from_json("row_json", "o_orderkey bigint, o_custkey bigint, o_orderpriority string")
    return rejects.select("table_name", "run", back.alias("r")).select("table_name", "run", "r.*")
