"""Validity filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import clean
from ..operators import validity as V
from .base import query, table, text_table

AS_OF = date(2001, 6, 1)


def _people(spark, sf):
    """Person columns made from customers, some of them wrong by segment."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    five = F.lpad((k % 100000).cast("string"), 5, "0")
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    pick = {
        "zip": F.when(seg == "BUILDING", F.concat(five, F.lit("-1"))).otherwise(five),
        "patient": F.when(seg == "BUILDING", "").when(seg != "MACHINERY", k.cast("string")),
        "icd": F.when(seg == "BUILDING", F.concat(F.lit("e"), four)).otherwise(F.concat(F.lit("E11."), F.substring(four, 1, 2))),
        "phone": F.when(seg == "BUILDING", F.concat(F.lit("716-55-"), four)).otherwise(F.concat(F.lit("(716) 555-"), four, F.lit(" x12"))),
        "email": F.when(seg == "BUILDING", "no mail").otherwise(F.concat(F.lit("u."), k.cast("string"), F.lit("@mail-host.org"))),
        "sex": F.when(seg == "BUILDING", "M").when(seg == "MACHINERY", "FEMALE").otherwise("other"),
        "ssn": F.when(seg == "BUILDING", F.concat(F.lit("123456"), four)).otherwise(F.concat(F.lit("123-45-"), four)),
        "state": F.when(seg == "BUILDING", "XX").when(seg == "MACHINERY", "ny").otherwise("CA"),
    }
    return table(spark, sf, "customer").withColumns(pick)


def _bad(name, column, bad):
    @query(name, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
    def run(spark, sf):
        return V.bad_rows(_people(spark, sf), bad(column)).select("c_custkey")

    return run


_bad("v2_bad_zip", "zip", C.bad_zip)
_bad("v6_bad_icd10", "icd", C.bad_icd10)
_bad("v7_bad_phone", "phone", C.bad_phone)
_bad("v8_bad_email", "email", C.bad_email)
_bad("v9_bad_sex", "sex", C.bad_sex)
_bad("v10_bad_ssn", "ssn", C.bad_ssn)
_bad("v11_bad_state", "state", C.bad_state)


@query(
    "v1_bad_age",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR NOT floor(date_diff('day', o_orderdate, DATE '2001-06-01') / 365) BETWEEN 0 AND 120",
)
def v1(spark, sf):
    orders = table(spark, sf, "orders").withColumn("dob", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return V.bad_rows(orders, C.bad_age("dob", AS_OF)).select("o_orderkey")


@query("v3_bad_dob", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate >= TIMESTAMP '2001-06-01'")
def v3(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return V.bad_rows(table(spark, sf, "orders").withColumn("dob", text), C.bad_dob("dob", AS_OF)).select("o_orderkey")


@query("v4_bad_patient_id", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def v4(spark, sf):
    return V.bad_rows(_people(spark, sf), C.bad_identifier("patient")).select("c_custkey")


@query("v5_bad_encounter_id", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def v5(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("encounter", F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")))
    return V.bad_rows(lines, C.bad_identifier("encounter")).select("l_orderkey", "l_linenumber")


@query(
    "v10_all_checks",
    """
SELECT unnest(['zip', 'patient', 'email', 'sex']) AS "check", unnest([count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')),
  count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) FILTER (c_mktsegment = 'BUILDING')]) AS bad_rows FROM customer
""",
)
def v_all(spark, sf):
    checks = {"zip": C.bad_zip("zip"), "patient": C.bad_identifier("patient"), "email": C.bad_email("email"), "sex": C.bad_sex("sex")}
    return V.validate_all(_people(spark, sf), checks)


@query(
    "v12_patient_without_encounter",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def v12(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return V.without_partner(table(spark, sf, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey")


@query(
    "v12_order_without_result",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def v12_orders(spark, sf):
    return V.without_partner(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query(
    "v12_patient_without_payer",
    "SELECT c_custkey FROM customer WHERE c_acctbal < 0",
)
def v12_payer(spark, sf):
    payers = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("insured"))
    return V.without_partner(table(spark, sf, "customer"), payers, "c_custkey", "insured").select("c_custkey")


@query(
    "v13_missing_fields",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'patient' ELSE 'patient' END AS missing FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
def v13_missing(spark, sf):
    return V.missing_fields(_people(spark, sf), ["zip", "patient", "email"], "c_custkey")


@query(
    "v13_outliers",
    """
WITH f AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
SELECT event_id, event_type FROM events JOIN f USING (event_type) WHERE abs(value - m) > 1.5 * s
""",
)
def v13_outliers(spark, sf):
    return V.outliers(table(spark, sf, "events"), "value", ["event_type"], 1.5).select("event_id", "event_type")


@query("v13_events_per_month", "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS events FROM orders GROUP BY ALL")
def v13_months(spark, sf):
    return V.events_per_month(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@query(
    "v13_contradictions",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linestatus = 'F' AND l_returnflag IN ('A', 'R')) OR (l_linestatus = 'O' AND l_returnflag = 'N')",
)
def v13_contradictions(spark, sf):
    rules = [("l_linestatus", "f", "l_returnflag", ["A", "R"]), ("l_linestatus", "o", "l_returnflag", ["N"])]
    return V.contradictions(table(spark, sf, "lineitem"), rules).select("l_orderkey", "l_linenumber")


def _terminology(spark, sf):
    """Long words of the dictionary texts as terms of two systems."""
    words = F.explode(F.regexp_extract_all(F.col("text"), F.lit("([A-Za-z]{7,})"), F.lit(1)))
    terms = table(spark, sf, "benchmark").select(words.alias("term")).distinct()
    first = terms.select("term", F.concat(F.lit("S"), F.length("term").cast("string")).alias("code"), F.lit("SYSONE").alias("display"), F.lit(1).alias("priority"))
    second = terms.select("term", F.lit("T00").alias("code"), F.lit("SYSTWO").alias("display"), F.lit(2).alias("priority"))
    return first.where(F.length("term") >= 9).unionByName(second)


_TERMS_SQL = "SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z]{7,})', 1)) AS w FROM benchmark)"
_CLEAN_SQL = f"""trim(regexp_replace(regexp_replace(lower(regexp_replace(translate(text, '{clean.MARKED}', '{clean.PLAIN}'),
  '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9 %/.\\-]', ' ', 'g'), ' +', ' ', 'g'), ' ')"""


@query(
    "v14_standardise_terms",
    f"""
WITH t AS ({_TERMS_SQL}), words AS (SELECT doc_id, unnest(regexp_extract_all({_CLEAN_SQL}, '([a-z0-9_]+)', 1)) AS w FROM documents)
SELECT d.doc_id, count(t.w) FILTER (length(t.w) >= 9) AS first_system, count(t.w) FILTER (length(t.w) < 9) AS second_system
FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN t ON words.w = t.w GROUP BY 1
""",
)
def v14(spark, sf):
    texts = text_table(spark, sf, "documents").select("doc_id", "text")
    done = V.standardise_terms(texts, "doc_id", "text", _terminology(spark, sf))

    def hits(name):
        return (F.size(F.split("text", name, -1)) - 1).cast("bigint")

    return done.select("doc_id", hits("SYSONE").alias("first_system"), hits("SYSTWO").alias("second_system"))


@query(
    "v14_standard_codes",
    f"""
WITH t AS ({_TERMS_SQL}), w AS (SELECT doc_id, regexp_extract({_CLEAN_SQL}, '([a-z]{{7,}})', 1) AS term FROM documents)
SELECT doc_id, term, CASE WHEN t.w IS NULL THEN NULL WHEN length(t.w) >= 9 THEN 'S' || length(t.w) ELSE 'T00' END AS code,
  CASE WHEN t.w IS NULL THEN NULL WHEN length(t.w) >= 9 THEN 'SYSONE' ELSE 'SYSTWO' END AS display
FROM w LEFT JOIN t ON w.term = t.w
""",
)
def v14_codes(spark, sf):
    words = text_table(spark, sf, "documents").select("doc_id", F.regexp_extract(clean.clean_term("text"), "([a-z]{7,})", 1).alias("term"))
    return V.standard_codes(words, "term", _terminology(spark, sf))
