"""Fields out of message columns. The messages are put together from customers and orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import messages as M
from .base import query, table, text_table


def _hl7(spark, sf):
    orders, cust = text_table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(cust, orders["o_custkey"] == cust["c_custkey"])
    person = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("X"), F.col("o_custkey").cast("string"))).otherwise(
        F.when(F.col("o_orderstatus") == "O", (F.col("o_custkey") + 3000000000).cast("string")).otherwise(F.col("o_custkey").cast("string"))
    )
    born = F.when(F.col("o_orderpriority") == "5-LOW", "19991340").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    message = F.concat(
        F.lit("MSH|^~\\&|LAB|SITE\r\nPID|1|"), person, F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" |A|"), F.col("c_name"),
        F.lit("^"), F.col("c_mktsegment"), F.lit("^M||"), born, F.lit("|\r\nOBX|1|NM|"), F.col("o_totalprice").cast("decimal(12,2)").cast("string"),
    )
    return joined.select("o_orderkey", message.alias("message"))


@query(
    "e1_hl7_person",
    """
SELECT o_orderkey, CAST(CASE WHEN o_orderstatus IN ('P', 'O') THEN 0 ELSE o_custkey END AS INTEGER) AS person_id, c_name || ' ' || c_mktsegment AS name,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dob
FROM orders JOIN customer ON o_custkey = c_custkey
""",
)
def e1(spark, sf):
    rows = _hl7(spark, sf)
    return rows.select("o_orderkey", *[c.alias(n) for n, c in M.hl7_person("message").items()])


@query(
    "e2_hl7_field",
    """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS pid_4, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS obx_4, CAST(NULL AS VARCHAR) AS pv1_2, CAST(NULL AS VARCHAR) AS pid_40 FROM orders
""",
)
def e2(spark, sf):
    return _hl7(spark, sf).select(
        "o_orderkey",
        M.hl7_field("message", "PID", 4).alias("pid_4"),
        M.hl7_field("message", "OBX", 4).alias("obx_4"),
        M.hl7_field("message", "PV1", 2).alias("pv1_2"),
        M.hl7_field("message", "PID", 40).alias("pid_40"),
    )


def _escaped(value: Column, marks: str) -> Column:
    """A value as it stands in a message with these separators."""
    codes = dict(zip(marks, "FSRET"))
    for mark in (marks[3], *[m for m in marks if m != marks[3]]):
        value = F.replace(value, F.lit(mark), F.lit(f"{marks[3]}{codes[mark]}{marks[3]}"))
    return value


@query(
    "e2_message_tree",
    r"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '#*+!%' ELSE '|^~\&' END AS marks, CAST(o_custkey AS VARCHAR) AS first_id, CAST(c_nationkey AS VARCHAR) AS second_id,
       c_mktsegment AS authority, c_name || ' |^~\&#*+!% \F\' AS family, 'Zoë' || chr(10) || '\H\' AS given, CAST(NULL AS VARCHAR) AS fourth,
       o_orderpriority AS second_note, CASE WHEN o_orderstatus = 'F' THEN '#' ELSE '|' END AS msh_1, 'SITE' AS msh_4, 4::INTEGER AS segments
FROM orders JOIN customer ON o_custkey = c_custkey
""",
)
def e2_tree(spark, sf):
    """Two sets of separators, declared in the header; values that hold all of them; repetitions, sub-components, escapes."""
    orders, cust = text_table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(cust, orders["o_custkey"] == cust["c_custkey"])

    def message(marks: str):
        f, c, r, e, b = marks
        name = F.concat(F.col("c_name"), F.lit(" |^~\\&#*+!% \\F\\"))
        given = F.lit(f"Zo{e}XC3AB{e}{e}.br{e}") if e == "\\" else F.lit(f"Zoë{e}X0A{e}")
        shown = F.lit(f"{e}H{e}") if e == "\\" else _escaped(F.lit("\\H\\"), marks)
        return F.concat(
            F.lit(f"MSH{f}{c}{r}{e}{b}{f}LAB{f}SITE\rPID{f}1{f}{f}"), F.col("o_custkey").cast("string"), F.lit(r), F.col("c_nationkey").cast("string"),
            F.lit(f"{c}{c}{c}A{b}"), _escaped(F.col("c_mktsegment"), marks), F.lit(f + f), _escaped(name, marks), F.lit(c), given, shown,
            F.lit(f"\r\nNTE{f}1{f}x\r\n\r\nNTE{f}2{f}"), _escaped(F.col("o_orderpriority"), marks), F.lit("\r"),
        )

    text = F.when(F.col("o_orderstatus") == "F", message("#*+!%")).otherwise(message("|^~\\&"))
    rows = joined.select("o_orderkey", text.alias("message")).select("o_orderkey", M.message_separators("message").alias("marks"), M.message_tree("message").alias("t"))
    return rows.select(
        "o_orderkey", "marks",
        M.tree_value("t", "PID", 3).alias("first_id"),
        M.tree_value("t", "PID", 3, 2).alias("second_id"),
        M.tree_value("t", "PID", 3, 2, 4, 2).alias("authority"),
        M.tree_value("t", "PID", 5).alias("family"),
        M.tree_value("t", "PID", 5, 1, 2).alias("given"),
        M.tree_value("t", "PID", 5, 1, 4).alias("fourth"),
        M.tree_value("t", "NTE", 2, occurrence=2).alias("second_note"),
        M.tree_value("t", "MSH", 1).alias("msh_1"),
        M.tree_value("t", "MSH", 4).alias("msh_4"),
        F.size("t").alias("segments"),
    )


@query(
    "e3_xml_value",
    "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<(?:\\w+:)?title(?:\\s[^>]*)?>(.*?)</(?:\\w+:)?title\\s*>', 1), ' '), '') AS title FROM pages",
)
def e3(spark, sf):
    return table(spark, sf, "pages").select("page_id", M.xml_value("html", "title").alias("title"))


@query(
    "e3_xml_value_cdata",
    "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS patient, o_orderpriority AS priority FROM orders",
)
def e3_cdata(spark, sf):
    message = F.concat(
        F.lit('<n:rec><n:PatientId a="1"><![CDATA[ '), F.col("o_custkey").cast("string"), F.lit(" ]]></n:PatientId><Priority>"),
        F.col("o_orderpriority"), F.lit("</Priority>"),
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", M.xml_value(message, "patientid").alias("patient"), M.xml_value(message, "priority").alias("priority")
    )


@query(
    "e4_xml_identifiers",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS encounter_id, CAST(o_custkey AS VARCHAR) AS patient_id FROM orders",
)
def e4(spark, sf):
    k, p = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    tags = F.concat(F.lit("<r><encounterId>"), k, F.lit("</encounterId><patientID> "), p, F.lit("</patientID>"))
    attributes = F.concat(F.lit('<r encounterid="'), k, F.lit("\" x='1' patientid='"), p, F.lit("'/>"))
    owners = F.concat(F.lit('<Encounter type="a" id="'), k, F.lit('"><patient id="'), p, F.lit('"/></Encounter>'))
    loose = F.concat(F.lit("broken < encounterId: "), k, F.lit(" patientId="), p)
    s = F.col("o_orderstatus")
    low = F.col("o_orderpriority") == "5-LOW"
    message = F.when(low, loose).when(s == "F", tags).when(s == "O", attributes).otherwise(owners)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        M.xml_identifier(message, ["encounterid"], ["encounter"]).alias("encounter_id"),
        M.xml_identifier(message, ["patientid"], ["patient"]).alias("patient_id"),
    )
