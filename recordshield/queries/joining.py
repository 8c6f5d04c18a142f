"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import reports, versioned
from ..operators.mapping import pii_rows
from ..operators.notes import attach_terms, pii_terms
from .base import (
    HISTORY_SQL,
    INCREMENT_SQL,
    LAYERS_SQL,
    LINE_KEY,
    LINE_ORDER,
    MAPS_SQL,
    PATIENTS_SQL,
    encounters,
    history,
    increment,
    patients,
    query,
    table,
)


@query(
    "j1_enrichment_join",
    """
SELECT o_orderkey, o_custkey, c_name AS c_name_cust, c_mktsegment AS c_mktsegment_cust
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
""",
)
def j1(spark, sf):
    right = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return J.enrich(left, right, "o_custkey", "c_custkey", suffix="_cust", drop_right_key=True)


@query(
    "j2_patient_map_join",
    f"""
WITH pmap AS ({PATIENTS_SQL})
SELECT o_orderkey, sur_patient_id AS sur_patient_id_from_custkey, day_offset AS day_offset_from_custkey
FROM orders LEFT JOIN pmap ON o_custkey = custkey
""",
)
def j2(spark, sf):
    out = J.map_patient(table(spark, sf, "orders"), patients(spark, sf), [J.PatientKey("o_custkey", "custkey")])
    return out.select("o_orderkey", "sur_patient_id_from_custkey", "day_offset_from_custkey")


@query(
    "j3_two_hop_map",
    f"""
WITH {MAPS_SQL}
SELECT {LINE_ORDER}, e.sur_encounter_id, e.sur_patient_id AS sur_patient_id_from_encounter, p.day_offset AS day_offset_from_encounter
FROM lineitem LEFT JOIN emap e ON l_orderkey = e.encounter_id LEFT JOIN pmap p ON e.sur_patient_id = p.sur_patient_id
""",
)
def j3(spark, sf):
    out = J.map_encounter(table(spark, sf, "lineitem"), encounters(spark, sf), patients(spark, sf), "l_orderkey")
    return out.select(*LINE_KEY, "sur_encounter_id", "sur_patient_id_from_encounter", "day_offset_from_encounter")


APPOINTMENTS_SQL = """
    SELECT event_id AS appointment_id, 50000001 + event_id AS sur_appointment_id, p.sur_patient_id
    FROM events JOIN pmap p ON user_id = p.custkey WHERE event_type <> 'error'
"""


def appointments(spark, sf):
    events = table(spark, sf, "events").where("event_type <> 'error'")
    people = patients(spark, sf).select("custkey", "sur_patient_id")
    return events.join(people, events["user_id"] == people["custkey"]).select(
        F.col("event_id").alias("appointment_id"), (F.col("event_id") + 50000001).alias("sur_appointment_id"), "sur_patient_id"
    )


@query(
    "j4_appointment_map",
    f"""
WITH pmap AS ({PATIENTS_SQL}), amap AS ({APPOINTMENTS_SQL})
SELECT event_id, a.sur_appointment_id, a.sur_patient_id AS sur_patient_id_from_appointment, p.day_offset AS day_offset_from_appointment
FROM events LEFT JOIN amap a ON event_id = a.appointment_id LEFT JOIN pmap p ON a.sur_patient_id = p.sur_patient_id
""",
)
def j4(spark, sf):
    out = J.map_encounter(
        table(spark, sf, "events"), appointments(spark, sf), patients(spark, sf), "event_id", "appointment_id", "appointment"
    )
    return out.select("event_id", "sur_appointment_id", "sur_patient_id_from_appointment", "day_offset_from_appointment")


@query(
    "j5_resolve_identity",
    f"""
WITH {MAPS_SQL}
SELECT o_orderkey, coalesce(e.sur_patient_id, p.sur_patient_id) AS sur_patient_id, coalesce(pe.day_offset, p.day_offset) AS day_offset
FROM orders LEFT JOIN pmap p ON o_custkey = p.custkey
LEFT JOIN emap e ON o_orderkey = e.encounter_id LEFT JOIN pmap pe ON e.sur_patient_id = pe.sur_patient_id
""",
)
def j5(spark, sf):
    out = J.map_patient(table(spark, sf, "orders"), patients(spark, sf), [J.PatientKey("o_custkey", "custkey")])
    out = J.map_encounter(out, encounters(spark, sf), patients(spark, sf), "o_orderkey")
    return J.resolve_identity(out, ["custkey"], 34).select("o_orderkey", "sur_patient_id", "day_offset")


@query(
    "j6_bridge_join",
    f"""
WITH bridge AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, min(CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_custkey AS VARCHAR) END) AS chart
                FROM orders GROUP BY 1)
SELECT {LINE_ORDER}, chart FROM lineitem JOIN bridge ON CAST(l_orderkey AS VARCHAR) = k WHERE chart <> ''
""",
)
def j6(spark, sf):
    chart = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_custkey").cast("string"))
    bridge = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), chart.alias("dst"))
    return J.bridge_join(table(spark, sf, "lineitem"), bridge, "l_orderkey", "src", "dst", "chart").select(*LINE_KEY, "chart")


def _path(spark, sf):
    return [
        J.Hop(table(spark, sf, "orders"), "o_orderkey", "o_custkey", "o_orderkey"),
        J.Hop(
            table(spark, sf, "customer").withColumn(
                "nation", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey"))
            ),
            "c_custkey",
            "nation",
            "c_custkey",
        ),
        J.Hop(table(spark, sf, "nation"), "n_nationkey", "n_name", "n_nationkey"),
    ]


@query(
    "j7_reference_path",
    f"""
SELECT {LINE_ORDER}, n_name AS target FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""",
)
def j7(spark, sf):
    return J.follow_path(table(spark, sf, "lineitem"), "l_orderkey", _path(spark, sf), "target").select(*LINE_KEY, "target")


@query(
    "j7_first_known",
    """
SELECT l_orderkey, arg_min(l_suppkey, l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey) AS first_supplier FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey
""",
)
def j7_first(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns(
        {"known": F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")), "pos": F.col("l_linenumber") * F.lit(100000000000) + F.col("l_partkey") * 10000 + F.col("l_suppkey")}
    )
    first = J.first_known(J.Hop(rows, "l_orderkey", "known", "pos"))
    return first.select(F.col("__k").alias("l_orderkey"), F.col("__next").alias("first_supplier"))


@query(
    "j8_build_bridge",
    """
WITH existing AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT l_orderkey AS src, n_name AS dst FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment <> 'MACHINERY' AND l_orderkey NOT IN (SELECT o_orderkey FROM existing)
""",
)
def j8(spark, sf):
    existing = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("src"))
    return J.build_bridge(table(spark, sf, "lineitem"), "l_orderkey", _path(spark, sf), existing, "src", "dst")


@query(
    "j9_or_of_chains",
    """
SELECT DISTINCT l_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
UNION
SELECT DISTINCT l_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0
""",
)
def j9(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    base = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    cust = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    supp = table(spark, sf, "supplier").where("s_acctbal < 0")
    by_customer = base.join(cust, base["o_custkey"] == cust["c_custkey"]).select("l_orderkey", "o_custkey")
    by_supplier = base.join(supp, base["l_suppkey"] == supp["s_suppkey"]).select("l_orderkey", "o_custkey")
    return J.or_of_chains([by_customer, by_supplier])


@query(
    "j10_never_processed",
    f"""
WITH h AS ({HISTORY_SQL}) SELECT order_key, row_id FROM h
WHERE row_id NOT IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderstatus <> 'P')
""",
)
def j10(spark, sf):
    processed = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select((F.col("o_orderkey") + 1).alias("row_id"))
    return J.absent_rows(history(spark, sf), processed, ["row_id"]).select("order_key", "row_id")


@query(
    "j11_backfill",
    f"""
SELECT {LINE_ORDER} FROM lineitem l WHERE NOT EXISTS (
  SELECT 1 FROM lineitem k WHERE k.l_shipdate < TIMESTAMP '1999-01-01' AND k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber)
""",
)
def j11(spark, sf):
    lines = table(spark, sf, "lineitem")
    loaded = lines.where("l_shipdate < '1999-01-01'")
    return J.absent_rows(lines, loaded, ["l_orderkey", "l_linenumber"]).select(*LINE_KEY)


@query(
    "j12_lower_flags",
    f"""
WITH {LAYERS_SQL}
SELECT order_key, row_id, CASE WHEN order_key IN (SELECT order_key FROM i) THEN 'N' ELSE 'Y' END AS active_flag FROM h
""",
)
def j12(spark, sf):
    return versioned.lower_flags(history(spark, sf), increment(spark, sf), ["order_key"]).select("order_key", "row_id", "active_flag")


@query(
    "j13_dump_difference",
    f"""
WITH newer AS ({INCREMENT_SQL} UNION ALL {INCREMENT_SQL}),
older AS (SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS last_updated FROM orders
          WHERE o_orderdate < TIMESTAMP '2001-01-01')
SELECT order_key, cust_key, status, price, last_updated FROM newer n WHERE NOT EXISTS (
  SELECT 1 FROM older o WHERE o.order_key = n.order_key AND o.cust_key = n.cust_key AND o.status = n.status AND o.price = n.price
  AND o.last_updated = n.last_updated)
""",
)
def j13(spark, sf):
    cols = ["order_key", "cust_key", "status", "price", "last_updated"]
    newer = increment(spark, sf)
    newer = newer.unionByName(newer)  # every row twice: duplicates of the newer side stay
    older = table(spark, sf, "orders").where("o_orderdate < '2001-01-01'")
    older = older.select(*[F.col(o).alias(n) for o, n in zip(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"], cols)])
    return J.dump_difference(newer, older, ["extracted_date"]).select(*cols)


CHANGED = "o_orderkey BETWEEN 1000 AND 1400 AND o_orderstatus = 'F'"


@query(
    "j13_range_digests",
    f"""
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN {CHANGED} THEN 'changed' ELSE o_orderpriority END AS o_orderpriority, o_orderdate
FROM orders WHERE {CHANGED} OR o_orderkey % 977 = 0
""",
)
def j13_ranges(spark, sf):
    """All orders against an older copy in which some rows differ and some are missing."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
    orders = table(spark, sf, "orders").select(*columns)
    newer = orders.withColumn("o_orderpriority", F.when(F.expr(CHANGED), "changed").otherwise(F.col("o_orderpriority")))
    return J.dump_difference_by_range(newer, orders.where("o_orderkey % 977 <> 0"), "o_orderkey")


@query(
    "j14_pair_by_id",
    """
SELECT o_orderkey, o_totalprice AS o_totalprice_before, o_totalprice * 2 AS o_totalprice_after FROM orders WHERE o_orderstatus <> 'P'
""",
)
def j14(spark, sf):
    before = table(spark, sf, "orders")
    after = before.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return J.pair_by_id(before, after, "o_orderkey", ["o_totalprice"])


@query(
    "j15_surrogate_lookup",
    f"WITH pmap AS ({PATIENTS_SQL}) SELECT sur_patient_id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer JOIN pmap ON c_custkey = custkey",
)
def j15(spark, sf):
    roles = {"c_name": "name", "c_nationkey": "nation"}
    return pii_rows(table(spark, sf, "customer"), roles, patients(spark, sf), "c_custkey", "custkey")


@query(
    "j16_wide_counts",
    """
WITH a AS (SELECT 'Orders' AS t, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lines', l_linestatus, count(*) FROM lineitem GROUP BY 2),
b AS (SELECT 'orders' AS t, o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 2),
wa AS (SELECT lower(t) AS table_name, sum(n) FILTER (s = 'F') AS f, sum(n) FILTER (s = 'O') AS o, sum(n) FILTER (s = 'P') AS p FROM a GROUP BY 1),
wb AS (SELECT lower(t) AS table_name, sum(n) FILTER (s = 'F') AS f, sum(n) FILTER (s = 'O') AS o, sum(n) FILTER (s = 'P') AS p FROM b GROUP BY 1)
SELECT coalesce(wa.table_name, wb.table_name) AS table_name, CAST(wa.f AS BIGINT) AS F_source, CAST(wa.o AS BIGINT) AS O_source, CAST(wa.p AS BIGINT) AS P_source,
       CAST(wb.f AS BIGINT) AS F_target, CAST(wb.o AS BIGINT) AS O_target, CAST(wb.p AS BIGINT) AS P_target
FROM wa FULL JOIN wb ON wa.table_name = wb.table_name
""",
)
def j16(spark, sf):
    def counts(df, name, site):
        return df.groupBy(F.lit(name).alias("table_name"), F.col(site).alias("site")).agg(F.count(F.lit(1)).alias("row_count"))

    orders = table(spark, sf, "orders")
    first = counts(orders, "Orders", "o_orderstatus").unionByName(counts(table(spark, sf, "lineitem"), "lines", "l_linestatus"))
    second = counts(orders.where("o_orderdate < '2000-01-01'"), "orders", "o_orderstatus")
    return reports.wide_counts(first, second, ["F", "O", "P"], ("source", "target"))


@query(
    "j17_cohort_copy",
    """
WITH cohort AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey IN (3, 4)),
visits AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM cohort))
SELECT 'orders' AS table_name, o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM cohort)
UNION ALL SELECT 'events', event_id FROM events WHERE user_id IN (SELECT id FROM cohort)
UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM visits)
""",
)
def j17(spark, sf):
    people = table(spark, sf, "customer").where("c_nationkey IN (3, 4)").select(F.col("c_custkey").alias("id"))
    visits = J.present_rows(table(spark, sf, "orders"), people, "o_custkey", "id").select(F.col("o_orderkey").alias("id"))
    tables = {t: table(spark, sf, t) for t in ("orders", "events", "lineitem", "part")}
    copied = J.cohort_copy(tables, {"patient": people, "encounter": visits})
    ids = {"orders": "o_orderkey", "events": "event_id", "lineitem": "l_orderkey"}
    return reports.union_all([df.select(F.lit(t).alias("table_name"), F.col(ids[t]).alias("id")) for t, df in copied.items()])


@query(
    "j18_code_cohort_documents",
    """
WITH cohort AS (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R') AND l_discount >= 0.09)
SELECT c.o_custkey AS patient_id, o.o_orderkey AS document_id, n.c_name AS title, l.l_linenumber AS page
FROM cohort c JOIN orders o ON o.o_custkey = c.o_custkey JOIN customer n ON n.c_custkey = c.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
""",
)
def j18(spark, sf):
    orders, lines, cust = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    coded = lines.where(F.col("l_returnflag").isin("R") & (F.col("l_discount") >= 0.09))
    cohort = orders.join(coded, orders["o_orderkey"] == coded["l_orderkey"]).select(F.col("o_custkey").alias("patient_id")).distinct()
    docs = cohort.join(orders, cohort["patient_id"] == orders["o_custkey"]).join(cust, F.col("patient_id") == cust["c_custkey"])
    pages = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page"))
    return docs.join(pages, docs["o_orderkey"] == pages["k"], "left").select(
        "patient_id", F.col("o_orderkey").alias("document_id"), F.col("c_name").alias("title"), "page"
    )


@query(
    "j19_master_table",
    """
SELECT l_orderkey AS claim_id, l_linenumber AS claim_line, o_custkey AS patient_id, l_suppkey AS payer_id, o_orderdate AS invoice_date,
       l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
)
def j19(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_orderkey").alias("claim_id"),
        F.col("l_linenumber").alias("claim_line"),
        F.col("o_custkey").alias("patient_id"),
        F.col("l_suppkey").alias("payer_id"),
        F.col("o_orderdate").alias("invoice_date"),
        F.col("l_extendedprice").alias("amount"),
    )


@query(
    "j20_structure_difference",
    """
WITH a AS (SELECT 'orders' AS table_name, count(*) AS row_count, 6 AS column_count FROM orders UNION ALL SELECT 'customer', count(*), 5 FROM customer
           UNION ALL SELECT 'nation', count(*), 3 FROM nation),
b AS (SELECT 'orders' AS table_name, count(*) AS row_count, 6 AS column_count FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'customer', count(*), 5 FROM customer)
SELECT a.table_name, a.row_count, CAST(a.column_count AS BIGINT) AS column_count, b.row_count AS other_rows, CAST(b.column_count AS BIGINT) AS other_columns
FROM a LEFT JOIN b ON a.table_name = b.table_name
WHERE a.row_count IS DISTINCT FROM b.row_count OR a.column_count IS DISTINCT FROM b.column_count
""",
)
def j20(spark, sf):
    orders, cust, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    first = reports.table_statistics({"orders": orders, "customer": cust, "nation": nation}).drop("state")
    second = reports.table_statistics({"orders": orders.where("o_orderstatus <> 'P'"), "customer": cust}).drop("state")
    return reports.structure_difference(first, second)


@query(
    "j21_pii_lists",
    f"""
WITH {MAPS_SQL},
terms AS (SELECT DISTINCT sur_patient_id, v, m FROM (
  SELECT sur_patient_id, c_name AS v, '((NAME))' AS m FROM customer JOIN pmap ON c_custkey = custkey
  UNION ALL SELECT sur_patient_id, c_mktsegment, '((SEGMENT))' FROM customer JOIN pmap ON c_custkey = custkey)),
lists AS (SELECT sur_patient_id, string_agg(v || '=' || m, ';' ORDER BY length(v) DESC, v) AS terms FROM terms GROUP BY 1)
SELECT o_orderkey, p.sur_patient_id, l.terms FROM orders LEFT JOIN pmap p ON o_custkey = p.custkey LEFT JOIN lists l ON p.sur_patient_id = l.sur_patient_id
""",
)
def j21(spark, sf):
    roles = {"c_name": "name", "c_mktsegment": "segment"}
    pii = pii_rows(table(spark, sf, "customer"), roles, patients(spark, sf), "c_custkey", "custkey")
    terms = pii_terms(pii, {"name": "((NAME))", "segment": "((SEGMENT))"})
    owned = J.map_patient(table(spark, sf, "orders"), patients(spark, sf), [J.PatientKey("o_custkey", "custkey")])
    owned = owned.select("o_orderkey", F.col("sur_patient_id_from_custkey").alias("sur_patient_id"), F.col("o_orderpriority").alias("text"))
    listed = attach_terms(owned, "o_orderkey", "text", terms)
    shown = F.array_join(F.transform("terms", lambda t: F.concat(t["value"], F.lit("="), t["mask"])), ";")
    return listed.select("o_orderkey", "sur_patient_id", F.when(F.col("terms").isNotNull(), shown).alias("terms"))


