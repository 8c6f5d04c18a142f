"""Counts, marks, roll-ups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import reports, versioned
from ..operators.profile import value_overlap
from .base import LAYERS_SQL, TABLES, VERSIONED_SQL, history, query, table
from .base import versioned as versioned_orders

VERSIONS = f"WITH {LAYERS_SQL}, v AS ({VERSIONED_SQL})"


@query(
    "a1_table_counts",
    f"""
{VERSIONS}
SELECT 'orders' AS table_name, count(*) AS total_rows, count(*) FILTER (active_flag = 'Y') AS active_rows FROM v
UNION ALL SELECT 'lineitem', count(*), count(*) FROM lineitem
""",
)
def a1(spark, sf):
    return reports.table_counts({"orders": versioned_orders(spark, sf), "lineitem": table(spark, sf, "lineitem")})


@query(
    "a2_distinct_keys",
    "SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL",
)
def a2(spark, sf):
    return reports.distinct_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "a3_one_active_check",
    f"""
{VERSIONS}, c AS (SELECT count(DISTINCT order_key) AS d, count(*) FILTER (active_flag = 'Y') AS a FROM v)
SELECT 'orders' AS table_name, d AS distinct_keys, a AS active_rows, a = d AS valid,
       CASE WHEN a = d THEN 'one active row per key' WHEN a > d THEN (a - d) || ' active rows too many' ELSE (d - a) || ' keys without an active row' END AS reason
FROM c
""",
)
def a3(spark, sf):
    return versioned.one_active_check(versioned_orders(spark, sf), ["order_key"], "orders")


@query(
    "a3_keys_not_one_active",
    f"{VERSIONS} SELECT order_key, count(*) FILTER (active_flag = 'Y') AS active_rows FROM v GROUP BY 1 HAVING count(*) FILTER (active_flag = 'Y') <> 1",
)
def a3_keys(spark, sf):
    return versioned.keys_not_one_active(versioned_orders(spark, sf), ["order_key"])


@query("a4_high_water_mark", f"{VERSIONS} SELECT max(last_updated) AS mark FROM v")
def a4(spark, sf):
    return reports.high_water_mark(versioned_orders(spark, sf), "last_updated")


@query("a5_distinct_keys_as_text", "SELECT count(DISTINCT concat_ws(',', l_orderkey, l_linenumber)) AS distinct_keys FROM lineitem")
def a5(spark, sf):
    return reports.distinct_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], as_text=True)


@query(
    "a6_id_span",
    """
SELECT 'orders' AS table_name, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders
UNION ALL SELECT 'events', min(event_id), max(event_id) FROM events
""",
)
def a6(spark, sf):
    return reports.id_span({"orders": (table(spark, sf, "orders"), "o_orderkey"), "events": (table(spark, sf, "events"), "event_id")})


@query(
    "a8_group_latest",
    "SELECT user_id, max(ts) AS last_created, count(*) AS records, max(event_type) AS last_status FROM events GROUP BY user_id",
)
def a8(spark, sf):
    return reports.latest_per_group(table(spark, sf, "events"), "user_id", "ts", "event_type")


@query(
    "a9_status_rollup",
    """
SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'COMPLETED' WHEN bool_or(o_orderstatus = 'P') THEN 'RUNNING'
  WHEN bool_or(o_orderstatus = 'X') THEN 'FAILED' ELSE 'PENDING' END AS state FROM orders GROUP BY o_custkey
""",
)
def a9(spark, sf):
    return reports.rolled_status(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", "F", "P", "X")


@query(
    "a10_status_counts",
    """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY 1
""",
)
def a10(spark, sf):
    return reports.status_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "a10_stage_state",
    """
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS s,
           count(*) FILTER (event_type = 'click') AS k FROM events GROUP BY 1)
SELECT user_id, CASE WHEN e > 70 THEN 'Failed' WHEN p > 0 AND p = p + s + k THEN 'Completed' WHEN s > 0 THEN 'In Progress' WHEN k > 0 THEN 'Interrupted' ELSE 'Pending' END AS stage_state FROM c
""",
)
def a10_state(spark, sf):
    counts = reports.status_counts(table(spark, sf, "events"), "user_id", "event_type", ["error", "purchase", "signup", "click"])
    counts = counts.withColumn("error", F.greatest(F.col("error") - 70, F.lit(0)))
    return reports.stage_state(counts, "user_id", "error", "purchase", "signup", "click")


_STATS_SQL = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS column_count FROM {t}"
    for t in TABLES
)


@query(
    "a11_table_statistics",
    f"WITH s AS ({_STATS_SQL}) SELECT table_name, row_count, column_count, CASE WHEN row_count > 0 THEN 'filled' ELSE 'empty' END AS state FROM s",
)
def a11(spark, sf):
    return reports.table_statistics({t: table(spark, sf, t) for t in TABLES})


@query(
    "a12_extreme_tables",
    f"""
WITH s AS ({_STATS_SQL}), b AS (SELECT * FROM s ORDER BY row_count DESC, table_name DESC LIMIT 1), m AS (SELECT * FROM s ORDER BY row_count, table_name LIMIT 1)
SELECT b.table_name AS largest, b.row_count AS largest_rows, m.table_name AS smallest, m.row_count AS smallest_rows FROM b, m
""",
)
def a12(spark, sf):
    return reports.extreme_tables(reports.table_statistics({t: table(spark, sf, t) for t in TABLES}))


def _chunks(spark, sf):
    """Chunk results of a column check: price limits, one chunk per priority."""
    return (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", F.col("o_orderstatus").alias("column_name"))
        .agg(
            F.count_if(F.col("o_totalprice") >= 1000).alias("passed"),
            F.count_if(F.col("o_totalprice") < 1000).alias("failed"),
            F.when(F.count_if(F.col("o_totalprice") < 1000) > 0, F.array(F.concat(F.lit("low in "), F.first("o_orderpriority"))))
            .otherwise(F.array().cast("array<string>"))
            .alias("reasons"),
        )
        .select(F.lit("orders").alias("table_name"), "column_name", "passed", "failed", "reasons")
    )


CHUNKS_SQL = """
SELECT 'orders' AS table_name, o_orderstatus AS column_name, count(*) FILTER (o_totalprice >= 1000) AS passed, count(*) FILTER (o_totalprice < 1000) AS failed,
       coalesce(string_agg(DISTINCT 'low in ' || o_orderpriority, '; ' ORDER BY 'low in ' || o_orderpriority) FILTER (o_totalprice < 1000), '') AS reasons
FROM orders GROUP BY 2
"""


@query("a13_merge_qc", CHUNKS_SQL)
def a13(spark, sf):
    return reports.merge_qc(_chunks(spark, sf))


@query(
    "a13_table_verdict",
    f"""
WITH q AS ({CHUNKS_SQL})
SELECT 'orders' AS table_name, count(*) AS source_rows, count(*) FILTER (o_orderstatus <> 'P') AS target_rows, count(*) FILTER (o_orderstatus = 'P') AS ignored_rows,
       (SELECT bool_and(failed = 0) FROM q) AS passed FROM orders
""",
)
def a13_verdict(spark, sf):
    counts = table(spark, sf, "orders").agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(F.col("o_orderstatus") != "P").alias("target_rows"),
        F.count_if(F.col("o_orderstatus") == "P").alias("ignored_rows"),
    )
    return reports.table_verdict(reports.merge_qc(_chunks(spark, sf)), counts.withColumn("table_name", F.lit("orders")))


@query("a14_key_lists", "SELECT p_brand AS table_name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS key_columns FROM part GROUP BY 1")
def a14(spark, sf):
    return reports.key_lists(table(spark, sf, "part").select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("column_name")))


@query(
    "a15_source_history_report",
    f"""
{VERSIONS}, flat AS (
  SELECT 'site_a' AS schema_name, 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, count(*) AS history_rows,
         count(*) FILTER (active_flag = 'Y') AS active_rows, count(DISTINCT order_key) AS distinct_keys FROM v
  UNION ALL
  SELECT 'site_a', 'old_orders', (SELECT count(*) FROM h), count(*), count(*) FILTER (active_flag = 'Y'), count(DISTINCT order_key) FROM h
  UNION ALL
  SELECT 'site_b', 'customer', (SELECT count(*) FROM customer), count(*), count(*), count(DISTINCT c_custkey) FROM customer),
r AS (SELECT coalesce(schema_name, 'TOTAL') AS schema_name, coalesce(table_name, 'TOTAL') AS table_name, CAST(sum(source_rows) AS BIGINT) AS source_rows,
  CAST(sum(history_rows) AS BIGINT) AS history_rows, CAST(sum(active_rows) AS BIGINT) AS active_rows, CAST(sum(distinct_keys) AS BIGINT) AS distinct_keys
  FROM flat GROUP BY ROLLUP (schema_name, table_name))
SELECT *, source_rows - active_rows AS diff, CASE WHEN source_rows = active_rows THEN 'OK' ELSE 'DIFF' END AS verdict FROM r
""",
)
def a15(spark, sf):
    h, cust = history(spark, sf), table(spark, sf, "customer")
    return reports.source_history_report(
        {
            "orders": ("site_a", table(spark, sf, "orders"), versioned_orders(spark, sf), ["order_key"]),
            "old_orders": ("site_a", h, h, ["order_key"]),
            "customer": ("site_b", cust, cust.withColumn("active_flag", F.lit("Y")), ["c_custkey"]),
        }
    )


@query(
    "a16_value_overlap",
    """
SELECT 'events' AS table_name, 'user_id' AS column_name, count(*) AS values, count(*) FILTER (user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS hits,
       round(count(*) FILTER (user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) / count(*), 6) AS overlap FROM events
""",
)
def a16(spark, sf):
    return value_overlap(table(spark, sf, "events"), "events", "user_id", table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey")


@query(
    "a17_count_snapshot",
    f"""
{VERSIONS}
SELECT DATE '2001-06-01' AS snapshot_date, 'daily' AS run_name, 'orders' AS table_name, count(*) AS total_rows, count(*) FILTER (active_flag = 'Y') AS active_rows FROM v
""",
)
def a17(spark, sf):
    from ..session import scratch_path
    from ..sources.sink import snapshot

    counts = reports.table_counts({"orders": versioned_orders(spark, sf)})
    counts = counts.select(F.lit(date(2001, 6, 1)).alias("snapshot_date"), F.lit("daily").alias("run_name"), "*")
    return snapshot(counts, scratch_path(spark, "counts"), "2001-06-01")


@query(
    "a19_image_overview",
    """
SELECT count(DISTINCT l_suppkey) AS patients, count(DISTINCT (l_suppkey, l_partkey)) AS studies, count(DISTINCT (l_suppkey, l_partkey, l_orderkey)) AS series,
       count(*) FILTER (l_linestatus = 'F') AS state_f, count(*) FILTER (l_linestatus = 'O') AS state_o FROM lineitem
""",
)
def a19(spark, sf):
    levels = {
        "patients": ["l_suppkey"],
        "studies": ["l_suppkey", "l_partkey"],
        "series": ["l_suppkey", "l_partkey", "l_orderkey"],
    }
    return reports.image_overview(table(spark, sf, "lineitem"), levels, "l_linestatus", ["F", "O"])


@query("a20_distinct_values", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL")
def a20(spark, sf):
    return reports.distinct_values(table(spark, sf, "orders"), "o_custkey")
