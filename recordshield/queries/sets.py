"""Unions, table sets and merges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import versioned
from ..operators.filters import rename, stack_sources
from ..operators.joins import or_of_chains
from ..operators.numbering import next_ids
from ..plans.versions import BucketedTable, VersionedTable
from ..session import scratch_path
from ..sources.scan import table_sets
from .base import LAYERS_SQL, history, increment, query, table


@query(
    "u1_append_versions",
    f"""
WITH {LAYERS_SQL}
SELECT order_key, status, row_id, active_flag, extracted_date FROM h
UNION ALL SELECT order_key, status, (SELECT max(row_id) FROM h) + row_number() OVER (ORDER BY order_key, last_updated), 'Y', extracted_date FROM i
""",
)
def u1(spark, sf):
    h = history(spark, sf)
    merged = versioned.append_versions(h, next_ids(h, increment(spark, sf), ["order_key", "last_updated"]))
    return merged.select("order_key", "status", "row_id", "active_flag", "extracted_date")


@query(
    "u2_stack_sources",
    """
SELECT c_custkey AS patient_id, CAST(NULL AS BIGINT) AS chart_id, c_nationkey AS site FROM customer
UNION ALL SELECT NULL, s_suppkey, s_nationkey FROM supplier UNION ALL SELECT o_custkey, o_orderkey, NULL FROM orders
""",
)
def u2(spark, sf):
    a = rename(table(spark, sf, "customer"), {"c_custkey": "patient_id", "c_nationkey": "site"}, keep_others=False)
    b = rename(table(spark, sf, "supplier"), {"s_suppkey": "chart_id", "s_nationkey": "site"}, keep_others=False)
    c = rename(table(spark, sf, "orders"), {"o_custkey": "patient_id", "o_orderkey": "chart_id"}, keep_others=False)
    return stack_sources([a, b, c])


@query(
    "u3_distinct_union",
    "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT user_id FROM events WHERE event_type = 'error'",
)
def u3(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"))
    return or_of_chains([a, b])


@query(
    "u4_table_sets",
    """
WITH i AS (SELECT DISTINCT lower(p_name) AS t FROM part WHERE p_size < 25), h AS (SELECT DISTINCT lower(upper(p_name)) AS t FROM part WHERE p_brand <> 'Brand#2' AND p_size > 20)
SELECT t AS table_name, CASE WHEN t IN (SELECT t FROM h) THEN 'common' ELSE 'increment only' END AS membership FROM i
UNION ALL SELECT t, 'remaining' FROM h WHERE t NOT IN (SELECT t FROM i)
""",
)
def u4(spark, sf):
    part = table(spark, sf, "part")
    i = part.where("p_size < 25").select(F.col("p_name").alias("table_name"))
    h = part.where("p_brand <> 'Brand#2' AND p_size > 20").select(F.upper("p_name").alias("table_name"))
    return table_sets(i, h)


MERGED_SQL = f"""
WITH {LAYERS_SQL},
n AS (SELECT *, (SELECT max(row_id) FROM h) + row_number() OVER (ORDER BY order_key, last_updated) AS new_id FROM i),
v AS (SELECT order_key, cust_key, status, price, last_updated, row_id FROM h UNION ALL SELECT order_key, cust_key, status, price, last_updated, new_id FROM n)
SELECT order_key, cust_key, status, price, last_updated, row_id,
       CASE WHEN row_number() OVER (PARTITION BY order_key ORDER BY last_updated DESC NULLS LAST, row_id DESC) = 1 THEN 'Y' ELSE 'N' END AS active_flag FROM v
"""
MERGED_COLUMNS = ["order_key", "cust_key", "status", "price", "last_updated", "row_id", "active_flag"]


@query("u5_versioned_merge", MERGED_SQL)
def u5(spark, sf):
    return versioned.versioned_merge(history(spark, sf), increment(spark, sf), ["order_key"]).table.select(*MERGED_COLUMNS)


@query(
    "u5_versioned_merge_check",
    f"WITH m AS ({MERGED_SQL}) SELECT 'orders' AS table_name, count(DISTINCT order_key) AS distinct_keys, count(*) FILTER (active_flag = 'Y') AS active_rows, "
    "count(DISTINCT order_key) = count(*) FILTER (active_flag = 'Y') AS valid, 'one active row per key' AS reason FROM m",
)
def u5_check(spark, sf):
    return versioned.versioned_merge(history(spark, sf), increment(spark, sf), ["order_key"], table="orders").check


_TABLE_SQL = f"""
WITH {LAYERS_SQL},
a AS (SELECT *, row_number() OVER (ORDER BY order_key, last_updated) AS id FROM (SELECT order_key, status, last_updated FROM h)),
b AS (SELECT *, (SELECT max(id) FROM a) + row_number() OVER (ORDER BY order_key, last_updated) AS id FROM (SELECT order_key, status, last_updated FROM i)),
v AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT order_key, status, id AS row_id, CASE WHEN row_number() OVER (PARTITION BY order_key ORDER BY last_updated DESC, id DESC) = 1 THEN 'Y' ELSE 'N' END AS active_flag FROM v
"""


@query("u5_versioned_table", _TABLE_SQL)
def u5_table(spark, sf):
    store = VersionedTable(spark, scratch_path(spark, "versions"), ("order_key",))
    store.merge(history(spark, sf).drop("row_id", "active_flag"), run=1)
    store.merge(increment(spark, sf), run=2)
    store.merge(increment(spark, sf), run=2)  # a rerun replaces its own run
    return store.history().select("order_key", "status", "row_id", "active_flag")


@query("u5_bucketed_merge", _TABLE_SQL)
def u5_bucketed(spark, sf):
    store = BucketedTable(spark, scratch_path(spark, "buckets"), ("order_key",), buckets=16)
    store.merge(history(spark, sf).drop("row_id", "active_flag"), run=1)
    store.merge(increment(spark, sf), run=2)
    store.merge(increment(spark, sf), run=2)  # a rerun replaces its own run
    return store.history().select("order_key", "status", "row_id", "active_flag")


@query(
    "u6_merge_dump_difference",
    f"""
WITH {LAYERS_SQL}
SELECT order_key, status, row_id, active_flag, extracted_date FROM h
UNION ALL SELECT o_orderkey, o_orderstatus, o_orderkey + 1, NULL, DATE '2001-06-01' FROM orders WHERE o_orderkey + 1 NOT IN (SELECT row_id FROM h)
""",
)
def u6(spark, sf):
    orders = table(spark, sf, "orders")
    difference = orders.select(
        F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") + 1).alias("row_id")
    )
    main = history(spark, sf).select("order_key", "status", "row_id", "active_flag", "extracted_date")
    return versioned.merge_dump_difference(main, difference, date(2001, 6, 1))
