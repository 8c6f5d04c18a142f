"""Samples and first-per-key rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from .base import LINE_KEY, LINE_ORDER, query, table

SEED = "qc-1"


@query(
    "t1_sample_size",
    """
WITH c AS (SELECT o_orderpriority || o_orderstatus AS grp, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT l_returnflag, count(*) FROM lineitem GROUP BY 1
           UNION ALL SELECT CAST(n_regionkey AS VARCHAR), count(*) FROM nation GROUP BY 1)
SELECT grp, n, CAST(CASE WHEN n <= 300 THEN n WHEN n <= 1000 THEN 400 WHEN n <= 5000 THEN 650 WHEN n <= 10000 THEN 900
  WHEN n <= 100000 THEN least(3000 + floor((n - 10000) / 30000) * 1000, 5000) ELSE 5000 END AS BIGINT) AS sample_size FROM c
""",
)
def t1(spark, sf):
    def counts(t, c):
        return table(spark, sf, t).groupBy(c.alias("grp")).agg(F.count(F.lit(1)).alias("n"))

    all_counts = (
        counts("orders", F.concat("o_orderpriority", "o_orderstatus"))
        .unionByName(counts("lineitem", F.col("l_returnflag")))
        .unionByName(counts("nation", F.col("n_regionkey").cast("string")))
    )
    return all_counts.withColumn("sample_size", S.sample_size(F.col("n")))


@query("t2_random_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('{SEED}|' || o_orderkey), o_orderkey LIMIT 500")
def t2(spark, sf):
    return S.random_sample(table(spark, sf, "orders"), 500, "o_orderkey", SEED).select("o_orderkey", "o_totalprice")


@query(
    "t3_stratified_sample",
    f"""
WITH q AS (SELECT quantile_disc(o_totalprice, 0.25) AS q1, quantile_disc(o_totalprice, 0.5) AS q2, quantile_disc(o_totalprice, 0.75) AS q3 FROM orders),
k AS (SELECT o_orderkey, o_orderpriority, md5('{SEED}|' || o_orderkey) AS d,
  CASE WHEN o_totalprice <= q1 THEN '1' WHEN o_totalprice <= q2 THEN '2' WHEN o_totalprice <= q3 THEN '3' ELSE '4' END AS s FROM orders, q),
picked AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY s ORDER BY d, o_orderkey) AS rn FROM k) WHERE rn <= 20
  UNION SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY d, o_orderkey) AS rn FROM k) WHERE rn <= 20),
ranked AS (SELECT k.o_orderkey, CASE WHEN p.o_orderkey IS NULL THEN 1 ELSE 0 END AS cls, d FROM k LEFT JOIN picked p ON k.o_orderkey = p.o_orderkey)
SELECT o_orderkey FROM ranked ORDER BY cls, d, o_orderkey LIMIT 250
""",
)
def t3(spark, sf):
    orders = table(spark, sf, "orders")
    return S.stratified_sample(orders, ["o_totalprice", "o_orderpriority"], 20, 250, "o_orderkey", SEED).select("o_orderkey")


@query(
    "t4_paired_sample",
    f"""
WITH ids AS (SELECT o_orderkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 9000 ORDER BY md5('{SEED}|' || o_orderkey), o_orderkey LIMIT 200)
SELECT o_orderkey, o_totalprice AS before_price, o_totalprice + 1 AS after_price FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM ids) AND o_orderstatus <> 'P'
""",
)
def t4(spark, sf):
    before = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("before_price"))
    after = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("after_price"))
    b, a = S.paired_sample(before, after, "o_orderkey", 1000, 9000, 200, SEED)
    return b.join(a, "o_orderkey")


_FIRST_SQL = f"""
SELECT {LINE_ORDER} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn FROM lineitem) WHERE rn = 1
"""


@query("t5_first_per_key", _FIRST_SQL)
def t5(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_KEY)
    return S.first_per_key(lines, ["l_orderkey", "l_linenumber"], [F.col(c) for c in LINE_KEY])


@query("t6_dedup_by_row_id", "SELECT o_orderkey AS row_id, o_totalprice AS price FROM orders")
def t6(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"))
    return S.dedup_by_row_id(rows.unionByName(rows), "row_id", [F.col("price")])


@query(
    "t7_single_row_for_listed",
    """
WITH l AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE rn = 1 OR o_custkey NOT IN (SELECT c_custkey FROM l)
""",
)
def t7(spark, sf):
    listed = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return S.single_row_for(table(spark, sf, "orders"), "o_custkey", listed, newest).select("o_custkey", "o_orderkey")


@query(
    "t8_capped_failing_ids",
    """
WITH f AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_totalprice > 400000)
SELECT o_orderpriority, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS failing_ids FROM f WHERE rn <= 25 GROUP BY 1
""",
)
def t8(spark, sf):
    failing = table(spark, sf, "orders").where("o_totalprice > 400000")
    capped = S.capped_ids(failing, ["o_orderpriority"], "o_orderkey")
    return capped.select("o_orderpriority", F.array_join(F.col("failing_ids").cast("array<string>"), ",").alias("failing_ids"))


@query("t9_preview_page", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_partkey LIMIT 25 OFFSET 100")
def t9(spark, sf):
    return S.page(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey", 100, 25)
