"""Scans, sources and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.clean import moment
from ..operators.numbering import id_ranges, number_rows
from ..operators.profile import catalog
from ..session import scratch_path
from ..sources import scan, sink
from ..spec import ColumnRule, TableSpec
from .base import HISTORY_SQL, LINE_KEY, LINE_ORDER, TABLES, TODAY, history, query, table


@query(
    "s1_incremental_scan",
    f"""
WITH h AS ({HISTORY_SQL})
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders
WHERE o_orderdate > (SELECT date_trunc('day', max(last_updated)) FROM h) AND o_orderdate < TIMESTAMP '2001-06-01'
""",
)
def s1(spark, sf):
    done = history(spark, sf).withColumnRenamed("last_updated", "o_orderdate")
    rows = scan.incremental_scan(table(spark, sf, "orders"), done, "o_orderdate", TODAY)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query(
    "s1_incremental_scan_full",
    "SELECT event_id, user_id, ts FROM events",
)
def s1_full(spark, sf):
    return scan.incremental_scan(table(spark, sf, "events"), None, "ts", TODAY).select("event_id", "user_id", "ts")


@query("s2_tenant_filter", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey IN (3, 7, 12)")
def s2(spark, sf):
    return scan.tenant_filter(table(spark, sf, "customer"), "c_nationkey", [3, 7, 12]).select("c_custkey", "c_nationkey", "c_acctbal")


@query(
    "s3_typed_select",
    """
SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_linenumber AS TINYINT) AS l_linenumber,
       CAST(l_extendedprice AS DECIMAL(14,4)) AS l_extendedprice, CAST(l_discount AS DECIMAL(5,2)) AS l_discount,
       TRY_CAST(l_returnflag AS DOUBLE) AS l_returnflag, CAST(l_shipdate AS DATE) AS l_shipdate, l_linestatus
FROM lineitem
""",
)
def s3(spark, sf):
    types = {
        "l_orderkey": "NUMBER(10,0)",
        "l_linenumber": "NUMBER(2,0)",
        "l_extendedprice": "NUMBER(14,4)",
        "l_discount": "NUMBER(5,2)",
        "l_returnflag": "FLOAT",
        "l_shipdate": "DATE",
        "l_linestatus": "VARCHAR(16777216)",
    }
    return scan.typed_select(table(spark, sf, "lineitem"), types)


@query("s4_id_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 300 AND o_orderkey <= 1199")
def s4(spark, sf):
    return scan.id_range(table(spark, sf, "orders"), "o_orderkey", 300, 1200).select("o_orderkey", "o_totalprice")


@query(
    "s5_id_ranges",
    """
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)
SELECT CAST(rn // 700 AS BIGINT) AS batch, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, count(*) AS rows
FROM n GROUP BY 1
""",
)
def s5(spark, sf):
    return id_ranges(table(spark, sf, "orders"), "o_orderkey", 700)


@query("s6_page_scan", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 20")
def s6(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(20).limit(50)


@query(
    "s7_key_list_lookup",
    f"""
SELECT {LINE_ORDER} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
""",
)
def s7(spark, sf):
    from ..operators.joins import present_rows

    keys = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return present_rows(table(spark, sf, "lineitem"), keys, "l_orderkey", "o_orderkey").select(*LINE_KEY)


@query(
    "s8_key_config",
    """
WITH raw(table_name, primary_key) AS (SELECT n_name, 'key_' || n_nationkey || '| region_' || n_regionkey FROM nation
                                     UNION ALL SELECT r_name, 'r_regionkey' FROM region)
SELECT table_name, array_to_string(list_transform(string_split(primary_key, '|'), lambda x: trim(x)), '+') AS key_columns,
       CAST(len(string_split(primary_key, '|')) AS INTEGER) AS key_count
FROM raw
""",
)
def s8(spark, sf):
    nation = table(spark, sf, "nation").select(
        F.col("n_name").alias("table_name"),
        F.concat(F.lit("key_"), F.col("n_nationkey").cast("string"), F.lit("| region_"), F.col("n_regionkey").cast("string")).alias(
            "primary_key"
        ),
    )
    region = table(spark, sf, "region").select(F.col("r_name").alias("table_name"), F.lit("r_regionkey").alias("primary_key"))
    keys = scan.parse_keys(nation.unionByName(region))
    return keys.select("table_name", F.array_join("key_columns", "+").alias("key_columns"), F.size("key_columns").alias("key_count"))


@query(
    "s9_rule_sheet",
    """
WITH raw AS (SELECT p_brand AS table_name, p_type AS column_name, CASE WHEN max(p_size) > 40 THEN 'Yes' ELSE 'no' END AS is_phi,
                    CASE WHEN min(p_size) < 5 THEN 'mask' ELSE 'Dob' END AS rule, p_type AS mask_value
             FROM part GROUP BY p_brand, p_type)
SELECT table_name, CAST(count(*) FILTER (lower(is_phi) = 'yes') AS BIGINT) AS phi_columns,
       string_agg(column_name || ':' || CASE WHEN lower(is_phi) = 'yes' THEN 'true' ELSE 'false' END || ':' || upper(rule) || ':' || mask_value, ','
                  ORDER BY column_name) AS config
FROM raw GROUP BY table_name
""",
)
def s9(spark, sf):
    raw = (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("table_name"), F.col("p_type").alias("column_name"))
        .agg(
            F.when(F.max("p_size") > 40, "Yes").otherwise("no").alias("is_phi"),
            F.when(F.min("p_size") < 5, "mask").otherwise("Dob").alias("rule"),
        )
        .withColumn("mask_value", F.col("column_name"))
    )
    shown = F.transform(
        "columns_details",
        lambda c: F.concat_ws(":", c["column_name"], c["is_phi"].cast("string"), c["rule"], c["mask_value"]),
    )
    return scan.rule_sheet(raw).select("table_name", "phi_columns", F.array_join(shown, ",").alias("config"))


@query("s10_append_sink", "SELECT o_orderkey, o_totalprice, TIMESTAMP '2001-06-01 12:00:00' AS deid_ts FROM orders")
def s10(spark, sf):
    orders = table(spark, sf, "orders").withColumn("scratch", F.lit(1))
    path = scratch_path(spark, "append")
    stamp = moment(datetime(2001, 6, 1, 12))
    early, late = orders.where("o_orderdate < '1998-01-01'"), orders.where("o_orderdate >= '1998-01-01'")
    for part in (early, late):
        sink.append(part, path, ["o_orderkey", "o_totalprice", "deid_ts"], "deid_ts", stamp)
    return spark.read.parquet(path)


@query(
    "s11_rule_typed_target",
    """
SELECT c_custkey, TRY_CAST(c_name AS BIGINT) AS c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer
""",
)
def s11(spark, sf):
    spec = TableSpec(
        "customer",
        (ColumnRule("c_name", "PATIENT_ID"), ColumnRule("c_nationkey", "DOB"), ColumnRule("c_acctbal", "ZIP_CODE"), ColumnRule("c_mktsegment", "MASK", "SEG")),
    )
    return scan.typed_for_rules(table(spark, sf, "customer"), spec)


@query("s12_snapshot", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s12(spark, sf):
    nation = table(spark, sf, "nation")
    path = scratch_path(spark, "snapshot")
    sink.snapshot(nation.where("n_regionkey = 0"), path, "r1")
    return sink.snapshot(nation, path, "r1")  # the same run replaces its copy


@query("s13_range_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 1000 OR o_orderkey >= 2000")
def s13(spark, sf):
    return scan.without_range(table(spark, sf, "orders"), "o_orderkey", 1000, 2000).select("o_orderkey", "o_custkey")


@query(
    "s14_export_manifest",
    """
SELECT table_name, n > 0 AS has_files, n > 0 AS summed, n > 0 AS filled FROM (SELECT 'region' AS table_name, count(*) AS n FROM region
  UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer)
""",
)
def s14(spark, sf):
    path = scratch_path(spark, "export")
    for name in ("region", "nation", "customer"):
        sink.export(table(spark, sf, name), f"{path}/{name}")
    files = sink.manifest(spark, path)
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("table_name")).agg(
        (F.count(F.lit(1)) > 0).alias("has_files"), F.min(F.col("md5").rlike("^[0-9a-f]{32}$")).alias("summed"), F.min(F.col("bytes") > 0).alias("filled")
    )


@query(
    "s14_manifest_digests",
    """
WITH lines AS (SELECT 'region' AS table_name, r_regionkey AS k, r_regionkey || ',' || r_name || chr(10) AS line FROM region
  UNION ALL SELECT 'nation', n_nationkey, n_nationkey || ',' || n_name || ',' || n_regionkey || chr(10) FROM nation
  UNION ALL SELECT 'orders', o_orderkey, o_orderkey || ',' || o_custkey || ',' || o_orderstatus || chr(10) FROM orders)
SELECT table_name, sum(strlen(line))::BIGINT AS bytes, CASE WHEN table_name <> 'orders' THEN md5(string_agg(line, '' ORDER BY k)) END AS md5 FROM lines GROUP BY 1
""",
)
def s14_digests(spark, sf):
    """Bytes of all files of a table; the checksum too where a table is one file in the order of its key."""
    path = scratch_path(spark, "export")
    chosen = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"]}
    for name, columns in chosen.items():
        rows = table(spark, sf, name).select(*columns)
        sink.export(rows if name == "orders" else rows.sort(columns[0]).coalesce(1), f"{path}/{name}", "csv", header=False)
    files = sink.manifest(spark, path).withColumn("table_name", F.element_at(F.split("path", "/"), -2))
    return files.groupBy("table_name").agg(
        F.sum("bytes").alias("bytes"), F.max(F.when(F.col("table_name") != "orders", F.col("md5"))).alias("md5")
    )


@query(
    "s15_export_selection",
    """
WITH existing AS (SELECT n_name FROM nation), asked AS (SELECT lower(n_name) AS requested FROM nation WHERE n_regionkey IN (0, 1)
     UNION ALL SELECT 'missing_' || r_regionkey FROM region)
SELECT requested, n_name AS found_name, n_name IS NOT NULL AS found FROM asked LEFT JOIN existing ON upper(requested) = upper(n_name)
""",
)
def s15(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    asked = nation.where("n_regionkey IN (0, 1)").select(F.lower("n_name").alias("requested"))
    missing = region.select(F.concat(F.lit("missing_"), F.col("r_regionkey").cast("string")).alias("requested"))
    return scan.match_tables(asked.unionByName(missing), nation.select(F.col("n_name").alias("found_name")))


@query("s16_copy_filtered", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice > 250000")
def s16(spark, sf):
    copy = scan.copy_filtered(table(spark, sf, "orders"), F.col("o_totalprice") > 250000, ["o_orderkey", "o_orderdate", "o_totalprice"])
    path = scratch_path(spark, "copy")
    copy.write.parquet(path)
    return spark.read.parquet(path)


@query(
    "s17_table_catalog",
    """
SELECT table_name, column_name,
       CASE WHEN data_type IN ('TIMESTAMP', 'DATE') THEN 'date' WHEN data_type = 'VARCHAR' THEN 'string'
            WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type LIKE '%[]' THEN 'other' ELSE 'numeric' END AS family
FROM information_schema.columns WHERE table_name IN (
  'region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations')
""",
)
def s17(spark, sf):
    return catalog(spark, {t: table(spark, sf, t) for t in TABLES}).select("table_name", "column_name", "family")


@query(
    "s18_retention",
    """
SELECT run, dense_rank() OVER (ORDER BY run DESC) <= 3 AS keep FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS run FROM events)
""",
)
def s18(spark, sf):
    runs = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run"))
    return scan.newest_runs(runs, "run", 3)


@query(
    "s19_image_inventory",
    """
WITH s AS (SELECT l_suppkey, l_partkey, l_orderkey, count(*) AS files, min(l_shipdate) AS p FROM lineitem GROUP BY ALL)
SELECT l_suppkey, count(DISTINCT l_partkey) AS studies, count(*) AS series, CAST(sum(files) AS BIGINT) AS files, min(p) AS first_path
FROM s GROUP BY l_suppkey
""",
)
def s19(spark, sf):
    levels = {"patient": ["l_suppkey"], "study": ["l_partkey"], "series": ["l_orderkey"]}
    return scan.image_inventory(table(spark, sf, "lineitem"), levels, "l_shipdate")


@query(
    "a7_since_mark",
    f"""
WITH h AS ({HISTORY_SQL}),
done AS (SELECT max(o_orderdate) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' AND o_orderstatus <> 'P')
SELECT order_key, last_updated FROM h WHERE last_updated > (SELECT m FROM done)
""",
)
def a7(spark, sf):
    rows = history(spark, sf).select("order_key", "last_updated")
    done = table(spark, sf, "orders").where("o_orderdate < '1998-07-01' AND o_orderstatus <> 'P'")
    return scan.since_mark(rows, done.select(F.col("o_orderdate").alias("last_updated")), "last_updated")


@query(
    "w2_next_row_ids",
    f"""
SELECT {LINE_ORDER}, 1000 + row_number() OVER (ORDER BY {LINE_ORDER}) AS row_id FROM lineitem
""",
)
def w2(spark, sf):
    return number_rows(table(spark, sf, "lineitem").select(*LINE_KEY), LINE_KEY, start=1001)
