"""Registry, table access and the roles the test tables play."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import moment
from ..operators.mapping import keyed_offset
from ..sources.scan import row_tasks, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SALT = "test-salt"
CUT = datetime(2000, 1, 1)
TODAY = date(2001, 6, 1)
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on, spread over all cores."""
    return spread(table(spark, sf, name))


# --- a map of patients: every customer outside one market segment, so that some rows stay unmapped ---------------------

PATIENTS_SQL = f"""
    SELECT c_custkey AS custkey, 7000001 + c_custkey AS sur_patient_id,
           CAST(10 + (('0x' || substr(sha256('{SALT}|' || c_custkey), 1, 8))::BIGINT % 21) AS INTEGER) AS day_offset
    FROM customer WHERE c_mktsegment <> 'MACHINERY'
"""


def patients(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "customer")
        .where("c_mktsegment <> 'MACHINERY'")
        .select(
            F.col("c_custkey").alias("custkey"),
            (F.col("c_custkey") + 7000001).alias("sur_patient_id"),
            keyed_offset("c_custkey", SALT).alias("day_offset"),
        )
    )


# --- a map of encounters: orders that are not in state P, of mapped customers ------------------------------------------

ENCOUNTERS_SQL = """
    SELECT o_orderkey AS encounter_id, 90000001 + o_orderkey AS sur_encounter_id, p.sur_patient_id
    FROM orders JOIN pmap p ON o_custkey = p.custkey WHERE o_orderstatus <> 'P'
"""


def encounters(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    people = patients(spark, sf).select("custkey", "sur_patient_id")
    return orders.join(people, orders["o_custkey"] == people["custkey"]).select(
        F.col("o_orderkey").alias("encounter_id"), (F.col("o_orderkey") + 90000001).alias("sur_encounter_id"), "sur_patient_id"
    )


# --- a history of orders up to a day, and an increment with new orders and new versions of the urgent old ones ----------

HISTORY_SQL = """
    SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS status, o_totalprice AS price,
           o_orderdate AS last_updated, o_orderkey + 1 AS row_id, 'Y' AS active_flag, DATE '2000-01-02' AS extracted_date
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'
"""
INCREMENT_SQL = """
    SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS status, o_totalprice AS price,
           o_orderdate AS last_updated, DATE '2001-09-02' AS extracted_date
    FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
    UNION ALL
    SELECT o_orderkey, o_custkey, 'X', o_totalprice, TIMESTAMP '2001-09-01', DATE '2001-09-02'
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderpriority = '1-URGENT'
"""
LAYERS_SQL = f"h AS ({HISTORY_SQL}), i AS ({INCREMENT_SQL})"
MAPS_SQL = f"pmap AS ({PATIENTS_SQL}), emap AS ({ENCOUNTERS_SQL})"


def _order_columns(df: DataFrame, extracted: date, *extra) -> DataFrame:
    return df.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("cust_key"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("last_updated"),
        *extra,
        F.lit(extracted).alias("extracted_date"),
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").where(F.col("o_orderdate") < moment(CUT))
    return _order_columns(old, date(2000, 1, 2), (F.col("o_orderkey") + 1).alias("row_id"), F.lit("Y").alias("active_flag"))


def increment(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    fresh = orders.where(F.col("o_orderdate") >= moment(CUT))
    changed = orders.where((F.col("o_orderdate") < moment(CUT)) & (F.col("o_orderpriority") == "1-URGENT"))
    changed = changed.withColumns(
        {"o_orderstatus": F.lit("X"), "o_orderdate": moment(datetime(2001, 9, 1))}
    )
    day = date(2001, 9, 2)
    return _order_columns(fresh, day).unionByName(_order_columns(changed, day))


# --- versioned orders: the history with the increment behind it, flags not yet repaired --------------------------------

VERSIONED_SQL = """
    SELECT order_key, cust_key, status, price, last_updated, row_id, active_flag, extracted_date FROM h
    UNION ALL
    SELECT order_key, cust_key, status, price, last_updated, 100000000 + order_key, 'Y', extracted_date FROM i
"""


def versioned(spark: SparkSession, sf: str) -> DataFrame:
    new = increment(spark, sf).withColumns({"row_id": F.col("order_key") + 100000000, "active_flag": F.lit("Y")})
    return history(spark, sf).unionByName(new)


# --- notes: a text about each order that names its customer, a date and contact data ------------------------------------

NOTES_SQL = """
    SELECT o_orderkey AS note_id, o_custkey AS custkey, o_orderdate AS noted_at,
           c_name || ' seen ' || strftime(o_orderdate, '%Y-%m-%d') || ', call 716-555-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0')
           || ' or write u' || o_custkey || '@mail.example.org about order ' || o_orderkey || '.' AS note
    FROM orders JOIN customer ON o_custkey = c_custkey
"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    # dealt out behind the join: tasks cut by bytes would be few and long
    joined = joined.select("o_orderkey", "o_custkey", "o_orderdate", "c_name").repartition(row_tasks(orders))
    text = F.concat(
        "c_name",
        F.lit(" seen "),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(", call 716-555-"),
        F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"),
        F.lit(" or write u"),
        F.col("o_custkey").cast("string"),
        F.lit("@mail.example.org about order "),
        F.col("o_orderkey").cast("string"),
        F.lit("."),
    )
    return joined.select(
        F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("noted_at"), text.alias("note")
    )


# --- line items lack a row id: seven columns together are unique --------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice"]
LINE_ORDER = ", ".join(LINE_KEY)
