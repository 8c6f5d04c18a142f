"""Points where users hang in their own code: a rule, a pattern handler, a check, a validator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checks import register_check, sure
from ..functions.rules import RuleContext, apply_rule, register_rule
from ..functions.text import generic_mask
from ..operators import quality as Q
from .base import query, table


@register_rule("KEEP_INITIAL", "text")
def keep_initial(c, context):
    return F.concat(F.substring(c, 1, 1), F.lit("***"))


@register_check("KEEP_INITIAL")
def initial_kept(after, before=None, **_):
    return {5: sure(after.rlike(r"^.\*{3}$") & (F.substring(after, 1, 1) == F.substring(before, 1, 1)))}


@query("n1_own_rule", "SELECT s_suppkey, s_name[1] || '***' AS s_name FROM supplier")
def n1(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", apply_rule("KEEP_INITIAL", "s_name", RuleContext()).alias("s_name"))


@query(
    "n2_own_handler",
    """
SELECT c_custkey, 'write to <mail> about ' || c_name AS note FROM customer WHERE c_acctbal > 0
UNION ALL SELECT c_custkey, 'no mail about ' || c_name FROM customer WHERE c_acctbal <= 0
""",
)
def n2(spark, sf):
    """Addresses become a word of the user's own instead of the mask."""
    address = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.example.org"))
    opening = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("write to "), address)).otherwise("no mail")
    note = F.concat(opening, F.lit(" about "), "c_name")
    own = {"email": lambda text, pattern, mask: F.regexp_replace(text, pattern, "<mail>")}
    return table(spark, sf, "customer").select("c_custkey", generic_mask(note, custom=own).alias("note"))


@query(
    "n3_own_check",
    """
SELECT 'customer' AS table_name, 'c_name' AS column_name, 'KEEP_INITIAL' AS rule, count(*) FILTER (c_mktsegment <> 'BUILDING') AS passed,
       count(*) FILTER (c_mktsegment = 'BUILDING') AS failed FROM customer
""",
)
def n3(spark, sf):
    """One segment was left as it was."""
    customers = table(spark, sf, "customer")
    after = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(apply_rule("KEEP_INITIAL", "c_name", RuleContext()))
    pairs = customers.select(F.col("c_name").alias("c_name_before"), after.alias("c_name_after"))
    checked = Q.check_columns(pairs, [Q.ColumnCheck("c_name", "KEEP_INITIAL")], "customer")
    return checked.select("table_name", "column_name", "rule", "passed", "failed")


@query("n4_own_validator", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'P'")
def n4(spark, sf):
    """A validator is a function that gives the bad rows of a frame."""

    def open_and_dear(df):
        return df.where((F.col("o_totalprice") > 400_000) & (F.col("o_orderstatus") == "P"))

    return table(spark, sf, "orders").transform(open_and_dear).select("o_orderkey", "o_totalprice")
