"""Encoding and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import encode as E
from tessera.plans import fixtures as FX
from tessera.plans.catalog import register
from tessera.sources.tables import table

# The ordinal order of order priorities (FIXTURES.md B).
PRIORITY_RANKS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
PRIORITY_REVERSED = {k: 6 - v for k, v in PRIORITY_RANKS.items()}


def _mm_sql(col: str, src: str) -> str:
    """x * s + m with s = 1/range (0 range -> 1), m = -min * s."""
    s = (f"(1.0::DOUBLE / (CASE WHEN (SELECT max({col}) - min({col}) FROM {src}) = 0 THEN 1.0::DOUBLE "
         f"ELSE (SELECT max({col}) - min({col}) FROM {src}) END))")
    return f"(CAST({col} AS DOUBLE) * {s} + (0.0::DOUBLE - (SELECT min({col}) FROM {src}) * {s}))"


def _rank_case(col: str, ranks: dict[str, int]) -> str:
    order = sorted(ranks, key=ranks.get)
    return "CASE " + " ".join(f"WHEN {col} = '{v}' THEN {float(i)!r}::DOUBLE" for i, v in enumerate(order)) + " END"


@register("column_roles_dirty_orders", "E1,A4", f"""
WITH s AS (SELECT * FROM {FX.view(FX.DIRTY_ORDERS_SQL)}),
nd AS (SELECT count(DISTINCT o_orderstatus) + max(CAST(o_orderstatus IS NULL AS INT)) AS st,
              count(DISTINCT o_orderdate) + max(CAST(o_orderdate IS NULL AS INT)) AS dt,
              count(DISTINCT o_orderpriority) + max(CAST(o_orderpriority IS NULL AS INT)) AS pr FROM s)
SELECT 'o_custkey' AS column_name, 'numeric' AS role
UNION ALL SELECT 'o_orderstatus', CASE WHEN st <= 2 THEN 'binary' ELSE 'categorical' END FROM nd
UNION ALL SELECT 'o_totalprice', 'numeric'
UNION ALL SELECT 'o_orderdate', CASE WHEN dt <= 2 THEN 'binary' ELSE 'categorical' END FROM nd
UNION ALL SELECT 'o_orderpriority', CASE WHEN pr >= 2 THEN 'ordinal' WHEN pr <= 2 THEN 'binary' ELSE 'categorical' END FROM nd""")
def column_roles_dirty_orders(spark, d):
    roles = E.column_roles(FX.dirty_orders(spark, d), {"o_orderpriority": PRIORITY_RANKS}, "o_orderkey")
    return spark.createDataFrame(sorted(roles.items()), "column_name string, role string")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot_customer_segment", "E2", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_{s}"
    for s in _SEGMENTS) + " FROM customer")
def one_hot_customer_segment(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return E.one_hot(c, ["c_mktsegment"])


@register("one_hot_dirty_priority_null", "E2", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderpriority_{p}\""
    for p in PRIORITY_RANKS) + ", CASE WHEN o_orderpriority IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "
    "o_orderpriority_nan FROM " + FX.view(FX.DIRTY_ORDERS_SQL))
def one_hot_dirty_priority_null(spark, d):
    o = FX.dirty_orders(spark, d).select("o_orderkey", "o_orderpriority")
    return E.one_hot(o, ["o_orderpriority"])


@register("binary_encode_lineitem_status", "E3", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM lineitem) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS l_linestatus
FROM lineitem""")
def binary_encode_lineitem_status(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    return E.binary_encode(li, ["l_linestatus"])


@register("minmax_supplier_const", "E4", f"""
WITH s AS (SELECT s_suppkey, s_acctbal, 7.0::DOUBLE AS const_col FROM supplier)
SELECT s_suppkey, {_mm_sql('s_acctbal', 's')} AS s_acctbal, {_mm_sql('const_col', 's')} AS const_col FROM s""")
def minmax_supplier_const(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit(7.0).alias("const_col"))
    return E.minmax(s, ["s_acctbal", "const_col"])


@register("ordinal_encode_orders", "E5", f"""
WITH s AS (SELECT o_orderkey, {_rank_case('o_orderpriority', PRIORITY_RANKS)} AS a,
                  {_rank_case('o_orderpriority', PRIORITY_REVERSED)} AS b FROM orders)
SELECT o_orderkey, {_mm_sql('a', 's')} AS priority_rank, {_mm_sql('b', 's')} AS priority_reversed FROM s""")
def ordinal_encode_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority_rank"),
                                         F.col("o_orderpriority").alias("priority_reversed"))
    return E.ordinal_encode(o, {"priority_rank": PRIORITY_RANKS, "priority_reversed": PRIORITY_REVERSED})


@register("encode_orders", "E6,E1-E5", f"""
WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
                  {_rank_case('o_orderpriority', PRIORITY_RANKS)} AS o_orderpriority FROM orders)
SELECT o_orderkey, {_mm_sql('o_custkey', 's')} AS o_custkey, {_mm_sql('o_totalprice', 's')} AS o_totalprice,
       {_mm_sql('o_orderpriority', 's')} AS o_orderpriority,
       CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_F,
       CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_O,
       CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_P
FROM s""")
def encode_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         "o_orderpriority")
    return E.encode_and_normalize(o, {"o_orderpriority": PRIORITY_RANKS}, id_col="o_orderkey")


@register("validate_ranking_orders", "E7", """
SELECT 'o_orderpriority' AS column_name, 'ranks_not_1_to_n' AS problem, '1,2,3,5' AS detail
UNION ALL
SELECT DISTINCT 'o_orderpriority', 'value_not_ranked', o_orderpriority FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')""")
def validate_ranking_orders(spark, d):
    bad = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}
    return E.validate_ranking(table(spark, d, "orders"), {"o_orderpriority": bad})
