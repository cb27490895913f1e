"""Derived dirty views over the supplied tables (FIXTURES.md section B).

The supplied tables hold no NULLs, no malformed numbers and no marks, so the
health-check and cleaning queries run on deterministic dirty views derived
from them. Each view exists twice: as a Spark DataFrame and as the identical
DuckDB SQL used by the oracle. Both cover every row of the source table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import MARKS
from tessera.sources.tables import table


# ------------------------------------------------------------ dirty_orders
def dirty_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(k % 10 < 8, F.lit("F")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


DIRTY_ORDERS_SQL = """
SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 10 < 8 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders"""


# ------------------------------------------------------------ text_prices
def text_prices(spark: SparkSession, d: str) -> DataFrame:
    """o_totalprice rendered as text in six styles chosen by o_orderkey % 6:
    plain, comma decimal, European, Unicode minus, not a number, two commas."""
    o = table(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole = F.floor(cents / 100).cast("long").cast("string")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    thousands = F.floor(cents / 100000).cast("long").cast("string")
    units = F.lpad((F.floor(cents / 100).cast("long") % 1000).cast("string"), 3, "0")
    k = F.col("o_orderkey") % 6
    text = (F.when(k == 0, F.concat(whole, F.lit("."), frac))
            .when(k == 1, F.concat(whole, F.lit(","), frac))
            .when(k == 2, F.concat(thousands, F.lit("."), units, F.lit(","), frac))
            .when(k == 3, F.concat(F.lit("−"), whole, F.lit("."), frac))
            .when(k == 4, F.lit("abc"))
            .otherwise(F.concat(thousands, F.lit(","), units, F.lit(","), F.lpad(frac, 3, "0"))))
    return o.select("o_orderkey", "o_custkey", text.alias("price_text"))


TEXT_PRICES_SQL = """
SELECT o_orderkey, o_custkey,
  CASE o_orderkey % 6
    WHEN 0 THEN CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
    WHEN 1 THEN CAST(c // 100 AS VARCHAR) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
    WHEN 2 THEN CAST(c // 100000 AS VARCHAR) || '.' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0')
                || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
    WHEN 3 THEN '−' || CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
    WHEN 4 THEN 'abc'
    ELSE CAST(c // 100000 AS VARCHAR) || ',' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0')
         || ',' || lpad(lpad(CAST(c % 100 AS VARCHAR), 2, '0'), 3, '0')
  END AS price_text
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)"""


# ------------------------------------------------------------ marked_text
def marked_text(spark: SparkSession, d: str) -> DataFrame:
    """p_name with one mark prefixed, chosen by p_partkey % 12 (0 = none)."""
    p = table(spark, d, "part")
    marks = F.array(F.lit(""), *[F.lit(c) for c, _, _ in MARKS])
    mark = F.element_at(marks, (F.col("p_partkey") % 12 + 1).cast("int"))
    return p.select("p_partkey", F.concat(mark, F.col("p_name")).alias("p_name"), "p_brand",
                    "p_type", "p_size", "p_retailprice")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MARKED_TEXT_SQL = (
    "SELECT p_partkey, ([" + ", ".join(_sql_str(c) for c in [""] + [m[0] for m in MARKS])
    + "])[p_partkey % 12 + 1] || p_name AS p_name, p_brand, p_type, p_size, p_retailprice FROM part")


# ------------------------------------------------------------ spiked_events
def spiked_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    v = F.col("value")
    val = (F.when(F.col("event_id") == 0, v * 1000)
           .when(F.col("event_id") == 1, -v * 1000).otherwise(v))
    return e.select("event_id", "user_id", "event_type", val.alias("value"))


SPIKED_EVENTS_SQL = """
SELECT event_id, user_id, event_type,
  CASE WHEN event_id = 0 THEN value * 1000 WHEN event_id = 1 THEN -value * 1000 ELSE value END AS value
FROM events"""


# ------------------------------------------------------------ wide_numeric
def wide_numeric(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_extendedprice").cast("double").alias("extendedprice"),
        F.col("l_discount").cast("double").alias("discount"),
        F.col("l_tax").cast("double").alias("tax"),
        F.col("l_linenumber").cast("double").alias("linenumber"))


WIDE_NUMERIC_SQL = """
SELECT CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS extendedprice,
  CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax,
  CAST(l_linenumber AS DOUBLE) AS linenumber
FROM lineitem"""


def view(sql: str) -> str:
    """Wrap a fixture as a CTE body."""
    return "(" + sql.strip() + ")"
