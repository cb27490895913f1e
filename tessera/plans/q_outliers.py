"""Outlier, box-statistics and simple-imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import impute as I
from tessera.operators import outliers as O
from tessera.plans import fixtures as FX
from tessera.plans.catalog import register
from tessera.sources.tables import table


def _flags_sql(source: str, cols: list[str]) -> str:
    longv = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {source}"
        for i, c in enumerate(cols))
    return f"""
WITH l AS (SELECT * FROM ({longv}) WHERE value IS NOT NULL AND NOT isnan(value)),
hi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value DESC) AS r FROM l) WHERE r <= 8),
lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value ASC) AS r
                      FROM l WHERE value <> 0) WHERE r <= 8),
hf AS (SELECT column_name, pos, count(DISTINCT value) > 3
              AND bool_or(value <> 0 AND (SELECT max(h2.value) FROM hi h2 WHERE h2.column_name = hi.column_name) / value > 5) AS f
       FROM hi GROUP BY column_name, pos),
lf AS (SELECT column_name, pos, count(DISTINCT value) > 3 AND min(value) < 0
              AND bool_or(value <> 0 AND abs((SELECT min(l2.value) FROM lo l2 WHERE l2.column_name = lo.column_name)) / abs(value) > 5) AS f
       FROM lo GROUP BY column_name, pos)
SELECT coalesce(hf.column_name, lf.column_name) AS column_name, coalesce(hf.pos, lf.pos) AS pos,
       coalesce(hf.f, false) AS high, coalesce(lf.f, false) AS low
FROM hf FULL OUTER JOIN lf ON hf.column_name = lf.column_name"""


EVENT_COLS = ["user_id", "value"]
CUSTOMER_NUM = ["c_nationkey", "c_acctbal"]


@register("outlier_flags_spiked_events", "O1,O2,A11,A12",
          _flags_sql(FX.view(FX.SPIKED_EVENTS_SQL), EVENT_COLS))
def outlier_flags_spiked_events(spark, d):
    return O.outlier_flags(FX.spiked_events(spark, d).select(*EVENT_COLS))


@register("outlier_flags_customer", "O1,O2",
          _flags_sql("customer", CUSTOMER_NUM))
def outlier_flags_customer(spark, d):
    return O.outlier_flags(table(spark, d, "customer").select(*CUSTOMER_NUM))


_LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("find_outliers_lineitem", "O3,A6", f"""
SELECT column_name AS "Column", 'Possibly High Outlier(s)' AS "Value", pos, 0 AS _s FROM ({_flags_sql('lineitem', _LINE_NUM)}) WHERE high
UNION ALL
SELECT column_name, 'Possibly Low Outlier(s)', pos, 1 FROM ({_flags_sql('lineitem', _LINE_NUM)}) WHERE low""")
def find_outliers_lineitem(spark, d):
    return O.find_outliers(table(spark, d, "lineitem").select(*_LINE_NUM))


@register("find_outliers_spiked_events", "O3", f"""
SELECT column_name AS "Column", 'Possibly High Outlier(s)' AS "Value", pos, 0 AS _s FROM ({_flags_sql(FX.view(FX.SPIKED_EVENTS_SQL), EVENT_COLS)}) WHERE high
UNION ALL
SELECT column_name, 'Possibly Low Outlier(s)', pos, 1 FROM ({_flags_sql(FX.view(FX.SPIKED_EVENTS_SQL), EVENT_COLS)}) WHERE low""")
def find_outliers_spiked_events(spark, d):
    return O.find_outliers(FX.spiked_events(spark, d).select(*EVENT_COLS))


@register("outlier_candidates_events_high", "O4,A11", f"""
SELECT event_id, value FROM {FX.view(FX.SPIKED_EVENTS_SQL)} ORDER BY value DESC, event_id LIMIT 8""")
def outlier_candidates_events_high(spark, d):
    return O.outlier_candidates(FX.spiked_events(spark, d), "value", "event_id", "high")


@register("outlier_candidates_customer_low", "O4,A11", """
SELECT c_custkey, c_acctbal AS value FROM customer WHERE c_acctbal <> 0 ORDER BY c_acctbal ASC, c_custkey LIMIT 8""")
def outlier_candidates_customer_low(spark, d):
    return O.outlier_candidates(table(spark, d, "customer"), "c_acctbal", "c_custkey", "low")


@register("remove_outliers_events", "O6,P7", f"""
SELECT event_id, value FROM {FX.view(FX.SPIKED_EVENTS_SQL)}
WHERE event_id NOT IN (SELECT event_id FROM {FX.view(FX.SPIKED_EVENTS_SQL)} ORDER BY value DESC, event_id LIMIT 2)
ORDER BY value DESC, event_id LIMIT 8""")
def remove_outliers_events(spark, d):
    ev = FX.spiked_events(spark, d)
    chosen = O.outlier_candidates(ev, "value", "event_id", "high", k=2)
    _, refreshed = O.remove_outliers(ev, chosen, "event_id", "value", "high")
    return refreshed


@register("box_stats_customer_segment", "O5,X7", """
WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median,
                  quantile_cont(c_acctbal, 0.75) AS q3, count(c_acctbal) AS n FROM customer GROUP BY c_mktsegment)
SELECT q.c_mktsegment, min(c_acctbal) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       max(c_acctbal) AS max,
       min(CASE WHEN c_acctbal >= q1 - 1.5 * (q3 - q1) THEN c_acctbal END) AS lower_whisker,
       max(CASE WHEN c_acctbal <= q3 + 1.5 * (q3 - q1) THEN c_acctbal END) AS upper_whisker, n
FROM customer c JOIN q ON c.c_mktsegment = q.c_mktsegment
GROUP BY q.c_mktsegment, q1, median, q3, n""")
def box_stats_customer_segment(spark, d):
    b = O.box_stats(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"])
    return b.select("c_mktsegment", "min", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")],
                    "max", "lower_whisker", "upper_whisker", "n")


@register("box_stats_lineitem_price", "O5", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3, count(l_extendedprice) AS n FROM lineitem)
SELECT min(l_extendedprice) AS min, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3, max(l_extendedprice) AS max,
       min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END) AS lower_whisker,
       max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS upper_whisker,
       any_value(n) AS n
FROM lineitem, q""")
def box_stats_lineitem_price(spark, d):
    b = O.box_stats(table(spark, d, "lineitem"), "l_extendedprice")
    return b.select("min", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")],
                    "max", "lower_whisker", "upper_whisker", "n")


@register("columns_with_nulls_dirty_orders", "I1,A2", f"""
SELECT column_name, pos, has_null FROM (
  SELECT 'o_custkey' AS column_name, 0 AS pos, bool_or(o_custkey IS NULL) AS has_null FROM {FX.view(FX.DIRTY_ORDERS_SQL)}
  UNION ALL SELECT 'o_orderstatus', 1, bool_or(o_orderstatus IS NULL) FROM {FX.view(FX.DIRTY_ORDERS_SQL)}
  UNION ALL SELECT 'o_totalprice', 2, bool_or(o_totalprice IS NULL) FROM {FX.view(FX.DIRTY_ORDERS_SQL)}
  UNION ALL SELECT 'o_orderdate', 3, bool_or(o_orderdate IS NULL) FROM {FX.view(FX.DIRTY_ORDERS_SQL)}
  UNION ALL SELECT 'o_orderpriority', 4, bool_or(o_orderpriority IS NULL) FROM {FX.view(FX.DIRTY_ORDERS_SQL)})""")
def columns_with_nulls_dirty_orders(spark, d):
    return I.columns_with_nulls(FX.dirty_orders(spark, d), "o_orderkey")


@register("train_sample_orders", "I2", """
SELECT * FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 1000000 < 200000""")
def train_sample_orders(spark, d):
    """Rows-only: seeded 20% hash sample of orders (reproducible by id)."""
    return I.train_sample(table(spark, d, "orders"), 0.2, 42, "o_orderkey")


@register("simple_impute_dirty_orders", "I7", f"""
WITH s AS (SELECT * FROM {FX.view(FX.DIRTY_ORDERS_SQL)})
SELECT o_orderkey,
       round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM s)), 6) AS price_mean,
       round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM s)), 6) AS price_median,
       coalesce(o_orderpriority, (SELECT arg_min(o_orderpriority, (-n, o_orderpriority)) FROM
                                  (SELECT o_orderpriority, count(*) AS n FROM s WHERE o_orderpriority IS NOT NULL
                                   GROUP BY o_orderpriority))) AS priority_mode
FROM s""")
def simple_impute_dirty_orders(spark, d):
    df = FX.dirty_orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority")
    mean = I.simple_impute(df, "o_totalprice", "mean").select("o_orderkey", F.col("o_totalprice").alias("m"))
    med = I.simple_impute(df, "o_totalprice", "median").select("o_orderkey", F.col("o_totalprice").alias("md"))
    mode = I.simple_impute(df, "o_orderpriority", "mode").select("o_orderkey", "o_orderpriority")
    return mean.join(med, "o_orderkey").join(mode, "o_orderkey").select(
        "o_orderkey", F.round("m", 6).alias("price_mean"), F.round("md", 6).alias("price_median"),
        F.col("o_orderpriority").alias("priority_mode"))


@register("task_types_dirty_orders", "I4", f"""
WITH s AS (SELECT * FROM {FX.view(FX.DIRTY_ORDERS_SQL)}),
n AS (SELECT 'o_custkey' AS column_name, true AS numeric, count(DISTINCT o_custkey) AS n FROM s
  UNION ALL SELECT 'o_orderstatus', false, count(DISTINCT o_orderstatus) FROM s
  UNION ALL SELECT 'o_totalprice', true, count(DISTINCT o_totalprice) FROM s
  UNION ALL SELECT 'o_orderdate', false, count(DISTINCT o_orderdate) FROM s
  UNION ALL SELECT 'o_orderpriority', false, count(DISTINCT o_orderpriority) FROM s)
SELECT column_name, CASE WHEN numeric AND n > 20 THEN 'regression' WHEN n <= 2 THEN 'binary' ELSE 'multiclass' END AS task FROM n""")
def task_types_dirty_orders(spark, d):
    df = FX.dirty_orders(spark, d)
    rows = [(c, I.task_type(df, c)) for c in df.columns if c != "o_orderkey"]
    return spark.createDataFrame(rows, "column_name string, task string")


def _knn_sql(distance, fill):
    """The sampled rows near each row without a value, and what the five nearest give."""
    return f"""
WITH s AS (SELECT * FROM {FX.view(FX.DIRTY_ORDERS_SQL)}),
t AS (SELECT * FROM s WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 1000000 < 200000),
{distance},
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rn FROM pairs),
five AS (SELECT * FROM near WHERE rn <= 5),
{fill}"""


@register("knn_impute_priority_orders", "I5,I6,N1", _knn_sql("""
k AS (SELECT * FROM t WHERE o_orderpriority IS NOT NULL),
f AS (SELECT avg(CAST(o_custkey AS DOUBLE)) AS m, stddev_pop(CAST(o_custkey AS DOUBLE)) AS sd FROM k),
pairs AS (SELECT a.o_orderkey AS id, b.o_orderkey AS other, b.o_orderpriority AS y, sqrt(((a.o_custkey - b.o_custkey) / sd) * ((a.o_custkey - b.o_custkey) / sd)) AS dist
  FROM s a, k b, f WHERE a.o_orderpriority IS NULL)""", """
votes AS (SELECT id, y, count(*) AS n FROM five GROUP BY id, y),
fill AS (SELECT id, arg_min(y, (-n, y)) AS y FROM votes GROUP BY id)
SELECT o_orderkey, coalesce(o_orderpriority, y) AS o_orderpriority FROM s LEFT JOIN fill ON id = o_orderkey"""))
def knn_impute_priority_orders(spark, d):
    """Vote of the five orders with the nearest customer number."""
    df = FX.dirty_orders(spark, d).select("o_orderkey", "o_custkey", "o_orderpriority")
    return I.knn_impute(df, "o_orderkey", "o_orderpriority").select("o_orderkey", "o_orderpriority")


@register("knn_impute_price_orders", "I5,I6,N1", _knn_sql("""
k AS (SELECT * FROM t WHERE o_totalprice IS NOT NULL),
f AS (SELECT avg(CAST(o_custkey AS DOUBLE)) AS m, stddev_pop(CAST(o_custkey AS DOUBLE)) AS sd FROM k),
pairs AS (SELECT a.o_orderkey AS id, b.o_orderkey AS other, b.o_totalprice AS y,
    sqrt(((a.o_custkey - b.o_custkey) / sd) * ((a.o_custkey - b.o_custkey) / sd)
      + CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 1 ELSE 0 END
      + CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 1 ELSE 0 END) AS dist
  FROM s a, k b, f WHERE a.o_totalprice IS NULL)""", """
fill AS (SELECT id, avg(y) AS y FROM five GROUP BY id)
SELECT o_orderkey, round(coalesce(o_totalprice, y), 6) AS o_totalprice FROM s LEFT JOIN fill ON id = o_orderkey"""))
def knn_impute_price_orders(spark, d):
    """Mean price of the five nearest orders by customer number, priority (with gaps) and status."""
    df = FX.dirty_orders(spark, d).drop("o_orderdate")
    return I.knn_impute(df, "o_orderkey", "o_totalprice").select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@register("model_impute_dirty_orders", "I3,I4,I5")
def model_impute_dirty_orders(spark, d):
    """Rows-only: fast model imputation of price (regression) and priority
    (classification) in column order."""
    df = FX.dirty_orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                          "o_orderpriority")
    return I.model_impute(df, "o_orderkey", fast=True)


@register("model_impute_race_dirty_orders", "I3,I6")
def model_impute_race_dirty_orders(spark, d):
    """Rows-only: model race on a holdout split for the price column."""
    df = FX.dirty_orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return I.model_impute(df, "o_orderkey", ["o_totalprice"], fast=False)
