"""Projection, filter and keyed-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.operators import select as S
from tessera.plans import fixtures as FX
from tessera.plans import oracle_profile as OP
from tessera.plans.catalog import register
from tessera.sources.tables import table


@register("select_features_lineitem", "P1,P2,P4,A8", """
SELECT l_discount, l_extendedprice, l_linenumber, l_quantity, l_tax FROM lineitem""")
def select_features_lineitem(spark, d):
    li = table(spark, d, "lineitem").drop("l_shipdate", "l_returnflag", "l_linestatus")
    li = S.drop_columns(li, ["l_orderkey", "l_partkey", "l_suppkey", "absent_column"])
    target = S.default_target(li)                       # last column: l_tax
    feats = S.feature_columns(li, [target])
    return S.select_features(li, feats, target=target)


@register("filter_ids_lineitem_urgent", "P6,J3", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def filter_ids_lineitem_urgent(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    ids = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT") \
        .select(F.col("o_orderkey").alias("l_orderkey"))
    return S.filter_ids(li, ids, "l_orderkey")


@register("drop_rows_orders_expensive", "P7,J4", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)""")
def drop_rows_orders_expensive(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return S.drop_rows(o, o.where(F.col("o_totalprice") > 400000), "o_orderkey")


@register("drop_null_rows_dirty_orders", "P8", f"""
SELECT * FROM {FX.view(FX.DIRTY_ORDERS_SQL)}
WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""")
def drop_null_rows_dirty_orders(spark, d):
    return S.drop_null_rows(FX.dirty_orders(spark, d))


POLYGON = [(0.1, 0.1), (0.6, 0.2), (0.5, 0.8), (0.2, 0.6)]


def _lit(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _polygon_sql(x: str, y: str, verts) -> str:
    terms = []
    n = len(verts)
    for i in range(n):
        (xi, yi), (xj, yj) = verts[i], verts[(i - 1) % n]
        if yi == yj:
            continue
        terms.append(f"CASE WHEN (({_lit(yi)} > {y}) <> ({_lit(yj)} > {y})) AND "
                     f"({x} < {_lit(xj - xi)} * ({y} - {_lit(yi)}) / {_lit(yj - yi)} + {_lit(xi)}) "
                     f"THEN 1 ELSE 0 END")
    return "((" + " + ".join(terms) + ") % 2 = 1)"


def blobs2d(spark, d):
    """2-D points over ALL events: x = min-max of value, y = min-max of
    hour + user_id % 5 (scalars from one aggregate)."""
    e = table(spark, d, "events")
    raw_y = (F.hour("ts") + F.col("user_id") % 5).cast("double")
    r = e.agg(F.min("value").alias("a"), F.max("value").alias("b"),
              F.min(raw_y).alias("c"), F.max(raw_y).alias("e")).first()
    x = (F.col("value") - F.lit(r["a"])) / F.lit(r["b"] - r["a"])
    y = (raw_y - F.lit(r["c"])) / F.lit(r["e"] - r["c"])
    return e.select("event_id", x.alias("x"), y.alias("y"))


BLOBS2D_SQL = """
SELECT event_id, (value - a) / (b - a) AS x, (CAST(hour(ts) + user_id % 5 AS DOUBLE) - c) / (e - c) AS y
FROM events, (SELECT min(value) AS a, max(value) AS b,
                     min(CAST(hour(ts) + user_id % 5 AS DOUBLE)) AS c,
                     max(CAST(hour(ts) + user_id % 5 AS DOUBLE)) AS e FROM events)"""


@register("range_select_events", "P9", f"""
SELECT event_id FROM ({BLOBS2D_SQL}) WHERE {_polygon_sql('x', 'y', POLYGON)}
  AND x BETWEEN 0.0 AND 0.9 AND y BETWEEN 0.0 AND 1.0""")
def range_select_events(spark, d):
    pts = blobs2d(spark, d)
    return S.range_select(pts, "event_id", "x", "y", box=((0.0, 0.9), (0.0, 1.0)), polygon=POLYGON)


@register("filter_report_dirty_orders", "P5,H8",
          "SELECT * FROM (" + OP.health_report_sql(FX.DIRTY_ORDERS_SQL, "o_orderkey",
                                                     [("o_custkey", "numeric"), ("o_orderstatus", "string"),
                                                      ("o_totalprice", "numeric"), ("o_orderdate", "string"),
                                                      ("o_orderpriority", "string")])
          + ") WHERE contains(lower(errors_found), 'nan')")
def filter_report_dirty_orders(spark, d):
    return S.filter_report(P.health_report(FX.dirty_orders(spark, d), "o_orderkey"), "NaN")
