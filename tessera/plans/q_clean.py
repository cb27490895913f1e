"""Source/sink, type inference, cleaning and label queries (S1-S5, C1-C4,
F1-F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as TX
from tessera.functions.scale import log_scale, shorten_labels
from tessera.operators import clean as C
from tessera.operators import profile as P
from tessera.plans import fixtures as FX
from tessera.plans import oracle_profile as OP
from tessera.plans.catalog import register
from tessera.session import scratch_path
from tessera.sources import io as IO
from tessera.sources.tables import table

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]


@register("infer_types_lineitem", "S2,F2", """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate
FROM lineitem""")
def infer_types_lineitem(spark, d):
    li = table(spark, d, "lineitem")
    as_text = li.select(*[F.col(c).cast("string").alias(c) for c in LINEITEM_COLS])
    return IO.infer_types(as_text)


@register("csv_roundtrip_dirty_orders", "S1,S3,S4,S5", f"""
SELECT o_orderkey, o_custkey AS Column_1, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {FX.view(FX.DIRTY_ORDERS_SQL)}""")
def csv_roundtrip_dirty_orders(spark, d):
    """Write the dirty view as ``;``-separated text with a ``--`` null token
    and a blank-style header, convert it to ``,``, read and type it back."""
    src = FX.dirty_orders(spark, d).withColumnRenamed("o_custkey", "_c1")
    semi = scratch_path(spark, "dirty_orders_semicolon")
    comma = scratch_path(spark, "dirty_orders_comma")
    IO.write_table(src, semi, "csv", ";", null_value="--")
    IO.convert_delimiter(spark, semi, comma, ";", null_values=["--"])
    return IO.read_table(spark, comma, ",")


@register("csv_roundtrip_documents", "S1,S3", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip_documents(spark, d):
    """Whole texts with quotes, line breaks and blanks through CSV and back."""
    path = scratch_path(spark, "documents_csv")
    IO.write_table(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    back = IO.read_table(spark, path, infer=False, keep_default_na=False)
    return IO.infer_types(back, ["doc_id", "n_chars"]).withColumn("text", F.coalesce("text", F.lit("")))


@register("infer_types_long_integers", "S2", """
SELECT o_orderkey, '9' || lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS big, CAST(o_custkey AS BIGINT) AS small FROM orders""")
def infer_types_long_integers(spark, d):
    """20-digit integers keep every digit (decimal), short ones become long."""
    t = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("9"), F.lpad(F.col("o_orderkey").cast("string"), 19, "0")).alias("big"),
                                         F.col("o_custkey").cast("string").alias("small"))
    out = IO.infer_types(t)
    assert dict(out.dtypes)["big"] == "decimal(38,0)"
    return out.withColumn("big", F.col("big").cast("string"))


def _fix_decimal_sql(x: str) -> str:
    # RE2 has no look-arounds: two passes of (\d),(\d) reach every comma
    once = f"regexp_replace({x}, '(\\d),(\\d)', '\\1.\\2', 'g')"
    twice = f"regexp_replace({once}, '(\\d),(\\d)', '\\1.\\2', 'g')"
    s = OP.strip_sql(f"replace({twice}, '\"', '')")
    return f"CASE WHEN {OP.parses_sql(s)} THEN TRY_CAST({s} AS DOUBLE) END"


@register("fix_decimals_text_prices", "C1,F1,F2",
          f"SELECT o_orderkey, {_fix_decimal_sql('price_text')} AS price_text "
          f"FROM {FX.view(FX.TEXT_PRICES_SQL)}")
def fix_decimals_text_prices(spark, d):
    return C.fix_decimals(FX.text_prices(spark, d), ["price_text"]).select("o_orderkey", "price_text")


_SRC, _DST = TX.translate_args(True)


@register("fix_unicode_marked_part", "C2,F1",
          f"SELECT p_partkey, translate(p_name, {OP.q(_SRC)}, {OP.q(_DST)}) AS p_name "
          f"FROM {FX.view(FX.MARKED_TEXT_SQL)}")
def fix_unicode_marked_part(spark, d):
    return C.fix_unicode(FX.marked_text(spark, d), ["p_name"]).select("p_partkey", "p_name")


@register("fill_null_dirty_orders", "C3,S2", f"""
SELECT o_orderkey, coalesce(o_totalprice, 0.0::DOUBLE) AS o_totalprice,
       coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority
FROM {FX.view(FX.DIRTY_ORDERS_SQL)}""")
def fill_null_dirty_orders(spark, d):
    df = FX.dirty_orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return C.fill_null(C.fill_null(df, "o_totalprice", "0"), "o_orderpriority", "UNKNOWN")


_FIXED_PRICES_SQL = (f"SELECT o_orderkey, o_custkey, {_fix_decimal_sql('price_text')} AS price_text "
                     f"FROM {FX.view(FX.TEXT_PRICES_SQL)}")


@register("apply_fixes_text_prices", "C4,H8",
          OP.health_report_sql(_FIXED_PRICES_SQL, "o_orderkey",
                               [("o_custkey", "numeric"), ("price_text", "numeric")]))
def apply_fixes_text_prices(spark, d):
    _, report = C.apply_fixes(FX.text_prices(spark, d), C.FixPlan(decimals=["price_text"]), "o_orderkey")
    return report


@register("apply_fixes_dirty_orders", "C4,P1,H8",
          OP.health_report_sql(
              f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, "
              f"coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority FROM {FX.view(FX.DIRTY_ORDERS_SQL)}",
              "o_orderkey", [("o_custkey", "numeric"), ("o_totalprice", "numeric"),
                             ("o_orderdate", "string"), ("o_orderpriority", "string")]))
def apply_fixes_dirty_orders(spark, d):
    plan = C.FixPlan(drop=["o_orderstatus", "not_a_column"], fill={"o_orderpriority": "UNKNOWN"})
    _, report = C.apply_fixes(FX.dirty_orders(spark, d), plan, "o_orderkey")
    return report


def _shorten_sql(x: str, n: int = 15) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


@register("shorten_labels_part", "F4", f"""
SELECT p_partkey, CASE WHEN k = 1 THEN cut ELSE cut || '(' || CAST(k AS VARCHAR) || ')' END AS short_label
FROM (SELECT p_partkey, cut, row_number() OVER (PARTITION BY cut ORDER BY p_partkey) AS k
      FROM (SELECT p_partkey, {_shorten_sql('p_name')} AS cut FROM part))""")
def shorten_labels_part(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return shorten_labels(p, "p_name", "p_partkey").select("p_partkey", "short_label")


@register("log_scale_events", "F3,F6,A5", """
SELECT event_id, round(1.0::DOUBLE + 6.0::DOUBLE * (ln(1 + ((value - mn) + 1e-9::DOUBLE)) - ln(1 + 1e-9::DOUBLE))
       / nullif(ln(1 + ((mx - mn) + 1e-9::DOUBLE)) - ln(1 + 1e-9::DOUBLE), 0), 9) AS size
FROM events, (SELECT min(value) AS mn, max(value) AS mx FROM events)""")
def log_scale_events(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return log_scale(e, "value", "size").select("event_id", F.round("size", 9).alias("size"))


@register("pct_format_orders", "F5", """
SELECT o_orderstatus, count(*) AS n,
       round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 2) AS pct
FROM orders GROUP BY o_orderstatus""")
def pct_format_orders(spark, d):
    o = table(spark, d, "orders")
    total = o.count()
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")) \
        .select("o_orderstatus", "n", F.round(F.col("n") * 100.0 / F.lit(total), 2).alias("pct"))


@register("to_number_cases_events", "F2,F1", f"""
SELECT event_id, CASE WHEN {OP.parses_sql(OP.strip_sql("t"))} THEN TRY_CAST({OP.strip_sql("t")} AS DOUBLE) END AS num
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || CAST(user_id AS VARCHAR) || ' '
                                        WHEN 1 THEN CAST(user_id AS VARCHAR) || 'd'
                                        WHEN 2 THEN '1_' || CAST(user_id AS VARCHAR)
                                        WHEN 3 THEN '-' || CAST(user_id AS VARCHAR) || 'e2'
                                        ELSE event_type END AS t FROM events)""")
def to_number_cases_events(spark, d):
    """Guarded parse of trimmed numbers, ``12d`` (Spark would accept it),
    ``1_12`` (Python would accept it), exponents and words."""
    e = table(spark, d, "events")
    uid = F.col("user_id").cast("string")
    k = F.col("event_id") % 5
    t = (F.when(k == 0, F.concat(F.lit(" "), uid, F.lit(" ")))
         .when(k == 1, F.concat(uid, F.lit("d")))
         .when(k == 2, F.concat(F.lit("1_"), uid))
         .when(k == 3, F.concat(F.lit("-"), uid, F.lit("e2")))
         .otherwise(F.col("event_type")))
    return e.select("event_id", N.to_number(t).alias("num"))
