"""Health-check queries (H1-H9) on dirty views and on the real text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.plans import fixtures as FX
from tessera.plans import oracle_profile as OP
from tessera.plans.catalog import register
from tessera.sources.tables import table

DIRTY_ORDERS_COLS = [("o_custkey", "numeric"), ("o_orderstatus", "string"),
                     ("o_totalprice", "numeric"), ("o_orderdate", "string"),
                     ("o_orderpriority", "string")]
TEXT_PRICES_COLS = [("o_custkey", "numeric"), ("price_text", "string")]
MARKED_PART_COLS = [("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
                    ("p_size", "numeric"), ("p_retailprice", "numeric")]
DOCUMENTS_COLS = [("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "numeric")]
PAGES_COLS = [("url", "string"), ("html", "string")]
CUSTOMER_COLS = [("c_name", "string"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"),
                 ("c_mktsegment", "string")]


@register("health_report_dirty_orders", "H1-H5,H8",
          OP.health_report_sql(FX.DIRTY_ORDERS_SQL, "o_orderkey", DIRTY_ORDERS_COLS))
def health_report_dirty_orders(spark, d):
    return P.health_report(FX.dirty_orders(spark, d), "o_orderkey")


@register("health_report_text_prices", "H2,H3,H5,H8",
          OP.health_report_sql(FX.TEXT_PRICES_SQL, "o_orderkey", TEXT_PRICES_COLS))
def health_report_text_prices(spark, d):
    return P.health_report(FX.text_prices(spark, d), "o_orderkey")


@register("health_report_marked_part", "H5,H6,H8",
          OP.health_report_sql(FX.MARKED_TEXT_SQL, "p_partkey", MARKED_PART_COLS))
def health_report_marked_part(spark, d):
    return P.health_report(FX.marked_text(spark, d), "p_partkey")


@register("health_report_documents", "H1-H6,H8",
          OP.health_report_sql("SELECT doc_id, text, lang, source, n_chars FROM documents",
                               "doc_id", DOCUMENTS_COLS))
def health_report_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return P.health_report(docs, "doc_id")


@register("health_report_customer", "H1-H8",
          OP.health_report_sql("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
                               "c_custkey", CUSTOMER_COLS))
def health_report_customer(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                           "c_mktsegment")
    return P.health_report(c, "c_custkey")


@register("issue_counters_dirty_orders", "H7",
          OP.issue_counters_sql(FX.DIRTY_ORDERS_SQL, "o_orderkey", DIRTY_ORDERS_COLS))
def issue_counters_dirty_orders(spark, d):
    return P.issue_counters(FX.dirty_orders(spark, d), "o_orderkey")


@register("issue_counters_text_prices", "H7",
          OP.issue_counters_sql(FX.TEXT_PRICES_SQL, "o_orderkey", TEXT_PRICES_COLS))
def issue_counters_text_prices(spark, d):
    return P.issue_counters(FX.text_prices(spark, d), "o_orderkey")


@register("null_profile_dirty_orders", "H1,A2",
          OP.null_profile_sql(FX.DIRTY_ORDERS_SQL, "o_orderkey", DIRTY_ORDERS_COLS))
def null_profile_dirty_orders(spark, d):
    return P.null_profile(FX.dirty_orders(spark, d), 0.0, "o_orderkey")


@register("missing_report_dirty_orders", "H9,A10,A11",
          OP.missing_report_sql(FX.DIRTY_ORDERS_SQL, "o_orderkey", DIRTY_ORDERS_COLS))
def missing_report_dirty_orders(spark, d):
    return P.missing_report(FX.dirty_orders(spark, d), 20, "o_orderkey")


@register("looks_numeric_dirty_orders", "H2",
          OP.looks_numeric_sql(FX.DIRTY_ORDERS_SQL, "o_orderkey", DIRTY_ORDERS_COLS))
def looks_numeric_dirty_orders(spark, d):
    return P.looks_numeric(FX.dirty_orders(spark, d), "o_orderkey") \
        .select("column_name", "pos", "looks_numeric")


@register("numeric_issues_text_prices", "H3,F1,F2",
          OP.numeric_issues_sql(FX.TEXT_PRICES_SQL, "o_orderkey", TEXT_PRICES_COLS))
def numeric_issues_text_prices(spark, d):
    return P.numeric_issues(FX.text_prices(spark, d), "o_orderkey") \
        .select("column_name", "pos", "issue", "issue_count", "first_id", "example_value",
                "example_fix")


@register("majority_dirty_orders", "H4,A3",
          OP.majority_sql(FX.DIRTY_ORDERS_SQL, "o_orderkey", DIRTY_ORDERS_COLS))
def majority_dirty_orders(spark, d):
    return P.majority_value(FX.dirty_orders(spark, d), 70.0, "o_orderkey") \
        .select("column_name", "pos", "value", "cnt", "n_rows", "pct", "issue")


@register("cardinality_customer", "H5,A4",
          OP.cardinality_sql("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
                             "c_custkey", CUSTOMER_COLS))
def cardinality_customer(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                           "c_mktsegment")
    return P.cardinality(c, 5, "c_custkey")


@register("char_issues_pages", "H6,F1",
          OP.char_issues_sql("SELECT page_id, url, html FROM pages", "page_id", PAGES_COLS))
def char_issues_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    return P.char_issues(pages, "page_id").select(
        "column_name", "pos", "ch", "occurrences", "first_id", "issue", "replacement", "first_pos")


@register("char_issues_marked_part", "H6",
          OP.char_issues_sql(FX.MARKED_TEXT_SQL, "p_partkey", MARKED_PART_COLS, report_apostrophe=True))
def char_issues_marked_part(spark, d):
    return P.char_issues(FX.marked_text(spark, d), "p_partkey", report_apostrophe=True).select(
        "column_name", "pos", "ch", "occurrences", "first_id", "issue", "replacement", "first_pos")
