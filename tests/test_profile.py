"""Semantics of the health check and fixes on literal frames: thresholds at
their boundaries, the ordered number rules, character rules and divergences
from the reference that are deliberate."""

from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.operators import clean as C
from tessera.operators import profile as P
from tessera.sources import io as IO


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_null_threshold_is_strict(spark):
    df = _frame(spark, [(1, None), (2, 1.0), (3, 2.0), (4, 3.0)], "id long, a double")
    at = P.null_profile(df, 25.0, "id").collect()[0]
    assert at.null_count == 1 and at.issue is False
    below = P.null_profile(df, 24.9, "id").collect()[0]
    assert below.issue is True


def test_majority_threshold_inclusive_and_ties(spark):
    rows = [(i, "a" if i < 7 else "b") for i in range(10)]
    df = _frame(spark, rows, "id long, c string")
    r = P.majority_value(df, 70.0, "id").collect()[0]
    assert (r.value, r.cnt, r.issue) == ("a", 7, True)
    assert r.example == "'a' appears in 70.0% of rows"
    tie = _frame(spark, [(1, "y"), (2, "x"), (3, "y"), (4, "x")], "id long, c string")
    assert P.majority_value(tie, 70.0, "id").collect()[0].value == "x"


def test_cardinality_counts_null_as_value(spark):
    rows = [(i, v) for i, v in enumerate(["a", "b", "c", "d", None])]
    df = _frame(spark, rows, "id long, c string")
    r = P.cardinality(df, 5, "id").collect()[0]
    assert (r.n_distinct, r.issue) == (5, False)
    r4 = P.cardinality(df, 4, "id").collect()[0]
    assert r4.issue is True


def test_numeric_rules(spark):
    cases = ["12", " 12 ", "1d", "1_000", "1,5", "1.234,56", "1,234.56", "−5", "2024-01-01", "abc", "inf"]
    df = _frame(spark, list(enumerate(cases)), "id long, s string")
    issue, fix = N.numeric_issue(F.col("s"))
    got = {r.s: (r.i, r.f) for r in df.select("s", issue.alias("i"), fix.alias("f")).collect()}
    assert got["12"] == (None, None)
    assert got[" 12 "] == (None, None)
    assert got["inf"] == (None, None)
    assert got["1d"][0] == N.ISSUE_NOT_NUMBER            # Spark alone would cast it
    assert got["1_000"][0] == N.ISSUE_NOT_NUMBER         # Python alone would accept it
    assert got["1,5"] == (N.ISSUE_COMMA_DECIMAL, "1.5")
    assert got["1.234,56"] == (N.ISSUE_EUROPEAN, "1234.56")
    assert got["1,234.56"] == (N.ISSUE_EUROPEAN, "1.23456")  # US format is classed European
    assert got["−5"] == (N.ISSUE_UNICODE_MINUS, "-5")
    assert got["2024-01-01"][0] == N.ISSUE_NOT_NUMBER


def test_dates_look_numeric(spark):
    df = _frame(spark, [(1, "2024-01-01"), (2, "2024-02-03"), (3, "x")], "id long, d string")
    r = P.looks_numeric(df, "id").collect()[0]
    assert r.looks_numeric is True and r.all_parse is False


def test_char_issues_rules(spark):
    rows = [(1, "a“b”"), (2, 'quote " only'), (3, "åäö ok"), (4, "naïve – dash"), (5, "it's")]
    df = _frame(spark, rows, "id long, t string")
    got = {r.ch: r for r in P.char_issues(df, "id").collect()}
    assert set(got) == {"“", "”", "ï", "–"}               # no ASCII quote, no åäö, no apostrophe
    assert got["–"].replacement == "-" and got["ï"].issue == "Unicode character (U+00EF)"
    assert got["“"].first_id == 1 and got["“"].example == "'a“b”' ('“' → '\"')"
    with_apos = {r.ch for r in P.char_issues(df, "id", report_apostrophe=True).collect()}
    assert "'" in with_apos


def test_report_lines_and_no_issue(spark):
    rows = [(i, float(i), "v" if i % 2 else None) for i in range(10)]
    df = _frame(spark, rows, "id long, x double, s string")
    rep = {r.column_name: r for r in P.health_report(df, "id").collect()}
    assert rep["x"].errors_found == "- No issues found" and rep["x"].severity == "Ok"
    assert rep["s"].errors_found == "- Contains NaN values (%): 50"
    cnt = {r.category: r.n_columns for r in P.issue_counters(df, "id").collect()}
    assert cnt["NaN"] == 1 and cnt["No Issue"] == 1 and cnt["Comma"] == 0


def test_fix_decimals(spark):
    cases = ["1,5", "1.234,56", "1,234,567", '"3,25"', "abc", None, "7"]
    df = _frame(spark, list(enumerate(cases)), "id long, s string")
    got = [r.s for r in C.fix_decimals(df, ["s"]).orderBy("id").collect()]
    assert got == [1.5, None, None, 3.25, None, None, 7.0]


def test_fix_unicode(spark):
    df = _frame(spark, [(1, "a–b—c‐d−e “q” ‘s’ x…y\xa0z it's")], "id long, s string")
    assert C.fix_unicode(df, ["s"]).first().s == 'a-b-c-d-e "q" \'s\' xy z its'
    assert C.fix_unicode(df, ["s"], drop_apostrophe=False).first().s.endswith("it's")


def test_infer_types(spark):
    df = _frame(spark, [("1", "1.5", "True", "a", None), ("2", None, "False", "3", None)],
                "a string, b string, c string, d string, e string")
    kinds = IO.inferred_types(df)
    assert kinds == {"a": "long", "b": "double", "c": "boolean", "d": "string", "e": "double"}


def test_clean_headers(spark):
    df = _frame(spark, [(1, 2)], "_c0 long, `Unnamed: 3` long")
    assert IO.clean_headers(df).columns == ["Column_0", "Column_3"]


def test_missing_report_label(spark):
    rows = [(i, None if i < 5 else 1.0, None if i < 4 else 1.0) for i in range(10)]
    df = _frame(spark, rows, "id long, a double, b double")
    got = [(r.column_name, r.missing_pct, r.condition) for r in P.missing_report(df, 20, "id").collect()]
    assert got == [("a", 50.0, "Above 40%"), ("b", 40.0, "40% or Below")]
