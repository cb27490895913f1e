"""Health check (H1-H9): null share, numeric-looking text and its parse
issues, majority value, cardinality, odd characters, per-column report,
issue counters and the missing-value report.

Shape of every plan: a single wide aggregate for per-column counts, and one
unpivot (`long_values`) followed by group-bys keyed by ``column_name`` for
anything per value. Hot values are combined map-side by partial aggregation,
so a value holding a third of the rows never lands whole in one task. Only
O(columns) rows are broadcast (the per-column flag frames)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as TX
from tessera.functions.frame import (columns_of_kind, is_missing, kind_of, long_values,
                                     pct_text_sql, position_map, qcol, ratio_round_sql,
                                     stack_row)

# Issue labels, report categories and missing-report labels.
ISSUE_NAN = "Contains NaN values (%)"
ISSUE_MAJORITY = "Value majority (%)"
ISSUE_CARDINALITY = "Large amount of unique categorical variables"
NO_ISSUES = "No issues found"
CATEGORIES = ["Comma", "Unicode", "Numeric", "NaN", "Majority", "Categorical", "No Issue"]
SEVERITY = {"Comma": "Critical", "Unicode": "Critical", "Numeric": "Potential",
            "NaN": "Potential", "Majority": "Potential", "Categorical": "Potential",
            "No Issue": "Ok"}
MISSING_ABOVE = "Above 40%"
MISSING_BELOW = "40% or Below"


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the health check: null% 0, repetition% 70, categorical 5."""
    nan: float = 0.0
    rep: float = 70.0
    cat: int = 5


def _profiled(df: DataFrame, id_col: str | None) -> list[str]:
    return [c for c in df.columns if c != id_col]


# ---------------------------------------------------------------- H1
def null_profile(df: DataFrame, nan_thresh: float = 0.0, id_col: str | None = None) -> DataFrame:
    """H1: (column_name, pos, n_rows, null_count, null_pct, issue) in one pass.
    Issue iff null% is strictly above the threshold."""
    cols = _profiled(df, id_col)
    row = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count_if(is_missing(df, c)).alias(f"_z{i}") for i, c in enumerate(cols)])
    out = stack_row(row, [(c, i, {"null_count": F.col(f"_z{i}")}) for i, c in enumerate(cols)],
                    keep=["n_rows"])
    pct = (F.col("null_count") / F.col("n_rows")) * 100
    return out.select("column_name", "pos", "n_rows", "null_count", pct.alias("null_pct"),
                      (pct > F.lit(float(nan_thresh))).alias("issue"))


# ---------------------------------------------------------------- H2
def looks_numeric(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """H2: (column_name, pos, all_parse, digit_share, looks_numeric).

    Numeric and boolean columns always look numeric. A text column does when
    every non-null value parses, or when more than half of the non-null
    values are digits after removing ``-``/``.`` and turning ``,`` to ``.``."""
    cols = _profiled(df, id_col)
    aggs = []
    for i, c in enumerate(cols):
        k = kind_of(df.schema[c].dataType)
        if k == "string":
            v = qcol(c)
            aggs += [F.count(v).alias(f"_nn{i}"),
                     F.count_if(v.isNotNull() & ~N.parses(N.strip(v))).alias(f"_bad{i}"),
                     F.count_if(N.digit_like(v)).alias(f"_dig{i}")]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    items = []
    for i, c in enumerate(cols):
        k = kind_of(df.schema[c].dataType)
        if k == "string":
            nn, bad, dig = F.col(f"_nn{i}"), F.col(f"_bad{i}"), F.col(f"_dig{i}")
            share = F.when(nn > 0, dig / nn)
            items.append((c, i, {"all_parse": bad == 0,
                                 "digit_share": share,
                                 "looks_numeric": (bad == 0) | F.coalesce(share > 0.5, F.lit(False))}))
        else:
            numeric = k in ("numeric", "boolean")
            items.append((c, i, {"all_parse": F.lit(numeric),
                                 "digit_share": F.lit(None).cast("double"),
                                 "looks_numeric": F.lit(numeric)}))
    return stack_row(row, items)


# ---------------------------------------------------------------- shared
def value_stats(df: DataFrame, id_col: str | None, cols: list[str] | None = None) -> DataFrame:
    """(column_name, pos, value, cnt, first_id): every distinct value of every
    profiled column with its row count and lowest row id; NULL (and NaN) is
    one value. One scan and one shuffle, combined map-side, so a value that
    holds a third of all rows is pre-summed in every map task. H1-H6 all
    derive from this frame (the report persists it, as its branches filter it
    differently), and rules that test text run once per distinct value."""
    prof = _profiled(df, id_col)
    cols = cols if cols is not None else prof
    clean = df.select(*([qcol(id_col)] if id_col else []),
                      *[F.when(~is_missing(df, c), qcol(c)).alias(c) for c in cols])
    longf = long_values(clean, cols, id_col, prof)
    aggs = [F.count(F.lit(1)).alias("cnt")]
    aggs.append(F.min(qcol(id_col)).cast("long").alias("first_id") if id_col
                else F.lit(None).cast("long").alias("first_id"))
    return longf.groupBy("column_name", "pos", "value").agg(*aggs)


def _text_filter(df: DataFrame, id_col: str | None):
    return F.col("column_name").isin([c for c in columns_of_kind(df, "string") if c != id_col])


def _looks_from(vs: DataFrame, df: DataFrame, id_col: str | None) -> DataFrame:
    cnt, v = F.col("cnt"), F.col("value")
    text = vs.where(_text_filter(df, id_col)).groupBy("column_name", "pos").agg(
        F.sum(F.when(v.isNotNull(), cnt).otherwise(0)).alias("nn"),
        F.sum(F.when(v.isNotNull() & ~N.parses(N.strip(v)), cnt).otherwise(0)).alias("bad"),
        F.sum(F.when(N.digit_like(v), cnt).otherwise(0)).alias("dig"))
    share = F.when(F.col("nn") > 0, F.col("dig") / F.col("nn"))
    return text.select("column_name", "pos", (F.col("bad") == 0).alias("all_parse"),
                       share.alias("digit_share"),
                       ((F.col("bad") == 0) | F.coalesce(share > 0.5, F.lit(False))).alias("looks_numeric"))


def _numeric_issues_from(vs: DataFrame, looks: DataFrame) -> DataFrame:
    flags = looks.where("looks_numeric").select("column_name")
    issue, fix = N.numeric_issue(F.col("value"))
    # per distinct value, weighted by its count; flags has O(columns) rows
    tagged = vs.join(F.broadcast(flags), "column_name").select(
        "column_name", "pos", "value", "cnt", "first_id", issue.alias("issue"), fix.alias("fix")) \
        .where(F.col("issue").isNotNull())
    agg = tagged.groupBy("column_name", "pos", "issue").agg(
        F.sum("cnt").alias("issue_count"),
        F.min(F.struct(F.col("first_id"), F.col("value"), F.col("fix"))).alias("_first"))
    return agg.select(
        "column_name", "pos", "issue", "issue_count",
        F.col("_first.first_id").alias("first_id"),
        F.col("_first.value").alias("example_value"),
        F.col("_first.fix").alias("example_fix"),
        F.format_string("'%s' → '%s'", F.col("_first.value"),
                        F.coalesce(F.col("_first.fix"), F.lit("None"))).alias("example"))


def _nulls_from(vs: DataFrame) -> DataFrame:
    return vs.groupBy("column_name", "pos").agg(
        F.sum("cnt").cast("long").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("cnt")).otherwise(0)).cast("long").alias("null_count"))


def _majority_from(vs: DataFrame, rep_thresh: float) -> DataFrame:
    top = vs.groupBy("column_name", "pos").agg(
        F.sum("cnt").alias("n_rows"),
        F.min(F.when(F.col("value").isNotNull(),
                     F.struct((-F.col("cnt")).alias("neg"), F.col("value")))).alias("_t"))
    pct = (F.col("cnt") / F.col("n_rows")) * 100
    out = top.where(F.col("_t").isNotNull()).select(
        "column_name", "pos", F.col("_t.value").alias("value"),
        (-F.col("_t.neg")).alias("cnt"), F.col("n_rows").cast("long").alias("n_rows"))
    return out.select(
        "column_name", "pos", "value", "cnt", "n_rows", pct.alias("pct"),
        (pct >= F.lit(float(rep_thresh))).alias("issue"),
        F.format_string("'%s' appears in %s%% of rows", F.col("value"),
                        F.expr(pct_text_sql("cnt", "n_rows", True))).alias("example"))


def _cardinality_from(vs: DataFrame, df: DataFrame, id_col: str | None, cat_thresh: int) -> DataFrame:
    out = vs.where(_text_filter(df, id_col)).groupBy("column_name", "pos") \
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    return out.select("column_name", "pos", "n_distinct",
                      (F.col("n_distinct") > F.lit(cat_thresh)).alias("issue"))


def _char_issues_from(vs: DataFrame, report_apostrophe: bool) -> DataFrame:
    """Explode (column, first_id, cnt, character) only -- never the text --
    and fetch the example text back from the distinct-value frame by
    (column, first_id), so a long document is not copied per character."""
    pattern = TX.NON_ASCII_OR_APOSTROPHE_PATTERN if report_apostrophe else TX.NON_ASCII_PATTERN
    key = F.xxhash64("value").alias("value_key")
    chars = vs.select("column_name", "pos", "first_id", "cnt", key,
                      F.explode(F.regexp_extract_all(F.col("value"), F.lit(pattern), 0)).alias("ch")) \
        .where(~F.col("ch").isin(list(TX.ALLOWED_LETTERS)))
    agg = chars.groupBy("column_name", "pos", "ch").agg(
        F.sum("cnt").alias("occurrences"), F.min(F.struct("first_id", "value_key")).alias("first")) \
        .select("column_name", "pos", "ch", "occurrences", "first.first_id", "first.value_key")
    # by the value's hash too: an id may be repeated, so that two values share a lowest id
    joined = agg.join(vs.select("column_name", "first_id", "value", key), ["column_name", "first_id", "value_key"])
    mark_label = F.create_map(*[x for c, _, lab in TX.MARKS for x in (F.lit(c), F.lit(lab))])
    mark_repl = F.create_map(*[x for c, r, _ in TX.MARKS for x in (F.lit(c), F.lit(r))])
    label = F.coalesce(F.element_at(mark_label, F.col("ch")),
                       F.concat(F.lit("Unicode character ("), TX.code_point_label(F.col("ch")), F.lit(")")))
    repl = F.element_at(mark_repl, F.col("ch"))
    example = F.when(F.coalesce(repl, F.lit("")) != "",
                     F.format_string("'%s' ('%s' → '%s')", F.col("value"), F.col("ch"), repl)) \
        .otherwise(F.format_string("'%s' (character: '%s')", F.col("value"), F.col("ch")))
    return joined.select(
        "column_name", "pos", "ch", F.col("occurrences").cast("long").alias("occurrences"),
        "first_id", label.alias("issue"), repl.alias("replacement"), example.alias("example"),
        repl.isNotNull().alias("is_mark"), F.instr(F.col("value"), F.col("ch")).cast("long").alias("first_pos"))


# ---------------------------------------------------------------- H3
def numeric_issues(df: DataFrame, id_col: str) -> DataFrame:
    """H3: per numeric-looking text column and issue: count, first example
    (lowest id), its suggested fix, and the text ``'value' → 'fix'``."""
    text_cols = [c for c in columns_of_kind(df, "string") if c != id_col]
    vs = value_stats(df, id_col, text_cols)
    return _numeric_issues_from(vs, _looks_from(vs, df, id_col))


# ---------------------------------------------------------------- H4 / H5
def value_counts(df: DataFrame, cols: list[str], positions: list[str] | None = None) -> DataFrame:
    """A3: (column_name, pos, value, cnt) for every column, NULL included as
    its own value. One unpivot + one aggregate (map-side combined)."""
    return long_values(df, cols, None, positions).groupBy("column_name", "pos", "value") \
        .agg(F.count(F.lit(1)).alias("cnt"))


def majority_value(df: DataFrame, rep_thresh: float = 70.0, id_col: str | None = None) -> DataFrame:
    """H4: top non-null value per column (ties -> smallest text), its share
    of ALL rows, issue iff share >= threshold."""
    return _majority_from(value_stats(df, id_col), rep_thresh)


def cardinality(df: DataFrame, cat_thresh: int = 5, id_col: str | None = None) -> DataFrame:
    """H5: distinct values of each text column, NULL counted as a value;
    issue iff the count is above the threshold."""
    text_cols = [c for c in columns_of_kind(df, "string") if c != id_col]
    vs = value_stats(df.drop(id_col) if id_col else df, None, text_cols)
    return _cardinality_from(vs, df, id_col, cat_thresh)


# ---------------------------------------------------------------- H6
def char_issues(df: DataFrame, id_col: str, cols: list[str] | None = None,
                report_apostrophe: bool = False) -> DataFrame:
    """H6: per text column and odd character: occurrences, first value
    holding it (lowest id), replacement and label. Characters: the listed
    marks plus any non-ASCII character outside ``åäöÅÄÖ``; the ASCII
    apostrophe only on request; the ASCII double quote never."""
    cols = cols if cols is not None else [c for c in columns_of_kind(df, "string") if c != id_col]
    return _char_issues_from(value_stats(df, id_col, cols), report_apostrophe)


# ---------------------------------------------------------------- H7 / H8
_ISSUE_COLS = ["column_name", "pos", "stage", "k1", "k2", "k3", "issue", "count_text",
               "example", "category"]


def issue_rows(df: DataFrame, id_col: str, thresholds: Thresholds = Thresholds(),
               report_apostrophe: bool = False) -> DataFrame:
    """All issues as rows: (column_name, pos, stage, k1, k2, k3, issue,
    count_text, example, category). (stage, k1, k2, k3) orders the issues
    of one column the way the report lists them. Every branch reads the
    same distinct-value frame."""
    # persisted: each branch below filters it differently, which defeats
    # exchange reuse, so without it every branch would rescan the source
    vs = value_stats(df, id_col).persist(StorageLevel.MEMORY_AND_DISK)
    zero = F.lit(0)
    nulls = _nulls_from(vs)
    null_p = nulls.where((F.col("null_count") / F.col("n_rows")) * 100 > F.lit(float(thresholds.nan))).select(
        "column_name", "pos", zero.alias("stage"), zero.cast("long").alias("k1"),
        zero.alias("k2"), zero.alias("k3"), F.lit(ISSUE_NAN).alias("issue"),
        F.expr(pct_text_sql("null_count", "n_rows", False)).alias("count_text"),
        F.lit(None).cast("string").alias("example"), F.lit("NaN").alias("category"))
    num = _numeric_issues_from(vs, _looks_from(vs, df, id_col)).select(
        "column_name", "pos", F.lit(1).alias("stage"), F.col("first_id").alias("k1"),
        zero.alias("k2"), zero.alias("k3"), "issue",
        F.col("issue_count").cast("string").alias("count_text"), "example",
        F.when(F.lower(F.col("issue")).contains("comma"), F.lit("Comma"))
        .otherwise(F.lit("Numeric")).alias("category"))
    maj = _majority_from(vs, thresholds.rep).where("issue").select(
        "column_name", "pos", F.lit(2).alias("stage"), zero.cast("long").alias("k1"),
        zero.alias("k2"), zero.alias("k3"), F.lit(ISSUE_MAJORITY).alias("issue"),
        F.lit("").alias("count_text"), "example", F.lit("Majority").alias("category"))
    card = _cardinality_from(vs, df, id_col, thresholds.cat)
    cat = card.where("issue").select(
        "column_name", "pos", F.lit(3).alias("stage"), zero.cast("long").alias("k1"),
        zero.alias("k2"), zero.alias("k3"), F.lit(ISSUE_CARDINALITY).alias("issue"),
        F.col("n_distinct").cast("string").alias("count_text"),
        F.lit("").alias("example"), F.lit("Categorical").alias("category"))
    # H6 only on text columns that failed the cardinality check; the filter
    # is a join with the O(columns) flag frame, applied before the explode.
    high = vs.join(F.broadcast(card.where("issue").select("column_name")), "column_name")
    chars = _char_issues_from(high, report_apostrophe).select(
        "column_name", "pos", F.lit(4).alias("stage"), F.col("first_id").alias("k1"),
        F.when(F.col("is_mark"), 0).otherwise(1).alias("k2"), F.col("first_pos").alias("k3"),
        "issue", F.col("occurrences").cast("string").alias("count_text"), "example",
        F.lit("Unicode").alias("category"))
    return null_p.unionByName(num).unionByName(maj).unionByName(cat).unionByName(chars)


def _with_placeholders(df: DataFrame, id_col: str, rows: DataFrame) -> DataFrame:
    """Add one stage-9 "No issues found" row per column; consumers drop it
    when the column has real issues (no second evaluation of the plan)."""
    cols = _profiled(df, id_col)
    none = df.sparkSession.createDataFrame(
        [(c, i, 9, 0, 0, 0, NO_ISSUES, None, None, "No Issue") for i, c in enumerate(cols)],
        "column_name string, pos int, stage int, k1 long, k2 int, k3 int, issue string, "
        "count_text string, example string, category string")
    return rows.select(*_ISSUE_COLS).unionByName(none)


def issue_line(issue_col: str = "issue", count_col: str = "count_text",
               example_col: str = "example"):
    """``- Issue: count (example)``; an empty count still prints ``: ``, an
    empty example prints nothing (the reference's formatting)."""
    line = F.concat(F.lit("- "), F.col(issue_col))
    line = F.when(F.col(count_col).isNotNull(), F.concat(line, F.lit(": "), F.col(count_col))) \
        .otherwise(line)
    return F.when(F.coalesce(F.col(example_col), F.lit("")) != "",
                  F.concat(line, F.lit(" ("), F.col(example_col), F.lit(")"))).otherwise(line)


def health_report(df: DataFrame, id_col: str, thresholds: Thresholds = Thresholds(),
                  report_apostrophe: bool = False) -> DataFrame:
    """H8: one row per column: (column_name, pos, severity, errors_found)
    with the issue lines joined by newlines in report order. Issues per
    column are few (bounded by issue kinds and distinct characters)."""
    rows = _with_placeholders(df, id_col, issue_rows(df, id_col, thresholds, report_apostrophe))
    sev = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    rank = F.create_map(F.lit("Critical"), F.lit(0), F.lit("Potential"), F.lit(1), F.lit("Ok"), F.lit(2))
    per = rows.select("column_name", "pos", "stage",
                      F.struct("stage", "k1", "k2", "k3", issue_line().alias("line")).alias("s"),
                      F.element_at(rank, F.element_at(sev, F.col("category"))).alias("sev_rank"))
    out = per.groupBy("column_name", "pos").agg(
        F.array_sort(F.collect_list("s")).alias("_s"), F.min("sev_rank").alias("_r"))
    names = F.create_map(F.lit(0), F.lit("Critical"), F.lit(1), F.lit("Potential"), F.lit(2), F.lit("Ok"))
    # the placeholder sorts last (stage 9); keep it only when it is alone
    kept = F.when(F.size("_s") > 1, F.slice("_s", 1, F.size("_s") - 1)).otherwise(F.col("_s"))
    return out.select("column_name", "pos",
                      F.element_at(names, F.when(F.size("_s") > 1, F.least(F.col("_r"), F.lit(1)))
                                   .otherwise(F.col("_r"))).alias("severity"),
                      F.array_join(F.transform(kept, lambda s: s["line"]), "\n").alias("errors_found"))


def issue_counters(df: DataFrame, id_col: str, thresholds: Thresholds = Thresholds(),
                   report_apostrophe: bool = False) -> DataFrame:
    """H7: (category, n_columns) for the seven categories. Comma/Numeric
    count one per issue kind, the others one per column."""
    rows = _with_placeholders(df, id_col, issue_rows(df, id_col, thresholds, report_apostrophe))
    per_col = rows.groupBy("column_name").agg(
        F.collect_set(F.when(F.col("stage") < 9, F.struct("category", "issue"))).alias("_c"))
    kinds = per_col.select("column_name", F.when(F.size("_c") > 0, F.col("_c")).otherwise(
        F.array(F.struct(F.lit("No Issue").alias("category"), F.lit(NO_ISSUES).alias("issue"))))
        .alias("_c"))
    flat = kinds.select("column_name", F.inline("_c"))
    per_kind = flat.where(F.col("category").isin("Comma", "Numeric"))
    other = flat.where(~F.col("category").isin("Comma", "Numeric")).select("category", "column_name").distinct()
    counts = per_kind.groupBy("category").agg(F.count(F.lit(1)).alias("n_columns")) \
        .unionByName(other.groupBy("category").agg(F.count(F.lit(1)).alias("n_columns")))
    cats = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)],
                                           "category string, cat_pos int")
    return cats.join(F.broadcast(counts), "category", "left").select(
        "category", "cat_pos", F.coalesce(F.col("n_columns"), F.lit(0)).cast("long").alias("n_columns"))


# ---------------------------------------------------------------- H9
def missing_report(df: DataFrame, top_n: int = 20, id_col: str | None = None) -> DataFrame:
    """H9: columns holding nulls: count, percent rounded to 2 places, label
    by percent > 40, largest first, first ``top_n``."""
    prof = null_profile(df, 0.0, id_col).where(F.col("null_count") > 0)
    pct = F.expr(ratio_round_sql("null_count * 100", "n_rows", 2))
    out = prof.select("column_name", "pos", F.col("null_count").alias("missing_count"),
                      pct.alias("missing_pct"))
    out = out.withColumn("condition", F.when(F.col("missing_pct") > 40, F.lit(MISSING_ABOVE))
                         .otherwise(F.lit(MISSING_BELOW)))
    return out.orderBy(F.col("missing_pct").desc(), F.col("pos")).limit(top_n)
