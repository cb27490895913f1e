"""DuckDB oracle SQL for the health check (H1-H9), generated from a source
query and its column kinds. Written independently of the Spark plan: plain
UNION ALL unpivots, GROUP BY and string_agg."""

from __future__ import annotations

from tessera.functions import numbers as N
from tessera.functions import text as TX
from tessera.functions.frame import pct_text_sql, ratio_round_sql
from tessera.operators.profile import (CATEGORIES, ISSUE_CARDINALITY, ISSUE_MAJORITY, ISSUE_NAN,
                                       MISSING_ABOVE, MISSING_BELOW, NO_ISSUES, SEVERITY,
                                       Thresholds)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def strip_sql(v: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in N.WHITESPACE)
    return f"trim({v}, {chars})"


def parses_sql(v: str) -> str:
    return f"regexp_matches({v}, {q(N.NUMBER_PATTERN)})"


def numeric_issue_sql(v: str) -> tuple[str, str]:
    s = strip_sql(v)
    minus_fix = f"replace({s}, '−', '-')"
    euro_fix = f"replace(replace({s}, '.', ''), ',', '.')"
    comma_fix = f"replace({s}, ',', '.')"
    is_minus = f"(contains({s}, '−') AND {parses_sql(minus_fix)})"
    is_euro = f"(contains({s}, ',') AND contains({s}, '.') AND {parses_sql(euro_fix)})"
    is_comma = f"(contains({s}, ',') AND NOT contains({s}, '.') AND {parses_sql(comma_fix)})"
    ok = f"({v} IS NULL OR {parses_sql(s)})"
    issue = (f"CASE WHEN {ok} THEN NULL WHEN {is_minus} THEN {q(N.ISSUE_UNICODE_MINUS)} "
             f"WHEN {is_euro} THEN {q(N.ISSUE_EUROPEAN)} WHEN {is_comma} THEN {q(N.ISSUE_COMMA_DECIMAL)} "
             f"ELSE {q(N.ISSUE_NOT_NUMBER)} END")
    fix = (f"CASE WHEN {ok} THEN NULL WHEN {is_minus} THEN {minus_fix} WHEN {is_euro} THEN {euro_fix} "
           f"WHEN {is_comma} THEN {comma_fix} END")
    return issue, fix


def health_ctes(source_sql: str, id_col: str, cols: list[tuple[str, str]],
                th: Thresholds = Thresholds(), report_apostrophe: bool = False) -> str:
    """CTEs: src, nulls, longv, vc, looks, numiss, major, card, chars, issues."""
    names = [c for c, _ in cols]
    text_cols = [c for c, k in cols if k == "string"]
    num_like = [c for c, k in cols if k in ("numeric", "boolean")]
    nulls = " UNION ALL ".join(
        f"SELECT {q(c)} AS column_name, {i} AS pos, count(*) AS n_rows, "
        f"count(*) FILTER (WHERE {ident(c)} IS NULL"
        + (f" OR isnan({ident(c)})" if k == "numeric_float" else "") + ") AS null_count FROM src"
        for i, (c, k) in enumerate(cols))
    longv = " UNION ALL ".join(
        f"SELECT {ident(id_col)} AS _id, {q(c)} AS column_name, {i} AS pos, "
        f"CAST({ident(c)} AS VARCHAR) AS value FROM src" for i, c in enumerate(names))
    text_in = ", ".join(q(c) for c in text_cols) or "NULL"
    digit = "regexp_matches(replace(replace(replace(value, ',', '.'), '-', ''), '.', ''), '^[0-9]+$')"
    looks_text = (
        f"SELECT column_name, pos, (count(*) FILTER (WHERE value IS NOT NULL AND NOT "
        f"{parses_sql(strip_sql('value'))}) = 0) OR coalesce(CASE WHEN count(value) > 0 THEN "
        f"(count(*) FILTER (WHERE {digit})) / count(value) END > 0.5, false) AS looks_numeric "
        f"FROM longv WHERE column_name IN ({text_in}) GROUP BY column_name, pos")
    looks_other = " UNION ALL ".join(
        f"SELECT {q(c)} AS column_name, {names.index(c)} AS pos, true AS looks_numeric" for c in num_like)
    looks = looks_text + (" UNION ALL " + looks_other if looks_other else "")
    issue, fix = numeric_issue_sql("value")
    pattern = TX.NON_ASCII_OR_APOSTROPHE_PATTERN if report_apostrophe else TX.NON_ASCII_PATTERN
    allowed = ", ".join(q(c) for c in TX.ALLOWED_LETTERS)
    label_case = "CASE ch " + " ".join(f"WHEN {q(c)} THEN {q(lab)}" for c, _, lab in TX.MARKS) + \
        " ELSE 'Unicode character (' || printf('U+%04X', unicode(ch)) || ')' END"
    repl_case = "CASE ch " + " ".join(f"WHEN {q(c)} THEN {q(r)}" for c, r, _ in TX.MARKS) + " END"
    ctes = f"""
src AS ({source_sql}),
nulls AS ({nulls}),
longv AS ({longv}),
vc AS (SELECT column_name, pos, value, count(*) AS cnt FROM longv GROUP BY column_name, pos, value),
looks AS ({looks}),
numtag AS (SELECT l._id, l.column_name, l.pos, l.value, {issue} AS issue, {fix} AS fix
           FROM longv l JOIN looks k ON l.column_name = k.column_name
           WHERE k.looks_numeric AND l.column_name IN ({text_in})),
numiss AS (SELECT column_name, pos, issue, count(*) AS issue_count,
                  min(_id) AS first_id,
                  arg_min(value, _id) AS example_value, arg_min(fix, _id) AS example_fix
           FROM numtag WHERE issue IS NOT NULL GROUP BY column_name, pos, issue),
major AS (SELECT column_name, pos, value, cnt, n_rows, (cnt / n_rows) * 100 AS pct
          FROM (SELECT column_name, pos, sum(cnt) AS n_rows,
                       arg_min(value, (-cnt, value)) FILTER (WHERE value IS NOT NULL) AS value,
                       max(cnt) FILTER (WHERE value IS NOT NULL) AS cnt
                FROM vc GROUP BY column_name, pos) WHERE cnt IS NOT NULL),
card AS (SELECT column_name, pos, count(*) AS n_distinct FROM vc
         WHERE column_name IN ({text_in}) GROUP BY column_name, pos),
chx AS (SELECT _id, column_name, pos, unnest(regexp_extract_all(value, {q(pattern)})) AS ch
        FROM longv WHERE column_name IN (SELECT column_name FROM card WHERE n_distinct > {int(th.cat)})),
chagg AS (SELECT column_name, pos, ch, count(*) AS occurrences, min(_id) AS first_id
          FROM chx WHERE ch NOT IN ({allowed}) GROUP BY column_name, pos, ch),
chars AS (SELECT a.column_name, a.pos, a.ch, a.occurrences, a.first_id, {label_case} AS issue,
                 {repl_case} AS replacement, l.value, ({repl_case}) IS NOT NULL AS is_mark,
                 instr(l.value, a.ch) AS first_pos
          FROM chagg a JOIN longv l ON l.column_name = a.column_name AND l._id = a.first_id),
issues AS (
  SELECT column_name, pos, 0 AS stage, CAST(0 AS BIGINT) AS k1, 0 AS k2, 0 AS k3, {q(ISSUE_NAN)} AS issue,
         {pct_text_sql('null_count', 'n_rows', False)} AS count_text, CAST(NULL AS VARCHAR) AS example,
         'NaN' AS category
  FROM nulls WHERE (null_count / n_rows) * 100 > {float(th.nan)}
  UNION ALL
  SELECT column_name, pos, 1, first_id, 0, 0, issue, CAST(issue_count AS VARCHAR),
         '''' || example_value || ''' → ''' || coalesce(example_fix, 'None') || '''',
         CASE WHEN contains(lower(issue), 'comma') THEN 'Comma' ELSE 'Numeric' END
  FROM numiss
  UNION ALL
  SELECT column_name, pos, 2, 0, 0, 0, {q(ISSUE_MAJORITY)}, '',
         '''' || value || ''' appears in ' || {pct_text_sql('cnt', 'n_rows', True)} || '% of rows',
         'Majority'
  FROM major WHERE pct >= {float(th.rep)}
  UNION ALL
  SELECT column_name, pos, 3, 0, 0, 0, {q(ISSUE_CARDINALITY)}, CAST(n_distinct AS VARCHAR), '', 'Categorical'
  FROM card WHERE n_distinct > {int(th.cat)}
  UNION ALL
  SELECT column_name, pos, 4, first_id, CASE WHEN is_mark THEN 0 ELSE 1 END, first_pos, issue,
         CAST(occurrences AS VARCHAR),
         CASE WHEN coalesce(replacement, '') <> ''
              THEN '''' || value || ''' (''' || ch || ''' → ''' || replacement || ''')'
              ELSE '''' || value || ''' (character: ''' || ch || ''')' END,
         'Unicode'
  FROM chars
),
allrows AS (
  SELECT * FROM issues
  UNION ALL
  SELECT column_name, pos, 9, 0, 0, 0, {q(NO_ISSUES)}, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'No Issue'
  FROM nulls WHERE column_name NOT IN (SELECT column_name FROM issues)
)"""
    return ctes


LINE_SQL = ("CASE WHEN coalesce(example, '') <> '' THEN "
            "(CASE WHEN count_text IS NOT NULL THEN '- ' || issue || ': ' || count_text ELSE '- ' || issue END)"
            " || ' (' || example || ')' ELSE "
            "(CASE WHEN count_text IS NOT NULL THEN '- ' || issue || ': ' || count_text ELSE '- ' || issue END) END")


def health_report_sql(source_sql, id_col, cols, th=Thresholds(), report_apostrophe=False) -> str:
    sev_case = "CASE category " + " ".join(
        f"WHEN {q(k)} THEN {({'Critical': 0, 'Potential': 1, 'Ok': 2})[v]}" for k, v in SEVERITY.items()) + " END"
    return "WITH " + health_ctes(source_sql, id_col, cols, th, report_apostrophe) + f"""
SELECT column_name, pos,
       CASE min({sev_case}) WHEN 0 THEN 'Critical' WHEN 1 THEN 'Potential' ELSE 'Ok' END AS severity,
       string_agg({LINE_SQL}, chr(10) ORDER BY stage, k1, k2, k3, {LINE_SQL}) AS errors_found
FROM allrows GROUP BY column_name, pos"""


def issue_counters_sql(source_sql, id_col, cols, th=Thresholds(), report_apostrophe=False) -> str:
    cats = " UNION ALL ".join(f"SELECT {q(c)} AS category, {i} AS cat_pos" for i, c in enumerate(CATEGORIES))
    return "WITH " + health_ctes(source_sql, id_col, cols, th, report_apostrophe) + f""",
counts AS (
  SELECT category, count(*) AS n FROM allrows WHERE category IN ('Comma', 'Numeric') GROUP BY category
  UNION ALL
  SELECT category, count(*) FROM (SELECT DISTINCT category, column_name FROM allrows
                                  WHERE category NOT IN ('Comma', 'Numeric')) GROUP BY category
)
SELECT c.category, c.cat_pos, CAST(coalesce(n.n, 0) AS BIGINT) AS n_columns
FROM ({cats}) c LEFT JOIN counts n ON c.category = n.category"""


def null_profile_sql(source_sql, id_col, cols, th=Thresholds()) -> str:
    return "WITH " + health_ctes(source_sql, id_col, cols, th) + f"""
SELECT column_name, pos, n_rows, null_count, (null_count / n_rows) * 100 AS null_pct,
       (null_count / n_rows) * 100 > {float(th.nan)} AS issue
FROM nulls"""


def missing_report_sql(source_sql, id_col, cols, top_n=20) -> str:
    pct = ratio_round_sql("null_count * 100", "n_rows", 2)
    return "WITH " + health_ctes(source_sql, id_col, cols) + f"""
SELECT column_name, pos, null_count AS missing_count, {pct} AS missing_pct,
       CASE WHEN {pct} > 40 THEN {q(MISSING_ABOVE)} ELSE {q(MISSING_BELOW)} END AS condition
FROM nulls WHERE null_count > 0 ORDER BY missing_pct DESC, pos LIMIT {int(top_n)}"""


def numeric_issues_sql(source_sql, id_col, cols) -> str:
    return "WITH " + health_ctes(source_sql, id_col, cols) + """
SELECT column_name, pos, issue, issue_count, CAST(first_id AS BIGINT) AS first_id, example_value, example_fix
FROM numiss"""


def char_issues_sql(source_sql, id_col, cols, report_apostrophe=False) -> str:
    th = Thresholds(cat=-1)   # every text column
    return "WITH " + health_ctes(source_sql, id_col, cols, th, report_apostrophe) + """
SELECT column_name, pos, ch, occurrences, CAST(first_id AS BIGINT) AS first_id, issue, replacement, first_pos
FROM chars"""


def majority_sql(source_sql, id_col, cols, th=Thresholds()) -> str:
    return "WITH " + health_ctes(source_sql, id_col, cols, th) + f"""
SELECT column_name, pos, value, cnt, CAST(n_rows AS BIGINT) AS n_rows, pct, pct >= {float(th.rep)} AS issue
FROM major"""


def cardinality_sql(source_sql, id_col, cols, th=Thresholds()) -> str:
    return "WITH " + health_ctes(source_sql, id_col, cols, th) + f"""
SELECT column_name, pos, n_distinct, n_distinct > {int(th.cat)} AS issue FROM card"""


def looks_numeric_sql(source_sql, id_col, cols) -> str:
    return "WITH " + health_ctes(source_sql, id_col, cols) + """
SELECT column_name, pos, looks_numeric FROM looks"""
