"""Number parsing as column expressions.

Every text-to-number cast in the library goes through :func:`to_number`, so
Spark's lenient casts (``'1d'`` -> 1.0) never leak in. The same pattern is
used by the DuckDB oracle (RE2 accepts it unchanged)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a decimal number with optional sign and exponent, or the
# words inf / infinity / nan in any case.
NUMBER_PATTERN = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
WHITESPACE_EDGES = r"^\s+|\s+$"
# Fixed value: the whitespace characters stripped around numbers.
WHITESPACE = " \t\n\x0b\f\r"

# Numeric-issue labels of the health check, in rule order.
ISSUE_UNICODE_MINUS = "Contains Unicode minus sign (U+2212)"
ISSUE_EUROPEAN = "Uses European number format (comma as decimal)"
ISSUE_COMMA_DECIMAL = "Uses comma as decimal separator"
ISSUE_NOT_NUMBER = "Numeric Error: Cannot be converted to number"

UNICODE_MINUS = "−"


def strip(c: Column) -> Column:
    """Remove surrounding whitespace (character-set trim, no regex)."""
    return F.btrim(c, F.lit(WHITESPACE))


def parses(c: Column) -> Column:
    """True when the (already stripped) text is a number."""
    return c.rlike(NUMBER_PATTERN)


def to_number(c: Column) -> Column:
    """Guarded text -> double; anything that is not a number becomes NULL."""
    s = strip(c.cast("string"))
    return F.when(parses(s), s.try_cast("double"))


def digit_like(c: Column) -> Column:
    """H2 rule: after ``,`` -> ``.`` and removing ``-`` and ``.`` only digits
    remain (so ``2024-01-01`` counts)."""
    s = F.replace(F.replace(F.replace(c, F.lit(","), F.lit(".")), F.lit("-"), F.lit("")),
                  F.lit("."), F.lit(""))
    return s.rlike("^[0-9]+$")


def numeric_issue(raw: Column) -> tuple[Column, Column]:
    """(issue label or NULL, suggested fix or NULL) for one text value, using
    the ordered rules: parses -> no issue; Unicode minus; European format;
    comma decimal; otherwise not a number."""
    s = strip(raw.cast("string"))
    minus_fix = F.replace(s, F.lit(UNICODE_MINUS), F.lit("-"))
    euro_fix = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    comma_fix = F.replace(s, F.lit(","), F.lit("."))
    has_comma = s.contains(",")
    has_dot = s.contains(".")
    is_minus = s.contains(UNICODE_MINUS) & parses(minus_fix)
    is_euro = has_comma & has_dot & parses(euro_fix)
    is_comma = has_comma & ~has_dot & parses(comma_fix)
    issue = (F.when(raw.isNull() | parses(s), F.lit(None).cast("string"))
             .when(is_minus, F.lit(ISSUE_UNICODE_MINUS))
             .when(is_euro, F.lit(ISSUE_EUROPEAN))
             .when(is_comma, F.lit(ISSUE_COMMA_DECIMAL))
             .otherwise(F.lit(ISSUE_NOT_NUMBER)))
    fix = (F.when(raw.isNull() | parses(s), F.lit(None).cast("string"))
           .when(is_minus, minus_fix)
           .when(is_euro, euro_fix)
           .when(is_comma, comma_fix))
    return issue, fix


def fix_decimal(c: Column) -> Column:
    """Every comma between two digits becomes a dot, double quotes are
    removed, then the guarded parse; ``1.234,56`` therefore becomes NULL."""
    s = F.regexp_replace(c.cast("string"), r"(?<=\d),(?=\d)", ".")
    return to_number(F.replace(s, F.lit('"'), F.lit("")))


def digamma_sql(m: str) -> str:
    """The digamma function of a whole number from 1 on, as SQL that Spark and
    DuckDB share: ten steps of its recursion, then the asymptotic series."""
    z = f"(CAST({m} AS DOUBLE) + 10)"
    steps = " + ".join(f"1e0 / (CAST({m} AS DOUBLE) + {i})" for i in range(10))
    # terms B(2n) / (2n z^2n)
    series = "".join(f" - {num}e0 / ({den} * pow({z}, {p}))" for num, den, p in ((1, 12, 2), (-1, 120, 4), (1, 252, 6), (-1, 240, 8), (1, 132, 10)))
    return f"(ln({z}) - 1e0 / (2 * {z}){series} - ({steps}))"
