"""Character marks found and fixed by the health check (H6, C2), and label
helpers (F4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks the health check names and the Unicode fix replaces,
# in the reference's order: (character, replacement, issue label).
# Labels use the characters' real names where the reference misnames them.
MARKS = [
    ("−", "-", "Unicode: MINUS SIGN (U+2212)"),
    ("–", "-", "Unicode: EN DASH (U+2013)"),
    ("—", "-", "Unicode: EM DASH (U+2014)"),
    ("‐", "-", "Unicode: HYPHEN (U+2010)"),
    ("“", '"', "Unicode: CURVED QUOTE (U+201C)"),
    ("”", '"', "Unicode: CURVED QUOTE (U+201D)"),
    ("'", "", "Unicode: APOSTROPHE (U+0027)"),
    ("‘", "'", "Unicode: CURVED QUOTE (U+2018)"),
    ("’", "'", "Unicode: CURVED QUOTE (U+2019)"),
    ("…", "", "Unicode: ELLIPSIS (U+2026)"),
    ("\xa0", " ", "Unicode: NON-BREAKING SPACE (U+00A0)"),
]
# Fixed value: non-ASCII letters that are never reported.
ALLOWED_LETTERS = "åäöÅÄÖ"

NON_ASCII_PATTERN = "[^\\x00-\\x7F]"
NON_ASCII_OR_APOSTROPHE_PATTERN = "[^\\x00-\\x7F]|'"


def translate_args(drop_apostrophe: bool = True) -> tuple[str, str]:
    """(from, to) for ``translate``: mapped marks first, deleted marks last
    (``translate`` deletes characters of ``from`` that have no partner)."""
    kept = [(c, r) for c, r, _ in MARKS if r]
    dropped = [c for c, r, _ in MARKS if not r and (drop_apostrophe or c != "'")]
    src = "".join(c for c, _ in kept) + "".join(dropped)
    dst = "".join(r for _, r in kept)
    return src, dst


def fix_unicode(c: Column, drop_apostrophe: bool = True) -> Column:
    """Dashes -> ``-``, curly quotes -> straight, nbsp -> space, ellipsis
    (and by default the ASCII apostrophe) removed, in one ``translate``."""
    src, dst = translate_args(drop_apostrophe)
    return F.translate(c, src, dst)


def code_point_label(ch: Column) -> Column:
    """``U+XXXX`` of a one-character string (``ascii`` returns the code
    point in Spark)."""
    return F.format_string("U+%04X", F.ascii(ch))


def shorten(c: Column, max_len: int = 15) -> Column:
    """F4 first step: cut to ``max_len`` characters and add ``...``."""
    return F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, max_len), F.lit("..."))) \
        .otherwise(c)
