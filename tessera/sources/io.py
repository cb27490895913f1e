"""Delimited-file sources and sinks (S1-S5) and type inference.

CSV is read all-string (no ``inferSchema``: it would turn date-like text
into dates, which the reference keeps as text), the NA token set is applied
as an expression, then :func:`infer_types` decides each column's type in ONE
aggregate over all columns and casts through the guarded parser."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions.frame import qcol

# Text read as missing by default (the pandas CSV reader's set).
DEFAULT_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
              "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
              "nan", "null"]
# Text recognised as booleans.
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]


def clean_headers(df: DataFrame) -> DataFrame:
    """Blank headers (Spark names them ``_c<N>``, pandas ``Unnamed: N``)
    become ``Column_N``."""
    def fix(name: str) -> str:
        m = re.fullmatch(r"_c(\d+)", name) or re.fullmatch(r"Unnamed: (\d+)", name)
        return f"Column_{m.group(1)}" if m else name
    return df.toDF(*[fix(c) for c in df.columns])


def apply_na(df: DataFrame, null_values: list[str] | None = None,
             keep_default_na: bool = True) -> DataFrame:
    """Map the NA token set (plus user tokens) to NULL in every text column."""
    tokens = (DEFAULT_NA if keep_default_na else []) + list(null_values or [])
    tokens = sorted(set(tokens))
    return df.select(*[F.when(qcol(c).isin(tokens), F.lit(None).cast("string"))
                       .otherwise(qcol(c)).alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, delimiter: str = ",",
               null_values: list[str] | None = None, header: bool = True,
               infer: bool = True, multi_line: bool = True, keep_default_na: bool = True) -> DataFrame:
    """Delimited scan with a user null token, header cleaning and type
    inference. Quoted fields may hold the delimiter, doubled quotes and, with
    ``multi_line``, line breaks. Such a file is read by one task, so big inputs
    should be many files, or pass ``multi_line=False`` where no field holds a
    line break (files are then split across tasks)."""
    raw = (spark.read.option("header", header).option("sep", delimiter)
           .option("quote", '"').option("escape", '"').option("lineSep", "\n")
           .option("inferSchema", False).option("multiLine", multi_line)
           .option("mode", "PERMISSIVE").csv(path))
    df = apply_na(clean_headers(raw), null_values, keep_default_na)
    return infer_types(df) if infer else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def inferred_types(df: DataFrame, cols: list[str] | None = None) -> dict[str, str]:
    """S2 decision, O(columns) to the driver: an integer type if every value is
    an integer and none is missing (long, decimal(38,0) beyond 64 bits, text
    beyond 38 digits); double if every non-missing value is a number (or the
    column is all missing); boolean if every value is a true/false word and
    none is missing; else string.

    One aggregate over all columns, summed up in the map tasks: no value is
    shuffled. Patterns run only on what the cast to long refuses."""
    cols = cols if cols is not None else df.columns
    text = [c for c in cols if dict(df.dtypes)[c] == "string"]
    if not text:
        return {}

    def times(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    aggs = []
    for k, c in enumerate(text):
        v = qcol(c)
        s = N.strip(v)
        whole = s.rlike(N.INTEGER_PATTERN)
        small = F.when(whole, s.try_cast("long")).isNotNull()          # a refused cast costs an exception a value
        aggs += [times(v.isNull()).alias(f"n{k}"),
                 times(v.isNotNull() & ~(small | N.parses(s))).alias(f"f{k}"),
                 times(v.isNotNull() & ~(small | whole)).alias(f"i{k}"),
                 times(~small & whole).alias(f"w{k}"),
                 times(~small & whole & (F.length(F.ltrim(s, F.lit("+-0"))) > 38)).alias(f"x{k}"),
                 times(v.isNotNull() & ~v.isin(TRUE_WORDS + FALSE_WORDS)).alias(f"b{k}")]
    r = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    out = {}
    for k, c in enumerate(text):
        n, f, i, w, x, b = (r[f"{p}{k}"] or 0 for p in "nfiwxb")
        if n == r["rows"]:
            out[c] = "double"
        elif i == 0 and n == 0:
            out[c] = "string" if x else "decimal(38,0)" if w else "long"
        elif f == 0:
            out[c] = "double"
        elif b == 0 and n == 0:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def cast_to(c: str, kind: str, checked: bool = True):
    """Column cast for an inferred kind. ``checked`` means every value is
    already known to pass the kind's rule, so the per-row guard is skipped."""
    v = qcol(c)
    if kind == "long" or kind.startswith("decimal"):
        return N.strip(v).try_cast(kind).alias(c)
    if kind == "double":
        num = N.strip(v).try_cast("double") if checked else N.to_number(v)
        return F.when(~F.isnan(num), num).alias(c)          # NaN text -> NULL
    if kind == "boolean":
        return F.when(v.isin(TRUE_WORDS), F.lit(True)).when(v.isin(FALSE_WORDS), F.lit(False)).alias(c)
    return v.alias(c)


def infer_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Re-type text columns (all, or ``cols``) by the rule above."""
    kinds = inferred_types(df, cols)
    return df.select(*[cast_to(c, kinds[c]) if c in kinds else qcol(c) for c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "csv", delimiter: str = ",",
                null_value: str = "", mode: str = "overwrite") -> None:
    """S3: save with a header and no index; written in parallel by tasks."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("sep", delimiter).option("nullValue", null_value) \
            .option("quote", '"').option("escape", '"').option("lineSep", "\n") \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
            .option("emptyValue", '""').csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def convert_delimiter(spark: SparkSession, in_path: str, out_path: str, delimiter: str,
                      null_values: list[str] | None = None) -> DataFrame:
    """Rewrite a delimited file with ``,``; returns the re-read table."""
    df = read_table(spark, in_path, delimiter, null_values, infer=False)
    write_table(df, out_path, "csv", ",")
    return read_table(spark, out_path, ",")
