"""Compare a Spark frame with DuckDB SQL over the supplied parquet tables."""

import math

import duckdb
import pandas as pd

from tessera.sources.tables import TABLES


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or v is pd.NA:
        return (0, "")
    if hasattr(v, "item") and not isinstance(v, (list, tuple, str)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, float):                       # pandas holds whole numbers with nulls as floats
        return (0, "") if math.isnan(v) else (3, str(int(v))) if v.is_integer() and abs(v) < 2**53 else (1, float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)):
        return (2, str([norm(x) for x in v]))
    return (3, str(v))


def canon(pdf):
    cols = sorted(pdf.columns)
    rows = sorted((tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)
    return cols, rows
