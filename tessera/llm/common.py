"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts`` (a null id counts as
    the empty text). Decides what a model may learn from."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only (all-ASCII texts by the faster built-in, to the same effect)."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Identifies a row by content: the id and a hash and length of its text.
    Rows that agree in all three are repeated rows and get equal results."""
    return [F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"),
            F.length(F.col(text_col)).alias("_tl")]


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task: Spark keeps
    Python workers for later tasks, of other operators too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):                      # only glibc has it
        pass


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    while base.lower() in map(str.lower, df.columns):
        base += "_"
    return base


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to make: an input
    column named like an output column gives way to it."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])
