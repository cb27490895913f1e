"""Frame-shape helpers shared by the operators: column kinds, the one-pass
unpivot used by every per-column group-by, exact rational rounding and
size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Names of the columns of one kind, in frame order."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def qcol(name: str) -> Column:
    """Reference a column whose name may contain dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns (pandas treats both as missing)."""
    dt = df.schema[name].dataType
    c = qcol(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def position_map(names: list[str]) -> Column:
    """Literal map column name -> position in the frame."""
    if not names:
        return F.create_map().cast("map<string,int>")
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])


def long_values(df: DataFrame, cols: list[str], id_col: str | None = None,
                positions: list[str] | None = None) -> DataFrame:
    """One scan -> (id?, column_name, pos, value as text). NULLs are kept.

    Every per-column statistic groups this long frame by ``column_name``, so
    a table of any width costs one scan and one shuffle, not one per column."""
    ids = [qcol(id_col)] if id_col else []
    order = positions or cols
    # inline(array(struct)) rather than DataFrame.unpivot: the Expand node of
    # unpivot trips a whole-stage codegen method-split bug when wide CASE
    # expressions follow it, which silently drops to the interpreted path.
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(order.index(c)).alias("pos"),
                               qcol(c).cast("string").alias("value")) for c in cols])
    return df.select(*ids, F.inline(items))


def stack_row(row: DataFrame, items: list[tuple[str, int, dict[str, Column]]],
              keep: list[str] | None = None) -> DataFrame:
    """Turn a one-row aggregate into one row per column (O(columns) rows)."""
    structs = []
    for name, pos, fields in items:
        structs.append(F.struct(F.lit(name).alias("column_name"), F.lit(pos).alias("pos"),
                                *[v.alias(k) for k, v in fields.items()]))
    keep_cols = [F.col(k) for k in (keep or [])]
    return row.select(*keep_cols, F.inline(F.array(*structs)))


def ratio_round_sql(num: str, den: str, decimals: int) -> str:
    """SQL text (valid in Spark and DuckDB) for num/den rounded half-up to
    ``decimals`` places using integer arithmetic, so both engines return the
    same double. Arguments are non-negative integer SQL expressions."""
    scale = 10 ** decimals
    return (f"(CAST(FLOOR((CAST({num} AS DOUBLE) * {2 * scale} + {den}) / (2 * {den})) "
            f"AS BIGINT) / CAST({scale} AS DOUBLE))")


def pct_text_sql(num: str, den: str, always_decimal: bool) -> str:
    """Text of 100*num/den: ``'12'`` when integral (unless ``always_decimal``),
    else one decimal rounded half-up, built from integers in SQL (portable)."""
    tenths = f"CAST(FLOOR((CAST({num} AS DOUBLE) * 2000 + {den}) / (2 * {den})) AS BIGINT)"
    one_dec = (f"concat(CAST(CAST(FLOOR({tenths} / 10) AS BIGINT) AS STRING), '.', "
               f"CAST({tenths} % 10 AS STRING))")
    if always_decimal:
        return one_dec
    integral = f"(({num}) * 100) % ({den}) = 0"
    whole = f"CAST(CAST(({num}) * 100 / ({den}) AS BIGINT) AS STRING)"
    return f"(CASE WHEN {integral} THEN {whole} ELSE {one_dec} END)"
