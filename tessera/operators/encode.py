"""Encoding and normalisation.

Column roles and ranges are decided by ONE aggregate over all columns
(O(columns) numbers to the driver); the encoding itself is a single
``select`` of column expressions, so it stays inside whole-stage codegen and
needs no shuffle. One-hot categories are the sorted distinct values of
each categorical column; above ``max_onehot`` distinct values the column is
encoded as one sparse vector (StringIndexer + OneHotEncoder) instead of
thousands of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frame import kind_of, qcol

NULL_SUFFIX = "nan"


def column_roles(df: DataFrame, ordinal: dict[str, dict[str, int]] | None = None,
                 id_col: str | None = None) -> dict[str, str]:
    """Numeric | ordinal | binary | categorical | passthrough per column.
    Text columns: ordinal when in the mapping and >= 2 distinct values
    (NULL counted), else binary when <= 2 distinct, else categorical."""
    ordinal = ordinal or {}
    text = [f.name for f in df.schema.fields if kind_of(f.dataType) == "string" and f.name != id_col]
    nd = {}
    if text:
        row = df.agg(*[(F.count_distinct(qcol(c)) + F.max(qcol(c).isNull().cast("int"))).alias(f"d{i}")
                       for i, c in enumerate(text)]).first()
        nd = {c: row[f"d{i}"] for i, c in enumerate(text)}
    roles = {}
    for f in df.schema.fields:
        c, k = f.name, kind_of(f.dataType)
        if c == id_col:
            continue
        if k == "numeric":
            roles[c] = "numeric"
        elif k == "string":
            if nd[c] >= 2 and c in ordinal:
                roles[c] = "ordinal"
            elif nd[c] <= 2:
                roles[c] = "binary"
            else:
                roles[c] = "categorical"
        else:
            roles[c] = "passthrough"
    return roles


def _minmax_cols(df: DataFrame, exprs: dict[str, object]) -> dict[str, tuple[float, float]]:
    if not exprs:
        return {}
    row = df.agg(*[x for i, (c, e) in enumerate(exprs.items())
                   for x in (F.min(e).alias(f"mn{i}"), F.max(e).alias(f"mx{i}"))]).first()
    return {c: (row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(exprs)}


def scaled(e, mn, mx):
    """Min-max with the scaler's arithmetic: x * s + m, s = 1 / range
    (a zero range counts as 1, so a constant column maps to 0), m = -min*s."""
    if mn is None:
        return F.lit(None).cast("double")
    rng = float(mx) - float(mn)
    s = 1.0 / (rng if rng != 0 else 1.0)
    m = 0.0 - float(mn) * s
    return e.cast("double") * F.lit(s) + F.lit(m)


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min) per column; constant -> 0.0; NULL kept."""
    rng = _minmax_cols(df, {c: qcol(c) for c in cols})
    keep = set(cols)
    return df.select(*[scaled(qcol(c), *rng[c]).alias(c) if c in keep else qcol(c) for c in df.columns])


def binary_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """0/1 by sorted value; NULL stays NULL."""
    if not cols:
        return df
    row = df.agg(*[F.min(qcol(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    first = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    keep = set(cols)
    return df.select(*[F.when(qcol(c).isNull(), F.lit(None).cast("double"))
                       .when(qcol(c) == F.lit(first[c]), F.lit(0.0)).otherwise(F.lit(1.0)).alias(c)
                       if c in keep else qcol(c) for c in df.columns])


def ordinal_encode(df: DataFrame, mapping: dict[str, dict[str, int]]) -> DataFrame:
    """E5: the user's rank order (the reference intends this but sorts
    alphabetically), code = position in that order, then min-max over the
    codes present. Values missing from the mapping and NULL give NULL."""
    codes = {}
    for c, ranks in mapping.items():
        if c not in df.columns:
            continue
        order = sorted(ranks, key=ranks.get)
        lut = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(float(i)))])
        codes[c] = F.element_at(lut, qcol(c))
    rng = _minmax_cols(df, codes)
    return df.select(*[scaled(codes[c], *rng[c]).alias(c) if c in codes else qcol(c) for c in df.columns])


def _category_values(df: DataFrame, cols: list[str], max_onehot: int) -> dict[str, list | None]:
    """Sorted distinct values per column via one unpivoted group-by; a column
    over ``max_onehot`` values returns None (vector encoding)."""
    if not cols:
        return {}
    items = F.array(*[F.struct(F.lit(c).alias("c"), qcol(c).alias("v")) for c in cols])
    distinct = df.select(F.inline(items)).distinct()
    sizes = {r["c"]: r["n"] for r in distinct.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = [c for c in cols if sizes.get(c, 0) <= max_onehot]
    out: dict[str, list | None] = {c: None for c in cols}
    if small:
        rows = distinct.where(F.col("c").isin(small)).groupBy("c") \
            .agg(F.sort_array(F.collect_list("v")).alias("vals"),
                 F.max(F.col("v").isNull().cast("int")).alias("has_null")).collect()
        for r in rows:
            out[r["c"]] = list(r["vals"]) + ([None] if r["has_null"] else [])
    return out


def one_hot(df: DataFrame, cols: list[str], max_onehot: int = 1000) -> DataFrame:
    """Source column dropped; 0/1 double columns ``col_value`` appended
    for the sorted categories, NULL as its own last column ``col_nan``."""
    if not cols:
        return df
    cats = _category_values(df, cols, max_onehot)
    keep = [qcol(c) for c in df.columns if c not in set(cols)]
    added, wide = [], []
    for c in cols:
        if cats[c] is None:
            wide.append(c)
            continue
        for v in cats[c]:
            name = f"{c}_{NULL_SUFFIX}" if v is None else f"{c}_{v}"
            cond = qcol(c).isNull() if v is None else (qcol(c) == F.lit(v))
            added.append(F.coalesce(cond, F.lit(False)).cast("double").alias(name))
    out = df.select(*keep, *[qcol(c) for c in wide], *added)
    if wide:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import OneHotEncoder, StringIndexer
        stages = []
        for c in wide:
            stages += [StringIndexer(inputCol=c, outputCol=f"_{c}_idx", stringOrderType="alphabetAsc",
                                     handleInvalid="keep"),
                       OneHotEncoder(inputCol=f"_{c}_idx", outputCol=f"{c}_onehot", dropLast=False)]
        out = Pipeline(stages=stages).fit(out).transform(out)
        out = out.drop(*wide, *[f"_{c}_idx" for c in wide])
    return out


def encode_and_normalize(df: DataFrame, ordinal: dict[str, dict[str, int]] | None = None,
                         id_col: str | None = None, max_onehot: int = 1000) -> DataFrame:
    """Numeric -> min-max, binary -> 0/1, ordinal -> ranked + min-max,
    categorical -> one-hot columns appended last; other columns in place."""
    roles = column_roles(df, ordinal, id_col)
    by_role = {r: [c for c, rr in roles.items() if rr == r] for r in set(roles.values())}
    out = minmax(df, by_role.get("numeric", []))
    out = binary_encode(out, by_role.get("binary", []))
    if by_role.get("ordinal"):
        out = ordinal_encode(out, {c: ordinal[c] for c in by_role["ordinal"]})
    return one_hot(out, by_role.get("categorical", []), max_onehot)


def validate_ranking(df: DataFrame, mapping: dict[str, dict[str, int]]) -> DataFrame:
    """Problems of a rank mapping as rows (column_name, problem, detail):
    ranks must be 1..n, each used once, covering every distinct value."""
    spark = df.sparkSession
    problems = []
    for c, ranks in mapping.items():
        vals = sorted(ranks.values())
        if vals != list(range(1, len(vals) + 1)):
            problems.append((c, "ranks_not_1_to_n", ",".join(map(str, vals))))
    frame = spark.createDataFrame(problems, "column_name string, problem string, detail string")
    # values present in the data but absent from the mapping (anti join)
    for c, ranks in mapping.items():
        if c not in df.columns:
            continue
        known = spark.createDataFrame([(k,) for k in ranks], "v string")
        missing = df.select(qcol(c).alias("v")).where(F.col("v").isNotNull()).distinct() \
            .join(known, "v", "left_anti")
        frame = frame.unionByName(missing.select(F.lit(c).alias("column_name"),
                                                 F.lit("value_not_ranked").alias("problem"),
                                                 F.col("v").alias("detail")))
    return frame
