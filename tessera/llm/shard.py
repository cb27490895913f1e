"""Operator 6: sharding by weighted rendezvous hashing.

Every (record key, shard) pair has a hash u in (0, 1); a record goes to the
shard with the smallest -ln(u) / weight. The choice depends on the key and the
shards' weights only, and adding a shard takes records only into it. Slots
number the rows of a shard without gaps, in the order of a hash of the key.

Only DataFrame functions run here. A shard may be far too large for one task:
the hash order is cut into blocks of equal hash ranges, rows are numbered
within (shard, block), and the blocks' offsets (shards x blocks numbers) are
added.

Semantics: a null key counts as the empty text, so all null keys share a shard;
a null text has no bytes and checksum 0; repeated rows share a shard and get
slots of their own; input columns named like an output column give way to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, without

OVERHEAD = 16                  # bytes that every record adds to its text


def _unit(text: Column) -> Column:
    """A number in (0, 1) from 52 bits of an md5."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def ranked(key: Column, weights: list[float], first: int = 0) -> Column:
    """Smallest (cost, shard) over the shards ``first`` .. ``first + len(weights) - 1``."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    cost = F.transform(F.array(*[F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]),
                       lambda s: F.struct((-F.ln(_unit(F.concat(key, F.lit(":"), s["shard"].cast("string")))) / s["w"]).alias("cost"),
                                          s["shard"].alias("shard")))
    return F.array_min(cost)


def assign(df: DataFrame, weights: list[float], key_col: str, grow_by: float | None = None,
           shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``df`` with the shard of every row and, with ``grow_by``, the shard
    after one of that weight was added."""
    df = without(df, shard, grown)
    key, best = F.coalesce(F.col(key_col).cast("string"), F.lit("")), free_name(df, "_best")
    out = df.withColumn(best, ranked(key, weights))
    more = F.lit(None).cast("int")
    if grow_by is not None:
        more = F.least(F.col(best), ranked(key, [grow_by], len(weights)))["shard"]
    return out.withColumn(shard, F.col(best)["shard"].cast("int")).withColumn(grown, more.cast("int")).drop(best)


def number(df: DataFrame, key_col: str, order: list[str], shard: str = "shard", slot: str = "slot",
           blocks: int | None = None) -> DataFrame:
    """``df`` with gapless slots from 0 in every shard, by the hash of the key
    and then the ``order`` columns."""
    spark = df.sparkSession
    blocks = blocks or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    d = df.withColumn("_hash", F.md5(key.cast("binary")))
    d = d.withColumn("_block", F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint") * blocks / float(1 << 32)).cast("int"))
    w = Window.partitionBy(shard, "_block").orderBy("_hash", *order)
    local = d.withColumn("_n", F.row_number().over(w) - 1)
    sums = d.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_from", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    # shards x blocks rows
    return local.join(F.broadcast(offsets), [shard, "_block"]) \
        .withColumn(slot, (F.col("_from") + F.col("_n")).cast("long")).drop("_hash", "_block", "_n", "_from")


def layout(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
           weights: list[float] | None = None, grow_by: float = 1.0) -> DataFrame:
    """Per row: id, size, text_crc32, law ``key``, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    put = assign(rows, weights or [1.0] * shards, id_col, grow_by)
    return number(put, id_col, [id_col, "text_crc32", "size"]) \
        .select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def oracle(shards: int) -> str:
    """DuckDB SQL for :func:`layout` with equal weights. The checksum is worked
    out byte by byte from its polynomial."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE bits(b, i, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT b, i + 1, {step} FROM bits WHERE i < 8),
t AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE i = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
h AS (SELECT r, regexp_extract_all(hex(encode(text)), '..') AS bytes FROM d),
c AS (SELECT r, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda x: CAST('0x' || x AS BIGINT))),
        lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) AS crc FROM h, t),
p AS (SELECT r, s, -ln((CAST('0x' || substr(md5(k || ':' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS cost
      FROM d, range({shards + 1}) AS x(s)),
a AS (SELECT r, arg_min(s, (cost, s)) FILTER (s < {shards}) AS shard, arg_min(s, (cost, s)) AS grown FROM p GROUP BY r)
SELECT doc_id, CAST(strlen(text) + {OVERHEAD} AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law,
       CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, crc, strlen(text)) - 1 AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN c USING (r) JOIN a USING (r)"""
