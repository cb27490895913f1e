"""Operator 12: the trie of all conversation prefixes.

A conversation is its list of turn digests. All conversations are sorted
across the cluster by that list and then by id, so that the members of a trie
node are neighbours:

1. :func:`forest` works on one sorted partition. Edges between neighbours, as deep as the
   prefix that they share, are taken deepest first, and union-find merges the
   components on both sides: each merge is a branching node, and the depths
   between two merges are nodes with a single child. A node that holds neither the first
   nor the last row of its partition has all its members there and is done.
2. The other ('open') nodes are prefixes of a partition's first or last row. :func:`contract`
   merges those of up to ``FAN`` neighbouring blocks by their keys, closes the
   nodes that no longer touch the outer border, adds them to their parents
   and leaves a block with open nodes of its own, until one block is left.

Digests of the ids that end in an open node are worked out over pieces of ids in
sorted order, streamed, so that a conversation shared by a third of all ids
is never one row.

Semantics: rows without a conversation id take no part. Turns of a conversation are
sorted by turn (null first), then role, then the digest of the text; repeated
rows are turns of their own. An empty table gives no rows, not even a root.
Other columns are ignored. A conversation's digests (16 bytes a turn) are one row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release_memory
from tessera.session import scratch_path

FAN = 64                  # blocks that one task of a merging round takes
PIECE = 8192              # ids in one piece of an open node's list of ends
BORDER = 200_000          # border nodes (a key and a number each) that may be broadcast
ROWS = 10_000             # rows of one output batch

_FIELDS = [("kind", pa.string()), ("block", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
           ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
           ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()),
           ("ends_sha256", pa.string()), ("ends", pa.binary())]
_NAMES = [n for n, _ in _FIELDS]
_SCHEMA = "kind string, block long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, " \
    "n_children long, n_leaves long, saved_tokens long, words long, first boolean, last boolean, ends_sha256 string, ends binary"
NOTHING = hashlib.sha256(b"").hexdigest()


def _row(**values) -> list:
    return [values.get(n) for n in _NAMES]


def _batches(rows: list[list]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), ROWS):
        cols = zip(*rows[at:at + ROWS])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], names=_NAMES)


def prefix_keys(seq: list[bytes]) -> list[bytes]:
    """A key of every prefix, the empty one first."""
    h = hashlib.sha256()
    keys = [h.digest()[:16]]
    for digest in seq:
        h.update(digest)
        keys.append(h.copy().digest()[:16])
    return keys


def _same(a: list, b: list) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class _Part:
    """A component of the union-find: rows low .. high, and its node of the present depth."""
    __slots__ = ("low", "high", "depth", "n", "least", "ends", "below", "children", "leaves", "saved")

    def __init__(self, low: int, high: int, depth: int, ids: list[int]):
        self.low, self.high, self.depth, self.n, self.least, self.ends = low, high, depth, len(ids), min(ids), ids
        self.below, self.children, self.leaves, self.saved = [], 0, 0, 0       # of closed children


def forest(ids: list[int], seqs: list[list[bytes]], words: list[list[int]], block: int) -> list[list]:
    """Rows of the local trie of sorted conversations: closed nodes, open nodes
    and the ends of open nodes."""
    if not ids:
        return []
    end, out = len(ids) - 1, []
    edge_keys = prefix_keys(seqs[0]), prefix_keys(seqs[end])
    parts, place = [], [0] * len(ids)
    deep = [_same(seqs[i - 1], seqs[i]) for i in range(1, len(ids))]
    low = 0
    for i in range(1, len(ids) + 1):                           # runs of equal conversations
        if i > end or not deep[i - 1] == len(seqs[i]) == len(seqs[i - 1]):
            place[low:i] = [len(parts)] * (i - low)
            parts.append(_Part(low, i - 1, len(seqs[low]), ids[low:i]))
            low = i
    root = list(range(len(parts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def lift(p: _Part, to: int) -> None:
        """Put out the nodes of ``p`` that are deeper than ``to``."""
        while p.depth > to:
            put(p)

    def put(p: _Part) -> None:
        first, last = p.low == 0, p.high == end
        own = words[p.low][p.depth - 1] if p.depth else 0
        if first or last:
            keys = edge_keys[0 if first else 1]
            key, above = keys[p.depth], keys[p.depth - 1] if p.depth else None
            for at in p.below:
                out[at][3] = key
            out.append(_row(kind="open", block=block, key=key, parent_key=above, conv_id=p.least, depth=p.depth, n_convs=p.n,
                            n_children=p.children, n_leaves=p.leaves, saved_tokens=p.saved, words=own, first=first, last=last))
            for at in range(0, len(p.ends), PIECE):
                text = ",".join(map(str, p.ends[at:at + PIECE]))
                out.append(_row(kind="ends", block=block, key=key, depth=at, ends=text.encode()))
            p.below, p.children, p.leaves, p.saved = [], 0, 0, 0
        else:
            for at in p.below:
                out[at][6] = p.least
            leaves, saved = p.leaves or 1, p.saved + (p.n - 1) * own
            sha = hashlib.sha256(",".join(map(str, p.ends)).encode()).hexdigest() if p.ends else NOTHING
            out.append(_row(kind="closed", conv_id=p.least, depth=p.depth, n_convs=p.n, n_children=p.children, n_leaves=leaves,
                            saved_tokens=saved, ends_sha256=sha))
            p.below, p.children, p.leaves, p.saved = [len(out) - 1], 1, leaves, saved
        p.ends = []
        p.depth -= 1

    for i in sorted(range(1, len(ids)), key=lambda i: -deep[i - 1]):
        a, b = find(place[i - 1]), find(place[i])
        if a == b:
            continue
        left, right = parts[a], parts[b]
        lift(left, deep[i - 1])
        lift(right, deep[i - 1])
        left.high, left.n, left.least = right.high, left.n + right.n, min(left.least, right.least)
        left.ends += right.ends
        left.below += right.below
        left.children, left.leaves, left.saved = left.children + right.children, left.leaves + right.leaves, left.saved + right.saved
        root[b], parts[b] = a, None
    lift(parts[find(0)], -1)
    return out


def contract(rows: list[dict], group: int, whole: bool) -> list[list]:
    """Open nodes of neighbouring blocks as one block's: equal keys are merged, and
    nodes away from the outer border closed (all, if the block is the ``whole``)."""
    lowest, highest = min(r["block"] for r in rows), max(r["block"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        first, last = bool(r["first"] and r["block"] == lowest), bool(r["last"] and r["block"] == highest)
        got = nodes.get(r["key"])
        if got is None:
            nodes[r["key"]] = r | {"first": first, "last": last}
            continue
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            got[name] += r[name]
        got["conv_id"] = min(got["conv_id"], r["conv_id"])
        got["first"], got["last"] = got["first"] or first, got["last"] or last
    out = []
    for node in sorted(nodes.values(), key=lambda x: -x["depth"]):
        node["block"] = group
        if not whole and (node["first"] or node["last"]):
            out.append(_row(**node | {"kind": "open"}))
            continue
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        parent = nodes.get(node["parent_key"])
        if parent is not None:
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved_tokens"] += node["saved_tokens"]
            node["parent_conv_id"] = parent["conv_id"] if whole or not (parent["first"] or parent["last"]) else None
        out.append(_row(**node | {"kind": "closed"}))
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of every key, which come in order."""
    key, h = None, None
    for batch in batches:
        done = []
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                h.update(b"," + piece)
                continue
            if h is not None:
                done.append((key, h.hexdigest()))
            key, h = k, hashlib.sha256(piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["key", "sha"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "sha"])


def _merger(whole: bool):
    def merge(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["group"]).to_pylist()
        return pa.Table.from_batches(_batches(contract(rows, table.column("group")[0].as_py(), whole)), pa.schema(_FIELDS))
    return merge


def trie(conversations: DataFrame, id_col: str = "conv_id", seq_col: str = "seq", words_col: str = "words") -> DataFrame:
    """Nodes of the trie of conversations given as one row each: a long id, the
    digests of its turns (array of binary) and their numbers of words (array of long)."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col(id_col).cast("long").alias("id"), F.col(seq_col).alias("seq"), F.col(words_col).alias("words"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seqs, words = [], [], []
        for batch in batches:
            for to, column in zip((ids, seqs, words), batch.columns):
                to += column.to_pylist()
        yield from _batches(forest(ids, seqs, words, TaskContext.get().partitionId()))
        release_memory()

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, "trie")
    rows.repartitionByRange(parts, "seq", "id").sortWithinPartitions("seq", "id").mapInArrow(local, _SCHEMA).write.parquet(path)
    found = spark.read.schema(_SCHEMA).parquet(path)
    opened, closed = found.where("kind = 'open'"), []
    blocks = (opened.agg(F.max("block")).first()[0] or 0) + 1
    while True:
        whole = blocks <= FAN

        path = scratch_path(spark, "trie")
        opened.withColumn("group", F.floor(F.col("block") / FAN)).groupBy("group").applyInArrow(_merger(whole), _SCHEMA).write.parquet(path)
        merged = spark.read.schema(_SCHEMA).parquet(path)
        closed.append(merged.where("kind = 'closed'"))
        if whole:
            break
        opened, blocks = merged.where("kind = 'open'"), (blocks + FAN - 1) // FAN
    border = closed[0]
    for x in closed[1:]:
        border = border.unionByName(x)
    sha = found.where("kind = 'ends'").select("key", "ends", "block", "depth").repartition(F.col("key")) \
        .sortWithinPartitions("key", "block", "depth").select("key", "ends").mapInArrow(_ends, "key binary, sha string")
    border = border.drop("ends").join(sha, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NOTHING))).drop("sha")
    inner = found.where("kind = 'closed'")
    # children of border nodes learn their parent's smallest member. The border has a few rows a partition; with
    # very long conversations it may have many, and is broadcast only where its counted rows are few
    above = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    if sum(x.count() for x in closed) <= BORDER:
        above = F.broadcast(above)
    inner = inner.join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    own = border.drop("parent_conv_id").join(above.withColumnRenamed("_parent", "parent_conv_id"), "parent_key", "left")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inner.select(*names).unionByName(own.select(*names))


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn's role and text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, seq, words): every conversation with its first h turns taken from the
    first conversation of its group of ``every`` ids; h is the id's crc32 modulo ``heads``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), turn_digest(role, text).alias("digest"),
                 F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")) \
        .select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own"),
                F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int").alias("h"),
                (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    first = own.where(F.col("base") == F.col("conv_id")).select("base", F.slice("own", 1, max(1, heads - 1)).alias("head"))
    none = F.array().cast("array<struct<digest:binary,words:bigint>>")
    whole = F.concat(F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).otherwise(none),
                     F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return own.join(first, "base", "left").withColumn("_t", whole) \
        .select("conv_id", F.transform("_t", lambda t: t["digest"]).alias("seq"), F.transform("_t", lambda t: t["words"]).alias("words"))


def oracle(every: int = 20, heads: int = 4) -> str:
    """DuckDB SQL for the trie of the rebuilt conversations."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE bits(b, i, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT b, i + 1, {step} FROM bits WHERE i < 8),
t AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE i = 8),
o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT conv_id, turn, role, substr(sha256(strlen(role) || ':' || role || text), 1, 32) AS digest,
  CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS k FROM m),
c AS (SELECT conv_id, regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..') AS bytes FROM (SELECT DISTINCT conv_id FROM m)),
h AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda x: CAST('0x' || x AS BIGINT))),
        lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) % {heads} AS h FROM c, t),
r AS (SELECT h.conv_id, k, digest, words FROM h JOIN n ON n.conv_id = h.conv_id - h.conv_id % {every} AND k <= h
  UNION ALL SELECT conv_id, k, digest, words FROM h JOIN n USING (conv_id) WHERE k > h),
q AS (SELECT conv_id, words, digest, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth FROM r),
p AS (SELECT conv_id, depth, words, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM q),
a AS (SELECT conv_id, depth, words, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS above FROM p
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM h),
v AS (SELECT node, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM a GROUP BY node, depth),
k AS (SELECT above AS node, count(*) AS n_children FROM v WHERE above IS NOT NULL GROUP BY above),
s AS (SELECT a.node, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved
  FROM v LEFT JOIN k ON k.node = v.node JOIN a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.node),
e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM a
  WHERE (conv_id, depth) IN (SELECT (conv_id, max(depth)) FROM a GROUP BY conv_id) GROUP BY node)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM v JOIN s ON s.node = v.node LEFT JOIN v u ON u.node = v.above LEFT JOIN k ON k.node = v.node LEFT JOIN e ON e.node = v.node"""
