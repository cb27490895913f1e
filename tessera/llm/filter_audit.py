"""Operator 11: how text filters act together, with duplicates found by radix tries.

Every document gets a mask of the filters that it fails. Whether its text is
that of a smaller id is told by compressed tries over whole texts:

1. :func:`cut_prefixes` cuts the order of all texts into ranges of bounded
   bytes. A prefix that holds too many bytes is extended past all that its texts
   share, then by a few bytes, until each prefix is light or holds copies of
   one text only; the smallest id of such copies is known from that count.
   This is the top of the trie, counted over all documents.
2. Every map task works out the other filters, settles the copies of texts
   that step 1 knows and those within a batch, and sends on one row of each
   other text with its range.
3. Each range is one group: its texts go into a :class:`RadixTrie` whose
   terminals hold minimum ids, and a traversal tells which rows are copies.

The masks, counted per part, then give every order of the filters its numbers
without another look at a document.

Semantics: a null text is the empty text, a null part the empty string. A row
without an id is no copy of any and makes none. Repeated rows of one id are not
copies of each other. A document is ``good`` or ``toxic`` if any of its label
rows says so; label rows without a document count nowhere. An empty table gives
no rows. Other columns of ``docs`` are ignored."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release_memory

STEP = 3                       # bytes that a heavy prefix grows by, beyond what its texts share
LOOK = 1024                    # bytes that one round looks ahead for what the texts of a prefix share
LEAST_RANGE, MOST_RANGE = 1 << 20, 128 << 20     # bytes of text in one range

_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))            # bytes that don't start a character


def facts(text: bytes) -> dict[str, int]:
    """What the filters look at. Words end at the ASCII white space 09-0D and 20."""
    words = text.split()
    return {"words": len(words), "distinct": len(set(words)), "chars": len(text.translate(None, _CONTINUED)),
            "capitals": len(text) - len(text.translate(None, _CAPITALS)), "marks": len(text) - len(text.translate(None, _MARKS))}


#: Failure condition of each filter; the last letter of an audit is that of the duplicates.
CHECKS: dict[str, Callable[[dict[str, int]], bool]] = {
    "A": lambda f: f["words"] < 50,
    "B": lambda f: 100 * f["distinct"] < 65 * f["words"],
    "C": lambda f: 100 * f["capitals"] > 5 * f["chars"],
    "D": lambda f: f["marks"] > 0,
}


def shared(a: bytes, b: bytes) -> bytes:
    """The longest common prefix."""
    if b.startswith(a):
        return a
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return a[:low]


class RadixTrie:
    """Compressed trie over byte strings. A terminal holds the minimum id and the rows of its text."""

    def __init__(self) -> None:
        self.root = [b"", {}, None, []]                    # label, children by first byte, minimum id, rows

    def insert(self, text: bytes, key: int, row: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = child = [text[at:], {}, None, []]
                node = child
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            common = shared(label, text[at:at + len(label)])
            upper = [common, {label[len(common)]: child}, None, []]
            child[0] = label[len(common):]
            node[1][text[at]] = upper
            node, at = upper, at + len(common)
        node[2] = key if node[2] is None else min(node[2], key)
        node[3].append(row)

    def terminals(self) -> Iterator[tuple[int, list[int]]]:
        """(minimum id, rows) of every text."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[3]:
                yield node[2], node[3]
            stack.extend(node[1].values())


class Cuts:
    """Prefixes in order that every text has exactly one of: the greatest that is not beyond it."""

    def __init__(self) -> None:
        self.prefixes, self.shared, self.bytes = [b""], [0], [0]
        self.open, self.least = [True], [None]             # least: the minimum id where all texts are the same
        self.ranges = [0]

    def find(self, text: bytes) -> int:
        return max(0, bisect_right(self.prefixes, text) - 1)

    def replace(self, children: list[tuple]) -> None:
        """Open prefixes give way to (prefix, shared, bytes, open, least)."""
        old = [x for x in zip(self.prefixes, self.shared, self.bytes, self.open, self.least) if not x[3]]
        rows = sorted(old + children, key=lambda x: x[0]) or [(b"", 0, 0, False, None)]
        self.prefixes, self.shared, self.bytes, self.open, self.least = map(list, zip(*rows))

    def pack(self, target: int) -> int:
        """Neighbouring prefixes share a range of up to ``target`` bytes; gives the number of ranges."""
        self.ranges, at, held = [], 0, 0
        for n, least in zip(self.bytes, self.least):
            if least is None:
                if held and held + n > target:
                    at, held = at + 1, 0
                held += n
            self.ranges.append(at)
        return at + 1


def cut_prefixes(texts: DataFrame, partitions: int) -> tuple[Cuts, int]:
    """Cuts of the texts (columns ``_id`` long, ``_text`` binary) and the
    number of ranges. One pass a level; the driver gets the children of heavy prefixes only,
    whose number follows that of the ranges."""
    cuts, target = Cuts(), None
    while any(cuts.open):
        wide = texts.sparkSession.sparkContext.broadcast(cuts)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, found = wide.value, {}
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    k = c.find(text)
                    if not c.open[k]:
                        continue
                    name = text[:c.shared[k] + STEP]
                    got = found.get(name)
                    if got is None:
                        found[name] = [1, len(text), text, True, key]
                        continue
                    got[0] += 1
                    got[1] += len(text)
                    if got[2] != text or not got[3]:
                        got[2], got[3] = shared(got[2], text), False
                    if key is not None and (got[4] is None or key < got[4]):
                        got[4] = key
            names = list(found)
            rows = list(found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2][:len(n) + LOOK] for n, r in zip(names, rows)], pa.binary()),
                 pa.array([_digest(r[2]) if r[3] else None for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.int64())],
                names=["prefix", "bytes", "head", "whole", "least"])
            release_memory()

        got = texts.mapInArrow(count, "prefix binary, bytes long, head binary, whole binary, least long") \
            .groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.min("head").alias("low"), F.max("head").alias("high"),
                                   F.min("whole").alias("one"), F.max("whole").alias("other"),
                                   F.count("whole").alias("same"), F.count(F.lit(1)).alias("all"), F.min("least").alias("least")).collect()
        if target is None:
            target = min(MOST_RANGE, max(LEAST_RANGE, sum(r["bytes"] for r in got) // (2 * partitions)))
        children = []
        for r in got:
            one = r["same"] == r["all"] and r["one"] == r["other"]
            heavy = r["bytes"] > target
            children.append((bytes(r["prefix"]), len(shared(bytes(r["low"]), bytes(r["high"]))), r["bytes"], heavy and not one,
                             r["least"] if heavy and one else None))
        cuts.replace(children)
    return cuts, cuts.pack(target)


def _digest(text: bytes) -> bytes:
    import hashlib
    return hashlib.sha256(text).digest()


def masks(docs: DataFrame, checks: dict[str, Callable] | None = None, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """(_id, _part, _mask, _n): how many rows of an id and part fail a set of
    filters: bit i for the i-th check, the next bit for a copy of a smaller id."""
    checks = checks if checks is not None else CHECKS
    conditions, copy_bit = list(checks.values()), 1 << len(checks)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"))
    cuts, ranges = cut_prefixes(rows.select("_id", "_text"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    wide = spark.sparkContext.broadcast(cuts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = wide.value
        for batch in batches:
            least, seen = {}, {}
            for key, text, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key is not None and (text not in least or key < least[text]):
                    least[text] = key
                at = (text, key, part)
                seen[at] = seen.get(at, 0) + 1
            known, out = {}, {}
            for (text, key, part), n in seen.items():
                got = known.get(text)
                if got is None:
                    f = facts(text)
                    got = known[text] = (sum(1 << i for i, fails in enumerate(conditions) if fails(f)), c.find(text))
                mask, k = got
                settled = key is None or key > least[text]
                if settled:
                    mask |= copy_bit if key is not None else 0
                elif c.least[k] is not None:
                    settled, mask = True, mask | (copy_bit if key > c.least[k] else 0)
                at = (key, part, mask, None if settled else text, zlib.crc32(f"{key},{part},{mask}".encode()) % ranges if settled else c.ranges[k])
                out[at] = out.get(at, 0) + n
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[4], pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()),
                 pa.array(list(out.values()), pa.int64()), pa.array(cols[3], pa.binary())],
                names=["_range", "_id", "_part", "_mask", "_n", "_text"])
        release_memory()

    def second(group: pa.Table) -> pa.Table:
        keys, mask = group.column("_id").to_pylist(), group.column("_mask").to_pylist()
        trie = RadixTrie()
        for i, text in enumerate(group.column("_text").to_pylist()):
            if text is not None:
                trie.insert(text, keys[i], i)
        for least, held in trie.terminals():
            for i in held:
                if keys[i] > least:
                    mask[i] |= copy_bit
        return pa.table([group.column("_id"), group.column("_part"), pa.array(mask, pa.int32()), group.column("_n")],
                        names=["_id", "_part", "_mask", "_n"])

    sent = rows.mapInArrow(first, "_range int, _id long, _part string, _mask int, _n long, _text binary")
    return sent.groupBy("_range").applyInArrow(second, "_id long, _part string, _mask int, _n long") \
        .groupBy("_id", "_part", "_mask").agg(F.sum("_n").alias("_n"))


def audit(docs: DataFrame, labels: DataFrame, checks: dict[str, Callable] | None = None, copies: str = "E", id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; see the module's text."""
    checks = checks if checks is not None else CHECKS
    letters = [*checks, copies]
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")) \
        .agg(F.max((F.col("quality") == 1).cast("long")).alias("_good"), F.max((F.col("toxic") == 1).cast("long")).alias("_toxic"))
    found = masks(docs, checks, id_col, text_col, part_col).join(marks, "_id", "left") \
        .groupBy("_part", "_mask").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.coalesce("_good", F.lit(0))).alias("good"),
                                       F.sum(F.col("_n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"))
    # at most 2 ** filters masks a part
    parts = found.groupBy(F.col("_part").alias("part")).agg(F.collect_list(F.struct(F.col("_mask").alias("mask"), "n", "good", "toxic")).alias("_m"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bit = F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, 1 << i)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))) \
        .withColumn("_bit", bit[F.substring("filter_order", F.col("step"), F.lit(1))]) \
        .withColumn("_before", F.aggregate(F.split(F.expr("left(filter_order, step - 1)"), ""), F.lit(0),
                                           lambda a, c: a.bitwiseOR(F.coalesce(bit[c], F.lit(0)))))

    def total(value: str, when) -> Column:
        return F.aggregate("_m", F.lit(0).cast("long"), lambda a, m: a + F.when(when(m["mask"]), m[value]).otherwise(F.lit(0)))

    has, gone, only = (lambda m: m.bitwiseAND(F.col("_bit")) != 0), (lambda m: m.bitwiseAND(F.col("_before")) != 0), (lambda m: m == F.col("_bit"))
    fact = 1
    for i in range(2, len(letters) + 1):
        fact *= i
    # of the filters that a document fails each comes first in an equal share of all orders
    share = F.aggregate("_m", F.lit(0).cast("long"), lambda a, m: a + F.when(
        has(m["mask"]), m["n"] * (F.lit(fact) / F.greatest(F.bit_count(m["mask"]), F.lit(1))).cast("long")).otherwise(F.lit(0)))
    return steps.select("part", "filter_order", F.col("step").cast("int").alias("step"),
                        total("n", lambda m: ~gone(m) & ~has(m)).alias("kept"), total("n", lambda m: has(m) & ~gone(m)).alias("removed"),
                        total("n", lambda m: has(m) & gone(m)).alias("redundant"), total("n", only).alias("unique_fails"),
                        total("good", lambda m: has(m) & ~gone(m)).alias("good_lost"), total("toxic", lambda m: has(m) & ~gone(m)).alias("toxic_lost"),
                        share.alias("shapley"))


def oracle() -> str:
    """DuckDB SQL for :func:`audit` with the default checks."""
    letters = "ABCDE"
    conditions = ["n_words < 50", "100 * n_distinct < 65 * n_words", "100 * n_upper > 5 * n_chars", "has_mark", "is_copy"]
    mask = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(conditions))
    return f"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS is_copy FROM d),
f AS (SELECT doc_id, part, is_copy, len(words) AS n_words, len(list_distinct(words)) AS n_distinct, length(t) AS n_chars,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, regexp_matches(t, '[#$%&*|]') AS has_mark FROM w),
m AS (SELECT f.part, {mask} AS mask, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT unnest(string_split('{letters}', '')) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, CAST(step AS INTEGER), 1)) - 65) AS bit,
  CAST(coalesce(list_sum(list_transform(string_split(left(filter_order, step - 1), ''), lambda y: CASE WHEN y = '' THEN 0 ELSE 1 << (ascii(y) - 65) END)), 0) AS BIGINT) AS before
  FROM o, range(1, 6) AS r(step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step"""
