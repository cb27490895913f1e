"""Operator 8: near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles (fewer words: one
shingle). Its signature takes, for every register, the earliest point of Poisson
processes that belong to the shingles. A shingle's weights are cut into
dyadic levels (0,1], (1,2], (2,4], ...; each level is a process whose rate is its
width, and a point counts only if its place in the level is within the
shingle's weight. Two documents agree in a register with a probability equal
to the Jaccard similarity of their multisets. Points come in order of time, so
a process ends as soon as its next point is later than the latest register.

Documents with equal texts are one class from the start and go on as one vertex,
whatever their ids. Bands of the signature make buckets. First every member is compared
with the smallest vertex of its bucket (one row per member, however large the bucket)
and linked if the multisets' similarity reaches the threshold. Buckets that then
still hold several components are finished exactly: every member outside of the
bucket's largest component is compared with all members of other components, in
blocks of bounded size. So every pair that shares a bucket ends in one component or
has been compared. Classes are the connected components of the links.

A pair of similarity 0.8 shares none of the 16 bands of 4 with probability
(1 - 0.8**4)**16 = 0.0002.

Semantics: rows with a null id take part by their text, and the class of texts that
only such rows hold is null; texts without a word (null, empty, marks only) are like no
other text, so that such rows are classes of their own id (null: of their own); rows that
repeat an id get that id's class once for each row, and different texts under one id
are linked through it, each being compared by its own bands and multiset."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, release_memory
from tessera.operators.neighbors import connected_components
from tessera.session import scratch_path

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
BLOCK = 512                     # members compared with as many others in a group of the exact second round
WORDS_AT_ONCE = 1_000_000       # words hashed together by one worker
WORD_CACHE = 200_000

_words = re.compile(r"\w+").findall
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Shingler:
    """Hashes of the shingles of many texts at a time."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes, numbers of their texts), in order."""
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        known, hashes, count = self.known, [], []
        for t in texts:
            words = _words(t.lower())
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
            hashes += map(known.__getitem__, words)
            count.append(len(words))
        h, n = np.array(hashes, np.uint64), np.array(count, np.int64)
        doc = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        left = np.repeat(n, n) - place                         # words from here to the end of the text
        out = np.zeros(len(h), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.size):
                part = np.zeros_like(out)
                part[:len(h) - i] = h[i:]
                part[left <= i] = 0                            # short texts are one shorter shingle
                out = _mix(out * _STEP + part + np.uint64(i + 1))
        start = (left >= self.size) | (place == 0)
        return out[start], doc[start]


def signatures(shingle: np.ndarray, doc: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Registers (times as doubles) of each text; infinite for a text without shingles."""
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(doc)))
    shingle, doc = shingle[at], doc[at]
    # one process for each level that a weight reaches into
    level = np.zeros(len(at), np.int64)
    parts = [(shingle, doc, weight, level)]
    high = 0
    more = weight > 1
    while more.any():
        high += 1
        parts.append((shingle[more], doc[more], weight[more], np.full(int(more.sum()), high)))
        more = weight > (1 << high)
    shingle, doc, weight, level = (np.concatenate(x) for x in zip(*parts))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low).astype(np.float64)
    regs = np.full(docs * registers, np.inf)
    latest = np.full(docs, np.inf)
    with np.errstate(over="ignore"):
        state = _mix(shingle + level.astype(np.uint64) * _M2)
        time = np.zeros(len(doc))
        while len(doc):
            state = state + _STEP
            a = _mix(state)
            time = time - np.log(_unit(a)) / (width * registers)
            live = time < latest[doc]
            if not live.all():
                state, time, doc, weight, low, width, a = (x[live] for x in (state, time, doc, weight, low, width, a))
            b = _mix(a ^ _M1)
            register = (b % np.uint64(registers)).astype(np.int64)
            place = low + np.floor(_unit(_mix(b + _STEP)) * width).astype(np.int64) + 1
            own = np.flatnonzero(place <= weight)
            np.minimum.at(regs, doc[own] * registers + register[own], time[own])
            latest = regs.reshape(docs, registers).max(1)
    return regs.reshape(docs, registers)


def band_hashes(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = regs.view(np.uint64).reshape(len(regs), bands, rows)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, bits.shape[:2]).copy()
        for i in range(rows):
            out = _mix(out * _M2 + bits[:, :, i])
    return out.view(np.int64)


def as_set(shingle: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the k-th occurrence of a shingle is an
    element of its own, so that set overlap is multiset overlap."""
    s = np.sort(shingle)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return np.sort(np.where(nth == 0, s, _mix(s + nth.astype(np.uint64) * _STEP)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: a loss of executors costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of text bytes."""
    texts, size, begin = batch.column(1), 0, 0
    for i in range(len(batch)):
        size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
        if size > 6 * WORDS_AT_ONCE or i + 1 == len(batch):
            yield batch.slice(begin, i + 1 - begin)
            size, begin = 0, i + 1


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest, bands) of the rows (id, text, digest): shingles and band hashes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in (b for x in batches for b in _batches(x)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            shingle, doc = shingler(texts)
            found = band_hashes(signatures(shingle, doc, len(texts), bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.bincount(doc, minlength=len(texts))), batch.column(2),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(found.ravel()))],
                names=["id", "n", "digest", "bands"])
        del shingler
        release_memory()

    return docs.mapInArrow(work, "id long, n long, digest binary, bands array<long>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, elements): the shingle multisets of the rows (id, text)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in (b for x in batches for b in _batches(x)):
            shingle, doc = shingler([t or "" for t in batch.column(1).to_pylist()])
            cut = np.searchsorted(doc, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_set(shingle[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                names=["id", "elements"])
        del shingler
        release_memory()

    return docs.mapInArrow(work, "id long, elements binary")


def _verified(pairs: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """(src, dst): the pairs (a, b) that are similar enough."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b, sa, sb = (x.column(i) for i in range(4))
            keep = np.array([similarity(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) >= least
                             for p, q in zip(sa, sb)], bool)
            yield pa.RecordBatch.from_arrays([a, b], names=["src", "dst"]).filter(pa.array(keep))

    joined = pairs.join(elements.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b") \
        .join(elements.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
    return joined.select("a", "b", "ea", "eb").mapInArrow(work, "src long, dst long")


def _rest(members: DataFrame, elements: DataFrame, least: float, block: int) -> DataFrame:
    """(src, dst): links between different components of the buckets in
    ``members`` (bucket, id, comp), each of which holds several components."""
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("total"),
                                       F.sum("n").alias("all_n"), F.max("n").alias("main_n"))
    m = members.join(main, "bucket").withColumn("blocks", F.ceil(F.col("total") / block)) \
        .withColumn("open_blocks", F.ceil((F.col("total") - F.col("main_n")) / block))
    # members outside of the main component are dealt over open_blocks; every open block meets every block of all members
    is_open = F.col("comp") != F.col("main")
    place = F.pmod(F.xxhash64("id"), F.col("blocks"))
    everyone = m.select("bucket", "id", "comp", F.lit(False).alias("open"), place.alias("y"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("open_blocks") - 1)).alias("x"))
    opened = m.where(is_open).select("bucket", "id", "comp", F.lit(True).alias("open"),
                                     F.pmod(F.xxhash64("id"), F.col("open_blocks")).alias("x"),
                                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("y"))
    rows = everyone.select("bucket", "x", "y", "id", "comp", "open").unionByName(opened.select("bucket", "x", "y", "id", "comp", "open"))
    rows = rows.join(elements, "id")

    def work(f: pd.DataFrame) -> pd.DataFrame:
        comp, ids, is_open = f["comp"].to_numpy(), f["id"].to_numpy(), f["open"].to_numpy()
        e = [np.frombuffer(x, np.uint64) for x in f["elements"]]
        n = np.array([len(x) for x in e])
        other = np.flatnonzero(~is_open)
        out = []
        if len(other) and is_open.any():
            # postings: the members that hold each element, so that one count gives all overlaps of a member
            flat, who = np.concatenate([e[j] for j in other]), np.repeat(np.arange(len(other)), n[other])
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            for i in np.flatnonzero(is_open):
                start, end = np.searchsorted(flat, e[i], "left"), np.searchsorted(flat, e[i], "right")
                some = end > start
                held = np.concatenate([who[a:b] for a, b in zip(start[some], end[some])]) if some.any() else who[:0]
                both = np.bincount(held, minlength=len(other))
                near = np.flatnonzero((both >= least * (n[i] + n[other] - both)) & (comp[other] != comp[i]))
                _, first = np.unique(comp[other[near]], return_index=True)        # one link to a component is enough
                out += [(ids[i], ids[j]) for j in other[near[first]]]
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return rows.groupBy("bucket", "x", "y").applyInPandas(work, "src long, dst long").distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def _graph(base: DataFrame, size: int, least: float, bands: int, rows: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, digest, key, n) and the vertices (key, rep, comp) of the rows
    (id, text, digest): the key is the digest of a text, or the id of a text
    without a word; rep is the smallest id of a key."""
    key = F.when(F.col("n") > 0, F.col("digest")).otherwise(F.unhex(F.hex("id")))      # 16 bytes or at most 8
    seen = _written(sketch(base, size, bands, rows).withColumn("key", key), "sketch")
    full = seen.where(F.col("key").isNotNull())
    # equal texts are one vertex; its number is fixed as it is written
    firsts = full.groupBy("key").agg(F.min("id").alias("rep"), F.first("digest").alias("digest"), F.first("n").alias("n"),
                                     F.first("bands").alias("bands"))
    firsts = _written(firsts.withColumn("v", F.monotonically_increasing_id()), "vertices")
    spread = firsts.where(F.col("n") > 0).select(F.col("v").alias("id"), "n", F.explode(F.array_distinct("bands")).alias("bucket"))
    leader = spread.groupBy("bucket").agg(F.min("id").alias("lead"), F.min_by("n", "id").alias("lead_n"),
                                          F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    met = _written(spread.join(leader, "bucket").select("bucket", "id", "n", "lead", "lead_n", "m"), "buckets")
    near = F.least("n", "lead_n") >= least * F.greatest("n", "lead_n")
    pairs = met.where((F.col("id") != F.col("lead")) & near).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    # multisets of the texts that any bucket holds with another, each from a row of its smallest id
    some = met.select("id").distinct()
    wanted = firsts.join(some, firsts["v"] == some["id"], "left_semi").select("v", F.col("rep").alias("_rep"), F.col("digest").alias("_digest"))
    wanted = base.join(wanted, base["id"].eqNullSafe(wanted["_rep"]) & (base["digest"] == wanted["_digest"])) \
        .select(F.col("v").alias("id"), "text").dropDuplicates(["id"])
    elements = _written(sets(wanted, size), "sets")
    # different keys under one id: each is linked with the smallest
    several = full.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")) \
        .where(F.col("lo") < F.col("hi")).select("id", "lo")
    twins = full.select("id", "key").join(several, "id").where(F.col("key") != F.col("lo")).select("lo", "key").distinct()
    twins = _written(twins.join(firsts.select("key", F.col("v").alias("dst")), "key")
                     .join(firsts.select(F.col("key").alias("lo"), F.col("v").alias("src")), "lo").select("src", "dst"), "twins")
    links = _written(_verified(pairs, elements, least).unionByName(twins), "links")
    some = some.union(twins.select("src")).union(twins.select("dst")).distinct()
    comp = _written(connected_components(links, some), "components").select("id", F.col("component").alias("comp"))
    # what is left: buckets of three and more members in several components
    members = met.where(F.col("m") > 2).select("bucket", "id").join(comp, "id")
    several = members.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where(F.col("c0") < F.col("c1"))
    left = _written(_rest(members.join(several.select("bucket"), "bucket", "left_semi"), elements, least, block), "rest")
    if left.limit(1).count():
        # links between components: a small graph whose vertices are components
        a, b = comp.select(F.col("id").alias("src"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("dst"), F.col("comp").alias("cb"))
        between = left.join(a, "src").join(b, "dst").select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct()
        ends = between.select(F.col("src").alias("id")).union(between.select("dst")).distinct()
        joined = connected_components(between, ends).select(F.col("id").alias("comp"), F.col("component").alias("to"))
        comp = comp.join(joined, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    vertices = firsts.select("key", "rep", F.col("v").alias("id")).join(comp, "id", "left").select("key", "rep", F.coalesce("comp", "id").alias("comp"))
    return seen.select("id", "digest", "key", "n"), _written(vertices, "classes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY,
            bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, class_id, n_shingles) per row: class_id is the smallest id of the class."""
    seen, vertices = _graph(_rows(docs, id_col, text_col), size, least, bands, rows, block)
    smallest = vertices.groupBy("comp").agg(F.min("rep").alias("class_id"))
    found = vertices.join(smallest, "comp").select("key", "class_id")
    return seen.join(found, "key", "left").select("id", "class_id", F.col("n").alias("n_shingles"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY,
               bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row of each class, with all columns: of its smallest id (null is
    the largest) and that id's smallest digest, one of the equal rows. Rows
    with neither an id nor a word stay."""
    seen, vertices = _graph(_rows(docs, id_col, text_col), size, least, bands, rows, block)
    different = seen.where(F.col("key").isNotNull()).groupBy("id", "digest", "key").agg(F.count(F.lit(1)).alias("m")) \
        .join(vertices.select("key", "comp"), "key")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "digest")
    winner = different.groupBy("comp").agg(F.min(place).alias("first"))
    first = (F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "digest") == F.col("first")).alias("is_first")
    # rows that go or repeat; of the repeated rows that are first in their class one comes back
    moved = _written(different.join(winner, "comp").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), first, "m")
                     .where(~F.col("is_first") | (F.col("m") > 1)), "moved")
    digest = free_name(docs, "_text_digest")
    keyed = docs.withColumn(digest, F.unhex(F.md5(F.col(text_col).cast("binary"))))

    def same(other: DataFrame):
        return keyed[id_col].cast("long").eqNullSafe(other["_id"]) & keyed[digest].eqNullSafe(other["_digest"])

    repeated = moved.where("is_first")
    one = keyed.join(repeated, same(repeated), "left_semi")
    number = free_name(docs, "_row_id")
    one = one.withColumn(number, F.col(id_col).cast("long")).dropDuplicates([number, digest]).drop(number)
    return keyed.join(moved, same(moved), "left_anti").unionByName(one).select(*docs.columns)
