"""Operator 13: token ids in Parquet files that can be read in parts.

A folder of token files holds one row per document in ascending id order: its id,
its number of tokens, the number of tokens before it in its part, and the ids as a list
column. Ids are dictionary encoded (a vocabulary fits one dictionary page), the
sorted numbers delta encoded; row groups and pages are of a given size and every
page has an entry in the page index. So lengths are read without touching ids
(:func:`lengths`), single documents (:func:`documents`) and stretches of the whole token
stream (:func:`stretch`) by reading the pages that hold them. A document's place in the
stream is its place in the part plus the tokens of all parts before, which
:func:`parts` sums from the lengths.

Texts are ordered first (one shuffle of texts) and encoded in order by the tasks
that write, so nothing is encoded twice and ids are never shuffled.

Encoding is the tokenizers library's. For byte-level files it splits a text at
every single space or line feed between two other characters, whatever stands
around; so a task has the library encode each distinct unit between such places
once and remembers it. Other texts and files go through the library as they are.

Semantics: a null text is the empty text, of which only the end id is written;
null ids come first; rows of one id follow each other in the order of their texts' hashes and
get places of their own; other columns are not written. An empty table gives a
folder without rows."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import release_memory

UNITS = 1_000_000         # units that one worker remembers
LONG_UNIT = 64            # longer ones are not remembered
MARKS = ".,;:!?"          # told off the end of a unit
BLOCK = 1 << 16           # characters that the library takes at once
LINE = 1 << 20            # characters that are split at once
CHARS = 4 << 20           # characters of texts whose unknown units are encoded together, about

_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Units(dict):
    """Remembered units, and those of the texts at hand beside them."""
    rest: dict[str, bytes | None] = {}

    def __missing__(self, unit: str) -> bytes | None:
        return self.rest[unit]


class UnitEncoder:
    """The tokenizers library behind a memory of units; ids as little-endian unsigned 32-bit numbers.

    A unit is a word with what hangs on it; one that starts a line carries the
    line feed before it, any other follows a space."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        file = json.loads(spec)
        pre = file.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in file.get("added_tokens") or []]
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") \
            and not file.get("normalizer") and not any(re.search(r"\s", t) for t in self.added) \
            and not any(t.get("lstrip") or t.get("rstrip") for t in file.get("added_tokens") or [])
        self.known = _Units()
        self.feed = len(self.whole("\n"))
        self.marks = {c: self.whole(c) for c in MARKS}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Units that the library encodes together, each after a space or its line feed."""
        at, size = 0, 0
        spelt = [u if u[0] == "\n" else " " + u for u in units]
        for end, u in enumerate(spelt, 1):
            size += len(u)
            if size < BLOCK and end < len(units):
                continue
            got = self.library.encode("".join(spelt[at:end]), add_special_tokens=False)
            ids = got.ids
            starts = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids))
            data = np.asarray(ids, "<u4").tobytes()
            cuts = (np.searchsorted(starts, np.cumsum([0, *map(len, spelt[at:end])])) * 4).tolist()
            yield from zip(units[at:end], map(data.__getitem__, map(slice, cuts, cuts[1:])))
            at, size = end, 0

    def _learn(self, new: set[str]) -> None:
        """Ids of unknown units; None for those that can't be taken out of their text."""
        known, marks = self.known, self.marks
        known.rest = found = {}
        marked, plain = [], set()
        for u in new:
            core = u[1:] if u[:1] == "\n" else u
            if not core or core[0].isspace() or core[-1].isspace():
                found[u] = None
            elif core[-1] in marks and core[-2:-1].isalpha():            # a mark after a letter is a piece of its own
                marked.append(u)
                if u[:-1] not in known:
                    plain.add(u[:-1])
            else:
                plain.add(u)
        found.update(self._encoded(list(plain)))
        found.update([(u, known[u[:-1]] + marks[u[-1]]) for u in marked])
        if len(known) < UNITS:                                           # frequent units come early
            known.update([(u, x) for u, x in found.items() if x is not None and len(u) <= LONG_UNIT])

    def _odd(self, text: str) -> bytes:
        if not self.cuts or len(text) <= BLOCK:
            return self.whole(text)
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + BLOCK)
            end = cut.start() if cut else len(text)
            out.append(self.whole(text[at:end]))
            at = end
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        # every unit after a space; the line feed put before the text goes again
        rows = [("\n" + t).replace("\n", " \n")[1:] if self.cuts and t and not any(x in t for x in self.added) else None for t in texts]
        units: set[str] = set()
        for row in rows:
            for block in _blocks(row):
                units.update(block)
        self._learn({u for u in units if u not in self.known})
        get, out = self.known.__getitem__, []
        for text, row in zip(texts, rows):
            try:
                out.append(b"".join([b"".join(map(get, block)) for block in _blocks(row)])[self.feed:] if row else self._odd(text) if text else b"")
            except TypeError:                                              # white space that isn't single
                out.append(self._odd(text))
        return out


def _blocks(row: str | None) -> Iterator[list[str]]:
    """Units of a text, those of some characters at a time."""
    at = 0
    while row and (cut := row.find(" ", at + LINE)) > 0:
        yield row[at:cut].split(" ")
        at = cut + 1
    if row:
        yield row[at:].split(" ")


_ENCODERS: dict[int, UnitEncoder] = {}


def _encoder(spec: str) -> UnitEncoder:
    """The encoder of this worker, which Spark keeps for later tasks."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = UnitEncoder(spec)
    return _ENCODERS[key]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10, page_rows: int = 1000, files: int | None = None) -> None:
    """Write the token files of all documents; ``tokenizer`` is a file of the tokenizers library."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(spec.value), 0
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            for at in (cuts := np.unique([0, *np.searchsorted(ends, range(CHARS, int(ends[-1]) if len(ends) else 0, CHARS))]).tolist()):
                some = batch.slice(at, next((c for c in cuts if c > at), batch.num_rows) - at)
                data = [x + end for x in encoder.encode(some.column(1).to_pylist())]
                sizes = np.asarray([len(x) // 4 for x in data], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), pa.array(before + offsets[:-1]), ids],
                                                 names=["doc_id", "n_tokens", "part_start", "ids"])
                before += int(offsets[-1])
        release_memory()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("salt"))       # rows of one id may need more than one part
    order = ["doc_id", "tie", "salt"]
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text") \
        .mapInArrow(encode, "doc_id long, n_tokens long, part_start long, ids array<int>").write \
        .option("compression", "zstd").option("parquet.writer.version", "v2") \
        .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows) \
        .option("parquet.dictionary.page.size", 1 << 20).option("parquet.enable.dictionary", "true") \
        .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#part_start", "false").parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return spark.read.schema("doc_id long, n_tokens long, part_start long, ids array<int>").parquet(path).withColumn("part", number)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, rows, tokens, first_token): one row a part, from lengths only."""
    sums = _files(spark, path).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # as many rows as parts
    return sums.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _placed(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    first = parts(spark, path).select("part", "first_token")
    return _files(spark, path).join(F.broadcast(first), "part") \
        .select("doc_id", (F.col("first_token") + F.col("part_start")).alias("start"), "n_tokens", *columns)


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading ids."""
    return _placed(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents."""
    return _placed(spark, path, "ids")


def documents(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """Rows of :func:`read` of some documents; the page index leads to their pages."""
    return read(spark, path).where(F.col("doc_id").isin(*doc_ids))


def stretch(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The tokens ``low`` to ``high`` - 1 of the whole stream, as (start, ids) pieces of documents."""
    held = parts(spark, path).where((F.col("first_token") < high) & (F.col("first_token") + F.col("tokens") > low)) \
        .agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min("first_token").alias("t")).first()
    if held["a"] is None or low >= high:
        return read(spark, path).where("false").select("start", "ids")
    # documents of the first and the last part that can't reach into the stretch are told by their place in the part
    rows = _files(spark, path).where(F.col("part").between(held["a"], held["b"])) \
        .where((F.col("part") != held["a"]) | (F.col("part_start") + F.col("n_tokens") > low - held["t"]))
    first = parts(spark, path).select("part", "first_token")
    rows = rows.join(F.broadcast(first), "part").withColumn("start", F.col("first_token") + F.col("part_start"))
    rows = rows.where((F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low))
    skip, end = F.greatest(F.lit(low) - F.col("start"), F.lit(0)), F.least(F.lit(high) - F.col("start"), F.col("n_tokens"))
    return rows.select((F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), (end - skip).cast("int")).alias("ids"))


def checksums(rows: DataFrame, ids_col: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """``rows`` with an unsigned crc32 of the ids as little-endian unsigned 32-bit numbers in place of them."""
    keep = [c for c in rows.columns if c not in (ids_col, out)]
    at = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            data = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            ends = column.offsets.to_numpy().astype(np.int64) * 4
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sums, pa.int64())], names=[*keep, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.select(*keep, ids_col).mapInArrow(work, f"{fields}, `{out}` long")
