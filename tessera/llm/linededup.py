"""Operator 5: line deduplication with a tree of line templates.

A line goes down a parse tree of fixed depth: its number of words, its first
``LEADING`` words, then ``PARTS`` equal parts of the remaining words. Words with
a digit are variable and become ``<*>`` on the way. Besides the branch of its
own words every line also takes, for each part, the branch where that part is
variable, so that lines that differ in one field only meet at the end of such
a path. The end of a path is a template. A template that lines of at least
``min_docs`` documents reach recurs: the document with the smallest id keeps its
lines, all other documents lose theirs. In lines under ``min_variable`` words a
part may be variable only if ``min_fixed`` words without a digit stay beside it.
A line under ``min_words`` words is its own template as a whole and recurs when
at least ``short_docs`` documents hold it, as two documents may share a
word or two by chance.

What is shuffled are hashes: one row per (template, document, line), then the
dropped lines of each document. Whole texts move once, to be joined with the
lines they lose. A template that a third of all documents share is pre-aggregated
(smallest id per map task); its rows are joined in a sort-merge join that
adaptive execution splits.

Semantics: null texts stay null and take no part, nor do rows without an id;
lines are separated by \\n and compared without surrounding white space; rows that
share an id count as one document; a document that loses nothing keeps its
exact text; one that loses every line becomes empty; an input column named like
the output column gives way to it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, without
from tessera.session import scratch_path

LEADING = 2
PARTS = 4
MIN_WORDS = 4
MIN_VARIABLE = 12
MIN_FIXED = 3                   # fixed words beside a variable part of a line under MIN_VARIABLE words
MIN_DOCS = 2
SHORT_DOCS = 8                  # documents that must share a line under MIN_WORDS words
_ALL, _ODD, _ANY = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0x94D049BB133111EB
#: An odd factor for each level of the tree.
_PLACES = [pow(_ODD, 2 * i + 1, 1 << 64) for i in range(PARTS + 1)]
_DIGIT = re.compile(r"\d")
_VARIABLE = re.compile(r"\S*\d\S*")
_hash = xxhash.xxh3_64_intdigest


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _finish(x: int) -> int:
    """Spreads the sum of the levels' hashes over all bits."""
    x &= _ALL
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & _ALL
    return x ^ x >> 32


def line_hash(line: str) -> int:
    return _signed(_hash(line.strip().encode("utf-8", "replace")))


def _words_of(line: str) -> list[str]:
    return (_VARIABLE.sub("<*>", line) if _DIGIT.search(line) else line).split()


def paths(line: str, min_words: int = MIN_WORDS, min_variable: int = MIN_VARIABLE, min_fixed: int = MIN_FIXED) -> list[int]:
    """Hashes of the templates at which a line arrives (none: a short line, see ``short_path``)."""
    words = _words_of(line)
    n = len(words)
    if n < min_words:
        return []
    lead, rest = words[:LEADING], words[LEADING:]
    cut = [len(rest) * i // PARTS for i in range(PARTS + 1)]
    parts = [rest[a:b] for a, b in zip(cut, cut[1:])]
    # a hash for each level, then one for each path of levels; the root's level holds the number of words
    own = [_hash(" ".join(x).encode("utf-8", "replace")) for x in (lead, *parts)]
    own[0] = (own[0] * _ODD + n) & _ALL
    step = [x * p & _ALL for x, p in zip(own, _PLACES)]
    whole = sum(step)
    ends = [_signed(_finish(whole))]
    if n >= min_variable:
        open_parts = range(1, PARTS + 1)
    else:
        fixed = n - words.count("<*>")
        open_parts = [i for i, x in enumerate(parts, 1) if x and fixed - (len(x) - x.count("<*>")) >= min_fixed]
    ends += [_signed(_finish(whole - step[i] + _PLACES[i] * _ANY)) for i in open_parts]
    return ends


def short_path(line: str, min_words: int = MIN_WORDS) -> int | None:
    """Hash of the template of a line of one to ``min_words`` - 1 words: all of its words."""
    words = _words_of(line)
    return _signed(_hash(" ".join(words).encode("utf-8", "replace"), seed=1)) if 0 < len(words) < min_words else None


def template(line: str) -> str:
    """A line's own template: digits generalised, white space as single blanks."""
    return " ".join(_VARIABLE.sub("<*>", line).split())


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                    min_variable: int = MIN_VARIABLE, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS,
                    min_fixed: int = MIN_FIXED) -> DataFrame:
    """(doc, line): hashes of the lines that each document loses."""
    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 500):
                doc, path, line, short = [], [], [], []
                for i, text in zip(f["doc"].iloc[at:at + 500], f["text"].iloc[at:at + 500]):
                    for x in set(map(str.strip, text.split("\n"))):
                        ends, is_short = paths(x, min_words, min_variable, min_fixed), False
                        if not ends:
                            whole = short_path(x, min_words)
                            ends, is_short = [] if whole is None else [whole], True
                        if ends:
                            h = line_hash(x)
                            doc += [i] * len(ends)
                            line += [h] * len(ends)
                            short += [is_short] * len(ends)
                            path += ends
                yield pd.DataFrame({"path": path, "doc": doc, "line": line}, dtype="int64").assign(short=np.array(short, bool))

    def recurring(rows: DataFrame, least: int) -> DataFrame:
        if least > 2:
            # the documents of a hot path are counted by (path, document) first
            return rows.select("path", "doc").distinct().groupBy("path").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")) \
                .where(F.col("n") >= least).select("path", "first")
        return rows.groupBy("path").agg(F.min("doc").alias("first"), F.max("doc").alias("last")) \
            .where(F.col("first") < F.col("last")).select("path", "first")

    # written once: it is both summed up and joined
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")) \
        .mapInPandas(walk, "path long, doc long, line long, short boolean")
    path = scratch_path(docs.sparkSession, "line_paths")
    rows.write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    shared = recurring(rows.where(~F.col("short")), min_docs).withColumn("short", F.lit(False)) \
        .unionByName(recurring(rows.where("short"), short_docs).withColumn("short", F.lit(True)))
    return rows.join(shared, ["path", "short"]).where(F.col("doc") > F.col("first")).select("doc", "line").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
          min_variable: int = MIN_VARIABLE, min_docs: int = MIN_DOCS, lost: str = "n_dropped", short_docs: int = SHORT_DOCS,
          min_fixed: int = MIN_FIXED) -> DataFrame:
    """``docs`` with the recurring lines cut out of the text and the number of
    dropped lines."""
    docs = without(docs, lost)
    hashes, key = free_name(docs, "_lost"), free_name(docs, "_doc")
    # as many hashes as a document has lines at most
    gone = recurring_lines(docs, id_col, text_col, min_words, min_variable, min_docs, short_docs, min_fixed) \
        .groupBy(F.col("doc").alias(key)).agg(F.collect_list("line").alias(hashes))
    fields = [*docs.schema.fields, T.StructField(lost, T.LongType(), False)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, count = [], []
            for t, out in zip(b.column(at).to_pylist(), b.column(len(docs_columns)).to_pylist()):
                n = 0
                if t is not None and out:
                    out = set(out)
                    lines = t.split("\n")
                    kept = [x for x in lines if line_hash(x) not in out]
                    n = len(lines) - len(kept)
                    t = "\n".join(kept)
                text.append(t)
                count.append(n)
            arrays = [pa.array(text, pa.string()) if i == at else b.column(i) for i in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(count, pa.int64())], names=[*docs_columns, lost])

    docs_columns, at = docs.columns, docs.columns.index(text_col)
    joined = docs.join(gone, docs[id_col].cast("long") == gone[key], "left").drop(key)
    return joined.mapInArrow(cut, T.StructType(fields))
