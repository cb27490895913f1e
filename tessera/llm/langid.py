"""Operator 10: language spans by script ranges and Viterbi.

A naive-Bayes table of character n-grams and whole words gives every distinct
word a log-probability per language. The scripts of a word's letters (Unicode
ranges) first narrow the languages down to those that were seen in that
script. Viterbi over the words of a text, with a penalty for every switch,
then labels spans of one language; the language with most letters is the
text's prediction and its share of letters the score.

Training: ``train_rows`` labelled rows of each language at most (those with the smallest
hashes of id and text, so that rows without an id differ) are counted in Spark; what
reaches the driver is a table of ``buckets`` counts per language. Everything else covers all rows.

Semantics: null texts and texts without a letter are ``und`` with score 0 and
no spans; equal shares go to the first language in alphabetical order; with no
training rows everything is ``und``. Repeated rows are scored alike. Input
columns named like an output column give way to it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import release_memory, without

BUCKETS = 1 << 17
LONGEST_GRAM = 4
TRAIN_ROWS = 500               # of each language
SWITCH = 12.0                  # log-probability that a change of language has to gain
WORDS_AT_ONCE = 1_000_000      # words labelled together by one worker
TEXTS_AT_ONCE = 512            # texts of a batch that are Python strings together
NEW_AT_ONCE = 1 << 14          # new words cut into n-grams together
WORD_CACHE = 200_000           # distinct words remembered by one worker before the cache starts anew

SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

#: First and last code point of script blocks.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF)],
}
_NAMES = list(SCRIPTS)
_WORDS = re.compile(r"[^\W\d_]+").findall


def script(word: str) -> int:
    """Number of the script of a word's first listed letter (one past the last: none listed)."""
    for c in word:
        at = ord(c)
        for i, name in enumerate(_NAMES):
            if any(a <= at <= b for a, b in SCRIPTS[name]):
                return i
    return len(_NAMES)


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (buckets, numbers of the words) of all n-grams of lower-case
    words with a border on both sides."""
    text = "".join([f"\x02{w.lower()}\x03" for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(code == 2) - 1
    h = np.zeros(len(code), np.uint64)
    for n in range(1, 1 + min(LONGEST_GRAM, len(code))):
        h = h[:len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1:] + np.uint64(n)
        own = np.flatnonzero(word[:len(h)] == word[n - 1:])
        x = h[own]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        yield ((x >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64), word[own]


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          train_rows: int = TRAIN_ROWS) -> dict:
    """Counts of buckets and scripts per label over a bounded sample of the
    rows of every label; a null text counts as the empty one."""
    rows = docs.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("_h"))
    # hashes are sorted, not texts, and a map task keeps train_rows of a language at most
    first = Window.partitionBy("label").orderBy("_h")
    picked = rows.select("label", "_h").distinct().withColumn("_n", F.row_number().over(first)) \
        .where(F.col("_n") <= train_rows).select("label", "_h")
    sample = rows.join(F.broadcast(picked), ["label", "_h"]).dropDuplicates(["label", "_h"]).select("label", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}                    # words of the sample, whose rows are bounded
        for f in frames:
            for label, text in zip(f["label"], f["text"]):
                seen.setdefault(label, Counter()).update(_WORDS(text.lower()))
        for label, found in seen.items():
            words, n = list(found), np.fromiter(found.values(), np.float64, len(found))
            c = np.zeros(BUCKETS + len(_NAMES) + 1)
            for bucket, word in _grams(words):
                c[:BUCKETS] += np.bincount(bucket, n[word], BUCKETS)
            c[BUCKETS:] = np.bincount([script(w) for w in words], n, len(_NAMES) + 1)
            yield pd.DataFrame({"label": [label], "counts": [c.tobytes()]})

    total: dict[str, np.ndarray] = {}
    # few tasks, each a table per label: labels x tables reach the driver, whatever the corpus
    for r in sample.repartition(6).mapInPandas(count, "label string, counts binary").toLocalIterator():
        total[r["label"]] = total.get(r["label"], 0) + np.frombuffer(bytes(r["counts"]))
    labels = sorted(total)
    if not labels:
        return {"labels": [], "log": np.zeros((BUCKETS, 0), np.float32), "allowed": np.zeros((len(_NAMES) + 1, 0), bool)}
    c = np.stack([total[x][:BUCKETS] for x in labels], 1)
    sums = c.sum(0)                                     # of equal weight, so that a language of few rows isn't outvoted
    c = c * (sums.max() / np.maximum(sums, 1)) + 0.5
    seen = np.stack([total[x][BUCKETS:] for x in labels], 1)
    share = seen / np.maximum(seen.sum(0), 1)
    allowed = share > 1e-3
    allowed[~allowed.any(1)] = True                     # a script of no language narrows nothing down
    return {"labels": labels, "log": np.log(c / c.sum(0)).astype(np.float32), "allowed": allowed}


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best state of every word; ``scores`` holds the texts one after another.
    All texts advance together, one word a step."""
    n, k = scores.shape
    states = np.zeros(n, np.int32)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    state = np.int8 if k <= 1 << 7 else np.int32
    back = np.zeros((n, k), state)
    best = np.zeros((len(lengths), k), np.float32)
    stay = np.arange(k, dtype=state)
    for t, m in enumerate(live):
        at, v = starts[:m] + t, best[:m]
        if t:
            top = v.argmax(1)
            change = v[np.arange(m), top] - np.float32(switch)
            moved = change[:, None] > v
            back[at] = np.where(moved, top[:, None].astype(state), stay)
            v = np.maximum(v, change[:, None])
        v = v + scores[at]
        best[:m] = v - v.max(1, keepdims=True)
    now = best.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = starts[:m] + t
        states[at] = now[:m]
        now[:m] = back[at, now[:m]]
    return states


def identify(docs: DataFrame, model: dict, text_col: str = "text", switch: float = SWITCH,
             names: tuple[str, str, str] = ("lang_pred", "score", "lang_spans"), keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text, unless kept) with the prediction, its score
    and the spans (array of first word, word after the last, language)."""
    docs = without(docs, *names)
    shared = docs.sparkSession.sparkContext.broadcast(model)     # labels x buckets numbers
    keep = [c for c in docs.columns if keep_text or c != text_col]
    read, text_at = (keep, keep.index(text_col)) if keep_text else ([*keep, text_col], len(keep))
    schema = T.StructType([docs.schema[c] for c in keep]).add(names[0], "string").add(names[1], "double") \
        .add(names[2], T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("lang", "string")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels, log, allowed = m["labels"], m["log"], m["allowed"]
        known: dict[str, int] = {}
        table = np.zeros((0, len(labels)), np.float32)

        def scored(new: list[str]) -> np.ndarray:
            """Scores of words, the best allowed language at 0."""
            out = np.zeros((len(new), len(labels)))
            for s in range(0, len(new), NEW_AT_ONCE):
                part = new[s:s + NEW_AT_ONCE]
                for bucket, word in _grams(part):
                    for j in range(len(labels)):
                        out[s:s + len(part), j] += np.bincount(word, log[bucket, j], len(part))
            may = allowed[np.fromiter(map(script, new), np.int64, len(new))]
            out = np.where(may, out, -np.inf)
            out = np.maximum(out - out.max(1, keepdims=True), -1e3)
            return out.astype(np.float32)

        for f in batches:
            rows, fresh, size, begin = [], [], 0, 0
            texts = (text for s in range(0, f.num_rows, TEXTS_AT_ONCE) for text in f.column(text_at).slice(s, TEXTS_AT_ONCE).to_pylist())
            for i, text in enumerate(texts):
                words = _WORDS(text) if text and labels else []
                for w in set(words).difference(known):
                    known[w] = len(known)
                    fresh.append(w)
                rows.append((np.fromiter(map(known.__getitem__, words), np.int32, len(words)),
                             np.fromiter(map(len, words), np.int32, len(words))))
                size += len(words)
                if size >= WORDS_AT_ONCE or i + 1 == f.num_rows:
                    n = np.array([len(x) for x, _ in rows])
                    flat = np.concatenate([x for x, _ in rows])
                    if fresh:
                        table = np.concatenate([table, scored(fresh)])
                    states = viterbi(table[flat], n, switch) if size else flat
                    letters = np.concatenate([x for _, x in rows])
                    pred, share, spans, at = [], [], [], 0
                    for k in n:
                        if not k:
                            pred.append("und"), share.append(0.0), spans.append([])
                            continue
                        s = states[at:at + k]
                        per = np.bincount(s, letters[at:at + k], len(labels))
                        cut = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), int(k)]
                        pred.append(labels[int(per.argmax())]), share.append(float(per.max() / per.sum()))
                        spans.append([{"start": a, "end": b, "lang": labels[s[a]]} for a, b in zip(cut, cut[1:])])
                        at += k
                    own = [f.column(j).slice(begin, i + 1 - begin) for j in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(spans, SPANS)],
                        names=schema.names)
                    rows, fresh, size, begin = [], [], 0, i + 1
                    if len(known) > WORD_CACHE:
                        known.clear()
                        table = table[:0]
        del known, table
        release_memory()

    return docs.select(*read).mapInArrow(work, schema)
