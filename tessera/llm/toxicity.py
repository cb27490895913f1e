"""Operator 1: toxicity by a bidirectional gated recurrent network.

A word is read twice: as a whole (an embedding for words of the training
sample, one shared embedding for all others) and by its characters (a small
bidirectional gated recurrent network with attention pooling). A second such
network reads the words of a window, attention pooling and a logistic unit give
the window's score. Every text is scored over all its overlapping windows (the
whole text, whatever its length); its score is that of the highest window.

Training is numpy with Adam on a bounded sample: ``positives`` and ``negatives``
labelled texts at most (smallest hashes of the id) with ``windows_per_text``
windows each at most (chosen by hash over the whole text). A label belongs to a
text, not to a window, so each round of training picks windows: first those
whose words and character n-grams speak most for the label by their counts, then
those that the network itself scores highest, and random windows of
clean texts.

Semantics: null texts count as empty; a text without a word is one empty window and
gets the network's score for it; without labelled rows of both kinds every text scores 0;
repeated rows score alike; input columns named like an output column give way to it. Words over 16 letters are read in parts of 16."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import without

WINDOW, STRIDE = 32, 16
POSITIVES, NEGATIVES, WINDOWS_PER_TEXT = 800, 2400, 64
CHARS, CHAR_DIM, CHAR_H = 512, 10, 10
WORD_DIM, WORD_H = 10, 12
OWN_WORD = 10                       # texts of the sample that must hold a word for it to get its own embedding
LETTERS = 16
WINDOWS_AT_ONCE = 1024              # windows read together: their inputs stay near the processor
WINDOWS_HELD = 32768                # windows of whole texts gathered before they are read
WORD_CACHE = 150_000
_words = re.compile(r"[^\W\d_]{1,%d}" % LETTERS).findall


def tokens(text: str | None) -> list[str]:
    return _words((text or "").lower())


def window_starts(n: int) -> range:
    """Starts of the windows of a text of n words: all words are covered, neighbours overlap."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else range(1)


# ---------------------------------------------------------------- network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gru_weights(rng: np.random.Generator, inputs: int, hidden: int) -> dict[str, np.ndarray]:
    """One direction: columns are update, reset and candidate."""
    return {"W": rng.normal(0, 1 / np.sqrt(inputs), (inputs, 3 * hidden)), "U": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)),
            "b": np.zeros(3 * hidden)}


def _gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """States [t, n, h] for projected inputs [t, n, 3h]; masked places keep the state."""
    t, n, h3 = x.shape
    h = h3 // 3
    state = np.zeros((n, h), x.dtype)
    out = np.empty((t, n, h), x.dtype)
    past = []
    for i in range(t):
        r_u = state @ u
        zr = _sigmoid(x[i, :, :2 * h] + r_u[:, :2 * h])
        z, r = zr[:, :h], zr[:, h:]
        cand = np.tanh(x[i, :, 2 * h:] + r * r_u[:, 2 * h:])
        m = mask[i][:, None]
        new = state + m * (1 - z) * (cand - state)
        if keep:
            past.append((state, z, r, cand, r_u[:, 2 * h:], m))
        state = out[i] = new
    return out, past


def _gru_back(d_out: np.ndarray, past: list, u: np.ndarray):
    """Gradients of the projected inputs and of u."""
    t, n, h = d_out.shape
    d_x, d_u = np.empty((t, n, 3 * h), d_out.dtype), np.zeros_like(u)
    d_state = np.zeros((n, h), d_out.dtype)
    for i in range(t - 1, -1, -1):
        state, z, r, cand, ru, m = past[i]
        d = d_out[i] + d_state
        d_cand = d * m * (1 - z) * (1 - cand ** 2)
        d_z = -d * m * (cand - state) * z * (1 - z)
        d_r = d_cand * ru * r * (1 - r)
        d_x[i] = np.concatenate([d_z, d_r, d_cand], 1)
        d_ru = np.concatenate([d_z, d_r, d_cand * r], 1)
        d_u += state.T @ d_ru
        d_state = d * (1 - m * (1 - z)) + d_ru @ u.T
    return d_x, d_u


def _attend(h: np.ndarray, mask: np.ndarray, p: dict, name: str):
    """Weighted mean of states [t, n, 2h] over t; places off the mask get no weight."""
    s = np.tanh(h @ p[name + "A"] + p[name + "a"])
    e = s @ p[name + "v"]
    e = np.where(mask > 0, e, -1e9)
    e = np.exp(e - e.max(0))
    a = e / e.sum(0)
    return (a[:, :, None] * h).sum(0), (s, a)


def _attend_back(d_pool: np.ndarray, h: np.ndarray, kept, p: dict, name: str, g: dict) -> np.ndarray:
    s, a = kept
    d_h = a[:, :, None] * d_pool
    d_a = (h * d_pool).sum(2)
    d_e = a * (d_a - (a * d_a).sum(0))
    d_s = d_e[:, :, None] * p[name + "v"] * (1 - s ** 2)
    g[name + "v"] += (d_e[:, :, None] * s).sum((0, 1))
    g[name + "a"] += d_s.sum((0, 1))
    g[name + "A"] += np.einsum("tni,tnj->ij", h, d_s)
    return d_h + d_s @ p[name + "A"].T


def _both(x: np.ndarray, mask: np.ndarray, p: dict, name: str, keep: bool = False):
    """Bidirectional states [t, n, 2h] of inputs projected to [t, n, 6h]."""
    h3 = x.shape[2] // 2
    f, pf = _gru(x[:, :, :h3], mask, p[name + "fU"], keep)
    b, pb = _gru(x[::-1, :, h3:], mask[::-1], p[name + "bU"], keep)
    return np.concatenate([f, b[::-1]], 2), (pf, pb)


def _both_back(d: np.ndarray, kept, p: dict, name: str, g: dict) -> np.ndarray:
    h = d.shape[2] // 2
    dxf, du = _gru_back(d[:, :, :h], kept[0], p[name + "fU"])
    g[name + "fU"] += du
    dxb, du = _gru_back(d[::-1, :, h:], kept[1], p[name + "bU"])
    g[name + "bU"] += du
    return np.concatenate([dxf, dxb[::-1]], 2)


def new_weights(words: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"chars": rng.normal(0, 0.5, (CHARS, CHAR_DIM)), "words": rng.normal(0, 0.1, (words + 1, WORD_DIM)), "out": np.zeros(2 * WORD_H),
         "bias": np.zeros(1)}
    for name, inputs, h in (("c", CHAR_DIM, CHAR_H), ("w", WORD_DIM + 2 * CHAR_H, WORD_H)):
        f, b = _gru_weights(rng, inputs, h), _gru_weights(rng, inputs, h)
        p |= {name + "W": np.concatenate([f["W"], b["W"]], 1), name + "b": np.concatenate([f["b"], b["b"]]), name + "fU": f["U"],
              name + "bU": b["U"], name + "A": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, h)), name + "a": np.zeros(h),
              name + "v": rng.normal(0, 1 / np.sqrt(h), h)}
    p["out"] = rng.normal(0, 0.3, 2 * WORD_H)
    return p


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(character numbers, mask), both [letters, words]."""
    n = max(map(len, words), default=1) or 1
    codes = np.frombuffer("".join([w.ljust(n, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = codes.reshape(len(words), n).T.astype(np.int64)
    return np.where(c < CHARS, c, c % 256 + 256), (c > 0).astype(np.float32)


def _spelled(p: dict, words: list[str], keep: bool = False):
    """Vectors of words by their characters."""
    c, mask = letters(words)
    x = p["chars"][c] @ p["cW"] + p["cb"]
    h, kept = _both(x, mask, p, "c", keep)
    pool, att = _attend(h, mask, p, "c")
    return pool, (c, mask, h, kept, att)


def word_inputs(p: dict, own: dict[str, int], words: list[str], at_once: int = 20_000) -> np.ndarray:
    """Projected inputs [words, 6h] of the window network, words by length."""
    out = np.empty((len(words), 6 * WORD_H), np.float32)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for i in range(0, len(order), at_once):
        part = order[i:i + at_once]
        some = [words[j] for j in part]
        v = np.concatenate([p["words"][[own.get(w, 0) for w in some]], _spelled(p, some)[0]], 1)
        out[part] = v @ p["wW"] + p["wb"]
    return out


def window_logits(p: dict, inputs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Logits of windows [n, WINDOW] of word numbers (-1: no word) over a table of projected inputs."""
    out = np.empty(len(windows), np.float32)
    blank = np.concatenate([inputs, np.broadcast_to(p["wb"].astype(np.float32), (1, inputs.shape[1]))])
    for i in range(0, len(windows), WINDOWS_AT_ONCE):
        w = windows[i:i + WINDOWS_AT_ONCE].T
        mask = (w >= 0).astype(np.float32)
        h, _ = _both(blank[w], mask, p, "w")
        pool, _ = _attend(h, mask, p, "w")
        out[i:i + WINDOWS_AT_ONCE] = pool @ p["out"] + p["bias"][0]
    return out


def _step(p: dict, own: dict[str, int], batch: list[list[str]], y: np.ndarray, rng) -> tuple[float, dict]:
    """Loss and gradients of a batch of windows."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    words = sorted({w for x in batch for w in x}) or ["\0"]
    at = {w: i for i, w in enumerate(words)}
    grid = np.full((WINDOW, len(batch)), -1)
    for j, x in enumerate(batch):
        grid[:len(x), j] = [at[w] for w in x]
    mask = (grid >= 0).astype(p["out"].dtype)
    spelled, (c, c_mask, c_h, c_kept, c_att) = _spelled(p, words, True)
    # now and then a word is read by its characters alone, so that these learn too
    number = np.array([own.get(w, 0) for w in words]) * (rng.random(len(words)) > 0.4)
    v = np.concatenate([p["words"][number], spelled], 1)
    x = (v @ p["wW"] + p["wb"])[grid]
    h, kept = _both(x, mask, p, "w", True)
    pool, att = _attend(h, mask, p, "w")
    q = _sigmoid(pool @ p["out"] + p["bias"][0])
    loss = -np.mean(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))
    d = ((q - y) / len(y)).astype(p["out"].dtype)
    g["out"], g["bias"] = pool.T @ d, np.array([d.sum()])
    d_h = _attend_back(d[:, None] * p["out"], h, att, p, "w", g)
    d_x = _both_back(d_h, kept, p, "w", g) * mask[:, :, None]
    per_word = np.zeros((len(words), d_x.shape[2]), d_x.dtype)
    real = grid >= 0
    np.add.at(per_word, grid[real], d_x[real])
    g["wW"], g["wb"] = v.T @ per_word, per_word.sum(0)
    d_v = per_word @ p["wW"].T
    np.add.at(g["words"], number, d_v[:, :WORD_DIM])
    d_ch = _attend_back(d_v[:, WORD_DIM:], c_h, c_att, p, "c", g)
    d_cx = _both_back(d_ch, c_kept, p, "c", g)
    flat = d_cx.reshape(-1, d_cx.shape[2])
    e = p["chars"][c].reshape(-1, CHAR_DIM)
    g["cW"], g["cb"] = e.T @ flat, flat.sum(0)
    np.add.at(g["chars"], c.ravel(), flat @ p["cW"].T)
    return float(loss), g


def _evidence(texts: list[list[list[str]]], y: np.ndarray) -> dict[str, float]:
    """Log-odds of words for the label by the texts that hold them, a word's
    own or those of its strongest character 4- or 5-gram."""
    @lru_cache(50_000)
    def grams(w: str) -> tuple[str, ...]:
        x = f"^{w}$"
        return (x, *(x[i:i + n] for n in (4, 5) for i in range(len(x) - n + 1)))

    clean, marked = Counter(), Counter()
    all_words: set[str] = set()
    for x, label in zip(texts, y):
        words = set().union(*x)
        all_words |= words
        (marked if label else clean).update(set().union(*map(grams, words)) if words else ())
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    odds = {k: log((marked[k] + 0.3) / n1) - log((clean[k] + 0.3) / n0) for k in {*marked, *(k for k, n in clean.items() if n >= 5)}
            if marked[k] + clean[k] >= 5}
    return {w: max((odds[k] for k in grams(w) if k in odds), default=0.0) for w in all_words}


def fit(texts: list[list[list[str]]], y: np.ndarray, rounds: int = 7, batch: int = 96, steps: int = 26, rate: float = 0.01, seed: int = 7) -> dict:
    """Weights from texts (lists of windows of words) and their labels."""
    rng = np.random.default_rng(seed)
    df = Counter(w for x in texts for w in set().union(*x))
    own = {w: i + 1 for i, w in enumerate(sorted(w for w, n in df.items() if n >= OWN_WORD))}
    p = new_weights(len(own), seed)
    p["bias"] = np.array([np.log(max(1, y.sum()) / max(1, (1 - y).sum()))])
    p = {k: a.astype(np.float32) for k, a in p.items()}
    odds = _evidence(texts, y)
    best = [int(np.argmax([sum(sorted((odds[w] for w in x), reverse=True)[:3]) for x in t])) for t in texts]
    mean = None
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    flat = [x for t in texts for x in t]
    first = np.cumsum([0, *map(len, texts)])
    words = sorted({w for x in flat for w in x})
    at = {w: i for i, w in enumerate(words)}
    grid = np.full((len(flat), WINDOW), -1)
    for i, x in enumerate(flat):
        grid[i, :len(x)] = [at[w] for w in x]
    for r in range(rounds):
        if r:                                              # the network's own choice from now on
            z = window_logits(p, word_inputs(p, own, words), grid)
            best = [int(z[a:b].argmax()) for a, b in zip(first, first[1:])]
        rows: list[tuple[list[str], float]] = []
        while len(rows) < steps * batch:                   # a small sample is read more than once in a round
            rows += [(t[i], label) for t, i, label in zip(texts, best, y)]
            rows += [(t[int(rng.integers(len(t)))], 0.0) for t, label in zip(texts, y) if not label and rng.random() < 0.4]
        order = rng.permutation(len(rows))[:steps * batch]
        for i in range(0, len(order), batch):
            part = [rows[j] for j in order[i:i + batch]]
            _, g = _step(p, own, [x for x, _ in part], np.array([label for _, label in part], float), rng)
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            lr = rate * min(1.0, 1.1 - r / rounds)
            for k, a in g.items():
                a = a * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            if r >= rounds // 2:                           # the mean of the later steps varies less than the last one
                mean = {k: a.copy() for k, a in p.items()} if mean is None else {k: 0.97 * mean[k] + 0.03 * a for k, a in p.items()}
    return {"weights": {k: a.astype(np.float32) for k, a in (mean or p).items()}, "own": own}


# ---------------------------------------------------------------- Spark

def sample_ids(labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", positives: int = POSITIVES,
               negatives: int = NEGATIVES) -> DataFrame:
    """(id, label) of the training sample: ``positives + negatives`` rows at
    most, those with the smallest hashes; an id with both labels takes no part."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col) \
        .agg(F.min(F.col(label_col).cast("int")).alias("_y"), F.max(F.col(label_col).cast("int")).alias("_z")) \
        .where(F.col("_y") == F.col("_z")).withColumn("_h", F.xxhash64(id_col))
    some = [ids.where(F.col("_y") == y).orderBy("_h", id_col).limit(n) for y, n in ((1, positives), (0, negatives))]
    return some[0].unionByName(some[1]).select(id_col, F.col("_y").alias(label_col))


def train(sample: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          windows_per_text: int = WINDOWS_PER_TEXT) -> dict | None:
    """A network fitted to the texts of a bounded sample (:func:`sample_ids`);
    None without rows of both labels. Repeated rows count once."""
    picked = sample.select(F.xxhash64(id_col).alias("h"), F.col(label_col).cast("int").alias("y"), F.col(text_col).alias("text")) \
        .dropDuplicates(["h"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, y, text in zip(f["h"], f["y"], f["text"]):
                words = tokens(text)
                starts = list(window_starts(len(words)))
                if len(starts) > windows_per_text:
                    starts = np.random.default_rng(h & 0x7FFFFFFF).choice(starts, windows_per_text, replace=False).tolist()
                out.append((h, y, ["\t".join(words[a:a + WINDOW]) for a in starts]))
            yield pd.DataFrame(out, columns=["h", "y", "windows"])

    rows = picked.mapInPandas(cut, "h long, y int, windows array<string>").orderBy("h").collect()
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return fit([[[w for w in x.split("\t") if w] for x in r["windows"]] for r in rows], y)


def score(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with score, n_windows and the first word of
    the highest window."""
    docs = without(docs, "score", "n_windows", "top_start")
    shared = docs.sparkSession.sparkContext.broadcast(model)          # a few thousand embeddings
    keep = [c for c in docs.columns if c != text_col]
    schema = T.StructType([docs.schema[c] for c in keep]).add("score", "double").add("n_windows", "long").add("top_start", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, int] = {}
        table = np.zeros((0, 6 * WORD_H), np.float32)
        for whole in batches:
            begin = 0
            while begin < len(whole) or begin == 0 and not len(whole):
                ids, starts, count, fresh = [], [], [], []
                end = begin
                while end < len(whole) and len(starts) < WINDOWS_HELD:
                    words = tokens(whole.column(len(keep))[end].as_py())
                    for w in set(words).difference(known):
                        known[w] = len(known)
                        fresh.append(w)
                    x = np.full(len(words) + WINDOW, -1, np.int64)
                    x[:len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    s = np.array(window_starts(len(words)))
                    ids.append(x)
                    starts.extend(s.tolist())
                    count.append(len(s))
                    end += 1
                n = np.array(count, np.int64)
                part = whole.slice(begin, end - begin)
                if m is None or not len(n):
                    top, where = np.zeros(len(n)), np.zeros(len(n), np.int64)
                else:
                    p, own = m["weights"], m["own"]
                    if fresh:
                        table = np.concatenate([table, word_inputs(p, own, fresh)])
                    base = np.cumsum([0, *map(len, ids[:-1])])
                    s = np.array(starts) + np.repeat(base, n)
                    grid = np.concatenate(ids)[s[:, None] + np.arange(WINDOW)]
                    z = window_logits(p, table, grid)
                    first = np.cumsum(n) - n
                    top = np.maximum.reduceat(z, first)
                    doc = np.repeat(np.arange(len(n)), n)
                    hit = np.flatnonzero(z == top[doc])[::-1]
                    where = np.zeros(len(n), np.int64)
                    where[doc[hit]] = np.array(starts)[hit]
                    top = _sigmoid(top.astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(top, pa.float64()), pa.array(n), pa.array(where)],
                                                 names=schema.names)
                begin = end
                if len(known) > WORD_CACHE:
                    known.clear()
                    table = table[:0]
                if not len(whole):
                    break

    return docs.select(*keep, text_col).mapInArrow(work, schema)
