"""Operator 7: scores of a Brown class-based bigram model.

The probability of a word is that of its class after the class before, times
that of the word within its class. Counts cover all training rows:

1. Documents are packed into chunks of bounded text size as they are read:
   numbers of words, the chunk's distinct words and their training counts. The
   packed table is written once; one shuffle sums up the counts.
2. The ``frequent`` most frequent words are symbols of their own, all other
   words share ``endings`` symbols by a hash of their last bytes, and the end of
   a text is a symbol too. The bigram counts of symbols (a table of fixed size,
   whatever the corpus) are summed over all tasks.
3. Exchange clustering on that table gives the classes to start from: symbols
   move one at a time to the class that raises the likelihood most, until a sweep
   moves few.
4. Every chunk gets the counts of those of its words back that other chunks hold as
   well. From here on every word that occurs ``own_count`` times is clustered by
   itself: a sweep counts the classes before and after each word in the chunks, sums
   them up in parts of the words' hashes, and moves each word to its best class against
   the (broadcast) classes x classes table. Words of one sweep move at the same time, half
   of them in each sweep; a sweep that lowers the likelihood is not taken. Rarer and
   unknown words stay in the class of their ending.
5. The chunks, with the classes of their words, score their texts.

Smoothing: transitions are interpolated with class frequencies, emissions use
absolute discounting (the discount follows from the words seen once and
twice), what is taken off goes to the unknown words of the class, and the
class model is mixed with a discounted unigram. An unknown word of class c is
one event, as the unknown word is in the add-one base model.

Semantics: A-Z count as a-z; words are separated by ASCII white space; a null or
empty text is its end alone; rows with equal ids and texts are scored alike; with no
training rows every word is unknown and the score is the base score."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release_memory
from tessera.session import drop_table, scratch_path, shuffles_released

FREQUENT, ENDINGS, CLASSES = 1024, 511, 64
CHUNK_BYTES = 24_000_000
SWEEPS = 8
OWN_COUNT = 5                   # words that occur as often are clustered by themselves
FAN = 16                        # tables of bigrams that are added up in one group
LOOKUP = 4_000_000              # words clustered by themselves that may be broadcast
WORD_SWEEPS = 4                 # sweeps over all of these words at most
LEAST_GAIN = 1e-3               # of a sweep over all words, in nats a token
STEP = 300_000                  # tokens of whole texts that are counted or scored at a time
PART_WORDS = 200_000            # words of chunks in a part of the sums
ALPHA = 20.0                    # weight of class frequencies in a transition
CLASS_SHARE = 0.95              # weight of the class model against the unigram


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def symbol_of(frequent: dict[bytes, int], endings: int):
    """Symbol of a word: its own, or that of its ending."""
    base = len(frequent)

    def symbol(word: bytes) -> int:
        own = frequent.get(word)
        return base + zlib.crc32(word[-3:]) % endings if own is None else own

    return symbol


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every symbol from the counts pairs[before, after]: exchange
    clustering by the likelihood of the class bigram model."""
    s = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    k = min(classes, s)
    own = np.empty(s, np.int64)
    own[order] = np.arange(s) % k
    member = np.zeros((s, k))
    member[np.arange(s), own] = 1
    n = member.T @ pairs @ member
    left, right = pairs.T @ member, pairs @ member          # class counts before and after every symbol
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, self_n = own[w], pairs[w, w]
            before, after = left[w].copy(), right[w].copy()
            before[a] -= self_n
            after[a] -= self_n
            n[a, :] -= after
            n[:, a] -= before
            n[a, a] -= self_n
            gn = _g(n)
            rows, cols = n.sum(1) + before, n.sum(0) + after         # pairs with w count whatever its class
            gain = (_g(n + after) - gn).sum(1) + (_g(n + before[:, None]) - gn).sum(0)
            d = np.diag(n)
            gain += _g(d + after + before + self_n) - _g(d + after) - _g(d + before) + np.diag(gn)
            gain -= _g(rows + after.sum() + self_n) - _g(rows) + _g(cols + before.sum() + self_n) - _g(cols)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            n[b, :] += after
            n[:, b] += before
            n[b, b] += self_n
            if b != a:
                own[w] = b
                moved += 1
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
        if moved <= s // 500:
            break
    return own


PACKED = "chunk long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, words array<binary>, n array<int>"


def pack(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of the rows (id, held_out, text): one row each, with the texts as
    compressed word numbers (frequent words first), the distinct words and
    their counts in the texts that are not held out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, held, lengths, flat, at, size = [], [], [], array("I"), {}, 0

        def chunk() -> pa.RecordBatch:
            nonlocal made, size
            x, out = np.frombuffer(flat, np.uint32) if flat else np.zeros(0, np.uint32), np.repeat(held, lengths).astype(bool)
            order = np.argsort(-np.bincount(x, minlength=len(at)), kind="stable")
            place = np.empty(len(at), np.uint32)
            place[order] = np.arange(len(at), dtype=np.uint32)
            x = place[x]
            n = np.bincount(x[~out], minlength=len(at)).astype(np.int32)
            words = list(at)
            b = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([lengths], pa.list_(pa.int32())), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()),
                 pa.array([[words[i] for i in order]], pa.list_(pa.binary())), pa.array([n.tolist()], pa.list_(pa.int32()))],
                names=["chunk", "ids", "held", "lengths", "tokens", "words", "n"])
            made += 1
            size = 0
            for c in (ids, held, lengths, at):
                c.clear()
            del flat[:]
            return b

        for b in batches:
            for i, out, text in zip(*(c.to_pylist() for c in b.columns)):
                words = tokens(text)
                for w in set(words).difference(at):
                    at[w] = len(at)
                flat.extend(map(at.__getitem__, words))
                ids.append(i)
                held.append(out)
                lengths.append(len(words))
                size += len(text or "") + 16
                if size >= chunk_bytes:
                    yield chunk()
        if ids:
            yield chunk()
        release_memory()

    return rows.select("id", "held_out", "text").mapInArrow(work, PACKED)


def _unpacked(r: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, words of each text, held out) of a chunk."""
    length = np.asarray(r["lengths"], np.int64)
    x = pa.decompress(bytes(r["tokens"]), int(length.sum()) * 4, "zstd", asbytes=True)
    return np.frombuffer(x, np.uint32).astype(np.int64), length, np.asarray(r["held"], bool)


def _with_ends(x: np.ndarray, length: np.ndarray, end: int) -> np.ndarray:
    """Word numbers with an end after each text."""
    out = np.full(len(x) + len(length), end, np.int64)
    out[np.arange(len(x)) + np.repeat(np.arange(len(length)), length)] = x
    return out


def _bigrams(packed: DataFrame, frequent: dict[bytes, int], endings: int) -> np.ndarray:
    """Counts [before, after] of symbols over all training texts; the last
    symbol is the end, which also stands before the first word."""
    shared = packed.sparkSession.sparkContext.broadcast(frequent)     # FREQUENT words at most
    size = len(frequent) + endings + 1

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol = symbol_of(shared.value, endings)
        total = np.zeros(size * size, np.int64)
        for f in frames:
            for _, r in f.iterrows():
                x, length, held = _unpacked(r)
                own = np.fromiter(map(symbol, r["words"]), np.int64, len(r["words"]))
                now = _with_ends(own[x[~np.repeat(held, length)]], length[~held], size - 1)
                before = np.concatenate([[size - 1], now])[:-1]
                total += np.bincount(before * size + now, minlength=size * size)
        yield pd.DataFrame({"id": [TaskContext.get().partitionId()], "counts": [_packed(total)]})

    def summed(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size * size, np.int64)
        for x in f["counts"]:
            total += _opened(x, size * size, np.int64)
        return pd.DataFrame({"id": f["id"].iloc[:1], "counts": [_packed(total)]})

    left = packed.select("held", "lengths", "tokens", "words")
    tasks = left.rdd.getNumPartitions()
    parts = left.mapInPandas(count, "id long, counts binary")
    while tasks > 1:                                      # sums of some tasks, then sums of some sums
        parts = parts.withColumn("id", F.floor(F.col("id") / FAN)).groupBy("id").applyInPandas(summed, "id long, counts binary")
        tasks = -(-tasks // FAN)
    out = np.zeros(size * size, np.int64)
    for r in parts.collect():                             # one table of symbols
        out += _opened(bytes(r["counts"]), size * size, np.int64)
    return out.reshape(size, size).astype(float)


def likelihood(n: np.ndarray) -> float:
    """Of the class bigrams n[before, after], up to what no class changes."""
    return float(_g(n).sum() - _g(n.sum(0)).sum() - _g(n.sum(1)).sum())


def best_classes(word: np.ndarray, key: np.ndarray, count: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most if that word alone
    moves. Entries are (word, key, count), sorted by word; keys are the class after, k +
    the class before, and 2 k for the word itself after itself."""
    k, out = len(n), own.copy()
    step = 4000
    for begin in range(0, len(own), step):
        a = own[begin:begin + step].astype(np.int64)
        x, y = np.searchsorted(word, [begin, begin + len(a)])
        each, dense = np.arange(len(a)), np.zeros((len(a), 2 * k + 1))
        dense[word[x:y] - begin, key[x:y]] = count[x:y]
        after, before, same = dense[:, :k], dense[:, k:2 * k], dense[:, 2 * k]
        gain = np.zeros((len(a), k))
        for own_side, other_side, table in ((after, before, n.T), (before, after, n)):
            w, c = np.nonzero(own_side)
            for at in range(0, len(w), 20_000):
                v, d = w[at:at + 20_000], c[at:at + 20_000]
                # counts between every class and d, without the word in its own class
                base, m = table[d].copy(), own_side[v, d]
                base[np.arange(len(v)), a[v]] -= m
                in_own = np.flatnonzero(d == a[v])
                base[in_own] -= other_side[v[in_own]]
                base[in_own, d[in_own]] -= same[v[in_own]]
                term = _g(base + m[:, None]) - _g(base)
                start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                gain[v[start]] += np.add.reduceat(term, start, axis=0)
        d = np.tile(np.diag(n), (len(a), 1))
        d[each, a] -= after[each, a] + before[each, a] + same
        gain += _g(d + after + before + same[:, None]) - _g(d + after) - _g(d + before) + _g(d)
        for total, side in ((n.sum(1), after), (n.sum(0), before)):
            size, t = side.sum(1) + same, np.tile(total, (len(a), 1))
            t[each, a] -= size
            gain -= _g(t + size[:, None]) - _g(t)
        best = gain.argmax(1)
        better = gain[each, best] > gain[each, a] + 1e-9
        out[begin:begin + step] = np.where(better, best, a)
    return out


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def _opened(x: bytes, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, size * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


READY = "chunk long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, c binary, symbol binary, at binary, hash binary, " \
        "n_words long, n_own long"


def ready(packed: DataFrame, back: DataFrame, frequent: dict[bytes, int], endings: int, own_count: int) -> DataFrame:
    """The chunks with the corpus counts and symbols of their words, and the places and
    hashes (in order of the hashes) of the words that are clustered by themselves."""
    shared = packed.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = symbol_of(shared.value, endings)
        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1)
                words = r.column(5)[0].values.to_pylist()
                c = r.column(6)[0].values.to_numpy(zero_copy_only=False).astype(np.int64)
                if r.column(7)[0].is_valid:                # words that other chunks hold too
                    more = r.column(7)[0].values
                    c[more.field(0).to_numpy()] = more.field(1).to_numpy()
                own = np.fromiter(map(symbol, words), np.uint16, len(words))
                at = np.flatnonzero((c >= own_count) | ((own < len(shared.value)) & (c > 0)))
                h = np.array([xxhash.xxh3_64_intdigest(words[j]) for j in at], np.uint64)
                order = np.argsort(h, kind="stable")
                made = [_packed(c), _packed(own), _packed(at[order].astype(np.int32)), _packed(h[order])]
                yield pa.RecordBatch.from_arrays(
                    [*r.columns[:5], *(pa.array([x], pa.binary()) for x in made), pa.array([len(words)], pa.int64()), pa.array([len(at)], pa.int64())],
                    names=["chunk", "ids", "held", "lengths", "tokens", "c", "symbol", "at", "hash", "n_words", "n_own"])
                del words, c, own, at, h, order, made, r
        release_memory()

    lists = back.withColumnRenamed("chunk", "_chunk")
    return packed.join(lists, packed["chunk"] == lists["_chunk"], "left") \
        .select("chunk", "ids", "held", "lengths", "tokens", "words", "n", "back").mapInArrow(work, READY)


def _with_classes(chunks: DataFrame, moved: DataFrame | Broadcast | None) -> DataFrame:
    """The ready chunks with the classes of their words, part by part (null:
    those of the symbols, or of the broadcast words)."""
    if moved is None or isinstance(moved, Broadcast):
        return chunks.withColumn("classes", F.lit(None).cast("array<struct<part: long, payload: binary>>"))
    lists = moved.where(F.col("chunk") >= 0).groupBy(F.col("chunk").alias("_chunk")).agg(F.collect_list(F.struct("part", "payload")).alias("classes"))
    return chunks.join(lists, chunks["chunk"] == lists["_chunk"], "left").drop("_chunk")


def _opened_chunk(r: dict, own: np.ndarray, lookup: Broadcast | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, words of each text, held out, places of the words clustered by themselves, class of each word)."""
    length = r["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64)
    x = _opened(r["tokens"].as_buffer(), int(length.sum()), np.uint32)
    words, n_own = r["n_words"].as_py(), r["n_own"].as_py()
    at = _opened(r["at"].as_buffer(), n_own, np.int32)
    cls = own[_opened(r["symbol"].as_buffer(), words, np.uint16)]
    if lookup is not None:
        hashes, classes = lookup.value
        cls[at] = classes[np.searchsorted(hashes, _opened(r["hash"].as_buffer(), n_own, np.uint64))]
    elif r["classes"].is_valid:
        parts = sorted(r["classes"].as_py(), key=lambda p: p["part"])
        cls[at] = np.concatenate([np.frombuffer(p["payload"], np.uint16) for p in parts])
    return x, length, r["held"].values.to_numpy(zero_copy_only=False).astype(bool), at, cls


def _slices(length: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """(texts, their words) in parts of about ``STEP`` tokens."""
    ends = np.cumsum(length + 1)
    cut = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(STEP, ends[-1], STEP)) + 1, [len(length)]])) if len(length) else [0]
    place = np.append(0, np.cumsum(length))
    for a, z in zip(cut, cut[1:]):
        yield slice(int(a), int(z)), slice(int(place[a]), int(place[z]))


def _count_classes(chunks: DataFrame, moved: DataFrame | Broadcast | None, own: np.ndarray, k: int, parts: int, words_too: bool) -> DataFrame:
    """(chunk, part, payload): the class bigrams (negative parts) and, for each
    chunk and part of the words' hashes, the neighbour classes of its words."""
    lookup = moved if isinstance(moved, Broadcast) else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for b in batches:
            for i in range(len(b)):
                r = {c: b.column(j)[i] for j, c in enumerate(b.schema.names)}
                x, length, held, at, cls = _opened_chunk(r, own, lookup)
                end = len(cls)
                c_of = np.append(cls, own[-1])
                place = np.full(end + 1, -1, np.int64)
                place[at] = np.arange(len(at))
                codes, counts = [], []
                for rows, flat in _slices(length):
                    out = held[rows]
                    now = _with_ends(x[flat][~np.repeat(out, length[rows])], length[rows][~out], end)
                    c = c_of[now].astype(np.int64)
                    c_before = np.concatenate([[own[-1]], c])[:-1].astype(np.int64)       # each text ends with the end
                    total += np.bincount(c_before * k + c, minlength=k * k)
                    if not words_too or not len(at):
                        continue
                    s = place[now] * (2 * k + 1)
                    again = np.append(now[1:] == now[:-1], False)        # the same word follows
                    repeats = np.concatenate([[False], again])[:len(now)]
                    c_after = np.append(c[1:], 0)[:len(now)]             # the last token is an end
                    again = again[:len(now)]
                    some = s >= 0
                    f, m = np.unique(np.concatenate([(s + np.where(again, 2 * k, c_after))[some], (s + k + c_before)[some & ~repeats]]),
                                     return_counts=True)
                    codes.append(f)
                    counts.append(m.astype(np.int32))
                del x, place
                if not words_too or not len(at):
                    continue
                codes, n = np.concatenate([*codes, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int32)
                order = np.argsort(codes, kind="stable")
                codes, n = codes[order], n[order]
                start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
                codes, n = codes[start], np.add.reduceat(n, start) if len(start) else n
                w, key = codes // (2 * k + 1), (codes % (2 * k + 1)).astype(np.uint16)
                del order, start, codes, counts
                h = _opened(r["hash"].as_buffer(), len(at), np.uint64)
                part = (h >> np.uint64(32)).astype(np.int64) * parts >> 32
                found, cut = np.unique(part, return_index=True)
                cut = np.append(cut, len(at))
                edge = np.searchsorted(w, cut)
                payload = []
                for a, z, e, f in zip(cut, cut[1:], edge, edge[1:]):
                    head = np.array([z - a, f - e], np.int64).tobytes()
                    payload.append(pa.compress(head + h[a:z].tobytes() + cls[at[a:z]].astype(np.uint16).tobytes() + (w[e:f] - a).astype(np.uint32).tobytes()
                                               + key[e:f].tobytes() + n[e:f].astype(np.uint32).tobytes(), "zstd", asbytes=True))
                sizes = [16 + 10 * (z - a) + 10 * (f - e) for a, z, e, f in zip(cut, cut[1:], edge, edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), r["chunk"].as_py())), pa.array(found), pa.array(payload, pa.binary()), pa.array(np.array(sizes, np.int64))],
                    names=["chunk", "part", "payload", "size"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int64()), pa.array([-1 - TaskContext.get().partitionId() % 16], pa.int64()), pa.array([total.tobytes()], pa.binary()),
             pa.array([0], pa.int64())], names=["chunk", "part", "payload", "size"])
        release_memory()

    cols = ["chunk", "held", "lengths", "tokens", "symbol", "at", "hash", "n_words", "n_own", "classes"]
    return _with_classes(chunks, moved).select(*cols).mapInArrow(work, "chunk long, part long, payload binary, size long")


def _total(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the payloads, summed up in 16 groups first."""
    def summed(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"payload": [sum(np.frombuffer(x, np.int64) for x in f["payload"]).tobytes()]})

    parts = rows.select(F.pmod("part", F.lit(16)).alias("g"), "payload").groupBy("g").applyInPandas(summed, "payload binary")
    return sum((np.frombuffer(bytes(r["payload"]), np.int64) for r in parts.collect()), np.zeros(size, np.int64))


def _move(counted: DataFrame, n: np.ndarray, parity: int, whole: bool) -> DataFrame:
    """(chunk, part, payload): the new classes of each chunk's words or (``whole``,
    chunk -2) hashes and classes of all words, and (chunk -1) the number of
    different words of every class."""
    k = len(n)

    def work(f: pd.DataFrame) -> pd.DataFrame:
        hashes, classes, codes, counts = [], [], [], []
        for payload, size in zip(f["payload"], f["size"]):
            raw = pa.decompress(payload, int(size), "zstd", asbytes=True)
            words, entries = np.frombuffer(raw, np.int64, 2)
            at = 16
            got = []
            for kind, m in ((np.uint64, words), (np.uint16, words), (np.uint32, entries), (np.uint16, entries), (np.uint32, entries)):
                got.append(np.frombuffer(raw, kind, m, at))
                at += int(m) * np.dtype(kind).itemsize
            hashes.append(got[0])
            classes.append(got[1])
            codes.append((got[2], got[3]))
            counts.append(got[4])
        distinct, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        own = np.concatenate(classes)[first].astype(np.int64)
        cut = np.cumsum([0, *map(len, hashes)])
        code = np.concatenate([which[a:z][w] * (2 * k + 1) + key for (w, key), a, z in zip(codes, cut, cut[1:])])
        order = np.argsort(code, kind="stable")
        code, count = code[order], np.concatenate(counts)[order].astype(np.float64)
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        code, count = code[start], np.add.reduceat(count, start) if len(start) else count
        new = best_classes(code // (2 * k + 1), code % (2 * k + 1), count, own, n)
        new = np.where(distinct % np.uint64(2) == parity, new, own)
        types = np.bincount(new, minlength=k).astype(np.int64).tobytes()
        if whole:
            return pd.DataFrame({"chunk": [-2, -1], "part": [f["part"].iloc[0]] * 2,
                                 "payload": [distinct.astype(np.uint64).tobytes() + new.astype(np.uint16).tobytes(), types]})
        out = [new[which[a:z]].astype(np.uint16).tobytes() for a, z in zip(cut, cut[1:])]
        return pd.DataFrame({"chunk": [*f["chunk"], -1], "part": [*f["part"], f["part"].iloc[0]], "payload": [*out, types]})

    return counted.where(F.col("chunk") >= 0).groupBy("part").applyInPandas(work, "chunk long, part long, payload binary")


def _lookup(moved: DataFrame) -> Broadcast:
    """Hashes, in order, and classes of all words that are clustered by themselves."""
    hashes, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    for r in moved.where(F.col("chunk") == -2).select("payload").collect():
        raw = bytes(r["payload"])
        words = len(raw) // 10
        hashes.append(np.frombuffer(raw, np.uint64, words))
        classes.append(np.frombuffer(raw, np.uint16, words, 8 * words))
    hashes, classes = np.concatenate(hashes), np.concatenate(classes)
    order = np.argsort(hashes, kind="stable")
    return moved.sparkSession.sparkContext.broadcast((hashes[order], classes[order]))


def cluster_words(chunks: DataFrame, own: np.ndarray, k: int, sweeps: int, own_words: int) \
        -> tuple[np.ndarray, DataFrame | Broadcast | None, np.ndarray | None]:
    """(class bigrams, classes of the chunks' words, different words of every
    class) after sweeps over all words that are clustered by themselves; None where
    the classes of the symbols are as good. Up to ``LOOKUP`` of these words (10 bytes each)
    are broadcast with their classes; more are brought to the chunks by a join."""
    spark, small = chunks.sparkSession, own_words <= LOOKUP
    parts = 1 + (chunks.agg(F.sum("n_own")).first()[0] or 0) // PART_WORDS
    moved = types = best = None
    old: list[str] = []                                     # tables of classes that may still be the best
    for sweep in range(sweeps + 1):
        path = scratch_path(spark, "neighbours")
        _count_classes(chunks, moved, own, k, parts, sweep < sweeps).write.parquet(path)
        counted = spark.read.parquet(path)
        n = _total(counted.where(F.col("chunk") < 0), k * k).reshape(k, k).astype(np.float64)
        now, last = likelihood(n), best[0] if best else None
        if last is None or now > last:
            best = (now, n, moved, types)
            for done in old[:-1]:
                drop_table(spark, done)
            del old[:-1]
        # the first two sweeps move one half of the words each
        if sweep == sweeps or not n.any() or (sweep > 1 and now - last < LEAST_GAIN * n.sum()):
            drop_table(spark, path)
            break
        to = scratch_path(spark, "classes")
        _move(counted, n, sweep % 2, small).write.parquet(to)
        drop_table(spark, path)
        moved = spark.read.parquet(to)
        types = _total(moved.where(F.col("chunk") == -1), k)
        if small:
            moved = _lookup(moved)
            drop_table(spark, to)
        else:
            old.append(to)
    return best[1:]


def word_masses(c: np.ndarray, cls: np.ndarray, n_class: np.ndarray, t_class: np.ndarray, discount: float, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each word in its class, unigram probability). A word with count
    ``c`` 0 stands for the unknown word of its class, which has what was taken off the class's ``t_class`` words."""
    mass = np.where(c > 0, c - discount, discount * t_class[cls])
    return mass / np.maximum(n_class[cls], 1.0), mass / max(1, total)


def transitions(counts: np.ndarray) -> np.ndarray:
    """Probability of every class after every class."""
    share = counts.sum(0) / max(1.0, counts.sum())
    return (counts + ALPHA * share) / (counts.sum(1, keepdims=True) + ALPHA)


def score(docs: DataFrame, *args, **options) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity (of the score), after learning from the rows that are not held out. Takes the options of :func:`_score`."""
    with shuffles_released(docs.sparkSession):               # each step writes a table and reads no shuffle again
        return _score(docs, *args, **options)


def _score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out",
          frequent: int = FREQUENT, endings: int = ENDINGS, classes: int = CLASSES, chunk_bytes: int = CHUNK_BYTES,
          own_count: int = OWN_COUNT, word_sweeps: int = WORD_SWEEPS) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "packed")
    pack(docs.select(F.col(id_col).cast("long").alias("id"), F.col(held_col).alias("held_out"), F.col(text_col).alias("text")),
         chunk_bytes).write.parquet(path)
    packed, written = spark.read.parquet(path), [path]
    vocabulary = packed.select("chunk", F.posexplode_outer(F.arrays_zip("words", "n")).alias("at", "x")).where(F.col("at").isNotNull()) \
        .select("chunk", "at", F.col("x.words").alias("word"), F.col("x.n").alias("n"))
    path = scratch_path(spark, "counts")
    vocabulary.where(F.col("n") > 0).groupBy("word").agg(F.sum("n").alias("c")).write.parquet(path)
    counts = spark.read.parquet(path)
    written.append(path)
    # words, sums and rare words by ending: endings rows
    ending = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(endings)).cast("int")
    by_ending = counts.groupBy(ending.alias("e")).agg(
        F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("n1"),
        F.sum((F.col("c") == 2).cast("long")).alias("n2"), F.sum((F.col("c") < own_count).cast("long")).alias("rare")).collect()
    n_docs = packed.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    total = sum(r["n"] for r in by_ending) + n_docs       # the ends are tokens
    types = sum(r["v"] for r in by_ending) + (1 if n_docs else 0)
    most = counts.orderBy(F.desc("c"), "word").limit(frequent).collect()
    top = {bytes(r["word"]): i for i, r in enumerate(most)}
    n1, n2 = sum(r["n1"] for r in by_ending), sum(r["n2"] for r in by_ending)
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    pairs = _bigrams(packed, top, endings)
    own = exchange(pairs, classes)
    k = int(own.max()) + 1
    back = vocabulary.join(counts, "word").where(F.col("c") != F.col("n")).select("chunk", "at", "c")
    # a table of its own, so that the shuffles of words are gone before the chunks are shuffled
    path = scratch_path(spark, "back")
    back.groupBy("chunk").agg(F.collect_list(F.struct("at", "c")).alias("back")).write.parquet(path)
    back = spark.read.parquet(path)
    written.append(path)
    path = scratch_path(spark, "ready")
    ready(packed, back, top, endings, own_count).write.parquet(path)
    chunks = spark.read.parquet(path)
    for done in written:                                     # what the ready chunks were made of
        drop_table(spark, done)
    own_words = sum(r["v"] - r["rare"] for r in by_ending) + sum(r["c"] < own_count for r in most)
    trans, moved, own_types = cluster_words(chunks, own, k, word_sweeps, own_words)
    per_class = trans.sum(0)
    # different words of every class
    symbol_types = np.zeros(len(own))
    symbol_types[:len(top)] = 1
    for r in by_ending:
        symbol_types[len(top) + r["e"]] = r["v"]
    for w in top:
        symbol_types[len(top) + zlib.crc32(w[-3:]) % endings] -= 1
    symbol_types[-1] = 1 if n_docs else 0
    class_types = np.bincount(own, symbol_types, k)
    if moved is not None:                                  # words clustered by themselves, the rarer ones by ending, the end
        rare = np.zeros(len(own))
        for r in by_ending:
            rare[len(top) + r["e"]] = r["rare"]
        for r in most:
            if r["c"] < own_count:
                rare[len(top) + zlib.crc32(bytes(r["word"])[-3:]) % endings] -= 1
        rare[-1] = symbol_types[-1]
        class_types = own_types + np.bincount(own, rare, k)
    # symbols, classes x classes numbers
    model = spark.sparkContext.broadcast((own, transitions(trans), per_class, class_types))
    lookup = moved if isinstance(moved, Broadcast) else None
    end_class = int(own[-1])
    base_below = total + (types + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls_of, move, n_class, t_class = model.value
        for b in batches:
            for i in range(len(b)):
                r = {x: b.column(j)[i] for j, x in enumerate(b.schema.names)}
                x, length, _, _, own_cls = _opened_chunk(r, cls_of, lookup)
                words = len(own_cls)
                c = np.append(_opened(r["c"].as_buffer(), words, np.int64), n_docs).astype(np.float64)
                cls = np.append(own_cls, end_class)
                known = c > 0
                emit, uni = word_masses(c, cls, n_class, t_class, discount, total)
                for rows, flat in _slices(length):
                    long = length[rows]
                    flat = _with_ends(x[flat], long, words)
                    doc = np.repeat(np.arange(len(long)), long + 1)
                    now = cls[flat]
                    before = np.concatenate([[end_class], now])[:-1]       # each text ends with the end, which stands before the next
                    base10 = np.log10((c + 1) / base_below)[flat]
                    if total:
                        p = CLASS_SHARE * move[before, now] * emit[flat] + (1 - CLASS_SHARE) * uni[flat]
                        own10 = np.where(p > 0, np.log10(np.maximum(p, 1e-300)), base10)
                    else:
                        own10 = base10
                    score = np.bincount(doc, own10, len(long))
                    ids, out = (r[n].values.slice(rows.start, len(long)) for n in ("ids", "held"))
                    yield pa.RecordBatch.from_arrays(
                        [ids, out, pa.array(long + 1), pa.array(np.bincount(doc, known[flat], len(long)).astype(np.int64)),
                         pa.array(np.full(len(long), total, np.int64)), pa.array(np.bincount(doc, base10, len(long))), pa.array(score),
                         pa.array(np.power(10.0, -score / (long + 1)))],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
        release_memory()

    cols = ["ids", "held", "lengths", "tokens", "c", "symbol", "at", "hash", "n_words", "n_own", "classes"]
    return _with_classes(chunks, moved).select(*cols).mapInArrow(
        work, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double") \
        .withColumnRenamed("id", id_col)
