"""Operator 2: exact byte-pair encoding and decoding.

A piece of text is encoded left to right over its prefixes. Byte-pair
merging has one result for every text, so every prefix has exactly one last
token. An automaton over the vocabulary (a trie whose suffix links lead from
each match to the next shorter vocabulary entry that also ends there) lists
the tokens that are suffixes of a prefix; the first one that is compatible
with the last token of the prefix before it is stored. Following the stored
tokens back from the whole piece gives the ids.

Two adjacent tokens are compatible if merging their joined bytes would keep
the border between them. The test undoes the merges next to the border from
the latest to the earliest and looks for a merge across the border that
would have come first.

Semantics: null text is encoded as the empty text (no ids, empty decoded
text). Added tokens of the tokenizer file are cut out of the text before it is
split into pieces, as the tokenizers library does with default settings.
Repeated rows, ties and extra columns have no effect on a row's result; an input
column named like an output column gives way to it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import release_memory, without

#: Fixed value: the split pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KNOWN_PAIRS = 300_000    # tested token pairs remembered by one worker
PIECE_CACHE = 300_000      # distinct pieces remembered before a new cache starts; the one before it is still asked
CACHED_PIECE = 64          # longer pieces are not remembered
ROWS_AT_ONCE = 256         # texts whose ids and decoded texts one worker holds


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of every byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairModel:
    """Encoder and decoder for one byte-level tokenizer file."""

    def __init__(self, tokenizer_json: str):
        import ahocorasick
        import regex

        spec = json.loads(tokenizer_json)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("needs a byte-level BPE file without normalizer or prefix space")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with strip or word rules are not handled")
        alphabet = byte_alphabet()
        vocab = {t: i for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        raw = {}
        for t, i in vocab.items():
            if t in self.added:
                self.bytes[i] = t.encode()
            else:
                self.bytes[i] = bytes(alphabet[c] for c in t)
                raw[self.bytes[i].decode("latin-1")] = i
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        # how each token is made: rank of its merge and the two halves (rank -1: a single byte)
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            made, x, y = vocab[a + b], vocab[a], vocab[b]
            self.pairs.setdefault((x, y), r)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, x, y
        self.size, self.lengths = size, [len(x) for x in self.bytes]
        self._known: dict[int, bool] = {}
        # a token takes part only if merging its own bytes gives it back
        whole = [False] * size
        for i in sorted(raw.values(), key=self.rank.__getitem__):
            r = self.rank[i]
            whole[i] = r < 0 or whole[self.left[i]] and whole[self.right[i]] and \
                not self._border_merges(self.left[i], self.right[i], r)
        self.automaton = ahocorasick.Automaton()
        for text, i in raw.items():
            if whole[i]:
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self._before: dict[str, tuple[int, ...]] = {}

    def _border_merges(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether a merge across the border of a and b happens at a rank
        under ``before``, while both of its sides exist."""
        rank, pairs = self.rank, self.pairs
        a_until = b_until = before
        while True:
            r = pairs.get((a, b))
            # of equal merges the leftmost happens first: inside a before the border, the border before inside b
            if r is not None and r < a_until and (r <= b_until if b_until != before else r < before):
                return True
            if rank[a] < 0 and rank[b] < 0:
                return False
            if rank[a] > rank[b]:
                a_until, a = rank[a], self.right[a]
            else:
                b_until, b = rank[b], self.left[b]

    def _test(self, key: int) -> bool:
        """Whether the pair of tokens with the number a * size + b is compatible, remembered."""
        if len(self._known) > KNOWN_PAIRS:
            self._known.clear()
        fits = self._known[key] = not self._border_merges(*divmod(key, self.size))
        return fits

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.size + b
        return self._known.get(key, False) or self._test(key)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        text = piece if piece.isascii() else piece.encode("utf-8", "replace").decode("latin-1")
        last: list[int] = [-1] * len(text)             # the last token of every prefix, by its last place
        size, known, lengths = self.size, self._known, self.lengths
        for end, token in self.automaton.iter(text):   # at each place the longest match first
            if last[end] < 0:
                before = end - lengths[token]
                if before < 0:
                    last[end] = token
                else:
                    key = last[before] * size + token
                    fits = known.get(key)
                    if fits is None:
                        fits = self._test(key)
                    if fits:
                        last[end] = token
        ids, at = [], len(text) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return tuple(ids)

    def _remembered(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that isn't in the cache."""
        got = self._before.get(piece) or self.encode_piece(piece)
        if len(piece) <= CACHED_PIECE:
            if len(self.cache) >= PIECE_CACHE:
                self._before, self.cache = self.cache, {}
            self.cache[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        parts = self.cut.split(text) if self.cut and any(t in text for t in self.added) else [text]
        cache = self.cache
        for part in parts:
            if part in self.added:
                ids.append(self.added[part])
                continue
            for piece in self.split(part):
                got = cache.get(piece)
                if got is None:
                    got = self._remembered(piece)
                    cache = self.cache
                ids += got
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None,
           keep_text: bool = True) -> DataFrame:
    """``df`` (without its text, unless kept) with the token ids (array<int>) of a text column and, if
    ``decoded`` names a column, the text that the ids decode to.

    The driver reads the tokenizer file (its size is that of a vocabulary, not
    of the data) and broadcasts its text; each task builds the automaton
    once."""
    df = without(df, out, *([decoded] if decoded else []))
    spec = df.sparkSession.sparkContext.broadcast(_read(path))
    at = df.columns.index(text_col)
    keep = [j for j in range(len(df.columns)) if keep_text or j != at]
    fields = [*[df.schema.fields[j] for j in keep], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BytePairModel(spec.value)                  # a third of a second a task; gone with it
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(start, ROWS_AT_ONCE)
                ids = [np.asarray(model.encode(t or ""), dtype=np.int32) for t in rows.column(at).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                arrays = [*[rows.column(j) for j in keep], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                if decoded:
                    arrays.append(pa.array([model.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])
        del model
        release_memory()

    return df.mapInArrow(work, T.StructType(fields))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that a column of token ids decodes to (null: empty
    text; an id outside the vocabulary raises)."""
    df = without(df, out)
    spec = df.sparkSession.sparkContext.broadcast(_read(path))
    at = df.columns.index(ids_col)
    fields = [*df.schema.fields, T.StructField(out, T.StringType(), False)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BytePairModel(spec.value)
        for batch in batches:
            text = [model.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[f.name for f in fields])

    return df.mapInArrow(work, T.StructType(fields))


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the round trip of every whole text."""
    got = encode(df.select(id_col, text_col), path, text_col, "_ids", "_decoded", keep_text=False)
    return got.select(id_col, F.size("_ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"))


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file (see the package ``public_tokenizers``)."""
    import public_tokenizers
    return public_tokenizers.path(name)
