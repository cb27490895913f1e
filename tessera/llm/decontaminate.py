"""Operator 9: benchmark decontamination with a broadcast set of n-grams.

Words are maximal runs of digits, letters and non-ASCII characters after
lower-casing A-Z. A window is ``n`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window. All windows of all documents
are hashed, the hashes are looked up in the set of benchmark windows, and the
words of a found window are compared with the item's to rule out equal hashes.

Only DataFrame functions run here. The benchmark's windows, and what one scan finds of them in
the documents, are each written once under the shared checkpoint folder. The distinct
windows are broadcast while they are at most ``broadcast_windows`` and
their measured size is at most ``broadcast_bytes``; beyond that the same
join is a shuffled one. So are the keys of the documents with equal hashes, by which the
texts to be compared are picked: only those are shuffled, not the others. Items
are joined to the verified windows as rows.

Semantics: a null or empty text has no words and is clean; repeated rows get
equal results each; benchmark rows with a null id mark words as hit but are not
listed; an empty benchmark leaves everything clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_az, row_key
from tessera.session import scratch_path

#: Fixed value: what separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 13
BROADCAST_WINDOWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a text as an array (empty for null)."""
    return F.filter(F.split(F.coalesce(lower_az(text), F.lit("")), GAP), lambda w: w != "")


def _windows(ws: Column, size: Column | int) -> Column:
    """Starts (from 1) of the windows of ``size`` words."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.size(ws) >= size, F.sequence(F.lit(1), F.size(ws) - size + 1)) \
        .otherwise(F.array().cast("array<int>"))


def with_window_hashes(df: DataFrame, lengths: list[int], ws: str = "ws") -> DataFrame:
    """``df`` with a column ``h<k>`` for each k: the hashes of all windows of k
    words, in order. Hashes of 1, 2, 4, ... words are joined pairwise, so that
    a window of k words takes about log2(k) steps, not k."""
    own = set(df.columns)
    df = df.withColumn("_p1", F.transform(ws, lambda w: F.xxhash64(w)))

    def joined(a: str, b: str, shift: int) -> Column:
        # the last places of the result lack their right part and are cut off below
        return F.zip_with(a, F.slice(b, shift + 1, F.greatest(F.size(b) - shift, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    power = 1
    while 2 * power <= max(lengths, default=0):
        df = df.withColumn(f"_p{2 * power}", joined(f"_p{power}", f"_p{power}", power))
        power *= 2
    for k in lengths:
        done, at = None, 0
        for p in (2 ** j for j in reversed(range(k.bit_length()))):
            if k & p:
                if done is None:
                    df = df.withColumn(f"_w{k}_{p}", F.col(f"_p{p}"))
                else:
                    df = df.withColumn(f"_w{k}_{p}", joined(done, f"_p{p}", at))
                done, at = f"_w{k}_{p}", at + p
        df = df.withColumn(f"h{k}", F.slice(done, 1, F.greatest(F.size(ws) - k + 1, F.lit(0))))
    return df.select(*own, *[f"h{k}" for k in lengths])


def benchmark_windows(items: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram, len, item): the distinct windows of every item."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")) \
        .where(F.size("ws") > 0).withColumn("len", F.least(F.size("ws"), F.lit(n)))
    return w.select("item", "len", "ws", F.explode(_windows(F.col("ws"), F.col("len"))).alias("at")) \
        .select(F.slice("ws", F.col("at"), F.col("len")).alias("gram"), "len", "item").distinct()


def hashed(grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The windows of :func:`benchmark_windows` with their ``hash``."""
    h = F.coalesce(*[F.when(F.col("len") == k, F.get(f"h{k}", F.lit(0))) for k in lengths]) if lengths \
        else F.lit(None).cast("long")
    return with_window_hashes(grams, lengths, "gram").select(*grams.columns, h.alias("hash"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(of: Column) -> Column:
    """Sum of a row's bytes as a broadcast table holds them, generously."""
    return F.coalesce(F.sum(F.coalesce(of, F.lit(0)).cast("long") + 64), F.lit(0))


def _by_key() -> Column:
    """Rows with the key (_id, _th, _tl) and those with the same key under (i, h, l)."""
    return F.col("_id").eqNullSafe(F.col("i")) & F.col("_th").eqNullSafe(F.col("h")) & F.col("_tl").eqNullSafe(F.col("l"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & a["_th"].eqNullSafe(b["_th"]) & a["_tl"].eqNullSafe(b["_tl"])


def candidates(docs: DataFrame, grams: DataFrame, lengths: list[int], broadcast: bool, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct document row: (_id, _th, _tl, n_words, copies,
    found), where ``found`` holds (at, hash) of the windows whose hash is one of
    the benchmark's.

    Every document puts the value 0 before its window hashes, and the looked-up
    set holds it too, so that one scan gives the documents without hits as well.
    Only ids and numbers run through the explode and the look-up."""
    base = docs.select(*row_key(id_col, text_col), words(F.col(text_col)).alias("ws"))
    # the hashes are a column of their own, so that the explode and the look-up share one generated loop;
    # the outer form keeps the optimiser from filtering on (and so repeating) that column
    rows = with_window_hashes(base, lengths) \
        .withColumn("hashes", F.concat(F.array(F.lit(0).cast("long")), *[f"h{k}" for k in lengths])) \
        .select("_id", "_th", "_tl", F.size("ws").cast("long").alias("n_words"), F.posexplode_outer("hashes").alias("at", "hash"))
    known = grams.select("hash").union(grams.sparkSession.range(1).select(F.col("id").alias("hash"))).distinct()
    found = rows.join(F.broadcast(known) if broadcast else known, "hash")
    return found.groupBy("_id", "_th", "_tl").agg(
        F.max("n_words").alias("n_words"), F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("copies"),
        F.collect_set(F.when(F.col("at") > 0, F.struct("at", "hash"))).alias("found"))


def _start(at: Column, size: Column, n_words: Column, lengths: list[int]) -> Column:
    """First word (from 0) of a window from its place among the windows of all lengths."""
    before, out = F.lit(1), None
    for k in lengths:
        case = F.when(size == k, at - before) if out is None else out.when(size == k, at - before)
        out, before = case, before + F.greatest(F.lit(0), n_words - k + 1)
    return out.cast("int")


def contamination(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text",
                  broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per distinct document row: (_id, _th, _tl, n_words, copies,
    spans, item_ids), where ``spans`` are the hit word positions (0-based,
    sorted) and ``item_ids`` the sorted ids of the items with occurring windows."""
    pairs = benchmark_windows(items, n)
    lengths = sorted(r["len"] for r in pairs.select("len").distinct().collect())                  # at most n rows
    pairs = _written(hashed(pairs, lengths), "windows")
    grams = pairs.select("gram", "len", "hash").distinct()
    word_bytes = F.aggregate("gram", F.lit(0), lambda x, w: x + F.octet_length(w) + 16)
    size = grams.agg(F.count(F.lit(1)).alias("rows"), _bytes(word_bytes).alias("bytes")).first()
    small = size["rows"] <= broadcast_windows and size["bytes"] <= broadcast_bytes
    per_doc = _written(candidates(docs, grams, lengths, small, id_col, text_col), "found")
    # words are compared for the documents with equal hashes only
    keys = per_doc.where(F.size("found") > 0).select(F.col("_id").alias("i"), F.col("_th").alias("h"), F.col("_tl").alias("l"))
    few = keys.agg(_bytes(F.octet_length(F.col("i").cast("string"))).alias("size")).first()["size"] <= broadcast_bytes
    some = per_doc.where(F.size("found") > 0).select(
        "_id", "_th", "_tl", "n_words", F.explode("found").alias("f")).select("*", F.col("f.hash").alias("hash"))
    some = some.join(F.broadcast(grams) if small else grams, "hash")
    some = some.withColumn("start", _start(F.col("f.at"), F.col("len"), F.col("n_words"), lengths or [n])) \
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))) \
        .groupBy("_id", "_th", "_tl").agg(F.collect_set(F.struct("start", "len", "gram")).alias("found"))
    text = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("_text"))
    text = text.join(F.broadcast(keys) if few else keys, _by_key(), "left_semi").dropDuplicates(["_id", "_th", "_tl"])
    text = text.join(some.withColumnsRenamed({"_id": "i", "_th": "h", "_tl": "l"}), _by_key())
    hits = text.withColumn("ws", words(F.col("_text"))).select("_id", "_th", "_tl", F.filter(
        "found", lambda h: F.slice(F.col("ws"), h["start"] + 1, h["len"]) == h["gram"]).alias("hits")).where(F.size("hits") > 0)
    hits = _written(hits, "hits")
    spans = hits.select("_id", "_th", "_tl", F.array_sort(F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))).alias("spans"))
    listed = hits.select("_id", "_th", "_tl", F.explode(F.array_distinct(F.transform(
        "hits", lambda h: h["gram"]))).alias("gram")) \
        .join(pairs.where(F.col("item").isNotNull()).select("gram", "item"), "gram") \
        .groupBy("_id", "_th", "_tl").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    spans = spans.join(listed.withColumnsRenamed({"_id": "i", "_th": "h", "_tl": "l"}), _by_key(), "left").drop("i", "h", "l")
    none = [F.array().cast("array<int>"), F.array().cast("array<string>")]
    return per_doc.join(spans, _same(per_doc, spans), "left").select(
        per_doc["_id"], per_doc["_th"], per_doc["_tl"], "n_words", "copies",
        F.coalesce("spans", none[0]).alias("spans"), F.coalesce("item_ids", none[1]).alias("item_ids"))


def verdict(n_hit: Column, n_words: Column) -> Column:
    """Whether a document counts as contaminated: a twentieth of its words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = contamination(docs, items, n, id_col, text_col)
    each = c.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))        # repeated rows again
    return each.select(F.col("_id").alias(id_col), "n_words", F.size("spans").cast("long").alias("n_hit"),
                    F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256")) \
        .withColumn("contaminated", verdict(F.col("n_hit"), F.col("n_words")))


def remove_documents(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns. The
    contaminated ones (id, text hash and length) are joined away; Spark
    broadcasts them only if measured small."""
    c = contamination(docs, items, n, id_col, text_col)
    bad = c.where(verdict(F.size("spans"), F.col("n_words"))).select("_id", "_th", "_tl")
    same = docs[id_col].eqNullSafe(bad["_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(bad["_th"]) \
        & F.length(docs[text_col]).eqNullSafe(bad["_tl"])
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """All documents, their hit words (with the characters up to the next
    word) cut out of the text; a document without hits keeps its exact text."""
    c = contamination(docs, items, n, id_col, text_col).where(F.size("spans") > 0).select("_id", "_th", "_tl", "spans")
    same = docs[id_col].eqNullSafe(c["_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(c["_th"]) \
        & F.length(docs[text_col]).eqNullSafe(c["_tl"])
    joined = docs.join(c, same, "left")
    # the text in pieces: what comes before the first word, then each word with the gap after it
    piece = F.regexp_extract_all(docs[text_col], F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), 0)
    head = F.regexp_extract(docs[text_col], r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 0)
    # whether each piece is hit, from runs of false between the hit words: no search per word
    size, spans = F.size(piece), c["spans"]
    runs = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.concat(
        F.array_repeat(F.lit(False), (F.when(i == F.size(spans), size).otherwise(F.get(spans, i))
                                      - F.when(i == 0, 0).otherwise(F.get(spans, i - 1) + 1)).cast("int")),
        F.when(i == F.size(spans), F.array().cast("array<boolean>")).otherwise(F.array(F.lit(True)))))
    kept = F.filter(F.arrays_zip(piece.alias("p"), F.flatten(runs).alias("h")), lambda x: ~x["h"])
    text = F.when(spans.isNull(), docs[text_col]).otherwise(F.concat(head, F.array_join(F.transform(kept, lambda x: x["p"]), "")))
    return joined.select(*[text.alias(text_col) if x == text_col else docs[x] for x in docs.columns])


def oracle(n: int = N) -> str:
    """DuckDB SQL for :func:`report`."""
    split = "list_filter(regexp_split_to_array(coalesce(translate(text, '{u}', '{l}'), ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')" \
        .format(u="ABCDEFGHIJKLMNOPQRSTUVWXYZ", l="abcdefghijklmnopqrstuvwxyz")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {split} AS ws FROM benchmark),
bl AS (SELECT item, ws, least(len(ws), {n}) AS k FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item, k, ws[i:i + k - 1] AS gram
      FROM (SELECT item, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM bl)),
k AS (SELECT DISTINCT k FROM g),
p AS (SELECT r, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d JOIN k ON len(ws) >= k),
h AS (SELECT r, i, k, ws[i:i + k - 1] AS gram FROM p),
f AS (SELECT r, i, h.k, item FROM h JOIN g ON g.gram = h.gram),
n AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS w FROM f) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""
