"""Operators whose workers hold little at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tessera.llm import bpe, langid, toxicity


def test_pieces_of_the_cache_before_are_not_encoded_again(monkeypatch):
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    rng = np.random.default_rng(0)
    rare = iter(rng.permutation(2000))
    text = " ".join(w for _ in range(400) for w in ("often", "again", "Straße", f"x{next(rare)}"))
    whole = bpe.BytePairModel(spec)
    want = whole.encode(text)
    monkeypatch.setattr(bpe, "PIECE_CACHE", 50)
    model = bpe.BytePairModel(spec)
    encoded = []
    inner = model.encode_piece
    monkeypatch.setattr(model, "encode_piece", lambda piece: encoded.append(piece) or inner(piece))
    assert model.encode(text) == want
    assert len(model.cache) <= 50 and len(model._before) <= 50
    assert encoded.count(" often") == encoded.count(" again") == 1           # eight caches were begun meanwhile


def test_texts_are_encoded_in_slices_and_left_behind(spark):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None if i % 50 == 0 else "" if i % 50 == 1 else f"text {i} 🙂 ä" * (i % 7) for i in range(2 * bpe.ROWS_AT_ONCE + 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = bpe.encode(df, path, "text", "ids", "decoded", keep_text=False)
    assert got.columns == ["doc_id", "ids", "decoded"]
    rows = {r["doc_id"]: r for r in got.collect()}
    model = bpe.BytePairModel(open(path, encoding="utf-8").read())
    assert {i: r["decoded"] for i, r in rows.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(rows[i]["ids"] == model.encode(t or "") for i, t in enumerate(texts))
    assert bpe.encode(df.limit(0), path).count() == 0


def test_language_in_small_steps(spark):
    rows = [(i, t * (1 + i % 3), lang) for i, (t, lang) in enumerate([("the cat sat on a mat ", "en"), ("der Hund und die Katze ", "de")] * 40)]
    rows += [(100, None, None), (101, "12 ...", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = langid.train(docs)
    want = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    words = [f"w{i}x" * (1 + i % 4) for i in range(40_000)]
    small = sorted(b for n in range(0, len(words), langid.NEW_AT_ONCE) for x, _ in langid._grams(words[n:n + langid.NEW_AT_ONCE]) for b in x)
    assert small == sorted(b for x, _ in langid._grams(words) for b in x)
    assert [want[i]["lang_pred"] for i in (0, 1, 100, 101)] == ["en", "de", "und", "und"]


def test_windows_are_read_in_steps_that_stay_small(monkeypatch):
    rng = np.random.default_rng(0)
    p = {k: a.astype(np.float32) for k, a in toxicity.new_weights(50).items()}
    inputs = rng.normal(0, 1, (500, 6 * toxicity.WORD_H)).astype(np.float32)
    windows = rng.integers(-1, 500, (4096, toxicity.WINDOW))
    tracemalloc.start()
    got = toxicity.window_logits(p, inputs, windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    monkeypatch.setattr(toxicity, "WINDOWS_AT_ONCE", 4096)
    assert (toxicity.window_logits(p, inputs, windows) == got).all()
