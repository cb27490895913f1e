"""The dealt operators against brute force, libraries and odd inputs."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import (bpe, brown_lm, decontaminate, html_text, langid, linededup, neardup,  # noqa: E402
                         queries, shard, topk, toxicity)
from tessera.llm.common import table  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    return table(spark, small_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# ------------------------------------------------------------------ 1
def test_network_gradients():
    p = toxicity.new_weights(4)
    own = {"ab": 1, "cde": 2, "x": 3}

    class Always:
        def random(self, n):
            return np.ones(n)

    batch, y = [["ab", "cde", "zz"], ["x"], []], np.array([1.0, 0.0, 1.0])
    _, g = toxicity._step(p, own, batch, y, Always())
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = p[k][at], 1e-5
        p[k][at] = old + e
        up = toxicity._step(p, own, batch, y, Always())[0]
        p[k][at] = old - e
        down = toxicity._step(p, own, batch, y, Always())[0]
        p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-7), k


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        starts = list(toxicity.window_starts(n))
        covered = {i for a in starts for i in range(a, min(n, a + toxicity.WINDOW))}
        assert covered == set(range(n))


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts, y = [], []
    for i in range(240):
        x = rng.choice(words, 70).tolist()
        if i % 3 == 0:
            x[int(rng.integers(70))] = "badstem" + str(rng.choice(["a", "er", "ing"]))
        texts.append([x[a:a + 32] for a in toxicity.window_starts(len(x))])
        y.append(int(i % 3 == 0))
    return toxicity.fit(texts, np.array(y), rounds=4, steps=35)


def test_toxicity_finds_stems(spark, toxic_model, odd, empty):
    rows = [(1, "waa wba wca " * 40), (2, "waa wba " * 300 + "badstemly " + "wca wda " * 300), (3, "badstema waa wba wca wda wea")]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), toxic_model).collect()}
    assert got[1]["score"] < 0.5 < min(got[2]["score"], got[3]["score"])
    assert got[2]["top_start"] <= 600 < got[2]["top_start"] + toxicity.WINDOW
    out = toxicity.score(odd, toxic_model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty, toxic_model).count() == 0
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


# ------------------------------------------------------------------ 2
def test_bpe_equals_the_library(spark, docs, texts, odd, empty):
    from tokenizers import Tokenizer
    path = bpe.tokenizer_path(spark)
    lib = Tokenizer.from_file(path)

    def check(df):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
            back = lib.decode(ids, skip_special_tokens=False)
            want[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(back.encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in bpe.digests(df, path).collect()) == want

    check(docs)
    check(odd)
    assert bpe.digests(empty, path).count() == 0


def test_bpe_pieces(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer
    path = bpe.tokenizer_path(spark)
    with open(path, encoding="utf-8") as f:
        model = bpe.BytePairModel(f.read())
    lib = Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(["a", "aa", "the", " ", "  ", "\n", "'s", "é", "ß", "中", "🙂", "<|endoftext|>", "1", "²", "\x85", "ing", "==", "_"]),
                    max_size=40).map("".join) | st.text(max_size=60))
    def same(text):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids
        assert model.decode(ids) == lib.decode(ids, skip_special_tokens=False)

    same()
    ids = bpe.encode(spark.createDataFrame([(1, "some text 🙂"), (2, None)], "doc_id long, text string"), path)
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(ids, path).collect()}
    assert back == {1: "some text 🙂", 2: ""}


# ------------------------------------------------------------------ 3
def test_html_article(spark, small_dir):
    for r in queries.op3_html(spark, small_dir).join(table(spark, small_dir, "pages"), ["page_id", "url"]).collect():
        body = r["html"].partition("<article>")[2]
        body = re.split(r"</article>|<footer>", body)[0]
        body = re.sub(r"<[a-z/][^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))
        want = " ".join(html.unescape(body).split())
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p", ""), ("<script>var x='</p>';", ""),
    ("<article><header><h1>T &lt;b&gt;</h1></header><p title='a>b'>x<br>y<b>z</b>w</p><aside>no</aside>tail</article><p>after", "T <b> x yzw tail"),
    ("<div class='cookie-notice'>We use it for you</div><p>One &amp; two&nbsp;three</p><form><p>name</p></form>", "One & two three"),
    ("<ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul><p>The cat is on the mat and it was there for the whole of the day, "
     "so we left.</p><p>Short one</p><div id='comments'><p>I think that this is the best of all of the pages on the web.</p></div>",
     "The cat is on the mat and it was there for the whole of the day, so we left. Short one"),
    ("<main><p>a<p>b<div hidden>c</div><!-- d --><p>e</main><footer>f</footer>", "a b e"),
])
def test_html_rules(page, text):
    assert html_text.main_text(page) == text


LONG_TEXT = "The cat is on the mat and it was there for the whole of the day, so we left it in the house."


@pytest.mark.parametrize("page, text", [
    (f"<article><p>{LONG_TEXT}</p><section id='market-share'><p>{LONG_TEXT}</p></section></article>", f"{LONG_TEXT} {LONG_TEXT}"),
    (f"<article><h2 id='legal-notice-period'>Notice period</h2><p>{LONG_TEXT}</p></article>", f"Notice period {LONG_TEXT}"),
    (f"<form id=aspnetForm><nav>Menu</nav><p>{LONG_TEXT}</p></form>", LONG_TEXT),
    (f"<p>{LONG_TEXT}</p><form><p>{LONG_TEXT}</p></form>", LONG_TEXT),
    ("<form><p>Your name</p></form>", ""),
    (f"<article><p>{LONG_TEXT}</p><div class='share-buttons'>Share</div><section class='user-comments'>{LONG_TEXT}</section></article>", LONG_TEXT),
    (f"<p title='id=comments'>{LONG_TEXT}</p>", LONG_TEXT),
    ("<p>a<svg/>b</p>", "ab"), ("<p a=\"x>y</p>z", "y z"), ("<p don't>x</p>", "x"), ("a < b <1 c", "a < b <1 c"), ("a </ c", "a"),
    ("<p>&#" + "0" * 5000 + "65; &#" + "9" * 5000 + ";</p>", "A \ufffd"),
])
def test_html_names(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<a " + '"' * 10 ** 6, "<a " * 333_000, "<a<a " * 200_000, "<div>" * 100_000 + "</b>" * 100_000, "<a =\">\" " * 125_000,
    "<b><article>" + "<div>" * 80_000 + "</b>" * 80_000, "<noscript>" * 100_000, "<p>" * 300_000, "<!-- " * 200_000, "<![CDATA[" * 110_000,
    "<a " + "=" * 10 ** 6 + ">", "<a id" + " " * 10 ** 6 + ">", "<a class='" * 100_000 + ">", "&#" * 500_000, "<" * 10 ** 6, "</" * 500_000,
    "<p style='" + "display " * 125_000 + "'>x", "<script" * 140_000 + ">", "<a b='" + "\"" * 10 ** 6 + ">",
], ids=range(19))
def test_html_linear(page):
    begin = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begin < 3


def test_html_odd(spark, odd, empty):
    clash = spark.createDataFrame([("<p>x", "old")], "html string, TEXT string")
    assert [r.asDict() for r in html_text.extract(clash).collect()] == [{"text": "x"}]
    assert html_text.extract(odd, "text", "text").count() == odd.count()
    assert html_text.extract(empty, "text", "text").count() == 0
    assert len(html_text.main_text("<p>" + "long word " * 200_000)) == 10 * 200_000 - 1


# ------------------------------------------------------------------ 4
def brute_top(rows, k=5, every=50):
    v = {i: np.floor(256 * np.asarray(x, np.float64)).astype(np.int64) for i, x in rows}
    return {q: sorted((-(int(v[q] @ v[c])), c) for c in v if c != q)[:k] for q in v if q % every == 0}


def test_top_k_exact(spark, small_dir):
    e = table(spark, small_dir, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    prepared = topk.quantised(e, "vec_id", "embedding")
    for block, chunk, seeds in ((512, 8192, 2048), (3, 70, 20), (3, 70, 0)):
        got = {}
        for r in topk.search(prepared, prepared.where("id % 50 = 0"), 5, block, chunk, seeds).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert got == brute_top(rows)


def test_top_k_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (None, [9.0, 9.0]), (50, [-1.0, -0.001]), (7, []), (8, [1.0]), (2, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df).orderBy("query_id", "rank").collect()]
    a, b = 256 * 256 + 128 * 128, -256 * 256 - 128
    assert got == [(0, 1, 1, a), (0, 2, 2, a), (0, 3, 50, b), (50, 1, 0, b), (50, 2, 1, b), (50, 3, 2, b)]
    assert topk.top_k(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 5
def brute_lines(rows):
    first = {}
    for i, t in rows:
        for x in set(map(str.strip, (t or "").split("\n"))):
            for e in linededup.paths(x):
                if i is not None:
                    first[e] = min(first.get(e, i), i)
    return Counter((i, t if i is None or t is None else "\n".join(
        x for x in t.split("\n") if not any(first[e] < i for e in linededup.paths(x.strip())))) for i, t in rows)


def test_line_dedup(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = linededup.dedup(df)
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == brute_lines(rows)
        assert got.columns == [*df.columns, "n_dropped"]
    assert linededup.dedup(empty).count() == 0


def test_line_templates(spark):
    long = "the quick brown fox {} over the lazy dog and then it runs away from here"
    rows = [(1, long.format("jumps")), (2, "own line of text\n" + long.format("leaps")), (3, "Order 17 was sent on 2024-01-01 to you"),
            (4, "Order 99 was sent on 2025-12-31 to you"), (5, "one two\nthe fox"), (6, "one two\nthe fox")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("own line of text", 1)
    assert got[3] == (rows[2][1], 0) and got[4] == ("", 1)
    assert got[5][1] == got[6][1] == 0
    assert linededup.template("Order 17  was") == "Order <*> was"


def test_line_dedup_by_words(spark):
    """Short lines and variable words in lines of 4 to 11 words, against a comparison of words that doesn't call paths()."""
    rng = random.Random(8)
    few = ["All rights reserved.", "Menu", "Read more", "of the"]
    some = ["Share this page with {}", "Click here to {} this", "Posted by {} on our community news board today", "a lone line {}"]
    fill = ["friends", "family", "us", "now", "you"]
    rows = []
    for i in range(40):
        text = [f"own{i} " + " ".join(rng.choice("abcdefgh") * 3 + str(i) for _ in range(rng.randrange(9)))]
        text += [few[0]] if i % 2 else []
        text += [few[1]] if i < 8 else []
        text += [few[2]] if i < 7 else []
        text += [rng.choice(some[:3]).format(rng.choice(fill)), few[3] if i == 20 else ""]
        rows.append((i, "\n".join(text)))
    rows.append((50, some[3].format("x")))

    def split(line):
        w = ["<*>" if any(c.isdigit() for c in x) else x for x in line.split()]
        rest = w[2:]
        at = [len(rest) * k // 4 for k in range(5)]
        return w, [tuple(w[:2]), *(tuple(rest[a:b]) for a, b in zip(at, at[1:]))]

    def meet(x, y):
        (a, p), (b, q) = split(x), split(y)
        if len(a) != len(b):
            return False
        if a == b:
            return True
        off = [k for k in range(5) if p[k] != q[k]]
        # one part differs, and three words without a digit are left beside it
        return len(a) >= 4 and len(off) == 1 and off[0] > 0 and \
            (len(a) >= 12 or sum(w != "<*>" for k in range(5) if k != off[0] for w in p[k]) >= 3)

    lines = [(i, x) for i, t in rows for x in t.split("\n") if x]
    want = {}
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            near = {j for j, y in lines if x and meet(x, y)}
            if not (x and min(near) < i and (len(near) >= 8 if len(x.split()) < 4 else len(near) >= 2)):
                kept.append(x)
        want[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert sum("All rights reserved." in t for t in got.values()) == 1 == sum("Menu" in t for t in got.values())
    assert sum("Read more" in t for t in got.values()) == 7 and sum("Share this page" in t for t in got.values()) == 1


# ------------------------------------------------------------------ 6
def test_shard_law(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = shard.layout(df, 40).collect()
        assert len(rows) == df.count()
        slots = Counter()
        for r in rows:
            slots[r["shard"], r["slot"]] += 1
            assert r["grown_shard"] in (r["shard"], 40)
        sizes = Counter(r["shard"] for r in rows)
        assert all(slots[s, i] == 1 for s, n in sizes.items() for i in range(n))
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in shard.layout(docs, 40).collect()} == want
    assert shard.layout(empty, 40).count() == 0


def test_shard_weights(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    n = {r["shard"]: r["count"] for r in shard.assign(df, [1.0, 3.0], "k").groupBy("shard").count().collect()}
    assert abs(n[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        shard.assign(df, [1.0, 0.0], "k")


# ------------------------------------------------------------------ 7
def test_lm_base_and_gain(spark, small_dir, texts):
    rows = queries.op7_brown_lm(spark, small_dir).collect()
    train, count = Counter(), len(texts)
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None])
    total, types = sum(train.values()), len(train)
    assert len(rows) == count
    for r in rows:
        words = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]])), None]
        assert r["n_tokens"] == len(words) and r["train_tokens"] == total
        assert r["n_known"] == sum(train[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(np.log10((train[w] + 1) / (total + types + 1)) for w in words))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


def test_lm_probabilities_sum_to_one(spark):
    """All known words and the unknown event of each class, after any word, have mass 1 at most (and nearly 1)."""
    rows = [(i, t, False) for i, t in enumerate(["a b a c", "b a d", "a b", "c d a b", "x y z", "a b e"])]
    rows += [(100 + i, f"a {w}", True) for i, w in enumerate("a b c d e x y z q".split())] + [(200, "a", True)]
    got = {r["doc_id"]: r["score"] for r in brown_lm.score(
        spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), frequent=4, endings=1, classes=2).collect()}
    # p("a w end") / p(... "a") leaves p(w | a) * p(end | w); the end differs by class only, so compare through two-word sums
    assert all(v < 0 for v in got.values())
    assert got[101] > got[108]                             # "a b" is likelier than "a q"


def test_lm_events_have_mass_one():
    """All known words and the unknown word of every class, after any class."""
    rng = np.random.default_rng(0)
    k, c = 5, rng.integers(1, 40, 200).astype(float)
    cls = rng.integers(0, k, 200)
    n_class, t_class = np.bincount(cls, c, k), np.bincount(cls, minlength=k).astype(float)
    counts = rng.integers(0, 9, (k, k)).astype(float)
    counts[3] = 0                                              # a class that nothing followed
    counts *= n_class / np.maximum(counts.sum(0), 1)           # as often entered as its words occur
    move = brown_lm.transitions(counts)
    emit, uni = brown_lm.word_masses(np.append(c, np.zeros(k)), np.append(cls, np.arange(k)), n_class, t_class, 0.63, int(c.sum()))
    where = np.append(cls, np.arange(k))
    for before in range(k):
        p = brown_lm.CLASS_SHARE * move[before, where] * emit + (1 - brown_lm.CLASS_SHARE) * uni
        assert p.sum() == pytest.approx(1.0, abs=1e-9)


def test_lm_classes_by_broadcast_or_join(spark, docs, monkeypatch):
    df = docs.select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out"))
    got = []
    for limit in (10 ** 6, 0):
        monkeypatch.setattr(brown_lm, "LOOKUP", limit)
        got.append({r["doc_id"]: r["score"] for r in brown_lm.score(df, chunk_bytes=100_000).collect()})
    assert got[0] == pytest.approx(got[1])


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    pairs = np.zeros((30, 30))
    at = 0
    for _ in range(6000):                                  # two kinds of symbols of different frequency that follow their own
        kind = at // 15 if rng.random() < 0.9 else 1 - at // 15
        to = 15 * kind + min(14, int(rng.exponential(4)))
        pairs[at, to] += 1
        at = to
    own = brown_lm.exchange(pairs, 2, sweeps=30)
    seen = np.flatnonzero(pairs.sum(0) > 20)
    assert len(set(own[seen[seen < 15]])) == len(set(own[seen[seen >= 15]])) == 1 and own[0] != own[15]

    def likelihood(c):
        m = np.zeros((30, 4))
        m[np.arange(30), c] = 1
        n = m.T @ pairs @ m
        return brown_lm._g(n).sum() - brown_lm._g(n.sum(0)).sum() - brown_lm._g(n.sum(1)).sum()

    # a local optimum: no single move raises the likelihood
    pairs = rng.poisson(3, (30, 30)).astype(float)
    own = brown_lm.exchange(pairs, 4, sweeps=50)
    for w in range(30):
        for c in range(4):
            assert likelihood(np.where(np.arange(30) == w, c, own)) <= likelihood(own) + 1e-6


def test_words_move_to_their_best_class():
    rng = np.random.default_rng(6)
    pairs = rng.poisson(1.5, (24, 24)).astype(float)
    own, k = rng.integers(4, size=24), 4

    def table(c):
        m = np.eye(k)[c]
        return m.T @ pairs @ m

    word, key, count = [], [], []
    for w in range(24):
        row = np.zeros(2 * k + 1)
        for v in range(24):
            if v != w:
                row[own[v]] += pairs[w, v]
                row[k + own[v]] += pairs[v, w]
        row[2 * k] = pairs[w, w]
        for x in np.flatnonzero(row):
            word, key, count = [*word, w], [*key, x], [*count, row[x]]
    got = brown_lm.best_classes(np.array(word), np.array(key), np.array(count), own, table(own))
    for w in range(24):
        all_l = [brown_lm.likelihood(table(np.where(np.arange(24) == w, c, own))) for c in range(k)]
        assert all_l[got[w]] == pytest.approx(max(all_l))


def test_words_beyond_the_frequent_are_clustered(spark):
    """Two kinds of words with one ending that follow each other: only their own classes tell them apart."""
    rng = random.Random(9)
    kinds = [[f"{c}{i}xyz" for i in range(20)] for c in "ab"]

    def text():
        return " ".join(rng.choice(kinds[j % 2]) for j in range(40))

    rows = [(i, text(), i >= 150) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    for chunk_bytes in (3_000, brown_lm.CHUNK_BYTES):
        got = brown_lm.score(df, frequent=4, endings=1, classes=4, chunk_bytes=chunk_bytes).where("held_out").collect()
        assert len(got) == 50 and np.mean([r["perplexity"] for r in got]) < 24         # 20 words may follow; 40 without classes


def test_lm_odd(spark, odd, empty):
    flagged = odd.withColumn("held_out", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))
    assert brown_lm.score(flagged).count() == odd.count()
    assert brown_lm.score(flagged.limit(0)).count() == 0
    held = brown_lm.score(odd.withColumn("held_out", F.lit(True))).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == r["base_score"] for r in held)


# ------------------------------------------------------------------ 8
def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = neardup._words((t or "").lower())
        sets[i] = Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = sum((sets[i] & sets[j]).values())
            if both and both / (sum(sets[i].values()) + sum(sets[j].values()) - both) >= 0.8:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in texts}


def test_near_duplicates(docs, texts, odd, empty):
    got = {r["id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == brute_classes(texts)
    kept = neardup.keep_first(docs)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in got.items() if i == c} and kept.columns == docs.columns
    rows = [(r["id"], r["class_id"]) for r in neardup.classes(odd).collect()]
    assert Counter(rows) == Counter([(1, 1), (2, 2), (None, None), (3, 3), (4, 4), (5, 4), (5, 4), (6, 4), (7, 7), (8, 7), (9, 9), (10, 10),
                                     (11, 11), (12, 12)])
    assert neardup.classes(empty).count() == 0


def test_signature_is_unbiased():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(120):
        base = rng.integers(1 << 62, size=25)
        a = Counter({int(x): int(rng.choice([1, 1, 2, 5, 9])) for x in base[:20]})
        b = Counter({int(x): int(rng.choice([1, 1, 2, 5, 9])) for x in base[5:]})
        s = np.array([*a.elements(), *b.elements()], np.uint64)
        d = np.repeat([0, 1], [sum(a.values()), sum(b.values())])
        r = neardup.signatures(s, d, 2, 128)
        off.append((r[0] == r[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.015


def test_second_round_finds_links_between_members(spark):
    """A bucket whose smallest member is like neither of two that are alike."""
    members = spark.createDataFrame([(1, 10, 10), (1, 11, 11), (1, 12, 12)], "bucket long, id long, comp long")
    e = {10: range(0, 50), 11: range(100, 150), 12: range(100, 149)}
    elements = spark.createDataFrame([(i, bytearray(np.array(x, np.uint64).tobytes())) for i, x in e.items()], "id long, elements binary")
    for block in (128, 1):
        assert {tuple(sorted(r)) for r in neardup._rest(members, elements, 0.8, block).collect()} == {(11, 12)}


def test_near_duplicates_of_texts_under_one_id(spark):
    """Every text of an id is compared by its own bands and multiset."""
    rng = random.Random(4)
    short, long = (" ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(99)) for _ in range(n)) for n in (60, 900))
    rows = [(5, short), (5, long), (9, short + " end"), (12, long + " end"), (13, "quite another text of its own"), (5, None), (2, "")]
    for order in (rows, rows[::-1]):
        got = {(r["id"], r["class_id"]) for r in neardup.classes(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert got == {(5, 5), (9, 5), (12, 5), (13, 13), (2, 2)}


def test_near_duplicates_repeated_rows_and_null_ids(spark):
    """One row of each class stays, whatever its id and however often it is there."""
    text, near = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(79))
    lone = "only rows without an id hold this text"
    rows = [(7, text), (7, text), (7, near), (8, text), (None, text), (None, near), (None, lone), (None, lone), (None, ""), (None, None), (3, ""),
            (4, ""), (4, ""), (6, "a single row that no other resembles")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, extra long")
    got = Counter((r["id"], r["class_id"]) for r in neardup.classes(df).collect())
    assert got == Counter({(7, 7): 3, (8, 7): 1, (None, 7): 2, (None, None): 4, (3, 3): 1, (4, 4): 2, (6, 6): 1})
    kept = neardup.keep_first(df)
    out = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    first = min((text, near), key=lambda t: hashlib.md5(t.encode()).digest())
    assert kept.columns == df.columns
    assert out == Counter([(7, first), (None, lone), (None, ""), (None, None), (3, ""), (4, ""), (6, rows[-1][1])])


# ------------------------------------------------------------------ 9
def test_decontamination_short_items(spark, odd, empty):
    items = spark.createDataFrame([(1, "the alpha of"), (2, None), (3, ""), (None, "word"), (2, "Der die, DAS und der"), (1, "the alpha of")],
                                  "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.report(odd.where("doc_id is null or doc_id <> 9"), items).collect()}
    assert len(rows) == 12 and decontaminate.report(odd, items).count() == 14
    assert (rows[None]["n_hit"], rows[None]["n_items"], rows[None]["contaminated"]) == (3, 1, True)
    assert rows[None]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert (rows[7]["n_hit"], rows[7]["n_items"], rows[7]["contaminated"]) == (1, 0, True)
    assert (rows[10]["n_hit"], rows[10]["n_words"]) == (157, 160)
    assert rows[1]["n_words"] == 0 and not rows[1]["contaminated"]
    assert {r["n_hit"] for r in decontaminate.report(odd, items.limit(0)).collect()} == {0}
    assert decontaminate.report(empty, items).count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(odd, items).collect()}
    assert cut[None] == "the beta and so on" and cut[7] == "" and cut[1] is None and cut[10] == "die das und "
    left = decontaminate.remove_documents(odd, items)
    assert {r["doc_id"] for r in left.collect()} >= {1, 2, 3, 4, 11, 12} and left.columns == odd.columns
    assert 10 not in {r["doc_id"] for r in left.collect()}
    # without a broadcast the result is the same
    a = decontaminate.contamination(odd, items, broadcast_windows=0).select("_id", "n_words", "spans").collect()
    b = decontaminate.contamination(odd, items).select("_id", "n_words", "spans").collect()
    c = decontaminate.contamination(odd, items, broadcast_bytes=0).select("_id", "n_words", "spans").collect()
    assert sorted(map(str, b)) == sorted(map(str, c))
    assert Counter(map(str, a)) == Counter(map(str, b))


# ------------------------------------------------------------------ 10
def brute_viterbi(scores, switch):
    best, back = scores[0].astype(float), []
    for s in scores[1:]:
        move = best.max() - switch
        back.append([int(best.argmax()) if move > b else k for k, b in enumerate(best)])
        best = np.maximum(best, move) + s
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(b[out[-1]])
    return out[::-1]


def test_viterbi_batches():
    rng = np.random.default_rng(2)
    n = np.array([5, 0, 40, 1, 13])
    scores = rng.normal(0, 4, (n.sum(), 3)).astype(np.float32)
    got = langid.viterbi(scores, n, 3.0)
    at = 0
    for k in n:
        if k:
            want = brute_viterbi(scores[at:at + k], 3.0)
            value = lambda p: sum(scores[at + i, s] for i, s in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
            assert value(got[at:at + k]) == pytest.approx(value(want), abs=1e-3)
        at += k


def test_language_accuracy(spark, small_dir, docs):
    rows = queries.op10_language(spark, small_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_spans_and_odd(spark, docs, odd, empty):
    model = langid.train(docs)
    de = docs.where("lang = 'de'").orderBy(F.desc(F.length("text"))).first()["text"].split()[:60]
    fr = docs.where("lang = 'fr'").orderBy(F.desc(F.length("text"))).first()["text"].split()[:40]
    mixed = spark.createDataFrame([(1, " ".join(de + fr))], "doc_id long, text string")
    r = langid.identify(mixed, model).first()
    assert r["lang_pred"] == "de" and [s["lang"] for s in r["lang_spans"]] == ["de", "fr"] and 0.5 < r["score"] < 1
    out = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(odd, model).count() == odd.count() and langid.identify(empty, model).count() == 0
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_viterbi_many_labels():
    rng = np.random.default_rng(5)
    scores = rng.normal(0, 3, (300, 200)).astype(np.float32)
    scores[:100, 199] += 30
    n = np.array([100, 0, 50, 150])
    got = langid.viterbi(scores, n, 4.0)
    assert set(got[:100]) == {199}
    at = 0
    for k in n:
        if k:
            want = brute_viterbi(scores[at:at + k], 4.0)
            assert list(got[at:at + k]) == list(want)
        at += k


def test_language_many_and_rare(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    stem = {f"l{i:03d}": letters[i % 26] * 3 + letters[i // 26] * 3 + letters[i * 7 % 26] for i in range(200)}
    rows = [(i, f"{w} {w}{w} {w}", x) for i, (x, w) in enumerate(stem.items())]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["labels"] == sorted(stem)
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
    one = [(i, "the house and the garden", "en") for i in range(3000)] + [(None, "das Haus und der Garten", "de")]
    one += [(None, f"la maison {i}", "fr") for i in range(3)]
    model = langid.train(spark.createDataFrame(one, "doc_id long, text string, lang string"), train_rows=20)
    assert model["labels"] == ["de", "en", "fr"]
    tests = spark.createDataFrame([(1, "der Garten und das Haus")], "doc_id long, text string")
    assert langid.identify(tests, model).first()["lang_pred"] == "de"
