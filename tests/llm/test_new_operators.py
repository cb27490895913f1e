"""Operators 11 to 13 against brute force, the library, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import bpe, filter_audit, prefix_trie, queries, token_files  # noqa: E402
from tessera.llm.common import table  # noqa: E402
from tessera.session import scratch_path, ship_package  # noqa: E402


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# ------------------------------------------------------------------ 11
def brute_audit(docs, labels):
    """docs: (id, part, text); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, part, t in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words),
                                               100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
                                               i is not None and i > least[t])) if bad}
        rows.append((part or "", fails, i in good, i in toxic))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        removed = defaultdict(int)
        for order in orders:
            for r in here:
                if r[1]:
                    removed[min(r[1], key=order.index)] += 1
        for order in orders:
            left = here
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                before = set(order[:step - 1])
                out[part, order, step] = (len(left), len(gone), sum(c in r[1] and bool(r[1] & before) for r in here),
                                          sum(r[1] == {c} for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone), removed[c])
    return out


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_audit_on_odd_rows(spark, odd, empty):
    labels = [(3, 1, 0), (3, 0, 1), (5, 1, 1), (8, 0, 1), (None, 1, 1), (99, 1, 1), (12, None, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = [(r["doc_id"], r["source"], r["text"]) for r in odd.collect()]
    assert audited(filter_audit.audit(odd, marks)) == brute_audit(docs, labels)
    assert filter_audit.audit(empty, marks).count() == 0
    assert filter_audit.audit(odd, marks.limit(0)).count() == 120 * 5 * len({d[1] or "" for d in docs})


def test_audit_with_small_ranges(spark, monkeypatch):
    """Shared prefixes, prefixes of each other and copies beyond a range."""
    monkeypatch.setattr(filter_audit, "LEAST_RANGE", 400)
    monkeypatch.setattr(filter_audit, "MOST_RANGE", 400)
    monkeypatch.setattr(filter_audit, "LOOK", 5)
    rng = random.Random(4)
    stems = ["x" * 40, "x" * 40 + "y", "same head of all " * 5, "é", "", "Z"]
    texts = [rng.choice(stems) + "".join(rng.choice("abc é#") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += ["hot text of many rows"] * 200 + texts[:60] + ["x" * n for n in range(40)]
    rng.shuffle(texts)
    docs = [(rng.choice([None, i, i // 2, 7]), rng.choice(["a", "b", None, ""]), t) for i, t in enumerate(texts)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 500, 3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert audited(got) == brute_audit(docs, labels)
    cuts, ranges = filter_audit.cut_prefixes(df.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("_text")), 4)
    assert ranges > 5 and not any(cuts.open) and cuts.prefixes == sorted(cuts.prefixes)
    held = defaultdict(set)
    for t in texts:
        held[cuts.find(t.encode())].add(t)
    assert all(len(held[k]) == 1 for k, least in enumerate(cuts.least) if least is not None)


def test_radix_trie():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(400)]
    trie, want = filter_audit.RadixTrie(), {}
    for i, w in enumerate(words):
        trie.insert(w, -i, i)
        want.setdefault(w, []).append(i)
    assert sorted((least, rows) for least, rows in trie.terminals()) == sorted((-r[-1], r) for r in want.values())


# ------------------------------------------------------------------ 12
def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0), role, digest, text))
    turns = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    new = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = turns.get(c - int(np.fmod(c, 20)), [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in new.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        saved = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = 0
        for x in children[node]:
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves or 1, saved

    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(new[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *below(node),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    return sorted((tuple(r[n] for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
                   for r in df.collect()), key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, seq string, words string, id long"


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for c in range(-25, 140):
        if c % 7 == 3:
            continue
        hot = c % 3 == 0
        for turn in range(2 if hot else rng.randint(1, 9)):
            rows.append((c, turn, "user", "the very common turn" if hot else f"text {rng.randint(0, 2)} of it"))
    rows += [(None, 0, "user", "no id"), (500, None, None, None), (500, 3, "b", "two words"), (500, 3, "a", "tie"), (500, 3, "a", "tie"),
             (501, 0, "user", ""), (502, 0, "", "user"), (2 ** 40, 1, "user", "x" * 5000)]
    return rows


def test_prefix_trie(spark, monkeypatch):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "s", "w", 0) for r in rows], CONVERSATIONS)
    want = brute_trie(rows)
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(df))) == want
    monkeypatch.setattr(prefix_trie, "FAN", 2)                 # several rounds of merging
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(prefix_trie, "BORDER", -1)
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(df))) == want
    assert prefix_trie.trie(prefix_trie.rebuilt(df.limit(0))).count() == 0
    one = brute_trie(rows[-1:])
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(df.where("conv_id = 1099511627776")))) == one


@pytest.mark.parametrize("cuts", [(), (1,), (3, 5), (2, 4, 6, 8, 10)])
def test_forest_and_contract(cuts):
    """Any cut of the sorted conversations gives the nodes of the whole."""
    rng = random.Random(len(cuts))
    seqs = sorted([bytes([rng.randint(0, 1)]) for _ in range(rng.randint(0, 5))] for _ in range(12))
    rows = list(zip(range(12), seqs, [[1] * len(s) for s in seqs]))
    bounds = [0, *cuts, 12]
    closed, opened = [], []
    for block, (a, b) in enumerate(zip(bounds, bounds[1:])):
        for r in prefix_trie.forest(*map(list, zip(*rows[a:b])), block):
            r = dict(zip(prefix_trie._NAMES, r))
            (closed if r["kind"] == "closed" else opened if r["kind"] == "open" else []).append(r)
    closed += [dict(zip(prefix_trie._NAMES, r)) for r in prefix_trie.contract(opened, 0, True)]
    want = defaultdict(list)
    for c, s in enumerate(seqs):
        for d in range(len(s) + 1):
            want[tuple(s[:d])].append(c)
    assert sorted((r["conv_id"], r["depth"], r["n_convs"]) for r in closed) == sorted((min(m), len(k), len(m)) for k, m in want.items())
    root = next(r for r in closed if r["depth"] == 0)
    assert root["saved_tokens"] == sum(len(m) - 1 for k, m in want.items() if k)
    assert root["n_leaves"] == sum(all(k != o[:-1] for o in want if o) for k in want)


# ------------------------------------------------------------------ 13
@pytest.fixture(scope="module")
def library(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.tokenizer_path(spark))
    t.no_padding()
    t.no_truncation()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def brute_tokens(rows, library, end=2):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = library(t) + [end]
        out.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_units_equal_the_library(spark, library, monkeypatch):
    with open(bpe.tokenizer_path(spark), encoding="utf-8") as f:
        spec = f.read()
    rng = random.Random(1)
    bits = [" ", " ", "\n", "a", "bc", "the", "é", "日本", "1", "23", "'s", "'", "!!", "\t", " ", "<|endoftext|>", "\x1c", "😀", "x. ", "_",
            "\r\n", "don't", "A", ".", "?", ";"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["\n".join(" ".join(rng.choice(["alpha", "beta.", "don't", "été", "3x", "'s", "'tis"]) for _ in range(rng.randint(1, 6)))
                        for _ in range(n)) for n in (1, 2, 50, 500)]
    want = [library(t) for t in texts]
    for line, block, units in ((1 << 20, 1 << 16, 10 ** 6), (40, 20, 50)):
        monkeypatch.setattr(token_files, "LINE", line)
        monkeypatch.setattr(token_files, "BLOCK", block)
        monkeypatch.setattr(token_files, "UNITS", units)
        e = token_files.UnitEncoder(spec)
        for at in range(0, len(texts), 100):
            got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[at:at + 100])]
            assert got == want[at:at + 100]


def test_token_files(spark, small_dir, library):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small_dir, "documents").collect()]
    got = queries.op13_token_files(spark, small_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want = brute_tokens(rows, library)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_token_files_of_odd_rows(spark, odd, empty, library):
    path = scratch_path(spark, "tokens")
    token_files.write(odd, path, bpe.tokenizer_path(spark), 2, files=3)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids) and len(ids) == odd.count()
    stream = [x for r in rows for x in r["ids"]]
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += len(r["ids"])
    key = lambda i, x: (i is not None, i or 0, x)
    want = sorted((key(r["doc_id"], library(r["text"]) + [2]) for r in odd.collect()))
    assert sorted(key(r["doc_id"], list(r["ids"])) for r in rows) == want
    assert {(r["doc_id"], r["start"]) for r in token_files.lengths(spark, path).collect()} == {(r["doc_id"], r["start"]) for r in rows}
    assert {r["doc_id"] for r in token_files.documents(spark, path, [5, 9]).collect()} == {5, 9}
    for low, high in ((0, 5), (3, 900), (len(stream) - 4, len(stream)), (10, 10), (0, len(stream))):
        pieces = sorted(token_files.stretch(spark, path, low, high).collect(), key=lambda r: r["start"])
        assert [x for p in pieces for x in p["ids"]] == stream[low:high]
        assert not pieces or pieces[0]["start"] == low
    path = scratch_path(spark, "tokens")
    token_files.write(empty, path, bpe.tokenizer_path(spark), 2)
    assert token_files.checksums(token_files.read(spark, path)).count() == 0


def test_layout_of_token_files(spark, small_dir, tmp_path):
    import glob

    import pyarrow.parquet as pq
    path = str(tmp_path / "tokens")
    docs = table(spark, small_dir, "documents")
    for _ in range(3):
        docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    token_files.write(docs, path, bpe.tokenizer_path(spark), 2, row_group_bytes=1 << 20, page_bytes=8 << 10, page_rows=50, files=1)
    files = [pq.ParquetFile(f) for f in glob.glob(path + "/part-*.parquet")]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 3 << 20
    for g in groups:
        by_name = {g.column(i).path_in_schema: g.column(i) for i in range(g.num_columns)}
        assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
        assert "DELTA_BINARY_PACKED" in by_name["part_start"].encodings
        assert by_name["ids.list.element"].has_dictionary_page
        assert all(c.has_offset_index for c in by_name.values()) and by_name["doc_id"].has_column_index
