"""The corpus pipeline against its stages by hand, and the SQL of the queries."""

from collections import Counter

import pytest

pytest.importorskip("tessera.llm")

import corpus_pipeline as P  # noqa: E402
from oracle_util import canon, duck  # noqa: E402
from test_operators import brute_classes, brute_lines  # noqa: E402

from tessera.llm import decontaminate, queries  # noqa: E402
from tessera.llm.common import table  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small_dir, name):
    got, want = canon(queries.queries()[name](spark, small_dir).toPandas()), canon(duck(small_dir).execute(queries.oracle_sql()[name]).df())
    assert got == want


def test_stages(spark, small_dir, tmp_path):
    docs = table(spark, small_dir, "documents")
    assert [n for n, _ in P.STAGES] == ["language", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, small_dir)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        a, b = before.collect(), docs.collect()
        if name == "language":
            assert {r["doc_id"] for r in b} == {r["doc_id"] for r in a if any(c.isalpha() for c in r["text"])}
        elif name == "line_dedup":
            want = {i: t for i, t in brute_lines([(r["doc_id"], r["text"]) for r in a])}
            had = {r["doc_id"]: r["text"] for r in a}
            assert {r["doc_id"]: r["text"] for r in b} == {i: t for i, t in want.items() if t == had[i] or t.strip(" ")}
        elif name == "near_dedup":
            assert {r["doc_id"] for r in b} == {i for i, c in brute_classes({r["doc_id"]: r["text"] for r in a}).items() if i == c}
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.report(before, table(spark, small_dir, "benchmark")).collect() if r["contaminated"]}
            assert {r["doc_id"] for r in b} == {r["doc_id"] for r in a} - bad
        else:
            assert Counter(r["doc_id"] for r in b) == Counter(r["doc_id"] for r in a)
    assert Counter(map(tuple, P.run(spark, small_dir).collect())) == Counter(map(tuple, b))


def test_odd_inputs(spark, small_dir, odd, empty):
    for name, stage in P.STAGES:
        out = stage(spark, odd, small_dir)
        assert out.count() <= odd.count() and (name == "bpe" or out.columns == odd.columns)
        assert stage(spark, empty, small_dir).count() == 0
