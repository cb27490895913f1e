"""One query per operator over its whole table, and the DuckDB SQL of those
that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (bpe, brown_lm, decontaminate, filter_audit, html_text, langid, linededup, neardup, prefix_trie,
                         shard, token_files, topk, toxicity)
from tessera.llm.common import fold, table
from tessera.session import scratch_path

SHARDS = 40
END_ID = 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    # labels meet texts for the training sample only
    ids = toxicity.sample_ids(labels)
    model = toxicity.train(docs.where(~F.col("held_out")).join(F.broadcast(ids), "doc_id"))
    out = toxicity.score(docs, model)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.tokenizer_path(spark))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup(docs)
    return out.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars"), "text")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.layout(table(spark, sf_dir, "documents"), SHARDS)


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    return brown_lm.score(docs)


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_shingles")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, bpe.tokenizer_path(spark), END_ID)
    return token_files.checksums(token_files.read(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": topk.oracle(), "op6_shard": shard.oracle(SHARDS), "op9_decontaminate": decontaminate.oracle(),
            "op11_filter_audit": filter_audit.oracle(), "op12_prefix_trie": prefix_trie.oracle()}
