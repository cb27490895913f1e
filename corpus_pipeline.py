"""A training-corpus pipeline of five stages over ``documents``.

Every stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame;
all but the last return the columns of ``documents``. Extra columns pass through
unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, linededup, neardup
from tessera.llm.common import free_name, table
from tessera.session import scratch_path, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null text, no letter) go."""
    ship_package(spark)
    names = [free_name(docs, x) for x in ("lang_pred", "lang_score", "lang_spans")]
    out = langid.identify(docs, langid.train(docs), names=tuple(names), keep_text=True)
    return out.where(F.col(names[0]) != "und").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents stay in the first one only; a
    document of which nothing is left goes. n_chars follows the text."""
    ship_package(spark)
    lost = free_name(docs, "_n_lost")
    out = linededup.dedup(docs, lost=lost)
    out = out.where((F.col(lost) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays (the smallest id)."""
    ship_package(spark)
    return neardup.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lies in benchmark windows go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    ship_package(spark)
    return bpe.digests(docs, bpe.tokenizer_path(spark))


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: Trained models and signatures are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
