"""The training-data pipeline: five stages over ``documents``, each reading what the one before it kept.

toxicity          documents that the classifier, fitted on ``labels``, predicts toxic go
exact_dedup       of equal texts the row with the largest id stays
simhash_dedup     of texts connected by SimHash fingerprints within 3 of 64 bits, or by 0.8 of their five-word shingles or more (which 3 bits
                  do not always show), the document with the smallest id stays
decontaminate     documents that hold a passage of ``benchmark`` go
trie_bpe          what is left, as token ids and as the text they decode to

Null texts count as empty, null ids are below all others, further columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm import decontaminate, exact_dedup, near_copies, near_dedup, toxicity, trie_bpe
from oddsmill.llm.tables import keyed_text, small_batches, table
from oddsmill.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(keyed_text(docs), table(spark, sf_dir, "labels"))
    return toxicity.kept_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.kept_documents(docs, further=near_copies.copies)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = trie_bpe.encode_documents(keyed_text(docs), decoded=True, remember=False)
    return out.select(F.col("key").alias("doc_id"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("trie_bpe", encode),
]
#: A classifier, majority fingerprints, an alignment and a BPE are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet under ``spark.checkpoint.dir`` and read again."""
    out, docs = scratch_path(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}_{name}")
        docs = spark.read.parquet(f"{out}/{k}_{name}")
    return docs
