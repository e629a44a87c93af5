"""The dealt operators as queries ``opN_<name>``, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.session import durable, scratch_path

from . import chat_windows, decontaminate, exact_dedup, fill_in_middle, hard_negatives, lm_scoring, max_score, near_dedup, quality, token_shards, toxicity, trie_bpe, url_filter
from .labelled import FOLD, FOLDS
from .oracles import ORACLE_SQL
from .tables import held_out, keyed_text, table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "shards")
    token_shards.write_shards(keyed_text(table(spark, sf_dir, "documents")), out)
    return token_shards.read_shards(spark, out)


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat_windows.END}{chat_windows.START}assistant ok"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema))
    return chat_windows.conversation_digests(chat_windows.read_windows(durable(chat_windows.format_windows(turns))))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(keyed_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(keyed_text(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed_text(table(spark, sf_dir, "documents"))
    scored = toxicity.score_rows(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), name="score")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed_text(table(spark, sf_dir, "documents"))
    scored = quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.documents_components(table(spark, sf_dir, "documents"))


def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trie_bpe.encode_documents(keyed_text(table(spark, sf_dir, "documents")), decoded=True)
    return out.select(F.col("key").alias("doc_id"), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.deduplicate(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return out.select("entry.doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = fill_in_middle.restore_documents(fill_in_middle.transform_documents(keyed_text(table(spark, sf_dir, "documents"))))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_token_shards, op2_chat_windows, op3_decontaminate, op4_lm_scoring, op5_toxicity, op6_url_filter, op7_quality, op8_simhash, op9_trie_bpe, op10_exact_dedup, op11_fill_in_middle, op12_max_score, op13_hard_negatives)}
