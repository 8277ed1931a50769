"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import ann, balance, bpe, chat, itq, merkle, packing, repair, secret_ledger, toxicity, url_filter, warc
from orrery.llm.jaccard import jaccard_components


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_tree_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"))


def op2_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secret_report(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents"), with_ids=False))


def op8_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: A conversation whose texts look like the template's own marks.
CONTROL_STRINGS = r"\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role").withColumn("text", F.lit(CONTROL_STRINGS))
    return chat.report(chat.format_conversations(rows.unionByName(added)))


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.written_and_read(_table(spark, sf_dir, "pages"))


def op11_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.pack(balance.document_pieces(_table(spark, sf_dir, "documents")), with_ids=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle.prove(docs, claimed=merkle.tampered(docs))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(conversations), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_tree_concatenation": op1_bpe_tree_concatenation,
    "op2_kmeans_tree_neighbours": op2_kmeans_tree_neighbours,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_itq_near_duplicates": op5_itq_near_duplicates,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_url_language_models": op8_url_language_models,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_warc_archives": op10_warc_archives,
    "op11_cost_balanced_packing": op11_cost_balanced_packing,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {"op3_secret_ledger": secret_ledger.report_sql(), "op8_url_language_models": url_filter.judged_sql(), "op12_merkle_manifest": merkle.proofs_sql(), "op13_conversation_repair": repair.report_sql()}
