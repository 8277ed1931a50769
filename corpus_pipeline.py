"""A training-data pipeline over documents: toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each
stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import packing, secret_ledger, toxicity
from orrery.llm.common import cut, fresh_path, named
from orrery.llm.jaccard import jaccard_components

#: Near duplicates: shingles of so many words, and the least similarity in per cent.
SHINGLE_WORDS = 5
SIMILARITY = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity operator scores 0.5 or more; each row is judged by its own text."""
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: that with the smallest doc_id, one without an id last; of rows that repeat an id and a text, one.

    Rows are told apart by a digest of id and text, so texts that share an id, or have none, stand for
    themselves. A text without words links with nothing. The columns are held in one struct meanwhile, so
    none clashes with a helper's name; of rows that repeat an id and a text one stays, by a hash of all columns.
    """
    row = F.col("row")
    told = F.to_json(F.struct(row.getField("doc_id").alias("doc_id"), row.getField("text").alias("text")))
    keyed = docs.select(F.struct(*map(named, docs.columns)).alias("row")).withColumn("key", F.unhex(F.sha2(told, 256)))
    groups = jaccard_components(keyed.select("key", row.getField("text").alias("text")), "key", words=SHINGLE_WORDS, percent=SIMILARITY).select(F.col("doc_id").alias("key"), "component_id")
    ranked = keyed.select("key", F.struct(row.getField("doc_id").isNull().alias("last"), row.getField("doc_id").alias("doc_id"), "key").alias("rank")).distinct().join(groups.distinct(), "key")
    chosen = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.key")
    return keyed.join(chosen, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select(*(row.getField(c).alias(c) for c in docs.columns))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret in a text replaced by a mark; n_chars is counted anew where a text changed."""
    hidden = secret_ledger.redacted(docs, secret_ledger.Ledger(spark, fresh_path(spark, "ledger")))
    return hidden.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their ids, sequences and offsets."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", hide_secrets), ("packing", pack_sequences)]

#: Label models, near-duplicate components and packing can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
