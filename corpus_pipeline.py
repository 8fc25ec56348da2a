"""From raw documents to token ids: each stage applies one corpus operator.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the
columns of documents.  Rows with null ids or texts go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm import decontam, near_dedup, piece_scan, repeats, toxicity
from convlens.llm.common import TOKENIZER_DIR, store, table

MODEL = f"{TOKENIZER_DIR}/piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out()))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 the least id stays."""
    return near_dedup.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that repeats 100 bytes of earlier text is cut out; every document stays."""
    return repeats.cut_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of the text, with a check that they decode to it."""
    hashed = docs.select("doc_id", "text", "lang", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    out = piece_scan.encode(hashed, MODEL, decoded=True)
    return out.select("doc_id", "lang", "source", F.size("token_ids").alias("n_tokens"), "token_ids", (F.xxhash64("decoded") == F.col("text_hash")).alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: Tokenizers and fitted models cannot be put in SQL; the tests run stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
