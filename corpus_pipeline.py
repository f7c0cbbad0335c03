"""A corpus pipeline of five of the training-data operators; each stage works on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import line_dedup, mixing, sentencepiece_viterbi, simhash, toxicity
from fluvia.llm.common import new_path, table
from fluvia.llm.queries import tokenizer_file


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the others stay as they are."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in three documents or more go, except from the largest doc_id; every document stays."""
    return _with_length(line_dedup.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows doc_id, n_tokens, round_trip, ids_crc32 for each row of the mixture."""
    return sentencepiece_viterbi.coded(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"), ("n_tokens", "round_trip", "ids_crc32"))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("SimHash near-dedup", drop_near_duplicates), ("mixing sources", mix_sources), ("SentencePiece", encode)]

#: Fitted trees, fingerprints and pieces can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
