"""A training-data pipeline over `documents`: language, near duplicates, repeated passages, benchmark passages, token ids.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet to the shared folder and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm import decontamination, language_id, ngram_join, sentencepiece_codec, suffix_dedup
from runnel.llm._shared import table, written

#: A document whose leading language has a smaller share of its words' posterior mass is no text in any one language.
MIN_LANGUAGE_SCORE = 0.4
#: A public tokenizer's model file.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a leading language."""
    model = language_id.train(docs.where(language_id.fold() != 1))
    found = language_id.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.first_of_each(docs, 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has."""
    return suffix_dedup.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of benchmark items."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds SentencePiece ids, their number, and whether decoding them gives the text back."""
    return sentencepiece_codec.encode(docs, Path(PIECE_MODEL).read_bytes())


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("sentencepiece", token_ids),
]

#: SQL has no conditional random field and no tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
