"""A training corpus from raw documents: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  Labels, languages and
benchmark come from the tables of ``sf_dir``; rows without text, without words or
without a letter are rejected by the first two stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, jaccard, language, piece_viterbi, quality
from tidemark.llm.common import fold, stored, table
from tidemark.llm.queries import PIECE_MODEL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores ``quality.KEEP`` or more."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return quality.accepted(docs, quality.train(docs, labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return language.accepted(docs, language.train(docs.where(fold("doc_id", 4) != 2)))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without benchmark passages; ``n_chars`` follows the text."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return decontam.without_spans(docs, table(spark, sf_dir, "benchmark"), length=length)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    found = piece_viterbi.encode_texts(docs, public_tokenizers.path(PIECE_MODEL), kept)
    return found.select(*kept, F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", duplicate_stage),
    ("benchmark", benchmark_stage),
    ("pieces", piece_stage),
]

#: Learned models and an automaton decide: no SQL says this.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
