"""A cleaning pipeline over `documents`: each stage works on all that the stage before it kept.

toxicity: documents that the chain's marginals call toxic go; line dedup: lines
that an earlier document holds go; near duplicates: one document of each group
stays; mixing: documents are repeated or left out to meet the sources' targets;
encoding: texts become piece ids.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm import line_dedup, mixing, ngram_join, piece_encoding, toxicity
from tarnfield.llm.shared import WORK, remove, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the chain calls toxic; a null or empty text has no toxic token and stays."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that an earlier document holds; documents of which no text is left go, empty ones stay."""
    return line_dedup.dedup_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents linked by five-word shingles at 0.8; documents without words and null ids stay."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them; a document without words stays once."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage's rows are ids of pieces, not documents: the text is named by its digest, other columns are left behind."""
    out = piece_encoding.encode(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_pieces", "piece_score", "exact", "piece_ids", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_LEFT: list[str] = []


def _tidied(stage: Callable) -> Callable:
    """stage, before which the working tables of the stage before it go: its result has been written by then."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _LEFT)
        _LEFT.clear()
        before = len(WORK)
        out = stage(spark, docs, sf_dir)
        _LEFT.extend(WORK[before:])
        return out

    return run_stage


STAGES = [
    ("toxicity", _tidied(drop_toxic)),
    ("line_dedup", _tidied(drop_repeated_lines)),
    ("ngram_join", _tidied(drop_near_duplicates)),
    ("mixing", _tidied(mix_sources)),
    ("piece_encoding", _tidied(encode_pieces)),
]

#: The chain's training and the piece vocabulary are outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
