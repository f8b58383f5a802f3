"""Corpus pipeline: stages over ``documents``, each one operator, written and read again in between."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.lines import dedup_lines
from tickloom.llm.mixing import drawn, mixed
from tickloom.llm.pieces import encode
from tickloom.llm.quality import score_quality
from tickloom.llm.queries import DOMAIN_TARGETS, labelled_domains
from tickloom.llm.simhash import one_of_each
from tickloom.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(done: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``row``, with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _rows(done: DataFrame, docs: DataFrame) -> DataFrame:
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality label is likelier 0 than 1 go."""
    return _rows(score_quality(docs, _labels(spark, sf_dir)).filter("score >= 0.5"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in one document; a document keeps its row even if no line is left."""
    return _with_text(dedup_lines(docs), docs, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of their five-word shingles shared) the smallest id stays."""
    return _rows(one_of_each(docs, shingle=5, max_bits=3, similarity=0.8), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains that have too much are thinned to their target; clean documents stay and none is repeated."""
    labelled = labelled_domains(_labels(spark, sf_dir))
    rates = mixed(docs, labelled, DOMAIN_TARGETS, anchor="clean", max_rate=1.0, headroom=1.05)
    return _rows(drawn(docs, rates), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, with one merge in ten skipped; decoding gives the text again."""
    return encode(docs, dropout=0.1, seed=1)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]
# Models and seeded hashing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table; what lies between them is in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if place + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{place}-{name}")
        docs = spark.read.parquet(f"{folder}/{place}-{name}")
    return docs
