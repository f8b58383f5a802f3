"""One named query per operator on the given tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.clusters import cluster, cluster_report, kept_vectors
from tickloom.llm.common import NO_ID, crc_fold
from tickloom.llm.lines import dedup_lines
from tickloom.llm.mixing import mixed
from tickloom.llm.negatives import hard_negatives, mining_rows
from tickloom.llm.pieces import encode
from tickloom.llm.quality import score_quality
from tickloom.llm.rules import apply_policy, rule_ledger
from tickloom.llm.simhash import near_groups
from tickloom.llm.subtrees import dedup_words
from tickloom.llm.suffixes import dedup_bytes
from tickloom.llm.topk import integer_vectors, top_k
from tickloom.llm.toxicity import fit_toxicity, score_toxicity
from tickloom.llm.warc import read_records, write_warc
from tickloom.llm import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    text = getattr(sql, fn.__name__.upper(), None)
    if text is not None:
        ORACLES[fn.__name__] = text
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(rule_ledger(_table(spark, sf_dir, "documents")), "v2")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score",
    )


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, _table(spark, sf_dir, "labels"))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), (crc_fold(F.col("row.doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


DOMAIN_TARGETS = {"clean": 0.90, "poor": 0.05, "toxic": 0.05}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """Domain of each labelled document; null labels count as the better one."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    return labels.select(F.col("doc_id").cast("long").alias("k"), domain.alias("domain"))


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rates = mixed(docs, labelled_domains(_table(spark, sf_dir, "labels")), DOMAIN_TARGETS, anchor="clean")
    return rates.select(
        F.nullif("did", F.lit(NO_ID)).alias("doc_id"), "tokens",
        *[F.get("p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(DOMAIN_TARGETS)], "rate",
    )


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), dropout=0.1, seed=1)


@query
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(_table(spark, sf_dir, "embeddings")))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_bytes(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_words(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return hard_negatives(mining_rows(_table(spark, sf_dir, "embeddings"), label=moved))


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_records(write_warc(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(cluster(kept_vectors(_table(spark, sf_dir, "embeddings")))).withColumnRenamed("id", "vec_id")
