"""Readers and writers for the derived artefacts.

Spark's job commit makes a written folder appear whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location (a local one only on a local master)."""
    return f"{shared_folder(spark)}/tickloom-{name}-{uuid.uuid4().hex}"


def read_keyed_csv(spark: SparkSession, path: str, schema: str, key: str, width: int = 6) -> DataFrame:
    """CSV whose key lost its leading zeros somewhere; ``schema`` is explicit, nothing inferred."""
    table = spark.read.csv(path, schema=schema, header=True)
    return table.withColumn(key, F.lpad(F.col(key).cast("string"), width, "0"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions with one folder per evaluation set, so that reading one set skips the others."""
    df.write.mode("overwrite").partitionBy("eval_set").parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Model scores ``model, symbol, tick_seq, time_s, bid1, score``, one folder per model."""
    df.write.mode("overwrite").partitionBy("model").parquet(path)


def write_ticks(df: DataFrame, path: str) -> None:
    """Sequenced ticks by date; later jobs read ``tick_seq`` instead of recomputing it."""
    df.write.mode("overwrite").partitionBy("date").parquet(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_nested_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
