"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import keyed_rows, lower_ascii, text_of

BLANK = " \t\n\x0b\x0c\r"


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """``row`` (the input row), ``kept_text``, ``n_lines`` and ``n_dropped`` for every row of ``docs``.

    A line's key is the line without the white space of ``BLANK`` at its ends and with A-Z lower-cased.
    Keys of ``min_chars`` code points or more that ``min_docs`` documents hold stay only in the smallest id.
    A null or empty text is one empty line. A null id counts as one document before all others; repeated
    rows of one id are one document, so a line kept there is kept in each of them. Ties do not arise: ids
    are compared, not rows. An empty table gives an empty table.

    Only hashes, ids and line numbers are shuffled for counting; a frequent line is pre-aggregated in
    every task, and the join back to its occurrences is one whose large partitions Spark can split.
    """
    base = keyed_rows(docs, id_col, text_col)
    text = text_of(F.col(f"row.`{text_col}`"))
    key = lower_ascii(F.btrim("line", F.lit(BLANK)))
    lines = (
        base.select("did", "th", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .select("did", "th", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    shared = (
        lines.groupBy("h1", "h2", "did").agg(F.count("*").alias("n"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("did").alias("first"))
        .filter(F.col("n_docs") >= min_docs)
    )
    drops = (
        lines.join(shared, ["h1", "h2"]).filter(F.col("did") != F.col("first"))
        .groupBy("did", "th").agg(F.collect_set("pos").alias("gone"))
    )
    split_up = base.join(drops, ["did", "th"], "left").select("row", "gone", F.split(text, "\n", -1).alias("lines"))
    # Both lists come from a hash set or a counter, so reassembly is linear in the lines of a document.
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return split_up.select(
        "row",
        F.when(F.col("gone").isNull(), text)
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
