"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, shared_folder

__all__ = ["cut_lineage", "staged", "WORD_BREAK", "NO_ID", "words", "spaced", "word_windows", "lower_ascii", "text_of", "keyed_rows", "crc_fold"]

WORD_BREAK = r"[\x20\x09-\x0D]+"
# A null id counts as one document that sorts before all others.
NO_ID = -(2**63)


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than the six white-space ones of the contract."""
    return F.array_remove(F.split(text, WORD_BREAK, -1), "")


def spaced(text: Column) -> Column:
    """The words of a text joined by single spaces; empty where it has none."""
    return F.btrim(F.regexp_replace(text, WORD_BREAK, " "), F.lit(" "))


def word_windows(spaced_text: Column, size: int) -> Column:
    """Every window of ``size`` words of a text from ``spaced``, as strings; none where it has fewer words.

    One pass of a look-ahead, which costs far less than indexing an array of words per window.
    """
    ahead = " ".join(["[^ ]+"] * size)
    return F.regexp_extract_all(spaced_text, F.lit(f"(?:^| )(?=({ahead}))"), 1)


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole row as ``row``, with its id ``did`` and the hash ``th`` of its text.

    Keeping the input in one struct leaves no name that its columns could clash with. Rows that
    share id and text share the key; what is computed for one of them holds for the other.
    """
    rows = docs.select(F.struct("*").alias("row"))
    return rows.select(
        "row",
        F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(text_of(F.col(f"row.`{text_col}`"))).alias("th"),
    )


def crc_fold(id_column: Column, folds: int) -> Column:
    return F.crc32(id_column.cast("string")) % folds


def staged(df: DataFrame) -> DataFrame:
    """Written as a table into the shared folder and read again: lineage cut, compact, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
