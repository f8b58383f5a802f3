"""Quality rules as a ledger: each rule is evaluated once into a bit, policies are masks over the bits.

Everything is built-in Columns. Measurements of one document never leave its row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import spaced, text_of, word_windows

# Rule name -> when a document fails it, over the measurements. The place in this list is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_word_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "2 * n_capitals > word_chars",
    "exclamations": "20 * n_exclamations > word_chars",
}
WINDOW = 3
BLANK = " \t\n\x0b\x0c\r"
BASE = ("few_words", "repeated_windows")
# Version -> rules that reject. Old versions stay, so that earlier corpora can be rebuilt.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": (*BASE, "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}


def mask_of(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _chars(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the measurements, and ``fail_bits`` with a bit per failed rule.

    Null and empty texts have no words, all measurements are zero and only ``few_words`` fails. Repeated
    rows are measured alike, null ids are kept, other columns are not read.
    """
    step = docs.select(
        F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("body")
    ).select(
        "doc_id", "body", spaced(F.col("body")).alias("t"),
        F.filter(F.split("body", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0).alias("word_lines"),
    ).select("*", F.length("t").cast("long").alias("t_chars"), _chars(F.col("t"), "[^ ]+").alias("gaps"))
    step = step.select(
        "doc_id",
        F.when(F.col("t_chars") > 0, F.col("gaps") + 1).otherwise(0).cast("long").alias("n_words"),
        (F.col("t_chars") - F.col("gaps")).alias("word_chars"),
        _chars(F.col("t"), r"[^#*$%&|<>]+").alias("n_symbols"),
        _chars(F.col("t"), "[^A-Z]+").alias("n_capitals"),
        _chars(F.col("t"), "[^!]+").alias("n_exclamations"),
        F.size("word_lines").cast("long").alias("n_word_lines"),
        (F.size("word_lines") - F.size(F.array_distinct("word_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(word_windows(F.col("t"), WINDOW), lambda x: F.xxhash64(x)).alias("h"),
    )
    # Upper hash halves with the position below them, sorted as plain numbers: equal windows are neighbours.
    packed = F.transform("h", lambda x, i: x.bitwiseAND(F.lit(-(2**32))).bitwiseOR(i.cast("long")))
    step = step.withColumn(
        "near", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(packed)).otherwise(F.array().cast("array<long>"))
    )
    at = lambda x: x.bitwiseAND(F.lit(2**32 - 1)).cast("int")
    pairs = F.zip_with(
        "near", F.slice("near", 2, F.greatest(F.size("near"), F.lit(1))),
        lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), 32) == 0, F.array(at(a), at(b))),
    )
    step = step.withColumn("likely", F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    # The few that are left are compared by their whole hash.
    step = step.withColumn(
        "same", F.sort_array(F.transform("likely", lambda i: F.struct(F.get("h", i).alias("v"), i.alias("i"))))
    )
    twins = F.zip_with(
        "same", F.slice("same", 2, F.greatest(F.size("same"), F.lit(1))),
        lambda a, b: F.when(a["v"] == b["v"], F.array(a["i"], b["i"])),
    )
    starts = F.array_distinct(F.flatten(F.filter(twins, lambda p: p.isNotNull())))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[i + k for k in range(WINDOW)])))))
    measured = step.withColumn("n_repeat_words", covered.cast("long")).drop("h", "near", "likely", "same")
    bits = None
    for place, failed in enumerate(RULES.values()):
        bit = F.when(F.expr(failed), F.lit(1 << place)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, version: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under one version; no text is read again."""
    bits = F.col("fail_bits")
    return ledger.withColumn("base_failed", bits.bitwiseAND(F.lit(mask_of(BASE))) != 0).withColumn(
        "kept", bits.bitwiseAND(F.lit(mask_of(policies[version]))) == 0
    )


def ablations(ledger: DataFrame, version: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per rule of a version: documents failing it, and documents that only it rejects.

    One aggregation over the distinct bit patterns, of which there are at most 2 to the number of rules.
    """
    chosen = policies[version]
    whole = mask_of(chosen)
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of((r,))).cast("long").alias("bit")) for r in chosen]))
    return (
        patterns.select("bits", "n", each.alias("r")).groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )
