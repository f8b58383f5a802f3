"""Decision ledgers: summaries, ranking, fill economics.

A ledger row is one decision of a contract on a symbol. ``CENSORED`` decisions could not be
observed to the end and never enter a denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.book import FEE_BPS
from tickloom.functions.numeric import ratio
from tickloom.operators.positions import sorted_positions
from tickloom.operators.quantiles import grouped_medians, grouped_quantiles
from tickloom.session import cut_lineage

MIN_SCORABLE = 200

# The loss cohorts of a filled decision.
COHORTS = (
    "NET_RECOVERY",
    "EARLY_RECOVERY_LATE_REVERSAL",
    "COST_INSUFFICIENT",
    "PERSISTENT_ADVERSE",
)


def is_filled() -> Column:
    return F.col("status") == "FILLED"


def is_scorable() -> Column:
    return F.col("status").isin("FILLED", "UNFILLED")


def contract_summary(ledger: DataFrame, by: Sequence[str] = ("contract_id",)) -> DataFrame:
    """One row per contract with every denominator next to the totals it belongs to."""
    counts = [
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(is_scorable()).alias("scorable"),
        F.count_if(is_filled()).alias("fills"),
        F.count_if(F.col("status") == "UNFILLED").alias("unfilled"),
        F.count_if(F.col("status") == "CENSORED").alias("censored"),
        F.coalesce(F.sum(F.when(is_filled(), F.col("net_bps"))), F.lit(0.0)).alias("total_net_bps"),
    ]
    cohorts = [
        F.count_if(is_filled() & (F.col("cohort") == name)).alias(f"cohort_{name}") for name in COHORTS
    ]
    net, scorable = F.col("total_net_bps"), F.col("scorable")
    return (
        ledger.groupBy(*by)
        .agg(*counts, *cohorts)
        .withColumn("bps_per_decision", ratio(net, scorable))
        .withColumn("positive", (scorable > 0) & (net > 0))
    )


def ranking_order() -> list[Column]:
    return [
        F.col("total_net_bps").desc(),
        F.col("bps_per_decision").desc(),
        F.col("contract_id").asc(),
    ]


def rank_contracts(summary: DataFrame, min_scorable: int = MIN_SCORABLE) -> DataFrame:
    """Eligible contracts with their place by total net; the rate only breaks ties."""
    eligible = summary.filter(F.col("scorable") >= min_scorable)
    falling = [-F.col("total_net_bps"), -F.col("bps_per_decision"), F.col("contract_id")]
    return sorted_positions(cut_lineage(eligible), [], falling, "place")


def best_per_kind(
    summary: DataFrame, kind: str, min_scorable: int = MIN_SCORABLE
) -> DataFrame:
    """The first contract of each kind under the ranking rule."""
    window = Window.partitionBy(kind).orderBy(*ranking_order())
    return (
        summary.filter(F.col("scorable") >= min_scorable)
        .withColumn("_place", F.row_number().over(window))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def duplicate_groups(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Contracts with identical metric vectors share a leader (their lowest id).

    Members stay one per row, so a vector shared by very many contracts is no single big cell.
    """
    leaders = summary.groupBy(*metrics).agg(
        F.min("contract_id").alias("leader"), F.count(F.lit(1)).alias("group_size")
    )
    same = [summary[m].eqNullSafe(leaders[m]) for m in metrics]
    return summary.join(leaders, same).select("leader", "contract_id", "group_size")


def value_shares(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Counts of each value and its share within ``by``; missing values are left out."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counted.groupBy(*by).agg(F.sum("n").alias("_total"))
    return counted.join(totals, list(by)).withColumn("share", ratio(F.col("n"), F.col("_total"))).drop("_total")


def top_values(df: DataFrame, value: Column, k: int, name: str = "value") -> DataFrame:
    """The ``k`` most frequent values, ties in ascending order."""
    return (
        df.groupBy(value.alias(name))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(name).asc())
        .limit(k)
    )


def symbol_vectors(ledger: DataFrame) -> DataFrame:
    """Sums per contract and symbol. Pairs without decisions are implied zeros and not stored."""
    return ledger.groupBy("contract_id", "symbol").agg(
        F.coalesce(F.sum(F.when(is_filled(), F.col("net_bps"))), F.lit(0.0)).alias("net"),
        F.coalesce(F.sum(F.when(is_filled(), F.col("gross_bps"))), F.lit(0.0)).alias("gross"),
        F.count_if(is_filled()).alias("fills"),
        F.count_if(is_scorable()).alias("scorable"),
        F.count(F.lit(1)).alias("decisions"),
    )


PLACES_PER_BLOCK = 4_096


def full_symbol_vectors(ledger: DataFrame, contracts: DataFrame, symbols: DataFrame) -> DataFrame:
    """:func:`symbol_vectors` over every contract of ``contracts`` and every symbol of ``symbols``, zero where there is no decision.

    Contracts without any row have their zeros too; decisions of symbols or contracts outside the lists are left
    out. Each contract notes, block by block of the numbered symbols, which it has seen; the unseen
    numbers of a block are spelled out and looked up, so only the rows of the result are made.
    """
    numbered = cut_lineage(sorted_positions(symbols.select("symbol").distinct(), [], [F.col("symbol")], "_place"))
    count = numbered.count()
    listed = contracts.select("contract_id").distinct()
    known = cut_lineage(
        symbol_vectors(ledger).join(listed, "contract_id", "left_semi").join(numbered, "symbol").withColumn("_place", F.col("_place") - 1)
    )
    if not count:
        return known.drop("_place")
    block = F.floor(F.col("_place") / PLACES_PER_BLOCK).cast("int")
    seen = known.groupBy("contract_id", block.alias("_block")).agg(F.collect_set((F.col("_place") % PLACES_PER_BLOCK).cast("int")).alias("_seen"))
    blocks = F.sequence(F.lit(0), F.lit((count - 1) // PLACES_PER_BLOCK))
    every = listed.select("contract_id", F.explode(blocks).alias("_block")).join(seen, ["contract_id", "_block"], "left")
    size = F.least(F.lit(PLACES_PER_BLOCK), F.lit(count) - F.col("_block") * PLACES_PER_BLOCK)
    unseen = F.array_except(F.sequence(F.lit(0), (size - 1).cast("int")), F.coalesce("_seen", F.array().cast("array<int>")))
    absent = every.select("contract_id", "_block", F.explode(unseen).alias("_at")).select(
        "contract_id", (F.col("_block") * F.lit(PLACES_PER_BLOCK) + F.col("_at") + 1).cast("long").alias("_place")
    )
    zeros = {c: F.lit(0).cast(known.schema[c].dataType) for c in ("net", "gross", "fills", "scorable", "decisions")}
    added = absent.join(numbered, "_place").select("contract_id", "symbol", *[v.alias(n) for n, v in zeros.items()])
    return known.drop("_place").unionByName(added)


def full_contract_summary(ledger: DataFrame, contracts: DataFrame) -> DataFrame:
    """:func:`contract_summary` for every contract of ``contracts``; counts and totals are zero where it has no row."""
    made = contract_summary(ledger)
    counted = [c for c in made.columns if c not in ("contract_id", "bps_per_decision", "positive")]
    joined = contracts.select("contract_id").distinct().join(made, "contract_id", "left")
    return joined.na.fill(0, counted).na.fill(False, ["positive"]).select(*made.columns)


def fill_economics(ledger: DataFrame) -> DataFrame:
    """Per contract: means per fill, fill rate, median holding, cohort shares, active symbols."""
    summary = contract_summary(ledger)
    extra = ledger.groupBy("contract_id").agg(
        F.avg(F.when(is_filled(), F.col("net_bps"))).alias("net_per_fill"),
        F.avg(F.when(is_filled(), F.col("gross_bps"))).alias("gross_per_fill"),
        F.countDistinct("symbol").alias("symbols_with_decisions"),
    )
    holding = grouped_quantiles(
        ledger.filter(is_filled()), ["contract_id"], "holding_seconds", {"holding_median": 0.5}
    )
    shares = [
        ratio(F.col(f"cohort_{name}"), F.col("fills")).alias(f"share_{name}") for name in COHORTS
    ]
    return (
        summary.join(extra, "contract_id")
        .join(holding, "contract_id", "left")
        .select(
            "contract_id",
            "net_per_fill",
            "gross_per_fill",
            ratio(F.col("fills"), F.col("scorable")).alias("fill_rate"),
            "holding_median",
            *shares,
            "symbols_with_decisions",
        )
    )


def fill_distribution(ledger: DataFrame, fee_bps: float = FEE_BPS) -> DataFrame:
    """Shape of the filled decisions of each contract."""
    fills = ledger.filter(is_filled())
    gross = F.col("gross_bps")

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    shares = fills.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("fills"),
        share(gross >= fee_bps).alias("share_gross_ge_fee"),
        share(gross > 0).alias("share_gross_pos"),
        share(gross == 0).alias("share_gross_zero"),
        share(F.col("net_bps") > 0).alias("share_net_pos"),
    )
    cuts = grouped_quantiles(
        fills,
        ["contract_id"],
        "gross_bps",
        {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9},
    )
    excursions = grouped_medians(
        fills, ["contract_id"], ["max_favorable_gross_bps", "max_adverse_gross_bps", "holding_seconds"]
    )
    return shares.join(cuts, "contract_id").join(excursions, "contract_id")


def median_decision_and_fill(ledger: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature medians over all decisions and over fills, one row per contract and population."""
    tagged = ledger.select(
        "contract_id",
        *features,
        F.explode(
            F.when(is_filled(), F.array(F.lit("decision"), F.lit("fill"))).otherwise(
                F.array(F.lit("decision"))
            )
        ).alias("population"),
    )
    return grouped_medians(tagged, ["contract_id", "population"], features)


def economics_by_group(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """Decision and fill economics per label and group, with distinct symbols."""
    filled = is_filled()
    return ledger.groupBy(*by).agg(
        F.countDistinct("symbol").alias("symbols"),
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(filled).alias("fills"),
        F.avg(F.when(filled, F.col("gross_bps"))).alias("gross_mean"),
        F.avg(F.when(filled, F.col("net_bps"))).alias("net_mean"),
        F.avg(F.when(filled, (F.col("net_bps") > 0).cast("double"))).alias("share_net_pos"),
        F.coalesce(F.sum(F.when(filled, F.col("net_bps"))), F.lit(0.0)).alias("net_total"),
    )


def split_contract_id(df: DataFrame) -> DataFrame:
    """``prefix:q0.85`` becomes ``prefix`` and ``q``."""
    parts = F.split("contract_id", ":q")
    return df.withColumns({"prefix": parts[0], "q": parts[1].cast("double")})


def attach_labels(summary: DataFrame, labels: DataFrame) -> DataFrame:
    """Name contracts by their prefix and keep the rows at the label's own quantile."""
    return (
        split_contract_id(summary)
        .join(labels, "prefix")
        .filter(F.col("q") == F.col("label_q"))
        .drop("label_q")
    )


def same_quantile_differences(summary: DataFrame, left: str) -> DataFrame:
    """Metric difference between contract family ``left`` and each other family at equal q."""
    parts = split_contract_id(summary).select("prefix", "q", "bps_per_decision")
    base = parts.filter(F.col("prefix") == left).select("q", F.col("bps_per_decision").alias("_base"))
    return (
        parts.filter(F.col("prefix") != left)
        .join(base, "q")
        .select("prefix", "q", (F.col("_base") - F.col("bps_per_decision")).alias("diff"))
    )


def ledger_differences(
    ledger: DataFrame, left: str, right: str, columns: Sequence[str]
) -> DataFrame:
    """Rows that one contract has more often than another; empty when the ledgers agree."""
    sign = F.when(F.col("contract_id") == left, 1).otherwise(-1)
    return (
        ledger.filter(F.col("contract_id").isin(left, right))
        .groupBy(*columns)
        .agg(F.sum(sign).alias("surplus"))
        .filter(F.col("surplus") != 0)
    )


def attempt_count(contracts: DataFrame, grid_size: int) -> DataFrame:
    """Number of strategies tried: contract entries times grid points."""
    return contracts.agg((F.countDistinct("contract_id") * grid_size).alias("attempts"))
