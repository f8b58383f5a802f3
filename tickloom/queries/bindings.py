"""How the test tables play the roles of ticks, book, ledger and predictions.

Every binding exists twice, as a DataFrame and as SQL for the oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.clock import bucket_of, epoch_micros
from tickloom.operators.positions import positions_by_piece

DAY_US = 86_400_000_000
KEYS = ["symbol"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- events as ticks ---------------------------------------------------------


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("symbol"),
        "event_id",
        epoch_micros(F.col("ts")).alias("t_us"),
        F.when(kind.isin("purchase", "click"), "buy")
        .when(kind.isin("error", "signup"), "sell")
        .otherwise("quote")
        .alias("side"),
        F.floor("value").cast("double").alias("vol"),
        F.col("value").alias("score"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions_by_piece(
        raw_ticks(spark, sf_dir),
        KEYS,
        bucket_of(F.col("t_us"), DAY_US),
        ["t_us", "event_id"],
        "tick_seq",
    )


E_SQL = """
e AS (
  SELECT user_id AS symbol, event_id, epoch_us(ts) AS t_us,
         CASE WHEN event_type IN ('purchase','click') THEN 'buy'
              WHEN event_type IN ('error','signup') THEN 'sell' ELSE 'quote' END AS side,
         CAST(floor(value) AS DOUBLE) AS vol, value AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tick_seq
  FROM events)"""


# --- derived order book ------------------------------------------------------


BOOK_SIDES = {
    "bid_px": "{bid} - 5 * {k}",
    "ask_px": "{ask} + 5 * {k}",
    "bid_qty": "1 + (event_id * 31 + {i} * 17) % 199",
    "ask_qty": "1 + (event_id * 37 + {i} * 23) % 199",
}


def with_book(df: DataFrame) -> DataFrame:
    drift = "(10000 + 5 * ((event_id * 7919) % 41 - 20))"
    bid, ask = f"({drift} - 5 * (1 + event_id % 3))", f"({drift} + 5 * (1 + event_id div 3 % 3))"
    arrays = [
        "array("
        + ", ".join(f"double({form.format(bid=bid, ask=ask, i=i, k=i - 1)})" for i in range(1, 11))
        + f") AS {name}"
        for name, form in BOOK_SIDES.items()
    ]
    return df.selectExpr(
        "*",
        f"double({bid}) AS bid1",
        f"double({ask}) AS ask1",
        *arrays,
        f"if(side = 'sell', double({bid} + 5 * (event_id % 3 - 1)), NULL) AS sell_min_price",
        "if(side = 'buy', vol, 0D) AS buy_volume",
        "if(side = 'sell', vol, 0D) AS sell_volume",
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_book(ticks(spark, sf_dir))


B_SQL = (
    E_SQL
    + """,
b0 AS (
  SELECT *, 10000 + 5 * ((event_id * 7919) % 41 - 20) - 5 * (1 + event_id % 3) AS bb,
            10000 + 5 * ((event_id * 7919) % 41 - 20) + 5 * (1 + (event_id // 3) % 3) AS ba
  FROM e),
b AS (
  SELECT symbol, event_id, t_us, side, vol, score, tick_seq,
         CAST(bb AS DOUBLE) AS bid1, CAST(ba AS DOUBLE) AS ask1,
         [CAST(bb - 5 * (i - 1) AS DOUBLE) FOR i IN range(1, 11)] AS bid_px,
         [CAST(ba + 5 * (i - 1) AS DOUBLE) FOR i IN range(1, 11)] AS ask_px,
         [CAST(1 + (event_id * 31 + i * 17) % 199 AS DOUBLE) FOR i IN range(1, 11)] AS bid_qty,
         [CAST(1 + (event_id * 37 + i * 23) % 199 AS DOUBLE) FOR i IN range(1, 11)] AS ask_qty,
         CASE WHEN side = 'sell' THEN CAST(bb + 5 * (event_id % 3 - 1) AS DOUBLE) END AS sell_min_price,
         CASE WHEN side = 'buy' THEN vol ELSE 0.0::DOUBLE END AS buy_volume,
         CASE WHEN side = 'sell' THEN vol ELSE 0.0::DOUBLE END AS sell_volume
  FROM b0)"""
)


# --- ledger ------------------------------------------------------------------


def ledger(spark: SparkSession, sf_dir: str, graded: bool = False) -> DataFrame:
    """Decision ledger; with ``graded`` the contract id carries its quantile (``prefix:q0.85``)."""
    line, qty = F.col("l_linenumber"), F.col("l_quantity")
    status = F.when(line % 5 == 0, "CENSORED").when(line % 2 == 0, "UNFILLED").otherwise("FILLED")
    filled = F.col("status") == "FILLED"
    if graded:
        tag = F.element_at(
            F.array(F.lit(":q0.70"), F.lit(":q0.85"), F.lit(":q0.95")),
            (F.col("l_orderkey") % 3 + 1).cast("int"),
        )
        contract = F.concat("l_returnflag", tag)
    else:
        contract = F.concat("l_returnflag", "l_linestatus")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            contract.alias("contract_id"),
            F.col("l_suppkey").alias("symbol"),
            status.alias("status"),
            (qty - 25).alias("gross_bps"),
            F.when(qty <= 12, "PERSISTENT_ADVERSE")
            .when(qty <= 25, "COST_INSUFFICIENT")
            .when(qty <= 38, "EARLY_RECOVERY_LATE_REVERSAL")
            .otherwise("NET_RECOVERY")
            .alias("cohort"),
            (F.col("l_partkey") % 900).cast("double").alias("holding_seconds"),
            (F.col("l_orderkey") % 390).alias("minute_of_session"),
            F.element_at(
                F.array(F.lit("TARGET"), F.lit("STOP"), F.lit("TIME")),
                (F.col("l_partkey") % 3 + 1).cast("int"),
            ).alias("exit_reason"),
            (qty - 25 + F.col("l_tax") * 100).alias("max_favorable_gross_bps"),
            (qty - 25 - F.col("l_discount") * 100).alias("max_adverse_gross_bps"),
            F.col("l_orderkey").alias("order_id"),
        )
        .withColumn("net_bps", F.when(filled, F.col("gross_bps") - 23))
        .withColumn("cohort", F.when(filled, F.col("cohort")))
        .withColumn("exit_reason", F.when(filled, F.col("exit_reason")))
    )


L_SQL = """
l0 AS (
  SELECT l_returnflag || l_linestatus AS contract_id,
         l_returnflag || [':q0.70', ':q0.85', ':q0.95'][CAST(l_orderkey % 3 + 1 AS INT)] AS graded_id,
         l_suppkey AS symbol,
         CASE WHEN l_linenumber % 5 = 0 THEN 'CENSORED' WHEN l_linenumber % 2 = 0 THEN 'UNFILLED'
              ELSE 'FILLED' END AS status,
         l_quantity - 25 AS gross_bps,
         CASE WHEN l_quantity <= 12 THEN 'PERSISTENT_ADVERSE' WHEN l_quantity <= 25 THEN 'COST_INSUFFICIENT'
              WHEN l_quantity <= 38 THEN 'EARLY_RECOVERY_LATE_REVERSAL' ELSE 'NET_RECOVERY' END AS cohort0,
         CAST(l_partkey % 900 AS DOUBLE) AS holding_seconds, l_orderkey % 390 AS minute_of_session,
         ['TARGET', 'STOP', 'TIME'][CAST(l_partkey % 3 + 1 AS INT)] AS exit0,
         l_quantity - 25 + l_tax * 100 AS max_favorable_gross_bps,
         l_quantity - 25 - l_discount * 100 AS max_adverse_gross_bps, l_orderkey AS order_id
  FROM lineitem),
l AS (
  SELECT * EXCLUDE (cohort0, exit0), CASE WHEN status = 'FILLED' THEN gross_bps - 23 END AS net_bps,
         CASE WHEN status = 'FILLED' THEN cohort0 END AS cohort,
         CASE WHEN status = 'FILLED' THEN exit0 END AS exit_reason
  FROM l0)"""


# --- predictions -------------------------------------------------------------

P_ORDER = (
    "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()


ORDERS_PER_PIECE_BITS = 20


def predictions(spark: SparkSession, sf_dir: str, sequenced: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Two prediction columns per row; with ``sequenced`` also the row's place in its symbol; ``keep`` adds columns as they are."""
    base = table(spark, sf_dir, "lineitem")
    keep = [*keep, "tick_seq"] if sequenced else keep
    if sequenced:
        piece = F.shiftright("l_orderkey", ORDERS_PER_PIECE_BITS)
        base = positions_by_piece(base, ["l_suppkey"], piece, P_ORDER, "tick_seq")
    return base.select(
        *keep,
        F.col("l_suppkey").alias("symbol"),
        F.when(F.col("l_linestatus") == "F", "eval1").otherwise("eval2").alias("eval_set"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        F.col("l_quantity").alias("pred_a"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("pred_b"),
        (1 + F.col("l_linenumber")).cast("double").alias("w"),
        (F.col("l_suppkey") % 3).alias("tick_group"),
        (F.floor(F.col("l_suppkey") / 3) % 3).alias("liq_group"),
    )


P_SQL = f"""
p AS (
  SELECT l_suppkey AS symbol, CASE WHEN l_linestatus = 'F' THEN 'eval1' ELSE 'eval2' END AS eval_set,
         l_extendedprice / 1000 AS y, l_quantity AS pred_a, l_quantity * (1 - l_discount) AS pred_b,
         CAST(1 + l_linenumber AS DOUBLE) AS w, l_suppkey % 3 AS tick_group, (l_suppkey // 3) % 3 AS liq_group,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(P_ORDER)}) AS tick_seq
  FROM lineitem)"""


# --- vectors -----------------------------------------------------------------


WIDTH = 64
VECTOR_COLUMNS = [f"x{i}" for i in range(WIDTH)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(VECTOR_COLUMNS)],
    )


V_SQL = f"""
v AS (SELECT vec_id, {', '.join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(VECTOR_COLUMNS))} FROM embeddings),
vl AS MATERIALIZED (SELECT vec_id, unnest(range({WIDTH})) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"""
