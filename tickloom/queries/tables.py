"""Registered queries on the dimension tables, the vectors, and source/sink round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.clock import bucket_of
from tickloom.operators import joins, metrics, ranking, sampling
from tickloom.operators.positions import sorted_positions
from tickloom.operators.quantiles import grouped_quantiles
from tickloom.plans import ledger as ledger_plan
from tickloom.plans import selection, verdicts
from tickloom.queries.bindings import (
    DAY_US,
    E_SQL,
    L_SQL,
    V_SQL,
    VECTOR_COLUMNS,
    WIDTH,
    book,
    ledger,
    raw_ticks,
    table,
    vectors,
)
from tickloom.queries.book import COVARIATES_CTE, WITH_B, covariates
from tickloom.queries.registry import draw_sql, query, r6, rounded
from tickloom.session import cut_lineage
from tickloom.sources import tables as store
from tickloom.sources import ticks as source

SEED = 9

# --- sources and sinks -------------------------------------------------------


@query(
    "s01_list_symbol_files",
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code FROM supplier WHERE s_nationkey <> 4""",
)
def list_symbol_files(spark, sf):
    """Writes one folder per code, some codes twice, and lists those with exactly one file."""
    path = store.scratch_path(spark, "files")
    code = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    rows = table(spark, sf, "supplier").withColumn("code", code)
    columns = [c for c in rows.columns if c != "code"]
    for name, part in (("a", rows), ("b", rows.filter(F.col("s_nationkey") == 4))):
        source.write_keyed_files(part, f"{path}/{name}", ["code"], "code={code}/part.parquet", columns)
    return source.list_files(spark, path, r"code=([0-9]+)/[^/]*\.parquet$").select("code")


MASTER_SQL = """
ms AS (SELECT lpad(CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 10 = 0 THEN 5 ELSE 6 END, '0') AS issue_code,
         CASE WHEN p_size % 4 = 0 THEN 'EF' ELSE 'ST' END AS asset_type, p_partkey FROM part)"""


@query(
    "s02_selection_ladder",
    f"""WITH {MASTER_SQL} SELECT DISTINCT issue_code FROM ms WHERE asset_type = 'ST'
        AND regexp_matches(issue_code, '^[0-9]{{6}}$') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)""",
)
def selection_ladder(spark, sf):
    key = F.col("p_partkey").cast("string")
    master = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 10 == 0, F.lpad(key, 5, "0")).otherwise(F.lpad(key, 6, "0")).alias("issue_code"),
        F.when(F.col("p_size") % 4 == 0, "EF").otherwise("ST").alias("asset_type"),
    )
    traded = table(spark, sf, "lineitem").filter(F.col("l_quantity") > 40).select(
        F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("code")
    )
    return source.eligible_symbols(master, traded)


@query(
    "s07_keyed_csv",
    "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, s_nationkey % 3 AS tick_group FROM supplier",
)
def keyed_csv(spark, sf):
    path = store.scratch_path(spark, "groups")
    store.write_csv(
        table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("symbol"), (F.col("s_nationkey") % 3).alias("tick_group")
        ),
        path,
    )
    return store.read_keyed_csv(spark, path, "symbol string, tick_group int", "symbol")


@query(
    "s08_write_covariates",
    f"""{WITH_B}, {COVARIATES_CTE} SELECT lpad(CAST(symbol AS VARCHAR), 6, '0') AS symbol, tick,
        round(mean_spread_ticks, 6) AS mean_spread_ticks FROM cv""",
)
def write_covariates(spark, sf):
    path = store.scratch_path(spark, "covariates")
    store.write_csv(covariates(spark, sf).select("symbol", "tick", "mean_spread_ticks"), path)
    return rounded(
        store.read_keyed_csv(spark, path, "symbol string, tick double, mean_spread_ticks double", "symbol")
    )


@query(
    "s11_ledger_round_trip",
    f"WITH {L_SQL} SELECT contract_id, status, count(*) AS n, round(sum(net_bps), 4) AS net FROM l GROUP BY 1, 2",
)
def ledger_round_trip(spark, sf):
    path = store.scratch_path(spark, "ledger")
    ledger(spark, sf).write.parquet(path)
    return spark.read.parquet(path).groupBy("contract_id", "status").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("net_bps"), "net", 4)
    )


@query(
    "s12_score_files",
    f"""WITH {E_SQL} SELECT symbol, count(*) AS n, round(sum(score * 2), 4) AS total FROM e GROUP BY 1""",
)
def score_files(spark, sf):
    path = store.scratch_path(spark, "scores")
    ticks = book(spark, sf).select(
        "symbol", "tick_seq", (F.col("t_us") / 1e6).alias("time_s"), "bid1", "score"
    )
    both = ranking.union_blocks(
        {"once": ticks, "twice": ticks.withColumn("score", F.col("score") * 2)}, "model"
    )
    store.write_scores(both, path)
    back = spark.read.parquet(path).filter(F.col("model") == "twice")
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score"), "total", 4))


@query(
    "s13_json_report",
    f"""WITH {L_SQL} SELECT contract_id, '{{"contract_id":"' || contract_id || '","decisions":' || count(*) || '}}' AS report
        FROM l GROUP BY 1""",
)
def json_report(spark, sf):
    path = store.scratch_path(spark, "report")
    summary = ledger_plan.contract_summary(ledger(spark, sf)).select("contract_id", "decisions")
    store.write_json_report(summary, path)
    back = store.read_nested_json(spark, path, "contract_id string, decisions long")
    return back.select("contract_id", F.to_json(F.struct("contract_id", "decisions")).alias("report"))


COHORT_COLS = [f"cohort_{c}" for c in ledger_plan.COHORTS]


@query(
    "s14_nested_json_state",
    f"WITH {L_SQL} SELECT contract_id, cohort, count(*) AS n FROM l WHERE cohort IS NOT NULL GROUP BY 1, 2",
)
def nested_json_state(spark, sf):
    path = store.scratch_path(spark, "state")
    summary = ledger_plan.contract_summary(ledger(spark, sf))
    entries = F.array(
        *[F.struct(F.lit(c).alias("cohort"), F.col(f"cohort_{c}").alias("n")) for c in ledger_plan.COHORTS]
    )
    nested = summary.select(F.struct("contract_id", entries.alias("cohorts")).alias("state"))
    store.write_json_report(nested, path)
    back = store.read_nested_json(
        spark, path, "state struct<contract_id: string, cohorts: array<struct<cohort: string, n: long>>>"
    )
    return back.select("state.contract_id", F.inline("state.cohorts")).filter(F.col("n") > 0)


@query(
    "s15_tick_table_round_trip",
    f"""WITH {E_SQL} SELECT symbol, max(tick_seq) AS last_seq, count(*) AS n FROM e GROUP BY 1""",
)
def tick_table_round_trip(spark, sf):
    path = store.scratch_path(spark, "ticks")
    rows = source.sequence_ticks(raw_ticks(spark, sf), ["symbol"], "t_us", ["event_id"], DAY_US)
    store.write_ticks(rows.withColumn("date", bucket_of(F.col("t_us"), DAY_US)), path)
    return spark.read.parquet(path).groupBy("symbol").agg(
        F.max("tick_seq").alias("last_seq"), F.count(F.lit(1)).alias("n")
    )


# --- joins -------------------------------------------------------------------


@query(
    "j01_master_with_files",
    "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
)
def master_with_files(spark, sf):
    sold = table(spark, sf, "lineitem").filter(F.col("l_quantity") == 50).select(
        F.col("l_partkey").alias("p_partkey")
    )
    return joins.semi_join(table(spark, sf, "part"), sold, ["p_partkey"]).select("p_partkey", "p_brand")


CONTRACTS = ["e000", "e001", "e002", "naive", "null"]
GRID = [0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.99]


@query(
    "j07_parameter_table",
    f"""SELECT c AS contract_id, c || ':q' || printf('%.2f', q::DOUBLE) AS graded_id, s_suppkey, 'theta' AS theta,
        q::DOUBLE AS q FROM supplier, (SELECT unnest({CONTRACTS!r}) AS c), (SELECT unnest({GRID!r}::DOUBLE[]) AS q)""",
)
def parameter_table(spark, sf):
    contracts = spark.createDataFrame([(c,) for c in CONTRACTS], "contract_id string")
    return joins.parameter_table(table(spark, sf, "supplier"), "s_suppkey", contracts, GRID)


@query(
    "j08_colliding_contract_ids",
    """WITH c AS (SELECT DISTINCT 'c' || (o_custkey % 20) AS base, (o_orderkey % 300) / 300.0::DOUBLE AS q FROM orders)
       SELECT base || ':q' || printf('%.2f', q) AS graded_id, count(DISTINCT q) AS n FROM c GROUP BY 1
       HAVING count(DISTINCT q) > 1""",
)
def colliding_contract_ids(spark, sf):
    contracts = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey") % 20).alias("base"),
        ((F.col("o_orderkey") % 300) / 300.0).alias("q"),
    )
    return joins.colliding_ids(contracts.distinct(), F.col("base"), F.col("q"))


# --- aggregates and sets -----------------------------------------------------


@query(
    "a04_range_per_group",
    """SELECT c_nationkey, round(min(c_acctbal), 6) AS lowest, round(max(c_acctbal), 6) AS highest, count(*) AS size
       FROM customer GROUP BY 1""",
)
def range_per_group(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(
        r6(F.min("c_acctbal"), "lowest"), r6(F.max("c_acctbal"), "highest"), F.count(F.lit(1)).alias("size")
    )


@query(
    "a40_universe_overlap",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) % 2 = 0),
            b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) % 2 = 1)
       SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS in_both,
              count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL) AS new
       FROM a FULL JOIN b ON a.k = b.k""",
)
def universe_overlap(spark, sf):
    orders = table(spark, sf, "orders")
    year = F.year("o_orderdate")
    return joins.overlap_counts(
        orders.filter(year % 2 == 0), orders.filter(year % 2 == 1), "o_custkey"
    )


@query(
    "t01_first_codes_per_stratum",
    """SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn
       FROM supplier) WHERE rn <= 3""",
)
def first_codes_per_stratum(spark, sf):
    return ranking.first_per_group(
        table(spark, sf, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], ["s_suppkey"], 3
    )


@query(
    "u02_set_intersection",
    """SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000""",
)
def set_intersection(spark, sf):
    rich = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k"))
    big = table(spark, sf, "orders").filter(F.col("o_totalprice") > 200000).select(F.col("o_custkey").alias("k"))
    return ranking.common_members(rich, big)


@query(
    "u03_disjoint_splits",
    """WITH t AS (SELECT c_custkey AS k, 'a' AS part FROM customer WHERE c_nationkey % 3 = 0
            UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_nationkey % 3 = 1 OR c_custkey % 50 = 0
            UNION ALL SELECT c_custkey, 'c' FROM customer WHERE c_nationkey % 3 = 2),
        n AS (SELECT k, count(*) AS n FROM t GROUP BY 1)
        SELECT part, count(*) AS members, count(*) FILTER (n > 1) AS shared FROM t JOIN n USING (k) GROUP BY 1""",
)
def disjoint_splits(spark, sf):
    rows = table(spark, sf, "customer")
    third = F.col("c_nationkey") % 3
    parts = {
        "a": rows.filter(third == 0),
        "b": rows.filter((third == 1) | (F.col("c_custkey") % 50 == 0)),
        "c": rows.filter(third == 2),
    }
    return ranking.shared_members(parts, "c_custkey")


@query(
    "u04_missing_pairs",
    """SELECT DISTINCT l_suppkey, l_partkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (
         SELECT 1 FROM lineitem b WHERE b.l_returnflag <> 'R' AND b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey)""",
)
def missing_pairs(spark, sf):
    rows = table(spark, sf, "lineitem")
    returned, kept = rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag <> 'R'")
    return ranking.missing_pairs(returned, kept, ["l_suppkey", "l_partkey"])


# --- splits ------------------------------------------------------------------


def split_sql(source: str, stratum: str, ident: str, seed: int) -> str:
    fraction = 1.0 - 2 / 3
    return f"""
o_{source} AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {draw_sql(seed, ident)}, {ident}) AS place,
        count(*) OVER (PARTITION BY {stratum}) AS n FROM {source}),
r_{source} AS (SELECT {stratum}, {ident}, CASE WHEN n >= 2 AND place <= least(greatest(1, round(n * {fraction!r})), n - 1)
        THEN 'select' ELSE 'fit' END AS role FROM o_{source})"""


@query(
    "r03_stratified_split",
    f"WITH {split_sql('customer', 'c_nationkey', 'c_custkey', SEED)} SELECT c_nationkey, c_custkey, role FROM r_customer",
)
def stratified_split(spark, sf):
    members = table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    return sampling.stratified_split(members, "c_nationkey", "c_custkey", SEED)


@query(
    "r04_three_way_split",
    f"""WITH cand AS (SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey
            ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 5),
        pl AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY {draw_sql(1, 'c_custkey')}, c_custkey) AS pos
               FROM cand),
        rest AS (SELECT c_nationkey, c_custkey FROM pl WHERE pos > 2), {split_sql('rest', 'c_nationkey', 'c_custkey', SEED)}
        SELECT c_nationkey, c_custkey, 'reference' AS role FROM pl WHERE pos <= 2
        UNION ALL SELECT c_nationkey, c_custkey, role FROM r_rest""",
)
def three_way_split(spark, sf):
    members = table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    return sampling.three_way_split(
        members,
        "c_nationkey",
        "c_custkey",
        reference_per_stratum=2,
        distill_per_stratum=3,
        seed=1,
        split_seed=SEED,
    )


GROUP_SPLIT_CTE = f"""
gs AS (SELECT grp, symbol, CASE WHEN place <= n // 6 THEN 'eval' WHEN place <= 2 * (n // 6) THEN 'select' ELSE 'train' END AS role
       FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {draw_sql(SEED, 'symbol')}, symbol) AS place,
                    count(*) OVER (PARTITION BY grp) AS n
             FROM (SELECT DISTINCT user_id % 3 AS grp, user_id AS symbol FROM events)))"""


def group_split(spark, sf):
    members = table(spark, sf, "events").select(
        (F.col("user_id") % 3).alias("grp"), F.col("user_id").alias("symbol")
    ).distinct()
    return sampling.group_split(members, "grp", "symbol", SEED)


@query("r05_group_preserving_split", f"WITH {GROUP_SPLIT_CTE} SELECT grp, symbol, role FROM gs")
def group_preserving_split(spark, sf):
    return group_split(spark, sf)


@query(
    "r06_sets_by_role_and_date",
    f"""WITH {E_SQL}, {GROUP_SPLIT_CTE}, ru AS (SELECT * FROM (VALUES ('train', 19723, 'fit'), ('train', 19724, 'fit'),
          ('select', 19725, 'select'), ('eval', 19726, 'eval1'), ('train', 19726, 'eval2')) t(role, day, set_name))
        SELECT set_name, count(*) AS n, count(DISTINCT symbol) AS symbols FROM e JOIN gs USING (symbol) JOIN ru
          ON gs.role = ru.role AND e.t_us // 86400000000 = ru.day GROUP BY 1""",
)
def sets_by_role_and_date(spark, sf):
    rules = spark.createDataFrame(
        [("train", 19723, "fit"), ("train", 19724, "fit"), ("select", 19725, "select"),
         ("eval", 19726, "eval1"), ("train", 19726, "eval2")],
        "role string, day long, set_name string",
    )
    rows = raw_ticks(spark, sf).select("symbol", bucket_of(F.col("t_us"), DAY_US).alias("day"))
    assigned = sampling.assign_sets(rows, group_split(spark, sf), "symbol", "day", rules)
    return assigned.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols")
    )


# --- vectors -----------------------------------------------------------------


@query(
    "a32_mean_and_covariance",
    f"""WITH {V_SQL} SELECT 'x' || a.i AS a, 'x' || b.i AS b, round(covar_samp(a.x, b.x), 6) AS cov, round(avg(a.x), 6) AS mean_a
        FROM vl a JOIN vl b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""",
)
def mean_and_covariance(spark, sf):
    return rounded(metrics.covariance_rows(vectors(spark, sf), VECTOR_COLUMNS))


# The covariance is inverted by sweeping its columns one after the other; the swept matrix is minus the inverse.
REGION_CTE = f"""{V_SQL},
mv AS (SELECT i, avg(x) AS m FROM vl GROUP BY 1), dv AS MATERIALIZED (SELECT vec_id, vl.i, x - m AS x FROM vl JOIN mv USING (i)),
s0 AS MATERIALIZED (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS s FROM dv a JOIN dv b ON a.vec_id = b.vec_id GROUP BY 1, 2),
sw AS (SELECT 0 AS k, list(s ORDER BY i, j) AS s FROM s0 UNION ALL
  SELECT k + 1, list_transform(range({WIDTH * WIDTH}), lambda t: CASE WHEN t = k * {WIDTH + 1} THEN -1 / s[k * {WIDTH + 1} + 1]
    WHEN t // {WIDTH} = k OR t % {WIDTH} = k THEN s[t + 1] / s[k * {WIDTH + 1} + 1]
    ELSE s[t + 1] - s[t // {WIDTH} * {WIDTH} + k + 1] * s[k * {WIDTH} + t % {WIDTH} + 1] / s[k * {WIDTH + 1} + 1] END) FROM sw WHERE k < {WIDTH}),
iv AS MATERIALIZED (SELECT unnest(range({WIDTH * WIDTH})) // {WIDTH} AS i, unnest(range({WIDTH * WIDTH})) % {WIDTH} AS j, unnest(s) AS s
  FROM sw WHERE k = {WIDTH}),
ds AS MATERIALIZED (SELECT a.vec_id, sqrt(greatest(-sum(a.x * s * b.x), 0)) AS distance FROM dv a JOIN iv USING (i) JOIN dv b
         ON a.vec_id = b.vec_id AND b.i = j GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rn, count(*) OVER () AS n FROM ds),
ra AS (SELECT quantile_cont(distance, 0.99) AS radius FROM ds)"""


@query(
    "r02_trust_region",
    f"""WITH RECURSIVE {REGION_CTE} SELECT vec_id, round(distance, 6) AS distance, distance <= radius AS on_manifold FROM ds, ra""",
)
def trust_region(spark, sf):
    region = selection.trust_region(vectors(spark, sf), VECTOR_COLUMNS)
    return region.select("vec_id", r6("distance"), "on_manifold")


@query(
    "w15_tail_weights",
    f"""WITH RECURSIVE {REGION_CTE}, wt AS (SELECT vec_id, 1 + 4 * rn / (n - 1) AS w FROM rk WHERE {draw_sql(2, 'vec_id')} < 2147483648)
        SELECT vec_id, round(w / sum(w) OVER () * count(*) OVER (), 6) AS weight FROM wt""",
)
def tail_weights(spark, sf):
    from tickloom.functions.draws import draw

    weighted = selection.tail_weights(
        selection.trust_region(vectors(spark, sf), VECTOR_COLUMNS), "distance", ["vec_id"]
    )
    chosen = weighted.filter(draw(2, F.col("vec_id")) < 2_147_483_648)
    return selection.renormalise(chosen, "weight").select("vec_id", r6("weight"))


@query(
    "r02_select_rows",
    f"""WITH RECURSIVE {REGION_CTE}, o AS (SELECT *, row_number() OVER (ORDER BY {draw_sql(SEED, 'vec_id')}, vec_id) AS place FROM rk),
        ch AS (SELECT vec_id, distance <= radius AS on_manifold, 1 + 4 * rn / (n - 1) AS w FROM o, ra WHERE place <= 200)
        SELECT vec_id, on_manifold, round(w / sum(w) OVER () * count(*) OVER (), 6) AS weight FROM ch""",
)
def select_rows(spark, sf):
    chosen = selection.select_rows(vectors(spark, sf), VECTOR_COLUMNS, ["vec_id"], 200, seed=SEED)
    return chosen.select("vec_id", "on_manifold", r6("weight"))


@query(
    "r09_uniform_box_sample",
    f"""WITH {V_SQL}, q AS (SELECT {', '.join(
        f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in VECTOR_COLUMNS)} FROM v)
        SELECT draw_id, {', '.join(
        f"round(lo_{c} + (hi_{c} - lo_{c}) * {draw_sql(SEED, chr(39) + c + chr(39), 'draw_id')} / 4294967296.0::DOUBLE, 6) AS {c}"
        for c in VECTOR_COLUMNS)} FROM range(500) r(draw_id), q""",
)
def uniform_box_sample(spark, sf):
    return rounded(sampling.uniform_box(vectors(spark, sf), VECTOR_COLUMNS, 500, SEED))


# --- verdict tables ----------------------------------------------------------

LAWS_CTE = """
cb AS (SELECT r_regionkey + 1 AS k, c_acctbal, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
lw AS (SELECT 'L' || k AS law, avg(c_acctbal) AS score, stddev_samp(c_acctbal) AS sd, count(*) AS n FROM cb GROUP BY 1)"""


def law_scores(spark, sf):
    """Five scored laws, one per region, from customer balances."""
    named = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("law", F.concat(F.lit("L"), F.col("r_regionkey") + 1))
    )
    return named.groupBy("law").agg(
        F.avg("c_acctbal").alias("score"),
        F.stddev_samp("c_acctbal").alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )


def _gate_sql(limit: float) -> str:
    return f"""g AS (SELECT count(*) AS n_laws, count(*) FILTER (score > {limit}) AS n_recovered,
          count(*) FILTER (law IN ('L1', 'L2') AND score <= {limit}) AS veto_failed FROM lw)
        SELECT *, CASE WHEN n_recovered <= 2 THEN 'stop' WHEN veto_failed = 2 THEN 'hold' ELSE 'proceed' END AS verdict FROM g"""


@query("d05_law_gate", f"WITH {LAWS_CTE}, {_gate_sql(4400.0)}")
def law_gate(spark, sf):
    scored = law_scores(spark, sf).select("law", (F.col("score") > 4400.0).alias("recovered"))
    return verdicts.law_gate(scored)


GRADED_CTE = f"""{LAWS_CTE},
gi AS (SELECT law, sd < 3175 AS control_clean, score > 4300 AS eligible, score - sd / sqrt(n) AS lo, score + sd / sqrt(n) AS hi,
         score * CASE WHEN n % 2 = 0 THEN 1 ELSE 0.99 END AS s, score * 0.98 AS sb, score + 100 AS sn FROM lw),
gd AS (SELECT law, CASE WHEN NOT control_clean THEN 'untrusted' WHEN s IS NULL THEN 'not distilled'
         WHEN NOT eligible THEN 'ineligible' ELSE 'graded' END AS status, s >= lo AS recovered, s > hi AS exceeds_ceiling,
         sb > s AS no_added_value, sn > s + 0.05 AS teacher_harmed, eligible, control_clean, s AS score FROM gi)"""


def graded_laws(spark, sf):
    half = F.col("sd") / F.sqrt("n")
    return law_scores(spark, sf).select(
        "law",
        (F.col("sd") < 3175).alias("control_clean"),
        (F.col("score") > 4300).alias("eligible"),
        (F.col("score") - half).alias("ci_low"),
        (F.col("score") + half).alias("ci_high"),
        (F.col("score") * F.when(F.col("n") % 2 == 0, 1.0).otherwise(0.99)).alias("score"),
        (F.col("score") * 0.98).alias("score_baseline"),
        (F.col("score") + 100).alias("score_direct"),
    )


@query(
    "d06_reference_grades",
    f"""WITH {GRADED_CTE} SELECT law, status, recovered, exceeds_ceiling, no_added_value, teacher_harmed FROM gd""",
)
def reference_grades(spark, sf):
    return verdicts.reference_gate_by_law(graded_laws(spark, sf)).drop("eligible", "control_clean", "score")


@query(
    "d06_reference_gate",
    f"""WITH {GRADED_CTE}, g AS (SELECT count(*) FILTER (law <> 'L1' AND status = 'graded') AS eligible_laws,
          count(*) FILTER (law <> 'L1' AND status = 'graded' AND recovered) AS recovered_laws,
          bool_and(eligible AND control_clean AND recovered) FILTER (law = 'L1') AS control_holds FROM gd)
        SELECT *, CASE WHEN NOT control_holds THEN 'STOP' WHEN eligible_laws = 0 THEN 'INSUFFICIENT_TARGETS'
          WHEN recovered_laws = eligible_laws THEN 'PROCEED' WHEN recovered_laws = 0 THEN 'STOP' ELSE 'HOLD' END AS verdict FROM g""",
)
def reference_gate(spark, sf):
    return verdicts.reference_gate(graded_laws(spark, sf))


@query(
    "d07_direct_versus_sampled",
    f"""WITH a AS (SELECT c_nationkey, avg(c_acctbal) > 4500 AS direct,
          coalesce(avg(c_acctbal) FILTER ({draw_sql(SEED, 'c_custkey')} < 2147483648) > 4500, false) AS sampled
          FROM customer GROUP BY 1)
        SELECT c_nationkey, CASE WHEN direct AND sampled THEN 'law holds, search method at fault'
          WHEN direct THEN 'sampling distorts' WHEN NOT sampled THEN 'law absent here' ELSE 'needs explanation' END AS verdict FROM a""",
)
def direct_versus_sampled(spark, sf):
    from tickloom.functions.draws import draw

    kept = draw(SEED, F.col("c_custkey")) < 2_147_483_648
    bands = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        (F.avg("c_acctbal") > 4500).alias("direct"),
        F.coalesce(F.avg(F.when(kept, F.col("c_acctbal"))) > 4500, F.lit(False)).alias("sampled"),
    )
    return bands.select(
        "c_nationkey", verdicts.direct_versus_sampled(F.col("direct"), F.col("sampled")).alias("verdict")
    )


@query(
    "d10_equivalence_gate",
    """WITH a AS (SELECT p_brand, avg(p_retailprice) FILTER (p_size % 2 = 0) AS cand,
         avg(p_retailprice) FILTER (p_size > 10) AS ref FROM part GROUP BY 1)
       SELECT p_brand, CASE WHEN ref IS NULL THEN 'withheld' WHEN cand >= 0.9 * ref THEN 'equivalent' ELSE 'worse' END AS verdict FROM a""",
)
def equivalence_gate(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    both = table(spark, sf, "part").groupBy("p_brand").agg(
        F.avg(F.when(size % 2 == 0, price)).alias("candidate"),
        F.avg(F.when(size > 10, price)).alias("reference"),
    )
    return both.select(
        "p_brand", verdicts.equivalence(F.col("candidate"), F.col("reference")).alias("verdict")
    )
