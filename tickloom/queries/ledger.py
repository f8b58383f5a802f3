"""Registered queries on the ledger binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio_if_positive
from tickloom.operators import bootstrap as boot
from tickloom.plans import ledger as plan
from tickloom.plans import verdicts
from tickloom.queries.bindings import L_SQL, ledger, table
from tickloom.queries.registry import draw_sql, query, r6, rounded

WITH_L = f"WITH {L_SQL}"
REPS = 10_000
SEED = 7
BONF = 0.05 / 12
BOUNDS = {"lo95": 0.025, "hi95": 0.975, "lo_bonf": BONF / 2, "hi_bonf": 1 - BONF / 2}

COHORT_COUNTS_SQL = ", ".join(
    f"count(*) FILTER (status = 'FILLED' AND cohort = '{c}') AS \"cohort_{c}\"" for c in plan.COHORTS
)


def summary_cte(name: str = "s", key: str = "contract_id", source: str = "l") -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN scorable > 0 THEN total_net_bps / scorable END AS bps_per_decision,
         scorable > 0 AND total_net_bps > 0 AS positive
  FROM (SELECT {key} AS contract_id, count(*) AS decisions,
               count(*) FILTER (status IN ('FILLED','UNFILLED')) AS scorable,
               count(*) FILTER (status = 'FILLED') AS fills, count(*) FILTER (status = 'UNFILLED') AS unfilled,
               count(*) FILTER (status = 'CENSORED') AS censored,
               coalesce(sum(net_bps) FILTER (status = 'FILLED'), 0.0::DOUBLE) AS total_net_bps, {COHORT_COUNTS_SQL}
        FROM {source} GROUP BY 1))"""


S_SQL = f"{WITH_L}, {summary_cte()}"
G_SQL = f"{WITH_L}, {summary_cte(key='graded_id')}"
SUMMARY_OUT = (
    "contract_id, decisions, scorable, fills, unfilled, censored, round(total_net_bps, 6) AS total_net_bps, "
    + ", ".join(f'"cohort_{c}"' for c in plan.COHORTS)
    + ", round(bps_per_decision, 6) AS bps_per_decision, positive"
)


@query("a05_contract_summary", f"{S_SQL} SELECT {SUMMARY_OUT} FROM s")
def contract_summary(spark, sf):
    return rounded(plan.contract_summary(ledger(spark, sf)))


@query(
    "t02_contract_ranking",
    f"""{S_SQL} SELECT {SUMMARY_OUT},
        row_number() OVER (ORDER BY total_net_bps DESC, bps_per_decision DESC, contract_id) AS place
        FROM s WHERE scorable >= 200""",
)
def contract_ranking(spark, sf):
    return rounded(plan.rank_contracts(plan.contract_summary(ledger(spark, sf))))


@query(
    "t03_best_contract_per_kind",
    f"""{G_SQL} SELECT contract_id, kind, scorable, round(total_net_bps, 6) AS total_net_bps FROM (
        SELECT *, split_part(contract_id, ':', 1) AS kind, row_number() OVER (
          PARTITION BY split_part(contract_id, ':', 1)
          ORDER BY total_net_bps DESC, bps_per_decision DESC, contract_id) AS rn
        FROM s WHERE scorable >= 200) WHERE rn = 1""",
)
def best_contract_per_kind(spark, sf):
    summary = plan.contract_summary(ledger(spark, sf, graded=True)).withColumn(
        "kind", F.split("contract_id", ":")[0]
    )
    return plan.best_per_kind(summary, "kind").select("contract_id", "kind", "scorable", r6("total_net_bps"))


@query(
    "t04_best_row_per_normal_form",
    f"""{G_SQL} SELECT normal_form, max(bps_per_decision) IS NOT NULL AS scored,
        arg_min(contract_id, (-bps_per_decision, contract_id)) AS contract_id
        FROM (SELECT *, substr(contract_id, 3) AS normal_form FROM s) GROUP BY 1""",
)
def best_row_per_normal_form(spark, sf):
    from tickloom.plans.formulas import best_per_form

    summary = plan.contract_summary(ledger(spark, sf, graded=True)).withColumn(
        "normal_form", F.substring("contract_id", 3, 100)
    )
    best = best_per_form(summary, "normal_form", "bps_per_decision", "contract_id")
    return best.select("normal_form", F.col("bps_per_decision").isNotNull().alias("scored"), "contract_id")


@query(
    "t05_pareto_front",
    f"""{G_SQL}, top AS (SELECT contract_id, bps_per_decision AS score, scorable % 7 AS complexity FROM s
        ORDER BY score DESC, complexity, contract_id LIMIT 6)
        SELECT contract_id, round(score, 6) AS score, complexity FROM top""",
)
def pareto_front(spark, sf):
    from tickloom.plans.formulas import pareto_front as front

    scored = plan.contract_summary(ledger(spark, sf, graded=True)).select(
        "contract_id", F.col("bps_per_decision").alias("score"), (F.col("scorable") % 7).alias("complexity")
    )
    return rounded(front(scored, "score", "complexity", "contract_id", keep=6))


@query(
    "a06_duplicate_signal_groups",
    f"""{G_SQL}, m AS (SELECT contract_id, positive, total_net_bps < 0 AS losing FROM s)
        SELECT min(contract_id) OVER (PARTITION BY positive, losing) AS leader, contract_id,
               count(*) OVER (PARTITION BY positive, losing) AS group_size FROM m""",
)
def duplicate_signal_groups(spark, sf):
    summary = plan.contract_summary(ledger(spark, sf, graded=True)).withColumn(
        "losing", F.col("total_net_bps") < 0
    )
    return plan.duplicate_groups(summary, ["positive", "losing"])


def _shares_sql(value: str) -> str:
    return f"""{WITH_L} SELECT contract_id, {value}, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (PARTITION BY contract_id), 6) AS share
        FROM l WHERE {value} IS NOT NULL GROUP BY 1, 2"""


@query("a07_status_shares", _shares_sql("status"))
def status_shares(spark, sf):
    return rounded(plan.value_shares(ledger(spark, sf), ["contract_id"], "status"))


@query("a07_cohort_shares", _shares_sql("cohort"))
def cohort_shares(spark, sf):
    return rounded(plan.value_shares(ledger(spark, sf), ["contract_id"], "cohort"))


@query("a07_exit_reason_shares", _shares_sql("exit_reason"))
def exit_reason_shares(spark, sf):
    return rounded(plan.value_shares(ledger(spark, sf), ["contract_id"], "exit_reason"))


@query(
    "a08_top_reasons",
    f"""{WITH_L} SELECT substr('horizon past close at ' || minute_of_session, 1, 120) AS value, count(*) AS n
        FROM l WHERE status = 'CENSORED' GROUP BY 1 ORDER BY n DESC, value LIMIT 8""",
)
def top_reasons(spark, sf):
    censored = ledger(spark, sf).filter(F.col("status") == "CENSORED")
    reason = F.substring(F.concat(F.lit("horizon past close at "), F.col("minute_of_session")), 1, 120)
    return plan.top_values(censored, reason, 8)


VECTORS_CTE = """
vec AS (SELECT contract_id, symbol, coalesce(sum(net_bps), 0.0::DOUBLE) AS net,
               coalesce(sum(gross_bps) FILTER (status = 'FILLED'), 0.0::DOUBLE) AS gross,
               count(*) FILTER (status = 'FILLED') AS fills,
               count(*) FILTER (status IN ('FILLED','UNFILLED')) AS scorable, count(*) AS decisions
        FROM l GROUP BY 1, 2)"""


@query(
    "a09_contract_symbol_vectors",
    f"""{WITH_L}, {VECTORS_CTE} SELECT contract_id, symbol, round(net, 6) AS net, round(gross, 6) AS gross,
        fills, scorable, decisions FROM vec""",
)
def contract_symbol_vectors(spark, sf):
    return rounded(plan.symbol_vectors(ledger(spark, sf)))


EVERY_SQL = "cs AS (SELECT DISTINCT contract_id FROM l UNION ALL SELECT 'ZZ')"


def every_contract(spark, sf):
    """The contracts of the ledger and one that never decided."""
    return ledger(spark, sf).select("contract_id").distinct().unionByName(spark.createDataFrame([("ZZ",)], "contract_id string"))


@query(
    "a09_full_symbol_vectors",
    f"""{WITH_L}, {VECTORS_CTE}, {EVERY_SQL}, sy AS (SELECT s_suppkey AS symbol FROM supplier UNION SELECT c_custkey FROM customer)
        SELECT contract_id, symbol, round(coalesce(net, 0), 6) AS net, round(coalesce(gross, 0), 6) AS gross, coalesce(fills, 0) AS fills,
               coalesce(scorable, 0) AS scorable, coalesce(decisions, 0) AS decisions
        FROM cs CROSS JOIN sy LEFT JOIN vec USING (contract_id, symbol)""",
)
def full_symbol_vectors(spark, sf):
    symbols = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol")).union(table(spark, sf, "customer").select("c_custkey"))
    return rounded(plan.full_symbol_vectors(ledger(spark, sf), every_contract(spark, sf), symbols))


@query(
    "a05_summary_of_all_contracts",
    f"""{S_SQL}, {EVERY_SQL}, f AS (SELECT contract_id, {', '.join(f'coalesce("{c}", 0) AS "{c}"' for c in (
        'decisions', 'scorable', 'fills', 'unfilled', 'censored', 'total_net_bps', *[f'cohort_{c}' for c in plan.COHORTS]))},
        bps_per_decision, coalesce(positive, false) AS positive FROM cs LEFT JOIN s USING (contract_id))
        SELECT {SUMMARY_OUT} FROM f""",
)
def summary_of_all_contracts(spark, sf):
    return rounded(plan.full_contract_summary(ledger(spark, sf), every_contract(spark, sf)))


SHARE_COLS = ", ".join(f'round("cohort_{c}" / nullif(fills, 0), 6) AS "share_{c}"' for c in plan.COHORTS)


@query(
    "a10_fill_economics",
    f"""{S_SQL}, x AS (SELECT contract_id, avg(net_bps) AS npf, avg(gross_bps) FILTER (status = 'FILLED') AS gpf,
        quantile_cont(holding_seconds, 0.5) FILTER (status = 'FILLED') AS hm, count(DISTINCT symbol) AS sd
        FROM l GROUP BY 1)
        SELECT s.contract_id, round(npf, 6) AS net_per_fill, round(gpf, 6) AS gross_per_fill,
               round(fills / nullif(scorable, 0), 6) AS fill_rate, round(hm, 6) AS holding_median, {SHARE_COLS},
               sd AS symbols_with_decisions FROM s JOIN x USING (contract_id)""",
)
def fill_economics(spark, sf):
    return rounded(plan.fill_economics(ledger(spark, sf)))


@query(
    "a11_fill_distribution",
    f"""{WITH_L} SELECT contract_id, count(*) AS fills,
        round(avg(CAST(gross_bps >= 23 AS INT)), 6) AS share_gross_ge_fee,
        round(avg(CAST(gross_bps > 0 AS INT)), 6) AS share_gross_pos,
        round(avg(CAST(gross_bps = 0 AS INT)), 6) AS share_gross_zero,
        round(avg(CAST(net_bps > 0 AS INT)), 6) AS share_net_pos,
        round(quantile_cont(gross_bps, 0.1), 6) AS q10, round(quantile_cont(gross_bps, 0.25), 6) AS q25,
        round(quantile_cont(gross_bps, 0.5), 6) AS q50, round(quantile_cont(gross_bps, 0.75), 6) AS q75,
        round(quantile_cont(gross_bps, 0.9), 6) AS q90,
        round(quantile_cont(max_favorable_gross_bps, 0.5), 6) AS max_favorable_gross_bps,
        round(quantile_cont(max_adverse_gross_bps, 0.5), 6) AS max_adverse_gross_bps,
        round(quantile_cont(holding_seconds, 0.5), 6) AS holding_seconds
        FROM l WHERE status = 'FILLED' GROUP BY 1""",
)
def fill_distribution(spark, sf):
    return rounded(plan.fill_distribution(ledger(spark, sf)))


@query(
    "a11_feature_medians_by_population",
    f"""{WITH_L}, u AS (SELECT *, 'decision' AS population FROM l
        UNION ALL SELECT *, 'fill' AS population FROM l WHERE status = 'FILLED')
        SELECT contract_id, population, round(quantile_cont(minute_of_session, 0.5), 6) AS minute_of_session,
               round(quantile_cont(max_favorable_gross_bps, 0.5), 6) AS max_favorable_gross_bps
        FROM u GROUP BY 1, 2""",
)
def feature_medians_by_population(spark, sf):
    return rounded(
        plan.median_decision_and_fill(ledger(spark, sf), ["minute_of_session", "max_favorable_gross_bps"])
    )


@query(
    "a12_economics_by_label_and_group",
    f"""{WITH_L} SELECT contract_id, symbol % 3 AS tick_group, count(DISTINCT symbol) AS symbols,
        count(*) AS decisions, count(*) FILTER (status = 'FILLED') AS fills,
        round(avg(gross_bps) FILTER (status = 'FILLED'), 6) AS gross_mean, round(avg(net_bps), 6) AS net_mean,
        round(avg(CAST(net_bps > 0 AS INT)), 6) AS share_net_pos, round(sum(net_bps), 6) AS net_total
        FROM l GROUP BY 1, 2""",
)
def economics_by_label_and_group(spark, sf):
    grouped = ledger(spark, sf).withColumn("tick_group", F.col("symbol") % 3)
    return rounded(plan.economics_by_group(grouped, ["contract_id", "tick_group"]))


@query(
    "f11_minute_slice",
    f"""{WITH_L} SELECT contract_id, count(*) AS decisions, round(sum(net_bps), 6) AS net FROM l
        WHERE minute_of_session >= 330 GROUP BY 1""",
)
def minute_slice(spark, sf):
    late = ledger(spark, sf).filter(F.col("minute_of_session") >= 330)
    return late.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("decisions"), r6(F.sum("net_bps"), "net")
    )


LEDGER_COLS = ["symbol", "status", "gross_bps", "net_bps", "minute_of_session", "holding_seconds"]


@query(
    "j11_ledger_equality",
    f"""{WITH_L} SELECT {', '.join(LEDGER_COLS)},
        CAST(sum(CASE WHEN contract_id = 'AF' THEN 1 ELSE -1 END) AS BIGINT) AS surplus
        FROM l WHERE contract_id IN ('AF', 'RF') GROUP BY ALL HAVING surplus <> 0""",
)
def ledger_equality(spark, sf):
    return plan.ledger_differences(ledger(spark, sf), "AF", "RF", LEDGER_COLS)


@query(
    "j12_same_quantile_difference",
    f"""{G_SQL}, g AS (SELECT split_part(contract_id, ':q', 1) AS prefix,
        CAST(split_part(contract_id, ':q', 2) AS DOUBLE) AS q, bps_per_decision AS v FROM s)
        SELECT o.prefix, q, round(b.v - o.v, 6) AS diff FROM g o JOIN g b USING (q)
        WHERE o.prefix <> 'A' AND b.prefix = 'A'""",
)
def same_quantile_difference(spark, sf):
    summary = plan.contract_summary(ledger(spark, sf, graded=True))
    return rounded(plan.same_quantile_differences(summary, "A"))


@query(
    "j13_label_from_contract_prefix",
    f"""{G_SQL}, lab AS (SELECT * FROM (VALUES ('A', 'seed0', 0.7::DOUBLE), ('N', 'naive', 0.85::DOUBLE),
        ('R', 'null', 0.95::DOUBLE)) t(prefix, label, label_q))
        SELECT contract_id, prefix, CAST(split_part(contract_id, ':q', 2) AS DOUBLE) AS q, label, scorable,
               round(total_net_bps, 6) AS total_net_bps
        FROM s JOIN lab ON split_part(contract_id, ':q', 1) = prefix
             AND CAST(split_part(contract_id, ':q', 2) AS DOUBLE) = label_q""",
)
def label_from_contract_prefix(spark, sf):
    summary = plan.contract_summary(ledger(spark, sf, graded=True))
    named = plan.attach_labels(summary, LABELS(spark))
    return named.select("contract_id", "prefix", "q", "label", "scorable", r6("total_net_bps"))


def LABELS(spark):
    return spark.createDataFrame(
        [("A", "seed0", 0.70), ("N", "naive", 0.85), ("R", "null", 0.95)],
        "prefix string, label string, label_q double",
    )


@query("m18_attempt_count", f"{WITH_L} SELECT count(DISTINCT contract_id) * 7 AS attempts FROM l")
def attempt_count(spark, sf):
    return plan.attempt_count(ledger(spark, sf), 7)


# --- bootstraps over symbols -------------------------------------------------

COUNTS_CTE = f"""
sym AS (SELECT DISTINCT symbol FROM l),
place AS (SELECT symbol, row_number() OVER (ORDER BY {draw_sql(SEED, 'symbol')}, symbol) AS place,
                 count(*) OVER () AS k FROM sym),
hits AS (SELECT rep, {draw_sql(SEED, 'rep', 'place')} % k + 1 AS place FROM place, range({REPS}) r(rep)),
cnt AS (SELECT rep, symbol, count(*) AS times FROM hits JOIN place USING (place) GROUP BY 1, 2)"""

INTERVAL_OUT = ", ".join(f"round(quantile_cont(r, {p!r}), 6) AS {n}" for n, p in BOUNDS.items())


def _reps(frame, num, den, by=("contract_id",), vectors=None):
    """Replicate sums over the symbols of ``frame``, with the ratio of two of them."""
    made = boot.drawn_sums(
        frame.select("symbol"), plan.symbol_vectors(frame) if vectors is None else vectors, "symbol", list(by), [num, den], reps=REPS, seed=SEED
    )
    return made.withColumn("r", ratio_if_positive(F.col(num), F.col(den)))


@query(
    "r12_ratio_bootstrap",
    f"""{WITH_L}, {VECTORS_CTE}, {COUNTS_CTE},
        reps AS (SELECT contract_id, rep, sum(times * net) / nullif(sum(times * scorable), 0) AS r
                 FROM cnt JOIN vec USING (symbol) GROUP BY 1, 2)
        SELECT contract_id, {INTERVAL_OUT}, count(*) FILTER (r IS NULL) AS null_reps FROM reps GROUP BY 1""",
)
def ratio_bootstrap(spark, sf):
    return rounded(boot.interval(_reps(ledger(spark, sf), "net", "scorable"), ["contract_id"], F.col("r"), BOUNDS))


@query(
    "r13_ratio_difference_bootstrap",
    f"""{WITH_L}, {VECTORS_CTE}, {COUNTS_CTE},
        reps AS (SELECT contract_id, rep, sum(times * net) / nullif(sum(times * scorable), 0) AS v
                 FROM cnt JOIN vec USING (symbol) GROUP BY 1, 2),
        d AS (SELECT o.contract_id, b.v - o.v AS r FROM reps o JOIN reps b USING (rep)
              WHERE b.contract_id = 'AF' AND o.contract_id <> 'AF')
        SELECT contract_id, {INTERVAL_OUT}, count(*) FILTER (r IS NULL) AS null_reps FROM d GROUP BY 1""",
)
def ratio_difference_bootstrap(spark, sf):
    gaps = boot.all_differences(_reps(ledger(spark, sf), "net", "scorable"), "contract_id", [], F.col("r"), BOUNDS)
    return rounded(
        gaps.filter("contract_id = 'AF'").select(F.col("other").alias("contract_id"), *BOUNDS, "null_reps")
    )


@query(
    "r13_all_arm_differences",
    f"""{WITH_L}, vec AS (SELECT split_part(graded_id, ':', 1) AS arm, split_part(graded_id, ':', 2) AS q, symbol,
            coalesce(sum(net_bps), 0.0::DOUBLE) AS net, count(*) FILTER (status IN ('FILLED','UNFILLED')) AS scorable FROM l GROUP BY 1, 2, 3),
        {COUNTS_CTE},
        reps AS (SELECT arm, q, rep, sum(times * net) / nullif(sum(times * scorable), 0) AS v FROM cnt JOIN vec USING (symbol) GROUP BY 1, 2, 3),
        d AS (SELECT a.q, a.arm, b.arm AS other, a.v - b.v AS r FROM reps a JOIN reps b ON a.q = b.q AND a.rep = b.rep AND a.arm <> b.arm)
        SELECT q, arm, other, {INTERVAL_OUT}, count(*) FILTER (r IS NULL) AS null_reps FROM d GROUP BY 1, 2, 3""",
)
def all_arm_differences(spark, sf):
    frame = ledger(spark, sf, graded=True)
    parts = F.split("contract_id", ":")
    vectors = plan.symbol_vectors(frame).select(F.get(parts, F.lit(0)).alias("arm"), F.get(parts, F.lit(1)).alias("q"), "symbol", "net", "scorable")
    reps = _reps(frame, "net", "scorable", ("arm", "q"), vectors)
    return rounded(boot.all_differences(reps, "arm", ["q"], F.col("r"), BOUNDS))


@query(
    "r14_mean_per_fill_bootstrap",
    f"""{WITH_L}, {VECTORS_CTE}, {COUNTS_CTE},
        reps AS (SELECT contract_id, rep, sum(times * gross) / nullif(sum(times * fills), 0) AS r
                 FROM cnt JOIN vec USING (symbol) GROUP BY 1, 2)
        SELECT contract_id, {INTERVAL_OUT}, count(*) FILTER (r IS NULL) AS null_reps FROM reps GROUP BY 1""",
)
def mean_per_fill_bootstrap(spark, sf):
    return rounded(boot.interval(_reps(ledger(spark, sf), "gross", "fills"), ["contract_id"], F.col("r"), BOUNDS))


# --- verdicts ----------------------------------------------------------------


@query(
    "d02_contract_verdict",
    f"""{S_SQL}, {VECTORS_CTE}, {COUNTS_CTE},
        reps AS (SELECT contract_id, rep, sum(times * net) / nullif(sum(times * scorable), 0) AS r
                 FROM cnt JOIN vec USING (symbol) GROUP BY 1, 2),
        ci AS (SELECT contract_id, quantile_cont(r, {BOUNDS['lo_bonf']!r}) AS lo,
                      quantile_cont(r, {BOUNDS['hi_bonf']!r}) AS hi FROM reps GROUP BY 1)
        SELECT contract_id, scorable, round(lo, 6) AS lo_bonf, round(hi, 6) AS hi_bonf, CASE WHEN scorable < 200 THEN 'too few'
               WHEN total_net_bps > 0 AND lo > 0 THEN 'profit' WHEN hi < 0 THEN 'loss' ELSE 'undecided' END AS verdict
        FROM s JOIN ci USING (contract_id)""",
)
def contract_verdict(spark, sf):
    frame = ledger(spark, sf)
    summary = plan.contract_summary(frame)
    ci = boot.interval(_reps(frame, "net", "scorable"), ["contract_id"], F.col("r"), BOUNDS)
    verdict = verdicts.contract_economics(
        F.col("scorable"), F.col("total_net_bps"), F.col("lo_bonf"), F.col("hi_bonf")
    )
    return summary.join(ci, "contract_id").select(
        "contract_id", "scorable", r6("lo_bonf"), r6("hi_bonf"), verdict.alias("verdict")
    )


def _friction(symbol):
    return F.element_at(F.array(F.lit("L"), F.lit("M"), F.lit("H")), (symbol % 3 + 1).cast("int"))


FRICTION_SQL = "['L', 'M', 'H'][CAST(symbol % 3 + 1 AS INT)]"


@query(
    "d09_degradation_table",
    f"""{WITH_L}, f AS (SELECT *, {FRICTION_SQL} || '|' || contract_id AS fk FROM l), {summary_cte('s', 'fk', 'f')}
        SELECT split_part(contract_id, '|', 2) AS contract_id,
               round(max(total_net_bps) FILTER (contract_id LIKE 'L|%'), 6) AS l_net,
               round(max(total_net_bps) FILTER (contract_id LIKE 'M|%'), 6) AS m_net,
               round(max(total_net_bps) FILTER (contract_id LIKE 'H|%'), 6) AS h_net,
               max(scorable) FILTER (contract_id LIKE 'L|%') AS l_scorable,
               max(scorable) FILTER (contract_id LIKE 'M|%') AS m_scorable,
               max(scorable) FILTER (contract_id LIKE 'H|%') AS h_scorable
        FROM s GROUP BY 1""",
)
def degradation_table(spark, sf):
    return rounded(_degradation(spark, sf))


def _degradation(spark, sf):
    frame = ledger(spark, sf).withColumn("friction", _friction(F.col("symbol")))
    summary = plan.contract_summary(frame, ["friction", "contract_id"])
    wide = []
    for column, short in (("total_net_bps", "net"), ("scorable", "scorable")):
        for layer in "LMH":
            wide.append(
                F.max(F.when(F.col("friction") == layer, F.col(column))).alias(f"{layer.lower()}_{short}")
            )
    return summary.groupBy("contract_id").agg(*wide)


@query(
    "d08_seed_pass",
    f"""{WITH_L}, f AS (SELECT * FROM l WHERE {FRICTION_SQL} = 'H'), {summary_cte('s', 'contract_id', 'f')},
        f2 AS (SELECT * FROM l WHERE {FRICTION_SQL} = 'M'), {summary_cte('s2', 'contract_id', 'f2')},
        n AS (SELECT total_net_bps AS null_net FROM s WHERE contract_id = 'RO'),
        p AS (SELECT contract_id, s2.total_net_bps > 0 AND s.total_net_bps > 0 AND s.scorable >= 200
                     AND s.total_net_bps > null_net AS passed FROM s JOIN s2 USING (contract_id), n WHERE contract_id <> 'RO')
        SELECT contract_id, passed, bool_and(passed) OVER () AS all_passed FROM p""",
)
def seed_pass(spark, sf):
    table = _degradation(spark, sf).select("contract_id", "m_net", "h_net", "h_scorable")
    null_net = table.filter(F.col("contract_id") == "RO").select("h_net").scalar()
    judged = table.filter(F.col("contract_id") != "RO").select(
        "contract_id",
        verdicts.seed_pass(F.col("m_net") > 0, F.col("h_net"), F.col("h_scorable"), null_net).alias("passed"),
    )
    return judged.withColumn("all_passed", judged.agg(F.bool_and("passed")).scalar())


@query(
    "d12_drift_signals",
    f"""{WITH_L}, per AS (SELECT graded_id AS contract_id, minute_of_session >= 195 AS late, cohort, count(*) AS n
            FROM l WHERE status = 'FILLED' GROUP BY 1, 2, 3),
        dom AS (SELECT contract_id, late, arg_max(cohort, (n, cohort)) AS dominant,
                       sum(n) FILTER (cohort = 'COST_INSUFFICIENT') / sum(n) AS cost FROM per GROUP BY 1, 2),
        sc AS (SELECT graded_id AS contract_id, count(*) FILTER (status <> 'CENSORED') AS scorable FROM l
               WHERE minute_of_session >= 195 GROUP BY 1),
        bq AS (SELECT split_part(contract_id, ':', 1) AS base, late, arg_max(contract_id, (net, contract_id)) AS best FROM (
                 SELECT graded_id AS contract_id, minute_of_session >= 195 AS late, coalesce(sum(net_bps), 0) AS net FROM l GROUP BY 1, 2) GROUP BY 1, 2),
        mv AS (SELECT e.base, e.best <> n.best AS moved FROM bq e JOIN bq n USING (base) WHERE NOT e.late AND n.late)
        SELECT contract_id, CASE
          WHEN b.dominant = 'NET_RECOVERY' AND a.dominant = 'PERSISTENT_ADVERSE' THEN 'cohort reversal'
          WHEN contract_id LIKE '%:q0.95' AND scorable <= 200 THEN 'threshold at extreme'
          WHEN a.cost - b.cost > 0.1 THEN 'cohort shift' WHEN moved THEN 'threshold drift' ELSE 'none' END AS signal,
          b.dominant AS dominant_before, a.dominant AS dominant_now
        FROM dom a JOIN dom b USING (contract_id) JOIN sc USING (contract_id) JOIN mv ON split_part(contract_id, ':', 1) = mv.base
        WHERE a.late AND NOT b.late""",
)
def drift_signals(spark, sf):
    frame = ledger(spark, sf, graded=True).withColumn("late", F.col("minute_of_session") >= 195)
    cohorts = (
        frame.filter(plan.is_filled())
        .groupBy("contract_id", "late", "cohort")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("contract_id", "late")
        .agg(
            F.max(F.struct("n", "cohort"))["cohort"].alias("dominant"),
            (
                F.sum(F.when(F.col("cohort") == "COST_INSUFFICIENT", F.col("n"))) / F.sum("n")
            ).alias("cost"),
        )
    )
    before = cohorts.filter(~F.col("late")).select(
        "contract_id", F.col("dominant").alias("dominant_before"), F.col("cost").alias("cost_before")
    )
    now = cohorts.filter("late").select(
        "contract_id", F.col("dominant").alias("dominant_now"), F.col("cost").alias("cost_now")
    )
    scorable = frame.filter("late").groupBy("contract_id").agg(
        F.count_if(plan.is_scorable()).alias("scorable")
    )
    base = F.split_part("contract_id", F.lit(":"), F.lit(1))
    nets = frame.groupBy("contract_id", "late").agg(F.coalesce(F.sum("net_bps"), F.lit(0.0)).alias("net"))
    best = nets.groupBy(base.alias("base")).agg(
        *[F.max(F.when(F.col("late") == late, F.struct("net", "contract_id")))["contract_id"].alias(n) for n, late in (("was", False), ("is", True))]
    )
    moved = best.filter(F.col("was").isNotNull() & F.col("is").isNotNull()).select("base", (F.col("was") != F.col("is")).alias("moved"))
    joined = before.join(now, "contract_id").join(scorable, "contract_id").withColumn("base", base).join(moved, "base")
    return joined.select(
        "contract_id",
        verdicts.drift_signal(
            F.col("moved"),
            F.col("contract_id").endswith(":q0.95"),
            F.col("scorable"),
            F.col("cost_before"),
            F.col("cost_now"),
            F.col("dominant_before"),
            F.col("dominant_now"),
        ).alias("signal"),
        "dominant_before",
        "dominant_now",
    )
