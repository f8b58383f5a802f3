"""Zero records, parameter rows and replicates by matrix, against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bootstrap as boot
from tickloom.operators import joins
from tickloom.plans import ledger as plan


@pytest.fixture(scope="module")
def decisions(spark):
    rng = np.random.default_rng(4)
    rows = [
        (f"c{c}", int(s), st, float(g), float(g - 3) if st == "FILLED" else None, "NET_RECOVERY" if st == "FILLED" else None)
        for c, s, st, g in zip(rng.integers(0, 4, 300), rng.integers(0, 9, 300), rng.choice(["FILLED", "UNFILLED", "CENSORED"], 300), rng.integers(-9, 9, 300))
    ]
    return spark.createDataFrame(rows, "contract_id string, symbol long, status string, gross_bps double, net_bps double, cohort string")


@pytest.mark.parametrize("block", [1, 4, 4_096])
def test_every_pair_has_a_record(spark, decisions, monkeypatch, block):
    monkeypatch.setattr(plan, "PLACES_PER_BLOCK", block)
    contracts = spark.createDataFrame([("c0",), ("c1",), ("c1",), ("none",)], "contract_id string")
    symbols = spark.createDataFrame([(s,) for s in (0, 3, 7, 7, 50, 60)], "symbol long")
    got = {(r.contract_id, r.symbol): r for r in plan.full_symbol_vectors(decisions, contracts, symbols).collect()}
    assert sorted(got) == sorted(itertools.product(["c0", "c1", "none"], [0, 3, 7, 50, 60]))
    plain = {(r.contract_id, r.symbol): r for r in plan.symbol_vectors(decisions).collect()}
    for key, row in got.items():
        want = plain.get(key)
        assert tuple(row)[2:] == (tuple(want)[2:] if want else (0.0, 0.0, 0, 0, 0))
    assert plan.full_symbol_vectors(decisions.filter("symbol < 0"), contracts, symbols).count() == 15
    assert plan.full_symbol_vectors(decisions, contracts, symbols.filter("symbol < 0")).count() == 0


def test_contracts_without_rows_are_summarised(spark, decisions):
    contracts = spark.createDataFrame([("c2",), ("none",)], "contract_id string")
    got = {r.contract_id: r for r in plan.full_contract_summary(decisions, contracts).collect()}
    assert got["c2"] == plan.contract_summary(decisions).filter("contract_id = 'c2'").first()
    none = got["none"]
    assert (none.decisions, none.fills, none.total_net_bps, none.bps_per_decision, none.positive) == (0, 0, 0.0, None, False)


def test_parameters_of_any_number(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_BLOCK", 7)
    contracts = spark.range(23).select(F.concat(F.lit("c"), "id").alias("contract_id"))
    symbols = spark.range(5).withColumnRenamed("id", "symbol")
    made = joins.parameter_table(symbols, "symbol", contracts, [0.7, 0.85])
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows)) == 23 * 5 * 2 and ("c4", "c4:q0.85", 3, "theta", 0.85) in rows
    assert joins.parameter_rows(contracts, [0.5]).count() == 23


@pytest.mark.parametrize("cells", [4_000_000, 60])
@pytest.mark.parametrize("groups", [(), ("g",)])
def test_drawn_sums_are_the_sums_of_the_drawn_rows(spark, monkeypatch, cells, groups):
    monkeypatch.setattr(boot, "MATRIX_CELLS", cells)
    rng = np.random.default_rng(6)
    members = [(int(i), int(i % 2)) for i in range(11)]
    stats = [(int(i), int(i % 2), arm, float(rng.normal()), int(rng.integers(0, 5))) for i in range(9) for arm in ("x", "y", None)]
    m = spark.createDataFrame(members, "symbol long, g int")
    s = spark.createDataFrame(stats, "symbol long, g int, arm string, v double, n int")
    by = [*groups, "arm"]
    got = boot.drawn_sums(m, s, "symbol", by, ["v", "n"], reps=25, seed=3, groups=groups).toPandas()
    counts = boot.draw_counts(m, list(groups), "symbol", reps=25, seed=3)
    want = boot.replicate_sums(counts, s.filter("arm IS NOT NULL"), [*groups, "symbol"], by, ["v", "n"]).toPandas()
    got = got[got.arm.notna()]
    order = [*by, "rep"]
    got, want = (d.sort_values(order).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) and (got[order].astype(str) == want[order].astype(str)).all(axis=None)
    assert np.allclose(got[["v", "n"]].astype(float), want[["v", "n"]].astype(float))
    assert boot.drawn_sums(m.filter("symbol < 0"), s, "symbol", by, ["v"], reps=5, seed=3, groups=groups).count() == 0


def test_differences_of_all_arms(spark):
    rng = np.random.default_rng(1)
    rows = [(q, a, r, None if (a, r) == ("b", 3) else float(rng.normal())) for q in ("p", "q") for a in "abc" for r in range(40)]
    reps = spark.createDataFrame(rows, "q string, arm string, rep long, v double")
    got = {(r.q, r.arm, r.other): r for r in boot.all_differences(reps, "arm", ["q"], F.col("v"), {"lo": 0.025, "mid": 0.5}).collect()}
    value = {(q, a, r): v for q, a, r, v in rows}
    assert len(got) == 12
    for (q, a, b), row in got.items():
        gaps = [value[q, a, r] - value[q, b, r] for r in range(40) if value[q, a, r] is not None and value[q, b, r] is not None]
        assert np.allclose([row.lo, row.mid], np.quantile(gaps, [0.025, 0.5])) and row.null_reps == 40 - len(gaps)
    assert boot.all_differences(reps.filter("q = 'p'"), "arm", [], F.col("v"), {"m": 0.5}).count() == 6
