"""Chunk kernels, the one-read as-of, range positions and the raw load path, against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.asof import fill_flag, forward_asof
from tickloom.operators.kernels import last_in_time, over_chunks, prior_order_statistics, window_minima
from tickloom.operators.positions import sorted_positions, sorted_running_total
from tickloom.operators.windows import with_rolling_quantiles
from tickloom.plans import labels
from tickloom.sources import ticks as source


@pytest.fixture(scope="module")
def paths():
    """One busy symbol, thin ones, a symbol without a name; ties in time, gaps over many buckets, missing prints."""
    rng = np.random.default_rng(11)
    parts = []
    for symbol, n in (("busy", 700), ("thin", 3), ("one", 1), (None, 40), *[(f"s{i}", int(rng.integers(1, 30))) for i in range(25)]):
        step = np.where(rng.random(n) < 0.05, rng.integers(50, 900, n), rng.integers(0, 3, n))
        price = rng.integers(95, 105, n).astype(float)
        price[rng.random(n) < 0.6] = np.nan
        price[rng.random(n) < 0.1] = 0.0
        bid = rng.integers(94, 103, n).astype(float)
        parts.append(pd.DataFrame({"symbol": symbol, "seq": np.arange(1, n + 1), "t": np.cumsum(step) * 1_000_000, "sell": price, "bid1": bid, "ask1": bid + 2}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def table(spark, paths):
    rows = spark.createDataFrame(paths).withColumn("sell", F.when(~F.isnan("sell"), F.col("sell")))
    return rows.withColumn("note", F.array("symbol")).repartition(6).cache()


def by_symbol(df):
    got = df.toPandas()
    got["symbol"] = got.symbol.fillna("")
    return [part.sort_values("seq") for _, part in got.groupby("symbol")]


def plain_fill(part, max_rows, max_us):
    t, p, bid = part.t.to_numpy(), part.sell.to_numpy(), part.bid1.to_numpy()
    out = []
    for i in range(len(t)):
        later = [p[j] for j in range(i + 1, min(len(t), i + 1 + max_rows)) if t[j] <= t[i] + max_us and p[j] > 0]
        out.append(1.0 if later and min(later) <= bid[i] else 0.0)
    return out


@pytest.mark.parametrize("max_rows, seconds, chunk", [(10, 4, 16), (100, 2, 65_536), (3, 10_000, 7), (1, 0, 5)])
def test_fill_flag_against_a_loop(table, paths, max_rows, seconds, chunk):
    flagged = fill_flag(
        table, ["symbol"], "t", "seq", sell_min="sell", limit_price="bid1", max_rows=max_rows, max_us=seconds * 1_000_000,
        previous="prev", chunk_rows=chunk,
    )
    assert flagged.count() == len(paths) and flagged.columns == [*table.columns, "y_fill", "prev"]
    for part in by_symbol(flagged):
        assert part.y_fill.tolist() == plain_fill(part, max_rows, seconds * 1_000_000)
        assert part.prev.tolist()[1:] == part.t.tolist()[:-1] and pd.isna(part.prev.iloc[0])


@pytest.mark.parametrize("horizon, bucket", [(3, 7), (30, 60), (40, 9), (0, 5), (5_000, 11)])
def test_forward_asof_against_searchsorted(table, paths, horizon, bucket):
    found = forward_asof(
        table, ["symbol"], "t", "seq", horizon_us=horizon * 1_000_000, bucket_us=bucket * 1_000_000,
        take={"hit": "seq", "price": "sell"}, keep=["seq", "t"], chunk_rows=13,
    )
    assert found.columns == ["symbol", "seq", "t", "hit", "price"] and found.count() == len(paths)
    for part in by_symbol(found):
        t = part.t.to_numpy()
        want = [i + 1 if i < len(t) else None for i in np.searchsorted(t, t + horizon * 1_000_000, side="left")]
        assert [None if pd.isna(x) else int(x) for x in part.hit] == want


def test_forward_asof_reads_the_ticks_once(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/ticks")
    stored = spark.read.parquet(f"{tmp_path}/ticks")
    found = forward_asof(stored, ["symbol"], "t", "seq", horizon_us=10, bucket_us=20, take={"hit": "seq"}, keep=["seq"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "note" not in plan


def test_labels_agree_with_the_single_operators(table):
    both = labels.with_labels(table.withColumnRenamed("sell", "sell_min_price"), ["symbol"], "t", "seq", horizon_us=5_000_000, order_ticks=8, order_us=3_000_000)
    path = labels.path_label(table, ["symbol"], "t", "seq", horizon_us=5_000_000)
    assert both.select(*path.columns).exceptAll(path).isEmpty() and both.count() == path.count()
    for part in by_symbol(both):
        assert part.y_fill.tolist() == plain_fill(part.rename(columns={"sell_min_price": "sell"}), 8, 3_000_000)


def test_rolling_quantiles_of_several_columns(table):
    cuts = {"sell": {"low": 0.0, "mid": 0.5}, "bid1": {"q70": 0.7, "top": 1.0}}
    for chunk in (11, 65_536):
        for part in by_symbol(with_rolling_quantiles(table, ["symbol"], "seq", cuts, size=4, chunk_rows=chunk)):
            for value, names in cuts.items():
                for name, p in names.items():
                    want = part[value].shift(1).rolling(4).quantile(p, interpolation="higher")
                    assert (part[name].isna() == want.isna()).all() and np.allclose(part[name].dropna(), want.dropna())


def test_kernels_of_plain_arrays():
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 200, 500))
    ends = np.where(np.arange(500) < 320, 320, 500)
    t[320:] = np.sort(rng.integers(0, 90, 180))
    last = last_in_time(t, ends, 9, 5)
    values = rng.normal(size=500)
    values[::7] = np.inf
    least = window_minima(values, np.arange(500) + 1, last)
    for i in range(500):
        rows = [j for j in range(i + 1, min(ends[i], i + 10)) if t[j] <= t[i] + 5]
        assert last[i] == i + 1 + len(rows)
        assert least[i] == min((values[j] for j in rows), default=np.inf)
    assert prior_order_statistics(np.array([3.0, np.nan, 1.0, 2.0, 5.0, 4.0]), np.array([0]), 2, {"low": 0})["low"][4:].tolist() == [1.0, 2.0]


def test_chunks_of_nothing(spark, table):
    none = table.filter("seq < 0")
    out = over_chunks(none, ["symbol"], "seq", lambda rows: {"x": np.zeros(rows.table.num_rows)}, {"x": T.DoubleType()})
    assert out.count() == 0 and out.columns == [*table.columns, "x"]
    assert forward_asof(none, ["symbol"], "t", "seq", horizon_us=1, bucket_us=2, take={"hit": "seq"}).count() == 0


# --- positions by range ---


@pytest.mark.parametrize("pieces", [1, 2, 7, 50])
def test_sorted_positions_with_ties_and_nulls(spark, pieces):
    rng = np.random.default_rng(pieces)
    rows = [(int(k), None if v < 3 else float(v), str(n)) for k, v, n in zip(rng.integers(0, 3, 900), rng.integers(0, 40, 900), rng.integers(0, 900, 900))]
    rows += [(1, 5.5, "same")] * 300  # a third of all rows tie on everything
    df = spark.createDataFrame(rows, "k int, v double, n string").repartition(5)
    by_key = sorted_positions(df, ["k"], [-F.col("v"), F.col("n")], "pos", pieces=pieces).collect()
    for k in {r[0] for r in rows}:
        own = sorted((r for r in by_key if r.k == k), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(1, len(own) + 1))
        order = [(r.v is not None, -(r.v or 0.0), r.n) for r in own]
        assert order == sorted(order)
    total = sorted_running_total(df, [F.col("v"), F.col("n")], "k", "upto", pieces=pieces).orderBy("upto").collect()
    assert max(r.upto for r in total) == sum(r[0] for r in rows)
    assert sorted_positions(df.filter("k > 9"), [], [F.col("v")], "pos").count() == 0


# --- raw files ---


def _raw(spark):
    """Quotes and trades of three codes on two dates, and a second file for one of them."""
    rows = []
    for date in ("20240101", "20240102"):
        for code in ("000001", "000002", "00000A"):
            for i in range(7):
                rows.append((date, code, "some_name", i, 12 if i % 2 == 0 else 11, (9 * 3600 + i) * 10**6))
    df = spark.createDataFrame(rows, "date string, code string, name string, i int, data_type int, sec long")
    clock = F.expr("((sec div 1000000) div 3600 * 10000 + (sec div 1000000) div 60 % 60 * 100 + (sec div 1000000) % 60) * 1000000")
    levels = [(F.col("i") + j * 1.0).alias(n) for j, n in enumerate(f.name for f in source.raw_schema(2) if f.name[:3] in ("ask", "bid") and "_type" not in f.name)]
    return df.select("date", "code", "name", "i", "data_type", clock.alias("local_time"), F.lit(1).alias("askbid_type"), F.lit(1.0).alias("trade_price"),
                     F.lit(2.0).alias("trade_quantity"), F.lit(None).cast("double").alias("cumulative_trading_amount"), *levels)


def test_only_chosen_files_are_read(spark, tmp_path):
    root = f"file:{tmp_path}/raw"
    written = source.write_tick_files(_raw(spark), root, levels=2)
    assert written.count() == 6
    source.write_tick_files(_raw(spark).filter("code = '000002' AND date = '20240102'").withColumn("name", F.lit("other")), root, levels=2)

    listed = source.file_manifest(spark, root)
    assert sorted((r.date, r.code) for r in listed.collect()) == sorted([(d, c) for d in ("20240101", "20240102") for c in ("000001", "000002", "00000A")] + [("20240102", "000002")])
    assert source.file_manifest(spark, root, ["20240101"]).count() == 3
    assert {r.bytes for r in written.collect()} >= {r.bytes for r in source.file_manifest(spark, root, ["20240101"]).collect()}

    sole = source.sole_files(source.file_manifest(spark, root, ["20240102"]))
    assert sorted(r.code for r in sole.collect()) == ["000001", "00000A"]
    loaded = source.load_ticks(spark, sole, levels=2)
    assert len(loaded.inputFiles()) == 2 and all("20240102" in f and "000002" not in f for f in loaded.inputFiles())
    arrays = source.level_arrays(loaded, levels=2).orderBy("symbol", "file_row").collect()
    assert [(r.symbol, r.date, r.file_row) for r in arrays] == [(c, "20240102", i) for c in ("000001", "00000A") for i in range(7)]
    assert arrays[3].t_us == (9 * 3600 + 3) * 10**6 and arrays[3].ask_px == [3.0, 5.0] and arrays[3].bid_qty == [8.0, 10.0]
    assert source.load_ticks(spark, sole.filter("code = 'none'"), levels=2).count() == 0
    assert source.load_ticks(spark, root, levels=2).columns == loaded.columns


def test_many_files_are_listed_and_opened_by_tasks(spark, tmp_path, monkeypatch):
    """The same rows as through Spark's index, which then holds none of the files; odd names and absent columns too."""
    root = f"file:{tmp_path}/raw"
    source.write_tick_files(_raw(spark).withColumn("name", F.lit("a %20{b} c=d")), root, levels=2)
    (tmp_path / "raw" / "20240101" / "_000009_hidden_20240101.parquet").write_text("not a table")
    listed = source.file_manifest(spark, root)
    assert listed.count() == 6 and not any(f.endswith("_20240101.parquet") for f in listed.inputFiles())
    plain = source.load_ticks(spark, listed, levels=3)
    monkeypatch.setattr(source, "INDEXED_FILES", 5)
    many = source.load_ticks(spark, listed, levels=3)
    assert len(plain.inputFiles()) == 6 and many.inputFiles() == []
    assert many.dtypes == plain.dtypes and many.count() == 42
    assert sorted(map(str, many.collect())) == sorted(map(str, plain.collect()))


def test_a_second_write_of_a_file_replaces_it(spark, tmp_path):
    root = f"file:{tmp_path}/raw"
    for _ in range(2):
        source.write_tick_files(_raw(spark), root, levels=2)
    assert source.load_ticks(spark, source.file_manifest(spark, root), levels=2).count() == 42


def test_many_small_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(300).select(F.format_string("%04d", F.col("id") % 100).alias("code"), "id")
    written = source.write_keyed_files(rows, str(tmp_path), ["code"], "code={code}/part.parquet", ["id"], ["id"])
    assert written.count() == 100 and len(written.inputFiles()) > 8
    back = spark.read.parquet(*[r.path for r in written.filter("code = '0007'").collect()])
    assert [r.id for r in back.collect()] == [7, 107, 207]
    assert source.list_files(spark, str(tmp_path), r"code=([0-9]+)/[^/]*\.parquet$").count() == 100
