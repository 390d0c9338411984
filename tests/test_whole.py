"""Whole-series operators against plain loops and against the scan rows, over chunks and blocks of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from shapes import candles, walk

from barloom.functions.fits import fit_parabola
from barloom.functions.rows import each_struct
from barloom.functions.sql import F as S
from barloom.operators import levels, momentum, sizing, whole
from barloom.operators.series import as_xy, scan_rows
from barloom.operators.swings import candle_swings
from barloom.plans.catalog import QUERIES

SPAN = 200 * 3600


def plain_zigzag(swings, reversal):
    kept = []
    for s in swings:
        if not kept:
            kept.append(s)
        elif s[1] == kept[-1][1]:
            if s[2] > kept[-1][2] if s[1] == "high" else s[2] < kept[-1][2]:
                kept[-1] = s
        elif abs(s[2] - kept[-1][2]) >= reversal:
            kept.append(s)
    return kept


def swing_sets():
    rng = random.Random(11)

    def kind():
        return rng.choice(["high", "low"])

    yield "noise", [(i * 3, kind(), rng.uniform(0, 10)) for i in range(600)], 4.0
    price, path = 100.0, []
    for i in range(800):
        price += rng.gauss(0, 1)
        path.append((i * 2, kind(), price))
    yield "path", path, 3.0
    yield "never", path, 1e9
    yield "always", path, 0.0
    yield "rising", [(i, "high" if i % 2 else "low", i + 3.0 * (i % 2)) for i in range(500)], 2.0
    # A great swing, then hundreds that can't touch it, then one that can.
    yield "quiet", [(0, "high", 200.0), *((i, kind(), 100 + rng.random()) for i in range(1, 700)), (701, "high", 300.0)], 150.0
    # Steps just short of a reversal: folds with different entries stay apart for long.
    yield "short steps", [(i, "high" if i % 2 else "low", float(i % 2) * 0.99 + (i // 50) * 0.5) for i in range(300)], 1.0
    yield "lows above", [(0, "high", 10.0), *((i, "low", 20.0 + i) for i in range(1, 90))], 5.0
    yield "one", [(5, "low", 1.0)], 1.0


@pytest.mark.parametrize("fold_bars", [40, 10_000])
def test_zigzag_over_chunks_equals_the_fold(spark, fold_bars):
    sets = list(swing_sets())
    rows = [(name, i, 0, i * 60, k, p) for name, swings, _ in sets for i, k, p in swings]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, ord int, ts long, kind string, price double")
    sizes = spark.createDataFrame([(n, r) for n, _, r in sets], "symbol string, min_reversal double")
    got = {}
    for r in whole.zigzag(df, sizes, fold_bars).orderBy("symbol", "no").collect():
        got.setdefault(r["symbol"], []).append((r["idx"], r["kind"], r["price"]))
        assert r["no"] == len(got[r["symbol"]]) - 1 and r["ts"] == r["idx"] * 60
    assert got == {n: plain_zigzag(s, r) for n, s, r in sets}


def test_zigzag_equals_the_scan_row(spark):
    bars = candles(spark, {"a": walk(6000, 3), "b": walk(40, 4), "c": walk(5, 5)})
    want = each_struct(scan_rows(bars), "zz", "symbol").select("symbol", "idx", "kind", "ts", "price")
    got = whole.zigzag(candle_swings(bars, chunk_seconds=SPAN), whole.min_reversal(bars, SPAN), 500)
    atr = scan_rows(bars).select("symbol", F.round("min_reversal", 9)).collect()
    assert sorted(atr) == sorted(whole.min_reversal(bars, SPAN).select("symbol", F.round("min_reversal", 9)).collect())
    assert sorted(map(tuple, got.drop("no").collect())) == sorted(map(tuple, want.collect()))


def test_a_long_series_in_many_chunks(spark):
    """200,000 swings of one hot symbol beside a short one; the fold of every task is bounded by the chunk."""
    rng = np.random.default_rng(5)
    price = np.cumsum(rng.normal(size=200_000)) + 1000
    kinds = rng.choice(["high", "low"], size=len(price))
    rows = [("hot", int(i), 0, int(i), str(k), float(p)) for i, (k, p) in enumerate(zip(kinds, price, strict=True))] + [("cold", 0, 0, 0, "high", 1.0)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, ord int, ts long, kind string, price double")
    sizes = spark.createDataFrame([("hot", 12.0), ("cold", 1.0)], "symbol string, min_reversal double")
    got = [(r["idx"], r["kind"], r["price"]) for r in whole.zigzag(df, sizes, 10_000).where("symbol = 'hot'").orderBy("no").collect()]
    assert got == plain_zigzag([(r[1], r[4], r[5]) for r in rows[:-1]], 12.0)


def test_values_at_the_end_need_only_the_settled_bars(spark):
    bars = candles(spark, {"a": walk(6000, 3), "b": walk(300, 4), "c": walk(12, 5)})
    names = ["rsi", "macd_hist", "end_atr", "last_atr", "realized_vol", "bb_width", "bb_mean_width"]
    keep = ["symbol", *[F.round(n, 8).alias(n) for n in names], "macd_cross", "bb_squeeze"]
    assert sorted(whole.settled_rows(bars, SPAN).select(*keep).collect()) == sorted(scan_rows(bars).select(*keep).collect())
    stats = [sorted(sizing.vol_stats(r).select("symbol", F.round("atr_pct", 8)).collect()) for r in (whole.settled_rows(bars, SPAN), scan_rows(bars))]
    assert stats[0] == stats[1]


def test_reversal_by_multiplier_and_fallback(spark):
    bars = candles(spark, {"a": walk(60, 4), "short": walk(5, 5)})
    got = {r["symbol"]: r for r in whole.min_reversal(bars, SPAN, multiplier=2.0, fallback=0.1).collect()}
    last = {r["symbol"]: r["last_close"] for r in whole.meta_summary(bars).collect()}
    assert got["a"]["min_reversal"] == pytest.approx(2 * got["a"]["last_atr"])
    assert got["short"]["last_atr"] == 0 and got["short"]["min_reversal"] == pytest.approx(0.1 * last["short"])


def test_parabola_from_power_sums(spark):
    bowl = [(c, c + 1, c - 1, c, 1.0) for c in (50 + 1e-6 * (i - 9000) ** 2 for i in range(20_000))]
    series = {"bowl": bowl, "walk": walk(3000, 8), "two": walk(2, 1), "one": walk(1, 1), "flat": [(5, 6, 4, 5, 1.0)] * 30}
    bars = candles(spark, series)
    got = {r["symbol"]: r for r in whole.quad_fit(bars, "low", 1000 * 3600).collect()}
    assert got["bowl"]["a"] == pytest.approx(1e-6, rel=1e-9)
    assert got["bowl"]["vertex"] == pytest.approx(9000, abs=1e-4) and got["bowl"]["r2"] == pytest.approx(1)
    assert (got["two"]["a"], got["two"]["r2"], got["two"]["vertex"]) == (0, 0, None) == (got["one"]["a"], got["one"]["r2"], got["one"]["vertex"])
    assert got["flat"]["r2"] == 1
    row = scan_rows(bars.where("symbol = 'walk'")).select(fit_parabola(as_xy(S.col("bars"), "low")).column().alias("q")).first()["q"]
    assert [got["walk"][k] for k in ("a", "r2", "vertex")] == pytest.approx([row[k] for k in ("a", "r2", "vertex")], rel=1e-7)


def test_profile_by_runs_of_bins(spark):
    rng = random.Random(4)
    wide = [(p, p + rng.uniform(0, 30), p - rng.uniform(0, 30), p, rng.uniform(1, 9)) for p in (rng.uniform(80, 120) for _ in range(500))]
    top = [(9, 10, 0, 5, 7.0), (10, 10, 10, 10, 100.0)]
    bars = candles(spark, {"wide": wide, "top": top, "flat": [(5, 5, 5, 5, 3.0)] * 4})
    want = scan_rows(bars).select("symbol", levels.volume_profile(S.col("bars")).column().alias("p"))
    rows = {r["symbol"]: r["p"] for r in want.collect()}
    for r in whole.volume_profile(bars).collect():
        assert r["profile"]["bins"] == pytest.approx(rows[r["symbol"]]["bins"]) and len(r["profile"]["bins"]) == levels.BINS
    area = {r["symbol"]: tuple(r)[1:] for r in whole.value_area(bars).collect()}
    assert area["flat"] == (5, 5, 5)
    assert area == {r[0]: pytest.approx(tuple(r)[1:]) for r in levels.with_levels(scan_rows(bars)).select("symbol", "poc", "vah", "val").collect()}


def test_divergences_by_buckets_equal_the_scan_row(spark, fold_bars=50):
    bars = candles(spark, {"a": walk(3000, 3), "b": walk(200, 4), "c": walk(20, 5)})
    pivots = whole.series_pivots(bars, SPAN)
    want = each_struct(scan_rows(bars), momentum.divergences("rsi", "macd"), "symbol")
    places = [F.round(c, 7).alias(c) if c in ("p1", "p2", "i1", "i2") else c for c in want.columns]
    found = whole.divergences(pivots, fold_bars=fold_bars)
    rows = found.select(*places).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, want.select(*places).collect()))
    assert {r["kind"] for r in rows} == set(momentum.DIVERGENCE_KINDS) and {r["indicator"] for r in rows} == {"rsi", "macd"}
    assert found.groupBy("symbol").count().where("count > 3").count() == whole.recent_divergences(found).where("no = 2").count()


def test_nearest_pivot_takes_the_earlier_on_ties(spark):
    rows = [("a", "close", "low", 20, 0, 1.0), ("a", "rsi", "low", 14, 0, 2.0), ("a", "rsi", "low", 26, 0, 3.0), ("a", "rsi", "high", 20, 0, 4.0)]
    rows += [("a", "close", "low", 33, 0, 1.0), ("a", "close", "high", 60, 0, 1.0), ("a", "macd", "high", 67, 0, 1.0)]
    pivots = spark.createDataFrame(rows, "symbol string, series string, kind string, bar_idx long, ts long, price double")
    got = {(r["indicator"], r["kind"], r["bar_idx"]): r["match_idx"] for r in whole.nearest_pivots(pivots).collect()}
    assert got == {("rsi", "low", 20): 14, ("rsi", "low", 33): None, ("rsi", "high", 60): None, **{("macd", k, i): None for k, i in (("low", 20), ("low", 33), ("high", 60))}}


def test_no_bars_are_gathered(spark, sf):
    for name in "macd_cross vol_stats min_reversal quad_fit volatility_summary momentum_summary volume_profile poc_value_area meta_summary divergences_lines".split():
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan, name


def test_empty_tables(spark):
    bars = candles(spark, {"a": walk(30, 1)}).limit(0)
    assert whole.zigzag(candle_swings(bars, chunk_seconds=SPAN), whole.min_reversal(bars, SPAN)).collect() == []
    for df in (whole.meta_summary(bars), whole.quad_fit(bars, "low", SPAN), whole.value_area(bars), whole.momentum_summary(bars, SPAN)):
        assert df.collect() == []


def test_levels_by_rounds_of_sums_equal_the_scan_row(spark):
    """Also of few swings, of none, of one price, of bars without symbol or time."""
    rng = random.Random(6)
    coarse = [(c, c + 1.0, c - 1.0, c, 1.0) for c in (float(rng.randrange(4)) for _ in range(900))]
    spikes = [(o, h * (1e6 if i % 97 == 50 else 1), x, c, v) for i, (o, h, x, c, v) in enumerate(walk(1500, 9))]
    series = {"a": walk(3000, 3), "few": walk(24, 4), "none": walk(5, 5), "flat": [(5, 5, 5, 5, 3.0)] * 40, "coarse": coarse, "spikes": spikes, "lost": walk(400, 8)}
    bars = candles(spark, series)
    late = F.col("symbol").isin("a", "lost") & (F.unix_seconds("ts") == F.min(F.unix_seconds("ts")).over(Window.partitionBy("symbol")))
    bars = bars.withColumn("ts", F.when(~late, F.col("ts"))).withColumn("symbol", F.when(F.col("symbol") != "lost", F.col("symbol")))
    columns = ["symbol", *[F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in ("clusters", "support", "resistance")]]
    want = {r[0]: tuple(r) for r in levels.with_levels(scan_rows(bars)).select(*columns).collect()}
    got = whole.find_levels(bars, SPAN).select(*columns).collect()
    assert len(got) == len(want) == len(series) and {r[0]: tuple(r) for r in got} == want
    assert want["none"][1] == [] and len(want["a"][1]) == levels.CLUSTERS


def test_levels_of_long_series_gather_no_bars(spark, sf):
    plan = QUERIES["find_levels_lines"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "later_low" not in plan and "collect_list(struct" not in plan


def test_divergences_compute_the_pivots_once(spark, sf):
    """They are matched by short windows in one shuffle, without a join that would read them again."""
    pivots = whole.series_pivots(candles(spark, {"a": walk(300, 3)}), SPAN)
    matched = whole.nearest_pivots(pivots)._jdf.queryExecution().optimizedPlan().toString()
    joins = pivots._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert matched.count("Join ") == joins
    assert whole.divergences(pivots)._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") >= 2
