"""Whole series, strict order, one scan per view."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from shapes import candles, walk

from barloom.functions.layout import index_bars
from barloom.functions.sql import F as S
from barloom.operators.patterns.templates import template_hits
from barloom.operators.ranges import price_alerts, with_previous_close, crossed
from barloom.operators.series import scan_rows
from barloom.operators.trend import trend_by_symbol, trend_summary
from barloom.plans.catalog import QUERIES
from barloom.plans.thesis import rank_setups
from barloom.session import checkpoint_root
from barloom.sources.candles import clean_quotes, is_valid_candle, validate_candles
from barloom.sources.resample import infer_timeframe, tail_lookback


def test_whole_series_unless_a_lookback_is_given(spark):
    long = candles(spark, {"a": walk(6000, 3)})
    row = scan_rows(long).select("n", trend_summary().column().alias("t")).first()
    assert row["n"] == 6000
    assert row["t"]["strength"] == pytest.approx(trend_by_symbol(index_bars(long)).first()["strength"], abs=1e-9)
    assert scan_rows(long, lookback=5500).select("n").first()["n"] == 5500
    assert tail_lookback(long, 5999).count() == 5999


def test_templates_come_by_arity_then_window_however_far_apart(spark):
    rows = [(i * 160, i, "high" if i % 2 else "low", i * 160 * 3600, 100.0 + (38.2 if i % 2 else 14.6) * (1 + 0.01 * i)) for i in range(12)]
    zz = spark.createDataFrame([(rows,)], "zz array<struct<idx:int,ord:int,kind:string,ts:long,price:double>>")
    wide = zz.withColumn("atr", F.lit(0.5)).select(template_hits(S.col("zz"), S.col("atr")).column().alias("hits"))
    hits = [h for r in wide.collect() for h in r["hits"]]
    order = [(len(h["points"]), h["points"][0]["ts"]) for h in hits]
    assert order == sorted(order)


def test_numbers_that_are_none_are_rejected(spark):
    rows = [("a", dt.datetime(2024, 1, 1), *[float(x) for x in v], 1.0) for v in ((1, 2, 0.5, 1), ("nan", 2, 1, 1), (1, "inf", 1, 1), (1, 2, "-inf", 1))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    valid, bad = validate_candles(df)
    assert valid.count() == 1 and df.where(is_valid_candle()).count() == 1
    assert sorted(r["missing_field"] for r in bad.collect()) == ["high", "low", "open"]
    assert clean_quotes(df.withColumnRenamed("ts", "date")).count() == 1


def test_alerts_by_buckets_equal_all_pairs(spark):
    bars = candles(spark, {"a": walk(300, 5), "b": walk(50, 6)})
    levels = [(s, 90 + i * 0.37, w) for s in ("a", "b", "c") for i in range(60) for w in (None, "above", "below", "cross")]
    rules = spark.createDataFrame(levels, "symbol string, price double, direction string").withColumn("note", F.lit("n"))
    pairs = with_previous_close(bars).join(rules, "symbol").where(crossed(F.col("price"), F.col("direction"), F.col("prev_close"), F.col("close")))
    assert price_alerts(bars, rules).count() == pairs.count() > 0


def test_timeframe_is_the_second_bar_even_at_the_same_time(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, 1), ("a", t, 2), ("a", t + dt.timedelta(hours=1), 3), ("b", t, 4)]
    got = infer_timeframe(spark.createDataFrame(rows, "symbol string, ts timestamp, seq long"))
    assert {r[0]: r[1] for r in got.collect()} == {"a": 0, "b": None}


@pytest.mark.parametrize("name, scans", [("trending_with_bands", 1), ("infer_timeframe_users", 1), ("indicator_last", 1), ("horizon_by_symbol", 3)])
def test_scans(spark, sf, name, scans):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == scans


def test_no_shared_folder_is_an_error(spark):
    class Unset:
        conf = {}

    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(ValueError):
        checkpoint_root(Unset)


def test_extreme_symbols_do_not_stop_a_ranking(spark):
    t, rows = dt.datetime(2024, 1, 1), []
    path = [100 + (i % 13) + (i % 7) / 3 for i in range(120)]
    series = {
        **{f"zero{n}": [0.0] * n for n in (1, 2, 3, 60)},
        **{f"same{n}": [5.0] * n for n in (1, 2, 60)},
        "below": [-x for x in path],
        "huge": [x * 1e305 for x in path],
        "tiny": [x * 1e-310 for x in path],
        "swing": [1.7e308, -1.7e308] * 50,
        "plain": path,
    }
    for symbol, prices in series.items():
        rows += [(symbol, t + dt.timedelta(hours=i), p, p, p, p, 0.0 if symbol == "plain" else None) for i, p in enumerate(prices)]
    rows += [("none", t, float("nan"), 1.0, 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    ranked, failed = rank_setups(bars)
    assert {r["symbol"] for r in ranked.select("symbol").collect()} == set(series)
    assert [r["symbol"] for r in failed.collect()] == ["none"]
