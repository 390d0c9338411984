import math

import pytest
from pyspark.sql import functions as F
from shapes import candles, walk

from barloom.functions.indicators import Indicator, suffix_extrema, with_indicators
from barloom.operators.ranges import as_of_bar, with_previous_close
from barloom.operators.swings import candle_swings, series_pivots
from barloom.sources.resample import tail_lookback

WANTED = [
    Indicator("ATR", (14,)),
    Indicator("MACD", (12, 26, 9)),
    Indicator("RSI", (14,)),
    Indicator("SQUEEZE", (20,)),
    Indicator("RVOL", (20,)),
    Indicator("EMA", (5,)),
]
COLUMNS = ["atr_14", "macd", "macd_signal", "rsi_14", "boll_upper", "keltner_lower", "realized_vol", "ema_5"]


@pytest.fixture(scope="module")
def bars(spark):
    df = candles(spark, {"a": walk(3000, 1), "b": walk(700, 2), "short": walk(9, 3)}).cache()
    yield df
    df.unpersist()


def collect(df):
    return {(r.symbol, r.bar_idx): r for r in df.collect()}


def same(x, y):
    return (x is None and y is None) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)


def test_blocks_equal_whole_series(bars):
    whole = collect(with_indicators(bars, WANTED))
    blocks = collect(with_indicators(bars, WANTED, chunk_seconds=86400 * 3, block=900))
    assert whole.keys() == blocks.keys()
    for k, r in whole.items():
        assert all(same(r[c], blocks[k][c]) for c in COLUMNS), k
        assert r.bb_squeeze == blocks[k].bb_squeeze


def test_recursions_equal_plain_loops(bars):
    got = collect(with_indicators(bars, WANTED).where("symbol = 'b'"))
    closes = [r.close for r in bars.where("symbol = 'b'").orderBy("ts").collect()]
    ema, k = closes[0], 2 / 6
    for i, c in enumerate(closes):
        ema = ema if i == 0 else c * k + ema * (1 - k)
        assert same(got["b", i].ema_5, ema)
    gain = loss = 0.0
    for i in range(1, len(closes)):
        d = closes[i] - closes[i - 1]
        up, down = max(d, 0.0), max(-d, 0.0)
        if i <= 14:
            gain, loss = gain + up / 14, loss + down / 14
        else:
            gain, loss = (gain * 13 + up) / 14, (loss * 13 + down) / 14
        if i >= 14:
            assert same(got["b", i].rsi_14, 100 - 100 / (1 + gain / loss))
        else:
            assert got["b", i].rsi_14 is None


def test_short_series_stay_null(bars):
    rows = with_indicators(bars, WANTED).where("symbol = 'short'").collect()
    assert len(rows) == 9 and all(r.atr_14 is None and r.rsi_14 is None and not r.bb_squeeze for r in rows)


def test_flat_series_has_rsi_100(spark):
    df = candles(spark, {"flat": [(5, 5, 5, 5, 1)] * 30})
    assert {r.rsi_14 for r in with_indicators(df, [Indicator("RSI", (14,))]).where("bar_idx >= 14").collect()} == {100.0}


def test_swings_in_blocks_equal_whole_series(bars):
    a = {tuple(r) for r in candle_swings(bars).collect()}
    b = {tuple(r) for r in candle_swings(bars, chunk_seconds=86400, block=100).collect()}
    assert a == b and len(a) > 500
    a = {tuple(r) for r in series_pivots(bars).collect()}
    assert a == {tuple(r) for r in series_pivots(bars, chunk_seconds=86400, block=64).collect()}


def test_ties_are_not_pivots(spark):
    prices = [1, 2, 3, 5, 5, 3, 2, 1, 2, 3, 4, 9, 4, 3, 2, 1]
    df = candles(spark, {"t": [(p, p, p, p, 1) for p in prices]})
    assert [(r.bar_idx, r.kind) for r in series_pivots(df).orderBy("bar_idx").collect()] == [(7, "low"), (11, "high")]


def test_suffix_extrema_and_previous_close(bars):
    rows = sorted(bars.where("symbol = 'b'").collect(), key=lambda r: r.ts)
    got = sorted(suffix_extrema(bars, 86400).where("symbol = 'b'").collect(), key=lambda r: r.ts)
    for i in (0, 17, 350, 698):
        assert got[i].suffix_min_low == min(r.low for r in rows[i + 1 :])
        assert got[i].suffix_max_high == max(r.high for r in rows[i + 1 :])
    assert got[-1].suffix_min_low is None
    prev = sorted(with_previous_close(bars, 86400).where("symbol = 'b'").collect(), key=lambda r: r.ts)
    assert [r.prev_close for r in prev] == [None, *[r.close for r in rows[:-1]]]


def test_tail_lookback_with_and_without_pruning(bars):
    a = {(r.symbol, r.ts) for r in tail_lookback(bars, 100).collect()}
    b = {(r.symbol, r.ts) for r in tail_lookback(bars, 100, chunk_seconds=86400).collect()}
    assert a == b and len(a) == 209
    assert tail_lookback(bars, 5001).count() == bars.count()
    with pytest.raises(ValueError):
        tail_lookback(bars, 9)


def test_as_of_bar(spark, bars):
    indexed = with_indicators(bars, []).select("symbol", "ts", "bar_idx")
    asked = (
        indexed.where("bar_idx % 97 = 5")
        .select("symbol", (F.col("ts") + F.expr("INTERVAL 59 MINUTES")).alias("at"), F.col("bar_idx").alias("request_id"))
        .union(
            spark.sql("SELECT 'a', TIMESTAMP'2000-01-01', CAST(-1 AS BIGINT) UNION ALL SELECT 'a', TIMESTAMP'2040-01-01', 2999")
        )
    )
    rows = as_of_bar(indexed, asked, 86400).collect()
    assert rows and all(r.bar_idx == r.request_id for r in rows)
