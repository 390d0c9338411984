import datetime as dt

import pytest
from shapes import candles, walk

from barloom.functions.indicators import PRESETS, apply_preset, setup_preset
from barloom.operators.sizing import position_size
from barloom.sources.candles import clean_quotes, load_candles, require_valid, validate_candles, write_candles
from barloom.schema import TIMEFRAME_MINUTES
from barloom.sources.resample import infer_timeframe, resample_candles

T0 = dt.datetime(2024, 1, 1)


def hour(h, *ohlcv):
    return ("x", T0 + dt.timedelta(hours=h), *map(float, ohlcv))


def test_resample_aligns_to_the_epoch_and_skips_gaps(spark):
    from barloom.schema import CANDLE_SCHEMA

    rows = [hour(1, 10, 12, 9, 11, 5), hour(2, 11, 15, 10, 14, 5), hour(3, 14, 14, 8, 9, 5), hour(9, 9, 9, 9, 9, 1)]
    got = resample_candles(spark.createDataFrame(rows, CANDLE_SCHEMA), 4 * 3600).orderBy("ts").collect()
    assert [tuple(r)[1:] for r in got] == [
        (T0, 10.0, 15.0, 8.0, 9.0, 15.0),
        (T0 + dt.timedelta(hours=8), 9.0, 9.0, 9.0, 9.0, 1.0),
    ]


def test_same_second_ticks_keep_their_arrival_order(spark):
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, seq bigint"
    rows = [("x", T0, *[float(v)] * 4, 1.0, v) for v in (3, 1, 2)]
    (bar,) = resample_candles(spark.createDataFrame(rows, schema), 60).collect()
    assert (bar.open, bar.close, bar.high, bar.low) == (1.0, 3.0, 3.0, 1.0)


def test_clean_and_validate(spark):
    schema = "symbol string, date timestamp, open double, high double, low double, close double, volume double"
    t = T0.replace(microsecond=999000)
    rows = [("x", t, 1.0, 2.0, 0.5, 1.5, None), ("x", t, 1.0, None, 0.5, 1.5, 3.0)]
    (q,) = clean_quotes(spark.createDataFrame(rows, schema)).collect()
    assert (q.ts, q.volume) == (T0, 0.0)
    valid, bad = validate_candles(spark.createDataFrame(rows, schema).withColumnRenamed("date", "ts"))
    assert valid.count() == 1 and [r.missing_field for r in bad.collect()] == ["high"]
    with pytest.raises(Exception, match="invalid candle"):
        require_valid(spark.createDataFrame(rows, schema).withColumnRenamed("date", "ts")).collect()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_write_and_load_round_trip(spark, tmp_path, fmt):
    df = candles(spark, {"a": walk(40, 5), "b": walk(30, 6)})
    write_candles(df, str(tmp_path / fmt), fmt)
    back = load_candles(spark, str(tmp_path / fmt), fmt, source="store", timeframe="1h")
    assert {r.source for r in back.collect()} == {"store"}
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        load_candles(spark, "x", "xlsx")


def test_infer_timeframe(spark):
    df = candles(spark, {"a": walk(5, 1), "one": walk(1, 1)})
    assert {r.symbol: r.timeframe_seconds for r in infer_timeframe(df).collect()} == {"a": 3600, "one": None}


def test_presets_add_their_columns(spark):
    df = candles(spark, {"a": walk(60, 1)})
    for name in PRESETS:
        assert apply_preset(df, name).count() == 60
    assert "ema_200" in apply_preset(df, "trend_analysis").columns
    with pytest.raises(ValueError):
        apply_preset(df, "nope")


def test_presets_are_set_up_with_timeframe_and_lookback(spark):
    df = candles(spark, {"a": walk(3000, 1)})
    four_hours = resample_candles(df, 4 * 3600)
    for name, lookback in (("swing_trading", 500), ("clean", 200), ("trend_analysis", 500)):
        got = setup_preset(df, name)
        assert got.count() == min(lookback, resample_candles(df, TIMEFRAME_MINUTES[PRESETS[name].timeframe] * 60).count())
    newest = four_hours.agg({"ts": "max"}).first()[0]
    assert setup_preset(df, "swing_trading", lookback=20).agg({"ts": "max"}).first()[0] == newest


PLAN = "account_size double, risk_pct double, entry_price double, stop_loss double, target_price double, commission_per_side double"


def test_position_size(spark):
    rows = [(10000.0, 1.0, 100.0, 95.0, 115.0, None), (10000.0, 1.0, 50.0, 52.0, None, 2.5)]
    long, short = position_size(spark.createDataFrame(rows, PLAN)).collect()
    assert (long.side, long.shares, long.position_value, long.actual_dollar_risk) == ("long", 20, 2000.0, 100.0)
    assert (long.risk_reward, long.potential_profit, long.breakeven_winrate_pct) == (3.0, 300.0, 25.0)
    assert (short.side, short.shares, short.actual_dollar_risk, short.risk_reward) == ("short", 50, 105.0, None)
    same = spark.createDataFrame([(1000.0, 1.0, 5.0, 5.0, None, None)], PLAN)
    with pytest.raises(Exception, match="cannot be the same"):
        position_size(same).collect()
    assert position_size(same, strict=False).first().shares is None
