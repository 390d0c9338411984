import copy

import pytest
from shapes import candles, walk

from barloom.plans.summary import compact_summary, market_summary
from barloom.plans.thesis import compose_thesis, rank_setups

T1, DAY = 1_700_000_000, 86400
LAST = T1 + 200 * DAY


def summary(**o):
    base = {
        "meta": {"candle_count": 200, "timeframe_seconds": DAY, "first_ts": T1, "last_ts": LAST, "last_price": 100.0},
        "trend": {"direction": "sideways", "strength": 0.0, "duration_candles": 0, "slope_pct_per_candle": 0.0},
        "plr": [],
        "levels": {"support": [], "resistance": [], "poc": 0.0, "vah": 0.0, "val": 0.0},
        "momentum": {
            "rsi": 50.0,
            "rsi_state": "neutral",
            "macd_cross": "none",
            "macd_histogram": 0.0,
            "divergences": {"count": 0, "by_kind": {}, "recent": []},
        },
        "volatility": {"atr": 1.0, "atr_pct": 1.0, "bb_squeeze": False, "bb_width_pct": 2.0, "state": "stable"},
        "patterns": [],
    }
    base = copy.deepcopy(base)
    for k, v in o.items():
        base[k] = v if isinstance(v, list) else {**base[k], **v}
    return base


def hit(kind, confidence, target=None, invalidation=None, ts=LAST):
    return {
        "detector_no": 0,
        "kind": kind,
        "confidence": confidence,
        "points": [{"idx": 199, "ts": ts, "price": 100.0, "role": "apex"}],
        "target_price": target,
        "invalidation_price": invalidation,
    }


def divergence(kind):
    return {"count": 1, "by_kind": {}, "recent": [{"kind": kind, "indicator": "rsi", "ts": 1, "price": 100.0}]}


BULLS = {
    "trend": {"direction": "up", "strength": 0.8},
    "momentum": {"rsi": 28.0, "rsi_state": "oversold", "macd_cross": "bullish", "divergences": divergence("bullish")},
}
ROOM = {"support": [95.0], "resistance": [110.0], "poc": 98.0, "vah": 105.0, "val": 96.0}
CASES = {
    "long": summary(**BULLS, levels=ROOM),
    "short": summary(
        trend={"direction": "down", "strength": 0.8},
        momentum={"rsi": 74.0, "rsi_state": "overbought", "macd_cross": "bearish", "divergences": divergence("bearish")},
        levels={"support": [88.0], "resistance": [105.0], "poc": 102.0, "vah": 106.0, "val": 92.0},
    ),
    "conflict": summary(
        trend={"direction": "up", "strength": 0.5}, momentum={"rsi": 72.0, "rsi_state": "overbought"}
    ),
    "no_room": summary(
        **BULLS, levels={"support": [99.0], "resistance": [100.3], "poc": 100.0, "vah": 100.1, "val": 99.2}
    ),
    "measured": summary(
        **BULLS, levels=ROOM, patterns=[hit("inverse_head_shoulders", 0.8, 130.0, 94.0)]
    ),
    "empty": summary(meta={"candle_count": 0, "last_price": 0.0}),
    "crowded": summary(
        **BULLS,
        levels={**ROOM, "support": [99.9]},
        patterns=[hit("double_bottom", 0.7), hit("bull_flag", 0.6), hit("ascending_triangle", 0.5)],
    ),
    "neutral_kinds": summary(patterns=[hit("symmetric_triangle", 0.8), hit("channel_flat", 0.7)]),
    "stale": summary(patterns=[hit("double_top", 0.95, ts=T1 + 100_000)]),
    "recent": summary(patterns=[hit("double_top", 0.95)]),
    "at_highs": summary(
        **BULLS, levels={"support": [98.0], "resistance": [], "poc": 95.0, "vah": 0.0, "val": 0.0}
    ),
    "far_stop": summary(
        meta={"last_price": 307.34},
        **BULLS,
        levels={"support": [283.37], "resistance": [], "poc": 226.82, "vah": 0.0, "val": 195.8},
        volatility={"atr": 6.07},
    ),
    "minutes": summary(meta={"timeframe_seconds": 300}),
    "hours": summary(meta={"timeframe_seconds": 3600}),
}


@pytest.fixture(scope="module")
def theses(spark):
    schema = market_summary(candles(spark, {"a": walk(40, 1)})).schema
    df = spark.createDataFrame([{"symbol": k, **v} for k, v in CASES.items()], schema)
    return {r.symbol: r for r in compose_thesis(df).collect()}


def factors(t, side):
    return [p.factor for p in t[side]]


def test_directional_verdicts(theses):
    up, down = theses["long"], theses["short"]
    assert (up.bias, up.verdict) == ("bullish", "long") and up.setup.stop < 100 < up.setup.target and up.setup.rr >= 1
    assert (down.bias, down.verdict) == ("bearish", "short") and down.setup.target < 100 < down.setup.stop
    assert up.invalidation.reason == "structural stop" and up.confidence > 0


def test_conflict_and_no_room_stand_aside(theses):
    assert theses["conflict"].bias == "neutral" and theses["conflict"].setup is None
    t = theses["no_room"]
    assert t.bias == "bullish" and t.verdict == "stand_aside" and t.setup is None
    assert any("no clean setup" in n for n in t.notes)


def test_pattern_target_and_invalidation(theses):
    t = theses["measured"]
    assert t.setup.target == 130 and "inverse_head_shoulders" in t.setup.basis and t.invalidation.price == 94


def test_empty_series(theses):
    t = theses["empty"]
    assert (t.verdict, t.confidence, t.setup, t.notes) == ("stand_aside", 0.0, None, ["insufficient data"])


def test_evidence_is_capped_and_sorted(theses):
    t = theses["crowded"]
    weights = [p.weight for p in t.bull]
    assert len(weights) == 5 and weights == sorted(weights, reverse=True)


def test_neutral_kinds_are_notes(theses):
    t = theses["neutral_kinds"]
    assert not t.bull and not t.bear
    assert "channel flat — await breakout" in t.notes and "symmetric triangle — await breakout" in t.notes


def test_recency(theses):
    assert factors(theses["stale"], "bear") == [] and factors(theses["recent"], "bear") == ["double_top"]


def test_measured_move_and_clamped_stop(theses):
    t = theses["at_highs"]
    assert t.verdict == "long" and t.setup.basis == "measured move" and t.setup.rr >= 2
    t = theses["far_stop"]
    assert t.setup.stop == pytest.approx(307.34 - 1.5 * 6.07, abs=1e-3) and "ATR stop" in t.setup.basis
    assert t.setup.rr >= 2


def test_horizon(theses):
    assert [theses[k].horizon for k in ("minutes", "hours", "long")] == ["intraday", "swing", "position"]


def test_ranking_and_failures(spark):
    good = candles(spark, {f"s{i}": walk(120, i) for i in range(6)})
    broken = spark.sql(
        "SELECT 'bad' AS symbol, TIMESTAMP'2024-01-01' AS ts, 1D AS open, CAST(NULL AS DOUBLE) AS high, 1D AS low, 1D AS close, 1D AS volume"
    )
    ranked, failed = rank_setups(good.union(broken))
    rows = ranked.collect()
    assert len(rows) == 6 and [r.score for r in rows] == sorted([r.score for r in rows], reverse=True)
    assert [(r.symbol, r.rows) for r in failed.collect()] == [("bad", 1)]


def test_summary_of_tiny_series(spark):
    rows = {r.symbol: r for r in market_summary(candles(spark, {"one": walk(1, 1), "ten": walk(10, 2)})).collect()}
    one = rows["one"]
    assert one.meta.candle_count == 1 and one.meta.timeframe_seconds is None and one.trend.direction == "sideways"
    assert one.momentum.rsi == 50 and one.volatility.atr == 0 and one.volatility.atr_pct is None and one.plr == []
    assert len(rows["ten"].plr) == 8


def test_compact_summary(spark):
    (r,) = compact_summary(market_summary(candles(spark, {"a": walk(200, 4)}))).collect()
    assert len(r.plr) == 4 and len(r.patterns) <= 5
    assert [p.confidence for p in r.patterns] == sorted([p.confidence for p in r.patterns], reverse=True)
