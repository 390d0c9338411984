"""Bar sets with known structure, built from close paths."""

from __future__ import annotations

import datetime as dt
import random

START = dt.datetime(2023, 11, 14, 22, 13, 20)


def rows(symbol, bars, step=3600):
    """bars: (open, high, low, close, volume)"""
    return [(symbol, START + dt.timedelta(seconds=i * step), *map(float, b)) for i, b in enumerate(bars)]


def from_closes(closes, up=0.3, down=0.3, volume=1000.0):
    """Each bar opens halfway between the last close and its own, so extremes never tie."""
    out, prev = [], closes[0]
    for c in closes:
        o = (prev + c) / 2
        out.append((o, max(o, c) + up, min(o, c) - down, c, volume))
        prev = c
    return out


def flat_bodies(prices, wick=0.5):
    return [(p, p + wick, p - wick, p, 1000.0) for p in prices]


def wave(n, period):
    """0 -> 1 -> 0 triangle wave."""
    for i in range(n):
        x = (i % period) / period
        yield i, (2 * x if x < 0.5 else 2 - 2 * x)


def channel(slope, start=100, amp=3, n=60):
    return from_closes([start + slope * i + amp * (2 * w - 1) for i, w in wave(n, 10)])


def wedge(start, lower, upper, gap=16, n=50):
    return from_closes([start + lower * i + (gap + (upper - lower) * i) * w for i, w in wave(n, 8)])


HANDLE = [118, 116.5, 115, 114.2, 115.5, 117, 118.2, 119]
RAMP = [110, 113, 116, 120]


def cup(handle=True):
    bowl = [120 - 20 * (1 - ((k - 20) / 20) ** 2) + 0.4 for k in range(1, 40)] + [119.8]
    bars = from_closes(RAMP + bowl + HANDLE, 0.2, 0.4)
    return bars if handle else bars[:45]


def v_bottom():
    legs = [120 - k for k in range(1, 21)] + [100 + k * 0.99 for k in range(1, 21)]
    return from_closes(RAMP + legs + HANDLE, 0.2, 0.4)


def on_lows(lows):
    return [(x + 0.4, x + 0.7, x, x + 0.3, 1000.0) for x in lows]


def bowl():
    return on_lows([119.5] * 5 + [100 + 20 * ((k - 25) / 25) ** 2 for k in range(51)] + [114, 114.3, 114, 114.2])


def falling():
    return on_lows([100 + 20 * ((k - 59) / 59) ** 2 for k in range(60)])


def quiet(n):
    out = []
    for i in range(n):
        c = 100.3 if i % 2 == 0 else 99.7
        out.append((100, c + 0.5, 99.2, c, 1000))
    return out


def gap_up(filled=False):
    out = quiet(20)
    for i in range(8):
        b = 106 + i * 0.2
        out.append((b, b + 0.6, b - 0.4, b + 0.3, 1500))
    if filled:
        c = out[-1][3]
        out.append((c, c, 100.2, 100.5, 2000))
    return out


def micro_gaps():
    return [(100 + i * 0.1, 101 + i * 0.1, 99 + i * 0.1, 100.5 + i * 0.1, 1000) for i in range(30)]


def through(*pivots, per_leg=6, tail=4):
    """Straight legs through the pivots, with a lead-in and a tail that confirm the ends."""
    first, last = pivots[1] - pivots[0], pivots[-1] - pivots[-2]
    closes = [pivots[0] + first * k / 12 for k in (3, 2, 1)] + [pivots[0]]
    for a, b in zip(pivots, pivots[1:], strict=False):
        closes += [a + (b - a) * k / per_leg for k in range(1, per_leg + 1)]
    closes += [pivots[-1] - last * 0.1 * k / tail for k in range(1, tail + 1)]
    return from_closes(closes, 0.15, 0.15)


def flag():
    out = [(100, 101, 99, 100, 1000)] * 10
    out += [(p - 0.5, p + 0.5, p - 1, p, 2000) for p in (100 + 1.2 * k for k in range(1, 11))]
    out += [(p, p + 0.3, p - 0.3, p, 800) for p in (112 - 0.25 * k for k in range(10))]
    return out


def walk(n, seed, size=2.5):
    rng, price, out = random.Random(seed), 100.0, []
    for _ in range(n):
        prev, price = price, max(5.0, price + rng.uniform(-size, size))
        out.append((prev, max(prev, price) + rng.random(), min(prev, price) - rng.random(), price, 1000.0))
    return out


HEAD_SHOULDERS = [100, 102, 105, 110, 115, 113, 110, 107, 105, 100, 95, 100, 105, 110, 115, 120, 125, 128, 130]
HEAD_SHOULDERS += [125, 120, 115, 110, 105, 108, 112, 115, 113, 110, 107, 105, 100, 95, 90]
DOUBLE_TOP = [100, 105, 110, 115, 120, 118, 115, 110, 105, 100, 105, 110, 115, 118, 120, 115, 112, 113, 112, 113, 112]

SHAPES = {
    "head_shoulders": flat_bodies(HEAD_SHOULDERS),
    "double_top": flat_bodies(DOUBLE_TOP),
    "channel_up": channel(0.5),
    "channel_down": channel(-0.5, 200),
    "channel_flat": channel(0),
    "rising_wedge": wedge(100, 0.5, 0.3),
    "falling_wedge": wedge(200, -0.3, -0.5),
    "cup_handle": cup(),
    "cup_without_handle": cup(False),
    "v_bottom": v_bottom(),
    "rounding_bottom": bowl(),
    "falling_parabola": falling(),
    "gap_up": gap_up(),
    "gap_filled": gap_up(True),
    "micro_gaps": micro_gaps(),
    "abcd_bullish": through(110, 90, 102.36, 85.056),
    "gartley_bullish": through(80, 120, 95.28, 108.876, 88.56),
    "bat_bullish": through(80, 120, 102, 111, 84.56),
    "butterfly_bullish": through(80, 120, 88.56, 105.852, 64),
    "crab_bullish": through(80, 120, 102, 111, 55.28),
    "triple_top": through(120, 104, 119.5, 105, 120.2),
    "triple_bottom": through(100, 116, 100.5, 115, 99.8),
    "shallow_double": through(100, 160, 156, 160.4),
    "misaligned_double": through(120, 100, 114),
    "broken_abcd": through(110, 90, 100, 86),
    "broken_xabcd": through(80, 120, 92, 107.4, 88.56),
    "bull_flag": flag(),
}


def candles(spark, shapes):
    from barloom.schema import CANDLE_SCHEMA

    data = [r for name, bars in shapes.items() for r in rows(name, bars)]
    return spark.createDataFrame(data, CANDLE_SCHEMA)
