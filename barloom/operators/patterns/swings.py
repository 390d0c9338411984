"""Patterns read off raw swings and closes: head & shoulders, triangles, flags."""

from __future__ import annotations

from barloom.functions.sql import F, Sql
from barloom.functions.arrays import Candidates, at, tail, windows
from barloom.functions.fits import fit_line
from barloom.operators.patterns.hits import hit, point, when_enough
from barloom.operators.series import as_xy

# Fixed values.
SHOULDER_TOLERANCE = 0.05
TRIANGLE_SWINGS = 4
FLAT_SLOPE_PCT = 0.05
TRIANGLE_CONFIDENCE = 0.6
FLAG_BARS = 10
FLAG_MIN_IMPULSE = 0.05
FLAG_MAX_PULLBACK = 0.5
FLAG_CONFIDENCE = 0.55


def head_shoulders_hits(highs: Sql, lows: Sql) -> Sql:
    """Tops first, then the inverse form."""
    return F.concat(
        _shoulders(highs, lows, 1.0, "head_shoulders"),
        _shoulders(lows, highs, -1.0, "inverse_head_shoulders"),
    )


def _shoulders(extremes: Sql, between: Sql, sign: float, kind: str) -> Sql:
    """Three consecutive extremes, the middle one furthest out, with equal shoulders."""
    up = F.lit(sign)
    c = Candidates.of(windows(extremes, 3), left=lambda w: w[0], head=lambda w: w[1], right=lambda w: w[2])
    c = c.where(lambda x: (up * x.head.price > up * x.left.price) & (up * x.head.price > up * x.right.price),
    )
    c = c.add(skew=lambda x: F.try_divide(
            F.abs(x.left.price - x.right.price), F.greatest(x.left.price, x.right.price)
        ),
    )
    c = c.where(lambda x: x.skew <= SHOULDER_TOLERANCE)
    # The first opposite swing on either side of the head, not the furthest one.
    c = c.add(n1=lambda x: at(F.filter(between, lambda s: (s.idx > x.left.idx) & (s.idx < x.head.idx)), 0),
        n2=lambda x: at(F.filter(between, lambda s: (s.idx > x.head.idx) & (s.idx < x.right.idx)), 0),
    )
    c = c.where(lambda x: x.n1.isNotNull() & x.n2.isNotNull())
    c = c.add(neck=lambda x: (x.n1.price + x.n2.price) / 2.0)
    return c.to(lambda x: hit(
            1,
            kind,
            F.greatest(0.5, 1.0 - x.skew * 10.0),
            F.array(
                point(x.left, "left_shoulder"),
                point(x.head, "head"),
                point(x.right, "right_shoulder"),
                point(x.n1, "neckline_left"),
                point(x.n2, "neckline_right"),
            ),
            x.neck - (x.head.price - x.neck),
            x.head.price,
        ),
    )


def triangle_hits(highs: Sql, lows: Sql) -> Sql:
    """Lines through the last four swing highs and lows: one flat or both converging."""
    c = Candidates.single(hi=tail(highs, TRIANGLE_SWINGS), lo=tail(lows, TRIANGLE_SWINGS))
    c = c.where(lambda x: (F.size(x.hi) >= 2) & (F.size(x.lo) >= 2))
    c = c.add(all=lambda x: F.concat(x.hi, x.lo),
        up=lambda x: fit_line(as_xy(x.hi, "price")).slope,
        dn=lambda x: fit_line(as_xy(x.lo, "price")).slope,
    )
    c = c.add(mean=lambda x: F.aggregate(x.all, 0.0, lambda a, p: a + p.price) / F.size(x.all),
    )
    c = c.add(up=lambda x: F.try_divide(x.up, x.mean) * 100.0,
        dn=lambda x: F.try_divide(x.dn, x.mean) * 100.0,
    )
    flat = FLAT_SLOPE_PCT
    c = c.add(kind=lambda x: F.when((F.abs(x.up) < flat) & (x.dn > flat), F.lit("ascending_triangle"))
        .when((F.abs(x.dn) < flat) & (x.up < -flat), F.lit("descending_triangle"))
        .when((x.up < -flat) & (x.dn > flat), F.lit("symmetric_triangle")),
    )
    c = c.where(lambda x: x.kind.isNotNull())
    return c.to(lambda x: hit(
            3,
            x.kind,
            TRIANGLE_CONFIDENCE,
            F.slice(
                F.concat(
                    F.transform(x.hi, lambda s: point(s, "high")), F.transform(x.lo, lambda s: point(s, "low"))
                ),
                1,
                4,
            ),
        ),
    )


def flag_hits(bars: Sql, n: Sql) -> Sql:
    """A move of 5% or more over ten bars, then a pullback of less than half of it."""
    c = Candidates.single(
        start=at(bars, n - 2 * FLAG_BARS), top=at(bars, n - FLAG_BARS), end=at(bars, n - 1)
    )
    c = c.add(impulse=lambda x: F.try_divide(x.top.close - x.start.close, x.start.close),
        pullback=lambda x: F.try_divide(x.end.close - x.top.close, x.top.close),
    )
    c = c.where(lambda x: (F.abs(x.impulse) >= FLAG_MIN_IMPULSE)
        & (x.impulse * x.pullback < 0)
        & (F.abs(F.try_divide(x.pullback, x.impulse)) < FLAG_MAX_PULLBACK),
    )
    hits = c.to(lambda x: hit(
            4,
            F.when(x.impulse > 0, F.lit("bull_flag")).otherwise(F.lit("bear_flag")),
            FLAG_CONFIDENCE,
            F.array(
                point(x.start, "impulse_start", x.start.close),
                point(x.top, "impulse_end", x.top.close),
                point(x.end, "flag_end", x.end.close),
            ),
            x.top.close * (1.0 + x.impulse),
        ),
    )
    return when_enough(n >= 2 * FLAG_BARS, hits)
