"""Cup & handle and rounding bottom: parabolic basins."""

from __future__ import annotations

from barloom.functions.sql import F, Sql
from barloom.functions.arrays import Candidates, at, let
from barloom.functions.fits import fit_parabola, on_parabola
from barloom.functions.numbers import round_half_up
from barloom.operators.patterns.hits import bar_point, hit, no_hits, point, when_enough
from barloom.operators.series import as_xy, bar_slice, of_kind

# Fixed values.
MIN_BARS = 40
MIN_SPAN = 20
RIM_TOLERANCE = 0.03
MIN_DEPTH_ATR = 2.5
MAX_DEPTH_FRAC = 0.35
MIN_R2 = 0.8
VERTEX_THIRD = 1 / 3
BASIN_DEPTH_FRAC = 0.2
MIN_BASIN_FRAC = 0.25
HANDLE_MIN_BARS = 3
HANDLE_MAX_DEPTH_FRAC = 0.5
HANDLE_RECOVERY_FRAC = 0.15
ARC_SAMPLES = 7
ROUNDING_WINDOWS = (40, 60, 90)
MIN_RECOVERY_FRAC = 0.6
MAX_OVERSHOOT_FRAC = 0.15
VERTEX_MIN_FRAC = 0.25
VERTEX_MAX_FRAC = 0.8
MAX_CONFIDENCE = 0.85


def _arc(bars: Sql, fit: Sql, first: Sql, span: Sql) -> Sql:
    """Samples of the fitted parabola at equal steps."""
    steps = F.transform(
        F.sequence(0, F.lit(ARC_SAMPLES - 1)),
        lambda k: first.cast("double") + span * k / F.lit(float(ARC_SAMPLES - 1)),
    )
    return F.transform(
        steps,
        lambda x: bar_point(at(bars, round_half_up(x).cast("int")), on_parabola(fit, x), "arc"),
    )


def _basin_share(lows: Sql, ceiling: Sql) -> Sql:
    return F.size(F.filter(lows, lambda p: p.y <= ceiling)) / F.size(lows)


def _precision(r2: Sql) -> Sql:
    return 0.2 * ((r2 - F.lit(MIN_R2)) / F.lit(1 - MIN_R2))


def cup_handle_hits(bars: Sql, n: Sql, zz: Sql, atr: Sql, close: Sql) -> Sql:
    """The newest right rim with the nearest left rim that makes a complete cup with handle.

    Everything that can be decided from the two rims and the low after the right
    rim is decided before a bar range is touched; the basin is fitted last.
    """
    highs = of_kind(zz, "high")
    oldest = at(highs, 0).idx
    rights = F.filter(
        highs,
        lambda r: (n - 1 - r.idx >= HANDLE_MIN_BARS) & (r.idx - oldest >= (n - 1 - r.idx) * 2),
    )

    def pairs_of(r: Sql) -> Sql:
        reach = F.greatest(F.lit(MIN_SPAN), (n - 1 - r.idx) * 2)
        lefts = F.filter(
            highs,
            lambda l: (r.idx - l.idx >= reach)  # noqa: E741
            & (F.abs(l.price - r.price) <= F.lit(RIM_TOLERANCE) * F.greatest(l.price, r.price)),
        )
        return F.transform(F.reverse(lefts), lambda l: F.struct(l.alias("left"), r.alias("right")))  # noqa: E741

    c = Candidates(F.flatten(F.transform(F.reverse(rights), pairs_of)), ("left", "right"))
    c = c.add(rim=lambda x: (x.left.price + x.right.price) / 2.0,
        dip=lambda x: at(bars, x.right.idx).later_low,
    )
    # Depth is at most 35% of the rim, which bounds handle depth and recovery.
    c = c.where(lambda x: (x.rim - x.dip > 0)
        & (x.rim - x.dip <= F.lit(HANDLE_MAX_DEPTH_FRAC * MAX_DEPTH_FRAC) * x.rim * 1.000001)
        & (close >= x.rim * F.lit(1 - HANDLE_RECOVERY_FRAC * MAX_DEPTH_FRAC - 0.000001)),
    )
    # The lowest low needs no lambda per bar: a slice of the plain list of lows.
    lows = F.transform(bars, lambda b: b.low)
    c = Candidates(
        let(lows, lambda ls: c.add(bottom=lambda x: F.array_min(bar_slice(ls, x.left.idx, x.right.idx))).array),
        (*c.fields, "bottom"),
    )
    c = c.add(depth=lambda x: x.rim - x.bottom)
    c = c.where(lambda x: (x.depth >= F.lit(MIN_DEPTH_ATR) * atr)
        & (x.depth <= F.lit(MAX_DEPTH_FRAC) * x.rim)
        & (x.rim - x.dip <= F.lit(HANDLE_MAX_DEPTH_FRAC) * x.depth)
        & (close >= x.rim - F.lit(HANDLE_RECOVERY_FRAC) * x.depth)
    )
    c = c.add(lows=lambda x: as_xy(bar_slice(bars, x.left.idx, x.right.idx), "low"))
    c = c.where(
        lambda x: _basin_share(x.lows, x.bottom + F.lit(BASIN_DEPTH_FRAC) * x.depth) >= MIN_BASIN_FRAC
    )
    c = c.add(fit=lambda x: fit_parabola(x.lows))
    c = c.where(lambda x: (x.fit.a > 0)
        & (x.fit.r2 >= MIN_R2)
        & (x.fit.vertex >= x.left.idx + (x.right.idx - x.left.idx) * F.lit(VERTEX_THIRD))
        & (x.fit.vertex <= x.right.idx - (x.right.idx - x.left.idx) * F.lit(VERTEX_THIRD)),
    )
    c = c.first()
    c = c.add(handle=lambda x: at(F.filter(F.slice(bars, x.right.idx + 2, n), lambda b: b.low == x.dip), 0),
        skew=lambda x: F.abs(x.left.price - x.right.price) / F.greatest(x.left.price, x.right.price),
        end=lambda x: at(bars, n - 1),
    )
    hits = c.to(lambda x: hit(
            7,
            "cup_handle",
            F.least(
                F.lit(MAX_CONFIDENCE),
                0.5
                + _precision(x.fit.r2)
                + 0.1 * (1.0 - x.skew / F.lit(RIM_TOLERANCE))
                + 0.05 * (1.0 - (x.rim - x.dip) / x.depth / F.lit(HANDLE_MAX_DEPTH_FRAC)),
            ),
            F.concat(
                F.array(
                    point(x.left, "left_rim"),
                    bar_point(at(bars, round_half_up(x.fit.vertex).cast("int")), x.bottom, "cup_bottom"),
                    point(x.right, "right_rim"),
                    bar_point(x.handle, x.dip, "handle_low"),
                    bar_point(x.end, close, "handle_end"),
                ),
                _arc(bars, x.fit, x.left.idx, x.right.idx - x.left.idx),
            ),
            x.rim + x.depth,
            x.dip,
        ),
    )
    return when_enough((atr > 0) & (n >= MIN_BARS), hits)


def rounding_bottom_hits(bars: Sql, n: Sql, atr: Sql, close: Sql) -> Sql:
    """The first of the last 40, 60 or 90 bars that form a recovered basin."""
    c = Candidates.of(
        F.filter(F.array(*ROUNDING_WINDOWS), lambda w: w <= n), w=lambda w: w, first=lambda w: n - w
    )
    c = c.add(lows=lambda x: as_xy(bar_slice(bars, x.first, n - 1), "low"))
    c = c.add(fit=lambda x: fit_parabola(x.lows))
    c = c.where(lambda x: (x.fit.a > 0)
        & (x.fit.r2 >= MIN_R2)
        & (x.fit.vertex >= x.first + x.w * F.lit(VERTEX_MIN_FRAC))
        & (x.fit.vertex <= x.first + x.w * F.lit(VERTEX_MAX_FRAC)),
    )
    c = c.add(bottom=lambda x: on_parabola(x.fit, x.fit.vertex),
        rim=lambda x: F.least(
            on_parabola(x.fit, x.first.cast("double")), on_parabola(x.fit, (n - 1).cast("double"))
        ),
    )
    c = c.add(depth=lambda x: x.rim - x.bottom)
    c = c.add(share=lambda x: _basin_share(x.lows, x.bottom + F.lit(BASIN_DEPTH_FRAC) * x.depth))
    c = c.where(lambda x: (x.depth >= F.lit(MIN_DEPTH_ATR) * atr)
        & (x.depth <= F.lit(MAX_DEPTH_FRAC) * x.rim)
        & (x.share >= MIN_BASIN_FRAC)
        & (close >= x.bottom + F.lit(MIN_RECOVERY_FRAC) * x.depth)
        & (close <= x.rim + F.lit(MAX_OVERSHOOT_FRAC) * x.depth),
    )
    hits = c.first().to(
        lambda x: hit(
            8,
            "rounding_bottom",
            F.least(
                F.lit(MAX_CONFIDENCE),
                0.5
                + _precision(x.fit.r2)
                + 0.1 * F.least(1.0, x.share / F.lit(2 * MIN_BASIN_FRAC)),
            ),
            F.concat(
                F.array(
                    bar_point(at(bars, x.first), on_parabola(x.fit, x.first.cast("double")), "rim_left"),
                    bar_point(at(bars, round_half_up(x.fit.vertex).cast("int")), x.bottom, "bottom"),
                    bar_point(at(bars, n - 1), close, "recovery_end"),
                ),
                _arc(bars, x.fit, x.first, x.w - 1),
            ),
            x.rim + x.depth,
            x.bottom,
        ),
    )
    return when_enough((atr > 0) & (n >= MIN_BARS), hits)


def rounding_unless_cup(cup: Sql, rounding: Sql) -> Sql:
    """One structure, one signal: a cup silences the rounding bottom."""
    return F.when(F.size(cup) > 0, no_hits()).otherwise(rounding)
