"""Parallel channels and wedges."""

from __future__ import annotations

from barloom.functions.sql import F, Sql
from barloom.functions.arrays import Candidates, at, let, tail, total
from barloom.functions.fits import fit_line, on_line
from barloom.operators.patterns.hits import bar_point, hit, point, when_enough
from barloom.operators.series import ATR_PERIOD, SWING_LOOKBACK, as_xy, bar_slice, of_kind, reversal_size, zigzag

# Channels.
SCOPES = (130, 60)
MIN_SPAN = 30
MAX_SWINGS_PER_SIDE = 6
MIN_HEIGHT_ATR = 1.5
MIN_HEIGHT_ATR_FLAT = 2.5
MAX_HEIGHT_PCT = 0.12
TOUCH_HEIGHT_FRAC = 0.2
BREAK_HEIGHT_FRAC = 0.15
FLAT_SLOPE_PCT = 0.05
MIN_CLOSE_R2 = 0.55
MIN_USAGE = 0.15
TOUCHES_PRIMARY = 3
TOUCHES_SECONDARY = 2
# Wedges.
WEDGE_MIN_SPAN = 15
WEDGE_MIN_SLOPE_PCT = 0.05
WEDGE_CONVERGENCE = 0.7
WEDGE_APEX_SPANS = 4
WEDGE_MIN_R2 = 0.5
WEDGE_MIN_TOUCHES = 2
WEDGE_MAX_RESIDUAL = 0.12
WEDGE_TOUCH_ATR = 0.3
MAX_CONFIDENCE = 0.85


def _max_of(arr: Sql, f) -> Sql:
    return F.array_max(F.transform(arr, lambda s: f(s)))


def _sides(c: Candidates) -> Candidates:
    """Add the last swings of either kind and the bar range they cover."""
    c = c.add(hi=lambda x: tail(of_kind(x.zz, "high"), MAX_SWINGS_PER_SIDE),
        lo=lambda x: tail(of_kind(x.zz, "low"), MAX_SWINGS_PER_SIDE),
    )
    c = c.where(lambda x: (F.size(x.hi) >= 2) & (F.size(x.lo) >= 2))
    return c.add(first=lambda x: F.least(x.hi[0].idx, x.lo[0].idx),
        last=lambda x: F.greatest(_max_of(x.hi, lambda s: s.idx), _max_of(x.lo, lambda s: s.idx)),
    )


def _window_atr(bars: Sql, n: Sql, scope: Sql) -> Sql:
    """ATR at the end of the last ``scope`` bars, warmed up inside them; NULL when zero."""
    ranges = F.transform(
        F.sequence(n - scope + 1, n - 1),
        lambda i: F.greatest(
            bars[i].high - bars[i].low,
            F.abs(bars[i].high - bars[i - 1].close),
            F.abs(bars[i].low - bars[i - 1].close),
        ),
    )
    p = float(ATR_PERIOD)

    def smooth(r: Sql) -> Sql:
        seed = F.aggregate(F.slice(r, 1, ATR_PERIOD), 0.0, lambda a, t: a + t) / p
        return F.aggregate(F.slice(r, ATR_PERIOD + 1, scope), seed, lambda a, t: (a * (p - 1) + t) / p)

    return let(let(ranges, smooth), lambda atr: F.when(atr > 0, atr))


def _scopes(bars: Sql, n: Sql, swings: Sql, zz: Sql, atr: Sql, close: Sql) -> Candidates:
    """The whole series, then its last 130 and 60 bars with swing structure of their own."""

    shorter = Candidates.of(
        F.filter(F.array(*SCOPES), lambda k: k < n),
        no=lambda k: n - k,
        # Inside the window the first bars cannot be confirmed as swings.
        inner=lambda k: F.filter(swings, lambda s: s.idx >= n - k + SWING_LOOKBACK),
        own=lambda k: _window_atr(bars, n, k),
    ).to(
        lambda x: F.struct(
            x.no.alias("no"),
            zigzag(x.inner, reversal_size(F.coalesce(x.own, 0.0), close)).alias("zz"),
            F.coalesce(x.own, atr).alias("atr"),
        )
    )
    whole = F.array(F.struct(("no", 0), zz.alias("zz"), atr.alias("atr")))
    return Candidates(F.concat(whole, shorter), ("no", "zz", "atr"))


def channel_hits(bars: Sql, n: Sql, swings: Sql, zz: Sql, atr: Sql, close: Sql) -> Sql:
    """At most one channel: the regression line of the closes, offset through the outermost swings."""
    c = _sides(_scopes(bars, n, swings, zz, atr, close))
    c = c.where(lambda x: x.last - x.first >= MIN_SPAN)
    c = c.add(seg=lambda x: as_xy(bar_slice(bars, x.first, x.last), "close"))
    c = c.add(mid=lambda x: fit_line(x.seg))
    c = c.add(up=lambda x: _max_of(x.hi, lambda s: s.price - on_line(x.mid, s.idx)),
        dn=lambda x: _max_of(x.lo, lambda s: on_line(x.mid, s.idx) - s.price),
    )
    c = c.add(height=lambda x: x.up + x.dn)
    c = c.where(lambda x: (x.up > 0)
        & (x.dn > 0)
        & (x.height >= F.lit(MIN_HEIGHT_ATR) * x.atr)
        & (x.height <= F.lit(MAX_HEIGHT_PCT) * close),
    )
    c = c.add(hits_up=lambda x: F.filter(
            x.hi,
            lambda s: F.abs(s.price - (on_line(x.mid, s.idx) + x.up)) <= F.lit(TOUCH_HEIGHT_FRAC) * x.height,
        ),
        hits_dn=lambda x: F.filter(
            x.lo,
            lambda s: F.abs(s.price - (on_line(x.mid, s.idx) - x.dn)) <= F.lit(TOUCH_HEIGHT_FRAC) * x.height,
        ),
    )
    c = c.where(lambda x: (F.greatest(F.size(x.hits_up), F.size(x.hits_dn)) >= TOUCHES_PRIMARY)
        & (F.least(F.size(x.hits_up), F.size(x.hits_dn)) >= TOUCHES_SECONDARY),
    )
    # Closes stay inside the band but travel across it.
    c = c.where(lambda x: F.forall(
            x.seg,
            lambda p: (p.y - on_line(x.mid, p.x) <= x.up + F.lit(BREAK_HEIGHT_FRAC) * x.height)
            & (on_line(x.mid, p.x) - p.y <= x.dn + F.lit(BREAK_HEIGHT_FRAC) * x.height),
        ),
    )
    c = c.add(usage=lambda x: total(x.seg, lambda p: F.abs(p.y - on_line(x.mid, p.x))) / F.size(x.seg) / x.height,
        slope=lambda x: F.try_divide(x.mid.slope, on_line(x.mid, x.last)) * 100.0,
    )
    c = c.add(kind=lambda x: F.when(x.slope >= FLAT_SLOPE_PCT, F.lit("channel_up"))
        .when(x.slope <= -FLAT_SLOPE_PCT, F.lit("channel_down"))
        .otherwise(F.lit("channel_flat")),
    )
    flat = lambda x: x.kind == "channel_flat"
    c = c.where(lambda x: (x.usage >= MIN_USAGE)
        & F.when(flat(x), x.height >= F.lit(MIN_HEIGHT_ATR_FLAT) * x.atr).otherwise(x.mid.r2 >= MIN_CLOSE_R2),
    )
    c = c.add(confidence=lambda x: F.least(
            F.lit(MAX_CONFIDENCE),
            0.5
            + 0.04 * F.least(F.greatest(F.size(x.hits_up) + F.size(x.hits_dn) - 5, 0), 3)
            + F.when(flat(x), 0.075).otherwise(0.15 * x.mid.r2)
            + 0.4 * F.least(F.greatest(x.usage - MIN_USAGE, 0.0), 0.15),
        ),
        touch=lambda x: F.greatest(_max_of(x.hits_up, lambda s: s.idx), _max_of(x.hits_dn, lambda s: s.idx)),
        # Offsets of the line that price rides and of the opposite one.
        base=lambda x: F.when(x.kind == "channel_down", x.up).otherwise(-x.dn),
        other=lambda x: F.when(x.kind == "channel_down", -x.dn).otherwise(x.up),
        centre=lambda x: on_line(x.mid, x.last),
    )
    # The most confident scope; the widest one on ties.
    best_first = F.array_sort(
        c.array, lambda a, b: F.when(a.confidence > b.confidence, -1).when(a.confidence < b.confidence, 1).otherwise(a.no - b.no)
    )
    c = Candidates(best_first, c.fields).first()

    def ride_to_upper(x: Sql) -> Sql:
        return (x.kind == "channel_up") | (flat(x) & (close <= x.centre))

    hits = c.to(lambda x: hit(
            5,
            x.kind,
            x.confidence,
            F.concat(
                F.array(
                    bar_point(at(bars, x.first), on_line(x.mid, x.first) + x.base, "base_start"),
                    bar_point(at(bars, x.touch), on_line(x.mid, x.touch) + x.base, "base_end"),
                    bar_point(at(bars, x.first), on_line(x.mid, x.first) + x.other, "offset"),
                ),
                F.transform(tail(x.hits_up, 3), lambda s: point(s, "upper_touch")),
                F.transform(tail(x.hits_dn, 3), lambda s: point(s, "lower_touch")),
            ),
            F.when(ride_to_upper(x), x.centre + x.up).otherwise(x.centre - x.dn),
            F.when(ride_to_upper(x), x.centre - x.dn).otherwise(x.centre + x.up),
        ),
    )
    return when_enough((atr > 0) & (n >= MIN_SPAN), hits)


def two_lines(zz: Sql, touch_tolerance: Sql) -> Candidates:
    """Zero or one struct: lines through the last highs and lows and the swings that touch them."""
    c = _sides(Candidates.single(zz=zz))
    c = c.add(up=lambda x: fit_line(as_xy(x.hi, "price")),
        dn=lambda x: fit_line(as_xy(x.lo, "price")),
    )
    c = c.add(hits_up=lambda x: F.filter(x.hi, lambda s: F.abs(s.price - on_line(x.up, s.idx)) <= touch_tolerance),
        hits_dn=lambda x: F.filter(x.lo, lambda s: F.abs(s.price - on_line(x.dn, s.idx)) <= touch_tolerance),
    )
    return c.add(touch=lambda x: F.greatest(
            F.coalesce(_max_of(x.hits_up, lambda s: s.idx), -1),
            F.coalesce(_max_of(x.hits_dn, lambda s: s.idx), -1),
        ),
    )


def _residual(swings: Sql, fit: Sql) -> Sql:
    return F.sqrt(
        total(swings, lambda s: F.pow(s.price - on_line(fit, s.idx), 2.0)) / F.size(swings)
    )


def wedge_hits(bars: Sql, n: Sql, zz: Sql, atr: Sql) -> Sql:
    """Two converging lines that slope the same way."""
    c = two_lines(zz, F.lit(WEDGE_TOUCH_ATR) * atr)
    c = c.where(lambda x: (x.last - x.first >= WEDGE_MIN_SPAN)
        & (F.size(x.hits_up) >= WEDGE_MIN_TOUCHES)
        & (F.size(x.hits_dn) >= WEDGE_MIN_TOUCHES)
        & (F.least(x.up.r2, x.dn.r2) >= WEDGE_MIN_R2),
    )
    c = c.add(price=lambda x: (on_line(x.up, x.last) + on_line(x.dn, x.last)) / 2.0,
        gap0=lambda x: on_line(x.up, x.first) - on_line(x.dn, x.first),
        gap1=lambda x: on_line(x.up, x.last) - on_line(x.dn, x.last),
        closing=lambda x: x.dn.slope - x.up.slope,
    )
    c = c.add(s_up=lambda x: F.try_divide(x.up.slope, x.price) * 100.0,
        s_dn=lambda x: F.try_divide(x.dn.slope, x.price) * 100.0,
    )
    steep = WEDGE_MIN_SLOPE_PCT
    c = c.add(kind=lambda x: F.when((x.s_up > steep) & (x.s_dn > steep) & (x.closing > 0), F.lit("rising_wedge")).when(
            (x.s_up < -steep) & (x.s_dn < -steep) & (x.closing > 0), F.lit("falling_wedge")
        ),
        apex=lambda x: x.first + F.try_divide(x.gap0, x.closing),
        gap=lambda x: (x.gap0 + x.gap1) / 2.0,
    )
    c = c.where(lambda x: x.kind.isNotNull()
        & (x.gap0 > 0)
        & (x.gap1 > 0)
        & (x.gap1 <= F.lit(WEDGE_CONVERGENCE) * x.gap0)
        & (_residual(x.hi, x.up) <= F.lit(WEDGE_MAX_RESIDUAL) * x.gap)
        & (_residual(x.lo, x.dn) <= F.lit(WEDGE_MAX_RESIDUAL) * x.gap)
        & (x.apex > x.last)
        & (x.apex <= x.last + F.lit(WEDGE_APEX_SPANS) * (x.last - x.first)),
    )
    q = WEDGE_CONVERGENCE
    c = c.add(confidence=lambda x: F.least(
            F.lit(MAX_CONFIDENCE),
            0.5
            + 0.15 * F.least(x.up.r2, x.dn.r2)
            + 0.1
            * F.greatest(
                0.0,
                F.least(
                    1.0,
                    (1.0 - F.try_divide(x.gap1, x.gap0) - F.lit(1 - q)) / F.lit(q),
                ),
            )
            + 0.04 * F.greatest(0, F.size(x.hits_up) + F.size(x.hits_dn) - 4),
        ),
        rising=lambda x: x.kind == "rising_wedge",
        touches=lambda x: F.concat(
            F.transform(tail(x.hits_up, 2), lambda s: point(s, "upper_touch")),
            F.transform(tail(x.hits_dn, 2), lambda s: point(s, "lower_touch")),
        ),
    )
    hits = c.to(lambda x: hit(
            6,
            x.kind,
            x.confidence,
            F.concat(
                F.array(
                    bar_point(at(bars, x.first), on_line(x.up, x.first), "upper_start"),
                    bar_point(at(bars, x.last), on_line(x.up, x.last), "upper_end"),
                    bar_point(at(bars, x.first), on_line(x.dn, x.first), "lower_start"),
                    bar_point(at(bars, x.last), on_line(x.dn, x.last), "lower_end"),
                ),
                x.touches,
            ),
            F.when(x.rising, on_line(x.dn, x.first)).otherwise(on_line(x.up, x.first)),
            F.when(x.rising, on_line(x.up, x.last)).otherwise(on_line(x.dn, x.last)),
        ),
    )
    return when_enough((atr > 0) & (n >= WEDGE_MIN_SPAN), hits)
