"""Divergences and the momentum and volatility summaries of a scan row."""

from __future__ import annotations

from barloom.functions.arrays import Candidates, windows
from barloom.functions.sql import F, Sql

# Fixed values.
MATCH_BARS = 6
RECENT_DIVERGENCES = 3
DIVERGENCE_KINDS = ("bullish", "bearish", "hidden_bullish", "hidden_bearish")
OVERBOUGHT = 70
OVERSOLD = 30
EXPANDING = 1.15
CONTRACTING = 0.85


def nearest_pivot(pivots: Sql, idx: Sql, reach: int = MATCH_BARS) -> Sql:
    """The pivot closest to bar ``idx`` within ``reach`` bars; the earlier one on ties."""
    near = F.filter(pivots, lambda p: F.abs(p.idx - idx) <= reach)
    return F.array_min(
        F.transform(
            near,
            lambda p: F.struct(("dist", F.abs(p.idx - idx)), ("idx", p.idx), ("ts", p.ts), ("price", p.price)),
        )
    )


def _one_side(indicator: str, side: str, prices: Sql, pivots: Sql) -> Sql:
    """Consecutive price pivots of one kind against their matched indicator pivots."""
    c = Candidates.of(windows(prices, 2), a=lambda w: w[0], b=lambda w: w[1])
    c = c.add(ia=lambda x: nearest_pivot(pivots, x.a.idx), ib=lambda x: nearest_pivot(pivots, x.b.idx))
    c = c.where(lambda x: x.ia.isNotNull() & x.ib.isNotNull())

    def kind(x: Sql) -> Sql:
        lower, higher = x.b.price < x.a.price, x.b.price > x.a.price
        i_lower, i_higher = x.ib.price < x.ia.price, x.ib.price > x.ia.price
        if side == "low":
            return F.when(lower & i_higher, "bullish").when(higher & i_lower, "hidden_bullish")
        return F.when(higher & i_lower, "bearish").when(lower & i_higher, "hidden_bearish")

    c = c.add(kind=kind).where(lambda x: x.kind.isNotNull())
    return c.to(
        lambda x: F.struct(
            ("indicator", indicator),
            ("kind", x.kind),
            ("p1_ts", x.a.ts),
            ("p1", x.a.price),
            ("p2_ts", x.b.ts),
            ("p2", x.b.price),
            ("i1_ts", x.ia.ts),
            ("i1", x.ia.price),
            ("i2_ts", x.ib.ts),
            ("i2", x.ib.price),
        )
    )


def divergences(*indicators: str) -> Sql:
    """All divergences of the named indicators over a scan row: lows first, then highs."""
    return F.concat(
        *[
            _one_side(name, side, F.col(f"close_{side}s"), F.col(f"{name}_{side}s"))
            for name in indicators
            for side in ("low", "high")
        ]
    )


def recent_divergences(found: Sql) -> Sql:
    """The three with the latest price point; discovery order on ties."""
    numbered = F.transform(found, lambda d, i: F.struct(("age", -d.p2_ts), ("no", i), ("d", d)))
    latest = F.slice(F.array_sort(numbered), 1, RECENT_DIVERGENCES)
    return F.transform(
        latest,
        lambda x: F.struct(
            ("kind", x.d.kind), ("indicator", x.d.indicator), ("ts", x.d.p2_ts), ("price", x.d.p2)
        ),
    )


def rsi_state(rsi: Sql) -> Sql:
    return F.when(rsi >= OVERBOUGHT, "overbought").when(rsi <= OVERSOLD, "oversold").otherwise("neutral")


def momentum_summary(found: Sql) -> Sql:
    """Momentum struct of a scan row; ``found`` is its list of divergences."""
    counts = [
        part
        for k in DIVERGENCE_KINDS
        for part in (F.lit(k), F.size(F.filter(found, lambda d, k=k: d.kind == k)))
    ]
    rsi = F.coalesce(F.col("rsi"), 50.0)
    return F.struct(
        ("rsi", rsi),
        ("rsi_state", rsi_state(rsi)),
        ("macd_cross", F.coalesce(F.col("macd_cross"), "none")),
        ("macd_histogram", F.coalesce(F.col("macd_hist"), 0.0)),
        (
            "divergences",
            F.struct(
                ("count", F.size(found)), ("by_kind", F.map(*counts)), ("recent", recent_divergences(found))
            ),
        ),
    )


def volatility_summary() -> Sql:
    """Volatility struct of a scan row. ATR% stays NULL while the ATR is warming up."""
    close, width, mean = F.col("last_close"), F.coalesce(F.col("bb_width"), 0.0), F.col("bb_mean_width")

    def pct(x: Sql) -> Sql:
        return F.when(close == 0, 0.0).otherwise(F.try_divide(x, close) * 100.0)

    enough = F.col("bb_widths") >= 2
    return F.struct(
        ("atr", F.coalesce(F.col("end_atr"), 0.0)),
        ("atr_pct", pct(F.col("end_atr"))),
        ("bb_squeeze", F.coalesce(F.col("bb_squeeze"), False)),
        ("bb_width_pct", pct(width)),
        (
            "state",
            F.when(enough & (width > mean * EXPANDING), "expanding")
            .when(enough & (width < mean * CONTRACTING), "contracting")
            .otherwise("stable"),
        ),
    )
