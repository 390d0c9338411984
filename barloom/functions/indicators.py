"""Per-bar indicator columns. Warm-up rows are NULL."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.layout import Layout, block_layout, index_bars, series_layout
from barloom.functions.scan import Filter, affine_scan, memory
from barloom.schema import TIMEFRAME_MINUTES
from barloom.sources.resample import resample_candles, tail_lookback


def _ema_decay(period: int) -> float:
    return 1.0 - 2.0 / (period + 1)


def _wilder_decay(period: int) -> float:
    return (period - 1) / period


# ── building blocks ─────────────────────────────────────────────────────────
# Columns that start with "_" are intermediate results; `Layout.bars` drops them.


def true_range(prev: Column) -> Column:
    return F.when(
        prev.isNotNull(),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
    )


def add_true_range(layout: Layout, name: str = "true_range") -> Layout:
    return layout if name in layout.df.columns else layout.with_columns({name: true_range(F.lag("close").over(layout.ordered))})


def add_wilder(layout: Layout, outputs: dict[str, tuple[str, int]]) -> Layout:
    """Wilder averages ``name -> (column, period)``, seeded at bar ``period`` with a plain mean."""
    layout = layout.with_columns(wilder_seeds(layout, outputs))
    return affine_scan(layout, wilder_filters(outputs))


def wilder_seeds(layout: Layout, outputs: dict[str, tuple[str, int]]) -> dict[str, Column]:
    return {f"_{n}_seed": F.avg(c).over(layout.frame(-(p - 1), 0)) for n, (c, p) in outputs.items()}


def wilder_filters(outputs: dict[str, tuple[str, int]]) -> dict[str, Filter]:
    i = F.col("bar_idx")

    def feed(name: str, column: str, period: int) -> Column:
        return (
            F.when(i < period, F.lit(0.0))
            .when(i == period, F.col(f"_{name}_seed"))
            .otherwise(F.coalesce(F.col(column), F.lit(0.0)) / F.lit(float(period)))
        )

    return {n: Filter(_wilder_decay(p), feed(n, c, p), from_bar=p) for n, (c, p) in outputs.items()}


def add_atr(layout: Layout, period: int = 14, name: str | None = None) -> Layout:
    return add_wilder(add_true_range(layout, "_tr"), {name or f"atr_{period}": ("_tr", period)})


def _rolling(layout: Layout, fn, column: str, period: int) -> Column:
    return F.when(F.col("bar_idx") >= period - 1, fn(column).over(layout.frame(-(period - 1), 0)))


def add_sma(layout: Layout, period: int, column: str = "close", name: str | None = None) -> Layout:
    return layout.with_columns({name or f"sma_{period}": _rolling(layout, F.avg, column, period)})


def add_rolling_std(layout: Layout, period: int, column: str = "close", name: str | None = None) -> Layout:
    """Population standard deviation."""
    return layout.with_columns({name or f"std_{period}": _rolling(layout, F.stddev_pop, column, period)})


def add_bollinger(layout: Layout, period: int = 20, k: float = 2.0) -> Layout:
    return layout.with_columns(bollinger(layout, period, k))


def bollinger(layout: Layout, period: int, k: float) -> dict[str, Column]:
    mid = _rolling(layout, F.avg, "close", period)
    band = F.lit(k) * _rolling(layout, F.stddev_pop, "close", period)
    return {"boll_middle": mid, "boll_upper": mid + band, "boll_lower": mid - band}


def add_keltner(layout: Layout, period: int = 20, k: float = 1.5) -> Layout:
    """Simple-average middle line, ATR of the same period for the width."""
    layout = add_atr(layout, period, "_katr")
    mid, band = _rolling(layout, F.avg, "close", period), F.lit(k) * F.col("_katr")
    return layout.with_columns({"keltner_upper": mid + band, "keltner_lower": mid - band})


def add_squeeze(layout: Layout, period: int = 20) -> Layout:
    """Bollinger bands strictly inside the Keltner channel."""
    layout = add_keltner(add_bollinger(layout, period), period)
    return layout.with_columns({"bb_squeeze": squeezed(period, F.col("keltner_upper"), F.col("keltner_lower"))})


def squeezed(period: int, keltner_upper: Column, keltner_lower: Column) -> Column:
    inside = (F.col("boll_upper") < keltner_upper) & (F.col("boll_lower") > keltner_lower)
    return F.coalesce((F.col("bar_idx") >= period) & inside, F.lit(False))


def ema_filter(period: int, column: str) -> Filter:
    x = F.col(column)
    feed = F.when(F.col("pos") == 0, x).otherwise(x * F.lit(2.0 / (period + 1)))
    return Filter(_ema_decay(period), feed)


def add_ema(layout: Layout, period: int, column: str = "close", name: str | None = None) -> Layout:
    """Seeded with the first value, no warm-up gap."""
    return affine_scan(layout, {name or f"ema_{period}": ema_filter(period, column)})


def add_macd(layout: Layout, fast: int = 12, slow: int = 26, signal: int = 9) -> Layout:
    layout = affine_scan(layout, {"_fast": ema_filter(fast, "close"), "_slow": ema_filter(slow, "close")})
    layout = layout.with_columns({"macd": F.col("_fast") - F.col("_slow")})
    layout = add_ema(layout, signal, column="macd", name="macd_signal")
    return layout.with_columns({"macd_hist": F.col("macd") - F.col("macd_signal")})


def add_rsi(layout: Layout, period: int = 14, name: str | None = None) -> Layout:
    """Wilder RSI; 100 whenever the average loss is zero."""
    layout = layout.with_columns(moves(F.lag("close").over(layout.ordered)))
    layout = add_wilder(layout, {"_gains": ("_gain", period), "_losses": ("_loss", period)})
    return layout.with_columns({name or f"rsi_{period}": relative_strength("_gains", "_losses")})


def moves(prev: Column) -> dict[str, Column]:
    move = F.col("close") - prev
    return {"_gain": F.greatest(move, F.lit(0.0)), "_loss": F.greatest(-move, F.lit(0.0))}


def relative_strength(gains: str, losses: str) -> Column:
    g, l = F.col(gains), F.col(losses)  # noqa: E741
    return F.when(l == 0, F.lit(100.0)).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + g / l))


def add_realized_vol(layout: Layout, period: int = 20, name: str = "realized_vol") -> Layout:
    """Annualised percent volatility of the last ``period`` log returns (252 sessions)."""
    layout = layout.with_columns({"_return": log_return(F.lag("close").over(layout.ordered))})
    return layout.with_columns({name: realized_vol(layout, period)})


def log_return(prev: Column) -> Column:
    ratio = F.try_divide(F.col("close"), prev)
    return F.when(ratio > 0, F.ln(ratio))


def realized_vol(layout: Layout, period: int) -> Column:
    vol = F.stddev_samp("_return").over(layout.frame(-(period - 1), 0)) * F.lit(252.0**0.5) * F.lit(100.0)
    return F.when(F.col("bar_idx") >= period, vol)


def macd_cross_flag(was: Column) -> Column:
    """'bullish' / 'bearish' on the bar where macd - signal changes sign."""
    now = F.col("macd_hist")
    return F.when((was <= 0) & (now > 0), F.lit("bullish")).when((was >= 0) & (now < 0), F.lit("bearish"))


def pivot_flag(layout: Layout, column: str, lookback: int, kind: str) -> Column:
    """True on strict local extremes of ``column`` over +-lookback bars.

    Ties disqualify, NULL neighbours are ignored, NULL values are never pivots.
    Needs ``bars_after`` (how many bars follow in the series) for the end margin.
    """
    x = F.col(column)
    inner = (F.col("bar_idx") >= lookback) & (F.col("bars_after") >= lookback) & x.isNotNull()
    for w in (layout.frame(-lookback, -1), layout.frame(1, lookback)):
        beats = x > F.max(column).over(w) if kind == "high" else x < F.min(column).over(w)
        inner = inner & F.coalesce(beats, F.lit(True))
    return inner


# ── bundles ─────────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class Indicator:
    """One requested indicator: a type and its parameters."""

    type: str
    params: tuple[int, ...] = ()

    def halo(self) -> int:
        """Leading bars a block needs so that its own bars come out exact."""
        p = self.params
        if self.type == "EMA":
            return memory(_ema_decay(p[0]))
        if self.type in ("RSI", "ATR"):
            return memory(_wilder_decay(p[0])) + p[0]
        if self.type == "MACD":
            return memory(_ema_decay(p[1])) + memory(_ema_decay(p[2])) + 1
        if self.type == "SQUEEZE":
            return memory(_wilder_decay(p[0])) + p[0]
        if self.type == "KELTNER":
            return memory(_wilder_decay(p[0])) + p[0]
        if self.type in ("SMA", "STD", "BOLL"):
            return p[0]
        if self.type == "RVOL":
            return p[0] + 1
        if self.type in ("TR", "VOL"):
            return 1
        raise ValueError(f"unknown indicator {self.type!r}")

    def apply(self, layout: Layout) -> Layout:
        p = self.params
        return {
            "TR": lambda: add_true_range(layout),
            "ATR": lambda: add_atr(layout, *p),
            "SMA": lambda: add_sma(layout, *p),
            "STD": lambda: add_rolling_std(layout, *p),
            "BOLL": lambda: add_bollinger(layout, *p),
            "KELTNER": lambda: add_keltner(layout, *p),
            "SQUEEZE": lambda: add_squeeze(layout, *p),
            "EMA": lambda: add_ema(layout, *p),
            "MACD": lambda: add_macd(layout, *p),
            "RSI": lambda: add_rsi(layout, *p),
            "RVOL": lambda: add_realized_vol(layout, *p),
            "VOL": lambda: layout,
        }[self.type]()


def with_indicators(
    candles: DataFrame,
    indicators: Iterable[Indicator],
    chunk_seconds: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """Candles plus ``bar_idx`` and the requested indicator columns.

    ``chunk_seconds`` selects the block layout for tables with very long series
    (see `layout`); without it every symbol is one window group.
    """
    wanted: Sequence[Indicator] = list(indicators)
    indexed = index_bars(candles, chunk_seconds)
    if chunk_seconds is None:
        layout = series_layout(indexed)
    else:
        layout = block_layout(indexed, max([1, *[i.halo() for i in wanted]]), block=block)
    for indicator in wanted:
        layout = indicator.apply(layout)
    return layout.bars()


@dataclass(frozen=True)
class Preset:
    timeframe: str
    lookback: int
    indicators: tuple[Indicator, ...]


def _ema(*periods: int) -> tuple[Indicator, ...]:
    return tuple(Indicator("EMA", (p,)) for p in periods)


_MACD = Indicator("MACD", (12, 26, 9))
_RSI = Indicator("RSI", (14,))
_VOL = Indicator("VOL")

# Named indicator bundles with their default timeframe and lookback.
PRESETS = {
    "trend_analysis": Preset("1d", 500, (*_ema(20, 50, 200), _RSI, _VOL)),
    "scalping": Preset("5m", 300, (*_ema(9, 21), _MACD, _VOL)),
    "swing_trading": Preset("4h", 500, (*_ema(50, 200), _MACD, _RSI, Indicator("ATR", (14,)))),
    "institutional": Preset("1h", 500, (*_ema(20, 50), _RSI, _MACD, _VOL)),
    "momentum": Preset("15m", 300, (*_ema(9, 21), _RSI, Indicator("BOLL", (20,)), _VOL)),
    "clean": Preset("1h", 200, ()),
}


def apply_preset(candles: DataFrame, name: str, chunk_seconds: int | None = None) -> DataFrame:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; use one of {sorted(PRESETS)}")
    return with_indicators(candles, PRESETS[name].indicators, chunk_seconds)


def setup_preset(
    candles: DataFrame, name: str, timeframe: str | None = None, lookback: int | None = None, chunk_seconds: int | None = None
) -> DataFrame:
    """A preset as it is set up: bars in its timeframe, the last ``lookback`` of them, its indicators over these.

    Either value can be given instead of the preset's own. Bars that are coarser than the timeframe stay as they are.
    """
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; use one of {sorted(PRESETS)}")
    preset = PRESETS[name]
    bars = resample_candles(candles, TIMEFRAME_MINUTES[timeframe or preset.timeframe] * 60)
    return apply_preset(tail_lookback(bars, lookback or preset.lookback, chunk_seconds), name, chunk_seconds)


# ── suffix extrema ──────────────────────────────────────────────────────────


def suffix_extrema(candles: DataFrame, chunk_seconds: int) -> DataFrame:
    """Lowest low and highest high over all strictly later bars (NULL on the last bar).

    Extremes inside a time chunk are a bounded window; extremes of later chunks
    come from one row per (symbol, chunk).
    """
    order = ["ts", "seq"] if "seq" in candles.columns else ["ts"]
    chunk = F.floor(F.unix_seconds("ts") / F.lit(chunk_seconds))
    # Later rows are a running frame over the reversed order: linear per group.
    before = (Window.unboundedPreceding, -1)
    later = Window.partitionBy("symbol").orderBy(F.desc("_chunk")).rowsBetween(*before)
    per_chunk = (
        candles.groupBy("symbol", chunk.alias("_chunk"))
        .agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
        .select(
            "symbol", "_chunk", F.min("_lo").over(later).alias("_later_lo"), F.max("_hi").over(later).alias("_later_hi")
        )
    )
    inside = Window.partitionBy("symbol", "_chunk").orderBy(*[F.desc(c) for c in order]).rowsBetween(*before)
    return (
        candles.withColumn("_chunk", chunk)
        .withColumns({"_lo": F.min("low").over(inside), "_hi": F.max("high").over(inside)})
        .join(per_chunk, ["symbol", "_chunk"])
        .withColumns(
            {
                "suffix_min_low": F.least("_lo", "_later_lo"),
                "suffix_max_high": F.greatest("_hi", "_later_hi"),
            }
        )
        .drop("_chunk", "_lo", "_hi", "_later_lo", "_later_hi")
    )
