"""Swing tables over histories of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.indicators import pivot_flag
from barloom.functions.layout import Layout, block_layout, index_bars, series_layout

LOOKBACK = 3


def _layout(candles: DataFrame, lookback: int, chunk_seconds: int | None, block: int | None) -> Layout:
    """Bars with ``lookback`` neighbours on both sides and ``bars_after`` capped at the halo."""
    indexed = index_bars(candles, chunk_seconds)
    if chunk_seconds is None:
        layout = series_layout(indexed)
    else:
        layout = block_layout(indexed, lookback, lookback, block)
    following = F.count("*").over(layout.frame(1, lookback))
    return layout.with_columns({"bars_after": following})


def series_pivots(
    candles: DataFrame,
    column: str = "close",
    lookback: int = LOOKBACK,
    chunk_seconds: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """Strict local extremes of one column: (symbol, bar_idx, ts, kind, value)."""
    layout = _layout(candles, lookback, chunk_seconds, block)
    layout = layout.with_columns(
        {f"_{kind}": pivot_flag(layout, column, lookback, kind) for kind in ("high", "low")}
    )
    kind = F.when(F.col("_high"), F.lit("high")).when(F.col("_low"), F.lit("low"))
    rows = layout.with_columns({"kind": kind})
    return rows.bars().where("kind IS NOT NULL").select("symbol", "bar_idx", "ts", "kind", F.col(column).alias("value"))


def candle_swings(
    candles: DataFrame, lookback: int = LOOKBACK, chunk_seconds: int | None = None, block: int | None = None
) -> DataFrame:
    """Swing highs of ``high`` and lows of ``low``: (symbol, bar_idx, ord, ts, kind, price)."""
    layout = _layout(candles, lookback, chunk_seconds, block)
    layout = layout.with_columns(
        {
            "is_high": pivot_flag(layout, "high", lookback, "high"),
            "is_low": pivot_flag(layout, "low", lookback, "low"),
        }
    )

    def side(flag: str, no: int, kind: str):
        return F.when(
            F.col(flag), F.struct(F.lit(no).alias("ord"), F.lit(kind).alias("kind"), F.col(kind).alias("price"))
        )

    both = F.array_compact(F.array(side("is_high", 0, "high"), side("is_low", 1, "low")))
    return (
        layout.bars()
        .where("is_high OR is_low")
        .select("symbol", "bar_idx", "ts", F.explode(both).alias("s"))
        .select("symbol", "bar_idx", "s.ord", "ts", "s.kind", "s.price")
    )
