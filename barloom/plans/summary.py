"""The market summary: every feature of a symbol in one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as pf

from barloom.functions.arrays import tail
from barloom.functions.sql import F, Sql
from barloom.operators.levels import with_levels
from barloom.operators.momentum import divergences, momentum_summary, volatility_summary
from barloom.operators.patterns.detect import with_patterns
from barloom.operators.select import top_hits
from barloom.operators.series import scan_rows
from barloom.operators.trend import trend_summary, with_segments

# Fixed values.
COMPACT_SEGMENTS = 4
COMPACT_PATTERNS = 5


def meta_summary() -> Sql:
    return F.struct(
        ("candle_count", F.col("n")),
        ("timeframe_seconds", F.col("timeframe_seconds")),
        ("first_ts", F.col("first_ts")),
        ("last_ts", F.col("last_ts")),
        ("last_price", F.col("last_close")),
    )


def summarize(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scan rows to summary rows: symbol, meta, trend, plr, levels, momentum, volatility, patterns.

    ``keep`` names further columns of the scan rows to carry along.
    """
    rows = with_segments(with_levels(with_patterns(rows)))
    rows = rows.withColumn("_div", divergences("rsi", "macd").column())
    return rows.select(
        "symbol",
        meta_summary().column().alias("meta"),
        trend_summary().column().alias("trend"),
        "plr",
        pf.struct("support", "resistance", "poc", "vah", "val").alias("levels"),
        momentum_summary(F.col("_div")).column().alias("momentum"),
        volatility_summary().column().alias("volatility"),
        "patterns",
        *keep,
    )


def market_summary(candles: DataFrame, lookback: int | None = None, chunk_seconds: int | None = None) -> DataFrame:
    return summarize(scan_rows(candles, lookback, chunk_seconds))


def compact_summary(summary: DataFrame) -> DataFrame:
    """The short form: last four segments and the five most confident patterns, trimmed."""
    return summary.withColumns(
        {
            "plr": tail(F.col("plr"), COMPACT_SEGMENTS).column(),
            "patterns": top_hits(F.col("patterns"), COMPACT_PATTERNS).column(),
        }
    )
