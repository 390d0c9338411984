"""Last value and state label of indicator series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import Indicator, with_indicators

# Fixed values.
SQUEEZE_PCT = 1.0
EXPANSION_PCT = 5.0
FLAT_DELTA = 1e-6

_SERIES = {
    "RSI": lambda p: [("value", f"rsi_{p[0]}")],
    "MACD": lambda _: [("macd", "macd"), ("signal", "macd_signal"), ("histogram", "macd_hist")],
    "BOLL": lambda _: [("upper", "boll_upper"), ("middle", "boll_middle"), ("lower", "boll_lower")],
    "EMA": lambda p: [("value", f"ema_{p[0]}")],
    "SMA": lambda p: [("value", f"sma_{p[0]}")],
    "ATR": lambda p: [("value", f"atr_{p[0]}")],
}


def indicator_values(candles: DataFrame, indicators: list[Indicator]) -> DataFrame:
    """Long table (symbol, indicator, series_no, series, bar_idx, value)."""
    wide = with_indicators(candles, indicators)
    rows = [
        F.struct(
            F.lit(i.type).alias("indicator"),
            F.lit(no).alias("series_no"),
            F.lit(name).alias("series"),
            F.col(column).alias("value"),
        )
        for i in indicators
        for no, (name, column) in enumerate(_SERIES[i.type](i.params))
    ]
    return wide.select("symbol", "bar_idx", F.inline(F.array(*rows)))


def last_two(candles: DataFrame, indicators: list[Indicator]) -> DataFrame:
    """What ``indicator_last`` gives for ``indicator_values``, from one aggregate over the wide table.

    Per column the last computed value and the one a bar before it; only these, one row per symbol, are unpivoted.
    """
    wide = with_indicators(candles, indicators)
    columns = [(i.type, no, name, column) for i in indicators for no, (name, column) in enumerate(_SERIES[i.type](i.params))]
    order = Window.partitionBy("symbol").orderBy("bar_idx")
    before = {f"_before_{c}": F.lag(c).over(order) for *_, c in columns}
    parts = []
    for *_, c in columns:
        at = F.when(F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")), F.col("bar_idx"))
        parts += [F.max_by(c, at).alias(f"_last_{c}"), F.max_by(f"_before_{c}", at).alias(f"_prev_{c}"), F.max(at).alias(f"_at_{c}")]
    ends = wide.withColumns(before).groupBy("symbol").agg(*parts)
    rows = [
        F.struct(
            F.lit(kind).alias("indicator"), F.lit(no).alias("series_no"), F.lit(name).alias("series"),
            F.col(f"_last_{c}").alias("last"), F.col(f"_prev_{c}").alias("prev"), F.col(f"_at_{c}").alias("_at"),
        )
        for kind, no, name, c in columns
    ]
    found = ends.select("symbol", F.inline(F.array(*rows))).where("_at IS NOT NULL").drop("_at")
    return found.withColumn("delta", F.col("last") - F.col("prev"))


def indicator_last(values: DataFrame) -> DataFrame:
    """Per series: last computed value, the value one bar before it, and their difference."""
    w = Window.partitionBy("symbol", "indicator", "series_no", "series").orderBy("bar_idx")
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    pairs = values.withColumn("before", F.lag("value").over(w)).where(finite)
    return (
        pairs.groupBy("symbol", "indicator", "series_no", "series")
        .agg(F.max_by("value", "bar_idx").alias("last"), F.max_by("before", "bar_idx").alias("prev"))
        .withColumn("delta", F.col("last") - F.col("prev"))
    )


def indicator_state(last: DataFrame) -> DataFrame:
    """One label per (symbol, indicator)."""

    def of(series: str, column: str):
        return F.max(F.when(F.col("series") == series, F.col(column)))

    parts = last.groupBy("symbol", "indicator").agg(
        F.min_by("last", "series_no").alias("first_last"),
        F.min_by("prev", "series_no").alias("first_prev"),
        of("histogram", "last").alias("h1"),
        of("histogram", "prev").alias("h0"),
        of("upper", "last").alias("upper"),
        of("middle", "last").alias("middle"),
        of("lower", "last").alias("lower"),
    )
    v, h0, h1 = F.col("first_last"), F.col("h0"), F.col("h1")
    rsi = F.when(v >= 70, "overbought").when(v <= 30, "oversold").otherwise("neutral")
    macd = (
        F.when(h0.isNull() | h1.isNull(), "unknown")
        .when((h0 < 0) & (h1 >= 0), "bull_cross")
        .when((h0 > 0) & (h1 <= 0), "bear_cross")
        .when(h1 > 0, "bullish")
        .otherwise("bearish")
    )
    middle = F.col("middle")
    width = F.when(middle > 0, (F.col("upper") - F.col("lower")) / middle * 100).otherwise(
        F.when(middle.isNotNull(), F.lit(0.0))
    )
    boll = F.when(width < SQUEEZE_PCT, "squeeze").when(width > EXPANSION_PCT, "expansion").otherwise("neutral")
    delta = v - F.col("first_prev")
    other = (
        F.when(delta.isNull(), "unknown")
        .when(F.abs(delta) < FLAT_DELTA, "flat")
        .when(delta > 0, "rising")
        .otherwise("falling")
    )
    label = (
        F.when(F.col("indicator") == "RSI", rsi)
        .when(F.col("indicator") == "MACD", macd)
        .when(F.col("indicator") == "BOLL", boll)
        .otherwise(other)
    )
    return parts.select("symbol", "indicator", label.alias("state"))
