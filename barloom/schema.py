"""Schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

CANDLE_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

PRICE_COLUMNS = ("open", "high", "low", "close")

# The supported timeframes and their length in minutes.
TIMEFRAME_MINUTES = {
    "1m": 1,
    "2m": 2,
    "5m": 5,
    "15m": 15,
    "30m": 30,
    "1h": 60,
    "2h": 120,
    "4h": 240,
    "1d": 1440,
    "5d": 7200,
    "1w": 10080,
    "1mo": 43200,
    "3mo": 129600,
}

# Fixed value: the fewest bars that a lookback may ask for.
MIN_LOOKBACK = 10

# The pattern kinds, in their canonical order.
PATTERN_KINDS = (
    "head_shoulders",
    "inverse_head_shoulders",
    "double_top",
    "double_bottom",
    "ascending_triangle",
    "descending_triangle",
    "symmetric_triangle",
    "bull_flag",
    "bear_flag",
    "channel_up",
    "channel_down",
    "channel_flat",
    "rising_wedge",
    "falling_wedge",
    "cup_handle",
    "abcd_bullish",
    "abcd_bearish",
    "gartley_bullish",
    "gartley_bearish",
    "bat_bullish",
    "bat_bearish",
    "butterfly_bullish",
    "butterfly_bearish",
    "crab_bullish",
    "crab_bearish",
    "triple_top",
    "triple_bottom",
    "rounding_bottom",
    "gap_up",
    "gap_down",
)

# Which way each directional kind speaks.
BULLISH_KINDS = (
    "inverse_head_shoulders",
    "double_bottom",
    "ascending_triangle",
    "bull_flag",
    "channel_up",
    "falling_wedge",
    "cup_handle",
    "abcd_bullish",
    "gartley_bullish",
    "bat_bullish",
    "butterfly_bullish",
    "crab_bullish",
    "triple_bottom",
    "rounding_bottom",
    "gap_up",
)
BEARISH_KINDS = (
    "head_shoulders",
    "double_top",
    "descending_triangle",
    "bear_flag",
    "channel_down",
    "rising_wedge",
    "abcd_bearish",
    "gartley_bearish",
    "bat_bearish",
    "butterfly_bearish",
    "crab_bearish",
    "triple_top",
    "gap_down",
)
NEUTRAL_KINDS = ("symmetric_triangle", "channel_flat")

POINT_TYPE = "struct<idx:int,ts:bigint,price:double,role:string>"
HIT_TYPE = (
    "struct<detector_no:int,kind:string,confidence:double,"
    f"points:array<{POINT_TYPE}>,target_price:double,invalidation_price:double>"
)
