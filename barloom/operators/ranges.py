"""Aggregates over a bar range, previous closes and price alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.resample import order_columns

DAY = 86400


def with_previous_close(candles: DataFrame, chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Add ``prev_close`` without ordering a whole series in one task.

    Inside a (symbol, time chunk) it is a plain lag; the first bar of a chunk takes
    the last close of the chunk before, from a table with one row per chunk.
    """
    order = order_columns(candles)
    chunk = F.floor(F.unix_seconds("ts") / F.lit(chunk_seconds))
    latest = F.max_by("close", F.struct(*order)) if len(order) > 1 else F.max_by("close", "ts")
    carried = (
        candles.groupBy("symbol", chunk.alias("_chunk"))
        .agg(latest.alias("_end"))
        .select(
            "symbol",
            "_chunk",
            F.lag("_end").over(Window.partitionBy("symbol").orderBy("_chunk")).alias("_carried"),
        )
    )
    inside = Window.partitionBy("symbol", "_chunk").orderBy(*order)
    return (
        candles.withColumn("_chunk", chunk)
        .withColumn("_lag", F.lag("close").over(inside))
        .join(carried, ["symbol", "_chunk"])
        .withColumn("prev_close", F.coalesce("_lag", "_carried"))
        .drop("_chunk", "_lag", "_carried")
    )


def range_summary(candles: DataFrame, start=None, end=None, chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Per symbol: extent, volume and return of the bars in [start, end]."""
    bars = candles
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    pc = F.col("prev_close")
    tr = F.when(
        pc.isNotNull(),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)),
    )
    volume = F.coalesce("volume", F.lit(0.0))
    out = (
        with_previous_close(bars, chunk_seconds)
        .groupBy("symbol")
        .agg(
            F.count("*").alias("bars"),
            F.unix_seconds(F.min("ts")).alias("first_ts"),
            F.unix_seconds(F.max("ts")).alias("last_ts"),
            F.min("low").alias("min_low"),
            F.max("high").alias("max_high"),
            F.min_by("open", "ts").alias("open_first"),
            F.max_by("close", "ts").alias("close_last"),
            F.sum(volume).alias("volume_sum"),
            F.avg(volume).alias("volume_avg"),
            F.max(volume).alias("volume_max"),
            F.coalesce(F.sum(tr), F.lit(0.0)).alias("_tr"),
        )
    )
    move = F.when(
        F.col("open_first") > 0, (F.col("close_last") - F.col("open_first")) / F.col("open_first") * 100
    ).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "pct_change": move,
            "atr_approx": F.when(F.col("bars") > 1, F.col("_tr") / (F.col("bars") - 1)).otherwise(F.lit(0.0)),
        }
    ).drop("_tr")


ALERT_DIRECTIONS = ("above", "below", "cross")


def crossed(rule_price, direction, prev, close):
    """True on the bar whose close moves through the alert price in the watched direction."""
    above = (prev <= rule_price) & (close > rule_price)
    below = (prev >= rule_price) & (close < rule_price)
    way = F.coalesce(direction, F.lit("cross"))
    return F.when(way == "above", above).when(way == "below", below).otherwise(above | below)


def price_alerts(candles: DataFrame, rules: DataFrame, chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Bars that trigger alert rules (symbol, price, direction NULL = cross, note).

    A bar meets only the rules between its previous close and its close: prices are cut into buckets as wide as
    the symbol's mean move, a bar is copied into the buckets it crosses (two on average), and the join is on
    (symbol, bucket). The exact test follows.
    """
    bars = with_previous_close(candles.select("symbol", "ts", "close"), chunk_seconds)
    move = F.abs(F.col("close") - F.col("prev_close"))
    width = bars.where(move > 0).groupBy("symbol").agg(F.avg(move).alias("_width"))

    def bucket(price):
        return F.floor(price / F.col("_width"))

    low, high = F.least("prev_close", "close"), F.greatest("prev_close", "close")
    bars = bars.where(move > 0).join(width, "symbol").withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    r = rules.select("symbol", F.col("price").alias("alert_price"), "direction", "note").join(width, "symbol")
    r = r.withColumn("_bucket", bucket(F.col("alert_price"))).drop("_width")
    return (
        bars.join(r, ["symbol", "_bucket"])
        .where(crossed(F.col("alert_price"), F.col("direction"), F.col("prev_close"), F.col("close")))
        .select(
            "symbol",
            "ts",
            "alert_price",
            F.coalesce("direction", F.lit("cross")).alias("direction"),
            "note",
            "prev_close",
            "close",
        )
    )


def as_of_bar(bars: DataFrame, times: DataFrame, chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Last bar at or before each requested time, per symbol; bar_idx -1 where there is none.

    Bars and requests are put on one time line. Inside a (symbol, time chunk) the last
    bar seen is a running maximum; requests before the first bar of their chunk use
    the last bar of an earlier chunk. Nothing is paired bar by bar.
    """
    line = bars.select(
        "symbol", F.col("ts").alias("t"), F.lit(0).alias("is_request"), "bar_idx", F.lit(None).cast("bigint").alias("request_id")
    ).unionByName(
        times.select(
            "symbol", F.col("at").alias("t"), F.lit(1).alias("is_request"), F.lit(None).cast("bigint").alias("bar_idx"), "request_id"
        )
    )
    line = line.withColumn("_chunk", F.floor(F.unix_seconds("t") / F.lit(chunk_seconds)))
    earlier = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        line.groupBy("symbol", "_chunk")
        .agg(F.max("bar_idx").alias("_last"))
        .select("symbol", "_chunk", F.max("_last").over(earlier).alias("_carried"))
    )
    seen = (
        Window.partitionBy("symbol", "_chunk")
        .orderBy("t", "is_request")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        line.withColumn("_seen", F.max("bar_idx").over(seen))
        .where("is_request = 1")
        .join(carried, ["symbol", "_chunk"])
        .select(
            "symbol",
            "request_id",
            F.col("t").alias("at"),
            F.coalesce("_seen", "_carried", F.lit(-1)).alias("bar_idx"),
        )
    )
