"""Candle views over general tables, so that the operators have bars to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.resample import bucket_start, resample_candles, utc_ts

HOUR = 3600
DAY = 86400
MINUTE = 60
FRAME_MINUTES = (15, 30, 90, 120, 180, 240, 360, 480)


def _ticks(df: DataFrame, symbol: str, ts: str, price: str, seq: str) -> DataFrame:
    p = F.col(price)
    return df.select(
        F.col(symbol).cast("string").alias("symbol"),
        utc_ts(df, ts).alias("ts"),
        p.alias("open"),
        p.alias("high"),
        p.alias("low"),
        p.alias("close"),
        F.lit(1.0).alias("volume"),
        F.col(seq).alias("seq"),
    )


def tick_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a one-price candle of its event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _ticks(events, "event_type", "ts", "value", "event_id")


def candles_ev(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    """Bars of the raw event value, per event type."""
    return resample_candles(tick_candles(spark, sf_dir), seconds)


def candles_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per user: many short series."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return resample_candles(_ticks(events, "user_id", "ts", "value", "event_id"), DAY)


def candles_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the order total, per order priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return resample_candles(
        _ticks(orders, "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey"), DAY
    )


def candles_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per order and return flag from the prices of its lines: a few very long series."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_returnflag", F.timestamp_seconds(F.col("l_orderkey") * HOUR).alias("ts"), "l_extendedprice",
        (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("line"),
    )
    return resample_candles(_ticks(lines, "l_returnflag", "ts", "l_extendedprice", "line"), HOUR)


def candles_walk(spark: SparkSession, sf_dir: str, seconds: int = HOUR, symbol: str = "event_type") -> DataFrame:
    """Bars of a price path that each event moves by (value - 50) / 10, starting at 2000.

    A running sum over all events of one symbol would put a whole symbol into one
    task. Instead the path is built in two levels: running sums inside each
    (symbol, minute), then one running sum over the minutes' net moves, whose number
    is bounded by the calendar. Moves are counted in whole thousandths, so the sums
    are exact in any order.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    moves = events.select(
        F.col(symbol).cast("string").alias("symbol"),
        utc_ts(events, "ts").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.round(F.col("value") * 100).cast("bigint") - 5000).alias("move"),
    ).withColumn("minute", bucket_start(F.col("ts"), MINUTE))
    inside = Window.partitionBy("symbol", "minute").orderBy("ts", "seq")
    path = moves.withColumns(
        {
            "pos": F.row_number().over(inside),
            "run": F.sum("move").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    minutes = path.groupBy("symbol", "minute").agg(
        F.min_by("run", "pos").alias("first"),
        F.max("run").alias("top"),
        F.min("run").alias("bottom"),
        F.max_by("run", "pos").alias("last"),
        F.count("*").alias("moves"),
    )
    before = F.coalesce(
        F.sum("last").over(
            Window.partitionBy("symbol").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    level = minutes.withColumn("base", before + F.lit(2_000_000))

    def price(name: str):
        return ((F.col("base") + F.col(name)) / F.lit(1000.0)).cast("double")

    bars = level.select(
        "symbol",
        F.col("minute").alias("ts"),
        price("first").alias("open"),
        price("top").alias("high"),
        price("bottom").alias("low"),
        price("last").alias("close"),
        F.col("moves").cast("double").alias("volume"),
    )
    return bars if seconds == MINUTE else resample_candles(bars, seconds)


def candles_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-hour bars of one price path per user: many series of medium length."""
    return candles_walk(spark, sf_dir, 4 * HOUR, "user_id")


def candles_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event-type paths in several timeframes at once; symbol is 'type@minutes'."""
    minutes = candles_walk(spark, sf_dir, MINUTE)
    frames = F.explode(F.array(*[F.lit(m) for m in FRAME_MINUTES])).alias("m")
    spread = minutes.select("*", frames).withColumns(
        {
            "symbol": F.concat("symbol", F.lit("@"), F.col("m").cast("string")),
            "bucket": F.timestamp_seconds(F.unix_seconds("ts") - F.unix_seconds("ts") % (F.col("m") * 60)),
        }
    )
    return (
        spread.groupBy("symbol", "bucket")
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "ts")
    )
