"""Bucketing, lookback selection and bar spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import MIN_LOOKBACK


def utc_ts(df: DataFrame, name: str) -> Column:
    """``name`` as a UTC TIMESTAMP, whatever the session zone, for zoned and unzoned columns."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`))")
    return F.col(name)


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    s = F.unix_seconds(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)))


def arrival_key(candles: DataFrame) -> Column:
    """One orderable scalar for (ts, seq).

    A decimal(38) keeps the aggregation buffers fixed-width, so ``min_by`` stays
    on hash aggregation; ordering by a struct would force a sort on the map side.
    """
    if "seq" not in candles.columns:
        return F.col("ts")
    micros = F.unix_micros("ts").cast("decimal(38,0)")
    return (micros * F.lit(10**18).cast("decimal(19,0)") + F.col("seq").cast("decimal(18,0)")).cast("decimal(38,0)")


def resample_candles(candles: DataFrame, seconds: int) -> DataFrame:
    """Coarser candles: first open, max high, min low, last close, summed volume per bucket.

    One partial (map-side) aggregation followed by one shuffle of at most one row
    per symbol, bucket and map task, so a symbol holding most rows does not skew it.
    Empty buckets are not emitted.
    """
    key = arrival_key(candles)
    return (
        candles.select(
            "symbol",
            bucket_start(F.col("ts"), seconds).alias("bucket"),
            key.alias("k"),
            "open",
            "high",
            "low",
            "close",
            "volume",
        )
        .groupBy("symbol", "bucket")
        .agg(
            F.min_by("open", "k").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "k").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "ts")
    )


def order_columns(candles: DataFrame) -> list[str]:
    return ["ts", "seq"] if "seq" in candles.columns else ["ts"]


def tail_lookback(candles: DataFrame, lookback: int, chunk_seconds: int | None = None) -> DataFrame:
    """The last ``lookback`` bars of every symbol."""
    return with_age(candles, "_age", lookback, chunk_seconds).drop("_age")


def with_age(candles: DataFrame, age: str, lookback: int | None = None, chunk_seconds: int | None = None) -> DataFrame:
    """Adds ``age``, which counts bars from the newest, 1 upwards; with ``lookback`` only the last bars stay.

    With ``chunk_seconds`` the needed time range is found first from per-chunk row
    counts (a column-pruned, map-side combined aggregate) and all older rows are
    dropped by a semi join before the ranking shuffle; use it on stored tables
    where one symbol may hold a large share of the rows.
    """
    if lookback is not None and lookback < MIN_LOOKBACK:
        raise ValueError(f"lookback must be at least {MIN_LOOKBACK}")
    rows = candles
    if lookback is not None and chunk_seconds:
        chunk = F.floor(F.unix_seconds("ts") / F.lit(chunk_seconds)).alias("_chunk")
        newer = F.sum("_rows").over(
            Window.partitionBy("symbol").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        )
        needed = (
            candles.groupBy("symbol", chunk)
            .agg(F.count("*").alias("_rows"))
            .withColumn("_newer", F.coalesce(newer, F.lit(0)))
            .where(F.col("_newer") < lookback)
            .select("symbol", "_chunk")
        )
        rows = candles.withColumn("_chunk", chunk).join(needed, ["symbol", "_chunk"], "left_semi").drop("_chunk")
    newest_first = Window.partitionBy("symbol").orderBy(*[F.desc(c) for c in order_columns(candles)])
    aged = rows.withColumn(age, F.row_number().over(newest_first))
    return aged if lookback is None else aged.where(F.col(age) <= lookback)


def infer_timeframe(candles: DataFrame) -> DataFrame:
    """Seconds between the first and the second bar of each symbol; NULL when there is only one.

    Ranking stops at two bars per symbol in every task, before and after the shuffle.
    """
    oldest_first = Window.partitionBy("symbol").orderBy(*order_columns(candles))
    firsts = candles.withColumn("_rn", F.row_number().over(oldest_first)).where(F.col("_rn") <= 2)
    seconds = F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))
    return firsts.groupBy("symbol").agg(F.when(F.count("*") == 2, seconds).alias("timeframe_seconds"))
