"""Reading, checking, cleaning and writing candle tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import CANDLE_SCHEMA, PRICE_COLUMNS, TIMEFRAME_MINUTES

FORMATS = ("parquet", "json", "csv", "orc")


def load_candles(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    source: str = "raw",
    timeframe: str = "1h",
) -> DataFrame:
    """Candle table at ``path`` with an explicit schema, tagged with source and timeframe."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown candle format {fmt!r}; use one of {FORMATS}")
    if timeframe not in TIMEFRAME_MINUTES:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    reader = spark.read.schema(CANDLE_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return tag_candles(reader.load(path), source, timeframe)


def tag_candles(candles: DataFrame, source: str, timeframe: str) -> DataFrame:
    return candles.withColumns({"source": F.lit(source), "timeframe": F.lit(timeframe)})


def write_candles(candles: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Persist candles ordered by symbol and time.

    Range partitioning samples the table, so a symbol that holds a large share of it is cut by time
    into many files, and small symbols share files; readers find a symbol by the files' value ranges.
    """
    candles.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").write.mode(mode).format(fmt).save(path)


def is_number(name: str):
    """Neither NULL nor NaN nor infinite (NaN is larger than infinity here)."""
    return F.col(name).isNotNull() & (F.abs(F.col(name)) < F.lit(float("inf")))


def is_valid_candle():
    """ts and all four prices must be real numbers; volume is not checked."""
    ok = F.col("ts").isNotNull()
    for name in PRICE_COLUMNS:
        ok = ok & is_number(name)
    return ok


def validate_candles(candles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, quarantined); the quarantine names the first field that is missing or no number."""
    missing = F.coalesce(
        F.when(F.col("ts").isNull(), F.lit("ts")), *[F.when(~is_number(c), F.lit(c)) for c in PRICE_COLUMNS]
    )
    valid = candles.where(is_valid_candle())
    bad = candles.where(~is_valid_candle()).withColumn("missing_field", missing)
    return valid, bad


def require_valid(candles: DataFrame) -> DataFrame:
    """Strict form: the job fails on the first row without ts or OHLC."""
    checked = F.when(is_valid_candle(), F.col("close")).otherwise(
        F.raise_error(F.concat(F.lit("invalid candle: missing OHLC field for "), F.coalesce("symbol", F.lit("?"))))
    )
    return candles.withColumn("close", checked)


def clean_quotes(quotes: DataFrame) -> DataFrame:
    """Vendor quotes to candles: drop rows in which a price is no number, volume defaults to 0, whole seconds."""
    usable = [is_number(c) for c in PRICE_COLUMNS]
    return quotes.where(usable[0] & usable[1] & usable[2] & usable[3]).select(
        "symbol",
        F.date_trunc("second", "date").alias("ts"),
        *PRICE_COLUMNS,
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
    )
