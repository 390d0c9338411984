"""Live forms: resampling, price alerts, incremental swing scan."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.ranges import crossed
from barloom.sources.resample import arrival_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_resample(candles: DataFrame, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Coarser candles from a live feed; a bar is final once the watermark passes its end.

    Rows later than ``lateness`` are dropped. State is one aggregation buffer per open
    (symbol, bucket).
    """
    return (
        candles.withColumn("k", arrival_key(candles))
        .withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(
            F.min_by("open", "k").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "k").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


_WAITING = T.StructField("waiting", T.ArrayType(T.ArrayType(T.DoubleType())))
_CLOSE_STATE = T.StructType([T.StructField("close", T.DoubleType()), T.StructField("ts", T.LongType()), _WAITING])
_CLOSE_OUT = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("prev_close", T.DoubleType()),
    ]
)


def _in_time(batches: Iterator[pd.DataFrame], newest: int | None, waiting: list | None, names: list[str], mark: int | None) -> tuple[pd.DataFrame, list]:
    """(bars of one symbol in order, bars that wait as lists of microseconds and values).

    Without a watermark ``mark`` (milliseconds) nothing waits. Bars that are not newer than the state are late and dropped.
    """
    parts = [b[["ts", *names]].astype({"ts": "datetime64[us]"}) for b in batches if len(b)]
    if waiting:
        held = pd.DataFrame(waiting, columns=["ts", *names])
        parts.append(held.assign(ts=held["ts"].astype("int64").astype("datetime64[us]")))
    if not parts:
        return pd.DataFrame(columns=["ts", *names]), []
    bars = pd.concat(parts, ignore_index=True).sort_values("ts", kind="stable")
    if newest is not None:
        bars = bars[bars["ts"] > pd.Timestamp(newest, unit="s")]
    if mark is None:
        return bars, []
    due = bars["ts"] <= pd.Timestamp(mark, unit="ms")
    later = bars[~due]
    return bars[due], list(zip(later["ts"].astype("int64").astype(float), *(later[n].astype(float) for n in names), strict=True))


def _keep(state: GroupState, value: tuple, waiting: list, mark: int | None) -> None:
    """Updates the state and asks to be called again once the watermark has passed the first bar that waits."""
    state.update((*value, [list(bar) for bar in waiting]))
    if waiting:
        state.setTimeoutTimestamp(max(mark + 1, int(-(-waiting[0][0] // 1000))))


def _stateful(bars: DataFrame, step: Callable, out: T.StructType, kept: T.StructType, lateness: str | None) -> DataFrame:
    """``step`` by symbol; with a lateness, bars wait for the watermark and are handed on in order."""
    ordered = lateness is not None
    timeout = GroupStateTimeout.EventTimeTimeout if ordered else GroupStateTimeout.NoTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from step(key, batches, state, state.getCurrentWatermarkMs() if ordered else None)

    bars = bars.withWatermark("ts", lateness) if ordered else bars
    return bars.groupBy("symbol").applyInPandasWithState(run, out, kept, "append", timeout)


def _previous_close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, mark: int | None) -> Iterator[pd.DataFrame]:
    first, newest, waiting = state.get if state.exists else (None, None, None)
    bars, waiting = _in_time(batches, newest, waiting, ["close"], mark)
    closes = bars["close"]
    if len(bars):
        last = float(closes.iloc[-1]), int(bars["ts"].iloc[-1].timestamp())
    else:
        last = first, newest
    _keep(state, last, waiting, mark)
    if bars.empty:
        return
    yield pd.DataFrame(
        {
            "symbol": key[0],
            "ts": bars["ts"].to_numpy(),
            "close": closes.to_numpy(),
            "prev_close": closes.shift(1, fill_value=first).to_numpy(dtype=float),
        }
    )


#: Width of a price bucket of live alerts, as a share of the price.
BUCKET = 0.01


def stream_alerts(bars: DataFrame, rules: DataFrame, lateness: str | None = None) -> DataFrame:
    """Alert triggers of a live feed of finished bars.

    State is one close per symbol. Without ``lateness`` a bar that comes after a newer one's micro-batch is dropped; with it, bars wait in the state
    until the watermark passes them and are compared in order. A bar meets only the rules in the price buckets (one percent
    wide, above small prices) between its previous close and its close; the exact test follows.
    """
    moves = _stateful(bars.select("symbol", "ts", "close"), _previous_close, _CLOSE_OUT, _CLOSE_STATE, lateness)

    def bucket(price: Column) -> Column:
        return F.floor(F.signum(price) * F.log1p(F.abs(price)) / F.lit(BUCKET))

    prev = F.when(F.isnan("prev_close"), None).otherwise(F.col("prev_close"))
    moves = moves.withColumn("prev_close", prev).where("prev_close IS NOT NULL AND NOT isnan(close)")
    low, high = F.least("prev_close", "close"), F.greatest("prev_close", "close")
    moves = moves.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    r = rules.select("symbol", F.col("price").alias("alert_price"), "direction", "note").withColumn("_bucket", bucket(F.col("alert_price")))
    return (
        moves.join(r, ["symbol", "_bucket"])
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


# The state of one symbol: position, Wilder ATR, the last bars and the last zigzag pivot.
_SCAN_STATE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("prev_close", T.DoubleType()),
        T.StructField("tr_sum", T.DoubleType()),
        T.StructField("atr", T.DoubleType()),
        T.StructField("ts", T.ArrayType(T.LongType())),
        T.StructField("high", T.ArrayType(T.DoubleType())),
        T.StructField("low", T.ArrayType(T.DoubleType())),
        T.StructField("pivot_kind", T.StringType()),
        T.StructField("pivot_price", T.DoubleType()),
        _WAITING,
    ]
)
_SCAN_OUT = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("bar_idx", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("action", T.StringType()),
        T.StructField("atr", T.DoubleType()),
    ]
)
_SIDE = 3
_PERIOD = 14
_FALLBACK = 0.005


def _scan(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, mark: int | None) -> Iterator[pd.DataFrame]:
    if state.exists:
        n, prev_close, tr_sum, atr, ts, high, low, kind, price, waiting = state.get
        ts, high, low = list(ts), list(high), list(low)
    else:
        n, prev_close, tr_sum, atr, ts, high, low, kind, price, waiting = 0, None, 0.0, None, [], [], [], None, None, None
    out = []
    bars, waiting = _in_time(batches, ts[-1] if ts else None, waiting, ["high", "low", "close"], mark)
    for b in bars.itertuples(index=False):
        if prev_close is not None:
            tr = max(b.high - b.low, abs(b.high - prev_close), abs(b.low - prev_close))
            if n <= _PERIOD:
                tr_sum += tr
                atr = tr_sum / _PERIOD if n == _PERIOD else None
            else:
                atr = (atr * (_PERIOD - 1) + tr) / _PERIOD
        ts, high, low = [*ts, int(b.ts.timestamp())], [*high, float(b.high)], [*low, float(b.low)]
        ts, high, low = ts[-2 * _SIDE - 1 :], high[-2 * _SIDE - 1 :], low[-2 * _SIDE - 1 :]
        n, prev_close = n + 1, float(b.close)
        if len(ts) <= 2 * _SIDE:
            continue
        reversal = atr if atr else prev_close * _FALLBACK
        around_h, around_l = high[:_SIDE] + high[_SIDE + 1 :], low[:_SIDE] + low[_SIDE + 1 :]
        for k, p, is_pivot, further in (
            ("high", high[_SIDE], high[_SIDE] > max(around_h), price is not None and high[_SIDE] > price),
            ("low", low[_SIDE], low[_SIDE] < min(around_l), price is not None and low[_SIDE] < price),
        ):
            if not is_pivot:
                continue
            if kind is None or (kind != k and abs(p - price) >= reversal):
                action = "append"
            elif kind == k and further:
                action = "replace"
            else:
                continue
            kind, price = k, p
            out.append((key[0], n - 1 - _SIDE, ts[_SIDE], k, p, action, atr))
    _keep(state, (n, prev_close, tr_sum, atr, ts, high, low, kind, price), waiting, mark)
    yield pd.DataFrame(out, columns=[f.name for f in _SCAN_OUT.fields]).astype({"atr": float})


def incremental_scan(bars: DataFrame, lateness: str | None = None) -> DataFrame:
    """Zigzag pivots of a live feed of finished bars, three bars after they happen.

    ``action`` is 'append' for a new pivot and 'replace' when the latest pivot moved
    further out. Without ``lateness``, state per symbol is constant-size, and a bar that is not newer than the last one seen is late and
    dropped, so that it cannot change what is settled. With it, state also holds the bars that the watermark has not passed
    (as many as that time has): they are taken in order, so a shuffled feed gives what an ordered one gives.
    """
    return _stateful(bars.select("symbol", "ts", "high", "low", "close"), _scan, _SCAN_OUT, _SCAN_STATE, lateness)
