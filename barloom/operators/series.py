"""One row per symbol: the analysis window of a series and what all detectors share.

An analysis looks at the last ``lookback`` bars of each symbol, or at the whole series
where none is given. The series is one row of arrays, so every operator downstream of it
is a plain projection and the whole analysis costs one shuffle on ``symbol``; the row
grows with the bars that are looked at, so give a lookback for series of many millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.arrays import empty_like
from barloom.functions.layout import series_layout
from barloom.functions.scan import affine_scan
from barloom.functions.sql import F as S
from barloom.functions.sql import Sql
from barloom.sources.resample import with_age

# Fixed values.
SWING_LOOKBACK = 3
ATR_PERIOD = 14
BAND_PERIOD = 20
REVERSAL_FALLBACK = 0.005


def _collect(cond: Sql | None, **fields: Sql) -> Sql:
    """All (matching) rows of the group as structs, in bar order."""
    row = S.struct(*fields.items())
    return S.array_sort(S.collect_list(row if cond is None else S.when(cond, row)))


def scan_bars(candles: DataFrame, lookback: int | None = None, chunk_seconds: int | None = None) -> DataFrame:
    """Bars of the analysis windows with position, indicators and pivot flags.

    Window functions are computed in as few steps as their dependencies allow, since
    every step buffers the group once: raw lags and averages, then seeds, then the
    recursive filters, then pivots.
    """
    recent = with_age(candles, "_age", lookback, chunk_seconds)
    newer = Window.partitionBy("symbol").orderBy("_age").rowsBetween(Window.unboundedPreceding, -1)
    df = recent.withColumns(
        {
            "later_low": F.min("low").over(newer),
            "later_high": F.max("high").over(newer),
            "bar_idx": F.count("*").over(Window.partitionBy("symbol")) - F.col("_age"),
        }
    ).withColumns({"bars_after": F.col("_age") - 1, "sec": F.unix_seconds("ts")})
    layout = series_layout(df, max_rows=lookback)

    def before(column: str) -> Column:
        return F.lag(column).over(layout.ordered)

    layout = layout.with_columns(
        {
            **{f"prev_{c}": before(c) for c in ("sec", "close", "high", "low")},
            **ind.bollinger(layout, BAND_PERIOD, 2.0),
        }
    )
    layout = affine_scan(layout, {"_fast": ind.ema_filter(12, "close"), "_slow": ind.ema_filter(26, "close")})
    prev = F.col("prev_close")
    layout = layout.with_columns(
        {
            "_tr": ind.true_range(prev),
            "_return": ind.log_return(prev),
            **ind.moves(prev),
            "macd": F.col("_fast") - F.col("_slow"),
        }
    )
    averages = {
        "atr": ("_tr", ATR_PERIOD),
        "_katr": ("_tr", BAND_PERIOD),
        "_gains": ("_gain", 14),
        "_losses": ("_loss", 14),
    }
    layout = layout.with_columns(
        {**ind.wilder_seeds(layout, averages), "realized_vol": ind.realized_vol(layout, 20)}
    )
    layout = affine_scan(layout, {**ind.wilder_filters(averages), "_signal": ind.ema_filter(9, "macd")})
    band = F.lit(1.5) * F.col("_katr")
    layout = layout.with_columns(
        {
            "rsi": ind.relative_strength("_gains", "_losses"),
            "macd_hist": F.col("macd") - F.col("_signal"),
            "bb_squeeze": ind.squeezed(BAND_PERIOD, F.col("boll_middle") + band, F.col("boll_middle") - band),
        }
    )
    flags = {
        f"{name}_{kind}": ind.pivot_flag(layout, column, SWING_LOOKBACK, kind)
        for name, column, kinds in (
            ("swing", "high", ("high",)),
            ("swing", "low", ("low",)),
            ("close", "close", ("high", "low")),
            ("rsi", "rsi", ("high", "low")),
            ("macd", "macd", ("high", "low")),
        )
        for kind in kinds
    }
    return layout.with_columns(
        {**flags, "prev_atr": before("atr"), "macd_flag": ind.macd_cross_flag(before("macd_hist"))}
    ).bars()


def gap_size() -> tuple[Sql, Sql]:
    """Empty space above / below the previous bar."""
    return S.col("low") - S.col("prev_high"), S.col("prev_low") - S.col("high")


# Fixed value: smallest gap, in ATRs of the bar before it.
GAP_MIN_ATR = 0.5


def open_gap() -> Sql:
    """'gap_up' / 'gap_down' on bars whose gap is large enough and was never traded back."""
    up, down = gap_size()
    floor = S.when(S.col("prev_atr") > 0, S.col("prev_atr") * GAP_MIN_ATR)
    up_open = ~S.coalesce(S.col("later_low") <= S.col("prev_high"), False)
    down_open = ~S.coalesce(S.col("later_high") >= S.col("prev_low"), False)
    return S.when(up >= floor, S.when(up_open, "gap_up")).when((down >= floor) & down_open, "gap_down")


def scan_rows(candles: DataFrame, lookback: int | None = None, chunk_seconds: int | None = None) -> DataFrame:
    """One wide row per symbol; unused parts are pruned by the optimizer.

    ``bars`` and every pivot list are arrays in bar order.
    """
    b = scan_bars(candles, lookback, chunk_seconds).withColumn("gap_kind", open_gap().column())
    idx, sec = S.col("bar_idx").cast("int"), S.col("sec")
    is_last = S.col("bars_after") == 0
    near_end = S.col("bars_after") <= 20
    width = S.col("boll_upper") - S.col("boll_lower")

    def pivots(flag: str, column: str) -> Sql:
        return _collect(S.col(flag), idx=idx, ts=sec, price=S.col(column))

    def last(value: Sql) -> Sql:
        return S.max(S.when(is_last, value))

    def where_bar(cond: Sql) -> Sql:
        return S.when(cond, S.col("bar_idx"))

    gap_up = S.col("gap_kind") == "gap_up"
    up, down = gap_size()
    parts = {
        "n": S.count(1).cast("int"),
        "first_ts": S.min(sec),
        "last_ts": S.max(sec),
        "timeframe_seconds": S.min(S.when(S.col("bar_idx") == 1, sec - S.col("prev_sec"))),
        "last_close": last(S.col("close")),
        "prev_close": last(S.col("prev_close")),
        "last_atr": S.coalesce(S.max_by(S.col("atr"), where_bar(S.col("atr") > 0)), 0.0),
        "end_atr": last(S.col("atr")),
        "rsi": last(S.col("rsi")),
        "macd_hist": last(S.col("macd_hist")),
        "realized_vol": last(S.col("realized_vol")),
        "macd_cross": S.min_by(
            S.col("macd_flag"), where_bar(S.col("macd_flag").isNotNull() & (S.col("bars_after") < 3))
        ),
        "bb_width": last(width),
        "bb_mean_width": S.avg(S.when(near_end, width)),
        "bb_widths": S.count(S.when(near_end, width)),
        "bb_squeeze": S.bool_or(is_last & S.col("bb_squeeze")),
        "trend_slope": S.regr_slope(S.col("close"), S.col("bar_idx")),
        "trend_r2": S.regr_r2(S.col("close"), S.col("bar_idx")),
        "avg_close": S.avg(S.col("close")),
        "var_close": S.var_pop(S.col("close")),
        "bars": _collect(
            None,
            idx=idx,
            ts=sec,
            **{c: S.col(c) for c in ("open", "high", "low", "close", "volume", "later_low", "later_high")},
        ),
        "highs": pivots("swing_high", "high"),
        "lows": pivots("swing_low", "low"),
        **{
            f"{name}_{kind}s": pivots(f"{name}_{kind}", name)
            for name in ("close", "rsi", "macd")
            for kind in ("high", "low")
        },
        "gaps": _collect(
            S.col("gap_kind").isNotNull(),
            idx=idx,
            kind=S.col("gap_kind"),
            prev_idx=idx - 1,
            prev_ts=S.col("prev_sec"),
            ts=sec,
            zone_low=S.when(gap_up, S.col("prev_high")).otherwise(S.col("high")),
            zone_high=S.when(gap_up, S.col("low")).otherwise(S.col("prev_low")),
            gap=S.when(gap_up, up).otherwise(down),
            atr=S.col("prev_atr"),
        ),
    }
    rows = b.groupBy("symbol").agg(*[v.column().alias(k) for k, v in parts.items()])
    rows = rows.withColumns(
        {
            "swings": merge_swings(S.col("highs"), S.col("lows")).column(),
            "min_reversal": reversal_size(S.col("last_atr"), S.col("last_close")).column(),
        }
    )
    return rows.withColumn("zz", zigzag(S.col("swings"), S.col("min_reversal")).column())


def reversal_size(atr: Sql, close: Sql, multiplier: float = 1.0, fallback: float = REVERSAL_FALLBACK) -> Sql:
    """Smallest opposite move that counts: ATRs, else a part of the price; by default one ATR and half a percent."""
    return S.when(atr > 0, atr if multiplier == 1 else atr * multiplier).otherwise(close * fallback)


def merge_swings(highs: Sql, lows: Sql) -> Sql:
    """Both pivot lists in bar order, the high first where one bar is both."""

    def tagged(arr: Sql, ord_: int, kind: str) -> Sql:
        return S.transform(
            arr,
            lambda p: S.struct(
                p.idx.alias("idx"), ("ord", ord_), ("kind", kind), p.ts.alias("ts"), p.price.alias("price")
            ),
        )

    return S.array_sort(S.concat(tagged(highs, 0, "high"), tagged(lows, 1, "low")))


def zigzag(swings: Sql, min_reversal: Sql) -> Sql:
    """Alternating pivots, folded over the swings in order.

    A more extreme swing of the same kind replaces the last pivot; one of the other
    kind is appended when it is at least ``min_reversal`` away; all others drop out.
    """

    def step(acc: Sql, s: Sql) -> Sql:
        last = S.get(acc, S.size(acc) - 1)
        further = S.when(s.kind == "high", s.price > last.price).otherwise(s.price < last.price)
        return (
            S.when(S.size(acc) == 0, S.array(s))
            .when(
                s.kind == last.kind,
                S.when(further, S.concat(S.slice(acc, 1, S.size(acc) - 1), S.array(s))).otherwise(acc),
            )
            .when(S.abs(s.price - last.price) >= min_reversal, S.concat(acc, S.array(s)))
            .otherwise(acc)
        )

    return S.aggregate(swings, empty_like(swings), step)


def of_kind(swings: Sql, kind: str) -> Sql:
    return S.filter(swings, lambda s: s.kind == kind)


def bar_slice(bars: Sql, first: Sql, last: Sql) -> Sql:
    """Bars first..last (zero-based, inclusive)."""
    return S.slice(bars, first + 1, last - first + 1)


def as_xy(arr: Sql, y: str) -> Sql:
    return S.transform(arr, lambda p: S.struct(p.idx.cast("double").alias("x"), p[y].alias("y")))
