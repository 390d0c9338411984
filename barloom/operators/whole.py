"""Summaries and structure of whole series, without a symbol's bars in one row or one window group.

Three kinds of result, by what they need of a series:

* its end: all filters forget their start (see `scan`), so the last ``SETTLED`` bars give what the whole series gives;
* sums over all bars: plain aggregates with map-side combine, around one place per symbol so that no digits are lost;
* order: blocks or chunks of bars, whose results are put together from one row per chunk.

``chunk_seconds`` is a time span that holds a bounded number of bars (see `index_bars`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import Indicator, pivot_flag
from barloom.functions.layout import block_layout, index_bars
from barloom.functions.sql import F as S
from barloom.operators import levels, momentum
from barloom.operators.series import REVERSAL_FALLBACK, SWING_LOOKBACK, reversal_size, scan_rows
from barloom.operators.swings import candle_swings
from barloom.session import settled
from barloom.sources.resample import arrival_key, infer_timeframe

#: Bars after which every filter of a scan has forgotten its start (the slowest: an EMA of 26 into one of 9, both e^-40).
SETTLED = 2048
#: Bars of a chunk whose swings are folded by one call.
FOLD_BARS = 65_536
#: Parts of a symbol's prices of which only those with a sought quantile are ordered.
PARTS = 64


# ── the end of a series ─────────────────────────────────────────────────────


def settled_rows(candles: DataFrame, chunk_seconds: int) -> DataFrame:
    """Scan rows of the last ``SETTLED`` bars: for values at the end of a series, not for its swings or its beginning."""
    return scan_rows(candles, SETTLED, chunk_seconds)


def min_reversal(candles: DataFrame, chunk_seconds: int, multiplier: float = 1.0, fallback: float = REVERSAL_FALLBACK) -> DataFrame:
    """(symbol, last_atr, min_reversal): the last positive ATR times ``multiplier``, else ``fallback`` of the last close.

    An ATR that only bars before the last ``SETTLED`` ones would keep above zero counts as none.
    """
    size = reversal_size(S.col("last_atr"), S.col("last_close"), multiplier, fallback)
    return settled_rows(candles, chunk_seconds).select("symbol", "last_atr", size.column().alias("min_reversal"))


# ── sums over all bars ──────────────────────────────────────────────────────


def meta_summary(candles: DataFrame) -> DataFrame:
    """(symbol, candle_count, timeframe_seconds, first_ts, last_ts, last_close), times in seconds."""
    sums = candles.groupBy("symbol").agg(
        F.count("*").alias("candle_count"),
        F.unix_seconds(F.min("ts")).alias("first_ts"),
        F.unix_seconds(F.max("ts")).alias("last_ts"),
        F.max_by("close", arrival_key(candles)).alias("last_close"),
    )
    return sums.join(infer_timeframe(candles), "symbol")


def quad_fit(candles: DataFrame, column: str, chunk_seconds: int) -> DataFrame:
    """(symbol, a, r2, vertex) of the parabola through ``column`` over bar number; under 3 bars: a = 0, r2 = 0, no vertex.

    Power sums of x and y around their middle, x in half lengths of the series, so that fourth powers stay near 1.
    """
    indexed = index_bars(candles, chunk_seconds)
    middle = indexed.groupBy("symbol").agg(F.count("*").cast("double").alias("n"), F.avg(column).alias("mean"))
    x = (F.col("bar_idx") - (F.col("n") - 1) / 2) / (F.col("n") / 2)
    points = indexed.join(middle, "symbol").select("symbol", "n", x.alias("x"), (F.col(column) - F.col("mean")).alias("y"))
    square = F.col("x") * F.col("x")
    s = points.groupBy("symbol", "n").agg(
        F.sum(square).alias("s2"),
        F.sum(square * square).alias("s4"),
        F.sum("y").alias("y"),
        F.sum(F.col("x") * F.col("y")).alias("xy"),
        F.sum(square * F.col("y")).alias("xxy"),
        F.sum(F.col("y") * F.col("y")).alias("yy"),
    )
    # Odd powers cancel around the middle, so that the three equations fall apart into two and one.
    det = F.col("s4") * F.col("n") - F.col("s2") * F.col("s2")
    ok = (F.col("n") >= 3) & (det > 0)
    a = F.try_divide(F.col("xxy") * F.col("n") - F.col("s2") * F.col("y"), det)
    c = F.try_divide(F.col("s4") * F.col("y") - F.col("s2") * F.col("xxy"), det)
    s = s.withColumns({"a": a, "b": F.try_divide("xy", "s2"), "c": c, "ok": ok})
    total = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    left = F.col("yy") - F.col("a") * F.col("xxy") - F.col("b") * F.col("xy") - F.col("c") * F.col("y")
    half, mid = F.col("n") / 2, (F.col("n") - 1) / 2
    return s.select(
        "symbol",
        F.when(F.col("ok"), F.col("a") / (half * half)).otherwise(0.0).alias("a"),
        F.when(~F.col("ok"), 0.0).when(total <= 0, 1.0).otherwise(1 - left / total).alias("r2"),
        F.when(F.col("ok") & (F.col("a") != 0), mid - F.try_divide(F.col("b"), 2 * F.col("a")) * half).alias("vertex"),
    )


def volume_profile(candles: DataFrame) -> DataFrame:
    """(symbol, profile): struct of low, width and the volume in each of the equal-width price bins.

    A bar covers a run of bins; there are at most bins * (bins + 1) / 2 different runs, so volumes are summed by run
    (before the shuffle, too) and spread over the bins once per run.
    """
    ends = candles.groupBy("symbol").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    ends = ends.select("symbol", "_low", ((F.col("_high") - F.col("_low")) / float(levels.BINS)).alias("_width"))
    bars = candles.join(ends, "symbol")
    last = F.lit(levels.BINS - 1)

    def bin_of(price: str) -> Column:
        return F.floor(F.try_divide(F.col(price) - F.col("_low"), F.col("_width"))).cast("int")

    runs = bars.select("symbol", "_low", "_width", bin_of("low").alias("lo"), F.least(last, bin_of("high")).alias("hi"), F.coalesce("volume", F.lit(0.0)).alias("v"))
    # A bar at the very top lies above the last bin.
    each = F.col("v") / F.greatest(F.lit(1), F.col("hi") - F.col("lo") + 1)
    summed = runs.groupBy("symbol", "_low", "_width", "lo", "hi").agg(F.sum(each).alias("v"))

    def in_bin(k: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("lo") <= k) & (F.col("hi") >= k), F.col("v"))), F.lit(0.0))

    bins = F.array(*[in_bin(k) for k in range(levels.BINS)])
    found = summed.groupBy("symbol", "_low", "_width").agg(bins.alias("bins"))
    return found.select("symbol", F.struct(F.col("_low").alias("low"), F.col("_width").alias("width"), "bins").alias("profile"))


def value_area(candles: DataFrame) -> DataFrame:
    """(symbol, poc, vah, val)."""
    return volume_profile(candles).select("symbol", levels.value_area(S.col("profile")).column().alias("area")).select("symbol", "area.*")


# ── rounds of sums: levels ──────────────────────────────────────────────────


def level_clusters(prices: DataFrame, k: int = levels.CLUSTERS) -> DataFrame:
    """(symbol, clusters): `levels.level_clusters` of the rows (symbol, price), by sums over distinct prices.

    A round is one aggregate with map-side combine, its result a small table of one row per symbol; a symbol that has settled
    keeps its centres. Prices and rounds are written below ``spark.checkpoint.dir``.
    """
    points = settled(prices.where("price IS NOT NULL").groupBy("symbol", "price").agg(F.count("*").alias("n")), "levels")
    sizes = points.groupBy("symbol").agg(F.sum("n").alias("size"))
    one_by_one = F.array_sort(F.flatten(F.collect_list(F.array_repeat("price", F.col("n").cast("int")))))  # k prices at most
    few = points.join(sizes.where(F.col("size") <= k), "symbol").groupBy("symbol").agg(one_by_one.alias("centres")).withColumn("done", F.lit(True))
    many = _quantiles(points, sizes.where(F.col("size") > k), k).withColumn("done", F.lit(False))
    state = settled(few.unionAll(many), "levels")
    for _ in range(levels.CLUSTER_STEPS):
        if not state.where("NOT done").head(1):
            break
        state = settled(_moved(points.join(state, "symbol"), k), "levels")
    return state.select("symbol", F.array_sort("centres").alias("clusters"))


def _moved(near: DataFrame, k: int) -> DataFrame:
    """Centres moved to the means of the prices that are nearest to them; one without any stays, and all of a symbol that is done."""
    centres = [F.get("centres", F.lit(i)) for i in range(k)]
    away = F.array(*[F.abs(F.col("price") - c) for c in centres])
    at = near.select("symbol", "centres", "done", "price", "n", F.array_position(away, F.array_min(away)).alias("at"))
    mean = [F.try_divide(F.sum(F.when(F.col("at") == i + 1, F.col("price") * F.col("n"))), F.sum(F.when(F.col("at") == i + 1, F.col("n")))) for i in range(k)]
    new = at.groupBy("symbol", "centres", "done").agg(*[m.alias(f"_{i}") for i, m in enumerate(mean)])
    new = new.select("symbol", "centres", "done", F.array(*[F.coalesce(f"_{i}", c) for i, c in enumerate(centres)]).alias("new"))
    step = F.array_max(F.zip_with("new", "centres", lambda a, b: F.abs(a - b)))
    return new.select("symbol", F.when(F.col("done"), F.col("centres")).otherwise(F.col("new")).alias("centres"), (F.col("done") | (step <= levels.CLUSTER_SETTLED)).alias("done"))


def _quantiles(points: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(symbol, centres): the prices at the middles of k equal parts of a symbol's rows in order; ``points`` has (symbol, price, n).

    Approximate quantiles cut the prices into ``PARTS`` parts; rows are counted by part, and only parts that hold a middle are ordered.
    """
    borders = points.groupBy("symbol").agg(F.percentile_approx("price", [i / PARTS for i in range(1, PARTS)], 1000).alias("borders"))
    part = F.size(F.filter("borders", lambda b: b <= F.col("price"))).alias("part")
    placed = settled(points.join(borders, "symbol").select("symbol", "price", "n", part), "levels")
    earlier = F.sum("rows").over(Window.partitionBy("symbol").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("symbol", "part").agg(F.sum("n").alias("rows")).withColumn("ahead", F.coalesce(earlier, F.lit(0)))
    counts = counts.join(sizes, "symbol").select("*", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("i"))
    middle = F.floor((F.col("i") + 0.5) / float(k) * F.col("size")) - F.col("ahead")
    wanted = counts.withColumn("middle", middle).where("middle >= 0 AND middle < rows").select("symbol", "part", "i", "middle")
    order = Window.partitionBy("symbol", "part", "i").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.join(wanted, ["symbol", "part"]).withColumn("upto", F.sum("n").over(order))
    found = upto.where("middle < upto AND middle >= upto - n")
    return found.groupBy("symbol").agg(F.array(*[F.max(F.when(F.col("i") == i, F.col("price"))) for i in range(k)]).alias("centres"))


def find_levels(candles: DataFrame, chunk_seconds: int) -> DataFrame:
    """(symbol, last_close, clusters, support, resistance), as `levels.with_levels` over whole series.

    Bars without a symbol are one series, those without a time come first, as in a scan row.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col("symbol").cast("string")), F.lit(""))
    bars = candles.withColumns({"symbol": named, "ts": F.coalesce("ts", F.expr("timestamp'0001-01-01 00:00:00'"))})
    clusters = level_clusters(candle_swings(bars, chunk_seconds=chunk_seconds).select("symbol", "price"))
    ends = bars.groupBy("symbol").agg(F.max_by("close", arrival_key(bars)).alias("last_close"))
    name = F.when(F.col("symbol") != "", F.expr("substring(symbol, 2)")).cast(candles.schema["symbol"].dataType)
    rows = ends.join(clusters, "symbol", "left").select(name.alias("symbol"), "last_close", F.coalesce("clusters", F.expr("array()").cast("array<double>")).alias("clusters"))
    support, resistance = levels.nearest_levels(S.col("clusters"), S.col("last_close"))
    return rows.withColumns({"support": support.column(), "resistance": resistance.column()})


# ── order: zigzag ───────────────────────────────────────────────────────────


def fold_swings(kinds: list[str], prices: list[float], reversal: float, entry: tuple[str, float] | None) -> tuple[list[int], int]:
    """(positions that became final, position of the open pivot) of a run of swings; -1 is the pivot that came in.

    A more extreme swing of the open pivot's kind takes its place; one of the other kind that is ``reversal`` away ends it.
    """
    kept: list[int] = []
    at = -1
    kind, price = entry or (None, 0.0)
    for i, (k, p) in enumerate(zip(kinds, prices, strict=True)):
        if k == kind:
            if p > price if k == "high" else p < price:
                at, price = i, p
        elif kind is None or abs(p - price) >= reversal:
            if kind is not None:
                kept.append(at)
            at, kind, price = i, k, p
    return kept, at


_PIVOT = "idx long, kind string, ts long, price double"
_EXTREMES = ["high_top", "high_bottom", "low_top", "low_bottom"]
_CHUNK = f"symbol string, chunk long, {', '.join(f'{e} double' for e in _EXTREMES)}, {_PIVOT}"
_ENTRY = f"symbol string, chunk long, reversal double, last boolean, {_PIVOT}, guess_idx long, guess_kind string"
_FOLDED = f"symbol string, chunk long, part int, no long, {_PIVOT}, agrees boolean"
_FIELDS = ["idx", "kind", "ts", "price"]


def _alone(key: tuple, swings: pd.DataFrame) -> pd.DataFrame:
    """A chunk folded from nothing: its open pivot, and the extremes that tell whom it can't touch."""
    s = swings.sort_values(["idx", "ord"])
    _, at = fold_swings(s["kind"].tolist(), s["price"].tolist(), float(s["reversal"].iloc[0]), None)
    extremes = [f(s["price"][s["kind"] == k]) for k in ("high", "low") for f in (pd.Series.max, pd.Series.min)]
    return pd.DataFrame([[*key, *extremes, *s.iloc[at][_FIELDS]]], columns=["symbol", "chunk", *_EXTREMES, *_FIELDS])


def _entries(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
    """In order of a symbol's chunks: which pivot enters, and which is expected to leave.

    A chunk that can't touch the entering pivot hands it on; one whose pivot is known from a fold with the same entry
    hands on that; any other is expected to end like it does from nothing.
    """
    rows, state = [], None
    chunks = chunks.sort_values("chunk")
    reversal = float(chunks["reversal"].iloc[0])
    for c in chunks.to_dict("records"):
        entry = state
        if state is not None and _untouched(state, c, reversal):
            out = state
        elif c.get("known_idx") is not None and not pd.isna(c["known_idx"]) and state is not None and (c["from_idx"], c["from_kind"]) == (state["idx"], state["kind"]):
            out = {f: c[f"known_{f}"] for f in _FIELDS}
        else:
            out = {f: c[f] for f in _FIELDS}
        rows.append([*key, c["chunk"], reversal, False, *((entry or dict.fromkeys(_FIELDS))[f] for f in _FIELDS), out["idx"], out["kind"]])
        state = out
    rows[-1][3] = True
    return pd.DataFrame(rows, columns=["symbol", "chunk", "reversal", "last", *_FIELDS, "guess_idx", "guess_kind"])


def _untouched(state: dict, c: dict, reversal: float) -> bool:
    """No swing of the chunk is further on the pivot's side, or far enough on the other one (absent extremes are none)."""
    e = {f: np.nan if c[f] is None else c[f] for f in _EXTREMES}
    price = state["price"]
    further = e["high_top"] > price if state["kind"] == "high" else e["low_bottom"] < price
    other = "low" if state["kind"] == "high" else "high"
    return not (further or e[f"{other}_top"] - price >= reversal or price - e[f"{other}_bottom"] >= reversal)


def _replayed(key: tuple, swings: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """A chunk folded from its entry: part 0 are pivots that became final, part 1 is the one that leaves."""
    e = entries.iloc[0]
    s = swings.sort_values(["idx", "ord"])
    entered = None if pd.isna(e["price"]) else (e["kind"], float(e["price"]))
    kept, at = fold_swings(s["kind"].tolist(), s["price"].tolist(), float(e["reversal"]), entered)
    came, own = e[_FIELDS].tolist(), s[_FIELDS].values.tolist()

    def pivot(i: int) -> list:
        return came if i < 0 else own[i]

    out = pivot(at)
    agrees = bool(out[0] == e["guess_idx"] and out[1] == e["guess_kind"])
    final = [*kept, at] if e["last"] else kept
    rows = [[*key, 0, n, *pivot(i), True] for n, i in enumerate(final)] + [[*key, 1, len(final), *out, agrees]]
    return pd.DataFrame(rows, columns=["symbol", "chunk", "part", "no", *_FIELDS, "agrees"])


def zigzag(swings: DataFrame, reversal: DataFrame, fold_bars: int = FOLD_BARS) -> DataFrame:
    """Alternating pivots (symbol, no, idx, kind, ts, price) of candle swings; ``reversal`` has (symbol, min_reversal).

    A speculative fold in parallel. Every chunk of ``fold_bars`` bars is folded from nothing. As the open pivot is all
    that a fold remembers, and folds that once share it stay the same, a chunk mostly ends like that whatever comes in. So
    one row per chunk gives a guess of all entries, every chunk is folded from its entry, and if one ends otherwise
    than expected, its end is made known (by a checkpoint, so ``spark.checkpoint.dir`` must be set for such series) and the
    entries are found anew; each round settles at least one chunk more.
    Swings without a price don't count; a symbol without a positive reversal keeps every change of kind.
    """
    s = swings.join(reversal.select("symbol", F.col("min_reversal").alias("reversal")), "symbol").where("price IS NOT NULL AND reversal IS NOT NULL")
    ts = F.unix_seconds("ts").alias("ts") if dict(swings.dtypes)["ts"].startswith("timestamp") else F.col("ts")
    s = s.select("symbol", F.floor(F.col("bar_idx") / fold_bars).alias("chunk"), F.col("bar_idx").cast("long").alias("idx"), F.col("ord").cast("int").alias("ord"), "kind", ts, "price", "reversal")
    s = s.repartition("symbol", "chunk").persist()
    chunks = s.groupBy("symbol", "chunk").applyInPandas(_alone, _CHUNK).join(reversal.select("symbol", F.col("min_reversal").alias("reversal")), "symbol").persist()
    known = None
    while True:
        asked = chunks if known is None else chunks.join(known, ["symbol", "chunk"], "left")
        entries = asked.groupBy("symbol").applyInPandas(_entries, _ENTRY).persist()
        folded = s.groupBy("symbol", "chunk").cogroup(entries.groupBy("symbol", "chunk")).applyInPandas(_replayed, _FOLDED).persist()
        if not folded.where("part = 1 AND NOT agrees").head(1):
            break
        # What the rounds pass on is one row per chunk, cut from its lineage.
        ended = folded.where("part = 1").select("symbol", "chunk", *[F.col(f).alias(f"known_{f}") for f in _FIELDS])
        came = entries.select("symbol", "chunk", F.col("idx").alias("from_idx"), F.col("kind").alias("from_kind"))
        known = ended.join(came, ["symbol", "chunk"]).checkpoint()
        entries.unpersist()
        folded.unpersist()
    ahead = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = folded.where("part = 1").select("symbol", "chunk", F.coalesce(F.sum("no").over(ahead), F.lit(0)).alias("before"))
    final = folded.where("part = 0").join(start, ["symbol", "chunk"])
    return final.select("symbol", (F.col("before") + F.col("no")).alias("no"), *_FIELDS)


# ── order: pivots of price and indicators ───────────────────────────────────

_SERIES = {"close": "close", "rsi": "rsi_14", "macd": "macd"}


def series_pivots(candles: DataFrame, chunk_seconds: int) -> DataFrame:
    """(symbol, series, kind, bar_idx, ts, price): pivots of close, RSI and MACD line, in blocks of bars."""
    wanted = [Indicator("RSI", (14,)), Indicator("MACD", (12, 26, 9))]
    layout = block_layout(index_bars(candles, chunk_seconds), max(i.halo() for i in wanted) + SWING_LOOKBACK, SWING_LOOKBACK)
    for i in wanted:
        layout = i.apply(layout)
    layout = layout.with_columns({"bars_after": F.count("*").over(layout.frame(1, SWING_LOOKBACK))})
    flags = {(name, kind): pivot_flag(layout, column, SWING_LOOKBACK, kind) for name, column in _SERIES.items() for kind in ("low", "high")}
    layout = layout.with_columns({f"{n}_{k}_flag": c for (n, k), c in flags.items()})
    rows = [
        F.when(F.col(f"{n}_{k}_flag"), F.struct(F.lit(n).alias("series"), F.lit(k).alias("kind"), F.col(_SERIES[n]).alias("price"))) for n, k in flags
    ]
    found = layout.bars().select("symbol", "bar_idx", F.unix_seconds("ts").alias("ts"), F.explode(F.array_compact(F.array(*rows))).alias("p"))
    return found.select("symbol", "p.series", "p.kind", "bar_idx", "ts", "p.price")


def nearest_pivots(pivots: DataFrame, indicators: tuple[str, ...] = ("rsi", "macd"), reach: int = momentum.MATCH_BARS) -> DataFrame:
    """Every closing pivot with the nearest pivot of the same kind of each indicator, at most ``reach`` bars away.

    (symbol, indicator, kind, bar_idx, ts, price, match_idx, match_ts, match); the earlier one on ties, without match
    where there is none. The pivots are read once and shuffled once, by chunks of ``FOLD_BARS`` bars; an indicator pivot stands in
    the one or two chunks it reaches, and the nearest ones are values of short windows.
    """
    at, series = F.col("bar_idx"), F.col("series")

    def bucket(i: Column) -> Column:
        return F.floor(i / FOLD_BARS).cast("long")

    far = F.when(series == "close", 0).otherwise(reach)
    spread = F.explode(F.sequence(bucket(at - far), bucket(at + far))).alias("bucket")
    placed = pivots.where(series.isin("close", *indicators)).select("symbol", "series", "kind", "bar_idx", "ts", "price", spread)
    order = Window.partitionBy("symbol", "kind", "bucket").orderBy("bar_idx")

    def nearest(name: str) -> Column:
        pivot = F.when(series == name, F.struct(at.alias("match_idx"), F.col("ts").alias("match_ts"), F.col("price").alias("match")))
        before = F.last(pivot, ignorenulls=True).over(order.rangeBetween(-reach, 0))
        after = F.first(pivot, ignorenulls=True).over(order.rangeBetween(0, reach))
        earlier = after.isNull() | (at - before["match_idx"] <= after["match_idx"] - at)
        return F.when(before.isNull(), after).when(earlier, before).otherwise(after)

    found = placed.withColumn("_near", F.array(*[F.struct(F.lit(i).alias("indicator"), nearest(i).alias("near")) for i in indicators]))
    found = found.where(series == "close").select("symbol", "kind", "bar_idx", "ts", "price", F.explode("_near").alias("of"))
    return found.select("symbol", "of.indicator", "kind", "bar_idx", "ts", "price", "of.near.match_idx", "of.near.match_ts", "of.near.match")


def _with_previous(rows: DataFrame, keys: list[str], fields: list[str], fold_bars: int) -> DataFrame:
    """``prev``: the fields of the row before, by bar number; the first row of a chunk takes the last one of the chunk before."""
    this = F.struct(*fields)
    chunked = rows.withColumn("_chunk", F.floor(F.col("bar_idx") / fold_bars))
    inside = F.lag(this).over(Window.partitionBy(*keys, "_chunk").orderBy("bar_idx"))
    ends = chunked.groupBy(*keys, "_chunk").agg(F.max_by(this, "bar_idx").alias("_end"))
    ends = ends.select(*keys, "_chunk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_end"))
    return chunked.withColumn("_inside", inside).join(ends, [*keys, "_chunk"]).withColumn("prev", F.coalesce("_inside", "_end")).drop("_chunk", "_inside", "_end")


def divergences(pivots: DataFrame, indicators: tuple[str, ...] = ("rsi", "macd"), fold_bars: int = FOLD_BARS) -> DataFrame:
    """Consecutive closing pivots of one kind against their matched indicator pivots, as `momentum.divergences` over whole series.

    The matched pivots are used twice, by the rows and by the ends of chunks, and kept for that.
    """
    matched = nearest_pivots(pivots, indicators).persist()
    fields = ["ts", "price", "match_ts", "match"]
    rows = _with_previous(matched, ["symbol", "indicator", "kind"], fields, fold_bars).where("prev.match IS NOT NULL AND match IS NOT NULL")
    lower, higher = F.col("price") < F.col("prev.price"), F.col("price") > F.col("prev.price")
    i_lower, i_higher = F.col("match") < F.col("prev.match"), F.col("match") > F.col("prev.match")
    low = F.col("kind") == "low"
    kind = (
        F.when(low & lower & i_higher, "bullish")
        .when(low & higher & i_lower, "hidden_bullish")
        .when(~low & higher & i_lower, "bearish")
        .when(~low & lower & i_higher, "hidden_bearish")
    )
    found = rows.select(
        "symbol",
        "indicator",
        F.col("kind").alias("side"),
        "bar_idx",
        kind.alias("kind"),
        F.col("prev.ts").alias("p1_ts"),
        F.col("prev.price").alias("p1"),
        F.col("ts").alias("p2_ts"),
        F.col("price").alias("p2"),
        F.col("prev.match_ts").alias("i1_ts"),
        F.col("prev.match").alias("i1"),
        F.col("match_ts").alias("i2_ts"),
        F.col("match").alias("i2"),
    )
    return found.where("kind IS NOT NULL")


def recent_divergences(found: DataFrame, indicators: tuple[str, ...] = ("rsi", "macd")) -> DataFrame:
    """The three with the latest price point per symbol: (symbol, no, kind, indicator, ts, price)."""
    order = [F.desc("p2_ts"), F.array_position(F.array(*[F.lit(i) for i in indicators]), F.col("indicator")), F.desc("side"), "bar_idx"]
    newest = Window.partitionBy("symbol").orderBy(*order)
    top = found.withColumn("no", F.row_number().over(newest) - 1).where(F.col("no") < momentum.RECENT_DIVERGENCES)
    return top.select("symbol", "no", "kind", "indicator", F.col("p2_ts").alias("ts"), F.col("p2").alias("price"))


def momentum_summary(candles: DataFrame, chunk_seconds: int, found: DataFrame | None = None) -> DataFrame:
    """(symbol, rsi, rsi_state, macd_cross, macd_histogram, divergence_count, and one count per kind)."""
    found = divergences(series_pivots(candles, chunk_seconds)) if found is None else found
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in momentum.DIVERGENCE_KINDS]
    counts = found.groupBy("symbol").agg(F.count("*").alias("divergence_count"), *kinds)
    rsi = S.coalesce(S.col("rsi"), 50.0)
    end = settled_rows(candles, chunk_seconds).select(
        "symbol",
        rsi.column().alias("rsi"),
        momentum.rsi_state(rsi).column().alias("rsi_state"),
        F.coalesce("macd_cross", F.lit("none")).alias("macd_cross"),
        F.coalesce("macd_hist", F.lit(0.0)).alias("macd_histogram"),
    )
    return end.join(counts, "symbol", "left").fillna(0, ["divergence_count", *momentum.DIVERGENCE_KINDS])
