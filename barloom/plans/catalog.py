"""Every operator as a query over the given tables, flattened to scalar columns.

Each entry takes (spark, sf_dir). Doubles are rounded to 6 places, times are unix
seconds, counts and positions are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as pf

from barloom.functions.arrays import let
from barloom.functions.fits import fit_parabola
from barloom.functions.indicators import Indicator, apply_preset, setup_preset, suffix_extrema, with_indicators
from barloom.functions.layout import index_bars
from barloom.functions.rows import each, each_struct
from barloom.functions.sql import F
from barloom.operators import geometry, levels, momentum, ranges, select, sizing, states, swings, whole
from barloom.operators.patterns import channels, detect, templates
from barloom.operators.patterns.breach import breach_guard as guard
from barloom.operators.series import as_xy, bar_slice, scan_rows
from barloom.operators.trend import trend_by_symbol, with_segments
from barloom.plans.summary import compact_summary, market_summary, summarize
from barloom.plans.thesis import compose_thesis, horizon, rank_setups, with_evidence, with_verdict
from barloom.sources.candles import clean_quotes, tag_candles, validate_candles
from barloom.sources.resample import infer_timeframe, resample_candles, tail_lookback, utc_ts
from barloom.sources.views import (
    candles_ev,
    candles_frames,
    candles_lines,
    candles_ord,
    candles_paths,
    candles_user,
    candles_walk,
    tick_candles,
)

Query = Callable[[SparkSession, str], DataFrame]
DAY = 86400
MINUTE = 60
#: Bars are placed by counts over spans of so many seconds.
SPAN = 90 * DAY
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _secs(name: str = "ts"):
    return pf.unix_seconds(name).alias("ts")


def _flat(df: DataFrame) -> DataFrame:
    """Round doubles, widen integers."""
    out = []
    for f in df.schema.fields:
        c, t = pf.col(f"`{f.name}`"), f.dataType.typeName()
        if t == "double":
            c = pf.round(c, 6)
        elif t in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif t == "timestamp":
            c = pf.unix_seconds(c)
        out.append(c.alias(f.name))
    return df.select(*out)


_OHLCV = ("open", "high", "low", "close", "volume")


# ── sources ─────────────────────────────────────────────────────────────────


@query
def load_candles(spark, d):
    return _flat(tag_candles(candles_ev(spark, d), "events", "1h"))


def _quotes(spark, d):
    """Vendor-shaped rows with holes: prices above 150 miss their high, below 1 their open."""
    e = spark.read.parquet(f"{d}/events.parquet")
    v = pf.col("value")
    return e.select(
        pf.col("event_type").alias("symbol"),
        utc_ts(e, "ts").alias("date"),
        pf.when(v >= 1, v).alias("open"),
        pf.when(v <= 150, v).alias("high"),
        v.alias("low"),
        v.alias("close"),
        pf.when(v <= 100, v).alias("volume"),
    )


@query
def validate_candles_split(spark, d):
    valid, bad = validate_candles(_quotes(spark, d).withColumnRenamed("date", "ts"))
    both = valid.withColumn("missing_field", pf.lit("none")).unionByName(bad)
    return _flat(both.groupBy("symbol", "missing_field").agg(pf.count("*").alias("rows"), pf.sum("low").alias("low_sum")))


@query
def clean_quotes_rows(spark, d):
    return _flat(clean_quotes(_quotes(spark, d)))


@query
def resample_candles_4h(spark, d):
    return _flat(resample_candles(candles_ev(spark, d), 4 * 3600))


@query
def resample_orders_daily(spark, d):
    return _flat(candles_ord(spark, d))


@query
def tail_lookback_500(spark, d):
    return _flat(tail_lookback(candles_ev(spark, d), 500, chunk_seconds=7 * DAY))


@query
def infer_timeframe_users(spark, d):
    return _flat(infer_timeframe(candles_user(spark, d)))


# ── per-bar indicators ──────────────────────────────────────────────────────


def _indicator(columns, *wanted, view=candles_walk, **kw):
    def run(spark, d):
        return _flat(with_indicators(view(spark, d), wanted, **kw).select("symbol", "bar_idx", *columns))

    return run


def _on_ticks(columns, *wanted):
    """Over every event as its own bar: few, very long series, hence the block layout."""
    return _indicator(columns, *wanted, view=tick_candles, chunk_seconds=MINUTE)


QUERIES |= {
    "true_range": _indicator(["true_range"], Indicator("TR")),
    "atr": _indicator(["atr_14"], Indicator("ATR", (14,))),
    "atr_ticks": _on_ticks(["atr_14"], Indicator("ATR", (14,))),
    "sma": _indicator(["sma_20"], Indicator("SMA", (20,))),
    "rolling_std": _indicator(["std_20"], Indicator("STD", (20,))),
    "bollinger": _indicator(["boll_upper", "boll_middle", "boll_lower"], Indicator("BOLL", (20,))),
    "keltner": _indicator(["keltner_upper", "keltner_lower"], Indicator("KELTNER", (20,))),
    "bb_squeeze": _indicator(["bb_squeeze"], Indicator("SQUEEZE", (20,))),
    "ema": _indicator(["ema_20"], Indicator("EMA", (20,))),
    "ema_ticks": _on_ticks(["ema_20"], Indicator("EMA", (20,))),
    "macd": _indicator(["macd", "macd_signal", "macd_hist"], Indicator("MACD", (12, 26, 9))),
    "rsi": _indicator(["rsi_14"], Indicator("RSI", (14,))),
    "rsi_ticks": _on_ticks(["rsi_14"], Indicator("RSI", (14,))),
    "realized_vol": _indicator(["realized_vol"], Indicator("RVOL", (20,))),
}


@query
def macd_cross(spark, d):
    rows = whole.settled_rows(candles_walk(spark, d), SPAN)
    return rows.select("symbol", pf.coalesce("macd_cross", pf.lit("none")).alias("macd_cross"))


@query
def vol_stats(spark, d):
    return _flat(sizing.vol_stats(whole.settled_rows(candles_walk(spark, d), SPAN)))


def _preset(name, columns):
    def run(spark, d):
        return _flat(apply_preset(candles_walk(spark, d), name).select("symbol", "bar_idx", *columns, "volume"))

    return run


QUERIES |= {
    "preset_trend_analysis": _preset("trend_analysis", ["ema_20", "ema_50", "ema_200", "rsi_14"]),
    "preset_scalping": _preset("scalping", ["ema_9", "ema_21", "macd_hist"]),
    "preset_swing_trading": _preset("swing_trading", ["ema_50", "ema_200", "macd_hist", "rsi_14", "atr_14"]),
    "preset_institutional": _preset("institutional", ["ema_20", "ema_50", "rsi_14", "macd_hist"]),
    "preset_momentum": _preset("momentum", ["ema_9", "ema_21", "rsi_14", "boll_upper", "boll_lower"]),
    "preset_clean": _preset("clean", ["close"]),
}


def _setup(name, columns):
    def run(spark, d):
        return _flat(setup_preset(candles_walk(spark, d), name).select("symbol", "ts", "bar_idx", *columns, "volume"))

    return run


QUERIES |= {
    "setup_swing_trading": _setup("swing_trading", ["ema_50", "ema_200", "macd_hist", "rsi_14", "atr_14"]),
    "setup_institutional": _setup("institutional", ["ema_20", "ema_50", "rsi_14", "macd_hist"]),
    "setup_clean": _setup("clean", ["close"]),
}


@query
def suffix_extrema_bars(spark, d):
    bars = suffix_extrema(candles_walk(spark, d), chunk_seconds=DAY)
    return _flat(bars.select("symbol", "ts", "suffix_min_low", "suffix_max_high"))


@query
def min_reversal(spark, d):
    return _flat(whole.min_reversal(candles_walk(spark, d), SPAN))


@query
def min_reversal_scaled(spark, d):
    """Short series, many without an ATR: two and a half ATRs, else one percent."""
    return _flat(whole.min_reversal(candles_user(spark, d), SPAN, multiplier=2.5, fallback=0.01))


# ── summaries ───────────────────────────────────────────────────────────────


@query
def trend_summary(spark, d, view=candles_walk):
    return _flat(trend_by_symbol(index_bars(view(spark, d))))


@query
def line_fit(spark, d):
    """Regression of order value on order number per customer: arbitrary x and y."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    x, y = pf.col("o_orderkey"), pf.col("o_totalprice")
    fits = o.groupBy("o_custkey").agg(
        pf.count("*").alias("n"),
        pf.coalesce(pf.regr_slope(y, x), pf.lit(0.0)).alias("slope"),
        pf.coalesce(pf.regr_intercept(y, x), pf.avg(y)).alias("intercept"),
        pf.coalesce(pf.regr_r2(y, x), pf.lit(0.0)).alias("r2"),
    )
    return _flat(fits)


@query
def quad_fit(spark, d, view=candles_walk):
    """Parabola through the lows."""
    return _flat(whole.quad_fit(view(spark, d), "low", SPAN))


@query
def volatility_summary(spark, d):
    rows = whole.settled_rows(candles_walk(spark, d), SPAN)
    return _flat(rows.select("symbol", momentum.volatility_summary().column().alias("v")).select("symbol", "v.*"))


@query
def momentum_summary(spark, d, view=candles_walk):
    return _flat(whole.momentum_summary(view(spark, d), SPAN))


@query
def momentum_recent(spark, d):
    return _flat(whole.recent_divergences(whole.divergences(whole.series_pivots(candles_walk(spark, d), SPAN))))


@query
def range_summary(spark, d):
    return _flat(ranges.range_summary(candles_ev(spark, d), "2024-01-08", "2024-01-21 23:59:59", 7 * DAY))


_STATES = [
    Indicator("RSI", (14,)),
    Indicator("MACD", (12, 26, 9)),
    Indicator("BOLL", (20,)),
    Indicator("ATR", (14,)),
]


@query
def indicator_last(spark, d):
    return _flat(states.last_two(candles_walk(spark, d), _STATES))


@query
def indicator_state(spark, d):
    return states.indicator_state(states.last_two(candles_walk(spark, d), _STATES))


@query
def volume_profile(spark, d, view=candles_walk):
    return _flat(each(whole.volume_profile(view(spark, d)), "profile.bins", "symbol", no="bin", value="volume"))


@query
def poc_value_area(spark, d, view=candles_walk):
    return _flat(whole.value_area(view(spark, d)))


@query
def meta_summary(spark, d, view=candles_user):
    return _flat(whole.meta_summary(view(spark, d)))


# ── structure ───────────────────────────────────────────────────────────────


@query
def series_pivots(spark, d):
    return _flat(swings.series_pivots(candles_walk(spark, d)))


@query
def series_pivots_ticks(spark, d):
    return _flat(swings.series_pivots(tick_candles(spark, d), chunk_seconds=MINUTE).drop("ts"))


@query
def candle_swings(spark, d):
    return _flat(swings.candle_swings(candles_walk(spark, d)))


@query
def zigzag(spark, d, view=candles_walk):
    bars = view(spark, d)
    return _flat(whole.zigzag(swings.candle_swings(bars, chunk_seconds=SPAN), whole.min_reversal(bars, SPAN)))


@query
def two_line_fit(spark, d):
    fit = channels.two_lines(F.col("zz"), 0.3 * F.col("last_atr")).to(
        lambda x: F.struct(
            ("hi_slope", x.up.slope),
            ("hi_r2", x.up.r2),
            ("lo_slope", x.dn.slope),
            ("lo_r2", x.dn.r2),
            ("hi_touches", F.size(x.hits_up)),
            ("lo_touches", F.size(x.hits_dn)),
            ("start_idx", x.first),
            ("end_idx", x.last),
            ("last_touch_idx", x.touch),
        )
    )
    return _flat(each_struct(scan_rows(candles_walk(spark, d)), fit, "symbol"))


@query
def plr_segments(spark, d):
    rows = with_segments(scan_rows(candles_walk(spark, d)))
    return _flat(each(rows, "plr", "symbol", no="seg_no").select("symbol", "seg_no", "x.*"))


@query
def level_clusters(spark, d):
    rows = levels.with_levels(scan_rows(candles_walk(spark, d)))
    return _flat(each(rows, "clusters", "symbol", value="price"))


@query
def find_levels(spark, d):
    """Of short series, as projections of the scan row."""
    return _flat(_sides(levels.with_levels(scan_rows(candles_walk(spark, d)))))


@query
def find_levels_lines(spark, d):
    """Of long series, by rounds of sums."""
    return _flat(_sides(whole.find_levels(candles_lines(spark, d), SPAN)))


def _sides(rows: DataFrame) -> DataFrame:
    sides = [
        F.transform(F.col(side), lambda p, i, side=side: F.struct(("side", side), ("no", i), ("price", p)))
        for side in ("support", "resistance")
    ]
    return each_struct(rows, F.concat(*sides), "symbol")


@query
def level_detail(spark, d):
    rows = levels.with_level_detail(levels.with_levels(scan_rows(candles_walk(spark, d))))
    return _flat(each_struct(rows, "level_detail", "symbol"))


@query
def nearest_pivot(spark, d):
    """The RSI low matched to each closing low."""
    near = whole.nearest_pivots(whole.series_pivots(candles_walk(spark, d), SPAN), ("rsi",)).where("kind = 'low' AND match IS NOT NULL")
    return _flat(near.select("symbol", pf.col("bar_idx").alias("idx"), "match_idx", pf.col("match").alias("value")))


@query
def nearest_pivot_sides(spark, d):
    """RSI and MACD pivots matched to closing lows and highs."""
    near = whole.nearest_pivots(whole.series_pivots(candles_walk(spark, d), SPAN)).where("match IS NOT NULL")
    return _flat(near.select("symbol", "indicator", "kind", pf.col("bar_idx").alias("idx"), "match_idx", pf.col("match").alias("value")))


@query
def divergences(spark, d):
    """Of short series, as projections of the scan row."""
    return _flat(each_struct(scan_rows(candles_walk(spark, d)), momentum.divergences("rsi", "macd"), "symbol"))


@query
def divergences_lines(spark, d):
    """Of long series, by joins."""
    return _flat(whole.divergences(whole.series_pivots(candles_lines(spark, d), SPAN)).drop("side", "bar_idx"))


@query
def as_of_bar(spark, d):
    """The daily-order bar in force at each event; an event asks for one priority of the table."""
    bars = index_bars(candles_ord(spark, d))
    orders = spark.read.parquet(f"{d}/orders.parquet")
    symbols = orders.agg(pf.sort_array(pf.collect_set("o_orderpriority")).alias("symbols")).scalar()
    events = spark.read.parquet(f"{d}/events.parquet")
    shifted = utc_ts(events, "ts") - pf.expr("INTERVAL 10000 DAYS") + pf.make_dt_interval(days=pf.col("user_id") * 10)
    asked = events.select(symbols.alias("symbols"), shifted.alias("at"), pf.col("event_id").alias("request_id"))
    pick = pf.get("symbols", (pf.col("request_id") % pf.size("symbols")).cast("int"))
    keyed = asked.select(pick.alias("symbol"), "at", "request_id")
    return _flat(ranges.as_of_bar(bars, keyed, 7 * DAY).select("symbol", "request_id", "bar_idx"))


# ── patterns ────────────────────────────────────────────────────────────────


def _points_flat(rows: DataFrame, column: str) -> DataFrame:
    hits = detect.hit_rows(rows, column)
    keep = ("symbol", "hit_no", "kind", "confidence", "target_price", "invalidation_price")
    points = each(hits, "points", *keep, no="point_no")
    return _flat(points.select(*keep, "point_no", "x.ts", "x.price", "x.role"))


def _detector(*names, kinds=None, view=candles_walk):
    """One row per anchor of every hit, before the breach guard."""

    def run(spark, d):
        rows = detect.with_detector(scan_rows(view(spark, d)), *names)
        if kinds:
            rows = rows.withColumn("hits", F.filter(F.col("hits"), lambda h: h.kind.isin(*kinds)).column())
        return _points_flat(rows, "hits")

    return run


QUERIES |= {
    "head_shoulders": _detector("head_shoulders", kinds=("head_shoulders",)),
    "inverse_head_shoulders": _detector("head_shoulders", kinds=("inverse_head_shoulders",)),
    "double_top_bottom": _detector("double_triple", kinds=("double_top", "double_bottom")),
    "triple_top_bottom": _detector("double_triple", kinds=("triple_top", "triple_bottom")),
    "double_triple_paths": _detector("double_triple", view=candles_paths),
    "double_triple_users": _detector("double_triple", view=candles_user),
    "triangles": _detector("triangles"),
    "triangles_frames": _detector("triangles", view=candles_frames),
    "triangles_users": _detector("triangles", view=candles_user),
    "flags": _detector("flags", view=candles_frames),
    "flags_users": _detector("flags", view=candles_user),
    "channels": _detector("channels"),
    "channels_paths": _detector("channels", view=candles_paths),
    "wedges": _detector("wedges", view=candles_user),
    "wedges_frames": _detector("wedges", view=candles_frames),
    "cup_handle": _detector("cup_handle", view=candles_paths),
    "rounding_bottom": _detector("rounding_bottom", view=candles_paths),
    "template_match": _detector("templates", view=candles_paths),
    "harmonics_users": _detector("templates", view=candles_user),
    "gaps": _detector("gaps"),
    "gaps_users": _detector("gaps", view=candles_user),
    "templates_frames": _detector("templates", view=candles_frames),
}


@query
def template_rows(spark, d):
    """The shipped templates read from a table, over the path bars."""
    rows = templates.read_templates(templates.template_table(spark))
    return _points_flat(detect.with_detector(scan_rows(candles_paths(spark, d)), "templates", templates=rows), "hits")


def _patterns(spark, d, view=candles_walk):
    return detect.with_patterns(scan_rows(view(spark, d)))


@query
def breach_guard(spark, d):
    """Head & shoulders that are still alive."""
    rows = detect.with_detector(scan_rows(candles_walk(spark, d)), "head_shoulders")
    return _points_flat(rows.withColumn("hits", guard(F.col("hits"), F.col("bars")).column()), "hits")


@query
def detect_patterns(spark, d):
    return _points_flat(_patterns(spark, d), "patterns")


@query
def detect_patterns_paths(spark, d):
    return _points_flat(_patterns(spark, d, candles_paths), "patterns")


@query
def detect_patterns_frames(spark, d):
    return _points_flat(_patterns(spark, d, candles_frames), "patterns")


@query
def breach_guard_all(spark, d):
    """Hits of all families that are still alive, over many series."""
    return _points_flat(_patterns(spark, d, candles_user), "patterns")


@query
def trim_hits(spark, d):
    return _flat(select.trim_hits(_patterns(spark, d)))


@query
def recent_patterns(spark, d):
    return _flat(select.trim_hits(select.recent_patterns(_patterns(spark, d))))


@query
def pattern_by_rank(spark, d):
    hits = select.pattern_by_rank(_patterns(spark, d))
    return _flat(hits.select("symbol", "kind", "confidence", "target_price", "invalidation_price"))


# ── decisions ───────────────────────────────────────────────────────────────


@query
def compact_summary_rows(spark, d):
    s = compact_summary(market_summary(candles_walk(spark, d)))
    return _flat(each(s, "patterns", "symbol").select("symbol", "no", "x.*"))


@query
def market_summary_rows(spark, d):
    s = market_summary(candles_walk(spark, d))
    return _flat(
        s.select(
            "symbol",
            "meta.*",
            pf.col("trend.direction").alias("direction"),
            pf.col("trend.strength").alias("strength"),
            pf.col("trend.slope_pct_per_candle").alias("slope_pct"),
            pf.size("plr").alias("segments"),
            pf.size("levels.support").alias("supports"),
            pf.size("levels.resistance").alias("resistances"),
            pf.col("levels.poc").alias("poc"),
            pf.col("momentum.rsi").alias("rsi"),
            pf.col("momentum.macd_cross").alias("macd_cross"),
            pf.col("volatility.atr").alias("atr"),
            pf.col("volatility.state").alias("volatility_state"),
            pf.size("patterns").alias("patterns"),
        )
    )


@query
def evidence(spark, d):
    e = with_evidence(market_summary(candles_walk(spark, d)))
    sides = [
        F.transform(
            F.col(f"_{side}"),
            lambda p, i, side=side: F.struct(
                ("side", side), ("no", i), ("factor", p.factor), ("weight", p.weight), ("detail", p.detail)
            ),
        )
        for side in ("bull", "bear")
    ]
    return _flat(each_struct(e, F.concat(*sides), "symbol"))


@query
def verdict(spark, d):
    v = with_verdict(with_evidence(market_summary(candles_user(spark, d))))
    return _flat(v.select("symbol", "bias", pf.col("_confidence").alias("confidence"), pf.col("_bull_score").alias("bull_score"), pf.col("_bear_score").alias("bear_score")))


@query
def trade_setup(spark, d):
    t = compose_thesis(market_summary(candles_user(spark, d)))
    return _flat(each_struct(t, F.array_compact(F.array(F.col("setup"))), "symbol", "verdict"))


@query
def stand_aside_guard(spark, d):
    t = compose_thesis(market_summary(candles_user(spark, d)))
    return _flat(t.select("symbol", "bias", "verdict", "confidence", pf.col("invalidation.price").alias("price"), pf.col("invalidation.reason").alias("reason")))


@query
def horizon_by_symbol(spark, d):
    parts = [
        infer_timeframe(view(spark, d)).select("symbol", horizon(F.col("timeframe_seconds")).column().alias("horizon"))
        for view in (candles_ev, candles_user, candles_ord)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def thesis(spark, d):
    t = compose_thesis(market_summary(candles_walk(spark, d)))
    return _flat(
        t.select(
            "symbol",
            "bias",
            "verdict",
            "confidence",
            "setup.entry",
            "setup.stop",
            "setup.target",
            "setup.rr",
            "setup.basis",
            pf.col("invalidation.price").alias("invalidation_price"),
            "horizon",
            pf.concat_ws("; ", "notes").alias("notes"),
            pf.concat_ws("; ", pf.col("bull.factor")).alias("bull"),
            pf.concat_ws("; ", pf.col("bear.factor")).alias("bear"),
        )
    )


@query
def rank_setups_users(spark, d):
    ranked, _ = rank_setups(candles_user(spark, d))
    return _flat(ranked.select("symbol", "verdict", "confidence", "score", "setup.rr"))


@query
def rank_setups_failed(spark, d):
    """Symbols that can't be ranked: bars above 150 or below 1 lack a price here, and some symbols have no other."""
    quotes = _quotes(spark, d)
    symbol = pf.concat_ws("-", "symbol", pf.floor(pf.col("close") / 25).cast("string"))
    _, failed = rank_setups(quotes.withColumnRenamed("date", "ts").withColumn("symbol", symbol))
    return _flat(failed)


@query
def position_size(spark, d):
    """Orders as planned trades: 2% below the price as stop, 5% above as target."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    price = pf.col("o_totalprice")
    plans = o.select(
        "o_orderkey",
        pf.lit(1_000_000.0).alias("account_size"),
        (pf.col("o_custkey") % 10 + 1).cast("double").alias("risk_pct"),
        price.alias("entry_price"),
        pf.when(pf.col("o_orderstatus") == "F", price * 1.02).otherwise(price * 0.98).alias("stop_loss"),
        pf.when(pf.col("o_orderstatus") != "P", price * 1.05).alias("target_price"),
        pf.lit(1.5).alias("commission_per_side"),
    )
    return _flat(sizing.position_size(plans))


# ── drawing and alerts ──────────────────────────────────────────────────────


def _shape_points(shapes: DataFrame) -> DataFrame:
    keep = [c for c in shapes.columns if c != "points"]
    return each(shapes, "points", *keep, no="point_no").select(*keep, "point_no", "x.ts", "x.price")


@query
def pattern_geometry(spark, d):
    g = geometry.pattern_geometry(_patterns(spark, d))
    return _flat(_shape_points(g))


@query
def thesis_layers(spark, d):
    rows = geometry.with_zone_start(scan_rows(candles_walk(spark, d)))
    g = geometry.thesis_layers(compose_thesis(summarize(rows, ("left_ts",)), geometry.LAYER_COLUMNS))
    return _flat(_shape_points(g))


@query
def price_alerts(spark, d):
    """Alerts at each nation's key price (20 + 4 per nation), direction by region."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    way = pf.when(pf.col("n_regionkey") == 0, "above").when(pf.col("n_regionkey") == 1, "below")
    types = spark.read.parquet(f"{d}/events.parquet").agg(pf.collect_set("event_type").alias("types")).scalar()
    rules = n.withColumn("types", types).select(
        pf.explode("types").alias("symbol"),
        (20 + 4 * pf.col("n_nationkey")).cast("double").alias("price"),
        way.alias("direction"),
        pf.col("n_name").alias("note"),
    )
    return _flat(ranges.price_alerts(candles_ev(spark, d), rules, 7 * DAY))


def _long(f: Query) -> Query:
    """The same over series of many thousand bars."""
    return lambda spark, d: f(spark, d, candles_lines)


QUERIES |= {f"{f.__name__}_lines": _long(f) for f in (trend_summary, meta_summary, zigzag, poc_value_area, quad_fit, volume_profile)}


def trending_with_bands(spark: SparkSession, d: str) -> DataFrame:
    """Which symbols trend, and how wide are their bands."""
    bars = with_indicators(candles_walk(spark, d), [Indicator("BOLL", (20,))])
    width = pf.max_by(pf.col("boll_upper") - pf.col("boll_lower"), "bar_idx")
    return _flat(trend_by_symbol(bars, band_width=width, last=pf.max_by("close", "bar_idx")))


query(trending_with_bands)

