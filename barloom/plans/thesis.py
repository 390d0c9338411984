"""Rule-scored trade thesis over summary rows, and the ranking of all symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as pf

from barloom.functions.arrays import let
from barloom.functions.numbers import clamp01, round_half_up
from barloom.functions.sql import F, Sql
from barloom.operators.select import recent_hits
from barloom.plans.summary import market_summary
from barloom.schema import BEARISH_KINDS, BULLISH_KINDS, HIT_TYPE, NEUTRAL_KINDS
from barloom.sources.candles import is_valid_candle

# Evidence weights and decision limits.
W_TREND = 0.30
W_RSI = 0.2
W_CROSS = 0.15
W_DIVERGENCE = 0.25
W_VALUE = 0.15
W_LEVEL = 0.12
W_PATTERN = 0.30
BIAS_THRESHOLD = 0.15
FULL_MASS = 0.6
MIN_RR = 1.0
NEAR_LEVEL = 0.015
STOP_ATR = 1.5
STOP_MAX_ATR = 3.0
STOP_MAX_PCT = 0.08
TARGET_ATR = 3.0
TARGET_RR = 2.0
EVIDENCE_SHOWN = 5

EVIDENCE_TYPE = "struct<factor:string,weight:double,detail:string>"
SETUP_TYPE = "struct<entry:double,stop:double,target:double,rr:double,basis:string>"


def _number(x: Sql, places: int) -> Sql:
    """A rounded number as text without a trailing '.0'."""
    return F.regexp_replace(round_half_up(x, places).cast("string"), "\\.0$", "")


def _point(factor, weight, detail) -> Sql:
    return F.struct(("factor", factor), ("weight", weight), ("detail", detail)).cast(EVIDENCE_TYPE)


def horizon(timeframe_seconds: Sql) -> Sql:
    return (
        F.when(F.coalesce(timeframe_seconds, 0) == 0, "swing")
        .when(timeframe_seconds < 3600, "intraday")
        .when(timeframe_seconds < 86400, "swing")
        .otherwise("position")
    )


def best_per_kind(patterns: Sql) -> Sql:
    """The most confident hit of each kind, kinds in order of first appearance."""

    def best(hits: Sql) -> Sql:
        return F.aggregate(hits, F.get(hits, 0), lambda a, h: F.when(h.confidence > a.confidence, h).otherwise(a))

    return let(
        patterns,
        lambda ps: F.transform(
            F.array_distinct(F.transform(ps, lambda p: p.kind)),
            lambda k: let(F.filter(ps, lambda p: p.kind == k), best),
        ),
    )


def _evidence(side: str) -> Sql:
    """Scored points of one side, in the order in which they are added up."""
    bull = side == "bull"
    trend, momentum, levels = F.col("trend"), F.col("momentum"), F.col("levels")
    price = F.col("meta").last_price
    kinds = BULLISH_KINDS if bull else BEARISH_KINDS
    word = "bullish" if bull else "bearish"
    near = F.get(
        F.filter(
            levels.support if bull else levels.resistance,
            lambda l: F.try_divide(F.abs(price - l), price) <= NEAR_LEVEL,  # noqa: E741
        ),
        0,
    )
    fresh = F.size(F.filter(momentum.divergences.recent, lambda d: d.kind.isin(word, f"hidden_{word}")))
    label = "uptrend" if bull else "downtrend"
    extreme = "oversold" if bull else "overbought"
    on_side = price >= levels.poc if bull else price < levels.poc
    points = [
        F.when(
            (trend.direction == ("up" if bull else "down")) & (trend.strength > 0),
            _point(
                label,
                round_half_up(W_TREND * trend.strength, 3),
                F.concat(f"{label} r²=", _number(trend.strength, 2)),
            ),
        ),
        F.when(
            momentum.rsi_state == extreme,
            _point(f"rsi_{extreme}", W_RSI, F.concat("RSI ", _number(momentum.rsi, 1), f" {extreme}")),
        ),
        F.when(
            momentum.macd_cross == word,
            _point(f"macd_{side}_cross", W_CROSS, f"recent MACD {word} cross"),
        ),
        F.when(
            fresh > 0,
            _point(
                f"{word}_divergence",
                W_DIVERGENCE,
                F.concat(fresh.cast("string"), f" recent {word} divergence(s)"),
            ),
        ),
        F.when(
            (levels.poc > 0) & on_side,
            _point(
                "above_poc" if bull else "below_poc",
                W_VALUE,
                F.concat(f"price {'above' if bull else 'below'} POC ", _number(levels.poc, 2)),
            ),
        ),
        let(
            near,
            lambda l: F.when(  # noqa: E741
                l.isNotNull(),
                _point(
                    "at_support" if bull else "at_resistance",
                    W_LEVEL,
                    F.concat("holding support " if bull else "capped at resistance ", _number(l, 2)),
                ),
            ),
        ),
    ]
    from_patterns = F.transform(
        F.filter(F.col("_best"), lambda h: h.kind.isin(*kinds)),
        lambda h: _point(
            h.kind,
            round_half_up(W_PATTERN * h.confidence, 3),
            F.concat(h.kind, " (conf ", _number(h.confidence, 2), ")"),
        ),
    )
    return F.concat(F.array_compact(F.array(*points)), from_patterns)


def _strongest(points: Sql) -> Sql:
    """By weight, heaviest first; order of discovery on ties."""
    keyed = F.transform(points, lambda p, i: F.struct(("w", p.weight), ("i", i), ("p", p)))
    ordered = F.array_sort(
        keyed, lambda a, b: F.when(a.w > b.w, -1).when(a.w < b.w, 1).otherwise(a.i - b.i)
    )
    return F.slice(F.transform(ordered, lambda x: x.p), 1, EVIDENCE_SHOWN)


def trade_setup(direction: str) -> Sql:
    """Entry, stop and target of a long or short, NULL when no honest one exists."""
    long = direction == "long"
    sign = 1.0 if long else -1.0
    levels, atr, entry = F.col("levels"), F.col("volatility").atr, F.col("meta").last_price
    top = F.col("_top")
    lower = F.concat(levels.support, F.array(levels.val, levels.poc))
    upper = F.concat(levels.resistance, F.array(levels.vah, levels.poc))

    def nearest_below(xs: Sql) -> Sql:
        return F.array_max(F.filter(xs, lambda v: (v > 0) & (v < entry)))

    def nearest_above(xs: Sql) -> Sql:
        return F.array_min(F.filter(xs, lambda v: (v > 0) & (v > entry)))

    behind = nearest_below(lower) if long else nearest_above(upper)
    ahead = nearest_above(upper) if long else nearest_below(lower)
    atr_stop = entry - sign * STOP_ATR * atr
    kinds = BULLISH_KINDS if long else BEARISH_KINDS
    measured = top.kind.isin(*kinds) & (
        (top.target_price > entry) if long else (top.target_price < entry)
    )

    def stops(raw: Sql) -> Sql:
        far = (atr > 0) & (sign * (entry - raw) > F.least(STOP_MAX_ATR * atr, STOP_MAX_PCT * entry))
        return F.struct(
            ("raw", raw), ("clamped", F.coalesce(far, False)), ("stop", F.when(far, atr_stop).otherwise(raw))
        )

    def targets(s: Sql) -> Sql:
        projected = entry + sign * F.greatest(TARGET_RR * sign * (entry - s.stop), TARGET_ATR * atr)
        return F.struct(
            ("raw", s.raw),
            ("clamped", s.clamped),
            ("stop", s.stop),
            (
                "target",
                F.when(F.coalesce(measured, False), top.target_price).otherwise(F.coalesce(ahead, projected)),
            ),
            (
                "basis",
                F.when(F.coalesce(measured, False), F.concat(top.kind, " target"))
                .when(ahead.isNotNull(), "support→resistance" if long else "resistance→support")
                .otherwise("measured move"),
            ),
        )

    def judged(t: Sql) -> Sql:
        rr = F.try_divide(sign * (t.target - entry), sign * (entry - t.stop))
        ok = (
            (entry > 0)
            & (sign * (entry - t.raw) > 0)
            & (sign * (t.target - entry) > 0)
            & (t.target > 0)
            & (rr >= MIN_RR)
        )
        return F.when(
            ok,
            F.struct(
                ("entry", round_half_up(entry, 4)),
                ("stop", round_half_up(t.stop, 4)),
                ("target", round_half_up(t.target, 4)),
                ("rr", round_half_up(rr, 2)),
                ("basis", F.concat(t.basis, F.when(t.clamped, " [ATR stop: structure too far]").otherwise(""))),
            ).cast(SETUP_TYPE),
        )

    raw = F.coalesce(behind, F.when(atr > 0, atr_stop))
    return let(let(let(raw, stops), targets), judged)


def with_evidence(summary: DataFrame) -> DataFrame:
    """Summary rows plus all scored points of both sides and the leading pattern."""
    meta = F.col("meta")
    usable = F.coalesce((meta.candle_count > 0) & (meta.last_price > 0), False)
    df = summary.withColumns(
        {
            "_usable": usable.column(),
            "_best": best_per_kind(recent_hits(F.col("patterns"), meta.first_ts, meta.last_ts)).column(),
        }
    )
    directional = F.filter(F.col("_best"), lambda h: ~h.kind.isin(*NEUTRAL_KINDS))
    top = F.aggregate(
        directional,
        F.lit(None).cast(HIT_TYPE),
        lambda a, h: F.when(a.isNull() | (h.confidence > a.confidence), h).otherwise(a),
    )
    none = F.array().cast(f"array<{EVIDENCE_TYPE}>")
    return df.withColumns(
        {
            "_top": top.column(),
            "_bull": F.when(F.col("_usable"), _evidence("bull")).otherwise(none).column(),
            "_bear": F.when(F.col("_usable"), _evidence("bear")).otherwise(none).column(),
        }
    )


def _sum_weights(points: Sql) -> Sql:
    """Added up in order: a re-ordered sum can land on the other side of the threshold."""
    return F.aggregate(points, 0.0, lambda a, p: a + p.weight)


def with_verdict(evidence: DataFrame) -> DataFrame:
    """Add bias and raw confidence."""
    bull, bear = F.col("_bull_score"), F.col("_bear_score")
    df = evidence.withColumns(
        {"_bull_score": _sum_weights(F.col("_bull")).column(), "_bear_score": _sum_weights(F.col("_bear")).column()}
    )
    net, mass = bull - bear, bull + bear
    agreement = F.coalesce(F.try_divide(F.abs(net), mass), 0.0)
    return df.withColumns(
        {
            "bias": F.when(net > BIAS_THRESHOLD, "bullish")
            .when(net < -BIAS_THRESHOLD, "bearish")
            .otherwise("neutral")
            .column(),
            "_confidence": round_half_up(clamp01(agreement * clamp01(mass / FULL_MASS)), 2).column(),
        }
    )


def _notes() -> Sql:
    trend, volatility = F.col("trend"), F.col("volatility")
    waiting = F.transform(
        F.filter(F.col("_best"), lambda h: h.kind.isin(*NEUTRAL_KINDS)),
        lambda h: F.concat(F.replace(h.kind, "_", " "), " — await breakout"),
    )
    directed = trend.direction.isin("up", "down") & (trend.strength > 0)
    return F.when(~F.col("_usable"), F.array("insufficient data")).otherwise(
        F.concat(
            F.array_compact(F.array(F.when(~directed, "no clear trend (ranging)"))),
            waiting,
            F.array_compact(
                F.array(
                    F.when(volatility.bb_squeeze, "Bollinger squeeze — volatility expansion likely").when(
                        volatility.state == "expanding", "volatility expanding"
                    ),
                    F.when(
                        (F.col("bias") != "neutral") & F.col("setup").isNull(),
                        "no clean setup at acceptable R/R — standing aside",
                    ),
                )
            ),
        )
    )


def compose_thesis(summary: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One thesis per summary row. Without a clean setup the verdict is to stand aside.

    ``keep`` names summary columns to carry along.
    """
    df = with_verdict(with_evidence(summary))
    setup = F.when(F.col("bias") == "bullish", trade_setup("long")).when(
        F.col("bias") == "bearish", trade_setup("short")
    )
    df = df.withColumn("setup", setup.column())
    has, top, biased = F.col("setup").isNotNull(), F.col("_top"), F.col("bias") != "neutral"
    level = F.when(top.invalidation_price != 0, top.invalidation_price)
    return df.select(
        "symbol",
        "bias",
        F.when(~has, "stand_aside")
        .when(F.col("bias") == "bullish", "long")
        .otherwise("short")
        .column()
        .alias("verdict"),
        F.when(biased & ~has, round_half_up(F.col("_confidence") * 0.5, 2))
        .otherwise(F.col("_confidence"))
        .column()
        .alias("confidence"),
        _strongest(F.col("_bull")).column().alias("bull"),
        _strongest(F.col("_bear")).column().alias("bear"),
        "setup",
        F.when(
            has,
            F.struct(
                ("price", round_half_up(F.coalesce(level, F.col("setup").stop), 4)),
                (
                    "reason",
                    F.when(level.isNotNull(), F.concat(top.kind, " invalidation")).otherwise("structural stop"),
                ),
            ),
        )
        .column()
        .alias("invalidation"),
        horizon(F.col("meta").timeframe_seconds).column().alias("horizon"),
        _notes().column().alias("notes"),
        pf.col("_bull_score").alias("bull_score"),
        pf.col("_bear_score").alias("bear_score"),
        *keep,
    )


def thesis(candles: DataFrame, lookback: int | None = None, chunk_seconds: int | None = None) -> DataFrame:
    return compose_thesis(market_summary(candles, lookback, chunk_seconds))


def score(theses: DataFrame) -> DataFrame:
    """R/R times confidence; 0 without a setup."""
    return theses.withColumn(
        "score", pf.coalesce(pf.col("setup.rr") * pf.col("confidence"), pf.lit(0.0))
    )


def rank_setups(
    candles: DataFrame, lookback: int | None = None, chunk_seconds: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(ranked, failed): theses of all symbols, best first, and the symbols that have no usable bar.

    Ranking is a distributed sort. It needs a sampling pass over its input, so the
    finished theses (one short row per symbol) are shuffled once before it; otherwise
    the whole analysis would run twice.
    """
    ok = is_valid_candle()
    done = score(thesis(candles.where(ok), lookback, chunk_seconds).repartition(pf.xxhash64("symbol")))
    ranked = done.orderBy(pf.desc("score"), "symbol")
    failed = (
        candles.groupBy("symbol")
        .agg(pf.count_if(ok).alias("usable"), pf.count("*").alias("rows"))
        .where(pf.col("usable") == 0)
        .select("symbol", "rows", pf.lit("no bar with ts and OHLC").alias("reason"))
    )
    return ranked, failed
