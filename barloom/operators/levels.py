"""Support, resistance and the volume profile of a scan row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as pf

from barloom.functions.arrays import let, tail
from barloom.functions.numbers import clamp01
from barloom.functions.sql import F, Sql

# Fixed values.
BINS = 50
VALUE_AREA = 0.7
CLUSTERS = 6
CLUSTER_STEPS = 30
CLUSTER_SETTLED = 1e-6
LEVELS_PER_SIDE = 3
TOUCH_ATR = 0.3
TOUCH_FALLBACK = 0.005
FULL_TOUCHES = 5


def volume_profile(bars: Sql) -> Sql:
    """struct(low, width, bins): volume per equal-width price bin.

    Each bar spreads its volume evenly over the bins between its low and high.
    ``width`` is 0 when all prices are equal.
    """

    def binned(range_: Sql) -> Sql:
        spread = F.transform(
            bars,
            lambda b: let(
                F.struct(
                    ("lo", F.floor(F.try_divide(b.low - range_.low, range_.width))),
                    ("hi", F.least(BINS - 1, F.floor(F.try_divide(b.high - range_.low, range_.width)))),
                ),
                lambda s: F.struct(
                    ("lo", s.lo),
                    ("hi", s.hi),
                    ("v", F.coalesce(b.volume, 0.0) / F.greatest(1, s.hi - s.lo + 1)),
                ),
            ),
        )
        bins = let(
            spread,
            lambda xs: F.transform(
                F.sequence(0, BINS - 1),
                lambda k: F.aggregate(
                    xs, 0.0, lambda a, x: a + F.when((x.lo <= k) & (k <= x.hi), x.v).otherwise(0.0)
                ),
            ),
        )
        return F.struct(("low", range_.low), ("width", range_.width), ("bins", bins))

    low = F.array_min(F.transform(bars, lambda b: b.low))
    high = F.array_max(F.transform(bars, lambda b: b.high))
    return let(
        F.struct(("low", low), ("high", high)),
        lambda r: let(F.struct(("low", r.low), ("width", (r.high - r.low) / float(BINS))), binned),
    )


def value_area(profile: Sql) -> Sql:
    """struct(poc, vah, val): busiest bin and the band around it that holds 70% of the volume."""

    def expand(p: Sql, poc: Sql, goal: Sql) -> Sql:
        def step(s: Sql, _: Sql) -> Sql:
            left = F.when(s.lo > 0, F.get(p.bins, s.lo - 1)).otherwise(-1.0)
            right = F.when(s.hi < BINS - 1, F.get(p.bins, s.hi + 1)).otherwise(-1.0)
            go_left = (s.lo > 0) & (left >= right)
            more = (s.sum < goal) & ((s.lo > 0) | (s.hi < BINS - 1))
            return (
                F.when(~more, s)
                .when(go_left, F.struct(("lo", s.lo - 1), ("hi", s.hi), ("sum", s.sum + left)))
                .otherwise(F.struct(("lo", s.lo), ("hi", s.hi + 1), ("sum", s.sum + right)))
            )

        start = F.struct(("lo", poc), ("hi", poc), ("sum", F.get(p.bins, poc)))
        band = F.aggregate(F.sequence(1, BINS - 1), start, step)
        return let(
            band,
            lambda b: F.struct(
                ("poc", p.low + (poc + 0.5) * p.width),
                ("vah", p.low + (b.hi + 1) * p.width),
                ("val", p.low + b.lo * p.width),
            ),
        )

    def located(p: Sql) -> Sql:
        poc = F.array_position(p.bins, F.array_max(p.bins)).cast("int") - 1
        goal = F.aggregate(p.bins, 0.0, lambda a, v: a + v) * VALUE_AREA
        return F.when(p.width == 0, F.struct(("poc", p.low), ("vah", p.low), ("val", p.low))).otherwise(
            let(F.struct(("at", poc), ("goal", goal)), lambda s: expand(p, s.at, s.goal))
        )

    return let(profile, located)


def level_clusters(prices: Sql, k: int = CLUSTERS) -> Sql:
    """Ascending centres of one-dimensional k-means, seeded on quantiles.

    At most 30 rounds, fewer once no centre moves by more than 1e-6; a centre without
    members stays put. k or fewer prices are returned as they are.
    """

    def settle(values: Sql) -> Sql:
        seeds = let(
            F.array_sort(values),
            lambda s: F.transform(
                F.sequence(0, k - 1), lambda i: F.get(s, F.floor((i + 0.5) / float(k) * F.size(s)).cast("int"))
            ),
        )

        def round_(state: Sql, _: Sql) -> Sql:
            def nearest(v: Sql) -> Sql:
                return let(
                    F.transform(state.centres, lambda c: F.abs(v - c)),
                    lambda d: F.array_position(d, F.array_min(d)) - 1,
                )

            members = F.transform(values, lambda v: F.struct(("v", v), ("c", nearest(v))))

            def means(ms: Sql) -> Sql:
                return F.transform(
                    state.centres,
                    lambda c, i: let(
                        F.filter(ms, lambda m: m.c == i),
                        lambda own: F.when(F.size(own) == 0, c).otherwise(
                            F.aggregate(own, 0.0, lambda a, m: a + m.v) / F.greatest(1, F.size(own))
                        ),
                    ),
                )

            moved = let(
                let(members, means),
                lambda new: F.struct(
                    ("centres", new),
                    (
                        "done",
                        F.array_max(F.zip_with(new, state.centres, lambda a, b: F.abs(a - b))) <= CLUSTER_SETTLED,
                    ),
                ),
            )
            return F.when(state.done, state).otherwise(moved)

        start = F.struct(("centres", seeds), ("done", False))
        return F.array_sort(F.aggregate(F.sequence(1, CLUSTER_STEPS), start, round_).centres)

    return let(prices, lambda v: F.when(F.size(v) <= k, F.array_sort(v)).otherwise(settle(v)))


def swing_prices(highs: Sql, lows: Sql) -> Sql:
    return F.concat(F.transform(highs, lambda p: p.price), F.transform(lows, lambda p: p.price))


def nearest_levels(clusters: Sql, close: Sql) -> tuple[Sql, Sql]:
    """(support, resistance): up to three centres strictly below / above the last close."""
    support = tail(F.filter(clusters, lambda c: c < close), LEVELS_PER_SIDE)
    resistance = F.slice(F.filter(clusters, lambda c: c > close), 1, LEVELS_PER_SIDE)
    return support, resistance


def level_detail(levels: Sql, swings: Sql, atr: Sql, first_ts: Sql, last_ts: Sql) -> Sql:
    """Per level: how often and how recently swings came within tolerance of it."""

    def one(level: Sql) -> Sql:
        tol = F.when(atr > 0, atr * TOUCH_ATR).otherwise(level * TOUCH_FALLBACK)
        near = F.filter(swings, lambda s: F.abs(s.price - level) <= tol)
        return let(
            F.struct(
                ("touches", F.size(near)),
                ("ts", F.coalesce(F.array_max(F.transform(near, lambda s: s.ts)), F.lit(0).cast("bigint"))),
            ),
            lambda t: F.struct(
                ("price", level),
                ("touches", t.touches),
                (
                    "strength",
                    clamp01(t.touches / float(FULL_TOUCHES))
                    * (
                        0.5
                        + 0.5
                        * F.when((last_ts > first_ts) & (t.ts > 0), F.try_divide(t.ts - first_ts, last_ts - first_ts)).otherwise(0.0)
                    ),
                ),
                ("last_touch_ts", t.ts),
            ),
        )

    return F.transform(levels, one)


def with_levels(rows: DataFrame) -> DataFrame:
    """Add ``clusters``, ``support``, ``resistance``, ``poc``, ``vah`` and ``val`` to scan rows."""
    close = F.col("last_close")
    rows = rows.withColumns(
        {
            "clusters": level_clusters(swing_prices(F.col("highs"), F.col("lows"))).column(),
            "_area": value_area(volume_profile(F.col("bars"))).column(),
        }
    )
    support, resistance = nearest_levels(F.col("clusters"), close)
    return rows.withColumns(
        {
            "support": support.column(),
            "resistance": resistance.column(),
            **{c: pf.col(f"_area.{c}") for c in ("poc", "vah", "val")},
        }
    ).drop("_area")


def with_level_detail(rows: DataFrame) -> DataFrame:
    """Add ``level_detail``: one entry per support and resistance level."""
    args = (F.col("swings"), F.col("last_atr"), F.col("first_ts"), F.col("last_ts"))
    return rows.withColumn(
        "level_detail", level_detail(F.concat(F.col("support"), F.col("resistance")), *args).column()
    )

