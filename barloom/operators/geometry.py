"""Drawing primitives of hits and theses, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as pf

from barloom.functions.arrays import let
from barloom.functions.numbers import round_half_up
from barloom.functions.rows import each
from barloom.functions.sql import F, Sql

SHAPE_TYPE = "struct<shape:string,label:string,points:array<struct<ts:bigint,price:double>>>"

# Pattern families; re-drawing a family replaces it as one group.
FAMILIES = {
    "pattern-hs": ("head_shoulders", "inverse_head_shoulders"),
    "pattern-double": ("double_top", "double_bottom", "triple_top", "triple_bottom"),
    "pattern-triangle": ("ascending_triangle", "descending_triangle", "symmetric_triangle"),
    "pattern-flag": ("bull_flag", "bear_flag"),
    "pattern-channel": ("channel_up", "channel_down", "channel_flat"),
    "pattern-wedge": ("rising_wedge", "falling_wedge"),
    "pattern-cup": ("cup_handle", "rounding_bottom"),
    "pattern-gap": ("gap_up", "gap_down"),
    "pattern-harmonic": (
        "abcd_bullish",
        "abcd_bearish",
        "gartley_bullish",
        "gartley_bearish",
        "bat_bullish",
        "bat_bearish",
        "butterfly_bullish",
        "butterfly_bearish",
        "crab_bullish",
        "crab_bearish",
    ),
}


def group_id(kind: Sql) -> Sql:
    out = None
    for name, kinds in FAMILIES.items():
        out = (out or F).when(kind.isin(*kinds), name)
    return out


def _role(hit: Sql, *roles: str) -> Sql:
    """Anchors with one of the given roles, in the order of the hit's points."""
    return F.transform(
        F.filter(hit.points, lambda p: p.role.isin(*roles)), lambda p: F.struct(("ts", p.ts), ("price", p.price))
    )


def _one(hit: Sql, role: str) -> Sql:
    return F.get(_role(hit, role), 0)


def _shape(shape: str, label, points: Sql) -> Sql:
    return F.struct(("shape", shape), ("label", label), ("points", points)).cast(SHAPE_TYPE)


def _through(shape: str, label, *points: Sql) -> Sql:
    """A shape through single anchors, NULL unless all of them exist."""
    return let(
        F.array(*points),
        lambda ps: F.when(F.forall(ps, lambda p: p.isNotNull()), _shape(shape, label, ps)),
    )


def _roles_shape(hit: Sql, shape: str, label, roles: tuple[str, ...]) -> Sql:
    return _through(shape, label, *[_one(hit, r) for r in roles])


def _ends(hit: Sql, role: str, label) -> Sql:
    """A line from the first to the last of at least two anchors of a role."""
    return let(
        _role(hit, role),
        lambda ps: F.when(
            F.size(ps) >= 2,
            _shape("trendline", label, F.array(F.get(ps, 0), F.get(ps, F.size(ps) - 1))),
        ),
    )


def _silhouette(hit: Sql, roles: tuple[str, ...], necks: tuple[str, ...], lowest: bool) -> list[Sql]:
    """Path through the pivots and a level at the far neck pivot."""
    far = let(
        _role(hit, *necks),
        lambda ps: F.aggregate(
            ps,
            F.get(ps, 0),
            lambda a, p: F.when(p.price < a.price if lowest else p.price > a.price, p).otherwise(a),
        ),
    )
    return [
        _roles_shape(hit, "path", hit.kind, roles),
        _through("horizontalLine", F.concat(hit.kind, " neckline"), far),
    ]


def _arc(hit: Sql, label) -> Sql:
    return let(_role(hit, "arc"), lambda ps: F.when(F.size(ps) >= 3, _shape("path", label, ps)))


def hit_shapes(hit: Sql) -> Sql:
    """All drawing primitives of one hit, derived only from its named anchors."""
    named = lambda suffix: F.concat(hit.kind, suffix)
    per_family: dict[tuple[str, ...], list[Sql]] = {
        FAMILIES["pattern-hs"]: [
            _roles_shape(hit, "trendline", named(" neckline"), ("neckline_left", "neckline_right")),
            _roles_shape(
                hit,
                "path",
                hit.kind,
                ("left_shoulder", "neckline_left", "head", "neckline_right", "right_shoulder"),
            ),
        ],
        ("double_top",): _silhouette(hit, ("top_1", "valley", "top_2"), ("valley",), True),
        ("double_bottom",): _silhouette(hit, ("bottom_1", "peak", "bottom_2"), ("peak",), False),
        ("triple_top",): _silhouette(
            hit, ("top_1", "valley_1", "top_2", "valley_2", "top_3"), ("valley_1", "valley_2"), True
        ),
        ("triple_bottom",): _silhouette(
            hit, ("bottom_1", "peak_1", "bottom_2", "peak_2", "bottom_3"), ("peak_1", "peak_2"), False
        ),
        FAMILIES["pattern-triangle"]: [_ends(hit, "high", named(" upper")), _ends(hit, "low", named(" lower"))],
        FAMILIES["pattern-flag"]: [
            _roles_shape(hit, "path", hit.kind, ("impulse_start", "impulse_end", "flag_end"))
        ],
        FAMILIES["pattern-channel"]: [
            _roles_shape(hit, "parallelChannel", hit.kind, ("base_start", "base_end", "offset"))
        ],
        FAMILIES["pattern-wedge"]: [
            _roles_shape(hit, "trendline", named(" upper"), ("upper_start", "upper_end")),
            _roles_shape(hit, "trendline", named(" lower"), ("lower_start", "lower_end")),
        ],
        ("abcd_bullish", "abcd_bearish"): [_roles_shape(hit, "abcd", hit.kind, ("A", "B", "C", "D"))],
        tuple(k for k in FAMILIES["pattern-harmonic"] if not k.startswith("abcd")): [
            _roles_shape(hit, "xabcd", hit.kind, ("X", "A", "B", "C", "D"))
        ],
        ("cup_handle",): [
            _arc(hit, "cup"),
            _roles_shape(hit, "path", "handle", ("right_rim", "handle_low", "handle_end")),
            F.when(
                _one(hit, "left_rim").isNotNull(), _roles_shape(hit, "horizontalLine", "cup rim", ("right_rim",))
            ),
        ],
        ("rounding_bottom",): [
            _arc(hit, hit.kind),
            _roles_shape(hit, "horizontalLine", named(" rim"), ("rim_left",)),
        ],
        FAMILIES["pattern-gap"]: [_roles_shape(hit, "rectangle", hit.kind, ("gap_low", "gap_high"))],
    }
    shapes = None
    for kinds, parts in per_family.items():
        shapes = (shapes or F).when(hit.kind.isin(*kinds), F.array_compact(F.array(*parts)))
    last_ts = F.array_max(F.transform(hit.points, lambda p: p.ts))

    def level(price: Sql, suffix: str) -> Sql:
        return F.when(
            price.isNotNull(),
            _shape(
                "horizontalLine", named(suffix), F.array(F.struct(("ts", last_ts), ("price", price)))
            ),
        )

    levels = F.array_compact(
        F.array(level(hit.target_price, " target"), level(hit.invalidation_price, " invalidation"))
    )
    return let(shapes, lambda s: F.when(F.size(s) > 0, F.concat(s, levels)).otherwise(s))


def pattern_geometry(rows: DataFrame) -> DataFrame:
    """One row per drawing primitive of every pattern: (symbol, hit_no, shape_no, group_id, shape, label, points)."""
    drawn = F.transform(
        F.col("patterns"), lambda h: F.struct(("group_id", group_id(h.kind)), ("shapes", hit_shapes(h)))
    )
    hits = each(rows, drawn, "symbol", no="hit_no").select("symbol", "hit_no", "x.*")
    keep = ("symbol", "hit_no", "group_id")
    return each(hits, "shapes", *keep, no="shape_no").select("symbol", "hit_no", "shape_no", "group_id", "x.*")


# Fixed values.
ZONE_ATR = 0.25
ZONE_BARS = 20
THESIS_GROUP = "thesis"


# Summary columns that a thesis must carry along to be drawn.
LAYER_COLUMNS = ("meta", "levels", "volatility", "patterns", "left_ts")


def thesis_layers(theses: DataFrame) -> DataFrame:
    """Context lines for every symbol; entry zone and trade box only where there is a setup.

    Needs ``LAYER_COLUMNS`` next to the thesis; ``left_ts`` is where zone and box start.
    """
    df = theses
    meta, levels, setup, atr = F.col("meta"), F.col("levels"), F.col("setup"), F.col("volatility").atr

    def text(x: Sql) -> Sql:
        return F.format_string("%.2f", round_half_up(x, 2))

    def line(price: Sql, label: Sql) -> Sql:
        return _shape("horizontalLine", label, F.array(F.struct(("ts", meta.last_ts), ("price", price))))

    cut = meta.last_ts - 0.25 * (meta.last_ts - meta.first_ts)
    recent = F.filter(
        F.col("patterns"),
        lambda h: (h.kind != "symmetric_triangle")
        & ((meta.last_ts <= meta.first_ts) | (F.array_max(F.transform(h.points, lambda p: p.ts)) >= cut)),
    )
    top = let(
        recent,
        lambda hs: F.aggregate(
            hs, F.get(hs, 0), lambda a, h: F.when(h.confidence > a.confidence, h).otherwise(a)
        ),
    )
    context = F.concat(
        F.transform(levels.support, lambda s: line(s, F.concat("S ", text(s)))),
        F.transform(levels.resistance, lambda r: line(r, F.concat("R ", text(r)))),
        F.array_compact(
            F.array(
                F.when(levels.poc > 0, line(levels.poc, F.concat("POC ", text(levels.poc)))),
                let(
                    top,
                    lambda t: F.when(
                        t.invalidation_price.isNotNull(),
                        line(t.invalidation_price, F.concat(t.kind, " invalidation")),
                    ),
                ),
            )
        ),
    )
    left = F.col("left_ts")
    far = F.when(F.col("verdict") == "long", setup.entry - ZONE_ATR * atr).otherwise(setup.entry + ZONE_ATR * atr)

    def corner(ts: Sql, price: Sql) -> Sql:
        return F.struct(("ts", ts), ("price", price))

    action = F.array_compact(
        F.array(
            F.when(
                atr > 0,
                _shape("rectangle", "entry zone", F.array(corner(left, setup.entry), corner(meta.last_ts, far))),
            ),
            F.struct(
                ("shape", F.when(F.col("verdict") == "long", "longPosition").otherwise("shortPosition")),
                (
                    "label",
                    F.concat(
                        F.upper(F.col("verdict")),
                        " · R/R ",
                        F.regexp_replace(setup.rr.cast("string"), "\\.0$", ""),
                    ),
                ),
                ("points", F.array(*[corner(left, setup[f]) for f in ("entry", "stop", "target")])),
            ).cast(SHAPE_TYPE),
        )
    )
    layers = F.concat(
        context, F.when(setup.isNotNull(), action).otherwise(F.array().cast(f"array<{SHAPE_TYPE}>"))
    )
    return each(df, layers, "symbol", no="layer_no").select(
        "symbol", "layer_no", pf.lit(THESIS_GROUP).alias("group_id"), "x.*"
    )


def with_zone_start(rows: DataFrame) -> DataFrame:
    """Add ``left_ts`` to scan rows: the bar 20 bars back, or the first one."""
    bar = F.get(F.col("bars"), F.greatest(0, F.col("n") - ZONE_BARS))
    return rows.withColumn("left_ts", bar.ts.column())
