import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as pf
from shapes import SHAPES, candles, quiet, walk

from barloom.functions.sql import F
from barloom.operators.geometry import pattern_geometry
from barloom.operators.patterns.detect import hit_points, hit_rows, with_patterns
from barloom.operators.patterns.templates import HARMONICS, TEMPLATE_SCHEMA, read_templates, template_hits, template_table
from barloom.operators.series import scan_rows


@pytest.fixture(scope="module")
def rows(spark):
    out = with_patterns(scan_rows(candles(spark, SHAPES))).cache()
    yield out
    out.unpersist()


@pytest.fixture(scope="module")
def kinds(rows):
    found = defaultdict(list)
    for r in hit_rows(rows).orderBy("symbol", "hit_no").collect():
        found[r.symbol].append(r)
    return found


POSITIVE = [
    "head_shoulders",
    "double_top",
    "channel_up",
    "channel_down",
    "channel_flat",
    "rising_wedge",
    "falling_wedge",
    "cup_handle",
    "rounding_bottom",
    "gap_up",
    "abcd_bullish",
    "gartley_bullish",
    "bat_bullish",
    "butterfly_bullish",
    "crab_bullish",
    "triple_top",
    "triple_bottom",
    "bull_flag",
]


@pytest.mark.parametrize("kind", POSITIVE)
def test_textbook_shape_is_found(kinds, kind):
    assert kind in [h.kind for h in kinds[kind]]


@pytest.mark.parametrize(
    ("shape", "absent"),
    [
        ("v_bottom", {"cup_handle", "rounding_bottom"}),
        ("cup_without_handle", {"cup_handle"}),
        ("cup_handle", {"rounding_bottom"}),
        ("falling_parabola", {"rounding_bottom", "cup_handle"}),
        ("gap_filled", {"gap_up", "gap_down"}),
        ("micro_gaps", {"gap_up", "gap_down"}),
        ("shallow_double", {"double_top", "triple_top"}),
        ("misaligned_double", {"double_top"}),
        ("broken_abcd", {"abcd_bullish", "abcd_bearish"}),
        ("broken_xabcd", {"gartley_bullish", "bat_bullish", "butterfly_bullish", "crab_bullish"}),
        ("triple_top", {"double_top"}),
        ("triple_bottom", {"double_bottom"}),
    ],
)
def test_look_alike_is_rejected(kinds, shape, absent):
    assert not absent & {h.kind for h in kinds[shape]}


def test_head_shoulders_is_followed_by_three_gaps(kinds):
    assert [h.kind for h in kinds["head_shoulders"]] == ["head_shoulders", "gap_down", "gap_down", "gap_down"]


def test_levels_of_known_shapes(kinds):
    triple = next(h for h in kinds["triple_top"] if h.kind == "triple_top")
    assert triple.invalidation_price > 120 and triple.target_price < 104
    cup = next(h for h in kinds["cup_handle"] if h.kind == "cup_handle")
    assert cup.target_price > 130 and 112 < cup.invalidation_price < 115
    assert [p.role for p in cup.points].count("arc") == 7
    assert all(0.5 <= h.confidence <= 1 for hs in kinds.values() for h in hs)


def test_points_lie_on_bars(rows):
    points = hit_points(hit_rows(rows)).join(
        rows.select("symbol", pf.explode("bars.ts").alias("ts")), ["symbol", "ts"], "left_anti"
    )
    assert points.count() == 0


def test_geometry_has_a_shape_per_hit(rows, kinds):
    shapes = pattern_geometry(rows).collect()
    drawn = {(r.symbol, r.hit_no) for r in shapes}
    assert drawn == {(s, h.hit_no) for s, hs in kinds.items() for h in hs}
    cup = [r for r in shapes if r.symbol == "cup_handle" and r.group_id == "pattern-cup"]
    assert [r.shape for r in cup] == ["path", "path", "horizontalLine", "horizontalLine", "horizontalLine"]
    neck = [r for r in shapes if r.label == "triple_top neckline"]
    assert neck and neck[0].points[0].price == pytest.approx(103.85)


def test_noise_has_no_gated_structure(spark):
    shapes = {f"w{seed}": walk(80, seed) for seed in range(12)}
    found = hit_rows(with_patterns(scan_rows(candles(spark, shapes)))).select("kind").collect()
    gated = {"rising_wedge", "falling_wedge", "cup_handle", "rounding_bottom", "gartley_bullish", "bat_bullish"}
    assert len([r for r in found if r.kind in gated]) <= 2


def test_breached_level_kills_a_hit(spark):
    from shapes import DOUBLE_TOP, flat_bodies

    alive = flat_bodies(DOUBLE_TOP)
    tagged = [*alive, (112, 121.5, 111, 112, 1000), (112, 112.5, 111.5, 112, 1000)]
    found = hit_rows(with_patterns(scan_rows(candles(spark, {"alive": alive, "tagged": tagged})))).collect()
    assert ("alive", "double_top") in {(r.symbol, r.kind) for r in found}
    assert ("tagged", "double_top") not in {(r.symbol, r.kind) for r in found}


def test_short_series_have_no_patterns(spark):
    rows = with_patterns(scan_rows(candles(spark, {"nine": quiet(9), "one": quiet(1)})))
    assert [r.n for r in rows.where(F.size(F.col("patterns")).column() == 0).collect()].__len__() == 2


def _zigzags(spark, n=2000):
    """Random zigzags of twelve pivots with legs of Fibonacci ratios, so that most templates match somewhere."""
    rng, rows = random.Random(11), []
    for i in range(n):
        price, leg, zz = 100.0, 10.0, []
        for j in range(12):
            zz.append((j * 5, j, "low" if j % 2 == 0 else "high", j * 18000, price))
            price += leg if j % 2 == 0 else -leg
            leg *= rng.choice((0.382, 0.5, 0.618, 0.786, 0.886, 1.13, 1.272, 1.618, 1.9, 2.24, 2.83)) * rng.uniform(0.97, 1.03)
        rows.append((f"s{i}", zz, rng.uniform(0.01, 0.3)))
    return spark.createDataFrame(rows, "symbol string, zz array<struct<idx:int,ord:int,kind:string,ts:long,price:double>>, atr double")


def _template_hits(zz, templates):
    found = zz.select("symbol", template_hits(F.col("zz"), F.col("atr"), templates).column().alias("hits"))
    return {r["symbol"]: r["hits"] for r in found.collect()}


def test_templates_from_a_table_equal_the_shipped_ones(spark, tmp_path):
    zz = _zigzags(spark)
    template_table(spark).withColumn("extra", pf.lit(1)).write.parquet(str(tmp_path / "t"))
    rows = read_templates(spark.read.parquet(str(tmp_path / "t")))
    assert [t.name for t in rows] == [t.name for t in HARMONICS]
    shipped = _template_hits(zz, HARMONICS)
    assert _template_hits(zz, rows) == shipped
    assert len({h["kind"] for hits in shipped.values() for h in hits}) >= 8
    assert read_templates(template_table(spark).limit(0)) == ()


def test_a_template_of_a_user_needs_no_code(spark):
    zz = _zigzags(spark, 80)
    row = (7, "steps", ["A", "B", "C"], 0, [("r", [1, 2], [0, 1], None, 0.4, 0.6, 0.01)], "0.5 + abs(r - 0.5)", "p2 + dir * (p1 - p0)", "CASE WHEN dir > 0 THEN least(p0, p2) ELSE greatest(p0, p2) END", "dir * (p2 - p0) > 0")
    got = _template_hits(zz, read_templates(spark.createDataFrame([row], TEMPLATE_SCHEMA)))
    count = 0
    for r in zz.collect():
        want = []
        for w in zip(r["zz"], r["zz"][1:], r["zz"][2:], strict=False):
            p = [x["price"] for x in w]
            d, ratio = (1.0 if w[0]["kind"] == "low" else -1.0), abs(p[1] - p[2]) / abs(p[0] - p[1])
            if min(abs(p[1] - p[0]), abs(p[2] - p[1])) >= 2 * r["atr"] and 0.39 <= ratio <= 0.61 and d * (p[2] - p[0]) > 0:
                kind = "steps_bullish" if d > 0 else "steps_bearish"
                want.append((kind, 0.5 + abs(ratio - 0.5), p[2] + d * (p[1] - p[0]), min(p[0], p[2]) if d > 0 else max(p[0], p[2])))
        count += len(want)
        assert [(h["kind"], h["confidence"], h["target_price"], h["invalidation_price"]) for h in got[r["symbol"]]] == want
    assert count > 20


@pytest.mark.parametrize(
    "change",
    [{"target": "p9"}, {"target": "secret + 1"}, {"target": "p0; p1"}, {"target": None}, {"bullish_low_at": 4}, {"name": "two words"}, {"ratios": [("r", [0, 7], [0, 1], None, 0.1, 0.2, None)]}, {"ratios": [("r", [0, 1], [1, 2], None, None, None, None)]}],
)
def test_templates_that_make_no_sense_are_errors(spark, change):
    row = dict(no=1, name="steps", roles=["A", "B", "C"], bullish_low_at=0, ratios=[("r", [1, 2], [0, 1], [0.5], None, None, None)], confidence="0.5", target="p0", invalidation="p1", guard=None)
    assert len(read_templates(spark.createDataFrame([tuple(row.values())], TEMPLATE_SCHEMA))) == 1
    with pytest.raises(ValueError):
        read_templates(spark.createDataFrame([tuple((row | change).values())], TEMPLATE_SCHEMA))
