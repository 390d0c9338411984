"""Drawing primitives of patterns and theses."""

from __future__ import annotations

from oracles.base import FULL, WALK, sql
from oracles.decisions import _CONTEXT, _num
from oracles.patterns import ALL

O: dict[str, str] = {}

_HARMONICS = "['gartley_bullish', 'gartley_bearish', 'bat_bullish', 'bat_bearish', 'butterfly_bullish', 'butterfly_bearish', 'crab_bullish', 'crab_bearish']"

# kind, place among the shapes of the kind, shape, label ('' = kind, leading blank = kind + suffix), roles.
_SPECS = f"""
  (['head_shoulders', 'inverse_head_shoulders'], 0, 'trendline', ' neckline', ['neckline_left', 'neckline_right']),
  (['head_shoulders', 'inverse_head_shoulders'], 1, 'path', '', ['left_shoulder', 'neckline_left', 'head', 'neckline_right', 'right_shoulder']),
  (['double_top'], 0, 'path', '', ['top_1', 'valley', 'top_2']), (['double_top'], 1, 'horizontalLine', ' neckline', ['valley']),
  (['double_bottom'], 0, 'path', '', ['bottom_1', 'peak', 'bottom_2']), (['double_bottom'], 1, 'horizontalLine', ' neckline', ['peak']),
  (['triple_top'], 0, 'path', '', ['top_1', 'valley_1', 'top_2', 'valley_2', 'top_3']),
  (['triple_bottom'], 0, 'path', '', ['bottom_1', 'peak_1', 'bottom_2', 'peak_2', 'bottom_3']),
  (['bull_flag', 'bear_flag'], 0, 'path', '', ['impulse_start', 'impulse_end', 'flag_end']),
  (['channel_up', 'channel_down', 'channel_flat'], 0, 'parallelChannel', '', ['base_start', 'base_end', 'offset']),
  (['rising_wedge', 'falling_wedge'], 0, 'trendline', ' upper', ['upper_start', 'upper_end']),
  (['rising_wedge', 'falling_wedge'], 1, 'trendline', ' lower', ['lower_start', 'lower_end']),
  (['abcd_bullish', 'abcd_bearish'], 0, 'abcd', '', ['A', 'B', 'C', 'D']), ({_HARMONICS}, 0, 'xabcd', '', ['X', 'A', 'B', 'C', 'D']),
  (['cup_handle'], 1, 'path', 'handle', ['right_rim', 'handle_low', 'handle_end']), (['cup_handle'], 2, 'horizontalLine', 'cup rim', ['right_rim']),
  (['rounding_bottom'], 1, 'horizontalLine', ' rim', ['rim_left']), (['gap_up', 'gap_down'], 0, 'rectangle', '', ['gap_low', 'gap_high'])"""

_SHAPES = f""",
specs(kinds, o, shape, label, roles) AS (VALUES {_SPECS}),
drawn AS (
  SELECT symbol, hit_no, p.kind, o, shape, CASE WHEN label = '' THEN p.kind WHEN label[1] = ' ' THEN p.kind || label ELSE label END AS label,
         list_transform(roles, lambda r: list_filter(pts, lambda x: x.role = r)[1]) AS ps
  FROM patterns p JOIN specs s ON list_contains(s.kinds, p.kind)
  UNION ALL
  SELECT symbol, hit_no, kind, k.o, 'trendline', kind || k.label, [q[1], q[-1]]
  FROM (SELECT p.*, k.o, k.label, list_filter(pts, lambda x: x.role = k.role) AS q FROM patterns p, (VALUES (0, ' upper', 'high'), (1, ' lower', 'low')) k(o, label, role)
        WHERE kind LIKE '%triangle') k WHERE len(q) >= 2
  UNION ALL
  SELECT symbol, hit_no, kind, 1, 'horizontalLine', kind || ' neckline', [CASE WHEN (a.price <= b.price) = (kind = 'triple_top') OR a.price = b.price THEN a ELSE b END]
  FROM (SELECT *, pts[2] AS a, pts[4] AS b FROM patterns WHERE kind LIKE 'triple%')
  UNION ALL
  SELECT symbol, hit_no, kind, 0, 'path', CASE WHEN kind = 'cup_handle' THEN 'cup' ELSE kind END, list_filter(pts, lambda x: x.role = 'arc')
  FROM patterns WHERE kind IN ('cup_handle', 'rounding_bottom')
  UNION ALL
  SELECT symbol, hit_no, kind, 8, 'horizontalLine', kind || ' target', [struct_pack(idx := 0::BIGINT, sec := list_max(list_transform(pts, lambda x: x.sec)), price := tgt, role := '')]
  FROM patterns WHERE tgt IS NOT NULL
  UNION ALL
  SELECT symbol, hit_no, kind, 9, 'horizontalLine', kind || ' invalidation', [struct_pack(idx := 0::BIGINT, sec := list_max(list_transform(pts, lambda x: x.sec)), price := inv, role := '')]
  FROM patterns WHERE inv IS NOT NULL
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, hit_no ORDER BY o) - 1 AS shape_no,
         CASE WHEN kind LIKE '%head_shoulders' THEN 'pattern-hs' WHEN kind LIKE 'double%' OR kind LIKE 'triple%' THEN 'pattern-double'
              WHEN kind LIKE '%triangle' THEN 'pattern-triangle' WHEN kind LIKE '%flag' THEN 'pattern-flag' WHEN kind LIKE 'channel%' THEN 'pattern-channel'
              WHEN kind LIKE '%wedge' THEN 'pattern-wedge' WHEN kind IN ('cup_handle', 'rounding_bottom') THEN 'pattern-cup'
              WHEN kind LIKE 'gap%' THEN 'pattern-gap' ELSE 'pattern-harmonic' END AS group_id
  FROM drawn WHERE len(list_filter(ps, lambda x: x IS NULL)) = 0
)"""
O["pattern_geometry"] = sql(
    WALK,
    FULL,
    ALL,
    _SHAPES,
    select="""SELECT symbol, hit_no, shape_no, group_id, shape, label, point_no, q.sec AS ts, round(q.price, 6) AS price
FROM (SELECT *, unnest(ps) AS q, unnest(range(len(ps))) AS point_no FROM placed)""",
)


def _money(x: str) -> str:
    return f"printf('%.2f', floor({x} * 100 + 0.5::DOUBLE) / 100)"


_LAYERS = f""",
lefts AS (SELECT symbol, max(sec) FILTER (WHERE i = greatest(0, n - 20)) AS left_ts FROM bars GROUP BY symbol),
shown AS (
  SELECT symbol, kind, inv FROM recent WHERE kind <> 'symmetric_triangle'
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY conf DESC, hit_no) = 1
),
layers AS (
  SELECT symbol, 0 AS o, v AS o2, 'horizontalLine' AS shape, 'S ' || {_money('v')} AS label, [struct_pack(ts := last_ts, price := v)] AS ps
  FROM (SELECT *, unnest(support) AS v FROM theses)
  UNION ALL SELECT symbol, 1, v, 'horizontalLine', 'R ' || {_money('v')}, [struct_pack(ts := last_ts, price := v)] FROM (SELECT *, unnest(resistance) AS v FROM theses)
  UNION ALL SELECT symbol, 2, 0, 'horizontalLine', 'POC ' || {_money('poc')}, [struct_pack(ts := last_ts, price := poc)] FROM theses WHERE poc > 0
  UNION ALL SELECT t.symbol, 3, 0, 'horizontalLine', kind || ' invalidation', [struct_pack(ts := last_ts, price := inv)] FROM theses t JOIN shown USING (symbol) WHERE inv IS NOT NULL
  UNION ALL SELECT t.symbol, 4, 0, 'rectangle', 'entry zone', [struct_pack(ts := left_ts, price := entry), struct_pack(ts := last_ts, price := entry - d * 0.25 * atr)]
  FROM theses t JOIN lefts USING (symbol) WHERE has AND atr > 0
  UNION ALL SELECT t.symbol, 5, 0, CASE WHEN d = 1 THEN 'longPosition' ELSE 'shortPosition' END, upper(verdict) || ' · R/R ' || {_num('rr', 2)},
    [struct_pack(ts := left_ts, price := entry), struct_pack(ts := left_ts, price := stop), struct_pack(ts := left_ts, price := target)]
  FROM theses t JOIN lefts USING (symbol) WHERE has
),
numbered_layers AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY o, o2) - 1 AS layer_no FROM layers)"""
O["thesis_layers"] = sql(
    WALK,
    FULL,
    _CONTEXT,
    _LAYERS,
    select="""SELECT symbol, layer_no, 'thesis' AS group_id, shape, label, point_no, q.ts AS ts, round(q.price, 6) AS price
FROM (SELECT *, unnest(ps) AS q, unnest(range(len(ps))) AS point_no FROM numbered_layers)""",
)
