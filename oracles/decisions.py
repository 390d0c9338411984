"""Segments, thesis, ranking, sizing, drawing and alerts."""

from __future__ import annotations

from oracles.base import BARS, EV, FULL, ORD, USER, WALK, sql
from oracles.indicators import _CROSS, _FLAGS, _TREND, _WIDTHS, AREA, CLUSTERS, LEVELS, PROFILE
from oracles.patterns import ALL

O: dict[str, str] = {}

BULL = """('inverse_head_shoulders', 'double_bottom', 'ascending_triangle', 'bull_flag', 'channel_up', 'falling_wedge', 'cup_handle',
 'abcd_bullish', 'gartley_bullish', 'bat_bullish', 'butterfly_bullish', 'crab_bullish', 'triple_bottom', 'rounding_bottom', 'gap_up')"""
BEAR = """('head_shoulders', 'double_top', 'descending_triangle', 'bear_flag', 'channel_down', 'rising_wedge', 'abcd_bearish',
 'gartley_bearish', 'bat_bearish', 'butterfly_bearish', 'crab_bearish', 'triple_top', 'gap_down')"""
NEUTRAL = "('symmetric_triangle', 'channel_flat')"


def _up(x: str, places: int) -> str:
    f = 10**places
    return f"(floor(({x}) * {f} + 0.5::DOUBLE) / {f})"


def _num(x: str, places: int) -> str:
    return f"regexp_replace(CAST({_up(x, places)} AS VARCHAR), '\\.0$', '')"


# Greedy joining of neighbouring segments; the cost of a join comes from prefix sums.
_PLR = """,
centred AS (SELECT symbol, i, close - avg(close) OVER (PARTITION BY symbol) AS y FROM bars),
prefix AS (
  SELECT symbol, count(*) AS n, list(p0 ORDER BY i) AS sy, list(p1 ORDER BY i) AS sxy, list(p2 ORDER BY i) AS syy
  FROM (SELECT symbol, i, sum(y) OVER w AS p0, sum(i * y) OVER w AS p1, sum(y * y) OVER w AS p2 FROM centred
        WINDOW w AS (PARTITION BY symbol ORDER BY i)) GROUP BY symbol
),
joins AS (
  SELECT symbol, n, sy, sxy, syy, range(n) AS b FROM prefix
  UNION ALL
  SELECT symbol, n, sy, sxy, syy, list_concat(b[:k], b[k + 2:]) FROM (
    SELECT *, list_position(cost, list_min(cost)) AS k FROM (
      SELECT *, list_transform(range(2, len(b)), lambda j: (
          syy[b[j+1]+1] - coalesce(syy[b[j-1]], 0) - (sy[b[j+1]+1] - coalesce(sy[b[j-1]], 0)) ** 2 / (b[j+1] - b[j-1] + 1)
          - (sxy[b[j+1]+1] - coalesce(sxy[b[j-1]], 0) - (sy[b[j+1]+1] - coalesce(sy[b[j-1]], 0)) * (b[j+1] + b[j-1]) / 2.0::DOUBLE) ** 2
            / ((b[j+1] - b[j-1] + 1.0::DOUBLE) * ((b[j+1] - b[j-1] + 1.0::DOUBLE) ** 2 - 1) / 12))) AS cost
      FROM joins WHERE len(b) > 9))
),
cuts AS (SELECT symbol, unnest(b[:-2]) AS f, unnest(b[2:]) AS t, unnest(range(len(b) - 1)) AS no FROM joins WHERE len(b) <= 9),
segs AS (
  SELECT c.symbol, c.no, a.sec AS from_ts, z.sec AS to_ts, a.close AS p0, z.close AS p1, (z.close - a.close) / a.close * 100 AS mag,
         (z.close - a.close) / (z.i - a.i) / m.mean * 100 AS slope, z.i - a.i + 1 AS k
  FROM cuts c JOIN bars a ON a.symbol = c.symbol AND a.i = c.f JOIN bars z ON z.symbol = c.symbol AND z.i = c.t
  JOIN (SELECT symbol, avg(close) AS mean FROM bars GROUP BY symbol) m ON m.symbol = c.symbol
)"""
O["plr_segments"] = sql(
    WALK,
    BARS,
    _PLR,
    select="""SELECT symbol, no AS seg_no, from_ts, to_ts, round(p0, 6) AS from_price, round(p1, 6) AS to_price,
  CASE WHEN abs(mag) < 0.5 OR abs(slope) < 0.05 THEN 'consolidation' WHEN abs(mag) >= 2 THEN 'impulse' ELSE 'correction' END AS kind,
  round(mag, 6) AS magnitude_pct, k AS candle_count FROM segs""",
)

_CONTEXT = (
    _TREND
    + _WIDTHS
    + _CROSS
    + _FLAGS
    + CLUSTERS
    + LEVELS
    + PROFILE
    + AREA
    + ALL
    + """,
latest_divs AS (
  SELECT symbol, count(*) FILTER (WHERE kind IN ('bullish', 'hidden_bullish')) AS bulls,
         count(*) FILTER (WHERE kind IN ('bearish', 'hidden_bearish')) AS bears
  FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY b_sec DESC, no) <= 3) GROUP BY symbol
),
sides AS (
  SELECT symbol, list(price ORDER BY price) FILTER (WHERE side = 'support') AS support,
         list(price ORDER BY price) FILTER (WHERE side = 'resistance') AS resistance FROM level_rows GROUP BY symbol
),
tf AS (SELECT symbol, max(CASE WHEN i = 1 THEN sec - psec END) AS tf FROM bars GROUP BY symbol),
ctx AS (
  SELECT c.symbol, c.n, c.last_close AS px, c.first_ts, c.last_ts, t.direction, tr.r2, coalesce(i.rsi, 50) AS rsi, i.hist, x.macd_cross, a.poc, a.vah, a.val,
         coalesce(s.support, []) AS support, coalesce(s.resistance, []) AS resistance, coalesce(bulls, 0) AS bulls, coalesce(bears, 0) AS bears,
         coalesce(w.atr, 0) AS atr, tr.pct,
         w.squeeze, CASE WHEN k >= 2 AND w > mean * 1.15 THEN 'expanding' WHEN k >= 2 AND w < mean * 0.85 THEN 'contracting' ELSE 'stable' END AS vstate, tf.tf
  FROM scale c JOIN trends t USING (symbol) JOIN trend tr USING (symbol) JOIN ind i ON i.symbol = c.symbol AND i.i = c.n - 1
  JOIN cross_now x ON x.symbol = c.symbol JOIN area a ON a.symbol = c.symbol JOIN widths w ON w.symbol = c.symbol JOIN tf ON tf.symbol = c.symbol
  LEFT JOIN sides s ON s.symbol = c.symbol LEFT JOIN latest_divs d ON d.symbol = c.symbol
),
kinds AS (
  SELECT symbol, kind, min(hit_no) AS seen, max(conf) AS conf, arg_min(tgt, (hit_no + 1) - conf * 1000000) AS tgt,
         arg_min(inv, (hit_no + 1) - conf * 1000000) AS inv FROM recent GROUP BY symbol, kind
)"""
    + f""",
lead_hit AS (
  SELECT * FROM kinds WHERE kind NOT IN {NEUTRAL} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY conf DESC, seen) = 1
),
ev AS (
  SELECT symbol, 'bull' AS side, 0 AS o, 'uptrend' AS factor, {_up('0.3 * r2', 3)} AS weight, 'uptrend r²=' || {_num('r2', 2)} AS detail FROM ctx WHERE direction = 'up' AND r2 > 0
  UNION ALL SELECT symbol, 'bear', 0, 'downtrend', {_up('0.3 * r2', 3)}, 'downtrend r²=' || {_num('r2', 2)} FROM ctx WHERE direction = 'down' AND r2 > 0
  UNION ALL SELECT symbol, 'bull', 1, 'rsi_oversold', 0.2, 'RSI ' || {_num('rsi', 1)} || ' oversold' FROM ctx WHERE rsi <= 30
  UNION ALL SELECT symbol, 'bear', 1, 'rsi_overbought', 0.2, 'RSI ' || {_num('rsi', 1)} || ' overbought' FROM ctx WHERE rsi >= 70
  UNION ALL SELECT symbol, 'bull', 2, 'macd_bull_cross', 0.15, 'recent MACD bullish cross' FROM ctx WHERE macd_cross = 'bullish'
  UNION ALL SELECT symbol, 'bear', 2, 'macd_bear_cross', 0.15, 'recent MACD bearish cross' FROM ctx WHERE macd_cross = 'bearish'
  UNION ALL SELECT symbol, 'bull', 3, 'bullish_divergence', 0.25, bulls || ' recent bullish divergence(s)' FROM ctx WHERE bulls > 0
  UNION ALL SELECT symbol, 'bear', 3, 'bearish_divergence', 0.25, bears || ' recent bearish divergence(s)' FROM ctx WHERE bears > 0
  UNION ALL SELECT symbol, 'bull', 4, 'above_poc', 0.15, 'price above POC ' || {_num('poc', 2)} FROM ctx WHERE poc > 0 AND px >= poc
  UNION ALL SELECT symbol, 'bear', 4, 'below_poc', 0.15, 'price below POC ' || {_num('poc', 2)} FROM ctx WHERE poc > 0 AND px < poc
  UNION ALL SELECT symbol, 'bull', 5, 'at_support', 0.12, 'holding support ' || {_num('lv', 2)}
    FROM (SELECT *, list_filter(support, lambda s: abs(px - s) / px <= 0.015)[1] AS lv FROM ctx) WHERE lv IS NOT NULL
  UNION ALL SELECT symbol, 'bear', 5, 'at_resistance', 0.12, 'capped at resistance ' || {_num('lv', 2)}
    FROM (SELECT *, list_filter(resistance, lambda s: abs(px - s) / px <= 0.015)[1] AS lv FROM ctx) WHERE lv IS NOT NULL
  UNION ALL SELECT symbol, CASE WHEN kind IN {BULL} THEN 'bull' ELSE 'bear' END, 10 + seen, kind, {_up('0.3 * conf', 3)}, kind || ' (conf ' || {_num('conf', 2)} || ')'
    FROM kinds WHERE kind NOT IN {NEUTRAL}
),
sums AS (
  SELECT c.symbol, coalesce(list_reduce(list(CAST(weight AS DOUBLE) ORDER BY o) FILTER (WHERE side = 'bull'), lambda a, b: a + b), 0) AS bull,
         coalesce(list_reduce(list(CAST(weight AS DOUBLE) ORDER BY o) FILTER (WHERE side = 'bear'), lambda a, b: a + b), 0) AS bear
  FROM ctx c LEFT JOIN ev USING (symbol) GROUP BY c.symbol
),
votes AS (
  SELECT *, CASE WHEN bull - bear > 0.15::DOUBLE THEN 'bullish' WHEN bull - bear < -0.15::DOUBLE THEN 'bearish' ELSE 'neutral' END AS bias,
         {_up('CASE WHEN bull + bear > 0 THEN abs(bull - bear) / (bull + bear) ELSE 0 END * least((bull + bear) / 0.6::DOUBLE, 1)', 2)} AS conf
  FROM sums
),
cand AS (
  SELECT c.*, v.bias, v.conf, v.bull, v.bear, l.kind AS tk, l.tgt AS tt, l.inv AS ti, CASE WHEN v.bias = 'bullish' THEN 1 ELSE -1 END AS d,
         list_filter(list_concat(support, [val, poc]), lambda s: s > 0 AND s < px) AS below,
         list_filter(list_concat(resistance, [vah, poc]), lambda s: s > 0 AND s > px) AS above
  FROM ctx c JOIN votes v USING (symbol) LEFT JOIN lead_hit l ON l.symbol = c.symbol
),
stopped AS (
  SELECT *, coalesce(CASE WHEN d = 1 THEN list_max(below) ELSE list_min(above) END, CASE WHEN atr > 0 THEN px - d * 1.5 * atr END) AS raw_stop,
         CASE WHEN d = 1 THEN list_min(above) ELSE list_max(below) END AS ahead,
         coalesce(CASE WHEN d = 1 THEN tk IN {BULL} AND tt > px ELSE tk IN {BEAR} AND tt < px END, false) AS measured
  FROM cand WHERE bias <> 'neutral'
),
clamped AS (
  SELECT *, coalesce(atr > 0 AND d * (px - raw_stop) > least(3 * atr, 0.08 * px), false) AS far FROM stopped
),
aimed AS (
  SELECT *, CASE WHEN far THEN px - d * 1.5 * atr ELSE raw_stop END AS stop FROM clamped
),
targeted AS (
  SELECT *, CASE WHEN measured THEN tt ELSE coalesce(ahead, px + d * greatest(2 * d * (px - stop), 3 * atr)) END AS target,
         CASE WHEN measured THEN tk || ' target' WHEN ahead IS NOT NULL THEN CASE WHEN d = 1 THEN 'support→resistance' ELSE 'resistance→support' END
              ELSE 'measured move' END || CASE WHEN far THEN ' [ATR stop: structure too far]' ELSE '' END AS basis
  FROM aimed
),
setups AS (
  SELECT symbol, {_up('px', 4)} AS entry, {_up('stop', 4)} AS stop, {_up('target', 4)} AS target,
         {_up('(d * (target - px)) / (d * (px - stop))', 2)} AS rr, basis
  FROM targeted WHERE px > 0 AND d * (px - raw_stop) > 0 AND d * (target - px) > 0 AND target > 0 AND d * (target - px) / (d * (px - stop)) >= 1
),
theses AS (
  SELECT c.*, s.entry, s.stop, s.target, s.rr, s.basis, s.symbol IS NOT NULL AS has,
         CASE WHEN s.symbol IS NULL THEN 'stand_aside' WHEN bias = 'bullish' THEN 'long' ELSE 'short' END AS verdict,
         CASE WHEN bias <> 'neutral' AND s.symbol IS NULL THEN {_up('conf * 0.5::DOUBLE', 2)} ELSE conf END AS confidence,
         CASE WHEN s.symbol IS NOT NULL THEN {_up('coalesce(nullif(ti, 0), s.stop)', 4)} END AS inv_price,
         CASE WHEN s.symbol IS NOT NULL THEN CASE WHEN nullif(ti, 0) IS NOT NULL THEN tk || ' invalidation' ELSE 'structural stop' END END AS inv_reason
  FROM cand c LEFT JOIN setups s ON s.symbol = c.symbol
)"""
)


def _ctx(view: str, select: str) -> str:
    return sql(view, FULL, _CONTEXT, select=select)


_HORIZON = "CASE WHEN coalesce(tf, 0) = 0 THEN 'swing' WHEN tf < 3600 THEN 'intraday' WHEN tf < 86400 THEN 'swing' ELSE 'position' END"

O["market_summary_rows"] = _ctx(
    WALK,
    """SELECT c.symbol, n AS candle_count, tf AS timeframe_seconds, first_ts, last_ts, round(px, 6) AS last_price, direction,
  round(r2, 6) AS strength, round(pct, 6) AS slope_pct, least(8, n - 1)::BIGINT AS segments, len(support) AS supports, len(resistance) AS resistances,
  round(poc, 6) AS poc, round(rsi, 6) AS rsi, macd_cross, round(atr, 6) AS atr, vstate AS volatility_state,
  (SELECT count(*) FROM patterns p WHERE p.symbol = c.symbol) AS patterns FROM ctx c""",
)
O["evidence"] = _ctx(
    WALK,
    """SELECT symbol, side, row_number() OVER (PARTITION BY symbol, side ORDER BY o) - 1 AS no, factor, round(CAST(weight AS DOUBLE), 6) AS weight, detail FROM ev""",
)
O["verdict"] = _ctx(
    USER,
    "SELECT symbol, bias, round(conf, 6) AS confidence, round(bull, 6) AS bull_score, round(bear, 6) AS bear_score FROM votes",
)
O["trade_setup"] = _ctx(
    USER,
    """SELECT symbol, verdict, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, round(rr, 6) AS rr, basis
FROM theses WHERE has""",
)
O["stand_aside_guard"] = _ctx(
    USER,
    """SELECT symbol, bias, verdict, round(confidence, 6) AS confidence, round(inv_price, 6) AS price, inv_reason AS reason FROM theses""",
)
O["thesis"] = _ctx(
    WALK,
    f"""SELECT t.symbol, bias, verdict, round(confidence, 6) AS confidence, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target,
  round(rr, 6) AS rr, basis, round(inv_price, 6) AS invalidation_price, {_HORIZON} AS horizon,
  concat_ws('; ', CASE WHEN NOT (direction IN ('up', 'down') AND r2 > 0) THEN 'no clear trend (ranging)' END,
    (SELECT string_agg(replace(kind, '_', ' ') || ' — await breakout', '; ' ORDER BY seen) FROM kinds k WHERE k.symbol = t.symbol AND kind IN {NEUTRAL}),
    CASE WHEN squeeze THEN 'Bollinger squeeze — volatility expansion likely' WHEN vstate = 'expanding' THEN 'volatility expanding' END,
    CASE WHEN bias <> 'neutral' AND NOT has THEN 'no clean setup at acceptable R/R — standing aside' END) AS notes,
  coalesce((SELECT string_agg(factor, '; ' ORDER BY weight DESC, o) FROM (SELECT * FROM ev e WHERE e.symbol = t.symbol AND side = 'bull' ORDER BY weight DESC, o LIMIT 5)), '') AS bull,
  coalesce((SELECT string_agg(factor, '; ' ORDER BY weight DESC, o) FROM (SELECT * FROM ev e WHERE e.symbol = t.symbol AND side = 'bear' ORDER BY weight DESC, o LIMIT 5)), '') AS bear
FROM theses t""",
)
O["rank_setups_failed"] = """SELECT event_type || '-' || CAST(floor(value / 25) AS BIGINT) AS symbol, count(*) AS rows, 'no bar with ts and OHLC' AS reason
FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value >= 1 AND value <= 150) = 0"""
O["rank_setups_users"] = _ctx(
    USER,
    """SELECT symbol, verdict, round(confidence, 6) AS confidence, round(coalesce(rr * confidence, 0), 6) AS score, round(rr, 6) AS rr FROM theses""",
)


def _horizons(view: str) -> str:
    return (
        "SELECT symbol, "
        + _HORIZON
        + " AS horizon FROM ("
        + sql(view, BARS, select="SELECT symbol, max(CASE WHEN i = 1 THEN sec - psec END) AS tf FROM bars GROUP BY symbol")
        + ")"
    )


O["horizon_by_symbol"] = "\nUNION ALL\n".join(_horizons(v) for v in (EV, USER, ORD))

O["position_size"] = """WITH plans AS (
  SELECT o_orderkey, 1000000.0::DOUBLE AS account_size, (o_custkey % 10 + 1)::DOUBLE AS risk_pct, o_totalprice AS entry_price,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.02::DOUBLE ELSE o_totalprice * 0.98::DOUBLE END AS stop_loss,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 1.05::DOUBLE END AS target_price, 1.5::DOUBLE AS commission_per_side FROM orders
),
d AS (SELECT *, abs(entry_price - stop_loss) AS stop_distance, account_size * risk_pct / 100 AS max_dollar_risk, abs(target_price - entry_price) AS reward FROM plans),
s AS (SELECT *, CAST(floor(max_dollar_risk / stop_distance) AS BIGINT) AS shares FROM d)
SELECT o_orderkey, account_size, risk_pct, round(entry_price, 6) AS entry_price, round(stop_loss, 6) AS stop_loss, round(target_price, 6) AS target_price,
  commission_per_side, round(stop_distance, 6) AS stop_distance, round(max_dollar_risk, 6) AS max_dollar_risk, shares,
  CASE WHEN entry_price > stop_loss THEN 'long' ELSE 'short' END AS side, round(shares * entry_price, 6) AS position_value,
  round(shares * stop_distance + commission_per_side * 2, 6) AS actual_dollar_risk, round(reward / stop_distance, 6) AS risk_reward,
  round(shares * reward - commission_per_side * 2, 6) AS potential_profit,
  round(shares * entry_price / account_size * 100, 6) AS position_pct_of_account,
  round((shares * stop_distance + commission_per_side * 2) / account_size * 100, 6) AS risk_pct_of_account,
  round(100 / (1 + reward / stop_distance), 6) AS breakeven_winrate_pct
FROM s"""

O["price_alerts"] = sql(
    EV,
    BARS,
    """,
rules AS (
  SELECT t.symbol, (20 + 4 * n_nationkey)::DOUBLE AS alert_price, CASE n_regionkey WHEN 0 THEN 'above' WHEN 1 THEN 'below' ELSE 'cross' END AS direction, n_name AS note
  FROM nation, (SELECT DISTINCT event_type AS symbol FROM events) t
)""",
    select="""SELECT symbol, sec AS ts, alert_price, direction, note, round(pc, 6) AS prev_close, round(close, 6) AS close
FROM bars JOIN rules USING (symbol)
WHERE (direction <> 'below' AND pc <= alert_price AND close > alert_price) OR (direction <> 'above' AND pc >= alert_price AND close < alert_price)""",
)
