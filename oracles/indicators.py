"""Sources, indicators and summaries."""

from __future__ import annotations

from oracles.base import (
    BARS,
    BARS_TICKS,
    EV,
    LINES,
    FULL,
    ORD,
    PREP,
    RECURSION,
    SCALE,
    SWINGS,
    TICK_BARS,
    USER,
    WALK,
    pivot_high,
    pivot_low,
    sql,
)

IND = (WALK, BARS, PREP, RECURSION)
O: dict[str, str] = {}

_OHLC = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume"

O["load_candles"] = sql(
    EV, select=f"SELECT symbol, sec AS ts, {_OHLC}, 'events' AS source, '1h' AS timeframe FROM raw_bars"
)

_QUOTES = """
quotes AS (
  SELECT event_type AS symbol, ts, CASE WHEN value >= 1 THEN value END AS open,
         CASE WHEN value <= 150 THEN value END AS high, value AS low, value AS close,
         CASE WHEN value <= 100 THEN value END AS volume
  FROM events
)"""
O["validate_candles_split"] = sql(
    _QUOTES,
    select="""SELECT symbol, CASE WHEN ts IS NULL THEN 'ts' WHEN open IS NULL THEN 'open' WHEN high IS NULL THEN 'high'
       WHEN low IS NULL THEN 'low' WHEN close IS NULL THEN 'close' ELSE 'none' END AS missing_field,
  count(*) AS rows, round(sum(low), 6) AS low_sum FROM quotes GROUP BY 1, 2""",
)
O["clean_quotes_rows"] = sql(
    _QUOTES,
    select="""SELECT symbol, CAST(floor(epoch(ts)) AS BIGINT) AS ts, round(open, 6) AS open, round(high, 6) AS high,
  round(low, 6) AS low, round(close, 6) AS close, round(coalesce(volume, 0), 6) AS volume
FROM quotes WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""",
)
O["resample_candles_4h"] = sql(
    EV,
    select="""SELECT symbol, CAST(floor(sec / 14400.0) * 14400 AS BIGINT) AS ts, round(first(open ORDER BY sec), 6) AS open,
  round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY sec), 6) AS close,
  round(sum(volume), 6) AS volume FROM raw_bars GROUP BY 1, 2""",
)
O["resample_orders_daily"] = sql(ORD, select=f"SELECT symbol, sec AS ts, {_OHLC} FROM raw_bars")
O["tail_lookback_500"] = sql(
    EV,
    select=f"""SELECT symbol, sec AS ts, {_OHLC} FROM raw_bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sec DESC) <= 500""",
)
O["infer_timeframe_users"] = sql(
    USER, BARS, select="SELECT symbol, max(CASE WHEN i = 1 THEN sec - psec END) AS timeframe_seconds FROM bars GROUP BY symbol"
)


def _ind(columns: str) -> str:
    return sql(*IND, select=f"SELECT symbol, i AS bar_idx, {columns} FROM ind")


def _ticks(columns: str) -> str:
    return sql(TICK_BARS, BARS_TICKS, PREP, RECURSION, select=f"SELECT symbol, i AS bar_idx, {columns} FROM ind")


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


O["true_range"] = sql(WALK, BARS, PREP, select=f"SELECT symbol, i AS bar_idx, {_r('tr', 'true_range')} FROM prep")
O["atr"] = _ind(_r("atr14", "atr_14"))
O["atr_ticks"] = _ticks(_r("atr14", "atr_14"))
O["sma"] = _ind(_r("sma20", "sma_20"))
O["rolling_std"] = _ind(_r("sd20", "std_20"))
_BOLL = (
    f"{_r('sma20 + 2 * sd20', 'boll_upper')}, {_r('sma20', 'boll_middle')}, {_r('sma20 - 2 * sd20', 'boll_lower')}"
)
O["bollinger"] = _ind(_BOLL)
O["keltner"] = _ind(f"{_r('sma20 + 1.5 * atr20', 'keltner_upper')}, {_r('sma20 - 1.5 * atr20', 'keltner_lower')}")
_SQUEEZE = (
    "coalesce(i >= 20 AND sma20 + 2 * sd20 < sma20 + 1.5 * atr20 AND sma20 - 2 * sd20 > sma20 - 1.5 * atr20, false)"
)
O["bb_squeeze"] = _ind(f"{_SQUEEZE} AS bb_squeeze")
O["ema"] = _ind(_r("e20", "ema_20"))
O["ema_ticks"] = _ticks(_r("e20", "ema_20"))
O["macd"] = _ind(f"{_r('macd', 'macd')}, {_r('sig', 'macd_signal')}, {_r('hist', 'macd_hist')}")
O["rsi"] = _ind(_r("rsi", "rsi_14"))
O["rsi_ticks"] = _ticks(_r("rsi", "rsi_14"))

_RVOL = """,
rets AS (SELECT *, CASE WHEN close / nullif(pc, 0) > 0 THEN ln(close / pc) END AS ret FROM bars),
rvol AS (
  SELECT symbol, i, CASE WHEN i >= 20 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY i
    ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) * 100 END AS rv FROM rets
)"""
O["realized_vol"] = sql(WALK, BARS, _RVOL, select=f"SELECT symbol, i AS bar_idx, {_r('rv', 'realized_vol')} FROM rvol")

_CROSS = """,
crosses AS (
  SELECT symbol, i, n, CASE WHEN was <= 0 AND hist > 0 THEN 'bullish' WHEN was >= 0 AND hist < 0 THEN 'bearish' END AS flag
  FROM (SELECT *, lag(hist) OVER (PARTITION BY symbol ORDER BY i) AS was FROM ind)
),
cross_now AS (
  SELECT symbol, coalesce(arg_min(flag, i) FILTER (WHERE flag IS NOT NULL AND i >= n - 3), 'none') AS macd_cross
  FROM crosses GROUP BY symbol
)"""
O["macd_cross"] = sql(*IND, _CROSS, select="SELECT symbol, macd_cross FROM cross_now")
O["vol_stats"] = sql(
    *IND,
    _RVOL,
    select=f"""SELECT symbol, {_r('close', 'last')}, {_r('(close - pc) / pc * 100', 'day_change_pct')},
  {_r('atr14', 'atr')}, {_r('atr14 / close * 100', 'atr_pct')}, {_r('rv', 'realized_vol')}
FROM ind JOIN rvol USING (symbol, i) WHERE i = n - 1""",
)

_EMA = {p: _r(f"e{p}", f"ema_{p}") for p in (9, 20, 21, 50, 200)}
_RSI, _HIST, _VOL = _r("rsi", "rsi_14"), _r("hist", "macd_hist"), _r("volume", "volume")
O["preset_trend_analysis"] = _ind(", ".join([_EMA[20], _EMA[50], _EMA[200], _RSI, _VOL]))
O["preset_scalping"] = _ind(", ".join([_EMA[9], _EMA[21], _HIST, _VOL]))
O["preset_swing_trading"] = _ind(", ".join([_EMA[50], _EMA[200], _HIST, _RSI, _r("atr14", "atr_14"), _VOL]))
O["preset_institutional"] = _ind(", ".join([_EMA[20], _EMA[50], _RSI, _HIST, _VOL]))
O["preset_momentum"] = _ind(
    ", ".join(
        [_EMA[9], _EMA[21], _RSI, _r("sma20 + 2 * sd20", "boll_upper"), _r("sma20 - 2 * sd20", "boll_lower"), _VOL]
    )
)
O["preset_clean"] = sql(WALK, BARS, select=f"SELECT symbol, i AS bar_idx, {_r('close', 'close')}, {_VOL} FROM bars")



def _setup(seconds: int, lookback: int, columns: str) -> str:
    view = WALK.replace("3600", str(seconds)).replace("raw_bars AS", "all_bars AS")
    last = f""",
raw_bars AS (SELECT * FROM all_bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sec DESC) <= {lookback})"""
    return sql(view, last, BARS, PREP, RECURSION, select=f"SELECT symbol, sec AS ts, i AS bar_idx, {columns} FROM ind")


O["setup_swing_trading"] = _setup(14400, 500, ", ".join([_EMA[50], _EMA[200], _HIST, _RSI, _r("atr14", "atr_14"), _VOL]))
O["setup_institutional"] = _setup(3600, 500, ", ".join([_EMA[20], _EMA[50], _RSI, _HIST, _VOL]))
O["setup_clean"] = _setup(3600, 200, f"{_r('close', 'close')}, {_VOL}")

O["suffix_extrema_bars"] = sql(
    WALK,
    select="""SELECT symbol, sec AS ts, round(min(low) OVER w, 6) AS suffix_min_low, round(max(high) OVER w, 6) AS suffix_max_high
FROM raw_bars WINDOW w AS (PARTITION BY symbol ORDER BY sec ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
)
O["min_reversal"] = sql(
    *IND,
    SCALE,
    select="""SELECT symbol, round(atr, 6) AS last_atr,
  round(CASE WHEN atr > 0 THEN atr ELSE last_close * 0.005 END, 6) AS min_reversal FROM scale""",
)
O["min_reversal_scaled"] = O["min_reversal"].replace(WALK, USER).replace("THEN atr ELSE last_close * 0.005", "THEN atr * 2.5 ELSE last_close * 0.01")

# ── summaries ───────────────────────────────────────────────────────────────

_TREND = """,
fits AS (
  SELECT symbol, count(*) AS n, regr_slope(close, i) AS slope, regr_r2(close, i) AS r2, avg(close) AS mean,
         var_pop(close) AS var FROM bars GROUP BY symbol
),
trend AS (
  SELECT symbol, n, slope, CASE WHEN n < 2 OR var = 0 THEN 0 ELSE coalesce(r2, 0) END AS r2,
         coalesce(slope / nullif(mean, 0) * 100, 0) AS pct FROM fits
),
trends AS (
  SELECT symbol, CASE WHEN r2 < 0.2 OR abs(pct) < 0.05 THEN 'sideways' WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction,
         round(r2, 6) AS strength, n AS duration_candles, round(pct, 6) AS slope_pct_per_candle FROM trend
)"""
O["trend_summary"] = sql(WALK, BARS, _TREND, select="SELECT * FROM trends")
O["trending_with_bands"] = sql(
    WALK,
    BARS,
    PREP,
    _TREND,
    select="""SELECT t.*, round(4 * p.sd, 6) AS band_width, round(p.close, 6) AS last
FROM trends t JOIN prep p ON p.symbol = t.symbol AND p.i = p.n - 1""",
)
O["line_fit"] = """SELECT o_custkey, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(o_totalprice, o_orderkey) END, 6) AS slope,
  round(CASE WHEN count(*) < 2 THEN avg(o_totalprice) ELSE regr_intercept(o_totalprice, o_orderkey) END, 6) AS intercept,
  round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_r2(o_totalprice, o_orderkey) END, 6) AS r2 FROM orders GROUP BY o_custkey"""
O["quad_fit"] = sql(
    WALK,
    BARS,
    """,
w AS (SELECT symbol, low AS y, i, (min(i) OVER (PARTITION BY symbol) + max(i) OVER (PARTITION BY symbol)) / 2.0::DOUBLE AS x0
      FROM bars),
d AS (SELECT *, i - x0 AS x FROM w),
s AS (SELECT symbol, any_value(x0) AS x0, count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4,
             sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2, avg(y) AS mean FROM d GROUP BY symbol),
e AS (SELECT *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) AS dd FROM s),
c AS (SELECT symbol, x0, mean,
             (t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0)) / dd AS a,
             (s4*(t1*s0 - t0*s1) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - t1*s2)) / dd AS b,
             (s4*(s2*t0 - s1*t1) - s3*(s3*t0 - s2*t1) + t2*(s3*s1 - s2*s2)) / dd AS k FROM e)""",
    select="""SELECT c.symbol, round(any_value(a), 6) AS a,
  round(1 - sum((y - (a*x*x + b*x + k))**2) / sum((y - mean)**2), 6) AS r2,
  round(any_value(c.x0 - b / (2*a)), 6) AS vertex FROM d JOIN c USING (symbol) GROUP BY c.symbol""",
)
_WIDTHS = """,
widths AS (
  SELECT symbol, count(sd20) FILTER (WHERE i >= n - 21) AS k, avg(4 * sd20) FILTER (WHERE i >= n - 21) AS mean,
         coalesce(max(4 * sd20) FILTER (WHERE i = n - 1), 0) AS w, max(close) FILTER (WHERE i = n - 1) AS close,
         max(atr14) FILTER (WHERE i = n - 1) AS atr,
"""
_WIDTHS += f"         bool_or({_SQUEEZE}) FILTER (WHERE i = n - 1) AS squeeze FROM ind GROUP BY symbol\n)"
O["volatility_summary"] = sql(
    *IND,
    _WIDTHS,
    select="""SELECT symbol, round(coalesce(atr, 0), 6) AS atr, round(atr / close * 100, 6) AS atr_pct, squeeze AS bb_squeeze,
  round(w / close * 100, 6) AS bb_width_pct,
  CASE WHEN k >= 2 AND w > mean * 1.15 THEN 'expanding' WHEN k >= 2 AND w < mean * 0.85 THEN 'contracting' ELSE 'stable' END AS state
FROM widths""",
)

_DIV_PARTS = []
for _name, _x in (("rsi", "rsi"), ("macd", "macd")):
    for _side in ("low", "high"):
        _DIV_PARTS.append((_name, _x, _side))

_FLAGS = f""",
pv AS (
  SELECT symbol, i, sec, close, rsi, macd,
         {pivot_high('close')} AS ch, {pivot_low('close')} AS cl, {pivot_high('rsi')} AS rh, {pivot_low('rsi')} AS rl,
         {pivot_high('macd')} AS mh, {pivot_low('macd')} AS ml
  FROM ind
),
price_pv AS (
  SELECT symbol, 'high' AS side, i, sec, close AS v FROM pv WHERE ch UNION ALL SELECT symbol, 'low', i, sec, close FROM pv WHERE cl
),
ind_pv AS (
  SELECT symbol, 'rsi' AS indicator, 'high' AS side, i, sec, rsi AS v FROM pv WHERE rh
  UNION ALL SELECT symbol, 'rsi', 'low', i, sec, rsi FROM pv WHERE rl
  UNION ALL SELECT symbol, 'macd', 'high', i, sec, macd FROM pv WHERE mh
  UNION ALL SELECT symbol, 'macd', 'low', i, sec, macd FROM pv WHERE ml
),
matched AS (
  SELECT p.symbol, p.side, p.i, p.sec, p.v, q.indicator, arg_min(q.i, abs(q.i - p.i) * 100000000 + q.i) AS mi,
         arg_min(q.sec, abs(q.i - p.i) * 100000000 + q.i) AS msec, arg_min(q.v, abs(q.i - p.i) * 100000000 + q.i) AS mv
  FROM price_pv p JOIN ind_pv q ON q.symbol = p.symbol AND q.side = p.side AND abs(q.i - p.i) <= 6
  GROUP BY ALL
),
consecutive AS (
  SELECT symbol, side, i, sec, v, lag(i) OVER w AS i0 FROM price_pv WINDOW w AS (PARTITION BY symbol, side ORDER BY i)
),
pairs AS (
  SELECT a.symbol, a.side, b.indicator, a.i AS a_i, a.sec AS a_sec, a.v AS a_v, b.i AS b_i, b.sec AS b_sec, b.v AS b_v,
         a.msec AS am_sec, a.mv AS am_v, b.msec AS bm_sec, b.mv AS bm_v
  FROM consecutive c
  JOIN matched a ON a.symbol = c.symbol AND a.side = c.side AND a.i = c.i0
  JOIN matched b ON b.symbol = c.symbol AND b.side = c.side AND b.i = c.i AND b.indicator = a.indicator
),
divs AS (
  SELECT *, CASE
      WHEN side = 'low' AND b_v < a_v AND bm_v > am_v THEN 'bullish'
      WHEN side = 'low' AND b_v > a_v AND bm_v < am_v THEN 'hidden_bullish'
      WHEN side = 'high' AND b_v > a_v AND bm_v < am_v THEN 'bearish'
      WHEN side = 'high' AND b_v < a_v AND bm_v > am_v THEN 'hidden_bearish' END AS kind
  FROM pairs
),
found AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY indicator = 'macd', side = 'high', b_i) AS no
  FROM divs WHERE kind IS NOT NULL
)"""
O["divergences"] = sql(
    *IND,
    _FLAGS,
    select="""SELECT symbol, indicator, kind, a_sec AS p1_ts, round(a_v, 6) AS p1, b_sec AS p2_ts, round(b_v, 6) AS p2,
  am_sec AS i1_ts, round(am_v, 6) AS i1, bm_sec AS i2_ts, round(bm_v, 6) AS i2 FROM found""",
)
O["nearest_pivot"] = sql(
    *IND,
    _FLAGS,
    select="""SELECT symbol, i AS idx, mi AS match_idx, round(mv, 6) AS value FROM matched
WHERE side = 'low' AND indicator = 'rsi'""",
)
O["nearest_pivot_sides"] = sql(
    *IND,
    _FLAGS,
    select="SELECT symbol, indicator, side AS kind, i AS idx, mi AS match_idx, round(mv, 6) AS value FROM matched",
)
O["momentum_recent"] = sql(
    *IND,
    _FLAGS,
    select="""SELECT symbol, row_number() OVER w - 1 AS no, kind, indicator, b_sec AS ts, round(b_v, 6) AS price FROM found
WINDOW w AS (PARTITION BY symbol ORDER BY b_sec DESC, no) QUALIFY row_number() OVER w <= 3""",
)
O["momentum_summary"] = sql(
    *IND,
    _CROSS,
    _FLAGS,
    """,
counts AS (
  SELECT symbol, count(*) AS c, count(*) FILTER (WHERE kind = 'bullish') AS bullish,
         count(*) FILTER (WHERE kind = 'bearish') AS bearish, count(*) FILTER (WHERE kind = 'hidden_bullish') AS hidden_bullish,
         count(*) FILTER (WHERE kind = 'hidden_bearish') AS hidden_bearish FROM found GROUP BY symbol
)""",
    select="""SELECT i.symbol, round(coalesce(rsi, 50), 6) AS rsi,
  CASE WHEN coalesce(rsi, 50) >= 70 THEN 'overbought' WHEN coalesce(rsi, 50) <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_state,
  macd_cross, round(hist, 6) AS macd_histogram, coalesce(c, 0) AS divergence_count, coalesce(bullish, 0) AS bullish,
  coalesce(bearish, 0) AS bearish, coalesce(hidden_bullish, 0) AS hidden_bullish, coalesce(hidden_bearish, 0) AS hidden_bearish
FROM ind i JOIN cross_now USING (symbol) LEFT JOIN counts USING (symbol) WHERE i.i = i.n - 1""",
)
O["range_summary"] = sql(
    EV,
    """,
r AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY sec) AS pc FROM raw_bars
  WHERE sec BETWEEN epoch(TIMESTAMP '2024-01-08') AND epoch(TIMESTAMP '2024-01-21 23:59:59')
),
g AS (
  SELECT symbol, count(*) AS bars, min(sec) AS first_ts, max(sec) AS last_ts, min(low) AS min_low, max(high) AS max_high,
         arg_min(open, sec) AS open_first, arg_max(close, sec) AS close_last, sum(volume) AS volume_sum, avg(volume) AS volume_avg,
         max(volume) AS volume_max,
         sum(CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END) AS tr
  FROM r GROUP BY symbol
)""",
    select="""SELECT symbol, bars, first_ts, last_ts, round(min_low, 6) AS min_low, round(max_high, 6) AS max_high,
  round(open_first, 6) AS open_first, round(close_last, 6) AS close_last, round(volume_sum, 6) AS volume_sum,
  round(volume_avg, 6) AS volume_avg, round(volume_max, 6) AS volume_max,
  round(CASE WHEN open_first > 0 THEN (close_last - open_first) / open_first * 100 ELSE 0 END, 6) AS pct_change,
  round(CASE WHEN bars > 1 THEN coalesce(tr, 0) / (bars - 1) ELSE 0 END, 6) AS atr_approx FROM g""",
)
_LAST = """,
two AS (SELECT *, lag(rsi) OVER w AS rsi0, lag(macd) OVER w AS macd0, lag(sig) OVER w AS sig0, lag(hist) OVER w AS hist0,
               lag(sma20) OVER w AS mid0, lag(sd20) OVER w AS sd0, lag(atr14) OVER w AS atr0
        FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY i)),
ends AS (SELECT * FROM two WHERE i = n - 1),
series AS (
  SELECT symbol, 'RSI' AS indicator, 0 AS series_no, 'value' AS series, rsi AS last, rsi0 AS prev FROM ends
  UNION ALL SELECT symbol, 'MACD', 0, 'macd', macd, macd0 FROM ends
  UNION ALL SELECT symbol, 'MACD', 1, 'signal', sig, sig0 FROM ends
  UNION ALL SELECT symbol, 'MACD', 2, 'histogram', hist, hist0 FROM ends
  UNION ALL SELECT symbol, 'BOLL', 0, 'upper', sma20 + 2 * sd20, mid0 + 2 * sd0 FROM ends
  UNION ALL SELECT symbol, 'BOLL', 1, 'middle', sma20, mid0 FROM ends
  UNION ALL SELECT symbol, 'BOLL', 2, 'lower', sma20 - 2 * sd20, mid0 - 2 * sd0 FROM ends
  UNION ALL SELECT symbol, 'ATR', 0, 'value', atr14, atr0 FROM ends
)"""
O["indicator_last"] = sql(
    *IND,
    _LAST,
    select="""SELECT symbol, indicator, CAST(series_no AS BIGINT) AS series_no, series, round(last, 6) AS last,
  round(prev, 6) AS prev, round(last - prev, 6) AS delta FROM series""",
)
O["indicator_state"] = sql(
    *IND,
    _LAST,
    select="""SELECT symbol, 'RSI' AS indicator, CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' ELSE 'neutral' END AS state FROM ends
UNION ALL SELECT symbol, 'MACD', CASE WHEN hist0 < 0 AND hist >= 0 THEN 'bull_cross' WHEN hist0 > 0 AND hist <= 0 THEN 'bear_cross'
  WHEN hist > 0 THEN 'bullish' ELSE 'bearish' END FROM ends
UNION ALL SELECT symbol, 'BOLL', CASE WHEN 4 * sd20 / sma20 * 100 < 1 THEN 'squeeze' WHEN 4 * sd20 / sma20 * 100 > 5 THEN 'expansion' ELSE 'neutral' END FROM ends
UNION ALL SELECT symbol, 'ATR', CASE WHEN abs(atr14 - atr0) < 1e-6 THEN 'flat' WHEN atr14 > atr0 THEN 'rising' ELSE 'falling' END FROM ends""",
)
PROFILE = """,
extent AS (SELECT symbol, min(low) AS lo, (max(high) - min(low)) / 50 AS width FROM bars GROUP BY symbol),
spans AS (
  SELECT symbol, i, volume, CAST(floor((low - lo) / nullif(width, 0)) AS INTEGER) AS a,
         least(49, CAST(floor((high - lo) / nullif(width, 0)) AS INTEGER)) AS b FROM bars JOIN extent USING (symbol)
),
bins AS (
  SELECT e.symbol, k.bin, coalesce(sum(s.volume / greatest(1, s.b - s.a + 1) ORDER BY s.i), 0) AS volume
  FROM extent e CROSS JOIN (SELECT unnest(range(50)) AS bin) k
  LEFT JOIN spans s ON s.symbol = e.symbol AND k.bin BETWEEN s.a AND s.b GROUP BY 1, 2
)"""
AREA = """,
profile AS (
  SELECT symbol, list(volume ORDER BY bin) AS h, sum(volume ORDER BY bin) * 0.7 AS goal,
         CAST(arg_min(bin, -volume * 1000000 + bin * 1e-7) AS INTEGER) AS poc FROM bins GROUP BY symbol
),
grow AS (
  SELECT symbol, h, goal, poc, poc AS lo, poc AS hi, h[poc + 1] AS acc, 0 AS step FROM profile
  UNION ALL
  SELECT symbol, h, goal, poc, CASE WHEN go_left THEN lo - 1 ELSE lo END, CASE WHEN go_left THEN hi ELSE hi + 1 END,
         acc + CASE WHEN go_left THEN h[lo] ELSE h[hi + 2] END, step + 1
  FROM (SELECT *, lo > 0 AND h[lo] >= CASE WHEN hi < 49 THEN h[hi + 2] ELSE -1 END AS go_left FROM grow)
  WHERE acc < goal AND (lo > 0 OR hi < 49)
),
area AS (
  SELECT g.symbol, any_value(e.lo) + (any_value(poc) + 0.5) * any_value(width) AS poc,
         any_value(e.lo) + (max(hi) + 1) * any_value(width) AS vah, any_value(e.lo) + min(g.lo) * any_value(width) AS val
  FROM grow g JOIN extent e ON e.symbol = g.symbol GROUP BY g.symbol
)"""
O["volume_profile"] = sql(
    WALK, BARS, PROFILE, select="SELECT symbol, CAST(bin AS BIGINT) AS bin, round(volume, 6) AS volume FROM bins"
)
O["poc_value_area"] = sql(
    WALK,
    BARS,
    PROFILE,
    AREA,
    select="SELECT symbol, round(poc, 6) AS poc, round(vah, 6) AS vah, round(val, 6) AS val FROM area",
)
O["meta_summary"] = sql(
    USER,
    BARS,
    select="""SELECT symbol, count(*) AS candle_count, max(CASE WHEN i = 1 THEN sec - psec END) AS timeframe_seconds,
  min(sec) AS first_ts, max(sec) AS last_ts, round(arg_max(close, i), 6) AS last_close FROM bars GROUP BY symbol""",
)

# ── structure ───────────────────────────────────────────────────────────────

_CLOSE_PIVOTS = f""",
cp AS (SELECT *, {pivot_high('close')} AS up, {pivot_low('close')} AS dn FROM bars)"""
O["series_pivots"] = sql(
    WALK,
    BARS,
    _CLOSE_PIVOTS,
    select="""SELECT symbol, i AS bar_idx, sec AS ts, CASE WHEN up THEN 'high' ELSE 'low' END AS kind, round(close, 6) AS value
FROM cp WHERE up OR dn""",
)
O["series_pivots_ticks"] = sql(
    TICK_BARS,
    BARS_TICKS,
    _CLOSE_PIVOTS,
    select="""SELECT symbol, i AS bar_idx, CASE WHEN up THEN 'high' ELSE 'low' END AS kind, round(close, 6) AS value
FROM cp WHERE up OR dn""",
)
O["candle_swings"] = sql(
    WALK,
    BARS,
    SWINGS,
    select="""SELECT symbol, idx AS bar_idx, CAST(ord AS BIGINT) AS ord, sec AS ts, kind, round(price, 6) AS price FROM swings""",
)
O["zigzag"] = sql(
    WALK,
    FULL,
    select="""SELECT symbol, CAST(no - 1 AS BIGINT) AS no, idx, kind, sec AS ts, round(price, 6) AS price FROM zz""",
)
CLUSTERS = """,
prices AS (
  SELECT symbol, list(price ORDER BY ord, idx) AS v, list(price ORDER BY price) AS s FROM swings GROUP BY symbol
),
rounds AS (
  SELECT symbol, v, CASE WHEN len(s) <= 6 THEN s
           ELSE list_transform(range(6), lambda k: s[1 + CAST(floor((k + 0.5::DOUBLE) / 6 * len(s)) AS INTEGER)]) END AS c,
         len(s) <= 6 AS done, 0 AS step FROM prices
  UNION ALL
  SELECT symbol, v, c2, list_max(list_transform(range(1, 7), lambda j: abs(c2[j] - c[j]))) <= 1e-6, step + 1
  FROM (
    SELECT symbol, v, c, step, list_transform(range(1, 7), lambda j: coalesce(list_avg(list_filter(v, lambda x:
             list_position(list_transform(c, lambda m: abs(x - m)), list_min(list_transform(c, lambda m: abs(x - m)))) = j)), c[j])) AS c2
    FROM rounds WHERE NOT done AND step < 30
  )
),
centres AS (SELECT symbol, list_sort(arg_max(c, step)) AS c FROM rounds GROUP BY symbol),
cluster_rows AS (
  SELECT symbol, unnest(range(len(c))) AS no, unnest(c) AS price FROM centres
)"""
O["level_clusters"] = sql(
    WALK, BARS, SWINGS, CLUSTERS, select="SELECT symbol, no, round(price, 6) AS price FROM cluster_rows"
)
LEVELS = """,
priced AS (SELECT r.*, s.last_close, s.atr, s.first_ts, s.last_ts FROM cluster_rows r JOIN scale s USING (symbol)),
level_rows AS (
  SELECT *, 'support' AS side FROM priced WHERE price < last_close
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY price DESC) <= 3
  UNION ALL
  SELECT *, 'resistance' FROM priced WHERE price > last_close
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY price) <= 3
)"""
O["find_levels"] = sql(
    WALK,
    FULL,
    CLUSTERS,
    LEVELS,
    select="""SELECT symbol, side, row_number() OVER (PARTITION BY symbol, side ORDER BY price) - 1 AS no, round(price, 6) AS price
FROM level_rows""",
)
O["level_detail"] = sql(
    WALK,
    FULL,
    CLUSTERS,
    LEVELS,
    """,
touch AS (
  SELECT l.symbol, l.price, any_value(l.first_ts) AS first_ts, any_value(l.last_ts) AS last_ts, count(s.sec) AS touches,
         coalesce(max(s.sec), 0) AS t
  FROM level_rows l LEFT JOIN swings s ON s.symbol = l.symbol
    AND abs(s.price - l.price) <= CASE WHEN l.atr > 0 THEN 0.3 * l.atr ELSE l.price * 0.005 END
  GROUP BY l.symbol, l.price
)""",
    select="""SELECT symbol, round(price, 6) AS price, touches,
  round(least(touches / 5.0::DOUBLE, 1) * (0.5 + 0.5 * CASE WHEN last_ts > first_ts AND t > 0
    THEN (t - first_ts)::DOUBLE / (last_ts - first_ts) ELSE 0 END), 6) AS strength, t AS last_touch_ts FROM touch""",
)
O["as_of_bar"] = sql(
    ORD,
    BARS,
    """,
asked AS (
  SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][event_id % 5 + 1] AS symbol,
         epoch(ts) - 10000 * 86400 + user_id * 10 * 86400 AS at, event_id AS request_id FROM events
)""",
    select="""SELECT a.symbol, a.request_id, coalesce(b.i, -1) AS bar_idx
FROM asked a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.at >= b.sec""",
)

# The same over the long series.
for _name in ("trend_summary", "meta_summary", "zigzag", "poc_value_area", "find_levels", "quad_fit", "volume_profile", "divergences"):
    O[f"{_name}_lines"] = O[_name].replace(USER if _name == "meta_summary" else WALK, LINES)
