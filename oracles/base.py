"""Shared SQL: candle views, recursive indicators, swings and zigzag, written for DuckDB."""

from __future__ import annotations

TICKS = """
ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value AS price FROM events
)"""

EV = (
    TICKS
    + """,
raw_bars AS (
  SELECT symbol, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS sec,
         first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, seq) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM ticks GROUP BY 1, 2
)"""
)

WALK = """
path AS (
  SELECT event_type AS symbol, ts, event_id AS seq,
         CAST(2000000 + sum(CAST(round(value * 100) AS BIGINT) - 5000)
              OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) / CAST(1000 AS DOUBLE) AS price
  FROM events
),
raw_bars AS (
  SELECT symbol, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS sec,
         first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, seq) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM path GROUP BY 1, 2
)"""

USER = """
raw_bars AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS sec,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2
)"""

ORD = """
raw_bars AS (
  SELECT o_orderpriority AS symbol, CAST(floor(epoch(o_orderdate) / 86400) * 86400 AS BIGINT) AS sec,
         first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2
)"""

LINES = """
raw_bars AS (
  SELECT l_returnflag AS symbol, CAST(l_orderkey AS BIGINT) * 3600 AS sec,
         first(l_extendedprice ORDER BY l_linenumber, l_partkey, l_suppkey) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         last(l_extendedprice ORDER BY l_linenumber, l_partkey, l_suppkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2
)"""

TICK_BARS = """
raw_bars AS (
  SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id AS seq,
         value AS open, value AS high, value AS low, value AS close, 1.0::DOUBLE AS volume
  FROM events
)"""

PATHS = (
    WALK.replace("event_type", "user_id")
    .replace("SELECT user_id AS symbol", "SELECT CAST(user_id AS VARCHAR) AS symbol")
    .replace("3600", "14400")
)

FRAMES = """
path AS (
  SELECT event_type, ts, event_id AS seq,
         CAST(2000000 + sum(CAST(round(value * 100) AS BIGINT) - 5000)
              OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) / CAST(1000 AS DOUBLE) AS price
  FROM events
),
raw_bars AS (
  SELECT event_type || '@' || m AS symbol, CAST(floor(epoch(ts) / (m * 60)) * (m * 60) AS BIGINT) AS sec,
         first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, seq) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM path CROSS JOIN (SELECT unnest([15, 30, 90, 120, 180, 240, 360, 480]) AS m) GROUP BY 1, 2
)"""

# Position, previous bar and bars that follow.
BARS = """,
bars AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n,
         lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(sec) OVER w AS psec
  FROM raw_bars WINDOW w AS (PARTITION BY symbol ORDER BY sec)
)"""
BARS_TICKS = BARS.replace("ORDER BY sec", "ORDER BY sec, seq")

# Everything the recursion needs as plain columns of the bar.
PREP = """,
moves AS (
  SELECT *, CASE WHEN i > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         CASE WHEN i > 0 THEN greatest(close - pc, 0) END AS gain,
         CASE WHEN i > 0 THEN greatest(pc - close, 0) END AS loss
  FROM bars
),
prep AS (
  SELECT *,
         avg(tr) OVER w14 AS tr14, avg(tr) OVER w20 AS tr20, avg(gain) OVER w14 AS gain14, avg(loss) OVER w14 AS loss14,
         avg(close) OVER w20 AS mid, stddev_pop(close) OVER w20 AS sd
  FROM moves
  WINDOW w14 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
         w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
)"""

_EMAS = (9, 12, 20, 21, 26, 50, 200)


def _ema(p: int, value: str, prev: str) -> str:
    return f"({value} * (2.0::DOUBLE / {p + 1}) + {prev} * (1 - 2.0::DOUBLE / {p + 1}))"


def _wilder(p: int, value: str, seed: str, prev: str) -> str:
    return (
        f"CASE WHEN p.i < {p} THEN NULL WHEN p.i = {p} THEN p.{seed} "
        f"ELSE ({prev} * {p - 1} + p.{value}) / {p} END"
    )


# One row per bar, the state of every recursive indicator carried along.
RECURSION = f""",
rec AS (
  SELECT symbol, i, NULL::DOUBLE AS atr14, NULL::DOUBLE AS atr20, NULL::DOUBLE AS ag, NULL::DOUBLE AS al,
         {', '.join(f'close AS e{p}' for p in _EMAS)}, 0::DOUBLE AS sig
  FROM prep WHERE i = 0
  UNION ALL
  SELECT p.symbol, p.i, {_wilder(14, 'tr', 'tr14', 'r.atr14')}, {_wilder(20, 'tr', 'tr20', 'r.atr20')},
         {_wilder(14, 'gain', 'gain14', 'r.ag')}, {_wilder(14, 'loss', 'loss14', 'r.al')},
         {', '.join(_ema(p, 'p.close', f'r.e{p}') for p in _EMAS)},
         {_ema(9, f"({_ema(12, 'p.close', 'r.e12')} - {_ema(26, 'p.close', 'r.e26')})", 'r.sig')}
  FROM rec r JOIN prep p ON p.symbol = r.symbol AND p.i = r.i + 1
),
ind AS (
  SELECT p.*, r.atr14, r.atr20, r.e9, r.e12, r.e20, r.e21, r.e26, r.e50, r.e200, r.sig,
         r.e12 - r.e26 AS macd, r.e12 - r.e26 - r.sig AS hist,
         CASE WHEN r.al = 0 THEN 100 ELSE 100 - 100 / (1 + r.ag / r.al) END AS rsi,
         CASE WHEN p.i >= 19 THEN mid END AS sma20,
         CASE WHEN p.i >= 19 THEN sd END AS sd20
  FROM prep p JOIN rec r USING (symbol, i)
)"""


def _pivot(x: str, op: str, agg: str) -> str:
    left = f"{agg}({x}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    right = f"{agg}({x}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
    return (
        f"(i >= 3 AND i < n - 3 AND {x} IS NOT NULL AND coalesce({x} {op} {left}, true) "
        f"AND coalesce({x} {op} {right}, true))"
    )


def pivot_high(x: str) -> str:
    return _pivot(x, ">", "max")


def pivot_low(x: str) -> str:
    return _pivot(x, "<", "min")


SWINGS = f""",
flagged AS (SELECT *, {pivot_high('high')} AS sh, {pivot_low('low')} AS sl FROM bars),
swings AS (
  SELECT symbol, i AS idx, 0 AS ord, 'high' AS kind, sec, high AS price FROM flagged WHERE sh
  UNION ALL
  SELECT symbol, i, 1, 'low', sec, low FROM flagged WHERE sl
)"""

# Last positive ATR (0 if none) and the reversal size; needs RECURSION.
SCALE = """,
scale AS (
  SELECT symbol, max(n) AS n, coalesce(arg_max(atr14, i) FILTER (WHERE atr14 > 0), 0) AS atr,
         arg_max(close, i) AS last_close, min(sec) AS first_ts, max(sec) AS last_ts
  FROM ind GROUP BY symbol
)"""

ZIGZAG = """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx, ord) AS k FROM swings),
walk AS (
  SELECT s.symbol, s.k, 1 AS no, s.idx, s.ord, s.kind, s.sec, s.price,
         CASE WHEN c.atr > 0 THEN c.atr ELSE c.last_close * 0.005 END AS rev
  FROM numbered s JOIN scale c USING (symbol) WHERE s.k = 1
  UNION ALL
  SELECT w.symbol, s.k,
         CASE WHEN s.kind <> w.kind AND abs(s.price - w.price) >= w.rev THEN w.no + 1 ELSE w.no END,
         CASE WHEN take THEN s.idx ELSE w.idx END, CASE WHEN take THEN s.ord ELSE w.ord END,
         CASE WHEN take THEN s.kind ELSE w.kind END, CASE WHEN take THEN s.sec ELSE w.sec END,
         CASE WHEN take THEN s.price ELSE w.price END, w.rev
  FROM walk w JOIN numbered s ON s.symbol = w.symbol AND s.k = w.k + 1,
       LATERAL (SELECT CASE WHEN s.kind = w.kind
                            THEN (s.kind = 'high' AND s.price > w.price) OR (s.kind = 'low' AND s.price < w.price)
                            ELSE abs(s.price - w.price) >= w.rev END AS take) t
),
zz AS (
  SELECT symbol, no, arg_max(idx, k) AS idx, arg_max(ord, k) AS ord, arg_max(kind, k) AS kind,
         arg_max(sec, k) AS sec, arg_max(price, k) AS price
  FROM walk GROUP BY symbol, no
)"""

FULL = BARS + PREP + RECURSION + SCALE + SWINGS + ZIGZAG


def sql(*parts: str, select: str) -> str:
    return "WITH RECURSIVE" + "".join(parts) + "\n" + select
