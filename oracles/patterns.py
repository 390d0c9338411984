"""Pattern detectors. Every detector yields rows (symbol, o1, o2, kind, conf, tgt, inv, pts)."""

from __future__ import annotations

from oracles.base import FRAMES, FULL, PATHS, USER, WALK, sql

O: dict[str, str] = {}

_P = "struct_pack(idx := {0}idx, sec := {0}sec, price := {0}price, role := '{1}')"


def _pt(prefix: str, role: str) -> str:
    return _P.format(prefix, role)


def _free(idx: str, sec: str, price: str, role: str) -> str:
    return f"struct_pack(idx := {idx}, sec := {sec}, price := {price}, role := '{role}')"


def _lead(k: int, prefix: str) -> str:
    return ", ".join(f"lead({c}, {k}) OVER w AS {prefix}{c}" for c in ("idx", "sec", "price", "kind"))


# ── head & shoulders, triangles, flags ──────────────────────────────────────

HS = f""",
triples3 AS (
  SELECT symbol, kind, idx AS l_idx, sec AS l_sec, price AS l_price, {_lead(1, 'h_')}, {_lead(2, 'r_')}
  FROM swings WINDOW w AS (PARTITION BY symbol, kind ORDER BY idx)
),
shaped AS (
  SELECT *, abs(l_price - r_price) / greatest(l_price, r_price) AS skew FROM triples3
  WHERE r_idx IS NOT NULL AND CASE WHEN kind = 'high' THEN h_price > l_price AND h_price > r_price
                                   ELSE h_price < l_price AND h_price < r_price END
),
necked AS (
  SELECT s.*, (SELECT min(o.idx) FROM swings o WHERE o.symbol = s.symbol AND o.kind <> s.kind AND o.idx > s.l_idx AND o.idx < s.h_idx) AS a_i,
         (SELECT min(o.idx) FROM swings o WHERE o.symbol = s.symbol AND o.kind <> s.kind AND o.idx > s.h_idx AND o.idx < s.r_idx) AS b_i
  FROM shaped s WHERE skew <= 0.05
),
hs_hits AS (
  SELECT n.symbol, 1 AS det, (n.kind = 'low')::BIGINT AS o1, l_idx AS o2,
         CASE WHEN n.kind = 'high' THEN 'head_shoulders' ELSE 'inverse_head_shoulders' END AS kind,
         greatest(0.5::DOUBLE, 1 - skew * 10) AS conf, (a.price + b.price) / 2 * 2 - h_price AS tgt, h_price AS inv,
         [{_pt('l_', 'left_shoulder')}, {_pt('h_', 'head')}, {_pt('r_', 'right_shoulder')},
          {_pt('a.', 'neckline_left')}, {_pt('b.', 'neckline_right')}] AS pts
  FROM necked n JOIN swings a ON a.symbol = n.symbol AND a.idx = a_i AND a.kind <> n.kind
  JOIN swings b ON b.symbol = n.symbol AND b.idx = b_i AND b.kind <> n.kind
)"""

TRI = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY idx DESC) AS back FROM swings),
lines4 AS (
  SELECT symbol, kind, count(*) AS k, sum(price) AS total,
         CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(price, idx) END AS slope,
         list(struct_pack(idx := idx, sec := sec, price := price, role := kind) ORDER BY idx) AS pts
  FROM ranked WHERE back <= 4 GROUP BY symbol, kind
),
slopes AS (
  SELECT h.symbol, h.slope / ((h.total + l.total) / (h.k + l.k)) * 100 AS up,
         l.slope / ((h.total + l.total) / (h.k + l.k)) * 100 AS dn, list_concat(h.pts, l.pts)[1:4] AS pts
  FROM lines4 h JOIN lines4 l ON h.symbol = l.symbol AND h.kind = 'high' AND l.kind = 'low' WHERE h.k >= 2 AND l.k >= 2
),
tri_hits AS (
  SELECT s.symbol, 3 AS det, 0::BIGINT AS o1, 0::BIGINT AS o2,
         CASE WHEN abs(up) < 0.05 AND dn > 0.05 THEN 'ascending_triangle'
              WHEN abs(dn) < 0.05 AND up < -0.05 THEN 'descending_triangle'
              WHEN up < -0.05 AND dn > 0.05 THEN 'symmetric_triangle' END AS kind,
         0.6::DOUBLE AS conf, NULL::DOUBLE AS tgt, NULL::DOUBLE AS inv, pts
  FROM slopes s JOIN scale c USING (symbol) WHERE c.n >= 10
)"""

FLAG = f""",
legs AS (
  SELECT a.symbol, a.i AS a_idx, a.sec AS a_sec, a.close AS a_price, b.i AS b_idx, b.sec AS b_sec, b.close AS b_price,
         c.i AS c_idx, c.sec AS c_sec, c.close AS c_price, (b.close - a.close) / a.close AS imp, (c.close - b.close) / b.close AS pull
  FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.i = a.i + 10 JOIN bars c ON c.symbol = a.symbol AND c.i = c.n - 1
  WHERE a.n >= 20 AND a.i = a.n - 20
),
flag_hits AS (
  SELECT symbol, 4 AS det, 0::BIGINT AS o1, 0::BIGINT AS o2, CASE WHEN imp > 0 THEN 'bull_flag' ELSE 'bear_flag' END AS kind,
         0.55::DOUBLE AS conf, b_price * (1 + imp) AS tgt, NULL::DOUBLE AS inv,
         [{_pt('a_', 'impulse_start')}, {_pt('b_', 'impulse_end')}, {_pt('c_', 'flag_end')}] AS pts
  FROM legs WHERE abs(imp) >= 0.05 AND sign(imp) * sign(pull) < 0 AND abs(pull / imp) < 0.5
)"""

# ── zigzag patterns ─────────────────────────────────────────────────────────

DT = f""",
last14 AS (
  SELECT z.*, c.atr, c.last_close FROM zz z JOIN scale c USING (symbol)
  WHERE c.atr > 0 AND c.n >= 10 QUALIFY z.no > max(z.no) OVER (PARTITION BY z.symbol) - 14
),
runs AS (
  SELECT symbol, no, atr, last_close, idx AS p1_idx, sec AS p1_sec, price AS p1_price, kind AS p1_kind,
         {', '.join(_lead(k, f'p{k + 1}_') for k in (1, 2, 3, 4))}
  FROM last14 WINDOW w AS (PARTITION BY symbol ORDER BY no)
),
m5 AS (
  SELECT *, p1_kind = 'high' AS top, greatest(p1_price, p3_price, p5_price) AS hi, least(p1_price, p3_price, p5_price) AS lo,
         (p1_price + p3_price + p5_price) / 3 AS mean,
         CASE WHEN p1_kind = 'high' THEN least(p2_price, p4_price) ELSE greatest(p2_price, p4_price) END AS neck
  FROM runs WHERE p5_idx IS NOT NULL AND p1_kind <> p2_kind AND p2_kind <> p3_kind AND p3_kind <> p4_kind AND p4_kind <> p5_kind
),
m3 AS (
  SELECT *, p1_kind = 'high' AS top, greatest(p1_price, p3_price) AS hi, least(p1_price, p3_price) AS lo,
         (p1_price + p3_price) / 2 AS mean, p2_price AS neck
  FROM runs WHERE p3_idx IS NOT NULL AND p1_kind <> p2_kind AND p2_kind <> p3_kind
),
gated5 AS (
  SELECT *, least(0.015 * hi, atr) AS tol, CASE WHEN top THEN mean - neck ELSE neck - mean END AS height,
         CASE WHEN top THEN hi ELSE lo END AS edge FROM m5
),
gated3 AS (
  SELECT *, least(0.015 * hi, atr) AS tol, CASE WHEN top THEN mean - neck ELSE neck - mean END AS height,
         CASE WHEN top THEN hi ELSE lo END AS edge FROM m3
),
ok5 AS (
  SELECT * FROM gated5 WHERE hi - lo <= tol AND height >= 2 * atr AND last_close > least(neck, edge) AND last_close < greatest(neck, edge)
),
claimed AS (SELECT DISTINCT symbol, no + k AS no FROM ok5, (SELECT unnest(range(5)) AS k)),
ok3 AS (
  SELECT * FROM gated3 g WHERE hi - lo <= tol AND height >= 2 * atr AND last_close > least(neck, edge) AND last_close < greatest(neck, edge)
    AND (SELECT count(*) FROM claimed c WHERE c.symbol = g.symbol AND c.no BETWEEN g.no AND g.no + 2) < 3
),
dt_hits AS (
  SELECT symbol, 2 AS det, 0::BIGINT AS o1, no AS o2, CASE WHEN top THEN 'triple_top' ELSE 'triple_bottom' END AS kind,
         least(0.85::DOUBLE, 0.55 + 0.18 * (1 - (hi - lo) / tol) + 0.12 * least(height / (3 * atr), 1)) AS conf,
         CASE WHEN top THEN neck - height ELSE neck + height END AS tgt, edge AS inv,
         CASE WHEN top THEN [{_pt('p1_', 'top_1')}, {_pt('p2_', 'valley_1')}, {_pt('p3_', 'top_2')}, {_pt('p4_', 'valley_2')}, {_pt('p5_', 'top_3')}]
              ELSE [{_pt('p1_', 'bottom_1')}, {_pt('p2_', 'peak_1')}, {_pt('p3_', 'bottom_2')}, {_pt('p4_', 'peak_2')}, {_pt('p5_', 'bottom_3')}] END AS pts
  FROM ok5
  UNION ALL
  SELECT symbol, 2, 1, no, CASE WHEN top THEN 'double_top' ELSE 'double_bottom' END,
         least(0.85::DOUBLE, 0.5 + 0.2 * (1 - (hi - lo) / tol) + 0.15 * least(height / (3 * atr), 1)),
         CASE WHEN top THEN neck - height ELSE neck + height END, edge,
         CASE WHEN top THEN [{_pt('p1_', 'top_1')}, {_pt('p2_', 'valley')}, {_pt('p3_', 'top_2')}]
              ELSE [{_pt('p1_', 'bottom_1')}, {_pt('p2_', 'peak')}, {_pt('p3_', 'bottom_2')}] END
  FROM ok3
)"""

TPL = f""",
last12 AS (
  SELECT z.*, c.atr FROM zz z JOIN scale c USING (symbol)
  WHERE c.atr > 0 AND c.n >= 10 QUALIFY z.no > max(z.no) OVER (PARTITION BY z.symbol) - 12
),
runs12 AS (
  SELECT symbol, no, atr, idx AS p1_idx, sec AS p1_sec, price AS p1_price, kind AS p1_kind,
         {', '.join(_lead(k, f'p{k + 1}_') for k in (1, 2, 3, 4))}
  FROM last12 WINDOW w AS (PARTITION BY symbol ORDER BY no)
),
four AS (
  SELECT *, CASE WHEN p4_kind = 'low' THEN 1 ELSE -1 END AS dir, abs(p3_price - p2_price) / abs(p2_price - p1_price) AS bc,
         abs(p4_price - p3_price) / abs(p3_price - p2_price) AS cd
  FROM runs12 WHERE p4_idx IS NOT NULL AND least(abs(p2_price - p1_price), abs(p3_price - p2_price), abs(p4_price - p3_price)) >= 2 * atr
),
abcd AS (
  SELECT *, CASE WHEN abs(bc - 0.618) <= 0.05 THEN 0.618 WHEN abs(bc - 0.786) <= 0.05 THEN 0.786 END AS anchor FROM four
  WHERE cd >= 1.272 - 0.05 AND cd <= 1.618 + 0.05
),
five AS (
  SELECT *, CASE WHEN p1_kind = 'low' THEN 1 ELSE -1 END AS dir, abs(p4_price - p3_price) / abs(p3_price - p2_price) AS c,
         abs(p2_price - p3_price) / abs(p1_price - p2_price) AS b, abs(p2_price - p5_price) / abs(p1_price - p2_price) AS d
  FROM runs12 WHERE p5_idx IS NOT NULL AND least(abs(p2_price - p1_price), abs(p3_price - p2_price), abs(p4_price - p3_price), abs(p5_price - p4_price)) >= 2 * atr
),
rows5(t, name, ext, b_lo, b_hi, d_lo, d_hi, b_at, d_at, lim) AS (VALUES
  (1, 'gartley', 0, 0.618, 0.618, 0.786, 0.786, 0.618, 0.786, NULL), (2, 'bat', 0, 0.382, 0.5, 0.886, 0.886, NULL, 0.886, NULL),
  (3, 'butterfly', 1, 0.786, 0.786, 1.272, 1.618, 0.786, NULL, 1.618), (4, 'crab', 1, 0.382, 0.618, 1.618, 1.618, NULL, 1.618, 1.618)
),
xabcd AS (
  SELECT f.*, t.* FROM five f, rows5 t
  WHERE c BETWEEN 0.382 - 0.05 AND 0.886 + 0.05 AND b BETWEEN b_lo - 0.05 AND b_hi + 0.05 AND d BETWEEN d_lo - 0.05 AND d_hi + 0.05
    AND CASE WHEN ext = 0 THEN dir * (p5_price - p1_price) > 0 ELSE dir * (p1_price - p5_price) > 0 END
),
tpl_hits AS (
  SELECT symbol, 9 AS det, no AS o1, 0::BIGINT AS o2, CASE WHEN dir > 0 THEN 'abcd_bullish' ELSE 'abcd_bearish' END AS kind,
         least(0.85::DOUBLE, 0.5 + 0.2 * (1 - abs(bc - anchor) / 0.05) + CASE WHEN cd BETWEEN 1.272 AND 1.618 THEN 0.1 ELSE 0 END) AS conf,
         p4_price + dir * 0.382 * abs(p4_price - p3_price) AS tgt, p3_price - dir * (1.618 + 0.05) * abs(p3_price - p2_price) AS inv,
         [{_pt('p1_', 'A')}, {_pt('p2_', 'B')}, {_pt('p3_', 'C')}, {_pt('p4_', 'D')}] AS pts
  FROM abcd WHERE anchor IS NOT NULL
  UNION ALL
  SELECT symbol, 9, 1000000 + no, t, name || CASE WHEN dir > 0 THEN '_bullish' ELSE '_bearish' END,
         least(0.85::DOUBLE, 0.5 + CASE WHEN b_at IS NULL THEN 0.15 ELSE 0.15 * greatest(0, 1 - abs(b - b_at) / 0.05) END
           + CASE WHEN d_at IS NOT NULL THEN 0.2 * greatest(0, 1 - abs(d - d_at) / 0.05) WHEN d BETWEEN 1.272 AND 1.618 THEN 0.1 ELSE 0 END),
         p5_price + dir * 0.382 * abs(p2_price - p5_price), coalesce(p2_price - dir * (lim + 0.05) * abs(p2_price - p1_price), p1_price),
         [{_pt('p1_', 'X')}, {_pt('p2_', 'A')}, {_pt('p3_', 'B')}, {_pt('p4_', 'C')}, {_pt('p5_', 'D')}]
  FROM xabcd
)"""

WEDGE = f""",
w6 AS (
  SELECT z.*, c.atr, c.n FROM zz z JOIN scale c USING (symbol)
  QUALIFY row_number() OVER (PARTITION BY z.symbol, z.kind ORDER BY z.idx DESC) <= 6
),
fit6 AS (
  SELECT symbol, kind, count(*) AS k, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(price, idx) END AS m, regr_intercept(price, idx) AS q,
         CASE WHEN var_pop(price) = 0 THEN 1 ELSE regr_r2(price, idx) END AS r2, min(idx) AS a, max(idx) AS z
  FROM w6 GROUP BY symbol, kind HAVING count(*) >= 2
),
res6 AS (
  SELECT w.symbol, w.kind, sqrt(avg((price - (m * idx + q)) ** 2)) AS rms,
         count(*) FILTER (WHERE abs(price - (m * idx + q)) <= 0.3 * atr) AS touches,
         coalesce(max(idx) FILTER (WHERE abs(price - (m * idx + q)) <= 0.3 * atr), -1) AS last_touch,
         list(struct_pack(idx := idx, sec := sec, price := price, role := CASE WHEN w.kind = 'high' THEN 'upper_touch' ELSE 'lower_touch' END) ORDER BY idx DESC)
           FILTER (WHERE abs(price - (m * idx + q)) <= 0.3 * atr) AS tp
  FROM w6 w JOIN fit6 f USING (symbol, kind) GROUP BY w.symbol, w.kind
),
lines6 AS (
  SELECT u.symbol, c.atr, c.n, u.m AS um, u.q AS uq, u.r2 AS ur2, d.m AS dm, d.q AS dq, d.r2 AS dr2, least(u.a, d.a) AS first, greatest(u.z, d.z) AS last,
         ru.rms AS urms, rd.rms AS drms, ru.touches AS ut, rd.touches AS dt, greatest(ru.last_touch, rd.last_touch) AS last_touch,
         list_reverse(ru.tp[1:2]) AS utp, list_reverse(rd.tp[1:2]) AS dtp
  FROM fit6 u JOIN fit6 d ON d.symbol = u.symbol AND u.kind = 'high' AND d.kind = 'low'
  JOIN res6 ru ON ru.symbol = u.symbol AND ru.kind = 'high' JOIN res6 rd ON rd.symbol = u.symbol AND rd.kind = 'low'
  JOIN scale c ON c.symbol = u.symbol
),
geo AS (
  SELECT *, (um - dm) * first + uq - dq AS g0, (um - dm) * last + uq - dq AS g1, ((um + dm) * last + uq + dq) / 2 AS price, last - first AS span
  FROM lines6
),
wedge_ok AS (
  SELECT *, CASE WHEN um / price * 100 > 0.05 AND dm / price * 100 > 0.05 AND dm > um THEN 'rising_wedge'
                 WHEN um / price * 100 < -0.05 AND dm / price * 100 < -0.05 AND um < dm THEN 'falling_wedge' END AS kind
  FROM geo WHERE atr > 0 AND n >= 15 AND span >= 15 AND ut >= 2 AND dt >= 2 AND least(ur2, dr2) >= 0.5 AND g0 > 0 AND g1 > 0 AND g1 <= 0.7 * g0
    AND greatest(urms, drms) <= 0.12 * (g0 + g1) / 2 AND dm > um AND first + g0 / (dm - um) > last AND first + g0 / (dm - um) <= last + 4 * span
),
wedge_hits AS (
  SELECT w.symbol, 6 AS det, 0::BIGINT AS o1, 0::BIGINT AS o2, kind,
         least(0.85::DOUBLE, 0.5 + 0.15 * least(ur2, dr2) + 0.1 * greatest(0, least(1, (1 - g1 / g0 - 0.3) / 0.7)) + 0.04 * greatest(0, ut + dt - 4)) AS conf,
         CASE WHEN kind = 'rising_wedge' THEN dm * first + dq ELSE um * first + uq END AS tgt,
         CASE WHEN kind = 'rising_wedge' THEN um * last + uq ELSE dm * last + dq END AS inv,
         list_concat([{_free('first', 'f.sec', 'um * first + uq', 'upper_start')}, {_free('last', 'l.sec', 'um * last + uq', 'upper_end')},
                      {_free('first', 'f.sec', 'dm * first + dq', 'lower_start')}, {_free('last', 'l.sec', 'dm * last + dq', 'lower_end')}],
                     list_concat(utp, dtp)) AS pts
  FROM wedge_ok w JOIN bars f ON f.symbol = w.symbol AND f.i = first JOIN bars l ON l.symbol = w.symbol AND l.i = last WHERE kind IS NOT NULL
)"""

GAP = """,
gap_bars AS (
  SELECT symbol, i, sec, psec, n, ph, pl, high, low, lag(atr14) OVER (PARTITION BY symbol ORDER BY i) AS a, low - ph AS up, pl - high AS dn,
         min(low) OVER s AS later_low, max(high) OVER s AS later_high
  FROM ind WINDOW s AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
),
open_gaps AS (
  SELECT *, CASE WHEN up >= 0.5 * a THEN 'gap_up' ELSE 'gap_down' END AS kind FROM gap_bars
  WHERE n >= 16 AND a > 0 AND CASE WHEN up >= 0.5 * a THEN later_low IS NULL OR later_low > ph
                                   WHEN dn >= 0.5 * a THEN later_high IS NULL OR later_high < pl ELSE false END
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= 3
),
gap_hits AS (
  SELECT symbol, 10 AS det, i AS o1, 0::BIGINT AS o2, kind,
         least(0.85::DOUBLE, 0.5 + 0.25 * least(CASE WHEN kind = 'gap_up' THEN up ELSE dn END / (2 * a), 1)) AS conf, NULL::DOUBLE AS tgt,
         CASE WHEN kind = 'gap_up' THEN ph ELSE pl END AS inv,
         [struct_pack(idx := i - 1, sec := psec, price := CASE WHEN kind = 'gap_up' THEN ph ELSE high END, role := 'gap_low'),
          struct_pack(idx := i, sec := sec, price := CASE WHEN kind = 'gap_up' THEN low ELSE pl END, role := 'gap_high')] AS pts
  FROM open_gaps
)"""

# ── channels: own swing structure for the last 130 and 60 bars ──────────────

CHANNEL = """,
scopes AS (
  SELECT symbol, n, last_close, atr, 0 AS sc, n AS k FROM scale WHERE atr > 0 AND n >= 30
  UNION ALL SELECT symbol, n, last_close, atr, 1, 130 FROM scale WHERE atr > 0 AND n > 130
  UNION ALL SELECT symbol, n, last_close, atr, 2, 60 FROM scale WHERE atr > 0 AND n > 60
),
local_tr AS (
  SELECT s.symbol, s.sc, list(p.tr ORDER BY p.i) AS trs FROM scopes s JOIN prep p ON p.symbol = s.symbol AND p.i > s.n - s.k
  WHERE s.sc > 0 GROUP BY s.symbol, s.sc
),
local_scale AS (
  SELECT s.*, coalesce(nullif(list_reduce(list_concat([list_avg(trs[1:14])], trs[15:]), lambda a, t: (a * 13 + t) / 14), 0), atr) AS satr
  FROM scopes s LEFT JOIN local_tr USING (symbol, sc)
),
sc_swings AS (
  SELECT s.sc, s.satr, s.last_close, w.*, row_number() OVER (PARTITION BY s.symbol, s.sc ORDER BY w.idx, w.ord) AS k
  FROM local_scale s JOIN swings w ON w.symbol = s.symbol AND (s.sc = 0 OR w.idx >= s.n - s.k + 3)
),
sc_walk AS (
  SELECT symbol, sc, k, 1 AS no, idx, ord, kind, sec, price, satr AS rev FROM sc_swings WHERE k = 1
  UNION ALL
  SELECT w.symbol, w.sc, s.k, CASE WHEN s.kind <> w.kind AND abs(s.price - w.price) >= w.rev THEN w.no + 1 ELSE w.no END,
         CASE WHEN take THEN s.idx ELSE w.idx END, CASE WHEN take THEN s.ord ELSE w.ord END, CASE WHEN take THEN s.kind ELSE w.kind END,
         CASE WHEN take THEN s.sec ELSE w.sec END, CASE WHEN take THEN s.price ELSE w.price END, w.rev
  FROM sc_walk w JOIN sc_swings s ON s.symbol = w.symbol AND s.sc = w.sc AND s.k = w.k + 1,
       LATERAL (SELECT CASE WHEN s.kind = w.kind THEN (s.kind = 'high' AND s.price > w.price) OR (s.kind = 'low' AND s.price < w.price)
                            ELSE abs(s.price - w.price) >= w.rev END AS take) t
),
sc_zz AS (
  SELECT symbol, sc, no, arg_max(idx, k) AS idx, arg_max(kind, k) AS kind, arg_max(sec, k) AS sec, arg_max(price, k) AS price
  FROM sc_walk GROUP BY symbol, sc, no
),
side6 AS (SELECT * FROM sc_zz QUALIFY row_number() OVER (PARTITION BY symbol, sc, kind ORDER BY idx DESC) <= 6),
ranges6 AS (
  SELECT symbol, sc, min(idx) AS first, max(idx) AS last FROM side6 GROUP BY symbol, sc
  HAVING count(*) FILTER (WHERE kind = 'high') >= 2 AND count(*) FILTER (WHERE kind = 'low') >= 2
),
mids AS (
  SELECT r.symbol, r.sc, r.first, r.last, regr_slope(close, i) AS m, regr_intercept(close, i) AS q,
         CASE WHEN var_pop(close) = 0 THEN 1 ELSE regr_r2(close, i) END AS r2
  FROM ranges6 r JOIN bars b ON b.symbol = r.symbol AND b.i BETWEEN r.first AND r.last WHERE r.last - r.first >= 30 GROUP BY ALL
),
offs AS (
  SELECT s.symbol, s.sc, max(price - (m * idx + q)) FILTER (WHERE kind = 'high') AS up, max(m * idx + q - price) FILTER (WHERE kind = 'low') AS dn
  FROM side6 s JOIN mids USING (symbol, sc) GROUP BY s.symbol, s.sc
),
banded AS (
  SELECT m.*, up, dn, up + dn AS h, l.satr, l.last_close, l.n FROM mids m JOIN offs USING (symbol, sc) JOIN local_scale l USING (symbol, sc)
  WHERE up > 0 AND dn > 0 AND up + dn >= 1.5 * satr AND up + dn <= 0.12 * last_close
),
touched AS (
  SELECT s.symbol, s.sc, count(*) FILTER (WHERE kind = 'high') AS t1, count(*) FILTER (WHERE kind = 'low') AS t2, max(idx) AS last_touch,
         list(struct_pack(idx := idx, sec := sec, price := price, role := 'upper_touch') ORDER BY idx DESC) FILTER (WHERE kind = 'high') AS tp,
         list(struct_pack(idx := idx, sec := sec, price := price, role := 'lower_touch') ORDER BY idx DESC) FILTER (WHERE kind = 'low') AS bp
  FROM side6 s JOIN banded b USING (symbol, sc)
  WHERE abs(price - (m * idx + q + CASE WHEN kind = 'high' THEN up ELSE -dn END)) <= 0.2 * h GROUP BY s.symbol, s.sc
),
travel AS (
  SELECT b.symbol, b.sc, avg(abs(close - (m * i + q))) / any_value(h) AS usage,
         bool_and(close - (m * i + q) <= up + 0.15 * h AND (m * i + q) - close <= dn + 0.15 * h) AS contained
  FROM banded b JOIN bars x ON x.symbol = b.symbol AND x.i BETWEEN b.first AND b.last GROUP BY b.symbol, b.sc
),
classed AS (
  SELECT *, m / (m * last + q) * 100 AS slope, m * last + q AS centre,
         CASE WHEN m / (m * last + q) * 100 >= 0.05 THEN 'channel_up' WHEN m / (m * last + q) * 100 <= -0.05 THEN 'channel_down' ELSE 'channel_flat' END AS kind
  FROM banded JOIN touched USING (symbol, sc) JOIN travel USING (symbol, sc)
  WHERE greatest(t1, t2) >= 3 AND least(t1, t2) >= 2 AND contained AND usage >= 0.15
),
channel_best AS (
  SELECT *, least(0.85::DOUBLE, 0.5 + 0.04 * least(greatest(t1 + t2 - 5, 0), 3) + CASE WHEN kind = 'channel_flat' THEN 0.075 ELSE 0.15 * r2 END
              + 0.4 * least(usage - 0.15, 0.15)) AS conf,
         CASE WHEN kind = 'channel_down' THEN up ELSE -dn END AS base, CASE WHEN kind = 'channel_down' THEN -dn ELSE up END AS other,
         kind = 'channel_up' OR (kind = 'channel_flat' AND last_close <= centre) AS to_upper
  FROM classed WHERE CASE WHEN kind = 'channel_flat' THEN h >= 2.5 * satr ELSE r2 >= 0.55 END
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY conf DESC, sc) = 1
),
channel_hits AS (
  SELECT c.symbol, 5 AS det, 0::BIGINT AS o1, 0::BIGINT AS o2, kind, conf,
         CASE WHEN to_upper THEN centre + up ELSE centre - dn END AS tgt, CASE WHEN to_upper THEN centre - dn ELSE centre + up END AS inv,
         list_concat([struct_pack(idx := first, sec := f.sec, price := m * first + q + base, role := 'base_start'),
                      struct_pack(idx := last_touch, sec := l.sec, price := m * last_touch + q + base, role := 'base_end'),
                      struct_pack(idx := first, sec := f.sec, price := m * first + q + other, role := 'offset')],
                     list_concat(list_reverse(tp[1:3]), list_reverse(bp[1:3]))) AS pts
  FROM channel_best c JOIN bars f ON f.symbol = c.symbol AND f.i = first JOIN bars l ON l.symbol = c.symbol AND l.i = last_touch
)"""


# ── parabolic basins ────────────────────────────────────────────────────────


def _parabola(name: str, source: str, keys: str) -> str:
    """CTEs fitting y = a x^2 + b x + k with x relative to the middle of the range."""
    return f""",
{name}_d AS (SELECT *, i - x0 AS x FROM {source}),
{name}_s AS (SELECT {keys}, any_value(x0) AS x0, count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4,
             sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2, avg(y) AS mean, min(y) AS lowest FROM {name}_d GROUP BY {keys}),
{name}_e AS (SELECT *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) AS dd FROM {name}_s),
{name}_c AS (SELECT {keys}, x0, mean, lowest, s0,
             (t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0)) / dd AS a,
             (s4*(t1*s0 - t0*s1) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - t1*s2)) / dd AS b,
             (s4*(s2*t0 - s1*t1) - s3*(s3*t0 - s2*t1) + t2*(s3*s1 - s2*s2)) / dd AS k FROM {name}_e WHERE dd <> 0),
{name}_f AS (SELECT {keys}, any_value(c.x0) AS x0, any_value(c.lowest) AS lowest, any_value(a) AS a, any_value(b) AS b, any_value(k) AS k,
             any_value(c.x0 - b / (2*a)) AS vertex, any_value(s0) AS len,
             1 - sum((y - (a*x*x + b*x + k))**2) / sum((y - mean)**2) AS r2 FROM {name}_d d JOIN {name}_c c USING ({keys}) GROUP BY {keys})"""


def _at(x: str) -> str:
    return f"(a*({x} - x0)*({x} - x0) + b*({x} - x0) + k)"


CUP = (
    """,
rims AS (SELECT z.symbol, z.idx, z.sec, z.price, c.atr, c.n, c.last_close FROM zz z JOIN scale c USING (symbol) WHERE kind = 'high' AND c.atr > 0 AND c.n >= 40),
rim_pairs AS (
  SELECT r.symbol, l.idx AS li, r.idx AS ri, l.sec AS lsec, r.sec AS rsec, l.price AS lp, r.price AS rp, r.atr, r.n, r.last_close, (l.price + r.price) / 2 AS rim
  FROM rims r JOIN rims l ON l.symbol = r.symbol AND l.idx < r.idx
  WHERE r.n - 1 - r.idx >= 3 AND r.idx - l.idx >= 20 AND r.n - 1 - r.idx <= (r.idx - l.idx) / 2.0::DOUBLE
    AND abs(l.price - r.price) <= 0.03 * greatest(l.price, r.price)
),
cup_src AS (
  SELECT p.symbol, li, ri, b.i, b.low AS y, (li + ri) / 2.0::DOUBLE AS x0 FROM rim_pairs p JOIN bars b ON b.symbol = p.symbol AND b.i BETWEEN li AND ri
)"""
    + _parabola("cup", "cup_src", "symbol, li, ri")
    + f""",
handles AS (
  SELECT p.symbol, li, ri, min(low) AS dip, arg_min(b.i, low * 1e6 + b.i * 1e-6) AS hi_i FROM rim_pairs p JOIN bars b ON b.symbol = p.symbol AND b.i > ri GROUP BY ALL
),
basin AS (
  SELECT f.symbol, f.li, f.ri, count(*) FILTER (WHERE s.y <= f.lowest + 0.2 * (p.rim - f.lowest)) / count(*) AS share
  FROM cup_f f JOIN rim_pairs p USING (symbol, li, ri) JOIN cup_src s USING (symbol, li, ri) GROUP BY ALL
),
cup_ok AS (
  SELECT * FROM (SELECT *, rim - lowest AS depth FROM rim_pairs JOIN cup_f USING (symbol, li, ri) JOIN handles USING (symbol, li, ri) JOIN basin USING (symbol, li, ri))
  WHERE depth >= 2.5 * atr AND depth <= 0.35 * rim AND a > 0 AND r2 >= 0.8 AND vertex >= li + (ri - li) * (1.0::DOUBLE / 3) AND vertex <= ri - (ri - li) * (1.0::DOUBLE / 3)
    AND share >= 0.25 AND rim - dip > 0 AND rim - dip <= 0.5 * depth AND last_close >= rim - 0.15 * depth
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ri DESC, li DESC) = 1
),
cup_hits AS (
  SELECT c.symbol, 7 AS det, 0::BIGINT AS o1, 0::BIGINT AS o2, 'cup_handle' AS kind,
         least(0.85::DOUBLE, 0.5 + 0.2 * ((r2 - 0.8) / (1 - 0.8::DOUBLE)) + 0.1 * (1 - abs(lp - rp) / greatest(lp, rp) / 0.03) + 0.05 * (1 - (rim - dip) / depth / 0.5)) AS conf,
         rim + depth AS tgt, dip AS inv,
         list_concat([{_free('li', 'lsec', 'lp', 'left_rim')}, {_free('v.i', 'v.sec', 'lowest', 'cup_bottom')}, {_free('ri', 'rsec', 'rp', 'right_rim')},
                      {_free('hb.i', 'hb.sec', 'dip', 'handle_low')}, {_free('e.i', 'e.sec', 'c.last_close', 'handle_end')}],
           (SELECT list(struct_pack(idx := q.i, sec := q.sec, price := {_at('(li + (ri - li) * g.s / 6.0::DOUBLE)')}, role := 'arc') ORDER BY g.s)
            FROM (SELECT unnest(range(7)) AS s) g JOIN bars q ON q.symbol = c.symbol AND q.i = floor(li + (ri - li) * g.s / 6.0::DOUBLE + 0.5))) AS pts
  FROM cup_ok c JOIN bars v ON v.symbol = c.symbol AND v.i = floor(vertex + 0.5) JOIN bars hb ON hb.symbol = c.symbol AND hb.i = hi_i
  JOIN bars e ON e.symbol = c.symbol AND e.i = e.n - 1
)"""
)

ROUND = (
    """,
rb_src AS (
  SELECT b.symbol, w.w, b.i, b.low AS y, (b.n - w.w + b.n - 1) / 2.0::DOUBLE AS x0 FROM bars b, (VALUES (40), (60), (90)) w(w)
  WHERE b.n >= 40 AND w.w <= b.n AND b.i >= b.n - w.w
)"""
    + _parabola("rb", "rb_src", "symbol, w")
    + f""",
rb_g AS (
  SELECT f.*, c.n, c.atr, c.last_close, c.n - w AS first, {_at('vertex')} AS bottom,
         least({_at('(c.n - w)')}, {_at('(c.n - 1)')}) AS rim FROM rb_f f JOIN scale c USING (symbol) WHERE c.atr > 0 AND a > 0
),
rb_share AS (
  SELECT g.symbol, g.w, count(*) FILTER (WHERE s.y <= g.bottom + 0.2 * (g.rim - g.bottom)) / count(*) AS share FROM rb_g g JOIN rb_src s USING (symbol, w) GROUP BY ALL
),
rb_ok AS (
  SELECT * FROM (SELECT *, rim - bottom AS depth FROM rb_g JOIN rb_share USING (symbol, w))
  WHERE r2 >= 0.8 AND vertex >= first + w * 0.25 AND vertex <= first + w * 0.8 AND depth >= 2.5 * atr AND depth <= 0.35 * rim AND share >= 0.25
    AND last_close >= bottom + 0.6 * depth AND last_close <= rim + 0.15 * depth
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY w) = 1
),
rb_hits AS (
  SELECT c.symbol, 8 AS det, 0::BIGINT AS o1, 0::BIGINT AS o2, 'rounding_bottom' AS kind,
         least(0.85::DOUBLE, 0.5 + 0.2 * ((r2 - 0.8) / (1 - 0.8::DOUBLE)) + 0.1 * least(1, share / 0.5)) AS conf, rim + depth AS tgt, bottom AS inv,
         list_concat([{_free('f.i', 'f.sec', _at('first'), 'rim_left')}, {_free('v.i', 'v.sec', 'bottom', 'bottom')}, {_free('e.i', 'e.sec', 'c.last_close', 'recovery_end')}],
           (SELECT list(struct_pack(idx := q.i, sec := q.sec, price := {_at('(first + (w - 1) * g.s / 6.0::DOUBLE)')}, role := 'arc') ORDER BY g.s)
            FROM (SELECT unnest(range(7)) AS s) g JOIN bars q ON q.symbol = c.symbol AND q.i = floor(first + (w - 1) * g.s / 6.0::DOUBLE + 0.5))) AS pts
  FROM rb_ok c JOIN bars f ON f.symbol = c.symbol AND f.i = first JOIN bars v ON v.symbol = c.symbol AND v.i = floor(vertex + 0.5)
  JOIN bars e ON e.symbol = c.symbol AND e.i = e.n - 1
)"""
)

# ── assembling ──────────────────────────────────────────────────────────────

SUFFIX = """,
later AS (
  SELECT symbol, i, close, min(low) OVER s AS lo, max(high) OVER s AS hi FROM bars
  WINDOW s AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
)"""


def alive(source: str, target: str) -> str:
    """CTE ``target``: the hits of ``source`` whose levels were not traded since completion."""
    return f""",
{target} AS (
  SELECT h.* FROM {source} h JOIN later b ON b.symbol = h.symbol AND b.i = list_max(list_transform(pts, lambda p: p.idx))
  WHERE h.kind IN ('channel_up', 'channel_down', 'channel_flat', 'rising_wedge', 'falling_wedge')
     OR NOT (coalesce(CASE WHEN inv < b.close THEN b.lo <= inv ELSE b.hi >= inv END, false)
             OR coalesce(CASE WHEN tgt > b.close THEN b.hi >= tgt ELSE b.lo <= tgt END, false))
)"""


def points(source: str, where: str = "true") -> str:
    return f"""SELECT symbol, hit_no, kind, conf AS confidence, tgt AS target_price, inv AS invalidation_price, point_no,
  p.sec AS ts, round(p.price, 6) AS price, p.role AS role
FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY det, o1, o2) - 1 AS hit_no, kind, round(conf, 6) AS conf,
             round(tgt, 6) AS tgt, round(inv, 6) AS inv, unnest(pts) AS p, unnest(range(len(pts))) AS point_no
      FROM {source} WHERE kind IS NOT NULL AND {where})"""


def _detector(ctes: str, source: str, view: str = WALK, where: str = "true") -> str:
    return sql(view, FULL, ctes, select=points(source, where))


O["head_shoulders"] = _detector(HS, "hs_hits", where="kind = 'head_shoulders'")
O["inverse_head_shoulders"] = _detector(HS, "hs_hits", where="kind = 'inverse_head_shoulders'")
O["double_top_bottom"] = _detector(DT, "dt_hits", where="kind LIKE 'double%'")
O["triple_top_bottom"] = _detector(DT, "dt_hits", where="kind LIKE 'triple%'")
O["triangles"] = _detector(TRI, "tri_hits")
O["flags"] = _detector(FLAG, "flag_hits", FRAMES)
O["channels"] = _detector(CHANNEL, "channel_hits")
O["wedges"] = _detector(WEDGE, "wedge_hits", USER)
O["cup_handle"] = _detector(CUP, "cup_hits", PATHS)
O["rounding_bottom"] = _detector(ROUND, "rb_hits", PATHS)
O["template_match"] = _detector(TPL, "tpl_hits", PATHS)
O["template_rows"] = O["template_match"]
O["gaps"] = _detector(GAP, "gap_hits")
O["flags_users"] = _detector(FLAG, "flag_hits", USER)
O["triangles_users"] = _detector(TRI, "tri_hits", USER)
O["double_triple_users"] = _detector(DT, "dt_hits", USER)
O["harmonics_users"] = _detector(TPL, "tpl_hits", USER)
O["wedges_frames"] = _detector(WEDGE, "wedge_hits", FRAMES)
O["templates_frames"] = _detector(TPL, "tpl_hits", FRAMES)
O["gaps_users"] = _detector(GAP, "gap_hits", USER)
O["two_line_fit"] = sql(
    WALK,
    FULL,
    WEDGE,
    select="""SELECT symbol, round(um, 6) AS hi_slope, round(ur2, 6) AS hi_r2, round(dm, 6) AS lo_slope, round(dr2, 6) AS lo_r2,
  ut AS hi_touches, dt AS lo_touches, first AS start_idx, last AS end_idx, last_touch AS last_touch_idx FROM lines6""",
)

ALL = (
    HS
    + DT
    + TRI
    + FLAG
    + CHANNEL
    + WEDGE
    + CUP
    + ROUND
    + TPL
    + GAP
    + SUFFIX
    + """,
all_hits AS (
  SELECT * FROM hs_hits UNION ALL SELECT * FROM dt_hits UNION ALL SELECT * FROM tri_hits WHERE kind IS NOT NULL
  UNION ALL SELECT * FROM flag_hits UNION ALL SELECT * FROM channel_hits UNION ALL SELECT * FROM wedge_hits
  UNION ALL SELECT * FROM cup_hits UNION ALL SELECT * FROM rb_hits WHERE symbol NOT IN (SELECT symbol FROM cup_hits)
  UNION ALL SELECT * FROM tpl_hits UNION ALL SELECT * FROM gap_hits
),
sized AS (SELECT a.* FROM all_hits a JOIN scale c USING (symbol) WHERE c.n >= 10)"""
    + alive("sized", "live")
    + """,
patterns AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY det, o1, o2) - 1 AS hit_no FROM live),
recent AS (
  SELECT p.* FROM patterns p JOIN scale c USING (symbol)
  WHERE c.last_ts <= c.first_ts OR list_max(list_transform(pts, lambda x: x.sec)) >= c.last_ts - 0.25 * (c.last_ts - c.first_ts)
)"""
)
O["channels_paths"] = _detector(CHANNEL, "channel_hits", PATHS)
O["double_triple_paths"] = _detector(DT, "dt_hits", PATHS)
O["triangles_frames"] = _detector(TRI, "tri_hits", FRAMES)
O["breach_guard_all"] = sql(USER, FULL, ALL, select=points("patterns"))
O["detect_patterns_paths"] = sql(PATHS, FULL, ALL, select=points("patterns"))
O["detect_patterns_frames"] = sql(FRAMES, FULL, ALL, select=points("patterns"))
O["breach_guard"] = sql(WALK, FULL, HS, SUFFIX, alive("hs_hits", "live"), select=points("live"))
O["detect_patterns"] = sql(WALK, FULL, ALL, select=points("patterns"))
_TRIM = """kind, round(conf, 6) AS confidence, round(tgt, 6) AS target_price, round(inv, 6) AS invalidation_price"""
O["trim_hits"] = sql(
    WALK, FULL, ALL, select=f"SELECT symbol, hit_no, {_TRIM}, len(pts) AS anchor_count FROM patterns"
)
O["recent_patterns"] = sql(
    WALK,
    FULL,
    ALL,
    select=f"""SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY hit_no) - 1 AS hit_no, {_TRIM},
  len(pts) AS anchor_count FROM recent""",
)
O["pattern_by_rank"] = sql(
    WALK,
    FULL,
    ALL,
    select=f"""SELECT symbol, {_TRIM} FROM recent
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY conf DESC, hit_no) = 1""",
)
O["compact_summary_rows"] = sql(
    WALK,
    FULL,
    ALL,
    select=f"""SELECT symbol, row_number() OVER w - 1 AS no, {_TRIM}, len(pts) AS anchor_count FROM patterns
WINDOW w AS (PARTITION BY symbol ORDER BY conf DESC, hit_no) QUALIFY row_number() OVER w <= 5""",
)
