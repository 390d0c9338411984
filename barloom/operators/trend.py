"""Trend and piecewise-linear segmentation of a scan row."""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as pf
from pyspark.sql import types as T

from barloom.functions.arrays import let
from barloom.functions.sql import F, Sql

# Workers get this module's functions with the plan and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
MIN_R2 = 0.2
MIN_SLOPE_PCT = 0.05
MAX_SEGMENTS = 8
FLAT_MOVE_PCT = 0.5
IMPULSE_MOVE_PCT = 2.0


def trend_summary() -> Sql:
    """Regression of close on bar number; flat or badly explained series are sideways."""
    n = F.col("n")
    r2 = F.when((n < 2) | (F.col("var_close") == 0), 0.0).otherwise(F.coalesce(F.col("trend_r2"), 0.0))
    slope = F.coalesce(F.col("trend_slope"), 0.0)
    pct = F.coalesce(F.try_divide(slope, F.col("avg_close")) * 100.0, 0.0)
    return let(
        F.struct(("r2", r2), ("slope", slope), ("pct", pct)),
        lambda t: F.struct(
            (
                "direction",
                F.when((t.r2 < MIN_R2) | (F.abs(t.pct) < MIN_SLOPE_PCT), "sideways")
                .when(t.slope > 0, "up")
                .otherwise("down"),
            ),
            ("strength", t.r2),
            ("duration_candles", n),
            ("slope_pct_per_candle", t.pct),
        ),
    )


def trend_by_symbol(indexed: DataFrame, **more: Column) -> DataFrame:
    """Trend of whole histories from plain aggregates over (symbol, bar_idx, close); ``more`` are further aggregates."""
    fits = indexed.groupBy("symbol").agg(
        pf.count("*").alias("n"),
        pf.regr_slope("close", "bar_idx").alias("trend_slope"),
        pf.regr_r2("close", "bar_idx").alias("trend_r2"),
        pf.avg("close").alias("avg_close"),
        pf.var_pop("close").alias("var_close"),
        *[column.alias(name) for name, column in more.items()],
    )
    return fits.withColumn("trend", trend_summary().column()).select("symbol", "trend.*", *more)


def _merge_moments(a: tuple, b: tuple) -> tuple:
    """Pool (n, mean x, mean y, Sxx, Sxy, Syy) of two point sets."""
    n = a[0] + b[0]
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * b[0] / n
    return (
        n,
        a[1] + dx * b[0] / n,
        a[2] + dy * b[0] / n,
        a[3] + b[3] + w * dx * dx,
        a[4] + b[4] + w * dx * dy,
        a[5] + b[5] + w * dy * dy,
    )


def _sse(m: tuple) -> float:
    return m[5] - m[4] * m[4] / m[3] if m[3] > 0 else 0.0


def segment_bounds(closes: np.ndarray, max_segments: int = MAX_SEGMENTS) -> list[int]:
    """Bar numbers where segments meet, both ends included.

    Starts with one segment per pair of bars and keeps joining the two neighbours
    whose joint regression leaves the least squared error (the earliest on ties).
    A heap holds the candidate joins; moments of a join are pooled from its parts,
    so a series of N bars costs O(N log N).
    """
    n = len(closes)
    if n < 2:
        return []
    point = [(1, float(i), float(y), 0.0, 0.0, 0.0) for i, y in enumerate(closes)]
    # Segment i covers bars (i, end[i]]; its first bar belongs to the segment before it.
    inner = dict(enumerate(point[1:]))
    end = {i: i + 1 for i in range(n - 1)}
    before = {i: i - 1 for i in range(1, n - 1)}
    version = dict.fromkeys(range(n - 1), 0)

    def join_cost(i: int) -> float:
        return _sse(_merge_moments(point[i], _merge_moments(inner[i], inner[end[i]])))

    heap = [(join_cost(i), i, 0, 0) for i in range(n - 2)]
    heapq.heapify(heap)
    while len(end) > max_segments:
        _, i, v, w = heapq.heappop(heap)
        j = end.get(i)
        if j is None or j not in end or version[i] != v or version[j] != w:
            continue
        inner[i] = _merge_moments(inner[i], inner.pop(j))
        end[i] = end.pop(j)
        version[i] += 1
        if end[i] in end:
            before[end[i]] = i
            heapq.heappush(heap, (join_cost(i), i, version[i], version[end[i]]))
        p = before.get(i)
        if p is not None:
            heapq.heappush(heap, (join_cost(p), p, version[p], version[i]))
    return [*sorted(end), n - 1]


@pf.pandas_udf(T.ArrayType(T.IntegerType()))
def _segment_bounds(closes: pd.Series) -> pd.Series:
    return closes.map(lambda c: segment_bounds(np.asarray(c, dtype=float)))


def segments(bars: Sql, bounds: Sql, avg: Sql) -> Sql:
    """Label each stretch between two bounds as impulse, correction or consolidation."""

    def one(k: Sql) -> Sql:
        ends = F.struct(("a", F.get(bars, F.get(bounds, k))), ("b", F.get(bars, F.get(bounds, k + 1))))
        return let(
            let(
                ends,
                lambda e: F.struct(
                    ("a", e.a),
                    ("b", e.b),
                    ("pct", F.coalesce(F.try_divide(e.b.close - e.a.close, e.a.close) * 100.0, 0.0)),
                    (
                        "slope",
                        F.coalesce(
                            F.try_divide((e.b.close - e.a.close) / (e.b.idx - e.a.idx), avg) * 100.0, 0.0
                        ),
                    ),
                ),
            ),
            lambda e: F.struct(
                ("from_ts", e.a.ts),
                ("to_ts", e.b.ts),
                ("from_price", e.a.close),
                ("to_price", e.b.close),
                (
                    "kind",
                    F.when((F.abs(e.pct) < FLAT_MOVE_PCT) | (F.abs(e.slope) < MIN_SLOPE_PCT), "consolidation")
                    .when(F.abs(e.pct) >= IMPULSE_MOVE_PCT, "impulse")
                    .otherwise("correction"),
                ),
                ("magnitude_pct", e.pct),
                ("candle_count", e.b.idx - e.a.idx + 1),
            ),
        )

    pairs = F.filter(F.sequence(0, F.size(bounds)), lambda k: k < F.size(bounds) - 1)
    return F.transform(pairs, one)


def with_segments(rows: DataFrame) -> DataFrame:
    """Add ``plr`` to scan rows. The greedy joining runs as one Arrow-batched function."""
    closes: Column = F.transform(F.col("bars"), lambda b: b.close).column()
    rows = rows.withColumn("_bounds", _segment_bounds(closes))
    return rows.withColumn("plr", segments(F.col("bars"), F.col("_bounds"), F.col("avg_close")).column()).drop(
        "_bounds"
    )
