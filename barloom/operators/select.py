"""Choosing and trimming hits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.functions.rows import each, each_struct
from barloom.functions.sql import F, Sql
from barloom.schema import PATTERN_KINDS

# Fixed value: the share of the time span that counts as current.
RECENT_FRACTION = 0.25


def trim(hit: Sql) -> Sql:
    return F.struct(
        ("kind", hit.kind),
        ("confidence", hit.confidence),
        ("target_price", hit.target_price),
        ("invalidation_price", hit.invalidation_price),
        ("anchor_count", F.size(hit.points)),
    )


def by_confidence(hits: Sql) -> Sql:
    """Most confident first; detection order on ties."""
    keyed = F.transform(hits, lambda h, i: F.struct(("k", -h.confidence), ("i", i), ("h", h)))
    return F.transform(
        F.array_sort(keyed, lambda a, b: F.when(a.k != b.k, F.when(a.k < b.k, -1).otherwise(1)).otherwise(a.i - b.i)),
        lambda x: x.h,
    )


def top_hits(hits: Sql, k: int) -> Sql:
    return F.transform(F.slice(by_confidence(hits), 1, k), trim)


def is_recent(hit: Sql, first_ts: Sql, last_ts: Sql, fraction: float = RECENT_FRACTION) -> Sql:
    """Does the hit's latest point fall into the last part of the series?"""
    latest = F.coalesce(F.array_max(F.transform(hit.points, lambda p: p.ts)), 0)
    return (last_ts <= first_ts) | (latest >= last_ts - fraction * (last_ts - first_ts))


def recent_hits(hits: Sql, first_ts: Sql, last_ts: Sql, fraction: float = RECENT_FRACTION) -> Sql:
    return F.filter(hits, lambda h: is_recent(h, first_ts, last_ts, fraction))


def trim_hits(rows: DataFrame) -> DataFrame:
    """One row per pattern without its points."""
    trimmed = F.transform(F.col("patterns"), trim)
    return each(rows, trimmed, "symbol", no="hit_no").select("symbol", "hit_no", "x.*")


def recent_patterns(rows: DataFrame, fraction: float = RECENT_FRACTION) -> DataFrame:
    """Scan rows whose ``patterns`` are limited to those that still speak to the current price."""
    return rows.withColumn(
        "patterns", recent_hits(F.col("patterns"), F.col("first_ts"), F.col("last_ts"), fraction).column()
    )


def pattern_by_rank(rows: DataFrame, kind: str | None = None, rank: int = 0) -> DataFrame:
    """The rank-th most confident recent hit of each symbol, optionally of one kind."""
    if kind is not None and kind not in PATTERN_KINDS:
        raise ValueError(f"unknown pattern kind {kind!r}")
    hits = recent_hits(F.col("patterns"), F.col("first_ts"), F.col("last_ts"))
    if kind is not None:
        hits = F.filter(hits, lambda h: h.kind == kind)
    return each_struct(rows, F.slice(by_confidence(hits), rank + 1, 1), "symbol")
