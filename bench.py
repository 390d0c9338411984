"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up (code generation, JIT) and is then timed in full:
building the plan, optimizing it and computing all rows and columns.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans.catalog import QUERIES  # noqa: E402
from barloom.session import local_session  # noqa: E402
from barloom.sources.views import candles_frames, candles_paths  # noqa: E402

HEADLINE = (
    "resample_candles_4h",
    "trending_with_bands",
    "atr_ticks",
    "rsi_ticks",
    "macd",
    "series_pivots_ticks",
    "divergences",
    "find_levels",
    "plr_segments",
    "detect_patterns_paths",
    "detect_patterns_frames",
    "thesis",
    "rank_setups_users",
    "price_alerts",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def phases_of(build) -> dict[str, float]:
    """Seconds for building and analysing the plan, and for optimizing it."""
    start = time.perf_counter()
    df = build()
    built = time.perf_counter()
    df._jdf.queryExecution().optimizedPlan()
    return {"build": round(built - start, 3), "optimize": round(time.perf_counter() - built, 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    phases: dict[str, dict[str, float]] = {}
    for name in HEADLINE:
        run(QUERIES[name](spark, sf_dir))
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
        phases[name] = phases_of(lambda name=name: QUERIES[name](spark, sf_dir))
    rates = {}
    for name, view in (("detect_patterns_paths", candles_paths), ("detect_patterns_frames", candles_frames)):
        bars = view(spark, sf_dir).groupBy("symbol").count().selectExpr("sum(count)", "count(*)").first()
        rates[name] = {
            "bars_per_sec": round(bars[0] / times[name]),
            "symbols_per_sec": round(bars[1] / times[name], 1),
        }
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "rates": rates,
                "phases": phases,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
