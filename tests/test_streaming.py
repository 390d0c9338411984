import datetime as dt

import pytest
from pyspark.sql import functions as F
from shapes import candles, walk

from barloom.operators.ranges import price_alerts
from barloom.operators.series import scan_rows
from barloom.schema import CANDLE_SCHEMA
from barloom.session import checkpoint_root
from barloom.sources.resample import resample_candles
from barloom.streaming.jobs import incremental_scan, stream_alerts, stream_resample


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The same bars as a table and as a stream of three files in time order."""
    bars = candles(spark, {"a": walk(150, 1), "b": walk(90, 2)}).cache()
    path = str(tmp_path_factory.mktemp("feed"))
    cuts = [r[0] for r in bars.selectExpr("percentile(unix_seconds(ts), array(0.33, 0.66))").collect()][0]
    sec = F.unix_seconds("ts")
    for part in (bars.where(sec <= cuts[0]), bars.where((sec > cuts[0]) & (sec <= cuts[1])), bars.where(sec > cuts[1])):
        part.coalesce(1).write.mode("append").parquet(path)
    return bars, path


def run(spark, df, mode, name):
    q = (
        df.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", f"{checkpoint_root(spark)}/{name}-{dt.datetime.now().timestamp()}")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.table(name)


def stream(spark, path):
    return spark.readStream.schema(CANDLE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_resample(spark, feed):
    bars, path = feed
    live = {tuple(r) for r in run(spark, stream_resample(stream(spark, path), 4 * 3600), "append", "live_bars").collect()}
    # Final are exactly the buckets that end an hour (the lateness) before the newest bar.
    newest = bars.agg(F.max(F.unix_seconds("ts"))).first()[0]
    closed = F.unix_seconds("ts") + 4 * 3600 <= newest - 3600
    assert live == {tuple(r) for r in resample_candles(bars, 4 * 3600).where(closed).collect()}


def test_late_bars_do_not_change_what_is_settled(spark, feed, tmp_path):
    bars, path = feed
    newest = bars.agg(F.max(F.unix_seconds("ts"))).first()[0]
    for part in (bars, bars.where(F.unix_seconds("ts") < newest - 20 * 3600).limit(5).withColumn("close", F.lit(1e6))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path))
    rules = spark.sql("SELECT * FROM VALUES ('a', 101D, CAST(NULL AS STRING), 'x'), ('b', 100D, 'below', 'z') AS t(symbol, price, direction, note)")
    batch = {tuple(r) for r in price_alerts(bars, rules).collect()}
    assert {tuple(r) for r in run(spark, stream_alerts(stream(spark, str(tmp_path)), rules), "append", "late_alerts").collect()} == batch
    once = run(spark, incremental_scan(stream(spark, path)), "append", "scan_in_time").collect()
    late = run(spark, incremental_scan(stream(spark, str(tmp_path))), "append", "scan_late").collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, late))


def test_alerts_equal_the_batch_form(spark, feed):
    bars, path = feed
    rules = spark.sql(
        "SELECT * FROM VALUES ('a', 101D, CAST(NULL AS STRING), 'x'), ('a', 98D, 'above', 'y'), ('b', 100D, 'below', 'z') AS t(symbol, price, direction, note)"
    )
    batch = {tuple(r) for r in price_alerts(bars, rules).collect()}
    live = {tuple(r) for r in run(spark, stream_alerts(stream(spark, path), rules), "append", "live_alerts").collect()}
    assert live == batch and batch


def test_incremental_scan_confirms_swings_late(spark, feed):
    bars, path = feed
    events = run(spark, incremental_scan(stream(spark, path)), "append", "live_pivots").collect()
    rows = {r.symbol: r for r in scan_rows(bars).collect()}
    swings = {(s, p.idx, p.kind, p.price) for s, r in rows.items() for p in r.swings}
    assert events and {(e.symbol, e.bar_idx, e.kind, e.price) for e in events} <= swings
    for symbol in ("a", "b"):
        own = [e for e in events if e.symbol == symbol]
        kinds = []
        for e in own:
            kinds = [*kinds[:-1], e.kind] if e.action == "replace" else [*kinds, e.kind]
        assert all(x != y for x, y in zip(kinds, kinds[1:], strict=False))


def test_a_shuffled_feed_gives_what_the_ordered_one_gives(spark, feed, tmp_path):
    bars, _ = feed
    mixed = bars.withColumn("_at", F.unix_seconds("ts") + F.pmod(F.xxhash64("symbol", "ts"), F.lit(20)) * 3600)
    cuts = mixed.selectExpr("percentile(_at, array(0.2, 0.4, 0.6, 0.8))").first()[0]
    edges = [float("-inf"), *cuts, float("inf")]
    for a, b in zip(edges, edges[1:], strict=False):
        part = mixed.where((F.col("_at") > a) & (F.col("_at") <= b)).drop("_at").orderBy(F.rand(3))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "mixed"))
    newest = bars.agg(F.max(F.unix_seconds("ts"))).first()[0]
    settled = bars.where(F.unix_seconds("ts") <= newest - 24 * 3600)
    settled.coalesce(1).write.parquet(str(tmp_path / "ordered"))
    rules = spark.sql(
        "SELECT * FROM VALUES ('a', 101D, CAST(NULL AS STRING), 'x'), ('a', 98D, 'above', 'y'), ('b', 100D, 'below', 'z'), ('b', -5D, 'cross', 'never') AS t(symbol, price, direction, note)"
    )
    live = run(spark, stream_alerts(stream(spark, str(tmp_path / "mixed")), rules, "24 hours"), "append", "mixed_alerts").collect()
    assert sorted(map(repr, live)) == sorted(map(repr, price_alerts(settled, rules).select(*live[0].__fields__).collect()))
    live = run(spark, incremental_scan(stream(spark, str(tmp_path / "mixed")), "24 hours"), "append", "mixed_scan").collect()
    once = run(spark, incremental_scan(stream(spark, str(tmp_path / "ordered"))), "append", "ordered_scan").collect()
    assert sorted(map(tuple, live)) == sorted(map(tuple, once)) and once
