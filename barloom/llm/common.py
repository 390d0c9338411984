"""Shared folder, written tables and connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine, as in tests) gets a folder of its own; a cluster gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="barloom-")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: cuts lineage, is computed once and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives the system back what Arrow and Python have freed; a worker that is used again would keep it from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows (no copies), so that what a task holds besides stays small."""
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


#: Vertices that a task of ``stars`` holds, and edges that one task of its second pass reads.
VERTICES, EDGES = 150_000, 2_000_000


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b), b < a, that connect what the given ones of a task connect: every vertex with its component's smallest.

    A task holds at most ``VERTICES`` vertices; beyond, what it knows is sent on and it begins anew. Nothing is lost by that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            top = v
            while (up := parent.get(top, top)) != top:
                top = up
            while v != top:
                parent[v], v = top, parent.get(v, top)
            return top

        def known() -> Iterator[pa.RecordBatch]:
            a = np.fromiter(parent, np.int64, len(parent))
            for at in range(0, len(a), 50_000):
                part = a[at : at + 50_000]
                b = np.fromiter(map(root, part.tolist()), np.int64, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(b)], ["a", "b"])
            parent.clear()

        for batch in small(batches, 50_000):
            pairs = np.unique(np.stack([c.to_numpy() for c in batch.columns], axis=1), axis=0)
            for a, b in pairs.tolist():
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > VERTICES:
                yield from known()
        yield from known()
        release()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, label), label the smallest id of the component.

    Tasks first reduce their edges to stars. Then the two star operations of large-star / small-star contraction alternate: every
    edge list is written before the next round, and a round ends in stars when nothing moves. Per-vertex minima are plain aggregates and
    the rows are joined back, so that a vertex with very many neighbours is never gathered. Null ends are ignored.
    """
    plain = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    cur = written(stars(plain), name)
    # Once more over all tasks' stars, in as few tasks as their number allows.
    cur = written(stars(cur.coalesce(cur.count() // EDGES + 1)).distinct(), name)
    before = None
    for _ in range(rounds):
        # Large star: neighbours above v move to the smallest of v and its neighbours.
        both = cur.select("a", "b").unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        big = cur.join(low, cur["b"] == low["v"]).select(F.col("a"), F.col("m").alias("b"))
        big = big.where("a <> b").distinct()
        # Small star: v and its neighbours below move to the smallest of them.
        low2 = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low2, "a").select("a", "b", "m")
        nxt = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low2.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        nxt = written(nxt, name)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        cur = nxt
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.select(F.col("a").alias("id"), F.col("b").alias("label")).unionAll(
        cur.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    )

