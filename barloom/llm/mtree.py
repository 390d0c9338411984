"""Exact top-k by inner product with M-trees: paged metric nodes, searched best first.

Vectors become whole numbers. Rows are dealt to pages near one of ``PIVOTS`` sampled rows (a bounded sample that only shapes the
pages), and pages of more than ``PAGE`` rows are split by a hash of the id, so equal vectors never make a large page. In a
page every node has a routing vector, a covering radius, the distance to its parent's routing vector and its largest norm; leaf
entries have their distance to the leaf's. The pages are a written table.

Since q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, a lower bound of a distance bounds a score from above. The triangle
inequality over stored parent distances gives such a bound before any distance is computed; nodes and entries that
can't reach the k-th best score so far are skipped, the others are taken best first. The first bar is the k-th score
among ``SEEDS`` sampled rows. Query blocks meet pages block by block, and the best of all pages are ranked.

Scores are exact integers. Defined results: vectors that are null, or hold null or non-finite components, and rows
without an id take no part; vectors of different length are never compared; ties go to the smaller id; rows with the
query's own id are no candidates; repeated candidates count once for each row; no rows give no results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import written

PIVOTS, SEEDS, PAGE, LEAF, QUERIES = 16, 512, 8192, 256, 512


def whole(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """Rows (vec_id, v, dim) of usable vectors, components floor(scale * x)."""
    x: Column = F.col(vector)
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & usable)
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).withColumn("dim", F.size("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class _Page:
    """An M-tree over the rows of a page, as flat arrays; node 0 is the root."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.norms = np.sqrt((self.x**2).sum(axis=1))
        self.order: list[np.ndarray] = []
        self.left, self.right, self.first, self.last = [], [], [], []
        self.radius, self.above, self.norm, self.routing, self.entry = [], [], [], [], []
        self.count = 0
        stack = [(np.arange(len(x)), -1, False)]
        while stack:
            rows, parent, is_right = stack.pop()
            node = len(self.left)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            mean = self.x[rows].mean(axis=0)
            center = rows[((self.x[rows] - mean) ** 2).sum(axis=1).argmin()]
            far = np.sqrt(((self.x[rows] - self.x[center]) ** 2).sum(axis=1))
            self.left.append(-1)
            self.right.append(-1)
            self.routing.append(center)
            self.radius.append(far.max())
            self.norm.append(self.norms[rows].max())
            self.above.append(0.0 if parent < 0 else float(np.sqrt(((self.x[center] - self.x[self.routing[parent]]) ** 2).sum())))
            if len(rows) <= LEAF or far.max() == 0:
                self.first.append(self.count)
                self.count += len(rows)
                self.order.append(rows)
                self.entry.append(far)
            else:
                self.first.append(-1)
                one = self.x[rows[far.argmax()]]
                near = ((self.x[rows] - one) ** 2).sum(axis=1)
                other = self.x[rows[near.argmax()]]
                side = near <= ((self.x[rows] - other) ** 2).sum(axis=1)
                if side.all() or not side.any():
                    side = np.arange(len(rows)) % 2 == 0
                stack += [(rows[~side], node, True), (rows[side], node, False)]
            self.last.append(self.count)

    def arrays(self) -> dict[str, np.ndarray]:
        order = np.concatenate(self.order)
        out = {k: np.array(getattr(self, k), np.int64) for k in ("left", "right", "first", "last")}
        out |= {k: np.array(getattr(self, k), np.float64) for k in ("radius", "above", "norm")}
        return out | {"center": self.x[self.routing], "entry": np.concatenate(self.entry), "order": order}


_TREE = ("left", "right", "first", "last", "radius", "above", "norm", "center", "entry")
PAGES = "page string, dim int, ids binary, vectors binary, " + ", ".join(f"{f} binary" for f in _TREE)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    dim = key[1].as_py()
    x = _matrix(table["v"].combine_chunks(), dim) if dim else np.zeros((len(table), 0), np.int64)
    a = _Page(x).arrays()
    order = a.pop("order")
    row = {"page": key[0].as_py(), "dim": dim, "ids": table["vec_id"].to_numpy()[order].tobytes(), "vectors": x[order].astype(np.int64).tobytes()}
    row |= {f: a[f].tobytes() for f in _TREE}
    kinds = pa.schema([("page", pa.string()), ("dim", pa.int32())] + [(f, pa.binary()) for f in ("ids", "vectors", *_TREE)])
    return pa.Table.from_pylist([row], kinds)


def pages(rows: DataFrame) -> DataFrame:
    """The written table of paged M-trees over rows (vec_id, v, dim)."""
    pivots = rows.orderBy(F.xxhash64("vec_id")).limit(PIVOTS).collect()
    by_dim: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in pivots}:
        by_dim[dim] = np.array([r["v"] for r in pivots if r["dim"] == dim], np.float64).reshape(-1, dim)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cell = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int32)
            for dim, p in by_dim.items():
                at = np.flatnonzero(dims == dim)
                if len(at) and dim:
                    x = _matrix(b.column(1).take(pa.array(at)), dim).astype(np.float64)
                    cell[at] = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["vec_id", "v", "dim", "cell"])

    celled = written(rows.mapInArrow(nearest, "vec_id long, v array<long>, dim int, cell int"), "mtree-cells")
    split = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(PAGE)).cast("int").alias("parts"))
    placed = celled.join(split, ["dim", "cell"]).withColumn(
        "page", F.concat_ws("-", "dim", "cell", F.expr("pmod(xxhash64(vec_id), parts)").cast("string"))
    )
    return written(placed.select("page", "dim", "vec_id", "v").groupBy("page", "dim").applyInArrow(_build, PAGES), "mtree-pages")


class _Search:
    """Best-first search of one page."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.exact = np.frombuffer(row["vectors"], np.int64).reshape(-1, self.dim)
        peak = float(np.abs(self.exact.astype(np.float64)).max(initial=0.0))
        self.peak, self.x = peak, self.exact.astype(np.float64)
        self.square = (self.x**2).sum(axis=1)
        for f in _TREE:
            setattr(self, f, np.frombuffer(row[f], np.int64 if f in ("left", "right", "first", "last") else np.float64))
        self.center = self.center.reshape(-1, self.dim)
        self.center_square = (self.center**2).sum(axis=1)

    def top(self, own: int, q: np.ndarray, k: int, bar: float) -> list[tuple[int, int]]:
        """The k best (score, -id) of the page that reach the bar, for the query with this id."""
        qf = q.astype(np.float64)
        qq = float(qf @ qf)
        length = qq**0.5
        slack = 1e-9 * (qq + float(self.norm[0]) ** 2) + 1e-6
        safe = self.dim * self.peak * float(np.abs(qf).max(initial=0.0)) < 2**52
        best: list[tuple[int, int]] = []
        left, right, first, last, radius, above, norm = self.left, self.right, self.first, self.last, self.radius, self.above, self.norm
        start = float(np.sqrt(max(0.0, qq + self.center_square[0] - 2 * self.center[0] @ qf)))
        heap = [(-np.inf, 0, start)]
        while heap:
            bound, node, far = heapq.heappop(heap)
            if -bound < bar:
                break
            if first[node] >= 0:
                a, b = first[node], last[node]
                low = np.abs(far - self.entry[a:b])
                able = np.flatnonzero((qq + self.square[a:b] - low * low) / 2 + slack >= bar) + a
                if not len(able):
                    continue
                scores = (self.x[able] @ qf).astype(np.int64) if safe else self.exact[able] @ q
                good = scores >= bar
                for s, i in zip(scores[good].tolist(), self.ids[able[good]].tolist(), strict=True):
                    if i != own:
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    bar = max(bar, best[0][0])
                continue
            for child in (left[node], right[node]):
                r, high = radius[child], norm[child]
                low = max(0.0, abs(far - above[child]) - r)
                if (qq + high * high - low * low) / 2 + slack < bar:
                    continue  # no distance computed
                dot = float(self.center[child] @ qf)
                away = max(0.0, qq + self.center_square[child] - 2 * dot) ** 0.5
                low = max(0.0, away - r)
                reach = min((qq + high * high - low * low) / 2, dot + length * r) + slack
                if reach >= bar:
                    heapq.heappush(heap, (-reach, int(child), away))
        return sorted(best, reverse=True)


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every query; both sides as ``whole`` gives them."""
    tree = pages(rows)
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(1))).limit(SEEDS).collect()
    for dim in {r["dim"] for r in sample}:
        own = [r for r in sample if r["dim"] == dim]
        seeds[dim] = (np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64).reshape(-1, dim))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = _matrix(table["v"].combine_chunks(), dim) if dim else np.zeros((len(table), 0), np.int64)
        ids, bars = table["vec_id"].to_numpy(), np.full(len(table), -np.inf)
        if dim in seeds and len(seeds[dim][0]) > k:
            scores = x.astype(np.float64) @ seeds[dim][1].T
            scores[ids[:, None] == seeds[dim][0]] = -np.inf
            # A little below the k-th best score among the seeds: rounding must not lift the bar.
            kth = np.partition(scores, -k, axis=1)[:, -k]
            bars = kth - 1 - 1e-9 * np.abs(kth)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "q_ids": [ids.tobytes()], "q": [x.astype(np.int64).tobytes()], "bars": [bars.tobytes()]})

    queries = queries.dropDuplicates(["vec_id", "v"])
    count = queries.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("blocks"))
    blocked = queries.join(count, "dim").withColumn("block", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)"))
    blocked = written(
        blocked.select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInArrow(packed, "dim int, block int, q_ids binary, q binary, bars binary"),
        "mtree-queries",
    )
    # Every query block meets every page once; both are of bounded size, and the pairs are dealt evenly.
    pairs = tree.select("page", "dim").join(blocked.select("dim", "block"), "dim")
    met = pairs.join(blocked, ["dim", "block"]).join(tree.drop("dim"), "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                page, found = _Search(row), []
                q = np.frombuffer(row["q"], np.int64).reshape(-1, row["dim"])
                for own, v, bar in zip(np.frombuffer(row["q_ids"], np.int64).tolist(), q, np.frombuffer(row["bars"], np.float64).tolist(), strict=True):
                    found += [(own, -i, s) for s, i in page.top(own, v, k, bar)]
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
