"""N-gram Jaccard join by count vectors in an R-tree.

A text's set holds its distinct k-word shingles as 64-bit hashes. Hashing shingles into groups gives two things:

* *Blocks.* Linked sets with at most D differing shingles share the content of a group wherever no differing shingle falls into it.
  Small sets have more groups than D (and a margin for empty ones), so that one always does. Sets of ``STRONG`` shingles or
  more have fewer and larger groups, which unrelated sets with a common passage rarely share, from as many independent hash functions
  as give ``GROUPS`` groups: linked sets share none of these with a probability below ``MISS`` (of the order of hash
  collisions). Equal contents are found by one shuffle; the connected components of "shares a group" are blocks, and no link leaves
  a block. The numbers depend on a size class; a set takes part in its own class and the one below, since linked sets are in equal or
  neighbouring classes.
* *Points.* Inside a block the counts by group are points of an R-tree. The overlap of two sets is at most the sum of the
  coordinate minima, of a set and a node at most that with the node's upper corner. Pairs that survive are verified
  on the shingles. Pairs that verified links already connect need no check, so a group of copies costs few.

Blocks beyond ``TILE`` shingles are cut into tiles, and pairs of tiles whose size classes can link are joined in tasks of
their own; no pair is left out. Equal sets are one node throughout. The result per row is the component's smallest id.

Signatures are combined before they are shuffled: of rows of a task with equal ones one goes on, and the others' keys are tied to its
key, so that a content which very many sets share does not meet in one window.

Defined results: texts that are null or without words have an empty set and stay alone; rows with the same id are one
document where ids are compared, each with its own set and its own component; null is an id like others, but the smallest of a
component only where it has no other; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import components, release, small, written
from barloom.llm.words import Words, mix, slices

#: Shingles in one tile of a block (8 bytes each in a task).
TILE = 2_000_000
LEAF, FANOUT = 32, 16
#: Set keys a task remembers, to emit the groups of copies once, signatures it combines at a time, and bytes of text and rows that it
#: works on and sends on at once (matters of traffic and memory only).
SEEN, COMBINED, PART, SENT = 100_000, 500_000, 1 << 19, 50_000
#: Least size of sets with larger groups, groups of such a set, and the bound on the probability that linked sets share none.
STRONG, GROUPS, MISS = 64, 96, 1e-9


class Rule:
    """Links sets with 100 * intersection >= percent * union."""

    def __init__(self, k: int = 4, percent: int = 85):
        self.k, self.percent = k, percent
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            b = self.bounds[-1]
            self.bounds.append(max(b + 1, -(-b * 100 // percent)))

    def linked(self, shared: int, a: int, b: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)

    def needed(self, total):
        """Least intersection of linked sets with so many elements together."""
        return -(-self.percent * total // (100 + self.percent))

    def size_class(self, n):
        return np.searchsorted(self.bounds, n, "right") - 1

    def differing(self, c: int) -> int:
        """A bound on the differing shingles of linked sets of which the smaller is in class c."""
        most = self.bounds[c + 1] - 1
        total = most + most * 100 // self.percent
        return max(total - 2 * int(self.needed(total)), 0) + 1  # one more, as smaller totals round differently

    def groups(self, c: int) -> int:
        """Least number of groups of a hash function with which ``GROUPS`` of them keep ``MISS``, for large sets.

        A group is shared where none of the differing shingles falls into it and one of the common does; whether groups are hit is
        negatively associated, so that all fail with at most the product of their probabilities.
        """
        differ, common = self.differing(c), -(-self.bounds[c] * self.percent // 100)
        enough, k = 1 - MISS ** (1 / GROUPS), 2
        while (1 - 1 / k) ** differ * (1 - (1 - 1 / k) ** common) < enough:
            k += max(1, k // 64)
        return k

    def scheme(self, c: int) -> tuple[int, int, int]:
        """Groups, margin of empty groups, and the largest set, for pairs whose smaller set is in class c."""
        most = self.bounds[c + 1] - 1
        differing = self.differing(c)
        margin = 2
        for _ in range(8):
            k = differing + 1 + margin
            empty = k * np.exp(-self.bounds[c] / k)
            margin = int(np.ceil(min(k, empty + 4 * np.sqrt(empty)))) + 1
        return differing + 1 + margin, margin, most * 100 // self.percent


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) by slices."""
    for at, data, offs in slices(column, PART):
        shingles, begin = Words(data, offs).shingles(k)
        yield at, [np.unique(shingles[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _key(s: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) ^ np.uint64(len(s))], np.uint64)).astype(np.int64)[0])


def _signatures(s: np.ndarray, rule: Rule) -> np.ndarray:
    """Content hashes of the groups of a set, under its own scheme and the one below."""
    out, n = [], len(s)
    own = int(rule.size_class(n))
    spread = mix(s)
    high = (s >> np.uint64(32)).astype(np.uint64)
    hashed: list[np.ndarray] = []
    for c in (own, own - 1):
        if c < 0:
            continue
        k, margin, largest = rule.scheme(c)
        if n > largest:
            continue
        if rule.bounds[c] >= STRONG:
            k = rule.groups(c)
            for t in range(-(-GROUPS // k)):
                if t == len(hashed):
                    hashed.append(np.sort(mix(s ^ mix(np.array([t + 7], np.uint64)))))
                group = ((hashed[t] >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
                first = np.flatnonzero(np.diff(group, prepend=np.uint64(k)))
                content = mix(np.add.reduceat(hashed[t], first)) + mix(group[first] * np.uint64(4096) + np.uint64(c * 4 + 3) + np.uint64(t << 50))
                out.append(mix(content[group[first] < GROUPS - t * k]))
            continue
        group = (high * np.uint64(k)) >> np.uint64(32)  # in order, as the hashes are
        first = np.flatnonzero(np.diff(group, prepend=np.uint64(k)))
        tag = np.uint64(c * 4 + 1)
        out.append(mix(np.add.reduceat(spread, first) + mix(group[first] * np.uint64(4096) + tag)))
        if k - len(first) > margin:
            # Two sets that both lack many groups may agree on empty ones only: they meet in their least shingles.
            most = n - int(-(-rule.percent * n // 100)) + 1
            out.append(mix(s[:most] ^ mix(np.array([tag + np.uint64(1)]))))
    return np.concatenate(out)


class RTree:
    """Points in bulk-loaded nodes: per level the upper corners and the smallest set size of each node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._arrange(points, sizes)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(points[self.order], sizes[self.order])]
        step = LEAF
        while len(self.levels[-1][1]) > FANOUT or len(self.levels) == 1:
            top, least = self.levels[-1]
            at = np.arange(0, len(least), step)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at)))
            step = FANOUT

    @staticmethod
    def _arrange(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: by size, then again and again halved along the coordinate that varies most."""
        out, stack = [], [np.argsort(sizes, kind="stable")]
        while stack:
            part = stack.pop()
            if len(part) <= LEAF:
                out.append(part)
                continue
            along = int(points[part].var(axis=0).argmax())
            part = part[np.argsort(points[part, along], kind="stable")]
            half = -(-len(part) // (2 * LEAF)) * LEAF
            stack += [part[half:], part[:half]]
        return np.concatenate(out)

    def search(self, q: np.ndarray, n: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose coordinate minima sum to enough."""
        tops = len(self.levels[-1][1])
        ask, node = np.repeat(np.arange(len(n)), tops), np.tile(np.arange(tops), len(n))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            keep = []
            for a in range(0, len(ask), 1 << 14):
                i, j = ask[a : a + (1 << 14)], node[a : a + (1 << 14)]
                bound = np.minimum(q[i], corner[j]).sum(axis=1, dtype=np.int64)
                keep.append(bound >= rule.needed(n[i] + least[j]))
            kept = np.concatenate(keep) if keep else np.zeros(0, bool)
            ask, node = ask[kept], node[kept]
            if depth:
                step, below = (LEAF if depth == 1 else FANOUT), len(self.levels[depth - 1][1])
                node = (node[:, None] * step + np.arange(step)).ravel()
                ask = np.repeat(ask, step)
                ask, node = ask[node < below], node[node < below]
        return ask, self.order[node]


def _tile_links(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Verified links that connect all that is linked between sides 0 and 1 (side 2: within)."""
    n = np.array([len(s) for s in sets], np.int64)
    groups = int(np.clip(1 << int(np.ceil(np.log2(max(1.0, n.mean() / 6)))), 16, 256))
    points = np.zeros((len(sets), groups), np.int32)
    for i, s in enumerate(sets):
        points[i] = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    inside, queries = np.flatnonzero(side != 0), np.flatnonzero(side != 1)
    if not len(inside) or not len(queries):
        return []
    tree, label, out = RTree(points[inside], n[inside]), np.arange(len(sets)), []
    for a in range(0, len(queries), 64):
        part = queries[a : a + 64]
        ask, found = tree.search(points[part], n[part], rule)
        ask, found = part[ask], inside[found]
        one = (ask != found) & ((side[ask] != 2) | (ask > found))
        ask, found = ask[one], found[one]
        for i in np.unique(ask):
            others = found[ask == i]
            while True:
                others = others[label[others] != label[i]]
                if not len(others):
                    break
                j, others = int(others[0]), others[1:]
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if rule.linked(shared, len(sets[i]), len(sets[j])):
                    label[label == label[j]] = label[i]
                    out.append((int(keys[i]), int(keys[j])))
    return out


def _combined(sig: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """One row of each signature; every other key that has it is tied to this row's key by two rows under a signature of their own."""
    order = np.argsort(sig)
    sig, key = sig[order], key[order]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    low = np.minimum.reduceat(key, first)
    lows = np.repeat(low, np.diff(np.append(first, len(sig))))
    other = key != lows
    ties = np.unique(np.stack([lows[other], key[other]], axis=1), axis=0)
    tie = mix(mix(ties[:, 0].astype(np.uint64)) ^ ties[:, 1].astype(np.uint64)).astype(np.int64)
    sig, key = np.concatenate([sig[first], tie, tie]), np.concatenate([low, ties[:, 0], ties[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key)], ["sig", "key"])


def keyed(docs: DataFrame, text: str = "text", k: int = 4, keep_text: bool = True) -> DataFrame:
    """``docs`` with n, the size of the text's set, and key, its hash (0 for the empty set), which no own column may be called.

    Without ``keep_text`` the texts don't come back from the tasks.
    """
    names = docs.columns
    own = [c for c in names if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, sets in _sets(batch.column(names.index(text)), k):
                for r, s in enumerate(sets, at):
                    n[r], key[r] = len(s), _key(s) if len(s) else 0
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in own], pa.array(n), pa.array(key)], [*own, "n", "key"])

    return docs.mapInArrow(run, (docs if keep_text else docs.drop(text)).selectExpr("*", "0L AS n", "0L AS key").schema)


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    return join_sets(docs, text, doc_id, k, percent).drop("key")


def join_sets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``join`` with key, which tells the sets of a repeated id apart (see ``keyed``)."""
    rule = Rule(k, percent)
    kind = docs.schema[doc_id].dataType
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        local = _remember(Rule(k, percent))
        sig: list[np.ndarray] = []
        key: list[int] = []
        size = 0

        def combined() -> Iterator[pa.RecordBatch]:
            rows = _combined(np.concatenate(sig), np.repeat(np.array(key, np.int64), [len(x) for x in sig]))
            sig.clear()
            key.clear()
            for at in range(0, rows.num_rows, SENT):
                yield rows.slice(at, SENT)

        for batch in small(batches):
            for _, sets in _sets(batch.column(0), k):
                for s in sets:
                    if len(s) and (own := _key(s)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(own)
                        sig.append(_signatures(s, local).astype(np.int64))
                        key.append(own)
                        size += len(sig[-1])
                        if size >= COMBINED:
                            yield from combined()
                            size = 0
        if size:
            yield from combined()
        release()

    nodes = written(keyed(docs, "text", k, keep_text=False), "join-nodes")
    shared = (
        docs.select("text")
        .mapInArrow(signed, "sig long, key long")
        .select("key", F.min("key").over(Window.partitionBy("sig")).alias("low"))
        .where("key <> low")
    )
    blocks = components(shared.select(F.col("key").alias("a"), F.col("low").alias("b")), "join-blocks")
    # Written, so that the tasks that compare tiles don't hold a second Python worker for the contraction of what they find.
    links = written(_links(docs, nodes, written(blocks, "join-block"), rule), "join-found")
    joined = components(links, "join-links").withColumnRenamed("id", "key")
    nodes = nodes.join(joined, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = nodes.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return nodes.join(least, "label", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        "key",
    )


def _remember(rule: Rule) -> Rule:
    """The same rule with its schemes computed once."""
    rule.scheme, rule.groups = functools.cache(rule.scheme), functools.cache(rule.groups)
    return rule


def _links(docs: DataFrame, nodes: DataFrame, blocks: DataFrame, rule: Rule) -> DataFrame:
    """Verified links (a, b) between set keys that connect each component."""
    k = rule.k
    one = nodes.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    member = written(one.join(blocks.select(F.col("id").alias("key"), F.col("label").alias("block")), "key"), "join-member")

    # Ids that stand for several sets, and null, can't tell which text is meant: those texts are looked up by their sets' keys.
    unclear = written(member.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"), "join-unclear")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for at, found in _sets(batch.column(0), k):
                part = batch.slice(at, len(found))
                own = np.array([_key(s) if len(s) else 0 for s in found], np.int64) == part.column(1).to_numpy()
                part = part.append_column("shingles", pa.array([s.tobytes() for s in found], pa.binary())).filter(pa.array(own))
                yield part.select(["shingles", "key", "block", "at"])

    def with_sets(placed: DataFrame) -> DataFrame:
        texts = docs.join(placed.select("doc_id", "key", "block", "at"), "doc_id").select("text", "key", "block", "at")
        if not unclear.isEmpty():
            same = F.col("u.doc_id").eqNullSafe(F.col("d.doc_id"))
            texts = docs.alias("d").join(unclear.alias("u"), same, "left_anti").join(placed, "doc_id").select("text", "key", "block", "at")
            meant = keyed(docs.alias("d").join(unclear.alias("u"), same, "left_semi").select("text"), "text", k)
            meant = meant.groupBy("key").agg(F.first("text").alias("text"))
            theirs = placed.alias("d").join(unclear.alias("u"), same, "left_semi").select("key", "block", "at")
            texts = texts.unionAll(meant.join(theirs, "key").select("text", "key", "block", "at"))
        return texts.mapInArrow(sets, texts.selectExpr("cast('' as binary) AS shingles", "key", "block", "at").schema)

    return tiled_links(member, with_sets, rule)


def tiled_links(member: DataFrame, with_sets: Callable[[DataFrame], DataFrame], rule: Rule, by_size: bool = True) -> DataFrame:
    """Verified links (a, b) that connect each component, of sets (key, n, block) of which no link leaves its block.

    ``with_sets`` gets the members with a column ``at`` and returns (shingles, key, block, at), shingles being the sorted
    64-bit hashes of the set as bytes. With ``by_size``, n is the exact size and tiles of sizes that can't link don't meet.
    """
    bounds = F.array(*[F.lit(b).cast("long") for b in rule.bounds])
    size_class = F.size(F.filter(bounds, lambda b: b <= F.col("n")))
    weight = member.groupBy("block").agg(F.sum("n").alias("weight"))
    big = F.col("weight") > TILE
    member = member.join(weight, "block").withColumn("class", F.when(big, size_class if by_size else F.lit(1)).otherwise(F.lit(0)))
    tiles = member.groupBy("block", "class").agg(F.ceil(F.sum("n") / F.lit(TILE)).cast("int").alias("tiles"))
    above = tiles.select("block", (F.col("class") - 1).alias("class"), F.col("tiles").alias("tiles_above"))
    below = tiles.select("block", (F.col("class") + 1).alias("class"), F.col("tiles").alias("tiles_below"))
    plan = tiles.join(above, ["block", "class"], "left").join(below, ["block", "class"], "left")
    member = member.join(plan, ["block", "class"]).withColumn("tile", F.expr("cast(pmod(xxhash64(key), tiles) as int)"))
    # Where a member's tile is compared: with itself and the other tiles of its class, and with those of the classes beside it.
    same = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda t: F.struct(
            F.col("class").alias("c"),
            F.least(t, F.col("tile")).alias("i"),
            F.greatest(t, F.col("tile")).alias("j"),
            F.lit(False).alias("next"),
            F.when(t == F.col("tile"), 2).when(F.col("tile") < t, 0).otherwise(1).alias("side"),
        ),
    )
    none = F.expr("cast(array() as array<struct<c:int,i:int,j:int,next:boolean,side:int>>)")
    up = F.transform(
        F.sequence(F.lit(0), F.col("tiles_above") - 1),
        lambda t: F.struct(F.col("class").alias("c"), F.col("tile").alias("i"), t.alias("j"), F.lit(True).alias("next"), F.lit(0).alias("side")),
    )
    down = F.transform(
        F.sequence(F.lit(0), F.col("tiles_below") - 1),
        lambda t: F.struct((F.col("class") - 1).alias("c"), t.alias("i"), F.col("tile").alias("j"), F.lit(True).alias("next"), F.lit(1).alias("side")),
    )
    beside = F.concat(same, F.coalesce(up, none), F.coalesce(down, none))

    placed = with_sets(member.withColumn("at", beside)).select("block", "key", "shingles", F.explode("at").alias("at"))
    placed = placed.select("block", "key", "shingles", "at.*")

    def tile(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy()
        _, first = np.unique(keys, return_index=True)  # rows that repeat bring a set twice
        shingles = table["shingles"]
        sets = [np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in first.tolist()]  # no copies
        found = _tile_links(keys[first], sets, table["side"].to_numpy()[first], rule)
        out = pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})
        if table.nbytes > PART:
            del table, shingles, sets
            release()
        return out

    return placed.groupBy("block", "c", "i", "j", "next").applyInArrow(tile, "a long, b long")
