"""Substring dedup: near-equal paragraphs by MinHash banding.

A paragraph here is a run of whole sentences (ended by . ! ? or a line end) of at least ``LEAST`` words, and one begins at every
sentence of at least ``FIRST`` words. Where sentences are shorter, one begins at those whose first words hash to the least value
within ``FIRST`` words (content alone decides, so copies choose alike): were one to begin at each, neighbours in a document would be
near-equal and chain copies to what lies beside them.

Sentences end differently around a copy, and not everywhere by these signs. So there are also windows of ``LEAST`` words, which
begin where the hash of the first words falls into one of ``EVERY`` parts (mostly no word outside has a say, so copies choose alike) and,
where none of ``SPAN`` in a row does, at the least of these: any run of ``LEAST + SPAN - 1`` words that two texts share holds
one (if rich, see below), wherever it lies and whatever its signs. Windows are compared for equality only, which
costs no bands: 80 % alike, they share 19 words in a row anyway.

A paragraph's set holds its five-word
shingles; paragraphs and windows in which fewer than ``DISTINCT`` differ from the one before (repeated words) are no passages.

Banding goes in two steps, which together reach ``RECALL`` at the threshold (see ``tune``). All paragraphs have a few keys of one hash function each;
those that share none with another document have nothing near them. The others, few, have keys of ``ROWS`` hash functions, which unrelated
paragraphs hardly share. Paragraphs that collide in these are joined into blocks, inside which pairs are verified by exact Jaccard (small blocks at once, large ones in tiles, with count
vectors to skip pairs and links already connected to skip checks), and components of verified links are clusters. Equal paragraphs
are one node, whose occurrences are told apart only at the end. In a cluster that spans documents the occurrence with the
smallest (doc_id, start) is kept, all others are removals; overlapping occurrences in a document are joined to spans.

Defined results: null, empty and short texts have no paragraphs; rows that repeat an id are one document; a passage that repeats
only inside one document is left alone; without repeats there are no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import components, written
from barloom.llm.jaccard_join import Rule, tiled_links
from barloom.llm.words import Words, mix, powers, slices

LEAST, FIRST, DISTINCT, SHINGLE = 20, 4, 10, 5
EVERY, SPAN = 5, 31
#: Bytes of text worked on at once (a longer text is whole).
PART = 1 << 19
#: Paragraphs times shingles of blocks whose pairs are all verified at once; larger ones go by tiles.
SMALL = 1 << 20
PERCENT, RECALL, ROWS = 80, 0.99, 5
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def tune(percent: int, recall: float, rows: int = ROWS) -> tuple[int, int]:
    """(keys of one hash function, keys of ``rows``): the fewest with which both steps together find pairs at the threshold so surely."""
    j = percent / 100
    first = int(np.ceil(np.log(1 - recall) / np.log(1 - j)))
    if (1 - (1 - j) ** first) <= recall:
        first += 1
    rest = recall / (1 - (1 - j) ** first)
    return first, int(np.ceil(np.log(1 - rest) / np.log(1 - j**rows)))


def signatures(shingle: np.ndarray, span: np.ndarray, bands: int, rows: int, salt: int = 0) -> np.ndarray:
    """Band keys of the sets ``shingle[span[2 i] : span[2 i + 1]]``: of each hash function the least value."""
    out = np.zeros((len(span) // 2, bands), np.uint64)
    if not len(span):
        return out
    for b in range(bands):
        for r in range(rows):
            seed = np.uint64(0x9E3779B97F4A7C15 * (salt + b * rows + r + 1) & (2**64 - 1))
            value = np.append(mix(shingle ^ seed), np.uint64(2**64 - 1))
            out[:, b] = mix(out[:, b] * np.uint64(31) + np.minimum.reduceat(value, span)[::2] + np.uint64(b))
    return out


class Paragraphs:
    """Paragraphs of the rows of a slice, with or without windows: row, first word, word after the last, and content hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, windows: bool = False):
        self.words = w = Words(data, offs)
        n = len(w.hash)
        self.begin = self.stop = self.row = np.zeros(0, np.int64)
        self.shingle = np.zeros(0, np.uint64)
        self.node = np.zeros(0, np.int64)
        if n < LEAST:
            return
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        ended = _ENDS[data[w.end - 1]]
        ended[:-1] |= (lines[w.start[1:]] > lines[w.end[:-1]]) | (w.row[1:] != w.row[:-1])
        ended[-1] = True
        starts = np.flatnonzero(np.append(True, ended[:-1]))
        stops = np.flatnonzero(ended) + 1
        self.shingle = _shingles(w.hash)
        starts = self._apart(starts, stops)
        at = np.searchsorted(stops, starts + LEAST)  # the first sentence end at least LEAST words on
        stop = stops[np.minimum(at, len(stops) - 1)]
        ok = (stop - starts >= LEAST) & (stop <= w.first[w.row[starts] + 1])
        begin, stop = starts[ok], stop[ok]
        # Repeated words repeat the shingle before them; a passage has many that do not. Only words inside count.
        changed = np.concatenate([[0], np.cumsum(np.append(True, self.shingle[1:] != self.shingle[:-1]))])
        rich = lambda begin, stop: changed[stop - SHINGLE + 1] - changed[begin + 1] >= DISTINCT - 1
        some = rich(begin, stop)
        self.begin, self.stop = begin[some], stop[some]
        if windows:
            begin = np.arange(n - LEAST + 1)
            begin = self._least(rich(begin, begin + LEAST))
            every = np.unique(np.stack([np.append(self.begin, begin), np.append(self.stop, begin + LEAST)], axis=1), axis=0)
            self.begin, self.stop = every[:, 0], every[:, 1]
        self.row = w.row[self.begin]
        self.node = _contents(w.hash, self.begin, self.stop)

    def _apart(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Beginnings of the long sentences, and of the short ones that are least among those within FIRST words."""
        w, far = self.words, np.uint64(2**64 - 1)
        long, room = stops - starts >= FIRST, w.first[w.row[starts] + 1] - starts >= LEAST
        value = np.full(len(w.hash) + 2 * FIRST, far)
        value[starts[long & room] + FIRST] = 0
        short = starts[~long & room]
        own = value[short + FIRST] = self.shingle[short] | np.uint64(1)
        least = np.ones(len(short), bool)
        for d in range(1, FIRST):
            least &= (own < value[short + FIRST - d]) & (own <= value[short + FIRST + d])
        return np.sort(np.concatenate([starts[long], short[least]]))

    def _least(self, rich: np.ndarray) -> np.ndarray:
        """Where rich windows begin that are chosen: one in EVERY, and the (first) least of SPAN in a row of a text that has none."""
        n, row = len(rich), self.words.row
        value = np.where(rich, self.shingle[:n] >> np.uint64(1), np.uint64(2**64 - 1))
        low = value < np.uint64(2**63 // EVERY)
        found = [np.flatnonzero(low & (row[:n] == row[LEAST - 1 :]))]
        count = n - SPAN + 1
        if count > 0:
            lows, riches = (np.concatenate([[0], np.cumsum(x)]) for x in (low, rich))
            bare = (lows[SPAN:] == lows[:count]) & (riches[SPAN:] > riches[:count]) & (row[:count] == row[SPAN + LEAST - 2 :])
            bare = np.flatnonzero(bare)
            for a in range(0, len(bare), 1 << 14):
                at = bare[a : a + (1 << 14)]
                found.append(at + value[at[:, None] + np.arange(SPAN)].argmin(axis=1))
        return np.unique(np.concatenate(found))

    def bands(self, bands: int) -> np.ndarray:
        """Keys of one hash function, paragraphs by bands."""
        return signatures(self.shingle, np.stack([self.begin, self.stop - SHINGLE + 1], axis=1).ravel(), bands, 1)


def _contents(h: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words from begin to before stop, wherever these lie."""
    up, down = powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    return mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64)).astype(np.int64)


def _shingles(h: np.ndarray) -> np.ndarray:
    rolled = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : len(rolled) + k]
    return mix(rolled)


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """Repeated passages: (doc_id, start, end, n_words, cluster, first_doc, kept); start and end are code points, end exclusive."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    first, second = tune(percent, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, offs in slices(batch.column(1), PART):
                p = Paragraphs(data, offs)
                keys = p.bands(first).astype(np.int64).ravel()
                yield _combined(keys, np.repeat(p.node, first), np.repeat(ids[at + p.row], first))

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, offs in slices(batch.column(1), PART):
                p = Paragraphs(data, offs, windows=True)
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                zero = point[offs[p.row]]
                start, end = point[p.words.start[p.begin]] - zero, point[p.words.end[p.stop - 1]] - zero
                columns = [p.node, ids[at + p.row], start.astype(np.int32), end.astype(np.int32), (p.stop - p.begin).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "doc_id", "start", "end", "words"])

    near = written(_colliding(docs.mapInArrow(keyed, "band long, node long, from long, to long")).select("node").distinct(), "passage-near")
    # Paragraphs that occur in more than one document, or may have another's near them.
    every = docs.mapInArrow(occurring, "node long, doc_id long, start int, end int, words int")
    every = every.withColumns({"low": F.min("doc_id").over(Window.partitionBy("node")), "high": F.max("doc_id").over(Window.partitionBy("node"))})
    some = every.join(near.withColumn("near", F.lit(True)), "node", "left")
    occurs = written(some.where("near OR low < high"), "passage-occurs")
    rule = Rule(SHINGLE, percent)
    place = F.min(F.struct("doc_id", "start", "end"))
    placed = occurs.where("near").groupBy("node").agg(place.alias("place"), F.max("high").alias("to"))
    placed = placed.select(F.col("node").alias("key"), "place.doc_id", "place.start", "place.end", "to")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offs in slices(batch.column(0), PART):
                w = Words(data, offs)
                found = [np.unique(_shingles(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                part = batch.slice(at, len(found)).append_column("shingles", pa.array([s.tobytes() for s in found], pa.binary()))
                part = part.append_column("n", pa.array([len(s) for s in found], pa.int64()))
                own = _contents(w.hash, w.first[:-1], w.first[1:]) == part.column(1).to_numpy()  # of texts with one id, the right one
                yield part.filter(pa.array(own)).select(["key", "from", "to", "n", "shingles"])

    texts = docs.join(placed, "doc_id").select(F.expr("substring(text, start + 1, end - start)").alias("text"), "key", F.col("doc_id").alias("from"), "to")
    held = written(texts.mapInArrow(sets, "key long, from long, to long, n long, shingles binary"), "passage-sets")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, low, high = (batch.column(i).to_numpy() for i in range(3))
                end = np.cumsum(batch.column(3).to_numpy())
                shingle = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64)
                span = np.stack([np.append(0, end[:-1]), end], axis=1).ravel()
                keys = signatures(shingle, span, second, ROWS, salt=first).astype(np.int64).ravel()
                yield _combined(keys, *(np.repeat(x, second) for x in (key, low, high)))

    shared = _colliding(held.mapInArrow(banded, "band long, node long, from long, to long")).where("node <> low")
    blocks = components(shared.select(F.col("node").alias("a"), F.col("low").alias("b")), "passage-blocks")
    blocks = blocks.select(F.col("id").alias("key"), F.col("label").alias("block"))
    blocks = blocks.join(held.groupBy("key").agg(F.min("n").alias("n")), "key")
    size = blocks.groupBy("block").agg((F.count("*") * F.sum("n") <= SMALL).alias("small"))
    member = written(blocks.join(size, "block"), "passage-member")

    def with_sets(at: DataFrame) -> DataFrame:
        return held.select("key", "shingles").join(at.select("key", "block", "at"), "key").select("shingles", "key", "block", "at")

    small = held.select("key", "shingles").join(member.where("small").select("key", "block"), "key").select("block", "key", "shingles")
    links = small.repartition("block").sortWithinPartitions("block", "key").mapInArrow(_small_links(rule), "a long, b long")
    links = links.unionAll(tiled_links(member.where("NOT small").select("key", "n", "block"), with_sets, rule))
    linked = components(links, "passage-links").select(F.col("id").alias("node"), "label")
    told = occurs.join(linked, "node", "left").withColumn("cluster", F.coalesce("label", "node"))
    cluster = told.groupBy("cluster").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"))
    told = told.join(cluster.where("first.doc_id < last"), "cluster").select(
        "doc_id", "start", "end", "words", "cluster", F.col("first.doc_id").alias("first_doc"), (F.struct("doc_id", "start") == F.col("first")).alias("kept")
    )
    return _spans(told)


def _small_links(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verified links of small blocks from rows (block, key, shingles) sorted by block; a block may go on in the next batch."""

    def links(table: pa.Table) -> pa.RecordBatch:
        block, key = table["block"].to_numpy(), table["key"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out = [np.zeros((0, 2), np.int64)]
        for a, b in zip(first, np.append(first[1:], len(block)), strict=True):
            n = np.array([len(s) for s in sets[a:b]])
            _, at = np.unique(np.concatenate(sets[a:b]), return_inverse=True)
            held = np.zeros((b - a, int(at.max()) + 1), np.float32)
            held[np.repeat(np.arange(b - a), n), at] = 1
            shared = (held @ held.T).astype(np.int64)
            i, j = np.nonzero(np.triu(rule.linked(shared, n[:, None], n[None, :]), 1))
            out.append(np.stack([key[a + i], key[a + j]], axis=1))
        found = np.concatenate(out)
        found = found[found[:, 0] != found[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = table if held is None else pa.concat_tables([held, table])
                block = table["block"].to_numpy()
                cut = int(np.searchsorted(block, block[-1]))
                held = table.slice(cut)
                if cut:
                    yield links(table.slice(0, cut))
        if held is not None:
            yield links(held)

    return run


def _combined(band: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> pa.RecordBatch:
    """One row of each (band, node), with the least and the greatest of its documents."""
    high = low if high is None else high
    order = np.lexsort((node, band))
    band, node = band[order], node[order]
    at = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (node[1:] != node[:-1]))) if len(band) else order
    columns = [band[at], node[at]]
    columns += [f.reduceat(x[order], at) if len(at) else x for f, x in ((np.minimum, low), (np.maximum, high))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["band", "node", "from", "to"])


def _colliding(keys: DataFrame) -> DataFrame:
    """(node, low) of the nodes of bands that several nodes and documents have; low is the band's least node."""
    band = Window.partitionBy("band")
    names = (F.min, "node", "low"), (F.max, "node", "high"), (F.min, "from", "begin"), (F.max, "to", "last")
    return keys.select("node", *[f(c).over(band).alias(name) for f, c, name in names]).where("low < high AND begin < last").select("node", "low")


def _spans(rows: DataFrame) -> DataFrame:
    """Joins overlapping paragraphs of a document that are alike kept or not."""
    order = Window.partitionBy("doc_id", "kept").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    group = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.distinct()
        .withColumn("new", new)
        .withColumn("span", group)
        .groupBy("doc_id", "kept", "span")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("words").alias("n_words"), F.min("cluster").alias("cluster"), F.min("first_doc").alias("first_doc"))
        .select("doc_id", "start", "end", "n_words", "cluster", "first_doc", "kept")
    )
