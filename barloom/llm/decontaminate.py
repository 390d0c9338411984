"""Benchmark decontamination: a BM25 index of test items, searched block by block with every training passage.

An index entry is a run of at most ``ENTRY`` words of an item. Its terms weigh by BM25 and are scaled so that a passage that
holds them all scores 1. Passages are windows of twice that length at every ``ENTRY`` words, so that any run of that many
words lies whole in one. Posting lists are cut into blocks of ``BLOCK`` entries with the block's largest weight per
term; as in block-max WAND, a block is opened for a passage only if the bounds of the terms they share reach the
threshold (terms in many entries count with one bound for all of them together), and only there are scores
computed. All entries above the threshold are retrieved, and their items are then verified on the whole document:
the shares of the five-word sequences of the question (all but the last sentence) and of the answer (the last one).

The index lives in the tasks. Its size is bounded: items are dealt to parts of at most ``PART_WORDS`` words, and every part makes one
pass over the documents; no item is left out.

Words are runs of letters and digits (all characters above ASCII count as letters), lower-cased. Defined results: null and empty texts
and items match nothing; an item without a sentence end is all question; repeated rows are each flagged, repeated items
each reported; a null item_id is reported as null. A column named ``leaks`` is replaced, others are carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small
from barloom.llm.words import Words, mix, slices

ENTRY, BLOCK = 64, 8
PART_WORDS = 2_000_000
#: Bytes of text, and cells of passages by blocks, that a task works on at once (a matter of memory only).
PART, CELLS = 1 << 19, 1 << 18
K1, B = 1.2, 0.75
THRESHOLD = 0.6
COVER, ANSWER_COVER = 0.8, 0.5
#: Terms in more than this share of the entries are bounded together.
COMMON = 0.1

BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LEAK = "leaks array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with the accented capitals of Latin-1 lowered (ASCII is lowered with the words)."""
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + upper.astype(np.uint8) * np.uint8(32)


def _words(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    for at, data, offs in slices(texts, PART):
        yield at, Words(fold(data), offs, BREAKS)


def _hashes(text: str) -> np.ndarray:
    return next((w.hash for _, w in _words(pa.array([text]))), np.zeros(0, np.uint64))


def _sequences(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    if len(words) < k or not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : len(out) + j]
    return mix(out)


class Index:
    """The inverted index of one part of the items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items, entry_item, entries = [], [], []
        for item_id, text in items:
            sentences = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]
            question, answer = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")
            words = _hashes(text)
            if not len(words):
                continue
            self.items.append((item_id, words, _hashes(question), _hashes(answer)))
            for a in range(0, len(words), ENTRY):
                a = max(0, min(a, len(words) - ENTRY))  # the last run is a full one
                entries.append(words[a : a + ENTRY])
                entry_item.append(len(self.items) - 1)
        self.item = np.array(entry_item, np.int64)
        self.terms = np.unique(np.concatenate(entries)) if entries else np.zeros(0, np.uint64)
        term = [np.searchsorted(self.terms, e) for e in entries]
        n, mean = len(entries), np.mean([len(e) for e in entries]) if entries else 1.0
        df = np.zeros(len(self.terms), np.int64)
        for t in term:
            df[np.unique(t)] += 1
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        posts = []
        for i, t in enumerate(term):
            own, tf = np.unique(t, return_counts=True)
            w = idf[own] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
            posts.append(np.stack([own, np.full(len(own), i), w / w.sum()]))
        post = np.concatenate(posts, axis=1) if posts else np.zeros((3, 0))
        post = post[:, np.lexsort((post[1], post[0]))]
        self.post_entry, self.post_weight = post[1].astype(np.int64), post[2]
        self.post_first = np.searchsorted(post[0], np.arange(len(self.terms) + 1))
        # Block maxima of the rarer terms, and per block the most that the common terms of an entry make together.
        self.blocks = -(-max(1, n) // BLOCK)
        common = df > max(2.0, COMMON * n)
        together = np.bincount(self.post_entry, self.post_weight * common[post[0].astype(np.int64)], minlength=self.blocks * BLOCK)
        self.common_bound = together.reshape(self.blocks, BLOCK).max(axis=1)
        rare = ~common[post[0].astype(np.int64)]
        cell = post[0][rare].astype(np.int64) * self.blocks + self.post_entry[rare] // BLOCK
        at, of = np.unique(cell, return_inverse=True)
        best = np.zeros(len(at))
        np.maximum.at(best, of, self.post_weight[rare])
        self.max_block, self.max_weight = at % self.blocks, best
        self.max_first = np.searchsorted(at // self.blocks, np.arange(len(self.terms) + 1))
        # A bit per low hash bits keeps most words of a text away from the search in the term list.
        self.bits = max(16, int(math.log2(len(self.terms) + 1)) + 5)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.terms & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def candidates(self, w: Words) -> dict[int, dict[int, float]]:
        """Per row, the items with an entry above the threshold in one of the row's passages, and its score."""
        out: dict[int, dict[int, float]] = {}
        if not len(self.terms):
            return out
        at = np.flatnonzero(self.filter[(w.hash & np.uint64(len(self.filter) - 1)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, w.hash[at]), len(self.terms) - 1)
        hit = self.terms[term] == w.hash[at]
        at, term = at[hit], term[hit]
        # Half windows: the passage s of a row is its half windows s and s + 1.
        halves = np.maximum(1, -(-np.diff(w.first) // ENTRY))
        base = np.concatenate([[0], np.cumsum(halves)])
        row = w.row[at]
        half = base[row] + (at - w.first[row]) // ENTRY
        row_of = np.repeat(np.arange(w.rows), halves)
        group = max(1, CELLS // self.blocks)
        for lo in range(0, base[-1], group):
            hi = min(base[-1], lo + group)
            a, b = np.searchsorted(half, [lo, hi + 1])
            # A term counts once in a half window, however often it is there.
            once = np.unique((half[a:b] - lo) * len(self.terms) + term[a:b])
            h, t = np.divmod(once, len(self.terms))
            span = self.max_first[t + 1] - self.max_first[t]
            post = np.repeat(self.max_first[t] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            cell = np.repeat(h, span) * self.blocks + self.max_block[post]
            bound = np.bincount(cell, self.max_weight[post], minlength=(hi - lo + 1) * self.blocks).reshape(-1, self.blocks)
            own = bound[: hi - lo].copy()
            joined = np.zeros(hi - lo, bool)
            joined[: min(hi, len(row_of) - 1) - lo] = row_of[lo : min(hi, len(row_of) - 1)] == row_of[lo + 1 : hi + 1]
            own[joined] += bound[1:][joined]
            opened = np.argwhere(own + self.common_bound >= THRESHOLD - 1e-9)
            for passage, block in opened:
                first, last = passage + lo, passage + lo + int(joined[passage])
                x, y = np.searchsorted(half, [first, last + 1])
                self._open(int(row_of[first]), np.unique(term[x:y]), int(block), out)
        return out

    def _open(self, row: int, terms: np.ndarray, block: int, out: dict[int, dict[int, float]]) -> None:
        """Scores the block's entries against a passage's terms."""
        first = self.post_first
        span = first[terms + 1] - first[terms]
        post = np.repeat(first[terms] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        entry = self.post_entry[post] - block * BLOCK
        inside = (entry >= 0) & (entry < BLOCK)
        score = np.bincount(entry[inside], self.post_weight[post[inside]], minlength=BLOCK)
        for i in np.flatnonzero(score >= THRESHOLD):
            item, found = int(self.item[block * BLOCK + i]), out.setdefault(row, {})
            found[item] = max(found.get(item, 0.0), float(score[i]))

    def verified(self, words: np.ndarray, found: dict[int, float]) -> list[dict]:
        """Of the items found for a document, those whose question and answer it holds."""
        out, known = [], {}

        def share(part: np.ndarray) -> float:
            k = min(5, len(part))
            if not k:
                return 1.0
            if k not in known:
                known[k] = _sequences(words, k)
            return float(np.isin(np.unique(_sequences(part, k)), known[k]).mean())

        for item, score in sorted(found.items()):
            item_id, whole, question, answer = self.items[item]
            q, a = share(question), share(answer)
            if share(whole) >= COVER or (q >= COVER and a >= ANSWER_COVER):
                out.append({"item_id": item_id, "score": min(1.0, score), "question_overlap": q, "answer_overlap": a})
        return out


def parts(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The items in lists of bounded size; only one is on the driver at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = -(-words // PART_WORDS) or 1
    for p in range(count):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(count)) == p) if count > 1 else rows
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def flag(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with leaks: the verified items of each text with score and overlaps."""
    spark = docs.sparkSession
    docs = docs.drop("leaks")
    names = docs.columns
    for part in parts(items):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in small(batches):
                leaks: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for at, words in _words(batch.column(names.index(text))):
                    for row, found in index.candidates(words).items():
                        leaks[at + row] = index.verified(words.hash[words.first[row] : words.first[row + 1]], found)
                kind = pa.list_(pa.struct([("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap"))]))
                new = pa.array(leaks, kind)
                if "leaks" in batch.schema.names:
                    before = batch.column(batch.schema.get_field_index("leaks")).to_pylist()
                    new = pa.array([x + y for x, y in zip(before, leaks, strict=True)], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], new], [*names, "leaks"])

        schema = docs.select(*names).selectExpr("*", f"cast(null as {_LEAK[6:]}) AS leaks").schema
        docs = docs.mapInArrow(run, schema)
    return docs
