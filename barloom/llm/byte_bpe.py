"""Byte-level BPE in overlapping chunks, and decoding by joining the tokens' bytes.

Texts are parted by a pattern into pieces, and merges never cross a piece. A text of up to ``CHUNK`` characters is parted in
one go. A longer one is cut into chunks, each with ``OVERLAP`` characters of the next, that are parted in any task. Parting has
no memory: two sequences of borders that once share a border stay the same from there on. So the first border that a chunk
shares with the chunk before it, inside their overlap, is where the chunk's own pieces begin and the other's end. (The last two
characters of a chunk may still be waiting for text, borders there don't count.) Then each chunk encodes its pieces, and
the ids of a text are joined in order. Where two chunks share no border, e.g. in a run of letters longer than the overlap,
the text's chunks are put together again and parted in one go.

Defined results: null is the empty text, which has no tokens; texts are encoded whole; strings of special tokens are plain text;
equal rows, also with equal ids, give equal results each; an empty table gives an empty result. Other columns are carried, never
read; the text itself is not (``decoded`` has its bytes). Own columns named like the new ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import weakref
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.llm.bpe import _byte_letters, _Kept
from barloom.llm.common import small, written

CHUNK, OVERLAP = 32_768, 512
#: Bytes of results that a task sends on at once.
OUT_BYTES = 4 << 20
#: Pieces of more bytes are merged with a heap.
LONG = 100
_BITS = 24
_MASK, _NEVER = (1 << _BITS) - 1, 1 << 60


class Tables:
    """Tokens and merges; plain data, so that it can be broadcast.

    ``merges`` has the two ids as one number, and the merge's rank and the new id as another, so that the smaller merges first.
    """

    def __init__(self, texts: list[bytes], merges: dict[int, int], whole: bool):
        self.texts, self.ids = texts, {t: i for i, t in enumerate(texts) if t}
        self.merges, self.whole = merges, whole
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.blob = b"".join(texts)

    @staticmethod
    def from_ranks(path: str) -> Tables:
        """A file of tokens in base 64 with their ranks, which are the ids: any two neighbours that make a token merge."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        texts = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            texts[i] = token
        halves = ((token[:k], token[k:], i) for token, i in ranks.items() for k in range(1, len(token)))
        return Tables(texts, {ranks[a] << _BITS | ranks[b]: i << _BITS | i for a, b, i in halves if a in ranks and b in ranks}, whole=True)

    @staticmethod
    def from_json(path: str) -> Tables:
        """A tokenizer file with a vocabulary of byte letters and a list of merges: only listed pairs merge."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: bytes([b]) for b, c in enumerate(_byte_letters())}
        raw = {t: b"".join(byte[c] for c in t) for t in model["vocab"]}
        texts = [b""] * (max(model["vocab"].values()) + 1)
        for t, i in model["vocab"].items():
            texts[i] = raw[t]
        ids = {t: i for i, t in enumerate(texts) if t}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranked = ((k, raw[a], raw[b]) for k, (a, b) in enumerate(merges))
        return Tables(texts, {ids[a] << _BITS | ids[b]: k << _BITS | ids[a + b] for k, a, b in ranked}, whole=False)


class Encoder:
    """Encodes pieces inside a task."""

    def __init__(self, tables: Tables, pattern: str, kept: int | None = None):
        import regex

        self.t = tables
        self.find = regex.compile(pattern)
        # The store doesn't hold the encoder: it goes with its task, not when Python looks for cycles.
        me = weakref.proxy(self)
        self.kept = _Kept(lambda piece: me._piece(piece), kept)
        self.kept_ids = _Kept(most=kept)
        self.blob = np.frombuffer(tables.blob, np.uint8)
        pairs = np.array(sorted(tables.merges.items()), np.int64).reshape(-1, 2)
        # One pair more that is none, so that every place in the list is there.
        self.pairs, self.ranks = np.append(pairs[:, 0], _NEVER), np.append(pairs[:, 1], _NEVER)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece: the pair with the lowest rank merges first, of equal ones the leftmost."""
        t = self.t
        if t.whole and piece in t.ids:
            return [t.ids[piece]]
        byte, rank = t.bytes, t.merges.get
        ids = [byte[b] for b in piece]
        if len(ids) > LONG:
            return self._merged_long(ids)
        ranks = [rank(a << _BITS | b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            i = ranks.index(low)
            new = ids[i] = low & _MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << _BITS | new, _NEVER)
            if i < len(ranks):
                ranks[i] = rank(new << _BITS | ids[i + 1], _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs (their merge, place and ids) over a linked list."""
        n, rank = len(ids), self.t.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << _BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = low & _MASK, -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
            for left, right in ((i, k), (h, i)):
                if left >= 0 and right < n and (r := rank(ids[left] << _BITS | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def merged_many(self, pieces: list[str]) -> list[bytes]:
        """Ids (as bytes of int32) of many pieces: in every round each piece merges its own lowest pair."""
        raw, out = [p.encode() for p in pieces], [b""] * len(pieces)
        short = []
        for i, p in enumerate(raw):
            if len(p) > LONG or (self.t.whole and p in self.t.ids):
                out[i] = array("i", self.merged(p)).tobytes()
            else:
                short.append(i)
        ids = np.array(self.t.bytes, np.int64)[np.frombuffer(b"".join([raw[i] for i in short]), np.uint8)]
        of = np.repeat(np.arange(len(short)), [len(raw[i]) for i in short])
        done = []
        while len(ids):
            pair = ids[:-1] << _BITS | ids[1:]
            place = np.searchsorted(self.pairs, pair)
            at = np.flatnonzero((self.pairs[place] == pair) & (of[:-1] == of[1:]))
            rank = self.ranks[place[at]]
            first = np.flatnonzero(np.diff(of[at], prepend=-1))
            low = np.minimum.reduceat(rank, first) if len(at) else rank
            at = at[rank == np.repeat(low, np.diff(first, append=len(at)))]
            at = at[np.diff(of[at], prepend=-1) != 0]
            ids[at] = low & _MASK
            # Pieces without a pair that merges are done.
            open_ = np.zeros(len(short), bool)
            open_[of[at]] = True
            here = open_[of]
            done.append((of[~here], ids[~here]))
            here[at + 1] = False
            ids, of = ids[here], of[here]
        if done:
            of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
            ids = ids[np.argsort(of, kind="stable")].astype(np.int32).tobytes()
            ends = 4 * np.cumsum(np.bincount(of, minlength=len(short)))
            for i, a, b in zip(short, [0, *ends.tolist()], ends.tolist(), strict=False):
                out[i] = ids[a:b]
        return out

    def _piece(self, piece: str) -> tuple[bytes, str]:
        ids = self.merged(piece.encode())
        return array("i", ids).tobytes(), " ".join(map(str, ids))

    def pieces(self, pieces: list[str]) -> tuple[bytes, str]:
        """Ids of the pieces (as bytes of int32), and the same in decimal with one space between."""
        kept = self.kept
        found = [kept[p] for p in pieces]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def ids(self, texts: str | list[str]) -> bytes | list[bytes]:
        """Ids (as bytes of int32) of a text, or of each of a list; pieces that are new are merged together."""
        if isinstance(texts, str):
            return self.ids([texts])[0]
        found = [self.find.findall(t) for t in texts]
        get = self.kept_ids.learn(set().union(*found), self.merged_many).__getitem__
        return [b"".join(map(get, f)) for f in found]

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start = self.t.offsets[ids]
        length = self.t.offsets[ids + 1] - start
        begin = np.cumsum(length) - length
        where = np.arange(int(length.sum())) + np.repeat(start - begin, length)
        return self.blob[where].tobytes()


_CHUNKS = "_row long, _no int, _part string, _last boolean, _ends binary, _head array<int>, _tail array<int>"


def _cut(long: DataFrame, text: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """The texts in chunks, dealt out evenly, with the borders between their pieces, and those of them in either overlap."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            row, whole = batch.column(0), batch.column(1)[0].as_py()
            for no, at in enumerate(range(0, len(whole), chunk)):
                last = at + chunk >= len(whole)
                yield pa.RecordBatch.from_arrays([row, pa.array([no], pa.int32()), pa.array([whole[at : at + chunk + (0 if last else overlap)]]), pa.array([last])], ["_row", "_no", "_part", "_last"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern)
        for batch in small(batches, 20):
            ends, heads, tails = [], [], []
            for part, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = np.array([0, *(m.end() for m in find.finditer(part))], np.int32)
                if not last:
                    own = own[own <= len(part) - 2]
                ends.append(own.tobytes())
                heads.append(own[own <= overlap])
                tails.append(own[own >= chunk] - chunk if not last else [])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.binary()), pa.array(heads, kind), pa.array(tails, kind)], ["_row", "_no", "_part", "_last", "_ends", "_head", "_tail"])

    chunks = long.select("_row", text).mapInArrow(split, "_row long, _no int, _part string, _last boolean")
    return chunks.repartition("_row", "_no").mapInArrow(borders, _CHUNKS)


def _spans(cut: DataFrame, chunk: int) -> DataFrame:
    """Where the own pieces of a chunk begin and end in it, and whether all borders of its text were found (_whole: not)."""
    left = cut.select("_row", (F.col("_no") + 1).alias("_no"), F.col("_tail").alias("_left"))
    met = cut.select("_row", "_no", "_head", "_last").join(left, ["_row", "_no"], "left")
    met = met.select("_row", "_no", "_last", F.when(F.col("_no") == 0, 0).otherwise(F.array_min(F.array_intersect("_head", "_left"))).alias("_from"))
    whole = Window.partitionBy("_row")
    return met.select(
        "_row",
        "_no",
        "_from",
        F.when(~F.col("_last"), F.lead("_from").over(whole.orderBy("_no")) + chunk).alias("_to"),
        F.max(F.col("_from").isNull()).over(whole).alias("_whole"),
    )


def encode(docs: DataFrame, tables: Tables, pattern: str, text: str = "text", digests_only: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The other columns of ``docs`` with token_ids (array of int) and decoded (binary), or with n_tokens and the digests of both."""
    if digests_only:
        new, fields = ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string"
        kinds = [pa.int64(), pa.string(), pa.string()]
    else:
        new, fields = ["token_ids", "decoded"], "token_ids array<int>, decoded binary"
        kinds = [pa.list_(pa.int32()), pa.binary()]
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    docs = docs.select(F.col(text).alias("_text"), *[c for c in docs.columns if c != text and c not in new])
    keep = docs.columns[1:]

    def result(encoder: Encoder, raw: bytes, decimal: str) -> tuple[tuple, int]:
        ids = np.frombuffer(raw, np.int32)
        back = encoder.decode(ids)
        if digests_only:
            return (len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back).hexdigest()), 200
        return (ids, back), len(raw) + len(back)

    def rows(batch: pa.RecordBatch, carried: list[str], results: Iterator[tuple[tuple, int]]) -> Iterator[pa.RecordBatch]:
        columns, at, size = [[] for _ in new], 0, 0
        for row, (values, more) in enumerate(results, 1):
            for column, value in zip(columns, values, strict=True):
                column.append(value)
            size += more
            if size > OUT_BYTES or row == batch.num_rows:
                own = [batch.column(c).slice(at, row - at) for c in carried]
                yield pa.RecordBatch.from_arrays(own + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*carried, *new])
                columns, at, size = [[] for _ in new], row, 0

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in small(batches):
            texts = (t.as_py() or "" for t in batch.column("_text"))
            yield from rows(batch, keep, (result(encoder, *encoder.pieces(encoder.find.findall(t))) for t in texts))

    def own_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in small(batches, 20):
            found = []
            for part, ends, begin, end in zip(*(batch.column(c).to_pylist() for c in ("_part", "_ends", "_from", "_to")), strict=True):
                at = np.frombuffer(ends, np.int32)
                at = at[(at >= begin) & (at <= (len(part) if end is None else end))].tolist()
                found.append(encoder.pieces([part[a:b] for a, b in zip(at, at[1:], strict=False)])[0])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_no"), pa.array(found, pa.binary()), pa.nulls(len(found), pa.string())], ["_row", "_no", "_ids", "_part"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)

        def results(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int]]:
            for parts in batch.column("_parts"):
                parts = parts.as_py()
                if parts[0]["_ids"] is None:
                    yield result(encoder, *encoder.pieces(encoder.find.findall("".join(p["_part"] for p in parts))))
                else:
                    raw = b"".join(p["_ids"] for p in parts)
                    yield result(encoder, raw, " ".join(map(str, np.frombuffer(raw, np.int32).tolist())) if digests_only else "")

        for batch in small(batches, 5):
            yield from rows(batch, ["_row"], results(batch))

    schema = StructType(docs.select(*keep).schema.fields + StructType.fromDDL(fields).fields)
    size = F.coalesce(F.char_length("_text"), F.lit(0))
    short = docs.where(size <= chunk).mapInArrow(at_once, schema)
    long = written(docs.where(size > chunk).withColumn("_row", F.monotonically_increasing_id()), "byte_bpe")
    cut = written(_cut(long, "_text", pattern, chunk, overlap), "byte_bpe")
    spans = cut.join(_spans(cut, chunk), ["_row", "_no"])
    pieces = spans.where("NOT _whole").select("_row", "_no", "_part", "_ends", "_from", "_to").mapInArrow(own_pieces, "_row long, _no int, _ids binary, _part string")
    again = spans.where("_whole").select("_row", "_no", F.lit(None).cast("binary").alias("_ids"), F.substring("_part", 1, chunk).alias("_part"))
    gathered = pieces.unionAll(again).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_no", "_ids", "_part"))).alias("_parts"))
    done = gathered.mapInArrow(joined, f"_row long, {fields}")
    return short.unionAll(long.select("_row", *keep).join(done, "_row").select(*keep, *new))
