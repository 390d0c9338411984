"""Links between the tokens of two tokenizers, and how often they hold over the corpus.

Tokens of either tokenizer are intervals of a text's bytes. Offsets where tokens of both end cut them into groups, and all pairs
of tokens of a group are links. The work is done on Arrow columns, a block of texts at a time: token lists are flattened with
their parent indices, a cumulative sum per parent gives the ends, an Acero hash join on (document, end) the common ends,
and ``Table.group_by`` the links per document, for one part of the block after the other. The block counts the documents per pair
of ids. Spark merges these partial counts, finds the highest count of every first id, and brings the counts back to the blocks
that asked for them, by pair and then by block. So a block's links are stored once, packed, and counts move once per pair and
block, not per link.

Defined results: texts that are null or empty, or whose tokens' bytes of either tokenizer are not the text's (with one space before
it), have no tokens: zeros and an empty string. Rows that repeat count as documents each. Texts are taken whole; a block holds one
text at least. An empty table gives no rows. Only the id and the text are read; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from barloom.llm import byte_bpe
from barloom.llm.bpe import _Kept
from barloom.llm.common import release, small, written

#: Characters of text in a block (one text at least): a matter of memory only.
BLOCK_CHARS = 2_500_000
#: Characters of text that are encoded at once (one text at least): a matter of memory and speed only.
ENCODE_CHARS = 800_000
#: Characters of text whose tokens are linked at once (one text at least): a matter of memory and speed only.
PART_CHARS = 200_000
#: Words and pieces that either encoder of a task keeps of late: a matter of memory and speed only.
KEPT = 200_000
#: A pair of ids is one number: the first one times this, plus the second one.
SECOND = 1 << 24
#: Groups with more links are taken by distinct ids and their numbers.
WIDE = 1024
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class PieceTables:
    """A sentencepiece model: its file as bytes, and the bytes of its tokens."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = f.read()
        p = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError("tokens may hold a space only at their beginning, else words can't be encoded one by one")
        self.texts = [bytes([int(n[3:5], 16)]) if p.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = p.piece_to_id("▁")


class PieceEncoder:
    """Encodes word by word: no token holds a space after another character, so that no merge crosses a word's beginning."""

    def __init__(self, tables: PieceTables, kept: int | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=tables.model)
        self.space = tables.space
        self.find = re.compile(" +[^ ]*").findall
        self.kept = _Kept(most=kept)

    def _words(self, words: list[str]) -> list[bytes]:
        # The model adds one space of its own before a text.
        found = self.model.encode([w[1:] for w in words], num_threads=1)
        return [array("i", ids if w != " " else [self.space]).tobytes() for w, ids in zip(words, found, strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text (as bytes of int32), which begins with the added space; words that are new are encoded together."""
        found = [self.find(t) for t in texts]
        get = self.kept.learn(set().union(*found), self._words).__getitem__
        return [b"".join(map(get, f)) for f in found]


class _Side:
    """Tokens of a block's texts by one tokenizer."""

    def __init__(self, raw: list[bytes], tokens: _Tokens):
        flat = np.frombuffer(b"".join(raw), np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat))
        self.ids, self.offsets = flat, offsets
        self.doc = pc.list_parent_indices(lists)
        total = pc.cumulative_sum(pc.take(tokens.lengths, pc.list_flatten(lists))).to_numpy()
        # Segmented: what the text's first token starts from goes off.
        before = np.concatenate([[0], total])[offsets[:-1]]
        self.ends = total - np.repeat(before, np.diff(offsets))

    def table(self, at: str, width: int) -> pa.Table:
        """Tokens by (document, end) as one number: a document's ends are below ``width``."""
        return pa.table({"end": self.doc.to_numpy().astype(np.int64) * width + self.ends, at: np.arange(len(self.ids))})


class _Tokens:
    def __init__(self, texts: list[bytes]):
        self.lengths = pa.array([len(t) for t in texts], pa.int64())
        self.bytes = pa.array(texts, pa.large_binary())

    def spell(self, ids: np.ndarray) -> bytes:
        """All tokens' bytes: the data of the taken binary column."""
        taken = pc.take(self.bytes, pa.array(ids))
        return taken.buffers()[2].to_pybytes()[: int(pc.sum(pc.take(self.lengths, pa.array(ids))).as_py() or 0)] if len(ids) else b""


def _decimals(n_a: int, n_b: int) -> pa.Array:
    """Ids in decimal with the character that follows: number * 3 + (0: ',', 1: '|', 2: ';'); second ids come after the first ones."""
    return pa.array([f"{i}{mark}" for n in (n_a, n_b) for i in range(n) for mark in ",|;"], pa.large_string())


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    begin = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - begin, sizes)


def _links(a: _Side, b: _Side, cut_a: np.ndarray, cut_b: np.ndarray, doc: np.ndarray) -> pa.Table:
    """Links of the groups [cut[g], cut[g + 1]) of either side, by document and pair of ids, with their number."""
    n_a, n_b = np.diff(cut_a), np.diff(cut_b)
    wide = n_a * n_b > WIDE
    g = np.flatnonzero(~wide)
    pairs = n_a[g] * n_b[g]
    each = np.repeat(np.arange(len(g)), pairs)
    k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    across = n_b[g][each]
    first = a.ids[cut_a[g][each] + k // across].astype(np.int64)
    second = b.ids[cut_b[g][each] + k % across]
    tables = [pa.table({"doc": doc[g][each], "pair": first * SECOND + second, "n": np.ones(len(k), np.int64)})]
    for g in np.flatnonzero(wide):
        (x, n_x), (y, n_y) = (np.unique(s.ids[c[g] : c[g + 1]], return_counts=True) for s, c in ((a, cut_a), (b, cut_b)))
        pair = (x.astype(np.int64)[:, None] * SECOND + y).ravel()
        tables.append(pa.table({"doc": np.full(len(pair), doc[g]), "pair": pair, "n": (n_x[:, None] * n_y).ravel()}))
    return pa.concat_tables(tables).group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")])


def _packed(values: np.ndarray) -> bytes:
    """Small numbers in little space: their four bytes in planes, compressed."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _encoded(encode, texts: list[str]) -> list[bytes]:
    """Ids of the texts, some of them at a time, so that their pieces take little memory."""
    out, some, held = [], [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= ENCODE_CHARS:
            out += encode(some)
            some, held = [], 0
    return out + encode(some)


def _parts(texts: list[str]) -> Iterator[slice]:
    """The texts of a block in parts."""
    begin = held = 0
    for i, t in enumerate(texts, 1):
        held += len(t)
        if held >= PART_CHARS or i == len(texts):
            yield slice(begin, i)
            begin, held = i, 0


def _part(whole: list[str], raw_a: list[bytes], raw_b: list[bytes], tokens_a: _Tokens, tokens_b: _Tokens, decimals: pa.Array, with_groups: bool) -> tuple[dict, pa.Table]:
    """Own results of some texts, and their links by document and pair of ids; documents begin at 0."""
    spaced = "".join(whole).encode()
    agree = all(tokens.spell(np.frombuffer(b"".join(raw), np.int32)) == spaced for raw, tokens in ((raw_a, tokens_a), (raw_b, tokens_b)))
    for i, t in enumerate(whole if not agree else ()):
        if t and not (tokens_a.spell(np.frombuffer(raw_a[i], np.int32)) == t.encode() == tokens_b.spell(np.frombuffer(raw_b[i], np.int32))):
            raw_a[i] = raw_b[i] = b""
    a, b = _Side(raw_a, tokens_a), _Side(raw_b, tokens_b)
    width = max(s.ends.max(initial=0) for s in (a, b)) + 1
    met = a.table("at_a", width).join(b.table("at_b", width), "end", join_type="inner", use_threads=False).sort_by("at_a")
    at_a, at_b = (met.column(c).to_numpy() for c in ("at_a", "at_b"))
    del met
    doc = a.doc.to_numpy()[at_a]
    cut_a, cut_b = np.concatenate([[0], at_a + 1]), np.concatenate([[0], at_b + 1])
    n_a, n_b = np.diff(cut_a), np.diff(cut_b)
    groups = np.bincount(doc, minlength=len(whole))
    first_group = np.concatenate([[0], np.cumsum(groups)])
    linked = np.concatenate([[0], np.cumsum(n_a * n_b)])

    # Both sides' tokens in the order of the groups, every one with the character after it.
    code = np.zeros(len(a.ids) + len(b.ids), np.int64)
    mark_a, mark_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    mark_a[at_a], mark_b[at_b] = 1, 2
    code[np.arange(len(a.ids)) + np.repeat(cut_b[:-1], n_a)] = 3 * a.ids.astype(np.int64) + mark_a
    code[np.arange(len(b.ids)) + np.repeat(cut_a[1:], n_b)] = 3 * (b.ids.astype(np.int64) + len(tokens_a.lengths)) + mark_b
    spelled = pc.take(decimals, pa.array(code))
    where = np.frombuffer(spelled.buffers()[1], np.int64)[: len(code) + 1]
    data = memoryview(spelled.buffers()[2] or b"")
    bounds = where[a.offsets + b.offsets]
    spelled_docs = [data[x : y - 1] if y > x else b"" for x, y in zip(bounds, bounds[1:], strict=False)]
    rows = {
        "n_a": np.diff(a.offsets),
        "n_b": np.diff(b.offsets),
        "n_groups": groups,
        "n_links": linked[first_group[1:]] - linked[first_group[:-1]],
        "groups_sha256": [hashlib.sha256(s).hexdigest() if len(s) else "" for s in spelled_docs],
    }
    if with_groups:
        rows["groups"] = [bytes(s).decode() for s in spelled_docs]
    del code, mark_a, mark_b, spelled, where, data, spelled_docs
    return rows, _links(a, b, cut_a, cut_b, doc)


def _block(ids: pa.Array, texts: list[str], encode_a, encode_b, tokens_a: _Tokens, tokens_b: _Tokens, decimals: pa.Array, with_groups: bool) -> dict:
    """The results of a block's texts, and its links by position in the block's sorted list of pairs."""
    whole = [" " + t if t else "" for t in texts]
    raw_a, raw_b = _encoded(encode_a, whole), _encoded(encode_b, whole)
    made, of, pairs, n = [], [], [], []
    for at in _parts(whole):
        part, links = _part(whole[at], raw_a[at], raw_b[at], tokens_a, tokens_b, decimals, with_groups)
        made.append(part)
        of.append(links.column("doc").to_numpy().astype(np.int64) + at.start)
        pairs.append(links.column("pair").to_numpy())
        n.append(links.column("n_sum").to_numpy())
    of, n = np.concatenate(of), np.concatenate(n)
    pair, place, n_docs = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    order = np.argsort(of * (len(pair) + 1) + place, kind="stable")
    of, place, n = of[order], place[order], n[order]
    if len(n) and n.max() >= 1 << 32:
        raise OverflowError("a pair is linked 2 ** 32 times in one text")
    step = np.diff(place, prepend=0)
    step[np.flatnonzero(np.diff(of, prepend=-1))] = place[np.flatnonzero(np.diff(of, prepend=-1))]
    rows = {
        "id": ids,
        **{c: np.concatenate([part[c] for part in made]) for c in COUNTS},
        "groups_sha256": [s for part in made for s in part["groups_sha256"]],
        "n_pairs": np.bincount(of, minlength=len(texts)),
    }
    if with_groups:
        rows["groups"] = pa.array([s for part in made for s in part["groups"]], pa.large_string())
    sink = pa.BufferOutputStream()
    table = pa.table(rows)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    held = sink.getvalue()
    return {
        "docs": pa.compress(held, codec="zstd", asbytes=True),
        "docs_size": held.size,
        "steps": _packed(step),
        "times": _packed(n),
        "pairs": pair,
        "n_docs": n_docs,
    }


_BLOCK = "block long, docs binary, docs_size long, steps binary, times binary, pairs array<long>, n_docs array<long>"


def blocks(docs: DataFrame, a: byte_bpe.Tables, pattern: str, b: PieceTables, id_col: str = "doc_id", text: str = "text", with_groups: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of texts: its documents' own results and its links, packed."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_a, table_b = shared.value
        encode_a, encode_b = byte_bpe.Encoder(table_a, pattern, KEPT).ids, PieceEncoder(table_b, KEPT).ids
        tokens_a, tokens_b = _Tokens(table_a.texts), _Tokens(table_b.texts)
        decimals = _decimals(len(table_a.texts), len(table_b.texts))
        ids, texts, held, no = [], [], 0, 0

        def out() -> pa.RecordBatch:
            found = _block(pa.concat_arrays(ids), texts, encode_a, encode_b, tokens_a, tokens_b, decimals, with_groups)
            row = {"block": (TaskContext.get().partitionId() << 32) + no, **found}
            kinds = {"pairs": pa.list_(pa.int64()), "n_docs": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c)) for c in row], list(row))

        for batch in small(batches):
            at = 0
            for i, t in enumerate(batch.column(1), 1):
                t = t.as_py() or ""
                texts.append(t)
                held += len(t)
                if held >= block_chars or i == batch.num_rows:
                    ids.append(batch.column(0).slice(at, i - at))
                    at = i
                if held >= block_chars:
                    yield out()
                    ids, texts, held, no = [], [], 0, no + 1
                    release()
        if texts:
            yield out()

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, _BLOCK)


def pair_counts(made: DataFrame) -> DataFrame:
    """Documents that hold a pair of ids linked, over all blocks: (pair, n, best: the highest count of its first id)."""
    parts = made.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n"))
    totals = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    first = F.expr(f"pair div {SECOND}").alias("first")
    best = totals.groupBy(first).agg(F.max("n").alias("highest"))
    return totals.withColumn("first", first).join(best, "first").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def scores(made: DataFrame, counts: DataFrame, id_field: StructField, with_groups: bool = False) -> DataFrame:
    """Per document its own results and n_best, count_sum from the corpus-wide counts."""
    asked = made.select("block", F.explode("pairs").alias("pair")).join(counts, "pair")
    known = asked.groupBy("block").agg(F.collect_list(F.struct("pair", (F.col("n") * 2 + F.col("best").cast("long")).alias("n"))).alias("known"))
    held = made.select("block", "docs", "docs_size", "steps", "times").join(known, "block", "left")
    more = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if with_groups else "")
    schema = StructType([id_field, *StructType.fromDDL(more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            raw, size, steps, times = (batch.column(c)[0].as_py() for c in ("docs", "docs_size", "steps", "times"))
            docs = pa.ipc.open_stream(pa.decompress(raw, size, codec="zstd")).read_all()
            n_pairs = docs.column("n_pairs").to_numpy()
            total = int(n_pairs.sum())
            begin = np.concatenate([[0], np.cumsum(n_pairs)])
            # Places start anew in every document; steps are never negative.
            sums = np.concatenate([[0], np.cumsum(_unpacked(steps, total).astype(np.int64))])
            place = sums[1:] - np.repeat(sums[begin[:-1]], n_pairs)
            structs = batch.column("known").flatten() if total else None
            pair, n = (pc.struct_field(structs, i).to_numpy() for i in (0, 1)) if total else (np.zeros(0, np.int64),) * 2
            n = n[np.argsort(pair)]
            if total and len(n) <= place.max():
                raise ValueError("a block has links without a count")
            times = _unpacked(times, total).astype(np.int64)
            best = np.concatenate([[0], np.cumsum(times * (n[place] & 1))])
            summed = np.concatenate([[0], np.cumsum(times * (n[place] >> 1))])
            out = [docs.column("id"), *(docs.column(c) for c in COUNTS), pa.array(best[begin[1:]] - best[begin[:-1]]), pa.array(summed[begin[1:]] - summed[begin[:-1]]), docs.column("groups_sha256")]
            if with_groups:
                out.append(docs.column("groups").cast(pa.string()))
            yield from pa.table(out, schema.names).to_batches()

    return held.mapInArrow(run, schema)


def align(docs: DataFrame, a: byte_bpe.Tables, pattern: str, b: PieceTables, id_col: str = "doc_id", text: str = "text", with_groups: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked for."""
    made = written(blocks(docs, a, pattern, b, id_col, text, with_groups, block_chars), "align")
    counts = written(pair_counts(made), "align")
    return scores(made, counts, docs.schema[id_col], with_groups)
