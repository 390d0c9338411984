"""BPE with word ends: a backtracking encoder in linear time, and decoding by an offset table.

Encoding a piece: one Aho-Corasick pass gives the longest vocabulary match at every position; tokens are laid greedily,
and a token may follow another only if the pair is compatible, that is, if merging the two texts together would again
give exactly this pair (checked by undoing merges of both in order of rank, see ``Tables.compatible``). A dead end clears its
position and steps back. The result is the merge order's own, without running merges.

Decoding: token ids index a table of offsets into one byte string of all token texts.

Defined results: null is the empty text, which has no tokens; texts are encoded whole; equal rows give equal results.
Extra columns are carried, never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import weakref
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import release, small

#: Encoded words, pieces and checked pairs that a Python worker keeps of late (a matter of speed only).
KEPT = 400_000
#: Bytes of results that a task sends on at once.
OUT_BYTES = 4 << 20
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class Tables:
    """What encoding and decoding need of a tokenizer file; plain data, so that it can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for a in spec["added_tokens"]:
            if a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"]:
                raise ValueError("only added tokens that match the raw text exactly are supported")
        if spec.get("decoder") or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("this tokenizer needs a decoder or has unknown tokens")
        #: Inner numbers: characters first, then merges by rank; a text made by two merges keeps the first.
        self.inner: dict[str, int] = {}
        made = {a + b for a, b in merges}
        for text in vocab:
            if text not in made and text not in self.added:
                self.inner[text] = len(self.inner)
        self.left, self.right = list(range(len(self.inner))), list(range(len(self.inner)))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y = self.inner[a], self.inner[b]
            if a + b not in self.inner:
                self.inner[a + b] = len(self.left)
                self.left.append(x)
                self.right.append(y)
            self.pairs.setdefault((x, y), self.inner[a + b])
        self.ids = [vocab[t] for t in self.inner]
        #: Token texts as Aho-Corasick keys: the word end is one character, so that it can't be cut.
        self.keys = [self.key(t) for t in self.inner]
        index = {k: i for i, k in enumerate(self.keys)}
        self.prefix = [next((index[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in index), -1) for k in self.keys]
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        size = max([*vocab.values(), *self.added.values()]) + 1
        texts = [b""] * size
        for t, i in [*vocab.items(), *self.added.items()]:
            texts[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.blob = b" ".join(texts) + b" "

    def key(self, token: str) -> str:
        return token[: -len(self.suffix)] + "\0" if self.suffix and token.endswith(self.suffix) else token

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: no merge across their border comes before the merges that made them."""
        pairs, left, right = self.pairs, self.left, self.right
        bound = len(left)
        while True:
            if pairs.get((a, b), bound) < bound:
                return False
            # Undo the later of the two merges; a merge across the border would have to come before it.
            if a > b:
                bound, a = a, right[a]
                if a == bound:
                    bound, b = b + 1, left[b]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, left[b]
                if b + 1 == bound:
                    bound, a = a, right[a]
                    if a == bound:
                        return True


class _Kept(dict):
    """A store of results by key that keeps what was asked for of late: two generations of half the size."""

    def __init__(self, make=None, most: int | None = None):
        self.make, self.older, self.most = make, {}, most

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found

    def put(self, key, found) -> None:
        if len(self) >= (self.most or KEPT) // 2:
            self.older = dict(self)
            self.clear()
        self[key] = found

    def learn(self, keys: set, make_many) -> dict:
        """Results of all the keys, also of more than are kept; those that are not known are made all at once."""
        out = {k: found for k in keys if (found := self.get(k)) is not None}
        again = {k: found for k in keys - out.keys() if (found := self.older.get(k)) is not None}
        new = [k for k in keys if k not in out and k not in again]
        more = again | dict(zip(new, make_many(new), strict=True)) if new else again
        for key, found in more.items():
            self.put(key, found)
        return out | more


class Encoder:
    """Encodes texts with ``Tables`` inside a task."""

    def __init__(self, tables: Tables):
        import ahocorasick
        import regex

        self.t = tables
        self.longest = ahocorasick.Automaton()
        self.size = [len(k) for k in tables.keys]
        for i, k in enumerate(tables.keys):
            self.longest.add_word(k, (i, len(k) - 1))
        self.longest.make_automaton()
        self.pieces = regex.compile(tables.pattern)
        self.split = regex.compile("|".join(regex.escape(a) for a in sorted(tables.added, key=len, reverse=True)) or r"(?!)")
        self.letters = dict(enumerate(_byte_letters()))
        self.blob = np.frombuffer(tables.blob, np.uint8)
        # The stores don't hold the encoder: it goes with its task, not when Python looks for cycles.
        me = weakref.proxy(self)
        self.kept_pieces = _Kept(lambda text: array("i", me.piece(text)).tobytes())
        self.kept = _Kept(lambda word: me._word(word))
        self.fits = _Kept(lambda pair: tables.compatible(*divmod(pair, len(tables.keys))))

    def piece(self, text: str) -> list[int]:
        """Token ids of one piece."""
        t, size, known, count = self.t, self.size, self.fits, len(self.size)
        s = text.encode().decode("latin-1").translate(self.letters)
        if t.suffix:
            s += "\0"
        n = len(s)
        match = [-1] * n
        for end, (i, before) in self.longest.iter(s):
            match[end - before] = i  # ends come in order: the last is the longest
        open_ = bytearray(b"\1") * (n + 1)
        tokens: list[int] = []
        at, token = 0, match[0] if n else -1
        while at < n:
            if token < 0:
                # Nothing fits here: close the position and try a shorter token before it.
                open_[at] = 0
                token = tokens.pop()
                at -= size[token]
                token = t.prefix[token]
                continue
            end = at + size[token]
            fits = open_[end]
            if fits and tokens:
                fits = known[tokens[-1] * count + token]
            if fits:
                tokens.append(token)
                at = end
                token = match[at] if at < n else -1
            else:
                token = t.prefix[token]
        return [t.ids[i] for i in tokens]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Token ids of a whole text, and the same in decimal with one space between."""
        ids, decimal, at = [], [], 0
        for m in self.split.finditer(text) if "<" in text else ():
            self._plain(text[at : m.start()], ids, decimal)
            ids.append(np.int32(self.t.added[m[0]]).tobytes())
            decimal.append(str(self.t.added[m[0]]))
            at = m.end()
        self._plain(text[at:] if at else text, ids, decimal)
        return np.frombuffer(b"".join(ids), np.int32), " ".join(decimal)

    def _plain(self, text: str, ids: list[bytes], decimal: list[str]) -> None:
        # Letters are lowered one by one: no special form of sigma at a word's end.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # White space parts pieces and is dropped, so that words are encoded one by one; split() also parts at
        # four control characters that are not white space here.
        words = self.pieces.findall(text) if _ODD_SPACE.search(text) else text.split()
        kept = self.kept
        for word in words:
            known = kept[word]
            ids.append(known[0])
            decimal.append(known[1])

    def _word(self, word: str) -> tuple[bytes, str]:
        out = [self.kept_pieces[p] for p in self.pieces.findall(word)]
        ids = b"".join(out)
        return ids, " ".join(map(str, array("i", ids)))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the token texts with one space between."""
        if not len(ids):
            return b""
        start = self.t.offsets[ids]
        length = self.t.offsets[ids + 1] - start
        begin = np.cumsum(length) - length
        where = np.arange(int(length.sum())) + np.repeat(start - begin, length)
        return self.blob[where[:-1]].tobytes()


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: its own where it is visible, else 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def encode(docs: DataFrame, path: str, text: str = "text", digests_only: bool = False) -> DataFrame:
    """The rows of ``docs`` with token_ids (array of int) and decoded (text), or with n_tokens and the digests of both."""
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(Tables(path))
    more = ["0L AS n_tokens", "'' AS ids_sha256", "'' AS decoded_sha256"] if digests_only else ["array(0) AS token_ids", "'' AS decoded"]
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests_only else ["token_ids", "decoded"]
    docs = docs.drop(*new)
    keep = [c for c in docs.columns if not (digests_only and c == text)]
    names = docs.columns
    schema = docs.select(*keep).selectExpr("*", *more).schema

    kinds = [pa.int64(), pa.string(), pa.string()] if digests_only else [pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in small(batches):
            columns, at, size = [[] for _ in new], 0, 0
            for row, scalar in enumerate(batch.column(names.index(text)), 1):
                ids, decimal = encoder.encode(scalar.as_py() or "")
                back = encoder.decode(ids)
                if digests_only:
                    values = (len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back).hexdigest())
                    size += 200
                else:
                    values = (ids, back.decode())
                    size += 4 * len(ids) + len(back)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
                if size > OUT_BYTES or row == batch.num_rows:
                    carried = [batch.column(names.index(c)).slice(at, row - at) for c in keep]
                    yield pa.RecordBatch.from_arrays(carried + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*keep, *new])
                    columns, at, size = [[] for _ in new], row, 0
        del encoder
        release()

    return docs.mapInArrow(run, schema)
