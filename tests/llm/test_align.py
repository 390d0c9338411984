"""Links between two tokenizers' tokens against a plain version with the libraries, and the cases that the docstring defines."""

import collections
import gc
import hashlib
import tracemalloc
import weakref

import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import align, byte_bpe
from barloom.llm.bpe import _byte_letters, _Kept


@pytest.fixture(scope="module")
def tables():
    return byte_bpe.Tables.from_json(P.path("byte_bpe_50k.json")), P.PATTERN, align.PieceTables(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte = {c: i for i, c in enumerate(_byte_letters())}

    def spelled_a(i):
        return bytes(byte[c] for c in a.id_to_token(i))

    def spelled_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        sides = [(a.encode(" " + text, add_special_tokens=False).ids, spelled_a), (b.encode(text, num_threads=1), spelled_b)]
        ends = []
        for ids, spell in sides:
            if b"".join(map(spell, ids)) != (" " + text).encode():
                return []
            at, found = 0, []
            for i in ids:
                at += len(spell(i))
                found.append(at)
            ends.append(found)
        common, out, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for end in common:
            group = []
            for side in (0, 1):
                to = ends[side].index(end, at[side]) + 1
                group.append(sides[side][0][at[side] : to])
                at[side] = to
            out.append(group)
        return out

    def all_of(texts):
        docs = [groups(t) for t in texts]
        count = collections.Counter()
        for d in docs:
            count.update({(x, y) for g in d for x in g[0] for y in g[1]})
        best = collections.defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        rows = []
        for d in docs:
            links = [(x, y) for g in d for x in g[0] for y in g[1]]
            s = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in d)
            rows.append(
                (
                    sum(len(g[0]) for g in d),
                    sum(len(g[1]) for g in d),
                    len(d),
                    len(links),
                    sum(count[k] == best[k[0]] for k in links),
                    sum(count[k] for k in links),
                    hashlib.sha256(s.encode()).hexdigest() if s else "",
                    s,
                )
            )
        return rows

    return all_of


TEXTS = [
    None,
    "",
    " ",
    "   ",
    "a ",
    "The quick  brown fox\njumps\t over",
    "x▁y",
    "<|endoftext|> <s> </s> <0x41> <unk>",
    "naïve 中文 🙂🙃 ﬁ ½   é ​",
    "\n\n\n  \r\n",
    "a\0b",
    "z" * 700 + "́" * 300 + "🙂" * 200,
    "The quick  brown fox\njumps\t over",
]


@pytest.mark.parametrize("block_chars", [30, 10**6])
def test_against_the_libraries(spark, tables, plain, block_chars):
    rows = [(i // 2 if i else None, t, "a", i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n_a int")
    got = align.align(df, *tables, with_groups=True, block_chars=block_chars)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    want = [(r[0], *w) for r, w in zip(rows, plain(TEXTS), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_documents_against_the_libraries(spark, sf, tables, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = {r["doc_id"]: w[:-1] for r, w in zip(rows, plain([r["text"] for r in rows]), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in align.align(docs, *tables, block_chars=100_000).collect()} == want


def test_wide_groups_are_counted_like_others(spark, tables, plain, monkeypatch):
    texts = TEXTS[5:]
    got = {}
    for wide in (0, 10**9):
        monkeypatch.setattr(align, "WIDE", wide)
        a, pattern, b = tables
        enc_a, enc_b = byte_bpe.Encoder(a, pattern).ids, align.PieceEncoder(b).ids
        got[wide] = align._block(pa.array(range(len(texts))), texts, enc_a, enc_b, align._Tokens(a.texts), align._Tokens(b.texts), align._decimals(len(a.texts), len(b.texts)), False)
    for key in ("pairs", "n_docs"):
        assert got[0][key].tolist() == got[10**9][key].tolist()
    assert [got[w]["times"] for w in got][0] == [got[w]["times"] for w in got][1]


def test_empty_table(spark, tables):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert align.align(df, *tables).collect() == []
    assert align.align(spark.createDataFrame([("q", None)], "doc_id string, text string"), *tables).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_words_that_are_new_are_encoded_together(tables, plain):
    a, pattern, b = tables
    encoder, pieces = byte_bpe.Encoder(a, pattern), align.PieceEncoder(b)
    texts = [" " + t for t in TEXTS if t]
    new = sorted({p for t in texts for p in encoder.find.findall(t)} | {"z" * n for n in (1, 2, 99, 100, 101, 250)} | {""})
    assert [list(memoryview(x).cast("i")) for x in encoder.merged_many(new)] == [encoder.merged(p.encode()) for p in new]
    assert encoder.merged_many([]) == [] == encoder.ids([])
    calls, model = [], pieces.model

    class Counted:
        def encode(self, words, **more):
            calls.append(words)
            return model.encode(words, **more)

    pieces.model = Counted()
    got = align._encoded(pieces.ids, texts)
    assert len(calls) == 1 and len(calls[0]) > 20
    assert [list(memoryview(x).cast("i")) for x in got] == [model.encode(t[1:]) for t in texts]


def test_encoders_go_with_their_task(tables):
    a, pattern, b = tables
    encoders = [byte_bpe.Encoder(a, pattern), align.PieceEncoder(b)]
    for e in encoders:
        e.ids([" Some words, some others."])
    gone = [weakref.ref(e) for e in encoders]
    gc.disable()
    try:
        del e, encoders
        assert [g() for g in gone] == [None, None]
    finally:
        gc.enable()


def test_a_block_is_linked_in_parts(tables):
    a, pattern, b = tables
    encoded = [byte_bpe.Encoder(a, pattern).ids, align.PieceEncoder(b).ids]
    tokens, decimals = [align._Tokens(t.texts) for t in (a, b)], align._decimals(len(a.texts), len(b.texts))

    def peak(n):
        texts = [" ".join(f"some words {i * k} here" for k in range(100)) for i in range(n)]
        texts[1::7] = [None] * len(texts[1::7])
        ids = pa.array(range(n))
        texts = [t or "" for t in texts]
        for e in encoded:
            align._encoded(e, [" " + t for t in texts if t])
        tracemalloc.start()
        found = align._block(ids, texts, *encoded, *tokens, decimals, False)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, found

    # Eight times the texts: one part would take eight times as much.
    (few, _), (many, found) = peak(100), peak(800)
    assert many < 4 * few
    assert len(found["pairs"]) == len(found["n_docs"]) and max(found["n_docs"]) == 800 - len(range(1, 800, 7))


@pytest.mark.parametrize("part_chars", [1, 40, 10**9])
def test_parts_don_t_show(tables, monkeypatch, part_chars):
    a, pattern, b = tables
    encoded = [byte_bpe.Encoder(a, pattern).ids, align.PieceEncoder(b).ids]
    texts = [t or "" for t in TEXTS]
    got = []
    for size in (align.PART_CHARS, part_chars):
        monkeypatch.setattr(align, "PART_CHARS", size)
        got.append(align._block(pa.array(range(len(texts))), texts, *encoded, align._Tokens(a.texts), align._Tokens(b.texts), align._decimals(len(a.texts), len(b.texts)), True))
    for x, y in zip(got[0].values(), got[1].values(), strict=True):
        assert bytes(x) == bytes(y) if not isinstance(x, int) else x == y


def test_more_new_words_than_are_kept(tables, plain):
    store, calls = _Kept(most=4), []

    def make(keys):
        calls.append(sorted(keys))
        return [k * 2 for k in keys]

    assert store.learn(set(range(1, 10)), make) == {k: 2 * k for k in range(1, 10)}
    assert len(store) + len(store.older) <= 4
    kept = {*store, *store.older}
    assert store.learn({*kept, 50}, make)[50] == 100
    assert calls == [list(range(1, 10)), [50]]
    a, pattern, b = tables
    texts = [" " + t for t in TEXTS if t]
    for few, many in ((byte_bpe.Encoder(a, pattern, 4), byte_bpe.Encoder(a, pattern)), (align.PieceEncoder(b, 4), align.PieceEncoder(b))):
        assert few.ids(texts) == few.ids(texts) == many.ids(texts)
