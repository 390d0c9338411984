"""Byte-level BPE against the library, and the cases that the docstring defines."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from barloom.llm import byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tables():
    return byte_bpe.Tables.from_ranks(RANKS)


def texts(seed=3):
    rng = random.Random(seed)
    odd = ["it's we'll don''t  x", "a\n\n b \n\n\nc", "   ", "\t\tq", "1234567 89", "Ünïcödé 中文字 🙂🙃", "<|endoftext|> x", "!!!'s 's", "a" * 300, " " * 200 + "b", "ab" * 120]
    words = [*odd, *("".join(rng.choice("abcdeéz'1 \n") for _ in range(rng.randint(1, 12))) for _ in range(60))]
    return [None, "", *odd, *("".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(80))]


def test_pieces_against_the_library(tables, library):
    encoder = byte_bpe.Encoder(tables, P.PATTERN)
    rng = random.Random(9)
    for _ in range(400):
        piece = "".join(rng.choice("aeinst rlé'=-中") for _ in range(rng.randint(1, 250)))
        assert encoder.merged(piece.encode()) == library._encode_single_piece(piece.encode())


def test_listed_merges_against_the_library():
    path = P.path("byte_bpe_50k.json")
    encoder, lib = byte_bpe.Encoder(byte_bpe.Tables.from_json(path), P.PATTERN), Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    import numpy as np

    for t in texts()[1:]:
        assert np.frombuffer(encoder.ids(t), np.int32).tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 20), (97, 64), (32_768, 512)])
def test_chunks_against_the_library(spark, tables, library, chunk, overlap):
    rows = [(i % 50, t, "x", i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, _no int")
    got = byte_bpe.encode(df, tables, P.PATTERN, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "_no", "token_ids", "decoded"]
    found = {r["_no"]: (r["doc_id"], r["token_ids"], bytes(r["decoded"])) for r in got.collect()}
    assert len(found) == len(rows)
    for doc_id, text, _, i in rows:
        assert found[i] == (doc_id, library.encode_ordinary(text or ""), (text or "").encode())


def test_a_run_longer_than_the_overlap_is_parted_in_one_go(spark, tables, library):
    text = "ab cd " * 30 + "x" * 400 + " ef" * 40 + " " * 300 + "1" * 90 + "!?" * 80
    got = byte_bpe.encode(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), tables, P.PATTERN, chunk=60, overlap=16).collect()
    assert [r["token_ids"] for r in got] == [library.encode_ordinary(text)] * 2


def test_documents_and_digests_against_the_library(spark, sf, tables, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in byte_bpe.encode(docs, tables, P.PATTERN, digests_only=True, chunk=5_000).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and max(len(r["text"] or "") for r in rows) > 5_000
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_empty_table(spark, tables):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(df, tables, P.PATTERN).collect() == []
