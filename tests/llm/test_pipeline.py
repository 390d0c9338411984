"""The pipeline's stages one by one, each on what the one before has kept; queries with SQL counterparts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm.oracles import ORACLES
from barloom.llm.queries import QUERIES
from test_oracles import canon


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    first = docs.orderBy("doc_id").first()
    extra = [(90001, "12 34 !!", "en", "s", 8), (90002, first["text"], "en", "s", 1), (90003, f"Some words. {bench} And more.", "en", "s", 1)]
    extra += [(90004, "Mail to jo.doe@mail.example.com please, the sooner the better for all of us.", "en", "s", 1)]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.schema.names == docs.schema.names
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        docs = out
    assert 90001 not in kept["language_id"] and len(kept["language_id"]) >= 200
    assert 90002 not in kept["jaccard_join"] and first["doc_id"] in kept["jaccard_join"]
    assert 90003 not in kept["decontaminate"] and 90004 in kept["decontaminate"]
    assert kept["pii"] == kept["decontaminate"]
    assert docs.where("doc_id = 90004").first()["text"].startswith("Mail to [email] please")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == len(kept["pii"]) and last.where(F.size("token_ids") == 0).count() == 0


def test_near_copies_go_by_five_words_and_80_percent(spark, sf):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for added in (10, 16, 18, 20, 22, 24, 26, 28, 40):
        base = text(104)
        rows += [(len(rows), base), (len(rows) + 1, f"{base} {text(added)}")]
    rows += [(100, text(3)), (101, ""), (102, None)]
    sets = {}
    for i, x in rows:
        w = (x or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    gone = {j for i in sets for j in sets if i < j and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(gone) == 6
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert {r["doc_id"] for r in kept.collect()} == set(sets) - gone


def test_stages_carry_columns_whatever_their_names(spark, sf):
    rng = random.Random(13)
    text = lambda: " ".join(rng.choices(["ka", "lo", "mi", "ra", "te", "zu"], k=40))
    names = ["score", "lang_pred", "leaks", "pii_base", "pii_spans", "_base_email", "_wide_ip", "decoded", "token_ids", "n", "key", "carried", "a.b"]
    texts = [text(), f"{text()} jo@mail.example.com", "", None, "12 34"]
    rows = [(i, x, "en", *[f"{c}{i}" for c in names]) for i, x in enumerate(texts)]
    cell = lambda c: f"`{c}` string"
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {', '.join(map(cell, names))}")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        own = [f"{c}_source" if name == "bpe" and c in corpus_pipeline.NEW else c for c in names]
        assert docs.columns == ["doc_id", "text", "lang", *own, *(corpus_pipeline.NEW if name == "bpe" else [])]
        docs = docs.cache()
        got = docs.collect()
        assert [r["doc_id"] for r in sorted(got)] == [0, 1]
        assert all(r[c] == f"{d}{r['doc_id']}" for r in got for c, d in zip(own, names, strict=True))


def test_stages_take_empty_tables_and_nulls(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    for rows in ([], [(1, None, None, None, None), (None, "some words here", None, None, None), (None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).cache()
            docs.count()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "decoded"]


def test_rows_of_a_repeated_id_go_by_their_own_text(spark, sf):
    rng = random.Random(14)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (2, f"{a} x"), (2, b), (3, f"{b} y"), (3, c), (None, f"{c} z"), (None, text())]
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[4], rows[6]], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_counterpart(spark, sf, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert canon(map(tuple, df.collect())) == canon([tuple(r[i] for i in order) for r in cursor.fetchall()])
