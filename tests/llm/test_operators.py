"""Operators of the training-data pipeline against plain versions, round trips and the cases their docstrings define."""

import collections
import gc
import hashlib
import random
import re
import weakref
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import bpe, chat, common, decontaminate, jaccard_join, language_id, mtree, passages, pii, toxicity, warc, words
from barloom.llm.common import components

BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(df):
    return df.limit(0)


# ── common ──────────────────────────────────────────────────────────────────


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: root(x) for x in parent}


# ── 1 WARC ──────────────────────────────────────────────────────────────────


def packed(data):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize("form", [bytes, packed])
def test_salvage_recovers_what_follows_damage(form):
    records = [warc.record(i, f"http://x/{i}", b"<p>%d" % i * (i * 40 + 1), None) for i in range(6)]
    parts = [form(r) for r in records]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0x55
    junk = b"junk \x1f\x8b\x08 WARC/1.1\r\nno field\r\n"
    data = [*parts[:2], bytes(broken), parts[3], junk, parts[4], parts[5][:-9]]
    got = list(warc.salvage(pa.BufferReader(b"".join(data))))
    assert [r["record_id"] for r in got if r["kind"] == "record"] == [0, 1, 3, 4]
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    gaps = [(r["start"], r["end"]) for r in got if r["kind"] == "gap"]
    assert gaps == [(at[2], at[3]), (at[4], at[5]), (at[6], at[7])]
    assert list(warc.salvage(pa.BufferReader(b""))) == []


def test_a_record_inside_a_payload_is_payload():
    inner = warc.record(7, "u", b"inner", None)
    got = list(warc.salvage(pa.BufferReader(warc.record(1, "u", inner, None) + warc.record(2, "u", b"", None))))
    assert [(r["record_id"], r["payload"]) for r in got] == [(1, inner), (2, b"")]


def test_archives_give_rows_back(spark):
    long = "é" * 800
    rows = [(1, "a b", long), (2, None, long), (2, "x", long), (3, "x", "short"), (4, "x", "short"), (5, "x", None), (None, "x", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = warc.read(warc.write(df)).orderBy(F.col("record_id").asc_nulls_last(), "refers_to").collect()
    assert [(r["record_id"], r["warc_type"], r["refers_to"], r["payload_bytes"]) for r in got] == [
        (1, "revisit", 2, 1600), (2, "response", None, 1600), (2, "response", None, 1600),
        (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (None, "response", None, 1600),
    ]
    assert got[0]["payload_digest"] == hashlib.sha1(long.encode()).hexdigest()
    assert warc.read(warc.write(empty(df))).count() == 0


@pytest.mark.parametrize("size", [50, 40_000])
def test_salvage_inside_members_of_several_records(size):
    rng = random.Random(size)
    records = [warc.record(i, f"http://x/{i}", rng.randbytes(rng.randrange(size, 2 * size)), None) for i in range(200)]
    got = lambda data: list(warc.salvage(pa.BufferReader(data)))
    ids = lambda rows: [r["record_id"] for r in rows if r["kind"] == "record"]
    last = packed(warc.record(900, "u", b"last", None))
    assert ids(got(packed(b"".join(records)) + last)) == [*range(200), 900]
    # One bad digest in an intact member.
    bad = [r[:-6] + bytes([r[-6] ^ 1]) + r[-5:] if i == 70 else r for i, r in enumerate(records)]
    whole = packed(b"".join(bad))
    rows = got(whole + last)
    assert ids(rows) == [*range(70), *range(71, 200), 900]
    assert [(r["reason"], 0 <= r["start"] < r["end"] <= len(whole)) for r in rows if r["kind"] == "gap"] == [("digest", True)]
    # Cut off, a checksum that fails, a break inside; stored bytes that show records again.
    whole = packed(b"".join(records))
    assert ids(got(whole[: len(whole) // 2]))[:80] == list(range(80))
    assert ids(got(whole[:-8] + b"\0" * 8 + last)) == [*range(200), 900]
    broken = bytearray(whole)
    broken[len(whole) // 2 : len(whole) // 2 + 40] = bytes(40)
    rows = got(bytes(broken) + last)
    assert ids(rows)[:80] == list(range(80)) and ids(rows)[-1] == 900 and rows[-2]["kind"] == "gap"
    assert len(set(ids(rows))) == len(ids(rows))
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = c.compress(b"".join(records)) + c.flush()
    assert sorted(ids(got(stored[:-8] + b"\0" * 8 + last))) == [*range(200), 900]


@pytest.mark.parametrize("compress", [True, False])
def test_very_long_urls_are_read_back(spark, compress):
    rows = [(1, "data:," + "x y" * 35_000, "a"), (2, "u", "b")]
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), compress=compress)).orderBy("record_id").collect()
    assert [(r["kind"], r["record_id"], r["url"]) for r in got] == [("record", 1, rows[0][1].replace(" ", "%20")), ("record", 2, "u")]


# ── 2 chat ──────────────────────────────────────────────────────────────────


def test_windows_give_conversations_back(spark):
    rng = random.Random(2)
    letters = "<>[]/\\|s INSTlbp\n</s><|é😀"
    rows = [
        (c, t, rng.choice(["system", "user", "assistant", "a|b<c", None, "\\p"]), None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.randint(0, 200))))
        for c in range(40)
        for t in range(rng.randint(1, 14))
    ]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("extra"))
    talks = collections.defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((t, r or "", x or ""))
    for budget, history in ((2048, 256), (80, 30), (10, 0)):
        windows = chat.windows(df, budget, history)
        assert windows.where(f"NOT over AND n_tokens > {budget}").count() == 0
        got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
        assert set(got) == set(talks)
        for c, turns in talks.items():
            turns = sorted(turns)
            loss = "".join(x for _, r, x in turns if r == "assistant")
            whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
            assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
            assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.windows(empty(df)).count() == 0


def test_windows_keep_the_system_turn_and_mask_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"word{i} " * 6) for i in range(1, 9)]
    windows = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 60, 30).orderBy("window").collect()
    assert len(windows) > 1
    for w in windows:
        turns = list(chat.parse(w["formatted"]))
        assert turns[0][1:] == ("system", "be kind")
        assert all(s["start"] >= w["own_from"] for s in w["loss"])
    assert windows[1]["own_from"] > len(chat.turn("system", "be kind")[0])


# ── 3 passages ──────────────────────────────────────────────────────────────


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) + ("." if i % 9 == 8 else "") for i in range(n))


def test_passages_are_found_inside_other_texts(spark):
    rng = random.Random(3)
    passage = prose(rng, 63).capitalize()
    near = passage.replace(passage.split()[30], "zzzz")
    rows = [(i, f"{prose(rng, 40)} {passage if i % 3 else near} {prose(rng, 50)}") for i in range(6)]
    rows += [(i, prose(rng, 120)) for i in range(10, 20)] + [(30, None), (31, ""), (32, "the " * 400), (33, "the " * 400), (34, "One short line.\n" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(3))
    found = passages.repeats(df).collect()
    assert {r["doc_id"] for r in found} == set(range(6))
    text = dict(rows)
    for r in found:
        assert text[r["doc_id"]][r["start"] : r["end"]].strip() in (passage + near + text[r["doc_id"]])
    assert {r["doc_id"] for r in found if r["kept"]} == {0, 1} or {r["doc_id"] for r in found if r["kept"]} == {0}
    assert passages.repeats(empty(df)).count() == 0


def test_passages_of_a_repeated_id_are_cut_from_the_right_text(spark):
    rng = random.Random(35)
    a, b = prose(rng, 50).capitalize(), prose(rng, 50).capitalize()
    near = lambda x: x.replace(x.split()[25], "zzzz")
    rows = [(1, f"{a} {prose(rng, 30)}"), (1, f"{b} {prose(rng, 30)}"), (2, f"{near(a)} {prose(rng, 30)}"), (3, f"{near(b)} {prose(rng, 30)}"), (4, prose(rng, 90))]
    for order in (rows, rows[::-1]):
        found = passages.repeats(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert {r["doc_id"] for r in found if not r["kept"]} == {2, 3}


def test_passages_of_short_sentences_are_found(spark):
    rng = random.Random(31)
    short = lambda n: " ".join("".join(rng.choices("ABCDEFGH", k=6)) + rng.choice(["!!", ".!!", "!!", "?"]) for _ in range(n))
    passage = short(60)
    rows = [(i, f"{short(30)} {passage} {short(40)}") for i in range(3)] + [(i, short(130)) for i in range(10, 20)]
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["kept"]) for r in found} == {(0, True), (1, False), (2, False)}
    for i, text in rows[:3]:
        begin, inside = text.index(passage), [r for r in found if r["doc_id"] == i]
        assert min(r["start"] for r in inside) >= begin - 10 and max(r["end"] for r in inside) <= begin + len(passage) + 10
        assert sum(r["end"] - r["start"] for r in inside) >= 0.5 * len(passage)


def test_passages_are_found_whatever_the_signs_around(spark):
    rng = random.Random(33)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))
    bare, quoted = words(50), '." '.join(words(12) for _ in range(5))
    hindi = "। ".join(words(13) for _ in range(4))
    rows = [(10 * k + i, f"{words(33)} {x} {words(41)}") for k, x in enumerate((bare, quoted, hindi)) for i in range(2)]
    rows += [(40 + i, f"{words(70)}. {words(30 + i)} {bare} {words(9)}. {words(45)}.") for i in range(2)] + [(60 + i, words(150)) for i in range(5)]
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert {r["doc_id"] for r in found if r["kept"]} == {0, 10, 20}
    assert {r["doc_id"] for r in found if not r["kept"]} == {1, 11, 21, 40, 41}
    for r in found:
        assert any(text[r["doc_id"]][r["start"] : r["end"]] in x for x in (bare, quoted, hindi)), r


def test_every_shared_run_holds_an_equal_window():
    rng = random.Random(34)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    for _ in range(2000):
        run, nodes = words(passages.LEAST + passages.SPAN - 1), []
        for _ in range(2):
            data = f"{words(rng.randrange(60))} {run} {words(rng.randrange(60))}".encode()
            nodes.append(set(passages.Paragraphs(np.frombuffer(data, np.uint8), np.array([0, len(data)]), windows=True).node.tolist()))
        assert nodes[0] & nodes[1]


def test_bands_reach_the_recall():
    for percent, recall in ((80, 0.95), (80, 0.99), (80, 0.999), (60, 0.99)):
        first, second = passages.tune(percent, recall)
        j = percent / 100
        assert (1 - (1 - j) ** first) * (1 - (1 - j**passages.ROWS) ** second) >= recall


@pytest.mark.parametrize("small", [passages.SMALL, 300])
def test_passages_equal_all_pairs_of_paragraphs(spark, docs, monkeypatch, small):
    """Against a plain join of all paragraphs that share a shingle, over all documents of the smallest table."""
    monkeypatch.setattr(passages, "SMALL", small)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    sets, where = {}, collections.defaultdict(set)
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        for windows in (False, True):
            p = passages.Paragraphs(data, np.array([0, len(data)]), windows=windows)
            for node, a, b in zip(p.node.tolist(), p.begin.tolist(), p.stop.tolist(), strict=True):
                where[node].add(i)
                if not windows:
                    sets[node] = set(p.shingle[a : b - passages.SHINGLE + 1].tolist())
    holders = collections.defaultdict(set)
    for node, s in sets.items():
        for x in s:
            holders[x].add(node)
    parent = {node: node for node in where}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for node, s in sets.items():
        common = collections.Counter(o for x in s for o in holders[x] if o > node)
        for o, n in common.items():
            if 100 * n >= passages.PERCENT * (len(s) + len(sets[o]) - n) and len(where[node] | where[o]) > 1:
                parent[root(node)] = root(o)
    spread = collections.defaultdict(set)
    for node, ids in where.items():
        spread[root(node)] |= ids
    want = {i for ids in spread.values() if len(ids) > 1 for i in ids}
    got = {r["doc_id"] for r in passages.repeats(docs).select("doc_id").distinct().collect()}
    assert want and got <= want
    assert len(got) >= passages.RECALL * len(want)


# ── 4 M-tree ────────────────────────────────────────────────────────────────


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 64)
    monkeypatch.setattr(mtree, "LEAF", 5)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 6)), np.repeat(rng.normal(size=(1, 6)), 200, axis=0), np.zeros((3, 6))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [1.0, 2.0]), (None, [1.0] * 6), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    whole = mtree.whole(df, "vec_id", "embedding", 256)
    got = mtree.search(whole, whole.where("vec_id % 50 = 0"), 5).collect()
    full = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and len(v) == 6]
    for q in {i for i, _ in full if i % 50 == 0}:
        own = next(v for i, v in full if i == q)
        want = sorted(((-int(own @ v), i) for i, v in full if i != q))[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert mtree.search(empty(whole), empty(whole)).count() == 0


# ── 5 decontamination ───────────────────────────────────────────────────────


def test_leaks_equal_brute_force(spark, sf):
    rng = random.Random(5)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "Three short words"), (None, prose(rng, 150) + "."), (903, items[0][1])]
    rows = [(i, f"{prose(rng, 90)} {x.upper() if i % 5 == 0 and x.isascii() else x} {prose(rng, 200)}") for i, (_, x) in enumerate(items) if x]
    rows += [(500 + i, prose(rng, 300)) for i in range(20)] + [(600, None), (601, ""), (602, " ".join(items[1][1].split()[:6]) + " " + prose(rng, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaks", F.lit(0)).withColumn("item_id", F.lit(1))
    found = decontaminate.flag(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    cut = lambda x: re.findall(r"[^\W_]+", x.lower())
    for r in found:
        words = cut(r["text"] or "")
        want = set()
        for item, x in items:
            w = cut(x or "")
            k = min(5, len(w))
            grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
            here = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
            if grams and len(grams & here) >= 0.8 * len(grams):
                want.add(item)
        assert {x["item_id"] for x in r["leaks"]} == want, r["doc_id"]
    assert decontaminate.flag(df, empty(spark.createDataFrame(items, "item_id long, text string"))).where("size(leaks) > 0").count() == 0


# ── 6 language ──────────────────────────────────────────────────────────────


def test_language_accuracy_and_unknown(spark, docs):
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = language_id.train(docs.where(~held))
    got = language_id.identify(docs.where(held).withColumn("score", F.lit("x")), model)
    rate = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert rate >= 0.95 and got.where("score < 0 OR score > 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the " * 100000)], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.identify(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    untrained = language_id.train(empty(docs))
    assert {r["lang_pred"] for r in language_id.identify(odd, untrained).collect()} == {"und"}


# ── 7 Jaccard join ──────────────────────────────────────────────────────────


def brute_join(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = {i: i + 32 for i in range(65, 91)}
    parent, sets, where = {i: i for i, _ in rows}, {}, collections.defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        w = word.findall((text or "").translate(lower))
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()
        shared = collections.Counter(j for s in sets[i] for j in where[s])
        for j, n in shared.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), root(i)) for i, _ in rows}


def test_join_equals_brute_force(spark, docs, monkeypatch):
    rng, rows = random.Random(7), []
    for _ in range(100):
        base = [str(rng.randrange(50)) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 30, 80, 300]))]
        for _ in range(rng.choice([1, 2, 3, 8])):
            v = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                v.insert(rng.choice([0, len(v)]), f"z{rng.randrange(5)}")
            rows.append((len(rows), " ".join(v)))
    rows += [(9000, None), (9001, ""), (9002, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    want = brute_join(rows)
    assert {r[0]: (r[1], r[2]) for r in jaccard_join.join(df).collect()} == want
    monkeypatch.setattr(jaccard_join, "TILE", 300)  # blocks are cut into many tiles
    assert {r[0]: (r[1], r[2]) for r in jaccard_join.join(df).collect()} == want
    assert jaccard_join.join(empty(df)).count() == 0
    assert jaccard_join.join(df.unionAll(df)).distinct().count() == len(rows)


def test_join_tells_the_texts_of_a_repeated_id_apart(spark):
    rng = random.Random(71)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, b), (1, a), (2, f"{b} more"), (3, f"{a} more"), (None, c), (None, f"{c} more"), (None, d), (7, f"{d} more"), (None, None), (8, text())]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df).collect())
        assert got == {(1, 57, 1): 2, (2, 58, 1): 1, (3, 58, 1): 1, (None, 57, None): 1, (None, 58, None): 1, (None, 57, 7): 1, (7, 58, 7): 1, (None, 0, None): 1, (8, 57, 8): 1}


@pytest.mark.parametrize(("percent", "k"), [(80, 5), (85, 4)])
def test_linked_sets_share_a_signature_at_every_size(percent, k):
    rng, rule = np.random.default_rng(percent), jaccard_join._remember(jaccard_join.Rule(k, percent))
    for union in [*range(1, 300), *rng.integers(300, 4000, 150).tolist()]:
        x = np.unique(rng.integers(0, 2**64, union, dtype=np.uint64))
        rng.shuffle(x)
        shared = -(-len(x) * percent // 100)  # no pair that links has fewer in common
        own = int(rng.integers(0, len(x) - shared + 1))
        a, b = np.sort(x[: shared + own]), np.sort(np.concatenate([x[:shared], x[shared + own :]]))
        assert rule.linked(shared, len(a), len(b))
        assert len(np.intersect1d(jaccard_join._signatures(a, rule), jaccard_join._signatures(b, rule)))
        c = int(rule.size_class(min(len(a), len(b))))
        if rule.bounds[c] >= jaccard_join.STRONG:  # the stated bound, at the class's worst
            n, common = rule.groups(c), -(-rule.bounds[c] * percent // 100)
            assert (1 - (1 - 1 / n) ** rule.differing(c) * (1 - (1 - 1 / n) ** common)) ** jaccard_join.GROUPS <= jaccard_join.MISS


def test_combined_signatures_keep_keys_connected():
    rng = np.random.default_rng(5)
    sig, key = rng.integers(0, 300, 4000), rng.integers(0, 900, 4000)
    out = jaccard_join._combined(sig, key)

    def parts(sig, key):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for s, k in zip(sig.tolist(), key.tolist(), strict=True):
            x, y = root(("s", s)), root(("k", k))
            parent[x] = y
        groups = collections.defaultdict(set)
        for k in set(key.tolist()):
            groups[root(("k", k))].add(k)
        return sorted(map(sorted, groups.values()))

    few = rng.integers(0, 4000, 300)  # few enough signatures that there are many parts
    assert parts(sig[few], key[few]) == parts(*(c.to_numpy() for c in jaccard_join._combined(sig[few], key[few]).columns))
    assert len(np.unique(out.column(0).to_numpy()[:300])) == len(np.unique(sig))


# ── 8 toxicity ──────────────────────────────────────────────────────────────


def test_field_marginals_equal_enumeration():
    rng = np.random.default_rng(8)
    field = toxicity.Field(4)
    for k in ("own", "before", "after", "step", "start"):
        setattr(field, k, rng.normal(size=getattr(field, k).shape))
    strength, lengths = rng.integers(0, 4, 13), [5, 1, 7]
    first = np.zeros(13, bool)
    first[[0, 5, 6]] = True
    got, at = field.marginals(strength, first)[0], 0
    for n in lengths:
        s, total, one = strength[at : at + n], 0.0, np.zeros(n)
        for state in range(1 << n):
            y = [(state >> i) & 1 for i in range(n)]
            e = field.start[y[0]] + sum(field.step[a, b] for a, b in zip(y[:-1], y[1:], strict=True))
            for i in range(n):
                if y[i]:
                    e += field.own[s[i]] + field.before[s[i - 1] if i else 0] + field.after[s[i + 1] if i + 1 < n else 0]
            total += np.exp(e)
            one += np.exp(e) * np.array(y)
        assert np.allclose(got[at : at + n], one / total)
        at += n


def test_toxicity_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.where(~held).withColumn("text", F.lit("clash")))
    rows = toxicity.score(docs.where(held), model).join(labels, "doc_id").select("toxic", "toxic_score", "toxic_spans").collect()
    hit = [r["toxic_score"] >= 0.5 for r in rows if r["toxic"] == 1]
    miss = [r["toxic_score"] >= 0.5 for r in rows if r["toxic"] == 0]
    assert np.mean(hit) >= 0.85 and np.mean(miss) <= 0.02
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é trash idiot moron scum")], "doc_id long, text string")
    got = toxicity.score(odd, model).orderBy("doc_id").collect()
    assert got[0]["toxic_score"] == got[1]["toxic_score"] < 0.5
    assert [s["start"] for s in got[2]["toxic_spans"]] == [2]
    none = toxicity.score(odd, toxicity.train(empty(docs), labels)).collect()
    assert {r["toxic_score"] for r in none} == {0.0}


# ── 9 BPE ───────────────────────────────────────────────────────────────────


def test_encoder_equals_the_library(docs):
    own, lib = bpe.Encoder(bpe.Tables(BPE)), Tokenizer.from_file(BPE)
    rng = random.Random(9)
    letters = "abcdeinthrsoΣσςİßéàÉñ'`<|startoftext|>  \n\t\x1c\x85​̀123٣Ⅷ漢字かกमा🎉👩‍👧\x00﻿"
    texts = [r["text"] for r in docs.limit(100).collect()]
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 300))) for _ in range(300)]
    texts += ["", "a" * 5000, "<|endoftext|>x<|startoftext|> <|startof", "ab" * 3000 + "!" * 1000]
    for x in texts:
        ids, decimal = own.encode(x)
        want = lib.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want and decimal == " ".join(map(str, want))
        assert own.decode(ids).decode() == lib.decode(want, skip_special_tokens=False)


def test_encode_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "Hello  World", 6)], "doc_id long, text string, n_tokens int")
    a = bpe.encode(df, BPE).orderBy("doc_id").collect()
    assert a[0]["token_ids"] == [] and a[0]["decoded"] == "" and a[1]["n_tokens"] == 6
    b = bpe.encode(df, BPE, digests_only=True).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in b] == [0, len(a[1]["token_ids"])]
    assert b[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert b[1]["decoded_sha256"] == hashlib.sha256(a[1]["decoded"].encode()).hexdigest()
    assert bpe.encode(empty(df), BPE).count() == 0


# ── 10 personal data ────────────────────────────────────────────────────────

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_rules(spark):
    rng = random.Random(10)
    rows = [(i, "".join(rng.choices("abc.@-_%+ 0123456789()😀é\n", k=rng.randint(0, 80)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "a@b.c_d@e.fr"), (5003, "4111 1111-1111 1111 x 00001.2.3.255 1.2.3.256 1.2.3.4.5.6.7.8.9")]
    rows += [(5004, "1 " * 20000), (5005, "a" * 100000), (5006, "9" * 21 + ".1.2.3 +" + "1-" * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii_spans", F.lit(1))
    got = {r["doc_id"]: r for r in pii.find(df, pii.Model()).collect()}
    for i, text in rows:
        assert [tuple(s) for s in got[i]["pii_base"]] == plain_spans(text)
        assert got[i]["pii_spans"] == got[i]["pii_base"]


def test_model_adds_spans_and_redaction_removes_them(spark):
    rows = [(i, f"write to user{i}@mail.example.com or call +1 (275) 555-{1000 + i} now, not 12345 or a@b") for i in range(200)]
    rows += [(1000, "call (275) 555-5927 today"), (1001, None), (1002, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(df)
    found = pii.find(df, model)
    spans = {r["doc_id"]: [tuple(s) for s in r["pii_spans"]] for r in found.collect()}
    assert spans[1000] == [("phone", 5, 19)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert clean[0] == "write to [email] or call [phone] now, not 12345 or a@b"
    assert clean[1001] is None and clean[1002] == "nothing here"
    assert pii.find(empty(df), pii.train(empty(df))).count() == 0




def test_tasks_give_freed_memory_back(monkeypatch):
    """At their beginning and their end, so that a worker that is used again does not add up what its tasks held."""
    from barloom.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    batches = iter([pa.RecordBatch.from_arrays([pa.array(range(7))], ["x"])])
    assert [b.num_rows for b in common.small(batches, 3)] == [3, 3, 1] and len(calls) == 2
    monkeypatch.undo()
    common.release()


class Tasks:
    """Stands for a table: takes the function that tasks run."""

    columns = ["doc_id", "text"]
    schema = None

    def mapInArrow(self, run, schema):
        self.run = run

    def selectExpr(self, *_):
        return self

    drop = selectExpr


def test_sets_are_keyed_in_small_parts_without_the_texts():
    texts = [f"one two three four w{i}" for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(texts)], ["doc_id", "text"])
    jaccard_join.keyed(tasks := Tasks(), keep_text=False)
    parts = list(tasks.run(iter([batch])))
    assert max(p.num_rows for p in parts) <= 500
    assert all(p.schema.names == ["doc_id", "n", "key"] for p in parts)
    whole = pa.Table.from_batches(parts).to_pydict()
    assert whole["doc_id"] == list(range(1200)) and set(whole["n"]) == {2} and len(set(whole["key"])) == 1200
    jaccard_join.keyed(tasks)
    assert pa.Table.from_batches(list(tasks.run(iter([batch])))).to_pydict() == {"doc_id": whole["doc_id"], "text": texts, "n": whole["n"], "key": whole["key"]}


def test_stars_are_sent_in_parts():
    n = 120_000
    pairs = [pa.array(np.arange(1, n)), pa.array(np.zeros(n - 1, np.int64))]
    common.stars(tasks := Tasks())
    parts = list(tasks.run(iter([pa.RecordBatch.from_arrays(pairs, ["a", "b"])])))
    assert max(p.num_rows for p in parts) <= 50_000
    whole = pa.Table.from_batches(parts).to_pydict()
    assert sorted(whole["a"]) == list(range(1, n)) and set(whole["b"]) == {0}


def test_an_encoder_goes_with_its_task():
    encoder = bpe.Encoder(bpe.Tables(BPE))
    encoder.encode("Some words, some others.")
    gone = weakref.ref(encoder)
    gc.disable()
    try:
        del encoder
        assert gone() is None
    finally:
        gc.enable()


def test_tasks_of_the_pipeline_work_on_small_parts(monkeypatch):
    monkeypatch.setattr(words, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    texts = [f"word{i} " * 2_000 for i in range(300)]
    parts = list(decontaminate._words(pa.array(texts)))
    assert sum(w.rows for _, w in parts) == 300 and max(len(w._sums) for _, w in parts) <= 1 << 20
    assert max(map(len, words._POWERS)) <= 1 << 20
    grams = list(language_id._grams(texts, language_id.BUCKETS))
    assert [lo for lo, *_ in grams] == [0, *[hi for _, hi, *_ in grams[:-1]]] and grams[-1][1] == 300
    assert max(len(row) for *_, row in grams) <= 1 << 19


def test_a_search_in_small_groups_finds_the_same(monkeypatch):
    rng = random.Random(15)
    text = lambda n: " ".join(f"w{rng.randrange(5_000)}" for _ in range(n))
    items = [(i, text(rng.randrange(5, 300))) for i in range(60)]
    index = decontaminate.Index(items)
    texts = pa.array([f"{text(rng.randrange(200))} {items[i % 60][1]} {text(rng.randrange(200))}" for i in range(90)] + ["", text(900)])
    search = lambda: [index.candidates(w) for _, w in decontaminate._words(texts)]
    found = search()
    assert sum(map(len, found)) == 90
    for cells in (1, 500, 1 << 21):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        assert search() == found
