"""Spelling variants against a plain version, and the cases that the docstring defines."""

import collections
import random
import re
import zlib

import pytest

from barloom.llm import spelling


def plain_words(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    out = {}
    near = {w: [v for v in words if apart_by_one(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    long = "".join(rng.choice("abcdefgh") for _ in range(200))
    words = {w: rng.randint(3, 40) for w in base}
    for w in [*base, long, long + "x"]:
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            v = rng.choice([w[:i] + "b" + w[i:], w[:i] + w[i + 1 :], w[:i] + "a" + w[i + 1 :], w])
            if len(v) >= 5:
                words[v] = rng.choice([3, 6, 12, 24, 48])
    got = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain(words)


def test_runs_of_one_letter_and_chains_of_forms(spark):
    words = {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 14)} | {"aaaab": 3, "baaaa": 3}
    got = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain(words)
    assert got["aaaaa"][1] == "a" * 13


def test_ties_go_to_the_smaller_word_in_code_point_order(spark):
    words = {"spellé": 9, "spellz": 9, "spella": 4, "Spellq": 1}
    got = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain(words)
    assert got["spella"][0] == "spellz"


def test_whole_texts_nulls_repeats_and_other_columns(spark):
    long = "Wortschatz wortschatz WORTSCHATZ Wortschats " * 1000 + "q" * 9_000
    rows = [(i, f"Colour color {'colour ' * (i % 5)} École école naïve-naïves x{i}") for i in range(400)]
    rows += [(None, "colour kolour"), (401, None), (402, ""), (403, long), (403, long), (403, long), (404, "1234 中文 İstanbul Kelvin")]
    df = spark.createDataFrame([(*r, "w", 1, ">") for r in rows], "doc_id long, text string, word string, n int, way string")
    assert found(spelling.group(df)) == plain(plain_words(rows))


def test_documents_against_the_plain_count(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert got == plain_words([tuple(r) for r in docs.collect()])


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c")], "doc_id long, text string")
    assert spelling.group(df).collect() == []
    assert spelling.group(df.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_words_meet_by_hash_tables_without_sorting_both_sides(spark):
    words = spark.createDataFrame([("house", 9), ("houses", 4), ("mouse", 3)], "word string, n long")
    paths = spelling._paths(words)
    asked = spelling._asked(spelling._edges(paths), paths)
    for df in (paths, spelling._stepped(spelling._starts(paths), asked)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_pair_is_walked_from_one_side(spark):
    words = {"house": 9, "houses": 4, "mouse": 3, "hous\u00e9": 5, "ouses": 4, "horse": 7, "hourse": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    walked = [tuple(r) for r in spelling._walked(df, "spelling").collect()]
    assert sorted(walked) == sorted((a, b) for a in words for b in words if apart_by_one(a, b) and (len(a) > len(b) or (len(a) == len(b) and a < b)))
    assert sorted(map(tuple, spelling.neighbours(df).collect())) == sorted(walked + [(b, a) for a, b in walked])
