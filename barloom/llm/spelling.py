"""Spelling variants: a frontier of (word, position, node, edits) states walks a trie that is a distributed edge table.

Trie: nodes are the beginnings of words that branch, end a word or start a walk; an edge carries all characters between two
nodes, so that a walk takes as many rounds as a word passes branches, not characters. A word's states start in the node half
its length down, as the first half is spelled exactly unless the edit lies in it; that case is met in a second trie, of the
reversed words, whose nodes stand in the same table. Every round joins the states with the edges of their nodes:

* no edit yet: the edge with the word's next character is the word's own path; every other one is a replaced or a
  deleted character, if the rest of its label then agrees (an edit can always be put where two words first differ);
* one edit: only the edge that agrees is followed.

Near is mutual, so every pair is walked from one side only and turned round at the end: a character is deleted but none
inserted (the longer word finds the shorter), and replaced only by a larger one (the smaller word finds the larger).

An edge can be asked for by its first character or by the one after that, so that a state meets only edges that agree in the
character that matters. States with one edit and no characters left are neighbours where their node ends a word. A node has
at most as many edges as there are letters, so a round makes at most some dozens of rows of a state, whatever words share a beginning.

Defined results: null and empty texts hold no words; a null id counts as the empty text in the checksum; rows that repeat
count as often as they are there; equal counts go to the smaller word in code-point order; an empty table gives no rows.
Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written

LETTER = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes up to this depth are named by their characters, deeper ones by a digest, so that a long word stays linear in size.
NAMED = 48


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 5, min_count: int = 3, lost_every: int = 97) -> DataFrame:
    """Words of whole texts with their numbers of occurrences: (word, n).

    One run in ``lost_every`` (by checksum of id and run) is counted without one of its characters.
    """
    runs = docs.select(
        F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("head"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTER}{{{min_chars},}}"), F.lit(0))).alias("run"),
    )
    # lower() is for ASCII only here: letters from U+00C0 on keep their case.
    capital = (F.octet_length("run") > F.char_length("run")) & F.col("run").rlike("[\\u00C0-\\u00DE]")
    runs = runs.withColumn("run", F.when(capital, F.translate("run", UPPER, LOWER)).otherwise(F.lower("run")))
    runs = runs.withColumn("h", F.crc32(F.concat("head", "run").cast("binary")))
    cut = F.expr("h % char_length(run)").cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.char_length("run")))
    word = F.when(F.col("h") % lost_every == 0, lost).otherwise(F.col("run")).alias("word")
    counted = runs.select(word).where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _hashed(df: DataFrame) -> DataFrame:
    """To be joined by hash tables of its shuffled parts, not by sorting both sides: of a key it has some dozens of rows at most."""
    return df.hint("shuffle_hash")


def _paths(words: DataFrame) -> DataFrame:
    """Every word both ways, with the trie nodes that it passes, in order: (word, way, stops of depth and node)."""
    both = words.select("word", F.explode(F.array(F.struct(F.lit(">").alias("way"), F.col("word").alias("path")), F.struct(F.lit("<").alias("way"), F.reverse("word").alias("path")))).alias("p"))
    both = both.select("word", "p.*").withColumn("long", F.char_length("path") > NAMED)
    # A long word in blocks, and a digest of all blocks before each, so that its nodes are named in linear time.
    blocks = F.expr(f"transform(sequence(0, char_length(path) div {NAMED}), i -> substring(path, i * {NAMED} + 1, {NAMED}))")
    both = both.withColumn("blocks", F.when(F.col("long"), blocks).otherwise(F.array("path")))
    chain = F.expr("aggregate(blocks, array(''), (a, b) -> concat(a, array(concat('#', sha2(concat(element_at(a, -1), b), 256)))))")
    both = both.withColumn("before", F.when(F.col("long"), chain).otherwise(F.array(F.lit(""))))
    # Position k has passed k characters; after the last one there is no next (0). A word has no nodes above its own start,
    # as only words of its own length and of one more meet it, which start there or below.
    both = both.withColumn("at", _start(F.char_length("path")))
    steps = both.select("*", F.explode(F.sequence("at", F.char_length("path"))).alias("depth"))
    block = F.expr(f"greatest(depth - 1, 0) div {NAMED}").cast("int")
    passed = F.substring(F.get("blocks", block), F.lit(1), F.col("depth") - block * NAMED)
    after = F.substring(F.get("blocks", F.expr(f"depth div {NAMED}").cast("int")), F.col("depth") % NAMED + 1, F.lit(1))
    steps = steps.select("way", "word", "depth", F.concat("way", F.get("before", block), passed).alias("node"), F.coalesce(F.ascii(after), F.lit(0)).alias("next"), (F.col("depth") == F.col("at")).alias("starts"))
    ends = steps.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"), F.max("starts").alias("starts"))
    nodes = ends.where("low <> high OR high = 0 OR starts").select("node")
    stop = F.struct("depth", "node")
    return steps.join(_hashed(nodes), "node", "left_semi").groupBy("way", "word").agg(F.sort_array(F.collect_list(stop)).alias("stops"), F.max(F.when(F.col("starts"), stop)).alias("start"))


def _start(size: Column) -> Column:
    """Characters before the node where a word of this size starts: the half that is exact if the edit lies in the other one."""
    shorter = F.floor(size / 2).cast("int")
    return F.when(F.col("way") == ">", shorter).otherwise(size - shorter)


def _path() -> Column:
    return F.when(F.col("way") == ">", F.col("word")).otherwise(F.reverse("word"))


def _edges(paths: DataFrame) -> DataFrame:
    """(at, label, child): every edge by its node with its first character, and with the one after that ('' at a word's end)."""
    e = paths.select(_path().alias("path"), "stops", F.posexplode(F.slice("stops", F.lit(2), F.size("stops") - 1)).alias("k", "to"))
    e = e.select("path", "to", F.expr("stops[k]").alias("from"))
    label = F.substring(F.col("path"), F.col("from.depth") + 1, F.col("to.depth") - F.col("from.depth"))
    return e.select("from.node", label.alias("label"), F.col("to.node").alias("child")).distinct()


def _asked(edges: DataFrame, paths: DataFrame) -> DataFrame:
    first = edges.select(_at("1", F.substring("label", 1, 1)).alias("at"), "label", "child")
    second = edges.where("char_length(label) > 1").select(_at("2", F.substring("label", 2, 1)).alias("at"), "label", "child")
    ends = paths.select(F.element_at("stops", -1)["node"].alias("child"), F.lit("").alias("next"))
    beyond = edges.select(F.col("node").alias("child"), F.substring("label", 1, 1).alias("next")).unionAll(ends)
    short = edges.where("char_length(label) = 1").join(_hashed(beyond), "child").select(_at("2", F.col("next")).alias("at"), "label", "child")
    return first.unionAll(second).unionAll(short)


def _at(place: str, letter: Column) -> Column:
    return F.concat("node", F.lit(place), letter)


def _starts(paths: DataFrame) -> DataFrame:
    """The first state of every word and way: as deep as its exact half reaches."""
    rest = F.substring(_path(), F.col("start.depth") + 1, F.char_length("word"))
    return paths.select("word", "start.node", rest.alias("rest"), F.lit(0).alias("edits"))


def _stepped(states: DataFrame, asked: DataFrame) -> DataFrame:
    """The states after one edge. ``rest`` is what the word still has to spell, i.e. its position."""
    one, two = F.substring("rest", 1, 1), F.substring("rest", 2, 1)
    fresh = F.col("edits") == 0

    def want(kind: str, place: str, letter: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), _at(place, letter).alias("at")))

    wants = F.array(
        want("same", "1", one, F.col("rest") != ""),
        want("replaced", "2", two, fresh & (F.col("rest") != "")),
        want("dropped", "1", two, fresh & (two != "") & (one != two)),
    )
    x = states.select("word", "rest", "edits", F.explode(F.array_compact(wants)).alias("w")).select("word", "rest", "edits", "w.*").join(_hashed(asked), "at")
    m, size, kind = F.char_length("label"), F.char_length("rest"), F.col("kind")
    tail = F.substring(F.col("label"), F.lit(2), m)
    fits = (
        F.when(kind == "same", F.col("rest").startswith(F.col("label")))
        .when(kind == "replaced", tail == F.substring(F.col("rest"), F.lit(2), m - 1))
        .otherwise(F.col("label") == F.substring(F.col("rest"), F.lit(2), m))
    )
    # Of two words that differ in one character the smaller finds the larger; a deleted one differs from the next already.
    x = x.where(fits & ((kind != "replaced") | (F.substring("label", 1, 1) > F.substring("rest", 1, 1))))
    used = F.when(kind == "dropped", m + 1).otherwise(m)
    return x.select("word", F.col("child").alias("node"), F.substring(F.col("rest"), used + 1, size).alias("rest"), F.when(kind == "same", F.col("edits")).otherwise(F.lit(1)).alias("edits"))


def _walked(words: DataFrame, name: str) -> DataFrame:
    """Pairs (word, near) one way each: near lacks a character of word, or has a larger one in its place."""
    paths = written(_paths(words), name)
    asked = written(_asked(written(_edges(paths), name), paths), name)
    # The last character left out (the word before it is a neighbour if the node ends one), or one edit and all spelled.
    done = F.expr("(edits = 0 AND char_length(rest) = 1) OR (edits = 1 AND rest = '')")
    states = written(_starts(paths), name)
    found = states.where(done).select("word", "node")
    while states.head(1):
        stepped = written(_stepped(states, asked), name)
        found = found.unionAll(stepped.where(done).select("word", "node"))
        states = stepped.where("rest <> ''")
    ends = paths.select(F.element_at("stops", -1)["node"].alias("node"), F.col("word").alias("near"))
    return found.join(_hashed(ends), "node").select("word", "near").distinct()


def neighbours(words: DataFrame, name: str = "spelling") -> DataFrame:
    """Pairs (word, near) of words that are one inserted, deleted or replaced character apart, each both ways, once."""
    pairs = _walked(words, name)
    way = F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))))
    return pairs.select(way.alias("p")).select("p.*")


def _roots(forms: DataFrame, name: str) -> DataFrame:
    """(word, root) of the words that have a form; a form has twice the count, so that chains are short and end."""
    cur = written(forms.select("word", F.col("form").alias("root")), name)
    while True:
        # Whom a root points to already may be far up: the chain's length halves every round.
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("up"))
        nxt = written(cur.join(on, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), name)
        cur = nxt.select("word", "root")
        if not nxt.where("moved").head(1):
            return cur


def variants(words: DataFrame, ratio: int = 2, name: str = "spelling") -> DataFrame:
    """Per word: form (its most frequent neighbour, if that has ``ratio`` times its count), root (the last form), n, n_near, form_n."""
    near = neighbours(words, name)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near.join(_hashed(counts), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("top"))
    found = words.join(_hashed(best), "word", "left")
    has = -F.col("top.less") >= ratio * F.col("n")
    found = written(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("top.near")).alias("form"), F.when(has, -F.col("top.less")).alias("form_n")
        ),
        name,
    )
    roots = _roots(found.where("form IS NOT NULL"), name)
    return found.join(_hashed(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "spelling") -> DataFrame:
    """The words of whole texts, each with its form and root."""
    return variants(written(vocabulary(docs, id_col, text), name), name=name)
