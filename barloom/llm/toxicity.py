"""Toxicity by a linear-chain conditional random field over words.

Labels are per document, so token labels are made from them: on one part of the labelled sample, words and beginnings
of words that occur far more often in toxic than in clean texts (counted once per distinct text) get a strength, a word the
largest of its own; in the other part, strong words of toxic texts are the toxic tokens. The field has two states; a word's features are its own strength and those of the words
before and after it. It is fitted by gradient steps on forward-backward marginals. Per document the marginals are
aggregated (noisy-or, expected count, largest) and calibrated by a logistic regression; runs of likely toxic words
come out with their offsets.

Forward and backward passes run over all words of a slice at once: the words are cut into columns, each column's
product of two-by-two step matrices gives the state it starts from, and then all columns step together; a document's
first word starts anew. This is the exact recursion, only in another order.

The fit uses at most ``SAMPLE`` labelled rows of each class (by hash of the id, a documented bound); every text is scored whole.
Defined results: null and empty texts have no words and the score of a text without evidence; null labels don't train; without both
classes every score is 0; rows that repeat are scored alike; extra columns are carried (toxic_score and toxic_spans are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import small, written
from barloom.llm.decontaminate import BREAKS, fold
from barloom.llm.words import Words, slices

SAMPLE = 4_000
FIELD_DOCS = 1_500
STEPS, RATE, DECAY = 60, 0.3, 1e-3
#: Log-odds from which a word has strength 1, 2, ...; from ``STRONG`` on it is a toxic token in a toxic text.
BINS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
STRONG = 3
#: Lengths, in bytes, of the beginnings of words that can be signs.
BEGINNINGS = (4, 5, 6, 7, 8)
SPAN = 0.5


def _scan(w: np.ndarray, first: np.ndarray, a: np.ndarray, s: np.ndarray, back: bool) -> np.ndarray:
    """Ratio of state 1 to state 0: of the forward (or backward) sums at every word."""
    n = len(w)
    rows = max(1, int(np.sqrt(n)))
    cols = -(-n // rows)
    pad = rows * cols - n
    x = np.concatenate([w[::-1] if back else w, np.ones(pad)]).reshape(cols, rows).T
    # Backward, the word that was just passed decides the step; it starts anew where that word is a document's first.
    f = np.concatenate([first[::-1] if back else first, np.ones(pad, bool)]).reshape(cols, rows).T

    def step(i: int, v0: np.ndarray, v1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if back:
            y0, y1 = a[0, 0] * v0 + a[0, 1] * x[i] * v1, a[1, 0] * v0 + a[1, 1] * x[i] * v1
            both = v0 + v1
            y0, y1 = np.where(f[i], both, y0), np.where(f[i], both, y1)
        else:
            both = v0 + v1
            y0 = np.where(f[i], s[0] * both, a[0, 0] * v0 + a[1, 0] * v1)
            y1 = x[i] * np.where(f[i], s[1] * both, a[0, 1] * v0 + a[1, 1] * v1)
        return y0, y1

    one = (np.ones(cols), np.zeros(cols)), (np.zeros(cols), np.ones(cols))
    for i in range(rows):
        one = tuple(step(i, *v) for v in one)
        top = np.maximum(np.maximum(one[0][0], one[0][1]), np.maximum(one[1][0], one[1][1]))
        one = tuple((v0 / top, v1 / top) for v0, v1 in one)
    begin, v = np.ones((2, cols)), np.ones(2)
    for c in range(cols):
        begin[:, c] = v
        v = np.array([one[0][0][c] * v[0] + one[1][0][c] * v[1], one[0][1][c] * v[0] + one[1][1][c] * v[1]])
        v /= v.sum()
    out, (v0, v1) = np.empty((rows, cols)), begin
    for i in range(rows):
        if back:
            out[i] = v1 / v0  # before the word itself is passed
        v0, v1 = step(i, v0, v1)
        total = v0 + v1
        v0, v1 = v0 / total, v1 / total
        if not back:
            out[i] = v1 / v0
    flat = out.T.ravel()[:n]
    return flat[::-1] if back else flat


class Field:
    """Weights of the field: own, earlier and later strength, transitions and starts (all as logarithms)."""

    def __init__(self, kinds: int):
        self.own, self.before, self.after = np.zeros(kinds), np.zeros(kinds), np.zeros(kinds)
        self.step, self.start = np.zeros((2, 2)), np.zeros(2)

    def marginals(self, strength: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probability of state 1 at every word, and what a gradient needs besides."""
        last = np.append(first[1:], True)
        before = np.where(first, 0, np.append(0, strength[:-1]))
        after = np.where(last, 0, np.append(strength[1:], 0))
        w = np.exp(np.clip(self.own[strength] + self.before[before] + self.after[after], -30, 30))
        a, s = np.exp(self.step), np.exp(self.start)
        r, b = _scan(w, first, a, s, False), _scan(w, first, a, s, True)
        p = r * b / (1 + r * b)
        return p, w, r, b, before, after

    def fit(self, strength: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> None:
        names = ("own", "before", "after", "step", "start")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        kinds, inner, y = len(self.own), ~first[1:], toxic.astype(np.int64)
        pair = np.bincount((2 * y[:-1] + y[1:])[inner], minlength=4).reshape(2, 2)
        for t in range(1, STEPS + 1):
            p, w, r, b, before, after = self.marginals(strength, first)
            d = toxic - p
            a = np.exp(self.step)
            cells = [[a[0, 0] * np.ones(len(r) - 1), a[0, 1] * w[1:] * b[1:]], [a[1, 0] * r[:-1], a[1, 1] * r[:-1] * w[1:] * b[1:]]]
            total = sum(map(sum, cells))
            expected = np.array([[float((c / total)[inner].sum()) for c in row] for row in cells])
            g = {
                "own": np.bincount(strength, d, minlength=kinds),
                "before": np.bincount(before, d, minlength=kinds),
                "after": np.bincount(after, d, minlength=kinds),
                "step": pair - expected,
                "start": np.array([-d[first].sum(), d[first].sum()]),
            }
            for k in names:
                grad = g[k] / max(1.0, toxic.sum()) - DECAY * getattr(self, k)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad**2
                setattr(self, k, getattr(self, k) + RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8))


class Model:
    """Strengths of words by hash, the field, and the calibration."""

    def __init__(self, words: np.ndarray, strength: np.ndarray):
        order = np.argsort(words)
        self.words, self.strength = words[order], strength[order]
        # A bit per low hash bits keeps most signs away from the search.
        self.filter = np.zeros(1 << max(12, int(len(words)).bit_length() + 5), bool)
        self.filter[(self.words & np.uint64(len(self.filter) - 1)).astype(np.int64)] = True
        self.field: Field | None = None
        self.weights = np.zeros(4)

    def strengths(self, w: Words) -> np.ndarray:
        out = np.zeros(len(w.hash), np.int64)
        if not len(self.words) or not len(out):
            return out
        for sign in _signs(w):
            maybe = np.flatnonzero(self.filter[(sign & np.uint64(len(self.filter) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, sign[maybe]), len(self.words) - 1)
            hit = self.words[at] == sign[maybe]
            out[maybe[hit]] = np.maximum(out[maybe[hit]], self.strength[at[hit]])
        return out

    def probability(self, strength: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.field.marginals(strength, first)[0] if len(strength) else np.zeros(0)

    @staticmethod
    def evidence(p: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Per document: 1, noisy-or, logarithm of the expected count, largest marginal."""
        out = np.zeros((len(begin) - 1, 4))
        out[:, 0] = 1
        some = np.flatnonzero(np.diff(begin))
        if len(some):
            at = begin[:-1][some]
            out[some, 1] = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), at))
            out[some, 2] = np.log1p(np.add.reduceat(p, at))
            out[some, 3] = np.maximum.reduceat(p, at)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.weights, -40, 40)))


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words]]:
    for at, data, offs in slices(column):
        yield at, data, offs, Words(fold(data), offs, BREAKS)


def _signs(w: Words) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings."""
    return [w.hash, *(w.beginnings(k) for k in BEGINNINGS)]


def _firsts(w: Words) -> np.ndarray:
    first = np.zeros(len(w.hash), bool)
    first[w.first[:-1][np.diff(w.first) > 0]] = True
    return first


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled texts that train, a written table (text, toxic, part): at most SAMPLE of each class."""
    one = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kept = [one.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    ids = F.broadcast(kept[0].unionAll(kept[1]))  # two times SAMPLE rows of two numbers
    text = docs.select("doc_id", "text").where("text IS NOT NULL").join(ids, "doc_id")
    return written(text.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(3)).alias("part")), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on documents (doc_id, text) with labels (doc_id, toxic)."""
    rows = sample(docs, labels)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            label, part = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at, _, _, w in _words(batch.column(0)):
                signs = np.stack(_signs(w))
                found = [np.unique(signs[:, a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                row = np.repeat(np.arange(at, at + w.rows), [len(x) for x in found])
                columns = [np.concatenate(found).astype(np.int64), label[row].astype(np.int32), part[row].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "toxic", "part"])

    texts = rows.distinct()
    early = F.col("part") < 2
    toxic = F.col("toxic") == 1
    size = texts.agg(*[F.count_if(c).alias(x) for x, c in (("t", toxic), ("n", ~toxic), ("t2", toxic & early), ("n2", ~toxic & early))]).first()
    if not size["t2"] or not size["n2"]:
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    counts = texts.mapInArrow(distinct, "word long, toxic int, part int").groupBy("word")
    counts = counts.agg(*[F.count_if(c).alias(x) for x, c in (("t", toxic), ("n", ~toxic), ("t2", toxic & early), ("n2", ~toxic & early))])

    def odds(t: str, n: str):
        return F.log((F.col(t) + 0.5) / (size[t] + 1)) - F.log((F.col(n) + 0.5) / (size[n] + 1))

    strong = counts.select("word", *[F.when(F.col(t) >= max(4, size[t] // 200), odds(t, n)).alias(t) for t, n in (("t", "n"), ("t2", "n2"))])
    strong = strong.where((F.col("t") >= BINS[0]) | (F.col("t2") >= BINS[0])).toPandas()

    def lexicon(column: str) -> Model:
        value = strong[column].fillna(0.0).to_numpy(float)
        return Model(strong["word"].to_numpy(np.int64).astype(np.uint64), np.searchsorted(BINS, value, "right").astype(np.int64))

    # The field and the calibration learn on texts that the words' strengths do not come from; the model then has those of all.
    first_part, model = lexicon("t2"), lexicon("t")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for _, _, _, w in _words(batch.column(0)):
                s = first_part.strengths(w).astype(np.uint8)
                out += [s[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["strengths", "toxic"])

    fit = rows.where("part = 2").select("text", "toxic").distinct()
    fit = fit.withColumn("i", F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("text")))).where(F.col("i") <= FIELD_DOCS).select("text", "toxic")
    got = fit.mapInArrow(told, "strengths binary, toxic int").toPandas()
    got = got[got["strengths"].map(len) > 0]
    if got["toxic"].nunique() < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    strength = np.frombuffer(b"".join(got["strengths"]), np.uint8).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(got["strengths"].map(len).to_numpy())])
    first = np.zeros(len(strength), bool)
    first[begin[:-1]] = True
    y = got["toxic"].to_numpy(float)
    token = (np.repeat(y, np.diff(begin)) == 1) & (strength >= STRONG)
    model.field = Field(len(BINS) + 1)
    model.field.fit(strength, first, token)
    x = model.evidence(model.probability(strength, first), begin)
    weights = np.zeros(4)
    for _ in range(50):  # Newton steps of a logistic regression with a small penalty
        p = 1 / (1 + np.exp(-x @ weights))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        weights += np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.1 * weights), -5, 5)
    model.weights = weights
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with toxic_score and toxic_spans: (start, end, probability) of likely toxic runs, in code points, end exclusive."""
    docs = docs.drop("toxic_score", "toxic_spans")
    names = docs.columns
    keep = [c for c in names if keep_text or c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = "cast(null as array<struct<start:int,end:int,probability:double>>) AS toxic_spans"
    schema = docs.select(*keep).selectExpr("*", "0D AS toxic_score", spans).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small(batches):
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for at, data, offs, w in _words(batch.column(names.index(text))) if own.field else ():
                p = own.probability(own.strengths(w), _firsts(w))
                scores[at : at + w.rows] = own.score(own.evidence(p, w.first))
                hot = np.flatnonzero(p >= SPAN)
                if not len(hot):
                    continue
                runs = np.split(hot, np.flatnonzero((np.diff(hot) > 1) | (np.diff(w.row[hot]) > 0)) + 1)
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                for one in runs:
                    r, a, b = w.row[one[0]], w.start[one[0]], w.end[one[-1]]
                    zero = point[offs[r]]
                    spans[at + r].append({"start": int(point[a] - zero), "end": int(point[b] - zero), "probability": float(p[one].max())})
            columns = [batch.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array(spans, kind)], [*keep, "toxic_score", "toxic_spans"])

    return docs.mapInArrow(run, schema)
