"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of every labelled text inside the tasks and sums the (language, bucket) counts in Spark;
the matrix of log probabilities (languages x buckets, a size set by parameters and the label set) is broadcast, and
each Arrow batch is scored in numpy: a batch is a sparse row-by-bucket incidence whose product with the matrix is a
gather and a segmented sum.

Defined results: a text that is null or holds no letter is ``und`` with score 0; ties go to the first language in
alphabetical order; rows without a label or text do not train; with no trainable row every text is ``und``.
Repeated rows count as often as they occur. Extra columns are carried, never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15  # a power of two
SMOOTHING = 0.5
#: A posterior is taken over at most so many n-grams' worth of evidence, so that long texts do not all score 1.
EVIDENCE = 60.0
#: Characters that a task works on at once (a matter of memory only); a longer text is taken whole.
PART = 1 << 18
UNKNOWN = "und"

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _LETTER


def _grams(texts: list[str | None], buckets: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(from row, to row, bucket ids by order, row of each position) of bounded groups of whole texts."""
    at, n = 0, len(texts)
    letters, shift = _letters(), np.uint64(64 - (buckets.bit_length() - 1))
    while at < n:
        to, size = at, 0
        while to < n and (to == at or size + len(texts[to] or "") <= PART):
            size += len(texts[to] or "") + 1
            to += 1
        parts = [(t or "").lower() for t in texts[at:to]]
        code = np.frombuffer(" ".join(parts + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        row = np.repeat(np.arange(to - at), lengths)
        # Everything but letters is one separator; runs of it count once.
        word = letters[code]
        code = np.where(word, code, np.uint32(32))
        keep = word.copy()
        keep[1:] |= word[:-1]
        code, row = code[keep], row[keep]
        out = []
        rolled = np.zeros(len(code), np.uint64)
        for k in ORDERS:
            # Hash of the last k characters: that of the k - 1 before the last one, and the last one.
            rolled[1:] = rolled[:-1] * np.uint64(0x100000001B3)
            rolled += code
            h = ((rolled + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32)
            # Windows that cross into another row, and the lone separator, go to a bucket that weighs nothing.
            h[: k - 1] = buckets
            h[k - 1 :][row[k - 1 :] != row[: max(0, len(code) - k + 1)]] = buckets
            if k == 1:
                h[code == 32] = buckets
            out.append(h)
        yield at, to, out, row
        at = to


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket (float32, languages x buckets), from all labelled rows."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in small(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            index = {x: i for i, x in enumerate(names)}
            of = np.array([index[x] for x in langs], np.int64)
            total = np.zeros(len(names) * (buckets + 1), np.int64)
            for lo, hi, grams, row in _grams(texts, buckets):
                base = of[lo:hi][row] * (buckets + 1)
                for h in grams:
                    total += np.bincount(base + h, minlength=len(total))
            for x in names:
                part = total[index[x] * (buckets + 1) :][:buckets]
                sums[x] = sums[x] + part if x in sums else part.copy()
        for x, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], ["lang", "bucket", "n"]
            )

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    langs = sorted(got["lang"].unique())
    table = np.full((len(langs), buckets), SMOOTHING)
    if langs:
        table[np.searchsorted(langs, got["lang"].to_numpy()), got["bucket"].to_numpy()] += got["n"].to_numpy()
    table = np.log(table / table.sum(axis=1, keepdims=True)) if langs else table
    return [str(x) for x in langs], table.astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; only ``text`` is read for the prediction."""
    langs, table = model
    spark = docs.sparkSession
    buckets = table.shape[1]
    shared = spark.sparkContext.broadcast(np.hstack([table, np.zeros((len(langs), 1), np.float32)]))
    drop = [c for c in ("lang_pred", "score") if c in docs.columns]
    docs = docs.drop(*drop)
    names = docs.columns
    schema = docs.selectExpr("*", "'' AS lang_pred", "0D AS score").schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in small(batches):
            texts = batch.column(names.index(text)).to_pylist()
            pred, prob = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo, hi, grams, row in _grams(texts, buckets):
                if not langs:
                    break
                total, seen = np.zeros((hi - lo, len(langs))), np.zeros(hi - lo, np.int64)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                here = row[first]
                for h in grams if len(row) else ():
                    for k in range(len(langs)):
                        total[here, k] += np.add.reduceat(weights[k][h], first, dtype=np.float64)
                seen += np.bincount(row[grams[0] < buckets], minlength=hi - lo)
                some = seen > 0
                scale = np.minimum(1.0, EVIDENCE / np.maximum(1, len(ORDERS) * seen))
                logit = (total - total.max(axis=1, keepdims=True)) * scale[:, None]
                share = np.exp(logit)
                share /= share.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                for i in np.flatnonzero(some):
                    pred[lo + i] = langs[best[i]]
                prob[lo:hi] = np.where(some, share[np.arange(hi - lo), best], 0.0)
            columns = [*batch.columns, pa.array(pred, pa.string()), pa.array(prob, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


def without_unknown(docs: DataFrame, identified: DataFrame) -> DataFrame:
    """Rows of known language, with the columns of ``docs``."""
    return identified.where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)
