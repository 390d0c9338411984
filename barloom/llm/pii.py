"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select redactions.

Everything that touches a text is a DataFrame expression. Per kind there is the base rule, whose spans always stay, and a
wider generator of high recall. Training counts all generated candidates by binned format and context features (a
table whose size the bins bound) with the base rule's check as the label; trees are boosted over those counts and
become CASE expressions. A kind's threshold is the lowest score that reaches ``PRECISION`` on the half of the texts
(by hash) that the trees have not seen; where none does, the kind gets no spans beyond the base ones.

Positions are code points, end exclusive. Defined results: a null text is empty and has no spans; rows are handled one
by one, so repeated rows give repeated results; with no candidates anywhere only base spans come out. Extra
columns are carried; columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
ROUNDS, DEPTH, RATE = 24, 3, 0.3

# Base rules. Possessive repeats and the check for the beginning of a run (or of the search, \\G) match what the plain
# patterns match, without trying a run again from within or keeping a stack of positions.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![^\s])[^\s@\[\]()]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[^\s@\[\]()]{1,255}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}+)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
}
FEATURES = 7


def _spans(found: Column, pieces: Column) -> Column:
    """Start and end of every match, from the texts between the matches; with the texts beside it."""
    steps = F.aggregate(
        F.transform(found, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("size"))),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts"),
        ),
    )
    return F.transform(
        F.arrays_zip(found.alias("m"), steps["starts"].alias("s")),
        lambda z, i: F.struct(
            z["s"].alias("start"),
            (z["s"] + F.length(z["m"])).alias("end"),
            z["m"].alias("match"),
            F.substring(F.get(pieces, i), -24, 24).alias("before"),
            F.substring(F.get(pieces, i + 1), 1, 1).alias("after"),
        ),
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits from the right: every second one doubled, nines cast out; the sum is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    weighed = F.transform(each, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The base rule's check of one of its matches."""
    n = F.length(_digits(m))
    if kind == "ip":
        parts = F.split(m, r"\.")
        return F.forall(parts, lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.right(x, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return n.between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _features(kind: str, c: Column) -> Column:
    """Binned format and context of a candidate, as small numbers."""
    m, n = c["match"], F.length(_digits(c["match"]))
    left = F.lower(c["before"])

    def side(x: Column) -> Column:
        return F.when(F.length(x) == 0, 0).when(x.rlike(r"\s"), 1).when(x.rlike(r"[\p{L}\p{N}]"), 3).otherwise(2)

    has = [F.when(m.contains(x), 1 << i).otherwise(0) for i, x in enumerate(("-", " ", ".", "("))]
    return F.array(
        F.when(n == 0, 0).when(n <= 6, 1).when(n <= 8, 2).when(n <= 11, 3).when(n <= 12, 4).when(n <= 15, 5).when(n <= 16, 6).when(n <= 19, 7).otherwise(8),
        has[0] + has[1] + has[2] + has[3],
        F.when(m.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}$"), 3).when(m.rlike("[0-9]{3}[-. ][0-9]{4}$"), 2).when(m.rlike("^[0-9]+$"), 1).otherwise(0),
        F.when(left.rlike("mail"), 1).when(left.rlike("tel|phone|call|fax|mobile"), 2).when(left.rlike("card|visa|credit|account"), 3).when(left.rlike(r"\bip\b|host|addr|server"), 4).otherwise(0),
        side(F.right(c["before"], F.lit(1))),
        side(c["after"]),
        F.when(m.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"), 3).when(m.rlike(r"[\[(]at[\])].*(?:\.|dot)[^A-Za-z]*[A-Za-z]+"), 2).when(m.contains("@"), 1).otherwise(0),
    )


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with, per kind, ``_base_<kind>`` (checked spans) and ``_wide_<kind>`` (candidates)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rules = [(f"_{way}_{k}", k, way, p[k]) for way, p in (("base", BASE), ("wide", WIDE)) for k in KINDS]
    docs = docs.withColumns({f"{name}_m": F.regexp_extract_all(t, F.lit(p), F.lit(0)) for name, _, _, p in rules})
    docs = docs.withColumns({f"{name}_p": F.when(F.size(f"{name}_m") > 0, F.split(t, p, -1)) for name, _, _, p in rules})
    docs = docs.withColumns({name: F.when(F.size(f"{name}_m") > 0, _spans(F.col(f"{name}_m"), F.col(f"{name}_p"))) for name, *_ in rules})
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string,before:string,after:string>>)")
    out = {}
    for name, kind, way, _ in rules:
        got = F.coalesce(F.col(name), none)
        out[name] = F.filter(got, lambda c: _valid(kind, c["match"])) if way == "base" else got
    return docs.withColumns(out).drop(*[f"{name}_{x}" for name, *_ in rules for x in "mp"])


def _label(kind: str, m: Column) -> Column:
    """Whether the base rule takes the whole candidate (for e-mail: part of it)."""
    if kind == "email":
        return m.rlike(BASE["email"])
    return m.rlike({"ip": f"^(?:{BASE['ip']})$", "card": f"^(?:{BASE['card']})$", "phone": rf"^\+[0-9][\x20().0-9-]+[0-9]$"}[kind]) & _valid(kind, m)


class Model:
    """Per kind: trees as nested (feature, bound, below, above) or leaf values, and the threshold on their sum."""

    def __init__(self) -> None:
        self.trees: dict[str, list] = {k: [] for k in KINDS}
        self.bound: dict[str, float | None] = dict.fromkeys(KINDS)

    def score(self, kind: str, f: Column) -> Column:
        def case(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            at, bound, below, above = node
            return F.when(F.get(f, F.lit(at)) <= bound, case(below)).otherwise(case(above))

        out = F.lit(0.0)
        for tree in self.trees[kind]:
            out = out + case(tree)
        return out


def train(docs: DataFrame, text: str = "text") -> Model:
    """Boosts trees over the counts of all candidates by their features."""
    half = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(2)).alias("half")
    found = with_candidates(docs.select(text), text).select(half, *[f"_wide_{k}" for k in KINDS])
    each = F.flatten(
        F.array(
            *[
                F.transform(f"_wide_{k}", lambda c: F.struct(F.lit(k).alias("kind"), _features(k, c).alias("f"), _label(k, c["match"]).alias("label")))
                for k in KINDS
            ]
        )
    )
    rows = (
        found.select("half", F.explode(each).alias("c"))
        .groupBy("half", F.col("c.kind").alias("kind"), F.col("c.f").alias("f"))
        .agg(F.count("*").alias("n"), F.sum(F.col("c.label").cast("long")).alias("hits"))
        .collect()
    )
    model = Model()
    for kind in KINDS:
        part = {h: [r for r in rows if r["kind"] == kind and r["half"] == h] for h in (0, 1)}
        if part[0] and part[1]:
            f, n, y = (np.array([r[x] for r in part[0]], float) for x in ("f", "n", "hits"))
            model.trees[kind] = _boost(f, n, y)
            f, n, y = (np.array([r[x] for r in part[1]], float) for x in ("f", "n", "hits"))
            model.bound[kind] = _threshold(_apply(model.trees[kind], f), n, y)
    return model


def _apply(trees: list, f: np.ndarray) -> np.ndarray:
    def values(node, rows: np.ndarray) -> np.ndarray:
        if not isinstance(node, tuple):
            return np.full(len(rows), node)
        at, bound, below, above = node
        return np.where(rows[:, at] <= bound, values(below, rows), values(above, rows))

    return sum((values(t, f) for t in trees), np.zeros(len(f)))


def _boost(f: np.ndarray, n: np.ndarray, y: np.ndarray) -> list:
    """Newton steps of the logistic loss on counted rows: n rows of features f, y of them positive."""
    trees, total = [], np.zeros(len(f))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        trees.append(_grow(f, y - n * p, n * p * (1 - p), np.arange(len(f)), DEPTH))
        total += _apply(trees[-1:], f)
    return trees


def _grow(f: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int):
    value = lambda rows: float(np.clip(RATE * g[rows].sum() / (h[rows].sum() + 1.0), -2, 2))
    gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    best = (1e-6, None)
    for k in range(f.shape[1] if depth else 0):
        for bound in np.unique(f[at, k])[:-1]:
            low, high = at[f[at, k] <= bound], at[f[at, k] > bound]
            better = gain(low) + gain(high) - gain(at)
            if better > best[0]:
                best = (better, (k, int(bound), low, high))
    if best[1] is None:
        return value(at)
    k, bound, low, high = best[1]
    return k, bound, _grow(f, g, h, low, depth - 1), _grow(f, g, h, high, depth - 1)


def _threshold(score: np.ndarray, n: np.ndarray, y: np.ndarray) -> float | None:
    best = None
    for s in sorted(set(score.tolist()), reverse=True):
        took = score >= s
        if y[took].sum() >= PRECISION * n[took].sum() and y[took].sum() > 0:
            best = s
    return None if best is None else best - 1e-9


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with pii_base and pii_spans: arrays of (kind, start, end), by kind as listed, then start."""
    got = with_candidates(docs.drop("pii_base", "pii_spans"), text)

    def slim(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    base = {k: slim(k, F.col(f"_base_{k}")) for k in KINDS}
    more: dict[str, Callable] = {}
    for k in KINDS:
        if model.bound[k] is None:
            continue
        taken = F.filter(f"_wide_{k}", lambda c: model.score(k, _features(k, c)) >= model.bound[k])
        free = F.filter(
            taken, lambda c: ~F.exists(f"_base_{k}", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        )
        more[k] = slim(k, free)
    every = [F.sort_array(F.concat(base[k], more[k])) if k in more else base[k] for k in KINDS]
    got = got.withColumns({"pii_base": F.concat(*base.values()), "pii_spans": F.concat(*every)})
    return got.drop(*[f"_{way}_{k}" for way in ("base", "wide") for k in KINDS])


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of pii_spans in the text by its kind in brackets; of overlapping spans the union, named after the first."""
    ordered = F.array_sort(
        F.transform("pii_spans", lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind")))
    )
    whole = F.col(text)
    joined = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, c: F.when(
            c["start"] >= acc["at"],
            F.struct(
                F.concat(acc["done"], F.substring(whole, acc["at"] + 1, c["start"] - acc["at"]), F.lit("["), c["kind"], F.lit("]")).alias("done"),
                (-c["back"]).alias("at"),
            ),
        ).otherwise(F.struct(acc["done"].alias("done"), F.greatest(acc["at"], -c["back"]).alias("at"))),
    )
    clean = F.when(F.size("pii_spans") > 0, F.concat(joined["done"], F.substring(whole, joined["at"] + 1, F.length(whole)))).otherwise(whole)
    return found.withColumn(text, clean).drop("pii_base", "pii_spans")
