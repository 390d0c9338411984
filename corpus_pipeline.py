"""From documents to token ids: five stages, each applying one operator to all that the one before has kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, jaccard_join, language_id, pii
from barloom.llm.common import written


#: Columns that stages read; all others travel in one struct, so that none meets a name that an operator uses.
READ = ("doc_id", "text", "lang")
NEW = ("token_ids", "decoded")


def apart(stage: Callable) -> Callable:
    """The stage with the other columns of documents packed away, and their order and names restored.

    Whatever they are called, they come out as they went in; own columns that are called like a new one of the last stage
    get ``_source`` added to their names.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        other = [c for c in names if c not in READ]
        packed = docs.select(*[c for c in READ if c in names], *([F.struct(*[F.col(f"`{c}`") for c in other]).alias("carried")] if other else []))
        out = stage(spark, packed, sf_dir)
        new = [c for c in out.columns if c in NEW]
        named = {}
        for c in names:
            named[c] = c
            while named[c] in new or (named[c] != c and named[c] in names):
                named[c] += "_source"
        return out.select(*[(F.col("carried")[c] if c in other else F.col(c)).alias(named[c]) for c in names], *new)

    return run


@apart
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows; texts without a letter, which have no language, go."""
    return language_id.without_unknown(docs, language_id.identify(docs, language_id.train(docs)))


@apart
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (80 % of five-word shingles) the document with the smallest id stays.

    Rows that repeat an id go or stay each by its own text; those of one group that hold its smallest id stay, all of them. A row
    without an id goes where its group has one with an id.
    """
    joined = jaccard_join.join_sets(docs, k=5, percent=80)
    gone = joined.where("NOT doc_id <=> component_id").select("doc_id", "key").distinct().alias("gone")
    mine = jaccard_join.keyed(docs, k=5).alias("mine")
    same = F.col("mine.doc_id").eqNullSafe(F.col("gone.doc_id")) & (F.col("mine.key") == F.col("gone.key"))
    return mine.join(gone, same, "left_anti").select(*docs.columns)


@apart
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    flagged = decontaminate.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return flagged.where(F.size("leaks") == 0).select(*docs.columns)


@apart
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in brackets; every document stays."""
    return pii.redact(pii.find(docs, pii.train(docs))).select(*docs.columns)


@apart
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids and the text that these decode to."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("decontaminate", without_benchmark),
    ("pii", without_personal_data),
    ("bpe", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
