"""One query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import align, bpe, byte_bpe, chat, decontaminate, jaccard_join, language_id, mtree, passages, pii, spelling, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(mod: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(_table(spark, sf_dir, "pages")), keep_payload=False).where("kind = 'record'")
    return records.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.windows(turns))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(_table(spark, sf_dir, "documents"))


def op4_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mtree.whole(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return mtree.search(rows, rows.where("vec_id % 50 = 0"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    flagged = decontaminate.flag(docs, _table(spark, sf_dir, "benchmark"))
    return flagged.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_crc(4) == 2, F.lit(False)))
    model = language_id.train(docs.where("NOT held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_crc(5) == 0, F.lit(False)))
    labels = _table(spark, sf_dir, "labels").where(F.coalesce(_crc(5) != 0, F.lit(False)))
    found = toxicity.score(docs.select("doc_id", "held_out", "text"), toxicity.train(docs, labels), keep_text=False)
    return found.select(
        "doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans")
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests_only=True)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))

    def listed(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])))

    counts = [F.size(F.filter("pii_base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("pii_base"), 256).alias("base_sha256"), listed("pii_spans").alias("spans"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a = byte_bpe.Tables.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    b = align.PieceTables(public_tokenizers.path("piece_bpe_32k.model"))
    return align.align(_table(spark, sf_dir, "documents"), a, public_tokenizers.PATTERN, b)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tables = byte_bpe.Tables.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tables, public_tokenizers.PATTERN, digests_only=True)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_chat": op2_chat,
    "op3_passages": op3_passages,
    "op4_mtree": op4_mtree,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_id": op6_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
    "op11_align": op11_align,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling": op13_spelling,
}
