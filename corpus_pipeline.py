"""From raw documents to token ids: language, near duplicates, repeated passages, test items, encoding.

Each stage takes what the stage before wrote and returns the same columns, the last one also token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import bytebpe, decontaminate, langid, near, substring
from trackweave.llm.rows import documents, materialize, prepare

LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose best language scores below `LEAST_LANGUAGE_SCORE`."""
    prepare(spark)
    labels, network = langid.train(docs, F.col("lang"), ~langid.held_out(5))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    marked = langid.predict_language(docs.select("text", row), labels, network)
    return marked.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class."""
    prepare(spark)
    return near.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a text that loses words has the rest joined by single spaces, one of which nothing is left goes."""
    prepare(spark)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = substring.drop_repeated_windows(docs.select("doc_id", "text", F.struct(*others).alias("row"), *[F.col(c).alias("chars") for c in docs.columns if c == "n_chars"]))
    lost = F.col("n_removed") > 0
    made = {c: F.col(f"row.{c}") for c in others} | {
        "text": F.when(lost, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(lost, F.length("kept_text")).otherwise(F.col("chars")) if "n_chars" in docs.columns else None}
    return out.where(~lost | (F.col("n_removed") < F.col("n_words"))).select(*[made[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a test item."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, their number, and whether decoding them gives the text back."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bytebpe.encode(docs, path, public_tokenizers.PATTERN, offsets=False, back=True)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    made = {"n_tokens": F.size("ids").cast("long"), "round_trip": F.col("decoded") == text}
    return out.withColumns(made).select(*[c for c in docs.columns if c not in ("ids", *made)], "ids", *made)


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
    ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
#: Networks, edit alignment and byte-pair merges are not expressible in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
