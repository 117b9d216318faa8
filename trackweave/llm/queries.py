"""The registered queries of this folder: each applies one operator to its whole table and returns its digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import bytebpe, decontaminate, fertility, idfile, kernel, langid, lm, near, sql, substring, suffix, toxicity, trie, turns
from trackweave.llm.rows import KEY, documents, materialize, prepare
from trackweave.session import shared_dir


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_passages(documents(spark, sf_dir))
    return found.select(F.col(KEY).alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(documents(spark, sf_dir), langid.held_out(10))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"), ~langid.held_out(5))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out(5).alias("held_out"), "score", "predicted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.drop_repeated_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bytebpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN, offsets=False, back=True)
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(F.col(KEY).alias("doc_id"), "item_id", "score", "start_word", "end_word")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    idfile.write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return idfile.documents_of(spark, path)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels, network = langid.train(docs, F.col("lang"), ~langid.held_out(5))
    out = langid.predict_language(docs.select("doc_id", "text"), labels, network)
    return out.select("doc_id", langid.held_out(5).alias("held_out"), "lang_pred", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near.near_duplicates(documents(spark, sf_dir))
    return out.select(F.col(KEY).alias("doc_id"), "class_id", "n_links", F.col("kept").alias("is_first"))


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(fertility.measure(
        documents(spark, sf_dir).select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")).drop("text"))
    return fertility.judge(measured, fertility.bands(measured)).drop("lang")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(kernel.measure(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    model = kernel.train(measured, documents(spark, sf_dir, "labels"), "quality", ~langid.held_out(5))
    return kernel.score(measured, model).select("doc_id", langid.held_out(5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """id and symbols (a digest and the code points of each turn) of every conversation: the first h turns of the first conversation of its hundred, then its own after h."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), F.length(text).alias("size"))
    own = materialize(conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("own")))
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    both = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("base"), "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    symbols = F.concat(first, F.slice("own", F.col("h") + 1, F.size("own")))
    return both.select(F.col("conv_id").alias("id"), F.transform(symbols, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("symbols"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.sequences(rebuilt(documents(spark, sf_dir, "conversations"))))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of id and turn; nulls become one space first."""
    space = F.lit(" ")
    place = F.concat(*[F.coalesce(c, space) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, space).alias(c) for c in ("role", "text")], (F.crc32(place.cast("binary")) % 20).alias("fault"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = documents(spark, sf_dir, "conversations")
    rows = damaged(original)
    plans = materialize(turns.plan_repairs(rows))
    found = plans.join(turns.repaired_digests(rows, plans).withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("conv_id")
    all_ids = original.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: (lambda spark, sf_dir, f=f: f(prepare(spark), sf_dir))
    for f in (op1_repeated_passages, op2_lm_scores, op3_toxicity, op4_substring_dedup, op5_byte_bpe, op6_decontamination, op7_token_files, op8_language_id, op9_near_duplicates, op10_fertility,
              op11_quality, op12_conversation_trie, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op12_conversation_trie": sql.TRIE, "op13_conversation_repair": sql.REPAIR}
