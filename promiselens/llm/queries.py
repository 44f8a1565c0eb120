"""The queries of this package by name, each over its whole table, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promiselens.llm import (
    alignment,
    chat,
    decontaminate,
    divergence,
    language,
    minhash,
    packing,
    quality_model,
    quality_rules,
    repeats,
    secrets,
    simhash,
    warc,
)
from promiselens.llm.common import table
from promiselens.llm.sql import SQL
from promiselens.session import materialise


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict, _ = quality_rules.judge(table(spark, sf_dir, "documents"))
    return verdict


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.update_ledger(table(spark, sf_dir, "documents"), secrets.new_ledger(spark)))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.NearParams(words=3, percent=85))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality_model.score(docs, quality_model.train(docs, labels.filter(~quality_model.held_out())))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", quality_model.held_out().alias("held_out"), "score", predicted)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = quality_model.held_out(mod=4, rest=2)
    found = language.predict(docs, language.train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pieces = chat.format_records(chat.records(turns.unionByName(chat.trap(turns))))
    return chat.digest(materialise(pieces))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.SimParams(words=3))
    return found.withColumn("fingerprint", simhash.hexadecimal(F.col("fingerprint")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_repeats, op3_decontaminate, op4_secrets, op5_warc, op6_minhash, op7_quality_model,
        op8_language, op9_chat, op10_packing, op11_divergence, op12_alignment, op13_simhash,
    )
}

ORACLE = {name: sql for name, sql in SQL.items() if name in QUERIES}
