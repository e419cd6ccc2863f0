"""The numbered queries, each a thin use of its operator, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import held_out, shared_dir
from labelloom.llm import chat_format, decontaminate, fill_in_middle, filter_audit, near_duplicates
from labelloom.llm.decontaminate import mark_contaminated
from labelloom.llm.importance import resample_by_importance
from labelloom.llm.language_id import identify_languages
from labelloom.llm.mixing import mix_sources
from labelloom.llm.quality_rules import judge_quality
from labelloom.llm.token_counts import count_tokens
from labelloom.llm.token_files import read_token_files, write_token_files
from labelloom.llm.toxicity import score_toxicity
from labelloom.llm.url_filter import Rule, filter_urls
from labelloom.shipping import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_by_importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path)


URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(_table(spark, sf_dir, "documents"), train=~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return marked.drop("text_hash")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restored_text(F.col("output"), F.col("form"))
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], said.schema)
    return chat_format.read_conversations(chat_format.format_conversations(said.unionByName(planted)))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_importance, op3_toxicity, op4_token_counts, op5_token_files, op6_url_filter, op7_language_id, op8_quality_rules, op9_near_duplicates, op10_decontamination, op11_filter_audit, op12_fill_in_middle, op13_chat_format)}
ORACLE: dict[str, str] = {
    "op9_near_duplicates": near_duplicates.oracle(),
    "op10_decontamination": decontaminate.oracle(),
    "op11_filter_audit": filter_audit.oracle(),
    "op12_fill_in_middle": fill_in_middle.oracle(),
    "op13_chat_format": chat_format.oracle(),
}
