"""Reports over findings, fused fields and the inspection history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as T

NOT_DETECTED = "Not detected"


def authority_summary(findings: DataFrame) -> DataFrame:
    """Satisfied and applicable rules of each package by authority; shown first come first, the two main ones before others."""
    rank = F.when(F.col("authority") == "FSSAI", 0).when(F.col("authority") == "Legal Metrology", 1).otherwise(2)
    return (
        findings.where("status <> 'not_applicable'")
        .groupBy("package_id", "authority")
        .agg(F.count_if(F.col("status") == "detected").alias("satisfied"), F.count("*").alias("applicable"), F.min(rank).alias("shown_rank"))
    )


def review_items(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status").isin("missing", "unclear")).select("package_id", "rule_id", "authority", "requirement", F.upper("severity").alias("severity"), "status", "message")


def fusion_kpis(fused: DataFrame) -> DataFrame:
    d = F.col("decision")
    return fused.groupBy("package_id").agg(F.count_if(d == "ai_fill").alias("ai_filled"), F.count_if(d == "conflict").alias("conflicts"))


def key_facts(declarations: DataFrame, fields: list[str]) -> DataFrame:
    """Chosen fields with a default for what is empty."""
    return declarations.select("package_id", *(F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit(NOT_DETECTED)).alias(f) for f in fields))


def decision_chips(fused: DataFrame) -> DataFrame:
    d = F.col("decision")
    chip = F.when(d == "agreement", "Verified").when(d == "ai_fill", "AI").when(d == "conflict", "Conflict").when(d == "deterministic_only", "OCR").when(d == "no_evidence", "Missing").otherwise("Review")
    return fused.select("package_id", "field", chip.alias("chip"), F.coalesce(F.nullif("value", F.lit("")), F.lit(NOT_DETECTED)).alias("shown"))


def context_labels(declarations_with_context: DataFrame) -> DataFrame:
    c = F.col("context")
    return declarations_with_context.select(
        "package_id", F.when(c["is_food"], "Food product").otherwise("Non-food product").alias("kind"), F.when(c["is_imported"], "Imported / origin declared").otherwise("Domestic").alias("origin")
    )


def history_kpis(inspections: DataFrame) -> DataFrame:
    d = F.col("decision")
    return inspections.agg(
        F.count("*").alias("total"), F.count_if(d == "Compliant").alias("compliant"), F.count_if(d == "Requires Correction").alias("requires_correction"), F.count_if(d == "Non-Compliant").alias("non_compliant")
    )


def search_history(inspections: DataFrame, query: str = "", decision: str = "All") -> DataFrame:
    """Rows whose id, product, maker and batch contain the query, and whose decision is the given one; a null product reads as none."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("inspection_id", "product_name", "manufacturer", "batch_number")]
    text: Column = F.lower(F.concat_ws(" ", *columns))
    tests = ([text.contains(query.strip().lower())] if query.strip() else []) + ([F.col("decision") == decision] if decision != "All" else [])
    return inspections.where(reduce(lambda a, b: a & b, tests)) if tests else inspections


def showing(inspections: DataFrame, found: DataFrame) -> DataFrame:
    """(n, total) of a search."""
    return found.agg(F.count("*").alias("n")).join(inspections.agg(F.count("*").alias("total")))


def history_rows(inspections: DataFrame) -> DataFrame:
    """Rows for a list, with defaults."""
    label = F.when(F.col("decision") == "Compliant", "Compliant").when(F.col("decision") == "Non-Compliant", "Non-compliant").when(F.col("decision") == "Requires Correction", "Needs correction").otherwise("Undetermined")
    return inspections.select(
        "inspection_id", F.when(T.present(F.col("product_name")), F.col("product_name")).otherwise("Unnamed package").alias("title"),
        F.when(T.present(F.col("manufacturer")), F.col("manufacturer")).otherwise(NOT_DETECTED).alias("maker"), label.alias("label"), F.coalesce("compliance_percent", F.lit(0.0)).alias("percent"),
    )


def inspection_detail(inspections: DataFrame, inspection_id: str, hidden: tuple[str, ...] = ("raw_text", "evidence", "fusion", "fusion_fields")) -> DataFrame:
    """One inspection without its bulky columns."""
    return inspections.where(F.col("inspection_id") == inspection_id).drop(*hidden)
