"""Guarded training examples: eligibility with reasons, message rows, leakage checks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as X
from claimloom.operators.scoring import triage_eligible


def check_request(partitions: Sequence[str], tiers: Sequence[str], allow_silver: bool = False) -> None:
    """Locked test data is never exported; silver tiers only when asked for."""
    if "test" in partitions:
        raise ValueError("locked test records can never be exported for training")
    unknown = [p for p in partitions if p not in ("train", "validation")]
    if unknown:
        raise ValueError(f"unknown training partition: {', '.join(unknown)}")
    if not allow_silver and any(t.upper() in ("C", "D") for t in tiers):
        raise ValueError("set allow_silver to export C/D records")


def extraction_reason(tier: Column, eligible: Column, path: Column, text: Column, tiers: Sequence[str],
                      require_eligible: bool = True) -> Column:
    """'' when the record may be exported, else the first reason against it."""
    flagged = F.coalesce(eligible, F.lit(False)) if require_eligible else F.lit(True)
    return (
        F.when(~tier.isin(*[t.upper() for t in tiers]), F.lit("tier_not_selected"))
        .when(~flagged, F.lit("not_training_eligible"))
        .when(~X.present(path), F.lit("source_pdf_missing"))
        .when(text.isNull(), F.lit("source_pdf_not_found"))
        .when(text == "", F.lit("pdf_text_empty"))
        .otherwise(F.lit(""))
    )


def triage_reason(relevant: Column, exclusion: Column, abstract: Column) -> Column:
    return (
        F.when(~triage_eligible(relevant, exclusion), F.lit("ambiguous_or_query_specific_label"))
        .when(~X.present(abstract), F.lit("abstract_missing"))
        .otherwise(F.lit(""))
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def example_row(example_id: Column, task: str, partition: Column, tier: Column, system: Column, user: Column,
                assistant: Column) -> Column:
    return F.struct(
        example_id.alias("id"), F.lit(task).alias("task"), partition.alias("partition"),
        F.struct(F.lit(False).alias("test_data"), F.lit(True).alias("target_absent_from_user_message"))
        .alias("leakage_guard"),
        tier.alias("quality_tier"),
        F.array(message("system", system), message("user", user), message("assistant", assistant)).alias("messages"),
    )


def triage_prompt(pmid: Column, title: Column, abstract: Column) -> Column:
    return F.concat(
        F.lit(config.TRIAGE_PROMPT + "PMID: "),
        pmid, F.lit("\nTITLE: "), X.coalesce_blank(title), F.lit("\nABSTRACT:\n"), X.coalesce_blank(abstract),
    )


def extraction_prompt(pmid: Column, title: Column, doi: Column, abstract: Column, text: Column, supplement: Column,
                      contract: dict | None = None) -> Column:
    """The contract when given, metadata, an optional supplement and the article text, in this order."""
    head = "" if contract is None else (
        config.EXTRACTION_PROMPT + json.dumps(contract, indent=2) + "\n\n"
    )
    return F.concat(
        F.lit(head),
        F.lit("=== METADATA ===\nPMID: "), X.coalesce_blank(pmid), F.lit("\nTitle: "), X.coalesce_blank(title),
        F.lit("\nDOI: "), X.coalesce_blank(doi), F.lit("\nAbstract: "), X.coalesce_blank(abstract), F.lit("\n\n"),
        F.when(X.coalesce_blank(supplement) != "",
               F.concat(F.lit("=== SUPPLEMENT / CONTROL STREAM ===\n"), supplement, F.lit("\n\n"))).otherwise(F.lit("")),
        F.when(X.coalesce_blank(text) != "", F.concat(F.lit("=== ARTICLE TEXT ===\n"), text)).otherwise(
            F.lit("=== ARTICLE TEXT ===\n" + config.NO_ARTICLE_TEXT)),
    )


def guard_violation(df: DataFrame) -> Column:
    """NULL for a clean example row (training JSON schema), else what is wrong with it."""
    roles = F.transform("messages", lambda m: m["role"])
    wanted = X.literal_array(["system", "user", "assistant"])
    return (
        F.when(F.coalesce(F.col("partition") == "test", F.lit(True)), F.lit("test_partition"))
        .when(F.coalesce(F.col("leakage_guard.test_data"), F.lit(True)), F.lit("test_data_flag"))
        .when(~F.coalesce(roles == wanted, F.lit(False)), F.lit("role_sequence"))
    )


def split_guarded(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("violation", guard_violation(df))
    return marked.filter(F.col("violation").isNull()).drop("violation"), marked.filter(F.col("violation").isNotNull())


def export_manifest(candidates: DataFrame) -> DataFrame:
    """Examples, candidates and skipped per task and partition."""
    return candidates.groupBy("task", "partition").agg(
        F.count_if(F.col("reason") == "").alias("examples"), F.count("*").alias("candidates"),
        F.count_if(F.col("reason") != "").alias("skipped"),
    )

