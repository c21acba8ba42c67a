"""Two extraction lanes per article: ingest, comparison, adjudication, status decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import jsontools as J
from claimloom.functions import text as X
from claimloom.operators import claims as C
from claimloom.plans import semantics
from claimloom.schemas import CONTRACTS
from claimloom.session import cut_lineage


def ingest_lane(responses: DataFrame, text_col: str, kind: str = "lane") -> DataFrame:
    """Responses with ``payload``, ``error`` and ``available``: repaired, parsed, checked against the contract."""
    repaired = J.salvage(responses, text_col)
    node = F.try_parse_json("payload")
    broken = J.conformance_error(node, CONTRACTS[kind])
    return repaired.withColumn("error", F.coalesce("error", broken)).withColumn(
        "available", F.col("error").isNull() & F.col("payload").isNotNull()
    ).withColumn("prompt_version", F.lit(config.PROMPT_VERSION))


def decode_lane(responses: DataFrame, text_col: str, kind: str = "lane") -> DataFrame:
    """Responses to typed, enriched lanes: ``available``, ``error``, ``model_present`` and the struct ``extraction``.

    A response is repaired, parsed, held against its contract and decoded; what breaks the contract anywhere, a wrong
    type included, is an error row without an extraction.  ``extraction`` has the fields that comparison and scoring
    read (``semantics.contract_extraction``); ``decoded`` is the whole response.
    """
    ready = J.decode(J.salvage(responses, text_col), "payload", CONTRACTS[kind], "decoded")
    there = F.col("error").isNull() & F.col("decoded").isNotNull()
    return ready.withColumns({
        "available": there, "model_present": F.col("decoded.model_present"), "prompt_version": F.lit(config.PROMPT_VERSION),
        "extraction": F.when(there, semantics.contract_extraction(F.col("decoded.extraction"))),
    })


def compare_responses(responses: DataFrame, keys: list[str], text_col: str, vision_col: str, kind: str = "lane",
                      tolerance: float = config.CLAIM_TOLERANCE) -> dict[str, DataFrame]:
    """Both lanes of every record from their response texts: ``lanes``, the ``claims`` side by side, and the ``summary``."""
    sides = {}
    for side, col in (("text", text_col), ("vision", vision_col)):
        sides[side] = cut_lineage(decode_lane(responses.select(*keys, col), col, kind).select(
            *keys, F.col("available").alias(f"{side}_available"), F.col("error").alias(f"{side}_error"), "model_present", "extraction"))

    def claims(side: str) -> DataFrame:
        rows = sides[side].filter(f"{side}_available")
        return X.inline_rows(rows, keys, C.extraction_claims(F.col("extraction"), F.col("model_present")), "field")

    both = sides["text"].drop("model_present", "extraction").join(sides["vision"].drop("model_present", "extraction"), keys)
    compared = C.compare_lanes(claims("text"), claims("vision"), keys, tolerance)
    return {"lanes": both, "text": sides["text"], "vision": sides["vision"], "claims": compared,
            "summary": C.comparison_summary(compared, both, keys)}


def needs_adjudication(comparison: DataFrame) -> DataFrame:
    """Comparable records with at least one difference."""
    return comparison.filter(F.col("comparable") & (F.col("difference_count") > 0))


def merge_adjudication(best: DataFrame, resolved: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """The resolved extraction replaces the best lane's where an adjudicated answer is available."""
    r = resolved.filter(F.col("available")).select(*keys, F.col(payload).alias("_resolved"))
    return best.join(r, keys, "left").withColumn(payload, F.coalesce("_resolved", payload)).withColumn(
        "adjudicated", F.col("_resolved").isNotNull()
    ).drop("_resolved")


def lane_decision(text_available: Column, vision_available: Column, text_present: Column, vision_present: Column,
                  consistent: Column, adjudicated: Column, adjudicated_present: Column, major_unresolved: Column,
                  best_present: Column, gate_failed: Column, independent: Column, policy: Column) -> Column:
    """struct(status, model_present, gate_passed) by the decision table.

    No lane: review.  Both absent or consistent: machine_consistent.  Adjudicated
    without a major unresolved field: machine_adjudicated.  A failed evidence
    gate or correlated lanes under the 'preferred' policy go back to review.
    Under 'required' correlated lanes are refused: no status but the refusal, no
    model, no passed gate.
    """
    comparable = text_available & vision_available
    both_absent = comparable & ~text_present & ~vision_present
    agreed = comparable & consistent
    settled = comparable & ~agreed & ~both_absent & adjudicated
    first = (
        F.when(both_absent | agreed, F.lit("machine_consistent"))
        .when(settled & ~major_unresolved, F.lit("machine_adjudicated"))
        .otherwise(F.lit("needs_review"))
    )
    same = comparable & (text_present == vision_present)
    present = (
        F.when(both_absent, F.lit(False))
        .when(agreed, text_present & vision_present)
        .when(settled, adjudicated_present)
        .when(same, text_present)
        .when(best_present, F.lit(True))
    )
    demoted = (F.coalesce(present, F.lit(False)) & gate_failed) | (
        ~independent & (policy == "preferred") & first.isin("machine_consistent", "machine_adjudicated")
    )
    refused = comparable & ~independent & (policy == "required")
    return F.struct(
        F.when(refused, F.lit("independence_required")).when(demoted, F.lit("needs_review")).otherwise(first).alias("status"),
        F.when(~refused, present).alias("model_present"),
        (independent | (policy == "off")).alias("independence_gate_passed"),
    )


def falsification_decision(text_available: Column, checks_ready: Column, binding_ready: Column, quarantined: Column) -> Column:
    """Status when the second lane only challenges the ledger."""
    ready = text_available & F.coalesce(checks_ready, F.lit(True)) & F.coalesce(binding_ready, F.lit(True)) & ~F.coalesce(
        quarantined, F.lit(False))
    return F.when(ready, F.lit("machine_consistent")).otherwise(F.lit("needs_review"))


def article_status(status: Column, model_present: Column) -> Column:
    """A confirmed absence is an exclusion; otherwise the lane status stands."""
    confirmed = (model_present == F.lit(False)) & status.isin("machine_consistent", "machine_adjudicated")
    return F.when(F.coalesce(confirmed, F.lit(False)), F.lit("excluded_no_model")).otherwise(status)


def publication_status(status: Column, model_present: Column) -> Column:
    """Catalogue status of a publishable article, null when nothing is published."""
    return F.when(F.coalesce(model_present, F.lit(False)),
                  F.when(status == "needs_review", F.lit("review")).otherwise(status))


def text_status(full_text: Column, abstract: Column, responded: Column, parse_error: Column, recommended: Column,
                verdict: Column) -> Column:
    """Status of a single-text extraction; missing text and abstract is an error value."""
    has_text, has_abstract = X.present(full_text), X.present(abstract)
    drafted = F.when(has_text, F.lit("draft")).otherwise(F.lit("stub"))
    return (
        F.when(~has_text & ~has_abstract, F.lit("error_no_text"))
        .when(~F.coalesce(responded, F.lit(False)), F.lit("stub"))
        .when(X.present(parse_error), F.lit("stub"))
        .when(F.coalesce(verdict == "reject", F.lit(False)), F.lit("stub"))
        .when(X.present(recommended), recommended)
        .otherwise(drafted)
    )


def quote_check(quotes: Column, evidence: Column) -> Column:
    """struct(verdict, missing_evidence): quotes that are no literal part of the evidence."""
    missing = F.filter(quotes, lambda q: ~F.coalesce((q != "") & F.contains(evidence, q), F.lit(False)))
    return F.struct(
        F.lit("needs_review").alias("verdict"),
        F.when(F.size(missing) > 0, missing).otherwise(X.literal_array(["Independent assessment not available"]))
        .alias("missing_evidence"),
    )


def compare_records(df: DataFrame, keys: list[str], text: Column, vision: Column, text_present: Column,
                    vision_present: Column, tolerance: float = config.CLAIM_TOLERANCE) -> DataFrame:
    """Claims of both lanes compared, for rows that carry both extraction structs."""
    a = X.inline_rows(df, keys, C.extraction_claims(text, text_present), "field")
    b = X.inline_rows(df, keys, C.extraction_claims(vision, vision_present), "field")
    return C.compare_lanes(a, b, keys, tolerance)
