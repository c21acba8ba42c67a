"""Plug-in points: responders, parser runners, attempts and typed job requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import jsontools as J
from claimloom.functions import text as X
from claimloom.operators import keyed
from claimloom.schemas import CONTRACTS


def stored_responder(responses: DataFrame, key: str) -> Callable[[DataFrame], DataFrame]:
    """The default responder: answers come from a stored response table."""
    def respond(requests: DataFrame) -> DataFrame:
        return requests.join(responses, key, "left")

    return respond


PAGES = "doc_id bigint, page_no int, text string"


def run_parser(documents: DataFrame, runner: Callable[[int, bytes], list[str]], schema: str = PAGES) -> DataFrame:
    """Pages from a user-supplied parser, applied batch by batch: (doc_id, content) -> (doc_id, page_no, text)."""
    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, number, text)
                for doc, content in zip(batch["doc_id"], batch["content"])
                for number, text in enumerate(runner(doc, content), start=1)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text"])

    return documents.select("doc_id", "content").mapInPandas(pages, schema)


def first_valid_attempt(attempts: DataFrame, keys: list[str], kind: str | None = None, max_retries: int = 3) -> DataFrame:
    """Per request the first attempt whose response is valid, or ok = false with the last error.

    attempts: keys, attempt (1, 2, ...), response.  Only 1 + max_retries attempts count.
    """
    tried = attempts.filter(F.col("attempt") <= 1 + max(0, min(3, max_retries)))
    checked = J.salvage(tried, "response")
    if kind:
        checked = checked.withColumn(
            "error", F.coalesce("error", J.conformance_error(F.try_parse_json("payload"), CONTRACTS[kind])))
    good = F.col("error").isNull()
    return checked.groupBy(*keys).agg(
        F.bool_or(good).alias("ok"),
        F.min(F.when(good, F.col("attempt"))).alias("_good"),
        F.max("attempt").alias("_last"),
        F.min_by("payload", F.when(good, F.col("attempt"))).alias("value"),
        F.max_by("error", "attempt").alias("_error"),
    ).select(
        *keys, "ok", "value", (F.coalesce("_good", "_last") - 1).alias("retry_count"),
        F.when(~F.col("ok"), F.col("_error")).alias("error"),
    )


def job_refusal(task, has_pdf, has_text, has_extraction, has_text_lane, has_vision_lane, has_comparison, confirmed):
    """Why a job request must not be queued; null when it may.

    Publication text only travels when the transfer is confirmed.
    """
    have = {"pdf": has_pdf, "extraction": has_extraction, "text_lane": has_text_lane, "vision_lane": has_vision_lane,
            "comparison": has_comparison}
    refusal = F.when(~task.isin(*config.JOB_REQUIREMENTS), F.lit("unknown_task")).when(
        (has_text | has_pdf) & ~confirmed, F.lit("transfer_not_confirmed")
    )
    for kind, needs in config.JOB_REQUIREMENTS.items():
        for need in needs:
            refusal = refusal.when((task == kind) & ~have[need], F.lit(f"{need}_required"))
    return refusal


def dispatch(jobs: DataFrame, task: str) -> DataFrame:
    return jobs.filter((F.col("task") == task) & F.col("refusal").isNull())


def message_text(messages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Role messages of a request as one text: text blocks kept, images as [image].

    The result is one text per request, so a request's messages meet in one row; no number of them is too many.
    """
    gathered = messages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "content"))).alias("_m"))
    return gathered.select(*keys, F.array_join(F.transform("_m", lambda m: X.coalesce_blank(m["content"], "[image]")), "\n\n").alias("text"))
