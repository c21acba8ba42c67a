"""Whole jobs: corpus build, benchmark, run plan, training export, batch processing, publication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as X
from claimloom.operators import catalogue, corpus, scoring, training, triage
from claimloom.plans import lanes
from claimloom.sources import writers

Responder = Callable[[DataFrame], DataFrame]


# ---------------------------------------------------------------- corpus


def build_corpus(models: DataFrame, studies: DataFrame, metadata: DataFrame, files: DataFrame, prefix: str,
                 seed: object = config.PARTITION_SEED, validation: float = config.VALIDATION_FRACTION,
                 test: float = config.TEST_FRACTION, low: int = 5, high: int = 9) -> dict[str, DataFrame]:
    """Model, article and screening tables from appendix tables.

    models/studies: (doc, row_no, cells); metadata: (pmid, title, abstract);
    files: (path, sha256, ordinal).
    """
    model_rows = corpus.model_index(corpus.appendix_rows(models, low, high))
    study_rows = corpus.appendix_rows(studies, low, high)
    index = corpus.file_index(files, "path", low, high)
    best = corpus.preferred_file(index, "ordinal").join(files.select("path", "sha256"), "path")
    records = corpus.model_records(corpus.study_join(model_rows, study_rows), metadata, best, prefix, seed, validation, test)
    ordered = records.withColumn("ordinal", F.col("row_no"))
    screening = corpus.screening_rows(ordered, files, low, high, seed, validation, test)
    enriched = screening.join(metadata.select("pmid", "title"), "pmid", "left").withColumn("title", X.coalesce_blank("title"))
    article_rows = corpus.articles(ordered, enriched, ["title", "partition"])
    return {"models": records, "articles": article_rows, "screening": screening}


def write_corpus(tables: dict[str, DataFrame], path: str) -> str:
    """One new snapshot folder, partitioned by data split; an existing version is never overwritten."""
    for name, df in tables.items():
        writers.table(df, f"{path}/{name}", ["partition"] if "partition" in df.columns else [])
    return path


# ---------------------------------------------------------------- benchmark


def benchmark(records: DataFrame, truth: dict[str, DataFrame], proposed: dict[str, DataFrame], available: DataFrame,
              keys: Sequence[str]) -> dict[str, DataFrame]:
    """Per-record scores, tier summary and gate.

    ``truth`` and ``proposed`` hold the long tables 'scalar', 'numeric' and 'semantic'.
    """
    keys = list(keys)
    scores = scoring.record_scores(
        records, available,
        scoring.scalar_field_score(truth["scalar"], proposed["scalar"], keys),
        scoring.numeric_score(truth["numeric"], proposed["numeric"], keys),
        scoring.semantic_score(truth["semantic"], proposed["semantic"], keys), keys,
    )
    summary = scoring.tier_summary(scores)
    return {"per_record": scores, "summary": summary, "gate": scoring.release_gate(summary)}


# ---------------------------------------------------------------- target-blind runs

SOURCE_COLUMNS = ("record_id", "article_id", "pmid", "source_sha256", "pdf_path")


def plan_run(records: DataFrame, envelopes: DataFrame, articles: DataFrame, task: str, mode: str, endpoint: str,
             limit: int | None = None, order: str = "ordinal") -> DataFrame:
    """Work items for the records whose articles cannot be reused; target columns never leave ``records``."""
    sources = records.select(*SOURCE_COLUMNS, order)
    if limit is not None:
        sources = corpus.first_groups(sources, "article_id", order, limit)
    reuse = scoring.reusable_articles(envelopes, sources, task, mode, endpoint)
    return sources.join(reuse.select("article_id", "reusable"), "article_id").join(
        articles.select("article_id", "title", "abstract"), "article_id", "left"
    ).select(
        *SOURCE_COLUMNS, "title", "abstract", F.lit(task).alias("task"), F.lit(mode).alias("mode"),
        F.lit(endpoint).alias("endpoint"), F.lit(True).alias("target_absent_from_prompt"), "reusable",
    )


def run(plan: DataFrame, responder: Responder) -> DataFrame:
    """Envelopes for the open work items; the responder maps a table to (record_id, prediction, error).

    Answers that have the work items' columns too must hold every item, and are taken as they
    are; others are joined to the items, for which the plan runs a second time.
    """
    work = plan.filter(~F.col("reusable"))
    answers = responder(work)
    if set(work.columns) <= set(answers.columns):
        answered = answers.select(*work.columns, "prediction", "error")
    else:
        answered = work.join(answers.select("record_id", "prediction", "error"), "record_id", "left")
    return answered.withColumn(
        "status", F.when(F.col("error").isNull() & F.col("prediction").isNotNull(), F.lit("complete")).otherwise(F.lit("error"))
    )


def run_counts(plan: DataFrame, envelopes: DataFrame) -> DataFrame:
    reused = plan.agg(F.count_if("reusable").alias("reused"))
    made = envelopes.agg(
        F.count_if(F.col("status") == "complete").alias("completed"), F.count_if(F.col("status") == "error").alias("failed"),
        F.count("*").alias("executed"),
    )
    stacked = made.unionByName(reused, allowMissingColumns=True)  # two one-row tables as one row
    total = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return total.withColumn("completed", F.col("completed") + F.col("reused"))


# ---------------------------------------------------------------- training export


def triage_export(screening: DataFrame, articles: DataFrame, partitions: Sequence[str], system: str) -> DataFrame:
    """Candidates with their reason and, when clean, the example row.

    screening: (screening_id, pmid, partition, relevant, recoverable, exclusion_reason, label_quality);
    articles: (pmid, title, abstract).
    """
    training.check_request(partitions, [])
    rows = screening.filter(F.col("partition").isin(*partitions)).join(
        articles.select("pmid", "title", "abstract"), "pmid", "left"
    )
    reason = training.triage_reason(F.col("relevant"), F.col("exclusion_reason"), F.col("abstract"))
    answer = F.to_json(triage.triage_target(F.col("relevant"), F.col("recoverable"), F.col("exclusion_reason")))
    example = training.example_row(
        F.col("screening_id"), "triage", F.col("partition"), F.col("label_quality"), F.lit(system),
        training.triage_prompt(F.col("pmid"), F.col("title"), F.col("abstract")), answer,
    )
    return rows.withColumn("reason", reason).select(
        F.col("screening_id").alias("reference_id"), F.lit("triage").alias("task"), "partition",
        F.col("label_quality").alias("tier"), "reason", F.when(F.col("reason") == "", example).alias("example"),
    )


def extraction_export(models: DataFrame, texts: DataFrame, partitions: Sequence[str], tiers: Sequence[str], system: str,
                      allow_silver: bool = False, require_eligible: bool = True, max_source_chars: int | None = 60_000) -> DataFrame:
    """Candidates for reviewed models; the target is the answer and never part of the prompt.

    ``max_source_chars`` is the budget of the article text; None keeps the whole of it.

    models: (reference_id, pmid, title, abstract, partition, tier, training_eligible, pdf_path, target_json);
    texts: (pdf_path, pages ARRAY<STRING>).
    """
    from claimloom.operators import chunks

    training.check_request(partitions, tiers, allow_silver)
    rows = models.filter(F.col("partition").isin(*partitions)).join(texts, "pdf_path", "left")
    text = F.when(F.col("pages").isNotNull(), chunks.budgeted_text(F.col("pages"), max_source_chars))
    rows = rows.withColumn("_text", text)
    reason = training.extraction_reason(F.col("tier"), F.col("training_eligible"), F.col("pdf_path"), F.col("_text"),
                                        tiers, require_eligible)
    blank = F.lit("")
    example = training.example_row(
        F.col("reference_id"), "extraction", F.col("partition"), F.col("tier"), F.lit(system),
        training.extraction_prompt(F.col("pmid"), F.col("title"), blank, F.col("abstract"), F.col("_text"), blank),
        F.col("target_json"),
    )
    return rows.withColumn("reason", reason).select(
        "reference_id", F.lit("extraction").alias("task"), "partition", "tier", "reason",
        F.when(F.col("reason") == "", example).alias("example"),
    )


def write_examples(candidates: DataFrame, path: str) -> str:
    """Clean examples as JSON lines under task=/partition= folders."""
    clean = candidates.filter(F.col("example").isNotNull()).select("task", "partition", "example")
    line = F.to_json("example").alias("value")
    clean.select("task", "partition", line).write.mode("errorifexists").partitionBy("task", "partition").text(path)
    return path


# ---------------------------------------------------------------- batch and publication


def process_batch(work: DataFrame, decisions: DataFrame, results: DataFrame, pipeline: str) -> DataFrame:
    """One outcome row per selected article; failures are rows, not exceptions.

    work: (pmid, source_sha256, has_pdf); results: (pmid, status, model_present, error).
    """
    checked = triage.reuse_decisions(work, decisions, pipeline).join(results, "pmid", "left")
    final = lanes.article_status(F.col("status"), F.col("model_present"))
    status = (
        F.when(~F.col("has_pdf"), F.lit("awaiting_pdf"))
        .when(F.col("reused"), F.col("decision_status"))
        .when(X.present("error") | F.col("status").isNull(), F.lit("failed"))
        .otherwise(final)
    )
    fresh = F.col("has_pdf") & ~F.col("reused") & ~X.present("error")
    return checked.withColumns({
        "status": status,
        "reused": F.col("reused") & F.col("has_pdf"),
        "publish_status": F.when(fresh, lanes.publication_status(F.col("status"), F.col("model_present"))),
    }).select("pmid", "status", "reused", "publish_status")


def publish_entries(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """New rows of the append-only version table; refused publications keep their reason and write nothing."""
    planned = catalogue.publish(existing, incoming)
    return planned.withColumn("updated_at", now)
