"""Discovery and triage: keyword scores, tiers, acquisition routes, worklists and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import numbers as N
from claimloom.functions import text as X
from claimloom.operators import keyed


def coalesce_metadata(df: DataFrame) -> DataFrame:
    """Seven text fields without nulls; the PMC prefix is dropped."""
    fields = {c: X.coalesce_blank(F.col(c).cast("string")) for c in ("pmid", "title", "abstract", "journal", "year", "doi")}
    return df.withColumns({**fields, "pmcid": X.strip_pmc(F.col("pmcid").cast("string"))})


def heuristic_probability(score: Column, has_abstract: Column) -> Column:
    ladder = F.array(*[F.lit(p) for p in config.HEURISTIC_LADDER])
    return F.when(~has_abstract, F.lit(config.NO_ABSTRACT_PROBABILITY)).otherwise(
        F.get(ladder, F.least(score, F.lit(4)))
    )


def triage(articles: DataFrame, keywords: Sequence[str] = tuple(config.MODEL_KEYWORDS),
           scores: DataFrame | None = None, high: float = config.HIGH_THRESHOLD,
           mid: float = config.INTERMEDIATE_THRESHOLD) -> DataFrame:
    """Probability, tier and action per article (pmid, title, abstract).

    ``scores`` (pmid, relevant_probability, recoverable_probability) come from
    a model; articles without one fall back to the keyword ladder.  Rows with
    neither title nor abstract carry an error instead of a decision.
    """
    title, abstract = X.coalesce_blank("title"), X.coalesce_blank("abstract")
    score = X.keyword_score(F.concat_ws(" ", title, abstract), keywords)
    out = articles.withColumn("relevance_score", score)
    fallback = heuristic_probability(F.col("relevance_score"), abstract != "")
    if scores is not None:
        model = scores.select("pmid", F.col("relevant_probability").alias("_p"), F.col("recoverable_probability").alias("_r"))
        out = out.join(model, "pmid", "left")
        p_model = X.finite(F.col("_p"))
        probability = F.coalesce(N.clip01(p_model), fallback)
        recoverable = F.when(p_model.isNotNull(), N.probability(F.col("_r"))).otherwise(
            F.greatest(F.lit(0.03), fallback - 0.25)
        )
        method = F.when(p_model.isNotNull(), F.lit("model")).otherwise(F.lit("heuristic_fallback"))
    else:
        probability, recoverable = fallback, F.greatest(F.lit(0.03), fallback - 0.25)
        method = F.lit("heuristic_fallback")
    tier = N.triage_tier(F.col("relevant_probability"), high, mid)
    out = out.withColumns({"relevant_probability": probability, "recoverable_probability": recoverable, "method": method})
    out = out.withColumn("tier", tier)
    return out.withColumns({
        "action": F.when(F.col("tier").isin(*config.FIRST_PASS_TIERS), F.lit("first_pass")).otherwise(F.lit("defer_low")),
        "error": F.when((title == "") & (abstract == ""), F.lit("title_and_abstract_missing")),
    }).select(*[c for c in (*articles.columns, "relevance_score", "relevant_probability", "recoverable_probability",
                            "tier", "action", "method", "error")])


def lookup_key(name: str, spread_by: str) -> Column:
    """A join key for look-ups; blank keys, often a large share of the rows, match nothing and are spread out."""
    nothing = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(spread_by), F.lit(4096)).cast("string"))
    return F.when(X.present(name), F.col(name)).otherwise(nothing)


def classify(articles: DataFrame, unpaywall: DataFrame, europe_pmc: DataFrame, pmc_oa: DataFrame,
             first_pass: Sequence[str] = tuple(config.FIRST_PASS_TIERS)) -> DataFrame:
    """Acquisition route per article, from three look-up response tables.

    articles: pmid, doi, pmcid, abstract, tier.  unpaywall: doi, url_for_pdf,
    is_oa.  europe_pmc: pmid, pmcid, pdf_url, is_open_access.  pmc_oa: pmcid,
    pdf_url, is_oa.  URL priority: PMC, then Unpaywall (whatever its own flag
    says), then Europe PMC when open; 'oa_auto' needs any source to be open.
    """
    u = unpaywall.select(F.col("doi").alias("_doi"), F.col("url_for_pdf").alias("u_url"), F.col("is_oa").alias("u_oa"))
    e = europe_pmc.select("pmid", X.strip_pmc("pmcid").alias("e_pmcid"), F.col("pdf_url").alias("e_url"),
                          F.col("is_open_access").alias("e_oa"))
    # One answer per article: an open one before a closed one, then by value.
    u = keyed.one_per_key(u, ["_doi"], [F.desc("u_oa")])
    e = keyed.one_per_key(e, ["pmid"], [F.desc("e_oa")])
    p = pmc_oa.select(X.strip_pmc("pmcid").alias("_pmcid"), F.col("pdf_url").alias("p_url"), F.col("is_oa").alias("p_oa"))
    p = keyed.one_per_key(p, ["_pmcid"], [F.desc("p_oa")])
    own = X.strip_pmc("pmcid")
    known = articles.withColumn("_doi", lookup_key("doi", "pmid")).join(u, "_doi", "left").join(e, "pmid", "left").withColumn(
        "pmcid", F.when(own == "", X.coalesce_blank("e_pmcid")).otherwise(own)
    )
    joined = known.withColumn("_pmcid", lookup_key("pmcid", "pmid")).join(p, "_pmcid", "left")

    def yes(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    url = (
        F.when(yes("p_oa") & X.present("p_url"), F.col("p_url"))
        .when(X.present("u_url"), F.col("u_url"))
        .when(yes("e_oa") & X.present("e_url"), F.col("e_url"))
        .otherwise(F.lit(""))
    )
    is_oa = yes("p_oa") | yes("u_oa") | yes("e_oa")
    early = F.lower(X.coalesce_blank("tier", "low")).isin(*first_pass)
    has_doi = X.present("doi")
    auto = (F.col("_url") != "") & F.col("is_oa")
    route = F.when(auto, F.lit("oa_auto")).when(has_doi, F.lit("needs_institutional")).when(early, F.lit("stub")).otherwise(
        F.lit("skipped")
    )
    strategy = (
        F.when(auto & F.col("_url").rlike("ncbi.nlm.nih.gov/pmc"), F.lit("pmc_pdf"))
        .when(auto, F.lit("oa_pdf"))
        .when(has_doi, F.lit("doi_follow"))
        .when(early, F.lit("abstract_only"))
        .otherwise(F.lit(""))
    )
    suggested = (
        F.when(auto, F.col("_url"))
        .when(has_doi, F.concat(F.lit("https://doi.org/"), X.strip_doi_url("doi")))
        .when(early, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("pmid"), F.lit("/")))
        .otherwise(F.lit(""))
    )
    out = joined.withColumn("_url", url).withColumn("is_oa", is_oa)
    return out.withColumns({
        "acquisition_class": F.when(early, route).otherwise(F.lit("deferred_low")),
        "strategy": strategy,
        "suggested_url": suggested,
        "status": F.when(early, F.lit("pending")).otherwise(F.lit("deferred")),
        "has_abstract": X.present("abstract"),
    }).drop("_url", "_doi", "_pmcid", "u_url", "u_oa", "e_pmcid", "e_url", "e_oa", "p_url", "p_oa")


def discover(ids: DataFrame, metadata: DataFrame, decisions: DataFrame, inbox: DataFrame) -> DataFrame:
    """Manifest rows for searched ids: ids without metadata drop out, articles with a file are fetched.

    metadata: pmid + text fields; decisions: pmid, tier, probability; inbox: pmid, local_path.
    """
    rows = ids.select("pmid").distinct()
    rows = rows.join(keyed.one_per_key(metadata, ["pmid"]), "pmid")
    rows = rows.join(keyed.one_per_key(decisions, ["pmid"]), "pmid", "left").join(keyed.one_per_key(inbox, ["pmid"]), "pmid", "left")
    early = F.coalesce(F.col("tier"), F.lit("low")).isin(*config.FIRST_PASS_TIERS)
    return rows.withColumns({
        "tier": F.coalesce("tier", F.lit("low")),
        "local_path": X.coalesce_blank("local_path"),
        "status": F.when(X.present("local_path"), F.lit("fetched")).when(early, F.lit("pending")).otherwise(F.lit("deferred")),
    })


def low_backlog(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("tier") == "low")


def discovery_summary(manifest: DataFrame) -> DataFrame:
    """Thirteen counts in one pass."""
    tier = F.lower(F.col("triage_tier"))
    kind, status = F.col("acquisition_class"), F.col("status")
    return manifest.agg(
        F.count("*").alias("total"),
        *[F.count_if(kind == k).alias(k) for k in ("oa_auto", "needs_institutional", "stub", "deferred_low", "skipped")],
        *[F.count_if(tier == t).alias(t) for t in config.TRIAGE_TIERS],
        F.count_if(tier.isin(*config.FIRST_PASS_TIERS)).alias("first_pass"),
        *[F.count_if(status == s).alias(s) for s in ("fetched", "fetch_failed", "pending")],
    )


def check_tiers(tiers: Sequence[str]) -> list[str]:
    wanted = [t.lower() for t in tiers]
    unknown = [t for t in wanted if t not in config.TRIAGE_TIERS]
    if unknown:
        raise ValueError(f"unknown triage tier: {', '.join(unknown)}")
    return wanted


def select_batch(manifest: DataFrame, tiers: Sequence[str] | None = None, limit: int | None = None,
                 order: str = "pmid") -> DataFrame:
    """Work for the batch: the wanted tiers, nothing skipped; ``limit`` takes the first rows in ``order``."""
    out = manifest
    if tiers is not None:
        out = out.filter(F.lower("triage_tier").isin(*check_tiers(tiers)))
    out = out.filter(F.col("acquisition_class") != "skipped")
    return out.orderBy(order).limit(int(limit)) if limit is not None else out


def fetch_worklist(manifest: DataFrame, classes: Sequence[str], tiers: Sequence[str] = tuple(config.FIRST_PASS_TIERS)) -> DataFrame:
    return manifest.filter(
        F.col("acquisition_class").isin(*classes) & (F.col("status") != "fetched")
        & F.lower("triage_tier").isin(*check_tiers(tiers))
    )


def merge_fetch_outcomes(manifest: DataFrame, outcomes: DataFrame, order: str) -> DataFrame:
    """Write outcomes back to the first manifest row of each pmid; blank errors and urls leave the old value."""
    firsts = manifest.groupBy("pmid").agg(F.min(order).alias(order)).join(
        keyed.one_per_key(outcomes.select("pmid", "success", F.col("path").alias("_path"), F.col("error").alias("_error"),
                                          F.col("final_url").alias("_url")), ["pmid"], [F.desc("success")]), "pmid"
    )
    joined = manifest.join(firsts, ["pmid", order], "left")
    hit = F.col("success").isNotNull()
    return joined.withColumns({
        "status": F.when(hit & F.col("success"), F.lit("fetched")).when(hit, F.lit("fetch_failed")).otherwise(F.col("status")),
        "local_path": F.when(hit, X.coalesce_blank("_path")).otherwise(F.col("local_path")),
        "fetch_error": F.when(hit & X.present("_error"), F.col("_error")).otherwise(F.col("fetch_error")),
        "final_url": F.when(hit & X.present("_url"), F.col("_url")).otherwise(F.col("final_url")),
    }).select(*manifest.columns)


def fetch_summary(outcomes: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("success"), F.lit(False))
    return outcomes.agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"),
        F.count_if(F.coalesce(F.col("skipped"), F.lit(False))).alias("skipped"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def upsert_requests(attempts: DataFrame) -> DataFrame:
    """One manual-download request per pmid from its attempts (pmid, ts, url, reason)."""
    return attempts.groupBy("pmid").agg(
        F.min("ts").alias("requested_at"), F.max("ts").alias("last_attempt_at"), F.count("*").alias("attempts"),
        F.max_by("reason", "ts").alias("reason"), F.max_by("url", "ts").alias("source_url"),
    )


def split_indexed(manifest: DataFrame, indexed: DataFrame, entry_id: Column) -> DataFrame:
    """Every row with ``skipped`` set when its entry is already in the catalogue."""
    known = indexed.select(F.col("library_id").alias("entry_id")).distinct().withColumn("skipped", F.lit(True))
    return manifest.withColumn("entry_id", entry_id).join(known, "entry_id", "left").withColumn(
        "skipped", F.coalesce("skipped", F.lit(False))
    )


def reuse_decisions(work: DataFrame, decisions: DataFrame, pipeline: str, version: str = config.PROMPT_VERSION) -> DataFrame:
    """Each work row with ``reused``: an earlier decision on the same source, pipeline and version that is final.

    work: (pmid, source_sha256); decisions: (pmid, source_sha256, pipeline, pipeline_version, status, decided_at).
    """
    good = decisions.filter(
        (F.col("pipeline") == pipeline) & (F.col("pipeline_version") == version)
        & F.col("status").isin(*config.REUSABLE_DECISIONS)
    )
    last = keyed.newest(good, ["pmid", "source_sha256"], F.col("decided_at"), ["status"]).withColumnRenamed(
        "status", "decision_status"
    )
    return work.join(last, ["pmid", "source_sha256"], "left").withColumn("reused", F.col("decision_status").isNotNull())


def stub_record(articles: DataFrame, reason: str = "abstract_only",
                keywords: Sequence[str] = tuple(config.MODEL_KEYWORDS)) -> DataFrame:
    """A low-confidence record from metadata alone."""
    text = F.concat_ws(" ", X.coalesce_blank("title"), X.coalesce_blank("abstract"))
    score = X.keyword_score(text, keywords)
    return articles.select(
        "pmid", X.coalesce_blank("title").alias("title"),
        F.when(F.contains(F.lower(text), F.lit("nonmem")), F.lit("NONMEM")).alias("software"),
        F.least(F.lit(0.25), F.lit(0.05) * score).alias("confidence_overall"),
        F.lit(f"Metadata stub: {reason} - full model evidence and human review are required.").alias("notes"),
    )


def triage_target(relevant: Column, recoverable: Column, reason: Column) -> Column:
    return F.struct(
        F.when(relevant, F.lit(1.0)).otherwise(F.lit(0.0)).alias("relevant_probability"),
        F.when(recoverable, F.lit(1.0)).otherwise(F.lit(0.0)).alias("recoverable_probability"),
        F.when(relevant, X.literal_array(["other"])).otherwise(X.literal_array([])).alias("model_categories"),
        F.when(relevant, F.lit(config.POSITIVE_RATIONALE)).otherwise(
            F.concat(F.lit(config.EXCLUSION_RATIONALE), F.coalesce(reason, F.lit("not relevant")))
        ).alias("rationale"),
    )
