"""The reference corpus: appendix rows, identities, partitions, roll-ups, curation and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import numbers as N
from claimloom.functions import parsing as P
from claimloom.functions import text as X
from claimloom.operators import keyed
from claimloom.session import cut_lineage


def appendix_rows(table: DataFrame, low: int = 5, high: int = 9) -> DataFrame:
    """Rows of an appendix table (doc, row_no, cells) that carry a citation key; row 1 is the header."""
    rows = table.filter((F.col("row_no") > 1) & (F.size("cells") > 0))
    return rows.withColumn("key", X.citation_key(F.get("cells", F.lit(0)), low, high)).filter(
        F.col("key").isNotNull()
    ).select(*[c for c in table.columns], F.col("key.pmid").alias("pmid"), F.col("key.year").alias("year"),
             F.col("key.first_author").alias("first_author"), F.col("key.raw").alias("citation"))


def excluded_path(path: Column) -> Column:
    return path.rlike(r"(?i)[/\\](exclude|excluded)[/\\]")


def file_index(paths: DataFrame, path: str = "path", low: int = 5, high: int = 9) -> DataFrame:
    """(pmid, path) for every isolated digit run in the file name."""
    name = F.regexp_extract(F.col(path), r"[^/\\]*$", 0)
    return paths.select("*", F.explode(X.digit_runs(name, low, high)).alias("pmid"))


def preferred_file(index: DataFrame, order: str, path: str = "path") -> DataFrame:
    """One path per pmid: outside exclude folders first, then the shortest, then the earliest."""
    best = F.struct(excluded_path(F.col(path)).cast("int"), F.length(path), F.col(order))
    return index.groupBy("pmid").agg(F.min_by(path, best).alias("path"))


def study_join(models: DataFrame, studies: DataFrame, width: int = 6) -> DataFrame:
    """Each model row with the first study row of its document and pmid, else empty cells."""
    first = keyed.first_per_key(studies, ["doc", "pmid"], ["row_no"]).select(
        "doc", "pmid", F.col("row_no").alias("study_row"), F.col("cells").alias("study_cells")
    )
    blank = F.array(*[F.lit("") for _ in range(width)])
    return models.join(first, ["doc", "pmid"], "left").withColumn("study_cells", F.coalesce("study_cells", blank))


def model_index(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """Running count of a pmid within its document, in row order."""
    return keyed.ordinal(rows, ["doc", "pmid"], order, "model_index")


def screening_rows(models: DataFrame, files: DataFrame, low: int = 5, high: int = 9, seed: object = config.PARTITION_SEED,
                   validation: float = config.VALIDATION_FRACTION, test: float = config.TEST_FRACTION,
                   group_root: str = "Supplements") -> DataFrame:
    """Positives from models, negatives from files under exclude folders; the first of each screening id wins.

    models: (pmid, compound_group, partition, ordinal); files: (path, ordinal).
    """
    positive = models.select(
        F.concat(F.lit("screen_"), F.lower("compound_group"), F.lit("_"), F.col("pmid")).alias("screening_id"),
        "pmid", "compound_group", "partition", F.lit(True).alias("relevant_model"),
        F.lit(None).cast("string").alias("exclusion_reason"), F.lit("included_appendix_model").alias("label_quality"),
        F.lit(0).alias("_source"), "ordinal",
    )
    name = F.regexp_extract("path", r"[^/\\]*$", 0)
    parts = F.split("path", "/")
    at = F.array_position(parts, F.lit(group_root)).cast("int")
    group = F.when((at > 0) & (F.size(parts) > at), F.get(parts, at)).otherwise(F.lit("unknown"))
    code = F.regexp_extract(name, r"^([0-4])_", 1)
    reason = F.lit("explicitly_excluded_reason_unavailable")
    for digit, meaning in config.EXCLUSION_CODES.items():
        reason = F.when(code == digit, F.lit(meaning)).otherwise(reason)
    pmid = F.get(X.digit_runs(name, low, high), F.lit(0))
    excluded = files.filter(excluded_path(F.col("path"))).withColumn("pmid", pmid).filter(F.col("pmid").isNotNull())
    negative = excluded.withColumn("compound_group", group).withColumn("exclusion_reason", reason).select(
        F.concat(F.lit("screen_"), F.lower("compound_group"), F.lit("_"), F.col("pmid")).alias("screening_id"),
        "pmid", "compound_group", N.partition_of(F.col("pmid"), seed, validation, test).alias("partition"),
        F.lit(False).alias("relevant_model"), "exclusion_reason",
        F.when(F.col("exclusion_reason") == "explicitly_excluded_reason_unavailable", F.lit("explicit_exclusion"))
        .otherwise(F.lit("coded_exclusion")).alias("label_quality"),
        F.lit(1).alias("_source"), "ordinal",
    )
    return keyed.first_per_key(positive.unionByName(negative), ["screening_id"], ["_source", "ordinal"]).drop("_source")


def articles(models: DataFrame, screening: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per article: the first model's metadata, else the first screening row's, and distinct counts.

    Compounds and model ids stay in their own tables (``article_compounds``,
    ``article_models``) because one article may own very many.
    """
    both = models.select("pmid", *columns, "compound_group", F.col("reference_id"), F.lit(0).alias("_source"), "ordinal").unionByName(
        screening.select("pmid", *columns, "compound_group", F.lit(None).cast("string").alias("reference_id"),
                         F.lit(1).alias("_source"), "ordinal")
    )
    return both.groupBy("pmid").agg(
        F.concat(F.lit("pmid_"), F.first("pmid")).alias("article_id"),
        *[F.min_by(c, F.struct("_source", "ordinal")).alias(c) for c in columns],
        F.count_distinct("compound_group").alias("n_compounds"),
        F.count_distinct("reference_id").alias("n_models"),
    )


def article_compounds(models: DataFrame, screening: DataFrame) -> DataFrame:
    """(pmid, compound_group, first_seen): distinct compounds of an article, models before screening."""
    both = models.select("pmid", "compound_group", F.lit(0).alias("s"), "ordinal").unionByName(
        screening.select("pmid", "compound_group", F.lit(1).alias("s"), "ordinal")
    )
    return both.groupBy("pmid", "compound_group").agg(F.min(F.struct("s", "ordinal")).alias("first_seen"))


def partition_ids(models: DataFrame, article_rows: DataFrame, screening: DataFrame) -> DataFrame:
    """(partition, kind, id) rows; a partition's lists are written as a partitioned table, never as one array."""
    return (
        models.select("partition", F.lit("model").alias("kind"), F.col("reference_id").alias("id"))
        .unionByName(article_rows.select("partition", F.lit("article").alias("kind"), F.col("article_id").alias("id")).distinct())
        .unionByName(screening.select("partition", F.lit("screening").alias("kind"), F.col("screening_id").alias("id")))
    )


def corpus_counts(models: DataFrame) -> DataFrame:
    """(measure, level, n): totals per tier, partition and implementation status in one pass.

    models: tier, partition, implementation_status, has_cohorts, has_genes, n_targets.
    """
    flags = X.rows_array(
        ["measure", "level", "n"],
        ["models", "all", 1],
        ["tier", F.col("tier"), 1],
        ["partition", F.col("partition"), 1],
        ["implementation", F.coalesce("implementation_status", F.lit("unresolved")), 1],
        ["structured_populations", "all", F.col("has_cohorts").cast("int")],
        ["pharmacogenetic_populations", "all", F.col("has_genes").cast("int")],
        ["reproduction_targets", "all", F.col("n_targets").cast("int")],
    )
    return models.select(F.inline(flags)).groupBy("measure", "level").agg(F.sum("n").alias("n"))


def list_models(models: DataFrame, partitions: Sequence[str] | None = None, tiers: Sequence[str] | None = None) -> DataFrame:
    """The listing of the corpus; an empty or missing choice of partitions or tiers leaves all rows."""
    chosen = filter_models(models, partitions=partitions, tiers=tiers)
    return chosen.select("reference_id", "article_id", "pmid", F.col("compound_group").alias("compound"), "partition", "tier",
                         F.coalesce("training_eligible", F.lit(False)).alias("training_eligible"))


def filter_models(models: DataFrame, words: str = "", partitions: Sequence[str] | None = None, tiers: Sequence[str] | None = None,
                  compound: str | None = None, searched: Sequence[str] = ("reference_id", "title", "compound_group")) -> DataFrame:
    """Models that hold ``words`` in one of the searched columns, in any letter case, and match every choice that is made."""
    keep = F.lit(True)
    if words:
        keep &= F.contains(F.lower(F.concat_ws(" ", *searched)), F.lower(F.lit(words)))
    for column, choice in (("partition", partitions), ("tier", tiers), ("compound_group", [compound] if compound else None)):
        if choice:
            keep &= F.col(column).isin(*choice)
    return models.filter(keep)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def leaking_groups(df: DataFrame, group: str = "pmid") -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct("partition").alias("n_partitions")).filter(F.col("n_partitions") > 1)


def missing_fields(document: Column, required: Sequence[str] = tuple(config.MODEL_REQUIRED)) -> Column:
    """Required top-level keys a JSON text lacks."""
    return F.array_except(X.literal_array(required), F.coalesce(F.json_object_keys(document), X.literal_array([])))


def first_groups(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """All rows of the first ``limit`` distinct groups in first-seen order.

    The limit is the feature (run the first N articles); the kept ids are at most N.
    """
    ids = df.groupBy(group).agg(F.min(order).alias("_at")).orderBy("_at").limit(int(limit)).select(group)
    return df.join(ids, group, "left_semi")


def newest_version(versions: DataFrame, name: str, valid: str) -> DataFrame:
    """The highest version that is valid."""
    return versions.filter(F.col(valid)).agg(F.max_by(name, N.version_key(F.col(name))).alias(name))


# ---------------------------------------------------------------- curation


def check_corrections(corrections: DataFrame) -> DataFrame:
    needed = ["reference_id", "pointer", "source", "value_json"]
    missing = [c for c in needed if c not in corrections.columns]
    if missing:
        raise ValueError(f"corrections lack columns: {', '.join(missing)}")
    return corrections


def curation_errors(models: DataFrame, decisions: DataFrame, corrections: DataFrame) -> DataFrame:
    """(reference_id, error) for decisions and corrections that must not be applied."""
    known = models.select("reference_id", "partition")
    joined = decisions.join(known, "reference_id", "left")
    wanted = F.coalesce(F.col("training_eligible"), F.lit(False))
    problem = (
        F.when(F.col("partition").isNull(), F.lit("unknown_model"))
        .when(~F.upper(X.strip("tier")).isin(*config.QUALITY_TIERS), F.lit("invalid_tier"))
        .when((F.col("partition") == "test") & wanted, F.lit("test_model_not_trainable"))
    )
    bad = joined.select("reference_id", problem.alias("error")).filter(F.col("error").isNotNull())
    orphan = corrections.select("reference_id").distinct().join(decisions, "reference_id", "left_anti").select(
        "reference_id", F.lit("correction_without_decision").alias("error")
    )
    source = corrections.filter(~F.col("source").isin("prediction", "custom")).select(
        "reference_id", F.lit("invalid_correction_source").alias("error")
    ).distinct()
    return bad.unionByName(orphan).unionByName(source)


def apply_decisions(models: DataFrame, decisions: DataFrame, curator: str) -> DataFrame:
    """Successor models: decided ones get tier, status, eligibility and an audit note, the others stay.

    Of several decisions for one model the last by ``seq`` counts; without such a column one is chosen by its values.
    """
    order = [F.desc("seq")] if "seq" in decisions.columns else []
    d = keyed.one_per_key(decisions, ["reference_id"], order).select(
        "reference_id", F.upper(X.strip("tier")).alias("_tier"), F.col("training_eligible").alias("_train"),
        F.nullif(X.coalesce_blank("review_status"), F.lit("")).alias("_status"),
        X.squeeze("notes").alias("_notes"), F.lit(True).alias("_decided"),
    )
    joined = models.join(d, "reference_id", "left")
    hit = F.coalesce(F.col("_decided"), F.lit(False))
    status = F.coalesce("_status", F.lit("reviewed"))
    gold = F.col("_tier").isin("A", "B")
    wanted = F.coalesce(F.col("_train"), F.col("training_eligible"), F.lit(False))
    audit = F.concat_ws("; ", F.concat(F.lit("curator="), F.lit(curator)), F.concat(F.lit("from="), F.col("tier")),
                        F.concat(F.lit("to="), F.col("_tier")), F.concat(F.lit("notes="), F.col("_notes")))
    return joined.select(
        *[c for c in models.columns if c not in ("tier", "review_status", "strict_score_eligible", "training_eligible", "audit")],
        F.when(hit, F.col("_tier")).otherwise(F.col("tier")).alias("tier"),
        F.when(hit, status).otherwise(F.col("review_status")).alias("review_status"),
        F.when(hit, gold & (status == "reviewed")).otherwise(F.col("strict_score_eligible")).alias("strict_score_eligible"),
        F.when(hit, wanted & gold & (F.col("partition") != "test")).otherwise(F.col("training_eligible")).alias("training_eligible"),
        F.when(hit, audit).otherwise(F.lit("")).alias("audit"),
    )


def apply_corrections(models: DataFrame, corrections: DataFrame, document: str, batch: int = 500) -> DataFrame:
    """Set corrected values in the target document, in order.

    Corrections of a model are applied up to ``batch`` at a time, so no row
    carries more than that many; a model with more takes further rounds.  Only
    corrected models go through the rounds and through Python; the others are
    added untouched at the end.
    corrections: (reference_id, seq, pointer, value_json) with seq = 1, 2, ... per model.
    """
    from claimloom.functions import jsontools as J

    numbered = corrections.withColumn("_round", F.floor((F.col("seq") - 1) / batch))
    last = numbered.agg(F.max("_round").alias("n")).first()["n"]
    corrected = corrections.select("reference_id").distinct()
    out = models.join(corrected, "reference_id", "left_semi")
    for number in range(0, -1 if last is None else int(last) + 1):
        step = numbered.filter(F.col("_round") == number).groupBy("reference_id").agg(
            F.sort_array(F.collect_list(F.struct("seq", "pointer", "value_json"))).alias("_fixes")
        )
        pointers = F.transform("_fixes", lambda f: f["pointer"])
        values = F.transform("_fixes", lambda f: f["value_json"])
        hit = out.join(step, "reference_id").withColumn(
            document, J.pointer_set_all(F.col(document), pointers, values)
        ).select(*out.columns)
        out = out.join(step.select("reference_id"), "reference_id", "left_anti").select(*out.columns).unionByName(hit)
        if number:
            out = cut_lineage(out)
    return models.join(corrected, "reference_id", "left_anti").select(*models.columns).unionByName(out.select(*models.columns))


def recount(models: DataFrame) -> DataFrame:
    """Successor manifest counts: eligible models, models per tier, curated or mixed."""
    return models.agg(
        F.count("*").alias("models"),
        *[F.count_if(F.col("tier") == t).alias(f"tier_{t.lower()}") for t in config.QUALITY_TIERS],
        F.count_if("training_eligible").alias("training_eligible"),
        F.when(F.bool_and(F.col("tier").isin("A", "B")), F.lit("curated_reference"))
        .otherwise(F.lit("mixed_reference")).alias("status"),
    )


# ---------------------------------------------------------------- validation


def validate(models: DataFrame, article_rows: DataFrame, manifest_version: str, partitions_present: Sequence[str],
             hashes: DataFrame | None = None) -> DataFrame:
    """(severity, rule, subject) rows; a corpus is valid when none is an error.

    models: reference_id, article_id, pmid, partition, tier, training_eligible, document (JSON text).
    hashes: optional (path, expected_sha256, actual_sha256).  Row rules share one scan.
    """
    partition_ok = F.coalesce(F.col("partition").isin(*config.PARTITIONS), F.lit(False))
    tier_ok = F.coalesce(F.col("tier").isin(*config.QUALITY_TIERS), F.lit(False))
    row_rules = F.array_compact(F.array(
        F.when(F.size(missing_fields(F.col("document"))) > 0, F.lit("required_fields_missing")),
        F.when(~partition_ok, F.lit("invalid_partition")),
        F.when((F.col("partition") == "test") & F.coalesce("training_eligible", F.lit(False)), F.lit("test_is_trainable")),
        F.when(~tier_ok, F.lit("invalid_tier")),
    ))
    found = models.select(F.explode(row_rules).alias("rule"), F.col("reference_id").alias("subject"))
    orphans = models.join(article_rows.select("article_id").distinct(), "article_id", "left_anti").select(
        F.lit("article_missing").alias("rule"), F.col("reference_id").alias("subject"))
    doubles = duplicate_ids(models, "reference_id").select(F.lit("duplicate_id").alias("rule"), F.col("reference_id").alias("subject"))
    leaks = leaking_groups(models).select(F.lit("pmid_crosses_partitions").alias("rule"), F.col("pmid").alias("subject"))
    issues = found.unionByName(orphans).unionByName(doubles).unionByName(leaks)
    spark = models.sparkSession
    fixed = [("missing_partition_index", p) for p in config.PARTITIONS if p not in partitions_present]
    if manifest_version not in config.CORPUS_SCHEMA_SUPPORTED:
        fixed.append(("unsupported_schema", manifest_version or "missing"))
    if fixed:
        issues = issues.unionByName(spark.createDataFrame(fixed, "rule string, subject string"))
    out = issues.select(F.lit("error").alias("severity"), "rule", "subject")
    if hashes is not None:
        absent = hashes.filter(F.col("actual_sha256").isNull()).select(
            F.lit("warning").alias("severity"), F.lit("source_missing").alias("rule"), F.col("path").alias("subject"))
        wrong = hashes.filter(F.col("actual_sha256") != F.col("expected_sha256")).select(
            F.lit("error").alias("severity"), F.lit("hash_mismatch").alias("rule"), F.col("path").alias("subject"))
        out = out.unionByName(absent).unionByName(wrong)
    return out


def require_valid(issues: DataFrame) -> None:
    """Stop when there is any error; at most five are read back for the message."""
    bad = issues.filter(F.col("severity") == "error").limit(5).collect()
    if bad:
        raise ValueError("corpus is invalid: " + "; ".join(f"{r['rule']} {r['subject']}" for r in bad))


# ---------------------------------------------------------------- build


def model_records(rows: DataFrame, metadata: DataFrame, files: DataFrame, prefix: str,
                  seed: object = config.PARTITION_SEED, validation: float = config.VALIDATION_FRACTION,
                  test: float = config.TEST_FRACTION) -> DataFrame:
    """Appendix model rows joined with studies (``study_join`` and ``model_index`` output) as corpus records.

    metadata: (pmid, title, abstract); files: (pmid, path, sha256), one per pmid.
    """
    cell = lambda name, i: X.coalesce_blank(F.get(F.col(name), F.lit(i)))
    joined = rows.join(metadata, "pmid", "left").join(
        files.select("pmid", F.col("path").alias("pdf_path"), F.col("sha256").alias("pdf_sha256")), "pmid", "left"
    )
    texts = joined.withColumns({
        "title": X.coalesce_blank("title"),
        "dose": X.squeeze(cell("cells", 1)),
        "structure": X.squeeze(cell("cells", 2)),
        "equations": X.squeeze(cell("cells", 3)),
        "parameter_values": X.squeeze(cell("cells", 4)),
        "population": X.squeeze(cell("study_cells", 1)),
        "model_type": X.squeeze(cell("study_cells", 2)),
        "covariate_text": X.squeeze(cell("study_cells", 4)),
        "pdf_path": X.coalesce_blank("pdf_path"),
    })
    bare = (F.col("equations") == "") & (F.col("parameter_values") == "")
    return texts.withColumns({
        "compound_group": F.col("doc"),
        "reference_id": X.record_id(prefix, "doc", "pmid", F.col("model_index")),
        "article_id": F.concat(F.lit("pmid_"), F.col("pmid")),
        "partition": N.partition_of(F.col("pmid"), seed, validation, test),
        "tier": F.when(bare, F.lit("D")).otherwise(F.lit("C")),
        "route": P.route("dose"),
        "n_subjects": P.subject_count("population"),
        "compartments": P.compartments("structure"),
        "parameters": P.parameters("parameter_values", "equations"),
        "covariates": P.covariate_lists("covariate_text"),
        "issues": F.array_compact(F.array(
            F.when(F.col("title") == "", F.lit("publication_title_missing")),
            F.when(F.col("equations") == "", F.lit("model_equations_missing")),
            F.when(F.col("parameter_values") == "", F.lit("parameter_values_missing")),
            F.when(F.col("pdf_path") == "", F.lit("source_pdf_missing")),
        )),
        "review_status": F.lit("unreviewed"),
        "strict_score_eligible": F.lit(False),
        "training_eligible": F.lit(False),
    })
