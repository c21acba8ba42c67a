"""Versioned catalogue and qualification records as append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import numbers as N
from claimloom.functions import text as X
from claimloom.operators import keyed


def index_rows(manifests: DataFrame, folder: str = "folder") -> DataFrame:
    """library_id, title, status, updated_at of readable entries; hidden staging folders never show."""
    return manifests.filter(~F.startswith(F.col(folder), F.lit("."))).select(
        F.coalesce("library_id", folder).alias("library_id"),
        X.coalesce_blank("title").alias("title"),
        X.coalesce_blank("status", "draft").alias("status"),
        F.coalesce("updated_at", "created_at", F.lit("")).alias("updated_at"),
    )


def list_entries(manifests: DataFrame, qualifications: DataFrame, now: Column, status: str | None = None) -> DataFrame:
    """17 columns per entry from nested manifests; an unreadable manifest gives a row with a blocker.

    ``manifests`` has the nested catalogue schema plus ``_corrupt_record`` and ``folder``;
    ``qualifications`` is the exploded clinical-use table (library_id, qualification_id, ...).
    """
    bad = F.col("_corrupt_record").isNotNull()
    current = current_records(version_bound(qualifications, manifests.filter(~bad).select("library_id", "version")))
    clinical = clinical_status(current, now)
    gate = F.col("qualification.gate")
    flat = manifests.select(
        F.coalesce("library_id", "folder").alias("library_id"),
        X.coalesce_blank("title").alias("title"),
        X.coalesce_blank("status").alias("status"),
        X.coalesce_blank("study.compound").alias("compound"),
        X.coalesce_blank("study.population").alias("population"),
        F.col("model.advan").alias("advan"),
        F.col("model.trans").alias("trans"),
        X.coalesce_blank("model.type").alias("model_type"),
        X.coalesce_blank("version").alias("version"),
        F.col("confidence.overall").alias("confidence_overall"),
        X.coalesce_blank("qualification.automated_assessment.verdict").alias("assessment"),
        F.when(bad, F.lit("")).otherwise(X.coalesce_blank("qualification.reproduction.status", "not_planned"))
        .alias("reproduction"),
        F.coalesce(gate["ready"], F.lit(False)).alias("qualified"),
        F.when(bad, F.lit("manifest_unreadable"))
        .when(gate.isNull(), F.lit("qualification_not_run"))
        .otherwise(F.array_join(F.coalesce(gate["blockers"], X.literal_array([])), "; "))
        .alias("qualification_blockers"),
        X.coalesce_blank("updated_at").alias("updated_at"),
    )
    if status:
        flat = flat.filter(F.col("status") == status)
    return flat.join(clinical, "library_id", "left").withColumns({
        "clinical_status": X.coalesce_blank("clinical_status"),
        "clinically_qualified": F.coalesce("clinically_qualified", F.lit(False)),
    })


def search(entries: DataFrame, query: str = "", compound: str | None = None, population: str | None = None,
           status: str | None = None, min_confidence: float | None = None, advan: Sequence[int] | None = None,
           model_type: str | None = None, assessment: str | None = None) -> DataFrame:
    """All filters are ANDed; the words of the query are ORed, and the whole phrase counts too."""
    out = entries
    if status:
        out = out.filter(F.col("status") == status)
    if compound:
        out = out.filter(F.col("compound").rlike("(?i)" + compound))
    if population:
        out = out.filter(F.col("population").rlike("(?i)" + population))
    if min_confidence is not None:
        out = out.filter(F.col("confidence_overall") >= min_confidence)
    if advan is not None:
        out = out.filter(F.col("advan").isin(*[int(a) for a in advan]))
    if model_type:
        out = out.filter(F.lower("model_type") == model_type.lower())
    if assessment:
        out = out.filter(F.lower("assessment") == assessment.lower())
    if query:
        phrase = query.lower()
        words = [w for w in phrase.split() if w]
        haystack = F.lower(F.concat_ws(" ", "title", "compound", "population", F.array_join("keywords", " "), "abstract"))
        found = F.contains(haystack, F.lit(phrase))
        for word in words:
            found = found | F.contains(haystack, F.lit(word))
        out = out.filter(found)
    return out


def version_bound(records: DataFrame, versions: DataFrame) -> DataFrame:
    """Qualification records bound to no version or to the entry's active one."""
    active = versions.select("library_id", F.col("version").alias("_active"))
    joined = records.join(active, "library_id")
    bound = X.coalesce_blank("model_version")
    return joined.filter((bound == "") | (bound == F.col("_active"))).drop("_active")


def current_records(records: DataFrame) -> DataFrame:
    """Records that no other record of the entry supersedes."""
    replaced = records.filter(X.present("supersedes")).select(
        "library_id", X.strip("supersedes").alias("qualification_id")
    ).distinct()
    return records.join(replaced, ["library_id", "qualification_id"], "left_anti")


def clinical_status(records: DataFrame, now: Column) -> DataFrame:
    """Distinct statuses joined, and whether a qualified record is within its review date.

    The status set is at most the six known statuses, so collecting it is safe.
    """
    return records.groupBy("library_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.nullif(F.col("status"), F.lit("")))), "; ").alias("clinical_status"),
        F.bool_or((F.col("status") == "qualified") & ~N.review_overdue(F.col("review_due"), now))
        .alias("clinically_qualified"),
    )


def merge_history(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Current records plus prior ones whose id is blank or not among the current ones."""
    blank = prior.filter(~X.present("qualification_id"))
    old = prior.filter(X.present("qualification_id")).join(
        current.select("library_id", "qualification_id").distinct(), ["library_id", "qualification_id"], "left_anti"
    )
    return current.unionByName(old).unionByName(blank)


def merge_packaged(packaged: DataFrame, active: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Outcome per entry: insert, upgrade (the active version is archived), keep.  Never a downgrade."""
    p = packaged.select("library_id", F.col("version").alias("p_version"), *[F.col(c).alias(f"p_{c}") for c in payload])
    a = active.select("library_id", F.col("version").alias("a_version"), *[F.col(c).alias(f"a_{c}") for c in payload])
    both = p.join(a, "library_id", "full_outer")
    action = (
        F.when(F.col("a_version").isNull(), F.lit("insert"))
        .when(N.version_newer(F.col("p_version"), F.col("a_version")), F.lit("upgrade"))
        .otherwise(F.lit("keep"))
    )
    take = action.isin("insert", "upgrade")
    return both.select(
        "library_id",
        action.alias("action"),
        F.when(take, F.col("p_version")).otherwise(F.col("a_version")).alias("version"),
        F.when(action == "upgrade", F.col("a_version")).alias("archived_version"),
        *[F.when(take, F.col(f"p_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in payload],
    )


def active_versions(history: DataFrame, payload: Sequence[str]) -> DataFrame:
    """The newest version per entry from an append-only table."""
    return keyed.newest(history, ["library_id"], N.version_key(F.col("version")), ["version", *payload])


def publish(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next versions for automated publications, with the reason when one is refused.

    existing: active (library_id, version, status); incoming: (library_id, status, ...).
    """
    old = existing.select("library_id", F.col("version").alias("old_version"), F.col("status").alias("old_status"))
    joined = incoming.join(old, "library_id", "left")
    refusal = (
        F.when(F.col("status").isin(*config.QUARANTINED_STATUSES), F.lit("status_needs_human_review"))
        .when(~F.col("status").isin(*config.STATUS_LEVELS), F.lit("unknown_status"))
        .when(F.col("old_status") == "validated", F.lit("validated_entry_protected"))
        .when(~X.valid_id("library_id"), F.lit("invalid_id"))
    )
    version = F.when(F.col("old_version").isNull(), F.lit("1.0.0")).otherwise(N.next_patch(F.col("old_version")))
    return joined.withColumn("refusal", refusal).withColumn(
        "version", F.when(F.col("refusal").isNull(), version)
    )


def provenance(entries: DataFrame, artefacts: dict[str, DataFrame], key: str = "library_id") -> DataFrame:
    """Entries with what was kept beside them: a struct column for each artefact, null where an entry has none.

    An artefact's rows are (key, fields...); of several rows of an entry the first
    by its fields counts, rows with a null key belong to no entry, and an artefact
    of an unknown entry is left out.
    """
    out = entries
    for name, rows in artefacts.items():
        fields = F.struct(*[c for c in rows.columns if c != key]).alias(name)
        out = out.join(keyed.one_per_key(rows, [key]).select(key, fields), key, "left")
    return out


def manifest_errors(required: dict[str, Column], library_id: Column, status: Column, confidence: Column,
                    artifact: Column | None = None) -> Column:
    """ARRAY of rule names a manifest breaks."""
    missing = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(k)) for k, v in required.items()]))
    score = X.finite(confidence)
    tests = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing_fields: "), F.array_join(missing, ", "))),
        F.when(~X.valid_id(library_id), F.lit("invalid_id")),
        F.when(~F.coalesce(status.isin(*config.STATUS_LEVELS), F.lit(False)), F.lit("unknown_status")),
        F.when((score < 0) | (score > 1), F.lit("confidence_out_of_range")),
    ]
    if artifact is not None:
        tests.append(F.when(~F.coalesce(artifact, F.lit(False)), F.lit("artifact_missing")))
    return F.array_compact(F.array(*tests))


def qualification_blockers(valid: Column, confidence: Column, mapping_review: Column, control_error: Column,
                           has_evidence: Column, compiled: Column, covariates_needed: Column, simulated: Column,
                           finite_predictions: Column, min_confidence: float = 0.8) -> Column:
    """Blockers in check order; results of the external compile and simulation steps come in as columns."""
    ok = F.coalesce(compiled, F.lit(False))
    score = X.finite(confidence)
    return F.array_compact(F.array(
        F.when(~F.coalesce(valid, F.lit(False)), F.lit("catalogue_schema_invalid")),
        F.when(F.coalesce(score < min_confidence, F.lit(True)), F.lit("confidence_below_threshold")),
        F.when(F.coalesce(mapping_review, F.lit(False)), F.lit("mapping_review_required")),
        F.when(X.present(control_error), F.lit("control_stream_validation_failed")),
        F.when(~F.coalesce(has_evidence, F.lit(False)), F.lit("evidence_missing")),
        F.when(~ok, F.lit("control_stream_compile_failed")),
        F.when(ok & (covariates_needed > 0), F.lit("qualification_covariates_unavailable")),
        F.when(ok & (covariates_needed == 0) & ~F.coalesce(simulated, F.lit(False)),
               F.lit("simulation_smoke_test_failed")),
        F.when(ok & (covariates_needed == 0) & simulated & ~F.coalesce(finite_predictions, F.lit(False)),
               F.lit("non_finite_predictions")),
    ))


def review_outcome(decisions: DataFrame, gates: DataFrame) -> DataFrame:
    """Each review decision with the reason it is refused, if any.

    decisions: (library_id, decided_at, status, reviewer, confirm_generated);
    gates: (library_id, generated_suggestion, gate_ready, manifest_valid).
    """
    validated = F.col("status") == "validated"
    refusal = (
        F.when(~X.present("reviewer"), F.lit("reviewer_required"))
        .when(~F.col("status").isin("review", "validated", "deprecated"), F.lit("unknown_status"))
        .when(validated & F.coalesce("generated_suggestion", F.lit(False)) & ~F.col("confirm_generated"),
              F.lit("generated_suggestions_unconfirmed"))
        .when(validated & ~F.coalesce("gate_ready", F.lit(False)), F.lit("not_qualified"))
        .when(~F.coalesce("manifest_valid", F.lit(False)), F.lit("manifest_invalid"))
    )
    return decisions.join(gates, "library_id", "left").withColumn("refusal", refusal)


def fold_reviews(outcomes: DataFrame) -> DataFrame:
    """Status of each entry after its accepted decisions."""
    good = outcomes.filter(F.col("refusal").isNull())
    return good.groupBy("library_id").agg(
        F.max_by("status", "decided_at").alias("status"),
        F.max_by("reviewer", "decided_at").alias("reviewer"),
        F.max("decided_at").alias("updated_at"),
        F.count("*").alias("decisions"),
    )


def qualification_refusal(records: DataFrame, entries: DataFrame, known: DataFrame) -> DataFrame:
    """New clinical-use records with the reason one is refused.

    records: (library_id, qualification_id, status, drugs, endpoints, issuer, reviewer, supersedes);
    entries: (library_id, entry_status); known: existing (library_id, qualification_id).
    """
    ids = known.select("library_id", "qualification_id").distinct()
    joined = (
        records.join(entries, "library_id", "left")
        .join(ids.withColumn("_known", F.lit(True)), ["library_id", "qualification_id"], "left")
        .join(ids.select("library_id", F.col("qualification_id").alias("supersedes"), F.lit(True).alias("_target")),
              ["library_id", "supersedes"], "left")
    )
    qualified = F.col("status") == "qualified"
    refusal = (
        F.when(~F.col("status").isin(*config.CLINICAL_STATUSES), F.lit("unknown_status"))
        .when(~X.valid_id("qualification_id"), F.lit("invalid_id"))
        .when(qualified & (F.size("drugs") == 0), F.lit("drug_missing"))
        .when(qualified & (F.size("endpoints") == 0), F.lit("endpoint_missing"))
        .when(qualified & (~X.present("issuer") | ~X.present("reviewer")), F.lit("issuer_and_reviewer_required"))
        .when(qualified & (F.lower(X.coalesce_blank("entry_status")) != "validated"), F.lit("entry_not_validated"))
        .when(F.col("_known"), F.lit("id_exists"))
        .when(X.present("supersedes") & F.col("_target").isNull(), F.lit("supersedes_unknown"))
    )
    return joined.withColumn("refusal", refusal).drop("_known", "_target")


def probe_events(models: DataFrame, dose_compartment: str, observation_compartment: str) -> DataFrame:
    """Seven standard rows per model: one dose and six observations."""
    times = [(0.0, 1, 100.0, 1)] + [(t, 0, 0.0, 0) for t in (0.5, 1.0, 2.0, 4.0, 8.0, 24.0)]
    rows = F.array(*[
        F.struct(F.lit(t).alias("time"), F.lit(e).alias("evid"), F.lit(a).alias("amt"), F.lit(m).alias("mdv"))
        for t, e, a, m in times
    ])
    dose = F.coalesce(F.col(dose_compartment), F.lit(1))
    seen = F.coalesce(F.col(observation_compartment), dose)
    return models.select("*", F.inline(rows)).withColumn("cmt", F.when(F.col("evid") == 1, dose).otherwise(seen))
