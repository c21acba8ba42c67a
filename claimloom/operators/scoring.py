"""Benchmark tables: record scores, tier summaries, triage metrics, release gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as X
from claimloom.functions.numbers import clip01, numeric_close
from claimloom.operators import claims as C
from claimloom.operators import ranking

METRICS = ["scalar_coverage", "scalar_score", "numeric_coverage", "numeric_accuracy", "semantic_coverage",
           "semantic_accuracy"]
EXTRAS = ["unverified_numeric_extras", "unverified_semantic_extras"]


def prediction_index(files: DataFrame, variant: str = "prediction") -> DataFrame:
    """(id, payload) from envelope rows (id, path, json): the first path of an id wins.

    The primary payload is the prediction key when present, even when null,
    else the extraction, the triage answer, or the whole document.
    """
    from claimloom.functions import jsontools as J
    from claimloom.operators import keyed

    # the text travels, not the parsed value: only one document per id is parsed after the choice
    readable = files.filter(J.strict_parse(F.col("json")).isNotNull())
    first = keyed.first_per_key(readable, ["id"], ["path"]).withColumn("_v", J.strict_parse(F.col("json")))
    members = J.as_object(F.col("_v"))
    if variant == "prediction":
        node = (
            F.when(F.map_contains_key(members, F.lit("prediction")), F.try_element_at(members, F.lit("prediction")))
            .otherwise(F.coalesce(F.try_element_at(members, F.lit("extraction")),
                                  F.try_element_at(members, F.lit("triage")), F.col("_v")))
        )
    else:
        node = F.try_element_at(J.as_object(F.try_element_at(members, F.lit("variants"))), F.lit(variant))
    return first.select("id", "path", F.nullif(F.to_json(node), F.lit("null")).alias("payload"))


def numeric_score(truth: DataFrame, proposed: DataFrame, keys: Sequence[str],
                  relative: float = config.RELATIVE_TOLERANCE, absolute: float = config.ABSOLUTE_TOLERANCE) -> DataFrame:
    """Parameters aligned on (type, key): inputs are (keys, type, item_key, value)."""
    t = truth.withColumnRenamed("value", "value_t")
    p = proposed.withColumnRenamed("value", "value_p")
    close = numeric_close(F.col("value_t"), F.col("value_p"), relative, absolute)
    return C.with_rates(C.pair_scores(t, p, keys, ["type", "item_key"], close))


def semantic_score(truth: DataFrame, proposed: DataFrame, keys: Sequence[str],
                   relative: float = config.RELATIVE_TOLERANCE, absolute: float = config.ABSOLUTE_TOLERANCE) -> DataFrame:
    """Semantic claims aligned on the path: inputs are (keys, path, text, number)."""
    t = truth.select(*keys, "path", F.col("text").alias("text_t"), F.col("number").alias("number_t"))
    p = proposed.select(*keys, "path", F.col("text").alias("text_p"), F.col("number").alias("number_p"))
    correct = F.when(
        F.col("number_t").isNotNull(), numeric_close(F.col("number_t"), F.col("number_p"), relative, absolute)
    ).otherwise(X.normalise("text_t") == X.normalise("text_p"))
    return C.with_rates(
        C.pair_scores(t, p, keys, ["path"], correct, C.has_value(F.col("text_p"), F.col("number_p")))
    )


def scalar_field_score(truth: DataFrame, proposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scalar fields (keys, path, text, number): expected, covered, score sum, coverage, mean score."""
    t = truth.filter(C.has_value(F.col("text"), F.col("number"))).select(
        *keys, "path", F.col("text").alias("text_t"), F.col("number").alias("number_t"))
    p = proposed.filter(C.has_value(F.col("text"), F.col("number"))).select(
        *keys, "path", F.col("text").alias("text_p"), F.col("number").alias("number_p"), F.lit(True).alias("found"))
    joined = t.join(p, [*keys, "path"], "left")
    score = F.when(F.col("found"), C.scalar_score(
        F.col("path"), F.col("text_t"), F.col("number_t"), F.col("text_p"), F.col("number_p")))
    return joined.groupBy(*keys).agg(
        F.count("*").alias("scalar_expected"),
        F.count("found").alias("scalar_covered"),
        (F.count("found") / F.count("*")).alias("scalar_coverage"),
        (F.sum(F.coalesce(score, F.lit(0.0))) / F.count("*")).alias("scalar_score"),
    )


def record_scores(records: DataFrame, available: DataFrame, scalar: DataFrame, numeric: DataFrame,
                  semantic: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every record once.  Without a prediction: coverage and score 0, accuracy missing."""
    keys = list(keys)
    n = numeric.select(*keys, F.col("coverage").alias("numeric_coverage"), F.col("accuracy").alias("numeric_accuracy"),
                       F.col("extras").alias("unverified_numeric_extras"))
    s = semantic.select(*keys, F.col("coverage").alias("semantic_coverage"),
                        F.col("accuracy").alias("semantic_accuracy"),
                        F.col("extras").alias("unverified_semantic_extras"))
    flag = available.select(*keys).distinct().withColumn("_there", F.lit(True))
    joined = records.join(flag, keys, "left").join(scalar, keys, "left").join(n, keys, "left").join(s, keys, "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    zero_when_missing = ["scalar_coverage", "scalar_score", "numeric_coverage", "semantic_coverage", *EXTRAS]
    columns = {"prediction_available": there}
    for name in METRICS + EXTRAS:
        gone = F.lit(0) if name in zero_when_missing else F.lit(None)
        columns[name] = F.when(there, F.col(name)).otherwise(gone)
    return joined.withColumns(columns).select(*records.columns, "prediction_available", *METRICS, *EXTRAS)


def finite_mean(value: Column) -> Column:
    return F.avg(X.finite(value))


def tier_groups(tier: Column) -> Column:
    """Each record counts in its own group and in 'all'; strict is A/B, silver is C/D."""
    return F.when(tier.isin("A", "B"), X.literal_array(["strict", "all"])).when(
        tier.isin("C", "D"), X.literal_array(["silver", "all"])
    )


def tier_summary(scores: DataFrame) -> DataFrame:
    """Per group: n counts every record, everything else only records with a prediction."""
    ok = F.col("prediction_available")
    rows = scores.withColumn("tier_group", F.explode(tier_groups(F.col("tier"))))
    return rows.groupBy("tier_group").agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("scored"),
        *[finite_mean(F.when(ok, F.col(m))).alias(m) for m in METRICS],
        *[F.coalesce(F.sum(F.when(ok, F.col(e))), F.lit(0)).alias(e) for e in EXTRAS],
    )


def release_gate(summary: DataFrame, thresholds: dict[str, float] | None = None, require_complete: bool = True) -> DataFrame:
    """One row per check on the strict group; a missing metric fails.  No strict row means every check fails."""
    limits = {**config.GATE_THRESHOLDS, **(thresholds or {})}
    strict = summary.filter(F.col("tier_group") == "strict").agg(
        F.max("n").alias("n"), F.max("scored").alias("scored"), *[F.max(m).alias(m) for m in METRICS]
    )

    def check(name: str, observed: Column, threshold: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check_name"), observed.cast("double").alias("observed"),
            threshold.cast("double").alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"),
        )

    rows = []
    for name, limit in limits.items():
        observed = X.finite(F.col("n") if name == "strict_records" else F.col(name))
        rows.append(check(name, observed, F.lit(limit), observed >= limit))
    if require_complete:
        rows.append(check("complete_strict_predictions", F.col("scored"), F.col("n"),
                          (F.col("scored") == F.col("n")) & (F.col("n") > 0)))
    return strict.select(F.inline(F.array(*rows)))


def gate_verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.bool_and("passed").alias("passed"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("check_name")))), ", ").alias("unmet"),
    )


def triage_eligible(relevant: Column, reason: Column) -> Column:
    """Positives, and negatives whose reason is about the model and not about the search."""
    return relevant | F.coalesce(reason.isin(*config.SAFE_EXCLUSIONS), F.lit(False))


def triage_point_metrics(rows: DataFrame, threshold: float = config.INTERMEDIATE_THRESHOLD,
                         keys: list[str] | None = None) -> DataFrame:
    """Brier score, log loss, sensitivity and specificity over rows (label, probability)."""
    p = clip01(X.finite(F.col("probability")))
    y = F.col("label").cast("double")
    hit = (p >= threshold).cast("double")
    floor = F.lit(1e-12)
    loss = y * F.log(F.greatest(p, floor)) + (1 - y) * F.log(F.greatest(1 - p, floor))
    scored = p.isNotNull()
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("expected"),
        F.count_if(scored).alias("found"),
        F.avg(F.when(scored, F.pow(p - y, F.lit(2.0)))).alias("brier"),
        (-F.avg(F.when(scored, loss))).alias("log_loss"),
        F.avg(F.when(scored & (F.col("label") == 1), hit)).alias("sensitivity"),
        F.avg(F.when(scored & (F.col("label") == 0), 1 - hit)).alias("specificity"),
    )


def triage_metrics(rows: DataFrame, tie: str, threshold: float = config.INTERMEDIATE_THRESHOLD) -> DataFrame:
    """All triage metrics in one row; rows hold (label, probability) and a unique numeric tie-breaker."""
    clean = rows.withColumn("probability", clip01(X.finite(F.col("probability"))))
    point = triage_point_metrics(clean, threshold)
    area = ranking.auroc(clean, "label", "probability").select("auroc")
    precision = ranking.average_precision(clean, "label", "probability", tie)
    stacked = point.unionByName(area, allowMissingColumns=True).unionByName(precision, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])  # three one-row tables as one row


def reusable_articles(envelopes: DataFrame, sources: DataFrame, task: str, mode: str, endpoint: str) -> DataFrame:
    """Articles whose every record has a complete prediction of the same task, mode, endpoint and source hash.

    sources: (article_id, record_id, source_sha256); envelopes: (record_id, task, mode, endpoint, status,
    source_sha256).
    """
    made = envelopes.filter(
        (F.col("task") == task) & (F.col("mode") == mode) & (F.col("endpoint") == endpoint)
        & (F.col("status") == "complete")
    )

    def packed(sha: Column) -> Column:
        # Half the bytes to shuffle of a hash in hex; anything else as it is. The first byte tells which.
        return F.when(sha.rlike(r"\A[0-9a-f]{64}\z"), F.concat(F.lit(b"\0"), F.unhex(sha))).otherwise(F.concat(F.lit(b"\1"), F.encode(sha, "UTF-8")))

    unknown = F.lit(b"\1?")
    made = made.select("record_id", packed(F.coalesce("source_sha256", F.lit("?"))).alias("_sha"))
    joined = sources.select("article_id", "record_id", packed(F.coalesce("source_sha256", F.lit(""))).alias("_own")).join(made, "record_id", "left")
    same = F.coalesce("_sha", unknown) == F.col("_own")
    return joined.groupBy("article_id").agg(
        F.count("*").alias("n_records"), F.bool_and(same).alias("reusable")
    )
