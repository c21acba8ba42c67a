"""Claims of one extraction, comparison of two lanes, and per-record scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import numbers as N
from claimloom.functions import text as X

CLAIM = "struct<field:string,text:string,number:double>"


def claim(field: Column | str, text: Column | None = None, number: Column | None = None) -> Column:
    """One claim: numeric claims carry the number, all others their text."""
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(
        name.alias("field"),
        (text if text is not None else F.lit(None)).cast("string").alias("text"),
        (number if number is not None else F.lit(None)).cast("double").alias("number"),
    )


def named_parameter_claims(items: Column, prefix: str, label: str, value: str) -> Column:
    """Upper-cased label or 1-based index; a later duplicate overwrites, and a null value deletes the earlier one."""
    keyed = F.transform(
        items,
        lambda p, i: F.struct(
            F.concat(
                F.lit(prefix + "."),
                F.coalesce(F.nullif(F.upper(X.strip(p[label])), F.lit("")), (i + 1).cast("string")),
            ).alias("field"),
            p[value].cast("double").alias("number"),
        ),
    )

    def last_only(rows: Column) -> Column:
        names = F.transform(rows, lambda k: k["field"])
        last = F.filter(rows, lambda k, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), k["field"]))
        return F.transform(
            F.filter(last, lambda k: k["number"].isNotNull()),
            lambda k: F.struct(k["field"].alias("field"), F.lit(None).cast("string").alias("text"),
                               k["number"].alias("number")),
        )

    return X.let(keyed, last_only)


def extraction_claims(x: Column, model_present: Column) -> Column:
    """ARRAY of claims from an extraction struct (see ``plans.semantics.enrich`` for its fields)."""
    fixed = [
        claim("model_present", text=model_present.cast("string")),
        claim("compound", text=x["compound"]),
        claim("population", text=x["population"]),
        claim("route", text=x["route"]),
        claim("n_subjects", number=x["n_subjects"]),
        claim("software", text=x["software"]),
        claim("estimation_method", text=x["estimation_method"]),
        claim("model_type", text=x["model_type"]),
        claim("structural.advan", number=x["advan"]),
        claim("structural.trans", number=x["trans"]),
        claim("structural.compartments", number=x["compartments"]),
        claim("structural.description", text=x["description"]),
        claim("structural.canonical.compartments", number=x["canonical"]["compartments"]),
        claim("structural.canonical.input", text=x["canonical"]["input"]),
        claim("structural.canonical.elimination", text=x["canonical"]["elimination"]),
        claim("structural.canonical.parameterization", text=x["canonical"]["parameterization"]),
        claim("structural.implementation_status", text=x["implementation"]["status"]),
        claim("population_details.n_total", number=x["population_details"]["n_total"]),
        claim("population_details.cohorts", text=_json_or_null(x["population_details"]["cohorts"])),
        claim("dosing", text=_json_or_null(x["dosing"])),
        claim("reproduction_targets", text=_json_or_null(x["reproduction_targets"])),
        claim("covariates", text=F.nullif(
            F.array_join(F.sort_array(F.transform(x["covariates"], lambda c: F.lower(c))), "|"), F.lit(""))),
        claim("residual_error", text=x["residual_error"]),
    ]
    lists = [
        named_parameter_claims(x["parameters"]["theta"], "theta", "name", "typical"),
        named_parameter_claims(x["parameters"]["omega"], "omega", "description", "value"),
        named_parameter_claims(x["parameters"]["sigma"], "sigma", "description", "value"),
    ]
    return F.concat(F.array(*fixed), *[F.coalesce(a, F.array().cast(f"array<{CLAIM}>")) for a in lists])


def _json_or_null(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.to_json(items, {"ignoreNullFields": "false"}))


def has_value(text: Column, number: Column) -> Column:
    return number.isNotNull() | X.present(text)


def claims_equal(text_a: Column, number_a: Column, text_b: Column, number_b: Column,
                 tolerance: float = config.CLAIM_TOLERANCE) -> Column:
    """Blank equals missing; numbers by tolerance; text without case and extra spaces."""
    a, b = has_value(text_a, number_a), has_value(text_b, number_b)

    def flat(value: Column) -> Column:
        return F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))

    def plain(number: Column) -> Column:
        return F.regexp_replace(number.cast("string"), r"\.0$", "")

    left = F.coalesce(plain(number_a), flat(text_a))
    right = F.coalesce(plain(number_b), flat(text_b))
    return (
        F.when(~a & ~b, F.lit(True))
        .when(a != b, F.lit(False))
        .when(number_a.isNotNull() & number_b.isNotNull(), N.claim_close(number_a, number_b, tolerance))
        .otherwise(left == right)
    )


def claim_impact(field: Column) -> Column:
    return F.when(field.rlike(config.MAJOR_CLAIM_PATTERN), F.lit("major")).otherwise(F.lit("minor"))


def compare_lanes(text_claims: DataFrame, vision_claims: DataFrame, keys: Sequence[str],
                  tolerance: float = config.CLAIM_TOLERANCE) -> DataFrame:
    """Field by field: keys, field, both values, equal, present, impact.  Inputs have keys, field, text, number.

    The full outer join is on (keys, field); the summary step only sees one row
    per field and reduces it before the shuffle.
    """
    a = text_claims.select(*keys, "field", F.col("text").alias("text_a"), F.col("number").alias("number_a"))
    b = vision_claims.select(*keys, "field", F.col("text").alias("text_b"), F.col("number").alias("number_b"))
    both = a.join(b, [*keys, "field"], "full_outer")
    equal = claims_equal(F.col("text_a"), F.col("number_a"), F.col("text_b"), F.col("number_b"), tolerance)
    present = has_value(F.col("text_a"), F.col("number_a")) | has_value(F.col("text_b"), F.col("number_b"))
    return both.withColumns({"is_equal": equal, "is_present": present, "impact": claim_impact(F.col("field"))})


def comparison_summary(compared: DataFrame, lanes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per record of ``lanes`` (keys, text_available, vision_available); both lanes must be available."""
    flags = compared.groupBy(*keys).agg(
        F.count_if("is_present").alias("_present"),
        F.count_if(F.col("is_present") & F.col("is_equal")).alias("_agree"),
        F.count_if(~F.col("is_equal")).alias("_differ"),
        F.count_if(~F.col("is_equal") & (F.col("impact") == "major")).alias("_major"),
    )
    ok = F.col("text_available") & F.col("vision_available")
    joined = lanes.join(flags, list(keys), "left")

    def counted(name: str) -> Column:
        return F.when(ok, F.coalesce(F.col(name), F.lit(0))).otherwise(F.lit(0))

    return joined.select(
        *keys,
        "text_available",
        "vision_available",
        ok.alias("comparable"),
        (ok & (counted("_differ") == 0)).alias("consistent"),
        F.when(ok, counted("_agree") / F.greatest(counted("_present"), F.lit(1))).otherwise(F.lit(0.0))
        .alias("agreement"),
        counted("_present").alias("compared_fields"),
        counted("_differ").alias("difference_count"),
        counted("_major").alias("major_difference_count"),
    )


def comparison_fingerprint(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def lane_confidence(recoverability: Column, confidence: Column) -> Column:
    return F.coalesce(X.finite(recoverability), X.finite(confidence), F.lit(0.0))


def best_lane(text_available: Column, text_confidence: Column, vision_available: Column,
              vision_confidence: Column) -> Column:
    """Highest confidence among the available lanes; the text lane wins ties."""
    return (
        F.when(text_available & (~vision_available | (text_confidence >= vision_confidence)), F.lit("text"))
        .when(vision_available, F.lit("vision"))
    )


# ---------------------------------------------------------------- scoring


def semantic_claims(df: DataFrame, keys: Sequence[str], x: Column, analysed: Callable[[Column], Column] = lambda cohort: cohort["n_analysed"]) -> DataFrame:
    """(keys, path, text, number): nested cohorts, dosing and targets as dotted paths with 1-based indexes.

    Two explodes, both of arrays that the contracts bound; absent values make no row.  ``analysed`` reads a cohort's
    number of analysed subjects.
    """
    none = F.array().cast(f"array<{CLAIM}>")

    def numbered(prefix: Column, fields: Sequence[tuple[str, Column]]) -> Column:
        return F.array(*[claim(F.concat(prefix, F.lit("." + n)), number=v) for n, v in fields])

    fixed = F.array(
        claim("implementation.advan", number=x["advan"]),
        claim("implementation.trans", number=x["trans"]),
        claim("canonical.compartments", number=x["canonical"]["compartments"]),
        claim("canonical.input", text=x["canonical"]["input"]),
        claim("canonical.elimination", text=x["canonical"]["elimination"]),
        claim("canonical.parameterization", text=x["canonical"]["parameterization"]),
        claim("population.n_total", number=x["population_details"]["n_total"]),
        claim("population.cohort_count", number=F.nullif(F.size(x["population_details"]["cohorts"]), F.lit(0))),
    )

    def cohort_claims(c: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("population.cohort"), (i + 1).cast("string"))
        described = F.flatten(F.transform(
            F.filter(c["descriptors"], lambda d: X.normalise(d["name"]) != ""),
            lambda d: F.flatten(F.transform(
                d["statistics"],
                lambda s: numbered(
                    F.concat(prefix, F.lit("."), X.normalise(d["name"]), F.lit("."), s["type"]),
                    [(n, s[n]) for n in ("mean", "sd", "minimum", "maximum", "value")],
                ),
            )),
        ))
        return F.concat(
            F.array(claim(F.concat(prefix, F.lit(".n")), number=analysed(c))), F.coalesce(described, none)
        )

    def dose_claims(d: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("dosing."), (i + 1).cast("string"), F.lit("."))
        words = ("route", "administration", "amount_unit", "interval_unit", "duration_unit", "steady_state")
        counts = ("amount", "interval", "duration", "repetitions")
        return F.concat(
            F.array(*[claim(F.concat(prefix, F.lit(n)), text=d[n].cast("string")) for n in words]),
            F.array(*[claim(F.concat(prefix, F.lit(n)), number=d[n]) for n in counts]),
        )

    def target_claims(t: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("target."), (i + 1).cast("string"))
        points = F.flatten(F.transform(
            t["points"],
            lambda p, j: numbered(
                F.concat(prefix, F.lit(".point."), (j + 1).cast("string")),
                [(n, p[n]) for n in ("time", "value", "lower", "upper")],
            ),
        ))
        words = F.array(*[claim(F.concat(prefix, F.lit("." + n)), text=t[n])
                          for n in ("kind", "statistic", "x_unit", "y_unit", "scale")])
        return F.concat(words, F.coalesce(points, none))

    everything = F.concat(
        fixed,
        F.coalesce(F.flatten(F.transform(x["population_details"]["cohorts"], cohort_claims)), none),
        F.coalesce(F.flatten(F.transform(x["dosing"], dose_claims)), none),
        F.coalesce(F.flatten(F.transform(x["reproduction_targets"], target_claims)), none),
    )
    # outer for the reason that X.inline_rows gives; the row of an empty array has no value
    rows = df.select(*keys, F.inline_outer(everything)).withColumnRenamed("field", "path")
    return rows.filter(has_value(F.col("text"), X.finite(F.col("number"))))


def pair_scores(truth: DataFrame, proposed: DataFrame, keys: Sequence[str], name: Sequence[str], correct: Column,
                proposed_has_value: Column | None = None) -> DataFrame:
    """Expected, covered, correct and extra items per record, from two long tables.

    ``truth`` columns end in ``_t`` and ``proposed`` columns in ``_p``; both
    carry ``keys`` and ``name``.  One full outer join on (keys, name), then one
    aggregation with a map-side combine.
    """
    t = truth.withColumn("_in_t", F.lit(True))
    p = proposed.withColumn("_in_p", F.lit(True))
    both = t.join(p, [*keys, *name], "full_outer")
    expected = F.coalesce(F.col("_in_t"), F.lit(False))
    found = F.coalesce(F.col("_in_p"), F.lit(False))
    covered = expected & found & (proposed_has_value if proposed_has_value is not None else F.lit(True))
    return both.groupBy(*keys).agg(
        F.count_if(expected).alias("expected"),
        F.count_if(covered).alias("covered"),
        F.count_if(covered & F.coalesce(correct, F.lit(False))).alias("correct"),
        F.count_if(found & ~expected).alias("extras"),
    )


def with_rates(df: DataFrame) -> DataFrame:
    """coverage = covered / expected and accuracy = correct / covered, null when there is nothing to divide by."""
    return df.withColumn("coverage", F.try_divide("covered", "expected")).withColumn(
        "accuracy", F.try_divide("correct", "covered")
    )


def parameter_key(kind: str, item: Column, position: Column) -> Column:
    """eta index, or row,col, or the 1-based position."""
    if kind == "omega":
        return F.coalesce(item["eta_index"], position).cast("string")
    if kind == "omega_covariance":
        return F.concat_ws(",", F.coalesce(item["row_eta"], position), F.coalesce(item["col_eta"], position))
    return position.cast("string")


def parameter_rows(df: DataFrame, keys: Sequence[str], parameters: Column) -> DataFrame:
    """(keys, type, item_key, value): the long view of theta, omega, omega_covariance and sigma."""
    def rows(kind: str, value: str) -> Column:
        return F.transform(
            parameters[kind],
            lambda p, i: F.struct(F.lit(kind).alias("type"), parameter_key(kind, p, i + 1).alias("item_key"),
                                  p[value].cast("double").alias("value")),
        )

    empty = F.array().cast("array<struct<type:string,item_key:string,value:double>>")
    everything = F.concat(*[
        F.coalesce(rows(kind, value), empty)
        for kind, value in (("theta", "typical"), ("omega", "value"), ("omega_covariance", "value"), ("sigma", "value"))
    ])
    return X.inline_rows(df, keys, everything, "type")


def token_f1(target: Column, prediction: Column) -> Column:
    """F1 of the distinct normalised words; 0 when either side has none."""
    def words(value: Column) -> Column:
        return F.array_distinct(F.filter(F.split(X.normalise(value), " +"), lambda w: w != ""))

    left, right = words(target), words(prediction)
    shared = F.size(F.array_intersect(left, right)).cast("double")
    return F.when(shared > 0, 2 * shared / (F.size(left) + F.size(right))).otherwise(F.lit(0.0))


def scalar_score(path: Column, text_t: Column, number_t: Column, text_p: Column, number_p: Column) -> Column:
    """Compound by alias, numbers within 5%, short fields exactly, other text by token F1."""
    as_number = F.coalesce(number_p, X.finite(text_p))
    return (
        F.when(path == "compound", (X.compound_code(text_t) == X.compound_code(text_p)).cast("double"))
        .when(number_t.isNotNull(), N.relative_equal(number_t, as_number, 0.05).cast("double"))
        .when(path.isin(*config.EXACT_SCALAR_PATHS), (X.normalise(text_t) == X.normalise(text_p)).cast("double"))
        .otherwise(token_f1(text_t, text_p))
    )
