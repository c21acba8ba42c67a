"""Numbers, hashes, versions and unit conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions.text import coalesce_blank, finite, let, metric_name

EPS = 2.220446049250313e-16


def clip01(value: Column) -> Column:
    """Into 0..1; null stays null (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def probability(value: Column, default: float = 0.0) -> Column:
    """Clipped to 0..1; missing or non-finite input gives the default."""
    return clip01(F.coalesce(finite(value), F.lit(default)))


def probability_text(value: Column) -> Column:
    """'83%' and numbers in (1, 100] are percentages; text that is no number is left alone (null)."""
    text = F.trim(value)
    percent = F.endswith(text, F.lit("%"))
    number = finite(F.regexp_replace(text, "%$", ""))
    scaled = F.when(percent, number / 100).otherwise(number)
    return F.when((scaled > 1) & (scaled <= 100), scaled / 100).otherwise(scaled)


def probability_ok(value: Column) -> Column:
    return value.isNull() | value.between(0, 1)


def triage_tier(p: Column, high: float = config.HIGH_THRESHOLD, mid: float = config.INTERMEDIATE_THRESHOLD) -> Column:
    return F.when(p >= high, F.lit("high")).when(p >= mid, F.lit("intermediate")).otherwise(F.lit("low"))


def hash_fraction(group: Column, seed: object) -> Column:
    """sha256('seed:group'), first seven hex digits over 16^7 - 1."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), group.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / F.lit(float(16**7 - 1))


def partition_of(group: Column, seed: object = config.PARTITION_SEED,
                 validation: float = config.VALIDATION_FRACTION, test: float = config.TEST_FRACTION) -> Column:
    if min(validation, test) < 0 or validation + test >= 1:
        raise ValueError("fractions must be non-negative and sum to less than one")
    score = hash_fraction(group, seed)
    return (
        F.when(score < test, F.lit("test"))
        .when(score < test + validation, F.lit("validation"))
        .otherwise(F.lit("train"))
    )


def claim_close(a: Column, b: Column, tolerance: float = config.CLAIM_TOLERANCE) -> Column:
    """Lane comparison: |a-b| <= max(1e-8, tol * max(1, |a|, |b|))."""
    bound = F.greatest(F.lit(1e-8), F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))
    return F.abs(a - b) <= bound


def numeric_close(target: Column, value: Column, relative: float = config.RELATIVE_TOLERANCE,
                  absolute: float = config.ABSOLUTE_TOLERANCE) -> Column:
    """Benchmark: |t-p| <= abs + rel * max(|t|, abs); anything non-finite is false."""
    t, p = finite(target), finite(value)
    return F.coalesce(
        F.abs(t - p) <= F.lit(absolute) + F.lit(relative) * F.greatest(F.abs(t), F.lit(absolute)), F.lit(False)
    )


def relative_equal(target: Column, value: Column, tolerance: float = 0.05) -> Column:
    """Mean relative difference of one pair; absolute when the target is not above the tolerance."""
    t, p = finite(target), finite(value)
    gap = F.abs(t - p)
    return F.coalesce(
        F.when(F.abs(t) > tolerance, gap / F.abs(t) <= tolerance).otherwise(gap <= tolerance), F.lit(False)
    )


def percent_delta(left: Column, right: Column) -> Column:
    """Infinity, not null, when only the left side is zero."""
    a, b = finite(left), finite(right)
    tiny = F.abs(a) <= EPS
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(tiny & (F.abs(b) <= EPS), F.lit(0.0))
        .when(tiny, F.lit(float("inf")))
        .otherwise(F.lit(100.0) * (b - a) / F.abs(a))
    )


def version_key(version: Column) -> Column:
    """Sortable ARRAY<INT> of the numeric parts."""
    return F.transform(F.split(version, "[.-]"), lambda part: part.try_cast("int"))


def version_newer(candidate: Column, current: Column) -> Column:
    """Part-wise numeric comparison; blank or malformed versions are never newer."""
    a, b = version_key(candidate), version_key(current)
    bad = F.exists(a, lambda v: v.isNull()) | F.exists(b, lambda v: v.isNull())
    return F.coalesce(
        F.when((candidate == "") | (current == "") | bad, F.lit(False)).otherwise(a > b), F.lit(False)
    )


def next_patch(version: Column) -> Column:
    parts = F.transform(F.split(coalesce_blank(version, "0.0.0"), "[.]"), lambda p: p.try_cast("int"))
    good = (F.size(parts) == 3) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(
        good,
        F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), (F.get(parts, F.lit(2)) + 1)),
    ).otherwise(F.lit("0.0.1"))


def review_overdue(due: Column, now: Column) -> Column:
    """Blank: not overdue.  Unparseable: overdue, so bad input fails closed."""
    text = coalesce_blank(due)
    return F.when(text == "", F.lit(False)).otherwise(
        F.coalesce(F.try_to_timestamp(text) < now, F.lit(True))
    )


def eta_distribution_name(distribution: Column, expression: Column, template_log_normal: bool = True) -> Column:
    """struct(name, inferred)."""
    named = metric_name(distribution)
    text = F.lower(coalesce_blank(expression))
    guess = (
        F.when(text.rlike(r"exp\s*\([^)]*eta"), F.lit("log_normal"))
        .when(text.rlike(r"[+].*eta"), F.lit("normal"))
        .otherwise(F.lit("log_normal" if template_log_normal else "unknown"))
    )
    name = F.when(named == "unknown", guess).otherwise(named)
    return F.struct(name.alias("name"), ((named == "unknown") & (name != "unknown")).alias("inferred"))


def omega_variance(reported: Column, converted: Column, metric: Column, distribution: Column,
                   expression: Column, typical: Column, template_log_normal: bool = True) -> Column:
    """Random-effect variance on the model scale.  The scale is never guessed from the size of the number."""
    facts = F.struct(
        F.coalesce(finite(reported), finite(converted)).alias("raw"),
        metric_name(metric).alias("kind"),
        eta_distribution_name(distribution, expression, template_log_normal).alias("dist"),
        finite(typical).alias("scale"),
    )
    return let(facts, lambda f: _omega_variance(f["raw"], f["kind"], f["dist"], f["scale"]))


def _omega_variance(raw: Column, kind: Column, dist: Column, scale: Column) -> Column:
    fraction = F.when(kind == "cv_percent", raw / 100).when(kind == "cv_fraction", raw)
    from_cv = F.when(dist["name"] == "log_normal", F.log1p(fraction * fraction)).when(
        dist["name"] == "normal", F.pow(scale * fraction, F.lit(2.0))
    )
    value = F.when(
        raw >= 0,
        F.when(kind == "variance", raw)
        .when(kind == "sd", raw * raw)
        .when(kind == "approximate_cv_percent", F.pow(raw / 100, F.lit(2.0)))
        .when(kind.isin("cv_fraction", "cv_percent"), from_cv),
    )
    supported = F.coalesce(value >= 0, F.lit(False))
    note = (
        F.when(raw.isNull() | (raw < 0), F.lit(config.NO_VARIABILITY))
        .when(kind == "variance", F.lit("used reported variance"))
        .when(kind == "sd", F.lit("squared the reported standard deviation"))
        .when(kind == "approximate_cv_percent", F.lit("used (CV/100)^2 as explicitly reported"))
        .when(kind.isin("cv_fraction", "cv_percent") & (dist["name"] == "log_normal"), F.lit("used log(1+CV^2)"))
        .when(kind.isin("cv_fraction", "cv_percent"), F.lit("converted CV to absolute SD, then squared"))
        .otherwise(F.lit("could not determine the variability metric"))
    )
    return F.struct(
        value.alias("value"),
        supported.alias("supported"),
        (~supported | dist["inferred"] | dist["name"].isin("other", "unknown")).alias("review"),
        kind.alias("metric"),
        dist["name"].alias("distribution"),
        note.alias("note"),
    )


def sigma_variance(reported: Column, converted: Column, metric: Column) -> Column:
    facts = F.struct(F.coalesce(finite(reported), finite(converted)).alias("raw"), metric_name(metric).alias("kind"))
    return let(facts, lambda f: _sigma_variance(f["raw"], f["kind"]))


def _sigma_variance(raw: Column, kind: Column) -> Column:
    value = F.when(
        raw >= 0,
        F.when(kind == "variance", raw)
        .when(kind.isin("sd", "cv_fraction"), raw * raw)
        .when(kind == "cv_percent", F.pow(raw / 100, F.lit(2.0))),
    )
    supported = F.coalesce(value >= 0, F.lit(False))
    return F.struct(
        value.alias("value"), supported.alias("supported"), (~supported).alias("review"), kind.alias("metric")
    )


def covariance_value(reported: Column, converted: Column, metric: Column, row_variance: Column,
                     col_variance: Column) -> Column:
    """A correlation (percent rescaled) times the two standard deviations; a covariance as it is."""
    facts = F.struct(F.coalesce(finite(reported), finite(converted)).alias("raw"), metric_name(metric).alias("kind"),
                     row_variance.alias("rv"), col_variance.alias("cv"))
    return let(facts, lambda f: _covariance_value(f["raw"], f["kind"], f["rv"], f["cv"]))


def _covariance_value(raw: Column, kind: Column, row_variance: Column, col_variance: Column) -> Column:
    percent = (kind == "correlation") & (F.abs(raw) > 1) & (F.abs(raw) <= 100)
    r = F.when(percent, raw / 100).otherwise(raw)
    value = F.when((kind == "correlation") & (F.abs(r) <= 1), r * F.sqrt(row_variance * col_variance)).when(
        kind == "covariance", raw
    )
    return F.struct(
        value.alias("value"),
        value.isNotNull().alias("supported"),
        (F.coalesce(percent, F.lit(False)) | value.isNull()).alias("review"),
        kind.alias("metric"),
    )


def amount_mg(amount: Column, unit: Column, weight: Column, surface: Column) -> Column:
    """struct(value, assumption, blocker): a dose in mg, or why it cannot be had."""
    number = finite(amount)
    text = F.lower(F.regexp_replace(coalesce_blank(unit), r"\s+", ""))
    text = F.regexp_replace(F.regexp_replace(text, "^mcg", "ug"), "^µg", "ug")
    facts = F.struct(number.alias("number"), text.alias("text"), finite(weight).alias("weight"), finite(surface).alias("surface"))
    return let(facts, lambda f: _amount_mg(f["number"], f["text"], f["weight"], f["surface"]))


def _amount_mg(number: Column, text: Column, weight: Column, surface: Column) -> Column:
    base = F.regexp_replace(text, "/.*$", "")
    per_kg, per_m2 = F.contains(text, F.lit("/kg")), F.contains(text, F.lit("/m2"))
    mg = F.when(base == "g", number * 1000).when(base == "ug", number / 1000).otherwise(number)
    blocker = (
        F.when(number.isNull(), F.lit("dose_amount_missing"))
        .when(text == "", F.lit("dose_unit_missing"))
        .when(~base.isin("g", "mg", "ug"), F.lit("dose_unit_not_convertible_to_mg"))
        .when(per_kg & weight.isNull(), F.lit("weight_required_for_weight_normalized_dose"))
        .when(per_m2 & surface.isNull(), F.lit("bsa_required_for_surface_area_normalized_dose"))
    )
    scaled = mg * F.when(per_kg, weight).otherwise(F.lit(1.0)) * F.when(per_m2, surface).otherwise(F.lit(1.0))
    assumption = F.when(per_m2, F.lit("surface-area-normalized dose converted with a representative BSA")).when(
        per_kg, F.lit("weight-normalized dose converted with a representative weight")
    )
    return F.struct(
        F.when(blocker.isNull(), scaled).alias("value"),
        F.when(blocker.isNull(), assumption).alias("assumption"),
        blocker.alias("blocker"),
    )


def hours(value: Column, unit: Column, field: str) -> Column:
    number = finite(value)
    text = F.lower(coalesce_blank(unit))
    factor = F.when(text.rlike("^h"), F.lit(1.0)).when(text.rlike("^min"), F.lit(1.0 / 60)).when(
        text.rlike("^d"), F.lit(24.0)
    )
    return F.struct(
        (number * factor).alias("value"),
        F.when(number.isNotNull() & factor.isNull(), F.lit(f"{field}_unit_not_convertible_to_hours")).alias("blocker"),
    )


def timeline(times: Column, horizon: Column | float = 24.0, points: int = 49) -> Column:
    """Sorted distinct non-negative times with zero, or an even grid when there are none."""
    good = F.filter(times, lambda t: t.isNotNull() & ~F.isnan(t) & (t >= 0))
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: i.cast("double") * (horizon if isinstance(horizon, Column) else F.lit(float(horizon)))
        / F.lit(float(points - 1)),
    )
    full = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), good)))
    return F.when(F.size(F.coalesce(good, F.array().cast("array<double>"))) > 0, full).otherwise(grid)


def validated_range(low: Column, high: Column) -> Column:
    """struct(min, max, valid): open ends default to infinity."""
    lo = F.coalesce(low.cast("double"), F.lit(float("-inf")))
    hi = F.coalesce(high.cast("double"), F.lit(float("inf")))
    return F.struct(lo.alias("min"), hi.alias("max"),
                    (~F.isnan(lo) & ~F.isnan(hi) & (lo <= hi)).alias("valid"))


def population_total(counts: Column, supplied: Column) -> Column:
    """struct(n_total, assumption): the sum of several cohort sizes, else the supplied count, else the only size."""
    sizes = F.filter(counts, lambda n: n.isNotNull())
    total = F.aggregate(sizes, F.lit(0.0), lambda acc, n: acc + n.cast("double"))
    several = F.coalesce(F.size(sizes), F.lit(0)) > 1
    return F.struct(
        F.when(several, total).otherwise(F.coalesce(finite(supplied), F.get(sizes, F.lit(0)).cast("double")))
        .alias("n_total"),
        F.when(several, F.lit(config.SUMMED_POPULATION))
        .alias("assumption"),
    )
