"""Reproduction of published curves: event tables, interpolation, scores, plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as X
from claimloom.operators import keyed, ranking

ROOT_EPS = 1.4901161193847656e-08


def concentration_points(df: DataFrame, keys: Sequence[str], targets: Column) -> DataFrame:
    """One row per usable point (both time and value) of the concentration-time targets."""
    rows = df.select(*keys, F.explode(targets).alias("t")).filter(F.col("t.kind") == "concentration_time")
    points = rows.select(*keys, F.col("t.id").alias("target_id"), F.col("t.statistic").alias("statistic"),
                         F.explode("t.points").alias("p"))
    time, value = X.finite(F.col("p.time")), X.finite(F.col("p.value"))
    return points.select(
        *keys, "target_id", "statistic", time.alias("time"), value.alias("value"),
        X.finite(F.col("p.lower")).alias("lower"), X.finite(F.col("p.upper")).alias("upper"),
    ).filter(F.col("time").isNotNull() & F.col("value").isNotNull())


def simulated_curve(simulated: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Median and 5/95% quantiles of the predictions per time."""
    rows = simulated.select(*keys, F.col(time).alias("time"), F.col(value).alias("_value"))
    return ranking.quantiles(rows, [*keys, "time"], "_value", {"low": 0.05, "median": 0.5, "high": 0.95})


def interpolate(curve: DataFrame, targets: DataFrame, keys: Sequence[str], time: str = "time", value: str = "median",
                points: Sequence[float] | None = None) -> DataFrame:
    """Targets with the curve value at their time: linear between neighbours, constant beyond the ends.

    Curve and targets are put on one timeline; each target looks at the last
    curve point at or before it and the first at or after it.  Timelines are
    cut into quantile blocks whose edges carry the neighbouring curve points,
    so a long series is not handled by one task.  ``points`` are the block
    edges when the caller has them from the raw series; otherwise they are
    taken from curve and targets.
    """
    c = curve.select(*keys, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"))
    both = targets.select(*keys, F.struct(*targets.columns).alias("_row"), F.col("time").cast("double").alias("_t")).withColumn(
        "_v", F.lit(None).cast("double")).unionByName(
        c.select(*keys, F.lit(None).cast(targets.select(F.struct(*targets.columns).alias("x")).schema["x"].dataType).alias("_row"), "_t", "_v"))
    cut = keyed.with_blocks(both, "_t", points=points)
    point = F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))
    edges = cut.groupBy(*keys, "_block").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_block")
    edges = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"),
        F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_t")
    marked = cut.withColumn("_lo", F.max(point).over(inside.rangeBetween(Window.unboundedPreceding, 0))).withColumn(
        "_hi", F.min(point).over(inside.rangeBetween(0, Window.unboundedFollowing)))
    condition = F.col("_block") == F.col("_k_block")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = marked.filter(F.col("_row").isNotNull()).join(edges, condition, "left")
    lo, hi = F.coalesce("_lo", "_before"), F.coalesce("_hi", "_after")
    share = F.try_divide(F.col("_t") - lo["_t"], hi["_t"] - lo["_t"])
    predicted = (
        F.when(lo.isNull(), hi["_v"]).when(hi.isNull() | (hi["_t"] == lo["_t"]), lo["_v"])
        .otherwise(lo["_v"] + (hi["_v"] - lo["_v"]) * share)
    )
    return joined.select("_row.*", predicted.alias("simulated"))


def point_scores(points: DataFrame) -> DataFrame:
    """Residual, relative error and interval flag per target point."""
    residual = F.col("simulated") - F.col("value")
    both = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    return points.withColumns({
        "residual": residual,
        "relative_error": residual / F.greatest(F.abs("value"), F.lit(ROOT_EPS)),
        "within_interval": F.when(both, F.col("simulated").between(F.col("lower"), F.col("upper"))),
    })


def reproduction_score(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """nrmse, median absolute relative error, interval coverage and a status per key."""
    rows = scored.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow("residual", F.lit(2.0)))).alias("_rmse"),
        (F.max("value") - F.min("value")).alias("_span"),
        F.avg(F.abs("value")).alias("_level"),
        F.avg(F.col("within_interval").cast("double")).alias("interval_coverage"),
        F.count("*").alias("n_points"),
    )
    middle = ranking.quantiles(
        scored.select(*keys, F.abs("relative_error").alias("_error")), list(keys), "_error",
        {"median_absolute_relative_error": 0.5},
    ).drop("n")
    nrmse = F.col("_rmse") / F.greatest("_span", "_level", F.lit(ROOT_EPS))
    status = (
        F.when(X.finite(F.col("nrmse")).isNull(), F.lit("not_scorable"))
        .when(F.col("nrmse") <= 0.1, F.lit("close_reproduction"))
        .when(F.col("nrmse") <= 0.25, F.lit("approximate_reproduction"))
        .otherwise(F.lit("material_discrepancy"))
    )
    joined = rows.join(middle, list(keys), "left").withColumn("nrmse", nrmse).withColumn("status", status)
    return joined.select(*keys, "n_points", "nrmse", "median_absolute_relative_error", "interval_coverage", "status")


def event_rows(plans: DataFrame, keys: Sequence[str], n_subjects: Column) -> DataFrame:
    """Dose and observation rows for every synthetic subject of every plan.

    plans: advan, amount_mg, steady_state, administration, repetitions,
    interval_hours, duration_hours, times ARRAY<DOUBLE>.  Subjects and times
    are exploded in the row; the output order is id, time, dose first.
    """
    oral = F.col("advan").isin(2, 4, 12)
    steady = F.coalesce("steady_state", F.lit(False))
    doses = F.when(~steady & (F.col("repetitions") > 1) & F.col("interval_hours").isNotNull(), F.col("repetitions")).otherwise(F.lit(1))
    infusion = (F.col("administration") == "infusion") & F.col("duration_hours").isNotNull()
    dose_rows = F.transform(
        F.sequence(F.lit(1), doses.cast("int")),
        lambda i: F.struct(
            F.when(i == 1, F.lit(0.0)).otherwise((i - 1) * F.col("interval_hours")).alias("TIME"),
            F.lit(1).alias("EVID"), F.col("amount_mg").alias("AMT"),
            F.when(infusion, F.col("amount_mg") / F.col("duration_hours")).otherwise(F.lit(0.0)).alias("RATE"),
            F.when(steady, F.coalesce("interval_hours", F.lit(0.0))).otherwise(F.lit(0.0)).alias("II"),
            steady.cast("int").alias("SS"), F.lit(1).alias("CMT"), F.lit(1).alias("MDV"),
        ),
    )
    seen_rows = F.transform(
        "times",
        lambda t: F.struct(
            t.alias("TIME"), F.lit(0).alias("EVID"), F.lit(0.0).alias("AMT"), F.lit(0.0).alias("RATE"),
            F.lit(0.0).alias("II"), F.lit(0).alias("SS"), F.when(oral, F.lit(2)).otherwise(F.lit(1)).alias("CMT"),
            F.lit(0).alias("MDV"),
        ),
    )
    people = plans.withColumn("ID", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n_subjects.cast("int")))))
    return people.select(*keys, "ID", F.inline(F.concat(dose_rows, seen_rows)))


def plan_blockers(advan: Column, trans: Column, amount: Column, interval: Column, duration: Column, steady: Column,
                  administration: Column, control_error: Column, generated_defaults: Column,
                  allow_defaults: bool = False) -> Column:
    """Codes that stop a reproduction run; amount, interval and duration are the structs of ``numbers``."""
    return F.array_compact(F.array(
        F.when(advan.isNull() | trans.isNull(), F.lit("implementation_unresolved")),
        amount["blocker"], interval["blocker"], duration["blocker"],
        F.when(F.coalesce(steady, F.lit(False)) & interval["value"].isNull(), F.lit("steady_state_interval_missing")),
        F.when((administration == "infusion") & duration["value"].isNull(), F.lit("infusion_duration_missing")),
        F.when(X.present(control_error), F.lit("model_compilation_failed")),
        F.when((generated_defaults > 0) & F.lit(not allow_defaults), F.lit("generated_parameter_defaults_present")),
    ))


def plan_subjects(n_total: Column) -> Column:
    return F.when(n_total.isNull(), F.lit(100)).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), n_total.cast("int"))))

