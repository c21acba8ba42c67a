"""From raw extraction fields to executable semantics: enrichment, template mapping, control text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import numbers as N
from claimloom.functions import parsing as P
from claimloom.functions import text as X
from claimloom.operators import claims as C

THETA = "array<struct<name:string,typical:double>>"
OMEGA = ("array<struct<description:string,parameter:string,eta_index:int,eta_distribution:string,"
         "eta_expression:string,reported_value:double,reported_metric:string,value:double>>")
COVARIANCE = "array<struct<row_eta:int,col_eta:int,reported_value:double,reported_metric:string,value:double>>"
SIGMA = "array<struct<description:string,error_model:string,reported_value:double,reported_metric:string,value:double>>"
PARAMETERS = f"struct<theta:{THETA},omega:{OMEGA},omega_covariance:{COVARIANCE},sigma:{SIGMA}>"
TARGETS = ("array<struct<id:string,kind:string,statistic:string,x_unit:string,y_unit:string,scale:string,"
           "points:array<struct<time:double,value:double,lower:double,upper:double>>>>")

FIELDS = {
    "title": "string", "compound": "string", "population": "string", "route": "string", "n_subjects": "double",
    "software": "string", "estimation_method": "string", "model_type": "string", "dose": "string",
    "advan": "int", "trans": "int", "compartments": "int", "description": "string", "residual_error": "string",
    "covariates": "array<string>", "parameters": PARAMETERS, "reproduction_targets": TARGETS,
    "confidence_overall": "double",
}


def with_fields(df: DataFrame) -> DataFrame:
    """Add the extraction fields a table lacks, as typed nulls."""
    missing = {name: F.lit(None).cast(kind) for name, kind in FIELDS.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def _kept(df: DataFrame, name: str, computed: Column, there: Column | None = None) -> Column:
    """A structured value that is there already stays; otherwise the computed one is used."""
    if name not in df.columns:
        return computed
    return F.when(there if there is not None else F.col(name).isNotNull(), F.col(name)).otherwise(computed)


def enrich(df: DataFrame) -> DataFrame:
    """Population cohorts, dosing, canonical structure and model code; reported values are kept.

    Legacy fields stay; advan, trans and compartments are filled only when
    missing.  Structured population_details, dosing, canonical and
    implementation columns (as this function makes them) pass through.
    """
    base = with_fields(df)
    theta = F.coalesce(F.col("parameters.theta"), F.array().cast(THETA))
    names = F.transform(theta, lambda p: X.coalesce_blank(p["name"]))
    cohorts = F.col("population_details.cohorts").isNotNull() if "population_details" in df.columns else None
    step = base.withColumns({
        "population_details": _kept(df, "population_details", P.population("population", F.col("n_subjects")), cohorts),
        "_regimen": P.regimen("dose", F.col("route")),
        "canonical": _kept(df, "canonical", P.canonical_structure(
            F.col("description"), F.col("compartments"), F.col("route"), names)),
    })
    inferred = P.implementation(F.col("canonical"), F.col("route"), F.col("advan"), F.col("trans"))
    step = step.withColumn("implementation", _kept(df, "implementation", inferred))
    regimens = F.array_compact(F.array("_regimen"))
    return step.withColumns({
        "n_subjects": F.coalesce(F.col("population_details.n_total"), F.col("n_subjects")),
        "dosing": _kept(df, "dosing", regimens, F.size("dosing") > 0 if "dosing" in df.columns else None),
        "advan": F.coalesce("advan", F.col("implementation.advan")),
        "trans": F.coalesce("trans", F.col("implementation.trans")),
        "compartments": F.coalesce("compartments", F.col("canonical.compartments")),
        "semantic_version": F.lit("1.0.0"),
    }).drop("_regimen")


EXTRACTION_COLUMNS = (
    "title", "compound", "population", "route", "n_subjects", "software", "estimation_method", "model_type",
    "advan", "trans", "compartments", "description", "canonical", "implementation", "population_details", "dosing",
    "reproduction_targets", "covariates", "residual_error", "parameters",
)


def as_struct(df: DataFrame, name: str = "extraction") -> DataFrame:
    """Pack the enriched columns into one struct column."""
    return df.withColumn(name, F.struct(*EXTRACTION_COLUMNS))


def contract_extraction(x: Column) -> Column:
    """An extraction of the contract's type, enriched, with the fields that claims and scores read.

    Structured population, dosing and canonical structure stay as reported.  The total of the population counts as the
    number of subjects.  Without an implementation one is inferred; missing codes and compartments are filled from it.
    """
    model = x["structural_model"]
    reported = model["canonical"]
    canonical = F.struct(
        reported["compartments"]["count"].cast("int").alias("compartments"), reported["input"]["process"].alias("input"),
        reported["input"]["depot"].alias("depot"), reported["elimination"]["type"].alias("elimination"),
        reported["parameterization"]["type"].alias("parameterization"))

    def filled(parts: Column) -> Column:
        found, inferred = F.get(model["implementations"], F.lit(0)), parts["inferred"]
        given = F.size(model["implementations"]) > 0
        return F.struct(
            *[x[c].alias(c) for c in ("title", "compound", "population", "route")],
            F.coalesce(x["population_details"]["n_total"], x["n_subjects"]).alias("n_subjects"),
            *[x[c].alias(c) for c in ("software", "estimation_method", "model_type")],
            F.coalesce(model["advan"].cast("int"), inferred["advan"]).alias("advan"),
            F.coalesce(model["trans"].cast("int"), inferred["trans"]).alias("trans"),
            F.coalesce(model["compartments"].cast("int"), parts["canonical"]["compartments"]).alias("compartments"),
            model["description"].alias("description"), parts["canonical"].alias("canonical"),
            F.struct(F.when(given, found["status"]).otherwise(inferred["status"]).alias("status"),
                     F.when(given, found["advan"].cast("int")).otherwise(inferred["advan"]).alias("advan"),
                     F.when(given, found["trans"].cast("int")).otherwise(inferred["trans"]).alias("trans")).alias("implementation"),
            *[x[c].alias(c) for c in ("population_details", "dosing", "reproduction_targets", "covariates", "residual_error", "parameters")],
        )

    inferred = P.implementation(canonical, x["route"], model["advan"], model["trans"])
    return X.let(F.struct(canonical.alias("canonical"), inferred.alias("inferred")), filled)


def score_tables(decoded: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """The long tables 'scalar', 'numeric' and 'semantic' of decoded lanes, as ``jobs.benchmark`` takes them."""
    rows = decoded.filter("available").select(*keys, "extraction")
    x = F.col("extraction")
    values = {"n_subjects": x["n_subjects"], "structural_model.compartments": x["compartments"], "structural_model.description": x["description"],
              "covariates": F.array_join(x["covariates"], " ")}
    numbers = ("n_subjects", "structural_model.compartments")
    found = {path: values[path] if path in values else x[path] for path in config.SCALAR_PATHS}
    scalar = F.array(*[C.claim(path, number=v) if path in numbers else C.claim(path, text=v) for path, v in found.items()])
    return {
        "scalar": rows.select(*keys, F.inline(scalar)).select(*keys, F.col("field").alias("path"), "text", "number"),
        "numeric": C.parameter_rows(rows, keys, x["parameters"]),
        "semantic": C.semantic_claims(rows, keys, x, lambda cohort: cohort["n"]["analysed"]),
    }


# ---------------------------------------------------------------- template mapping


def template(code: Column) -> Column:
    """struct(trans, names, values, etas, scale) of a template, or null for an unknown code."""
    out = F.lit(None)
    for advan, spec in config.TEMPLATES.items():
        record = F.struct(
            F.lit(spec["trans"]).alias("trans"), X.literal_array(spec["names"]).alias("names"),
            F.array(*[F.lit(v) for v in spec["values"]]).alias("values"), F.lit(spec["etas"]).alias("etas"),
            F.lit(spec["scale"]).alias("scale"),
        )
        out = F.when(code == advan, record).otherwise(out)
    return out


def map_template(df: DataFrame, theta: Column, advan: Column, trans: Column) -> DataFrame:
    """Add ``mapping``: reported values by position, defaults flagged, surplus parameters listed.

    The six templates are literals, so mapping is a row expression: the lists
    are matched by position without exploding or joining.
    """
    known = template(advan)
    spec = F.coalesce(known, template(F.lit(config.DEFAULT_TEMPLATE)))
    items = F.coalesce(theta, F.array().cast(THETA))
    base = df.withColumns({"_spec": spec, "_theta": items})
    slots = F.transform(
        F.arrays_zip(F.col("_spec.names").alias("name"), F.col("_spec.values").alias("value")),
        lambda s, i: F.struct(
            (i + 1).alias("position"),
            F.coalesce(
                F.nullif(F.regexp_replace(F.trim(F.get("_theta", i)["name"]), "[^A-Za-z0-9_.-]", "_"), F.lit("")),
                s["name"],
            ).alias("name"),
            F.coalesce(_usable(F.get("_theta", i)["typical"]), s["value"]).alias("value"),
            _usable(F.get("_theta", i)["typical"]).isNotNull().alias("supported"),
        ),
    )
    surplus = F.transform(
        F.slice("_theta", F.size("_spec.names") + 1, F.greatest(F.size("_theta"), F.lit(1))),
        lambda p: X.coalesce_blank(p["name"], "unnamed parameter"),
    )
    mapping = F.struct(
        F.when(known.isNotNull(), advan).otherwise(F.lit(config.DEFAULT_TEMPLATE)).alias("advan"),
        F.coalesce(trans, F.col("_spec.trans")).alias("trans"),
        known.isNull().alias("structure_inferred"),
        slots.alias("slots"),
        surplus.alias("unmapped"),
        F.col("_spec.etas").alias("etas"),
        F.col("_spec.scale").alias("scale"),
    )
    return base.withColumn("mapping", mapping).drop("_spec", "_theta")


def _usable(value: Column) -> Column:
    number = X.finite(value)
    return F.when(number > 0, number)


def map_variability(df: DataFrame, omega: Column, sigma: Column) -> DataFrame:
    """Add ``omegas`` (one per eta of the template) and ``sigmas``, converted to variances or flagged defaults."""
    reported = F.coalesce(omega, F.array().cast(OMEGA))
    residual = F.coalesce(sigma, F.array().cast(SIGMA))

    def at_eta(k: Column) -> Column:
        mine = F.filter(reported, lambda o, i: F.coalesce(o["eta_index"], i + 1) == k)
        return F.try_element_at(mine, F.lit(-1))

    def converted(k: Column) -> Column:
        item = at_eta(k)
        typical = F.get(F.col("mapping.slots"), F.least(k, F.size("mapping.slots")) - 1)["value"]
        return N.omega_variance(item["reported_value"], item["value"], item["reported_metric"],
                                item["eta_distribution"], item["eta_expression"], typical)

    omegas = F.transform(
        F.sequence(F.lit(1), F.col("mapping.etas")),
        lambda k: F.struct(
            k.alias("eta"),
            F.when(at_eta(k).isNotNull() & converted(k)["supported"], converted(k)["value"])
            .otherwise(F.lit(config.DEFAULT_OMEGA)).alias("value"),
            (at_eta(k).isNotNull() & converted(k)["supported"]).alias("supported"),
            F.when(at_eta(k).isNotNull(), converted(k)["distribution"]).otherwise(F.lit("unknown")).alias("distribution"),
        ),
    )
    listed = F.transform(
        residual,
        lambda s: N.sigma_variance(s["reported_value"], s["value"], s["reported_metric"]),
    )
    sigmas = F.when(F.size(residual) > 0, F.transform(
        listed, lambda c: F.struct(F.coalesce(c["value"], F.lit(config.DEFAULT_SIGMA)).alias("value"),
                                   c["supported"].alias("supported")),
    )).otherwise(F.array(F.struct(F.lit(config.DEFAULT_SIGMA).alias("value"), F.lit(False).alias("supported"))))
    return df.withColumns({"omegas": omegas, "sigmas": sigmas})


def covariance_cells(df: DataFrame, covariance: Column) -> DataFrame:
    """Add ``covariances``: converted off-diagonal cells of the omega block."""
    items = F.coalesce(covariance, F.array().cast(COVARIANCE))

    def variance(k: Column) -> Column:
        return F.get(F.col("omegas"), k - 1)["value"]

    cells = F.transform(
        items,
        lambda c: F.struct(
            c["row_eta"].alias("row_eta"), c["col_eta"].alias("col_eta"),
            N.covariance_value(c["reported_value"], c["value"], c["reported_metric"],
                               variance(c["row_eta"]), variance(c["col_eta"])).alias("converted"),
        ),
    )
    return df.withColumn("covariances", cells)


def generated_defaults() -> Column:
    """Names of every template value that was not reported."""
    theta = F.transform(F.filter("mapping.slots", lambda s: ~s["supported"]), lambda s: s["name"])
    omega = F.transform(F.filter("omegas", lambda o: ~o["supported"]),
                        lambda o: F.concat(F.lit("OMEGA("), o["eta"].cast("string"), F.lit(")")))
    numbered = F.transform("sigmas", lambda s, i: F.struct((i + 1).alias("i"), s["supported"].alias("ok")))
    sigma = F.transform(F.filter(numbered, lambda s: ~s["ok"]),
                        lambda s: F.concat(F.lit("SIGMA("), s["i"].cast("string"), F.lit(")")))
    return F.concat(theta, omega, sigma)


def _plain(value: Column) -> Column:
    """A number as short decimal text."""
    text = F.regexp_replace(F.format_string("%.6f", value), r"0+$", "")
    return F.regexp_replace(text, r"[.]$", "")


def control_text(title: Column) -> Column:
    """The reviewable control stream of a mapped row, as one text with ordered lines."""
    thetas = F.transform(
        "mapping.slots",
        lambda s: F.concat(
            F.lit(" ("), _plain(s["value"] / 1000), F.lit(", "), _plain(s["value"]), F.lit(", "),
            _plain(s["value"] * 1000), F.lit(") ; "), s["name"],
            F.when(s["supported"], F.lit("")).otherwise(F.lit(" [GENERATED DEFAULT]")),
        ),
    )
    block = F.size("covariances") > 0
    rows = F.transform(
        "omegas",
        lambda o, i: F.concat(F.lit(" "), F.array_join(F.transform(
            F.sequence(F.lit(1), i + 1),
            lambda j: F.when(j == i + 1, _plain(o["value"])).otherwise(_plain(_cell(i + 1, j))),
        ), " ")),
    )
    diagonal = F.transform("omegas", lambda o: F.concat(F.lit(" "), _plain(o["value"])))
    model = F.transform(
        "mapping.slots",
        lambda s: F.concat(
            _slot_name(s["position"]), F.lit(" = THETA("), s["position"].cast("string"), F.lit(")"),
            F.when(s["position"] <= F.col("mapping.etas"), _eta_part(s["position"])).otherwise(F.lit("")),
        ),
    )
    head = F.array(
        F.concat(F.lit("$PROBLEM "), F.regexp_replace(F.substring(title, 1, 180), "[\r\n]+", " ")),
        F.concat(F.lit("$SUBROUTINES ADVAN"), F.col("mapping.advan").cast("string"), F.lit(" TRANS"),
                 F.col("mapping.trans").cast("string")),
        F.lit("$INPUT ID TIME EVID AMT RATE II SS CMT DV MDV"),
        F.lit("$DATA literature.csv IGNORE=@"),
        F.lit("$THETA"),
    )
    omega_head = F.when(block, F.concat(F.lit("$OMEGA BLOCK("), F.size("omegas").cast("string"), F.lit(")"))).otherwise(F.lit("$OMEGA"))
    defaults = F.array_join(generated_defaults(), ", ")
    tail = F.array_compact(F.array(
        F.lit(config.DEFAULTS_NOTE),
        F.when(defaults != "", F.concat(F.lit("; REVIEW REQUIRED: defaults used for "), defaults)),
        F.when(F.size("mapping.unmapped") > 0,
               F.concat(F.lit("; REVIEW REQUIRED: unmapped THETA values: "), F.array_join("mapping.unmapped", ", "))),
    ))
    lines = F.flatten(F.array(
        head, thetas, F.array(omega_head), F.when(block, rows).otherwise(diagonal),
        F.array(F.lit("$SIGMA")), F.transform("sigmas", lambda s: F.concat(F.lit(" "), _plain(s["value"]))),
        F.array(F.lit("$PK")), model, F.array(F.col("mapping.scale"), F.lit("$ERROR"), F.lit("Y = F * (1 + ERR(1))")), tail,
    ))
    return F.array_join(lines, "\n")


def _cell(row: Column, col: Column) -> Column:
    hit = F.filter("covariances", lambda c: (c["row_eta"] == row) & (c["col_eta"] == col) & c["converted"]["supported"])
    return F.coalesce(F.try_element_at(hit, F.lit(-1))["converted"]["value"], F.lit(0.0))


def _slot_name(position: Column) -> Column:
    return F.get(template(F.col("mapping.advan"))["names"], position - 1)


def _eta_part(position: Column) -> Column:
    eta = F.concat(F.lit("ETA("), position.cast("string"), F.lit(")"))
    normal = F.get("omegas", position - 1)["distribution"] == "normal"
    return F.when(normal, F.concat(F.lit(" + "), eta)).otherwise(F.concat(F.lit(" * exp("), eta, F.lit(")")))


def map_models(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Enriched rows with mapping, omegas, sigmas, covariances, defaults and the control text."""
    step = map_template(df, F.col("parameters.theta"), F.col("advan"), F.col("trans"))
    step = covariance_cells(map_variability(step, F.col("parameters.omega"), F.col("parameters.sigma")),
                            F.col("parameters.omega_covariance"))
    step = step.withColumn("generated_defaults", generated_defaults())
    step = step.withColumn("control", control_text(X.coalesce_blank("title", "Literature model")))
    return step.select(*keep, *[c for c in step.columns if c not in keep]) if keep else step


def reproduction_plan(df: DataFrame, allow_defaults: bool = False) -> DataFrame:
    """Eligibility, blockers, amount, times and subjects for mapped rows (see ``map_models``)."""
    from claimloom.operators import reproduction as R

    weight = F.try_element_at(F.col("_cov"), F.lit("WT"))
    surface = F.try_element_at(F.col("_cov"), F.lit("BSA"))
    dose = F.get("dosing", F.lit(0))
    base = df.withColumn("_cov", P.covariate_representatives(F.col("population_details.cohorts"))).withColumn("_dose", dose)
    base = base.withColumns({
        "_amount": N.amount_mg(F.col("_dose.amount"), F.col("_dose.amount_unit"), weight, surface),
        "_interval": N.hours(F.col("_dose.interval"), F.col("_dose.interval_unit"), "dose_interval"),
        "_duration": N.hours(F.col("_dose.duration"), F.col("_dose.duration_unit"), "infusion_duration"),
    })
    timed = F.filter(F.coalesce(F.col("reproduction_targets"), F.array().cast(TARGETS)),
                     lambda t: t["kind"] == "concentration_time")
    points = F.flatten(F.transform(timed, lambda t: F.filter(
        t["points"], lambda p: X.finite(p["time"]).isNotNull() & X.finite(p["value"]).isNotNull())))
    blockers = R.plan_blockers(
        F.col("implementation.advan"), F.col("implementation.trans"), F.col("_amount"), F.col("_interval"),
        F.col("_duration"), F.col("_dose.steady_state"), F.col("_dose.administration"), F.lit(None).cast("string"),
        F.size("generated_defaults"), allow_defaults,
    )
    return base.withColumns({
        "blockers": blockers,
        "eligible": F.size(blockers) == 0,
        "scorable": F.coalesce(F.size(points), F.lit(0)) > 0,
        "amount_mg": F.col("_amount.value"),
        "plan_subjects": R.plan_subjects(F.col("population_details.n_total")),
        "times": N.timeline(F.transform(points, lambda p: p["time"]), F.coalesce(F.col("_interval.value"), F.lit(24.0))),
        "covariate_values": F.col("_cov"),
    }).drop("_cov", "_dose", "_amount", "_interval", "_duration")
