"""Table schemas and the typed contracts of every response kind (fixed formats)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------- tables

MANIFEST_CSV = T.StructType([
    T.StructField("pmid", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("pmcid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("publisher", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("suggested_url", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("acquisition_class", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("relevance_score", T.IntegerType()),
    T.StructField("relevance_keywords", T.StringType()),
    T.StructField("triage_probability", T.DoubleType()),
    T.StructField("recoverability_probability", T.DoubleType()),
    T.StructField("triage_tier", T.StringType()),
    T.StructField("triage_action", T.StringType()),
    T.StructField("triage_method", T.StringType()),
    T.StructField("triage_provider", T.StringType()),
    T.StructField("triage_model", T.StringType()),
    T.StructField("triage_evidence", T.StringType()),
    T.StructField("triage_uncertainty", T.StringType()),
    T.StructField("is_oa", T.BooleanType()),
    T.StructField("has_abstract", T.BooleanType()),
    T.StructField("local_path", T.StringType()),
])

CATALOGUE_JSON = (
    "schema_version string, library_id string, version string, status string, title string, "
    "created_at string, updated_at string, "
    "model struct<artifact:string,advan:int,trans:int,type:string,generated_suggestion:boolean,"
    "validation_error:string>, "
    "study struct<compound:string,population:string,keywords:array<string>,abstract:string>, "
    "confidence struct<overall:double>, "
    "provenance struct<pmid:string,doi:string,document_bundle:string,evidence_ledger:string>, "
    "qualification struct<mapping_review_required:boolean,"
    "gate:struct<ready:boolean,blockers:array<string>>,"
    "automated_assessment:struct<verdict:string>,reproduction:struct<status:string>,"
    "clinical_use:array<struct<qualification_id:string,status:string,supersedes:string,"
    "model_version:string,review_due:string>>>, "
    "relations struct<prior_version:array<string>>, "
    "_corrupt_record string"
)

ARTICLE_XML = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,"
    "Abstract:struct<AbstractText:array<string>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>>>, "
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)

TRAINING_JSON = (
    "id string, task string, partition string, "
    "leakage_guard struct<test_data:boolean,target_absent_from_user_message:boolean>, "
    "quality_tier string, messages array<struct<role:string,content:string>>"
)

# ---------------------------------------------------------------- contracts

TEXT = {"type": "string"}
TEXT_OR_NULL = {"type": ["string", "null"]}
NUMBER = {"type": "number"}
NUMBER_OR_NULL = {"type": ["number", "null"]}
INT = {"type": "integer"}
INT_OR_NULL = {"type": ["integer", "null"]}
FLAG = {"type": "boolean"}
SHARE = {"type": "number", "minimum": 0, "maximum": 1}


def one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def listing(items: dict, most: int | None = None) -> dict:
    spec = {"type": "array", "items": items}
    if most is not None:
        spec["maxItems"] = most
    return spec


def record(closed: bool = True, **fields: dict) -> dict:
    """An object whose fields are all required; unknown fields are rejected when closed."""
    spec = {"type": "object", "properties": fields, "required": list(fields)}
    if closed:
        spec["additionalProperties"] = False
    return spec


SOURCE = record(
    status=one_of("reported", "derived", "inferred", "unresolved", "missing"),
    source_locator=TEXT, evidence=TEXT, confidence=SHARE,
)
STATISTIC = record(
    type=one_of("mean_sd", "mean_se", "median_range", "median_quantiles", "quantiles", "range",
                "geometric_mean_cv", "count_proportion", "individual_values", "reported_center"),
    mean=NUMBER_OR_NULL, sd=NUMBER_OR_NULL, se=NUMBER_OR_NULL, median=NUMBER_OR_NULL,
    minimum=NUMBER_OR_NULL, maximum=NUMBER_OR_NULL, value=NUMBER_OR_NULL, statistic=TEXT_OR_NULL,
    cv_percent=NUMBER_OR_NULL, count=NUMBER_OR_NULL, proportion=NUMBER_OR_NULL,
    quantiles=listing(record(probability=NUMBER, value=NUMBER)), values=listing(NUMBER),
)
POPULATION = record(
    raw=TEXT_OR_NULL, n_total=NUMBER_OR_NULL,
    cohorts=listing(record(
        id=TEXT, label=TEXT, role=TEXT,
        n=record(enrolled=INT_OR_NULL, dosed=INT_OR_NULL, analysed=INT_OR_NULL),
        health_status=TEXT, country=TEXT_OR_NULL,
        descriptors=listing(record(
            name=TEXT, unit=TEXT_OR_NULL, statistics=listing(STATISTIC, 8),
            categories=listing(record(label=TEXT, count=INT_OR_NULL, proportion=NUMBER_OR_NULL), 30),
            source=SOURCE,
        ), 30),
        pharmacogenetics=listing(record(
            gene=TEXT, variant=TEXT_OR_NULL, diplotype=TEXT_OR_NULL, phenotype=TEXT_OR_NULL,
            n=INT_OR_NULL, proportion=NUMBER_OR_NULL, assay=TEXT_OR_NULL, source=SOURCE,
        ), 30),
        source=SOURCE,
    ), 12),
    assumptions=listing(TEXT, 20), source=SOURCE,
)
DOSING = listing(record(
    cohort_id=TEXT, route=TEXT_OR_NULL, administration=TEXT, amount=NUMBER_OR_NULL, amount_unit=TEXT_OR_NULL,
    interval=NUMBER_OR_NULL, interval_unit=TEXT_OR_NULL, duration=NUMBER_OR_NULL, duration_unit=TEXT_OR_NULL,
    repetitions=INT_OR_NULL, steady_state=FLAG, raw=TEXT_OR_NULL, source=SOURCE,
), 30)
STRUCTURAL = record(
    advan=INT_OR_NULL, trans=INT_OR_NULL, compartments=INT_OR_NULL, description=TEXT,
    canonical=record(
        compartments=record(count=INT_OR_NULL, names=listing(TEXT)),
        input=record(route=TEXT_OR_NULL, process=TEXT, depot=FLAG),
        elimination={"type": "object", "additionalProperties": False, "required": ["type", "from"],
                     "properties": {"type": TEXT, "from": TEXT}},
        parameterization=record(type=TEXT, parameters=listing(TEXT)),
        description=TEXT,
    ),
    implementations=listing(record(
        engine=TEXT, advan=INT_OR_NULL, trans=INT_OR_NULL,
        status=one_of("reported", "derived", "inferred", "unresolved"), confidence=SHARE, rationale=TEXT,
        evidence=SOURCE, alternatives=listing(record(advan=INT_OR_NULL, trans=INT_OR_NULL, reason=TEXT)),
        review_required=FLAG,
    )),
)
REPRODUCTION_TARGETS = listing(record(
    id=TEXT, kind=one_of("concentration_time", "concentration_distribution", "pk_summary", "other"),
    source_type=one_of("figure", "table", "text", "supplement"), source_locator=TEXT, cohort_id=TEXT_OR_NULL,
    analyte=TEXT_OR_NULL, statistic=TEXT, x_unit=TEXT_OR_NULL, y_unit=TEXT_OR_NULL,
    scale=one_of("linear", "log", "unknown"),
    points=listing(record(closed=False, time=NUMBER_OR_NULL, value=NUMBER, lower=NUMBER_OR_NULL,
                          upper=NUMBER_OR_NULL), 250),
    evidence=TEXT, confidence=SHARE,
), 30)
PARAMETERS = record(
    theta=listing(record(name=TEXT, typical=NUMBER_OR_NULL, se=NUMBER_OR_NULL, unit=TEXT_OR_NULL)),
    omega=listing(record(
        description=TEXT, parameter=TEXT, eta_index=INT_OR_NULL,
        eta_distribution=one_of("log_normal", "normal", "other", "unknown"), eta_expression=TEXT_OR_NULL,
        variability_level=one_of("iiv", "iov", "other", "unknown"), reported_value=NUMBER_OR_NULL,
        reported_metric=one_of("variance", "sd", "cv_percent", "cv_fraction", "approximate_cv_percent", "unknown"),
        value=NUMBER_OR_NULL, conversion=TEXT,
    )),
    omega_covariance=listing(record(
        row_eta=INT, col_eta=INT, reported_value=NUMBER_OR_NULL,
        reported_metric=one_of("covariance", "correlation", "unknown"), value=NUMBER_OR_NULL, conversion=TEXT,
    )),
    sigma=listing(record(
        description=TEXT,
        error_model=one_of("additive", "proportional", "combined", "log_additive", "other", "unknown"),
        reported_value=NUMBER_OR_NULL,
        reported_metric=one_of("variance", "sd", "cv_percent", "cv_fraction", "unknown"),
        value=NUMBER_OR_NULL, conversion=TEXT,
    )),
)
EXTRACTION = record(
    title=TEXT, compound=TEXT_OR_NULL, population=TEXT_OR_NULL, population_details=POPULATION,
    route=TEXT_OR_NULL, n_subjects=NUMBER_OR_NULL, dosing=DOSING, software=TEXT_OR_NULL,
    estimation_method=TEXT_OR_NULL, model_type=TEXT_OR_NULL, structural_model=STRUCTURAL,
    parameters=PARAMETERS, covariates=listing(TEXT, 50), residual_error=TEXT_OR_NULL,
    reproduction_targets=REPRODUCTION_TARGETS,
    confidence=record(overall=NUMBER, fields=record(structure=NUMBER, parameters=NUMBER, population=NUMBER,
                                                    software=NUMBER)),
    evidence_quotes=listing(TEXT, 30), notes=TEXT,
)
RECOVERABILITY = record(overall=SHARE, structure=SHARE, parameters=SHARE, variability=SHARE, covariates=SHARE,
                        data=SHARE)
EVIDENCE_ITEM = record(field=TEXT, value=TEXT_OR_NULL, source_locator=TEXT, evidence=TEXT, confidence=SHARE)
BOUND_EVIDENCE_ITEM = record(field=TEXT, value=TEXT_OR_NULL, source_locator=TEXT, evidence=TEXT, confidence=SHARE,
                             claim_ids=listing(TEXT, 12))


def lane(evidence_item: dict) -> dict:
    return record(
        model_present=FLAG, model_probability=SHARE, recoverability=RECOVERABILITY, extraction=EXTRACTION,
        field_evidence=listing(evidence_item, 20), limitations=listing(TEXT, 20),
    )


CLAIM = record(
    id=TEXT,
    domain=one_of("structure", "theta", "omega", "sigma", "covariates", "population", "dosing", "reproduction",
                  "other"),
    field=TEXT, value=TEXT_OR_NULL, unit=TEXT_OR_NULL,
    status=one_of("reported", "derived", "inferred", "unresolved"),
    model_stage=one_of("base", "intermediate", "final", "validation", "bootstrap", "external", "unknown"),
    source_locator=TEXT, evidence=TEXT, confidence=SHARE, dependencies=listing(TEXT), alternatives=listing(TEXT),
)
QUESTION = record(id=TEXT, field=TEXT, question=TEXT, priority=one_of("low", "medium", "high", "critical"),
                  search_terms=listing(TEXT))

CONTRACTS = {
    "triage": record(
        relevant_probability=SHARE, recoverable_probability=SHARE,
        model_categories=listing(one_of("pk", "pd", "pkpd", "exposure_response", "disease_progression", "mbma",
                                        "other")),
        positive_signals=listing(TEXT), negative_signals=listing(TEXT), evidence=listing(TEXT),
        uncertainty=listing(TEXT), rationale=TEXT,
    ),
    "extraction": EXTRACTION,
    "assessment": record(
        verdict=one_of("pass", "needs_review", "reject"), confidence=NUMBER, supported_fields=listing(TEXT),
        discrepancies=listing(record(field=TEXT, proposed=TEXT_OR_NULL, evidence=TEXT_OR_NULL,
                                     severity=one_of("minor", "major"))),
        missing_evidence=listing(TEXT), recommended_status=one_of("stub", "draft", "review"), summary=TEXT,
    ),
    "lane": lane(EVIDENCE_ITEM),
    "bound_lane": lane(BOUND_EVIDENCE_ITEM),
    "adjudication": record(
        model_present=FLAG, resolved_extraction=EXTRACTION,
        decisions=listing(record(field=TEXT, selected=one_of("text", "vision", "neither", "equivalent"),
                                 resolved_value=TEXT_OR_NULL, source_locator=TEXT, evidence=TEXT, rationale=TEXT)),
        unresolved_fields=listing(record(field=TEXT, impact=one_of("minor", "major"), reason=TEXT)),
        confidence=SHARE, summary=TEXT,
    ),
    "reconnaissance": record(
        model_present=FLAG, model_probability=SHARE,
        model_inventory=listing(record(
            id=TEXT, label=TEXT,
            role=one_of("base", "intermediate", "final", "validation", "external", "unknown"),
            compound=TEXT_OR_NULL, endpoint=TEXT_OR_NULL, source_locator=TEXT, evidence=TEXT, confidence=SHARE,
        ), 20),
        anchor_claims=listing(CLAIM, 40),
        hypotheses=listing(record(
            id=TEXT, description=TEXT, status=one_of("candidate", "supported", "rejected", "unresolved"),
            confidence=SHARE, supporting_claim_ids=listing(TEXT), contradicting_claim_ids=listing(TEXT),
        ), 20),
        investigation_questions=listing(QUESTION, 30),
        relevant_sections=listing(record(topic=TEXT, source_locator=TEXT, reason=TEXT), 30),
        referenced_sources=listing(record(kind=TEXT, citation=TEXT, reason=TEXT,
                                          required_for_reconstruction=FLAG), 20),
    ),
    "investigation": record(
        topic=TEXT, claims=listing(CLAIM, 60), resolved_question_ids=listing(TEXT),
        new_questions=listing(QUESTION, 20),
        contradictions=listing(record(claim_id=TEXT_OR_NULL, description=TEXT, source_locator=TEXT, evidence=TEXT,
                                      severity=one_of("minor", "major")), 20),
        coverage=SHARE, summary=TEXT,
    ),
    "falsification": record(
        verdicts=listing(record(claim_id=TEXT, verdict=one_of("supported", "contradicted", "uncertain"),
                                corrected_value=TEXT_OR_NULL, source_locator=TEXT, evidence=TEXT, reason=TEXT), 100),
        missing_critical=listing(QUESTION, 30), follow_up_queries=listing(QUESTION, 30),
        resolved_question_ids=listing(TEXT, 100), overall_ready=FLAG, summary=TEXT,
    ),
    "claim": CLAIM,
    "question": QUESTION,
}


def spark_type(spec: dict, whole: T.DataType | None = None) -> T.DataType:
    """The Spark type of a contract; ``whole`` is the type of its integers (BIGINT unless another is asked for)."""
    types = spec.get("type", [])
    types = [types] if isinstance(types, str) else list(types)
    if "object" in types:
        return T.StructType([T.StructField(name, spark_type(child, whole)) for name, child in spec["properties"].items()])
    if "array" in types:
        return T.ArrayType(spark_type(spec["items"], whole))
    simple = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "integer": whole or T.LongType()}
    return next(simple[t] for t in types if t != "null")


def contract_rules(kind: str) -> list[tuple[str, str, str, str]]:
    """The contract as flat rules (kind, path, rule, argument); '[]' stands for any element."""
    rules: list[tuple[str, str, str, str]] = []

    def walk(spec: dict, path: str) -> None:
        types = spec.get("type", [])
        rules.append((kind, path, "type", "|".join([types] if isinstance(types, str) else types)))
        if "enum" in spec:
            rules.append((kind, path, "enum", "|".join(spec["enum"])))
        for name in ("minimum", "maximum", "maxItems"):
            if name in spec:
                rules.append((kind, path, name, str(spec[name])))
        for name in spec.get("required", []):
            rules.append((kind, path, "required", name))
        if spec.get("additionalProperties") is False:
            rules.append((kind, path, "closed", "true"))
        for name, child in spec.get("properties", {}).items():
            walk(child, f"{path}.{name}")
        if "items" in spec:
            walk(spec["items"], f"{path}[]")

    walk(CONTRACTS[kind], "response")
    return rules


def rule_table(spark: SparkSession, kinds: list[str] | None = None) -> DataFrame:
    """Every contract rule as rows; its size is fixed by the contracts, so it can be broadcast."""
    rows = [rule for kind in (kinds or CONTRACTS) for rule in contract_rules(kind)]
    return spark.createDataFrame(rows, "kind string, path string, rule string, argument string")
