"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as X
from claimloom.operators import catalogue, corpus, ledger, scoring, training, triage
from workload import fixtures as fx
from workload.registry import Tables, query


@query("b01_metadata_coalesce", """
SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, split_part(text, chr(10), 1) AS title, '' AS journal, lang AS year,
       CAST(doc_id AS VARCHAR) AS pmcid, CASE WHEN lang = 'en' THEN '10.1/' || doc_id ELSE '' END AS doi, length(text) AS abstract_chars
FROM documents
""")
def metadata_coalesce(spark, sf):
    t = Tables(spark, sf)
    n = F.col("doc_id").cast("string")
    raw = fx.articles(t).select(
        "doc_id", n.alias("pmid"), "title", "abstract", F.lit(None).cast("string").alias("journal"), F.col("lang").alias("year"),
        F.when(F.col("lang") == "en", F.concat(F.lit("10.1/"), n)).alias("doi"),
        F.concat(F.when(F.col("lang") == "fr", F.lit("pmc")).otherwise(F.lit("PMC")), n).alias("pmcid"))
    out = triage.coalesce_metadata(raw)
    return out.select("doc_id", "pmid", "title", "journal", "year", "pmcid", "doi", F.length("abstract").cast("bigint").alias("abstract_chars"))


@query("b02_catalogue_search", f"""
WITH {fx.ENTRIES}
SELECT library_id, title, status, round(confidence_overall, 6) AS confidence FROM entries
WHERE regexp_matches(compound, '(?i)SRC1[0-9]') AND regexp_matches(population, '(?i)E[NS]') AND confidence_overall >= 0.01
  AND advan IN (1, 2, 4) AND lower(model_type) IN ('pk') AND lower(assessment) = 'pass'
  AND (contains(lower(title || ' ' || compound || ' ' || population || ' ' || keywords || ' ' || abstract), 'license worthless')
       OR contains(lower(title || ' ' || compound || ' ' || population || ' ' || keywords || ' ' || abstract), 'license')
       OR contains(lower(title || ' ' || compound || ' ' || population || ' ' || keywords || ' ' || abstract), 'worthless'))
""")
def catalogue_search(spark, sf):
    e = fx.entries(Tables(spark, sf))
    found = catalogue.search(e, "License worthless", compound="SRC1[0-9]", population="E[NS]", min_confidence=0.01, advan=[1, 2, 4],
                             model_type="PK", assessment="Pass")
    return found.select("library_id", "title", "status", fx.r6("confidence_overall").alias("confidence"))


@query("b03_reference_list_filter", f"""
WITH {fx.MODELS}
SELECT reference_id, tier, partition FROM models
WHERE contains(lower(reference_id || ' ' || title || ' ' || compound_group), 'the') AND partition IN ('train', 'validation') AND tier IN ('A', 'D')
  AND compound_group = 'src10'
""")
def reference_list_filter(spark, sf):
    found = corpus.filter_models(fx.models(Tables(spark, sf)), "The", ["train", "validation"], ["A", "D"], "src10")
    return found.select("reference_id", "tier", "partition")


@query("b04_batch_selection", f"""
WITH {fx.MANIFEST} SELECT ord, pmid, triage_tier, acquisition_class FROM manifest
WHERE lower(triage_tier) IN ('high', 'intermediate') AND acquisition_class <> 'skipped'
""")
def batch_selection(spark, sf):
    return triage.select_batch(fx.manifest(Tables(spark, sf)), config.FIRST_PASS_TIERS).select("ord", "pmid", "triage_tier", "acquisition_class")


@query("b05_fetch_worklist", f"""
WITH {fx.MANIFEST} SELECT ord, pmid, acquisition_class, status FROM manifest
WHERE acquisition_class IN ('oa_auto', 'stub') AND status <> 'fetched' AND lower(triage_tier) IN ('high', 'intermediate')
""")
def fetch_worklist(spark, sf):
    return triage.fetch_worklist(fx.manifest(Tables(spark, sf)), ["oa_auto", "stub"]).select("ord", "pmid", "acquisition_class", "status")


@query("b06_legacy_batch_selection", f"""
WITH {fx.MANIFEST} SELECT ord, 'pmid_' || pmid AS entry_id, CAST(pmid AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS skipped
FROM manifest WHERE acquisition_class <> 'skipped'
""")
def legacy_batch_selection(spark, sf):
    t = Tables(spark, sf)
    known = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.concat(F.lit("pmid_"), F.col("c_custkey").cast("string")).alias("library_id"))
    rows = triage.select_batch(fx.manifest(t))
    return triage.split_indexed(rows, known, F.concat(F.lit("pmid_"), F.col("pmid"))).select("ord", "entry_id", "skipped")


@query("b07_evidence_filter", """
SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'click') AND (value < 10 OR trim(CASE WHEN user_id < 50 THEN '  ' ELSE props END) = '')
""")
def evidence_filter(spark, sf):
    t = Tables(spark, sf)
    rows = t.events.select(
        "event_id", "user_id", F.when(F.col("event_type").isin("view", "click"), "reported").otherwise("derived").alias("status"),
        F.when(F.col("value") >= 10, "p1").alias("source_locator"), F.when(F.col("user_id") < 50, "  ").otherwise(F.col("props")).alias("evidence"))
    return ledger.unsupported_claims(rows).select("event_id", "user_id")


@query("b08_active_claims", """
SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND value >= 20
""")
def active_claims(spark, sf):
    t = Tables(spark, sf)
    rows = t.events.select("event_id", "event_type", F.when(F.col("event_type") == "error", "unresolved").otherwise("reported").alias("status"),
                           F.when(F.col("value") < 20, "x").otherwise(" ").alias("superseded_by"))
    return ledger.active_claims(rows).select("event_id", "event_type")


QUAL_ORDERS = """q AS (
  SELECT CAST(o_custkey AS VARCHAR) AS library_id, 'q' || o_orderkey AS qualification_id,
         CASE o_orderstatus WHEN 'O' THEN '' WHEN 'F' THEN '1.0.0' ELSE '2.0.0' END AS model_version,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'q' || (o_orderkey - 1) ELSE '' END AS supersedes, o_orderpriority AS prio,
         CASE WHEN o_orderstatus = 'F' THEN 'qualified' WHEN o_orderpriority LIKE '2%' THEN 'candidate' ELSE 'research_only' END AS status,
         CASE WHEN o_orderpriority LIKE '3%' THEN '' WHEN o_orderpriority LIKE '4%' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS review_due
  FROM orders),
v AS (SELECT CAST(c_custkey AS VARCHAR) AS library_id, CASE WHEN c_acctbal > 4000 THEN '1.0.0' ELSE '2.0.0' END AS version, c_name AS title FROM customer)"""


def qualification_orders(t: Tables):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    q = t.orders.select(
        F.col("o_custkey").cast("string").alias("library_id"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("qualification_id"),
        F.when(s == "O", "").when(s == "F", "1.0.0").otherwise("2.0.0").alias("model_version"),
        F.when(p.startswith("1"), F.concat(F.lit("q"), (F.col("o_orderkey") - 1).cast("string"))).otherwise(F.lit("")).alias("supersedes"),
        F.when(s == "F", "qualified").when(p.startswith("2"), "candidate").otherwise("research_only").alias("status"),
        F.when(p.startswith("3"), F.lit("")).when(p.startswith("4"), F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("review_due"))
    v = t.customer.select(F.col("c_custkey").cast("string").alias("library_id"), F.when(F.col("c_acctbal") > 4000, "1.0.0").otherwise("2.0.0").alias("version"),
                          F.col("c_name").alias("title"))
    return q, v


@query("b09_version_bound_records", f"""
WITH {QUAL_ORDERS} SELECT library_id, qualification_id, model_version FROM q JOIN v USING (library_id) WHERE model_version = '' OR model_version = version
""")
def version_bound_records(spark, sf):
    q, v = qualification_orders(Tables(spark, sf))
    return catalogue.version_bound(q, v).select("library_id", "qualification_id", "model_version")


@query("b10_triage_eligibility", """
SELECT doc_id, quality = 1 AS relevant, CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 'no_model' ELSE 'wrong_aed' END END AS reason
FROM labels WHERE quality = 1 OR toxic = 1
""")
def triage_eligibility(spark, sf):
    t = Tables(spark, sf)
    rows = t.labels.select("doc_id", (F.col("quality") == 1).alias("relevant"),
                           F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "no_model").otherwise("wrong_aed")).alias("reason"))
    return rows.filter(scoring.triage_eligible(F.col("relevant"), F.col("reason")))


@query("b11_training_eligibility", f"""
WITH {fx.MODELS}
SELECT reference_id, tier, CASE WHEN tier NOT IN ('A', 'B') THEN 'tier_not_selected' WHEN NOT training_eligible THEN 'not_training_eligible'
  WHEN lang = 'es' THEN 'source_pdf_missing' WHEN lang = 'fr' THEN 'source_pdf_not_found' ELSE '' END AS reason FROM models
""")
def training_eligibility(spark, sf):
    m = fx.models(Tables(spark, sf))
    reason = training.extraction_reason(F.col("tier"), F.col("training_eligible"), F.when(F.col("lang") != "es", F.col("title")),
                                        F.when(F.col("lang") != "fr", F.col("abstract")), ["A", "B"])
    return m.select("reference_id", "tier", reason.alias("reason"))


@query("b12_triage_example_eligibility", f"""
WITH {fx.MODELS}
SELECT reference_id, CASE WHEN NOT (quality = 1 OR (quality = 0 AND toxic = 1)) THEN 'ambiguous_or_query_specific_label' WHEN lang = 'de' THEN 'abstract_missing' ELSE '' END AS reason
FROM models WHERE quality IS NOT NULL
""")
def triage_example_eligibility(spark, sf):
    m = fx.models(Tables(spark, sf)).filter(F.col("quality").isNotNull())
    reason = training.triage_reason(F.col("quality") == 1, F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "no_pkpd").otherwise("other"),
                                    F.when(F.col("lang") == "de", F.lit(" ")).otherwise(F.col("abstract")))
    return m.select("reference_id", reason.alias("reason"))


@query("b13_locked_test_guard", f"""
WITH {fx.MODELS} SELECT reference_id, partition, tier FROM models WHERE partition IN ('train', 'validation') AND tier IN ('A', 'B')
""")
def locked_test_guard(spark, sf):
    partitions, tiers = ["train", "validation"], ["A", "B"]
    training.check_request(partitions, tiers)
    m = fx.models(Tables(spark, sf)).filter(F.col("partition").isin(*partitions) & F.col("tier").isin(*tiers))
    locked = F.when(F.col("partition") == "test", F.raise_error(F.lit("locked test record")).cast("string")).otherwise(F.col("partition"))
    return m.select("reference_id", locked.alias("partition"), "tier")


@query("b14_material_domains", """
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'structure' END, CASE WHEN o_totalprice > 100000 THEN 'theta' END,
  CASE WHEN o_totalprice > 400000 THEN 'omega' END, CASE WHEN o_orderpriority LIKE '1%' OR o_orderstatus = 'P' THEN 'sigma' END,
  CASE WHEN o_orderpriority LIKE '2%' THEN 'covariates' END, CASE WHEN o_orderpriority LIKE '3%' THEN 'population' END,
  CASE WHEN o_orderstatus = 'O' THEN 'dosing' END, CASE WHEN o_custkey < 100 THEN 'reproduction' END) AS domains FROM orders
""")
def material_domains(spark, sf):
    from claimloom.plans import semantics as S

    t = Tables(spark, sf)
    p, s, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    theta = F.when(price > 100000, F.array(F.struct(F.lit("CL").alias("name"), price.alias("typical")))).cast(S.THETA)
    omega = F.when(price > 400000, F.array(F.lit(None).cast(S.OMEGA.removeprefix("array<").removesuffix(">")))).cast(S.OMEGA)
    sigma = F.when(s == "P", F.array(F.lit(None).cast(S.SIGMA.removeprefix("array<").removesuffix(">")))).cast(S.SIGMA)
    parameters = F.struct(theta.alias("theta"), omega.alias("omega"), F.lit(None).cast(S.COVARIANCE).alias("omega_covariance"), sigma.alias("sigma"))
    x = F.struct(
        F.when(s == "F", F.lit(2)).alias("advan"), F.lit(None).cast("int").alias("trans"), F.lit(None).cast("int").alias("compartments"),
        F.lit(" ").alias("description"), parameters.alias("parameters"), F.when(p.startswith("1"), F.lit("Y")).alias("residual_error"),
        F.when(p.startswith("2"), F.array(F.lit("WT"))).otherwise(X.literal_array([])).alias("covariates"),
        F.lit(None).cast("string").alias("population"), F.when(p.startswith("3"), price).alias("n_subjects"),
        F.struct(X.literal_array([]).alias("cohorts")).alias("population_details"), F.when(s == "O", F.lit("oral")).alias("route"),
        X.literal_array([]).alias("dosing"), F.when(F.col("o_custkey") < 100, F.array(F.lit(1))).alias("reproduction_targets"))
    return t.orders.withColumn("x", x).select("o_orderkey", F.array_join(ledger.material_domains(F.col("x")), ",").alias("domains"))
