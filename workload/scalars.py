"""Scalar functions over whole tables: text, numbers, hashes, versions, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions import jsontools as J
from claimloom.functions import numbers as N
from claimloom.functions import parsing as P
from claimloom.functions import text as X
from claimloom.operators import chunks, claims, ledger, reproduction, training, triage
from claimloom.plans import plugins, semantics
from workload import fixtures as fx
from workload.registry import Tables, query

R6 = fx.r6


@query("h01_squeezed_text", f"SELECT doc_id, md5({fx.sql_squeeze('text')}) AS text_md5 FROM documents")
def squeezed_text(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.md5(X.squeeze("text")).alias("text_md5"))


@query("h02_normalised_text", f"SELECT doc_id, md5({fx.sql_normal('text')}) AS text_md5 FROM documents")
def normalised_text(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.md5(X.normalise("text")).alias("text_md5"))


@query("h03_compound_alias", """
SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'cbz' WHEN 'ECONOMY' THEN 'vpa' WHEN 'PROMO' THEN 'phb' ELSE lower(p_type) END AS code FROM part
""")
def compound_alias(spark, sf):
    name = F.when(F.col("p_type") == "STANDARD", "Carbamazepine").when(F.col("p_type") == "ECONOMY", " Valproic-ACID ").when(F.col("p_type") == "PROMO", "phenobarbitone").otherwise(F.col("p_type"))
    return Tables(spark, sf).part.select("p_partkey", X.compound_code(name).alias("code"))


@query("h04_doi_normaliser", """
SELECT page_id, regexp_replace(trim(url), '(?i)^https?://(m\\.|www\\.)?', '') AS host_path, regexp_replace(trim(' HTTPS://DX.doi.org/10.1/' || page_id || ' '), '(?i)^https?://(dx\\.)?doi\\.org/', '') AS doi FROM pages
""".replace("\\\\", "\\"))
def doi_normaliser(spark, sf):
    p = Tables(spark, sf).pages
    return p.select("page_id", F.regexp_replace(F.trim("url"), r"(?i)^https?://(m\.|www\.)?", "").alias("host_path"),
                    X.strip_doi_url(F.concat(F.lit(" HTTPS://DX.doi.org/10.1/"), F.col("page_id").cast("string"), F.lit(" "))).alias("doi"))


@query("h05_citation_key", """
SELECT o_orderkey, CAST(1000000 + o_orderkey AS VARCHAR) AS pmid, CASE WHEN o_orderstatus = 'F' THEN CAST(year(o_orderdate) AS VARCHAR) ELSE '' END AS year,
  CASE WHEN o_orderstatus = 'F' THEN 'Smith 1950b ' || o_custkey % 10 ELSE 'Smith et al. ' || o_custkey % 10 END AS first_author FROM orders
""")
def citation_key(spark, sf):
    digit = (F.col("o_custkey") % 10).cast("string")
    n = (F.col("o_orderkey") + 1000000).cast("string")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Smith 1950b\n"), digit, F.lit(" "), F.year("o_orderdate").cast("string"), F.lit("  "), n, F.lit(" 7654321"))).otherwise(
        F.concat(F.lit(" Smith et al. "), digit, F.lit("\t"), n))
    return Tables(spark, sf).orders.select("o_orderkey", X.citation_key(text).alias("k")).select("o_orderkey", "k.pmid", "k.year", "k.first_author")


@query("h06_route_detector", f"""
SELECT doc_id, CASE WHEN regexp_matches(lower({fx.sql_squeeze('text')}), 'intravenous|i[.]v[.]') THEN 'intravenous' WHEN regexp_matches(lower({fx.sql_squeeze('text')}), 'oral|per os') THEN 'oral'
  WHEN regexp_matches(lower({fx.sql_squeeze('text')}), 'subcutaneous|s[.]c[.]') THEN 'subcutaneous' END AS route FROM documents
""")
def route_detector(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", P.route("text").alias("route"))


@query("h07_subject_count", r"""
SELECT doc_id, try_cast(nullif(regexp_extract(text, '(?i)(?:^|[^A-Za-z])N\s*[:=]\s*([0-9]+)', 1), '') AS DOUBLE) AS n_in_text,
  CASE WHEN lang = 'en' THEN n_chars::DOUBLE END AS n_planted FROM documents
""")
def subject_count(spark, sf):
    planted = F.concat(F.when(F.col("lang") == "en", F.lit("Adults, n = ")).otherwise(F.lit("mean: ")), F.col("n_chars").cast("string"))
    return Tables(spark, sf).documents.select("doc_id", P.subject_count("text").alias("n_in_text"), P.subject_count(planted).alias("n_planted"))


@query("h08_compartment_count", """
SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 WHEN 'PROMO' THEN 3 END AS compartments FROM part
""")
def compartment_count(spark, sf):
    text = F.concat(F.col("p_name"), F.when(F.col("p_type") == "STANDARD", " a One-Compartment fit").when(F.col("p_type") == "ECONOMY", ": 2 compartment").when(F.col("p_type") == "PROMO", " threecompartment").otherwise(" 4-compartment"))
    return Tables(spark, sf).part.select("p_partkey", P.compartments(text).alias("compartments"))


def equation_text():
    size = F.col("p_size").cast("string")
    return F.concat(F.lit("CL = THETA1 * exp(ETA(1)); V/F = theta 2 + ETA(2); KA=THETA"), size, F.lit("; X = theta1; Cobs = F*(1 + EPS1) + "),
                    F.when(F.col("p_type") == "PROMO", F.lit("EPS2")).otherwise(F.lit("0")))


@query("h09_parameter_name_map", """
SELECT p_partkey, 'CL' AS theta1, 'V/F' AS theta2, CASE WHEN p_size > 2 THEN 'KA' END AS theta_own FROM part
""")
def parameter_name_map(spark, sf):
    m = P.parameter_names(equation_text())
    own = F.when(F.col("p_size") > 2, F.try_element_at(m, F.col("p_size").cast("string")))
    return Tables(spark, sf).part.select("p_partkey", F.try_element_at(m, F.lit("1")).alias("theta1"), F.try_element_at(m, F.lit("2")).alias("theta2"), own.alias("theta_own"))


@query("h10_eta_distribution", """
SELECT p_partkey, 'log_normal' AS eta1, 'normal' AS eta2, CASE WHEN p_size = 1 THEN 'log_normal' WHEN p_size = 2 THEN 'normal' ELSE 'unknown' END AS eta_own FROM part
""")
def eta_distribution(spark, sf):
    e = equation_text()
    return Tables(spark, sf).part.select("p_partkey", P.eta_distribution(e, F.lit(1)).alias("eta1"), P.eta_distribution(e, F.lit(2)).alias("eta2"), P.eta_distribution(e, F.col("p_size")).alias("eta_own"))


@query("h11_error_model", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'combined' WHEN 'SMALL' THEN 'additive' WHEN 'LARGE' THEN 'unknown' ELSE 'proportional' END AS error_model FROM part
""")
def error_model(spark, sf):
    text = F.when(F.col("p_type") == "SMALL", F.lit("Y = F + ERR(1)")).when(F.col("p_type") == "LARGE", F.col("p_name")).otherwise(equation_text())
    return Tables(spark, sf).part.select("p_partkey", P.error_model(text).alias("error_model"))


@query("h12_parameter_list", """
SELECT p_partkey, 'CL=' || p_size || ';V/F=2' AS thetas, '1=0.25;2=0.5' AS omegas, '3,1=-0.01' AS covariances, 'proportional=0.04' AS sigmas FROM part WHERE p_type <> 'PROMO'
UNION ALL SELECT p_partkey, 'CL=' || p_size || ';V/F=2', '1=0.25;2=0.5', '3,1=-0.01', 'combined=0.04' FROM part WHERE p_type = 'PROMO'
""")
def parameter_list(spark, sf):
    values = F.concat(F.lit("Theta2 = 2, OMEGA 2=.5 theta1="), F.col("p_size").cast("string"), F.lit(" omega1 = 2.5e-1 omega1,3=-0.01 Sigma1=0.04"))
    rows = Tables(spark, sf).spread("part").select("p_partkey", P.parameters(values, equation_text()).alias("p"))
    num = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    join = lambda a, f: F.array_join(F.transform(a, f), ";")
    return rows.select(
        "p_partkey", join("p.theta", lambda t: F.concat_ws("=", t["name"], num(t["typical"]))).alias("thetas"),
        join("p.omega", lambda o: F.concat_ws("=", o["eta_index"].cast("string"), num(o["value"]))).alias("omegas"),
        join("p.omega_covariance", lambda c: F.concat(c["row_eta"].cast("string"), F.lit(","), c["col_eta"].cast("string"), F.lit("="), num(c["value"]))).alias("covariances"),
        join("p.sigma", lambda s: F.concat_ws("=", s["error_model"], num(s["value"]))).alias("sigmas"))


@query("h13_covariate_list", """
SELECT p_partkey, lower(p_type) || '|age' AS tested, CASE WHEN p_size > 25 THEN 'wt|' || p_name ELSE '' END AS included FROM part
""")
def covariate_list(spark, sf):
    text = F.concat(F.lit("Tested: "), F.lower("p_type"), F.lit("; age , "), F.lower("p_type"), F.lit("\nIncluded : "), F.when(F.col("p_size") > 25, F.concat(F.lit("wt, "), "p_name")).otherwise(F.lit("None")))
    rows = Tables(spark, sf).part.select("p_partkey", P.covariate_lists(text).alias("c"))
    return rows.select("p_partkey", F.array_join("c.tested", "|").alias("tested"), F.array_join("c.included", "|").alias("included"))


@query("h14_record_id", """
SELECT o_orderkey, 'ref_' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')) || '_' || o_custkey || '_m' || CASE WHEN o_orderkey < 10 THEN '0' ELSE '' END || o_orderkey AS reference_id FROM orders
""")
def record_id(spark, sf):
    return Tables(spark, sf).orders.select("o_orderkey", X.record_id("ref", "o_orderpriority", F.col("o_custkey").cast("string"), F.col("o_orderkey")).alias("reference_id"))


@query("h15_valid_id", """
SELECT c_custkey, false AS raw_ok, true AS clean_ok, regexp_replace(c_name, '#', '_') AS entry_id FROM customer
""")
def valid_id(spark, sf):
    clean = F.replace(F.col("c_name"), F.lit("#"), F.lit("_"))
    return Tables(spark, sf).customer.select("c_custkey", X.valid_id("c_name").alias("raw_ok"), X.valid_id(clean).alias("clean_ok"), X.checked_id(clean).alias("entry_id"))


@query("h16_relative_path", """
SELECT page_id, CASE WHEN url LIKE 'http:/%' THEN substr(url, 7) END AS relative FROM pages
""")
def relative_path(spark, sf):
    return Tables(spark, sf).pages.select("page_id", X.relative_path("url", "HTTP:/", strict=False).alias("relative"))


@query("h17_relevance_score", f"""
SELECT doc_id, {fx.sql_score('text')} AS score, array_to_string(list_filter(['license', 'worthless', 'keit', 'mente', 'ment', 'und', 'ation', 'thou', 'the'], lambda k: contains(lower(text), k)), '; ') AS keywords FROM documents
""")
def relevance_score(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", X.keyword_score("text", fx.WORDS).alias("score"), F.array_join(X.contained_keywords("text", fx.WORDS), "; ").alias("keywords"))


@query("h18_whole_word_count", """
WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^0-9a-z_]+') AS toks FROM documents)
SELECT doc_id, len(list_filter(toks, lambda x: x = 'the')) AS n_the, len(list_filter(toks, lambda x: x = 'und')) AS n_und, len(list_filter(toks, lambda x: x = 'license')) AS n_license FROM w
""")
def whole_word_count(spark, sf):
    count = lambda w: X.whole_word_count("text", w).cast("bigint").alias(f"n_{w}")
    return Tables(spark, sf).documents.select("doc_id", count("the"), count("und"), count("license"))


@query("h19_chunk_format", r"""
WITH d AS (SELECT doc_id, text, length(text) AS n, unnest(range(1, CAST(ceil(greatest(length(text) - 4200, 0) / 3850.0) AS BIGINT) + 2)) AS i FROM documents WHERE regexp_matches(text, '\S')),
s AS (SELECT *, (i - 1) * 3850 + 1 AS start FROM d)
SELECT doc_id, md5(string_agg('=== C' || lpad(CAST(i AS VARCHAR), 3, '0') || ' | characters ' || start || '-' || least(n, start + 4199) || ' ===' || chr(10) || substr(text, start, 4200), chr(10) || chr(10) ORDER BY i)) AS block_md5
FROM s GROUP BY doc_id
""")
def chunk_format(spark, sf):
    d = Tables(spark, sf).documents
    text = chunks.unix_lines(F.col("text"))
    windows = F.transform(chunks.chunk_spans(text), lambda s: F.struct(
        chunks.chunk_id(s["idx"]).alias("chunk_id"), chunks.span_locator(s).alias("locator"),
        chunks.span_text(text, s).alias("chunk_text")))
    return d.filter(F.col("text").rlike(r"\S")).select("doc_id", F.md5(chunks.format_chunks(windows)).alias("block_md5"))


@query("h20_message_flatten", """
SELECT conv_id, md5(string_agg(CASE WHEN role = 'system' THEN '[image]' ELSE text END, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1
""")
def message_flatten(spark, sf):
    m = Tables(spark, sf).conversations.select("conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("content"))
    return plugins.message_text(m, ["conv_id"], "turn").select("conv_id", F.md5("text").alias("text_md5"))


@query("h21_prompt_assembly", f"""
WITH {fx.ARTICLES} SELECT doc_id, md5('=== METADATA ===' || chr(10) || 'PMID: ' || pmid || chr(10) || 'Title: ' || title || chr(10) || 'DOI: ' || chr(10) || 'Abstract: ' || title || chr(10) || chr(10)
 || CASE WHEN lang = 'fr' THEN '=== SUPPLEMENT / CONTROL STREAM ===' || chr(10) || compound || chr(10) || chr(10) ELSE '' END
 || CASE WHEN lang = 'en' THEN '=== ARTICLE TEXT ===' || chr(10) || abstract ELSE '=== ARTICLE TEXT ===' || chr(10) || 'Not available. Use metadata only and keep confidence low.' || chr(10) END) AS prompt_md5 FROM articles
""")
def prompt_assembly(spark, sf):
    a = fx.articles(Tables(spark, sf))
    prompt = training.extraction_prompt(F.col("pmid"), F.col("title"), F.lit(None).cast("string"), F.col("title"), F.when(F.col("lang") == "en", F.col("abstract")), F.when(F.col("lang") == "fr", F.col("compound")))
    return a.select("doc_id", F.md5(prompt).alias("prompt_md5"))


@query("h22_metric_name", """
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type || ' (' || p_size || '%)')), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS metric, 'unknown' AS blank FROM part
""")
def metric_name(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", X.metric_name(F.concat("p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit("%)"))).alias("metric"), X.metric_name(F.lit(" % ")).alias("blank"))


@query("h23_summary_statistic", """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'mean_sd:' || p_size || '±2|range:1-9' WHEN p_type = 'SMALL' THEN 'range:1-14' WHEN p_type = 'LARGE' THEN 'reported_center:' || p_size ELSE '' END AS statistics FROM part
""")
def summary_statistic(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_type") == "PROMO", F.concat(size, F.lit(" +/- 2 (1 – 9)"))).when(F.col("p_type") == "SMALL", F.concat(size, F.lit(" (1 to 14)"))).when(F.col("p_type") == "LARGE", F.concat(F.lit("about "), size)).otherwise(F.lit("none"))
    num = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    shown = F.transform(P.summary_statistics(text), lambda s: F.concat(s["type"], F.lit(":"), F.coalesce(
        F.concat(num(s["mean"]), F.lit("±"), num(s["sd"])), F.concat(num(s["minimum"]), F.lit("-"), num(s["maximum"])), num(s["value"]))))
    return Tables(spark, sf).part.select("p_partkey", F.array_join(shown, "|").alias("statistics"))


def cohort_text():
    size = F.col("p_size").cast("string")
    return F.when(F.col("p_type") == "PROMO", F.concat(F.lit("Healthy adults N: "), size, F.lit(" Age: 30 ± 4 (20-40) WT: 70 CYP2C9 and cyp3a4 patients. Elderly n = 7 Age 71"))).when(
        F.col("p_type") == "SMALL", F.concat(F.lit("N="), size, F.lit(" Weight: 55 (40-70)"))).otherwise(F.lit("patients of one site"))


@query("h24_cohort_segmentation", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Healthy adults=N: ' || p_size || ' Age: 30 ± 4 (20-40) WT: 70 CYP2C9 and cyp3a4 patients.|Elderly=n = 7 Age 71' WHEN 'SMALL' THEN 'overall=N=' || p_size || ' Weight: 55 (40-70)' ELSE 'overall=patients of one site' END AS segments FROM part
""")
def cohort_segmentation(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", F.array_join(F.transform(P.population_segments(cohort_text()), lambda s: F.concat_ws("=", s["label"], s["text"])), "|").alias("segments"))


@query("h25_population_normalise", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN p_size + 7.0::DOUBLE WHEN 'SMALL' THEN p_size::DOUBLE ELSE 99.0::DOUBLE END AS n_total, CAST(CASE WHEN p_type = 'PROMO' THEN 2 ELSE 1 END AS INTEGER) AS n_cohorts, p_type = 'PROMO' AS summed,
  CASE p_type WHEN 'PROMO' THEN 'patients,unspecified' WHEN 'SMALL' THEN 'unspecified' ELSE 'patients' END AS health, CASE p_type WHEN 'PROMO' THEN 'age,weight,age' WHEN 'SMALL' THEN 'weight' ELSE '' END AS descriptors,
  CASE p_type WHEN 'PROMO' THEN 'CYP2C9,CYP3A4' ELSE '' END AS genes FROM part
""")
def population_normalise(spark, sf):
    t = Tables(spark, sf).spread("part")
    p = t.withColumn("p", P.population(cohort_text(), F.when(~F.col("p_type").isin("PROMO", "SMALL"), F.lit(99.0))))
    return p.select(
        "p_partkey", "p.n_total", F.size("p.cohorts").alias("n_cohorts"), F.col("p.assumption").isNotNull().alias("summed"),
        F.array_join(F.transform("p.cohorts", lambda c: c["health_status"]), ",").alias("health"),
        F.array_join(F.flatten(F.transform("p.cohorts", lambda c: F.transform(c["descriptors"], lambda d: d["name"]))), ",").alias("descriptors"),
        F.array_join(F.flatten(F.transform("p.cohorts", lambda c: c["genes"])), ",").alias("genes"))


@query("h26_dose_parse", """
SELECT p_partkey, p_size::DOUBLE AS amount, CASE WHEN p_type = 'PROMO' THEN 'mg/kg' WHEN p_type = 'SMALL' THEN 'ug' ELSE 'mg' END AS amount_unit, CASE WHEN p_type = 'PROMO' THEN 12.0::DOUBLE WHEN p_type = 'LARGE' THEN 1.0::DOUBLE END AS interval,
  CASE WHEN p_type = 'PROMO' THEN 'h' WHEN p_type = 'LARGE' THEN 'day' END AS interval_unit, CASE WHEN p_type = 'SMALL' THEN 'bolus' WHEN p_type = 'LARGE' THEN 'infusion' ELSE 'unspecified' END AS administration, p_type = 'LARGE' AS steady_state FROM part
""")
def dose_parse(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_type") == "PROMO", F.concat(size, F.lit(" mg/kg every 12 h"))).when(F.col("p_type") == "SMALL", F.concat(F.lit("IV bolus "), size, F.lit("ug"))).when(
        F.col("p_type") == "LARGE", F.concat(size, F.lit(" MG infusion q1 day at steady-state"))).otherwise(F.concat(size, F.lit("mg once")))
    rows = Tables(spark, sf).part.select("p_partkey", P.regimen(text, F.lit(None).cast("string")).alias("d"))
    return rows.select("p_partkey", "d.amount", F.lower("d.amount_unit").alias("amount_unit"), "d.interval", "d.interval_unit", "d.administration", "d.steady_state")


def structures(t: Tables):
    text = F.when(F.col("p_type") == "PROMO", F.lit("one-compartment, absorption with lag time")).when(F.col("p_type") == "SMALL", F.lit("2-compartment infusion, Michaelis-Menten")).when(
        F.col("p_type") == "LARGE", F.lit("three compartment transit")).otherwise(F.lit("empirical"))
    names = F.when(F.col("p_type") == "LARGE", F.array(F.lit("k10"), F.lit("V1"))).otherwise(F.array(F.lit("cl"), F.lit(" vc ")))
    route = F.when(F.col("p_size") > 25, F.lit("Oral"))
    return t.part.select("p_partkey", "p_type", "p_size", P.canonical_structure(text, F.lit(None).cast("int"), route, names).alias("c"), route.alias("route"))


CANON = """cs AS (SELECT p_partkey, p_type, p_size, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'LARGE' THEN 3 END AS n,
  CASE WHEN p_type = 'PROMO' THEN 'first_order_with_lag' WHEN p_size > 25 THEN CASE WHEN p_type = 'LARGE' THEN 'transit' ELSE 'first_order' END WHEN p_type = 'SMALL' THEN 'infusion' ELSE 'direct' END AS input,
  CASE WHEN p_type = 'SMALL' THEN 'nonlinear' ELSE 'linear' END AS elimination, CASE WHEN p_type = 'LARGE' THEN 'micro_rate_constants' ELSE 'clearance_volume' END AS par FROM part)"""


@query("h27_canonical_structure", f"WITH {CANON} SELECT p_partkey, n AS compartments, input, input IN ('first_order', 'first_order_with_lag', 'transit') AS depot, elimination, par AS parameterization FROM cs")
def canonical_structure(spark, sf):
    return structures(Tables(spark, sf)).select("p_partkey", "c.*")


IMPL = f"""{CANON},
im AS (SELECT *, p_size > 25 OR input IN ('first_order', 'first_order_with_lag', 'transit') AS oral, CASE WHEN p_size > 45 THEN 6 END AS rep FROM cs),
co AS (SELECT *, CASE WHEN rep IS NOT NULL THEN rep WHEN elimination = 'linear' THEN CASE n WHEN 1 THEN CASE WHEN oral THEN 2 ELSE 1 END WHEN 2 THEN CASE WHEN oral THEN 4 ELSE 3 END WHEN 3 THEN CASE WHEN oral THEN 12 ELSE 11 END END END AS advan FROM im),
tr AS (SELECT *, CASE WHEN advan IS NULL THEN NULL WHEN par LIKE 'micro%' THEN 1 WHEN advan IN (1, 2) THEN 2 WHEN advan IN (3, 4, 11, 12) THEN 4 END AS trans FROM co)"""


@query("h28_implementation_inference", f"""
WITH {IMPL} SELECT p_partkey, advan, trans, CASE WHEN advan IS NULL OR trans IS NULL THEN 'unresolved' WHEN rep IS NOT NULL THEN 'reported' ELSE 'inferred' END AS status,
  CASE WHEN advan IS NULL OR trans IS NULL THEN 0.25::DOUBLE WHEN rep IS NOT NULL THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS confidence, CASE WHEN advan IS NULL OR trans IS NULL OR elimination <> 'linear' THEN '6,13' ELSE '' END AS alternatives,
  rep IS NULL OR advan IS NULL OR trans IS NULL AS review_required FROM tr
""")
def implementation_inference(spark, sf):
    s = structures(Tables(spark, sf))
    i = P.implementation(F.col("c"), F.col("route"), F.when(F.col("p_size") > 45, F.lit(6)), F.lit(None).cast("int"))
    return s.withColumn("i", i).select("p_partkey", "i.advan", "i.trans", "i.status", "i.confidence", F.array_join(F.transform("i.alternatives", lambda a: a.cast("string")), ",").alias("alternatives"), "i.review_required")


@query("h29_model_enrichment", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 7 WHEN p_type = 'PROMO' THEN 2 ELSE 1 END AS advan, CASE WHEN p_size > 40 THEN NULL ELSE 2 END AS trans, 1 AS compartments, p_size::DOUBLE AS n_subjects, 'mg' AS amount_unit, CASE WHEN p_size > 40 THEN 'unresolved' ELSE 'inferred' END AS status, '1.0.0' AS semantic_version FROM part
""")
def model_enrichment(spark, sf):
    p = Tables(spark, sf).spread("part")
    theta = F.array(F.struct(F.lit("CL").alias("name"), F.lit(1.0).alias("typical")), F.struct(F.lit("V").alias("name"), F.lit(2.0).alias("typical")))
    none = lambda k: F.lit(None).cast(k)
    rows = p.select("p_partkey", F.concat(F.lit("N = "), F.col("p_size").cast("string")).alias("population"), F.lit("5 mg").alias("dose"), F.when(F.col("p_type") == "PROMO", F.lit("oral")).alias("route"),
                    F.lit("one compartment").alias("description"), F.when(F.col("p_size") > 40, F.lit(7)).alias("advan"),
                    F.struct(theta.alias("theta"), none(semantics.OMEGA).alias("omega"), none(semantics.COVARIANCE).alias("omega_covariance"), none(semantics.SIGMA).alias("sigma")).alias("parameters"))
    e = semantics.enrich(rows)
    return e.select("p_partkey", "advan", "trans", "compartments", "n_subjects", F.get("dosing", F.lit(0))["amount_unit"].alias("amount_unit"), "implementation.status", "semantic_version")


@query("h30_semantic_scalar", """
SELECT doc_id, trim(string_split(text, ' ')[1], ' ') AS first_word, CASE WHEN lang = 'en' THEN n_chars::DOUBLE END AS number, CASE WHEN n_chars > 1000 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS confidence FROM documents
""")
def semantic_scalar(spark, sf):
    d = Tables(spark, sf).documents
    number = F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).when(F.col("lang") == "fr", F.lit("NaN")).otherwise(F.lit("n/a"))
    return d.select("doc_id", F.trim(F.get(F.split("text", " "), F.lit(0))).alias("first_word"), X.finite(number).alias("number"),
                    P.source_confidence(F.when(F.col("n_chars") > 1000, F.lit(7.0)).otherwise(F.lit(0.25))).alias("confidence"))


@query("h31_claim_equality", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN abs(l_extendedprice - l_extendedprice * (1 + l_tax - 0.04::DOUBLE)) <= greatest(1e-8::DOUBLE, 0.02::DOUBLE * greatest(1.0::DOUBLE, abs(l_extendedprice), abs(l_extendedprice * (1 + l_tax - 0.04::DOUBLE))))
  WHEN l_returnflag = 'N' THEN l_tax < 0.05 ELSE l_discount = 0 END AS is_equal FROM lineitem
""")
def claim_equality(spark, sf):
    a, n, r = F.col("l_returnflag") == "A", F.col("l_returnflag") == "N", F.col("l_returnflag") == "R"
    price = F.col("l_extendedprice")
    text_a = F.when(n, F.lit(" Two  Words")).when(r, F.lit("  "))
    text_b = F.when(n, F.when(F.col("l_tax") < 0.05, F.lit("two words ")).otherwise(F.lit("twowords"))).when(r & (F.col("l_discount") > 0), F.lit("x"))
    equal = claims.claims_equal(text_a, F.when(a, price), text_b, F.when(a, price * (1 + F.col("l_tax") - 0.04)))
    return Tables(spark, sf).spread("lineitem").select(*fx.LINE_KEYS, equal.alias("is_equal"))


@query("h32_claim_impact", f"""
SELECT doc_id, field, CASE WHEN field LIKE 'structural%' OR field LIKE 'population_details%' THEN 'major' ELSE 'minor' END AS impact FROM (SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'structural.' || l_linenumber WHEN 'N' THEN 'population_details.n' ELSE 'population' END AS field FROM lineitem)
""")
def claim_impact(spark, sf):
    field = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("structural."), F.col("l_linenumber").cast("string"))).when(F.col("l_returnflag") == "N", F.lit("population_details.n")).otherwise(F.lit("population"))
    return Tables(spark, sf).lineitem.select(F.col("l_orderkey").alias("doc_id"), field.alias("field")).withColumn("impact", claims.claim_impact(F.col("field")))


@query("h33_scalar_score", """
SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN 'ECONOMY' THEN CASE WHEN abs(p_size - 20) / p_size::DOUBLE <= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  WHEN 'PROMO' THEN 1.0::DOUBLE ELSE round(CASE WHEN split_part(p_name, ' ', 1) = 'red' AND split_part(p_name, ' ', 2) <> 'red' THEN 2.0::DOUBLE / (len(list_distinct(string_split(p_name, ' '))) + 2) WHEN list_contains(string_split(p_name, ' '), 'red') THEN 2.0::DOUBLE / (len(list_distinct(string_split(p_name, ' '))) + 2) ELSE 0.0::DOUBLE END, 6) END AS score FROM part
""")
def scalar_score(spark, sf):
    ty = F.col("p_type")
    path = F.when(ty == "STANDARD", "compound").when(ty == "ECONOMY", "n_subjects").when(ty == "PROMO", "route").otherwise("title")
    text_t = F.when(ty == "STANDARD", F.lit("VPA")).when(ty == "PROMO", F.lit("Per-Os")).when(ty != "ECONOMY", F.col("p_name"))
    text_p = F.when(ty == "STANDARD", F.when(F.col("p_size") > 25, F.lit("valproate")).otherwise(F.lit("gbp"))).when(ty == "PROMO", F.lit(" per os")).when(ty == "ECONOMY", F.lit("20")).otherwise(F.lit("red paint"))
    s = claims.scalar_score(path, text_t, F.when(ty == "ECONOMY", F.col("p_size").cast("double")), text_p, F.lit(None).cast("double"))
    return Tables(spark, sf).part.select("p_partkey", R6(s).alias("score"))


@query("h34_numeric_closeness", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount > 0 AND abs(l_extendedprice - l_extendedprice * (1 + 2 * l_tax - 0.08::DOUBLE)) <= 1e-8::DOUBLE + 0.05::DOUBLE * greatest(abs(l_extendedprice), 1e-8::DOUBLE) AS is_close FROM lineitem
""")
def numeric_closeness(spark, sf):
    price = F.col("l_extendedprice")
    p = F.when(F.col("l_discount") > 0, price * (1 + 2 * F.col("l_tax") - 0.08)).otherwise(F.lit(float("inf")))
    return Tables(spark, sf).lineitem.select(*fx.LINE_KEYS, N.numeric_close(price, p).alias("is_close"))


@query("h35_presence_test", "SELECT doc_id, trim(CASE WHEN lang = 'en' THEN '  ' WHEN lang = 'fr' THEN NULL ELSE text END) <> '' AND lang NOT IN ('en', 'fr') IS TRUE AS is_present FROM documents".replace("trim(CASE WHEN lang = 'en' THEN '  ' WHEN lang = 'fr' THEN NULL ELSE text END) <> '' AND lang NOT IN ('en', 'fr') IS TRUE", "coalesce(trim(CASE WHEN lang = 'en' THEN '  ' WHEN lang = 'fr' THEN NULL ELSE text END) <> '', false)"))
def presence_test(spark, sf):
    v = F.when(F.col("lang") == "en", F.lit("  ")).when(F.col("lang") != "fr", F.col("text"))
    return Tables(spark, sf).documents.select("doc_id", X.present(v).alias("is_present"))


@query("h36_display_value", r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), ' +', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 220 THEN substr(s, 1, 219) || '…' ELSE s END AS shown FROM f
""")
def display_value(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", X.display_value("text").alias("shown"))


@query("h37_partition_hash", f"SELECT doc_id, {fx.sql_partition('CAST(doc_id AS VARCHAR)')} AS partition FROM documents")
def partition_hash(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", N.partition_of(F.col("doc_id")).alias("partition"))


@query("h38_fingerprints", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents UNION ALL SELECT -page_id - 1, sha256(html), md5(html) FROM pages")
def fingerprints(spark, sf):
    t = Tables(spark, sf)
    both = t.documents.select("doc_id", "text").unionByName(t.pages.select((-F.col("page_id") - 1).alias("doc_id"), F.col("html").alias("text")))
    return both.select("doc_id", X.sha256_of("text").alias("sha256"), X.md5_of("text").alias("md5"))


@query("h39_claim_id", f"""
WITH {fx.CLAIMS} SELECT doc_id, seq, CASE WHEN status = 'unresolved' THEN 'theta_' || substr(sha256('{{"c0":"' || field || '","c1":"' || value || '","c2":"' || model_stage || '","c3":"' || source_locator || '"}}'), 1, 12) ELSE 'theta::' || id END AS claim_id FROM claims
""")
def claim_id(spark, sf):
    c = fx.claims(Tables(spark, sf))
    given = F.when(F.col("status") == "unresolved", F.lit(" ")).when(F.col("status") == "derived", F.concat(F.lit("theta::"), "id")).otherwise(F.col("id"))
    return c.select("doc_id", "seq", ledger.claim_id(given, F.col("stage"), F.col("field"), F.col("value"), F.col("model_stage"), F.col("source_locator")).alias("claim_id"))


@query("h40_review_overdue", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderdate < TIMESTAMP '1998-01-01' WHEN 'O' THEN true ELSE false END AS overdue FROM orders
""")
def review_overdue(spark, sf):
    due = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderstatus") == "O", F.lit("next spring"))
    return Tables(spark, sf).orders.select("o_orderkey", N.review_overdue(due, F.lit("1998-01-01").cast("timestamp")).alias("overdue"))


@query("h41_probability_clip", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE least(greatest(value / 50 - 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END AS p FROM events")
def probability_clip(spark, sf):
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value") / 50 - 0.5)
    return Tables(spark, sf).events.select("event_id", N.probability(v).alias("p"))


@query("h42_probability_normalise", """
SELECT event_id, CASE event_type WHEN 'view' THEN round(k / 100.0::DOUBLE, 6) WHEN 'click' THEN CASE WHEN k > 1 THEN round(k / 100.0::DOUBLE, 6) ELSE k::DOUBLE END WHEN 'error' THEN NULL ELSE (100 + k)::DOUBLE END AS p, event_type NOT IN ('purchase', 'signup') OR k = 0 AS valid
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
""".replace("(100 + k)::DOUBLE", "CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE (100 + k)::DOUBLE END"))
def probability_normalise(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_type") == "view", F.concat(k, F.lit("%"))).when(F.col("event_type") == "click", k).when(F.col("event_type") == "error", F.lit("high")).otherwise((k.cast("int") + 100).cast("string"))
    p = N.probability_text(text)
    return Tables(spark, sf).events.select("event_id", R6(p).alias("p"), N.probability_ok(p).alias("valid"))


@query("h42_probability_documents", """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN event_type = 'error' AND k > 0 THEN '{"confidence":{"overall":' || (k + 100) || '}}' WHEN event_type = 'view' THEN '{"n":' || k || '}'
  ELSE '{"confidence":{"overall":' || CASE WHEN event_type = 'error' THEN '1.0' WHEN k > 1 THEN CAST(k / 100.0::DOUBLE AS VARCHAR) ELSE CAST(k AS VARCHAR) END || CASE WHEN event_type = 'error' THEN '}}' ELSE ',"note":"x"},"model_probability":' || CAST(k / 100.0::DOUBLE AS VARCHAR) || '}' END END AS document,
  CASE WHEN event_type = 'error' AND k > 0 THEN 'invalid probability at /confidence/overall' END AS error FROM e
""")
def probability_documents(spark, sf):
    k = F.get_json_object("props", "$.k")
    doc = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"confidence":{"overall":'), (k.cast("int") + 100).cast("string"), F.lit("}}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"n":'), k, F.lit("}")))
        .otherwise(F.concat(F.lit('{"confidence":{"overall":'), k, F.lit(',"note":"x"},"model_probability":"'), k, F.lit('%"}')))
    )
    rows = Tables(spark, sf).spread("events").select("event_id", doc.alias("document"))
    return J.normalise_probabilities(rows, "document", levels=3).select("event_id", "document", "error")


@query("h43_triage_tier", f"""
SELECT doc_id, CASE WHEN s >= 2 THEN 'high' WHEN s = 1 THEN 'intermediate' ELSE 'low' END AS tier FROM (SELECT doc_id, {fx.sql_score('text', ['license', 'worthless', 'keit'])} AS s FROM documents)
""")
def triage_tier(spark, sf):
    s = X.keyword_score("text", ["license", "worthless", "keit"])
    return Tables(spark, sf).documents.select("doc_id", N.triage_tier(triage.heuristic_probability(s, F.lit(True))).alias("tier"))


@query("h44_omega_variance", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE l_linenumber WHEN 1 THEN l_discount WHEN 2 THEN l_discount * l_discount WHEN 3 THEN ln(1 + l_discount * l_discount) WHEN 4 THEN (l_quantity * l_discount) * (l_quantity * l_discount) WHEN 5 THEN ln(1 + (l_quantity / 100) * (l_quantity / 100)) WHEN 6 THEN (l_quantity / 100) * (l_quantity / 100) END, 6) AS value,
  l_linenumber < 7 AS supported, l_linenumber NOT IN (3, 4) AS review FROM lineitem
""")
def omega_variance(spark, sf):
    n, none = F.col("l_linenumber"), F.lit(None).cast("double")
    metric = F.when(n == 1, "variance").when(n == 2, " SD ").when(n.isin(3, 4), "CV fraction").when(n == 5, "cv-percent").when(n == 6, "Approximate CV (percent)").otherwise("range")
    raw = F.when(n >= 5, F.col("l_quantity")).otherwise(F.col("l_discount"))
    dist = F.when(n == 3, "log-normal").when(n == 4, "normal")
    v = N.omega_variance(none, raw, metric, dist, F.lit(None).cast("string"), F.col("l_quantity"))
    rows = Tables(spark, sf).spread("lineitem").withColumn("v", v)
    return rows.select(*fx.LINE_KEYS, R6("v.value").alias("value"), "v.supported", "v.review")


@query("h45_sigma_variance", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE l_linenumber WHEN 1 THEN l_tax WHEN 2 THEN l_tax * l_tax WHEN 3 THEN l_tax * l_tax WHEN 4 THEN (l_quantity / 100) * (l_quantity / 100) END, 6) AS value, l_linenumber <= 4 AS supported FROM lineitem
""")
def sigma_variance(spark, sf):
    n = F.col("l_linenumber")
    metric = F.when(n == 1, "variance").when(n == 2, "sd").when(n == 3, "cv_fraction").when(n == 4, "cv percent").otherwise("unknown")
    v = N.sigma_variance(F.when(n == 4, F.col("l_quantity")).otherwise(F.when(n == 5, F.lit(-1.0)).otherwise(F.col("l_tax"))), F.lit(None).cast("double"), metric)
    return Tables(spark, sf).spread("lineitem").withColumn("v", v).select(*fx.LINE_KEYS, R6("v.value").alias("value"), "v.supported")


@query("h46_covariance", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' THEN l_discount * sqrt(l_quantity * l_tax) WHEN l_returnflag = 'N' THEN l_quantity / 100 * sqrt(l_quantity * l_tax) WHEN l_linestatus = 'F' THEN l_discount END, 6) AS value,
  NOT (l_returnflag = 'R' AND l_linestatus <> 'F') AS supported FROM lineitem
""".replace("WHEN l_returnflag = 'N' THEN l_quantity / 100 *", "WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END *"))
def covariance(spark, sf):
    f = F.col("l_returnflag")
    raw = F.when(f == "N", F.col("l_quantity")).otherwise(F.col("l_discount"))
    metric = F.when(f.isin("A", "N"), "correlation").when(F.col("l_linestatus") == "F", "covariance").otherwise("unknown")
    v = N.covariance_value(raw, F.lit(None).cast("double"), metric, F.col("l_quantity"), F.col("l_tax"))
    return Tables(spark, sf).spread("lineitem").withColumn("v", v).select(*fx.LINE_KEYS, R6("v.value").alias("value"), "v.supported")


@query("h47_dose_to_mg", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity * 1000 WHEN 3 THEN CASE WHEN l_tax > 0 THEN l_quantity / 1000 * 80 END WHEN 4 THEN l_quantity * 1.8::DOUBLE END, 6) AS amount,
  CASE WHEN l_linenumber = 3 AND l_tax = 0 THEN 'weight_required_for_weight_normalized_dose' WHEN l_linenumber = 5 THEN 'dose_unit_not_convertible_to_mg' WHEN l_linenumber = 6 THEN 'dose_unit_missing' WHEN l_linenumber = 7 THEN 'dose_amount_missing' END AS blocker FROM lineitem
""")
def dose_to_mg(spark, sf):
    n = F.col("l_linenumber")
    unit = F.when(n == 1, "mg").when(n == 2, " G ").when(n == 3, "mcg / kg").when(n == 4, "mg/m2").when(n == 5, "tablet").when(n == 7, "mg")
    a = N.amount_mg(F.when(n < 7, F.col("l_quantity")), unit, F.when(F.col("l_tax") > 0, F.lit(80.0)), F.lit(1.8))
    return Tables(spark, sf).spread("lineitem").withColumn("a", a).select(*fx.LINE_KEYS, R6("a.value").alias("amount"), "a.blocker")


@query("h48_duration_to_hours", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'N' THEN l_quantity / 60 ELSE CASE WHEN l_linestatus = 'F' THEN l_quantity * 24 END END, 6) AS hours,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'dose_interval_unit_not_convertible_to_hours' END AS blocker FROM lineitem
""")
def duration_to_hours(spark, sf):
    f = F.col("l_returnflag")
    unit = F.when(f == "A", "Hours").when(f == "N", "minutes").when(F.col("l_linestatus") == "F", "d").otherwise("cycles")
    return Tables(spark, sf).lineitem.withColumn("h", N.hours(F.col("l_quantity"), unit, "dose_interval")).select(*fx.LINE_KEYS, R6("h.value").alias("hours"), "h.blocker")


@query("h49_version_compare", "SELECT p_partkey, p_type <> 'PROMO' AND p_type <> 'SMALL' AND p_size > 9 AS newer FROM part")
def version_compare(spark, sf):
    cand = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.when(F.col("p_type") == "SMALL", F.lit(".x")).otherwise(F.lit(".0")))
    return Tables(spark, sf).part.select("p_partkey", N.version_newer(cand, F.when(F.col("p_type") == "PROMO", F.lit("")).otherwise(F.lit("1.9.0"))).alias("newer"))


@query("h50_percent_delta", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_discount > 0 THEN 100.0::DOUBLE * (l_tax - l_discount) / l_discount WHEN l_tax = 0 THEN 0.0::DOUBLE END, 6) AS delta, l_returnflag <> 'R' AND l_discount = 0 AND l_tax > 0 AS infinite FROM lineitem
""")
def percent_delta(spark, sf):
    d = N.percent_delta(F.col("l_discount"), F.when(F.col("l_returnflag") != "R", F.col("l_tax")))
    rows = Tables(spark, sf).lineitem.withColumn("d", d)
    return rows.select(*fx.LINE_KEYS, R6(X.finite(F.col("d"))).alias("delta"), F.coalesce(F.col("d") == float("inf"), F.lit(False)).alias("infinite"))


# ---------------------------------------------------------------- JSON


@query("h51_pointer_tokens", """
SELECT event_id, replace(replace(event_type || '/~' || props, '~', '~0'), '/', '~1') AS escaped, event_type || '/~' || props AS token2, 'a' AS token1 FROM events
""")
def pointer_tokens(spark, sf):
    raw = F.concat("event_type", F.lit("/~"), "props")
    escaped = J.escape_token(raw)
    tokens = J.pointer_tokens(F.concat(F.lit("/a/"), escaped))
    return Tables(spark, sf).events.select("event_id", escaped.alias("escaped"), F.get(tokens, F.lit(1)).alias("token2"), F.get(tokens, F.lit(0)).alias("token1"))


def nested_json():
    k = F.get_json_object("props", "$.k")
    return F.concat(F.lit('{"k": '), k, F.lit(', "a/b": {"list": [{"x": "'), F.col("event_type"), F.lit('"}, [], null]}, "empty": {}, "p": '), F.col("props"), F.lit("}"))


@query("h52_json_flatten", """
WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, unnest(['/k', '/a~1b/list/0/x', '/a~1b/list/1', '/a~1b/list/2', '/empty', '/p/k']) AS pointer, unnest(['k', 'a/b.list[1].x', 'a/b.list[2]', 'a/b.list[3]', 'empty', 'p.k']) AS label,
  unnest([k, '"' || event_type || '"', '[]', 'null', '{}', k]) AS value_json FROM e
""")
def json_flatten(spark, sf):
    rows = J.with_leaves(Tables(spark, sf).spread("events").select("event_id", nested_json().alias("json")), "json", levels=3)
    rows = X.inline_rows(rows, ["event_id"], "leaves", "pointer")
    return rows.select("event_id", "pointer", "label", F.to_json("node").alias("value_json"))


@query("h53_pointer_get", """
SELECT event_id, '"' || event_type || '"' AS deep, json_extract_string(props, '$.k') AS k, true AS absent FROM events
""")
def pointer_get(spark, sf):
    rows = Tables(spark, sf).spread("events").select("event_id", F.parse_json(nested_json()).alias("v"))
    get = lambda p: F.to_json(J.pointer_get(F.col("v"), F.lit(p)))
    return rows.select("event_id", get("/a~1b/list/0/x").alias("deep"), get("/p/k").alias("k"), J.pointer_get(F.col("v"), F.lit("/a~1b/list/9/x")).isNull().alias("absent"))


@query("h54_pointer_set", """
SELECT event_id, CASE event_type WHEN 'view' THEN '{"k":' || k || ',"added":{"deep":[7]}}' WHEN 'click' THEN '{"k":"x~/' || k || '"}' ELSE props END AS document
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
""".replace('"added":{"deep":[7]}', '"added":{"deep":7}'))
def pointer_set(spark, sf):
    ev = Tables(spark, sf).events
    k = F.get_json_object("props", "$.k")
    fixes = ev.filter(F.col("event_type").isin("view", "click")).select(
        "event_id", F.when(F.col("event_type") == "view", F.lit("/added/deep")).otherwise(F.lit("/k")).alias("pointer"),
        F.when(F.col("event_type") == "view", F.lit("7")).otherwise(F.concat(F.lit('"x~/'), k, F.lit('"'))).alias("value_json"))
    patched = ev.join(fixes, "event_id").select("event_id", J.pointer_set(F.col("props"), F.col("pointer"), F.col("value_json")).alias("document"))
    rest = ev.join(fixes.select("event_id"), "event_id", "left_anti").select("event_id", F.col("props").alias("document"))
    return patched.unionByName(rest)


@query("h55_json_encode", """
SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical, event_type = 'error' AS invalid FROM events
""")
def json_encode(spark, sf):
    doc = F.when(F.col("event_type") == "error", F.concat("props", F.lit(","))).otherwise(F.col("props"))
    return Tables(spark, sf).events.select("event_id", F.to_json(F.parse_json("props")).alias("canonical"), J.strict_parse(doc).isNull().alias("invalid"))


@query("h56_leaf_equality", """
SELECT o_orderkey, o_orderstatus = 'F' AS same_compound, o_orderstatus <> 'O' AS same_text, floor(o_totalprice) * 0.04::DOUBLE <= 1e-8::DOUBLE + 0.05::DOUBLE * floor(o_totalprice) AS same_number, false AS null_vs_text, true AS both_null FROM orders
""")
def leaf_equality(spark, sf):
    v = lambda c: F.parse_json(c)
    price = F.floor("o_totalprice")
    s = F.col("o_orderstatus")
    root = F.lit("/x")
    return Tables(spark, sf).spread("orders").select(
        "o_orderkey", J.nodes_equal(v(F.lit('"CBZ"')), v(F.when(s == "F", F.lit('"carbamazepine"')).otherwise(F.lit('"vpa"'))), F.lit("/compound")).alias("same_compound"),
        J.nodes_equal(v(F.lit('"Two Words"')), v(F.when(s != "O", F.lit('" two-WORDS!"')).otherwise(F.lit('"two"'))), root).alias("same_text"),
        J.nodes_equal(v(price.cast("string")), v((price * 1.04).cast("string")), root).alias("same_number"),
        J.nodes_equal(v(F.lit("null")), v(F.concat(F.lit('"'), s, F.lit('"'))), root).alias("null_vs_text"), J.nodes_equal(v(F.lit("null")), F.lit(None).cast("variant"), root).alias("both_null"))


@query("h57_dotted_get", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing FROM events")
def dotted_get(spark, sf):
    rows = Tables(spark, sf).events.select("event_id", F.parse_json(nested_json()).alias("v"))
    return rows.select("event_id", J.text_of(J.dotted_get(F.col("v"), "p.k")).alias("k"), J.text_of(J.dotted_get(F.col("v"), "p.z.y")).alias("missing"))


def response_texts(t: Tables):
    """Conversation turns as model responses: fenced, cut, trailing commas, valid, or plain prose."""
    body = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "items": [1, 2'))
    text = (
        F.when(F.col("role") == "system", F.concat(F.lit("```json\n"), body, F.lit(",]}\n```")))
        .when((F.col("role") == "user") & (F.col("turn") < 2), F.concat(F.lit("Answer: "), body, F.lit("]} trailing")))
        .when(F.col("role") == "user", body).when(F.col("turn") < 2, F.concat(body, F.lit('], "x": "cut')))
        .when(F.col("turn") < 4, F.concat(body, F.lit("]}"))).otherwise(F.translate("text", "{}[]", ""))
    )
    return t.conversations.select("conv_id", "turn", "role", text.alias("response"))


@query("h58_json_salvage", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' AND (turn < 2 OR turn >= 4) THEN NULL ELSE '{"turn": ' || turn || ', "items": [1, 2]}' END AS payload,
  CASE WHEN role = 'assistant' AND turn < 2 THEN 'a value was truncated' WHEN role = 'assistant' AND turn >= 4 THEN 'no JSON object or array found' END AS error FROM conversations
""")
def json_salvage(spark, sf):
    return J.salvage(response_texts(Tables(spark, sf)), "response").select("conv_id", "turn", "payload", "error")


@query("h59_payload_conformance", """
SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'response.priority: outside the enumeration' WHEN 'error' THEN 'response: missing required field question' WHEN 'signup' THEN 'response.search_terms[2]: expected string'
  ELSE 'response: unexpected field extra' END AS error FROM events
""")
def payload_conformance(spark, sf):
    q = F.concat(F.lit('{"id": "q", "field": "'), "event_type", F.lit('", "priority": "'), F.when(F.col("event_type") == "click", F.lit("soon")).otherwise(F.lit("high")), F.lit('"'),
                 F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.lit(', "question": "why"')), F.lit(', "search_terms": ["a", '),
                 F.when(F.col("event_type") == "signup", F.lit("1")).otherwise(F.lit('"b"')), F.lit("]"), F.when(F.col("event_type") == "purchase", F.lit(', "extra": 1')).otherwise(F.lit("")), F.lit("}"))
    return Tables(spark, sf).spread("events").select("event_id", J.conformance_error(F.parse_json(q), schemas.CONTRACTS["question"]).alias("error"))


@query("h60_deep_merge", """
SELECT event_id, '{"drugs":["x"],"limits":{"by":{"a":{"b":{"c":3,"keep":1}}},"k":' || json_extract_string(props, '$.k') || ',"max":9,"min":0}}' AS merged FROM events
""")
def deep_merge(spark, sf):
    base = F.lit('{"drugs": [], "limits": {"min": 0, "max": 5, "by": {"a": {"b": {"keep": 1, "c": 2}}}}}')
    update = F.concat(F.lit('{"drugs": ["x"], "limits": {"max": 9, "by": {"a": {"b": {"c": 3}}}, "k": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    rows = Tables(spark, sf).events.select("event_id", J.merge_objects(base, update).alias("merged"))
    return rows.select("event_id", F.to_json(F.parse_json("merged")).alias("merged"))


@query("h61_range_validation", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size::DOUBLE ELSE '-inf'::DOUBLE END < 0 AS open_start, p_size <= 10 OR p_type = 'PROMO' OR p_size <= 30 AS valid FROM part")
def range_validation(spark, sf):
    r = N.validated_range(F.when(F.col("p_size") > 10, F.col("p_size")), F.when(F.col("p_type") != "PROMO", F.lit(30)))
    return Tables(spark, sf).part.withColumn("r", r).select("p_partkey", (F.col("r.min") < 0).alias("open_start"), "r.valid")


@query("h62_covariate_representatives", """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 30.0::DOUBLE END AS age, CASE WHEN p_type = 'PROMO' THEN 70.0::DOUBLE END AS wt, CASE WHEN p_type = 'PROMO' THEN 2 ELSE 0 END AS n FROM part
""")
def covariate_representatives(spark, sf):
    rows = Tables(spark, sf).spread("part").withColumn("c", P.cohorts(cohort_text())).withColumn("m", P.covariate_representatives(F.col("c")))
    return rows.select("p_partkey", F.try_element_at("m", F.lit("AGE")).alias("age"), F.try_element_at("m", F.lit("WT")).alias("wt"), F.size("m").alias("n"))


@query("h63_concentration_points", """
SELECT event_id, 't' || user_id AS target_id, 1.0::DOUBLE AS "time", value, value - 1 AS lower, NULL::DOUBLE AS upper FROM events WHERE event_type = 'view'
""")
def concentration_points(spark, sf):
    v = F.col("value")
    point = lambda a, b: F.struct(a.cast("double").alias("time"), b.cast("double").alias("value"), (v - 1).alias("lower"), F.lit(float("nan")).alias("upper"))
    target = lambda kind, pts: F.struct(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("id"), kind.alias("kind"), F.lit("mean").alias("statistic"), pts.alias("points"))
    targets = F.array(target(F.when(F.col("event_type") == "view", F.lit("concentration_time")).otherwise(F.lit("pk_summary")), F.array(point(F.lit(1.0), v), point(F.lit(None), v), point(F.lit(2.0), F.lit(float("nan"))))))
    return reproduction.concentration_points(Tables(spark, sf).events, ["event_id"], targets).select("event_id", "target_id", "time", "value", "lower", "upper")


@query("h64_stub_record", f"""
WITH {fx.ARTICLES} SELECT pmid, title, NULL::VARCHAR AS software, round(least(0.25::DOUBLE, 0.05::DOUBLE * {fx.sql_score("abstract")}), 6) AS confidence FROM articles
""")
def stub_record(spark, sf):
    s = triage.stub_record(fx.articles(Tables(spark, sf)), keywords=fx.WORDS)
    return s.select("pmid", "title", "software", R6("confidence_overall").alias("confidence"))


@query("h65_null_coalesce", "SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN text END, 'default') AS value FROM documents")
def null_coalesce(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", X.coalesce_blank(F.when(F.col("lang") == "en", F.col("text")), "default").alias("value"))


def _required_fields():
    """(kind, kind's number, place, field) of the fields that each contract demands, as its definition lists them."""
    return [(kind, n, place, field) for n, kind in enumerate(schemas.CONTRACTS) for place, field in enumerate(schemas.CONTRACTS[kind]["required"])]


@query("h66_contract_rules", f"""
WITH fields(kind, n, place, field) AS (VALUES {", ".join(str(row) for row in _required_fields())}),
counted AS (SELECT n, count(*) AS demanded FROM fields GROUP BY n),
ev AS (SELECT event_id % {len(schemas.CONTRACTS)} AS n, event_id // {len(schemas.CONTRACTS)} AS turn FROM events),
doc AS (SELECT n, turn % (demanded + 1) AS place FROM ev JOIN counted USING (n))
SELECT kind, field AS argument, count(*) AS n_documents FROM doc JOIN fields USING (n, place) GROUP BY 1, 2
""")
def contract_rules(spark, sf):
    # documents that carry one field each, of all contracts in turn, or one that no contract knows; the rule table is fixed in size and broadcast
    demanded = [spec["required"] for spec in schemas.CONTRACTS.values()]
    kinds = X.literal_array(list(schemas.CONTRACTS))
    names = F.array(*[X.literal_array([*fields, "other"]) for fields in demanded])
    n, turn = (F.col("event_id") % len(demanded)).cast("int"), F.floor(F.col("event_id") / len(demanded))
    ev = Tables(spark, sf).events.select(F.get(kinds, n).alias("kind"), F.get(names, n).alias("names"), turn.alias("turn"))
    name = F.get("names", (F.col("turn") % F.size("names")).cast("int"))
    keys = ev.select("kind", F.explode(F.json_object_keys(F.concat(F.lit('{"'), name, F.lit('": 1}')))).alias("argument"))
    rules = schemas.rule_table(spark).filter("rule = 'required' AND path = 'response'").select("kind", "argument")
    return keys.join(F.broadcast(rules), ["kind", "argument"]).groupBy("kind", "argument").agg(F.count("*").alias("n_documents"))


