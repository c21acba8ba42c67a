"""Joins: look-ups, comparisons, diffs, anti-joins, merges, interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as X
from claimloom.operators import catalogue, chunks, claims, corpus, jsondiff, keyed, ledger, reproduction, scoring, triage
from claimloom.plans import semantics
from workload import fixtures as fx
from workload.filters import QUAL_ORDERS, qualification_orders
from workload.registry import Tables, query


@query("c01_acquisition_route", """
WITH a AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS pmid, CASE WHEN o_orderstatus = 'O' THEN '' ELSE '10.1/' || o_custkey END AS doi,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS pmcid, CASE WHEN o_totalprice > 300000 THEN '' ELSE 'x' END AS abstract,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' THEN 'intermediate' ELSE 'low' END AS tier FROM orders),
c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM customer),
j AS (
  SELECT a.*, CASE WHEN a.pmcid <> '' THEN a.pmcid WHEN e.c_mktsegment = 'BUILDING' THEN e.k ELSE '' END AS pmcid2,
         CASE WHEN u.c_acctbal > 5000 THEN 'http://u/' || u.k ELSE '' END AS u_url, coalesce(u.c_acctbal < 7000, false) AS u_oa,
         CASE WHEN e.c_mktsegment = 'MACHINERY' THEN 'http://e/' || e.k ELSE '' END AS e_url, coalesce(e.c_nationkey < 12, false) AS e_oa
  FROM a LEFT JOIN c u ON a.doi <> '' AND a.doi = '10.1/' || u.k LEFT JOIN c e ON a.pmid = e.k),
f AS (SELECT j.*, CASE WHEN p.k IS NOT NULL THEN 'https://www.ncbi.nlm.nih.gov/pmc/' || p.k ELSE '' END AS p_url, coalesce(p.c_acctbal < 2000, false) AS p_oa
      FROM j LEFT JOIN c p ON j.pmcid2 <> '' AND j.pmcid2 = p.k AND p.c_mktsegment = 'BUILDING'),
g AS (SELECT *, CASE WHEN p_oa AND p_url <> '' THEN p_url WHEN u_url <> '' THEN u_url WHEN e_oa AND e_url <> '' THEN e_url ELSE '' END AS url,
             p_oa OR u_oa OR e_oa AS is_oa, tier IN ('high', 'intermediate') AS early FROM f)
SELECT o_orderkey, pmcid2 AS pmcid, is_oa,
  CASE WHEN NOT early THEN 'deferred_low' WHEN url <> '' AND is_oa THEN 'oa_auto' WHEN doi <> '' THEN 'needs_institutional' ELSE 'stub' END AS acquisition_class,
  CASE WHEN url <> '' AND is_oa THEN CASE WHEN contains(url, 'ncbi.nlm.nih.gov/pmc') THEN 'pmc_pdf' ELSE 'oa_pdf' END WHEN doi <> '' THEN 'doi_follow'
       WHEN early THEN 'abstract_only' ELSE '' END AS strategy,
  CASE WHEN url <> '' AND is_oa THEN url WHEN doi <> '' THEN 'https://doi.org/' || doi WHEN early THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' ELSE '' END AS suggested_url,
  CASE WHEN early THEN 'pending' ELSE 'deferred' END AS status
FROM g
""")
def acquisition_route(spark, sf):
    t = Tables(spark, sf)
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    k = F.col("o_custkey").cast("string")
    a = t.orders.select(
        "o_orderkey", k.alias("pmid"), F.when(s == "O", F.lit("")).otherwise(F.concat(F.lit("10.1/"), k)).alias("doi"),
        F.when(s == "P", F.lit("")).otherwise(F.concat(F.lit("PMC"), k)).alias("pmcid"),
        F.when(F.col("o_totalprice") > 300000, F.lit("")).otherwise(F.lit("x")).alias("abstract"),
        F.when(p.startswith("1"), "high").when(p.startswith("2"), "intermediate").otherwise("low").alias("tier"))
    c = t.customer.withColumn("k", F.col("c_custkey").cast("string"))
    seg = F.col("c_mktsegment")
    unpaywall = c.select(F.concat(F.lit("10.1/"), "k").alias("doi"), F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("http://u/"), "k")).alias("url_for_pdf"),
                         (F.col("c_acctbal") < 7000).alias("is_oa"))
    epmc = c.select(F.col("k").alias("pmid"), F.when(seg == "BUILDING", F.concat(F.lit("pmc"), "k")).alias("pmcid"),
                    F.when(seg == "MACHINERY", F.concat(F.lit("http://e/"), "k")).alias("pdf_url"), (F.col("c_nationkey") < 12).alias("is_open_access"))
    pmc = c.filter(seg == "BUILDING").select(F.col("k").alias("pmcid"), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/"), "k").alias("pdf_url"),
                                             (F.col("c_acctbal") < 2000).alias("is_oa"))
    return triage.classify(a, unpaywall, epmc, pmc).select("o_orderkey", "pmcid", "is_oa", "acquisition_class", "strategy", "suggested_url", "status")


@query("c02_discovery_assembly", f"""
WITH {fx.ARTICLES},
dec AS (SELECT CAST(doc_id + 1000000 AS VARCHAR) AS pmid, CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'intermediate' ELSE 'low' END AS tier FROM labels),
ids AS (SELECT DISTINCT CAST(o_custkey + 1000000 AS VARCHAR) AS pmid FROM orders),
inbox AS (SELECT CAST(page_id + 1000000 AS VARCHAR) AS pmid, min(url) AS local_path FROM pages WHERE contains(url, '/en/') GROUP BY 1)
SELECT ids.pmid, a.title, coalesce(d.tier, 'low') AS tier, coalesce(i.local_path, '') AS local_path,
  CASE WHEN i.local_path IS NOT NULL THEN 'fetched' WHEN coalesce(d.tier, 'low') <> 'low' THEN 'pending' ELSE 'deferred' END AS status,
  coalesce(d.tier, 'low') = 'low' AS in_backlog
FROM ids JOIN articles a USING (pmid) LEFT JOIN dec d USING (pmid) LEFT JOIN inbox i USING (pmid)
""")
def discovery_assembly(spark, sf):
    t = Tables(spark, sf)
    pm = lambda c: (F.col(c) + 1000000).cast("string").alias("pmid")
    dec = t.labels.select(pm("doc_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "high").when(F.col("quality") == 1, "intermediate").otherwise("low").alias("tier"))
    inbox = t.pages.filter(F.contains("url", F.lit("/en/"))).groupBy(pm("page_id")).agg(F.min("url").alias("local_path"))
    m = triage.discover(t.orders.select(pm("o_custkey")), fx.articles(t).select("pmid", "title"), dec, inbox)
    backlog = triage.low_backlog(m).select("pmid", F.lit(True).alias("in_backlog"))
    return m.join(backlog, "pmid", "left").select("pmid", "title", "tier", "local_path", "status", F.coalesce("in_backlog", F.lit(False)).alias("in_backlog"))


def order_records(t: Tables):
    p = F.col("o_orderpriority")
    return t.orders.select(F.col("o_orderkey").alias("doc_id"),
                           F.when(p.startswith("1"), "A").when(p.startswith("2"), "B").when(p.startswith("3"), "C").otherwise("D").alias("tier"))


ORDER_RECORDS = """recs AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'A' WHEN o_orderpriority LIKE '2%' THEN 'B'
  WHEN o_orderpriority LIKE '3%' THEN 'C' ELSE 'D' END AS tier FROM orders)"""


def score_tables(t: Tables):
    """Truth and proposed long tables per order, from its lines.

    Parameters are lines by (part, supplier, line); semantic claims are their
    ship dates; scalar fields are the order's own text columns.
    """
    k = F.concat_ws(".", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    kind = F.when(F.col("l_returnflag") == "A", "theta").when(F.col("l_returnflag") == "N", "omega").otherwise("sigma")
    line = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), k.alias("k"), kind.alias("type"), "l_extendedprice", "l_quantity", "l_tax", "l_discount",
                             "l_returnflag", "l_linestatus")
    seen = line.filter(F.col("l_discount") > 0)
    truth = {
        "numeric": line.filter(F.col("l_discount") < 0.1).select("doc_id", "type", F.col("k").alias("item_key"), F.col("l_extendedprice").alias("value")),
        "semantic": line.filter(F.col("l_discount") < 0.09).select(
            "doc_id", F.col("k").alias("path"), F.when(F.col("type") == "theta", F.col("l_linestatus")).alias("text"),
            F.when(F.col("type") != "theta", F.col("l_quantity")).alias("number")),
    }
    proposed = {
        "numeric": seen.select("doc_id", "type", F.col("k").alias("item_key"), (F.col("l_extendedprice") * (1 + 2 * F.col("l_tax") - 0.08)).alias("value")),
        "semantic": seen.select(
            "doc_id", F.col("k").alias("path"),
            F.when(F.col("type") == "theta", F.when(F.col("l_tax") > 0.06, F.lit("")).otherwise(F.lower(F.concat(F.lit(" "), F.when(F.col("l_tax") > 0.02, F.lit("O")).otherwise(F.lit("F")))))).alias("text"),
            F.when(F.col("type") != "theta", F.col("l_quantity") * (1 + F.col("l_tax"))).alias("number")),
    }
    none = F.lit(None)
    o = t.spread("orders")
    fields = lambda a, b, c, d: X.rows_array(["path", "text", "number"], ["compound", a, none.cast("double")], ["route", b, none.cast("double")], ["n_subjects", none.cast("string"), c], ["population", d, none.cast("double")])
    truth["scalar"] = o.select(F.col("o_orderkey").alias("doc_id"), F.inline(fields(F.lit("Carbamazepine"), F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority"))))
    proposed["scalar"] = o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.inline(fields(F.when(F.col("o_orderstatus") == "F", F.lit("CBZ")).otherwise(F.lit("VPA")), F.lit(" f!"), F.col("o_totalprice") * F.when(F.col("o_custkey") < 700, 1.04).otherwise(1.06),
                        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.lit("high urgent priority")))))
    return truth, proposed


SCORES = f"""{ORDER_RECORDS},
line AS (SELECT l_orderkey AS doc_id, concat_ws('.', l_partkey, l_suppkey, l_linenumber) AS k,
  CASE l_returnflag WHEN 'A' THEN 'theta' WHEN 'N' THEN 'omega' ELSE 'sigma' END AS type, * FROM lineitem),
num AS (
  SELECT doc_id, count(*) FILTER (WHERE l_discount < 0.1) AS expected, count(*) FILTER (WHERE l_discount < 0.1 AND l_discount > 0) AS covered,
    count(*) FILTER (WHERE l_discount < 0.1 AND l_discount > 0 AND abs(l_extendedprice - l_extendedprice * (1 + 2 * l_tax - 0.08::DOUBLE)) <= 1e-8::DOUBLE + 0.05::DOUBLE * abs(l_extendedprice)) AS correct,
    count(*) FILTER (WHERE l_discount >= 0.1) AS extras
  FROM line GROUP BY 1),
sem0 AS (
  SELECT doc_id, l_discount < 0.09 AS exp, l_discount > 0 AS got,
    l_discount > 0 AND (type <> 'theta' OR l_tax <= 0.06) AS has,
    CASE WHEN type = 'theta' THEN lower(l_linestatus) = CASE WHEN l_tax > 0.02 THEN 'o' ELSE 'f' END
         ELSE abs(l_quantity - l_quantity * (1 + l_tax)) <= 1e-8::DOUBLE + 0.05::DOUBLE * abs(l_quantity) END AS good FROM line),
sem AS (SELECT doc_id, count(*) FILTER (WHERE exp) AS expected, count(*) FILTER (WHERE exp AND got AND has) AS covered,
    count(*) FILTER (WHERE exp AND got AND has AND good) AS correct, count(*) FILTER (WHERE got AND NOT exp) AS extras FROM sem0 GROUP BY 1),
sca AS (
  SELECT o_orderkey AS doc_id, 4 AS scalar_expected, CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 4 END AS scalar_covered,
    (CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN o_custkey < 700 THEN 1.0::DOUBLE ELSE 0 END
     + CASE WHEN o_orderstatus = 'P' THEN 0.0::DOUBLE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2.0::DOUBLE / 5 ELSE 0.0::DOUBLE END) / 4 AS scalar_score FROM orders)"""


@query("c03_record_prediction_join", f"""
WITH {SCORES}
SELECT r.doc_id, r.tier, n.doc_id IS NOT NULL AS prediction_available,
  round(CASE WHEN n.doc_id IS NOT NULL THEN n.covered / nullif(n.expected, 0)::DOUBLE ELSE 0 END, 6) AS numeric_coverage,
  round(CASE WHEN n.doc_id IS NOT NULL THEN n.correct / nullif(n.covered, 0)::DOUBLE END, 6) AS numeric_accuracy,
  round(CASE WHEN n.doc_id IS NOT NULL THEN scalar_score ELSE 0 END, 6) AS scalar_score
FROM recs r LEFT JOIN num n USING (doc_id) LEFT JOIN sca USING (doc_id)
""")
def record_prediction_join(spark, sf):
    t = Tables(spark, sf)
    truth, proposed = score_tables(t)
    keys = ["doc_id"]
    s = scoring.record_scores(order_records(t), t.lineitem.select(F.col("l_orderkey").alias("doc_id")),
                              scoring.scalar_field_score(truth["scalar"], proposed["scalar"], keys),
                              scoring.numeric_score(truth["numeric"], proposed["numeric"], keys),
                              scoring.semantic_score(truth["semantic"], proposed["semantic"], keys), keys)
    return s.select("doc_id", "tier", "prediction_available", fx.r6("numeric_coverage").alias("numeric_coverage"),
                    fx.r6("numeric_accuracy").alias("numeric_accuracy"), fx.r6("scalar_score").alias("scalar_score"))


@query("c04_lane_comparison", f"""
WITH {fx.LANES},
g AS (SELECT doc_id, count(*) AS present, count(*) FILTER (WHERE is_equal) AS agree, count(*) FILTER (WHERE NOT is_equal) AS differ,
             count(*) FILTER (WHERE NOT is_equal AND field LIKE 'theta%') AS major FROM cmp GROUP BY 1),
l AS (SELECT o_orderkey AS doc_id, o_orderstatus <> 'P' AS ok FROM orders)
SELECT l.doc_id, ok AS comparable, ok AND coalesce(differ, 0) = 0 AS consistent,
  round(CASE WHEN ok THEN coalesce(agree, 0) / greatest(coalesce(present, 0), 1)::DOUBLE ELSE 0.0::DOUBLE END, 6) AS agreement,
  CASE WHEN ok THEN coalesce(present, 0) ELSE 0 END AS compared_fields, CASE WHEN ok THEN coalesce(differ, 0) ELSE 0 END AS difference_count,
  CASE WHEN ok THEN coalesce(major, 0) ELSE 0 END AS major_difference_count
FROM l LEFT JOIN g USING (doc_id)
""")
def lane_comparison(spark, sf):
    t = Tables(spark, sf)
    text, vision = fx.lane_claims(t)
    lanes = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(True).alias("text_available"), (F.col("o_orderstatus") != "P").alias("vision_available"))
    s = claims.comparison_summary(claims.compare_lanes(text, vision, ["doc_id"]), lanes, ["doc_id"])
    return s.withColumn("agreement", fx.r6("agreement")).drop("text_available", "vision_available")


def order_json(t: Tables, changed: bool):
    """One JSON document per order; the changed side shifts prices, drops keys and adds one."""
    price = F.floor("o_totalprice").cast("bigint")
    if changed:
        body = F.struct(
            F.struct(F.when(F.col("o_orderstatus") == "F", F.lit("CBZ")).otherwise(F.lit("vpa")).alias("compound"),
                     F.col("o_orderstatus").alias("status")).alias("head"),
            F.array(price + F.when(F.col("o_custkey") < 500, F.lit(0)).otherwise(F.floor(price * 0.2).cast("bigint")), F.col("o_custkey")).alias("numbers"),
            F.lower(F.col("o_orderpriority")).alias("tier"), F.lit(True).alias("added"))
    else:
        body = F.struct(
            F.struct(F.lit("cbz").alias("compound"), F.col("o_orderstatus").alias("status")).alias("head"),
            F.array(price, F.col("o_custkey"), F.lit(7)).alias("numbers"), F.col("o_orderpriority").alias("tier"),
            F.array().cast("array<int>").alias("empty"))
    return t.spread("orders").select(F.col("o_orderkey").alias("doc_id"), F.to_json(body).alias("json"))


LEAF_SQL = """o AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders),
l AS (
  SELECT o_orderkey AS doc_id, unnest(['/head/compound', '/head/status', '/numbers/0', '/numbers/1', '/numbers/2', '/tier', '/empty']) AS pointer,
         unnest(['head.compound', 'head.status', 'numbers[1]', 'numbers[2]', 'numbers[3]', 'tier', 'empty']) AS field,
         unnest(['cbz', o_orderstatus, CAST(price AS VARCHAR), CAST(o_custkey AS VARCHAR), '7', o_orderpriority, '[]']) AS v,
         unnest([NULL, NULL, price, o_custkey, 7, NULL, NULL]) AS n FROM o),
p AS (
  SELECT o_orderkey AS doc_id, unnest(['/head/compound', '/head/status', '/numbers/0', '/numbers/1', '/tier', '/added']) AS pointer,
         unnest(['head.compound', 'head.status', 'numbers[1]', 'numbers[2]', 'tier', 'added']) AS field,
         unnest([CASE WHEN o_orderstatus = 'F' THEN 'CBZ' ELSE 'vpa' END, o_orderstatus, CAST(price + CASE WHEN o_custkey < 500 THEN 0 ELSE CAST(floor(price * 0.2::DOUBLE) AS BIGINT) END AS VARCHAR),
                 CAST(o_custkey AS VARCHAR), lower(o_orderpriority), 'true']) AS v,
         unnest([NULL, NULL, price + CASE WHEN o_custkey < 500 THEN 0 ELSE CAST(floor(price * 0.2::DOUBLE) AS BIGINT) END, o_custkey, NULL, NULL]) AS n FROM o),
d AS (
  SELECT coalesce(l.doc_id, p.doc_id) AS doc_id, coalesce(l.pointer, p.pointer) AS pointer, coalesce(l.field, p.field) AS field, coalesce(l.v, '—') AS reference_value, coalesce(p.v, '—') AS prediction_value,
    CASE WHEN l.n IS NULL OR p.n IS NULL THEN NULL WHEN l.n = 0 AND p.n = 0 THEN 0.0 WHEN l.n = 0 THEN 'inf'::DOUBLE ELSE 100.0::DOUBLE * (p.n - l.n) / abs(l.n) END AS delta_percent,
    CASE WHEN l.doc_id IS NULL THEN 'prediction only' WHEN p.doc_id IS NULL THEN 'reference only'
         WHEN l.n IS NOT NULL AND p.n IS NOT NULL THEN CASE WHEN abs(l.n - p.n) <= 1e-8::DOUBLE + 0.05::DOUBLE * greatest(abs(l.n), 1e-8::DOUBLE) THEN 'Match' ELSE 'Different' END
         WHEN lower(l.v) = lower(p.v) THEN 'Match' ELSE 'Different' END AS status
  FROM l FULL OUTER JOIN p ON l.doc_id = p.doc_id AND l.pointer = p.pointer)"""


@query("c05_leaf_diff", f"""
WITH {LEAF_SQL} SELECT doc_id, pointer, field, reference_value, prediction_value, round(delta_percent, 6) AS delta_percent, status FROM d
""")
def leaf_diff(spark, sf):
    t = Tables(spark, sf)
    d = jsondiff.compare_documents(order_json(t, False), order_json(t, True), ["doc_id"], "json", "json", levels=4)
    return d.select("doc_id", "pointer", "field", "reference_value", "prediction_value", fx.r6("delta_percent").alias("delta_percent"), "status")


def rates(df):
    return df.withColumn("coverage", fx.r6("coverage")).withColumn("accuracy", fx.r6("accuracy"))


RATES = "expected, covered, correct, extras, round(covered / nullif(expected, 0)::DOUBLE, 6) AS coverage, round(correct / nullif(covered, 0)::DOUBLE, 6) AS accuracy"


@query("c06_parameter_alignment", f"WITH {SCORES} SELECT doc_id, {RATES} FROM num WHERE expected + extras > 0 OR covered > 0")
def parameter_alignment(spark, sf):
    truth, proposed = score_tables(Tables(spark, sf))
    return rates(scoring.numeric_score(truth["numeric"], proposed["numeric"], ["doc_id"]))


@query("c07_semantic_claim_join", f"WITH {SCORES} SELECT doc_id, {RATES} FROM sem")
def semantic_claim_join(spark, sf):
    truth, proposed = score_tables(Tables(spark, sf))
    return rates(scoring.semantic_score(truth["semantic"], proposed["semantic"], ["doc_id"]))


def line_extractions(t: Tables):
    """One extraction per line: cohort text, dose text, two parameters, one reproduction target."""
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    n = F.col("l_quantity").cast("int").cast("string")
    point = F.struct(F.lit(1.0).alias("time"), price.alias("value"), F.lit(None).cast("double").alias("lower"), (price * 2).alias("upper"))
    target = F.struct(F.lit("t1").alias("id"), F.lit("concentration_time").alias("kind"), F.lit("mean").alias("statistic"), F.lit("h").alias("x_unit"),
                      F.lit(None).cast("string").alias("y_unit"), F.lit("linear").alias("scale"), F.array(point).alias("points"))
    theta = F.array(F.struct(F.lit("cl").alias("name"), q.alias("typical")), F.struct(F.lit("V").alias("name"), price.alias("typical")),
                    F.struct(F.lit(" ").alias("name"), F.col("l_tax").alias("typical")), F.struct(F.lit("CL").alias("name"), F.when(F.col("l_tax") > 0.02, q + 1).alias("typical")))
    return t.spread("lineitem").select(
        *fx.LINE_KEYS, "l_tax", "l_returnflag", "l_linestatus",
        F.concat(F.lit("Young N: "), n, F.lit(" Age: "), n, F.lit(" ± 2 (1-9)")).alias("population"),
        F.concat(n, F.lit(" mg/kg every 12 h")).alias("dose"), F.when(F.col("l_returnflag") == "A", F.lit("oral")).alias("route"),
        F.lit("Two-compartment model").alias("description"), F.lit("Cbz").alias("compound"),
        F.struct(theta.alias("theta"), F.lit(None).cast(semantics.OMEGA).alias("omega"), F.lit(None).cast(semantics.COVARIANCE).alias("omega_covariance"),
                 F.lit(None).cast(semantics.SIGMA).alias("sigma")).alias("parameters"),
        F.array(F.lit("WT"), F.lit("Age")).alias("covariates"), F.array(target).cast(semantics.TARGETS).alias("reproduction_targets"))


@query("c08_semantic_claim_unnest", """
WITH l AS (SELECT *, CAST(l_quantity AS INTEGER) AS q, l_returnflag = 'A' AS oral FROM lineitem),
r AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    unnest(['implementation.advan', 'implementation.trans', 'canonical.compartments', 'population.n_total', 'population.cohort_count', 'population.cohort1.n',
            'population.cohort1.age.mean_sd.mean', 'population.cohort1.age.mean_sd.sd', 'population.cohort1.age.range.minimum', 'population.cohort1.age.range.maximum',
            'dosing.1.amount', 'dosing.1.interval', 'target.1.point.1.time', 'target.1.point.1.value', 'target.1.point.1.upper',
            'canonical.input', 'canonical.elimination', 'canonical.parameterization', 'dosing.1.route', 'dosing.1.administration', 'dosing.1.amount_unit', 'dosing.1.interval_unit', 'dosing.1.steady_state',
            'target.1.kind', 'target.1.statistic', 'target.1.x_unit', 'target.1.scale']) AS path,
    unnest([CASE WHEN oral THEN 4.0 ELSE 3 END, 4.0, 2.0, q, 1.0, q, q, 2.0, 1.0, 9.0, q, 12.0, 1.0, l_extendedprice, l_extendedprice * 2,
            NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL]::DOUBLE[]) AS number,
    unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
            CASE WHEN oral THEN 'first_order' ELSE 'direct' END, 'linear', 'clearance_volume', CASE WHEN oral THEN 'oral' END, 'unspecified', 'mg/kg', 'h', 'false',
            'concentration_time', 'mean', 'h', 'linear']) AS text
  FROM l)
SELECT path, text, count(*) AS n, round(sum(number), 2) AS total FROM r WHERE number IS NOT NULL OR text IS NOT NULL GROUP BY ALL
""")
def semantic_claim_unnest(spark, sf):
    e = semantics.as_struct(semantics.enrich(line_extractions(Tables(spark, sf))))
    rows = claims.semantic_claims(e, fx.LINE_KEYS, F.col("extraction"))
    return rows.groupBy("path", "text").agg(F.count("*").alias("n"), F.round(F.sum("number"), 2).alias("total"))


@query("c09_extraction_claim_unnest", """
WITH r AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    unnest(['model_present', 'compound', 'route', 'covariates', 'structural.description', 'structural.canonical.input', 'structural.implementation_status',
            'n_subjects', 'structural.advan', 'structural.trans', 'theta.CL', 'theta.V', 'theta.3']) AS field,
    unnest([CASE WHEN l_linestatus = 'F' THEN 'true' ELSE 'false' END, 'Cbz', CASE WHEN l_returnflag = 'A' THEN 'oral' END, 'age|wt', 'Two-compartment model',
            CASE WHEN l_returnflag = 'A' THEN 'first_order' ELSE 'direct' END, 'inferred', NULL, NULL, NULL, NULL, NULL, NULL]) AS text,
    unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(l_quantity AS INTEGER), CASE WHEN l_returnflag = 'A' THEN 4 ELSE 3 END, 4,
            CASE WHEN l_tax > 0.02 THEN l_quantity + 1 END, l_extendedprice, l_tax]::DOUBLE[]) AS number
  FROM lineitem)
SELECT field, text, count(*) AS n, round(sum(number), 2) AS total FROM r WHERE NOT (field LIKE 'theta%' AND number IS NULL) GROUP BY ALL
""")
def extraction_claim_unnest(spark, sf):
    e = semantics.as_struct(semantics.enrich(line_extractions(Tables(spark, sf))))
    rows = X.inline_rows(e, fx.LINE_KEYS, claims.extraction_claims(F.col("extraction"), F.col("l_linestatus") == "F"), "field")
    shown = ["model_present", "compound", "route", "covariates", "structural.description", "structural.canonical.input", "structural.implementation_status",
             "n_subjects", "structural.advan", "structural.trans"]
    kept = rows.filter(F.col("field").isin(shown) | F.startswith("field", F.lit("theta.")))
    return kept.groupBy("field", "text").agg(F.count("*").alias("n"), F.round(F.sum("number"), 2).alias("total"))


@query("c10_supersession_anti_join", f"""
WITH {QUAL_ORDERS} SELECT library_id, qualification_id, status FROM q
WHERE NOT EXISTS (SELECT 1 FROM q s WHERE s.library_id = q.library_id AND s.supersedes = q.qualification_id)
""")
def supersession_anti_join(spark, sf):
    q, _ = qualification_orders(Tables(spark, sf))
    return catalogue.current_records(q).select("library_id", "qualification_id", "status")


@query("c11_ledger_binding", f"""
WITH {fx.CLAIMS},
active AS (SELECT DISTINCT doc_id, 'theta::' || id AS claim_id, domain FROM claims WHERE status <> 'unresolved'),
one AS (SELECT doc_id, claim_id, min(domain) AS domain FROM active GROUP BY 1, 2),
ev AS (SELECT o_orderkey AS doc_id, o_orderstatus, o_orderpriority FROM orders),
cited AS (
  SELECT DISTINCT doc_id, 'theta::c' || n AS claim_id FROM ev, (SELECT unnest([1, 2, 3]) AS n) WHERE o_orderstatus <> 'P'),
m AS (SELECT c.doc_id, c.claim_id, o.domain FROM cited c LEFT JOIN one o USING (doc_id, claim_id)),
b AS (SELECT doc_id, count(*) FILTER (WHERE domain IS NULL) AS invalid_ids, list_sort(list(DISTINCT domain) FILTER (WHERE domain IS NOT NULL)) AS bound FROM m GROUP BY 1),
f AS (SELECT ev.doc_id, coalesce(b.bound, []) AS bound, coalesce(invalid_ids, 0) AS invalid_ids, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS items_without_ids,
      CASE WHEN o_orderpriority LIKE '1%' THEN ['structure', 'theta'] ELSE ['theta'] END AS req FROM ev LEFT JOIN b USING (doc_id))
SELECT doc_id, array_to_string(bound, ',') AS bound_domains, invalid_ids, CAST(items_without_ids AS BIGINT) AS items_without_ids,
  array_to_string(list_filter(req, lambda x: NOT list_contains(bound, x)), ',') AS missing_domains,
  invalid_ids = 0 AND items_without_ids = 0 AND len(list_filter(req, lambda x: NOT list_contains(bound, x))) = 0 AS ready
FROM f
""")
def ledger_binding(spark, sf):
    t = Tables(spark, sf)
    c = fx.claims(t).withColumn("claim_id", F.concat(F.lit("theta::"), "id")).withColumn("superseded_by", F.lit(""))
    ids = F.when(F.col("o_orderstatus") != "P", F.array(*[F.lit(f"theta::c{i}") for i in (1, 2, 3)])).otherwise(F.array(F.lit("")))
    evidence = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("item_no"), ids.alias("claim_ids"))
    required = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("structure"), F.lit("theta")))
                               .otherwise(F.array(F.lit("theta"))).alias("domains"))
    b = ledger.binding_checks(evidence, ledger.active_claims(c), required)
    return b.select("doc_id", F.array_join("bound_domains", ",").alias("bound_domains"), "invalid_ids", "items_without_ids",
                    F.array_join("missing_domains", ",").alias("missing_domains"), "ready")


@query("c12_review_verdicts", f"""
WITH {fx.CLAIMS},
k AS (SELECT *, CAST(doc_id AS VARCHAR) || '-' || seq AS claim_id FROM claims),
said AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN ['zz', 'aa'] WHEN o_orderpriority LIKE '3%' THEN ['aa', ' ', 'zz', 'aa'] ELSE [' '] END AS values
      FROM orders WHERE o_orderstatus = 'F'),
v AS (SELECT doc_id, unnest(values) AS corrected, generate_subscripts(values, 1) AS no FROM said),
h AS (SELECT k.*, v.no, v.corrected, trim(v.corrected) <> '' AS fixed, k.claim_id || '_correction_' || substr(sha256(v.corrected), 1, 8) AS new_id FROM k JOIN v USING (doc_id) WHERE k.id = 'c1'),
f AS (SELECT *, lag(new_id) OVER (PARTITION BY doc_id, claim_id ORDER BY no) AS mark FROM h WHERE fixed),
r AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM f e WHERE e.doc_id = f.doc_id AND e.field = f.field AND e.corrected = f.corrected AND e.model_stage = f.model_stage AND (e.no < f.no OR e.no = f.no AND e.seq < f.seq)))
SELECT 'contradiction' AS kind, doc_id, claim_id, CASE WHEN fixed THEN 'resolved' ELSE 'open' END || no AS detail, NULL::DOUBLE AS confidence FROM h
UNION ALL
SELECT 'replacement', doc_id, 'review::' || new_id, concat_ws('|', claim_id, domain, field, corrected, model_stage, status2, 'p9', 'table', coalesce(mark, '-')), round(greatest(0.7::DOUBLE, confidence), 6) FROM (SELECT *, 'reported' AS status2 FROM r)
UNION ALL
SELECT 'superseded', doc_id, claim_id, arg_max(new_id, no), NULL FROM f GROUP BY doc_id, claim_id
""")
def review_verdicts(spark, sf):
    """Up to four verdicts for one claim in order: the last correction holds, also where its id is the smaller one."""
    t = Tables(spark, sf)
    k = fx.claims(t).withColumn("claim_id", F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("seq").cast("string")))
    p = F.substring("o_orderpriority", 1, 1)
    values = F.when(p.isin("1", "2"), X.literal_array(["zz", "aa"])).when(p == "3", X.literal_array(["aa", " ", "zz", "aa"])).otherwise(X.literal_array([" "]))
    said = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(values).alias("no", "corrected_value"))
    c1 = k.filter(F.col("id") == "c1").select("doc_id", "claim_id", F.col("seq").alias("place"))
    verdicts = said.join(c1, "doc_id").select("doc_id", "claim_id", F.struct("no", "place").alias("seq"), "corrected_value", F.lit("contradicted").alias("verdict"), F.lit("p9").alias("source_locator"),
                                              F.lit("table").alias("evidence"), F.lit("reason").alias("reason"))
    out = ledger.apply_review(k.withColumn("seq", F.struct(F.lit(-1).alias("no"), F.col("seq").alias("place"))), verdicts, "review")
    none = F.lit(None).cast("double")
    made = F.concat_ws("|", F.element_at("dependencies", 1), "domain", "field", "value", "model_stage", "status", "source_locator", "evidence", F.coalesce("superseded_by", F.lit("-")))
    state = F.concat(F.when(F.col("resolved"), "resolved").otherwise("open"), (F.col("seq.no") + 1).cast("string"))
    return (
        out["contradictions"].select(F.lit("contradiction").alias("kind"), "doc_id", "claim_id", state.alias("detail"), none.alias("confidence"))
        .unionByName(out["replacements"].select(F.lit("replacement").alias("kind"), "doc_id", "claim_id", made.alias("detail"), fx.r6("confidence").alias("confidence")))
        .unionByName(out["claims"].filter(F.col("superseded_by").isNotNull() & (F.col("seq.no") < 0)).select(F.lit("superseded").alias("kind"), "doc_id", "claim_id", F.col("superseded_by").alias("detail"), none.alias("confidence")))
    )


@query("c13_question_resolution", """
SELECT user_id AS doc_id, 'q' || event_id AS question_id FROM events e WHERE event_type = 'view'
 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id = e.user_id AND r.event_id = e.event_id + 1)
""")
def question_resolution(spark, sf):
    t = Tables(spark, sf)
    asked = t.events.filter("event_type = 'view'").select(F.col("user_id").alias("doc_id"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("question_id"))
    done = t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("doc_id"), F.concat(F.lit("q"), (F.col("event_id") - 1).cast("string")).alias("question_id"))
    return ledger.drop_resolved(asked, done)


TOPICS = {"en": ["license", "thou"], "de": ["keit", "und"], "fr": ["ation", "mente"]}


@query("c14_topic_question_join", """
SELECT doc_id, topic FROM documents, (VALUES ('en', '(?i)license|thou'), ('de', '(?i)keit|und'), ('fr', '(?i)ation|mente')) AS t(topic, pat)
WHERE contains(lang, topic) OR regexp_matches(text, pat)
""")
def topic_question_join(spark, sf):
    t = Tables(spark, sf)
    return chunks.topic_terms(t.spread("documents"), "lang", "text", TOPICS).select("doc_id", "topic")


KEYWORDS = ["license", "the", "und", "ation", "thou", "les"]


@query("c15_chunk_retrieval", """
WITH d AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE regexp_matches(text, '\\S')),
n AS (SELECT *, length(text) AS n, CAST(ceil(greatest(length(text) - 600, 0) / 500.0) AS INTEGER) + 1 AS k FROM d),
c AS (SELECT doc_id, text, n, unnest(range(1, k + 1)) AS idx FROM n),
s AS (SELECT doc_id, idx, (idx - 1) * 500 + 1 AS start, least(n, (idx - 1) * 500 + 600) AS "end", substr(text, CAST((idx - 1) * 500 + 1 AS BIGINT), 600) AS chunk FROM c),
w AS (SELECT *, regexp_split_to_array(lower(chunk), '[^0-9a-z_]+') AS toks FROM s),
sc AS (SELECT doc_id, idx, start, "end", chunk, len(list_filter(toks, lambda x: x IN ('license', 'the', 'und', 'ation', 'thou', 'les'))) + CASE WHEN idx = 1 THEN 0.25::DOUBLE ELSE 0 END AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rn FROM sc)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, 'C' || lpad(CAST(idx AS VARCHAR), 3, '0') AS chunk_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", round(score, 6) AS score, md5(chunk) AS chunk_md5 FROM r WHERE rn <= 3
""")
def chunk_retrieval(spark, sf):
    t = Tables(spark, sf)
    c = chunks.retrieve_chunks(t.spread("documents"), "text", ["doc_id"], KEYWORDS, 3, 600, 100)
    return c.select("doc_id", "idx", fx.window_id("idx").alias("chunk_id"), "start", "end", fx.r6("score").alias("score"), F.md5("chunk_text").alias("chunk_md5"))


@query("c16_referential_integrity", """
SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
""")
def referential_integrity(spark, sf):
    t = Tables(spark, sf)
    return keyed.orphans(t.lineitem, "l_orderkey", t.orders.filter("o_orderstatus <> 'P'"), "o_orderkey")


def curation(t: Tables):
    m = fx.models(t).withColumns({"review_status": F.lit("unreviewed"), "strict_score_eligible": F.lit(False), "audit": F.lit("")})
    d = fx.models(t).filter(F.col("quality").isNotNull()).select(
        "reference_id", F.when(F.col("lang") == "en", F.lit(" a")).when(F.col("lang") == "fr", F.lit("B")).otherwise(F.lit("c")).alias("tier"),
        ((F.col("toxic") == 0) & (F.col("partition") != "test")).alias("training_eligible"),
        F.when(F.col("toxic") == 1, F.lit("disputed")).otherwise(F.lit("")).alias("review_status"), F.lit("checked  twice").alias("notes"))
    return m, d


@query("c17_curation_decisions", f"""
WITH {fx.MODELS},
x AS (SELECT *, quality IS NOT NULL AS hit, CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' ELSE 'C' END AS nt, CASE WHEN toxic = 1 THEN 'disputed' ELSE 'reviewed' END AS ns FROM models)
SELECT reference_id, CASE WHEN hit THEN nt ELSE tier END AS tier, CASE WHEN hit THEN ns ELSE 'unreviewed' END AS review_status,
  hit AND nt IN ('A', 'B') AND ns = 'reviewed' AS strict_score_eligible,
  CASE WHEN hit THEN toxic = 0 AND partition <> 'test' AND nt IN ('A', 'B') ELSE training_eligible END AS training_eligible,
  CASE WHEN hit THEN 'curator=kim; from=' || tier || '; to=' || nt || '; notes=checked twice' ELSE '' END AS audit
FROM x
""")
def curation_decisions(spark, sf):
    m, d = curation(Tables(spark, sf))
    return corpus.apply_decisions(m, d, "kim").select("reference_id", "tier", "review_status", "strict_score_eligible", "training_eligible", "audit")


@query("c17_corrections", """
SELECT CAST(doc_id AS VARCHAR) AS reference_id, CASE lang
  WHEN 'de' THEN '{"n":' || doc_id || ',"who":{"lang":"xx"}}'
  WHEN 'fr' THEN '{"n":' || n_chars || ',"who":{"lang":"fr"},"new":{"list":[1]}}'
  ELSE '{"n":' || n_chars || ',"who":{"lang":"' || lang || '"}}' END AS target FROM documents
""")
def corrections(spark, sf):
    d = Tables(spark, sf).documents
    rid = F.col("doc_id").cast("string").alias("reference_id")
    models = d.select(rid, F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit(',"who":{"lang":"'), F.col("lang"), F.lit('"}}')).alias("target"))
    german, french = d.filter("lang = 'de'"), d.filter("lang = 'fr'")
    fixes = german.select(rid, F.lit(1).alias("seq"), F.lit("/n").alias("pointer"), F.lit("0").alias("value_json")).unionByName(
        german.select(rid, F.lit(2).alias("seq"), F.lit("/who/lang").alias("pointer"), F.lit('"xx"').alias("value_json"))).unionByName(
        german.select(rid, F.lit(3).alias("seq"), F.lit("/n").alias("pointer"), F.col("doc_id").cast("string").alias("value_json"))).unionByName(
        french.select(rid, F.lit(1).alias("seq"), F.lit("/new/list").alias("pointer"), F.lit("[1]").alias("value_json")))
    return corpus.apply_corrections(models, fixes, "target", batch=2)


@query("c18_correction_coverage", f"""
WITH {fx.MODELS}, d AS (SELECT reference_id, partition, lang FROM models WHERE quality IS NOT NULL)
SELECT reference_id, 'correction_without_decision' AS error FROM models WHERE lang = 'es' AND quality IS NULL
UNION ALL SELECT reference_id, 'test_model_not_trainable' FROM models WHERE quality IS NOT NULL AND partition = 'test'
UNION ALL SELECT reference_id, 'invalid_correction_source' FROM models WHERE lang = 'es' AND compound_group = 'src1'
""")
def correction_coverage(spark, sf):
    t = Tables(spark, sf)
    m, d = curation(t)
    c = fx.models(t).filter(F.col("lang") == "es").select("reference_id", F.lit("/title").alias("pointer"),
                                                          F.when(F.col("compound_group") == "src1", "guess").otherwise("custom").alias("source"), F.lit('"x"').alias("value_json"))
    return corpus.curation_errors(m, d.withColumn("training_eligible", F.lit(True)), corpus.check_corrections(c))


@query("c19_decision_reuse", """
WITH dec AS (
  SELECT page_id, sha256(html) AS sha, CASE WHEN contains(url, '/en/') THEN 'needs_review' WHEN contains(url, '/fr/') THEN 'failed' ELSE 'machine_consistent' END AS status,
         CASE WHEN contains(url, 'www.') THEN '3.0.0' ELSE '3.1.0' END AS ver FROM pages)
SELECT p.page_id, d.page_id IS NOT NULL AS reused, d.status AS decision_status
FROM pages p LEFT JOIN dec d ON d.page_id = p.page_id AND d.status <> 'failed' AND d.ver = '3.1.0' AND NOT contains(p.url, 'page=')
""")
def decision_reuse(spark, sf):
    t = Tables(spark, sf)
    n = F.col("page_id").cast("string").alias("pmid")
    old = F.when(F.contains("url", F.lit("page=")), F.sha2(F.concat("html", F.lit(" ")), 256)).otherwise(F.sha2("html", 256))
    dec = t.pages.select(n, F.sha2("html", 256).alias("source_sha256"), F.lit("evidence").alias("pipeline"),
                         F.when(F.contains("url", F.lit("www.")), "3.0.0").otherwise(config.PROMPT_VERSION).alias("pipeline_version"),
                         F.when(F.contains("url", F.lit("/en/")), "needs_review").when(F.contains("url", F.lit("/fr/")), "failed").otherwise("machine_consistent").alias("status"),
                         F.col("page_id").alias("decided_at"))
    work = t.pages.select("page_id", n, old.alias("source_sha256"))
    return triage.reuse_decisions(work, dec, "evidence").select("page_id", "reused", "decision_status")


@query("c20_prediction_reuse", """
SELECT l_orderkey AS article_id, count(*) AS n_records, bool_and(l_linestatus = 'F' AND l_discount > 0.01 AND l_tax <> 0.08) AS reusable FROM lineitem GROUP BY 1
""")
def prediction_reuse(spark, sf):
    t = Tables(spark, sf)
    rid = F.concat_ws("-", *[F.col(k).cast("string") for k in fx.LINE_KEYS])
    sources = t.lineitem.select(F.col("l_orderkey").alias("article_id"), rid.alias("record_id"), F.sha2(F.col("l_tax").cast("string"), 256).alias("source_sha256"))
    env = t.lineitem.select(rid.alias("record_id"), F.lit("extraction").alias("task"), F.lit("dual").alias("mode"), F.lit("p/m").alias("endpoint"),
                            F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.01), "complete").otherwise("error").alias("status"),
                            F.sha2(F.when(F.col("l_tax") == 0.08, F.lit("old")).otherwise(F.col("l_tax").cast("string")), 256).alias("source_sha256"))
    return scoring.reusable_articles(env, sources, "extraction", "dual", "p/m")


@query("c21_stage_cache", """
SELECT doc_id, quality IS NOT NULL AND toxic = 0 AS cached FROM documents LEFT JOIN labels USING (doc_id)
""")
def stage_cache(spark, sf):
    t = Tables(spark, sf)
    def prints(df):
        return df.withColumn("fingerprint", ledger.stage_fingerprint([F.sha2("text", 256), F.lit(config.PROMPT_VERSION), F.lit("reconnaissance"), F.col("doc_id")]))
    requests = prints(t.documents).select("doc_id", "fingerprint")
    cache = prints(t.documents.join(t.labels, "doc_id")).select("fingerprint", (F.col("toxic") == 0).alias("valid"), F.lit("{}").alias("result"))
    reused, missing = ledger.split_cached(requests, cache)
    return reused.select("doc_id", "cached").unionByName(missing.select("doc_id", F.lit(False).alias("cached")))


@query("c22_catalogue_skip", """
SELECT o_orderkey, 'pmid_' || o_custkey AS entry_id, c_custkey IS NOT NULL AS skipped FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
""")
def catalogue_skip(spark, sf):
    t = Tables(spark, sf)
    known = t.customer.filter("c_acctbal > 0").select(F.concat(F.lit("pmid_"), F.col("c_custkey").cast("string")).alias("library_id"))
    return triage.split_indexed(t.orders, known, F.concat(F.lit("pmid_"), F.col("o_custkey").cast("string"))).select("o_orderkey", "entry_id", "skipped")


@query("c23_fetch_outcomes", f"""
WITH {fx.MANIFEST},
oc AS (SELECT CAST(c_custkey AS VARCHAR) AS pmid, c_acctbal > 3000 AS success, 'p/' || c_custkey AS path, CASE WHEN c_acctbal > 3000 THEN '' ELSE 'HTTP 403' END AS error,
       CASE WHEN c_nationkey < 10 THEN 'http://new' ELSE ' ' END AS final_url FROM customer WHERE c_mktsegment <> 'BUILDING'),
f AS (SELECT m.*, row_number() OVER (PARTITION BY pmid ORDER BY ord) AS rn FROM manifest m)
SELECT ord, f.pmid, CASE WHEN oc.pmid IS NULL THEN status WHEN success THEN 'fetched' ELSE 'fetch_failed' END AS status,
  CASE WHEN oc.pmid IS NULL THEN local_path ELSE oc.path END AS local_path, CASE WHEN oc.pmid IS NOT NULL AND oc.error <> '' THEN oc.error ELSE fetch_error END AS fetch_error,
  CASE WHEN oc.pmid IS NOT NULL AND trim(oc.final_url) <> '' THEN oc.final_url ELSE f.final_url END AS final_url
FROM f LEFT JOIN oc ON rn = 1 AND oc.pmid = f.pmid
""")
def fetch_outcomes(spark, sf):
    t = Tables(spark, sf)
    ok = F.col("c_acctbal") > 3000
    oc = t.customer.filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("pmid"), ok.alias("success"), F.concat(F.lit("p/"), F.col("c_custkey").cast("string")).alias("path"),
        F.when(ok, F.lit("")).otherwise(F.lit("HTTP 403")).alias("error"), F.when(F.col("c_nationkey") < 10, F.lit("http://new")).otherwise(F.lit(" ")).alias("final_url"))
    return triage.merge_fetch_outcomes(fx.manifest(t), oc, "ord").select("ord", "pmid", "status", "local_path", "fetch_error", "final_url")


def template_sql() -> str:
    rows = []
    for advan, spec in config.TEMPLATES.items():
        for i, (name, value) in enumerate(zip(spec["names"], spec["values"]), start=1):
            rows.append(f"({advan}, {spec['trans']}, {i}, '{name}', {value}::DOUBLE, {len(spec['names'])})")
    return "tpl(advan, trans, pos, name, dflt, n) AS (VALUES " + ", ".join(rows) + ")"


@query("c24_template_mapping", f"""
WITH {template_sql()},
r AS (SELECT p_partkey, CASE WHEN p_size <= 4 THEN p_size WHEN p_size <= 20 THEN 11 WHEN p_size <= 40 THEN 12 ELSE 6 END AS code, p_size,
             [p_retailprice, CASE WHEN p_size > 25 THEN -1.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END, NULL, 3.0::DOUBLE, 4.5::DOUBLE]::DOUBLE[] AS vals,
             ['ka x', p_type, '', 'Q/F', 'S'] AS names FROM part),
m AS (SELECT r.*, CASE WHEN code = 6 THEN 2 ELSE code END AS advan FROM r)
SELECT p_partkey, tpl.advan, tpl.trans, pos AS position,
  CASE WHEN pos <= 5 AND trim(names[pos]) <> '' THEN regexp_replace(trim(names[pos]), '[^A-Za-z0-9_.-]', '_', 'g') ELSE tpl.name END AS name,
  round(CASE WHEN pos <= 5 AND vals[pos] > 0 THEN vals[pos] ELSE dflt END, 6) AS value, coalesce(pos <= 5 AND vals[pos] > 0, false) AS supported,
  CASE WHEN 5 > n THEN 5 - n ELSE 0 END AS n_unmapped, m.code = 6 AS structure_inferred
FROM m JOIN tpl ON tpl.advan = m.advan
""")
def template_mapping(spark, sf):
    t = Tables(spark, sf)
    size = F.col("p_size")
    code = F.when(size <= 4, size).when(size <= 20, 11).when(size <= 40, 12).otherwise(6)
    item = lambda n, v: F.struct(n.alias("name"), v.cast("double").alias("typical"))
    theta = F.array(item(F.lit("ka x"), F.col("p_retailprice")), item(F.col("p_type"), F.when(size > 25, F.lit(-1.0)).otherwise(size)), item(F.lit(""), F.lit(None)),
                    item(F.lit("Q/F"), F.lit(3.0)), item(F.lit("S"), F.lit(4.5)))
    m = semantics.map_template(t.spread("part").withColumns({"theta": theta, "code": code}), F.col("theta"), F.col("code"), F.lit(None).cast("int"))
    kept = ["p_partkey", "mapping.advan", "mapping.trans", F.size("mapping.unmapped").alias("n_unmapped"), "mapping.structure_inferred"]
    return X.inline_rows(m, kept, "mapping.slots", "position").withColumn("value", fx.r6("value"))


@query("c25_interpolation", """
WITH ev AS (SELECT user_id, epoch(ts) AS t, value, event_type, event_id FROM events),
curve AS (SELECT user_id, t, median(value) AS v FROM ev WHERE event_type <> 'purchase' GROUP BY 1, 2),
tg AS (SELECT user_id, event_id, t, value FROM ev WHERE event_type = 'purchase'),
lo AS (SELECT tg.event_id, max(c.t) AS lt, arg_max(c.v, c.t) AS lv FROM tg JOIN curve c ON c.user_id = tg.user_id AND c.t <= tg.t GROUP BY 1),
hi AS (SELECT tg.event_id, min(c.t) AS ht, arg_min(c.v, c.t) AS hv FROM tg JOIN curve c ON c.user_id = tg.user_id AND c.t >= tg.t GROUP BY 1)
SELECT tg.user_id, tg.event_id, round(CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL OR ht = lt THEN lv ELSE lv + (hv - lv) * ((tg.t - lt) / (ht - lt)) END, 4) AS simulated
FROM tg LEFT JOIN lo USING (event_id) LEFT JOIN hi USING (event_id)
""")
def interpolation(spark, sf):
    t = Tables(spark, sf)
    ev = t.events.select("user_id", "event_id", (fx.micros("ts") / 1e6).alias("time"), "value", "event_type")
    curve = reproduction.simulated_curve(ev.filter("event_type <> 'purchase'"), ["user_id"], "time", "value")
    targets = ev.filter("event_type = 'purchase'").select("user_id", "event_id", "time", "value")
    out = reproduction.interpolate(curve, targets, ["user_id"], points=keyed.split_points(ev, "time"))
    return out.select("user_id", "event_id", fx.r6("simulated", 4).alias("simulated"))


@query("c26_subject_event_rows", """
WITH p AS (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN 2 ELSE 1 END AS advan, c_mktsegment = 'BUILDING' AS ss, CASE WHEN c_mktsegment = 'MACHINERY' THEN 3 ELSE 1 END AS reps,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'infusion' ELSE 'bolus' END AS adm, abs(c_acctbal) AS amt FROM customer),
s AS (SELECT *, unnest([1, 2]) AS "ID" FROM p),
d AS (SELECT c_custkey, "ID", unnest(range(0, CASE WHEN ss THEN 1 ELSE reps END)) * 12.0::DOUBLE AS "TIME", 1 AS "EVID", amt AS "AMT", CASE WHEN adm = 'infusion' THEN amt / 2.0::DOUBLE ELSE 0 END AS "RATE",
  CASE WHEN ss THEN 12.0::DOUBLE ELSE 0 END AS "II", CASE WHEN ss THEN 1 ELSE 0 END AS "SS", 1 AS "CMT", 1 AS "MDV" FROM s),
o AS (SELECT c_custkey, "ID", unnest([0.0::DOUBLE, 4.0, 8.0]) AS "TIME", 0 AS "EVID", 0.0::DOUBLE AS "AMT", 0.0::DOUBLE AS "RATE", 0.0::DOUBLE AS "II", 0 AS "SS", CASE WHEN advan IN (2, 4, 12) THEN 2 ELSE 1 END AS "CMT", 0 AS "MDV" FROM s)
SELECT * FROM d UNION ALL SELECT * FROM o
""")
def subject_event_rows(spark, sf):
    t = Tables(spark, sf)
    seg = F.col("c_mktsegment")
    p = t.customer.select(
        "c_custkey", F.when(F.col("c_nationkey") < 12, 2).otherwise(1).alias("advan"), (seg == "BUILDING").alias("steady_state"), F.when(seg == "MACHINERY", 3).otherwise(1).alias("repetitions"),
        F.when(seg == "FURNITURE", "infusion").otherwise("bolus").alias("administration"), F.abs("c_acctbal").alias("amount_mg"), F.lit(12.0).alias("interval_hours"),
        F.lit(2.0).alias("duration_hours"), F.array(F.lit(0.0), F.lit(4.0), F.lit(8.0)).alias("times"))
    return reproduction.event_rows(p, ["c_custkey"], F.lit(2))


@query("c27_packaged_merge", """
WITH p AS (SELECT 'c' || c_custkey AS library_id, '1.' || c_nationkey || '.0' AS version, c_name AS title FROM customer WHERE c_acctbal > 0),
a AS (SELECT 'c' || c_custkey AS library_id, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '1.9.0' END AS version, 'local ' || c_custkey AS title FROM customer WHERE c_mktsegment <> 'MACHINERY'),
j AS (SELECT coalesce(p.library_id, a.library_id) AS library_id, p.version AS pv, a.version AS av, p.title AS p_t, a.title AS a_t, p.library_id IS NOT NULL AS hp, a.library_id IS NOT NULL AS ha,
      CAST(split_part(p.version, '.', 2) AS INTEGER) > 9 AS newer FROM p FULL OUTER JOIN a ON p.library_id = a.library_id),
k AS (SELECT *, CASE WHEN NOT ha THEN 'insert' WHEN hp AND av <> '' AND newer THEN 'upgrade' ELSE 'keep' END AS action FROM j)
SELECT library_id, action, CASE WHEN action = 'keep' THEN av ELSE pv END AS version, CASE WHEN action = 'upgrade' THEN av END AS archived_version, CASE WHEN action = 'keep' THEN a_t ELSE p_t END AS title FROM k
""")
def packaged_merge(spark, sf):
    t = Tables(spark, sf)
    k = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("library_id")
    p = t.customer.filter("c_acctbal > 0").select(k, F.concat(F.lit("1."), F.col("c_nationkey").cast("string"), F.lit(".0")).alias("version"), F.col("c_name").alias("title"))
    a = t.customer.filter("c_mktsegment <> 'MACHINERY'").select(k, F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.lit("1.9.0")).alias("version"),
                                                                F.concat(F.lit("local "), F.col("c_custkey").cast("string")).alias("title"))
    return catalogue.merge_packaged(p, a, ["title"])


@query("c28_history_merge", f"""
WITH {QUAL_ORDERS}, cur AS (SELECT library_id, qualification_id, status FROM q WHERE status = 'qualified'),
prior AS (SELECT library_id, CASE WHEN prio LIKE '5%' THEN '' ELSE qualification_id END AS qualification_id, 'old' AS status FROM q WHERE prio NOT LIKE '1%')
SELECT * FROM cur UNION ALL SELECT * FROM prior p WHERE qualification_id = '' OR NOT EXISTS (SELECT 1 FROM cur c WHERE c.library_id = p.library_id AND c.qualification_id = p.qualification_id)
""")
def history_merge(spark, sf):
    t = Tables(spark, sf)
    q, _ = qualification_orders(t)
    p = q.join(t.orders.select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("qualification_id"), "o_orderpriority"), "qualification_id")
    cur = p.filter("status = 'qualified'").select("library_id", "qualification_id", "status")
    prior = p.filter(~F.col("o_orderpriority").startswith("1")).select(
        "library_id", F.when(F.col("o_orderpriority").startswith("5"), F.lit("")).otherwise(F.col("qualification_id")).alias("qualification_id"), F.lit("old").alias("status"))
    return catalogue.merge_history(cur, prior)


@query("c29_study_model_join", """
WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderstatus AS pmid, o_orderkey AS row_no, o_orderpriority AS cell, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, s.row_no AS study_row, coalesce(s.cell, '') AS study_cell FROM lineitem l
LEFT JOIN s ON s.rn = 1 AND s.doc = CAST(l.l_partkey AS VARCHAR) AND s.pmid = l.l_linestatus
""")
def study_model_join(spark, sf):
    t = Tables(spark, sf)
    studies = t.orders.select(F.col("o_custkey").cast("string").alias("doc"), F.col("o_orderstatus").alias("pmid"), F.col("o_orderkey").alias("row_no"), F.array("o_orderpriority").alias("cells"))
    m = t.lineitem.select(*fx.LINE_KEYS, F.col("l_partkey").cast("string").alias("doc"), F.col("l_linestatus").alias("pmid"))
    return corpus.study_join(m, studies).select(*fx.LINE_KEYS, "study_row", F.get("study_cells", F.lit(0)).alias("study_cell"))


def screening_inputs(t: Tables):
    m = fx.models(t).filter(F.col("quality") == 1).select("pmid", F.upper("compound_group").alias("compound_group"), "partition", F.col("doc_id").alias("ordinal"))
    code = F.when(F.contains("url", F.lit("/en/")), "2_").when(F.contains("url", F.lit("/fr/")), "4_").when(F.contains("url", F.lit("/de/")), "0_").otherwise("")
    folder = F.when(F.contains("url", F.lit("https")), "root/Supplements/SRC1/exclude/").when(F.contains("url", F.lit("www")), "root/keep/").otherwise("root/Excluded/")
    files = t.pages.select(F.concat(folder, code, (F.col("page_id") + 1000000).cast("string"), F.lit("_x.pdf")).alias("path"), F.col("page_id").alias("ordinal"))
    return m, files


@query("c30_screening_records", f"""
WITH {fx.MODELS},
pos AS (SELECT 'screen_' || lower(compound_group) || '_' || pmid AS screening_id, pmid, partition, true AS relevant_model, NULL AS exclusion_reason, 0 AS src, doc_id AS o FROM models WHERE quality = 1),
n0 AS (SELECT page_id, CAST(page_id + 1000000 AS VARCHAR) AS pmid, CASE WHEN contains(url, '/en/') THEN '2' WHEN contains(url, '/fr/') THEN '4' WHEN contains(url, '/de/') THEN '0' ELSE '' END AS code,
  CASE WHEN contains(url, 'https') THEN 'SRC1' WHEN contains(url, 'www') THEN NULL ELSE 'unknown' END AS grp FROM pages),
neg AS (SELECT 'screen_' || lower(grp) || '_' || pmid AS screening_id, pmid, {fx.sql_partition("pmid")} AS partition, false AS relevant_model,
  CASE code WHEN '2' THEN 'non_human' WHEN '4' THEN 'no_model' ELSE 'explicitly_excluded_reason_unavailable' END AS exclusion_reason, 1 AS src, page_id AS o FROM n0 WHERE grp IS NOT NULL),
u AS (SELECT * FROM pos UNION ALL SELECT * FROM neg), r AS (SELECT *, row_number() OVER (PARTITION BY screening_id ORDER BY src, o) AS rn FROM u)
SELECT screening_id, pmid, partition, relevant_model, exclusion_reason, CASE WHEN src = 0 THEN 'included_appendix_model' WHEN exclusion_reason LIKE 'explicit%' THEN 'explicit_exclusion' ELSE 'coded_exclusion' END AS label_quality
FROM r WHERE rn = 1
""")
def screening_records(spark, sf):
    m, files = screening_inputs(Tables(spark, sf))
    return corpus.screening_rows(m, files).select("screening_id", "pmid", "partition", "relevant_model", "exclusion_reason", "label_quality")
