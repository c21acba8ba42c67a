"""The given tables in the roles the engine works on, in Spark and as SQL with the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import numbers as N
from claimloom.functions import text as X
from workload.registry import Tables

# Substrings that occur in the given texts; the shipped keyword list never does.
WORDS = ["license", "worthless", "keit", "mente", "ment", "und", "ation", "thou", "the"]


def sql_score(text: str, words=WORDS) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({text}), '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


def sql_partition(group: str, seed: str = "20260716", validation: float = 0.15, test: float = 0.15) -> str:
    score = f"(CAST(('0x' || substr(sha256('{seed}:' || {group}), 1, 7)) AS BIGINT) / 268435455.0::DOUBLE)"
    return (f"(CASE WHEN {score} < {test}::DOUBLE THEN 'test' WHEN {score} < {test + validation}::DOUBLE "
            f"THEN 'validation' ELSE 'train' END)")


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def sql_normal(x: str) -> str:
    return f"trim(regexp_replace(lower({sql_squeeze(x)}), '[^a-z0-9]+', ' ', 'g'))"


def r6(x: Column | str, places: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, places)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp column, whatever the session zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def instant(ts: str) -> Column:
    """A zone-free timestamp read as UTC, as the event time streams need."""
    return F.timestamp_micros(micros(ts))


def utc_text(ts: str, pattern: str) -> Column:
    """An instant as UTC text, whatever the session zone is."""
    return F.date_format(F.expr(f"timestampadd(MICROSECOND, unix_micros({ts}), TIMESTAMP_NTZ '1970-01-01 00:00:00')"), pattern)


def window_id(idx: str) -> Column:
    """The id of a window as the SQL has it: lpad cuts to three digits."""
    return F.concat(F.lit("C"), F.lpad(F.col(idx).cast("string"), 3, "0"))


# ---------------------------------------------------------------- articles (documents)


def articles(t: Tables, heavy: bool = False) -> DataFrame:
    return (t.spread("documents") if heavy else t.documents).select(
        "doc_id", (F.col("doc_id") + 1000000).cast("string").alias("pmid"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("abstract"),
        F.col("source").alias("compound"), "lang", "n_chars",
    )


ARTICLES = """articles AS (
  SELECT doc_id, CAST(doc_id + 1000000 AS VARCHAR) AS pmid, split_part(text, chr(10), 1) AS title, text AS abstract,
         source AS compound, lang, n_chars FROM documents)"""


# ---------------------------------------------------------------- catalogue entries (documents + labels)


def entries(t: Tables) -> DataFrame:
    d = articles(t).join(t.labels, "doc_id", "left")
    status = (
        F.when(F.col("quality").isNull(), F.lit("stub")).when(F.col("quality") == 0, F.lit("draft"))
        .when(F.col("toxic") == 1, F.lit("review")).otherwise(F.lit("validated"))
    )
    return d.select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("library_id"), "title", "compound",
        F.col("lang").alias("population"), status.alias("status"), "abstract",
        F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("confidence_overall"),
        F.when(F.col("lang") == "en", 2).when(F.col("lang") == "fr", 4).when(F.col("lang") == "de", 1).alias("advan"),
        F.when(F.col("n_chars") > 2000, F.lit("pk")).otherwise(F.lit("PKPD")).alias("model_type"),
        F.when(F.col("toxic") == 1, F.lit("1.2.0")).otherwise(F.lit("1.0.0")).alias("version"),
        F.when(F.col("quality") == 1, F.lit("pass")).when(F.col("quality") == 0, F.lit("reject")).otherwise(F.lit("")).alias("assessment"),
        F.array(F.col("lang"), F.col("compound")).alias("keywords"), "quality", "toxic",
    )


ENTRIES = """entries AS (
  SELECT d.doc_id, 'doc_' || d.doc_id AS library_id, split_part(d.text, chr(10), 1) AS title, d.source AS compound,
         d.lang AS population,
         CASE WHEN l.quality IS NULL THEN 'stub' WHEN l.quality = 0 THEN 'draft' WHEN l.toxic = 1 THEN 'review'
              ELSE 'validated' END AS status, d.text AS abstract,
         least(1.0::DOUBLE, d.n_chars / 20000.0::DOUBLE) AS confidence_overall,
         CASE d.lang WHEN 'en' THEN 2 WHEN 'fr' THEN 4 WHEN 'de' THEN 1 END AS advan,
         CASE WHEN d.n_chars > 2000 THEN 'pk' ELSE 'PKPD' END AS model_type,
         CASE WHEN l.toxic = 1 THEN '1.2.0' ELSE '1.0.0' END AS version,
         CASE WHEN l.quality = 1 THEN 'pass' WHEN l.quality = 0 THEN 'reject' ELSE '' END AS assessment,
         d.lang || ' ' || d.source AS keywords, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def qualifications(t: Tables) -> DataFrame:
    """Two records per labelled document; the second supersedes the first unless toxic."""
    base = t.labels.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("library_id"), "quality", "toxic"
    )
    rows = X.rows_array(
        ["n", "status", "supersedes_no", "model_version", "review_due"],
        [1, "candidate", "", "", ""],
        [2, F.when(F.col("quality") == 1, F.lit("qualified")).otherwise(F.lit("suspended")),
         F.when(F.col("toxic") == 0, F.lit("1")).otherwise(F.lit("")), "1.0.0",
         F.when(F.col("toxic") == 1, F.lit("soon")).otherwise(F.lit("2099-01-01"))],
    )
    x = base.select("library_id", F.inline(rows))
    return x.select(
        "library_id", F.concat_ws("-", F.lit("cq"), "library_id", F.col("n").cast("string")).alias("qualification_id"),
        "status", F.when(F.col("supersedes_no") == "1", F.concat_ws("-", F.lit("cq"), "library_id", F.lit("1")))
        .otherwise(F.lit("")).alias("supersedes"), "model_version", "review_due",
    )


QUALIFICATIONS = """quals AS (
  SELECT 'doc_' || doc_id AS library_id, 'cq-doc_' || doc_id || '-1' AS qualification_id, 'candidate' AS status,
         '' AS supersedes, '' AS model_version, '' AS review_due FROM labels
  UNION ALL
  SELECT 'doc_' || doc_id, 'cq-doc_' || doc_id || '-2', CASE WHEN quality = 1 THEN 'qualified' ELSE 'suspended' END,
         CASE WHEN toxic = 0 THEN 'cq-doc_' || doc_id || '-1' ELSE '' END, '1.0.0',
         CASE WHEN toxic = 1 THEN 'soon' ELSE '2099-01-01' END FROM labels)"""


# ---------------------------------------------------------------- corpus models (documents + labels)


def models(t: Tables) -> DataFrame:
    d = articles(t).join(t.labels, "doc_id", "left")
    tier = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("A")).when(F.col("quality") == 1, F.lit("B"))
        .when(F.col("quality") == 0, F.lit("C")).otherwise(F.lit("D"))
    )
    part = N.partition_of(F.col("pmid"))
    return d.select(
        "doc_id", "pmid", F.concat(F.lit("pmid_"), F.col("pmid")).alias("article_id"),
        F.concat(F.lit("ref_"), F.col("compound"), F.lit("_"), F.col("pmid")).alias("reference_id"),
        F.col("compound").alias("compound_group"), "title", "abstract", "lang", part.alias("partition"), tier.alias("tier"),
        ((F.col("quality") == 1) & (part != "test")).alias("_eligible"), "quality", "toxic", "n_chars",
    ).withColumn("training_eligible", F.coalesce("_eligible", F.lit(False))).drop("_eligible")


MODELS = f"""models AS (
  SELECT d.doc_id, CAST(d.doc_id + 1000000 AS VARCHAR) AS pmid, 'pmid_' || CAST(d.doc_id + 1000000 AS VARCHAR) AS article_id,
         'ref_' || d.source || '_' || CAST(d.doc_id + 1000000 AS VARCHAR) AS reference_id, d.source AS compound_group,
         split_part(d.text, chr(10), 1) AS title, d.text AS abstract, d.lang,
         {sql_partition("CAST(d.doc_id + 1000000 AS VARCHAR)")} AS partition,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'A' WHEN l.quality = 1 THEN 'B' WHEN l.quality = 0 THEN 'C' ELSE 'D' END AS tier,
         coalesce(l.quality = 1 AND {sql_partition("CAST(d.doc_id + 1000000 AS VARCHAR)")} <> 'test', false) AS training_eligible,
         l.quality, l.toxic, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


# ---------------------------------------------------------------- manifest rows (orders)


def manifest(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    s = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").cast("string").alias("pmid"),
        F.when(p.startswith("1"), "high").when(p.startswith("2") | p.startswith("3"), "Intermediate").otherwise("low").alias("triage_tier"),
        F.when(s == "F", "oa_auto").when(p.startswith("5"), "skipped").when(s == "O", "needs_institutional").otherwise("stub").alias("acquisition_class"),
        F.when((s == "P") & (F.col("o_totalprice") > 250000), "fetched").when(s == "P", "fetch_failed").otherwise("pending").alias("status"),
        F.col("o_totalprice").alias("price"), F.lit("").alias("local_path"), F.lit("old error").alias("fetch_error"),
        F.lit("http://old").alias("final_url"),
    )


MANIFEST = """manifest AS (
  SELECT o_orderkey AS ord, CAST(o_custkey AS VARCHAR) AS pmid,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'Intermediate'
              ELSE 'low' END AS triage_tier,
         CASE WHEN o_orderstatus = 'F' THEN 'oa_auto' WHEN o_orderpriority LIKE '5%' THEN 'skipped'
              WHEN o_orderstatus = 'O' THEN 'needs_institutional' ELSE 'stub' END AS acquisition_class,
         CASE WHEN o_orderstatus = 'P' AND o_totalprice > 250000 THEN 'fetched' WHEN o_orderstatus = 'P' THEN 'fetch_failed'
              ELSE 'pending' END AS status, o_totalprice AS price, '' AS local_path, 'old error' AS fetch_error,
         'http://old' AS final_url
  FROM orders)"""


# ---------------------------------------------------------------- ledger claims (lineitem)


def claims(t: Tables) -> DataFrame:
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    n = F.col("l_linenumber").cast("string")
    return t.spread("lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_partkey") * 10000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("c"), n).alias("id"),
        F.when(f == "A", "theta").when(f == "N", "structure").otherwise("population").alias("domain"),
        F.when(f == "A", F.concat(F.lit("parameters.theta."), n)).when(f == "N", F.lit("structural.route"))
        .otherwise(F.lit("population.age")).alias("field"),
        s.alias("value"), F.when(s == "F", "final").otherwise("base").alias("model_stage"),
        F.when(F.col("l_discount") < 0.02, "unresolved").when(F.col("l_discount") < 0.05, "derived").otherwise("reported").alias("status"),
        F.when(F.col("l_tax") == 0, F.lit("")).otherwise(F.concat(F.lit("p"), n)).alias("source_locator"),
        F.when(F.col("l_tax") == 0.01, F.lit(" ")).otherwise(s).alias("evidence"),
        (F.col("l_discount") * 10).alias("confidence"), F.lit("theta").alias("stage"),
        F.array(F.concat(F.lit("c"), (F.col("l_linenumber") - 1).cast("string"))).alias("dependencies"),
        F.array().cast("array<string>").alias("alternatives"), F.lit(None).cast("string").alias("unit"),
    )


CLAIMS = """claims AS (
  SELECT l_orderkey AS doc_id, l_partkey * 10000000 + l_suppkey * 10 + l_linenumber AS seq, 'c' || l_linenumber AS id,
         CASE l_returnflag WHEN 'A' THEN 'theta' WHEN 'N' THEN 'structure' ELSE 'population' END AS domain,
         CASE l_returnflag WHEN 'A' THEN 'parameters.theta.' || l_linenumber WHEN 'N' THEN 'structural.route'
              ELSE 'population.age' END AS field, l_linestatus AS value,
         CASE WHEN l_linestatus = 'F' THEN 'final' ELSE 'base' END AS model_stage,
         CASE WHEN l_discount < 0.02 THEN 'unresolved' WHEN l_discount < 0.05 THEN 'derived' ELSE 'reported' END AS status,
         CASE WHEN l_tax = 0 THEN '' ELSE 'p' || l_linenumber END AS source_locator,
         CASE WHEN l_tax = 0.01 THEN ' ' ELSE l_linestatus END AS evidence, l_discount * 10 AS confidence, 'theta' AS stage,
         'c' || (l_linenumber - 1) AS dependency
  FROM lineitem)"""

# ---------------------------------------------------------------- lanes and predictions (lineitem)

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def lane_claims(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Text and vision claims per order: the vision lane misses discount 0 and shifts prices by the tax."""
    field = F.concat_ws(".", F.when(F.col("l_returnflag") == "R", F.lit("theta")).otherwise(F.lit("software")),
                        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    empty = F.lit(None).cast("string")
    text = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), field.alias("field"), empty.alias("text"),
                             F.col("l_extendedprice").alias("number"))
    vision = t.lineitem.filter(F.col("l_discount") > 0).select(
        F.col("l_orderkey").alias("doc_id"), field.alias("field"), empty.alias("text"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax") - 0.04)).alias("number"))
    return text, vision


LANES = """tl AS (
  SELECT l_orderkey AS doc_id, concat_ws('.', CASE WHEN l_returnflag = 'R' THEN 'theta' ELSE 'software' END, l_partkey, l_suppkey,
         l_linenumber) AS field, l_extendedprice AS a FROM lineitem),
vl AS (
  SELECT l_orderkey AS doc_id, concat_ws('.', CASE WHEN l_returnflag = 'R' THEN 'theta' ELSE 'software' END, l_partkey, l_suppkey,
         l_linenumber) AS field, l_extendedprice * (1 + l_tax - 0.04::DOUBLE) AS b FROM lineitem WHERE l_discount > 0),
cmp AS (
  SELECT coalesce(tl.doc_id, vl.doc_id) AS doc_id, coalesce(tl.field, vl.field) AS field, a, b,
         (a IS NOT NULL AND b IS NOT NULL AND abs(a - b) <= greatest(1e-8::DOUBLE, 0.02::DOUBLE * greatest(1.0::DOUBLE, abs(a), abs(b)))) AS is_equal
  FROM tl FULL OUTER JOIN vl ON tl.doc_id = vl.doc_id AND tl.field = vl.field)"""
