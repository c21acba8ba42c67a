"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as X
from claimloom.operators import catalogue, chunks, corpus, scoring, training
from claimloom.plans import jobs
from claimloom.session import scratch_path
from claimloom.sources import readers, writers
from workload import fixtures as fx
from workload.registry import Tables, query

def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def manifest_texts(t: Tables):
    """Manifest JSON per document; unlabelled Spanish ones are cut off and so unreadable."""
    e = fx.entries(t)
    body = F.to_json(F.struct(
        F.lit(config.SCHEMA_VERSION).alias("schema_version"), "library_id", "version", "status", "title",
        F.lit("2024-01-01").alias("created_at"),
        F.struct("advan", F.lit(2).alias("trans"), F.col("model_type").alias("type")).alias("model"),
        F.struct("compound", "population").alias("study"),
        F.struct(F.col("confidence_overall").alias("overall")).alias("confidence"),
        F.struct(
            F.when(F.col("quality").isNotNull(), F.struct(
                (F.col("toxic") == 0).alias("ready"),
                F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), F.lit("review"))).otherwise(X.literal_array([])).alias("blockers"),
            )).alias("gate"),
            F.struct(F.col("assessment").alias("verdict")).alias("automated_assessment"),
        ).alias("qualification"),
    ))
    broken = F.col("quality").isNull() & (F.col("population") == "es")
    folder = F.when(F.col("population") == "de", F.concat(F.lit("."), F.col("library_id"))).otherwise(F.col("library_id"))
    return e.select("library_id", folder.alias("hidden_folder"), F.col("library_id").alias("folder"),
                    F.when(broken, F.lit('{"schema_version": ')).otherwise(body).alias("json"))


@query("a01_catalogue_scan", f"""
WITH {fx.ENTRIES}, {fx.QUALIFICATIONS},
bound AS (SELECT q.* FROM quals q JOIN entries e USING (library_id)
          WHERE NOT (e.quality IS NULL AND e.population = 'es') AND (q.model_version = '' OR q.model_version = e.version)),
cur AS (SELECT * FROM bound b WHERE NOT EXISTS (SELECT 1 FROM bound s WHERE s.library_id = b.library_id AND s.supersedes = b.qualification_id)),
clin AS (SELECT library_id, string_agg(DISTINCT status, '; ' ORDER BY status) AS clinical_status,
                bool_or(status = 'qualified' AND review_due <> 'soon') AS clinically_qualified FROM cur GROUP BY 1)
SELECT e.library_id,
  CASE WHEN bad THEN '' ELSE title END AS title, CASE WHEN bad THEN '' ELSE status END AS status,
  CASE WHEN bad THEN '' ELSE compound END AS compound, CASE WHEN bad THEN '' ELSE population END AS population,
  CASE WHEN NOT bad THEN advan END AS advan, CASE WHEN NOT bad THEN 2 END AS trans,
  CASE WHEN bad THEN '' ELSE model_type END AS model_type, CASE WHEN bad THEN '' ELSE version END AS version,
  CASE WHEN NOT bad THEN round(confidence_overall, 6) END AS confidence_overall,
  CASE WHEN bad THEN '' ELSE assessment END AS assessment, CASE WHEN bad THEN '' ELSE 'not_planned' END AS reproduction,
  coalesce(toxic = 0, false) AS qualified,
  CASE WHEN bad THEN 'manifest_unreadable' WHEN quality IS NULL THEN 'qualification_not_run' WHEN toxic = 1 THEN 'toxic; review' ELSE '' END
    AS qualification_blockers,
  '' AS updated_at, coalesce(clinical_status, '') AS clinical_status, coalesce(clinically_qualified, false) AS clinically_qualified
FROM (SELECT *, quality IS NULL AND population = 'es' AS bad FROM entries) e LEFT JOIN clin USING (library_id)
""")
def catalogue_scan(spark, sf):
    t = Tables(spark, sf)
    manifests = readers.parse_manifests(manifest_texts(t))
    listed = catalogue.list_entries(manifests, fx.qualifications(t), now())
    return listed.withColumn("confidence_overall", fx.r6("confidence_overall"))


@query("a02_catalogue_index", f"""
WITH {fx.ENTRIES}
SELECT CASE WHEN quality IS NULL AND population = 'es' THEN library_id ELSE library_id END AS library_id,
       CASE WHEN quality IS NULL AND population = 'es' THEN '' ELSE title END AS title,
       CASE WHEN quality IS NULL AND population = 'es' THEN 'draft' ELSE status END AS status,
       CASE WHEN quality IS NULL AND population = 'es' THEN '' ELSE '2024-01-01' END AS updated_at
FROM entries WHERE population <> 'de'
""")
def catalogue_index(spark, sf):
    t = Tables(spark, sf)
    texts = manifest_texts(t).select(F.col("hidden_folder").alias("folder"), "json")
    return catalogue.index_rows(readers.parse_manifests(texts))


def entry_errors():
    required = {c: F.col(c) for c in ("library_id", "version", "status", "title")}
    return catalogue.manifest_errors(required, F.col("library_id"), F.col("status"), F.col("confidence_overall"))


@query("a03_entry_read", f"""
WITH {fx.ENTRIES}
SELECT l.doc_id, e.library_id, e.title, e.status, e.compound, round(e.confidence_overall, 6) AS confidence,
       e.library_id IS NOT NULL AS found, true AS valid
FROM labels l LEFT JOIN entries e ON e.library_id = 'doc_' || l.doc_id
""")
def entry_read(spark, sf):
    t = Tables(spark, sf)
    checked = fx.entries(t).select("library_id", "title", "status", "compound", fx.r6("confidence_overall").alias("confidence"),
                                   (F.size(entry_errors()) == 0).alias("valid"), F.lit(True).alias("found"))
    asked = t.labels.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("library_id"))
    return asked.join(checked, "library_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("a04_provenance_read", f"""
WITH {fx.ENTRIES}
SELECT e.library_id, e.version, e.status, p.url AS audit_url, l.quality AS assessed_quality, b.text IS NOT NULL AS has_ledger
FROM entries e LEFT JOIN pages p ON p.page_id = e.doc_id LEFT JOIN labels l ON l.doc_id = e.doc_id
LEFT JOIN benchmark b ON b.item_id = e.doc_id
""")
def provenance_read(spark, sf):
    t = Tables(spark, sf)
    e = fx.entries(t).select("doc_id", "library_id", "version", "status")
    kept = catalogue.provenance(e, {
        "audit": t.pages.select(F.col("page_id").alias("doc_id"), "url"),
        "assessment": t.labels.select("doc_id", "quality"),
        "ledger": t.benchmark.select(F.col("item_id").alias("doc_id"), F.xxhash64("text").alias("version")),
    }, "doc_id")
    return kept.select("library_id", "version", "status", F.col("audit.url").alias("audit_url"),
                       F.col("assessment.quality").alias("assessed_quality"), F.col("ledger").isNotNull().alias("has_ledger"))


@query("a05_model_lines", """
SELECT 'doc_' || doc_id AS library_id, CAST(n AS INTEGER) AS line_no, line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
""")
def model_lines(spark, sf):
    t = Tables(spark, sf)
    e = t.documents.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("library_id"), F.col("text").alias("model_text"))
    return readers.model_lines(e)


@query("a06_source_pdf", """
WITH files AS (SELECT 'inbox/' || doc_id || '/article.pdf' AS path FROM labels WHERE quality = 1
               UNION SELECT 'bundle/' || item_id || '.PDF' FROM benchmark)
SELECT 'doc_' || page_id AS library_id,
  CASE WHEN EXISTS (SELECT 1 FROM files f WHERE f.path = 'bundle/' || page_id || '.PDF') THEN 'bundle/' || page_id || '.PDF'
       WHEN EXISTS (SELECT 1 FROM files f WHERE f.path = 'inbox/' || page_id || '/article.pdf') THEN 'inbox/' || page_id || '/article.pdf'
       ELSE '' END AS pdf
FROM pages
""")
def source_pdf(spark, sf):
    t = Tables(spark, sf)
    n = F.col("page_id").cast("string")
    e = t.pages.select(F.concat(F.lit("doc_"), n).alias("library_id"), F.concat(F.lit("bundle/"), n, F.lit(".PDF")).alias("bundle_path"),
                       F.col("url").alias("acquisition_path"), F.concat(F.lit("inbox/"), n, F.lit("/article.pdf")).alias("inbox_path"))
    files = t.labels.filter("quality = 1").select(F.concat(F.lit("inbox/"), F.col("doc_id").cast("string"), F.lit("/article.pdf")).alias("path")).unionByName(
        t.benchmark.select(F.concat(F.lit("bundle/"), F.col("item_id").cast("string"), F.lit(".PDF")).alias("path")))
    return readers.source_pdf(e, files)


@query("a07_corpus_record_scan", f"""
WITH {fx.MODELS}
SELECT partition, reference_id, length(abstract) AS n_chars FROM models
""")
def corpus_record_scan(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "corpus")
    kinds = fx.models(t).withColumn("kind", F.lit("models")).select("kind", "partition", "reference_id", "abstract").unionByName(
        t.labels.select(F.lit("screening").alias("kind"), F.lit("train").alias("partition"),
                        F.col("doc_id").cast("string").alias("reference_id"), F.lit("").alias("abstract")))
    writers.json_lines(kinds, path, ["reference_id", "abstract"], ["kind", "partition"])
    rows = readers.corpus_records(spark, path, "models")
    parsed = F.from_json("value", "reference_id string, abstract string")
    return rows.select("partition", parsed.alias("r")).select("partition", "r.reference_id", F.length("r.abstract").cast("bigint").alias("n_chars"))


@query("a08_corpus_model_list", f"""
WITH {fx.MODELS}
SELECT reference_id, article_id, pmid, compound_group AS compound, partition, tier, training_eligible FROM models
WHERE partition IN ('train', 'validation') AND tier IN ('A', 'B')
""")
def corpus_model_list(spark, sf):
    return corpus.list_models(fx.models(Tables(spark, sf)), ["train", "validation"], ["A", "B"])


@query("a09_corpus_model_get", f"""
WITH {fx.MODELS}
SELECT b.item_id, m.reference_id, m.tier, m.partition FROM benchmark b JOIN models m ON m.doc_id = b.item_id
""")
def corpus_model_get(spark, sf):
    t = Tables(spark, sf)
    m = fx.models(t).select("doc_id", X.checked_id("reference_id").alias("reference_id"), "tier", "partition")
    return t.benchmark.select("item_id").join(m, F.col("item_id") == F.col("doc_id")).drop("doc_id")


@query("a10_prediction_file_scan", """
SELECT o_orderkey AS reference_id, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders
""")
def prediction_file_scan(spark, sf):
    t = Tables(spark, sf)
    path = scratch_path(spark, "predictions")
    t.orders.select(F.col("o_orderkey").alias("reference_id"), F.struct(F.floor("o_totalprice").cast("bigint").alias("value")).alias("prediction"),
                    F.col("o_orderstatus").alias("part")).write.partitionBy("part").json(path)
    rows = readers.prediction_lines(spark, path)
    parsed = F.from_json("json", "reference_id bigint, prediction struct<value:bigint>")
    return rows.select(parsed.alias("r")).select("r.reference_id", "r.prediction.value")


@query("a10_prediction_whole_files", """
SELECT 'ref-' || item_id AS id, length(text) AS n_chars FROM benchmark
""")
def prediction_whole_files(spark, sf):
    """One pretty-printed envelope per file, as tools write them."""
    t = Tables(spark, sf)
    path = scratch_path(spark, "envelopes")
    body = F.concat(F.lit('{\n  "reference_id": "ref-'), F.col("item_id").cast("string"), F.lit('",\n  "prediction": {\n    "text": '), F.to_json(F.array("text")), F.lit("\n  }\n}"))
    t.benchmark.select("item_id", body.alias("value")).write.partitionBy("item_id").text(path)
    found = readers.prediction_files(spark, path, "part-*")
    return found.select("id", F.length(F.get_json_object("json", "$.prediction.text[0]")).cast("bigint").alias("n_chars"))


@query("a11_prediction_index", """
WITH files AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id, 'p/' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '/' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
         || '/' || l_linenumber AS path, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f, l_linestatus AS s
  FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path) AS rn FROM files)
SELECT id, path, CASE WHEN f = 'A' THEN '{"q":' || q || '}' WHEN f = 'N' AND s = 'F' THEN '{"e":' || q || '}'
                      WHEN f = 'N' THEN '{"whole":' || q || '}' END AS payload
FROM ranked WHERE rn = 1
""")
def prediction_index(spark, sf):
    t = Tables(spark, sf)
    q = F.col("l_quantity").cast("bigint").cast("string")
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    path = F.concat_ws("/", F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"),
                       F.col("l_linenumber").cast("string"))
    json = (
        F.when(f == "A", F.concat(F.lit('{"prediction":{"q":'), q, F.lit("}}")))
        .when((f == "N") & (s == "F"), F.concat(F.lit('{"extraction":{"e":'), q, F.lit("}}")))
        .when(f == "N", F.concat(F.lit('{"whole":'), q, F.lit("}")))
        .when(s == "F", F.lit('{"prediction":null,"extraction":{"e":1}}'))
        .otherwise(F.lit('{"prediction": '))
    )
    files = t.spread("lineitem").select(F.col("l_orderkey").cast("string").alias("id"), path.alias("path"), json.alias("json"))
    return scoring.prediction_index(files)


ORDERS_CSV = "pmid string, status string, tier string, price double, note string"


def orders_csv(t: Tables):
    return t.orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("pmid"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("tier"), F.col("o_totalprice").alias("price"),
        F.concat(F.lit('said "'), F.col("o_orderpriority"), F.lit('", then\nleft')).alias("note"))


@query("a12_manifest_csv_read", """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS pmid, o_orderstatus AS status,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS tier, round(o_totalprice, 6) AS price,
       'said "' || o_orderpriority || '", then' || chr(10) || 'left' AS note
FROM orders
""")
def manifest_csv_read(spark, sf):
    path = writers.csv(orders_csv(Tables(spark, sf)), scratch_path(spark, "manifest"))
    return readers.manifest_csv(spark, path, ORDERS_CSV).withColumn("price", fx.r6("price"))


@query("a13_manifest_csv_write", """
SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN 'filled' ELSE 'blank' END AS tier_cell, count(*) AS n FROM orders GROUP BY 1
""")
def manifest_csv_write(spark, sf):
    t = Tables(spark, sf)
    rows = orders_csv(t).select("pmid", "tier")
    path = writers.csv(rows, scratch_path(spark, "manifest"))
    lines = spark.read.text(path).filter(F.col("value") != "pmid,tier")
    return lines.groupBy(F.when(F.endswith("value", F.lit(",")), F.lit("blank")).otherwise(F.lit("filled")).alias("tier_cell")).agg(
        F.count("*").alias("n"))


@query("a14_latest_manifest", """
SELECT coalesce((SELECT 'manifests/discover_' || o_orderkey || '.csv' FROM orders WHERE o_orderstatus = 'O'
 ORDER BY o_orderdate DESC, 'manifests/discover_' || o_orderkey || '.csv' DESC LIMIT 1), '') AS path
""")
def latest_manifest(spark, sf):
    t = Tables(spark, sf)
    name = F.when(F.col("o_orderstatus") == "O", F.lit("manifests/discover_")).otherwise(F.lit("manifests/other_"))
    files = t.orders.select(F.concat(name, F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("path"),
                            F.col("o_orderdate").alias("modificationTime"))
    return readers.newest_file(files)


@query("a15_literature_csv_scan", f"""
SELECT CAST(doc_id + 1000000 AS VARCHAR) AS pmid, {fx.sql_squeeze("split_part(text, chr(10), 1)")} AS title, md5({fx.sql_squeeze("text")}) AS abstract_md5
FROM documents
""")
def literature_csv_scan(spark, sf):
    t = Tables(spark, sf)
    rows = fx.articles(t).select(F.concat(F.lit("id "), F.col("pmid")).alias("PMID"), F.col("title").alias("Title"),
                                 F.col("abstract").alias("AbstractText"))
    bad = t.labels.select(F.lit("12").alias("PMID"), F.lit("short id").alias("Title"), F.lit("").alias("AbstractText"))
    path = writers.csv(rows.unionByName(rows).unionByName(bad), scratch_path(spark, "literature"))
    found = readers.literature_csv(spark, path, "part-*.csv")
    return found.select("pmid", "title", F.md5("abstract").alias("abstract_md5"))


@query("a16_article_xml", rf"""
SELECT CAST(doc_id + 1000000 AS VARCHAR) AS pmid,
       trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title,
       md5(trim(regexp_replace(text || ' ' || text, '\s+', ' ', 'g'))) AS abstract_md5,
       source AS journal, CASE WHEN lang = 'en' THEN '2001' WHEN lang = 'fr' THEN '1998' ELSE '' END AS year,
       '10.1/' || doc_id AS doi, CAST(doc_id AS VARCHAR) AS pmcid,
       'Ann ' || source || '|' || lang AS authors
FROM documents
""")
def article_xml(spark, sf):
    t = Tables(spark, sf)
    a = fx.articles(t)
    year = F.when(F.col("lang") == "en", F.lit("2001"))
    medline = F.when(F.col("lang") == "fr", F.lit("1998 Spring"))
    none = F.lit(None).cast("string")
    citation = F.struct(
        F.col("pmid").alias("PMID"),
        F.struct(
            F.col("title").alias("ArticleTitle"),
            F.struct(F.array("abstract", "abstract").alias("AbstractText")).alias("Abstract"),
            F.struct(F.col("compound").alias("Title"),
                     F.struct(F.struct(year.alias("Year"), medline.alias("MedlineDate")).alias("PubDate")).alias("JournalIssue")).alias("Journal"),
            F.struct(F.array(F.struct(F.col("compound").alias("LastName"), F.lit("Ann").alias("ForeName")),
                             F.struct(F.col("lang").alias("LastName"), none.alias("ForeName"))).alias("Author")).alias("AuthorList"),
        ).alias("Article"),
    )
    ids = F.struct(F.struct(F.array(
        F.struct(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("_VALUE"), F.lit("DOI").alias("_IdType")),
        F.struct(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("_VALUE"), F.lit("pmc").alias("_IdType")),
    ).alias("ArticleId")).alias("ArticleIdList"))
    path = scratch_path(spark, "articles")
    # an XML file is read whole by one task, so its size must not follow the size of the scan's splits
    a.select(citation.alias("MedlineCitation"), ids.alias("PubmedData")).write.format("xml").option("rowTag", "PubmedArticle").option(
        "rootTag", "PubmedArticleSet").option("maxRecordsPerFile", 2000).save(path)
    x = readers.article_xml(spark, path)
    return x.select("pmid", F.trim("title").alias("title"), F.md5(F.trim("abstract")).alias("abstract_md5"), "journal", "year", "doi", "pmcid",
                    F.array_join("authors", "|").alias("authors"))


@query("a17_appendix_rows", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row_no FROM documents),
keyed AS (
  SELECT doc_id, row_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS raw,
         list_filter(regexp_extract_all(trim(regexp_replace(line, '\s+', ' ', 'g')), '[0-9]+'), lambda x: length(x) BETWEEN 3 AND 9)[1] AS pmid
  FROM lines WHERE row_no > 1)
SELECT doc_id AS doc, CAST(row_no AS INTEGER) AS row_no, pmid, md5(raw) AS raw_md5 FROM keyed WHERE pmid IS NOT NULL
""")
def appendix_rows(spark, sf):
    t = Tables(spark, sf)
    lines = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    table = lines.select("doc", (F.col("at") + 1).alias("row_no"), F.array("line").alias("cells"))
    return corpus.appendix_rows(table, 3, 9).select("doc", "row_no", "pmid", F.md5("citation").alias("raw_md5"))


@query("a18_file_index", r"""
WITH names AS (SELECT page_id, url, regexp_extract(url, '[^/\\]*$') AS name FROM pages),
runs AS (SELECT page_id, url, unnest(list_filter(regexp_extract_all(name, '[0-9]+'), lambda x: length(x) BETWEEN 2 AND 4)) AS pmid FROM names)
SELECT page_id, pmid, url AS path FROM runs
""")
def file_index(spark, sf):
    t = Tables(spark, sf)
    return corpus.file_index(t.pages.select("page_id", F.col("url").alias("path")), "path", 2, 4).select("page_id", "pmid", "path")


@query("a19_preferred_file", r"""
WITH paths AS (SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN replace(url, '/fr/', '/Excluded/') ELSE url END AS path FROM pages),
runs AS (SELECT page_id, path, unnest(list_filter(regexp_extract_all(regexp_extract(path, '[^/\\]*$'), '[0-9]+'), lambda x: length(x) BETWEEN 2 AND 4)) AS pmid FROM paths),
r AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY CASE WHEN path LIKE '%/Excluded/%' THEN 1 ELSE 0 END, length(path), page_id) AS rn FROM runs)
SELECT pmid, path FROM r WHERE rn = 1
""")
def preferred_file(spark, sf):
    t = Tables(spark, sf)
    path = F.when(F.contains("url", F.lit("/fr/")), F.replace(F.col("url"), F.lit("/fr/"), F.lit("/Excluded/"))).otherwise(F.col("url"))
    index = corpus.file_index(t.pages.select("page_id", path.alias("path")), "path", 2, 4)
    return corpus.preferred_file(index, "page_id")


@query("a20_text_decoding", """
SELECT doc_id, md5(text) AS text_md5 FROM documents
""")
def text_decoding(spark, sf):
    t = Tables(spark, sf)
    legacy = readers.encode_windows(F.col("text"))
    utf8 = F.encode("text", "UTF-8")
    mark = F.unhex(F.lit("EFBBBF00"))
    content = F.when(F.col("lang").isin("fr", "de", "es") & legacy.isNotNull(), legacy).when(F.col("lang") == "en", F.concat(mark, utf8)).otherwise(utf8)
    return t.documents.select("doc_id", F.md5(readers.decode_text(content)).alias("text_md5"))


@query("a21_budgeted_page_text", f"""
WITH RECURSIVE pages0 AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS p0, generate_subscripts(string_split(text, chr(10)), 1) AS no,
         len(string_split(text, chr(10))) AS n FROM documents),
pg AS (SELECT doc_id, no, n, regexp_replace(p0, '[ \\t]+', ' ', 'g') AS p FROM pages0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN no = 1 THEN 0 WHEN no = n THEN 1 ELSE 2 END,
                                        -{fx.sql_score("p", ["the", "ment", "und", "ation"])}, no) AS rk,
                  sum(length(p)) OVER (PARTITION BY doc_id) AS total FROM pg),
fit AS (
  SELECT doc_id, rk, no, CAST(length(p) + 40 AS BIGINT) AS used, true AS taken FROM ranked WHERE rk = 1
  UNION ALL
  SELECT r.doc_id, r.rk, r.no, CASE WHEN f.used + length(r.p) + 40 <= 1500 THEN f.used + length(r.p) + 40 ELSE f.used END,
         f.used + length(r.p) + 40 <= 1500
  FROM fit f JOIN ranked r ON r.doc_id = f.doc_id AND r.rk = f.rk + 1),
chosen AS (SELECT r.doc_id, r.no, r.p FROM ranked r JOIN fit f USING (doc_id, rk) WHERE r.total <= 1500 OR f.taken),
joined AS (SELECT doc_id, string_agg('[PAGE ' || no || ']' || chr(10) || p, chr(10) || chr(10) ORDER BY no) AS x FROM chosen GROUP BY doc_id),
tidy AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM joined)
SELECT doc_id, CASE WHEN length(x) > 1500 THEN substr(x, 1, 1500) || chr(10) || chr(10) || '[TRUNCATED]' ELSE x END AS text FROM tidy
""")
def budgeted_page_text(spark, sf):
    t = Tables(spark, sf)
    text = chunks.budgeted_text(F.split("text", "\n"), 1500, ["the", "ment", "und", "ation"])
    return t.spread("documents").select("doc_id", text.alias("text"))


@query("a22_supplement_text", """
WITH files AS (
  SELECT source, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.CTL' WHEN 'de' THEN '.mod' ELSE '.pdf' END AS path,
         text FROM documents),
joined AS (
  SELECT source, string_agg('--- ' || split_part(path, '/', 2) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY path) AS x
  FROM files WHERE path NOT LIKE '%.pdf' GROUP BY source)
SELECT source, md5(CASE WHEN length(x) > 80000 THEN substr(x, 1, 80000) || chr(10) || '[SUPPLEMENT TRUNCATED]' ELSE x END) AS text_md5 FROM joined
""")
def supplement_text(spark, sf):
    t = Tables(spark, sf)
    ext = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".CTL").when(F.col("lang") == "de", ".mod").otherwise(".pdf")
    files = t.documents.select("source", F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), ext).alias("path"), "text")
    return readers.supplement_text(readers.supplements(files), "source").select("source", F.md5("text").alias("text_md5"))


def page_bytes():
    html = F.when(F.contains("url", F.lit("/en/")), F.concat(F.lit("%PDF-"), F.col("html"))).otherwise(F.col("html"))
    return F.encode(html, "UTF-8")


PAGE_SQL = "CASE WHEN contains(url, '/en/') THEN '%PDF-' || html ELSE html END"


@query("a23_manual_inbox", f"""
SELECT page_id, url AS destination, CASE WHEN contains(url, '/en/') AND strlen({PAGE_SQL}) > 1000 THEN 'complete' ELSE 'pending' END AS status FROM
(SELECT page_id, min(url) AS url, min(html) AS html FROM pages GROUP BY page_id)
""")
def manual_inbox(spark, sf):
    t = Tables(spark, sf)
    content = page_bytes()
    files = t.pages.select(F.concat_ws("#", F.col("page_id").cast("string"), "url").alias("path"), content.alias("content"), F.length(content).alias("length"))
    requests = t.pages.select("page_id", F.concat_ws("#", F.col("page_id").cast("string"), "url").alias("destination"), "url")
    return readers.inbox_state(requests, files).select("page_id", F.col("url").alias("destination"), "status")


@query("a24_file_check", f"""
SELECT page_id, contains(url, '/en/') AS is_pdf, contains(url, '/en/') AND strlen({PAGE_SQL}) > 1000 AS is_usable FROM pages
""")
def file_check(spark, sf):
    t = Tables(spark, sf)
    content = page_bytes()
    return t.pages.select("page_id", readers.looks_like_pdf(content).alias("is_pdf"), readers.looks_like_pdf(content, F.length(content)).alias("is_usable"))


def screening(t: Tables):
    m = fx.models(t).filter(F.col("quality").isNotNull())
    return m.select(
        F.concat(F.lit("screen_"), F.col("pmid")).alias("screening_id"), "pmid", "partition", (F.col("quality") == 1).alias("relevant"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("recoverable"),
        F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, F.lit("no_model")).otherwise(F.lit("wrong_aed"))).alias("exclusion_reason"),
        F.when(F.col("quality") == 1, F.lit("included")).otherwise(F.lit("coded_exclusion")).alias("label_quality"),
    )


SCREENING = f"""{fx.MODELS},
screening AS (SELECT 'screen_' || pmid AS screening_id, pmid, partition, quality = 1 AS relevant, quality = 1 AND toxic = 0 AS recoverable,
  CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 'no_model' ELSE 'wrong_aed' END END AS exclusion_reason,
  CASE WHEN quality = 1 THEN 'included' ELSE 'coded_exclusion' END AS label_quality, title, abstract FROM models WHERE quality IS NOT NULL)"""

PROMPT_SQL = ("'Assess whether this abstract reports or applies a pharmacometric model.' || chr(10) || "
              "'Do not use information outside the supplied title and abstract.' || chr(10) || chr(10) || 'PMID: ' || pmid || chr(10) || "
              "'TITLE: ' || title || chr(10) || 'ABSTRACT:' || chr(10) || abstract")


@query("a25_training_jsonl", f"""
WITH {SCREENING}
SELECT screening_id AS id, 'triage' AS task, partition, label_quality AS quality_tier, 'system,user,assistant' AS roles, md5({PROMPT_SQL}) AS user_md5
FROM screening WHERE partition <> 'test' AND (relevant OR exclusion_reason = 'no_model') AND trim(abstract) <> ''
""")
def training_jsonl(spark, sf):
    t = Tables(spark, sf)
    candidates = jobs.triage_export(screening(t), fx.articles(t), ["train", "validation"], "You screen abstracts.")
    path = jobs.write_examples(candidates, scratch_path(spark, "examples"))
    x = spark.read.schema("value string").text(path)
    parsed = F.from_json("value", "id string, task string, partition string, quality_tier string, messages array<struct<role:string,content:string>>")
    r = x.select(parsed.alias("r")).select("r.*")
    return r.select("id", "task", "partition", "quality_tier", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                    F.md5(F.get("messages", F.lit(1))["content"]).alias("user_md5"))


@query("a26_guarded_jsonl_scan", f"""
WITH {SCREENING}
SELECT CASE WHEN partition = 'test' THEN 'test_partition' WHEN NOT relevant THEN 'test_data_flag' WHEN NOT recoverable THEN 'role_sequence'
       ELSE 'clean' END AS outcome, count(*) AS n FROM screening GROUP BY 1
""")
def guarded_jsonl_scan(spark, sf):
    t = Tables(spark, sf)
    s = screening(t).join(fx.articles(t).select("pmid", "title", "abstract"), "pmid")
    good = training.example_row(F.col("screening_id"), "triage", F.col("partition"), F.col("label_quality"), F.lit("s"), F.col("title"), F.col("abstract"))
    rows = s.select(good.alias("e"), "relevant", "recoverable").select(
        F.col("e").withField("leakage_guard", F.struct((~F.col("relevant")).alias("test_data"), F.lit(True).alias("target_absent_from_user_message")))
        .withField("messages", F.when(F.col("recoverable"), F.col("e.messages")).otherwise(F.reverse("e.messages"))).alias("e")).select("e.*")
    path = scratch_path(spark, "examples")
    rows.write.json(path)
    clean, rejected = training.split_guarded(readers.training_examples(spark, path))
    both = clean.select(F.lit("clean").alias("outcome")).unionByName(rejected.select(F.col("violation").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


@query("a27_bibtex", """
SELECT doc_id, '@article{doc_' || doc_id || ',' || chr(10) || '  title = {' || regexp_replace(split_part(text, chr(10), 1), '[{}]', '', 'g') || '},' || chr(10)
  || '  author = {' || CASE WHEN lang = 'en' THEN 'A One and B Two' ELSE 'Unknown' END || '},' || chr(10) || '  journal = {' || source || '},' || chr(10) || '  year = {2001},' || chr(10)
  || CASE WHEN lang = 'fr' THEN '  doi = {10.1/' || doc_id || '},' || chr(10) ELSE '' END
  || CASE WHEN lang = 'de' THEN '  note = {Literature entry}' ELSE '  pmid = {' || doc_id || '}' END || chr(10) || '}' AS entry
FROM documents
""")
def bibtex(spark, sf):
    t = Tables(spark, sf)
    n = F.col("doc_id").cast("string")
    authors = F.when(F.col("lang") == "en", F.array(F.lit("A One"), F.lit("B Two"))).otherwise(X.literal_array([]))
    rows = fx.articles(t).select("doc_id", X.bibtex(
        F.concat(F.lit("doc_"), n), F.col("title"), authors, F.col("compound"), F.lit("2001"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("10.1/"), n)), F.when(F.col("lang") != "de", n)).alias("entry"))
    return rows


@query("a28_csv_report", """
SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_size END AS size, round(p_retailprice, 6) AS price FROM part
""")
def csv_report(spark, sf):
    t = Tables(spark, sf)
    rows = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"))
    path = writers.csv(rows, scratch_path(spark, "report"))
    return readers.manifest_csv(spark, path, "p_partkey bigint, p_name string, size int, price double").withColumn("price", fx.r6("price"))


@query("a29_text_cap", """
SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || '[DOCUMENT TRUNCATED]' ELSE text END) AS marked_md5,
       md5(CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) ELSE text END) AS silent_md5 FROM documents
""")
def text_cap(spark, sf):
    t = Tables(spark, sf)
    return t.documents.select("doc_id", F.md5(X.cap_text("text", 1000)).alias("marked_md5"), F.md5(X.cap_text("text", 5000, "")).alias("silent_md5"))


@query("a30_document_registry", """
WITH incoming AS (
  SELECT page_id, CASE WHEN contains(url, '/en/') THEN CAST(page_id AS VARCHAR) ELSE '' END AS pmid, sha256(html) AS sha256, contains(url, 'page=') AS parse_ok FROM pages),
k AS (SELECT *, substr(sha256, 1, 16) AS sha16, CASE WHEN pmid <> '' THEN pmid ELSE substr(sha256, 1, 16) END AS identifier FROM incoming),
reg AS (SELECT DISTINCT CAST(page_id AS VARCHAR) AS identifier, substr(sha256(html), 1, 16) AS sha16 FROM pages WHERE contains(url, 'www.'))
SELECT page_id, identifier, k.sha16, reg.identifier IS NOT NULL AS reused, NOT parse_ok AS fallback, CASE WHEN parse_ok THEN 'primary' ELSE 'text_fallback' END AS parser
FROM k LEFT JOIN reg USING (identifier, sha16)
""")
def document_registry(spark, sf):
    t = Tables(spark, sf)
    n = F.col("page_id").cast("string")
    incoming = t.pages.select("page_id", F.when(F.contains("url", F.lit("/en/")), n).otherwise(F.lit("")).alias("pmid"),
                              F.sha2("html", 256).alias("sha256"), F.contains("url", F.lit("page=")).alias("parse_ok"))
    known = t.pages.filter(F.contains("url", F.lit("www."))).select(n.alias("identifier"), F.substring(F.sha2("html", 256), 1, 16).alias("sha16"))
    return readers.register_documents(incoming, known).select("page_id", "identifier", "sha16", "reused", "fallback", "parser")
