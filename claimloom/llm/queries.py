"""The operators as registered queries on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, fingerprints, jaccard, lines, lmscore, mixture, pages, secrets, shards, simhash, toxicity, vantage, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op3_jaccard_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.similar_components(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


_OP8_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op8_decontaminate", f"""
WITH item AS (SELECT item_id, {_OP8_WORDS} AS w FROM benchmark),
gram AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS g
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_OP8_WORDS} AS w FROM documents),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
hit AS (SELECT p.doc_id, p.i, len(g.g) AS n, g.item_id FROM place p JOIN gram g
        ON g.g[1] = p.w[p.i] AND g.g = list_slice(p.w, p.i, p.i + len(g.g) - 1)),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    return decontaminate.report(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_sharding")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = shards.placed(docs, shards.balanced_map(docs, 8))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op7_mixture")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixture.mixed(docs, max_repeats=4.0).select("doc_id", "source", "mix_epoch", "mix_block", "mix_position", "mix_place")


#: The chain of the given labels: low quality, toxic, and both at once.
CATEGORIES = ["low_quality", "toxic", "toxic_low_quality"]


def toxicity_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"), ((1 - F.col("quality")) * F.col("toxic")).alias("toxic_low_quality"))


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, toxicity_labels(spark, folder), CATEGORIES)
    cut = float(chain.threshold[CATEGORIES.index("toxic")])
    return toxicity.score(docs, chain).select("doc_id", *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= cut).alias("toxic"))


@query("op9_fingerprints")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.versions(table(spark, folder, "documents"))


@query("op6_secrets")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find(table(spark, folder, "documents").select("doc_id", "text"))


@query("op10_page_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@query("op5_lm_score")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return lmscore.cross_entropy_difference(lmscore.flagged(docs, good), F.col("is_target"))


@query("op2_line_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_components(table(spark, folder, "documents"))


#: Words with their counts, then near words by two kinds of keys: one letter left open, and one letter left out.
_OP11_SQL = """
WITH RECURSIVE step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
run AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS r FROM documents)),
kind AS (SELECT doc_id, r, count(*) AS m, hex(encode(doc_id || ':' || r)) AS x FROM run GROUP BY doc_id, r),
hashed AS (SELECT r, m, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(x), 2), lambda j:
             CAST(16 * (instr('0123456789ABCDEF', substr(x, j, 1)) - 1) + instr('0123456789ABCDEF', substr(x, j + 1, 1)) - 1 AS BIGINT))),
             lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM kind, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, CAST(h % len(r) AS BIGINT)) || substr(r, CAST(h % len(r) AS BIGINT) + 2) ELSE r END AS word, m FROM hashed),
word AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM cut WHERE len(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
place AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM word),
opened AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS k FROM place),
short AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS k FROM place),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM opened a JOIN opened b ON a.k = b.k AND a.word <> b.word
         UNION ALL SELECT s.word, w.word, w.n FROM short s JOIN word w ON s.k = w.word
         UNION ALL SELECT w.word, s.word, s.n FROM short s JOIN word w ON s.k = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS top FROM near GROUP BY word),
form AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN top END AS form_n,
           (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = b.top AND b.top >= 10 * w.n) AS form
         FROM word w LEFT JOIN best b ON w.word = b.word),
chain(word, top) AS (SELECT word, word FROM form UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON c.top = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.top AS root, f.n, f.n_near, f.form_n
FROM form f JOIN chain c ON c.word = f.word JOIN form e ON e.word = c.top AND e.form IS NULL
"""


@query("op11_variants", _OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents").select("doc_id", "text"))


@query("op12_simhash")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_components(table(spark, folder, "documents").select("doc_id", "text"))


def _op13_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """All rounds written out: assignment to the nearest centroid, then the floored mean of each cluster."""
    parts = [f"""
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), row) - 1 AS c, x AS m FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), row) <= {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
d{i} AS (SELECT row, vec_id, x, c, list_sum(list_transform(range(1, {size + 1}), lambda j: (x[j] - m[j]) * (x[j] - m[j]))) AS d FROM v, c{i}),
a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""
s{i} AS (SELECT c, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, {size + 1}) t(j) GROUP BY c, j),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN m{i} n ON o.c = n.c)""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON a.c = k.c"""


@query("op13_centroids", _op13_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return vantage.cluster(table(spark, folder, "embeddings"))
