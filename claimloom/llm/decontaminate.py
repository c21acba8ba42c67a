"""Benchmark decontamination with a broadcast set of normalised n-grams.

Every benchmark item is cut into windows of consecutive normalised words (an
item with fewer words is one window).  The distinct windows form a hash set that
is broadcast after its size was measured; every word position of every document
is looked up in it within one codegen stage, and a hash hit counts only if the
words themselves agree.  Only hits are shuffled, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut_lineage

WINDOW = 10
#: Fixed by the contract: digits, a-z and every character outside ASCII belong to words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of more bytes than this are joined by a shuffle and not broadcast.
BROADCAST_BYTES = 64 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, nothing else; an ASCII text takes the short way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long")


def windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item_id, n, window): every distinct window of every item; items without words give none."""
    listed = items.select(F.col(item).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    placed = listed.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    return placed.select("item_id", "n", F.slice("w", F.col("at"), F.col("n")).alias("window")).distinct()


def hits(docs: DataFrame, grams: DataFrame, doc: str = "doc_id", text: str = "text", size: int = WINDOW,
         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_key, at, n, window): every place in a text where a window begins.

    ``at`` counts words from 0.  ``text_key`` is a 64-bit hash of the text: rows
    that repeat an id with the same text share their hits.
    """
    known = grams.select("n", "window").distinct()
    facts = known.agg(F.sum(F.octet_length(F.concat_ws(" ", "window")) + 64).alias("bytes"), F.collect_set("n").alias("sizes")).first()
    sizes = sorted(facts["sizes"])  # at most ``size`` of them
    # The same words hashed the same way on both sides; unused places are null and add nothing.
    key = F.xxhash64("n", *[F.get("window", F.lit(k)) for k in range(size)])
    known = known.withColumn("key", key)
    if (facts["bytes"] or 0) <= broadcast_bytes:
        known = F.broadcast(known)
    tokens = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_key"), words(F.col(text)).alias("w"))
    at = tokens.select("doc_id", "text_key", "w", F.posexplode("w").alias("at", "_word"))

    def probe(n: int) -> Column:
        places = [F.get("w", F.col("at") + k) for k in range(n)]
        return F.when(F.col("at") + n <= F.size("w"), F.xxhash64(F.lit(n), *places))

    if len(sizes) == 1:
        probed = at.select("doc_id", "text_key", "w", "at", F.lit(sizes[0]).alias("pn"), probe(sizes[0]).alias("pkey"))
    else:
        tried = F.array(*[F.struct(F.lit(n).alias("pn"), probe(n).alias("pkey")) for n in sizes] or [F.expr("named_struct('pn', 0, 'pkey', CAST(NULL AS BIGINT))")])
        probed = at.select("doc_id", "text_key", "w", "at", F.inline(tried))
    found = probed.join(known, (probed["pn"] == known["n"]) & (probed["pkey"] == known["key"]))
    return found.where(F.slice("w", F.col("at") + 1, F.col("n")) == F.col("window")).select("doc_id", "text_key", "at", "n", "window")


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted (at, n) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["words"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"]))).alias("words"))

    return F.aggregate(F.array_sort(spans), start, step)["words"]


def report(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items (ids as sorted strings), spans, text_key.

    A null or empty text has no words and no hits.  An item with a null id marks
    words but is not listed.  Repeated document rows each get their row; an item
    id with several texts counts once.  Empty tables give no rows or no hits.
    Other columns are ignored, whatever their names.
    """
    grams = cut_lineage(windows(items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")), size=size))
    plain = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    found = cut_lineage(hits(plain, grams, size=size, broadcast_bytes=broadcast_bytes).distinct())
    row = ["doc_id", "text_key"]
    spans = found.groupBy(*row).agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"))
    named = found.select(*row, "window").distinct().join(grams.select("window", "item_id"), "window")
    listed = named.groupBy(*row).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hit = spans.join(listed, (spans["doc_id"].eqNullSafe(listed["doc_id"])) & (spans["text_key"] == listed["text_key"])).select(
        spans["doc_id"].alias("hit_id"), spans["text_key"].alias("hit_key"), "spans", "items", _covered(F.col("spans")).alias("covered"))
    counted = plain.select("doc_id", F.xxhash64("text").alias("text_key"), n_words(F.col("text")).alias("n_words"))
    joined = counted.join(hit, counted["doc_id"].eqNullSafe(hit["hit_id"]) & (counted["text_key"] == hit["hit_key"]), "left")
    return joined.select("doc_id", "n_words", F.coalesce("covered", F.lit(0)).alias("n_hit"),
                         F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                         F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"), "spans", "text_key")


def _flagged(docs: DataFrame, items: DataFrame, doc: str, text: str, options: dict) -> DataFrame:
    found = report(docs, items, doc, text, **options).where("n_hit > 0")
    return cut_lineage(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")).distinct())


def drop_documents(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no window occurs, with all their columns."""
    bad = _flagged(docs, items, doc, text, options)
    return docs.join(bad, docs[doc].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["_key"]), "left_anti")


def drop_spans(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All documents; the hit words, and what stands between two hit words, are cut out of the text."""
    bad = _flagged(docs, items, doc, text, options)
    joined = docs.join(bad, docs[doc].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["_key"]), "left")
    parts = F.regexp_extract_all(F.col("_text"), F.lit(f"{WORD_ANY_CASE}|{BETWEEN}"), F.lit(0))
    opens = F.col("_text").rlike(f"^{WORD_ANY_CASE}")  # then the even parts are words, else the odd ones

    def keep(part: Column, i: Column) -> Column:
        shifted = F.when(F.col("_opens"), i).otherwise(i - 1)
        is_word, number = F.pmod(shifted, F.lit(2)) == 0, F.floor(shifted / 2)
        inside = F.exists("_spans", lambda s: (number >= s["at"]) & (number < s["at"] + s["n"] - F.when(is_word, 0).otherwise(1)))
        return ~inside

    cut = (joined.withColumn("_text", F.col(text)).withColumn("_opens", opens).withColumn("_parts", parts)
           .withColumn("_cut", F.array_join(F.filter("_parts", keep), "")))
    return cut.select(*[F.when(F.col("_spans").isNull(), docs[text]).otherwise(F.col("_cut")).alias(text) if c == text else docs[c] for c in docs.columns])
