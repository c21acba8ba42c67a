"""N-gram Jaccard self-join by PartEnum signatures, and the components of its links.

Texts become sets of word shingles.  Two sets with Jaccard similarity of at
least T differ in few elements, so when the shingle domain is cut into enough
parts some part differs in at most one element, and when that part is cut again
into three, dropping one of the three leaves two sub-parts that agree exactly.
The signatures are those agreements: (size band, part, dropped sub-part, hash of
the rest).  Similar sets share a signature, so an equality join finds them.

* Size bands.  Band i holds sizes l..floor(l/T); linked sets lie in the same or
  in neighbouring bands.  Signature family j serves bands j-1 and j, so every set
  is signed for two families.  With at most u elements in a family, linked sets
  differ in at most k = floor(2u(1-T)/(1+T)) elements, and ceil((k+1)/2) parts
  leave one with at most one difference.
* Small sets (up to SMALL shingles) use every element as a part of its own: all
  subsets with up to floor((1-T)n) elements left out are signed, which is exact.
* A signature of no element says nothing and is not used.  For the middle sizes,
  where all agreeing sub-parts could be empty at once, the domain is cut anew
  with further seeds until REPEAT parts were used.
* Of the parts at most PARTS are enumerated: a set of more than some 220 shingles
  has more.  Each part of a pair exactly at T = 0.75 agrees up to one element
  with probability 0.41, so 32 parts all fail for fewer than one such pair in
  ten million, and for fewer than one in 10**11 at 0.80.

Copies (equal sets) are one class and one signer, so a group of copies costs one
row however large it is.  In a signature's group every member is first checked
against one member only, the smallest id; members that end in one component by
that need no further check, since only reachability is asked for.  What is left,
pairs from different components, is checked in full.  Every check is exact: it
compares the two shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.components import components
from claimloom.llm.textbatch import NOT_BLANK, U64, mix, mix_int, pieces, shingles, words
from claimloom.session import cut_lineage, scratch_path

SHINGLE_WORDS = 5
THRESHOLD = 0.75
SMALL = 14
BANDS_FROM = 12
PARTS = 32
REPEAT = 12
SKETCH_WORDS = 16
_MASK = (1 << 64) - 1
_SEED = 0x5851F42D4C957F2D


def bands(most: int, threshold: float) -> list[tuple[int, int]]:
    """Size bands from BANDS_FROM up to one that holds ``most``."""
    out, low = [], BANDS_FROM
    while not out or out[-1][1] < most:
        high = max(low, int(low / threshold + 1e-9))
        out.append((low, high))
        low = high + 1
    return out


def _small_signatures(elements: np.ndarray, threshold: float) -> list[int]:
    n, values = len(elements), [int(x) for x in mix(elements ^ U64(_SEED))]
    total, out = sum(values), []
    for left_out in range(int(n * (1 - threshold) + 1e-9) + 1):
        if left_out < n:
            out += [mix_int((total - sum(c)) ^ (n - left_out)) for c in combinations(values, left_out)]
    return out


def _family_signatures(elements: np.ndarray, values: np.ndarray, family: int, most: int, threshold: float) -> list[np.ndarray]:
    k = int(2 * most * (1 - threshold) / (1 + threshold) + 1e-9)
    parts = (k + 2) // 2
    used = min(parts, PARTS)
    out = []
    for seed in range(-(-REPEAT // parts)):
        spread = mix(elements + U64((_SEED * (2 * (family * 64 + seed) + 1)) & _MASK))
        cell = ((spread >> U64(32)) * U64(3 * parts) >> U64(32)).astype(np.int64)
        value = values
        if used < parts:
            kept = cell < 3 * used
            cell, value = cell[kept], values[kept]
        sums = np.zeros(3 * used, dtype=U64)
        np.add.at(sums, cell, value)
        sums = sums.reshape(used, 3)
        filled = np.bincount(cell, minlength=3 * used).reshape(used, 3)
        rest = sums.sum(axis=1, dtype=U64)[:, None] - sums
        some = filled.sum(axis=1)[:, None] > filled
        label = (np.arange(3 * used, dtype=U64) + U64(family << 40 | seed << 32)).reshape(used, 3)
        out.append(mix(rest + mix(label))[some])
    return out


def signatures(elements: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """All signatures of one sorted set of 64-bit shingle hashes (none for the empty set)."""
    n, out = len(elements), []
    if not n:
        return elements
    if n <= SMALL:
        out.append(np.array(_small_signatures(elements, threshold), dtype=U64))
    if n >= BANDS_FROM:
        values = mix(elements ^ U64(_SEED))
        sizes = bands(n, threshold)
        sizes.append((sizes[-1][1] + 1, int((sizes[-1][1] + 1) / threshold + 1e-9)))
        for family in (len(sizes) - 2, len(sizes) - 1):
            out += _family_signatures(elements, values, family, sizes[family][1], threshold)
    return np.concatenate(out)


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """1024 bits as 16 words: bit i is the parity of the number of elements that hash to i."""
    slot = (mix(elements + U64(_SEED)) >> U64(54)).astype(np.int64)
    odd = (np.bincount(slot, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def sign(docs: DataFrame, doc: Column, text: Column, shingle: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, sketch, signatures) of every row; equal sets have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for first, data, offsets in pieces(column, 1 << 20):
                hashes, at = words(data, offsets, NOT_BLANK)
                sizes, keys_a, keys_b, sketches, signed = [], [], [], [], []
                for s in shingles(hashes, at, shingle):
                    sizes.append(len(s))
                    keys_a.append(int(s.sum(dtype=U64)))
                    keys_b.append(int(mix(s).sum(dtype=U64)))
                    sketches.append(parity_sketch(s))
                    signed.append(signatures(s, threshold))
                lists = np.concatenate([[0], np.cumsum([len(x) for x in signed])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64()),
                    pa.array(np.array(keys_a, dtype=U64).view(np.int64)), pa.array(np.array(keys_b, dtype=U64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(np.concatenate(sketches))),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(np.concatenate(signed).view(np.int64))),
                ], names=["doc_id", "n_shingles", "key_a", "key_b", "sketch", "signatures"])

    return docs.select(doc.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, key_a long, key_b long, sketch array<long>, signatures array<long>")


def linked(pairs: DataFrame, shingle: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose sets have at least the threshold in common, as (a, b)."""
    share = round(threshold * 10000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(column: pa.Array) -> np.ndarray:
            _, data, offsets = next(pieces(column, 1))
            return next(shingles(*words(data, offsets, NOT_BLANK), shingle))

        last, last_text, of_last = None, None, None
        for batch in batches:
            a, b, text_a, text_b = batch.columns
            kept = []
            for i in range(len(batch)):
                # An id can stand for several texts.
                if last is None or a[i] != last or text_a[i] != last_text:
                    last, last_text, of_last = a[i], text_a[i], one(text_a.slice(i, 1))
                other = one(text_b.slice(i, 1))
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                if both and 10000 * both >= share * (len(of_last) + len(other) - both):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(kept, pa.int64())), b.take(pa.array(kept, pa.int64()))], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _marked(docs: DataFrame, doc: Column, ids: DataFrame, bits: int) -> DataFrame:
    """The rows whose id may be among ``ids``, by a bit table of fixed size (a superset; nothing is lost).

    The table has 2**bits bits, so what reaches the driver and the tasks is at
    most 2**bits / 8 bytes whatever the number of ids.
    """
    filled = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("slot")).selectExpr(
        "cast(slot div 64 as int) AS word", "shiftleft(1L, cast(slot % 64 as int)) AS bit")
    rows = filled.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    known = np.zeros((1 << bits) // 64, dtype=np.int64)
    known[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(known)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            hit = (shared.value[at >> 6] >> (at & 63)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select(columns)

    where = F.pmod(F.xxhash64(doc.cast("long")), F.lit(1 << bits))
    return docs.withColumn("_slot", where).mapInArrow(run, docs.schema)


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Fetch both texts of every pair (a, b) and keep the linked ones."""
    right = texts.toDF("b", "text_b")
    left = texts.toDF("a", "text_a")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return linked(both, shingle, threshold)


def similar_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
                       threshold: float = THRESHOLD, filter_bits: int = 24) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row.

    ``class_id`` is the smallest id with the same shingle set, ``component_id``
    the smallest id reachable over links.  A row without words has n_shingles 0
    and is its own class and component.  Rows that repeat an id keep their own
    row; of an id with several texts each text is linked under that id.  A row
    whose id is null gets its sizes and null classes.  Other columns of the
    input are ignored, whatever their names.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = sign(plain, F.col("doc_id"), F.col("text"), shingle, threshold)
    folder = scratch_path(spark, "partenum")
    signed.write.parquet(f"{folder}/signed")
    signed = spark.read.parquet(f"{folder}/signed")
    key = ["n_shingles", "key_a", "key_b"]
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(filled.groupBy(*key).agg(F.min("doc_id").alias("class_id")))
    heads = classes.select(F.col("class_id").alias("doc_id"), *key)
    signers = filled.join(heads, ["doc_id", *key], "left_semi").select("doc_id", F.explode("signatures").alias("signature"))
    group = signers.select("signature", "doc_id", F.expr("min(doc_id) OVER (PARTITION BY signature)").alias("head"),
                           F.expr("max(doc_id) OVER (PARTITION BY signature)").alias("tail"))
    group.where("head < tail").write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups").select("signature", "doc_id", "head")
    texts = _marked(plain, F.col("doc_id"), groups.select(F.col("doc_id").alias("id")), filter_bits)
    texts.write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")

    stars = groups.where("doc_id > head").groupBy("doc_id").agg(F.mode("head", deterministic=True).alias("a"))
    found = cut_lineage(_checked(stars.select("a", F.col("doc_id").alias("b")), texts, shingle, threshold))
    roots = components(found)
    rooted = groups.join(roots, groups["doc_id"] == roots["node"], "left").select(
        "signature", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    several_roots = rooted.select("*", F.expr("min(root) OVER (PARTITION BY signature)").alias("low"), F.expr("max(root) OVER (PARTITION BY signature)").alias("high"))
    open_groups = several_roots.where("low < high").select("signature", "doc_id", "root")
    sketched = filled.select("doc_id", "n_shingles", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)]).distinct()
    open_groups = cut_lineage(open_groups.join(sketched, "doc_id"))
    x, y = open_groups.alias("x"), open_groups.alias("y")
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    may_link = (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-6) & (differ * (1 + threshold) <= (n + m) * (1 - threshold) + 1e-6)
    rest = x.join(y, (F.col("x.signature") == F.col("y.signature")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root")) & may_link).select(
        F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    tested = stars.select("a", F.col("doc_id").alias("b"))
    more = cut_lineage(_checked(rest.join(tested, ["a", "b"], "left_anti"), texts, shingle, threshold))
    # One id with several texts stands for all of them: each text's class is linked to it.
    classed = signed.join(classes, key, "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    same = classed.where("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    several = filled.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("b"))
    same = same.join(several, "b", "left_semi").select("a", "b")
    roots = components(found.unionByName(more).unionByName(same))
    return classed.join(roots, classed["class_id"] == roots["node"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "class_id")).alias("component_id"))


def one_per_component(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay when one document of each component is kept: the one with the smallest id.

    Rows with a null id and rows that repeat the kept id stay as they are.
    """
    found = similar_components(docs, doc, text, **options)
    gone = cut_lineage(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs[doc] == gone["_gone"], "left_anti")
