"""Document scores by the cross-entropy difference of two n-gram models.

A target model and a background model are counted over all their documents, with
one vocabulary, one order and one smoothing, so their losses differ only by what
the texts say.  A document's score is the mean over its tokens of target loss
minus background loss: the lower, the more it resembles the target.

* Vocabulary: all words that occur at least MIN_COUNT times in each corpus; every
  other word is the one unknown.
* Model: bigrams interpolated with add-ALPHA unigrams, and the start of a text as
  a context of its own.
* Bigrams: all are counted and all are in the model.  The HOT most frequent are
  broadcast.  The others stay a table: a task gives their tokens the unigram part
  and lists their codes, and a shuffle join by code brings what the bigram changes
  in the loss, summed per row.  HOT steers cost, not results.

``vocabulary_words`` and ``pairs`` make smaller models on request (the most
frequent words, and bigrams with at least c occurrences, c being the smallest
count under which at most ``pairs`` are left); neither is set by default.

The vocabulary with its counts (24 bytes a word) and the HOT bigrams reach the
driver and the tasks; the vocabulary grows with the corpus, though much slower.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from claimloom.llm.textbatch import NOT_BLANK, U64, pieces, words
from claimloom.session import cut_lineage, scratch_path

#: No bound: every word with MIN_COUNT occurrences in each corpus.
WORDS = 1 << 62
#: So many bigrams are broadcast; the rest is joined.
HOT = 1_000_000
MIN_COUNT = 2
ALPHA = 0.1
MIXING = 0.7
#: A task hands over its counts when it holds so many different keys.
HELD = 4_000_000
#: More ids than this are joined by a shuffle and not broadcast.
BROADCAST_IDS = 4_000_000


def flagged(docs: DataFrame, ids: DataFrame, doc: str = "doc_id", most: int = BROADCAST_IDS) -> DataFrame:
    """The documents with ``is_target``: whether their id is among the (distinct, not null) ``ids``."""
    chosen = cut_lineage(ids.select(F.col(ids.columns[0]).alias("_target_id")).dropna().distinct())
    side = F.broadcast(chosen) if chosen.count() <= most else chosen
    return docs.join(side, docs[doc] == side["_target_id"], "left").withColumn("is_target", F.col("_target_id").isNotNull()).drop("_target_id")


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """(key, target, background) summed over all rows (text, is_target); ``keys_of`` gives a run's keys and rows."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        """The counts of each key; the parts are let go, and the columns are summed one after the other, for the room they take."""
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        parts.clear()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        sums = np.zeros((len(first), 2), dtype=np.int64)
        if len(first):
            for c in range(2):
                sums[:, c] = np.add.reduceat(counts[:, c][order], first)
        return keys[first], sums

    def handed(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 1 << 18):
            k, c = keys[at: at + (1 << 18)], counts[at: at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.ascontiguousarray(c[:, 0])), pa.array(np.ascontiguousarray(c[:, 1]))], names=["key", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = total = 0
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, data, offsets in pieces(batch.column(0)):
                keys, row = keys_of(data, offsets)
                is_target = flags[first + row]
                kinds, inverse = np.unique(keys, return_inverse=True)
                target = np.bincount(inverse, weights=is_target, minlength=len(kinds)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(kinds))
                held.append((kinds, np.stack([target, every - target], axis=1)))
                size += len(kinds)
                if size > total + total // 2 + (1 << 20):
                    held = [merged(held)]
                    size = total = len(held[0][0])
                    if total > HELD:
                        yield from handed(*held[0])
                        held, size, total = [], 0, 0
        if held:
            yield from handed(*merged(held))

    counted = rows.mapInArrow(run, "key long, target long, background long")
    return counted.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def _written(table: DataFrame, label: str) -> DataFrame:
    """The table from files in the shared folder: columns of sorted keys take a fraction of checkpointed rows."""
    folder = scratch_path(table.sparkSession, label)
    table.sortWithinPartitions("key").write.option("compression", "zstd").parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def _rows(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _sorted_in_rows(codes: np.ndarray, row: np.ndarray, bound: int) -> np.ndarray:
    """The codes (under ``bound``) in ascending order inside each row; the rows do not descend."""
    if len(codes) and (int(row[-1]) + 1) * bound < 1 << 63:
        keys = row * bound + codes
        keys.sort()
        return keys % bound
    return codes[np.lexsort((codes, row))]


def _least(counted: DataFrame, most: int) -> int:
    """The smallest c for which at most ``most`` rows have at least c occurrences.

    The sizes of all counts below 4096, and of doublings above, are enough to find c.
    """
    n = F.col("target") + F.col("background")
    doubled = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double")) + 1e-9)).cast("long")
    sizes = counted.groupBy(F.when(n < 4096, n).otherwise(doubled).alias("n")).count().orderBy("n").collect()
    left, least = sum(r["count"] for r in sizes), 1
    for r in sizes:
        if left <= most:
            break
        left, least = left - r["count"], r["n"] + 1 if r["n"] < 4096 else 2 * r["n"]
    return least


def _most_frequent(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and counts of all rows with at least c occurrences, and c: the smallest under which at most ``most`` are left."""
    least = _least(counted, most)
    n = F.col("target") + F.col("background")
    # At most ``most`` rows of three numbers, as Arrow.
    kept = counted.where(n >= least).select("key", "target", "background").toArrow()
    columns = [kept.column(c).to_numpy() for c in ("key", "target", "background")]
    return columns[0].astype(np.int64), np.stack(columns[1:], axis=1).astype(np.int64), least


@dataclass
class Models:
    """Both models; column 0 of a count table is the target, column 1 the background."""

    vocabulary: np.ndarray  # sorted word hashes
    single: np.ndarray  # occurrences by word number; the unknown word is the last but one, the start of a text the last
    pair_codes: np.ndarray  # sorted
    pair_counts: np.ndarray
    rest: DataFrame | None = None  # (key, target, background) of all other bigrams of the model

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        # Each word is looked up once a run: sorted look-ups stay in the cache, those in text order do not.
        kinds, inverse = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.vocabulary, kinds), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == kinds, at, len(self.vocabulary))[inverse]

    def codes(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word number and bigram code (context, word) of every token."""
        here = self.numbers(hashes)
        before = np.empty_like(here)
        before[1:] = here[:-1]
        before[first[:-1][first[1:] > first[:-1]]] = len(self.vocabulary) + 1
        return here, before * (len(self.vocabulary) + 2) + here

    def code_losses(self, codes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Negative log probability under each model of the words of bigrams that occur ``found`` times."""
        width = len(self.vocabulary) + 2
        tokens = self.single[:-1].sum(axis=0)
        unigram = (self.single[codes % width] + ALPHA) / (tokens + ALPHA * (width - 1))
        share = found / np.maximum(self.single[codes // width], 1)
        return -np.log(MIXING * share + (1 - MIXING) * unigram)

    def losses(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Losses of every token by the bigrams at hand, its bigram code, and whether that bigram is not at hand."""
        codes = self.codes(hashes, first)[1]
        if not len(self.pair_codes):
            return self.code_losses(codes, np.zeros((len(codes), 2))), codes, np.ones(len(codes), dtype=bool)
        kinds, inverse = np.unique(codes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair_codes, kinds), len(self.pair_codes) - 1)
        known = self.pair_codes[at] == kinds
        return self.code_losses(kinds, np.where(known[:, None], self.pair_counts[at], 0))[inverse], codes, ~known[inverse]


def train(rows: DataFrame, vocabulary_words: int = WORDS, pairs: int | None = None, hot: int = HOT) -> Models:
    """Both models from all rows (text, is_target)."""

    def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, first = words(data, offsets, NOT_BLANK)
        return hashes, _rows(first)

    seen = _written(_counted(rows, word_keys), "words")
    both = seen.where((F.col("target") >= MIN_COUNT) & (F.col("background") >= MIN_COUNT))
    word_keys_kept, counts, _ = _most_frequent(both, vocabulary_words)
    order = np.argsort(word_keys_kept.view(U64))
    vocabulary, counts = word_keys_kept.view(U64)[order], counts[order]
    total = seen.agg(F.sum("target"), F.sum("background")).first()
    texts = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("is_target").count().collect()  # two rows at most
    starts = {r["is_target"]: r["count"] for r in texts}
    unknown = [(total[c] or 0) - int(counts[:, c].sum()) for c in range(2)]
    single = np.vstack([counts, np.array([unknown, [starts.get(True, 0), starts.get(False, 0)]], dtype=np.int64)])
    half = Models(vocabulary, single, np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64))

    def pair_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, first = words(data, offsets, NOT_BLANK)
        return half.codes(hashes, first)[1], _rows(first)

    counted = _written(_counted(rows, pair_keys), "bigrams")
    n = F.col("target") + F.col("background")
    if pairs is not None:
        counted = counted.where(n >= _least(counted, pairs))
    codes, pair_counts, least = _most_frequent(counted, hot)
    order = np.argsort(codes)
    return Models(vocabulary, single, codes[order], pair_counts[order], counted.where(n < least))


def score(docs: DataFrame, models: Models, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, target_loss, background_loss, score) of every row; the losses of a text without tokens are null.

    Repeated rows are scored each; other columns are ignored, whatever their names.
    """
    # Plain values: a task needs no class of ours to read them.
    shared = docs.sparkSession.sparkContext.broadcast((models.vocabulary, models.single, models.pair_codes, models.pair_counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Models(*shared.value)
        for batch in batches:
            for start, data, offsets in pieces(batch.column(2)):
                hashes, first = words(data, offsets, NOT_BLANK)
                n, row = len(offsets) - 1, _rows(first)
                loss, codes, open_ = known.losses(hashes, first)
                sums = [np.bincount(row, weights=loss[:, c], minlength=n).astype(np.float64) for c in range(2)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[open_], minlength=n))]).astype(np.int32)
                listed = _sorted_in_rows(codes[open_], row[open_], (len(known.vocabulary) + 2) ** 2)  # sorted numbers take less room
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(np.diff(first).astype(np.int64)), *[pa.array(x) for x in sums],
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(listed))], names=[*batch.schema.names[:2], "n_tokens", "target_sum", "background_sum", "codes"])

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Models(*shared.value)
        for batch in batches:
            codes = batch.column(1).to_numpy()
            counts = np.stack([batch.column(c).to_numpy() for c in (2, 3)], axis=1)
            changed = known.code_losses(codes, counts) - known.code_losses(codes, np.zeros_like(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(changed[:, c])) for c in range(2)]], names=["_of", "target_change", "background_change"])

    slim = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc), F.col(text).cast("string").alias("_text"))
    schema = slim.select("_row", doc).schema
    for name, kind in (("n_tokens", "long"), ("target_sum", "double"), ("background_sum", "double"), ("codes", ArrayType(LongType()))):
        schema = schema.add(name, kind)
    means = [F.when(F.col("n_tokens") > 0, F.col(f"{c}_sum") / F.col("n_tokens")).alias(f"{c}_loss") for c in ("target", "background")]
    scored = slim.mapInArrow(run, schema)
    if models.rest is not None:
        # Written: the row numbers must be the same in both uses.
        folder = scratch_path(docs.sparkSession, "scores")
        scored.write.option("compression", "zstd").parquet(folder)
        scored = docs.sparkSession.read.schema(schema).parquet(folder)
        # Small counts travel, and become changes of the loss after the join: those are numbers that do not compress.
        tokens = scored.select("_row", F.explode("codes").alias("key"))
        met = tokens.join(models.rest.select("key", "target", "background"), "key").select("_row", "key", "target", "background")
        moved = met.mapInArrow(changes, "_of long, target_change double, background_change double").groupBy("_of").agg(
            F.sum("target_change").alias("target_change"), F.sum("background_change").alias("background_change"))
        scored = scored.drop("codes").join(moved, F.col("_row") == F.col("_of"), "left")
        for c in ("target", "background"):
            scored = scored.withColumn(f"{c}_sum", F.col(f"{c}_sum") + F.coalesce(f"{c}_change", F.lit(0.0)))
    return scored.select(doc, "n_tokens", *means).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def cross_entropy_difference(docs: DataFrame, is_target: Column, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Train on all documents (target: where ``is_target`` is true; background: the others) and score all of them."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(is_target, F.lit(False)).alias("is_target"))
    return score(docs, train(rows, **options), doc, text)
