"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; the model of each category
sees the probabilities of the earlier ones as further features.  In training
those probabilities come from models that did not see the row (out of fold), so
later models learn from predictions as uncertain as the ones they will get.

Features are the words of a text and the beginnings of words (4 and 5 bytes), as
64-bit hashes, present or not.  Of them the FEATURES with the strongest
association with any category are kept, counted over the training rows, as far
as chance alone would not give it.

The training rows are the only sample: at most ``max_rows`` labelled rows (the
smallest hashes of their ids).  Folds are fitted in parallel, one task a fold on
that bounded sample.  The fitted chain is a few thousand numbers, sent to the
tasks that score every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.textbatch import LOWER, U64, mix, pieces, prefix_sums, span_hashes, table, word_spans
from claimloom.session import cut_lineage

#: Letters of any script: a-z and every byte of a character outside ASCII.
LETTERS = table([*range(0x61, 0x7B), *range(0x80, 0x100)])
PREFIXES = (4, 5)
MAX_ROWS = 16000
FEATURES = 2048
MIN_ROWS = 5
#: Chi-square under which a feature counts as chance, with tens of thousands of features looked at.
MIN_SCORE = 12.0
FOLDS = 4
RIDGE = 1.0
STEPS = 25


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of every word in order, and each row's first place in them."""
    lowered = LOWER[data]
    starts, ends, first = word_spans(lowered, offsets, LETTERS)
    sums = prefix_sums(lowered)
    kinds = [span_hashes(sums, starts, ends)]
    for k in PREFIXES:
        # A word shorter than the prefix repeats its own hash under another salt.
        kinds.append(mix(span_hashes(sums, starts, np.minimum(starts + k, ends)) + U64(k)))
    return np.stack(kinds, axis=1).reshape(-1), first * len(kinds)


@dataclass
class Chain:
    """Known features (sorted) and, per category, bias, feature weights and weights of earlier categories."""

    categories: list[str]
    known: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    threshold: np.ndarray

    def probabilities(self, column: pa.Array) -> np.ndarray:
        out = np.empty((len(column), len(self.categories)))
        # A small table answers most look-ups: no known feature has these low bits.
        low = np.zeros(1 << 20, dtype=bool)
        low[(self.known & U64((1 << 20) - 1)).astype(np.int64)] = True
        for first, data, offsets in pieces(column):
            hashes, at = features(data, offsets)
            maybe = np.flatnonzero(low[(hashes & U64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.known, hashes[maybe]), max(len(self.known) - 1, 0))
            hit = self.known[place] == hashes[maybe] if len(self.known) else np.zeros(0, dtype=bool)
            row = np.searchsorted(at, maybe[hit], side="right") - 1
            present = np.unique(row * len(self.known) + place[hit]) if len(self.known) else np.zeros(0, dtype=np.int64)
            row, place = present // max(len(self.known), 1), present % max(len(self.known), 1)
            n = len(offsets) - 1
            for c in range(len(self.categories)):
                score = np.bincount(row, weights=self.weights[c][place], minlength=n) + self.bias[c]
                score += out[first: first + n, :c] @ self.earlier[c][:c]
                out[first: first + n, c] = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        return out


def _fit_link(rows: np.ndarray, places: np.ndarray, n: int, k: int, extra: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Ridge logistic regression on present features plus dense extra columns: Newton steps solved by conjugate gradients."""
    width = k + extra.shape[1] + 1
    dense = np.hstack([extra, np.ones((n, 1))])
    penalty = np.full(width, RIDGE)
    penalty[-1] = 1e-6

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=w[:k][places], minlength=n) + dense @ w[k:]

    def back(v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(places, weights=v[rows], minlength=k), dense.T @ v])

    w = np.zeros(width)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(times(w), -40, 40)))
        gradient = back(p - y) + penalty * w
        if np.abs(gradient).max() < 1e-4 * n ** 0.5:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, residual = np.zeros(width), -gradient
        direction, square = residual.copy(), residual @ residual
        for _ in range(30):
            image = back(curve * times(direction)) + penalty * direction
            scale = square / max(direction @ image, 1e-12)
            step += scale * direction
            residual = residual - scale * image
            fresh = residual @ residual
            if fresh < 1e-8 * n:
                break
            direction, square = residual + fresh / square * direction, fresh
        w = w + step
    return w[-1], w[:k], w[k:-1]


def _sparse(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    lengths = frame["places"].map(len).to_numpy()
    places = np.concatenate([np.asarray(x, dtype=np.int64) for x in frame["places"]]) if lengths.sum() else np.zeros(0, dtype=np.int64)
    return np.repeat(np.arange(len(frame)), lengths), places


def _link_table(frame: pd.DataFrame, category: int, k: int) -> pd.DataFrame:
    """One fold of one category: fit on the rows outside the fold, predict those inside (fold -1: fit on all)."""
    fold = int(frame["held_out"].iloc[0])
    frame = frame.sort_values(["doc_id"]).reset_index(drop=True)
    rows, places = _sparse(frame)
    extra = np.array(frame["earlier"].tolist(), dtype=float).reshape(len(frame), -1)[:, :category]
    y = frame["labels"].map(lambda x: x[category]).to_numpy(dtype=float)
    train = frame["fold"].to_numpy() != fold
    number = np.cumsum(train) - 1
    kept = train[rows]
    bias, weights, earlier = _fit_link(number[rows[kept]], places[kept], int(train.sum()), k, extra[train], y[train])
    if fold < 0:
        return pd.DataFrame({"held_out": [fold], "doc_id": [None], "p": [None], "model": [np.concatenate([[bias], weights, earlier])]})
    score = np.bincount(rows, weights=weights[places], minlength=len(frame)) + extra @ earlier + bias
    p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    return pd.DataFrame({"held_out": fold, "doc_id": frame["doc_id"][~train], "p": p[~train], "model": None})


def _link_fitter(category: int, k: int):
    def link(frame: pd.DataFrame) -> pd.DataFrame:
        return _link_table(frame, category, k)

    return link


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], doc: str, text: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, labels, hashes): the bounded training sample with the distinct features of each text.

    Label rows with a null id or a null category are left out; of several label
    rows of one id the largest labels count, of several texts one.
    """
    known = labels.select(F.col(doc).cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("chosen"), F.array(*categories).alias("labels"))
    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # max_rows ids bound the broadcast.
    picked = texts.join(F.broadcast(cut_lineage(chosen)), F.col("doc_id") == F.col("chosen")).select("doc_id", "labels", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in pieces(batch.column(2)):
                hashes, at = features(data, offsets)
                lists = [np.unique(hashes[at[i]: at[i + 1]]).view(np.int64) for i in range(len(at) - 1)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(lists)), batch.column(1).slice(first, len(lists)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], names=["doc_id", "labels", "hashes"])

    return picked.mapInArrow(run, "doc_id long, labels array<int>, hashes array<long>").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], doc: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS,
        n_features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fit the chain in the order of ``categories`` and choose each category's threshold on out-of-fold probabilities.

    Without any usable labelled row every probability is 0.
    """
    picked = cut_lineage(sample(docs, labels, categories, doc, text, max_rows))
    n = picked.count()
    size = len(categories)
    if not n:
        return Chain(categories, np.zeros(0, dtype=U64), np.full(size, -40.0), np.zeros((size, 0)), np.zeros((size, size)), np.full(size, 0.5))
    totals = picked.agg(*[F.sum(F.col("labels")[c]).alias(f"n{c}") for c in range(size)]).first()
    counts = picked.select("labels", F.explode("hashes").alias("hash")).groupBy("hash").agg(
        F.count("*").alias("rows"), *[F.sum(F.col("labels")[c]).alias(f"y{c}") for c in range(size)]).where(F.col("rows") >= MIN_ROWS)
    # Chi-square of presence against each category.
    scores = []
    for c in range(size):
        expected = F.col("rows") * F.lit(totals[c] / n)
        rest = F.col("rows") - expected
        scores.append(F.when((expected > 0) & (rest > 0), F.pow(F.col(f"y{c}") - expected, 2) * (1 / expected + 1 / rest)).otherwise(0.0))
    best = counts.select("hash", (F.greatest(*scores) if size > 1 else scores[0]).alias("score")).where(F.col("score") >= MIN_SCORE).orderBy(F.desc("score"), "hash").limit(n_features)
    known = np.sort(best.select("hash").toPandas()["hash"].to_numpy(dtype=np.int64).view(U64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values, ends = column.flatten().to_numpy(zero_copy_only=False).view(U64), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
            hit = known[at] == values if len(known) else np.zeros(len(values), dtype=bool)
            inside = np.concatenate([[0], np.cumsum(hit)])[ends.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(inside.astype(np.int32)), pa.array(at[hit].astype(np.int32)))],
                                             names=["doc_id", "labels", "places"])

    rows = picked.select("doc_id", "labels", "hashes").mapInArrow(place, "doc_id long, labels array<int>, places array<int>")
    rows = cut_lineage(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int")).withColumn("earlier", F.expr("CAST(array() AS ARRAY<DOUBLE>)")))
    bias, weights, earlier, threshold = np.zeros(size), np.zeros((size, len(known))), np.zeros((size, size)), np.full(size, 0.5)
    for c in range(size):
        jobs = rows.withColumn("held_out", F.explode(F.array(*map(F.lit, range(-1, folds)))))

        fitted = cut_lineage(jobs.groupBy("held_out").applyInPandas(_link_fitter(c, len(known)), "held_out int, doc_id long, p double, model array<double>"))
        model = np.array(fitted.where("held_out < 0").first()["model"])
        bias[c], weights[c], earlier[c][:c] = model[0], model[1: len(known) + 1], model[len(known) + 1:]
        held = fitted.where("held_out >= 0").select(F.col("doc_id").alias("d"), "p")
        rows = cut_lineage(rows.join(held, rows["doc_id"] == held["d"]).drop("d").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p"))
        threshold[c] = _threshold(rows, c)
    return Chain(categories, known, bias, weights, earlier, threshold)


def _threshold(rows: DataFrame, category: int) -> float:
    """The cut with the best F1 on out-of-fold probabilities, on a grid of hundredths; ties go to the one nearest 0.5."""
    p, y = F.col("earlier")[category], F.col("labels")[category]
    bins = rows.select(F.floor(p * 100).cast("int").alias("bin"), y.alias("y")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).toPandas()
    n, hit = np.zeros(102), np.zeros(102)
    n[bins["bin"]], hit[bins["bin"]] = bins["n"], bins["y"]
    above, right, grid = np.cumsum(n[::-1])[::-1], np.cumsum(hit[::-1])[::-1], np.arange(102) / 100
    f1 = 2 * right / np.maximum(above + hit.sum(), 1)
    inner = np.arange(5, 96)
    best = inner[f1[inner] >= f1[inner].max() - 1e-12]
    return float(grid[best[np.argmin(np.abs(best - 50))]])


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """All rows and columns with ``p_<category>`` for each category; a null or empty text is scored by the biases alone.

    Columns of the input with these names are replaced.
    """
    names = [f"p_{c}" for c in chain.categories]
    kept = docs.drop(*names)
    # Plain values: a task needs no class of ours to read them.
    shared = docs.sparkSession.sparkContext.broadcast((chain.categories, chain.known, chain.bias, chain.weights, chain.earlier, chain.threshold))
    width = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Chain(*shared.value)
        for batch in batches:
            p = fitted.probabilities(batch.column(width))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *[pa.array(p[:, c]) for c in range(p.shape[1])]], names=[*batch.schema.names[:width], *names])

    schema = kept.schema
    for name in names:
        schema = schema.add(name, "double")
    return kept.withColumn("_scored_text", F.col(text).cast("string")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, chain: Chain, category: str, text: str = "text") -> DataFrame:
    """The rows whose probability of the category is under its threshold, with their own columns."""
    cut = float(chain.threshold[chain.categories.index(category)])
    scored = score(docs, chain, text)
    return scored.where(F.col(f"p_{category}") < cut).select(*docs.columns)
