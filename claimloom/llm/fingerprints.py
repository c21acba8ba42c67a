"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs: at line ends, and before words whose hash is a
multiple of PIECE (every fourth on average), so an edit changes the paragraphs it
touches and no others.  The fingerprint is a table of cells; each distinct
paragraph digest is added to three cells (count, xor of digests, xor of check
hashes).  Subtracting two tables leaves the digests in which the texts differ,
and peeling - taking digests out of cells that hold exactly one - recovers them.
If the table is too small for the difference, peeling gets stuck and is repeated
with a table four times as large, until it succeeds.

All tables of a run of documents are built and peeled together as numpy arrays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.textbatch import NOT_BLANK, U64, mix, prefix_sums, span_hashes, string_bytes, word_spans
from claimloom.session import cut_lineage

PIECE = 4
HASHES = 3
CELLS = 24
GROWTH = 4
RUN_BYTES = 1 << 20


def digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of the distinct paragraphs of every text, sorted."""
    data, offsets = string_bytes(column)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    starts, ends, _ = word_spans(data, offsets, NOT_BLANK)
    sums = prefix_sums(data)
    anchors = starts[span_hashes(sums, starts, ends) % U64(PIECE) == 0]
    lines = np.flatnonzero(data == 10) + 1
    cuts = np.unique(np.concatenate([offsets[:-1], anchors, lines]))
    cuts = cuts[cuts < len(data)]
    hashes = span_hashes(sums, cuts, np.append(cuts[1:], len(data)))
    rows = np.searchsorted(offsets, cuts, side="right") - 1
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[first], hashes[first]


def _places(rows: np.ndarray, keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each key in each third of its row's table."""
    third = cells // HASHES
    return [rows * cells + k * third + (mix(keys + U64(cells * HASHES + k)) % U64(third)).astype(np.int64) for k in range(HASHES)]


def build(rows: np.ndarray, keys: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest xors and check xors of ``n`` tables of ``cells`` cells."""
    count, key, check = np.zeros(n * cells, dtype=np.int64), np.zeros(n * cells, dtype=U64), np.zeros(n * cells, dtype=U64)
    checks = mix(keys)
    for at in _places(rows, keys, cells):
        np.add.at(count, at, 1)
        np.bitwise_xor.at(key, at, keys)
        np.bitwise_xor.at(check, at, checks)
    return count, key, check


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recover (row, digest, sign) from subtracted tables, and tell which rows were recovered in full."""
    rows, found, signs = [], [], []
    while True:
        pure = np.flatnonzero((np.abs(count) == 1) & (check == mix(key)))
        if not len(pure):
            break
        row, got = pure // cells, key[pure]
        _, once = np.unique(got ^ mix(row.astype(U64)), return_index=True)
        row, got, sign = row[once], got[once], count[pure][once]
        checks = mix(got)
        for at in _places(row, got, cells):
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(key, at, got)
            np.bitwise_xor.at(check, at, checks)
        rows.append(row)
        found.append(got)
        signs.append(sign)
    clean = ~((count != 0) | (key != 0) | (check != 0)).reshape(-1, cells).any(axis=1)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), clean
    return np.concatenate(rows), np.concatenate(found), np.concatenate(signs), clean


def _only(rows: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the wanted rows, with the rows numbered anew."""
    number = np.full(int(max(rows.max(initial=-1), wanted.max(initial=-1))) + 2, -1, dtype=np.int64)
    number[wanted] = np.arange(len(wanted))
    kept = number[rows] >= 0
    return number[rows[kept]], keys[kept]


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, sign) of all differing digests of n pairs of texts, and the cells that each pair needed.

    Sign 1: only in the first text; -1: only in the second.
    """
    open_rows, needed = np.arange(n), np.zeros(n, dtype=np.int64)
    rows, found, signs = [], [], []
    while len(open_rows):
        ra, ka = _only(*a, open_rows)
        rb, kb = _only(*b, open_rows)
        one, other = build(ra, ka, len(open_rows), cells), build(rb, kb, len(open_rows), cells)
        row, key, sign, clean = peel(one[0] - other[0], one[1] ^ other[1], one[2] ^ other[2], cells)
        done = clean[row]
        rows.append(open_rows[row[done]])
        found.append(key[done])
        signs.append(sign[done])
        needed[open_rows[clean]] = cells
        open_rows, cells = open_rows[~clean], cells * GROWTH
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate([*rows, empty]).astype(np.int64), np.concatenate([*found, empty.view(U64)]), np.concatenate([*signs, empty]), needed)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of common digests among all digests of each pair (two empty texts: 1), and the cells needed."""
    row, _, sign, needed = difference(a, b, n)
    size_a, size_b = np.bincount(a[0], minlength=n)[:n], np.bincount(b[0], minlength=n)[:n]
    common = size_a - np.bincount(row[sign > 0], minlength=n)
    every = size_a + size_b - common
    return np.where(every > 0, common / np.maximum(every, 1), 1.0), needed


def fingerprint(entries: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS) -> list[str]:
    """One string per text: cells, number of digests, and the cells themselves."""
    count, key, check = build(*entries, n, cells)
    packed = np.zeros(n * cells, dtype=[("count", "<i4"), ("key", "<u8"), ("check", "<u8")])
    packed["count"], packed["key"], packed["check"] = count, key, check
    sizes = np.bincount(entries[0], minlength=n)
    return [f"{cells}:{sizes[i]}:" + base64.b64encode(packed[i * cells: (i + 1) * cells].tobytes()).decode() for i in range(n)]


def read_fingerprint(text: str) -> tuple[int, int, np.ndarray]:
    """Cells, number of digests, and the cell array of a fingerprint string."""
    cells, size, body = text.split(":")
    return int(cells), int(size), np.frombuffer(base64.b64decode(body), dtype=[("count", "<i4"), ("key", "<u8"), ("check", "<u8")])


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, peek, doc_id, text), to be read in order inside each bucket.

    Rows are dealt to ranges of ids; the first row of each range is also sent to
    the range before it (``peek`` 1), that of the first range to the last, so
    each row's successor is the next row of its bucket.  Ids that are null come
    first; ties are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0e308)).alias("order_id"))
    points = ids.agg(F.percentile_approx("order_id", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(100 * buckets)).alias("p")).first()["p"] if buckets > 1 else []
    splits = [-float("inf"), *sorted(set(points or []) - {-1.0e308}), float("inf")]
    ranged = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0e308)).alias("order_id"))
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="order_id", outputCol="range").transform(ranged)
    else:
        ranged = ranged.withColumn("range", F.lit(0.0))
    ranged = ranged.select(F.col("range").cast("int").alias("bucket"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    first = ranged.groupBy("bucket").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("d"), "text_hash")).alias("head"))
    # One row a range: as many as there are partitions.
    heads = cut_lineage(first.select("bucket", F.col("head.d").alias("d"), F.col("head.text_hash").alias("h"), F.expr(
        "coalesce(lag(bucket) OVER (ORDER BY bucket), max(bucket) OVER ())").alias("to")))
    peeks = ranged.join(F.broadcast(heads.drop("bucket")), (F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("d")) & (F.col("text_hash") == F.col("h")))
    peeks = peeks.groupBy("to", "text_hash").agg(F.first("text").alias("text"))
    both = ranged.select("bucket", F.lit(0).alias("peek"), "doc_id", "text_hash", "text").unionByName(
        peeks.select(F.col("to").alias("bucket"), F.lit(1).alias("peek"), F.lit(None).cast("long").alias("doc_id"), "text_hash", "text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "peek", F.asc_nulls_first("doc_id"), "text_hash").select("bucket", "peek", "doc_id", "text")


def _run(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, which is only the successor of the one before."""
    n = len(ids)
    edited = [t[: len(t) - len(t) // 4] + s[: len(t) // 4] for t, s in zip(texts, texts[1:])]
    own, changed = digests(pa.array(texts, pa.string())), digests(pa.array(edited, pa.string()))
    here = _only(*own, np.arange(n))
    after = _only(*own, np.arange(1, n + 1))
    near_edited, cells_edited = likeness(here, changed, n)
    near_next, cells_next = likeness(here, after, n)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(fingerprint(here, n)), pa.array(fingerprint(changed, n)),
        pa.array(near_edited), pa.array(near_next), pa.array(cells_edited), pa.array(cells_next)], names=NAMES)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "cells_edited", "cells_next"]
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
          "cells_edited long, cells_next long")


def versions(docs: DataFrame, doc: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Each text, its edited version and its successor: fingerprints and likeness (see NAMES).

    The edited text is the text with its last quarter replaced by the beginning
    of the next document by id, the first after the last.  A null text counts as
    empty.  Two empty texts are alike (1), an empty and a filled one are not (0).
    Repeated rows follow each other.  An empty table gives no rows.
    """
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranges = buckets or min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 10000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, bucket = 0, None
        for batch in batches:
            for b, peek, one, body in zip(*[c.to_pylist() for c in batch.columns]):
                if b != bucket:
                    ids, texts, size, bucket = [], [], 0, b
                texts.append(body)
                size += len(body)
                if len(texts) > 1 and (peek or size > RUN_BYTES):
                    yield _run(ids, texts)
                    texts, ids, size = [body], [], len(body)
                if not peek:
                    ids.append(one)

    return with_next(slim, ranges).mapInArrow(run, SCHEMA)
