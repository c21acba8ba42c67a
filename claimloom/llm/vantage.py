"""Centroid clustering: each vector's nearest centroid by a vantage-point tree.

Vectors are whole numbers (floor of SCALE times each component), so distances,
sums and means are exact and a result does not depend on how rows are dealt out.

Every round builds a tree over the centroids on the driver (their number is a
parameter), broadcasts it, and sends each vector down best-first: of the nodes
that are open for it the one with the smallest possible distance is visited next,
and the search ends when that is over the best distance found.  A node holds the
distances of its centroids from its vantage centroid as an interval, so |D - r|
bounds what is inside from below.  Bounds are square roots in double precision with
a margin far over their error, and a node at exactly the best distance is still
visited: pruning is inclusive, so of equally near centroids the smallest number
wins.  The distances that decide are whole numbers.

The search runs over a batch of vectors at once, with one row of open bounds for
each vector.  Sums travel as a few numbers for each task, cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1024
LEAF = 2
BATCH = 4096
#: Below this size of all components squared distances fit 64 bits; larger ones are computed with Python's integers.
PLAIN = 1 << 26
#: Relative margin of the bounds; square roots of doubles err by less than 2**-52 of their value.
MARGIN = 1e-9
_LIMB = 40
_COUNT, _INERTIA = -1, -2
_LONG_MAX = (1 << 63) - 1


@dataclass
class Tree:
    """Nodes in an array: a vantage centroid with two children and the intervals of their distances, or a leaf of centroids."""

    centroids: list[list[int]]
    members: list[list[int]] = field(default_factory=list)
    children: list[list[tuple[int, float, float]]] = field(default_factory=list)

    def __post_init__(self):
        self.plain = all(abs(x) < PLAIN for c in self.centroids for x in c)
        self.table = np.array(self.centroids, dtype=np.int64 if self.plain else object)
        self._grow(list(range(len(self.centroids))))

    def _grow(self, numbers: list[int]) -> int:
        here = len(self.members)
        self.members.append(numbers if len(numbers) <= LEAF else numbers[:1])
        self.children.append([])
        if len(numbers) > LEAF:
            at = self.centroids[numbers[0]]
            far = sorted((sum((x - y) ** 2 for x, y in zip(at, self.centroids[n])), n) for n in numbers[1:])
            for part in (far[: len(far) // 2], far[len(far) // 2:]):
                child = self._grow(sorted(n for _, n in part))
                self.children[here].append((child, float(part[0][0]) ** 0.5, float(part[-1][0]) ** 0.5))
        return here

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid and the squared distance."""
        n, kind = len(vectors), np.int64 if self.plain and vectors.dtype != object else object
        best, owner = np.zeros(n, dtype=kind), np.full(n, -1)
        reach = np.full(n, np.inf)
        bounds = np.full((n, len(self.members)), np.inf)
        bounds[:, 0] = 0.0
        open_rows = np.arange(n)
        while len(open_rows):
            node = bounds[open_rows].argmin(axis=1)
            low = bounds[open_rows, node]
            go = np.isfinite(low) & (low <= reach[open_rows])
            open_rows, node = open_rows[go], node[go]
            bounds[open_rows, node] = np.inf
            for k in np.unique(node):
                rows = open_rows[node == k]
                for m in self.members[k]:
                    step = vectors[rows].astype(kind) - self.table[m].astype(kind)
                    d = (step * step).sum(axis=1)
                    better = (owner[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (m < owner[rows]))
                    best[rows[better]], owner[rows[better]] = d[better], m
                reach[rows] = np.sqrt(best[rows].astype(np.float64)) * (1 + MARGIN)
                if self.children[k]:
                    away = np.sqrt(d.astype(np.float64))
                    for child, near, far in self.children[k]:
                        bounds[rows, child] = np.maximum(np.maximum(away - far, near - away) - MARGIN * (away + far), 0.0)
        return owner, best


def whole_vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``size`` finite components, and those rows as whole numbers."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    values = pc.list_flatten(column.filter(right)).cast(pa.float64())
    table = values.to_numpy(zero_copy_only=False).reshape(-1, size)  # a null is NaN here
    good = np.isfinite(table).all(axis=1)
    scaled = np.floor(table[good] * SCALE)
    if not len(scaled) or np.abs(scaled).max() < PLAIN:
        return rows[good], scaled.astype(np.int64)
    return rows[good], np.array([[int(x) for x in row] for row in scaled.tolist()], dtype=object)


def _vectors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            piece = batch.slice(start, BATCH)
            rows, vectors = whole_vectors(piece.column(1), size)
            if len(rows):
                yield piece.column(0).take(pa.array(rows)), vectors


def _summed(vectors: DataFrame, tree: Tree, size: int, tally: Callable) -> dict[tuple[int, int], int]:
    """(cluster, entry) -> exact sum of what ``tally(vectors, owner, distance)`` yields as (cluster, entry, value)."""
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for _, block in _vectors(batches, size):
            for cluster, entry, value in tally(block, *sent.value.nearest(block)):
                sums[cluster, entry] = sums.get((cluster, entry), 0) + int(value)
        rows = []
        for (cluster, entry), value in sums.items():
            sign, value, power = (-1 if value < 0 else 1), abs(value), 0
            while value:
                rows.append((cluster, entry, power, sign * (value & ((1 << _LIMB) - 1))))
                value, power = value >> _LIMB, power + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["cluster", "entry", "power", "part"])

    parts = vectors.mapInArrow(run, "cluster long, entry long, power long, part long")
    found = parts.groupBy("cluster", "entry", "power").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")).collect()
    sent.unpersist()
    out: dict[tuple[int, int], int] = {}
    for r in found:
        out[r["cluster"], r["entry"]] = out.get((r["cluster"], r["entry"]), 0) + (int(r["part"]) << (_LIMB * r["power"]))
    return out


def _component_sums(block: np.ndarray, owner: np.ndarray, distance: np.ndarray):
    for k in np.unique(owner).tolist():
        mine = block[owner == k]
        yield k, _COUNT, len(mine)
        yield from ((k, j, x) for j, x in enumerate(mine.sum(axis=0).tolist()))


def _distance_sums(block: np.ndarray, owner: np.ndarray, distance: np.ndarray):
    for k in np.unique(owner).tolist():
        yield k, _INERTIA, sum(distance[owner == k].tolist())


def starting_centroids(vectors: DataFrame, k: int, size: int, salt: str) -> list[list[int]]:
    """The kept vectors with the smallest hashes of ``salt:id`` in that order; rows of one id follow by their components, null ids come last."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size("v") == size) & finite)
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = kept.select(order.alias("hash"), "v").orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    return [[int(x) for x in np.floor(np.array(r["v"], dtype=np.float64) * SCALE)] for r in first]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, salt: str = "3", vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row.

    Kept are rows whose vector has exactly ``size`` components, none null, NaN or
    infinite.  After ``rounds`` rounds of assignment and floored means every row is
    assigned once more.  A centroid without rows stays as it is; of equally near
    centroids the smaller number wins.  A row that repeats another counts again.  A
    null id is clustered like any other.  Fewer kept rows than ``k`` start as many
    centroids; none give no rows.  A distance or sum over 2**63 - 1 is null.  Other
    columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(vec).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    centroids = starting_centroids(slim, k, size, salt)
    kind = T.StructType([T.StructField("vec_id", slim.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not centroids:
        extra = [F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return spark.createDataFrame([], kind).select("*", *extra)
    for _ in range(rounds):
        sums = _summed(slim, Tree(centroids), size, _component_sums)
        centroids = [[sums.get((c, j), 0) // sums[c, _COUNT] for j in range(size)] if (c, _COUNT) in sums else old for c, old in enumerate(centroids)]
    tree = Tree(centroids)
    inertia = {c: x for (c, _), x in _summed(slim, tree, size, _distance_sums).items()}
    sent = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _vectors(batches, size):
            owner, distance = sent.value.nearest(block)
            fits = [x if x <= _LONG_MAX else None for x in distance.tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(owner.astype(np.int32)), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    def fit(x: int) -> int | None:
        return x if x <= _LONG_MAX else None

    total = fit(sum(inertia.values()))
    facts = [(c, fit(inertia.get(c, 0)), total, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    # One row for each centroid: as many as the parameter k says.
    known = spark.createDataFrame(facts, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = slim.mapInArrow(run, kind)
    return assigned.join(F.broadcast(known), assigned["cluster"] == known["number"]).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
