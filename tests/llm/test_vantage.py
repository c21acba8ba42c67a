import hashlib
import math
import random

import numpy as np

from claimloom.llm import vantage

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, id int, v int, number int"


def brute(rows, k, rounds, size):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = {n: sum(d for _, d, m in last if m == n) for n in range(len(centroids))}

    def fit(x):
        return x if x < 1 << 63 else None

    return sorted(((str(i), n, fit(d), fit(total[n]), fit(sum(total.values())), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                   for i, d, n in last), key=str)


def got(spark, rows, k, rounds, size):
    frame = spark.createDataFrame([(i, v, "x", 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(3)
    found = vantage.cluster(frame, k, rounds, size).collect()
    return sorted(((str(r[0]), *r[1:]) for r in found), key=str)


def vectors(n, size, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for i in range(n)]


def odd(size):
    return [(900, None), (901, []), (902, [0.5] * (size - 1)), (903, [0.5] * (size + 1)), (904, [float("nan")] + [0.0] * (size - 1)),
            (905, [float("inf")] * size), (906, [None] + [0.1] * (size - 1)), (907, [0.0] * size), (907, [0.0] * size), (None, [0.25] * size), (908, [-0.0001] * size)]


def test_rounds_equal_plain_loops(spark):
    rows = vectors(120, 6, 1) + odd(6)
    for k, rounds in ((8, 10), (1, 2), (13, 3)):
        assert got(spark, rows, k, rounds, 6) == brute(rows, k, rounds, 6)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 3 - 1), float(i % 2)]) for i in range(40)]
    assert got(spark, rows, 12, 4, 2) == brute(rows, 12, 4, 2)


def test_very_large_components_stay_exact(spark):
    rows = vectors(30, 3, 2) + [(100 + i, [1e30 * (i + 1), -2.5e5, 3.0]) for i in range(3)] + [(200, [70000.0, 1.0, 2.0])]
    assert got(spark, rows, 5, 3, 3) == brute(rows, 5, 3, 3)


def test_fewer_rows_than_centroids_and_no_rows(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.1, 0.9])]
    assert got(spark, rows, 8, 10, 2) == brute(rows, 8, 10, 2)
    assert got(spark, [], 8, 10, 2) == [] and got(spark, [(1, None)], 8, 10, 2) == []


def test_tree_finds_the_nearest_of_many_and_prunes():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-50, 50, (200, 3))
    tree = vantage.Tree([[int(x) for x in c] for c in centroids])
    vectors = rng.integers(-50, 50, (500, 3))
    owner, best = tree.nearest(vectors)
    d = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (owner == d.argmin(axis=1)).all()
