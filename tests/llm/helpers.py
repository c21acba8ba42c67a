"""Small fixtures shared by the tests of the corpus operators."""

import random

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(n, seed, pool=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}é" if rng.random() < 0.2 else f"word{rng.randrange(pool)}" for _ in range(n)]


def edited(tokens, share, seed):
    rng = random.Random(seed)
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else t for t in tokens]


def roots(links, nodes):
    """Union-find on the driver: node -> smallest node of its component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def docs(spark, rows, extra=True):
    """(doc_id, text) rows, with further columns whose names clash with the operators' own."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return frame
    return frame.selectExpr("doc_id", "text", "1 AS shard", "2 AS a", "'x' AS component_id", "3 AS n", "'y' AS source", "true AS is_target", "4 AS p_toxic", "5 AS spans")
