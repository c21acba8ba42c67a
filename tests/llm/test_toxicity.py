import random

import numpy as np
import pyarrow as pa

from claimloom.llm import toxicity
from tests.llm.helpers import docs, words

BAD = ["vilword", "nastystem", "grimoid"]


def corpus(n=600, seed=3):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        tokens = words(rng.randrange(20, 120), i)
        toxic = rng.random() < 0.2
        severe = toxic and rng.random() < 0.5
        if toxic:
            for _ in range(3):
                # Stems with changing ends: only their beginnings can be learned.
                tokens.insert(rng.randrange(len(tokens)), rng.choice(BAD) + rng.choice(["", "ab", "xy", "q"]) + str(rng.randrange(3)))
        if severe:
            tokens.append("threat")
        rows.append((i, " ".join(tokens)))
        labels.append((i, int(toxic), int(severe)))
    return rows, labels


def test_held_out_accuracy_and_clean_documents(spark):
    rows, labels = corpus()
    train = spark.createDataFrame(labels[:400], "doc_id long, toxic int, severe int")
    chain = toxicity.fit(docs(spark, rows), train, ["toxic", "severe"])
    assert chain.earlier[1][0] > 0  # the second link leans on the first
    scored = {r["doc_id"]: r for r in toxicity.score(docs(spark, rows), chain).collect()}
    for k, name in ((1, "toxic"), (2, "severe")):
        wrong = [i for i, *y in labels[400:] if (scored[i][f"p_{name}"] >= chain.threshold[k - 1]) != bool(y[k - 1])]
        assert len(wrong) <= 2
    kept = toxicity.keep_clean(docs(spark, rows), chain, "toxic")
    assert kept.columns == docs(spark, rows).columns
    gone = {i for i, _ in rows} - {r["doc_id"] for r in kept.collect()}
    assert len(gone ^ {i for i, t, _ in labels if t}) <= 3


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows, labels = corpus(200)
    odd = rows + [(500, None), (501, ""), (502, "w " * 20000), (None, "vilword"), (0, rows[0][1])]
    marks = [*labels, (0, 1, 0), (None, 1, 1), (7, None, 0), (9999, 1, 1)]
    chain = toxicity.fit(docs(spark, odd), spark.createDataFrame(marks, "doc_id long, toxic int, severe int"), ["toxic", "severe"])
    out = toxicity.score(docs(spark, odd), chain)
    assert out.columns == [*[c for c in docs(spark, odd).columns if c != "p_toxic"], "p_toxic", "p_severe"]
    found = out.collect()
    assert len(found) == len(odd) and all(0 <= r["p_toxic"] <= 1 for r in found)
    by_bias = 1 / (1 + np.exp(-chain.bias[0]))
    assert all(abs(r["p_toxic"] - by_bias) < 1e-9 for r in found if r["doc_id"] in (500, 501))
    empty = toxicity.fit(docs(spark, odd), spark.createDataFrame([], "doc_id long, toxic int, severe int"), ["toxic", "severe"])
    assert toxicity.keep_clean(docs(spark, odd), empty, "toxic").count() == len(odd)
    assert toxicity.score(docs(spark, []), chain).count() == 0


def test_probabilities_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    column = pa.array(["Aa bb ccccc dd", None, "", "bb bb zzz É", "ccccc"])
    data, offsets = toxicity.pieces(column).__next__()[1:]
    hashes, at = toxicity.features(data, offsets)
    known = np.unique(hashes)[::2]
    chain = toxicity.Chain(["x", "y"], known, rng.normal(size=2), rng.normal(size=(2, len(known))), np.array([[0, 0], [1.5, 0]]), np.full(2, 0.5))
    got = chain.probabilities(column)
    for i in range(len(column)):
        present = np.isin(known, hashes[at[i]: at[i + 1]])
        x = 1 / (1 + np.exp(-(chain.bias[0] + chain.weights[0][present].sum())))
        y = 1 / (1 + np.exp(-(chain.bias[1] + chain.weights[1][present].sum() + 1.5 * x)))
        assert np.allclose(got[i], [x, y])


def test_a_link_minimises_its_objective():
    rng = np.random.default_rng(2)
    n, k = 80, 6
    x = rng.random((n, k)) < 0.4
    extra = rng.random((n, 1))
    y = (rng.random(n) < 0.3 + 0.5 * x[:, 0]).astype(float)
    rows, places = np.nonzero(x)
    bias, weights, earlier = toxicity._fit_link(rows, places, n, k, extra, y)

    def loss(w):
        z = x @ w[:k] + extra @ w[k:-1] + w[-1]
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * toxicity.RIDGE * np.sum(w[:-1] ** 2)

    best = np.concatenate([weights, earlier, [bias]])
    assert all(loss(best) <= loss(best + 0.05 * rng.normal(size=len(best))) for _ in range(200))
