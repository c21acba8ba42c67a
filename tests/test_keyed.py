"""Skew-safe building blocks against brute force, with one key holding a third or more of all rows."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.operators import chunks, corpus, keyed, ledger, ranking, reproduction


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    return [(rng.choice(["hot"] * 5 + list("abcdef")), i, rng.randint(0, 9) / 10, rng.randint(0, 1)) for i in range(4000)]


def test_ordinal_and_running_sum(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, i bigint, p double, y int").repartition(7)
    out = keyed.running_sums(df, ["k"], "i", {"n": F.lit(1).cast("bigint"), "s": F.col("y").cast("bigint")})
    got = {(r["k"], r["i"]): (r["n"], r["s"]) for r in out.collect()}
    pdf = pd.DataFrame(skewed, columns=["k", "i", "p", "y"]).sort_values("i")
    pdf["n"] = pdf.groupby("k").cumcount() + 1
    pdf["s"] = pdf.groupby("k")["y"].cumsum()
    assert got == {(k, i): (n, s) for k, i, n, s in pdf[["k", "i", "n", "s"]].itertuples(index=False)}


def test_ranking_metrics(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, i bigint, p double, y int").repartition(5)
    pdf = pd.DataFrame(skewed, columns=["k", "i", "p", "y"])
    rank = pdf["p"].rank(method="average")
    pos, neg = (pdf["y"] == 1).sum(), (pdf["y"] == 0).sum()
    auc = (rank[pdf["y"] == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    assert abs(ranking.auroc(df, "y", "p").first()["auroc"] - auc) < 1e-12
    ordered = pdf.sort_values(["p", "i"], ascending=[False, True])
    precision = (ordered["y"].cumsum() / np.arange(1, len(ordered) + 1))[ordered["y"] == 1].mean()
    assert abs(ranking.average_precision(df, "y", "p", "i").first()["average_precision"] - precision) < 1e-12
    got = {r["i"]: r["average_rank"] for r in ranking.average_rank(df, "p").collect()}
    assert got == dict(zip(pdf["i"], rank))
    empty = ranking.auroc(df.filter("y = 1"), "y", "p").first()["auroc"]
    assert empty is None


def test_quantiles_type_seven(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, i bigint, p double, y int")
    got = {r["k"]: (r["a"], r["b"]) for r in ranking.quantiles(df, ["k"], "i", {"a": 0.05, "b": 0.5}).collect()}
    pdf = pd.DataFrame(skewed, columns=["k", "i", "p", "y"])
    for k, g in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(g["i"], [0.05, 0.5]))


def test_top_per_key_plan_limits_before_the_shuffle(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, i bigint, p double, y int")
    top = keyed.top_per_key(df, ["k"], [F.col("p").desc(), "i"], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") < plan.rindex("WindowGroupLimit")
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3


def test_set_digest_ignores_order_and_repeats(spark):
    a = spark.createDataFrame([(x,) for x in ["aa", "bb", "ab", "", None, "aa"]], "h string")
    b = spark.createDataFrame([(x,) for x in ["ab", "bb", "aa"]], "h string")
    assert keyed.set_digest(a, "h").first() == keyed.set_digest(b, "h").first()


def test_set_digest_groups_stay_small_at_any_count(spark, monkeypatch):
    monkeypatch.setattr(keyed, "DIGEST_GROUP", 4)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for n in (0, 1, 4, 5, 300, 2000):
        hashes = sorted(sha(str(i)) for i in range(n))
        level, width = [(h, h) for h in hashes], keyed.digest_width(n)
        assert n <= 4 * 16**width and (width == 0 or n > 4 * 16 ** (width - 2))
        for digits in range(width, -1, -2):
            groups = {}
            for p, d in sorted(level):
                groups.setdefault(p[:digits], []).append(d)
            level = [(p, sha("".join(ds))) for p, ds in groups.items()]
        got = keyed.set_digest(spark.createDataFrame([(h,) for h in hashes], "h string"), "h").collect()
        assert [(r["digest"], r["n_hashes"]) for r in got] == [(d, n) for _, d in level]


def first_wins(rows):
    kept, ids, contents = [], set(), set()
    for doc, seq, i, c in sorted(rows, key=lambda r: r[1]):
        if (doc, i) not in ids and (doc, c) not in contents:
            kept.append(seq)
            ids.add((doc, i))
            contents.add((doc, c))
    return sorted(kept)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=40))
def test_claim_dedupe_matches_the_sequential_rule(spark, raw):
    rows = [(d, n, f"i{i}", f"c{c}") for n, (d, i, c) in enumerate(raw)]
    df = spark.createDataFrame(rows, "doc_id int, seq int, i string, c string")
    got = sorted(r["seq"] for r in ledger.first_wins_pairs(df, ["doc_id"], "i", "c", "seq").collect())
    assert got == first_wins(rows)


def test_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    curve = [("a", float(t), float(v)) for t, v in zip(np.sort(rng.uniform(0, 50, 200)), rng.normal(size=200))]
    targets = [("a", i, float(t)) for i, t in enumerate(rng.uniform(-5, 60, 80))]
    c = spark.createDataFrame(curve, "k string, time double, median double")
    g = spark.createDataFrame(targets, "k string, n int, time double")
    got = {r["n"]: r["simulated"] for r in reproduction.interpolate(c, g, ["k"]).collect()}
    want = np.interp([t for _, _, t in targets], [t for _, t, _ in curve], [v for _, _, v in curve])
    assert np.allclose([got[i] for i in range(80)], want)


def brute_budget(pages, budget, terms):
    import re
    pages = [re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", p)) for p in pages]
    numbers = list(range(1, len(pages) + 1))
    if sum(map(len, pages)) > budget:
        score = [sum(t in p.lower() for t in terms) for p in pages]
        order = list(dict.fromkeys([0, len(pages) - 1] + sorted(range(len(pages)), key=lambda i: -score[i])))
        chosen, used = [], 0
        for i in order:
            if not chosen or used + len(pages[i]) + 40 <= budget:
                chosen.append(i)
                used += len(pages[i]) + 40
        numbers = sorted(i + 1 for i in chosen)
    text = "\n\n".join(f"[PAGE {n}]\n{pages[n - 1]}" for n in numbers)
    text = re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text))
    return text[:budget] + "\n\n[TRUNCATED]" if len(text) > budget else text


@pytest.mark.parametrize("budget", [60, 200, 700, 10_000])
def test_budgeted_text(spark, budget):
    rng = random.Random(budget)
    pages = ["".join(rng.choice(["model ", "x\t y ", "clearance\n", "\n\n\n\n"]) for _ in range(rng.randint(0, 12))) for _ in range(15)]
    got = spark.createDataFrame([(pages,)], "p array<string>").select(chunks.budgeted_text(F.col("p"), budget).alias("t")).first()["t"]
    from claimloom import config
    assert got == brute_budget(pages, budget, config.PAGE_TERMS)


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    rows = chunks.document_chunks(spark.createDataFrame([(1, text), (2, "   ")], "d int, t string"), "t", ["d"], 600, 100).orderBy("idx").collect()
    assert {r["d"] for r in rows} == {1} and rows[-1]["end"] == 10_000
    assert all(r["chunk_text"] == text[r["start"] - 1:r["end"]] for r in rows)
    assert [r["start"] for r in rows] == list(range(1, rows[-1]["start"] + 1, 500)) and rows[-2]["end"] < 10_000


def test_retrieval_finds_the_block(spark):
    text = "intro " * 200 + "\n# Methods\n" + "filler " * 300 + " $OMEGA variability eta omega table " + "tail " * 300
    rows = chunks.retrieve_chunks(spark.createDataFrame([(1, text)], "d int, t string"), "t", ["d"], ["omega", "eta", "variability"], 2, 800, 100).collect()
    assert any("$OMEGA" in r["chunk_text"] for r in rows) and [r["idx"] for r in rows] == sorted(r["idx"] for r in rows)


def test_locator(spark):
    text = "# Title\npage 3\n" + "x" * 900
    row = chunks.document_chunks(spark.createDataFrame([(1, text)], "d int, t string"), "t", ["d"], 500, 0).filter("idx = 2").first()
    assert row["locator"] == "page 3; Title; characters 501-915"


def test_first_groups_keep_whole_articles(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("a", 2), ("c", 3), ("b", 9)], "g string, at int")
    assert sorted(r["at"] for r in corpus.first_groups(df, "g", "at", 2).collect()) == [1, 2, 5, 9]
