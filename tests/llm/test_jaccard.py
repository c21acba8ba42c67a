import random
import re

import numpy as np
import pytest

from claimloom.llm import jaccard
from claimloom.llm.components import components
from tests.llm.helpers import LOWER, docs, edited, roots, words


def sets_of(rows):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows):
    sets = sets_of(rows)
    ids = sorted(i for i in sets if i is not None)
    links = []
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    return sets, roots(links, ids)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    for group in range(14):
        base = words(rng.choice([1, 3, 5, 6, 7, 9, 12, 15, 20, 30, 60, 150, 400, 900]), group)
        passage = words(60, 999)
        for copy in range(rng.choice([1, 3, 6])):
            share = rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05])
            out.append(" ".join(edited(base, share, 100 * group + copy)))
        out.append(" ".join(passage + base))  # a passage that many share
    for n in range(5, 18):  # small sets at and just under the threshold
        base = words(n, 70 + n)
        out += [" ".join(base), " ".join(base[:-1]), " ".join(base + ["tail"]), " ".join(base[1:]), " ".join(["Head", *base, "tail"])]
    out += [out[0], out[0].upper(), "", None, "   \n\t ", "one", "ONE", "one two", "a" * 5000, " ".join(words(6000, 3))]
    out.append(" ".join(words(6000, 3)[:-40]))
    rng.shuffle(out)
    return [(3 * k, text) for k, text in enumerate(out)]


def test_components_equal_brute_force(spark, rows):
    sets, want = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in want}


def test_one_document_of_each_component_stays(spark, rows):
    _, want = brute(rows)
    kept = jaccard.one_per_component(docs(spark, rows))
    assert kept.columns[:3] == ["doc_id", "text", "shard"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(words(40, 1))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (3, ""), (4, text + " more")]
    got = sorted(jaccard.similar_components(docs(spark, rows)).select("doc_id", "n_shingles", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, 36, 1), (1, 36, 1), (2, 36, 1), (None, 36, None), (3, 0, 3), (3, 0, 3), (4, 37, 1)], key=str)
    assert jaccard.similar_components(docs(spark, [])).count() == 0
    assert jaccard.one_per_component(docs(spark, [])).count() == 0


def test_an_id_with_several_texts_links_all_of_them(spark):
    x, y = " ".join(words(50, 8)), " ".join(words(50, 9))
    got = jaccard.similar_components(docs(spark, [(1, x), (2, x), (2, y), (3, y)])).select("doc_id", "component_id").distinct().collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 1), (3, 1)}


@pytest.mark.parametrize("size", [3, 8, 14, 15, 22, 40, 90, 250, 700])
def test_sets_at_the_threshold_share_a_signature(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        common = rng.integers(0, 2**63, size, dtype=np.uint64)
        spare = size // 3  # intersection / union = size / (size + spare) >= 0.75
        extra = rng.integers(0, 2**63, spare, dtype=np.uint64)
        cut = rng.integers(0, spare + 1)
        a, b = (np.sort(np.concatenate([common, x])) for x in (extra[:cut], extra[cut:]))
        assert set(jaccard.signatures(a).tolist()) & set(jaccard.signatures(b).tolist())
        differ = sum(int(x ^ y).bit_count() for x, y in zip(jaccard.parity_sketch(a).view(np.uint64), jaccard.parity_sketch(b).view(np.uint64)))
        assert differ <= spare


def test_union_find_on_paths_stars_and_noise(spark):
    rng = random.Random(1)
    path = list(range(0, 60))
    rng.shuffle(path)
    links = [*zip(path, path[1:]), *[(100, k) for k in range(101, 140)], (500, 501), (501, 500), (501, 501), (700, 700), (None, 3)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    nodes = {n for x in links for n in x if None not in x}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots([x for x in links if None not in x], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_pair_is_checked_on_its_own_text(spark):
    one, two = " ".join(words(30, 1)), " ".join(words(30, 2))
    pairs = spark.createDataFrame([(1, 2, one, one), (1, 3, two, two), (1, 4, one, two)], "a long, b long, text_a string, text_b string").coalesce(1)
    assert {(r["a"], r["b"]) for r in jaccard.linked(pairs).collect()} == {(1, 2), (1, 3)}
