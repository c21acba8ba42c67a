import random
import re

import numpy as np
import xxhash

from claimloom.llm import simhash
from tests.llm.helpers import LOWER, docs, edited, roots, words


def brute_print(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(tokens[i:i + 3]) for i in range(len(tokens) - 2)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(id, fingerprint, component) of every row, all pairs of distinct fingerprints compared."""
    prints = [brute_print(t) for _, t in rows]
    kinds = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1:] if (a ^ b).bit_count() <= 2]
    root, least = roots(links, kinds), {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted((str(i), f"{p:016x}", str(least.get(root[p]))) for (i, _), p in zip(rows, prints))


def sample():
    base = [" ".join(words(120, k)) for k in range(15)]
    near = [" ".join(edited(b.split(), 0.02, k + i)) for i, b in enumerate(base) for k in range(5)]
    odd = [None, "", " \t\r\n\v\f ", "one", "Two WORDS", "a b c", "A\x0bB\x0cC", "Ä b c", "\x1c\x1d x y", " ".join(["same"] * 50), "x" * 20000, "long " * 5000]
    rows = list(enumerate(base + near + odd + base[:3]))
    return rows + [(None, base[4]), (None, "nobody else has this text here"), (2, "two texts of one id and more"), (3, base[3])]


def got(frame):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_components(frame).collect())


def test_components_equal_brute_force(spark):
    rows = sample()
    assert got(docs(spark, rows)) == brute(rows)
    assert got(docs(spark, [])) == [] and len(got(docs(spark, [(1, None)]))) == 1


def test_small_buckets_and_levels_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SIZE", 4)
    rows = sample()
    assert got(docs(spark, rows)) == brute(rows)


def test_pieces_of_a_long_text_make_the_same_fingerprint(monkeypatch):
    text = " ".join(words(3000, 5)) + "  \n end"
    want = brute_print(text)
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == want


def test_trie_pairs_are_all_pairs_within_the_budget(monkeypatch):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    keys = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for c in centre for _ in range(12)}
    low = np.array(sorted(keys), dtype=np.uint64)
    cut = len(low) // 3
    for block in (8, 1 << 18):
        monkeypatch.setattr(simhash, "BLOCK", block)
        for x, y in ((low, low), (low[:cut], low[cut:])):
            a = simhash.Trie(x, x)
            b = a if x is y else simhash.Trie(y, y)
            found = [(int(a.low[i]), int(b.low[j])) for p, q in simhash.node_pairs(a, b, 2) for i, j in zip(p, q)]
            want = {(int(i), int(j)) for i in x for j in y if (int(i) ^ int(j)).bit_count() <= 2 and (x is not y or i <= j)}
            assert len(found) == len(set(found)) and {tuple(sorted(p)) for p in found} == {tuple(sorted(p)) for p in want}


def test_links_of_a_dense_group_stay_a_forest():
    keys = np.array(sorted({(1 << i) | (1 << j) for i in range(40) for j in range(40)}), dtype=np.uint64)
    trie = simhash.Trie(keys, keys)
    p, q = simhash.forest(trie, trie, 2)
    nodes = [int(k) for k in keys]
    links = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if (a ^ b).bit_count() <= 2]
    assert len(p) < len(nodes) < len(links)
    assert roots(zip(p.tolist(), q.tolist()), nodes) == roots(links, nodes)
