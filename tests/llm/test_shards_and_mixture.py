import math
import zlib
from collections import Counter, defaultdict

import pytest

from claimloom.llm import mixture, shards
from claimloom.session import scratch_path
from tests.llm.helpers import docs, words


def some(n=300):
    rows = [(k, " ".join(words(5 + 37 * k % 200, k))) for k in range(n)]
    return rows + [(900, None), (901, ""), (902, "é" * 3000), (None, "no id"), (0, rows[0][1]), (0, rows[0][1])]


def test_shards_are_near_equal_and_places_gapless(spark):
    rows = some()
    frame = docs(spark, rows)
    plan = shards.balanced_map(frame, 8, slots=512)
    assert [r["slot"] for r in plan.orderBy("slot").collect()] == list(range(512))
    found = shards.placed(frame, plan, slots=512, pieces=3).collect()
    assert len(found) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(8))
    loads = [sum(r["size"] for r in v) for v in by.values()]
    assert max(loads) - min(loads) <= max(r["size"] for r in found)
    for v in by.values():
        assert sorted(r["place"] for r in v) == list(range(len(v)))


def test_the_map_is_the_greedy_one(spark):
    frame = docs(spark, some())
    sums = {r["slot"]: r["bytes"] for r in shards.slot_bytes(frame, slots=64).collect()}
    load, want = [0] * 5, {}
    for slot in sorted(range(64), key=lambda s: (-sums.get(s, 0), s)):
        at = load.index(min(load))
        load[at] += max(sums.get(slot, 0), 1)
        want[slot] = at
    assert {r["slot"]: r["shard"] for r in shards.balanced_map(frame, 5, slots=64).collect()} == want


def test_edits_move_few_slots_and_versions_stay(spark):
    frame = docs(spark, some())
    path = scratch_path(spark, "maps")
    sums = shards.slot_bytes(frame, slots=256)
    shards.store_map(shards.balanced_map(frame, 4, slots=256), path)
    old = {r["slot"]: r["shard"] for r in shards.load_map(spark, path).collect()}
    shards.store_map(shards.edited_map(shards.load_map(spark, path), sums, 5), path)
    newer = shards.load_map(spark, path).collect()
    assert {r["version"] for r in newer} == {2} and shards.load_map(spark, path, 1).count() == 256
    new = {r["slot"]: r["shard"] for r in newer}
    moved = [s for s in old if old[s] != new[s]]
    assert moved and all(new[s] == 4 for s in moved)
    loads = Counter()
    for r in newer:
        loads[r["shard"]] += r["bytes"]
    assert max(loads.values()) - min(loads.values()) <= 2 * max(r["bytes"] for r in newer)
    assert shards.assign(frame, shards.load_map(spark, path), slots=256).columns == [*[c for c in frame.columns if c != "shard"], "virtual_slot", "shard", "map_version"]


def test_sharding_an_empty_table(spark):
    frame = docs(spark, [])
    assert shards.placed(frame, shards.balanced_map(frame, 3, slots=16), slots=16).count() == 0


def sources(spark):
    rows = [(k, " ".join(words(20 + k % 50, k)), s) for k, s in enumerate(["hot"] * 200 + ["b"] * 60 + [None] * 25 + ["small"] * 8)]
    rows += [(700, None, "b"), (701, "", "hot"), (702, None, "silent"), (0, rows[0][1], "hot")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mix_x", "2 AS tokens", "3 AS weight", "4 AS start")


def test_repeats_stay_under_the_limit_and_no_document_is_lost(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK_TOKENS", 300)
    rows, frame = sources(spark)
    out = mixture.mixed(frame, max_repeats=3.0).collect()
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    hot = max(tokens.values())
    t = 1 - math.log(3) / math.log(hot / tokens["small"])  # where the smallest source is repeated three times
    epochs = defaultdict(lambda: defaultdict(Counter))
    for r in out:
        epochs[r["source"]][r["mix_epoch"]][(r["doc_id"], r["text"])] += 1
    for source, total in tokens.items():
        own = Counter((i, text) for i, text, s in rows if s == source)
        budget = total * (hot / total) ** (1 - t) if total else 0
        got, size = epochs[source], lambda c: sum(n * len((text or "").split()) for (_, text), n in c.items())
        assert got[0] == own
        if total:
            assert sum(size(c) for c in got.values()) == pytest.approx(budget, abs=75)
            for e in range(max(got)):
                assert got[e] == own
            assert not got[max(got)] - own
    blocks = defaultdict(set)
    for r in out:
        blocks[(r["source"], r["mix_epoch"], r["mix_block"])].add(r["mix_position"])
        assert 0 <= r["mix_position"] <= 1
    assert all(len(p) == 1 for p in blocks.values())
    places = defaultdict(list)
    for r in out:
        places[(r["source"], r["mix_epoch"], r["mix_block"])].append(r["mix_place"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in places.values())


def test_entropy_target_and_token_budget(spark):
    rows, frame = sources(spark)
    shares = mixture.source_shares(frame)
    for target in (0.9, 1.2):
        t = mixture.exponent(shares, entropy=target)
        w = [r["weight"] for r in mixture.budgets(shares, t).collect() if r["weight"]]
        assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(target, abs=1e-6)
    assert mixture.exponent(shares, entropy=mixture.max_entropy(4)) == 0.0
    out = mixture.mixed(frame, entropy=1.2, budget=2000.0, ordered=False).collect()
    assert sum(len((r["text"] or "").split()) for r in out) == pytest.approx(2000, abs=4 * 75)


def test_mixing_one_source_and_none(spark):
    one = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")], "doc_id long, text string, source string")
    assert mixture.mixed(one, max_repeats=4.0).count() == 2
    assert mixture.mixed(one.limit(0), max_repeats=4.0).count() == 0
    silent = spark.createDataFrame([(1, None, "x"), (2, "", None)], "doc_id long, text string, source string")
    assert mixture.mixed(silent, max_repeats=4.0).count() == 2
