"""Each stage on its own input, and all of them on the small tables."""

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from claimloom.llm.queries import QUERIES, SQL
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_jaccard import brute as brute_links

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    found = entry_module.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found) and set(SQL) <= set(entry_module.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, FOLDER)
        result.write.parquet(f"{folder}/{name}")
        out[name] = (docs, spark.read.parquet(f"{folder}/{name}"))
        docs = out[name][1]
    return out


def rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_columns_are_those_of_documents(stages):
    first = stages["toxicity"][0].columns
    names = list(stages)
    assert all(stages[n][1].columns == first for n in names[:-1])
    assert stages[names[-1]][1].columns == [*first, "virtual_slot", "shard", "map_version"]


def test_toxic_documents_go(spark, stages):
    before, after = (dict(rows(x)) for x in stages["toxicity"])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = set(before) - set(after)
    known = [i for i in before if i in labels]
    assert sum((i in gone) != bool(labels[i]) for i in known) <= 0.1 * len(known)


def test_near_duplicates_and_benchmark_passages_go(spark, stages):
    before, after = (rows(x) for x in stages["near_duplicates"])
    _, want = brute_links(before)
    assert sorted(i for i, _ in after) == sorted(set(want.values()))
    before, after = (rows(x) for x in stages["decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _, _ in brute_windows(before, items) if n}
    assert sorted(i for i, _ in after) == sorted(i for i, _ in before if i not in hit)


def test_mixing_keeps_every_document_and_sharding_every_row(stages):
    before, after = (rows(x) for x in stages["mixture"])
    assert set(after) == set(before) and max(after.count(x) for x in set(after)) <= 2
    before, after = (rows(x) for x in stages["sharding"])
    assert sorted(before) == sorted(after)
    shards = {r["shard"] for r in stages["sharding"][1].collect()}
    assert shards <= set(range(corpus_pipeline.SHARDS)) and len(shards) > 1
