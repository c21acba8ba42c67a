import copy
import json
import random

from pyspark.sql import functions as F

from claimloom.functions import jsontools as J
from claimloom.plans import lanes
from claimloom.schemas import CONTRACTS, spark_type


def example(spec, rng):
    """A random value that keeps a contract."""
    types = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
    kind = rng.choice(types)
    if kind == "object":
        return {name: example(child, rng) for name, child in spec["properties"].items()}
    if kind == "array":
        return [example(spec["items"], rng) for _ in range(rng.randrange(min(3, spec.get("maxItems", 3)) + 1))]
    if kind == "string":
        return rng.choice(spec.get("enum", ["a", "", 'é "x"', "12"]))
    if kind == "boolean":
        return rng.random() < 0.5
    if kind == "integer":
        return rng.choice([0, 3, -7, 5.0])
    return None if kind == "null" else rng.choice([0, 1, 0.25, 1.0])


def places(value, path=()):
    yield path
    for key, child in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from places(child, (*path, key))


def broken(value, rng):
    """The value with one place changed, which may break the contract."""
    value = copy.deepcopy(value)
    path = rng.choice([p for p in places(value) if p])
    at = value
    for key in path[:-1]:
        at = at[key]
    change = rng.randrange(4)
    if change == 0 and isinstance(at, dict):
        del at[path[-1]]
    elif change == 1 and isinstance(at, dict):
        at["surprise"] = 1
    elif change == 2 and isinstance(at[path[-1]], list):
        at[path[-1]] = at[path[-1]] * 200
    else:
        at[path[-1]] = rng.choice(["odd", 7, -1, 2.5, 1e30, None, True, [], {}, ["x"]])
    return value


def test_the_batch_check_says_what_the_row_expression_says(spark):
    rng = random.Random(1)
    for kind in ("assessment", "claim", "question", "triage"):
        spec = CONTRACTS[kind]
        texts = [json.dumps(x) for _ in range(60) for x in [example(spec, rng)]]
        texts += [json.dumps(broken(json.loads(t), rng)) for t in texts for _ in range(3)] + ["[]", "1", "null"]
        frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "payload string")
        rows = frame.select("payload", J.conformance_error(F.try_parse_json("payload"), spec).alias("a"), J.payload_fault(F.col("payload"), spec).alias("b")).collect()
        assert [r for r in rows if r["a"] != r["b"]] == [] and sum(r["a"] is not None for r in rows) > 40


def loaded(value, spec):
    """What a decoded value must be: null members stand, whole numbers are integers."""
    if isinstance(value, dict):
        return {name: loaded(value[name], child) for name, child in spec["properties"].items()}
    if isinstance(value, list):
        return [loaded(v, spec["items"]) for v in value]
    return int(value) if "integer" in spec["type"] and value is not None else value


def test_a_decoded_lane_is_the_whole_response(spark):
    rng = random.Random(2)
    spec = CONTRACTS["lane"]
    good = [example(spec, rng) for _ in range(25)]
    texts = [(n, json.dumps(x)) for n, x in enumerate(good)] + [(100 + n, json.dumps(broken(x, rng))) for n, x in enumerate(good)] + [(200, None), (201, "prose"), (202, "")]
    rows = {r["n"]: r for r in lanes.decode_lane(spark.createDataFrame(texts, "n int, response string"), "response").select("n", "available", "error", "decoded", "extraction").collect()}
    for n, x in enumerate(good):
        assert rows[n]["error"] is None and rows[n]["available"] and rows[n]["decoded"].asDict(True) == loaded(x, spec)
    bad = [r for n, r in rows.items() if n >= 100 and r["error"] is not None]
    assert len(bad) > 10 and not any(r["available"] or r["decoded"] or r["extraction"] for r in bad)
    assert all(r["available"] == (r["error"] is None) for n, r in rows.items() if 100 <= n < 200)
    assert not any(rows[n]["available"] for n in (200, 201, 202))
    assert set(spark_type(spec).fieldNames()) == set(spec["properties"])


def test_enriched_lanes_keep_what_was_reported(spark):
    rng = random.Random(3)
    one = example(CONTRACTS["lane"], rng)
    x = one["extraction"]
    x.update(route="oral", n_subjects=9, population="p")
    x["population_details"].update(n_total=12, cohorts=[])
    x["structural_model"].update(advan=None, trans=None, compartments=None, implementations=[])
    x["structural_model"]["canonical"] = {"compartments": {"count": 2, "names": []}, "input": {"route": "oral", "process": "first_order", "depot": True},
                                          "elimination": {"type": "linear", "from": "c"}, "parameterization": {"type": "clearance_volume", "parameters": []}, "description": ""}
    two = copy.deepcopy(one)
    made = dict(engine="e", advan=6, trans=1, status="derived", confidence=1, rationale="", evidence=dict(status="reported", source_locator="", evidence="", confidence=1), alternatives=[], review_required=True)
    two["extraction"]["structural_model"].update(advan=13, compartments=3, implementations=[made])
    two["extraction"]["population_details"]["n_total"] = None
    frame = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(two))], "n int, response string")
    a, b = (r["extraction"] for r in lanes.decode_lane(frame, "response").orderBy("n").collect())
    assert (a["advan"], a["trans"], a["compartments"], a["n_subjects"], a["implementation"]["status"]) == (4, 4, 2, 12.0, "inferred")
    assert (b["advan"], b["compartments"], b["n_subjects"], b["implementation"]["status"], b["implementation"]["advan"]) == (13, 3, 9.0, "derived", 6)


def test_a_response_is_repaired_and_checked_once(spark, tmp_path):
    from workload import jobs

    rows = [(k, f"part {k}", 1 + k % 50) for k in range(1, 40)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = jobs.response_claims(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # one repair, one check, both above the exchange that spreads the one small file
    assert plan.count("ArrowEvalPython [") == 2 and "ArrowEvalPython" not in plan[plan.index("Exchange RoundRobin"):]
    kept = {k for k, *_ in rows if k % 11 and k % 13}
    assert {r["p_partkey"] for r in found.collect()} == kept


def test_texts_around_one_json_value(spark):
    from claimloom.functions import jsontools as J

    texts = ['{"a": 1}', ' \t\n{"a": 1} ', "[1]", '"{"', "3", "null", '{"a": 1} {"b": 2}', '{"a": 1},{"b": 2}', "", None, "{", '{"a": "[', "[1}", "say {\"a\": 1}", "﻿{\"a\": 1}"]
    got = {r["i"]: (r["payload"], r["error"]) for r in J.salvage(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").collect()}
    one = ('{"a": 1}', None)
    assert [got[i] for i in range(len(texts))] == [
        one, ('\t\n{"a": 1}', None), ("[1]", None), *[J._salvage_one(t) for t in texts[3:]]]
