import json

import pytest
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions import jsontools as J
from claimloom.operators import jsondiff


def flat(value, pointer="", label=""):
    """Plain recursion, as the yardstick."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flat(v, pointer + "/" + k.replace("~", "~0").replace("/", "~1"), f"{label}.{k}" if label else k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from flat(v, f"{pointer}/{i}", f"{label}[{i + 1}]")
    elif pointer or not isinstance(value, (dict, list)):
        yield pointer, label or "(root)", value


@pytest.mark.parametrize("doc", [
    {"a": {"b": [1, 2.5, {"c": None}], "d": {}}, "e/f~": "x", "g": []}, [], {}, 7, "text", [[1], [[]]],
])
def test_leaves_match_recursion(spark, doc):
    df = spark.createDataFrame([(json.dumps(doc),)], ["j"]).select(F.inline(J.leaves(F.parse_json("j"), 6)))
    got = {(r["pointer"], r["label"], r["v"]) for r in df.select("pointer", "label", F.to_json("node").alias("v")).collect()}
    assert got == {(p, lab, json.dumps(v, separators=(",", ":"))) for p, lab, v in flat(doc)}


def test_too_deep_is_an_error(spark):
    df = spark.createDataFrame([('{"a":{"b":{"c":{"d":1}}}}',)], ["j"])
    with pytest.raises(Exception, match="nested deeper"):
        df.select(F.inline(J.leaves(F.parse_json("j"), 2))).collect()


def nested(depth):
    doc = {"leaf": [1, {"x~/y": 'quote " and } back\\slash'}], "empty": {}}
    for k in range(depth):
        doc = [doc, k] if k % 2 else {"in": doc, "k": k}
    return doc


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_leaves_at_any_depth(spark, levels):
    docs = [nested(d) for d in (0, 1, 3, 7, 12, 60)] + [{"t": "[[[[[[[[[[[["}, [], 5]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string")
    rows = J.with_leaves(df, "j", levels=levels).select("i", F.inline("leaves")).select("i", "pointer", "label", F.to_json("node").alias("v")).collect()
    for i, doc in enumerate(docs):
        got = {(r["pointer"], r["label"], json.dumps(json.loads(r["v"]))) for r in rows if r["i"] == i}
        assert got == {(p, lab, json.dumps(v)) for p, lab, v in flat(doc)}


def test_repair_refuses_what_is_no_json(spark):
    df = spark.createDataFrame([('{"a": NaN,}',), ("{'a': Infinity}",), ('```json {"a": 1,}```',), ('{"a": -Infinity, "b": [1,]}',)], ["t"])
    got = {r["t"]: (r["payload"], r["error"]) for r in J.salvage(df, "t").collect()}
    assert got['```json {"a": 1,}```'] == ('{"a": 1}', None)
    assert all(p is None and e for t, (p, e) in got.items() if not t.startswith("```"))


def test_pointer_set(spark):
    rows = [('{"a":[1,2]}', "/a/1", "9"), ('{"a":1}', "/b/c", '"x"'), ('{"a":[]}', "/a/2", "true"), ("{}", "", "5")]
    df = spark.createDataFrame(rows, ["d", "p", "v"]).select(J.pointer_set(F.col("d"), F.col("p"), F.col("v")).alias("x"))
    assert [json.loads(r["x"]) for r in df.collect()] == [{"a": [1, 9]}, {"a": 1, "b": {"c": "x"}}, {"a": [None, None, True]}, 5]


@pytest.mark.parametrize("text, payload, error", [
    ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}, None), ('Sure: {"a": 1} and {"b": 2}', {"a": 1}, None),
    ('{"a": {"b": [1', {"a": {"b": [1]}}, None), ('{"a": "cut', None, "truncated"), ('{"a":', None, "truncated"),
    ("", None, "empty"), ("no json", None, "no JSON"), ('{"a": ]}', None, "mismatched"), ('{"a": "}"} x', {"a": "}"}, None), ('{"a":1} tail', {"a": 1}, None),
])
def test_salvage(spark, text, payload, error):
    row = J.salvage(spark.createDataFrame([(text,)], ["t"]), "t").first()
    assert (json.loads(row["payload"]) if row["payload"] else None) == payload
    assert (row["error"] is None) == (error is None) and (error is None or error in row["error"])


def test_every_contract_builds_and_checks(spark):
    df = spark.createDataFrame([("{}",)], ["j"])
    for kind in ("triage", "assessment", "investigation", "falsification", "claim", "question", "reconnaissance"):
        error = df.select(J.conformance_error(F.parse_json("j"), schemas.CONTRACTS[kind]).alias("e")).first()["e"]
        assert "missing required field" in error
    assert {r["kind"] for r in schemas.rule_table(spark).select("kind").distinct().collect()} == set(schemas.CONTRACTS)


def test_conformance_paths(spark):
    good = {"id": "q", "field": "f", "question": "?", "priority": "low", "search_terms": ["a"]}
    cases = [(good, None), ({**good, "priority": "x"}, "response.priority"), ({**good, "search_terms": ["a", 2]}, "response.search_terms[2]"), ({**good, "more": 1}, "unexpected field more")]
    for doc, part in cases:
        e = spark.createDataFrame([(json.dumps(doc),)], ["j"]).select(J.conformance_error(F.parse_json("j"), schemas.CONTRACTS["question"]).alias("e")).first()["e"]
        assert (e is None) if part is None else part in e


def test_diff_statuses(spark):
    ref = spark.createDataFrame([(1, '{"parameters":{"theta":[{"typical":5}]},"compound":"CBZ","n":1}'), (2, '{"a":1}')], ["id", "j"])
    pred = spark.createDataFrame([(1, '{"parameters":{"theta":[{"typical":7.5}]},"compound":"carbamazepine","extra":[]}')], ["id", "j"])
    rows = {(r["id"], r["pointer"]): r for r in jsondiff.compare_documents(ref, pred, ["id"], "j", "j").collect()}
    assert rows[1, "/parameters/theta/0/typical"]["status"] == "Different" and rows[1, "/parameters/theta/0/typical"]["delta_percent"] == 50.0
    assert rows[1, "/compound"]["status"] == "Match" and rows[1, "/n"]["status"] == "reference only"
    assert rows[1, "/extra"]["status"] == "prediction only" and rows[2, "/a"]["status"] == "reference only"


def test_merge_objects(spark):
    base, update = '{"a":{"x":1,"y":[1]},"b":2}', '{"a":{"y":[2],"z":3},"c":null}'
    df = spark.createDataFrame([(base, update)], ["b", "u"])
    merged = df.select(J.merge_objects("b", "u").alias("m")).first()["m"]
    assert json.loads(merged) == {"a": {"x": 1, "y": [2], "z": 3}, "b": 2, "c": None}
    deep = spark.createDataFrame([('{"a":{"b":{"c":{"d":{"keep":1,"e":2}}}}}', '{"a":{"b":{"c":{"d":{"e":3}}}}}'), (None, "{}"), ('{"x":1}', None)], ["b", "u"])
    got = [r["m"] for r in deep.select(J.merge_objects("b", "u").alias("m")).collect()]
    assert json.loads(got[0]) == {"a": {"b": {"c": {"d": {"keep": 1, "e": 3}}}}} and got[1:] == ["{}", '{"x":1}']


def test_probabilities_at_any_depth(spark):
    docs = ['{"a":{"confidence":{"overall":83,"by":["79%",1]}},"n":83}', '{"model_probability":101}', '{"coverage":0.5}', '{"x_confidence":"high","probability_note":90}']
    df = J.normalise_probabilities(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, j string"), "j")
    got = {r["i"]: (r["j"], r["error"]) for r in df.collect()}
    assert json.loads(got[0][0]) == {"a": {"confidence": {"overall": 0.83, "by": [0.79, 1]}}, "n": 83} and got[0][1] is None
    assert "model_probability" in got[1][1] and got[2] == (docs[2], None) and got[3] == (docs[3], None)
