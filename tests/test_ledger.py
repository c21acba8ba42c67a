import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from claimloom import config
from claimloom.operators import ledger
from claimloom.plans import investigation

SCHEMA = ("doc_id int, seq int, id string, domain string, field string, value string, unit string, status string, model_stage string, source_locator string, "
          "evidence string, confidence double, stage string, dependencies array<string>, alternatives array<string>")


def claim(seq, **k):
    base = dict(doc_id=1, seq=seq, id=f"c{seq}", domain="theta", field="parameters.theta.CL", value="5", unit=None, status="reported", model_stage="final",
                source_locator="p1", evidence="table", confidence=0.9, stage="theta", dependencies=[], alternatives=[])
    base.update(k)
    return tuple(base[n.split()[0]] for n in SCHEMA.split(", "))


def test_namespaced_ids_and_dependencies(spark):
    c = spark.createDataFrame([claim(1, id="c1"), claim(2, id="theta::c2", field="x", dependencies=["c1", "other"]), claim(3, id=" ", field="y")], SCHEMA)
    named = ledger.add_claims(c)
    ids = {r["seq"]: r["claim_id"] for r in named.collect()}
    assert ids[1] == "theta::c1" and ids[2] == "theta::c2" and ids[3].startswith("theta_") and len(ids[3]) == 18
    deps = ledger.remap_dependencies(named).orderBy("dep_seq").collect()
    assert [r["dependency"] for r in deps] == ["theta::c1", "other"]


def gate(spark, claims, questions=(), contradictions=(), reviews=(), role="final"):
    c = spark.createDataFrame(claims, SCHEMA).withColumn("superseded_by", F.lit(None).cast("string"))
    q = spark.createDataFrame(list(questions), "doc_id int, priority string")
    x = spark.createDataFrame(list(contradictions), "doc_id int, severity string, resolved boolean")
    r = spark.createDataFrame(list(reviews), "doc_id int, seq int, overall_ready boolean")
    return ledger.consistency(c, spark.createDataFrame([(1, role)], "doc_id int, role string"), x, q, r).first()


def complete(n=0):
    return [claim(i + n, domain=d, field=d) for i, d in enumerate(list(config.LEDGER_DOMAINS)[:6])]


def test_consistency_gate(spark):
    assert gate(spark, complete())["ready"]
    bad = gate(spark, complete() + [claim(20, value="7"), claim(21, value="5", evidence=" ")] + [claim(22, value="5")])
    assert not bad["ready"] and bad["conflicts"] == 1 and bad["claims_without_evidence"] == 1
    assert gate(spark, complete(), questions=[(1, "critical")])["errors"] == ["urgent_questions"]
    assert gate(spark, complete(), contradictions=[(1, None, None)])["errors"] == ["major_contradictions"]
    assert gate(spark, complete(), contradictions=[(1, "minor", False)])["ready"]
    assert gate(spark, complete(), reviews=[(1, 1, True), (1, 2, False)])["errors"] == ["review_not_ready"]
    few = gate(spark, [claim(1)])
    assert not few["ready"] and few["errors"] == [] and few["coverage_fraction"] == 1 / 8


def test_population_text_may_differ(spark):
    rows = complete() + [claim(30, domain="population", field="population.age", value="a"), claim(31, domain="population", field="population.age", value="b")]
    assert gate(spark, rows)["conflicts"] == 0


def test_binding(spark):
    active = spark.createDataFrame([(1, "s::a", "structure"), (1, "t::b", "theta")], "doc_id int, claim_id string, domain string")
    need = spark.createDataFrame([(1, ["structure", "theta"])], "doc_id int, domains array<string>")
    ok = ledger.binding_checks(spark.createDataFrame([(1, 1, ["s::a", "t::b"])], "doc_id int, item_no int, claim_ids array<string>"), active, need).first()
    assert ok["ready"]
    bad = ledger.binding_checks(spark.createDataFrame([(1, 1, ["s::a", "zz"]), (1, 2, [])], "doc_id int, item_no int, claim_ids array<string>"), active, need).first()
    assert not bad["ready"] and bad["missing_domains"] == ["theta"] and bad["invalid_ids"] == 1 and bad["items_without_ids"] == 1


def brute_compact(head, claims, tail, max_chars):
    """The whole payload of claims that are sorted already."""
    k = len(claims)
    while True:
        text = f"{head}{','.join(claims[:k])}{tail}{len(claims) - k}}}"
        if len(text) <= max_chars or k <= 12:
            return text
        k = max(12, math.floor(k * 0.85))


def test_compact_ledger_against_brute_force(spark):
    rows = [claim(i, doc_id=i % 3 % 2, evidence="e" * (i % 300), confidence=(i * 37 % 101) / 100, domain=None if i % 5 == 0 else "theta") for i in range(900)] + [claim(1, doc_id=3, confidence=None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"claim_id": F.col("id"), "superseded_by": F.lit(None).cast("string")})
    ledgers = spark.createDataFrame([(d, ("1", "a \"b\" é"), d == 1, 0.25 * d) for d in range(4)], "doc_id int, source struct<pmid string, title string>, model_present boolean, model_probability double")
    questions = spark.createDataFrame([(1, n, f"why {n}", None) for n in range(40, 0, -1)], "doc_id int, seq int, question string, priority string")
    text = {(r["doc_id"], r["seq"]): (-(r["confidence"] or 0), r["seq"], r["j"]) for r in df.select("doc_id", "seq", "confidence", ledger.compact_claim_json().alias("j")).collect()}
    for budget in (9000, 100, 10**6):
        out = {r["doc_id"]: r for r in ledger.compact_ledger(df, ledgers, {"questions": questions}, budget).collect()}
        assert sorted(out) == [0, 1, 2, 3]
        for doc, row in out.items():
            mine = [t for _, _, t in sorted(v for (d, _), v in text.items() if d == doc)]
            asked = ",".join(f'{{"question":"why {n}","priority":null}}' for n in range(1, 41)) if doc == 1 else ""
            head = f'{{"source":{{"pmid":"1","title":"a \\"b\\" é"}},"model_present":{"true" if doc == 1 else "false"},"model_probability":{[0, 0.25, 0.5, 0.75][doc]},"model_inventory":[],"claims":['
            assert row["payload"] == brute_compact(head, mine, f'],"hypotheses":[],"questions":[{asked}],"contradictions":[],"referenced_sources":[],"omitted_claim_count":', budget)
            said = json.loads(row["payload"])
            assert len(said["claims"]) == row["kept"] and said["omitted_claim_count"] == row["omitted_claim_count"] == len(mine) - row["kept"]
    one = json.loads(text[0, 0][2])
    assert list(one) == ["id", "domain", "field", "value", "unit", "status", "model_stage", "superseded_by", "source_locator", "evidence", "confidence", "dependencies", "alternatives"]
    assert one["domain"] == "other" and one["unit"] is None and one["confidence"] == 0


VERDICTS = "doc_id int, seq int, claim_id string, verdict string, corrected_value string, source_locator string, evidence string, reason string"


def test_review_replaces_contradicted_claims(spark):
    c = spark.createDataFrame([claim(1, unit="L/h"), claim(2, field="y")], SCHEMA).withColumn("claim_id", F.col("id"))
    v = spark.createDataFrame([(1, 1, "c1", "contradicted", "6", "p2", "t", "r"), (1, 2, "c2", "contradicted", None, "p2", "t", None), (1, 3, "zz", "contradicted", "1", "", "", ""),
                               (1, 4, "c2", "supported", "9", "", "", "")], VERDICTS)
    out = ledger.apply_review(c, v, "falsification_1")
    assert {(r["claim_id"], r["resolved"]) for r in out["contradictions"].collect()} == {("c1", True), ("c2", False)}
    new = out["replacements"].collect()
    assert len(new) == 1 and new[0]["value"] == "6" and new[0]["dependencies"] == ["c1"] and new[0]["confidence"] == 0.9 and new[0]["status"] == "reported"
    assert new[0]["domain"] == "theta" and new[0]["unit"] == "L/h" and new[0]["stage"] == "falsification_1" and new[0]["claim_id"].startswith("falsification_1::c1_correction_")
    marked = {r["claim_id"]: r["superseded_by"] for r in out["claims"].collect()}
    assert len(marked) == 3 and marked["c1"].startswith("c1_correction_") and marked["c2"] is None


def sequential_review(claims, verdicts, stage):
    """The rule as a plain loop: claims are dicts in ledger order."""
    out = [dict(c) for c in claims]
    for v in verdicts:
        hit = next((c for c in out if c["claim_id"] == v["claim_id"]), None)
        if hit is None or v["verdict"] != "contradicted" or not (v["corrected_value"] or "").strip():
            continue
        new = dict(hit, value=v["corrected_value"], source_locator=v["source_locator"] or "", stage=stage)
        mark = f"{hit['claim_id']}_correction_{hashlib.sha256(v['corrected_value'].encode()).hexdigest()[:8]}"
        new["claim_id"] = f"{stage}::{mark}"
        hit["superseded_by"] = mark
        content = lambda c: (c["field"], c["value"], c["model_stage"], c["source_locator"])
        if not any(c["claim_id"] == new["claim_id"] or content(c) == content(new) for c in out):
            out.append(new)
    return sorted((c["claim_id"], c["value"], c["superseded_by"] or "") for c in out)


@pytest.mark.parametrize("seed", range(4))
def test_verdicts_are_applied_in_order(spark, seed):
    rng = random.Random(seed)
    rows = [claim(i, field=f"f{i % 2}", source_locator=f"p{i % 3}", value=rng.choice("56")) for i in range(6)]
    said = [(1, n, f"c{rng.randrange(7)}", rng.choice(["contradicted"] * 4 + ["supported"]), rng.choice(["zz", "aa", "5", " ", None]), rng.choice(["p1", "p2", None]), "t", "r") for n in range(14)]
    c = spark.createDataFrame(rows, SCHEMA).withColumn("claim_id", F.col("id"))
    out = ledger.apply_review(c, spark.createDataFrame(rng.sample(said, len(said)), VERDICTS), "s")["claims"].collect()
    first = [dict(zip([n.split()[0] for n in SCHEMA.split(", ")], r), claim_id=r[2], superseded_by=None) for r in rows]
    names = [n.split()[0] for n in VERDICTS.split(", ")]
    assert sorted((r["claim_id"], r["value"], r["superseded_by"] or "") for r in out) == sequential_review(first, [dict(zip(names, v)) for v in said], "s")


def test_questions_open_again_after_they_were_resolved(spark):
    asked = spark.createDataFrame([
        (1, 1, 1, "q", "a", "F", "x", "high"), (1, 1, 2, "r", "a", "f", "X", "low"), (1, 2, 1, "q", "b", "f", "x", "high"), (1, 4, 1, "q", "c", "f", "x", "low"), (1, 6, 1, "q", "d", "f", "x", "low"),
        (1, 1, 3, "other", "a", "g", "", "low"), (2, 1, 1, " ", "a", None, None, "critical")], "doc_id int, step int, seq int, id string, stage string, field string, question string, priority string")
    done = spark.createDataFrame([(1, 3, "a::q"), (1, 3, "b::q"), (1, 5, "a::q"), (1, 1, "a::none"), (2, 1, "x")], "doc_id int, step int, question_id string")
    got = {(r["doc_id"], r["question_id"]) for r in ledger.open_questions(asked, done).collect() if r["doc_id"] == 1}
    assert got == {(1, "c::q"), (1, "a::other")}
    assert ledger.open_questions(asked, done.filter("false")).count() == 3
    assert ledger.open_questions(asked.filter("false"), done).count() == 0


@pytest.mark.parametrize("one_pass", [10**6, 0, 30])
def test_claim_dedupe_is_the_sequential_rule(spark, one_pass):
    rng = random.Random(one_pass)
    rows = [(d, n, f"i{rng.randrange(12)}", f"c{rng.randrange(12)}") for d in range(4) for n in range(20 * d)]
    want = set()
    for d in range(4):
        ones, twos = set(), set()
        for _, n, x, y in (r for r in rows if r[0] == d):
            if x not in ones and y not in twos:
                ones.add(x), twos.add(y), want.add((d, n))
    frame = spark.createDataFrame(rng.sample(rows, len(rows)) + [rows[0]], "doc int, n int, x string, y string")
    got = ledger.first_wins_pairs(frame, ["doc"], "x", "y", "n", one_pass).collect()
    assert {(r["doc"], r["n"]) for r in got} == want and len(got) == len(want) + 1


def test_a_long_chain_is_decided_in_one_pass(spark):
    chain = spark.createDataFrame([(1, n, f"i{n // 2}", f"c{(n + 1) // 2}") for n in range(1000)], "doc int, n int, x string, y string")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    got = ledger.first_wins_pairs(chain, ["doc"], "x", "y", "n").collect()
    assert sorted(r["n"] for r in got) == list(range(0, 1000, 2))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 20


def test_only_open_documents_enter_another_round(spark):
    docs = spark.createDataFrame([(i, "the dose " * 900) for i in range(4)], "doc_id int, text string")
    none = spark.createDataFrame([], SCHEMA)
    asked = "doc_id int, seq int, id string, stage string, field string, question string, priority string, search_terms array<string>"
    contra, done = spark.createDataFrame([], "doc_id int, stage string, severity string, resolved boolean"), spark.createDataFrame([], "doc_id int, stage string, question_id string")
    seen = []

    def respond(stage, request):
        ids = sorted({r["doc_id"] for r in request.select("doc_id").collect()})
        seen.append((stage, ids))
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        if stage == "investigate":
            rows = [claim(i, doc_id=d, domain=x, field=x, stage="a") for d in range(4) for i, x in enumerate(list(config.LEDGER_DOMAINS)[:6])]
            return {"claims": frame(rows, SCHEMA), "questions": frame([(1, 1, "u", "a", "f", "why", "critical", ["dose"])], asked), "contradictions": contra, "resolved": done,
                    "inventory": frame([(0, "final")], "doc_id int, role string")}
        if stage.startswith("gap"):
            return {"claims": none, "questions": frame([], asked), "contradictions": contra, "resolved": frame([(1, stage, "a::u"), (3, stage, "a::u")], "doc_id int, stage string, question_id string")}
        if stage == "synthesis":
            return {"evidence": frame([(d, 1, ["a::c0"]) for d in range(4)], "doc_id int, item_no int, claim_ids array<string>"),
                    "required": frame([(d, ["theta"] if d == 0 else ["structure"]) for d in range(4)], "doc_id int, domains array<string>")}
        number = int(stage[-1])
        remark = [(2, 1, "s", stage, "g", "where", "low", ["dose"])] if number < 3 else []
        return {"verdicts": frame([], VERDICTS), "reviews": frame([(d, d != 2 or number == 3) for d in ids], "doc_id int, overall_ready boolean"),
                "questions": frame(remark + [(0, 1, "s", stage, "g", "where", "low", ["dose"])], asked), "resolved": frame([], "doc_id int, question_id string")}

    out = investigation.investigate(docs, "text", respond, rounds=3, topics={"a": ["dose"]}, limit=1)
    assert seen == [("investigate", [0, 1, 2, 3]), ("falsification_1", [0, 1, 2, 3]), ("gap_search_1", [1, 2]), ("falsification_2", [1, 2]),
                    ("gap_search_2", [2]), ("falsification_3", [2]), ("synthesis", [0, 1, 2, 3])]
    assert {r["doc_id"]: r["outcome"] for r in out["outcome"].collect()} == {0: "binding_blocked", 1: "complete", 2: "complete", 3: "complete"}
    assert {(r["doc_id"], r["question_id"]) for r in out["questions"].collect()} == {(0, "falsification_1::s"), (2, "falsification_1::s")}


def test_cached_stages_are_reused(spark):
    req = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3")], "doc_id int, fingerprint string")
    cache = spark.createDataFrame([("f1", True, "{}"), ("f2", False, "{}")], "fingerprint string, valid boolean, result string")
    reused, missing = ledger.split_cached(req, cache)
    assert [r["doc_id"] for r in reused.collect()] == [1] and sorted(r["doc_id"] for r in missing.collect()) == [2, 3]


def test_gap_search_scores_every_term_list(spark):
    from claimloom.plans import investigation

    docs = spark.createDataFrame([(1, "alpha beta " * 60 + "x" * 900 + " gamma gamma omega "), (2, "nothing")], "doc_id int, text string")
    terms = spark.createDataFrame([(1, t) for t in ["gamma", "Omega", "zeta", "none", "at all"]], "doc_id int, term string")
    one = investigation.gap_requests(docs, "text", terms, 1).collect()
    split = investigation.gap_requests(docs, "text", terms, 1, batch=1).collect()
    assert one == split and one[0]["score"] == 3.25 and "omega" in one[0]["chunk_text"]


def test_topic_requests_use_one_pass(spark):
    from claimloom.plans import investigation

    docs = spark.createDataFrame([(1, "the clearance and the dose " * 300)], "doc_id int, text string")
    rows = investigation.topic_requests(docs, "text", {"a": ["clearance"], "b": ["dose", "zzz"]}, 1).collect()
    assert {r["topic"] for r in rows} == {"a", "b"} and all(r["score"] > 100 for r in rows)
