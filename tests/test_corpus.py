import hashlib
import json

import pytest
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as X
from claimloom.operators import catalogue, claims, corpus, keyed, scoring, training, triage
from claimloom.plans import jobs, lanes, semantics
from claimloom.session import scratch_path
from claimloom.sources import readers, writers

MODEL = "reference_id string, article_id string, pmid string, partition string, tier string, training_eligible boolean, document string"
DOC = json.dumps({k: 1 for k in config.MODEL_REQUIRED})


def validate(spark, rows, **k):
    m = spark.createDataFrame(rows, MODEL)
    a = spark.createDataFrame([("a1",)], "article_id string")
    return {(r["severity"], r["rule"]) for r in corpus.validate(m, a, k.get("version", "1.1.0"), k.get("parts", config.PARTITIONS)).collect()}


def test_validation_rules(spark):
    assert validate(spark, [("r1", "a1", "1", "train", "C", False, DOC)]) == set()
    assert validate(spark, [("r1", "a1", "1", "test", "C", True, DOC)]) == {("error", "test_is_trainable")}
    assert ("error", "pmid_crosses_partitions") in validate(spark, [("r1", "a1", "1", "test", "A", False, DOC), ("r2", "a1", "1", "train", "A", False, DOC)])
    assert ("error", "duplicate_id") in validate(spark, [("r1", "a1", "1", "train", "A", False, DOC)] * 2)
    assert ("error", "unsupported_schema") in validate(spark, [("r1", "a1", "1", "train", "A", False, DOC)], version="9")
    with pytest.raises(ValueError, match="invalid"):
        m = spark.createDataFrame([("r1", "zz", "1", "x", "Q", False, "{}")], MODEL)
        corpus.require_valid(corpus.validate(m, spark.createDataFrame([("a1",)], "article_id string"), "1.1.0", config.PARTITIONS))


def test_curation_and_corrections(spark):
    m = spark.createDataFrame([("r1", "train", "C", "unreviewed", False, False, "", '{"theta":[{"v":5}]}'), ("r2", "test", "C", "unreviewed", False, False, "", "{}")],
                              "reference_id string, partition string, tier string, review_status string, strict_score_eligible boolean, training_eligible boolean, audit string, target string")
    d = spark.createDataFrame([("r1", "a", True, "", "ok"), ("r2", "B", True, "", "")], "reference_id string, tier string, training_eligible boolean, review_status string, notes string")
    c = spark.createDataFrame([("r1", 1, "/theta/0/v", "custom", "7.5"), ("r1", 2, "/note", "custom", '"n"')], "reference_id string, seq int, pointer string, source string, value_json string")
    assert {(r["reference_id"], r["error"]) for r in corpus.curation_errors(m, d, c).collect()} == {("r2", "test_model_not_trainable")}
    new = {r["reference_id"]: r for r in corpus.apply_corrections(corpus.apply_decisions(m, d, "kim"), c, "target").collect()}
    assert json.loads(new["r1"]["target"]) == {"theta": [{"v": 7.5}], "note": "n"} and new["r1"]["training_eligible"] and new["r1"]["strict_score_eligible"]
    assert not new["r2"]["training_eligible"] and new["r2"]["tier"] == "B" and json.loads(m.first()["target"]) == {"theta": [{"v": 5}]}
    with pytest.raises(ValueError):
        corpus.check_corrections(c.drop("pointer"))


def test_export_guards(spark):
    with pytest.raises(ValueError, match="locked"):
        training.check_request(["train", "test"], ["A"])
    with pytest.raises(ValueError, match="unknown"):
        training.check_request(["dev"], ["A"])
    with pytest.raises(ValueError, match="silver"):
        training.check_request(["train"], ["C"])
    s = spark.createDataFrame([("s1", "1", "train", True, True, None, "q"), ("s2", "2", "test", True, True, None, "q"), ("s3", "3", "train", False, False, "wrong_aed", "q"), ("s4", "4", "train", False, False, "no_model", "q")],
                              "screening_id string, pmid string, partition string, relevant boolean, recoverable boolean, exclusion_reason string, label_quality string")
    a = spark.createDataFrame([("1", "t", "abs"), ("4", "t", "abs")], "pmid string, title string, abstract string")
    got = {r["reference_id"]: r for r in jobs.triage_export(s, a, ["train"], "sys").collect()}
    assert set(got) == {"s1", "s3", "s4"} and got["s3"]["reason"] == "ambiguous_or_query_specific_label"
    answer = json.loads(got["s4"]["example"]["messages"][2]["content"])
    assert answer["relevant_probability"] == 0 and "no_model" in answer["rationale"]


def test_build_is_repeatable_and_never_overwrites(spark):
    models = spark.createDataFrame([("CBZ", 1, ["Key"]), ("CBZ", 2, ["Heimann 1977 590316", "oral 5 mg", "one-compartment", "CL=theta1", "theta1=5", "v"]), ("CBZ", 3, ["Heimann 1977 590316", "", "", "", "", ""])], "doc string, row_no int, cells array<string>")
    studies = spark.createDataFrame([("CBZ", 1, ["Key"]), ("CBZ", 2, ["Heimann 1977 590316", "N = 12", "popPK", "", "Tested: age Included: WT", ""])], "doc string, row_no int, cells array<string>")
    meta = spark.createDataFrame([("590316", "T", "A")], "pmid string, title string, abstract string")
    files = spark.createDataFrame([("d/exclude/590316.pdf", "h1", 0), ("d/Supplements/CBZ/long_590316.pdf", "h2", 1)], "path string, sha256 string, ordinal int")
    a, b = (jobs.build_corpus(models, studies, meta, files, "ref") for _ in range(2))
    rows = a["models"].orderBy("model_index").collect()
    assert [r["reference_id"] for r in rows] == ["ref_cbz_590316_m01", "ref_cbz_590316_m02"] and [r["tier"] for r in rows] == ["C", "D"]
    assert rows[0]["pdf_path"].startswith("d/Supplements") and rows[0]["n_subjects"] == 12 and rows[0]["parameters"]["theta"][0]["typical"] == 5
    assert sorted(map(str, a["models"].collect())) == sorted(map(str, b["models"].collect()))
    assert a["articles"].count() == 1 and {r["relevant_model"] for r in a["screening"].collect()} == {True, False}
    path = jobs.write_corpus({"models": a["models"]}, scratch_path(spark, "t"))
    with pytest.raises(Exception, match="already exists"):
        jobs.write_corpus({"models": a["models"]}, path)


def test_gate(spark):
    cols = "tier_group string, n bigint, scored bigint, " + ", ".join(f"{m} double" for m in scoring.METRICS)
    good = spark.createDataFrame([("strict", 20, 20, 0.9, 0.85, 0.9, 0.9, 0.85, 0.85)], cols)
    assert scoring.gate_verdict(scoring.release_gate(good)).first()["passed"]
    silver = spark.createDataFrame([("silver", 20, 20, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], cols)
    assert not scoring.gate_verdict(scoring.release_gate(silver)).first()["passed"]
    gap = spark.createDataFrame([("strict", 20, 19, 0.9, 0.85, 0.9, None, 0.85, 0.85)], cols)
    v = scoring.gate_verdict(scoring.release_gate(gap)).first()
    assert not v["passed"] and v["unmet"] == "complete_strict_predictions, numeric_accuracy"


def extraction(spark, typical, present=True):
    theta = f"array(named_struct('name','CL','typical',double({typical})))"
    df = spark.sql(f"select 1 as id, 'oral' as route, 'one-compartment' as description, 'cbz' as compound, named_struct('theta',{theta},'omega',cast(null as {semantics.OMEGA}),'omega_covariance',cast(null as {semantics.COVARIANCE}),'sigma',cast(null as {semantics.SIGMA})) as parameters")
    return semantics.as_struct(semantics.enrich(df)).select("id", F.col("extraction"), F.lit(present).alias("present"))


def test_lane_pair(spark):
    a, b = extraction(spark, 5), extraction(spark, 8)
    both = a.select("id", F.col("extraction").alias("t"), "present").join(b.select("id", F.col("extraction").alias("v")), "id")
    diff = lanes.compare_records(both, ["id"], F.col("t"), F.col("v"), F.col("present"), F.col("present")).filter("NOT is_equal").collect()
    assert [(r["field"], r["impact"]) for r in diff] == [("theta.CL", "major")]
    scores = claims.with_rates(claims.pair_scores(
        claims.parameter_rows(a.select("id", F.col("extraction.parameters").alias("p")), ["id"], F.col("p")).withColumnRenamed("value", "value_t"),
        claims.parameter_rows(a.select("id", F.col("extraction.parameters").alias("p")), ["id"], F.col("p")).withColumnRenamed("value", "value_p"),
        ["id"], ["type", "item_key"], F.col("value_t") == F.col("value_p"))).first()
    assert scores["coverage"] == 1 and scores["accuracy"] == 1


def test_classification_never_yields_skipped(spark):
    a = spark.createDataFrame([("1", "", "", "x", "low"), ("2", "", "", "x", "high"), ("3", "10.1/z", "", "", "high"), ("4", "10.1/y", "", "", "intermediate")], "pmid string, doi string, pmcid string, abstract string, tier string")
    u = spark.createDataFrame([("10.1/y", "http://pdf", False)], "doi string, url_for_pdf string, is_oa boolean")
    e = spark.createDataFrame([("4", "PMC9", "", True)], "pmid string, pmcid string, pdf_url string, is_open_access boolean")
    p = spark.createDataFrame([], "pmcid string, pdf_url string, is_oa boolean")
    got = {r["pmid"]: (r["acquisition_class"], r["strategy"]) for r in triage.classify(a, u, e, p).collect()}
    assert got == {"1": ("deferred_low", ""), "2": ("stub", "abstract_only"), "3": ("needs_institutional", "doi_follow"), "4": ("oa_auto", "oa_pdf")}


def test_supersession_after_version_filter(spark):
    q = spark.createDataFrame([("m", "q1", "qualified", "", "1.0.0", ""), ("m", "q2", "suspended", "q1", "1.0.0", ""), ("m", "q3", "retired", "q2", "0.9.0", "")],
                              "library_id string, qualification_id string, status string, supersedes string, model_version string, review_due string")
    v = spark.createDataFrame([("m", "1.0.0")], "library_id string, version string")
    now = F.lit("2026-01-01").cast("timestamp")
    s = catalogue.clinical_status(catalogue.current_records(catalogue.version_bound(q, v)), now).first()
    assert s["clinical_status"] == "suspended" and not s["clinically_qualified"]


def test_catalogue_upgrade(spark):
    p = spark.createDataFrame([("e", "1.0.1", "new"), ("f", "0.9.0", "old"), ("g", "1.0.0", "first")], "library_id string, version string, title string")
    a = spark.createDataFrame([("e", "1.0.0", "mine"), ("f", "1.0.0", "mine"), ("h", "1.0.0", "local")], "library_id string, version string, title string")
    got = {r["library_id"]: (r["action"], r["version"], r["archived_version"]) for r in catalogue.merge_packaged(p, a, ["title"]).collect()}
    assert got == {"e": ("upgrade", "1.0.1", "1.0.0"), "f": ("keep", "1.0.0", None), "g": ("insert", "1.0.0", None), "h": ("keep", "1.0.0", None)}


def test_search_words_are_ored(spark):
    e = spark.createDataFrame([("a", "Alpha model", "x", "y", ["k"], ""), ("b", "Beta", "x", "y", ["k"], "gamma"), ("c", "Delta", "x", "y", ["k"], "")], "library_id string, title string, compound string, population string, keywords array<string>, abstract string")
    assert sorted(r["library_id"] for r in catalogue.search(e, "ALPHA gamma").collect()) == ["a", "b"]
    assert catalogue.search(e, compound="^X$").count() == 3


def test_encodings(spark):
    rows = [(1, "Röshammar".encode()), (2, "Röshammar".encode("cp1252")), (3, b"\xef\xbb\xbfa\x00b"), (4, b"")]
    df = spark.createDataFrame(rows, "id int, content binary").select("id", readers.decode_text(F.col("content")).alias("t"))
    assert [r["t"] for r in df.orderBy("id").collect()] == ["Röshammar", "Röshammar", "ab", ""]


def test_manual_inbox(spark):
    req = spark.createDataFrame([("1", "a.pdf"), ("2", "b.pdf"), ("3", "c.pdf")], "pmid string, destination string")
    files = spark.createDataFrame([("a.pdf", b"%PDF-" + b"x" * 2000, 2005), ("b.pdf", b"%PDF-", 5)], "path string, content binary, length long")
    assert {r["pmid"]: r["status"] for r in readers.inbox_state(req, files).collect()} == {"1": "complete", "2": "pending", "3": "pending"}


def test_files_round_trip(spark):
    path = scratch_path(spark, "pred")
    spark.createDataFrame([("r1", 1), ("r2", 2)], "reference_id string, v int").write.json(path)
    assert readers.prediction_files(spark, path).count() == 2
    out = writers.csv(spark.createDataFrame([("0012", None, 'say "x",\ny')], "pmid string, a string, b string"), scratch_path(spark, "csv"))
    assert tuple(readers.manifest_csv(spark, out, "pmid string, a string, b string").first()) == ("0012", None, 'say "x",\ny')
    text = scratch_path(spark, "json")
    spark.createDataFrame([('{"library_id": "e1", "model": {"advan": 2}}',), ("{broken",)], "value string").write.text(text)
    rows = readers.catalogue_manifests(spark, text).select("library_id", "_corrupt_record").collect()
    assert {(r[0], r[1]) for r in rows} == {("e1", None), (None, "{broken")}


def test_enrichment_is_idempotent_and_keeps_structured_values(spark):
    df = spark.sql("select 1 as id, 'Young N = 4 Age: 30' as population, '5 mg q 8 h' as dose, 'oral' as route, 'two compartment' as description")
    once = semantics.enrich(df)
    twice = semantics.enrich(once)
    assert once.select(*semantics.EXTRACTION_COLUMNS).first() == twice.select(*semantics.EXTRACTION_COLUMNS).first()
    changed = semantics.enrich(once.withColumn("population", F.lit("N = 99")))
    assert changed.first()["population_details"]["n_total"] == 4 and changed.first()["advan"] == 4


def test_plan_and_events(spark):
    from claimloom.operators import reproduction

    df = spark.sql("select 1 as id, 'N: 12 WT: 70 kg' as population, '2 mg/kg every 12 h' as dose, 'oral' as route, 'one-compartment' as description")
    plan = semantics.reproduction_plan(semantics.map_models(semantics.enrich(df)), allow_defaults=True)
    row = plan.first()
    assert row["eligible"] and row["amount_mg"] == 140 and row["plan_subjects"] == 12 and not row["scorable"] and row["covariate_values"] == {"WT": 70.0}
    blocked = semantics.reproduction_plan(semantics.map_models(semantics.enrich(df))).first()
    assert blocked["blockers"] == ["generated_parameter_defaults_present"]
    ev = plan.select("id", "advan", "amount_mg", F.lit(False).alias("steady_state"), F.lit("bolus").alias("administration"), F.lit(2).alias("repetitions"), F.lit(12.0).alias("interval_hours"), F.lit(None).cast("double").alias("duration_hours"), "times")
    rows = reproduction.event_rows(ev, ["id"], F.lit(3)).collect()
    assert len(rows) == 3 * (2 + 49) and {r["TIME"] for r in rows if r["EVID"] == 1} == {0.0, 12.0} and {r["CMT"] for r in rows if r["EVID"] == 0} == {2}


def test_missing_subject_count_plans_a_hundred(spark):
    from claimloom.operators import reproduction

    rows = spark.createDataFrame([(None,), (500.0,), (7.0,)], "n double").select(reproduction.plan_subjects(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in rows] == [100, 100, 7]


def test_many_corrections_need_several_rounds(spark):
    m = spark.createDataFrame([("r1", "{}"), ("r2", "{}")], "reference_id string, target string")
    c = spark.createDataFrame([("r1", i + 1, f"/k{i % 3}", str(i)) for i in range(25)], "reference_id string, seq int, pointer string, value_json string")
    got = {r["reference_id"]: json.loads(r["target"]) for r in corpus.apply_corrections(m, c, "target", batch=10).collect()}
    assert got == {"r1": {"k0": 24, "k1": 22, "k2": 23}, "r2": {}}


def test_every_byte_is_read_as_windows_1252_without_a_session_switch(spark):
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"
    rows = [(b, bytes([0xFF, b, 0x41])) for b in range(1, 256)]
    got = {r["id"]: r["t"] for r in spark.createDataFrame(rows, "id int, content binary").select("id", readers.decode_text(F.col("content")).alias("t")).collect()}
    assert got == {b: bytes([0xFF, b, 0x41]).decode("cp1252", "replace") for b in range(1, 256)}
    texts = [(1, "€ “é” ÿ abc"), (2, "漢"), (3, "\x81"), (4, ""), (5, None)]
    back = spark.createDataFrame(texts, "id int, t string").select("id", readers.encode_windows(F.col("t")).alias("b")).collect()
    assert {r["id"]: r["b"] and bytes(r["b"]) for r in back} == {1: "€ “é” ÿ abc".encode("cp1252"), 2: None, 3: None, 4: bytearray(), 5: None}


def test_listing_and_filter_of_models(spark):
    rows = [("r1", "a1", "1", "Midazolam", "train", "A", True, "One"), ("r2", "a2", "2", "other", "test", "B", None, "Two midaZOLAM"), ("r3", "a3", None, None, None, None, False, None)]
    models = spark.createDataFrame(rows, "reference_id string, article_id string, pmid string, compound_group string, partition string, tier string, training_eligible boolean, title string")
    assert [(r["reference_id"], r["compound"], r["training_eligible"]) for r in corpus.list_models(models).orderBy("reference_id").collect()] == [
        ("r1", "Midazolam", True), ("r2", "other", False), ("r3", None, False)]
    ids = lambda **choice: {r["reference_id"] for r in corpus.filter_models(models, **choice).collect()}
    assert ids(words="midazolam") == {"r1", "r2"} and ids(words="midazolam", compound="other") == {"r2"}
    assert ids(partitions=["train"], tiers=["A", "B"]) == {"r1"} and ids(tiers=[]) == ids() == {"r1", "r2", "r3"}
    assert corpus.list_models(models.limit(0), ["train"]).count() == 0


def test_provenance_orphans_and_fingerprints(spark):
    entries = spark.createDataFrame([("e1", 1), ("e2", 1)], "library_id string, version int")
    audits = spark.createDataFrame([("e1", "b", None), ("e1", "a", 2), ("e9", "z", 1), (None, "n", 1)], "library_id string, url string, version int")
    got = {r["library_id"]: (r["version"], r["audit"], r["ledger"]) for r in catalogue.provenance(entries, {"audit": audits, "ledger": audits.limit(0)}).collect()}
    assert got == {"e1": (1, ("a", 2), None), "e2": (1, None, None)}
    assert {r[0] for r in keyed.orphans(audits, "library_id", entries.selectExpr("library_id AS id"), "id").collect()} == {"e9", None}
    row = spark.createDataFrame([(None, "é")], "a string, b string").select(X.sha256_of("a"), X.md5_of("a"), X.sha256_of("b"), X.md5_of("b")).first()
    assert tuple(row) == ("", hashlib.md5(b"").hexdigest(), hashlib.sha256("é".encode()).hexdigest(), hashlib.md5("é".encode()).hexdigest())
