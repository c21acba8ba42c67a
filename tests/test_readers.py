import json

from claimloom.functions import jsontools as J
from claimloom.functions import text as X
from claimloom.operators import corpus, keyed, triage
from claimloom.plans import plugins
from claimloom.sources import readers
from pyspark.sql import functions as F


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_a_file_is_one_manifest_or_envelope(spark, tmp_path):
    write(tmp_path, "m/first/manifest.json", json.dumps({"library_id": "first", "title": "T", "version": "1.0.0"}, indent=2))
    write(tmp_path, "m/broken/manifest.json", "{\n not json")
    write(tmp_path, "m/first/other.json", "{}")
    got = {r["folder"]: r for r in readers.catalogue_manifest_files(spark, str(tmp_path / "m")).select("folder", "library_id", "_corrupt_record").collect()}
    assert set(got) == {"first", "broken"} and got["first"]["library_id"] == "first"
    assert got["first"]["_corrupt_record"] is None and got["broken"]["_corrupt_record"] is not None
    write(tmp_path, "p/a/ref_1.json", json.dumps({"prediction": {"x": 1}}, indent=2))
    write(tmp_path, "p/b/other.json", json.dumps({"reference_id": " ref_2 ", "prediction": None}, indent=2))
    write(tmp_path, "p/b/summary.json", "{}")
    rows = readers.prediction_files(spark, str(tmp_path / "p")).collect()
    assert sorted(r["id"] for r in rows) == ["ref_1", "ref_2"] and all(json.loads(r["json"]) for r in rows)
    write(tmp_path, "c/kind=models/partition=train/a.json", json.dumps({"reference_id": "r"}, indent=2))
    assert [json.loads(r["value"]) for r in readers.corpus_records(spark, str(tmp_path / "c"), "models", one_per_file=True).collect()] == [{"reference_id": "r"}]


def test_every_csv_file_has_its_own_header(spark, tmp_path):
    write(tmp_path, "pubmed_result1.csv", 'PMID,Title,Abstract\n123456,"One, two",first\n12,short,no\n')
    write(tmp_path, "sub/PubMed_Result2.CSV", 'AbstractText,pmid,Title\n"second\nline",id 234567,Two\nagain,123456,late\n')
    write(tmp_path, "pubmed_result3.csv", "PMID,Title,Abstract\n345678,Three,third\n")
    write(tmp_path, "else.csv", "x\n1\n")
    got = {r["pmid"]: (r["title"], r["abstract"]) for r in readers.literature_csv(spark, str(tmp_path)).collect()}
    assert got["234567"] == ("Two", "second line") and got["345678"] == ("Three", "third") and set(got) == {"123456", "234567", "345678"}


def test_inline_markup_is_text(spark, tmp_path):
    write(tmp_path, "a.xml", "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>Use of <i>x</i> &amp; <b>y</b></ArticleTitle><Abstract><AbstractText>10<sup>3</sup> a</AbstractText><AbstractText>p &lt; 1</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>")
    row = readers.article_xml(spark, str(tmp_path)).select("title", "abstract").first()
    assert row["title"] == "Use of x & y" and row["abstract"] == "103 a p < 1"


def test_white_space_of_any_kind_is_blank(spark):
    df = spark.createDataFrame([("\t\n",), ("\nfoo ",), (None,), ("a b",)], "t string")
    got = [(r["p"], r["s"], r["c"]) for r in df.select(X.present("t").alias("p"), X.strip("t").alias("s"), X.character_set(F.array("t")).alias("c")).collect()]
    assert got == [(False, "", []), (True, "foo", ["foo"]), (False, None, []), (True, "a b", ["a b"])]


def test_look_ups_give_one_row(spark):
    ids = spark.createDataFrame([("1",), ("1",), ("2",)], "pmid string")
    meta = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", None)], "pmid string, title string")
    tiers = spark.createDataFrame([("1", "high", 0.9), ("1", "low", 0.1)], "pmid string, tier string, probability double")
    inbox = spark.createDataFrame([("2", "/b"), ("2", "/a")], "pmid string, local_path string")
    got = [(r["pmid"], r["title"], r["tier"], r["local_path"]) for r in triage.discover(ids, meta, tiers, inbox).orderBy("pmid").collect()]
    assert got == [("1", "a", "high", ""), ("2", None, "low", "/a")]
    assert keyed.one_per_key(meta, ["pmid"]).count() == 2
    models = spark.createDataFrame([("r", "C", "new", False, False, "train")], "reference_id string, tier string, review_status string, strict_score_eligible boolean, training_eligible boolean, partition string")
    decided = spark.createDataFrame([("r", 1, "B", True, "", ""), ("r", 2, " a\t", True, "", "")], "reference_id string, seq int, tier string, training_eligible boolean, review_status string, notes string")
    assert [r["tier"] for r in corpus.apply_decisions(models, decided, "c").collect()] == ["A"]


def test_a_request_may_hold_many_messages(spark):
    rows = spark.range(600).selectExpr("1 AS request", "id AS seq", "CASE WHEN id = 3 THEN NULL ELSE concat('m', id) END AS content")
    text = plugins.message_text(rows, ["request"], "seq").first()["text"]
    assert text.split("\n\n") == [f"m{k}" if k != 3 else "[image]" for k in range(600)]


def test_strict_parse_is_what_counts(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("NaN",)], "t string")
    assert [r["k"] for r in df.select(J.kind_of(J.strict_parse("t")).alias("k")).collect()] == ["object", None]
