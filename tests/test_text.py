import pytest
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import numbers as N
from claimloom.functions import parsing as P
from claimloom.functions import text as X


def test_doi_and_pmc(one):
    assert one(lambda: X.strip_doi_url(F.lit(" https://doi.org/10.1/x "))) == "10.1/x"
    assert one(lambda: X.strip_doi_url(F.lit("HTTP://DX.DOI.ORG/10.1/x"))) == "10.1/x"
    assert one(lambda: X.strip_pmc(F.lit("pmc123"))) == "123"
    assert one(lambda: X.pmc_pdf_url(F.lit(""))) == ""
    assert one(lambda: X.pmc_pdf_url(F.lit("PMC7"))).endswith("/PMC7/pdf/")


def test_citation_key(one):
    key = one(lambda: X.citation_key(F.lit("Heimann 1977 590316")))
    assert (key["pmid"], key["year"], key["first_author"]) == ("590316", "1977", "Heimann")
    assert one(lambda: X.citation_key(F.lit("no number 1234 here"))) is None
    last = one(lambda: X.citation_key(F.lit("A 1950 B 2001 12345 99999")))
    assert (last["pmid"], last["year"], last["first_author"]) == ("12345", "2001", "A 1950 B")


def test_overlapping_keywords(one):
    assert one(lambda: X.keyword_score(F.lit("estimated with FOCEI"), config.MODEL_KEYWORDS)) == 2
    assert one(lambda: X.contained_keywords(F.lit("focei"), config.MODEL_KEYWORDS)) == ["foce", "focei"]


def test_whole_words_only(one):
    assert one(lambda: X.whole_word_count(F.lit("ETA detail meta ETA_1 eta."), "eta")) == 2
    assert one(lambda: X.whole_word_count(F.lit("a final  model; the Final Model"), "final model")) == 1
    assert one(lambda: X.whole_word_count(F.lit("1+1 x"), "1+1")) == 1


def test_compound_alias(one):
    assert one(lambda: X.compound_code(F.lit(" Valproic-Acid"))) == "vpa"
    assert one(lambda: X.compound_code(F.lit("Other drug"))) == "other drug"


def test_display_value_limit(one):
    shown = one(lambda: X.display_value(F.lit("x" * 500)))
    assert len(shown) == 220 and shown.endswith("…")
    assert one(lambda: X.display_value(F.lit(None).cast("string"))) == "null"


def test_route_abbreviations_are_off_by_default(one):
    assert one(lambda: P.route(F.lit("given iv"))) is None
    assert one(lambda: P.route(F.lit("given iv"), True)) == "intravenous"
    assert one(lambda: P.route(F.lit("i.v. then oral"))) == "intravenous"


def test_parameter_text(one):
    got = one(lambda: P.parameters(F.lit("theta1=5.5 omega1=0.17 omega2,1=0.02 sigma1 = 0.1"), F.lit("CL = theta1*exp(eta(1)); Y = F*(1 + ERR(1))")))
    assert got["theta"][0]["name"] == "CL" and got["theta"][0]["typical"] == 5.5
    assert got["omega"][0]["value"] == 0.17 and got["omega"][0]["eta_distribution"] == "log_normal"
    assert got["omega_covariance"][0]["value"] == 0.02 and got["omega_covariance"][0]["row_eta"] == 2
    assert got["sigma"][0]["error_model"] == "proportional"


def test_cohorts(one):
    text = "Elderly N: 36 Age: 74.2 ± 5.1 (65-85) Young N: 36 Age: 25 (20-30)"
    p = one(lambda: P.population(F.lit(text), F.lit(None).cast("double")))
    assert p["n_total"] == 72 and [c["label"] for c in p["cohorts"]] == ["Elderly", "Young"]
    age = p["cohorts"][0]["descriptors"][0]
    assert [s["type"] for s in age["statistics"]] == ["mean_sd", "range"]
    assert [s["type"] for s in p["cohorts"][1]["descriptors"][0]["statistics"]] == ["range"]
    assert p["assumption"]


def test_range_suppresses_centre(one):
    assert [s["type"] for s in one(lambda: P.summary_statistics(F.lit("9.5 (1 – 14)")))] == ["range"]
    assert one(lambda: P.summary_statistics(F.lit("9.5")))[0]["value"] == 9.5


def test_dose_units(one):
    mg = one(lambda: N.amount_mg(F.lit(250.0), F.lit("mcg/kg"), F.lit(80.0), F.lit(None).cast("double")))
    assert mg["value"] == 20.0 and mg["blocker"] is None
    assert one(lambda: N.amount_mg(F.lit(1.0), F.lit("tablet"), F.lit(80.0), F.lit(1.0)))["blocker"] == "dose_unit_not_convertible_to_mg"
    assert one(lambda: N.amount_mg(F.lit(1.0), F.lit("mg/kg"), F.lit(None).cast("double"), F.lit(1.0)))["blocker"].startswith("weight")


def test_regimen(one):
    d = one(lambda: P.regimen(F.lit("5 mg/kg every 8 hours infusion at steady state"), F.lit("intravenous")))
    assert (d["amount"], d["amount_unit"], d["interval"], d["administration"], d["steady_state"]) == (5.0, "mg/kg", 8.0, "infusion", True)
    assert one(lambda: P.regimen(F.lit("  "), F.lit(None).cast("string"))) is None


def test_mapping(one):
    def infer(description, names, route="oral"):
        canonical = P.canonical_structure(F.lit(description), F.lit(None).cast("int"), F.lit(route), X.literal_array(names))
        return P.implementation(canonical, F.lit(route), F.lit(None).cast("int"), F.lit(None).cast("int"))

    a = one(lambda: infer("one-compartment first-order absorption", ["KA", "CL", "V"]))
    assert (a["advan"], a["trans"], a["status"], a["confidence"]) == (2, 2, "inferred", 0.95)
    b = one(lambda: infer("two-compartment Michaelis-Menten", ["VMAX"]))
    assert b["status"] == "unresolved" and b["alternatives"] == [6, 13] and b["review_required"]


def test_variances(one):
    none = lambda: F.lit(None).cast("double")
    text = lambda: F.lit(None).cast("string")
    a = one(lambda: N.omega_variance(F.lit(37.9), none(), F.lit("cv_percent"), F.lit("log_normal"), text(), none()))
    assert abs(a["value"] - 0.13423) < 1e-4 and a["supported"]
    b = one(lambda: N.omega_variance(F.lit(50.0), none(), F.lit("cv_percent"), F.lit("normal"), text(), F.lit(2.0)))
    assert b["value"] == 1.0
    c = one(lambda: N.omega_variance(F.lit(50.0), none(), F.lit("unknown"), F.lit("normal"), text(), F.lit(2.0)))
    assert not c["supported"] and c["review"]
    d = one(lambda: N.sigma_variance(F.lit(14.1), none(), F.lit("cv percent")))
    assert abs(d["value"] - 0.141**2) < 1e-12
    e = one(lambda: N.covariance_value(F.lit(0.5), none(), F.lit("correlation"), F.lit(0.1), F.lit(0.2)))
    assert abs(e["value"] - 0.5 * (0.02**0.5)) < 1e-12


def test_probability_percent(one):
    assert one(lambda: N.probability_text(F.lit("83"))) == 0.83
    assert one(lambda: N.probability_text(F.lit("79%"))) == 0.79
    assert one(lambda: N.probability_text(F.lit("1"))) == 1.0
    assert not one(lambda: N.probability_ok(N.probability_text(F.lit("101"))))
    assert one(lambda: N.clip01(F.lit(None).cast("double"))) is None


def test_versions(one):
    assert one(lambda: N.version_newer(F.lit("1.10.0"), F.lit("1.9.9")))
    assert not one(lambda: N.version_newer(F.lit(""), F.lit("1.0.0")))
    assert not one(lambda: N.version_newer(F.lit("1.x"), F.lit("1.0")))
    assert one(lambda: N.next_patch(F.lit("2.1.9"))) == "2.1.10"
    assert one(lambda: N.next_patch(F.lit("2.1"))) == "0.0.1"


def test_percent_delta(one):
    assert one(lambda: N.percent_delta(F.lit(0.0), F.lit(1.0))) == float("inf")
    assert one(lambda: N.percent_delta(F.lit(2.0), F.lit(3.0))) == 50.0


def test_tolerances_differ_by_caller(one):
    assert one(lambda: N.claim_close(F.lit(0.0), F.lit(0.02)))
    assert not one(lambda: N.numeric_close(F.lit(0.0), F.lit(0.02)))
    assert one(lambda: N.relative_equal(F.lit(100.0), F.lit(105.0)))
    assert not one(lambda: N.relative_equal(F.lit(100.0), F.lit(106.0)))


def test_overdue_fails_closed(one):
    now = lambda: F.lit("2026-01-01").cast("timestamp")
    assert not one(lambda: N.review_overdue(F.lit(""), now()))
    assert one(lambda: N.review_overdue(F.lit("soon"), now()))
    assert not one(lambda: N.review_overdue(F.lit("2030-01-01"), now()))


def test_partition_is_deterministic(spark):
    rows = spark.range(2000).select(N.partition_of(F.col("id")).alias("p")).groupBy("p").count().collect()
    share = {r["p"]: r["count"] / 2000 for r in rows}
    assert abs(share["test"] - 0.15) < 0.04 and abs(share["validation"] - 0.15) < 0.04


@pytest.mark.parametrize("text, names", [
    ("CL = theta1; V=Theta 2", {"1": "CL", "2": "V"}), ("CL = theta1 CL2 = theta1", {"1": "CL"}), ("2CL = theta3, .KA= theta4\nx-y = THETA5", {"4": "KA", "5": "x-y"}),
    ("theta1 = 5", {}), ("a = theta", {}), (f"{'n' * 41} = theta1 p/{'q' * 38}=theta2", {"2": f"p/{'q' * 38}"}), ("K10 =\n theta12 = theta13", {"12": "K10"}), (None, {})])
def test_names_of_parameters(one, text, names):
    assert one(lambda: P.parameter_names(F.lit(text))) == names


@pytest.mark.parametrize("text, model", [
    ("Cobs = C * (1 + eps1)", "proportional"), ("cobs=C*(1+EPS1) + eps2", "combined"), ("cobs=C*(1+EPS(1)) + eps(2)", "proportional"), ("Y = F + ERR(1)", "additive"), ("y = f * (1 + err1 )\n + err2", "combined"), ("y = f\n + err(1)", "unknown"),
    ("cobs = c + err", "unknown"), ("y = f + eps", "unknown"), ("(1 + eps) + eps", "combined"), ("y =\n f + err", "unknown"), ("w = 2\ny = f * ( 1 + err)", "additive"), ("", "unknown"), (None, "unknown")])
def test_error_models(one, text, model):
    assert one(lambda: P.error_model(F.lit(text))) == model


@pytest.mark.parametrize("text, value", [
    ("N = 5 Age 30 ± 2 (20-40) Weight 70", "30 ± 2 (20-40)"), ("Age: 30", "30"), ("Age WT 5", ""), ("Age = WT 5", ""), ("age 3; x", ""), ("age; Age 30 years", "30 years"), ("Age 3 (a; b)", "3 (a; b)"), ("Age 3,Age 4 BMI 2", "3,Age 4"),
    ("Aged 5", "d 5"), ("none", ""), ("Stage 4", ""), ("Age 30\nCYP2D6", "30")])
def test_descriptor_values(one, text, value):
    assert one(lambda: P.descriptor_value(F.lit(text), r"\bAge")) == value


def test_genes_are_words(one):
    assert one(lambda: P.genes_in(F.lit("cyp2d6, CYP3A4/CYP2D6 xCYP2C9 CYP2C19*2 CYP9Z9 CYP2E1_1"))) == ["CYP2D6", "CYP3A4", "CYP2C19"]
