"""The evidence ledger as tables: claims, questions, contradictions, reviews, stage summaries.

Every table carries ``doc_id`` and an ordinal ``seq`` (unique per document, the
order in which items were reported), because first-wins rules need an order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom import config
from claimloom.functions import text as X
from claimloom.operators import keyed
from claimloom.session import cut_lineage


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"c{i}") for i, p in enumerate(parts)]),
                            {"ignoreNullFields": "false"}), 256)


def claim_id(supplied: Column, stage: Column, field: Column, value: Column, model_stage: Column,
             source_locator: Column) -> Column:
    """stage::id, written once; without an id, stage_ and twelve hex digits of the content."""
    given = X.strip(X.coalesce_blank(supplied))
    prefix = F.concat(stage, F.lit("::"))
    made = F.concat(stage, F.lit("_"), F.substring(content_hash(field, value, model_stage, source_locator), 1, 12))
    return F.when(given == "", made).when(F.startswith(given, prefix), given).otherwise(F.concat(prefix, given))


def question_id(supplied: Column, stage: Column, field: Column, question: Column) -> Column:
    given = X.strip(X.coalesce_blank(supplied))
    base = F.when(given == "", F.concat(F.lit("Q_"), F.substring(content_hash(field, question), 1, 12))).otherwise(given)
    return F.when(F.contains(base, F.lit("::")), base).otherwise(F.concat(stage, F.lit("::"), base))


#: Rows of one key that are decided in one pass; keys with more are decided in rounds.
ONE_PASS_ROWS = 100_000


def first_wins_pairs(df: DataFrame, keys: Sequence[str], one: str, two: str, order: str, one_pass: int = ONE_PASS_ROWS) -> DataFrame:
    """Keep a row unless an earlier *kept* row of the same keys shares either of two values.

    Rows of keys with at most ``one_pass`` rows are dealt by key, sorted, and read once, whatever chains
    they make; only the values seen so far are held, for one key at a time.  Larger keys are decided in
    rounds by :func:`_in_rounds`, so no key has to fit a task.  Rows of the same order do not see each other.
    """
    large = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > one_pass).select(*keys))
    names = df.columns
    at = [names.index(c) for c in (*keys, order, one, two)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, ones, twos, new = None, None, set(), set(), []
        for batch in batches:
            keep = []
            for *mine, place, x, y in zip(*(batch.column(i).to_pylist() for i in at)):
                if mine != key:
                    key, now, ones, twos, new = mine, place, set(), set(), []
                if place != now:
                    ones.update(p for p, _ in new), twos.update(q for _, q in new)
                    now, new = place, []
                keep.append(x not in ones and y not in twos)
                if keep[-1]:
                    new.append((x, y))
            yield batch.filter(pa.array(keep, pa.bool_()))

    def passed(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(scan, df.schema)

    if large.isEmpty():
        return passed(df)
    return passed(df.join(large, list(keys), "left_anti")).unionByName(_in_rounds(df.join(large, list(keys), "left_semi"), keys, one, two, order))


def _in_rounds(df: DataFrame, keys: Sequence[str], one: str, two: str, order: str) -> DataFrame:
    """The same rule for keys of any size.

    A row that comes first in both of its groups is kept; rows sharing a value
    with it fall away; what is left is decided the same way.  Groups are
    reduced with min(), never gathered.  Lineage is cut once per round, and
    nearly all rows are decided in the first two.
    """
    first = df.groupBy(*keys, one, two).agg(F.min(order).alias(order))
    open_rows, kept = first, None
    while True:
        by_one = open_rows.groupBy(*keys, one).agg(F.min(order).alias("_m1"))
        by_two = open_rows.groupBy(*keys, two).agg(F.min(order).alias("_m2"))
        ranked = open_rows.join(by_one, [*keys, one]).join(by_two, [*keys, two])
        winners = ranked.filter((F.col(order) == F.col("_m1")) & (F.col(order) == F.col("_m2"))).select(first.columns)
        winners = cut_lineage(winners)
        kept = winners if kept is None else kept.unionByName(winners)
        open_rows = cut_lineage(
            open_rows.join(winners.select(*keys, one), [*keys, one], "left_anti")
            .join(winners.select(*keys, two), [*keys, two], "left_anti")
        )
        if open_rows.isEmpty():
            break
    return df.join(kept, [*keys, one, two, order], "left_semi")


def _content() -> Column:
    return content_hash(F.col("field"), F.col("value"), F.col("model_stage"), F.col("source_locator"))


def name_claims(claims: DataFrame) -> DataFrame:
    """Claims with their namespaced ``claim_id``."""
    return claims.withColumn(
        "claim_id", claim_id(F.col("id"), F.col("stage"), F.col("field"), F.col("value"), F.col("model_stage"),
                             F.col("source_locator"))
    )


def add_claims(claims: DataFrame, order: str = "seq") -> DataFrame:
    """Namespaced claims; one is dropped when an earlier kept claim has its id or its content."""
    named = name_claims(claims).withColumn("_content", _content())
    return first_wins_pairs(named, ["doc_id"], "claim_id", "_content", order).drop("_content")


def new_claims(kept: DataFrame, claims: DataFrame, order: str = "seq") -> DataFrame:
    """The claims of a later stage that join a ledger of kept claims, by the rule of :func:`add_claims`.

    Everything in the ledger is kept and comes earlier, so a claim that shares an id
    or a content with it falls away at once; the rest is decided among itself.
    """
    named = name_claims(claims).withColumn("_content", _content())
    fresh = named.join(kept.select("doc_id", "claim_id"), ["doc_id", "claim_id"], "left_anti").join(
        kept.select("doc_id", _content().alias("_content")), ["doc_id", "_content"], "left_anti")
    return first_wins_pairs(fresh, ["doc_id"], "claim_id", "_content", order).select(*claims.columns, "claim_id")


def remap_dependencies(claims: DataFrame) -> DataFrame:
    """(doc_id, claim_id, dep_seq, dependency): ids supplied in the same batch become namespaced ids."""
    deps = claims.select("doc_id", "stage", "claim_id", F.posexplode("dependencies").alias("dep_seq", "dependency"))
    ids = claims.filter(X.present("id")).select(
        "doc_id", "stage", X.strip("id").alias("dependency"), F.col("claim_id").alias("mapped")
    ).distinct()
    return deps.join(ids, ["doc_id", "stage", "dependency"], "left").select(
        "doc_id", "claim_id", "dep_seq", F.coalesce("mapped", "dependency").alias("dependency")
    )


def add_questions(questions: DataFrame) -> DataFrame:
    """Namespaced questions; the first of each lower(field|question) wins."""
    key = F.lower(F.concat(X.coalesce_blank("field"), F.lit("|"), X.coalesce_blank("question")))
    named = questions.withColumn(
        "question_id", question_id(F.col("id"), F.col("stage"), F.col("field"), F.col("question"))
    ).withColumn("_key", key)
    return keyed.first_per_key(named, ["doc_id", "_key"], ["seq"]).drop("_key")


def drop_resolved(questions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Open questions without those whose id is listed as resolved (doc_id, question_id)."""
    return questions.join(resolved.select("doc_id", "question_id").distinct(), ["doc_id", "question_id"], "left_anti")


def open_questions(asked: DataFrame, resolved: DataFrame) -> DataFrame:
    """The questions that are open after all steps, folded from the log of what was asked and resolved.

    asked: (doc_id, step, seq, id, stage, field, question, ...); resolved: (doc_id, step, question_id).  In one
    step questions are asked before others are resolved.  While a question is open, another of the same
    lower(field|question) is not added; after it was resolved, the next one is.  Of a step only the first
    question of a key counts, so what is gathered for a key is bounded by the number of steps.
    """
    key = F.lower(F.concat(X.coalesce_blank("field"), F.lit("|"), X.coalesce_blank("question")))
    named = asked.withColumn("question_id", question_id(F.col("id"), F.col("stage"), F.col("field"), F.col("question"))).withColumn("_key", key)
    first = cut_lineage(keyed.first_per_key(named, ["doc_id", "_key", "step"], ["seq"]))
    ends = resolved.select("doc_id", "step", "question_id").distinct().join(
        first.select("doc_id", "question_id", "_key").distinct(), ["doc_id", "question_id"])
    events = first.select("doc_id", "_key", F.struct("step", F.lit(0).alias("ends"), "question_id").alias("e")).unionByName(
        ends.select("doc_id", "_key", F.struct("step", F.lit(1).alias("ends"), "question_id").alias("e")))

    def fold(state: Column, e: Column) -> Column:
        asks, none = e["ends"] == 0, state["question_id"].isNull()
        gone = ~asks & (state["question_id"] == e["question_id"])
        opened = F.struct(e["step"].alias("step"), e["question_id"].alias("question_id"))
        return F.when(asks & none, opened).when(gone, nothing).otherwise(state)

    nothing = F.struct(F.lit(None).cast(asked.schema["step"].dataType).alias("step"), F.lit(None).cast("string").alias("question_id"))
    last = events.groupBy("doc_id", "_key").agg(F.aggregate(F.array_sort(F.collect_list("e")), nothing, fold).alias("open")).select(
        "doc_id", "_key", F.col("open.step").alias("step"))
    return first.join(last.where("step IS NOT NULL"), ["doc_id", "_key", "step"], "left_semi").drop("_key")


def stage_summaries(claims: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Reported claims and contradictions per document and stage, before de-duplication."""
    counted = claims.select("doc_id", "stage", F.lit(1).alias("c"), F.lit(0).alias("x")).unionByName(
        contradictions.select("doc_id", "stage", F.lit(0).alias("c"), F.lit(1).alias("x"))
    )
    return counted.groupBy("doc_id", "stage").agg(
        F.sum("c").alias("claim_count"), F.sum("x").alias("contradiction_count")
    )


def merge_investigation(claims: DataFrame, questions: DataFrame, contradictions: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    """All tables of the ledger after a round: inputs hold old and new rows in one order of ``seq``."""
    return {
        "claims": add_claims(claims),
        "questions": drop_resolved(add_questions(questions), resolved),
        "contradictions": contradictions,
        "stages": stage_summaries(claims, contradictions),
    }


def apply_review(claims: DataFrame, verdicts: DataFrame, stage: str) -> dict[str, DataFrame]:
    """The ledger after a review: verdicts are events in the order of ``seq``, and of several the last one holds.

    claims: the kept claims (doc_id, seq, claim_id, field, value, model_stage, source_locator, evidence, confidence,
    status, dependencies, stage, ...) with ``superseded_by`` if an earlier review has set it.  verdicts: (doc_id, seq,
    claim_id, verdict, corrected_value, source_locator, evidence, reason); they speak about claims that stand in the
    ledger when the review begins, others are ignored.

    Every contradicting verdict gives a contradiction, which is resolved if the verdict corrects the value.  A
    correction gives a replacement: the claim with all its columns, but the corrected value, the verdict's locator and
    evidence, and a dependency on the claim.  The claim is superseded by the last replacement.  A replacement is a copy
    of the claim as it stands when the verdict comes, so one that follows another correction of the same claim bears
    that mark, and of several corrections the first one stays active.  Replacements join the ledger like other claims.

    Returns ``claims`` (with replacements), ``replacements`` (those that joined) and ``contradictions``.
    """
    if "superseded_by" not in claims.columns:
        claims = claims.withColumn("superseded_by", F.lit(None).cast("string"))
    target = keyed.first_per_key(claims, ["doc_id", "claim_id"], ["seq"])
    said = verdicts.filter(F.col("verdict") == "contradicted").select(
        "doc_id", "claim_id", F.col("seq").alias("v_seq"), "corrected_value", F.col("source_locator").alias("v_locator"),
        F.col("evidence").alias("v_evidence"), "reason",
    )
    hit = cut_lineage(said.join(target, ["doc_id", "claim_id"]))
    corrected = X.present("corrected_value")
    locator, evidence = X.coalesce_blank("v_locator"), X.coalesce_blank("v_evidence")
    contradictions = hit.select(
        "doc_id", "claim_id", F.col("v_seq").alias("seq"),
        X.coalesce_blank("reason", "Contradicted during review").alias("description"),
        locator.alias("source_locator"), evidence.alias("evidence"),
        F.lit("major").alias("severity"), corrected.alias("resolved"), F.lit(stage).alias("stage"),
    )
    new_id = F.concat(F.col("claim_id"), F.lit("_correction_"), F.substring(F.sha2(F.col("corrected_value"), 256), 1, 8))
    before = Window.partitionBy("doc_id", "claim_id").orderBy("v_seq")
    fixes = hit.filter(corrected).withColumn("_new", new_id).withColumn("_mark", F.coalesce(F.lag("_new").over(before), "superseded_by"))
    changed = {
        "seq": F.col("v_seq"), "id": F.col("_new"), "value": F.col("corrected_value"), "source_locator": locator, "evidence": evidence,
        "confidence": F.greatest(F.lit(0.7), F.coalesce(X.finite(F.col("confidence")), F.lit(0.0))), "status": F.lit("reported"),
        "dependencies": F.array("claim_id"), "superseded_by": F.col("_mark"), "stage": F.lit(stage),
    }
    columns = list(dict.fromkeys([c for c in claims.columns if c != "claim_id"] + ["id"]))
    replacements = cut_lineage(new_claims(claims, fixes.select(*[changed.get(c, F.col(c)).alias(c) for c in columns])))
    marks = fixes.groupBy("doc_id", "claim_id").agg(F.max_by("_new", "v_seq").alias("_by"))
    marked = claims.join(marks, ["doc_id", "claim_id"], "left").withColumn("superseded_by", F.coalesce("_by", "superseded_by")).drop("_by")
    return {"claims": marked.unionByName(replacements.select(*[c for c in replacements.columns if c in marked.columns])),
            "replacements": replacements, "contradictions": contradictions}


def unsupported_claims(claims: DataFrame) -> DataFrame:
    """Reported claims without a locator or without evidence."""
    return claims.filter(
        (F.col("status") == "reported") & (~X.present("source_locator") | ~X.present("evidence"))
    )


def active_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(~X.present("superseded_by") & (F.col("status") != "unresolved"))


def is_scalar_field(domain: Column, field: Column) -> Column:
    test = F.lit(False)
    for name, pattern in config.SCALAR_FIELD_PATTERNS.items():
        test = test | ((F.lower(domain) == name) & F.lower(field).rlike(pattern))
    return F.coalesce(test, F.lit(False))


def conflicts(claims: DataFrame, scalar: Column | None = None) -> DataFrame:
    """Fields of one model stage with at least two scalar claims and more than one distinct value.

    Values are reduced to distinct ones first, so a field repeated millions of
    times reaches the second step as its few values.
    """
    keep = scalar if scalar is not None else is_scalar_field(F.col("domain"), F.col("field"))
    rows = claims.filter(keep).select(
        "doc_id",
        F.lower(X.coalesce_blank("field")).alias("field"),
        F.lower(X.coalesce_blank("model_stage", "unknown")).alias("model_stage"),
        F.lower(X.strip(X.coalesce_blank("value"))).alias("value"),
    )
    distinct = rows.groupBy("doc_id", "field", "model_stage", "value").agg(F.count("*").alias("_n"))
    groups = distinct.groupBy("doc_id", "field", "model_stage").agg(
        F.sum("_n").alias("n_claims"), F.count_if(F.col("value") != "").alias("n_values"),
        F.min(F.nullif(F.col("value"), F.lit(""))).alias("low_value"), F.max("value").alias("high_value"),
    )
    return groups.filter((F.col("n_claims") >= 2) & (F.col("n_values") > 1))


def domain_flags() -> dict[str, Column]:
    """One column per domain: its own claims, or claims whose field starts with the domain's prefix."""
    field, domain = F.lower(X.coalesce_blank("field")), F.lower(X.coalesce_blank("domain"))
    return {
        name: (domain == name) | F.startswith(field, F.lit(prefix)) for name, prefix in config.LEDGER_DOMAINS.items()
    }


def consistency(claims: DataFrame, inventory: DataFrame, contradictions: DataFrame, questions: DataFrame,
                reviews: DataFrame, scalar: Column | None = None) -> DataFrame:
    """The gate per document: coverage, evidence gaps, conflicts, open issues, ready.

    Every input is aggregated to one row per document before it is joined.
    Documents come from ``inventory`` (doc_id, role); reviews are (doc_id, seq, overall_ready).
    """
    live = claims.filter(~X.present("superseded_by"))
    flags = domain_flags()
    gap = (F.col("status") == "reported") & (~X.present("source_locator") | ~X.present("evidence"))
    facts = live.groupBy("doc_id").agg(
        *[F.max(flag.cast("int")).alias(f"has_{name}") for name, flag in flags.items()],
        F.count_if(gap).alias("claims_without_evidence"),
        F.max((F.col("model_stage") == "final").cast("int")).alias("final_claim"),
    )
    clash = conflicts(live, scalar).groupBy("doc_id").agg(F.count("*").alias("conflicts"))
    roles = inventory.groupBy("doc_id").agg(F.max((F.col("role") == "final").cast("int")).alias("final_listed"))
    open_major = contradictions.groupBy("doc_id").agg(F.count_if(
        (X.coalesce_blank("severity", "major") == "major") & ~F.coalesce(F.col("resolved"), F.lit(False))
    ).alias("open_contradictions"))
    urgent = questions.groupBy("doc_id").agg(
        F.count_if(F.col("priority").isin("critical", "high")).alias("urgent_questions")
    )
    last = reviews.groupBy("doc_id").agg(F.max_by("overall_ready", "seq").alias("review_ready"))
    out = roles
    for part in (facts, clash, open_major, urgent, last):
        out = out.join(part, "doc_id", "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    covered = sum((zero(f"has_{name}") for name in flags), F.lit(0))
    fraction = covered / F.lit(float(len(flags)))
    final = (zero("final_claim") + zero("final_listed")) > 0
    review_ok = F.coalesce(F.col("review_ready"), F.lit(True))
    errors = F.array_compact(F.array(
        F.when(zero("conflicts") > 0, F.lit("conflicting_values")),
        F.when(zero("claims_without_evidence") > 0, F.lit("claims_without_evidence")),
        F.when(zero("open_contradictions") > 0, F.lit("major_contradictions")),
        F.when(zero("urgent_questions") > 0, F.lit("urgent_questions")),
        F.when(~review_ok, F.lit("review_not_ready")),
    ))
    return out.select(
        "doc_id",
        fraction.alias("coverage_fraction"),
        zero("claims_without_evidence").alias("claims_without_evidence"),
        zero("conflicts").alias("conflicts"),
        zero("open_contradictions").alias("open_contradictions"),
        zero("urgent_questions").alias("urgent_questions"),
        review_ok.alias("review_ready"),
        final.alias("final_model_identified"),
        errors.alias("errors"),
        ((F.size(errors) == 0) & (fraction >= 0.75) & final).alias("ready"),
    )


def material_domains(x: Column) -> Column:
    """Domains of an extraction that hold any content."""
    def some(items: Column) -> Column:
        return F.coalesce(F.size(items) > 0, F.lit(False))

    p = x["parameters"]
    tests = {
        "structure": x["advan"].isNotNull() | x["trans"].isNotNull() | x["compartments"].isNotNull()
        | X.present(x["description"]),
        "theta": some(p["theta"]),
        "omega": some(p["omega"]) | some(p["omega_covariance"]),
        "sigma": some(p["sigma"]) | X.present(x["residual_error"]),
        "covariates": some(x["covariates"]),
        "population": X.present(x["population"]) | x["n_subjects"].isNotNull()
        | some(x["population_details"]["cohorts"]),
        "dosing": X.present(x["route"]) | some(x["dosing"]),
        "reproduction": some(x["reproduction_targets"]),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def binding_checks(evidence: DataFrame, claims: DataFrame, required: DataFrame) -> DataFrame:
    """Do the cited claims exist, are they active, and do they bind every material domain?

    evidence: (doc_id, item_no, claim_ids); claims: active claims (doc_id, claim_id, domain);
    required: (doc_id, domains).  Lists are compared as rows, so nothing is gathered per document
    beyond counts and the at most nine bound domains.
    """
    cited = evidence.select("doc_id", "item_no", F.explode("claim_ids").alias("claim_id")).filter(
        F.coalesce(F.col("claim_id") != "", F.lit(False))
    )
    without = evidence.groupBy("doc_id").agg(
        F.count_if(~F.coalesce(F.exists("claim_ids", lambda c: c != ""), F.lit(False))).alias("items_without_ids")
    )
    ids = cited.select("doc_id", "claim_id").distinct()
    active = claims.select("doc_id", "claim_id", F.coalesce("domain", F.lit("other")).alias("domain"))
    marked = ids.join(keyed.first_per_key(active, ["doc_id", "claim_id"], ["domain"]), ["doc_id", "claim_id"], "left")
    bound = marked.groupBy("doc_id").agg(
        F.count_if(F.col("domain").isNull()).alias("invalid_ids"),
        F.sort_array(F.collect_set("domain")).alias("bound_domains"),
    )
    joined = required.join(without, "doc_id", "left").join(bound, "doc_id", "left")
    missing = F.array_except("domains", F.coalesce("bound_domains", X.literal_array([])))
    return joined.select(
        "doc_id",
        F.col("domains").alias("required_domains"),
        F.coalesce("bound_domains", X.literal_array([])).alias("bound_domains"),
        F.coalesce("invalid_ids", F.lit(0)).alias("invalid_ids"),
        F.coalesce("items_without_ids", F.lit(0)).alias("items_without_ids"),
        missing.alias("missing_domains"),
    ).withColumn(
        "ready",
        (F.col("invalid_ids") == 0) & (F.col("items_without_ids") == 0) & (F.size("missing_domains") == 0),
    )


def search_terms(questions: DataFrame) -> DataFrame:
    """Distinct (doc_id, term): field, question and search terms of the given questions."""
    terms = F.concat(F.array("field", "question"), F.coalesce("search_terms", X.literal_array([])))
    return questions.select("doc_id", F.explode(terms).alias("term")).filter(X.present("term")).distinct()


def urgent(questions: DataFrame) -> DataFrame:
    return questions.filter(F.col("priority").isin("critical", "high"))


# ---------------------------------------------------------------- compact view

MIN_CLAIMS = 12
#: No claim is shorter: the names of its fields alone take more characters.
SMALLEST_CLAIM = 40
#: The lists of the payload besides the claims, around them in this order.
LISTS_BEFORE, LISTS_AFTER = ("model_inventory",), ("hypotheses", "questions", "contradictions", "referenced_sources")


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _json_number(x: Column) -> Column:
    """A number as JSON text; whole numbers have no fraction, anything else that is not finite is null."""
    plain = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.coalesce(F.when(X.finite(x).isNotNull(), plain), F.lit("null"))


def bounded_evidence(locator: Column | str = "source_locator", evidence: Column | str = "evidence", dependencies: Column | str = "dependencies",
                     alternatives: Column | str = "alternatives", sizes: tuple[int, int, int, int] = (180, 240, 6, 4)) -> dict[str, Column]:
    """What a prompt shows of a claim's evidence: texts cut to characters and lists to items; nothing is null."""
    none, column = X.literal_array([]), lambda c: F.col(c) if isinstance(c, str) else c
    return {
        "source_locator": F.substring(X.coalesce_blank(column(locator)), 1, sizes[0]),
        "evidence": F.substring(X.coalesce_blank(column(evidence)), 1, sizes[1]),
        "dependencies": F.slice(F.coalesce(column(dependencies), none), 1, sizes[2]),
        "alternatives": F.slice(F.coalesce(column(alternatives), none), 1, sizes[3]),
    }


def compact_claim_json(locator_chars: int = 180, evidence_chars: int = 240, dependencies: int = 6,
                       alternatives: int = 4) -> Column:
    """A claim as the prompts show it: fields in a fixed order, null where nothing is known, long texts and lists cut."""
    cut = bounded_evidence(sizes=(locator_chars, evidence_chars, dependencies, alternatives))
    head = _json(
        F.col("claim_id").alias("id"), F.coalesce("domain", F.lit("other")).alias("domain"),
        *[F.col(c) for c in ("field", "value", "unit", "status", "model_stage", "superseded_by")],
        *[cut[c].alias(c) for c in ("source_locator", "evidence")],
    )
    tail = _json(*[cut[c].alias(c) for c in ("dependencies", "alternatives")])
    return F.concat(F.left(head, F.length(head) - 1),
                    F.lit(',"confidence":'), _json_number(F.col("confidence").cast("double")), F.lit(","), F.substring(tail, 2, 1 << 30))


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, list): the rows of a document (doc_id, seq, ...) as one JSON list in the order of ``seq``."""
    body = _json(*[F.col(c) for c in rows.columns if c not in ("doc_id", "seq")])
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", body.alias("json")))), lambda x: x["json"])
    return rows.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias(name))


def compact_ledger(claims: DataFrame, ledgers: DataFrame, lists: dict[str, DataFrame] | None = None, max_chars: int = 24_000) -> DataFrame:
    """One JSON payload per document, with the most confident claims that fit the budget of characters.

    ledgers: (doc_id, source struct, model_present, model_probability), one row per document; lists: tables
    (doc_id, seq, fields...) by the names in LISTS_BEFORE and LISTS_AFTER, which are shown whole and count against
    the budget.  They are what stages have returned about one document; only the claims give way.  The claim list
    shrinks by 0.85 (never below 12) until the whole payload fits, or 12 claims are left.  A claim takes at least
    ``SMALLEST_CLAIM`` characters, so no more than max_chars / 40 claims can ever fit; only that many per document
    are kept before anything is gathered, and the number left out is counted separately.
    """
    bound = max(MIN_CLAIMS, max_chars // SMALLEST_CLAIM)
    total = claims.groupBy("doc_id").agg(F.count("*").alias("n_claims"))
    confidence = F.coalesce(X.finite(F.col("confidence")), F.lit(0.0))
    top = keyed.top_per_key(
        claims.withColumn("_conf", confidence), ["doc_id"], [F.col("_conf").desc(), F.col("seq")], bound, rank="_pos"
    ).select("doc_id", "_pos", compact_claim_json().alias("_json"))
    gathered = top.groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_json"))), lambda s: s["_json"]).alias("_items")
    )
    base = ledgers.join(gathered.join(total, "doc_id"), "doc_id", "left")
    for name, rows in (lists or {}).items():
        base = base.join(_listed(rows, f"_{name}"), "doc_id", "left")

    def shown(names: Sequence[str]) -> list[Column]:
        return [x for n in names for x in (F.lit(f'"{n}":'), F.coalesce(f"_{n}", F.lit("[]")) if n in (lists or {}) else F.lit("[]"), F.lit(","))]

    source = F.to_json("source", {"ignoreNullFields": "false"})
    before = F.concat(F.lit('{"source":'), source, F.lit(',"model_present":'), F.coalesce(F.col("model_present").cast("string"), F.lit("null")),
                      F.lit(',"model_probability":'), _json_number(F.col("model_probability").cast("double")), F.lit(","), *shown(LISTS_BEFORE), F.lit('"claims":['))
    after = F.concat(F.lit("],"), *shown(LISTS_AFTER), F.lit('"omitted_claim_count":'))
    sizes = F.aggregate(
        "_items", F.array(F.lit(0)),
        lambda acc, j: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(j) + 1)),
    )

    def shrunk(sized: Column) -> Column:
        """The number of claims kept; ``sized`` is bound, so it is computed once and not in every step."""

        def fits(k: Column) -> Column:
            listed = F.when(k > 0, F.get(sized["sizes"], k) - 1).otherwise(0)  # null where more claims are asked for than can fit
            length = sized["fixed"] + listed + F.length((F.col("n_claims") - k).cast("string"))
            return F.coalesce(length <= max_chars, F.lit(False))

        return F.aggregate(
            F.sequence(F.lit(1), F.lit(200)),
            F.col("n_claims").cast("int"),
            lambda k, _: F.when((k <= MIN_CLAIMS) | fits(k), k).otherwise(
                F.greatest(F.lit(MIN_CLAIMS), F.floor(k * 0.85).cast("int"))
            ),
        )

    framed = base.withColumns({"n_claims": F.coalesce("n_claims", F.lit(0)), "_items": F.coalesce("_items", X.literal_array([])), "_before": before, "_after": after})
    sized = framed.withColumn("kept", X.let(
        F.struct(sizes.alias("sizes"), (F.length("_before") + F.length("_after") + 1).alias("fixed")), shrunk))
    omitted = F.col("n_claims") - F.col("kept")
    body = F.array_join(F.slice("_items", 1, F.col("kept")), ",")
    return sized.select(
        "doc_id", "n_claims", "kept", omitted.alias("omitted_claim_count"),
        F.concat("_before", body, "_after", omitted.cast("string"), F.lit("}")).alias("payload"),
    )


def new_ledger(documents: DataFrame, reconnaissance: DataFrame) -> DataFrame:
    """A ledger row per document, seeded from reconnaissance (doc_id, model_present, model_probability)."""
    seeded = documents.join(reconnaissance, "doc_id", "left")
    return seeded.select(
        "doc_id", F.lit(config.SCHEMA_VERSION).alias("schema_version"), F.lit(config.PROMPT_VERSION).alias("prompt_version"),
        *[X.coalesce_blank(c).alias(c) for c in ("pmid", "doi", "title", "sha256")],
        "model_present", F.coalesce("model_probability", F.lit(0.0)).alias("model_probability"),
    )


def stage_fingerprint(parts: Sequence[Column]) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"f{i}") for i, p in enumerate(parts)])), 256)


def split_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, missing): requests whose fingerprint has a valid cached result, and those to compute."""
    valid = cache.filter(F.col("valid")).select("fingerprint", "result").dropDuplicates(["fingerprint"])
    reused = requests.join(valid, "fingerprint").withColumn("cached", F.lit(True))
    missing = requests.join(valid.select("fingerprint"), "fingerprint", "left_anti")
    return reused, missing


def stage_audit(attempts: DataFrame) -> DataFrame:
    """One audit row per document and stage, blanks for missing text, zero for missing retries."""
    return attempts.select(
        "doc_id",
        *[X.coalesce_blank(c).alias(c) for c in ("stage", "role", "provider", "model")],
        "elapsed_seconds",
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.coalesce("cached", F.lit(False)).alias("cached"),
        X.coalesce_blank("cache_path").alias("cache_path"),
    )


def retry_total(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("doc_id").agg(F.sum(F.coalesce("retry_count", F.lit(0))).alias("retry_total"))
