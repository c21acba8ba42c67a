"""Queries on rows that the small given tables lack: keys, counts and lengths of larger tables."""

import duckdb
from pyspark.sql import functions as F

from workload import registry

registry.load_all()


def differences(spark, name, sql=None, **tables):
    """Rows that the query or its SQL has alone, on tables of lists of dicts."""
    folder = tables.pop("folder")
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    got = sorted(tuple(r) for r in df.collect())
    cur = con.execute(sql or registry.SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    want = sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    assert want
    return [r for r in got if r not in want], [r for r in want if r not in got]


LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string"


def wide(name, key):
    """The SQL with its ordering product beyond 64 bits, which it leaves at these keys as well."""
    return registry.SQL[name].replace(f"{key} *", f"{key}::HUGEINT *")


def test_ordinals_of_large_order_keys(spark, tmp_path):
    rows = [(9_000_000 - i % 7, 1_199_999 - i, 59_999, 1 + i % 7, "A", "F") for i in range(50)]
    assert differences(spark, "e03_key_ordinal", wide("e03_key_ordinal", "ORDER BY l_orderkey"), folder=tmp_path, lineitem=(LINES, rows)) == ([], [])


def test_first_groups_of_large_part_keys(spark, tmp_path):
    rows = [(9_000_000 - i // 2, 1_199_999 - i, 59_999, 1 + i % 7, "A", "F") for i in range(1200)]
    sql = registry.SQL["f06_limit_by_group"].replace(") * 1000000", ")::HUGEINT * 1000000")
    assert differences(spark, "f06_limit_by_group", sql, folder=tmp_path, lineitem=(LINES, rows)) == ([], [])


PAGES, DOCUMENTS = "page_id bigint, url string, html string", "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_source_digest_of_many_hashes(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "web", 9) for i in range(66_000)]
    tables = {"documents": (DOCUMENTS, rows), "pages": (PAGES, [(1, "u", "<p>x</p>")])}
    assert differences(spark, "d07_source_hash_digest", folder=tmp_path, **tables) == ([], [])


def test_headings_are_whole_lines(spark, tmp_path):
    # every look-back but the first begins inside the one line, at characters that look like a heading further on
    rows = [(i, "x" * i + "word### more " * 2000, lang, "web", 26_000) for i, lang in enumerate(["es", "fr", "en", "de"] * 4)]
    assert differences(spark, "e05_heading_carry_forward", folder=tmp_path, documents=(DOCUMENTS, rows)) == ([], [])


def test_a_heading_at_the_beginning_of_the_look_back_counts(spark):
    from claimloom.operators import chunks

    text = "x\n# Methods\n" + "y" * 2000
    df = spark.createDataFrame([(i,) for i in range(1, 30)], "start int").select("start", chunks.locator(F.lit(text), F.col("start") + 500, F.col("start") + 600, 500).alias("l"))
    found = {r["start"]: r["l"].startswith("Methods; ") for r in df.collect()}
    assert found == {s: s <= 3 for s in range(1, 30)}


def test_locators_of_top_chunks_have_no_cut_lines(spark, tmp_path):
    rows = [(i, "x" * i + "word### more " * 1500 + "the### more " * 500, "es", "web", 25_500) for i in range(13)]
    assert differences(spark, "f01_top_chunks", folder=tmp_path, documents=(DOCUMENTS, rows)) == ([], [])


def test_windows_of_odd_texts(spark, tmp_path):
    # headings, page marks, line ends of two characters, a vertical tab alone, over a thousand windows
    texts = ["# Title\nPage 3\n" + "the word " * 300, "the las\r\n" * 300, "\x0b", " \t\r\n\f", "", None, "x" * 510_000 + " the der las les" * 200]
    tables = {"documents": (DOCUMENTS, [(i, x, "fr", "web", 1) for i, x in enumerate(texts)])}
    assert differences(spark, "f01_top_chunks", folder=tmp_path, **tables) == ([], [])
    texts[-1] = "x" * 4_000_000
    tables = {"documents": (DOCUMENTS, [(i, x, "fr", "web", 1) for i, x in enumerate(texts)])}
    assert differences(spark, "e06_overlapping_windows", folder=tmp_path, **tables) == ([], [])


def test_character_set_trims_what_its_sql_trims(spark, tmp_path):
    rows = [(1, "a, b ,\nb,\tc , ,a", "en", "web", 9), (2, " \n ,\n", "en", "web", 9), (3, "", "en", "web", 0)]
    assert differences(spark, "g09_character_set", folder=tmp_path, documents=(DOCUMENTS, rows)) == ([], [])


def test_export_has_whole_texts(spark, tmp_path):
    rows = [(i, f"title {i}\n" + "word  and\tword\n\n\n" * 5000, lang, "web", 90_000) for i, lang in enumerate(["en", "de", "fr", "es"] * 8)]
    tables = {"documents": (DOCUMENTS, rows), "labels": ("doc_id bigint, quality int, toxic int", [(i, 1, 0) for i in range(32)])}
    assert differences(spark, "i19_training_export", folder=tmp_path, **tables) == ([], [])


def test_parameter_lists_use_all_cores(spark):
    df = registry.QUERIES["h12_parameter_list"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_costly_arrays_are_made_once_behind_the_exchange(spark):
    from claimloom.functions import text as X

    items = F.transform(F.sequence(F.lit(1), F.col("id")), lambda i: F.struct(i.alias("i")))
    df = spark.range(4).repartition(3).select("id", F.when(F.col("id") > 0, items).alias("items"))
    rows = X.inline_rows(df, ["id"], "items", "i")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("Repartition"):]
    plan = registry.QUERIES["c24_template_mapping"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("Repartition"):]


def test_status_ordering_spreads_equal_fields(spark):
    df = registry.QUERIES["f05_status_ordering"](spark, "/root/testdata/sf0.001")
    sort = next(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in line)
    assert [sort.index(c) for c in ("status_rank", "field", "doc_id", "pointer")] == sorted(sort.index(c) for c in ("status_rank", "field", "doc_id", "pointer"))


def test_leaves_are_made_once_behind_the_exchange(spark):
    # of the leaves nothing may be computed below the exchange, only the depth test
    plan = registry.QUERIES["h52_json_flatten"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and "size(" not in "".join(p.split("\n", 1)[1] for p in plan.split("Generate ")[1:] for p in [p[p.index("Repartition"):]])


def test_probabilities_are_found_once_behind_the_exchange(spark):
    # one scan for flat documents and one for deep ones, and no leaf below their exchange
    plan = registry.QUERIES["h42_probability_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    assert all("lambda" not in part[:part.index("Relation [")] for part in plan.split("Repartition")[1:])


def test_reuse_compares_hashes_of_any_kind(spark):
    from claimloom.operators import scoring

    a, b = "ab" * 32, "cd" * 32
    pairs = [(a, a), (a, b), (a, a.upper()), (a.upper(), a.upper()), ("x", "x"), (None, None), ("", None), (None, ""), ("?", None), ("?", "-"), ("é" * 16, "é" * 16), (a + "\n", a)]
    sources = spark.createDataFrame([(str(i), str(i), s) for i, (s, _) in enumerate(pairs)], "article_id string, record_id string, source_sha256 string")
    made = spark.createDataFrame([(str(i), "t", "m", "e", "complete", e) for i, (_, e) in enumerate(pairs) if e != "-"], "record_id string, task string, mode string, endpoint string, status string, source_sha256 string")
    got = {int(r["article_id"]): r["reusable"] for r in scoring.reusable_articles(made, sources, "t", "m", "e").collect()}
    assert got == {i: (s or "") == ("?" if e in (None, "-") else e) for i, (s, e) in enumerate(pairs)}
    plan = scoring.reusable_articles(made, sources, "t", "m", "e")._jdf.queryExecution().optimizedPlan().toString()
    assert "source_sha256" not in "".join(line for line in plan.splitlines() if "Join" in line or "Aggregate" in line)


def test_answers_that_hold_their_items_are_not_joined_again(spark):
    from claimloom.plans import jobs, plugins

    plan = spark.createDataFrame([("r1", "t", False), ("r2", "t", False), ("r3", "t", True)], "record_id string, title string, reusable boolean")
    answers = spark.createDataFrame([("r1", "{}", None), ("r2", None, "timeout"), ("r9", "{}", None)], "record_id string, prediction string, error string")
    stored = jobs.run(plan, plugins.stored_responder(answers, "record_id"))
    apart = jobs.run(plan, lambda work: answers.filter("record_id = 'r1'"))
    assert {(r["record_id"], r["title"], r["status"]) for r in stored.collect()} == {("r1", "t", "complete"), ("r2", "t", "error")} == {(r["record_id"], r["title"], r["status"]) for r in apart.collect()}
    assert stored._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 < apart._jdf.queryExecution().optimizedPlan().toString().count("Join") + 1


def test_article_files_do_not_follow_the_splits_of_the_scan(spark, tmp_path):
    rows = [(i, f"title {i}\ntext", "en", "web", 9) for i in range(4500)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["a16_article_xml"](spark, str(tmp_path))
    assert df.count() == 4500 and len(df.inputFiles()) == 3


def test_scalar_fields_of_small_order_files_use_all_cores(spark):
    from workload import joins

    for side in joins.score_tables(registry.Tables(spark, "/root/testdata/sf0.001")):
        assert side["scalar"].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
