import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from workload import registry

FOLDER = "/root/testdata/sf0.001"


def test_names_and_sql_cover_the_inventory():
    registry.load_all()
    queries, sql = registry.QUERIES, registry.SQL
    assert set(queries) <= set(entry_module.queries()) and set(sql) <= set(entry_module.oracle_sql())
    assert set(sql) <= set(queries) and len(queries) >= 225
    ids = {re.match(r"([a-k]\d\d)_", name).group(1) for name in queries}
    for letter, last in {"a": 30, "b": 14, "c": 30, "d": 30, "e": 9, "f": 8, "g": 10, "h": 66, "i": 25, "j": 6, "k": 4}.items():
        assert {f"{letter}{n:02d}" for n in range(1, last + 1)} <= ids
    assert set(queries) == set(sql)


def test_queries_do_without_a_package_that_only_the_corpus_operators_need():
    code = ("import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) >= 225 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)")
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_flagship_runs(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and {r["tier"] for r in rows} <= {"high", "intermediate", "low"}


@pytest.mark.parametrize("name", ["a21_budgeted_page_text", "c04_lane_comparison", "c15_chunk_retrieval", "d13_average_precision", "g02_claim_dedupe", "h58_json_salvage", "i15_control_text"])
def test_query_equals_sql_on_the_small_tables(spark, name):
    import check

    registry.load_all()
    df = registry.QUERIES[name](spark, FOLDER)
    got, columns = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(registry.SQL[name])
    want, names = check.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert columns == names and got == want
