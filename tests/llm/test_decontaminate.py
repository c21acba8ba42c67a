import hashlib
import re

from claimloom.llm import decontaminate
from tests.llm.helpers import LOWER, docs, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, items):
    grams = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for g, owners in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    names |= owners
        names.discard(None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()))
    return sorted(out, key=str)


def sample():
    items = [(k, " ".join(words(n, 30 + k))) for k, n in enumerate([25, 10, 11, 4, 1, 40])]
    items += [(9, items[0][1]), (10, None), (11, ""), (12, "--- !!"), (13, "ÉTÉ Über straße"), (None, " ".join(words(12, 77))), (5, "and more " * 8)]
    rows = [(1, "x " + items[0][1] + " y"), (2, items[0][1][40:170].upper()), (3, items[1][1].replace(" ", " -- ")), (4, items[3][1] * 2), (5, items[4][1]), (6, None), (7, ""),
            (8, "nothing here"), (9, " ".join(words(300, 4)) + " " + items[5][1]), (9, "nothing here"), (None, items[2][1]), (11, "ÉtÉ Über straße"), (11, "ÉTÉ über STRASSE"),
            (12, items[0][1]), (12, items[0][1]), (13, "and more " * 30), (14, " ".join(words(12, 77)))]
    return rows, items


def test_report_equals_brute_force(spark):
    rows, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 AS n", "2 AS window")
    for limit in (decontaminate.BROADCAST_BYTES, 0):  # with and without the broadcast
        found = decontaminate.report(docs(spark, rows), bench, broadcast_bytes=limit).collect()
        got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found], key=str)
        assert got == brute(rows, items)


def test_documents_and_spans_are_removed(spark):
    rows, items = sample()
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), docs(spark, rows)
    clean = [x for x, r in zip(sorted(rows, key=str), brute(rows, items))]
    kept = decontaminate.drop_documents(frame, bench)
    assert kept.columns == frame.columns
    wanted = [(i, t) for i, t in rows if brute([(i, t)], items)[0][2] == 0]
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted(wanted, key=str) and len(clean) == len(rows)
    cut = decontaminate.drop_spans(frame, bench)
    texts = [(r["doc_id"], r["text"]) for r in cut.collect()]
    assert len(texts) == len(rows)
    assert dict(texts)[1].split() == ["x", "y"] and dict(texts)[8] == "nothing here" and dict(texts)[6] is None
    assert (9, " ".join(words(300, 4)) + " ") in texts


def test_empty_tables(spark):
    rows, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.report(docs(spark, []), bench).count() == 0
    none = decontaminate.report(docs(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and all(r["n_hit"] == 0 and r["items"] == [] for r in none)
    assert decontaminate.drop_documents(docs(spark, rows), bench.limit(0)).count() == len(rows)
