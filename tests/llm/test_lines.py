import random
import re

from claimloom.llm import lines
from tests.llm.helpers import docs, roots, words


def brute(rows, share=lines.THRESHOLD):
    places = sorted({(i, n, line) for i, text in rows for n, line in enumerate((text or "").split("\n")) if re.search(r"\S", line)}, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    kinds = sorted({p[2] for p in places})
    sets = {x: {x[k:k + 8] for k in range(len(x) - 7)} if len(x) >= 8 else {x} for x in kinds}
    links = [(a, b) for k, a in enumerate(kinds) for b in kinds[k + 1:] if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    root, first = roots(links, kinds), {}
    for i, n, line in places:
        first.setdefault(root[line], (i, n))
    return set(first.values()), len(places)


def sample():
    base = [" ".join(words(30, k)) for k in range(12)]
    near = [b[:100] + "X" + b[101:] for b in base]
    rows = [(k, "\n".join([base[k], near[(k + 1) % 12], "short", "", "  ", base[0], "é" * 7, "ü" * 90, f"own line of {k} " * 5])) for k in range(12)]
    return rows + [(50, None), (51, ""), (52, "\n\n"), (53, "x" * 20000), (54, "x" * 20000 + "y"), (None, base[3])]


def test_kept_lines_equal_brute_force(spark):
    rows = sample()
    want, n = brute(rows)
    got = lines.line_components(docs(spark, rows)).collect()
    assert len(got) == n
    assert {(r["doc_id"], r["line_no"]) for r in got if r["kept"]} == want


def test_all_pairs_of_a_band_count(spark):
    rng = random.Random(7)
    base, kinds = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(97)), set()
    for _ in range(400):
        line = list(base)
        for _ in range(rng.randrange(1, 5)):
            line[rng.randrange(97)] = rng.choice("0123456789")
        kinds.add("".join(line))
    frame = docs(spark, list(enumerate(sorted(kinds))))
    named = {r["line_id"]: r["text"] for r in frame.selectExpr("xxhash64(text) AS line_id", "text").collect()}
    signed = {r["line_id"]: r for r in lines.signatures(frame.selectExpr("text AS line")).collect()}
    ids = sorted(named)
    sets = {i: {named[i][k:k + 8] for k in range(90)} for i in ids}
    keys = {i: {(k, *[signed[i][f"m{j}"] for j in band]) for k, band in enumerate(lines.bands())} for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if keys[a] & keys[b] and len(sets[a] & sets[b]) >= lines.THRESHOLD * len(sets[a] | sets[b])]
    want = roots(links, ids)
    first = lines.candidates(lines.groups(lines.signatures(frame.selectExpr("text AS line")))).collect()
    tested = {(r["a"], r["b"]) for r in first}
    assert roots([x for x in links if x in tested], ids) != want  # head and predecessor alone do not reach all
    got = lines.line_components(frame).collect()
    assert {r["line_id"]: r["component_id"] for r in got} == want and sum(r["kept"] for r in got) == len(set(want.values()))


def test_texts_lose_the_other_lines_and_keep_their_columns(spark):
    rows = sample()
    want, _ = brute(rows)
    frame = docs(spark, rows)
    out = lines.without_repeats(frame)
    assert out.columns == frame.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, text in rows:
        left = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if not x.strip() or (i, n) in want)
        assert got[i] == left


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(words(20, 1))
    got = lines.line_components(docs(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in got) == [(1, True), (1, True), (2, False)]
    kept = lines.without_repeats(docs(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, text), (1, text), (2, "")]
    assert lines.line_components(docs(spark, [])).count() == 0
    assert lines.without_repeats(docs(spark, [])).count() == 0


def test_bands_are_distinct_fours_that_meet_once():
    bands = lines.bands()
    assert len(bands) == 12 and all(len(set(b)) == 4 for b in bands)
    assert all(len(set(a) & set(b)) <= 1 for k, a in enumerate(bands) for b in bands[k + 1:])


def test_marks_hold_every_member_and_few_others(spark):
    ids = spark.range(-500, 500).selectExpr("xxhash64(id) AS line_id")
    bits = lines._marks(spark, ids).first()["bits"]
    assert len(bits) == (1 << lines.SLOT_BITS) // 64
    wanted = {r["line_id"] % (1 << lines.SLOT_BITS) for r in ids.collect()}
    assert {64 * w + b for w, x in enumerate(bits) if x for b in range(64) if x >> b & 1} == wanted


def test_sketch_is_the_parity_of_the_set(spark):
    frame = docs(spark, [(1, "abcdefghij" * 9), (2, "é"), (3, "x" * 50)]).selectExpr("text AS line", "doc_id AS line_id")
    sets = {r["line_id"]: r["s"] for r in frame.select("line_id", lines.shingle_set(frame["line"]).alias("s")).collect()}
    for row in lines._sketched(frame).collect():
        want = [0] * lines.SKETCH_WORDS
        for h in sets[row["line_id"]]:
            want[h >> 6 & lines.SKETCH_WORDS - 1] ^= 1 << (h & 63)
        assert row["n"] == len(sets[row["line_id"]]) and [row[f"s{i}"] % (1 << 64) for i in range(lines.SKETCH_WORDS)] == want


def test_sketch_refuses_long_lines_that_cannot_link(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz "
    rows = []
    for k in range(0, 40, 2):
        both, ends = "".join(rng.choices(letters, k=742)), ["".join(rng.choices(letters, k=158)) for _ in range(2)]
        rows += [(k + i, both + end) for i, end in enumerate(ends)]
    got = {r["line_id"]: r for r in lines._sketched(docs(spark, rows).selectExpr("doc_id AS line_id", "text AS line")).collect()}
    for k in range(0, 40, 2):
        x, y = got[k], got[k + 1]
        differ = sum(((x[f"s{i}"] ^ y[f"s{i}"]) % (1 << 64)).bit_count() for i in range(lines.SKETCH_WORDS))
        assert differ * (1 + lines.THRESHOLD) > (x["n"] + y["n"]) * (1 - lines.THRESHOLD)


def test_shingles_are_windows_of_characters(spark):
    kinds = ["abcdefg", "abcdefgh", "abcdefghi", "é" * 9, "\U0001F600ab\u4e2dcdefgh", "x" * 30]
    want = {x: {x[k:k + 8] for k in range(len(x) - 7)} if len(x) >= 8 else {x} for x in kinds}
    frame = docs(spark, list(enumerate(kinds)))
    cut = frame.selectExpr("text", "xxhash64(encode(text, 'UTF-32')) AS whole").collect()
    got = {r["text"]: r["s"] for r in frame.select("text", lines.shingle_set(frame["text"]).alias("s")).collect()}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[r["text"]] == [r["whole"]] for r in cut if len(r["text"]) <= 8)
    assert len(set(got["abcdefgh"]) & set(got["abcdefghi"])) == 1


def test_pairs_of_several_groups_leave_the_join_once(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120))
    kinds = sorted({base[:k] + rng.choice("0123456789") + base[k + 1:] for k in range(0, 120, 2)})
    texts = docs(spark, list(enumerate(kinds))).selectExpr("xxhash64(text) AS line_id", "text AS line")
    grouped = lines.groups(lines.signatures(texts))
    nobody = spark.createDataFrame([], "node bigint, root bigint")
    found = lines.other_candidates(grouped, nobody, texts, lines.THRESHOLD)
    got = [(r["a"], r["b"]) for r in found.collect()]
    several = {}
    for r in grouped.where("size > 3").collect():
        several.setdefault(r["key"], []).append(r["line_id"])
    sets = {r["line_id"]: {r["line"][k:k + 8] for k in range(113)} for r in texts.collect()}
    shared = [(a, b) for ids in several.values() for a in ids for b in ids if a < b]
    links = {(a, b) for a, b in shared if len(sets[a] & sets[b]) >= lines.THRESHOLD * len(sets[a] | sets[b])}
    assert len(shared) > len(set(shared)) and links <= set(got) <= set(shared)
    # no step behind the join takes copies out: it makes none
    assert len(got) == len(set(got)) and found._jdf.queryExecution().optimizedPlan().nodeName() == "Project"
