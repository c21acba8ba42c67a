import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import variants
from tests.llm.helpers import LOWER, docs


def brute_counts(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def sample():
    rng = random.Random(5)
    base = ["reading", "worthless", "Étranger", "aaaaaaaa", "ÀÈÌÒÙÿÿ", "Multiplying", "banananana", "naïveté", "x" * 45, "mi×ture÷s"]
    rows = []
    for i in range(60):
        text = []
        for _ in range(120):
            w = rng.choice(base)
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcÿ") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1:]])
            text.append(w)
        rows.append((i, " ".join(text)))
    return rows + [(70, None), (71, ""), (72, "short ones 123"), (73, "z" * 30000 + " " + "z" * 30000), (None, "reading reading Reading"), (1, rows[1][1])]


def got(frame):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()), key=str)


def test_words_forms_and_roots_equal_brute_force(spark):
    rows = sample()
    assert got(variants.variants(docs(spark, rows))) == brute(brute_counts(rows))


def test_chains_ties_and_any_alphabet(spark):
    counts = {"aaaaaab": 1000, "aaaaaac": 1000, "aaaaabb": 90, "aaaabbb": 9, "aaaaaa": 2, "aaabbbb": 1, "漢字漢字漢字漢": 30, "漢字漢字漢字漢😀": 3}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    for symbols in (None, 4, 16):
        assert got(variants.grouped(frame, symbols=symbols)) == brute(counts)


def test_empty_tables(spark):
    assert got(variants.variants(docs(spark, []))) == []
    assert got(variants.variants(docs(spark, [(1, None), (2, "one two")]))) == []


@pytest.mark.parametrize("symbols", [2, 4, 8])
def test_neighbourhoods_are_whole_and_hold_each_string_once(monkeypatch, symbols):
    monkeypatch.setattr(variants, "AT_ONCE", 40)
    words = ["a", "ab", "abc", "aabbcc", "bbbbbb", "cabacab"]

    def key(codes):
        h = 0
        for c in codes:
            h = (h * variants._BASE + c) & (1 << 64) - 1
        return h

    reduced = {w: tuple(int(c) for c in variants._reduced([w], symbols)[0]) for w in words}
    found = {w: [] for w in words}
    for who, keys in variants.neighbourhoods(words, symbols):
        for i, k in zip(who.tolist(), keys.tolist()):
            found[words[i]].append(k)
    for w, codes in reduced.items():
        want = {codes}
        for i in range(len(codes) + 1):
            want |= {codes[:i] + (x,) + codes[i:] for x in range(1, symbols + 1)} | {codes[:i] + (x,) + codes[i + 1:] for x in range(1, symbols + 1) if i < len(codes)}
            want |= {codes[:i] + codes[i + 1:]} if i < len(codes) else set()
        assert len(found[w]) == len(set(found[w])) and set(found[w]) == {key(c) for c in want}
    assert [int(k) for k in variants.word_keys(words, symbols)] == [key(reduced[w]) for w in words]
    assert np.all(variants._reduced(["abc"], symbols) <= symbols)
