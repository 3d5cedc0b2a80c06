"""Periodic runs against trying every period at every place."""

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from gleaner.llm import periodic
from gleaner.llm.common import table


def by_force(words):
    """Rows of start, length, period: per period, stretches of words that equal those one period on."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        j = 0
        while j < n - p:
            s = j
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - s + p >= max(6, 4 * p):
                found.setdefault((s, j - s + p), p)
            j += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def report_by_force(doc, text, plant=True):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if plant and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_force(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    four = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *four, sha256(listed.encode()).hexdigest(), sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, letters = rng.randrange(90), rng.choice([1, 2, 2, 3, 6])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            s, p = rng.randrange(n + 1), rng.randrange(1, 20)
            for i in range(s, rng.randrange(s, n + 1)):
                words[i] = words[s + (i - s) % p]
        assert [tuple(r) for r in periodic.find_runs(np.array(words, np.int32)).tolist()] == by_force(words)


def test_grids_in_parts(monkeypatch):
    words = [0, 1] * 40 + [2, 3, 4, 5, 6] * 30 + [7] * 50
    want = by_force(words)
    for size in (1, 7, 100):
        monkeypatch.setattr(periodic, "GRID", size)
        assert [tuple(r) for r in periodic.find_runs(np.array(words, np.int32)).tolist()] == want


def test_long_texts():
    assert periodic.find_runs(np.zeros(300_000, np.int32)).tolist() == [[0, 300_000, 1]]
    period = np.random.default_rng(1).integers(0, 50, 40_000).astype(np.int32)
    found = periodic.find_runs(np.tile(period, 5)[:-7])
    assert [0, 199_993, 40_000] in found.tolist()


CASES = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "a a a a a"), (5, "a a a a a a"), (6, "x a b a b a b a b y"), (7, "É é É é É é É é É é É é"),
    (8, "a b c " * 9 + "d " + "q " * 7 + "a b c " * 9), (8, "a b c " * 9), (None, "w " * 30), (None, "w"), (-3, "u v " * 8), (9, "ä b " * 6), (10, "A a " * 8),
]


def test_report_of_defined_cases(spark):
    docs = spark.createDataFrame([(t, d, "x", 1) for d, t in CASES], "text string, doc_id long, start string, length int")
    for edit in (None, periodic.planted):
        got = sorted(map(tuple, periodic.report(docs, edit).collect()), key=str)
        assert got == sorted((report_by_force(d, t, edit is not None) for d, t in CASES), key=str)
    assert periodic.report(docs.limit(0)).collect() == []


def test_runs_and_collapsed_texts_keep_other_columns(spark):
    docs = spark.createDataFrame([(t, d, "x", 1) for d, t in CASES], "text string, doc_id long, start string, `a.b` int")
    got = sorted((tuple(r) for r in periodic.runs(docs).collect()), key=str)
    assert got == sorted(((d, *r) for d, t in CASES for r in by_force((t or "").encode().split())), key=str)
    short = periodic.collapse(docs)
    assert short.columns == docs.columns
    rows = {(r["doc_id"], r["start"], r["a.b"]): r["text"] for r in short.collect() if r["doc_id"] not in (8, None)}
    assert rows[1, "x", 1] is None and rows[3, "x", 1] == CASES[2][1] and rows[5, "x", 1] == "a" and rows[6, "x", 1] == "x a b y" and rows[10, "x", 1] == "A a"


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = [report_by_force(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect() if len(r["text"] or "") < 12_000]
    got = {r["doc_id"]: tuple(r) for r in periodic.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert len(got) == 200 and all(got[r[0]] == r for r in want)
    assert sum(r[1] > 0 for r in want) > 5
