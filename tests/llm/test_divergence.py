"""Source divergence against dense sums over all kept terms, and against its SQL."""

import os
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from gleaner.llm import divergence


def by_force(rows, least_docs=30, top=50):
    counts, groups, held = defaultdict(Counter), set(), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least_docs]
        sources = sorted(s for k, s in groups if k == lang)
        shares = {}
        whole = sum((counts[lang, s] for s in sources), Counter())
        for name, c in [(None, whole), *((s, counts[lang, s]) for s in sources)]:
            total = sum(c[t] for t in kept)
            shares[name] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        pairs = defaultdict(list)
        for a, b in permutations(sources, 2):
            pairs[a].append((-sum(abs(shares[a][t] - shares[b][t]) for t in kept), b))
        for a in sources:
            out += [(lang, a, "pair", b, -v, i) for i, (v, b) in enumerate(sorted(pairs[a], key=lambda x: (x[0], x[1].encode())), 1)]
            more = [(shares[None][t] - shares[a][t], t) for t in kept if counts[lang, a][t] and shares[a][t] > shares[None][t]]
            out += [(lang, a, "term", t, -v, i) for i, (v, t) in enumerate(sorted(more, key=lambda x: (x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def frame(spark, rows):
    return spark.createDataFrame([(t, 7, s, k) for k, s, t in rows], "text string, term int, source string, lang string")


@pytest.mark.parametrize("seed", range(2))
def test_random_groups(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(divergence, "HELD", 50)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["Été", "été", "ÉTÉ", "Ab", "aB", "日本", "x-y", "it's", "a1b2"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "Ś4", None, ""]), " ".join(rng.choices(words, k=rng.randrange(9)))) for _ in range(150)]
    rows += [("xx", "lone", "one"), ("yy", "a", "rare"), ("yy", "b", None), ("yy", "c", "")]
    for least, top in ((1, 3), (8, 50)):
        assert found(divergence.audit(frame(spark, rows), least, top)) == by_force(rows, least, top)


def test_sources_without_kept_terms_long_texts_and_repeats(spark):
    rows = [("en", "a", "common " * 3)] * 30 + [("en", "b", "seldom")] * 2 + [("en", "c", "common " * 40_000 + "seldom " * 9)]
    got = found(divergence.audit(frame(spark, rows)))
    assert got == by_force(rows)
    assert {r[1] for r in got if r[2] == "pair"} == {"a", "b", "c"}
    assert found(divergence.audit(frame(spark, rows).limit(0))) == []


def test_shares_of_huge_counts_are_exact(spark):
    n, total, terms = 4 * 10**17 + 3, 9 * 10**17 + 11, 12_345_678
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert row.select(divergence.share(*map(divergence.F.col, ("n", "total", "terms")))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_query_against_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(f"select lang, source, part, item, value, rank from ({divergence.ORACLE_SQL['op13_source_divergence']})").fetchall()
    assert found(divergence.QUERIES["op13_source_divergence"](spark, sf)) == sorted(want)
    assert {r[2] for r in want} == {"pair", "term"}
