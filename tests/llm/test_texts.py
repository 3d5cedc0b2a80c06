"""Language ID, exact and near dedup, decontamination and lines, on edge cases and against brute force."""

import collections
import itertools
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import decontaminate, exact, language, lines, minhash

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, h long, __at string, doc string, __found string"
SPACE = " \t\n\x0b\x0c\r"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with names used inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, 1, "k", 2, "at", "d", "f") for i, t in zip(ids, texts)], EXTRA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- language ----------------------------------------------------------------------------------------------------------

ENGLISH = "the quick brown fox jumps over the lazy dog and then the fox walks away from the house with the other dogs "
GERMAN = "der schnelle braune fuchs springt über den faulen hund und dann geht der fuchs mit den anderen hunden vom haus weg "


def shuffled(text, seed):
    words = text.split() * 3
    random.Random(seed).shuffle(words)
    return " ".join(words)


def test_language(spark):
    training = spark.createDataFrame([(i, shuffled(ENGLISH, i), "en") for i in range(8)] + [(10 + i, shuffled(GERMAN, i), "de") for i in range(5)] + [(99, None, "fr"), (98, "1 2", "xx"), (97, "abc", None)], "doc_id long, text string, lang string")
    learned = language.learn(training)
    assert list(learned) == ["en", "de"]
    got = by_id(language.identify(docs(spark, [shuffled(ENGLISH, 77), shuffled(GERMAN, 78), None, "", "12 !?", shuffled(GERMAN, 79).upper() * 50]), learned))
    assert [got[i]["lang_pred"] for i in range(6)] == ["en", "de", "und", "und", "und", "de"]
    assert [got[i]["rejected"] for i in range(6)] == [False, False, True, True, True, False]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_training(spark):
    none = language.learn(docs(spark, ["a"]).where("false"))
    assert none == {}
    assert [r["lang_pred"] for r in language.identify(docs(spark, ["abc"]), none).collect()] == ["und"]
    assert language.language_id(docs(spark, ["a"]).where("false")).collect() == []


def test_language_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.language_id(table).where(language.held_out(F.col("doc_id")))
    good, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert good / n > 0.97


# -- exact -------------------------------------------------------------------------------------------------------------


def exact_by_force(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate({ord(c): None for c in SPACE})].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "one hex digit: hits that are none"])
def test_exact(spark, digest):
    texts = ["a b", "ab", "a\tb ", None, "", " \n", "x", "y", "ab\xa0", "é e", "ée"] + ["same"] * 20 + [str(i) for i in range(30)] + ["z" * 50_000, "z " * 50_000]
    want = exact_by_force(enumerate(texts))
    got = exact.exact_groups(docs(spark, texts), digest).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_repeated_rows_and_nulls(spark):
    table = docs(spark, ["a", "a", "a", "b"], [1, 1, None, None])
    left = exact.drop_copies(table)
    assert left.columns == table.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("1", "a"), ("None", "b")]
    assert exact.drop_copies(table.where("false")).collect() == []


# -- near --------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_by_force(texts, similarity=85):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (4, 30, 120, 400)]
    texts = [None, "", " \t", "one two", "ONE two", "one two three four", "word"]
    for base in bases:
        for k in range(25):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 20)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append((" " if k % 2 else "\n").join(words))
    got = by_id(minhash.near_components(docs(spark, texts)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == near_by_force(dict(enumerate(texts)))
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


@pytest.mark.parametrize("found_first", [lambda p: p.where("false"), lambda p: p.where("(a + b) % 3 = 0")])
def test_near_links_that_the_first_pass_leaves_are_found_by_roots(spark, monkeypatch, found_first):
    rng, known, calls, graphs = random.Random(6), minhash.confirmed, [], []
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = [" ".join(base[:i] + [f"x{i % 9}"] + base[i + 1 :]) for i in range(0, 120, 4)] * 2

    def confirmed(pairs, *rest):
        calls.append(1)
        return found_first(known(pairs, *rest)) if len(calls) == 1 else known(pairs, *rest)

    def linked(links, known=minhash.components):
        graphs.append(links.count())
        return known(links)

    monkeypatch.setattr(minhash, "confirmed", confirmed)
    monkeypatch.setattr(minhash, "components", linked)
    got = by_id(minhash.near_components(docs(spark, texts)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == near_by_force(dict(enumerate(texts)))
    assert len(graphs) == 2 and {r["component_id"] for r in got.values()} == {0}


def test_near_stage_links_pairs_from_80_percent(spark):
    rng = random.Random(8)
    texts = []
    for i in range(60):
        one = [f"w{rng.randrange(10**6)}" for _ in range(104)]  # 100 shingles; 10 new ones leave 90 of 110, 11 leave 89 of 111, 12 leave 88 of 112
        n = (10, 11, 12)[i % 3]
        texts += [" ".join(one), " ".join(one[:-n] + [f"x{i}-{j}" for j in range(n)])]
    table = docs(spark, texts)
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table, "").collect()}
    assert left == {i for i in range(120) if i % 2 == 0 or i % 6 == 5}
    assert minhash.near_components(table).where("NOT kept").count() == 0


def test_near_repeated_rows_and_nulls(spark):
    table = docs(spark, ["a b c d e f"] * 4 + [None], [3, 3, 5, None, None])
    left = minhash.drop_near(table)
    assert left.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "3", "None", "None"]
    assert minhash.near_components(table.where("false")).collect() == []


def test_sketches_never_exceed_the_difference():
    rng = random.Random(3)
    for n in (5, 300, 3000):
        a = minhash.np.unique(minhash.np.array([rng.getrandbits(64) for _ in range(n)], minhash.np.uint64))
        b = minhash.np.unique(minhash.np.append(a[n // 10 :], minhash.np.array([rng.getrandbits(64) for _ in range(n // 12)], minhash.np.uint64)))
        x, y = minhash.sketch(a), minhash.sketch(b)
        if len(x) == len(y):
            assert sum(bin(int(p) & (2**64 - 1)).count("1") for p in x ^ y) <= len(minhash.np.setxor1d(a, b))


# -- decontamination ---------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(500)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    edited = [w if i % 6 else "changed" for i, w in enumerate(item)]
    fewer = [w for i, w in enumerate(item) if i % 7]
    cases = {0: noise(300) + item + noise(200), 1: noise(50) + edited, 2: fewer + noise(20), 3: noise(500), 4: item[:6] + noise(100), 5: [w.upper() for w in item]}
    texts = [", ".join(w) for w in cases.values()] + [None, ""] + [" ".join(noise(10) + item) for _ in range(60)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (None, " ".join(noise(20))), (10, " ".join(item))], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, texts), bench).collect()
    assert {r["doc_id"] for r in found} == {0, 1, 2, 5} | set(range(8, 68))
    assert {r["item_id"] for r in found} == {7, 10}
    left = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 6, 7]
    assert decontaminate.contaminated(docs(spark, texts), bench.where("false")).collect() == []
    assert decontaminate.contaminated(docs(spark, texts).where("false"), bench).collect() == []


def test_many_edited_copies_and_few_verbatim_ones(spark):
    rng = random.Random(4)
    item = [f"i{i}" for i in range(38)]
    noise = lambda n: [f"v{rng.randrange(500)}" for _ in range(n)]
    edited = [w if i % 6 else "changed" for i, w in enumerate(item)]
    cases = [noise(9) + item for _ in range(3)] + [noise(5) + edited + noise(5) for _ in range(200)] + [noise(60) for _ in range(1500)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, [" ".join(w) for w in cases]), bench).collect()
    assert {r["doc_id"] for r in found} == set(range(203))


def test_short_items(spark):
    item = [f"i{i}" for i in range(15)]
    texts = [" ".join(f"c{i}" if i % 4 == 3 else w for i, w in enumerate(item)), "so Two Words it is", "two of them, words", "one", "two"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "two words"), (3, "one"), (4, "-")], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"], round(r["score"], 2)) for r in found} == {(0, 1, 0.7), (1, 2, 1.0), (3, 3, 1.0)}


def test_contaminated_is_alignment_with_every_document(spark):
    rng = random.Random(12)
    noise = lambda n: [f"v{int(rng.expovariate(0.05))}" for _ in range(n)]
    items = [noise(n) for n in (4, 5, 9, 15, 20, 38, 60)]
    cases = [noise(rng.randrange(1, 200)) for _ in range(100)]
    for _ in range(300):
        copy = [w for w in rng.choice(items)]
        for _ in range(rng.randrange(len(copy))):
            i = rng.randrange(len(copy))
            copy[i : i + rng.choice([0, 1, 1])] = noise(rng.choice([0, 1, 1]))
            copy = copy or ["x"]
        cases.append(noise(rng.randrange(40)) + copy + noise(rng.randrange(40)))
    cases += [[x for w in item for x in (w, "added")] for item in items]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontaminate.contaminated(docs(spark, [" ".join(w) for w in cases]), bench).collect()}
    want = {}
    for i, item in enumerate(items):
        want |= {(d, i): round(x, 9) for d, x in enumerate(decontaminate.align([(item, w) for w in cases]).tolist()) if x >= decontaminate.SCORE}
    assert got == want


def test_alignment_is_smith_waterman():
    def slow(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h)) / (2 * len(a))

    rng = random.Random(2)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(1, 12))], [rng.choice("abcd") for _ in range(rng.randint(1, 20))]) for _ in range(200)]
    assert [round(x, 9) for x in decontaminate.align(pairs)] == [round(slow(a, b), 9) for a, b in pairs]


# -- lines -------------------------------------------------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def lines_by_force(texts):
    first = {}
    for d, t in texts.items():
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(SPACE):
                first.setdefault(line, (d, n))
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([x for x in first if len(x) >= lines.LEAST], 2):
        if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
            x, y = sorted((find(a), find(b)), key=first.get)
            root[y] = x
    return {d: [n for n, x in enumerate((t or "").split("\n")) if x.strip(SPACE) and (d, n) != first[find(x)]] for d, t in texts.items()}


def test_lines(spark):
    rng = random.Random(4)
    letters = "abcdé "
    bases = ["".join(rng.choice(letters) for _ in range(n)) for n in (19, 20, 21, 22, 23, 40, 70)]

    def edited(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s))
            s[i : i + rng.randrange(2)] = rng.choice(["", "x", "y"])
        return "".join(s)

    texts = ["\n".join([edited(rng.choice(bases)) for _ in range(4)] + ["", "short", "  "]) for _ in range(30)] + [None, "", "\n\n"]
    got = by_id(lines.line_report(docs(spark, texts)))
    assert {i: r["dropped"] for i, r in got.items()} == lines_by_force(dict(enumerate(texts)))
    assert all(r["n_copies"] + r["n_near"] == len(r["dropped"]) for r in got.values())
    cleaned = lines.drop_lines(docs(spark, texts))
    assert cleaned.columns == docs(spark, []).columns
    want = {i: t if not got[i]["dropped"] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in got[i]["dropped"]) for i, t in enumerate(texts)}
    assert {i: r["text"] for i, r in by_id(cleaned).items()} == want
    assert lines.line_report(docs(spark, texts).where("false")).collect() == []


def test_edit_distance(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "c", "🎉"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        assert all(r["w"] == (distance(r["a"], r["b"]) <= edits) for r in df.select("a", "b", lines.within(F.col("a"), F.col("b"), edits).alias("w")).collect())


def test_exact_copies_that_joins_and_generators_make(spark, tmp_path):
    docs(spark, ["a b", "a  b", "c", None, ""]).write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    twice = [table.crossJoin(spark.range(2).select(F.lit(0))), table.withColumn("f", F.explode(F.array(F.lit("p"), F.lit("q")))), table.union(table), table.join(table.select("doc_id").union(table.select("doc_id")), "doc_id")]
    for many in twice:
        found = exact.exact_groups(many).collect()
        assert len(found) == 10 and sum(r["kept"] for r in found) == 3 and {r["group_size"] for r in found} == {2, 4}
        left = exact.drop_copies(many)
        assert left.columns == many.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3"]
    assert exact.scanned(table.where("doc_id > 1").select("doc_id", "text")) and not any(map(exact.scanned, twice))


def test_exact_columns_named_like_the_locator(spark):
    table = spark.createDataFrame([(1, "x", "same", 3), (2, "x ", "same", 3), (3, "y", "same", 3)], "doc_id long, text string, __at string, best int")
    assert sorted(r["doc_id"] for r in exact.drop_copies(table).collect()) == [2, 3]
    assert sorted((r["doc_id"], r["kept"]) for r in exact.exact_groups(table.select("doc_id", "text")).collect()) == [(1, False), (2, True), (3, True)]


def test_near_stage_compares_every_text_of_an_id(spark):
    """Several texts of one id: each is compared, and a row goes only for what its own text is near to."""
    rng = random.Random(12)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    table = docs(spark, [a, a + " more", b, b + " end", c, c + " last", None, a], [1, 2, 2, 2, 3, 4, 4, None])
    left = minhash.drop_near(table)
    assert left.columns == table.columns
    got = collections.Counter((r["doc_id"], "near" if r["text"] is None else r["text"].split()[0]) for r in left.collect())
    # one of each pair of near texts stays, whatever their ids; empty texts and rows without an id stay
    heads = collections.Counter(k[1] for k in got if k[0] is not None)
    assert heads[a.split()[0]] == heads[b.split()[0]] == heads[c.split()[0]] == 1
    assert (4, "near") in got and (None, a.split()[0]) in got and sum(got.values()) == 5


def test_results_do_not_depend_on_how_rare_words_seem(spark, monkeypatch):
    from collections import Counter

    table, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    found = lambda: sorted((r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.contaminated(table, bench).collect())
    want, counts = found(), decontaminate.usual(table)
    for other in (Counter(), Counter({w: 10**6 - n for w, n in counts.items()})):
        monkeypatch.setattr(decontaminate, "usual", lambda docs, other=other: other)
        assert found() == want and want


def test_stages_leave_little_in_python_workers(spark):
    """No workers of a second kind beside those of Arrow functions, no pandas in any, and few words remembered."""
    benchmark = spark.createDataFrame([(1, ENGLISH)], "item_id long, text string")
    written = spark.range(4).selectExpr("id AS doc_id", "'some words' AS text")  # made in the JVM
    plan = decontaminate.copies_found(written, benchmark)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ExistingRDD" not in plan and "LogicalRDD" not in plan
    code = "import sys; import gleaner.llm.language; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2]).returncode == 0
    found = spark.range(1).select(language.predictor(spark, {})(F.lit("a")).alias("x"))
    assert "pandas" not in found._jdf.queryExecution().toString().lower() and found.first()["x"] == ("und", 0.0)
    hashes = minhash.WordHashes()
    for i in range(300_000):
        hashes[b"%d" % i]
    assert len(hashes) <= 60_000 and hashes[b"7"] == minhash.WordHashes()[b"7"]


@pytest.mark.parametrize("query", ["op2", "pipeline"])
def test_what_the_sample_leaves_unread_is_searched(spark, monkeypatch, query):
    """A copy behind the sample's texts and characters is found with its score, by op2 and by the pipeline's stage."""
    item = "seven quiet otters carried a brass lantern across the frozen river before dawn".split()
    texts = [f"plain text {i}" for i in range(decontaminate.SAMPLE_TEXTS + 50)]
    texts[-1] = "word " * decontaminate.SAMPLE_CHARS + " ".join(w if i % 5 else "other" for i, w in enumerate(item)) + " end"
    table, bench = docs(spark, texts), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for limits in ((decontaminate.SAMPLE_TEXTS, decontaminate.SAMPLE_CHARS), (1, 1)):
        monkeypatch.setattr(decontaminate, "SAMPLE_TEXTS", limits[0])
        monkeypatch.setattr(decontaminate, "SAMPLE_CHARS", limits[1])
        if query == "op2":
            found = [(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.contaminated(table, bench).collect()]
            last = table.agg({"doc_id": "max"}).first()[0]
            assert found == [(last, 7, round(float(decontaminate.align([(item, decontaminate.words(texts[-1]))])[0]), 9))]
        else:
            left = decontaminate.drop_contaminated(table, bench)
            assert sorted(r["text"] for r in left.collect()) == sorted(texts[:-1])
