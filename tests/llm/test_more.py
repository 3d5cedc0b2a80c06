"""Findings of the first round: hot keys, shuffled input, NULL ids, long texts, thousands of rules."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, language, lines, urls
from test_texts import by_id, docs, lines_by_force


def test_split_keys_lose_no_link(spark):
    rng = random.Random(11)
    words = ["order", "number", "was", "sent", "today", "to", "the", "house"]
    texts = []
    for i in range(60):  # lines that share most of their segments, and differ by a number of other digits
        n = rng.randrange(10**6) if i % 3 else 123_456 + i
        texts.append(f"the order {n:06} was processed and sent to the house of the customer\n" + " ".join(rng.choice(words) for _ in range(6)))
    want = lines_by_force(dict(enumerate(texts)))
    for hot in (2, 5, lines.HOT):
        assert {i: r["dropped"] for i, r in by_id(lines.line_report(docs(spark, texts), hot)).items()} == want


def test_lines_of_repeated_rows_nulls_and_long_lines(spark):
    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(70_000))
    table = docs(spark, ["same line here, long enough\nx"] * 2 + ["same line here, long enough\ny", long, long[:100] + "#" + long[100:]], [None, None, 1, 2, 3])
    got = sorted((str(r["doc_id"]), r["dropped"], r["n_copies"], r["n_near"]) for r in lines.line_report(table).collect())
    assert got == [("1", [0], 1, 0), ("2", [], 0, 0), ("3", [0], 0, 1), ("None", [], 0, 0), ("None", [], 0, 0)]


def test_urls_of_shuffled_input_get_their_own_verdict(spark):
    n = 60_000
    kind = F.element_at(F.array(*map(F.lit, ["http://a{}.net/x", "http://m.example.net/en/{}", "http://a.com/ads/{}", "http://a.com/{}", "http://x.org/fr/{}"])), (F.col("id") % 5 + 1).cast("int"))
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.replace(kind, F.lit("{}"), F.col("id").cast("string")).alias("url")).repartition(7, "url")
    want = ["net/", "example.net/en/", None, None, "org/fr/"], ["block", "allow", "block", "allow", "allow"]
    rows = urls.filtered(pages, urls.rule_table(spark)).collect()
    assert len(rows) == n
    assert all((r["rule"], r["verdict"]) == (want[0][r["page_id"] % 5], want[1][r["page_id"] % 5]) for r in rows)


def test_thousands_of_url_rules(spark):
    import re

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    shapes = [r"(?i)[/.]{}[/.]", r"(?i)[?&]{}=", r"(?i)/{}", r"(?i)({}|zz)/", r"{}[/.]?$"]
    rules = [(rng.choice(shapes).format(w), w, rng.choice(["allow", "block"])) for w in (word() for _ in range(3000))]
    cases = [f"http://{word()}.{word()}.com/{word()}/{word()}x?{word()}=1" for _ in range(300)] + ["http://a.com/" + "x/" * 50_000 + "abc.", None]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filtered(pages, urls.rule_table(spark, [], rules)).collect()}
    tried = [(re.compile(p), v) for p, _, v in rules]
    want = {i: min({v for p, v in tried if u is not None and p.search(u)} or {"allow"}) for i, u in enumerate(cases)}
    assert got == want


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ 12 ³", "_ - !", ""])
def test_texts_without_a_letter_are_undetermined(spark, text):
    training = spark.createDataFrame([(i, "the quick fox and the dog", "en") for i in range(4)] + [(None, "der schnelle fuchs und der hund", "de")] * 4, "doc_id long, text string, lang string")
    learned = language.learn(training)
    assert set(learned) == {"en", "de"}
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in language.identify(docs(spark, [text]), learned).collect()] == [("und", 0.0, True)]


def test_contaminated_rows_without_id_go(spark):
    item = " ".join(f"i{i}" for i in range(20))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    table = docs(spark, ["so " + item, "nothing here", "first " + item, "clean", "z " * 60_000 + item], [None, None, 1, 1, 2])
    left = decontaminate.drop_contaminated(table, bench)
    assert left.columns == table.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("1", "clean"), ("None", "nothing here")]
    assert sorted(str(r["doc_id"]) for r in decontaminate.contaminated(table, bench).collect()) == ["1", "2", "None"]


def test_lines_that_share_half_of_what_they_are_known_by(spark, monkeypatch):
    rng = random.Random(21)
    words = ["order", "number", "was", "sent", "today", "to", "the", "house", "of", "a", "client"]
    texts = []
    for _ in range(40):
        line = " ".join(rng.choice(words) for _ in range(7))
        at = rng.randrange(len(line))
        texts.append("\n".join([line, line[:at] + "x" + line[at:], " ".join(rng.choice(words) for _ in range(7))]))
    want = lines_by_force(dict(enumerate(texts)))
    monkeypatch.setattr(lines, "line_hash", lambda line: F.pmod(F.xxhash64(line), F.lit(5)))
    assert {i: r["dropped"] for i, r in by_id(lines.line_report(docs(spark, texts))).items()} == want
