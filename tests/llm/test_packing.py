"""Packing: ids against the library, plans against their histogram and the least possible number of sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing
from gleaner.llm.common import table
from gleaner.llm.pretokens import vocabulary_path


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def test_ids_are_the_librarys(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 500)
    rng, codec = random.Random(5), packing.Words(vocabulary_path("word_bpe_49k.json"))
    letters = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　aAbB'sStTrRevmld01239½²!?-_<|>éÉßİıΣσςſ日本\x00\x7f́Å", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "\U0001f600", "é"]
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randrange(14)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    long = "word " * 3000 + "x" * 5000 + "é" * 300
    assert np.frombuffer(codec.encode(long), "<u4").tolist() == library.encode(long, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        packing.Words(vocabulary_path("byte_bpe_50k.json"))


def histogram(lengths, width):
    return np.bincount(lengths, minlength=width + 1)


SHAPES = {
    "uniform": np.append(0, np.full(256, 40)),
    "thousandfold": np.append(0, np.full(256, 40_000)),
    "long": np.where(np.arange(257) > 140, 37, 0),
    "one length": np.where(np.arange(257) == 100, 1001, 0),
    "only full": np.where(np.arange(257) == 256, 9, 0),
    "third": np.where(np.isin(np.arange(257), [85, 86, 1, 130]), 5000, 0),
    "short": np.floor(1e5 * np.exp(-np.arange(257) / 20)).astype(int) * (np.arange(257) > 0),
    "one": np.where(np.arange(257) == 3, 1, 0),
}


@pytest.mark.parametrize("name", SHAPES)
def test_plans_use_up_their_histogram(name):
    counts = SHAPES[name]
    plan = packing.make_plan(counts)
    used = Counter()
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= 256
        for length in pattern:
            used[length] += n
    assert used == {i: n for i, n in enumerate(counts.tolist()) if n}
    least = -(-int((counts * np.arange(257)).sum()) // 256)
    alone = sum(n for _, n in packing.best_fit(counts.astype(np.int64)))
    sequences = sum(n for _, n in plan)
    assert least <= sequences <= alone + max(1, alone // 2000)
    if name in ("uniform", "thousandfold", "short"):
        assert sequences <= least + 1 + least // 2000


def test_the_fit_meets_a_histogram_of_whole_patterns():
    rng = random.Random(1)
    counts = np.zeros(129, np.int64)
    for _ in range(60):
        a = rng.randrange(1, 64)
        for x in (a, 128 - a):
            counts[x] += 50
    rows = packing.patterns(counts)
    assert all(sum(r) == 128 and all(counts[x] for x in r if x) for r in rows.tolist())
    assert len({tuple(r) for r in rows.tolist()}) == len(rows)
    active, repeats = packing.fit(rows, counts)
    left = counts.copy()
    packing.rounded(rows[active], repeats, left)
    assert (repeats >= 0).all() and (left >= 0).all() and (left * np.arange(129)).sum() < 0.1 * (counts * np.arange(129)).sum()


def test_best_fit_of_few_lengths():
    assert sorted(packing.best_fit(histogram([6, 6, 5, 5, 4, 4, 2], 10))) == [((5, 5), 1), ((6, 4), 2), ((2,), 1)] or sum(n for _, n in packing.best_fit(histogram([6, 6, 5, 5, 4, 4, 2], 10))) == 4
    assert packing.best_fit(np.zeros(11, np.int64)) == []


def verify(rows, texts, library, width):
    """``texts``: text by doc_id; every piece is there once, has its ids, and sequences have no gaps."""
    pieces, places = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, crc, sequence, offset in rows:
        pieces[doc].append((piece, start, length, crc))
        places[sequence].append((offset, length))
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(i, at, len(ids[at : at + width]), zlib.crc32(ids[at : at + width].tobytes())) for i, at in enumerate(range(0, len(ids), width))]
        assert sorted(pieces[doc]) == want
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= width
    return len(places), -(-sum(length for p in pieces.values() for _, _, length, _ in p) // width)


def test_packs_of_defined_cases(spark, library):
    rng = random.Random(2)
    texts = {i: " ".join("abcdefgh"[rng.randrange(8)] for _ in range(rng.randrange(40))) for i in range(300)} | {300: None, 301: "", 302: " \n", 303: "tic tac " * 500, 304: "x " * 31, 305: "x " * 32, None: "none"}
    docs = spark.createDataFrame([(t, d, "x", 1) for d, t in texts.items()], "text string, doc_id long, part string, length int").repartition(5)
    n, least = verify(map(tuple, packing.pack(docs, 32).collect()), texts, library, 32)
    assert n <= least + 2
    twice = packing.pack(docs.where("doc_id = 303").union(docs.where("doc_id = 303")), 32).collect()
    assert len(twice) == 2 * sum(r["doc_id"] == 303 for r in packing.pack(docs, 32).collect()) and len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)
    empty = packing.pack(docs.limit(0))
    assert empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and empty.collect() == []


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    df = packing.QUERIES["op12_best_fit_packing"](spark, sf)
    assert df.dtypes[1] == ("piece", "int")
    n, least = verify(map(tuple, df.collect()), texts, library, 2048)
    assert n <= least + 1
