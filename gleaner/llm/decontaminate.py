"""Benchmark decontamination: Smith-Waterman alignment wherever a copy can be.

A local alignment score of half the item's own score is contamination, which finds copies with edited, missing or
added words.  The result is that of aligning every document with every item; three exact conditions choose
where to look, and none of them leaves out a copy within the score:

* A copy of an item of ``n`` words keeps at least half of them and spans no more than ``2 * n`` words.  So
  it keeps at least ``KEYS`` of any ``n / 2 + KEYS`` words of the item; the rarest ones are its key words, and a place
  is looked at only if so many of them are that near each other.
* A copy loses no more of the item's distinct words than of its words, and its score is no more than the best run with 2 for each word that the item has and -1 for any other.
* What remains is aligned with the item word by word, in the same scan; only scores of copies leave it.

How rare words are is estimated from a bounded number of texts; it changes the cost and never the result.
The benchmark is read in blocks of bounded size; only a block is ever sent to the executors.

Defined cases: NULL or empty texts hold no passage; texts of any length are looked at whole; items with NULL id, or without
words, identify nothing and give no rows; items of fewer than four words count only where they stand whole; repeated rows of a
``doc_id``, and all rows with a NULL one, count as that document, and of an ``item_id`` as that item, with the best score of
any, but rows go or stay by their own text; equal items of other ids each get their row; other columns don't matter; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.common import cut, free, small_batches, table, unmatched

#: Items of fewer words only count where they stand whole: half of them is no copy of anything.
WORDS = 4
#: Key words that a place must hold (or all that a copy must keep, if these are fewer).
KEYS = 4
#: Texts, and characters of each, that tell how rare words are.
SAMPLE_TEXTS, SAMPLE_CHARS = 1000, 10_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score, as a share of the item's score against itself.
SCORE = 0.5
#: Bounds of a block of the benchmark.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16 << 20
#: Words of passages that are held, and aligned at once.
BATCH_WORDS = 400_000

WORD = re.compile(r"\w+")
_SCORED = "doc_id long, th long, item_id long, score double"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def least_score(n: int) -> float:
    """The score that makes a copy of an item of ``n`` words."""
    return SCORE if n >= WORDS else 1.0


#: An item's id and words.
Item = tuple[int, list[str]]


def blocks(benchmark: DataFrame) -> Iterator[dict[int, Item]]:
    """The distinct items, numbered, in blocks within BLOCK_ITEMS and BLOCK_CHARS (a longer item is its own block)."""
    block: dict[int, Item] = {}
    chars = 0
    for item, text in benchmark.select("item_id", "text").where("item_id IS NOT NULL").distinct().toLocalIterator():
        found = words(text)
        if not found:
            continue
        if block and (len(block) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = {}, 0
        block[len(block)] = (item, found)
        chars += len(text)
    if block:
        yield block


class Finder:
    """The items of a block as word ids, and for each word the items that it is a key word of."""

    def __init__(self, block: dict[int, Item], often: Counter[str]):
        self.ids: dict[str, int] = {}
        self.items = {k: [self.ids.setdefault(w, len(self.ids)) for w in found] for k, (_, found) in block.items()}
        self.names = {k: name for k, (name, _) in block.items()}
        self.sets = {k: frozenset(coded) for k, coded in self.items.items()}
        uses = Counter(w for _, found in block.values() for w in set(found))
        lists: dict[int, list[int]] = defaultdict(list)
        self.width, self.keys, self.least, self.distinct = (np.zeros(len(block), np.int64) for _ in range(4))
        for k, (_, found) in block.items():
            n = len(found)
            self.least[k] = least = int(np.ceil(least_score(n) * MATCH * n))
            kept = -(-least // MATCH)  # the words that a copy keeps
            self.keys[k] = min(KEYS, kept)
            self.distinct[k] = len(self.sets[k]) - (n - kept)  # the distinct words that a copy has at least
            self.width[k] = (MATCH + 1) * n - least  # the words that it spans: every word that isn't kept costs 1
            rarest = sorted(found, key=lambda w: ((often[w] + 1) * uses[w], w))[: n - kept + int(self.keys[k])]
            for word in set(rarest):
                lists[self.ids[word]].append(k)
        self.count = np.array([len(lists[i]) for i in range(len(self.ids))], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.flat = np.array([k for i in range(len(self.ids)) for k in lists[i]], np.int64)

    def places(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Items and first positions of enough key words within the width of a copy."""
        known = (ids >= 0).nonzero()[0]
        count = self.count[ids[known]]
        known, count = known[count > 0], count[count > 0]
        if not len(known):
            return []
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.flat[np.repeat(self.first[ids[known]], count) + within]
        event = np.sort(item << 40 | np.repeat(known, count))
        item, at = event >> 40, event & ((1 << 40) - 1)
        last = np.arange(len(event)) + self.keys[item] - 1
        inside = last < len(event)
        last[~inside] = 0
        good = inside & (item[last] == item) & (at[last] - at < self.width[item])
        return list(zip(item[good].tolist(), at[good].tolist()))

    def passages(self, found: list[str]) -> Iterator[tuple[int, list[int]]]:
        """Items and the passages, as word ids, that may hold a copy of them."""
        ids = np.fromiter(map(self.ids.get, found, repeat(-1)), np.int64, len(found))
        listed = ids.tolist()
        for item, block in dict.fromkeys((item, at // len(self.items[item])) for item, at in self.places(ids)):
            n, width, own = len(self.items[item]), int(self.width[item]), self.sets[item]
            passage = listed[max(0, block * n - width) : (block + 1) * n + width]
            if len(own.intersection(passage)) < self.distinct[item]:
                continue
            # an upper bound of the score, whatever the order: each word of the item counts as a match, each other as an edit
            best = run = 0
            for x in passage:
                run = run + MATCH if x in own else max(run + GAP, 0)
                best = max(best, run)
            if best >= self.least[item]:
                yield item, passage


def usual(docs: DataFrame) -> Counter[str]:
    """How often words are in some texts."""
    some = docs.select(F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS).alias("text")).where("text IS NOT NULL").limit(SAMPLE_TEXTS)
    return Counter(w for (text,) in some.toLocalIterator() for w in words(text))


def scan(docs: DataFrame, finder) -> DataFrame:
    """``doc_id``, ``item_id`` and ``score`` of every passage that is a copy of an item."""

    def find(batches):
        own = finder.value
        for batch in batches:
            pairs: list[tuple[tuple, int, list[int]]] = []
            held = 0
            for doc, text, th in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for item, passage in own.passages(words(text)):
                    pairs.append(((doc, th), item, passage))
                    held += len(passage)
                    if held >= BATCH_WORDS:
                        yield copies(own, pairs)
                        pairs, held = [], 0
            yield copies(own, pairs)

    def copies(own, pairs):
        pairs = sorted(pairs, key=lambda x: (len(own.items[x[1]]), len(x[2])))
        rows = []
        while pairs:
            most = min(256, max(1, BATCH_WORDS // len(pairs[min(256, len(pairs)) - 1][2])))
            part, pairs = pairs[:most], pairs[most:]
            value = align([(own.items[item], passage) for _, item, passage in part])
            rows += [(*doc, own.names[item], x) for (doc, item, _), x in zip(part, value.tolist()) if x >= least_score(len(own.items[item]))]
        columns = zip(*rows) if rows else ((), (), (), ())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["doc_id", "th", "item_id", "score"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(find, _SCORED)


def align(pairs: list[tuple[list, list]]) -> np.ndarray:
    """Best local alignment score of each (item, passage), as a share of the item's score against itself."""
    ids: dict = {}
    number = lambda found: [ids.setdefault(w, len(ids)) for w in found]
    coded = [(number(a), number(b)) for a, b in pairs]
    m, n = max(len(a) for a, _ in coded), max(len(b) for _, b in coded)
    items, passages = np.full((len(pairs), m), -1, np.int32), np.full((len(pairs), n), -2, np.int32)
    for i, (a, b) in enumerate(coded):
        items[i, : len(a)], passages[i, : len(b)] = a, b
    step = -GAP * np.arange(n, dtype=np.int32)
    above = np.zeros((len(pairs), n + 1), np.int32)
    best = np.zeros(len(pairs), np.int32)
    for k in range(m):
        row = np.maximum(above[:, :-1] + np.where(passages == items[:, k, None], MATCH, MISMATCH), above[:, 1:] + GAP)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + step, axis=1) - step  # gaps within the row
        best = np.maximum(best, row.max(axis=1))
        above[:, 1:] = row
    return best / (MATCH * np.array([len(a) for a, _ in coded]))


def copies_found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``th`` (hash of the text), ``item_id`` and ``score`` of every copy of an item, edited or not."""
    spark = docs.sparkSession
    small_batches(spark)
    often = usual(docs)
    found = [spark.range(0).selectExpr(*(f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, _SCORED.split(", "))))]  # no Python RDD, which has workers of its own
    for block in blocks(benchmark):
        found.append(scan(docs, spark.sparkContext.broadcast(Finder(block, often))))
    return reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id`` and ``score`` of every document that holds a copy of an item, edited or not."""
    return copies_found(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without contaminated rows."""
    row = free(docs, "__row")
    name = lambda doc, th: F.concat_ws(":", F.coalesce(doc.cast("long").cast("string"), F.lit("")), th).alias(row)
    out = cut(copies_found(docs, benchmark).select(name(F.col("doc_id"), F.col("th"))).distinct())
    return unmatched(docs.select("*", name(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")))), out, row).select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2}
ORACLE_SQL: dict[str, str] = {}
