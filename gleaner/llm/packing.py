"""Packing of documents into sequences of a fixed number of tokens.

Lengths alone decide how well documents pack, and there are no more of them than a sequence has tokens, so the plan is made on
their histogram.  Patterns are up to three lengths that fill a sequence, exactly where they can.  Non-negative least squares fit how often each
pattern is to be used to the histogram, weighted by length: an active set takes the patterns along which the remaining error
falls most and refits.  The repeats are rounded, longest error first; what they leave goes, length by length from the longest, into the
sequences with room left where it fits best, whole groups of equal sequences at a time.

Every piece is numbered within its length (a count per task and length, and a running sum over tasks), and the
plan says for each range of these numbers which sequences and offset they get.  So only the histogram reaches the driver,
no document, and the plan's size depends on the width of a sequence, never on the number of documents.

Defined cases: NULL and empty texts have only the end id; texts of any length are encoded whole and cut into pieces of a full
sequence, the last one may be shorter; rows that repeat a ``doc_id``, and rows with a NULL one, are packed each; equal lengths are
interchangeable, which of them goes where follows the input's order; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleaner.llm.common import cut, small_batches, table
from gleaner.llm.pretokens import byte_letters, vocabulary_path

#: Tokens of a sequence, and the id after each document.
WIDTH, END_ID = 2048, 0
#: Words, and stretches, whose tokens a worker remembers, and the characters that one of them may have.
MEMORY, SHORT = 300_000, 64
#: Rounds of the fit, patterns that may enter in one, steps between them, and the share of the first error that ends it.
ROUNDS, ENTER, STEPS, CLOSE = 80, 256, 40, 1e-3


#: How the vocabularies that this serves split text in lower case: contractions, letters, single numerals, anything else but white space.
_L, _N, _S = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Characters that lower case or composition may turn into other numbers of characters, or whose class isn't listed here.
_WIDE = re.compile("[^\x00-\u012f\u0131-\u024f]")


class Words(dict):
    """The tokenizers library's ids, as little-endian 32-bit bytes, of words met lately.

    The vocabularies that this serves drop white space and never merge across words.  Text below U+0250 is put in lower case and
    split here, and only words that are new go to the library's model.  Of other texts, and those with a special token's
    string, each stretch between ASCII white space that has such a character or string goes to the library as it is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters = self.library.model, {b: c for c, b in byte_letters().items()}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.stretches: dict[str, bytes] = {}
        sample = "One two's 's I'll we'Ve !?''d can't 10 a1b ''re-do <|x|> \x1c\x7f~~ x'm ÀÉß ŁódŹ x²½"
        if self.whole(sample) != self.encode(sample.replace(" ", "\r\n\t ")):
            raise ValueError(f"{path} splits text in another way than by letters, numerals and white space that is dropped")

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return _kept(self, word, ids)

    def plain(self, text: str) -> bool:
        return not _WIDE.search(text) and not any(s in text for s in self.special)

    def stretch(self, text: str) -> bytes:
        if (ids := self.stretches.get(text)) is None:
            ids = _kept(self.stretches, text, self.split(text) if self.plain(text) else self.whole(text))
        return ids

    def split(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _SPLIT.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        return self.split(text) if self.plain(text) else b"".join(map(self.stretch, _BETWEEN.split(text)))


#: What stretches lie between: ASCII white space.
_BETWEEN = re.compile("[\t-\r ]+")


def _kept(memory: dict[str, bytes], key: str, ids: bytes) -> bytes:
    """``ids``, remembered unless the key is long."""
    if len(key) <= SHORT:
        if len(memory) >= MEMORY:
            memory.clear()
        memory[key] = ids
    return ids


_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "turn")])
_PIECES_DDL = "doc_id long, piece long, start long, length long, ids_crc32 long, part long, turn long"


def pieces(docs: DataFrame, width: int = WIDTH, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID) -> DataFrame:
    """A row per piece of a document: its number, ``start`` in the document's ids, ``length`` and ``ids_crc32``; ``part`` is the task
    that cut it and ``turn`` its number among that task's pieces of this length."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, turns, codec = TaskContext.get().partitionId(), Counter(), Words(vocabulary_path(vocabulary))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(codec.encode((text.as_py() or b"").decode("utf-8", "replace")) + end)
                for i, at in enumerate(range(0, len(ids), 4 * width)):
                    own = ids[at : at + 4 * width]
                    n = len(own) // 4
                    rows.append((doc, i, at // 4, n, zlib.crc32(own), part, turns[n]))
                    turns[n] += 1
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000])], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, _PIECES_DDL)


def patterns(histogram: np.ndarray) -> np.ndarray:
    """Rows of three lengths in descending order, 0 for none, that together fill a sequence; all are lengths that occur.

    Any two lengths are taken with the longest third one that has room.  A length that is in no full sequence comes with the
    fullest ones that it is in, with and without their third length, if these leave no more than a quarter of a sequence; so
    lengths that only many of fill a sequence are left to the best fit."""
    width = len(histogram) - 1
    there = np.flatnonzero(histogram[:width])
    there = there[there > 0]
    first, second = np.meshgrid(there, np.append(0, there), indexing="ij")
    fits = (first >= second) & (first + second <= width)
    first, second = first[fits], second[fits]
    most = np.minimum(second, width - first - second)
    third = np.append(0, there)[np.searchsorted(there, most, "right")]
    waste = width - first - second - third
    rows = np.stack([first, second, third], axis=1)
    least = np.full(width + 1, width)
    for place in range(3):
        np.minimum.at(least, rows[:, place], waste)
    least[0] = -1
    near = rows[(waste[:, None] == least[rows]).any(axis=1) & (waste > 0) & (waste <= width // 4)]
    near = np.unique(np.concatenate([near, near * [1, 1, 0]]), axis=0)
    return np.concatenate([rows[waste == 0], near])


def fit(rows: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative repeats of some patterns (their places in ``rows``) whose lengths come near the histogram."""
    weight = np.arange(len(histogram), dtype=float) / len(histogram)
    target, size = histogram.astype(float), len(histogram)
    active, repeats = np.zeros(0, np.int64), np.zeros(0)
    use = lambda x: np.bincount(rows[active].ravel(), np.repeat(x, 3), size) * (np.arange(size) > 0)  # noqa: E731  length 0 stands for none
    first = None
    for _ in range(ROUNDS):
        error = weight**2 * (target - use(repeats))
        gain = error[rows].sum(axis=1)
        gain[active] = 0
        best = np.argsort(-gain, kind="stable")[: 8 * ENTER]
        first = gain[best[0]] if first is None else first
        taken, entering = set(), []
        for i in best[gain[best] > CLOSE * first].tolist():  # disjoint lengths, so that one doesn't take another's error
            if taken.isdisjoint(own := set(rows[i].tolist()) - {0}):
                taken |= own
                entering.append(i)
                if len(entering) == ENTER:
                    break
        if not entering:
            break
        stay = repeats > 0
        active = np.append(active[stay], entering)
        repeats = np.append(repeats[stay], np.zeros(len(entering)))
        # projected gradient with momentum; a column's own curvature scales its step, lengths shared by many columns bound it
        shared = np.bincount(rows[active].ravel(), minlength=size)
        step = 1 / np.maximum((weight**2 * shared)[rows[active]].sum(axis=1), 1e-12)
        ahead, before = repeats, repeats
        for k in range(STEPS):
            repeats = np.maximum(0, ahead + step * (weight**2 * (target - use(ahead)))[rows[active]].sum(axis=1))
            ahead, before = repeats + k / (k + 3) * (repeats - before), repeats
    return active, repeats


def rounded(rows: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats, most used patterns first, as long as ``left`` has the lengths; takes them from ``left``."""
    plan = []
    for i in np.argsort(-repeats, kind="stable").tolist():
        pattern = Counter(x for x in rows[i].tolist() if x)
        n = min(int(repeats[i] + 0.5), *(int(left[x]) // k for x, k in pattern.items()))
        if n > 0:
            for x, k in pattern.items():
                left[x] -= n * k
            plan.append((tuple(pattern.elements()), n))
    return plan


def best_fit(left: np.ndarray, begun: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Packs the lengths of a histogram, the longest first, each where the least room remains, into sequences ``begun`` and new ones;
    equal sequences move as one group."""
    width = len(left) - 1
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms = np.zeros(width + 1, np.int64)
    for pattern, n in begun:
        groups.setdefault(width - sum(pattern), []).append((pattern, n))
        rooms[width - sum(pattern)] += n
    for length in range(width, 0, -1):
        n = int(left[length])
        while n:
            open_ = np.flatnonzero(rooms[length:])
            if not len(open_):  # new sequences, of as many of this length as fit
                each = min(width // length, n)
                groups.setdefault(width - each * length, []).append(((length,) * each, n // each))
                rooms[width - each * length] += n // each
                n -= n // each * each
                continue
            room = int(open_[0]) + length
            pattern, many = groups[room].pop()
            each = min(room // length, n)
            some = min(many, n // each)
            if some < many:
                groups[room].append((pattern, many - some))
            groups.setdefault(room - each * length, []).append((pattern + (length,) * each, some))
            rooms[room] -= some
            rooms[room - each * length] += some
            n -= some * each
    return [x for found in groups.values() for x in found]


def make_plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, none longer than ``len(histogram) - 1`` in sum, and their repeats, that use up the histogram."""
    left = histogram.astype(np.int64)
    full = [((len(left) - 1,), int(left[-1]))] if left[-1] else []
    left[-1] = 0
    rows, begun = patterns(left), []
    if len(rows):
        active, repeats = fit(rows, left)
        begun = rounded(rows[active], repeats, left)
    return full + best_fit(left, begun)


def ranges(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each range of numbers of a length, its key (length and first number), first sequence and offset; ordered by key."""
    used, found, sequence = Counter(), [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            found.append((length << 48 | used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return tuple(np.array(c, np.int64) for c in zip(*sorted(found)))


def pack(docs: DataFrame, width: int = WIDTH, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``; each sequence is filled from 0 without gaps."""
    spark = docs.sparkSession
    cut_up = cut(pieces(docs, width, vocabulary, end_id))
    counts = cut(cut_up.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(width + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row per length, width of them at most
        histogram[length] = n
    if not histogram.any():
        return cut_up.select("doc_id", F.col("piece").cast("int"), "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shared = spark.sparkContext.broadcast(ranges(make_plan(histogram)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = cut_up.join(counts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("turn")).alias("number"))

    def place(batches):
        keys, sequences, offsets = shared.value
        for batch in batches:
            key = batch.column(3).to_numpy() << 48 | batch.column(5).to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *batch.columns[2:5], pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op12_best_fit_packing": op12}
ORACLE_SQL: dict[str, str] = {}
