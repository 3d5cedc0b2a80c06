"""Periodic runs: stretches of words that repeat a shorter stretch at least four times.

Every text is named at powers of two (Karp, Miller and Rosenberg): a name of level k stands for ``2**k`` words in a
row, and is made from the two names of level k - 1 that it consists of, so equal names are equal words.  Levels end where
all names differ.  For a period p, places 0, p, 2p, ... form a grid: a run of four periods has a grid place whose next ``2**k`` words
(``p < 2**k <= 2p``) are those p words further on.  Such places in a row are one run, and less than p words are missing
on either side of it, which descending levels add, each used once.  Nothing is hashed for comparison and no suffix is sorted.

Defined cases: NULL, empty and blank texts have no words and no runs; words are split at ``[\\x20\\x09-\\x0D]`` only and compared as
bytes; texts of any length are named whole (a level takes four bytes a word, grid places are made ``GRID`` at a time); ties for the
strongest run go to the smallest start, then period; each of several rows of one ``doc_id``, and each with a NULL one, gives its own
row; an empty table gives no rows; ``collapse`` keeps every other column, whatever its name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.common import small_batches, table

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Grid places that are compared at a time.
GRID = 1 << 20


def coded(words: list[bytes]) -> np.ndarray:
    """A number for every word, the same for equal words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def named(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Names of level 0, 1, 2, ...: equal where the next 1, 2, 4, ... words are; ends before a level without equal names."""
    names, width = codes, 1
    yield names
    while 2 * width <= len(codes):
        left, right = names[:-width].astype(np.int64), names[width:]
        known, names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)
        if len(known) == len(names):
            return
        names, width = names.astype(np.int32), 2 * width
        yield names


def grids(first: int, last: int, n: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods from first to last and their grid places, of which ``width`` words and those one period on are within n words."""
    periods = np.arange(first, last + 1)
    places = np.maximum((n - periods - width) // periods + 1, 0)
    parts = np.cumsum(places) // GRID
    for part in range(int(parts[-1]) + 1):
        some, count = periods[parts == part], places[parts == part]
        period = np.repeat(some, count)
        before = np.repeat(np.cumsum(count) - count, count)
        yield period, period * (np.arange(len(period)) - before)


def find_runs(codes: np.ndarray) -> np.ndarray:
    """All runs of a sequence, as rows of start, length and smallest period, in order of start and period."""
    n, found = len(codes), [np.zeros((0, 3), np.int64)]
    levels: list[np.ndarray] = []
    for k, names in enumerate(named(codes) if n >= LEAST_WORDS else ()):
        levels.append(names)
        width, longest = 1 << k, min((1 << k) - 1, n // LEAST_PERIODS)
        if k == 0 or longest < width // 2:
            continue
        for period, place in grids(width // 2, longest, n, width):
            hit = names[place] == names[place + period]
            period, place = period[hit], place[hit]
            if not len(place):
                continue
            follows = (period[1:] == period[:-1]) & (place[1:] == place[:-1] + period[1:])
            start, p = place[np.append(True, ~follows)], period[np.append(True, ~follows)]
            stop = place[np.append(~follows, True)] + width
            for i in range(k - 1, -1, -1):
                step, level = 1 << i, levels[i]
                at = np.maximum(start - step, 0)
                start = np.where((start >= step) & (level[at] == level[at + p]), start - step, start)
                room = stop + step + p <= n
                at = np.where(room, stop, 0)
                stop = np.where(room & (level[at] == level[at + p]), stop + step, stop)
            length = stop - start + p
            long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
            found.append(np.stack([start, length, p], axis=1)[long])
    runs = np.concatenate(found)
    # a run has all multiples of its period that it is four times as long as: the smallest stays
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    again = (runs[1:, 0] == runs[:-1, 0]) & (runs[1:, 1] == runs[:-1, 1])
    runs = runs[np.append(True, ~again)[: len(runs)]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def strongest(runs: np.ndarray) -> np.ndarray:
    """The run of greatest length / period, compared exactly; then of smallest start, then period."""
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-12)]
    return max(near, key=lambda r: (Fraction(int(r[1]), int(r[2])), -r[0], -r[2]))


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those that a run holds after its first period go."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    return b" ".join(words[i] for i in np.flatnonzero(kept(len(words), runs)).tolist()) if len(runs) else b" ".join(words)


def runs(docs: DataFrame) -> DataFrame:
    """A row per run: ``doc_id``, ``start`` (word number), ``length`` and ``period``."""
    small_batches(docs.sparkSession)

    def find(batches):
        for batch in batches:
            ids, starts = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(rows := find_runs(coded((text or b"").split()))):
                    ids += [doc] * len(rows)
                    starts.append(rows)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, np.concatenate(starts).T.copy())], ["doc_id", "start", "length", "period"])

    return _texts(docs).mapInArrow(find, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with ``text`` without the repeats of runs; texts without a run stay as they are."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def short(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = text.encode().split() if text else []
            rows = find_runs(coded(words))
            out.append(collapsed(words, rows).decode() if len(rows) else text)
        return pd.Series(out, dtype=object)

    return docs.select(*[short(F.col("text").cast("string")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """Of one in ten documents, the words that take the places of its n words: from word a on, the next p repeat."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


_REPORT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")])
_REPORT_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame, edit: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """A row per document: its number of runs, the strongest one, and digests of all runs and of the collapsed text.

    ``edit`` may first put other words of the document in its words' places."""
    small_batches(docs.sparkSession)

    def row(doc: int | None, text: bytes | None) -> tuple:
        words = (text or b"").split()
        codes = coded(words)
        if edit is not None and (place := edit(doc, len(words))) is not None:
            words, codes = [words[i] for i in place.tolist()], codes[place]
        rows = find_runs(codes)
        top = [None] * 4
        if len(rows):
            start, length, period = strongest(rows).tolist()
            top = [start, length, period, 1000 * length // period]
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in rows.tolist())
        return doc, len(rows), *top, sha256(listed.encode()).hexdigest(), sha256(collapsed(words, rows)).hexdigest()

    def find(batches):
        for batch in batches:
            rows = [row(d.as_py(), t.as_py()) for d, t in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REPORT)], schema=_REPORT)

    return _texts(docs).mapInArrow(find, _REPORT_DDL)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), planted)


QUERIES = {"op11_periodic_runs": op11}
ORACLE_SQL: dict[str, str] = {}
