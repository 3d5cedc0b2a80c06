"""Byte-level BPE encoding and decoding.

A word's adjacent pairs are the leaves of a segment tree of merge ranks.  A leaf holds rank and place, so
the root is the leftmost lowest-rank merge.  A merge changes three leaves; each walks up the tree until
nothing changes.  The word is done when the root says that no pair can be merged.  The trees of a batch's new words
lie side by side in one array, so a step merges one pair in each of them.

Defined cases: NULL and empty texts have no tokens; strings of special tokens in a text become their ids, as in
the library; any text of any length round-trips; rows that repeat a ``doc_id``, and rows with a NULL one, each give their row; other
columns don't matter; an empty table gives no rows; a vocabulary file that splits text in another way is refused.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.common import small_batches, table
from gleaner.llm.pretokens import load, pretokens, splitter, vocabulary_path

#: Words whose tokens a worker remembers.
MEMORY = 400_000
_DONE = 1 << 62


def merge(ids: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """The ids after all merges."""
    n = len(ids)
    if n < 2:
        return ids
    bits = (n - 2).bit_length()
    size = 1 << bits
    low = size - 1
    pairs = [ranks.get(ids[i] << 20 | ids[i + 1]) for i in range(n - 1)]
    tree = [_DONE] * size + [_DONE if r is None else r << bits | i for i, r in enumerate(pairs)] + [_DONE] * (size - n + 1)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != _DONE:
        i = top & low
        gone = after[i]
        ids[i] = merged[top >> bits]
        ids[gone] = -1
        right = after[i] = after[gone]
        left = before[i]
        changed = [(i, _DONE), (gone, _DONE)] if gone <= low else [(i, _DONE)]
        if right < n:
            before[right] = i
            if (r := ranks.get(ids[i] << 20 | ids[right])) is not None:
                changed[0] = (i, r << bits | i)
        if left >= 0:
            r = ranks.get(ids[left] << 20 | ids[i])
            changed.append((left, _DONE if r is None else r << bits | left))
        for leaf, value in changed:
            k = size + leaf
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a < b else b
                if tree[k] == value:
                    break
                tree[k] = value
    return [x for x in ids if x >= 0]


#: Words of more bytes get a tree of their own.
WIDEST = 64


class Merger:
    """Merges many short words at once."""

    def __init__(self, byte_ids: list[int], ranks: dict[int, int], merged: list[int]):
        self.byte_ids, self.merged = np.array(byte_ids, np.int64), np.array(merged, np.int64)
        keys = np.fromiter(ranks, np.int64, len(ranks))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(ranks.values(), np.int64, len(ranks))[order]

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        """What the leaf of a pair holds; _DONE where one of its ids is -1 or no merge is known."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.values[at] << bits | place, _DONE)

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of WIDEST bytes at most."""
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            classes.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for bits, members in classes.items():
            for i, ids in zip(members, self._same_width([words[i] for i in members], bits)):
                out[i] = ids
        return out

    def _same_width(self, words: list[bytes], bits: int) -> list[list[int]]:
        size, n = 1 << bits, np.fromiter(map(len, words), np.int64, len(words))
        places = np.arange(size)
        ids = np.full((len(words), size + 1), -1, np.int64)  # the last column stands for no neighbour
        ids[:, :size][places < n[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.minimum(np.tile(places + 1, (len(words), 1)), size)
        before = np.tile(places - 1, (len(words), 1))
        after[places == n[:, None] - 1] = size
        tree = np.full((len(words), 2 * size), _DONE, np.int64)
        tree[:, size:] = self.leaf(ids[:, :-1], ids[:, 1:], places, bits)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.arange(len(words))
        while len(rows := rows[tree[rows, 1] != _DONE]):
            top = tree[rows, 1]
            i = top & (size - 1)
            gone = after[rows, i]
            ids[rows, i] = self.merged[top >> bits]
            ids[rows, gone] = -1
            right, left = after[rows, gone], before[rows, i]
            after[rows, i] = right
            some = right < size
            before[rows[some], right[some]] = i[some]
            tree[rows, size + gone] = _DONE
            tree[rows, size + i] = self.leaf(ids[rows, i], ids[rows, right], i, bits)
            some = left >= 0
            tree[rows[some], size + left[some]] = self.leaf(ids[rows[some], left[some]], ids[rows[some], i[some]], left[some], bits)
            row, node = np.concatenate([rows, rows, rows[some]]), np.concatenate([i, gone, left[some]]) + size
            for _ in range(bits):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        ids = ids[:, :-1]
        flat, stops = ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]


class Codec(dict):
    """Encoder and decoder of one vocabulary file; as a dictionary, the tokens of words met lately, as bytes of 32-bit ids."""

    def __init__(self, path: str):
        self.pieces, self.byte_ids, self.ranks, self.merged, self.special = load(path)
        self.cut = splitter(self.special)
        self.merger = Merger(self.byte_ids, self.ranks, self.merged)

    def learn(self, words: set[str]) -> None:
        """Remember the tokens of words; all others are forgotten when there are too many."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMORY:
            self.clear()
            new = list(words)
        data = [w.encode("utf-8", "replace") for w in new]
        short = [i for i, d in enumerate(data) if len(d) <= WIDEST]
        for i, ids in zip(short, self.merger([data[i] for i in short])):
            self[new[i]] = array("i", ids).tobytes()
        for w, d in zip(new, data):
            if len(d) > WIDEST:
                self[w] = array("i", merge([self.byte_ids[b] for b in d], self.ranks, self.merged)).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.cut.split(t or "") if self.cut else [t or ""] for t in texts]
        words = [[[part] if part in self.special else pretokens(part) for part in parts] for parts in split]
        self.update((s, array("i", [i]).tobytes()) for s, i in self.special.items())
        self.learn({w for text in words for part in text for w in part})
        self.update((s, array("i", [i]).tobytes()) for s, i in self.special.items())
        return [np.frombuffer(b"".join(map(self.__getitem__, chain.from_iterable(text))), np.int32).tolist() for text in words]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """A row per document: ``doc_id`` and its token ids, ``ids``."""
    small_batches(docs.sparkSession)

    def run(batches):
        codec = Codec(vocabulary_path(vocabulary))
        for batch in batches:
            ids = codec.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """A row per row of ``tokens(doc_id, ids)``: ``doc_id`` and ``text``."""
    small_batches(tokens.sparkSession)

    def run(batches):
        codec = Codec(vocabulary_path(vocabulary))
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", keep_ids: bool = False) -> DataFrame:
    """A row per document: what encoding gives, and what decoding these ids gives back, as digests; with
    ``keep_ids`` also the ids."""
    small_batches(docs.sparkSession)

    def run(batches):
        codec = Codec(vocabulary_path(vocabulary))
        digits = list(map(str, range(len(codec.pieces))))
        for batch in batches:
            rows = codec.encode_all(batch.column(1).to_pylist())
            lists = [hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest() for ids in rows]
            texts = [hashlib.sha256(codec.decode(ids).encode()).hexdigest() for ids in rows]
            out = [batch.column(0), pa.array(map(len, rows), pa.int64()), pa.array(lists, pa.string()), pa.array(texts, pa.string())]
            if keep_ids:
                out.append(pa.array(rows, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = [x.split()[0] for x in shape.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))


QUERIES = {"op3_bpe": op3}
ORACLE_SQL: dict[str, str] = {}
