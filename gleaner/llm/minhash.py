"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A text's set is its distinct five-word shingles.  A signature holds ``SYMBOLS`` minima of 12 bits.  Cut
into ``CHUNKS`` chunks, two signatures that differ in fewer than ``2 * CHUNKS`` symbols have, by the
pigeonhole principle, a chunk with at most one wrong symbol; so for every chunk and every place that the
one error may have, the chunk without that symbol is a key, and all pairs under that signature distance
share a key.  ``similarity`` and ``chunk`` (symbols of a chunk, a divisor of ``SYMBOLS``) are parameters: shorter chunks
are more chunks and a larger distance, as lower similarities need.  At a similarity of 0.85 the expected distance is 9 of 60 symbols, 5 deviations under the
bound.  Candidates within the distance are confirmed on the full sets.

Groups of copies never become all pairs.  Equal sets are one representative.  In every key, each
representative first meets only the most central one (the one whose keys are the fullest); once these
links have merged components, only pairs from different components are still looked at, each in the first
key that it shares.  Beside its signature a set has a parity sketch: each shingle flips one bit, so two
sketches differ in no more bits than the sets do in shingles, and a pair whose sketches differ in more than
a similar pair may is no candidate.  That is exact: a pair is left out only where its two ends are already
in one component, its signatures are too far apart, or its sets can't be similar.

Shingles are known by 128 bits, and equal sets by 128 bits of all of them.

Defined cases: NULL, empty and blank texts have an empty set, are linked with nothing and stay; a text
of fewer than five words is its whole sequence; texts of any length count whole; repeated rows of a ``doc_id`` are one
document, of different texts of one ``doc_id`` one (that with the smallest hash) is looked at, and all its rows get its class;
a NULL ``doc_id`` is linked with nothing and stays; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm.common import cut, free, matched, small_batches, spread_join, table, unmatched
from gleaner.operators.components import components

WORDS = 5
CHUNKS, CHUNK = 12, 5
SYMBOLS = CHUNKS * CHUNK
#: Bits of a symbol; a chunk is one 64-bit number.
BITS = 12
#: Representatives that share a key are compared in parts of so many.
ROWS_OF_A_KEY = 1000
#: Op4's contract: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85

_RNG = np.random.default_rng(20240229)
_MIX = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_PLACE = _RNG.integers(1, 2**63, (CHUNKS, CHUNK), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.arange(CHUNK, dtype=np.int64) * BITS
_MASK = _RNG.integers(1, 2**63, (CHUNKS, CHUNK), dtype=np.uint64)


class WordHashes(dict):
    """128-bit hashes of words, as bytes; emptied when it gets large."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh3_128_digest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles: two arrays of 64 bits of their hashes, sorted by both.  bytes.lower and bytes.split know A-Z
    and ASCII space only."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(hashes.__getitem__, words)), "<u8").reshape(-1, 2)
    if len(h) < WORDS:
        total = (h * _MIX[: len(h), None]).sum(axis=0, keepdims=True) + np.uint64(len(h))
    else:
        n = len(h) - WORDS + 1
        total = np.zeros((n, 2), np.uint64)
        for i in range(WORDS):
            total += h[i : i + n] * _MIX[i]
    one, two = _mixed(total[:, 0]), _mixed(total[:, 1])
    order = np.argsort(one, kind="stable")
    one, two = one[order], two[order]
    again = one[1:] == one[:-1]
    if (again & (two[1:] != two[:-1])).any():  # different shingles with the same first half
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        again = one[1:] == one[:-1]
    new = np.append(True, ~again | (two[1:] != two[:-1]))
    return one[new], two[new]


def common_items(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets have in common."""
    both, i, j = np.intersect1d(a[0], b[0], return_indices=True)
    same = int((a[1][i] == b[1][j]).sum())
    if same == len(both) and len(a[0]) == len(np.unique(a[0])) and len(b[0]) == len(np.unique(b[0])):
        return same
    return len(set(zip(*(x.tolist() for x in a))) & set(zip(*(x.tolist() for x in b))))


def signature(items: np.ndarray) -> np.ndarray:
    """BITS bits of the minima of SYMBOLS hash functions over the items."""
    low = (items >> np.uint64(32)).astype(np.uint32) ^ items.astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        x = low[i : i + 4096, None] * _MUL + _ADD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, x.min(axis=0))
    return ((least ^ (least >> np.uint32(16))) & np.uint32((1 << BITS) - 1)).astype(np.int64)


def most_distance(chunk: int) -> int:
    """Signatures that differ in more symbols than this are no candidates."""
    return 2 * (SYMBOLS // chunk) - 1


def chunk_keys(sig: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """A key for every chunk and every symbol that may be wrong: the chunk without that symbol."""
    parts = (sig.astype(np.uint64) * _PLACE.ravel()).reshape(-1, chunk)
    return _mixed((parts.sum(axis=1, keepdims=True) - parts) * np.uint64(0x9E3779B97F4A7C15) + _MASK.reshape(-1, chunk)).astype(np.int64).ravel()


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the items by the low bits of their hashes; at least two bits an item, in words of 64."""
    bits = max(512, 1 << (2 * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_SIGNED = "doc_id long, n_shingles long, th long, same binary, chunks array<long>, sketch array<long>, keys array<long>"


def _sign(batches, chunk: int):
    hashes, longs = WordHashes(), pa.list_(pa.int64())
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            items, more = shingles(text, hashes)
            out[0].append(doc)
            out[1].append(len(items))
            if len(items) and doc is not None:
                sig = signature(items)
                out[2].append(xxhash.xxh3_128_digest(items.tobytes() + more.tobytes()))
                out[3].append((sig.reshape(-1, chunk) << _SHIFT[:chunk]).sum(axis=1))
                out[4].append(sketch(items))
                out[5].append(chunk_keys(sig, chunk))
            else:
                for column in out[2:]:
                    column.append(None)
        kinds = [pa.int64(), pa.int64(), pa.binary(), longs, longs, longs]
        columns = [pa.array(x, k) for x, k in zip(out, kinds)]
        columns.insert(2, batch.column(2))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "th", "same", "chunks", "sketch", "keys"])


def _by_text(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def signed(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``th`` (hash of the text), ``same`` (digest of the whole set), ``chunks``, ``sketch`` and ``keys``; NULLs for empty sets."""
    small_batches(docs.sparkSession)
    return _by_text(docs).mapInArrow(partial(_sign, chunk=chunk), _SIGNED)


def _bits(value: int) -> Column:
    return F.lit(value).cast("long")


def errors(a: Column, b: Column) -> Column:
    """An array: in how many symbols each chunk differs."""
    low, high = (sum(x << int(i) for i in _SHIFT) for x in ((1 << (BITS - 1)) - 1, 1 << (BITS - 1)))

    def wrong(x: Column) -> Column:  # a symbol that isn't zero carries into, or has, its highest bit
        return F.bit_count((x.bitwiseAND(_bits(low)) + _bits(low)).bitwiseOR(x).bitwiseAND(_bits(high)))

    return F.zip_with(a, b, lambda x, y: wrong(x.bitwiseXOR(y)))


def _fold(sk: Column) -> Column:
    """The sketch of half as many bits."""
    half = (F.size(sk) / 2).cast("int")
    return F.zip_with(F.slice(sk, F.lit(1), half), F.slice(sk, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def can_be_similar(na: Column, nb: Column, ska: Column, skb: Column, similarity: int = SIMILARITY) -> Column:
    """Whether sizes and sketches allow the similarity: sets of n and m items may differ in
    (100 - similarity) / (100 + similarity) * (n + m) items."""
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    bits = (
        F.when(F.size(ska) == F.size(skb), differ(ska, skb)).when(F.size(ska) == 2 * F.size(skb), differ(_fold(ska), skb))
        .when(F.size(skb) == 2 * F.size(ska), differ(ska, _fold(skb)))
    )
    sizes = 100 * F.least(na, nb) >= similarity * F.greatest(na, nb)
    return sizes & (bits * (100 + similarity) <= (100 - similarity) * (na + nb))


def _confirm(batches, similarity: int):
    """Of pairs with both texts, those whose full sets are similar enough."""
    hashes, last = WordHashes(), (None, None)
    for batch in batches:
        a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
        good = []
        for x, one, two in zip(b, left, right):
            if last[0] != x:
                last = (x, shingles(two, hashes))
            one = shingles(one, hashes)
            both = common_items(one, last[1])
            good.append(100 * both >= similarity * (len(one[0]) + len(last[1][0]) - both))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def confirmed(pairs: DataFrame, docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The ``pairs(a, b)`` (written) whose full sets are similar enough; only texts of documents in pairs are moved."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = matched(_by_text(docs), ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", "th").alias("text"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    met = spread_join(pairs.join(left, "a"), right, "b", "a", counted=pairs)
    return met.select("a", "b", "ta", "tb").mapInArrow(partial(_confirm, similarity=similarity), "a long, b long")


def near_components(docs: DataFrame, similarity: int = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """A row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    every = cut(signed(docs, chunk))
    sets = every.where("same IS NOT NULL")
    # a document with several texts is the one with the smallest hash
    several = cut(every.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("th").alias("least"), F.max("th").alias("most")).where("least != most").select("doc_id", "least"))
    chosen = lambda rows: rows.join(several, "doc_id", "left").where("least IS NULL OR least = th").drop("least")
    sets = chosen(sets) if not several.isEmpty() else sets
    # equal sets: one representative, the one with the smallest id; the others get its class in the end
    rep = F.min("doc_id").alias("rep")
    reps = cut(sets.groupBy("same").agg(rep))
    members = cut(sets.select("same", "doc_id").distinct())
    one = sets.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keyed = one.select("doc_id", F.posexplode("keys").alias("place", "key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(full, "key"))
    # the most central representative of each key is the one whose keys are the fullest
    weight = shared.groupBy("doc_id").agg(F.sum("n").alias("w"))
    shared = cut(shared.join(weight, "doc_id").select("key", "place", "doc_id", "w"))
    pivot = shared.groupBy("key").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("i"))).alias("p")).select("key", (-F.col("p.i")).alias("b"))
    pairs = cut(shared.join(pivot, "key").where("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct())
    own = cut(one.select("doc_id", "n_shingles", "chunks", "sketch").join(shared.select("doc_id").distinct(), "doc_id", "left_semi"))
    distance = F.aggregate(errors(F.col("ca"), F.col("cb")), F.lit(0), lambda s, e: s + e)
    similar = (distance <= most_distance(chunk)) & can_be_similar(F.col("na"), F.col("nb"), F.col("ska"), F.col("skb"), similarity)
    near = spread_join(pairs.join(own.toDF("a", "na", "ca", "ska"), "a"), own.toDF("b", "nb", "cb", "skb"), "b", "a", counted=pairs).where(similar)
    links = cut(confirmed(cut(near.select("a", "b")), docs, similarity))
    roots = cut(components(links))
    # keys whose representatives are not all in one component: the pairs across components remain
    rooted = shared.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "place", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    left = cut(rooted.join(open_keys, "key").join(own, "doc_id").select("key", "place", "doc_id", "root", "n_shingles", "chunks", "sketch"))
    x, y = left.toDF("key", "place", "a", "ra", "na", "ca", "ska"), left.drop("place").toDF("key", "b", "rb", "nb", "cb", "skb")
    # the first key that a pair shares: of the first chunk with at most one error, the place of the error or else the first
    wrong = errors(F.col("ca"), F.col("cb"))
    at, place = F.floor(F.col("place") / chunk).cast("int"), F.col("place") % chunk
    few = F.array_position(F.transform(wrong, lambda e: e <= 1), True) == at + 1
    first_key = few & ((F.get(wrong, at) == 1) | (place == 0))
    across = (F.col("ra") < F.col("rb")) & (100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    more = spread_join(x, y, "key", "a", least=ROWS_OF_A_KEY).where(across & first_key & similar).select("a", "b").distinct()
    # such links merge components that are known by their roots
    links = cut(confirmed(cut(more), docs, similarity))
    if not links.isEmpty():
        ends = links.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
        tops = cut(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))).toDF("root", "top")
        # a representative without links so far is a root that roots doesn't have
        alone = tops.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select("root", "top")
        roots = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(alone)
    classes = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("root", "rep").alias("root"))
    of = spread_join(members, classes, "same", "doc_id").select("doc_id", "root")
    return every.select("doc_id", "n_shingles").join(of, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"),
        F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near(docs: DataFrame, similarity: int = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """``docs``, all columns, with one document of each group of near duplicates.

    Every text is compared: where a ``doc_id`` has several, that with the smallest hash goes by the id, and each other one is a document of
    its own under a number made of both.  Rows that repeat id and text go or stay together; rows with a NULL id stay.
    """
    own = free(docs, "__id")
    number, th = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    texts = docs.select(number.alias("doc_id"), th.alias("th")).where("doc_id IS NOT NULL")
    several = cut(texts.groupBy("doc_id").agg(F.min("th").alias("least"), F.max("th").alias("most")).where("least != most").select(F.col("doc_id").alias(own), "least"))
    if several.isEmpty():
        named = docs.withColumn(own, number)
    else:
        least = free(docs, "__least")
        met = docs.join(several.withColumnRenamed("least", least), number == F.col(own), "left").drop(own)
        named = met.withColumn(own, F.when(F.col(least).isNull() | (th == F.col(least)), number).otherwise(F.xxhash64(number, th))).drop(least)
    out = near_components(named.select(F.col(own).alias("doc_id"), "text"), similarity, chunk).where("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    return unmatched(named, cut(out), own).select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


QUERIES = {"op4_minhash": op4}
ORACLE_SQL: dict[str, str] = {}
