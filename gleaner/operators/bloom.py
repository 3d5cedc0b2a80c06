"""A Bloom filter of keys in built-in functions: it thins a large table in its scan, before anything is shuffled.

The filter is an array of 64-bit words in a scalar subquery, built by a bitwise OR that is combined before its shuffle.  Its
size follows the number of keys up to ``MOST_BITS``; beyond that more rows pass, and the join that follows stays exact as ever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits for each key (one in a hundred others passes), bits at most (8 MB), and positions of a key.
BITS_A_KEY, MOST_BITS, HASHES = 10, 1 << 26, 4


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def filter_words(keys: DataFrame, bits: int) -> DataFrame:
    """One row, one column ``words``: the filter of a one-column table as an array of longs."""
    spark, key = keys.sparkSession, F.col(f"`{keys.columns[0]}`")
    at = keys.where(key.isNotNull()).select(F.explode(F.array(*_positions(key, bits))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = at.groupBy(F.floor(F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(one).alias("bits"))
    every = spark.range(bits // 64).select(F.col("id").alias("word")).join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    listed = every.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))  # bits // 64 rows, a fixed number
    return listed.select(F.transform("all", lambda w: w["bits"]).alias("words"))


def might_hold(words: Column, key: Column, bits: int) -> Column:
    """False only if the key isn't in the filter; a NULL key never is."""
    held = F.lit(True)
    for at in _positions(key, bits):
        held = held & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return key.isNotNull() & held


def thinned(rows: DataFrame, key: Column, keys: DataFrame, n: int | None = None) -> DataFrame:
    """The ``rows`` whose ``key`` may be in the one-column table ``keys`` (of about ``n`` rows; counted if not given)."""
    n = keys.count() if n is None else n
    bits = min(MOST_BITS, 1 << max(10, (n * BITS_A_KEY).bit_length()))
    return rows.where(might_hold(filter_words(keys, bits).scalar(), key, bits))
