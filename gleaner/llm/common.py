"""Shared helpers: table access, joins of frequent keys and of few wanted rows, the shared scratch folder, lineage cuts and Arrow batch bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.operators.bloom import BITS_A_KEY, MOST_BITS, filter_words, might_hold
from gleaner.plans.shared import cut, drop_path, scratch, shared_dir, small_batches  # noqa: F401

#: The white space that every contract of this subpackage means by ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def _maybe(wanted: DataFrame, key: Column) -> Column:
    """Whether a row's ``key`` may be in the one-column written table ``wanted``, by a Bloom filter of bounded bytes."""
    bits = min(MOST_BITS, 1 << max(10, (wanted.count() * BITS_A_KEY).bit_length()))
    return might_hold(filter_words(wanted, bits).scalar(), key, bits)


def thinned(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``wanted`` (written), and a hundredth of the others (more, if ``wanted`` outgrows the filter): for uses that others don't harm."""
    return rows.where(_maybe(wanted.select(F.xxhash64(key)), F.xxhash64(key)))


def matched(rows: DataFrame, wanted: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``wanted`` (written, distinct keys) on the column ``key``, at every size in one way: a Bloom filter of the keys
    thins the scan of ``rows``, and what is left is shuffled."""
    return thinned(rows, wanted, key).join(wanted, key, how)


def unmatched(rows: DataFrame, out: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``out`` (written): most pass in the scan by the Bloom filter, the others are looked up."""
    maybe = _maybe(out.select(F.xxhash64(key)), F.xxhash64(key))
    return rows.where(~maybe).unionByName(rows.where(maybe).join(out, key, "left_anti"))


def spread_join(left: DataFrame, right: DataFrame, key: str, *spread: str, counted: DataFrame | None = None, least: int = 1) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, without a task for all rows of a frequent key.

    A key is frequent if it has more rows in ``counted`` (a written table, ``left`` unless given) than a quarter of an average
    partition, so there are no more of them than four times the shuffle partitions: they are broadcast.  Their rows are dealt
    by the columns ``spread`` over as many parts as such quarters (or as ``least`` rows, if that is more: where ``right`` has many
    rows of a key), and ``right``'s rows are repeated for each of these parts.
    """
    counted = left if counted is None else counted
    quarter = max(least, counted.count() // (4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1)
    often = counted.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > quarter)
    often = F.broadcast(cut(often.select(key, F.ceil(F.col("__n") / quarter).cast("int").alias("__parts"))))
    parts, part = F.coalesce("__parts", F.lit(1)), free(left, "__part")
    dealt = left.join(often, key, "left").withColumn(part, F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("__parts")
    repeated = right.join(often, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(repeated, [key, part]).drop(part)


def strip_space(text: Column) -> Column:
    """The text without any character of ``[\x20\x09-\x0D]``; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")
