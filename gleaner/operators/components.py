"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.plans.shared import cut


def _each(links: DataFrame, *pairs: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """A row for each of the pairs of columns, in one scan; a union would read and shuffle in a set of tasks for each."""
    one = [F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1])) for x, y in pairs]
    return links.select(F.inline(F.array(*one)))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours get linked to its smallest neighbour."""
    both = _each(links, ("a", "b"), ("b", "a"), names=("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, get linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _each(down.join(least, "u"), ("v", "m"), ("u", "m"), names=("a", "b")).where("a != b").distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every ``a`` is linked to one ``b``, which is linked to none itself: all roots are found, and another round would change nothing."""
    nodes = _each(links.select("a", "b", F.lit(1).alias("up"), F.lit(0).alias("down")), ("a", "up"), ("b", "down"), names=("u", "up")).withColumn("down", 1 - F.col("up"))
    return nodes.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node in ``links(a, b)``; roots included.

    Self links are ignored.  Each round halves path lengths, so the rounds grow with the logarithm of
    the longest path; no group of links is ever collected.  Links to a hot node are pre-aggregated.
    """
    now = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
