"""Deterministic selection: shards, rotating rings, due queues, budgets and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.operators.batch import ranked
from gleaner.plans.shared import cut


def by_digest(*ids: Column) -> list[Column]:
    """A stable order that has nothing to do with the ids' own: their digest, then the ids."""
    return [F.sha2(F.concat_ws(":", *[i.cast("string") for i in ids]), 256), *ids]


def shards(targets: DataFrame, source: str, target: str, n: int) -> DataFrame:
    """``shard`` 0 to n - 1 of each target: round robin within its source, in digest order."""
    placed = ranked(targets, [source], by_digest(F.col(target)), "__r")
    return placed.withColumn("shard", (F.col("__r") - 1) % n).drop("__r")


def ring(targets: DataFrame, source: str, target: str, limit: Column, cohort: int) -> DataFrame:
    """Each source's targets whose turn it is in a cohort: ``limit`` places of a ring, moving on by as many each time."""
    placed = ranked(targets, [source], by_digest(F.col(target)), "__p", "__n")
    return placed.where(F.pmod(F.col("__p") - 1 - cohort * limit, F.col("__n")) < limit).drop("__p", "__n")


#: Parts of a source that are sorted on their own before their first ones are compared.
PARTS = 64


def oldest_due(targets: DataFrame, source: str, target: str, due: Column, limit: int) -> DataFrame:
    """The first ``limit`` targets of each source by the time they are due; never seen ones come first."""
    order = [F.asc_nulls_first(due), *by_digest(F.col(target))]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    parted = targets.withColumn("__part", F.pmod(F.xxhash64(target), F.lit(PARTS)))
    some = parted.withColumn("due_rank", place(source, "__part")).where(F.col("due_rank") <= limit).drop("__part")
    return some.withColumn("due_rank", place(source)).where(F.col("due_rank") <= limit)


def within_budget(rows: DataFrame, order: list, cost: str, budget: float) -> DataFrame:
    """``rows`` with ``rn`` and running cost ``spent``, up to the first that would exceed the budget (costs aren't negative).

    The running sum starts in each range partition with the sum of those before it; only a row per partition is seen at once.
    """
    names = [f"__o{i}" for i in range(len(order))]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(rows.withColumns(dict(zip(names, order))).repartitionByRange(parts, *names).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*names)
    first = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per partition
    sums = spread.groupBy("__part").agg(F.sum(cost).alias("s"), F.count("*").alias("n"))
    before = sums.select("__part", F.coalesce(F.sum("s").over(first), F.lit(0)).alias("__s"), F.coalesce(F.sum("n").over(first), F.lit(0)).alias("__n"))
    placed = spread.withColumns({"spent": F.sum(cost).over(own), "rn": F.row_number().over(own)}).join(F.broadcast(before), "__part")
    summed = placed.withColumns({"spent": F.col("spent") + F.col("__s"), "rn": F.col("rn") + F.col("__n")})
    return summed.where(F.col("spent") <= budget).drop("__part", "__s", "__n", *names)


def even_sample(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """``n`` evenly spaced ranks of each group, its first and last among them."""
    placed = ranked(rows, [group], order, "rank", "__size")
    step = lambda i: F.floor(i * (F.col("__size") - 1) / (n - 1)) + 1
    chosen = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: step(i) == F.col("rank"))
    return placed.where((F.col("__size") <= n) | chosen).withColumn("rank", F.col("rank").cast("int")).drop("__size")


def pilot(rows: DataFrame, group: str, order: list, key: str, controls: DataFrame, n: int, first: int = 5) -> DataFrame:
    """``n`` rows of each group, with the ``turn`` in which they were taken: its control (of ``controls(group, key)``), the ``first`` in order, evenly spaced ranks from the first to the last, and then whatever comes next.

    A group without its control, or with fewer than ``n`` rows, is an error.
    """
    marked = rows.join(controls.select(group, key).withColumn("__control", F.lit(True)), [group, key], "left")
    placed = ranked(marked, [group], order, "__rank", "__size").withColumn("__r", F.col("__rank") - 1)
    spaced = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("__size") - 1) / (n - 1)).cast("long")), F.col("__r"))
    turn = F.when(F.col("__control"), 0).when(F.col("__r") < first, 1 + F.col("__r")).when(spaced > 0, first + spaced).otherwise(first + n + 1 + F.col("__r"))
    taken = ranked(placed.withColumn("__turn", turn), [group], [F.col("__turn")], "turn").where(F.col("turn") <= n)
    sound = taken.groupBy(group).agg((F.count("*") == n).alias("__full"), F.bool_or(F.coalesce("__control", F.lit(False))).alias("__held"))
    checked = taken.join(sound, group)
    wrong = F.when(~F.col("__held"), "a group has no control").when(~F.col("__full"), "a group has too few rows")
    return checked.withColumn("turn", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("turn"))).select(*rows.columns, "turn")
