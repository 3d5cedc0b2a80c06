"""What a refresh takes: limits by source, fairness and yield, health queues, capacity, shard sizes, stable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.operators.schedule import by_digest, oldest_due

# Cohorts in which every target has its turn, targets of one refresh, and targets of a shard.
TURNS, CEILING = 6, 600


def refresh_limits(targets: DataFrame, source: str, ramp: dict[str, int] | None = None, ceiling: int = CEILING) -> DataFrame:
    """Targets that a cohort takes of each source: a sixth of them, or the ramp's number, and all together no more than the
    ceiling, which shrinks every source alike."""
    n = targets.groupBy(source).agg(F.count("*").alias("targets"))
    wanted = F.ceil(F.col("targets") / TURNS)
    for name, most in (ramp or {}).items():
        wanted = F.when(F.col(source) == name, F.least(wanted, F.lit(most))).otherwise(wanted)
    n = n.withColumn("wanted", wanted)
    total = n.agg(F.sum("wanted").alias("total"))  # one row
    scaled = F.floor(F.col("wanted") * ceiling / F.greatest(F.col("total"), F.lit(ceiling)))
    return n.join(F.broadcast(total)).select(source, "targets", F.greatest(scaled, F.lit(1)).cast("long").alias("refresh_limit"))


def fair_and_yielding(targets: DataFrame, source: str, target: str, due: Column, yield_rate: Column, fair: int, most: int) -> DataFrame:
    """The ``fair`` longest due targets of each source, and of the others the best yielding up to ``most`` in all: ``reason``, ``rank``."""
    chosen = oldest_due(targets.withColumn("__yield", yield_rate), source, target, due, fair).withColumn("reason", F.lit("fairness"))
    room = chosen.agg(F.greatest(F.lit(most) - F.count("*"), F.lit(0)).alias("room"))
    rest = targets.withColumn("__yield", yield_rate).join(chosen.select(target), target, "left_anti").where(F.col("__yield") > 0)
    # the best ``most`` by a bounded sort; which of them have room is known from a row
    best = rest.orderBy(F.desc("__yield"), *by_digest(F.col(target))).limit(most)
    ranked = best.withColumn("due_rank", F.row_number().over(Window.orderBy(F.desc("__yield"), *by_digest(F.col(target)))))
    taken = ranked.join(F.broadcast(room)).where(F.col("due_rank") <= F.col("room")).drop("room").withColumn("reason", F.lit("yield"))
    both = chosen.unionByName(taken)
    return both.select(source, target, "reason", F.col("due_rank").alias("rank"))


def health_queue(targets: DataFrame, target: str, checked: str, now: Column, limit: int, max_hours: int, guard_hours: int) -> DataFrame:
    """``limit`` targets to check: first those whose admission is about to expire, then never-checked ones up to half of what is
    left, then routine ones, and what is still free goes to more never-checked ones: ``lane`` and ``place``."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(checked).cast("timestamp"))) / 3.6e9
    lane = F.when(F.col(checked).isNull(), "new").when((age >= max_hours - guard_hours) & (age <= max_hours), "expiring").otherwise("routine")
    ranked = oldest_due(targets.withColumn("lane", lane), "lane", target, F.col(checked), limit)
    sizes = ranked.groupBy().pivot("lane", ["expiring", "new", "routine"]).count().select(*[F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in ("expiring", "new", "routine")])
    expiring = F.least("n_expiring", F.lit(limit))
    half = F.least(F.col("n_new"), F.floor((limit - expiring) / 2))
    routine = F.least(F.col("n_routine"), limit - expiring - half)
    more = F.least(F.col("n_new"), limit - expiring - routine)
    quota = F.when(F.col("lane") == "expiring", expiring).when(F.col("lane") == "routine", routine).otherwise(more)
    return ranked.join(F.broadcast(sizes)).where(F.col("due_rank") <= quota).select(target, "lane", F.col("due_rank").cast("long").alias("place"))


def capacity(sizes: DataFrame, source: str, targets: str, limit: str, horizon: int) -> DataFrame:
    """Cohorts until every target of a source had its turn, and whether that is within the horizon."""
    turns = F.ceil(F.col(targets) / F.col(limit))
    return sizes.select(source, turns.alias("cohorts"), (turns <= horizon).alias("within_horizon"))


def shard_counts(targets: DataFrame, source: str, per_shard: int, most: int) -> DataFrame:
    """Shards that a source's targets need; ``refused`` if these are more than ``most``."""
    n = F.ceil(F.count("*") / per_shard)
    return targets.groupBy(source).agg(n.alias("shards"), (n > most).alias("refused"))


def stable_sample(targets: DataFrame, source: str, target: str, n: int) -> DataFrame:
    """The first ``n`` targets of each source in digest order: the same ones each time, whatever comes later."""
    first = oldest_due(targets, source, target, F.lit(None).cast("timestamp"), n)  # the digest decides
    return first.withColumnRenamed("due_rank", "place")


def request_cost(rows: Column, capped: Column, page: int = 20) -> Column:
    """Requests for a list and its details; unknown if the list is capped."""
    return F.when(~capped, F.ceil(rows / page) + rows)
