"""Telemetry: funnels, coverage, yield and percentiles.  Every count and percentile is exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions.values import age_bucket, age_seconds
from gleaner.plans.shared import cut

BUCKETS = ["0-24h", "24-48h", "48-72h", ">72h", "unknown", "invalid"]


def percentile_int(values: Column, share: float) -> Column:
    """Linear interpolation, rounded half to even; 0 without values."""
    return F.coalesce(F.bround(F.percentile(values, share), 0), F.lit(0.0)).cast("long")


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact percentiles of each key, with linear interpolation: ``keys``, ``n`` and ``p0``, ``p1``, ... in the order of ``shares``.

    Equal values are counted first.  The counts are then ranked from range partitions, so a key with most of the rows is
    sorted by many tasks, and no task holds a key's values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(counted.repartitionByRange(parts, *keys, value).withColumn("__part", F.spark_partition_id()))
    first = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and partition
    sums = spread.groupBy(*keys, "__part").agg(F.sum("__c").alias("__s"))
    before = sums.select(*keys, "__part", F.coalesce(F.sum("__s").over(first), F.lit(0)).alias("__before"))
    total = sums.groupBy(*keys).agg(F.sum("__s").alias("n"))
    last = F.sum("__c").over(Window.partitionBy(*keys, "__part").orderBy(value))
    ranked = spread.withColumn("__to", last).join(before, [*keys, "__part"]).join(total, keys)
    to, least = F.col("__to") + F.col("__before"), F.col("__to") + F.col("__before") - F.col("__c")  # ranks least .. to - 1 have the value

    def at(rank: Column) -> Column:
        return F.max(F.when((least <= rank) & (rank < to), F.col(value)))

    out = ranked.groupBy(*keys, "n").agg(*[x for i, q in enumerate(shares) for x in (
        at(F.floor((F.col("n") - 1) * q)).alias(f"__low{i}"), at(F.ceil((F.col("n") - 1) * q)).alias(f"__high{i}"))])
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return out.select(*keys, "n", *[(F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * part(q)).alias(f"p{i}") for i, q in enumerate(shares)])


def funnel(rows: DataFrame, source: str, posted_at: str, at: Column, stages: dict[str, Column]) -> DataFrame:
    """Counts of cumulative stages and of age buckets, by source and, with a NULL source, overall."""
    bucket = age_bucket(F.col(posted_at), at)
    counts = [F.count("*").alias("evaluated")]
    so_far = F.lit(True)
    for name, test in stages.items():
        so_far = so_far & test
        counts.append(F.count_if(F.coalesce(so_far, F.lit(False))).alias(name))
    counts += [F.count_if(bucket == b).alias("age_" + b.replace("-", "_").replace(">", "over_")) for b in BUCKETS]
    return rows.groupingSets([[F.col(source)], []], F.col(source)).agg(*counts)


def coverage(observations: DataFrame, source: str, target: str, at: str, status: str, runtime: str) -> DataFrame:
    """Per source: attempts, outcomes, success rate, revisit gaps in hours and runtimes."""
    own = Window.partitionBy(target).orderBy(F.unix_micros(F.col(at))).rangeBetween(Window.unboundedPreceding, -1)
    gap = (F.unix_micros(F.col(at)) - F.unix_micros(F.max(at).over(own))) / 3.6e9
    rows = cut(observations.select(source, target, status, runtime, gap.alias("__gap")))
    counts = rows.groupBy(source).agg(
        F.count("*").alias("attempted"), F.count_if(F.col(status) == "success").alias("succeeded"),
        F.count_if(F.col(status) == "partial").alias("partial"), F.count_if(F.col(status) == "failed").alias("failed"),
        F.bround(F.count_if(F.col(status) == "success") / F.count("*"), 6).alias("success_rate"), F.bround(F.max("__gap"), 3).alias("revisit_max_h"),
    )
    targets = rows.select(source, target).distinct().groupBy(source).agg(F.count(target).alias("targets"))
    gaps = percentiles(rows, [source], "__gap", [0.95]).select(source, F.bround("p0", 3).alias("revisit_p95_h"))
    whole = lambda c: F.coalesce(F.bround(c, 0), F.lit(0.0)).cast("long")
    times = percentiles(rows, [source], runtime, [0.5, 0.95]).select(source, F.col("p0").alias("__p50"), F.col("p1").alias("__p95"))
    met = counts.join(targets, source).join(gaps, source, "left").join(times, source, "left")
    return met.withColumns({"runtime_p50": whole("__p50"), "runtime_p95": whole("__p95")}).drop("__p50", "__p95")


def target_yield(sightings: DataFrame, target: str, job: str, run: str, at: str, fresh: Column, eligible: Column) -> DataFrame:
    """Per target: runs, distinct fresh and eligible jobs, runs in which a job was first eligible, last eligible time."""
    first = F.row_number().over(Window.partitionBy(target, job, F.col("__e")).orderBy(at, run))
    rows = sightings.withColumn("__f", fresh).withColumn("__e", fresh & eligible)
    rows = rows.withColumn("__first", F.col("__e") & (first == 1))
    return rows.groupBy(target).agg(
        F.count_distinct(run).alias("observations"), F.count_distinct(F.when(F.col("__f"), F.col(job))).alias("fresh_jobs"),
        F.count_distinct(F.when(F.col("__e"), F.col(job))).alias("eligible_jobs"), F.count_distinct(F.when(F.col("__first"), F.col(run))).alias("eligible_observations"),
        F.max(F.when(F.col("__first"), F.col(at))).alias("last_eligible_at"),
    )


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's most frequent value; ties go to the first in lower case, then as written."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.lower(value).alias("l"), F.col(value).alias("v"))).alias("b")).select(*keys, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def is_fresh_day(posted_at: Column, at: Column) -> Column:
    return F.coalesce(age_seconds(posted_at, at).between(-300, 86400), F.lit(False))
