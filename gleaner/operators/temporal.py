"""Joins and running totals in time that no frequent key can hold up.

Rows are range-partitioned by key and time, so a frequent key's rows are spread over many partitions in order.  Within a partition
a window does the work; what it can't see is what came before in its first key, and of that there is one row per partition: the carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.plans.shared import cut


def _ordered(rows: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """``rows`` written in ranges of key and order; ``__part`` numbers the ranges, and a key's rows are in consecutive ones."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *on, *order).withColumn("__part", F.spark_partition_id()))


def _carried(rows: DataFrame, on: list[str], total: Column, over) -> DataFrame:
    """``over`` of the per-part ``total`` of a key in all earlier parts, as ``__carry``; only for the parts that go on with a key, so a
    row per part at most, which is broadcast."""
    parts = rows.groupBy("__part", *on).agg(total.alias("__total"))
    before = Window.partitionBy(*on).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(cut(parts.select("__part", *on, over(F.col("__total")).over(before).alias("__carry")).where("__carry IS NOT NULL")))


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, tie: list[str] = (), strict: bool = True) -> DataFrame:
    """Each row of ``left`` with the struct ``match``: the latest row of ``right`` with its key, before (or unless ``strict``, at) its time.

    Of several at the same time the last by the columns ``tie`` counts.  NULL where there is none, and for rows with a NULL key or time.
    """
    ties = [f"__tie{i}" for i in range(len(tie))]
    key = lambda df: [F.col(c).alias(f"__k{i}") for i, c in enumerate(on)]
    keys = [f"__k{i}" for i in range(len(on))]
    a = left.select(*key(left), F.col(left_at).alias("__at"), F.lit(0 if strict else 1).alias("__side"), F.struct(*left.columns).alias("__left"))
    b = right.select(*key(right), F.col(right_at).alias("__at"), F.lit(1 if strict else 0).alias("__side"), *[F.col(c).alias(t) for c, t in zip(tie, ties)], F.struct(*right.columns).alias("__right"))
    b = b.where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, "__at"]))
    rows = _ordered(a.unionByName(b, allowMissingColumns=True), keys, ["__at", "__side", *ties])
    order = F.when(F.col("__right").isNotNull(), F.struct("__at", *ties))
    carry = _carried(rows, keys, F.max_by("__right", order), lambda c: F.last(c, ignorenulls=True))
    window = Window.partitionBy("__part", *keys).orderBy("__at", "__side", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("__own", F.last("__right", ignorenulls=True).over(window)).where("__left IS NOT NULL")
    known = F.when(F.col("__at").isNotNull(), F.coalesce("__own", "__carry"))
    return seen.join(carry, ["__part", *keys], "left").select("__left.*", known.alias("match"))


def running_sum(rows: DataFrame, on: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the key up to each one, in an order without ties."""
    placed = _ordered(rows, on, order)
    carry = _carried(placed, on, F.sum(value), F.sum)
    window = Window.partitionBy("__part", *on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn("__own", F.sum(value).over(window)).join(carry, ["__part", *on], "left")
    return own.select(*rows.columns, (F.col("__own") + F.coalesce("__carry", F.lit(0))).alias(into))


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, stop: str, spread: int = 8) -> DataFrame:
    """Rows of ``points`` with each interval of their key that holds their time: ``start <= at < stop``, as the struct ``interval``.

    Times are cut into stretches of a power of two of microseconds; an interval is filed at the level of its length, where it
    meets two stretches at most, and a point looks once at each level in use.  A stretch of a frequent key is dealt over
    ``spread`` parts by the point's hash, with the intervals of the stretch repeated there.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    filed = intervals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], micros(start).alias("__start"), micros(stop).alias("__stop"), F.struct(*intervals.columns).alias("interval")).where("__stop > __start")
    level = F.ceil(F.log2(F.col("__stop") - F.col("__start"))).cast("int")
    stretch = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("__level"))).cast("long")
    filed = cut(filed.withColumn("__level", level))
    levels = [r[0] for r in filed.select("__level").distinct().collect()]  # powers of two of a long, 64 at most
    both = F.sequence(stretch(F.col("__start")), stretch(F.col("__stop") - 1))
    filed = filed.withColumn("__stretch", F.explode(both))
    looking = points.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], micros(at).alias("__at"), F.struct(*points.columns).alias("__point"))
    looking = looking.withColumn("__level", F.explode(F.array(*map(F.lit, levels)))) if levels else looking.withColumn("__level", F.lit(0)).limit(0)
    keys = [*(f"__k{i}" for i in range(len(on))), "__level", "__stretch"]
    looking = looking.withColumn("__stretch", stretch(F.col("__at")))
    # frequent stretches: those of more points than an average part has, so there are no more of them than parts
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = looking.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    often = F.broadcast(cut(sizes.where(F.col("__n") > total // parts + 1).select(*keys, F.lit(spread).alias("__parts"))))
    dealt = looking.join(often, keys, "left").withColumn("__part", F.pmod(F.xxhash64("__point"), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    repeated = filed.join(often, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - F.lit(1).cast("long")))).drop("__parts")
    return dealt.join(repeated, [*keys, "__part"]).where("__at >= __start AND __at < __stop").select("__point.*", "interval")


def local_day(at: Column, zone: Column) -> tuple[Column, Column]:
    """Start and end of the calendar day of a zone that holds a time; the session's time zone is UTC."""
    day = F.date_trunc("day", F.from_utc_timestamp(at, zone))
    return F.to_utc_timestamp(day, zone), F.to_utc_timestamp(day + F.expr("INTERVAL 1 DAY"), zone)


def active_counts(sightings: DataFrame, of: list[str], what: str, at: str, hours: int) -> DataFrame:
    """How many distinct ``what`` of each ``of`` were sighted in the last ``hours``, as steps: ``active`` from ``since`` on.

    A sighting counts from its time to ``hours`` later, both included.  Overlapping sightings of one thing are one stretch of time, which
    begins with a +1 and ends with a -1; a running sum over these gives the number at every moment.
    """
    lasts = F.expr(f"INTERVAL {hours} HOURS")
    once = sightings.where(F.col(at).isNotNull()).select(*of, what, F.col(at).alias("__at")).distinct()
    turn = Window.partitionBy(*of, what).orderBy("__at")
    seen = once.select(*of, "__at", (F.lag("__at").over(turn) + lasts).alias("__before"), (F.lead("__at").over(turn) - lasts).alias("__next"))
    begins = seen.where("__before IS NULL OR __at > __before").select(*of, F.col("__at").alias("since"), F.lit(1).alias("__step"))
    ends = seen.where("__next IS NULL OR __next > __at").select(*of, (F.col("__at") + lasts + F.expr("INTERVAL 0.000001 SECONDS")).alias("since"), F.lit(-1).alias("__step"))
    steps = begins.union(ends).groupBy(*of, "since").agg(F.sum("__step").alias("__step")).where("__step != 0")
    return running_sum(steps, of, ["since"], "__step", "active").drop("__step")


def active_at(moments: DataFrame, steps: DataFrame, of: list[str], at: str) -> DataFrame:
    """``moments`` with the number ``active`` that ``active_counts`` gives for their ``of`` at their time."""
    found = asof_join(moments, steps, of, at, "since", strict=False)
    return found.select(*moments.columns, F.coalesce("match.active", F.lit(0).cast("long")).alias("active"))
