"""The universe of targets that historical links name, and how healthy it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.operators.reports import inventory_bucket

# Bands of historical occurrences, and of current postings.
OCCURRENCES = {"1": (1, 1), "2-4": (2, 4), "5-9": (5, 9), "10-24": (10, 24), "25+": (25, None)}
INVENTORY = ["0", "1-9", "10-49", "50-99", "100-499", "500+"]
#: Examples that are shown of a reason, and targets of the largest inventory.
EXAMPLES, TOP = 10, 20


def targets(links: DataFrame, order: list[str]) -> DataFrame:
    """A row per target of ``links(identity, source, url, company)``: ``occurrences``, ``distinct_urls``, the ``first`` and ``last`` link in order (their order columns and URL) and
    ``company``, the one most often named (then the first in lower case, then the first).  Links without an identity name no target."""
    known = links.where("identity IS NOT NULL")
    place = F.struct(*order, "url")
    each = known.groupBy("identity", "source").agg(F.count("*").alias("occurrences"), F.count_distinct("url").alias("distinct_urls"), F.min(place).alias("first"), F.max(place).alias("last"))
    named = known.where(F.coalesce("company", F.lit("")) != "").groupBy("identity", "company").agg(F.count("*").alias("n"))
    best = named.groupBy("identity").agg(F.min(F.struct((-F.col("n")).alias("less"), F.lower("company").alias("low"), "company")).alias("b")).select("identity", F.col("b.company").alias("company"))
    return each.join(best, "identity", "left")


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """By group: ``targets``, ``minimum``, ``median`` (exact, the mean of the middle two) and ``maximum`` of whole numbers.

    The median comes from counts per value and a running sum over them, so a group's rows are never in one place.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(by)
    ranked = counts.withColumn("upto", F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("n").over(own))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    low, high = at(F.floor((F.col("all") + 1) / 2)), at(F.floor(F.col("all") / 2) + 1)
    return ranked.groupBy(by).agg(F.sum("n").alias("targets"), F.min(value).alias("minimum"), ((low + high) / 2).alias("median"), F.max(value).alias("maximum"))


def unresolved(links: DataFrame, order: list[str]) -> DataFrame:
    """By ``reason`` of links that name no target: how many, and the first ``EXAMPLES`` URLs in order."""
    rows = links.where("identity IS NULL")
    turn = F.row_number().over(Window.partitionBy("reason").orderBy(*order, "url"))
    some = rows.withColumn("__k", turn).where(F.col("__k") <= EXAMPLES).groupBy("reason").agg(F.sort_array(F.collect_list(F.struct("__k", "url"))).alias("e"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).join(some, "reason").select("reason", "n", F.transform("e", lambda x: x["url"]).alias("examples"))


def _inventory() -> Column:
    """Current postings where they say something: of active and validly empty targets."""
    return F.when(F.col("classification").isin("active", "valid_empty") & (F.col("current_postings") >= 0), F.col("current_postings"))


def health_summary(results: DataFrame, classes: list[str]) -> DataFrame:
    """A row per source of ``results`` (target_identity, source, classification, current_postings, inventory_exact): targets, each of ``classes`` (0 if none), postings in sum, median and mean
    (of active targets) and maximum, targets by inventory, and those whose inventory may be cut off."""
    rows = results.withColumn("__n", _inventory()).withColumn("__active", F.when(F.col("classification") == "active", F.col("__n")))
    middle = distribution(rows, "source", "__active").select("source", F.col("median").alias("median_postings"))
    named = {c: F.count_if(F.col("classification") == c) for c in classes} | {f"inventory_{b.replace('-', '_').replace('+', '_plus')}": F.count_if(F.coalesce(inventory_bucket(F.col("__n")) == b, F.lit(False))) for b in INVENTORY}
    out = rows.groupBy("source").agg(
        F.count("*").alias("targets"), *[v.alias(k) for k, v in named.items()], F.coalesce(F.sum("__n"), F.lit(0)).alias("postings"), F.round(F.avg("__active"), 2).alias("mean_postings"),
        F.max("__n").alias("maximum_postings"), F.count_if(~F.coalesce("inventory_exact", F.lit(True))).alias("potentially_capped"),
    )
    return out.join(middle, "source", "left")


def occurrence_health(results: DataFrame) -> DataFrame:
    """By band of ``historical_occurrence_count``: targets, active ones, their percentage and the median of current postings."""
    count = F.col("historical_occurrence_count")
    band = F.lit(None).cast("string")
    for name, (low, high) in OCCURRENCES.items():
        band = F.when((count >= low) & (F.lit(True) if high is None else count <= high), name).otherwise(band)
    rows = results.withColumns({"band": band, "__n": _inventory()}).where("band IS NOT NULL")
    active = F.count_if(F.col("classification") == "active")
    middle = distribution(rows, "band", "__n").select("band", F.col("median").alias("median_postings"))
    return rows.groupBy("band").agg(F.count("*").alias("targets"), active.alias("active"), F.round(100 * active / F.count("*"), 2).alias("active_percentage")).join(middle, "band", "left")


def largest(results: DataFrame, n: int = TOP) -> DataFrame:
    """The targets with the largest inventories, then by identity."""
    return results.withColumn("postings", _inventory()).where("postings IS NOT NULL").orderBy(F.desc("postings"), "target_identity").limit(n).select("target_identity", "source", "postings", "inventory_exact")


def compared_ids(boards: DataFrame) -> DataFrame:
    """``boards`` with arrays ``historical`` and ``live`` of ids: how many are in both, and in one only."""
    size = lambda a: F.size(a).cast("long")
    known = lambda c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))
    old, new = known("historical"), known("live")
    return boards.withColumns({"both": size(F.array_intersect(old, new)), "historical_only": size(F.array_except(old, new)), "live_only": size(F.array_except(new, old))}).drop("historical", "live")
