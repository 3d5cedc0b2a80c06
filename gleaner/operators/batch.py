"""Daily batches: which candidates a quota-bounded, employer-diverse batch takes, and why the others stay out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gleaner.functions.values import freshness
from gleaner.plans.shared import cut


def priority() -> list:
    """Delivery order: better decision, higher score, newer posting, then the id."""
    rank = F.when(F.col("decision") == "strong_match", 0).when(F.col("decision") == "possible_match", 1).when(F.col("decision") == "needs_review", 2).otherwise(3)
    return [rank, -F.coalesce("score", F.lit(-1)), -F.coalesce(F.unix_micros(F.col("posted_at")), F.lit(0)), F.col("job_id")]


def round_robin(rows: DataFrame, employer: str, cap: int | None, order: list, quota: int | None = None) -> DataFrame:
    """``rows`` with ``place`` within the employer (up to ``cap``) and ``rn``, the turn in a round robin over employers;
    employers take turns in the order of their best row, and ``rn`` is NULL beyond the cap.

    The ranks within employers are windows by employer.  The global order is a sort, so turns come from a range
    partitioning and the counts of the partitions before, not from one window over everything.
    """
    own = Window.partitionBy(employer).orderBy(*order)
    best = F.first(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).over(own)
    placed = rows.withColumn("place", F.row_number().over(own)).withColumn("best", best)
    kept = placed.where(F.col("place") <= cap) if cap is not None else placed
    ranked = numbered(kept, [F.col("place"), F.col("best"), F.col(employer)], "rn")
    over = placed.where(F.col("place") > cap).withColumn("rn", F.lit(None).cast("long")) if cap is not None else None
    out = ranked if over is None else ranked.unionByName(over)
    return out.drop("best") if quota is None else out.where(F.col("rn") <= quota).drop("best")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their number, from 1, in a total order: a distributed sort, not a window over one partition."""
    names = [f"__o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(keyed.repartitionByRange(parts, *names).withColumn("__part", F.spark_partition_id()))  # sampled once
    inside = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*names)))
    before = spread.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col("__n") + F.col("__before")).drop("__part", "__n", "__before", *names)


def ranked(rows: DataFrame, groups: list[str], order: list, name: str, total: str | None = None) -> DataFrame:
    """``rows`` with their number, from 1, in their group, and with ``total`` the group's size: as ``numbered``, so that a group with
    most of the rows is sorted by many tasks."""
    names = [f"__o{i}" for i in range(len(order))]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(rows.withColumns(dict(zip(names, order))).repartitionByRange(parts, *groups, *names).withColumn("__part", F.spark_partition_id()))
    inside = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__part", *groups).orderBy(*names)))
    own = Window.partitionBy(*groups)  # over a row per partition that the group is in
    counts = spread.groupBy(*groups, "__part").agg(F.count("*").alias("__c"))
    before = counts.select(*groups, "__part", F.coalesce(F.sum("__c").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__c").over(own).alias("__all"))
    same = [inside["__part"] == before["__part"], *[inside[g].eqNullSafe(before[g]) for g in groups]]
    met = inside.join(before, same).drop(before["__part"], *[before[g] for g in groups])
    met = met.withColumn(name, F.col("__n") + F.col("__before"))
    return (met.withColumn(total, F.col("__all")) if total else met).drop("__part", "__n", "__before", "__all", *names)


def assemble(candidates: DataFrame, quota: int, cap: int | None, max_hours: int, unknown_policy: str, at, include_review: bool = False) -> DataFrame:
    """``candidates`` with their ``disposition`` and, for selected ones, ``ordinal``.

    Columns needed: job_id, group_id, employer, decision, score, posted_at, historical, delivered, cooling.  Groups go out as a whole
    for history, prior delivery and cooldown; a group is represented by the first of its fresh members.
    """
    good = ["strong_match", "possible_match"] + ["needs_review"] * include_review
    rows = candidates.withColumn("eligible", F.col("decision").isin(good))
    rows = cut(rows.withColumn("stale", freshness(F.col("posted_at"), at, F.lit(max_hours), F.lit(unknown_policy))))  # four branches read it
    state = rows.where("eligible").groupBy("group_id").agg(F.bool_or("historical").alias("g_hist"), F.bool_or("delivered").alias("g_deliv"))
    live = rows.where("eligible AND stale IS NULL").join(state.where("NOT g_hist AND NOT g_deliv"), "group_id", "left_semi")
    head = live.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc_nulls_last("posted_at"), "job_id"))).where("k = 1").drop("k")
    turns = round_robin(head.where("NOT cooling"), "employer", cap, priority())
    turns = turns.select("group_id", F.col("job_id").alias("rep"), "rn", F.coalesce(F.col("rn") <= quota, F.lit(False)).alias("taken"))
    chilled = head.where("cooling").select("group_id", F.lit(True).alias("g_cool"))
    out = rows.join(state, "group_id", "left").join(chilled, "group_id", "left").join(turns, "group_id", "left")
    said = (
        F.when(~F.col("eligible"), F.col("decision")).when(F.col("g_hist"), "historical").when(F.col("g_deliv"), "prior_delivery")
        .when(F.col("stale").isNotNull(), F.col("stale")).when(F.col("g_cool"), "employer_cooldown")
        .when(F.col("rep").isNotNull() & F.col("rn").isNull(), "company_duplicate_in_batch")
        .when(F.col("taken") & (F.col("rep") == F.col("job_id")), "selected_representative").when(F.col("taken"), "practical_duplicate").otherwise("outside_quota")
    )
    chosen = F.col("taken") & (F.col("rep") == F.col("job_id")) & F.col("eligible")
    return out.select(*candidates.columns, said.alias("disposition"), F.when(chosen, F.col("rn")).alias("ordinal"))


# Why a group without a fresh member is held back, the gravest first.
HELD_BACK = ["posting_time_invalid", "posting_age_unknown", "stale_posting"]


def counts(assembled: DataFrame, include_review: bool = False) -> DataFrame:
    """The counters of an assembled batch (``assemble``), one row: postings by decision, groups by what became of them.

    A group is counted as historical, delivered or cooling as a whole; one without a fresh member under the gravest reason of its members.
    """
    good = ["strong_match", "possible_match"]
    d, disposition = F.col("decision"), F.col("disposition")
    eligible = d.isin(good + ["needs_review"] * include_review)
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    grave = F.min(F.when(eligible, F.array_position(F.array(*map(F.lit, HELD_BACK)), disposition)).cast("int"))
    groups = assembled.groupBy("group_id").agg(
        flag(d.isin(good)).alias("matched"), flag(eligible).alias("eligible"), flag(eligible & (disposition == "historical")).alias("historical"), flag(eligible & (disposition == "prior_delivery")).alias("delivered"),
        flag(eligible & disposition.isin("employer_cooldown", "company_duplicate_in_batch", "selected_representative", "practical_duplicate", "outside_quota")).alias("fresh"), flag(eligible & (disposition == "employer_cooldown")).alias("cooling"),
        flag(eligible & (disposition == "company_duplicate_in_batch")).alias("capped"), flag(disposition == "selected_representative").alias("selected"), grave.alias("grave"),
        F.min(F.when(eligible & disposition.isin("company_duplicate_in_batch", "selected_representative", "practical_duplicate", "outside_quota"), F.col("employer"))).alias("employer"),
    )
    open_ = F.col("fresh") & ~F.col("cooling")
    held = lambda i: F.count_if(F.col("eligible") & ~F.col("fresh") & ~F.col("historical") & ~F.col("delivered") & (F.col("grave") == i))
    whole = groups.agg(
        F.count_if("matched").alias("match_eligible_groups"), F.count_if("eligible").alias("selection_eligible_groups"), F.count_if("historical").alias("historically_suppressed_groups"), F.count_if("delivered").alias("previously_delivered_groups"),
        F.count_if("fresh").alias("fresh_eligible_groups"), F.count_distinct(F.when(open_, F.col("employer"))).alias("fresh_eligible_employers"), F.count_if("cooling").alias("employer_cooldown_suppressed_groups"),
        held(3).alias("stale_posting_suppressed_groups"), held(2).alias("unknown_age_suppressed_groups"), held(1).alias("invalid_time_suppressed_groups"), F.count_if(F.col("capped") & ~F.col("selected")).alias("company_cap_suppressed_groups"), F.count_if("selected").alias("selected_groups"),
    )
    each = assembled.agg(
        F.count("*").alias("candidate_postings"), F.count_if(d.isin(good)).alias("match_eligible_postings"), F.count_if(d == "needs_review").alias("needs_review_postings"), F.count_if(d == "reject").alias("rejected_postings"),
        F.count_if(eligible).alias("selection_eligible_postings"),
    )
    return each.crossJoin(F.broadcast(whole)).withColumn("duplicate_postings_collapsed", F.col("selection_eligible_postings") - F.col("selection_eligible_groups"))
