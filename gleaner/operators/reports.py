"""Reports over matched, grouped and delivered postings, and the small writes that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions.values import age_bucket, freshness

GOOD = ("strong_match", "possible_match")
# How the reasons begin that end a posting's way through the funnel.
TITLE, MARKET, REMOTE = ("title does not match a configured target role",), ("target market ",), ("work mode ", "remote status ")
#: Age buckets as a column is named.
AGES = {"0-24h": "age_0_24h", "24-48h": "age_24_48h", "48-72h": "age_48_72h", ">72h": "age_over_72h", "unknown": "age_unknown", "invalid": "age_invalid"}


def client_funnel(matched: DataFrame, at: Column) -> DataFrame:
    """The funnel of a client's retained postings, by ``source`` (in lower case, ``unknown`` if blank) and overall (NULL).

    ``matched`` has source, decision, rejection_reasons and posted_at.  Twelve counters: all postings by decision, those of the last
    day by decision, and how many of these survive title, target market, work mode and all other rules; six more for the ages of matches.
    """
    said = lambda starts: F.exists(F.coalesce("rejection_reasons", F.array().cast("array<string>")), lambda r: _any(F.startswith(r, F.lit(s)) for s in starts))
    good, asks = F.col("decision").isin(*GOOD), F.col("decision") == "needs_review"
    bucket = age_bucket(F.col("posted_at"), at)
    fresh = bucket == "0-24h"
    title = fresh & ~said(TITLE)
    market = title & ~said(MARKET)
    remote = market & ~said(REMOTE)
    reject = ~good & ~asks
    counters = {
        "retained_evaluated": F.lit(True), "retained_confirmed_matches": good, "retained_needs_review_matches": asks, "retained_rejected": reject, "fresh_0_24h": fresh, "confirmed_matches_0_24h": fresh & good,
        "needs_review_matches_0_24h": fresh & asks, "rejected_0_24h": fresh & reject, "title_matched_0_24h": title, "target_market_survived_0_24h": market, "remote_survived_0_24h": remote, "other_rules_survived_0_24h": remote & ~reject,
    } | {name: ~reject & (bucket == b) for b, name in AGES.items()}
    source = F.coalesce(F.nullif(F.lower(F.btrim(F.col("source"))), F.lit("")), F.lit("unknown"))
    rows = matched.select(source.alias("source"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in counters.items()])
    return rows.groupingSets([[F.col("source")], []], "source").agg(*[F.count_if(n).alias(n) for n in counters])


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def matched_stats(matches: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Of good matches, by ``keys``: ``fresh_matches``, their distinct ``employers`` and ``groups``, and how many each freshness rule keeps back.

    ``matches`` has decision, employer_id, company, group_id, posted_at, max_hours and unknown_policy.
    """
    why = freshness(F.col("posted_at"), at, F.col("max_hours"), F.col("unknown_policy"))
    employer = F.coalesce("employer_id", F.lower(F.btrim(F.col("company"))))
    rows = matches.where(F.col("decision").isin(*GOOD)).withColumns({"__why": why, "__employer": employer})
    fresh = F.col("__why").isNull()
    return rows.groupBy(*keys).agg(
        F.count_if(fresh).alias("fresh_matches"), F.count_distinct(F.when(fresh, F.col("__employer"))).alias("employers"), F.count_distinct(F.when(fresh, F.col("group_id"))).alias("groups"),
        *[F.count_if(F.col("__why") == w).alias(w) for w in ("stale_posting", "posting_age_unknown", "posting_time_invalid")],
    )


def fresh_selection(candidates: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """The postings to deliver and four counters by ``keys``.

    ``candidates`` has job_id, group_id, history (``identity``, ``url`` or NULL) and delivered (of the group).  History suppresses a posting, earlier delivery
    its group; of what is left each group's first in ``order`` is selected.  A posting without a group is an error.
    """
    group = F.when(F.col("group_id").isNull(), F.raise_error(F.concat(F.lit("posting has no delivery group: "), F.col("job_id"))).cast("string")).otherwise(F.col("group_id"))
    rows = candidates.withColumn("group_id", group)
    left = F.col("history").isNull() & ~F.coalesce("delivered", F.lit(False))
    first = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, F.col("job_id")])])
    chosen = rows.where(left).groupBy(*keys, "group_id").agg(F.min_by("job_id", first).alias("job_id"))
    counts = rows.groupBy(*keys).agg(
        F.count_if(F.col("history") == "identity").alias("historical_identity"), F.count_if(F.col("history") == "url").alias("historical_url"),
        F.count_if(F.col("history").isNull() & F.coalesce("delivered", F.lit(False))).alias("already_delivered"), F.count_distinct(F.when(left, F.col("group_id"))).alias("selected"),
    )
    return chosen, counts


def target_capacity(rows: DataFrame) -> DataFrame:
    """A row per target of what its postings came to: lifecycles, decisions, history and groups.

    ``rows`` has target_identity, job_id, lifecycle, decision, history, group_id and delivered (of the posting's group).
    """
    good = F.col("decision").isin(*GOOD)
    new = good & F.col("history").isNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    groups = lambda c: F.count_distinct(F.when(c, F.col("group_id")))
    return rows.groupBy("target_identity").agg(
        F.count("job_id").alias("received"), *[count(F.col("lifecycle") == x).alias(f"lifecycle_{x}") for x in ("new", "seen", "changed", "closed")],
        *[count(F.col("decision") == x).alias(f"decision_{x}") for x in (*GOOD, "needs_review", "reject")], count(good).alias("delivery_eligible_matched"),
        count(good & (F.col("history") == "identity")).alias("historical_identity"), count(good & (F.col("history") == "url")).alias("historical_url"), count(new).alias("nonhistorical_matched"),
        (count(new) - groups(new)).alias("practical_duplicate_groups_collapsed"), groups(new & F.col("delivered")).alias("already_delivered_groups"),
        (groups(new) - groups(new & F.col("delivered"))).alias("fresh_unique_deliveries"),
    )


def group_replay(rows: DataFrame, family: str) -> DataFrame:
    """By source family: postings, matched ones, their groups, delivered leads and the duplicates that weren't delivered; ``rows`` has decision, group_id and delivered (of the posting)."""
    good = F.col("decision").isin(*GOOD)
    matched, delivered = F.count_if(F.coalesce(good, F.lit(False))), F.count_if(F.coalesce(F.col("delivered"), F.lit(False)))
    return rows.groupBy(family).agg(
        F.count("*").alias("source_postings"), matched.alias("matched_postings"), F.count_distinct(F.when(good, F.col("group_id"))).alias("matched_delivery_groups"),
        delivered.alias("delivered_leads"), (matched - delivered).alias("suppressed_duplicate_deliveries"),
    )


def prune_summary(rows: DataFrame) -> DataFrame:
    """How many rows retention passes over, compacts and deletes; ``rows`` has unresolved, selected_batch, candidate_batch, delivered and exported."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    used = flag("selected_batch") | flag("candidate_batch") | flag("delivered") | flag("exported")
    return rows.agg(F.count_if(flag("unresolved")).alias("skipped_unresolved"), F.count_if(~flag("unresolved") & used).alias("compacted_jobs"), F.count_if(~flag("unresolved") & ~used).alias("deleted_jobs"))


def production_summary(boards: DataFrame) -> DataFrame:
    """Totals over ``boards`` (status, discovered, normalized, quarantined, errors, delivered): overall (NULL) and by status, with the number of boards."""
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("discovered", "normalized", "quarantined", "errors", "delivered")]
    return boards.groupingSets([[F.col("status")], []], "status").agg(F.count("*").alias("boards"), *totals)


def inventory_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 10, "1-9").when(n < 50, "10-49").when(n < 100, "50-99").when(n < 500, "100-499").when(n >= 500, "500+")


def cost_tier(n: Column, exact: Column) -> Column:
    """What a target costs to read, by its inventory; one that may be cut off has a tier of its own."""
    return F.when(~F.coalesce(exact, F.lit(False)), "potentially_capped").when(n <= 49, "exact_1_49").when(n <= 99, "exact_50_99").when(n <= 499, "exact_100_499").otherwise("exact_500_plus")


def import_records(records: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records whose workbook (``client_id``, ``workbook_sha256``) isn't among ``imports`` yet, and a row per arriving workbook: ``imported`` and ``repeated`` records."""
    key = ["client_id", "workbook_sha256"]
    known = imports.select(*key).distinct().withColumn("__known", F.lit(True))
    met = records.join(known, key, "left")
    counts = met.groupBy(*key).agg(F.count_if(F.col("__known").isNull()).alias("imported"), F.count_if(F.col("__known").isNotNull()).alias("repeated"))
    return met.where("__known IS NULL").select(*records.columns), counts


def mark_exported(requests: DataFrame, members: DataFrame, deliveries: DataFrame, exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What exports add: rows of ``deliveries(group_id, client_id, destination, job_id, exported_at)`` and of ``exports(job_id, client_id, destination, exported_at)``.

    ``requests`` has job_id, client_id, destination and exported_at.  The first of a group (by time, then id) is its delivery, for good; a posting is exported only
    as its group's delivery.  A posting without a group is an error.
    """
    where = ["group_id", "client_id", "destination"]
    met = requests.join(members.select("job_id", "group_id"), "job_id", "left")
    group = F.when(F.col("group_id").isNull(), F.raise_error(F.concat(F.lit("posting has no delivery group: "), F.col("job_id"))).cast("string")).otherwise(F.col("group_id"))
    first = met.withColumn("group_id", group).groupBy(*where).agg(F.min(F.struct("exported_at", "job_id")).alias("f")).select(*where, "f.job_id", "f.exported_at")
    new = first.join(deliveries.select(*where), where, "left_anti")
    return new, new.select("job_id", "client_id", "destination", "exported_at").join(exports, ["job_id", "client_id", "destination"], "left_anti")


def edited(payload: Column, drop: list[str], overlay: dict[str, str] | None = None) -> Column:
    """JSON text of an object without some keys, and with others set to given JSON texts; keys in order, as all objects in it."""
    known = F.from_json(F.to_json(F.parse_json(payload)), "map<string,variant>")
    gone = [*drop, *(overlay or {})]
    left = F.map_filter(known, lambda k, v: ~k.isin(gone)) if gone else known
    if overlay:
        put = F.map_from_arrays(F.array(*map(F.lit, overlay)), F.array(*[F.parse_json(F.lit(v)) for v in overlay.values()]))
        left = F.map_concat(left, put)
    return F.to_json(F.parse_json(F.to_json(left)))


def refreshed(stored: Column, incoming: Column, volatile: list[str]) -> Column:
    """The payload to keep: the incoming one if it says something else than the stored one without volatile keys, else the stored one without them."""
    return F.when(edited(stored, volatile).eqNullSafe(edited(incoming, [])), edited(stored, volatile)).otherwise(incoming)


def compacted(payload: Column) -> Column:
    """A payload whose heavy fields are emptied, as retention leaves it."""
    return edited(payload, [], {"description_html": "null", "description_text": "null", "offices": "[]", "raw_metadata": "{}"})


def latest_members(memberships: DataFrame, merged: DataFrame) -> DataFrame:
    """``memberships(job_id, group_id)`` after groups were merged by a mapping ``merged(from_group, to_group)``."""
    met = memberships.join(merged.select(F.col("from_group").alias("group_id"), "to_group"), "group_id", "left")
    return met.select("job_id", F.coalesce("to_group", "group_id").alias("group_id"))


def health_changes(checks: DataFrame, target: str, at: str, health: str) -> DataFrame:
    """By reason of selection (``first_check`` or the class before): targets checked, ``newly_admitted`` (active for the first time) and ``reactivated`` (active again)."""
    turn = Window.partitionBy(target).orderBy(at)
    rows = checks.withColumns({"__before": F.lag(health).over(turn), "__was": F.max(F.col(health) == "active").over(turn.rowsBetween(Window.unboundedPreceding, -1))})
    active = (F.col(health) == "active") & (F.coalesce("__before", F.lit("")) != "active")
    return rows.groupBy(F.coalesce("__before", F.lit("first_check")).alias("reason")).agg(
        F.count("*").alias("checked"), F.count_if(active & ~F.coalesce("__was", F.lit(False))).alias("newly_admitted"), F.count_if(active & F.coalesce("__was", F.lit(False))).alias("reactivated"),
    )
