"""What happens to a prepared batch before it goes out: evidence, review, removals, the checks at release, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, TimestampType

from gleaner.functions import text as T
from gleaner.functions.values import freshness

#: Ordinals of a bucket in which removals are counted.
BUCKET = 100_000
# Fields that hourly collection and evaluation change without changing posting or match.
VOLATILE = {"discovered_at", "last_seen_at", "evaluated_at"}
# How a failure begins that only says that time has passed.
NO_LONGER_FRESH = "prepared posting is no longer fresh at delivery:"


def _json(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return T.json_string(value, ascii_only=False)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _json(x, kind.elementType)), ","), F.lit("]")), F.lit("null"))
    if isinstance(kind, TimestampType):
        return F.coalesce(F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"')), F.lit("null"))
    return F.coalesce(F.lower(value.cast("string")) if isinstance(kind, BooleanType) else value.cast("string"), F.lit("null"))


def canonical(rows: DataFrame, columns: list[str], unordered: tuple[str, ...] = ()) -> Column:
    """Columns as one JSON object: names in order, no blanks, other characters as they are; ``unordered`` lists are sorted."""
    kinds = {f.name: f.dataType for f in rows.schema}
    said = [F.concat(F.lit(f'"{c}":'), _json(F.array_sort(F.col(c)) if c in unordered else F.col(c), kinds[c])) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *said), F.lit("}"))


def evidence(rows: DataFrame, posting: list[str], match: list[str]) -> Column:
    """The digest of a posting and its match, columns of one table, without what collection and evaluation stamp on them."""
    keep = lambda columns: [c for c in columns if c not in VOLATILE]
    return F.sha2(F.concat(F.lit("["), canonical(rows, keep(posting), ("eligible_countries",)), F.lit(","), canonical(rows, keep(match)), F.lit("]")), 256)


def _selectable(decision: Column, review: Column) -> Column:
    return decision.isin("strong_match", "possible_match") | (review & (decision == "needs_review"))


def _met(items: DataFrame, candidates: DataFrame, batches: DataFrame, at: Column) -> DataFrame:
    """Each item with its candidate as it is now and its batch's policy."""
    now = candidates.select("batch_id", "job_id", F.col("evidence_sha256").alias("__now"), "group_id", "posted_at", "decision", "historical", "delivered")
    policy = batches.select("batch_id", "status", "max_hours", "unknown_policy", "include_review", F.coalesce(F.col("export_before").isNotNull() | F.col("export_after").isNotNull(), F.lit(False)).alias("journaled"))
    met = items.join(policy, "batch_id").join(now, ["batch_id", "job_id"], "left")
    return met.withColumns({
        "evidence_verified": F.coalesce(F.col("__now") == F.col("evidence_sha256"), F.lit(False)), "stale": freshness(F.col("posted_at"), at, F.col("max_hours"), F.col("unknown_policy")),
        "historical": F.coalesce("historical", F.lit(False)), "delivered": F.coalesce("delivered", F.lit(False)), "eligible": F.coalesce(_selectable(F.col("decision"), F.col("include_review")), F.lit(False)),
    })


# What a reviewer is told.
_WARNINGS = {
    "changed": "Job or match evidence changed after this review batch was prepared.",
    "stale_posting": "This job is now older than the client's freshness limit.",
    "posting_age_unknown": "Posting age is unknown and the client policy does not allow unknown age.",
    "posting_time_invalid": "The posting time is invalid for delivery.",
    "historical": "This job now appears in the client's prior-surfacing history.",
    "delivered": "An equivalent job has already been delivered to this destination.",
    "review": "The deterministic matcher requires human review for this job.",
    "ineligible": "This job is no longer eligible under the prepared batch policy.",
}


def review(items: DataFrame, candidates: DataFrame, batches: DataFrame, at: Column) -> DataFrame:
    """A row per item of a prepared batch as a reviewer sees it: ``evidence_verified``, ``release_ready`` and ``warnings``, and of its batch
    ``safe_to_release`` (prepared, not journaled, every item ready) and ``recovery_required``.

    ``items`` has batch_id, ordinal, job_id and evidence_sha256; ``candidates`` batch_id, job_id and, as they are now, evidence_sha256, group_id,
    posted_at, decision, historical and delivered; ``batches`` batch_id, status, max_hours, unknown_policy, include_review, export_before, export_after.
    """
    met = _met(items, candidates, batches, at)
    ready = F.col("evidence_verified") & F.col("stale").isNull() & ~F.col("historical") & ~F.col("delivered") & F.col("eligible")
    told = lambda when, key: F.when(when, F.lit(_WARNINGS[key]))
    to_review = F.coalesce(F.col("decision") == "needs_review", F.lit(False))
    warnings = [told(~F.col("evidence_verified"), "changed")] + [told(F.col("stale") == k, k) for k in ("stale_posting", "posting_age_unknown", "posting_time_invalid")]
    warnings += [told(F.col("historical"), "historical"), told(F.col("delivered"), "delivered"), told(to_review, "review"), told(~F.col("eligible") & ~to_review, "ineligible")]
    rows = met.withColumns({"release_ready": ready, "warnings": F.array_compact(F.array(*warnings))})
    whole = rows.groupBy("batch_id").agg((F.bool_and("release_ready") & (F.max("status") == "prepared") & ~F.bool_or("journaled")).alias("safe_to_release"), F.bool_or("journaled").alias("recovery_required"))
    return rows.select("batch_id", "ordinal", "job_id", "decision", "evidence_verified", "release_ready", "warnings").join(whole, "batch_id")


def violations(items: DataFrame, candidates: DataFrame, batches: DataFrame, at: Column) -> DataFrame:
    """Items that forbid their batch's release, with the first check that fails: ``candidate_missing``, ``groups_merged`` (two items are one vacancy by now), a
    freshness disposition, ``evidence_changed``, ``historical``, ``decision`` or ``delivered``.  No rows, no objection."""
    met = _met(items, candidates, batches, at)
    twice = met.where("group_id IS NOT NULL").groupBy("batch_id", "group_id").agg(F.count("*").alias("__same"))
    met = met.join(twice, ["batch_id", "group_id"], "left")
    ladder = (
        F.when(F.col("__now").isNull(), "candidate_missing").when(F.col("__same") > 1, "groups_merged").when(F.col("stale").isNotNull(), F.col("stale"))
        .when(~F.col("evidence_verified"), "evidence_changed").when(F.col("historical"), "historical").when(~F.col("eligible"), "decision").when(F.col("delivered"), "delivered")
    )
    return met.select("batch_id", "ordinal", "job_id", ladder.alias("violation")).where("violation IS NOT NULL")


def renumbered(items: DataFrame, removed: DataFrame) -> DataFrame:
    """``items`` of batches without the ``removed(batch_id, ordinal)`` ones, their ordinals closed up.

    The order is frozen in the ordinals, so nothing is sorted anew: an ordinal falls by the number of removed ones before it, which is that of the
    buckets before its own (a row per bucket that lost something) and that within its bucket.
    """
    bucket = F.floor((F.col("ordinal") - 1) / BUCKET).alias("__bucket")
    gone = removed.select("batch_id", "ordinal").distinct().join(items.select("batch_id", "ordinal"), ["batch_id", "ordinal"], "left_semi")
    marked = items.join(gone.withColumn("__gone", F.lit(1)), ["batch_id", "ordinal"], "left").withColumn("__bucket", bucket).withColumn("__gone", F.coalesce("__gone", F.lit(0)))
    inside = Window.partitionBy("batch_id", "__bucket").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("batch_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    lost = marked.groupBy("batch_id", "__bucket").agg(F.sum("__gone").alias("__lost")).select("batch_id", "__bucket", F.coalesce(F.sum("__lost").over(earlier), F.lit(0)).alias("__before"))
    kept = marked.withColumn("__own", F.sum("__gone").over(inside)).where("__gone = 0").join(lost, ["batch_id", "__bucket"])
    return kept.withColumn("ordinal", (F.col("ordinal") - F.col("__own") - F.col("__before")).cast(items.schema["ordinal"].dataType)).select(*items.columns)


def remove_items(requests: DataFrame, batches: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Operators' removals from prepared batches: what became of each request, the batches and the items after it.

    ``requests`` has batch_id (one a batch), generation_id and ordinals.  The answer is the first that holds of ``no_generation``, ``nothing_asked``,
    ``not_positive``, ``no_batch``, ``revision_changed``, ``not_editable``, ``unknown_item`` and ``every_item``, else ``removed``: then the batch has a new generation.
    """
    known = batches.select("batch_id", F.col("generation_id").alias("__generation"), "status", "export_before", "export_after")
    asked = requests.select("batch_id", "generation_id", F.array_distinct("ordinals").alias("ordinals"))
    wanted = asked.select("batch_id", F.explode("ordinals").alias("ordinal"))
    hits = wanted.join(items.select("batch_id", "ordinal"), ["batch_id", "ordinal"], "left_semi").groupBy("batch_id").agg(F.count("*").alias("__hits"))
    sizes = items.groupBy("batch_id").agg(F.count("*").alias("__size"))
    met = asked.join(known, "batch_id", "left").join(hits, "batch_id", "left").join(sizes, "batch_id", "left").na.fill(0, ["__hits", "__size"])
    n = F.size("ordinals")
    editable = (F.col("status") == "prepared") & F.col("export_before").isNull() & F.col("export_after").isNull()
    answer = (
        F.when(F.col("generation_id").isNull(), "no_generation").when(n == 0, "nothing_asked").when(F.array_min("ordinals") < 1, "not_positive").when(F.col("__generation").isNull(), "no_batch")
        .when(F.col("generation_id") != F.col("__generation"), "revision_changed").when(~F.coalesce(editable, F.lit(False)), "not_editable").when(F.col("__hits") < n, "unknown_item").when(n >= F.col("__size"), "every_item").otherwise("removed")
    )
    new = F.sha2(F.concat_ws("\x1f", "batch_id", "generation_id", F.array_join(F.array_sort("ordinals").cast("array<string>"), ",")), 256)
    answers = met.select("batch_id", answer.alias("answer"), F.when(answer == "removed", new).alias("new_generation"), "ordinals")
    done = answers.where("answer = 'removed'")
    after = batches.join(done.select("batch_id", "new_generation"), "batch_id", "left").withColumn("generation_id", F.coalesce("new_generation", "generation_id")).select(*batches.columns)
    return answers.drop("ordinals"), after, renumbered(items, done.select("batch_id", F.explode("ordinals").alias("ordinal")))


def recover(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is unresolved at each client's destinations: batches that can be discarded, and the ``next`` one that needs an action.

    In the order of assembly: a batch that failed only because time had passed, with nothing written, goes; the first other one that is prepared or has a
    journal is next (``release`` or ``reconcile``).  Other failures stay and are passed over, and discarding ends at the next one.
    """
    where = ["client_id", "destination"]
    stale = (F.col("status") == "failed") & F.startswith(F.coalesce("error", F.lit("")), F.lit(NO_LONGER_FRESH)) & F.col("delivered_at").isNull()
    journaled = F.col("export_before").isNotNull() | F.col("export_after").isNotNull()
    open_ = batches.where(F.col("status") != "delivered").withColumns({"__stale": stale & ~journaled, "__journaled": journaled}).where((F.col("status") == "prepared") | F.col("__journaled") | stale)
    order = F.struct("assembled_at", "batch_id")
    first = open_.where("NOT __stale").groupBy(*where).agg(F.min(order).alias("__next"), F.min_by("__journaled", order).alias("__journal"))
    discard = open_.where("__stale").join(first, where, "left").where(F.col("__next").isNull() | (order < F.col("__next")))
    following = first.select(*where, F.col("__next.batch_id").alias("batch_id"), F.when(F.col("__journal"), "reconcile").otherwise("release").alias("action"))
    return discard.select("batch_id"), following

