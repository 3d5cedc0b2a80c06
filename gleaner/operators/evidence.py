"""What earlier deliveries, batches and runs say about postings: bases, guards, ladders, histories, complete sets, and sums of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.operators.batch import ranked

IDENTITY = ["source", "source_board_id", "source_job_id"]


def surfaced_basis(postings: DataFrame, historical: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """``postings`` (client_id, source, source_board_id, source_job_id, canonical_url) with ``basis``, the first that holds of ``identity``, ``url`` (a historical link of
    the client), ``observed_identity`` and ``observed_url`` (a link seen at the destination), else NULL.

    Links have client_id, the identity's columns and normalized_url, and if ``postings`` has a column destination, observed ones are of that one.
    Four equality joins, never a nested OR; NULLs match nothing.
    """
    out, found = postings, []
    tables = [("", historical, ["client_id"])] + ([("observed_", observed, ["client_id", "destination"])] if observed is not None else [])
    for prefix, links, where in tables:
        for name, columns in (("identity", IDENTITY), ("url", ["canonical_url"])):
            known = links.withColumnRenamed("normalized_url", "canonical_url").select(*where, *columns).distinct()
            out = out.join(known.withColumn(f"__{prefix}{name}", F.lit(f"{prefix}{name}")), [*where, *columns], "left")
            found.append(f"__{prefix}{name}")
    return out.select(*postings.columns, F.coalesce(*found).alias("basis"))


def release_guard(batches: DataFrame) -> DataFrame:
    """``batches`` with ``guard``, the first that holds of: ``not_owned`` (client or destination isn't the profile's), ``already_delivered``, ``recover_journal`` (the export's
    digest is at the destination already, so only the ledger is completed), ``mode_changed`` (auto release of a batch with matches for review), ``paused`` and
    ``quota_exceeded``, else ``ready``; and ``remaining`` of the day's quota.

    Needs client_id, destination_id, profile_client_id, profile_destination_id, status, export_after, observed_digest, delivery_mode, include_review, profile_status,
    selected, daily_quota and delivered_today.
    """
    remaining = F.greatest(F.lit(0), F.col("daily_quota") - F.coalesce("delivered_today", F.lit(0)))
    owned = F.coalesce((F.col("client_id") == F.col("profile_client_id")) & (F.col("destination_id") == F.col("profile_destination_id")), F.lit(False))
    guard = (
        F.when(~owned, "not_owned").when(F.col("status") == "delivered", "already_delivered").when(F.col("export_after") == F.col("observed_digest"), "recover_journal")
        .when((F.col("delivery_mode") == "auto") & F.col("include_review"), "mode_changed").when(~F.coalesce(F.col("profile_status") == "active", F.lit(False)), "paused").when(F.col("selected") > remaining, "quota_exceeded").otherwise("ready")
    )
    return batches.withColumn("remaining", remaining).withColumn("guard", guard)


def ordered_digest(rows: DataFrame, sets: list[str], order: list[str], said: Column, unique: list[str] | None = None) -> DataFrame:
    """A digest of each set's rows in their order, and ``parts``; with ``unique``, a set with two rows of these values is an error."""
    part = F.struct(*order, said.alias("__said"), *([F.struct(*unique).alias("__once")] if unique else []))
    listed = rows.groupBy(*sets).agg(F.sort_array(F.collect_list(part)).alias("p"))
    digest = F.sha2(F.array_join(F.transform("p", lambda x: x["__said"]), ","), 256)
    if unique:
        once = F.size(F.array_distinct(F.transform("p", lambda x: x["__once"]))) == F.size("p")
        digest = F.when(once, digest).otherwise(F.raise_error(F.lit("a set has a candidate twice")).cast("string"))
    return listed.select(*sets, digest.alias("digest"), F.size("p").cast("long").alias("parts"))


def history(events: DataFrame, subject: list[str], order: list[str], value: str) -> DataFrame:
    """``events`` with their ``version`` in the subject's order and the value ``before``."""
    own = Window.partitionBy(*subject).orderBy(*order)
    return events.withColumn("version", F.row_number().over(own).cast("long")).withColumn("before", F.lag(value).over(own))


def frozen(items: DataFrame, batch: str, ordinal: str, item: str) -> DataFrame:
    """A batch's ``items`` by ordinal, how many, and whether they are ``whole``: ordinals from 1 to their number."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(ordinal, item))), lambda x: x[item].cast("string")), ",")
    whole = (F.count("*") == F.max(ordinal)) & (F.min(ordinal) == 1) & (F.count_distinct(ordinal) == F.count("*"))
    return items.groupBy(batch).agg(F.count("*").alias("items"), whole.alias("whole"), listed.alias("frozen"))


def group_pages(members: DataFrame, group: str, member: str, delivered: Column, order: list[str]) -> DataFrame:
    """Groups with their number of ``members``, and as ``representative`` the first in order, but only where a delivery is recorded."""
    return members.groupBy(group).agg(F.count("*").alias("members"), F.min_by(member, F.struct(*order)).alias("__first"), F.bool_or(F.coalesce(delivered, F.lit(False))).alias("__sent")).select(
        group, "members", F.when(F.col("__sent"), F.col("__first")).alias("representative"))


def latest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate that is combined before its shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__last")).select(key, "__last.*")


def complete_sets(parts: DataFrame, sets: list[str], number: str, declared: DataFrame | None = None) -> DataFrame:
    """Whether a set's parts are exactly those from 1 to their declared number (of ``declared(sets, declared)``, else as many as there are rows): ``complete``, ``missing`` and ``repeated``."""
    there = parts.groupBy(*sets).agg(F.count(number).alias("__n"), F.count_distinct(number).alias("__different"), F.min(number).alias("__lo"), F.max(number).alias("__hi"))
    met = there.withColumn("declared", F.col("__n")) if declared is None else declared.join(there, sets, "full").withColumn("declared", F.coalesce("declared", F.lit(0))).na.fill(0, ["__n", "__different"])
    whole = (F.col("__different") == F.col("declared")) & (F.col("__n") == F.col("declared")) & ((F.col("declared") == 0) | ((F.col("__lo") == 1) & (F.col("__hi") == F.col("declared"))))
    return met.select(*sets, F.coalesce(whole, F.lit(False)).alias("complete"), F.greatest(F.lit(0), F.col("declared") - F.col("__different")).alias("missing"), (F.col("__n") - F.col("__different")).alias("repeated"))


def exploded_identities(artifacts: DataFrame, keep: Column, lists: str, key: str, into: str) -> DataFrame:
    """Distinct identities in the lists of the artifacts that are kept."""
    return artifacts.where(keep).select(key, F.explode(lists).alias(into)).distinct()


def exactly_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with how many of a value they are bound to: ``bound`` only by exactly one, which is ``value`` (the least, if there are several)."""
    return rows.groupBy(key).agg((F.count(value) == 1).alias("bound"), F.min(value).alias(value))


def resolved(asked: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """``asked`` keys with what they ``resolved`` to, and the ``outcome``: ``resolved``, ``missing``, or ``ambiguous`` with several."""
    found = known.groupBy(key).agg(F.count_distinct(value).alias("__n"), F.min(value).alias("__v"))
    met = asked.select(key).join(found, key, "left")
    return met.select(key, F.when(F.col("__n") == 1, F.col("__v")).alias("resolved"), F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").otherwise("resolved").alias("outcome"))


def projected(postings: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``postings`` (history, delivered) with their ``outcome`` in a delivery: ``identity``, ``url``, ``delivered``, ``duplicate`` (not its group's first) or ``fresh``."""
    first = postings.groupBy(group).agg(F.min(F.struct(*order)).alias("__first"))
    met = postings.join(first, group, "left")
    again = ~F.coalesce(F.struct(*order) == F.col("__first"), F.lit(True))
    return met.withColumn("outcome", F.when(F.col("history").isNotNull(), F.col("history")).when(F.coalesce("delivered", F.lit(False)), "delivered").when(again, "duplicate").otherwise("fresh")).drop("__first")


def outcome_ladder(candidates: DataFrame, order: list, cap: int) -> DataFrame:
    """``candidates`` with their ``outcome``, the first rung that holds: ``reject``, ``historical``, ``delivered``, a freshness disposition (``stale``), ``not_eligible``, ``duplicate`` (not the first
    of its group in the ascending ``order``), ``company_cap`` (beyond the employer's ``cap``), else ``deliverable``.

    Needs decision, historical, delivered, stale (NULL if fresh), eligible, group_id (NULL: alone) and employer.  Each rung only counts those that passed the ones before.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    early = F.when(F.col("decision") == "reject", "reject").when(flag("historical"), "historical").when(flag("delivered"), "delivered").when(F.col("stale").isNotNull(), F.col("stale")).when(~F.coalesce("eligible", F.lit(True)), "not_eligible")
    alone = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))  # rows without a group aren't one group
    rows = candidates.withColumn("__early", early).withColumn("__group", F.coalesce(F.col("group_id").cast("string"), alone))
    turn = Window.partitionBy("__group", F.col("__early").isNull()).orderBy(*order)
    rows = rows.withColumn("__early", F.when(F.col("__early").isNull() & (F.row_number().over(turn) > 1), "duplicate").otherwise(F.col("__early"))).withColumn("__open", F.col("__early").isNull())
    placed = ranked(rows, ["employer", "__open"], order, "__place")
    return placed.withColumn("outcome", F.coalesce("__early", F.when(F.col("__place") > cap, "company_cap").otherwise("deliverable"))).drop("__early", "__group", "__open", "__place")


def two_passes(first: DataFrame, second: DataFrame, target: str) -> DataFrame:
    """Deliveries of two runs over the same input, by target and in all (NULL): ``first_pass``, ``second_pass`` and ``not_idle`` targets, of which there must be none."""
    a, b = first.groupBy(target).agg(F.count("*").alias("first_pass")), second.groupBy(target).agg(F.count("*").alias("second_pass"))
    met = a.join(b, target, "full").na.fill(0, ["first_pass", "second_pass"])
    return met.groupingSets([[F.col(target)], []], target).agg(F.count("*").alias("targets"), F.sum("first_pass").alias("first_pass"), F.sum("second_pass").alias("second_pass"), F.count_if(F.col("second_pass") > 0).alias("not_idle"))


def hand_off(targets: DataFrame, runs: DataFrame, target: str, open_: Column) -> DataFrame:
    """Targets by what has become of them in a run: ``not_started``, ``running`` (something is open) or ``done``."""
    state = runs.groupBy(target).agg(F.bool_or(F.coalesce(open_, F.lit(False))).alias("__open"))
    met = targets.select(target).join(state, target, "left")
    return met.select(target, F.when(F.col("__open").isNull(), "not_started").when(F.col("__open"), "running").otherwise("done").alias("disposition"))


def compared_sets(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """How many keys only one of two tables has, and how many ``both``: ``first_only``, ``second_only``."""
    a, b = (t.select(F.col(key).alias("__key")).distinct().withColumn(side, F.lit(True)) for t, side in ((first, "__a"), (second, "__b")))
    met = a.join(b, "__key", "full")
    return met.agg(F.count_if(F.col("__b").isNull()).alias("first_only"), F.count_if(F.col("__a").isNull()).alias("second_only"), F.count_if(F.col("__a") & F.col("__b")).alias("both"))


def class_summary(rows: DataFrame, by: str, admitted: Column, targets: str) -> DataFrame:
    """By class: rows ``n``, ``admitted`` ones, and distinct ``targets``."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(admitted, F.lit(False))).alias("admitted"), F.count_distinct(targets).alias("targets"))
