"""What happens to stored postings, targets and batches: stale identities, invalidation, retention, health, schedules, states."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.operators.state import retention_class

# Hours until a target of a health class is looked at again.
CHECK_AGAIN = {"active": 24, "empty": 168, "missing": 72}
CHECK_FAILED = 6
#: What a batch can become, by what it is.
NEXT = {None: {"prepare"}, "prepare": {"finalize", "fail", "discard"}, "fail": {"prepare", "discard"}, "finalize": set(), "discard": {"prepare"}}


def stale_identities(ledger: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger after an incremental run that only saw some identities: ``first_at`` of the first sighting stays, ``last_at`` moves
    on, and evidence is replaced where there is new one.  ``seen`` has the keys, ``at`` and ``evidence``."""
    new = seen.groupBy(*keys).agg(F.min("at").alias("__first"), F.max("at").alias("__last"), F.max_by("evidence", "at").alias("__evidence"))
    met = ledger.join(new, keys, "full")
    return met.select(*keys, F.coalesce("first_at", "__first").alias("first_at"), F.greatest("last_at", "__last").alias("last_at"), F.coalesce("__evidence", "evidence").alias("evidence"))


def invalidated(postings: DataFrame, gone: DataFrame, key: str, heavy: list[str]) -> DataFrame:
    """``postings`` with those in ``gone`` closed and without their heavy fields; identities stay."""
    flag = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    met = postings.join(flag, key, "left")
    dead = F.col("__gone").isNotNull()
    return met.withColumns({c: F.when(~dead, F.col(c)) for c in heavy} | {"lifecycle": F.when(dead, "closed").otherwise(F.col("lifecycle"))}).drop("__gone")


def safe_to_invalidate(results: DataFrame, board: str, status: str) -> DataFrame:
    """Boards all of whose shards succeeded: only their missing postings are gone."""
    return results.groupBy(board).agg(F.bool_and(F.col(status) == "success").alias("safe"), F.count("*").alias("shards"))


def pruned(postings: DataFrame, cutoff: Column, basis: Column, unresolved: DataFrame, delivered: DataFrame, key: str, heavy: list[str]) -> DataFrame:
    """``postings`` after retention, with ``retention``: unresolved ones stay, delivered ones lose their heavy fields, others go."""
    flag = lambda table, name: table.select(key).distinct().withColumn(name, F.lit(True))
    met = postings.join(flag(unresolved, "__u"), key, "left").join(flag(delivered, "__d"), key, "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(False))
    met = met.withColumn("retention", retention_class(basis, cutoff, some("__u"), some("__d"))).where("retention != 'delete'")
    return met.withColumns({c: F.when(F.col("retention") != "compact", F.col(c)) for c in heavy}).drop("__u", "__d")


def without_old_runs(members: DataFrame, runs: DataFrame, run: str, cutoff: Column) -> DataFrame:
    """Run memberships without those of runs completed before the cutoff; runs themselves (receipts) aren't touched."""
    return members.join(runs.where(F.col("completed_at") < cutoff).select(run), run, "left_anti")


def observed_targets(seen: DataFrame, key: str, coordinates: str, at: str, evidence: str) -> DataFrame:
    """A row per target: first and last sighting, distinct evidence, and ``conflict`` if its coordinates ever changed."""
    return seen.groupBy(key).agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count_distinct(evidence).alias("evidence"), F.max_by(coordinates, at).alias("coordinates"),
        (F.min(coordinates) != F.max(coordinates)).alias("conflict"),
    )


def check_after(health: Column) -> Column:
    """Hours until the next check of a health class."""
    chain = reduce(lambda e, x: e.when(health == x[0], x[1]), CHECK_AGAIN.items(), F)
    return chain.otherwise(CHECK_FAILED)


def health_state(checks: DataFrame, target: str, at: str, health: str) -> DataFrame:
    """Per target: latest class, when it was first active (admission, the first one wins) and when it is due again."""
    last = checks.groupBy(target).agg(F.max(at).alias("checked_at"), F.max_by(health, at).alias("health"), F.min(F.when(F.col(health) == "active", F.col(at))).alias("admitted_at"))
    due = F.timestamp_micros(F.unix_micros(F.col("checked_at").cast("timestamp")) + check_after(F.col("health")).cast("long") * F.lit(3_600_000_000).cast("long"))
    return last.withColumn("admitted", F.col("health") == "active").withColumn("next_check_at", due)


def admitted(states: DataFrame, at: Column, max_hours: int = 48) -> DataFrame:
    """Targets that are active and were checked within ``max_hours``."""
    age = F.unix_micros(at) - F.unix_micros(F.col("checked_at").cast("timestamp"))
    return states.where(F.col("admitted") & (age <= max_hours * 3_600_000_000))


def due_cohorts(completed: DataFrame, source: str, cohort: str, now: Column, most: int) -> DataFrame:
    """Per source: the cohort after the last contiguously completed one; what lies more than ``most`` behind is skipped, and the
    skipped range said.  Completed cohorts beyond a gap don't count."""
    own = Window.partitionBy(source).orderBy(cohort)
    run = completed.select(source, cohort).distinct().withColumn("k", F.row_number().over(own))
    first = run.groupBy(source).agg(F.min(cohort).alias("__first"))
    unbroken = run.join(first, source).where(F.col(cohort) - F.col("__first") == F.col("k") - 1)
    last = unbroken.groupBy(source).agg(F.max(cohort).alias("last"))
    due, least = F.col("last") + 1, now - most
    late = due < least
    return last.select(source, "last", F.when(late, least).otherwise(due).alias("due"), F.when(late, due).alias("skipped_from"), F.when(late, least - 1).alias("skipped_to"))


def batch_states(events: DataFrame, batch: str, order: list[str], action: str, generation: str) -> DataFrame:
    """Per batch its ``state``, ``generation`` (how often it was prepared), and how many events were applied and refused.

    An event is refused if the state doesn't allow it, or if it names another generation than the present one.  Each batch's
    sorted events stream through one state, and none are collected; rows come out where the next batch begins.
    """
    kind = events.select(batch).schema[0].dataType.simpleString()
    shape = f"{batch} {kind}, state string, generation long, applied long, refused long"
    turn = events.repartition(batch).sortWithinPartitions(batch, *order).select(batch, action, F.col(generation).cast("long"))

    def fold(batches):
        held, now = None, None

        def rows(done, like):
            columns = zip(*done) if done else [()] * 5
            kinds = [like.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], [batch, "state", "generation", "applied", "refused"])

        for part in batches:
            done, like = [], part.schema
            for key, what, of in zip(*(part.column(i).to_pylist() for i in range(3))):
                if now is None or key != held:
                    if now is not None:
                        done.append((held, *now))
                    held, now = key, (None, 0, 0, 0)
                state, generation_, applied, refused = now
                if what in NEXT[state] and (what == "prepare" or of == generation_):
                    now = (what, generation_ + (what == "prepare"), applied + 1, refused)
                else:
                    now = (state, generation_, applied, refused + 1)
            yield rows(done, like)
        if now is not None:
            yield rows([(held, *now)], like)

    return turn.mapInArrow(fold, shape)
