"""Keyed state: upserts, ledgers, suppression, retention, versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def latest(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__k", place).where(F.col("__k") <= n).drop("__k")


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Every key of either side with its ``lifecycle``: new, seen or changed if it arrived, else kept.

    The later of repeated arrivals (column ``pos``) wins; a repeat that differs from the one before it is a change.
    """
    turn = Window.partitionBy(*keys).orderBy("pos")
    moved = arriving.withColumn("__before", F.lag(fingerprint).over(turn)).withColumn("__again", F.lag("pos").over(turn).isNotNull())
    last = latest(moved, keys, [F.desc("pos")]).select(*keys, F.col(fingerprint).alias("__new"), "__before", "__again")
    old = stored.select(*keys, F.col(fingerprint).alias("__old"))
    base = F.when(F.col("__again"), F.col("__before")).otherwise(F.col("__old"))
    first = F.col("__old").isNull() & ~F.coalesce("__again", F.lit(False))
    life = F.when(F.col("__new").isNull(), "kept").when(first, "new").when(base.eqNullSafe(F.col("__new")), "seen").otherwise("changed")
    return old.join(last, keys, "full").select(*keys, life.alias("lifecycle"), F.coalesce("__new", "__old").alias(fingerprint))


def either_semi(rows: DataFrame, group: str, *evidence: tuple[DataFrame, list[str]]) -> DataFrame:
    """Groups with a member that meets any of the evidence tables: an OR of equi joins as a union of semi joins."""
    found = [rows.join(table.select(*on).distinct(), on, "left_semi").select(group) for table, on in evidence]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def retention_class(basis: Column, cutoff: Column, unresolved: Column, delivered: Column) -> Column:
    """What happens to a posting at the end of its retention."""
    return F.when(basis >= cutoff, "keep").when(unresolved, "skip_unresolved").when(delivered, "compact").otherwise("delete")


def coverage_state(observations: DataFrame, target: str, at: str, status: str) -> DataFrame:
    """First, previous and last successful observation of each target, and their number."""
    good = observations.where(F.col(status).isin("success", "partial"))
    times = good.select(target, at).distinct()
    last = Window.partitionBy(target).orderBy(F.desc(at))
    ranked = times.withColumn("k", F.row_number().over(last))
    return ranked.groupBy(target).agg(F.min(at).alias("first_at"), F.max(F.when(F.col("k") == 2, F.col(at))).alias("previous_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))


def previous(rows: DataFrame, keys: list[str], at: str) -> Column:
    """The latest time strictly before a row's own, per key; rows of the same time see the same one."""
    before = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(at))).rangeBetween(Window.unboundedPreceding, -1)
    return F.max(at).over(before)


def versions(events: DataFrame, subject: list[str], order: list, expected: str) -> DataFrame:
    """Append-only outcomes: an event whose expected version isn't the subject's number of accepted events so far is refused.

    Accepting is a fold: each subject's sorted rows stream through two counters, and none are collected.
    """
    kinds = events.select(*subject).schema
    schema = StructType([*kinds.fields, *(StructField(c, LongType()) for c in ("version", "events", "refused"))])
    turn = events.repartition(*subject).sortWithinPartitions(*subject, *order, expected)

    def fold(batches):
        last, version, seen = None, 0, 0
        done: list[tuple] = []

        def rows(like):
            columns = list(zip(*done)) or [()] * len(schema)
            types = [*(like.field(i).type for i in range(len(subject))), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], schema.names)

        for batch in batches:
            like = batch.schema
            *keys, wanted = (batch.column(i).to_pylist() for i in range(len(subject) + 1))
            for key, want in zip(zip(*keys), wanted):
                if key != last:
                    if seen:
                        done.append((*last, version, seen, seen - version))
                    last, version, seen = key, 0, 0
                seen += 1
                version += want == version
            yield rows(like)
            done.clear()
        if seen:
            done.append((*last, version, seen, seen - version))
            yield rows(like)

    return turn.select(*subject, F.col(expected)).mapInArrow(fold, schema)


def streaks(rows: DataFrame, keys: list[str], order: list, failed: Column) -> DataFrame:
    """Length of the run of failures that each key ends with."""
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    broken = F.sum(F.when(failed, 0).otherwise(1)).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__b", broken).groupBy(*keys).agg(F.count_if(F.col("__b") == 0).alias("streak"))


def multiset_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of a table that doesn't depend on row order: counts and digests of rows, summed as wide integers."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("n"), F.concat_ws(":", part(0), part(1), part(2)).alias("digest"))
