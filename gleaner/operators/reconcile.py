"""Differences of two large tables, suppression by digest, and fan-in of shards into one commit."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import text as T
from gleaner.operators.grouping import provider_identity
from gleaner.plans.shared import cut
from gleaner.sources import journal

#: Bits of a key's hash that one level of the digest tree looks at, levels at most, and differing leaves with which it ends.
FAN_BITS, LEVELS, ENOUGH = 12, 4, 1 << 14


def _hashed(rows: DataFrame, keys: list[str], values: list[str], side: str) -> DataFrame:
    key = F.xxhash64(F.lit("key"), *keys)
    whole = F.struct(*[F.col(c) for c in (*keys, *values)])
    marks = F.concat_ws("", *[F.col(c).isNull().cast("string") for c in (*keys, *values)])  # a hash passes over NULLs
    return rows.select(*keys, whole.alias(side), key.alias("__key"), *[F.xxhash64(F.lit(i), marks, whole).cast("decimal(20,0)").alias(f"__d{i}") for i in (0, 1)])


def _leaves(rows: DataFrame, level: int) -> DataFrame:
    """Count and two 64-bit digests, summed exactly, of the rows under each leaf of a level: 2**(FAN_BITS * level) leaves at most."""
    leaf = F.shiftrightunsigned("__key", 64 - FAN_BITS * level)
    return rows.groupBy(leaf.alias("__leaf")).agg(F.count("*").alias("n"), F.sum("__d0").alias("d0"), F.sum("__d1").alias("d1"))


def differing(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """The hashed rows of either table under the leaves in which the tables differ.

    Sums are combined before their shuffle, so a level moves a row per leaf and task; the next level looks only under leaves that differ, of
    which there are ``ENOUGH`` at most (they are broadcast): with more differences than that the rows under them are what has to move.
    """
    a, b = _hashed(first, keys, values, "__first"), _hashed(second, keys, values, "__second")
    for level in range(1, LEVELS + 1):
        x, y = _leaves(a, level), _leaves(b, level)
        same = ["n", "d0", "d1"]
        odd = x.join(y.select("__leaf", *[F.col(c).alias(f"{c}_") for c in same]), "__leaf", "full")
        odd = cut(odd.where(" OR ".join(f"{c} IS DISTINCT FROM {c}_" for c in same)).select("__leaf", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_", F.lit(0)).alias("n_")))
        found, rows = odd.agg(F.count("*"), F.sum(F.col("n") + F.col("n_"))).first()
        if found > ENOUGH:
            break  # what is left is too much to look under leaf by leaf; the last level's restriction holds
        leaves = F.broadcast(odd.select("__leaf"))
        under = lambda t: t.withColumn("__leaf", F.shiftrightunsigned("__key", 64 - FAN_BITS * level)).join(leaves, "__leaf", "left_semi").drop("__leaf")  # noqa: B023, E731
        a, b = under(a), under(b)
        if not found or rows <= 4 * found:  # few rows beside the different ones
            break
    return a, b


def differences(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys on which two tables differ, with ``status`` ``first_only``, ``second_only``, ``changed`` or ``repeated`` (a key with several rows in one table).

    NULLs are values like others.  Rows are shuffled only under leaves of the digest tree that differ.
    """
    a, b = differing(first, second, keys, values)
    one = lambda t, side: t.groupBy(*keys).agg(F.first(side).alias(side), F.count("*").alias(f"{side}_n"))
    a, b = one(a, "__first"), one(b, "__second")
    both = a.join(b.withColumnsRenamed({k: f"__{k}" for k in keys}), [a[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "full")
    n1, n2 = F.coalesce("__first_n", F.lit(0)), F.coalesce("__second_n", F.lit(0))
    status = F.when(F.greatest(n1, n2) > 1, "repeated").when(n2 == 0, "first_only").when(n1 == 0, "second_only").when(~F.col("__first").eqNullSafe(F.col("__second")), "changed")
    named = [F.when(n1 > 0, F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys]
    return both.select(*named, status.alias("status")).where("status IS NOT NULL")


def stability(first: DataFrame, second: DataFrame, keys: list[str], identity: list[str], content: str) -> DataFrame:
    """How two runs over the same source compare: ``first_only``, ``second_only``, ``common``, ``unstable`` (the identity moved) and ``content_changed``."""
    found = differences(first, second, keys, [*identity, content]).where("status != 'repeated'")
    moved = differences(first, second, keys, identity).where("status = 'changed'")
    counts = found.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("first_only", "second_only", "changed")])
    total = first.agg(F.count("*").alias("n")).crossJoin(F.broadcast(moved.agg(F.count("*").alias("unstable")))).crossJoin(F.broadcast(counts))
    return total.select("first_only", "second_only", (F.col("n") - F.col("first_only")).alias("common"), "unstable", (F.col("changed") - F.col("unstable")).alias("content_changed"))


def identity_digest() -> Column:
    """The digest under which a ledger knows a posting's provider identity."""
    said = [T.json_string(F.col(c), ascii_only=False) for c in ("source", "source_board_id", "source_job_id")]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *said), F.lit("]")), 256)


def url_digest() -> Column:
    return F.sha2(F.col("canonical_url"), 256)


def not_surfaced(postings: DataFrame, identities: DataFrame, urls: DataFrame) -> DataFrame:
    """Postings that a ledger of digests (one column each) knows neither by provider identity nor by URL.

    A posting's digests are made once, before two shuffles by them; as a filter's condition they would be made for every use of it.
    """
    rows = postings.withColumn("__i", identity_digest()).withColumn("__u", url_digest())
    for key, ledger in (("__i", identities), ("__u", urls)):
        rows = rows.join(ledger.toDF(key), key, "left_anti")
    return rows.select(*postings.columns)


def fan_in(rows: DataFrame, shards: DataFrame, folder: str, batch: str, now: datetime.datetime, retention_hours: int | None = None, invalidated: DataFrame | None = None) -> None:
    """Persist what shards collected in one commit of a journal: all of it or, when anything is amiss, nothing.

    ``rows`` has shard, target_identity, id, source, source_board_id, source_job_id, canonical_url, fingerprint and posted_at; ``shards(shard)`` are those
    that have to be there.  A missing or unknown shard and identities that don't agree (``identity_conflicts``) refuse the set.  A posting
    that several shards bring counts once.  Those older than the retention go to the ledger, without membership; ``invalidated`` identities
    are recorded.  The same ``batch`` again changes nothing.

    ``rows`` are computed three times: for the shards, for what they say of each id, which tells conflicts and postings, and for memberships.  Only
    where different things are said of an id (and allowed), they are computed once more, and the first shard and target have their way.
    """
    spark = rows.sparkSession
    journal.register(spark)
    if batch in journal.latest(folder).batches:
        return
    there, known = (t.select("shard").distinct().withColumn(mark, F.lit(True)) for t, mark in ((rows, "there"), (shards, "known")))
    odd = cut(there.join(known, "shard", "full").where("there IS NULL OR known IS NULL"))
    for problem, mark in (("without rows", "there"), ("unknown", "known")):
        if names := [str(r["shard"]) for r in odd.where(F.col(mark).isNull()).limit(5).collect()]:
            raise journal.Conflict(f"shards {problem}: {', '.join(names)}")
    identity = ["source", "source_board_id", "source_job_id"]
    said = [*identity, "canonical_url", "fingerprint", "posted_at"]
    facts = cut(rows.select("id", *said).distinct())
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("id", "fingerprint") for f in (F.min, F.max)]
    by_identity = facts.withColumn("identity", provider_identity()).groupBy("identity")
    if not by_identity.count().where("count > 1").isEmpty() and not by_identity.agg(*ends).where("min_id < max_id OR min_fingerprint < max_fingerprint").isEmpty():
        raise journal.Conflict("shards disagree about identities")
    text = lambda t, *cols: t.select(*[F.col(c).cast("string") for c in cols])
    jobs, several = facts, cut(facts.groupBy("id").count().where("count > 1").select(F.col("id").alias("several")))
    if not several.isEmpty():
        among = F.col("id").eqNullSafe(F.col("several"))
        first = rows.join(several, among, "left_semi").groupBy("id").agg(F.min(F.struct("shard", "target_identity", *said)).alias("j"))
        jobs = facts.join(several, among, "left_anti").unionByName(cut(first.select("id", *[f"j.{c}" for c in said])))
    old = F.lit(False) if retention_hours is None else F.coalesce(F.col("posted_at") < F.lit(now - datetime.timedelta(hours=retention_hours)), F.lit(False))
    jobs = jobs.withColumn("table", F.when(old, "ledger").otherwise("posting"))
    members = rows.select("id", "target_identity").join(jobs.where("table = 'posting'").select("id"), "id", "left_semi").distinct().withColumn("table", F.lit("membership"))
    tables = [text(jobs, "table", "id", *identity, "canonical_url", "fingerprint", "posted_at"), text(members, "table", "id", "target_identity")]
    if invalidated is not None:
        tables.append(text(invalidated.distinct().withColumn("table", F.lit("invalidated")), "table", *identity))
    out = tables[0].withColumn("target_identity", F.lit(None).cast("string"))
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out.write.format("journal").option("path", folder).option("batch", batch).option("table", "table").mode("append").save()
