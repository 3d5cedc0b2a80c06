"""Delivery groups: postings that are one vacancy, by shared URLs or by equal content.

``postings`` has id, source, source_board_id, source_job_id, canonical_url, job_url, apply_url, company, title, description_text,
eligible_countries, country, remote_status, location_text, city, region, department, employment_type, updated_at, posted_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import places, text as T, values as V
from gleaner.operators.bloom import thinned
from gleaner.operators.components import components
from gleaner.plans.shared import cut, small_batches

# The label of content keys, paths that are no vacancy's, and the words that content needs.
CONTENT = "dedupe-v1"
GENERAL_PATHS = ["/", "/jobs", "/careers", "/apply"]
CONTENT_WORDS = 40


def url_key(url: Column) -> Column:
    """A vacancy's URL with its parameters in order; NULL for a site's general pages."""
    canonical = V.canonical_url(url)
    return F.when(~F.lower(V.url_part(canonical, 3)).isin(GENERAL_PATHS), V.sorted_query(canonical))


def _countries() -> Column:
    listed = F.coalesce("eligible_countries", F.array().cast("array<string>"))
    return F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(F.array_compact(F.array("country")))


def _place_left() -> Column:
    """The location without what the countries and the work mode already say."""
    countries, left = _countries(), F.coalesce("location_text", F.lit(""))
    for name, pattern in places.COUNTRIES.items():
        left = F.when(F.array_contains(countries, name), F.regexp_replace(left, "(?iU)" + pattern, name.lower())).otherwise(left)
    left = F.regexp_replace(left, r"(?iU)\b(?:remote|hybrid|on[- ]?site)\b", "")
    left = F.aggregate(countries, left, lambda x, c: F.regexp_replace(x, F.concat(F.lit(r"(?iu)\Q"), c, F.lit(r"\E")), F.lit("")))
    return F.trim(F.regexp_replace(left, r"(?U)[\s,;|/–—-]+", " "))


def content_key() -> Column:
    """A digest of what makes a vacancy, for descriptions of CONTENT_WORDS words or more with known countries and work mode."""
    description = T.text_key(F.col("description_text"))
    enough = (F.size(F.split(description, " ")) >= CONTENT_WORDS) & (F.size(_countries()) > 0) & (F.coalesce("remote_status", F.lit("unknown")) != "unknown")
    said = lambda c: T.json_string(c, ascii_only=False)
    key = lambda c: said(T.text_key(F.col(c)))
    names = F.array_join(F.transform(F.array_sort(F.transform(_countries(), lambda c: F.lower(T.squeezed(c)))), said), ", ")
    facts = [key("company"), key("title"), said(description), F.concat(F.lit("["), names, F.lit("]")), said(F.col("remote_status")), said(T.text_key(_place_left()))]
    facts += [key(c) for c in ("city", "region", "department")] + [said(F.col("employment_type"))]
    return F.when(enough, F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *facts), F.lit("]")), 256))


def delivery_keys(postings: DataFrame) -> DataFrame:
    """``id``, ``kind`` and ``value`` of each posting's keys, without repeats."""
    small_batches(postings.sparkSession)
    one = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    found = F.array(*[one("url", url_key(F.col(c))) for c in ("canonical_url", "job_url", "apply_url")], one(CONTENT, content_key()))
    return postings.select("id", F.explode(F.array_compact(found)).alias("k")).select("id", "k.kind", "k.value").distinct()


def delivery_groups(keys: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of postings that share ``keys(id, kind, value)``, going on from ``existing(id, group_id)``.

    Groups are sticky: postings once grouped stay together, and where keys join groups the first id of them stays.  Returns
    ``id`` and ``group_id`` of every posting of either table, and ``from_group``, ``to_group`` of merged ones.  Postings, keys
    and groups are nodes of one graph, so a key of many postings is as many links and never all pairs.
    """
    node = lambda mark, c: F.concat(F.lit(mark), c)
    posting = node("j:", F.col("id"))
    by_key = keys.select(posting.alias("a"), node("k:", F.sha2(F.concat_ws("\0", "kind", "value"), 256)).alias("b"))
    by_group = existing.select(posting.alias("a"), node("g:", F.col("group_id")).alias("b"))
    roots = cut(components(by_key.union(by_group)))
    name = lambda c: F.substring(c, 3, 1 << 30)
    # the smallest node is a group if there is one, else the first posting, which gives the new group's id
    group = F.when(F.startswith("root", F.lit("g:")), name(F.col("root"))).otherwise(V.uuid5(F.concat(F.lit("delivery-group:"), name(F.col("root")))))
    named = roots.select("node", group.alias("group_id"))
    ids = named.where(F.startswith("node", F.lit("j:"))).select(name(F.col("node")).alias("id"), "group_id")
    merged = named.where(F.startswith("node", F.lit("g:"))).select(name(F.col("node")).alias("from_group"), F.col("group_id").alias("to_group"))
    return ids, merged.where("from_group != to_group")


def assign(batch: DataFrame, members: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of a batch of postings that arrive one after another, and the groups that they join.

    ``batch`` has id (once each), position, own_group (the id of a group of its own) and an array ``keys`` of (kind, value);
    ``members(id, group_id)`` and ``keys(id, kind, value)`` are what is stored.  A posting joins its own group, the one it is in already,
    and those of the postings that hold one of its keys when it arrives: a stored posting of the same batch holds its old keys until its own
    position and its new ones from then on.  Joined groups are one from then on, under the smallest id.

    Returns ``id, group_id`` of the batch, and ``from_group, to_group`` of stored groups that go.  The graph has the batch's groups and
    those that hold its keys; what is stored is only scanned, and a Bloom filter keeps all else out of the shuffle.
    """
    arriving = cut(batch.select("id", "position", "own_group", "keys"))
    said = arriving.select("id", "position", "own_group", F.explode("keys").alias("k")).select("id", "position", "own_group", "k.kind", "k.value")
    key = F.concat_ws("\0", "kind", "value")
    first = cut(said.groupBy("kind", "value").agg(F.min("position").alias("first")))
    holders = thinned(keys.select("id", "kind", "value"), key, first.select(key)).join(first, ["kind", "value"])
    before = holders.join(arriving.select("id", "position"), "id", "left").where("position IS NULL OR position > first")
    held = cut(before.select("id", "kind", "value"))
    known = cut(held.select("id").union(arriving.select("id")).distinct())
    stored = cut(thinned(members.select("id", "group_id"), F.col("id"), known).join(known, "id"))
    # the groups of a key are linked to the smallest of them: as many links as groups of it, and none for a key of one group
    by_key = cut(said.select(key.alias("key"), F.col("own_group").alias("group")).union(held.join(stored, "id").select(key, "group_id")).distinct())
    least = by_key.groupBy("key").agg(F.min("group").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    links = by_key.join(least, "key").select(F.col("group").alias("a"), F.col("least").alias("b")).union(arriving.join(stored, "id").select("own_group", "group_id"))
    roots = cut(components(links).toDF("group", "root"))
    found = arriving.join(roots.withColumnRenamed("group", "own_group"), "own_group", "left").select("id", F.coalesce("root", "own_group").alias("group_id"))
    merged = stored.select(F.col("group_id").alias("group")).distinct().join(roots, "group").where("group != root")
    return cut(found), cut(merged.select(F.col("group").alias("from_group"), F.col("root").alias("to_group")))


def assigned(batch: DataFrame, members: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is stored after a batch: members, keys, and the groups merged by it."""
    found, merged = assign(batch, members, keys)
    moved = members.join(found.select("id"), "id", "left_anti").join(merged.withColumnRenamed("from_group", "group_id"), "group_id", "left")
    new_keys = batch.select("id", F.explode("keys").alias("k")).select("id", "k.kind", "k.value").distinct()
    kept = keys.join(batch.select("id"), "id", "left_anti").select("id", "kind", "value")
    return cut(moved.select("id", F.coalesce("to_group", "group_id").alias("group_id")).union(found)), cut(kept.union(new_keys)), merged


def merged_history(deliveries: DataFrame, merged: DataFrame) -> DataFrame:
    """``deliveries(group_id, client_id, destination, job_id, exported_at)`` after groups were ``merged(from_group, to_group)``: of the records that meet for one client and destination that of
    the group that stays wins, else that of the first losing group."""
    met = deliveries.join(merged.withColumnRenamed("from_group", "group_id"), "group_id", "left")
    kept = F.coalesce("to_group", "group_id")
    best = F.min_by(F.struct("job_id", "exported_at"), F.struct(F.col("to_group").isNotNull(), "group_id"))
    return met.groupBy(kept.alias("__group"), "client_id", "destination").agg(best.alias("b")).select(F.col("__group").alias("group_id"), "client_id", "destination", "b.job_id", "b.exported_at")


def representative_order() -> list[Column]:
    """The order in which a group's postings represent it: direct application, longest description, richest, newest, then names."""
    rich = sum((F.coalesce((x if isinstance(x, Column) else (F.col(x) != "")).cast("int"), F.lit(0)) for x in (F.size("eligible_countries") > 0, "department", "employment_type", "city", "region")), F.lit(0))
    newest = lambda c: -F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(0))
    return [F.col("apply_url").isNull(), -F.length(T.text_key(F.col("description_text"))), -rich, newest("updated_at"), newest("posted_at"), F.col("source"), F.col("source_board_id"), F.col("source_job_id"), F.col("id")]


def representatives(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Each group's ``representative`` and number of ``members``, by a minimum that is combined before the shuffle."""
    small_batches(postings.sparkSession)
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(representative_order())])
    return postings.join(groups, "id").groupBy("group_id").agg(F.min(F.struct(order.alias("order"), "id")).alias("r"), F.count("*").alias("members")).select("group_id", F.col("r.id").alias("representative"), "members")


def provider_identity() -> Column:
    """What fan-in knows a posting by: its provider identity, or its URL where the provider gives no id."""
    provider = F.concat_ws("\x1f", F.lit("provider"), "source", "source_board_id", "source_job_id")
    return F.when(F.coalesce("source_job_id", F.lit("")) != "", provider).otherwise(F.concat_ws("\x1f", F.lit("url"), "canonical_url"))


def identity_conflicts(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Identities that fan-in must refuse: postings whose provider identity has several ids, or whose id comes with several
    fingerprints from different shards: ``identity``, ``ids``, ``fingerprints``, ``shards``."""
    each = rows.groupBy(provider_identity().alias("identity"), "id", "fingerprint", shard).agg(F.lit(1).alias("one"))
    found = each.groupBy("identity").agg(F.count_distinct("id").alias("ids"), F.count_distinct("fingerprint").alias("fingerprints"), F.count_distinct(shard).alias("shards"))
    return found.where("ids > 1 OR fingerprints > 1")
