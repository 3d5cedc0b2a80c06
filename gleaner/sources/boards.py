"""Boards that come in pages: where a board ends, which of its postings count, and how much of it the pages prove.

Pages were collected before; these functions say what a collector that reads them in order would have kept, without reading them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gleaner.functions.values import older_than_72h
from gleaner.operators.matching import may_match
from gleaner.plans.shared import cut

# Postings of a full page, and the total at which a provider's list is cut off.
PAGE, CAP = 50, 2000


def page_signature(ids):
    """What two pages with the same postings have in common, whatever their order; blanks and repeats count."""
    said = F.transform(F.array_sort(ids), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))
    return F.sha2(F.array_join(said, ","), 256)


def board_pages(pages: DataFrame, width: int = PAGE) -> DataFrame:
    """``pages(board, page, ids)`` that a board's reader would take: pages from 0 on without a gap, up to the first short one, or before the first
    whose signature an earlier page had.  ``ended`` says how the board ends: ``short_page``, ``repeated_page`` or ``pages_missing``."""
    rows = pages.select("board", "page", F.transform("ids", lambda x: F.coalesce(x, F.lit(""))).alias("ids")).withColumn("signature", page_signature(F.col("ids")))
    again = rows.groupBy("board", "signature").agg(F.min("page").alias("__first"))
    rows = rows.join(again, ["board", "signature"])
    order = Window.partitionBy("board").orderBy("page")
    rows = rows.withColumn("__n", F.row_number().over(order) - 1)
    ends = rows.groupBy("board").agg(
        F.min(F.when(F.col("page") != F.col("__first"), F.col("page"))).alias("repeat"), F.min(F.when(F.size("ids") < width, F.col("page"))).alias("short"),
        F.coalesce(F.min(F.when(F.col("page") != F.col("__n"), F.col("__n"))), F.max("page") + 1).alias("gap"),
    )
    stop = F.least(F.col("repeat"), F.col("short") + 1, F.col("gap"))  # the first page that isn't taken
    how = F.when(F.col("short") + 1 == F.col("stop"), "short_page").when(F.col("repeat") == F.col("stop"), "repeated_page").otherwise("pages_missing")
    ends = ends.withColumn("stop", stop).select("board", "stop", how.alias("ended"))
    return rows.join(ends, "board").where("page < stop").select("board", "page", "ids", "signature", "ended")


def board_postings(pages: DataFrame, width: int = PAGE) -> DataFrame:
    """``board``, ``page``, ``place`` and ``id`` of the postings of the pages that count, with ``rejected``: ``blank id`` or ``duplicate id`` (all but the first of an id)."""
    each = board_pages(pages, width).select("board", "page", F.posexplode("ids").alias("place", "id"))
    first = each.groupBy("board", "id").agg(F.min(F.struct("page", "place")).alias("__first"))
    met = each.join(first, ["board", "id"])
    return met.select("board", "page", "place", "id", F.when(F.col("id") == "", "blank id").when(F.struct("page", "place") != F.col("__first"), "duplicate id").alias("rejected"))


def board_results(pages: DataFrame, width: int = PAGE) -> DataFrame:
    """A row per board: ``pages``, ``received``, ``normalized`` and ``quarantined`` postings, ``ended`` and ``status``
    (``partial`` if postings were rejected, or the board didn't end with a short page)."""
    taken = board_pages(pages, width).groupBy("board").agg(F.count("*").alias("pages"), F.sum(F.size("ids")).alias("received"), F.max("ended").alias("ended"))
    bad = board_postings(pages, width).groupBy("board").agg(F.count("rejected").alias("quarantined"))
    looped = pages.select("board").distinct().join(taken, "board", "left").join(bad, "board", "left").na.fill(0, ["pages", "received", "quarantined"])
    ended = F.coalesce("ended", F.lit("pages_missing"))
    partial = (F.col("quarantined") > 0) | (ended != "short_page")
    return looped.select("board", "pages", "received", (F.col("received") - F.col("quarantined")).alias("normalized"), "quarantined", ended.alias("ended"), F.when(partial, "partial").otherwise("success").alias("status"))


def index_coverage(pages: DataFrame, facets: DataFrame) -> DataFrame:
    """How much of a target's list an index scan proves, a row per target: ``broad_total``, ``rows_seen``, ``postings``, ``coverage_mode``, ``errors``, ``status``.

    ``pages`` has target, scope (NULL for the whole list, else a partition), page, total (as the page declares it) and paths, of which NULL
    ones are invalid; ``facets(target, identifier, advertised)`` are the partitions that the target offers.  A query is complete if its valid rows are as many as
    its first page declared, all different.  A list at the cap counts only through partitions: two or more, known, each below the cap,
    together above it, all complete with the advertised number, none sharing a path.
    """
    each = pages.select("target", "scope", "page", "total", F.posexplode_outer("paths").alias("place", "path"))
    query = each.groupBy("target", "scope").agg(
        F.min_by("total", F.struct("page", "place")).alias("total"), F.count("path").alias("valid"), F.count_distinct("path").alias("different"),
        F.count("place").alias("rows"), F.count_if(F.col("place").isNotNull() & F.col("path").isNull()).alias("invalid"),
    )
    whole = F.col("total").isNotNull() & (F.col("valid") == F.col("total")) & (F.col("different") == F.col("valid"))
    wrong = F.col("invalid") + (F.col("valid") != F.coalesce("total", F.lit(-1))).cast("int") + (F.col("different") != F.col("valid")).cast("int")
    query = query.withColumns({"complete": whole & (F.col("invalid") == 0), "wrong": wrong})
    broad = query.where("scope IS NULL").select("target", F.col("total").alias("broad_total"), F.col("complete").alias("broad_complete"), F.col("rows").alias("broad_rows"), F.col("wrong").alias("broad_wrong"))
    offered = facets.groupBy("target").agg(
        F.count("*").alias("n"), F.count_distinct("identifier").alias("names"), F.sum("advertised").alias("sum"),
        F.bool_and(F.coalesce((F.col("identifier") != "") & F.col("advertised").between(0, CAP - 1), F.lit(False))).alias("known"),
    )
    safe = F.coalesce((F.col("n") >= 2) & F.col("known") & (F.col("names") == F.col("n")) & (F.col("sum") > CAP), F.lit(False))
    shared = each.where("scope IS NOT NULL AND path IS NOT NULL").groupBy("target", "path").agg(F.count_distinct("scope").alias("n")).groupBy("target").agg(F.count_if(F.col("n") > 1).alias("overlap"))
    parts = facets.join(query.where("scope IS NOT NULL"), (query["target"] == facets["target"]) & (query["scope"] == facets["identifier"]), "left").select(facets["target"], "advertised", "total", "complete", "rows", "wrong")
    reconciled = F.coalesce((F.col("total") == F.col("advertised")) & F.col("complete"), F.lit(False))
    parts = parts.groupBy("target").agg(F.bool_and(reconciled).alias("parts_complete"), F.count_if(~reconciled).alias("open"), F.coalesce(F.sum("rows"), F.lit(0)).alias("part_rows"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("part_wrong"))
    capped = F.col("broad_total") == CAP
    asked = F.coalesce(capped & F.col("safe"), F.lit(False))
    met = broad.join(offered.select("target", safe.alias("safe")), "target", "left").join(parts, "target", "left").join(shared, "target", "left").na.fill({"safe": False, "overlap": 0, "open": 0, "part_rows": 0, "part_wrong": 0})
    errors = F.col("broad_wrong") + F.when(asked, F.col("open") + F.col("part_wrong") + (F.col("overlap") > 0).cast("int")).when(capped | ((F.col("broad_total") > CAP) & ~F.col("broad_complete")), 1).otherwise(0)
    mode = (
        F.when(F.col("broad_total").isNull(), "unknown").when(asked, F.when(errors == 0, "job_family_group_partition").otherwise("capped_partial"))
        .when(capped | ((F.col("broad_total") > CAP) & ~F.col("broad_complete")), "capped_partial").otherwise("broad")
    )
    paths = each.join(met.select("target", asked.alias("asked")), "target").where("path IS NOT NULL AND (scope IS NULL OR asked)").groupBy("target").agg(F.count_distinct("path").alias("postings"))
    out = met.withColumns({"coverage_mode": mode, "errors": errors.cast("long"), "rows_seen": F.col("broad_rows") + F.when(asked, F.col("part_rows")).otherwise(0)}).join(paths, "target", "left")
    return out.select("target", "broad_total", "rows_seen", F.coalesce("postings", F.lit(0)).alias("postings"), "coverage_mode", "errors", F.when(F.col("errors") > 0, "partial").otherwise("success").alias("status"))


def index_first(index: DataFrame, coverage: DataFrame, briefs: DataFrame) -> DataFrame:
    """What to do with each posting of a list-only scan: ``index`` with ``action``.

    ``index`` has target, path, title and age_days as the list states it; ``coverage`` target and status (``index_coverage``).  Where the scan of
    a target isn't a success, what the list doesn't show can't be ruled out, and the whole target is collected (``full_collection``).
    Else a posting stated as older than 72 hours is left (``stale_skipped``), one without a title is read (``uncertain_title``), and of the others those
    whose title some brief could take (``candidate``); the rest is ``title_skipped``.
    """
    rows = cut(index.join(coverage.select("target", "status"), "target", "left").withColumn("__row", F.monotonically_increasing_id()))
    taken = may_match(rows, briefs).select("__row", F.lit(True).alias("__taken"))
    none = briefs.isEmpty()
    action = (
        F.when(F.coalesce(F.col("status"), F.lit("")) != "success", "full_collection").when(F.coalesce(older_than_72h(F.col("age_days")), F.lit(False)), "stale_skipped")
        .when(F.lit(none), "title_skipped").when(F.col("title").isNull(), "uncertain_title").when(F.col("__taken"), "candidate").otherwise("title_skipped")
    )
    return rows.join(taken, "__row", "left").withColumn("action", action).select(*index.columns, "action")


def index_first_counts(planned: DataFrame) -> DataFrame:
    """A row per target of ``index_first``: postings by action, and ``candidate_paths`` to read one by one."""
    named = ["stale_skipped", "title_skipped", "uncertain_title"]
    return planned.groupBy("target").agg(
        F.bool_or(F.col("action") == "full_collection").alias("fallback_full_collection"), *[F.count_if(F.col("action") == a).alias(a) for a in named],
        F.count_if(F.col("action").isin("candidate", "uncertain_title")).alias("candidate_paths"), F.count("*").alias("index_postings"),
    )


def hydrated(details: DataFrame, planned: DataFrame) -> DataFrame:
    """Of ``details(target, path, ...)`` those that were asked for: whole targets that are collected in full, and single candidates."""
    whole = planned.where("action = 'full_collection'").select("target").distinct()
    single = planned.where(F.col("action").isin("candidate", "uncertain_title")).select("target", "path").distinct()
    return details.join(whole, "target", "left_semi").unionByName(details.join(whole, "target", "left_anti").join(single, ["target", "path"], "left_semi"))
