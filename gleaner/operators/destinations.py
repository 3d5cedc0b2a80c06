"""Destinations of deliveries: whether a column mapping is safe, which links a sheet shows, and what becomes of old addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import text as T, values as V
from gleaner.plans.shared import cut

#: The field that every mapping needs.
LINK = "Job Link"


def _object(pairs: dict[str, Column]) -> Column:
    """JSON of an object, names in order and no blanks, from JSON texts."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), pairs[k]) for k in sorted(pairs)]), F.lit("}"))


def config_digest() -> Column:
    """The digest of a destination's configuration: client, destination, sheet, tab, header and mapping."""
    said = lambda c: T.json_string(c, ascii_only=False)
    names = F.array_sort(F.map_keys("column_mapping"))
    mapping = F.concat(F.lit("{"), F.array_join(F.transform(names, lambda k: F.concat(said(k), F.lit(":"), said(F.element_at("column_mapping", k)))), ","), F.lit("}"))
    header = F.concat(F.lit("["), F.array_join(F.transform("header", said), ","), F.lit("]"))
    pairs = {c: said(F.col(c)) for c in ("client_id", "destination_id", "spreadsheet_id", "tab_name")} | {"sheet_id": F.col("sheet_id").cast("string"), "header": header, "column_mapping": mapping}
    return F.sha2(_object(pairs), 256)


def mapping_problem(fields: list[str]) -> Column:
    """Why a destination's mapping isn't safe, the first that holds; NULL if it is.

    ``no_header``, ``unknown_field`` (not one of ``fields``), ``no_link``, ``target_twice``, ``target_not_once`` (a mapped column isn't in the header exactly once) and ``digest_differs``.
    """
    targets = F.map_values("column_mapping")
    count = lambda t: F.size(F.filter("header", lambda h: h == t))
    return (
        F.when(F.coalesce(F.size("header"), F.lit(0)) <= 0, "no_header").when(F.size(F.array_except(F.map_keys("column_mapping"), F.array(*map(F.lit, fields)))) > 0, "unknown_field")
        .when(~F.map_contains_key("column_mapping", LINK), "no_link").when(F.size(F.array_distinct(targets)) < F.size(targets), "target_twice")
        .when(F.exists(targets, lambda t: count(t) != 1), "target_not_once").when(F.col("config_sha256") != config_digest(), "digest_differs")
    )


def sheet_links(sheets: DataFrame, destinations: DataFrame) -> DataFrame:
    """The links that sheets show, in the column that their destination maps: ``client_id``, ``destination`` and ``link``.

    ``sheets(destination_id, rows)`` are the rows of a sheet with its header first, short ones padded.  Another header than the registered one, or a row that is longer, is an error.
    """
    met = sheets.join(destinations, "destination_id")
    width = F.size("header")
    wrong = F.when(~F.get("rows", F.lit(0)).eqNullSafe(F.col("header")), "header differs from the registered one").when(F.exists("rows", lambda r: F.size(r) > width), "a row is longer than the header")
    at = F.array_position("header", F.element_at("column_mapping", LINK)).cast("int") - 1
    rows = met.withColumn("rows", F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(": ", "destination_id", wrong)).cast("array<array<string>>")).otherwise(F.col("rows")))
    each = rows.select("client_id", F.col("logical_uri").alias("destination"), at.alias("at"), F.explode(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).alias("r"))
    link = F.btrim(F.coalesce(F.get("r", F.col("at")), F.lit("")))
    return each.select("client_id", "destination", link.alias("link")).where("link != ''")


def observe_links(links: DataFrame, observed: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """What ``links(client_id, destination, link)`` add to ``observed(client_id, destination, normalized_url, first_observed_at)``, and by destination the numbers of
    ``observed_links`` and ``newly_recorded_links``.  A link that is no web address is an error; the first observation of a link stays."""
    where = ["client_id", "destination"]
    url = V.canonical_url(F.col("link"))
    good = F.when(F.coalesce(url.rlike("^https?://"), F.lit(False)), url).otherwise(F.raise_error(F.concat(F.lit("no web address: "), F.col("link"))).cast("string"))
    seen = cut(links.select(*where, good.alias("normalized_url")).distinct())
    new = seen.join(observed.select(*where, "normalized_url"), [*where, "normalized_url"], "left_anti")
    counts = seen.groupBy(*where).agg(F.count("*").alias("observed_links")).join(new.groupBy(*where).agg(F.count("*").alias("newly_recorded_links")), where, "left").na.fill(0, ["newly_recorded_links"])
    return new.withColumn("first_observed_at", at), counts


def migrated(rows: DataFrame, addresses: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` of a ledger with those of legacy destinations (``addresses(legacy, logical)``) copied under their logical one, unless its key is there already; nothing is lost or doubled."""
    moved = rows.join(addresses, rows["destination"] == addresses["legacy"]).select(*[F.col("logical").alias("destination") if c == "destination" else rows[c] for c in rows.columns])
    return rows.unionByName(moved.dropDuplicates(key).join(rows.select(*key), key, "left_anti"))


def run_inventory(memberships: DataFrame, jobs: DataFrame, evidence: DataFrame, at: Column, retention_hours: int) -> DataFrame:
    """The distinct postings of each run that count: ``run_id``, ``job_id``, ``posted_at`` (the posting's, else what retention evidence remembers) and ``active``.

    Closed postings don't count; one is active unless its known time is older than the retention.
    """
    kept = jobs.where(F.coalesce(F.col("lifecycle") != "closed", F.lit(True))).select("job_id", "posted_at")
    met = memberships.select("run_id", "job_id").distinct().join(kept, "job_id").join(evidence.select("job_id", F.col("posted_at").alias("__known")).dropDuplicates(["job_id"]), "job_id", "left")
    posted = F.coalesce("posted_at", "__known")
    return met.select("run_id", "job_id", posted.alias("posted_at"), F.coalesce(V.age_seconds(posted, at) <= retention_hours * 3600, F.lit(True)).alias("active"))
