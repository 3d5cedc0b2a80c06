"""Provider payloads to one posting schema.

Payloads are JSON text with a ``target`` (board, company, employer_id).  Each provider is one projection with an
explicit schema; rows that lack what a posting needs go to a quarantine with the reason instead of failing the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import places, text as T, values as V

# Labels of work modes and of kinds of employment.
MODES = {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "on-site": "onsite"}
EMPLOYMENT = {
    "full-time": "full_time", "full time": "full_time", "fulltime": "full_time", "permanent": "full_time", "part-time": "part_time", "part time": "part_time", "parttime": "part_time",
    "contract": "contract", "contractor": "contract", "temporary": "temporary", "temp": "temporary", "intern": "internship", "internship": "internship",
}
SCHEMAS = {
    "greenhouse": "jobs array<struct<id:bigint,title:string,location:struct<name:string>,absolute_url:string,content:string,updated_at:timestamp,first_published:timestamp,departments:array<struct<name:string>>,offices:array<struct<name:string,location:string>>>>",
    "ashby": "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,isListed:boolean,isRemote:boolean,workplaceType:string,descriptionPlain:string,descriptionHtml:string,publishedAt:timestamp,employmentType:string,jobUrl:string,applyUrl:string>>",
    "lever": "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,description:string,descriptionPlain:string,country:string,workplaceType:string,createdAt:bigint,categories:struct<location:string,allLocations:array<string>,commitment:string,department:string>>>",
    "smartrecruiters": "content array<struct<id:string,name:string,company:struct<identifier:string,name:string>,location:struct<city:string,region:string,country:string,remote:boolean,hybrid:boolean>,releasedDate:string,typeOfEmployment:struct<label:string>,department:struct<label:string>,postingUrl:string,applyUrl:string,jobAd:struct<sections:struct<companyDescription:struct<text:string>,jobDescription:struct<text:string>,qualifications:struct<text:string>,additionalInformation:struct<text:string>>>>>",
    "workday": "jobPostingInfo struct<jobReqId:string,title:string,jobDescription:string,externalUrl:string,location:string,additionalLocations:array<string>,country:struct<descriptor:string>,remoteType:string,timeType:string,startDate:string>",
}
#: Bounds of a time in milliseconds that can be a posting's: the years 2000 to 2100.
MILLIS = (946_684_800_000, 4_102_444_800_000)


def label(of: dict[str, str], value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(value)))


def zoned(value: Column) -> Column:
    """A timestamp only if its text says which zone it is in."""
    return F.when(value.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(value))


def joined(*parts: Column) -> Column:
    """Distinct values in order, joined; NULL if there are none."""
    values = F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return F.when(F.size(values) > 0, F.array_join(values, "; "))


def _strings() -> Column:
    return F.array().cast("array<string>")


def _greenhouse(j):
    names, places_ = F.transform(j("offices"), lambda o: o["name"]), F.transform(j("offices"), lambda o: o["location"])
    text = T.html_to_text(j("content"))
    return {
        "job": j("id").cast("string"), "title": j("title"), "description_text": text, "url": j("absolute_url"), "apply": F.lit(None).cast("string"), "location_text": j("location")["name"],
        "offices": F.array_compact(places_), "mode": T.work_mode(j("location")["name"], text, F.array_compact(names), F.array_compact(places_)), "kind": F.lit(None).cast("string"),
        "department": F.get(j("departments"), F.lit(0))["name"], "posted_at": j("first_published"), "updated_at": j("updated_at"),
    }


def _ashby(j):
    text = F.coalesce(F.nullif(F.trim(j("descriptionPlain")), F.lit("")), T.html_to_text(j("descriptionHtml")))
    where = joined(F.array(j("location")), F.coalesce(F.transform(j("secondaryLocations"), lambda s: s["location"]), _strings()))
    guess = F.when(j("isRemote"), "remote").when(j("isRemote").isNull(), T.work_mode(where, text, _strings(), _strings())).otherwise("unknown")
    return {
        "job": F.coalesce(F.when(j("id").rlike(places.UUID), j("id")), places.identity(j("jobUrl"))["job"]), "title": j("title"), "description_text": text, "url": j("jobUrl"), "apply": j("applyUrl"),
        "location_text": where, "offices": _strings(), "mode": F.when(j("workplaceType").isNotNull(), F.coalesce(label(MODES, j("workplaceType")), F.lit("unknown"))).otherwise(guess),
        "kind": label(EMPLOYMENT, j("employmentType")), "department": j("department"), "posted_at": j("publishedAt"), "updated_at": F.lit(None).cast("timestamp"),
    }


def _lever(j):
    c = j("categories")
    where = F.concat(F.array(c["location"]), F.coalesce(c["allLocations"], _strings()))
    return {
        "job": j("id"), "title": j("text"), "description_text": F.coalesce(F.nullif(F.trim(j("descriptionPlain")), F.lit("")), T.html_to_text(j("description"))), "url": j("hostedUrl"), "apply": j("applyUrl"),
        "location_text": joined(where), "offices": F.array_compact(where), "mode": F.coalesce(label(MODES, j("workplaceType")), F.lit("unknown")), "kind": label(EMPLOYMENT, c["commitment"]),
        "department": c["department"], "posted_at": F.when(j("createdAt").between(*MILLIS), F.timestamp_millis(j("createdAt"))), "updated_at": F.lit(None).cast("timestamp"),
    }


def _smartrecruiters(j):
    ad = j("jobAd")["sections"]
    parts = F.array_compact(F.array(*[T.html_to_text(ad[s]["text"]) for s in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")]))
    where = j("location")
    return {
        "job": j("id"), "title": j("name"), "description_text": F.nullif(F.array_join(parts, "\n\n"), F.lit("")), "url": j("postingUrl"), "apply": j("applyUrl"),
        "location_text": F.nullif(F.concat_ws(", ", where["city"], where["region"], where["country"]), F.lit("")), "offices": _strings(),
        "mode": F.when(where["hybrid"], "hybrid").when(where["remote"], "remote").otherwise("unknown"), "kind": label(EMPLOYMENT, j("typeOfEmployment")["label"]),
        "department": j("department")["label"], "posted_at": zoned(j("releasedDate")), "updated_at": F.lit(None).cast("timestamp"),
    }


def _workday(j):
    where = F.concat(F.array(j("location")), F.coalesce(j("additionalLocations"), _strings()))
    country = F.coalesce(j("country")["descriptor"], F.lit(""))
    return {
        "job": j("jobReqId"), "title": j("title"), "description_text": T.html_to_text(j("jobDescription")), "url": j("externalUrl"), "apply": F.lit(None).cast("string"), "location_text": joined(where),
        "offices": F.array_compact(F.concat(where, F.array(country))), "mode": F.coalesce(label(MODES, j("remoteType")), F.lit("unknown")), "kind": label(EMPLOYMENT, j("timeType")),
        "department": F.lit(None).cast("string"), "posted_at": F.try_to_timestamp(j("startDate")), "updated_at": F.lit(None).cast("timestamp"),
    }


PROVIDERS = {"greenhouse": _greenhouse, "ashby": _ashby, "lever": _lever, "smartrecruiters": _smartrecruiters, "workday": _workday}
_ITEMS = {"greenhouse": "jobs", "ashby": "jobs", "smartrecruiters": "content"}


def raw_items(payloads: DataFrame, source: str) -> DataFrame:
    """A row per item of the ``payload`` texts, with ``target`` and ``j``; a payload that doesn't parse is one row without item."""
    parsed = payloads.withColumn("p", F.from_json("payload", SCHEMAS[source]))
    if source == "workday":
        items = F.array(F.col("p.jobPostingInfo"))
    elif source == "lever":
        items = F.col("p")
    else:
        items = F.col(f"p.{_ITEMS[source]}")
    rows = parsed.select("target", F.explode_outer(items).alias("j"))
    return rows.where(F.coalesce(F.col("j.isListed"), F.lit(True))) if source == "ashby" else rows


def postings(payloads: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The postings of a provider's payloads, and a quarantine of rows with the ``reason`` why they are none.

    Of items with the same id the first in input order isn't known to a distributed read; the one with the smallest digest stays.
    """
    rows = raw_items(payloads, source)
    found = PROVIDERS[source](lambda name: F.col(f"j.{name}"))
    flat = rows.select("target", "j", *[v.alias(k) for k, v in found.items()])
    reason = (
        F.when(F.col("j").isNull(), "payload cannot be read").when(F.coalesce(F.trim("title"), F.lit("")) == "", "title is missing")
        .when(F.coalesce("job", F.lit("")) == "", "id is missing").when(~F.coalesce(F.col("url").rlike("^https?://[^/]+"), F.lit(False)), "url is missing")
    )
    flat = flat.withColumn("reason", reason)
    place = places.location(F.col("location_text"), F.col("offices"))
    board = F.col("target.board")
    good = flat.where("reason IS NULL").withColumn("at", place).select(
        V.uuid5(F.concat_ws(":", F.lit(source), board, "job")).alias("id"), F.lit(source).alias("source"), F.col("job").alias("source_job_id"), board.alias("source_board_id"), "title",
        F.col("target.company").alias("company"), F.col("target.employer_id").alias("employer_id"), "description_text", V.canonical_url(F.col("url")).alias("canonical_url"),
        F.when(F.col("apply").isNotNull(), V.canonical_url(F.col("apply"))).alias("apply_url"), "location_text", F.col("at.country").alias("country"), F.col("at.countries").alias("eligible_countries"),
        F.col("at.region").alias("region"), F.col("at.city").alias("city"), F.col("mode").alias("remote_status"), F.col("kind").alias("employment_type"), "department", "posted_at", "updated_at",
    )
    facts = F.to_json(F.struct("title", "description_text", "canonical_url", "apply_url", "location_text", "eligible_countries", "remote_status", "employment_type", "department"), {"ignoreNullFields": "false"})
    good = good.withColumn("content_fingerprint", F.sha2(facts, 256))
    one = good.groupBy("id").agg(F.min_by(F.struct(*good.columns), "content_fingerprint").alias("g")).select("g.*")
    return one, flat.where("reason IS NOT NULL").select("target", "job", "title", "reason")


def pages_complete(pages: DataFrame) -> DataFrame:
    """Per ``board`` of paged lists (``board``, ``page``, ``total``, ``id``): rows against the first page's declared total, and repeats."""
    first = F.min_by("total", "page")
    return pages.groupBy("board").agg(first.alias("declared"), F.count("id").alias("rows"), F.count_distinct("id").alias("ids")).withColumn("complete", (F.col("ids") == F.col("declared")) & (F.col("rows") == F.col("ids")))


def history_links(spark, path: str) -> DataFrame:
    """Historical links from CSV files with a header: canonical URL, provider identity and status; blank URLs are dropped."""
    schema = "sheet string, row int, title string, company string, url string, status string"
    rows = spark.read.csv(path, schema=schema, header=True, encoding="UTF-8").where("trim(url) != ''")
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    return rows.select("sheet", "row", "title", "company", V.canonical_url(F.col("url")).alias("normalized_url"), places.identity(F.col("url")).alias("identity"), F.when(status == "", "unknown").otherwise(status).alias("operator_status"))
