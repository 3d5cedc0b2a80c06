"""Column functions over locations and vacancy URLs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.functions.text import CITY_STATE, NO_CITY, US_STATES, found
from gleaner.functions.values import url_part

# How the recognized countries are written.
COUNTRIES = {
    "Nigeria": r"(?<![A-Za-z])(?:Nigeria|NGA)(?![A-Za-z])",
    "India": r"(?<![A-Za-z])India(?![A-Za-z])",
    "United Kingdom": r"(?<![A-Za-z])(?:United Kingdom|U\.K\.|UK)(?![A-Za-z])",
    "United States": r"(?<![A-Za-z])(?:United States(?: of America)?|U\.S\.A\.?|USA|U\.S\.|US)(?![A-Za-z])",
    "Canada": r"(?<![A-Za-z])Canada(?![A-Za-z])",
}
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
BOARD = r"^[A-Za-z0-9._-]+$"


def location(text: Column, offices: Column) -> Column:
    """struct(countries, country, region, city) from explicit evidence only; one country makes ``country``."""
    city, region = F.regexp_extract(text, CITY_STATE, 1), F.upper(F.regexp_extract(text, CITY_STATE, 2))
    placed = F.coalesce(region.isin(US_STATES) & ~F.lower(city).isin(NO_CITY), F.lit(False))
    said = F.concat(F.array(F.coalesce(text, F.lit(""))), F.coalesce(offices, F.array().cast("array<string>")))
    says = lambda pattern: F.exists(said, lambda v: found(v, pattern))
    named = F.array_compact(F.array(*[F.when(says(p), F.lit(c)) for c, p in COUNTRIES.items()]))
    countries = F.array_sort(F.when(placed, F.array(F.lit("United States"))).otherwise(named))
    return F.struct(
        countries.alias("countries"), F.when(F.size(countries) == 1, F.get(countries, F.lit(0))).alias("country"),
        F.when(placed, region).alias("region"), F.when(placed, city).alias("city"),
    )


def identity(url: Column) -> Column:
    """struct(source, board, job) that a vacancy URL of a known provider names; NULLs otherwise."""
    host = F.lower(F.regexp_replace(url_part(url, 2), r"^[^@]*@|:\d+$", ""))
    parts = F.filter(F.split(url_part(url, 3), "/"), lambda p: p != "")
    p = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    n = F.size(parts)
    tail = lambda word: (n == 2) | ((n == 3) & (p(2) == word))
    local = F.when(F.lower(p(0)).rlike(r"^[a-z]{2}-[a-z]{2}$"), 1).otherwise(0)
    at = lambda i: F.coalesce(F.get(parts, local + i), F.lit(""))
    last = F.coalesce(F.when(F.get(parts, n - 1) == "apply", F.get(parts, n - 2)).otherwise(F.get(parts, n - 1)), F.lit(""))
    number, posting = F.substring_index(last, "_", -1), F.substring_index(p(1), "-", 1)
    three = lambda s, b, j: F.struct(s.alias("source"), b.alias("board"), j.alias("job"))
    none = F.lit(None).cast("string")
    return (
        F.when(host.isin("job-boards.greenhouse.io", "job-boards.eu.greenhouse.io") & (n >= 3) & (p(1) == "jobs") & p(0).rlike(BOARD), three(F.lit("greenhouse"), p(0), p(2)))
        .when((host == "jobs.ashbyhq.com") & tail("application") & p(0).rlike(BOARD) & p(1).rlike(UUID), three(F.lit("ashby"), p(0), p(1)))
        .when(host.isin("jobs.lever.co", "jobs.eu.lever.co") & tail("apply") & p(1).rlike(UUID), three(F.lit("lever"), F.concat(F.when(host == "jobs.lever.co", "global:").otherwise("eu:"), p(0)), p(1)))
        .when((host == "jobs.smartrecruiters.com") & tail("apply") & p(0).rlike(BOARD) & posting.rlike("^[0-9]+$"), three(F.lit("smartrecruiters"), F.lower(p(0)), posting))
        .when(host.rlike(r"^[a-z0-9-]+\.wd[0-9]+\.myworkdayjobs\.com$") & (n >= local + 4) & (at(1) == "job") & F.contains(last, F.lit("_")) & number.rlike("^[A-Za-z0-9-]+$"),
              three(F.lit("workday"), F.concat_ws(":", host, F.substring_index(host, ".", 1), at(0)), number))
        .otherwise(three(none, none, none))
    )


@functools.lru_cache(8)
def _country_rows(spark: SparkSession) -> list[tuple[str, str]]:
    locale = spark._jvm.java.util.Locale
    return [(code, locale("", code).getDisplayCountry(locale.ENGLISH)) for code in locale.getISOCountries()]


def countries(spark: SparkSession) -> DataFrame:
    """``country_code`` (two letters) and ``country_name`` (English) of all countries that the JVM's locales know, about 250."""
    return spark.createDataFrame(_country_rows(spark), "country_code string, country_name string")


def with_country(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` with ``country_code`` and ``country_name`` of a code or name in any case; NULLs where it is none."""
    dim = countries(rows.sparkSession)
    said = dim.select(F.lower("country_code").alias("__said"), "country_code", "country_name").union(dim.select(F.lower("country_name"), "country_code", "country_name"))
    return rows.withColumn("__value", F.lower(F.trim(value))).join(F.broadcast(said), F.col("__value") == F.col("__said"), "left").drop("__value", "__said")


def safe_url(url: Column, vacancy: bool = False) -> Column:
    """The URL if it is https on the usual port of a public host and without credentials, and with ``vacancy`` no general page."""
    authority = url_part(url, 2)
    host, port = F.lower(F.regexp_replace(authority, r":\d*$", "")), F.regexp_extract(authority, r":(\d*)$", 1)
    good = (url_part(url, 1) == "https") & ~F.contains(authority, F.lit("@")) & port.isin("", "443") & F.contains(host, F.lit("."))
    good = good & ~host.rlike(r"[.](localhost|local|internal)$") & (~host.rlike(r"^[0-9.]+$") | _public_address(host))
    if vacancy:
        good = good & ~F.lower(F.rtrim(url_part(url, 3), F.lit("/"))).isin("", "/jobs", "/careers", "/apply")
    return F.when(good, url)


def _public_address(host: Column) -> Column:
    """Whether four numbers make an address of the public Internet."""
    part = F.transform(F.split(host, "[.]"), lambda p: F.when(p.rlike("^(0|[1-9][0-9]{0,2})$"), p.cast("int")))
    n = lambda i: F.get(part, F.lit(i))
    # Address ranges that aren't public.
    private = n(0).isin(0, 10, 127) | (n(0) >= 224) | ((n(0) == 100) & n(1).between(64, 127)) | ((n(0) == 169) & (n(1) == 254)) | ((n(0) == 172) & n(1).between(16, 31))
    private = private | ((n(0) == 192) & (n(1) == 168)) | ((n(0) == 192) & (n(1) == 0) & n(2).isin(0, 2)) | ((n(0) == 198) & n(1).isin(18, 19)) | ((n(0) == 198) & (n(1) == 51) & (n(2) == 100)) | ((n(0) == 203) & (n(1) == 0) & (n(2) == 113))
    return F.coalesce((F.size(part) == 4) & F.forall(part, lambda x: x <= 255) & ~private, F.lit(False))


def application(canonical: Column, apply: Column) -> Column:
    """struct(application_url, canonical_url, kind): the direct application if it is safe, else the vacancy's page, else none."""
    direct, page = safe_url(apply, True), safe_url(canonical, True)
    kind = F.when(direct.isNotNull(), "direct_apply").when(page.isNotNull(), "vacancy_page").otherwise("unavailable")
    return F.struct(F.coalesce(direct, page).alias("application_url"), safe_url(canonical).alias("canonical_url"), kind.alias("kind"))


# Host endings of the providers.
PROVIDER_HOSTS = r"(?:^jobs[.]smartrecruiters[.]com|^jobs[.](?:eu[.])?lever[.]co|^jobs[.]ashbyhq[.]com|[.]greenhouse[.]io|[.]ashbyhq[.]com|[.]lever[.]co|[.]myworkdayjobs[.]com)$"


def link_target(url: Column) -> Column:
    """struct(class, source, board) of a link: a target to collect, a known provider without one, another site, or no URL."""
    host = F.lower(F.regexp_replace(url_part(url, 2), r"^[^@]*@|:\d+$", ""))
    found = identity(url)
    kind = (
        F.when(~F.lower(url_part(url, 1)).isin("http", "https") | (host == "") | url.isNull(), "malformed_url").when(found["source"].isNotNull(), "supported_target")
        .when(host.rlike(PROVIDER_HOSTS), "recognized_source_unresolved_target").otherwise("unsupported_source")
    )
    return F.struct(kind.alias("class"), found["source"].alias("source"), found["board"].alias("board"))


def sheet_id(value: Column) -> Column:
    """A spreadsheet's id from its address, or as it stands; NULL if it is neither."""
    raw = F.trim(value)
    inside = F.regexp_extract(raw, r"^https://docs[.]google[.]com/spreadsheets/d/([A-Za-z0-9_-]+)(?:[/?#].*)?$", 1)
    return F.when(inside != "", inside).when(raw.rlike("^[A-Za-z0-9_-]{20,}$"), raw)


# Countries whose codes are understood in a provider's country field, and other ways to write them.
CODED = ["US", "GB", "NG", "IN", "CA", "IT", "LU", "IE", "ES", "NL", "DE", "DK", "PT", "FR", "SG", "AU", "JP", "PL", "AT", "IL"]
ALIASES = {"U.S.": "US", "U.S.A.": "US", "United States of America": "US", "UK": "GB", "U.K.": "GB"}
# What a country field may say that is no country.
REGIONS = [
    "european union", "europe", "africa", "asia", "north america", "south america", "latin america", "americas", "global", "worldwide", "remote", "international", "anywhere", "unknown",
    "amer", "emea", "apac", "latam", "mena",
]
# Country codes that one provider uses, and countries that a client can choose.
CODES_OF_LISTS = ["AT", "CA", "DE", "GB", "IE", "NG", "SG", "US"]
CHOICES = {"NG": ["nigeria", "ng", "nga"], "IN": ["india"], "GB": ["uk", "unitedkingdom"], "CA": ["canada"], "US": ["us", "usa", "unitedstates", "unitedstatesofamerica"]}


def _named(said: dict[str, str]) -> Column:
    """A map literal from lower-case text to the name of the country whose code is given."""
    locale = SparkSession.active()._jvm.java.util.Locale
    return F.create_map(*[F.lit(x) for text, code in said.items() for x in (text.lower(), locale("", code).getDisplayCountry(locale.ENGLISH))])


def _every_way() -> dict[str, str]:
    locale = SparkSession.active()._jvm.java.util.Locale
    known = {text: code for code in CODED for text in (code, locale("", code).getISO3Country(), locale("", code).getDisplayCountry(locale.ENGLISH))}
    return known | ALIASES


def structured_countries(value: Column) -> Column:
    """Countries that a structured field names: a known code or name, else names within it, else any other name that is no region."""
    plain = F.trim(F.coalesce(value, F.lit("")))
    known = F.try_element_at(_named(_every_way()), F.lower(plain))
    inside = location(plain, F.lit(None).cast("array<string>"))["countries"]
    name = (F.length(plain) > 3) & ~F.lower(plain).isin(REGIONS) & plain.rlike(r"^\p{L}+(?:[ '-]\p{L}+)*$")
    return F.when(known.isNotNull(), F.array(known)).when(F.size(inside) > 0, inside).when(name, F.array(plain)).otherwise(F.array().cast("array<string>"))


def listed_country(code: Column, inferred: Column) -> Column:
    """Countries of a posting with a country code: that one if it is known, none if it isn't, the inferred ones without a code."""
    said = F.trim(F.coalesce(code, F.lit("")))
    known = F.try_element_at(_named({c: c for c in CODES_OF_LISTS}), F.lower(said))
    return F.when(said == "", inferred).otherwise(F.array_compact(F.array(known)))


def chosen_country(value: Column) -> Column:
    """struct(country, valid) of a client's choice, whatever its punctuation; "any" and blank choose none."""
    key = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")
    known = F.try_element_at(_named({text: code for code, texts in CHOICES.items() for text in texts}), key)
    free = F.trim(F.lower(F.coalesce(value, F.lit("")))).isin("", "any")
    return F.struct(F.when(~free, known).alias("country"), (free | known.isNotNull()).alias("valid"))
