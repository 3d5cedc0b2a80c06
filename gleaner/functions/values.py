"""Column functions over URLs, times, hashes and identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner.functions import text as T

# Query parameters that only track.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]
#: Seconds that a posting's time may lie ahead.
AHEAD = 300


def url_part(url: Column, group: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query, 5 fragment; an absent part is empty."""
    return F.regexp_extract(F.trim(url), r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", group)


def _decoded(part: Column) -> Column:
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """An array of (name, value) of a query's parameters, decoded."""
    said = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(said, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("name"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1)).alias("value")))


def query_text(pairs: Column) -> Column:
    """``?`` and encoded parameters; empty without any."""
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, no fragment, no tracking parameters; the others are decoded and encoded
    again, in their order."""
    url = F.regexp_replace(F.btrim(url, F.lit(" \t\r\n\f\x0b")), "[\t\r\n]", "")
    path = F.rtrim(url_part(url, 3), F.lit("/"))
    kept = F.filter(query_pairs(url_part(url, 4)), lambda p: ~F.startswith(F.lower(p["name"]), F.lit("utm_")) & ~F.lower(p["name"]).isin(TRACKING))
    scheme, host = F.lower(url_part(url, 1)), F.lower(url_part(url, 2))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.when(path == "", "/").otherwise(path), query_text(kept),
    )


def sorted_query(url: Column) -> Column:
    """A canonical URL with its parameters in the order of decoded names and values."""
    return F.concat(F.substring_index(url, "?", 1), query_text(F.array_sort(query_pairs(url_part(url, 4)))))


def uuid5(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name's version 5 UUID; the namespace is that of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4).substr((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def age_seconds(posted_at: Column, evaluated_at: Column) -> Column:
    return (F.unix_micros(evaluated_at.cast("timestamp")) - F.unix_micros(posted_at.cast("timestamp"))) / 1_000_000


def freshness(posted_at: Column, evaluated_at: Column, max_hours: Column, unknown: Column) -> Column:
    """NULL if fresh, else why not; an unknown age passes only under the policy ``allow``."""
    age = age_seconds(posted_at, evaluated_at)
    return (
        F.when(posted_at.isNull(), F.when(unknown == "allow", None).otherwise("posting_age_unknown"))
        .when(age < -AHEAD, "posting_time_invalid").when(age > max_hours * 3600, "stale_posting")
    )


def age_bucket(posted_at: Column, evaluated_at: Column) -> Column:
    age = age_seconds(posted_at, evaluated_at)
    return (
        F.when(posted_at.isNull(), "unknown").when(age < -AHEAD, "invalid").when(age <= 24 * 3600, "0-24h")
        .when(age <= 48 * 3600, "24-48h").when(age <= 72 * 3600, "48-72h").otherwise(">72h")
    )


def posted_age_days(label: Column) -> Column:
    """Days that a relative label states ("Posted 4 Days Ago"); NULL for anything else."""
    low = F.lower(F.trim(label))
    return (
        F.when(low == "posted today", 0).when(low == "posted yesterday", 1)
        .otherwise(F.regexp_extract(low, r"^posted (\d+)\+? days? ago$", 1).try_cast("int"))
    )


def employer_key(employer_id: Column, company: Column) -> Column:
    return F.coalesce(F.concat(F.lit("id:"), employer_id), F.concat(F.lit("name:"), F.lower(F.trim(F.regexp_replace(company, r"(?U)\s+", " ")))))


def day_window(at: Column, zone: str) -> tuple[Column, Column]:
    """Start and end, in UTC, of the local day of a time."""
    start = F.date_trunc("day", F.from_utc_timestamp(at, zone))
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(start + F.expr("INTERVAL 1 DAY"), zone)


def hour_cohort(at: Column) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / 3600)


def older_than_72h(age_days: Column) -> Column:
    """Whether a stated age in days is surely beyond 72 hours."""
    return age_days >= 4


def retention_basis(evidence: Column, posted_at: Column, first_seen: Column) -> Column:
    """The time that retention counts from."""
    return F.coalesce(evidence, posted_at, first_seen)


def age_hours(at: Column, evaluated_at: Column) -> Column:
    """Age in hours to one decimal, half to even; NULL if unknown."""
    return F.bround(age_seconds(at, evaluated_at) / 3600, 1)


def content_fingerprint(title: Column, description: Column, location: Column, employment_type: Column) -> Column:
    """SHA-256 of the posting's facts as JSON text with sorted names and ASCII characters only."""
    blank = lambda c: T.squeezed(F.coalesce(c, F.lit("")))
    facts = {"description": blank(description), "employment_type": employment_type, "location": F.lower(blank(location)), "title": T.normalize_title(F.coalesce(title, F.lit("")))}
    said = [F.concat(F.lit(f'"{name}": '), T.json_string(value, ascii_only=True)) for name, value in facts.items()]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *said), F.lit("}")), 256)


def canonical_sha256(facts: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON text with sorted names; other characters than ASCII stay as they are."""
    said = [F.concat(F.lit(f'"{name}":'), T.json_string(facts[name], ascii_only=False)) for name in sorted(facts)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *said), F.lit("}")), 256)


def control_id(*parts: Column) -> Column:
    """16 hexadecimal digits that stand for names without showing them."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def status_class(code: Column) -> Column:
    """What an HTTP status means for a collection."""
    return (
        F.when(code.between(200, 299), "success").when(code.isin(404, 410), "missing").when(code == 429, "rate_limited")
        .when(code.isin(502, 503, 504), "unavailable").otherwise("failed")
    )


def failure_class(error: Column) -> Column:
    """A short name of an error text, from what follows its first colon."""
    detail = F.when(F.contains(error, F.lit(": ")), error.substr(F.locate(": ", error) + 2, F.length(error))).otherwise(error)
    name = F.replace(F.lower(F.trim(detail)), F.lit(" "), F.lit("_"))
    http = F.concat(F.lit("http_"), F.trim(F.regexp_replace(detail, "^HTTP ", "")))
    return F.when(F.startswith(detail, F.lit("HTTP ")), http).when(name == "", "unknown").otherwise(name)


def id_of_path(path: Column) -> Column:
    """The provider's id at the end of a posting's path, after the last underscore; NULL without one."""
    return F.nullif(F.when(F.contains(path, F.lit("_")), F.substring_index(path, "_", -1)), F.lit(""))


def site_outcome(failure: Column, rows: Column, status: Column) -> Column:
    """What became of a site: its last transport failure, an empty but valid board, or the board's own status."""
    return (
        F.when(F.contains(failure, F.lit("Timeout")), "request_timeout").when(F.contains(failure, F.lit("Connect")) | F.contains(failure, F.lit("Network")), "connection_failure")
        .when(F.startswith(failure, F.lit("HTTP ")), "http_failure").when(failure == "expected JSON list of objects", "malformed_unexpected_payload")
        .when(failure.isNotNull(), "other_operational_failure").when(rows == 0, "empty_valid_board").otherwise(status)
    )
