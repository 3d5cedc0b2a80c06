"""The registered queries over the shared tables, each with the SQL that gives the same rows.

Roles of the tables: events are postings (``event_type`` provider, ``user_id`` employer or target, ``ts`` posting time, ``value``
runtime or score), documents are posting texts (``lang`` country, ``source`` board), orders are the delivery ledger
(customer = client), customers and suppliers are target registries, pages are vacancy URLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleaner.functions import places, text as T, values as V
from gleaner.operators import batch, components, grouping, matching, read_api, schedule, state, telemetry
from gleaner.sources import exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"
_AT = f"TIMESTAMP '{NOW}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a UTC timestamp; every 17th posting's time is unknown, so that policies have something to decide."""
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("posted_at", F.when(F.col("event_id") % 17 != 0, F.col("ts")))


_EVENTS = "(SELECT *, CASE WHEN event_id % 17 <> 0 THEN ts END AS posted_at FROM events)"
_AGE = f"(epoch_us({_AT}) - epoch_us(posted_at)) / 1000000.0"
_BUCKET = f"CASE WHEN posted_at IS NULL THEN 'unknown' WHEN {_AGE} < -300 THEN 'invalid' WHEN {_AGE} <= 86400 THEN '0-24h' WHEN {_AGE} <= 172800 THEN '24-48h' WHEN {_AGE} <= 259200 THEN '48-72h' ELSE '>72h' END"


def now():
    return F.lit(NOW).cast("timestamp")


def micros(c) -> "F.Column":
    return F.unix_micros(c.cast("timestamp") if not isinstance(c, str) else F.col(c).cast("timestamp"))


# -- telemetry ---------------------------------------------------------------------------------------------------------

_STAGES = "count(*) AS evaluated, count(*) FILTER (WHERE value > 20) AS title, count(*) FILTER (WHERE value > 20 AND user_id % 3 = 0) AS market"
_AGES = ", ".join(f"count(*) FILTER (WHERE b = '{b}') AS {('age_' + b).replace('-', '_').replace('>', 'over_')}" for b in telemetry.BUCKETS)


@query(f"SELECT event_type, {_STAGES}, {_AGES} FROM (SELECT *, {_BUCKET} AS b FROM {_EVENTS}) GROUP BY GROUPING SETS ((event_type), ())")
def funnel_overall_and_source(spark, sf):
    return telemetry.funnel(events(spark, sf), "event_type", "posted_at", now(), {"title": F.col("value") > 20, "market": F.col("user_id") % 3 == 0})


@query(f"SELECT event_type, {_STAGES}, {_AGES} FROM (SELECT *, {_BUCKET} AS b FROM {_EVENTS}) GROUP BY event_type")
def funnel_by_source(spark, sf):
    return funnel_overall_and_source(spark, sf).where("event_type IS NOT NULL")


_FUNNEL = f"SELECT event_type, {_STAGES}, {_AGES} FROM (SELECT *, {_BUCKET} AS b FROM {_EVENTS}) GROUP BY GROUPING SETS ((event_type), ())"
_SUM = " + ".join(f"{('age_' + b).replace('-', '_').replace('>', 'over_')}" for b in telemetry.BUCKETS)


@query(f"""SELECT CAST(count(*) FILTER (WHERE title > evaluated OR market > title) AS INT) AS not_monotone, CAST(count(*) FILTER (WHERE {_SUM} <> evaluated) AS INT) AS not_partitioned,
CAST(sum(CASE WHEN event_type IS NULL THEN evaluated ELSE -evaluated END) AS INT) AS not_summed FROM ({_FUNNEL})""")
def funnel_invariant_violations(spark, sf):
    rows = funnel_overall_and_source(spark, sf)
    ages = sum((F.col(c) for c in rows.columns if c.startswith("age_")), F.lit(0))
    parts = rows.agg(
        F.count_if((F.col("title") > F.col("evaluated")) | (F.col("market") > F.col("title"))).cast("int").alias("not_monotone"),
        F.count_if(ages != F.col("evaluated")).cast("int").alias("not_partitioned"),
        F.sum(F.when(F.col("event_type").isNull(), F.col("evaluated")).otherwise(-F.col("evaluated"))).cast("int").alias("not_summed"),
    )
    return parts


@query("""
WITH e AS (SELECT event_type, user_id, ts, value, CASE user_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'success' END AS status FROM events),
g AS (SELECT *, (epoch_us(ts) - epoch_us(max(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))) / 3.6e9 AS gap FROM e)
SELECT event_type, count(*) AS attempted, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'partial') AS partial,
  count(*) FILTER (WHERE status = 'failed') AS failed, round_even(count(*) FILTER (WHERE status = 'success') / count(*), 6) AS success_rate, count(DISTINCT user_id) AS targets,
  round_even(quantile_cont(gap, 0.95), 3) AS revisit_p95_h, round_even(max(gap), 3) AS revisit_max_h,
  CAST(round_even(quantile_cont(value, 0.5), 0) AS BIGINT) AS runtime_p50, CAST(round_even(quantile_cont(value, 0.95), 0) AS BIGINT) AS runtime_p95
FROM g GROUP BY event_type""")
def observed_coverage_report(spark, sf):
    status = F.when(F.col("user_id") % 5 == 0, "failed").when(F.col("user_id") % 5 == 1, "partial").otherwise("success")
    return telemetry.coverage(events(spark, sf).withColumn("status", status), "event_type", "user_id", "ts", "status", "value")


@query("""SELECT event_type, CAST(round_even(quantile_cont(value, 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(value, 0.95), 0) AS BIGINT) AS p95,
round_even(quantile_cont(value, 0.5), 3) AS p50_ms FROM events GROUP BY event_type""")
def runtime_percentiles(spark, sf):
    whole = lambda c: F.bround(c, 0).cast("long")
    p = telemetry.percentiles(events(spark, sf), ["event_type"], "value", [0.5, 0.95])
    return p.select("event_type", whole("p0").alias("p50"), whole("p1").alias("p95"), F.bround("p0", 3).alias("p50_ms"))


@query("""
WITH s AS (SELECT user_id AS target, event_type AS job, CAST(date_trunc('day', ts) AS DATE) AS run, ts, value > 10 AS f, value > 10 AND event_id % 2 = 0 AS e FROM events),
k AS (SELECT *, e AND row_number() OVER (PARTITION BY target, job, e ORDER BY ts, run) = 1 AS first FROM s)
SELECT target, count(DISTINCT run) AS observations, count(DISTINCT CASE WHEN f THEN job END) AS fresh_jobs, count(DISTINCT CASE WHEN e THEN job END) AS eligible_jobs,
  count(DISTINCT CASE WHEN first THEN run END) AS eligible_observations, epoch_us(max(CASE WHEN first THEN ts END)) AS last_eligible_at FROM k GROUP BY target""")
def target_yield(spark, sf):
    rows = events(spark, sf).select(F.col("user_id").alias("target"), F.col("event_type").alias("job"), F.to_date("ts").alias("run"), "ts", "value", "event_id")
    out = telemetry.target_yield(rows, "target", "job", "run", "ts", F.col("value") > 10, F.col("event_id") % 2 == 0)
    return out.withColumn("last_eligible_at", F.unix_micros("last_eligible_at"))


@query("""
WITH y AS (SELECT user_id AS target, count(*) FILTER (WHERE value > 50) AS eligible, count(*) AS observations, max(ts) AS last_at FROM events GROUP BY 1)
SELECT target, eligible, observations, row_number() OVER (ORDER BY eligible / observations DESC, eligible DESC, observations DESC, last_at DESC, sha256(CAST(target AS VARCHAR)), target) AS rn
FROM y QUALIFY rn <= 25""")
def yield_rank_topk(spark, sf):
    y = events(spark, sf).groupBy(F.col("user_id").alias("target")).agg(F.count_if(F.col("value") > 50).alias("eligible"), F.count("*").alias("observations"), F.max("ts").alias("last_at"))
    order = [-(F.col("eligible") / F.col("observations")), -F.col("eligible"), -F.col("observations"), -F.unix_micros("last_at"), *schedule.by_digest(F.col("target"))]
    return read_api.page(y, order, 0, 25).select("target", "eligible", "observations", "rn")


@query("""
WITH m AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, n FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, lower(o_orderpriority), o_orderpriority) = 1""")
def mode_with_tiebreak(spark, sf):
    return telemetry.mode(read(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("""
WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT min(n) AS least, median(n) AS middle, max(n) AS most, round_even(avg(n), 6) AS mean, count(*) AS targets FROM c""")
def occurrence_distribution(spark, sf):
    c = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return c.agg(F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"), F.bround(F.avg("n"), 6).alias("mean"), F.count("*").alias("targets"))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def inventory_histogram_pivot(spark, sf):
    wide = read(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s.lower()) for s in "FOP"])


@query("""
SELECT l_partkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rn FROM lineitem GROUP BY l_partkey QUALIFY rn <= 20""")
def top20_inventory(spark, sf):
    c = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return read_api.page(c, [-F.col("n"), F.col("l_partkey")], 0, 20).select("l_partkey", "n", "rn")


@query("""
WITH r AS (SELECT user_id, event_type = 'error' OR value > 60 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, coalesce(min(CASE WHEN NOT bad THEN k END) - 1, count(*)) AS streak FROM r GROUP BY user_id""")
def failure_streak(spark, sf):
    return state.streaks(events(spark, sf), ["user_id"], ["ts", "event_id"], (F.col("event_type") == "error") | (F.col("value") > 60))


@query("""
WITH r AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, list(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, day, len(v) AS jobs, len(list_filter(v, lambda x: x > 50)) AS trusted, len(list_filter(v, lambda x: x BETWEEN 10 AND 20)) AS fresh FROM r""")
def nested_observation_rows(spark, sf):
    v = F.col("value")
    return events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("jobs"), F.count_if(v > 50).alias("trusted"), F.count_if(v.between(10, 20)).alias("fresh"))


_SHARE = "CASE WHEN present = total THEN 'reliable' WHEN present > 0 THEN 'conditional' ELSE 'unavailable' END"


@query(f"""
WITH j AS (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
u AS (SELECT 'text' AS field, count(text) AS present, count(*) AS total FROM j UNION ALL SELECT 'lang', count(lang), count(*) FROM j
  UNION ALL SELECT 'quality', count(quality), count(*) FROM j UNION ALL SELECT 'toxic', count(toxic), count(*) FROM j)
SELECT field, present, total, {_SHARE} AS class FROM u""")
def field_coverage(spark, sf):
    j = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    one = j.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in ("text", "lang", "quality", "toxic")])
    long = one.unpivot(["total"], ["text", "lang", "quality", "toxic"], "field", "present")
    return long.select("field", "present", "total", F.when(F.col("present") == F.col("total"), "reliable").when(F.col("present") > 0, "conditional").otherwise("unavailable").alias("class"))


# -- functions ---------------------------------------------------------------------------------------------------------

_Q = "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND NOT list_contains(['fbclid','gclid','mc_cid','mc_eid','ref','source'], lower(split_part(p, '=', 1))))"
_CANON = f"""lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) ||
CASE WHEN rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') END ||
CASE WHEN len({_Q}) > 0 THEN '?' || array_to_string({_Q}, '&') ELSE '' END"""


@query(f"SELECT page_id, {_CANON} AS canonical FROM pages")
def url_canonicalize(spark, sf):
    return read(spark, sf, "pages").select("page_id", V.canonical_url(F.col("url")).alias("canonical"))


@query("""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS board, nullif(split_part(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/', 2), '') AS site,
regexp_extract(url, '/([0-9]+)', 1) AS job FROM pages""")
def url_identity_parts(spark, sf):
    url = F.col("url")
    return read(spark, sf, "pages").select("page_id", V.url_part(url, 2).alias("board"), F.nullif(F.get(F.split(V.url_part(url, 3), "/"), F.lit(1)), F.lit("")).alias("site"), F.regexp_extract(url, "/([0-9]+)", 1).alias("job"))


@query()
def html_to_text_exact(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


_STRIP = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<!--.*?-->|<!doctype[^>]*>', '', 'g'),
'(?i)</?(p|div|li|br|h[1-4]|tr)(\\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
_PLAIN = f"replace(replace(replace(replace(replace({_STRIP}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"""SELECT page_id, nullif(array_to_string(list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS text FROM pages""")
def html_to_text_basic(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.html_lines(F.col("html")).alias("text"))


@query("SELECT p_partkey, trim(regexp_replace(replace(lower(p_name || ' Full-Stack'), 'full-stack', 'full stack'), '[^a-z0-9+#.]+', ' ', 'g')) AS title FROM part")
def title_normalize(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.normalize_title(F.concat("p_name", F.lit(" Full-Stack"))).alias("title"))


_TITLES = "(SELECT *, p_name || CASE p_partkey % 6 WHEN 0 THEN ' Senior Staff' WHEN 1 THEN ' Head of Lead' WHEN 2 THEN ' Junior Manager' WHEN 3 THEN ' VP Director' ELSE '' END AS title FROM part)"


def _titles(spark, sf):
    k = F.col("p_partkey") % 6
    tail = F.when(k == 0, " Senior Staff").when(k == 1, " Head of Lead").when(k == 2, " Junior Manager").when(k == 3, " VP Director").otherwise("")
    return read(spark, sf, "part").withColumn("title", F.concat("p_name", tail))


_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(title, '(?i)\\b{s}\\b') THEN '{s}'" for s in T.SENIORITY) + " ELSE 'unknown' END"


@query(f"SELECT p_partkey, {_LEVEL} AS level FROM {_TITLES}")
def seniority_precedence(spark, sf):
    return _titles(spark, sf).select("p_partkey", T.seniority(F.col("title"), F.lit(None).cast("string")).alias("level"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{k}'" for k, p in T.MANAGEMENT) + " END"


@query(f"SELECT p_partkey, {_KIND} AS kind FROM {_TITLES}")
def management_titles(spark, sf):
    return _titles(spark, sf).select("p_partkey", T.management_kind(F.col("title")).alias("kind"))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^\\pL\\pN_])(of|die|que)($|[^\\pL\\pN_])') AS has FROM documents")
def term_containment(spark, sf):
    has = lambda w: T.contains_term(F.col("text"), F.lit(w))
    return read(spark, sf, "documents").select("doc_id", (has("of") | has("die") | has("que")).alias("has"))


_BODY = "lower(coalesce(text, ''))"
_TEXT_MODE = f"CASE WHEN regexp_matches({_BODY}, '{T.HYBRID}') THEN 'hybrid' WHEN regexp_matches({_BODY}, '{T.ONSITE}') THEN 'onsite' WHEN regexp_matches({_BODY}, '{T.REMOTE_ROLE}') AND NOT regexp_matches({_BODY}, '{T.NOT_REMOTE.replace(chr(39), chr(39) * 2)}') THEN 'remote' ELSE 'unknown' END"
_HTML_TEXT = f"(SELECT page_id AS doc_id, html AS text FROM pages UNION ALL SELECT doc_id, text FROM documents)"


@query(f"SELECT mode, count(*) AS n FROM (SELECT {_TEXT_MODE} AS mode FROM {_HTML_TEXT}) GROUP BY mode")
def remote_classify(spark, sf):
    """Work modes of all documents and raw pages, from their whole texts."""
    none = F.lit(None).cast("array<string>")
    texts = read(spark, sf, "documents").select("text").union(read(spark, sf, "pages").select("html"))
    return texts.groupBy(T.work_mode(F.lit(None).cast("string"), F.col("text"), none, none).alias("mode")).agg(F.count("*").alias("n"))


_CITIES = "(SELECT c_custkey, c_name || ', ' || substr(n_name, 1, 2) AS place FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(f"SELECT c_custkey, CASE WHEN substr(place, -2) IN ({', '.join(repr(x) for x in T.US_STATES)}) THEN 'onsite' ELSE 'unknown' END AS mode FROM {_CITIES}")
def city_state_mode(spark, sf):
    """Locations of the form "city, state" of all customers; the first letters of a nation stand for the state."""
    nation = read(spark, sf, "nation")
    c = read(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    place, none = F.concat("c_name", F.lit(", "), F.substring("n_name", 1, 2)), F.lit(None).cast("array<string>")
    return c.select("c_custkey", T.work_mode(place, F.lit(None).cast("string"), none, none).alias("mode"))


@query("""SELECT l_orderkey, max(CAST(l_quantity AS INT)) AS years FROM lineitem WHERE l_quantity < 100 GROUP BY 1""")
def experience_years_extract(spark, sf):
    """The largest minimum of years in postings made of an order's lines, a sentence for each."""
    said = F.concat(F.lit("At least "), F.col("l_quantity").cast("int").cast("string"), F.lit(" years of experience. Founded 77 years ago."))
    l = read(spark, sf, "lineitem").where("l_quantity < 100")  # noqa: E741
    posting = l.groupBy("l_orderkey").agg(F.array_join(F.collect_list(said), "\n").alias("text"))
    return posting.select("l_orderkey", T.required_years(F.col("text")).alias("years"))


@query()
def experience_years_of_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.required_years(F.col("text")).alias("years"))


@query("SELECT doc_id, CASE WHEN lang IN ('de', 'fr', 'es') THEN upper(lang) END AS code FROM documents")
def country_alias_lookup(spark, sf):
    """The languages of all documents looked up among the world's country codes and names."""
    return places.with_country(read(spark, sf, "documents"), F.col("lang")).select("doc_id", F.col("country_code").alias("code"))


_ESCAPED = """array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
WHEN unicode(c) > 65535 THEN '\\u' || lower(to_hex(55296 + (unicode(c) - 65536) // 1024)) || '\\u' || lower(to_hex(56320 + (unicode(c) - 65536) % 1024)) ELSE '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') END), '')"""
_SQUEEZED = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"""SELECT doc_id, sha256('{{"description": "' || {_ESCAPED.format(_SQUEEZED.format('text'))} || '", "employment_type": null, "location": "' || {_ESCAPED.format('lower(' + _SQUEEZED.format('lang') + ')')}
|| '", "title": "' || trim(regexp_replace(replace(lower(coalesce(source, '')), 'full-stack', 'full stack'), '[^a-z0-9+#.]+', ' ', 'g')) || '"}}') AS fingerprint FROM documents""")
def fingerprint_sha256(spark, sf):
    """Content fingerprints of all documents as postings: the whole text is the description."""
    return read(spark, sf, "documents").select("doc_id", V.content_fingerprint(F.col("source"), F.col("text"), F.col("lang"), F.lit(None).cast("string")).alias("fingerprint"))


@query("""
WITH h AS (SELECT o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('order:' || o_orderkey)) AS h FROM orders)
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def uuid5_ids(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", V.uuid5(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))).alias("id"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'id:' || c_mktsegment ELSE 'name:' || lower(c_name) END AS employer FROM customer")
def employer_key(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", V.employer_key(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.col("c_name")).alias("employer"))


@query(f"SELECT event_id, {_BUCKET} AS bucket FROM {_EVENTS}")
def age_bucket(spark, sf):
    return events(spark, sf).select("event_id", V.age_bucket(F.col("posted_at"), now()).alias("bucket"))


@query(f"SELECT event_id, CASE WHEN posted_at IS NULL THEN CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'posting_age_unknown' END WHEN {_AGE} < -300 THEN 'posting_time_invalid' WHEN {_AGE} > 259200 THEN 'stale_posting' END AS disposition FROM {_EVENTS}")
def freshness_disposition(spark, sf):
    policy = F.when(F.col("event_id") % 2 == 0, "allow").otherwise("review")
    return events(spark, sf).select("event_id", V.freshness(F.col("posted_at"), now(), F.lit(72), policy).alias("disposition"))


@query(f"SELECT event_id, CASE WHEN d < 0 THEN NULL ELSE CAST(least(d, 30) AS INT) END AS days, d >= 4 AS old FROM (SELECT event_id, CAST(floor((epoch_us({_AT}) - epoch_us(ts)) / 8.64e10) AS BIGINT) AS d FROM events)")
def relative_age(spark, sf):
    """Relative labels made of every posting's time, and the ages that they state."""
    days = F.floor((F.unix_micros(now()) - F.unix_micros("ts")) / 8.64e10)
    said = F.when(days == 0, "Posted Today").when(days == 1, "Posted Yesterday").when(days >= 30, "Posted 30+ Days Ago").when(days > 1, F.concat(F.lit("Posted "), days.cast("string"), F.lit(" Days Ago")))
    age = V.posted_age_days(said)
    return events(spark, sf).select("event_id", age.alias("days"), F.coalesce(V.older_than_72h(age), F.lit(False)).alias("old"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 05:00:00' AND ts < TIMESTAMP '2024-01-16 05:00:00' GROUP BY 1""")
def tz_day_window_counts(spark, sf):
    start, end = V.day_window(F.lit("2024-01-15 12:00:00").cast("timestamp"), "America/New_York")
    return events(spark, sf).where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS cohort, count(*) AS n FROM events GROUP BY 1")
def hour_cohort(spark, sf):
    return events(spark, sf).groupBy(V.hour_cohort(F.col("ts")).alias("cohort")).agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def json_prop_extract(spark, sf):
    key = F.get(F.json_object_keys("props"), F.lit(0))
    return events(spark, sf).select("event_id", F.element_at(F.from_json("props", "map<string,string>"), key).alias("first_value"))


# -- matching ----------------------------------------------------------------------------------------------------------


def _rule(values: list[str], intent: str, policy: str = "review") -> tuple:
    return (values, intent, policy)


def _brief(client: str, roles: list[str], **more) -> tuple:
    empty = _rule([], "ignore")
    base = {
        "management_roles": "ignore", "excluded_titles": [], "excluded_seniority": [], "target_market": empty, "work_mode": empty, "work_eligibility": empty,
        "employment_type": empty, "max_years": None, "avoid": [], "must": [], "preferred": [],
    } | more
    return (client, roles, *base.values())


#: Five briefs over part names and types as titles and descriptions.
BRIEFS = [
    _brief("c1", ["blue"], target_market=_rule(["EUROPE"], "must"), preferred=["brass"]),
    _brief("c2", ["green"], management_roles="avoid", avoid=["steel"], must=["economy"]),
    _brief("c3", ["red", "azure"], target_market=_rule(["ASIA", "AFRICA"], "prefer"), work_mode=_rule(["remote"], "must")),
    _brief("c4", ["a"], excluded_seniority=["senior"], employment_type=_rule(["full_time"], "avoid"), max_years=4),
    _brief("c5", ["part"], target_market=_rule(["AMERICA"], "avoid"), work_mode=_rule(["onsite"], "prefer"), preferred=["tin", "copper"]),
]


def _jobs(spark, sf):
    """Parts as postings: the brand's number decides place, mode and kind."""
    k = F.col("p_partkey") % 7
    places = F.element_at(F.array(*map(F.lit, ["EUROPE", "ASIA", "AFRICA", "AMERICA", "MIDDLE EAST", None, "EUROPE"])), (k + 1).cast("int"))
    return read(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.when(k == 0, " Senior Manager").otherwise(" part")).alias("title"),
        F.when(k != 6, F.concat(F.lower("p_type"), F.when(k == 3, "; at least 6 years of experience").otherwise(""))).alias("description_text"),
        F.lit(None).cast("string").alias("country"), F.array_compact(F.array(places)).alias("eligible_countries"),
        F.when(k < 3, "remote").when(k < 5, "onsite").otherwise("unknown").alias("remote_status"), F.when(k % 2 == 0, "full_time").alias("employment_type"),
    )


def matches(spark, sf):
    return matching.match(_jobs(spark, sf), spark.createDataFrame(BRIEFS, matching.BRIEF))


_JOBS = """j AS (SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_name) || CASE p_partkey % 7 WHEN 0 THEN ' senior manager' ELSE ' part' END AS t, p_partkey % 7 AS k,
 CASE WHEN p_partkey % 7 <> 6 THEN lower(p_type) END AS d,
 CASE p_partkey % 7 WHEN 0 THEN 'EUROPE' WHEN 1 THEN 'ASIA' WHEN 2 THEN 'AFRICA' WHEN 3 THEN 'AMERICA' WHEN 4 THEN 'MIDDLE EAST' WHEN 6 THEN 'EUROPE' END AS place,
 CASE WHEN p_partkey % 7 < 3 THEN 'remote' WHEN p_partkey % 7 < 5 THEN 'onsite' ELSE 'unknown' END AS mode, p_partkey % 7 % 2 = 0 AS full_time FROM part),
w AS (SELECT *, ' ' || regexp_replace(t || ' ' || coalesce(d, ''), '[^a-z0-9_]+', ' ', 'g') || ' ' AS body FROM j),
b AS (SELECT unnest(['c1', 'c2', 'c3', 'c4', 'c5']) AS client_id),
m AS (SELECT id, client_id, d IS NULL AS blind,
 CASE client_id WHEN 'c1' THEN contains(t, 'blue') WHEN 'c2' THEN contains(t, 'green') WHEN 'c3' THEN contains(t, 'red') OR contains(t, 'azure') WHEN 'c4' THEN contains(t, 'a') ELSE contains(t, 'part') END AS role,
 CASE client_id WHEN 'c1' THEN place IS NOT NULL AND place <> 'EUROPE'
  WHEN 'c2' THEN k = 0 OR contains(body, ' steel ') OR (d IS NOT NULL AND NOT contains(body, ' economy '))
  WHEN 'c3' THEN mode = 'onsite' WHEN 'c4' THEN k = 0 OR full_time OR k = 3 ELSE coalesce(place = 'AMERICA', false) END AS rejected,
 CASE client_id WHEN 'c1' THEN place IS NULL WHEN 'c2' THEN d IS NULL AND NOT contains(body, ' economy ') WHEN 'c3' THEN mode = 'unknown' ELSE false END AS review,
 CASE client_id WHEN 'c1' THEN CAST(contains(body, ' brass ') AS INT) WHEN 'c3' THEN CAST(coalesce(place IN ('ASIA', 'AFRICA'), false) AS INT)
  WHEN 'c5' THEN CAST(mode = 'onsite' AS INT) + CAST(contains(body, ' tin ') AS INT) + CAST(contains(body, ' copper ') AS INT) ELSE 0 END AS hits FROM w, b),
r AS (SELECT id AS job_id, client_id, CASE WHEN NOT role OR rejected THEN 'reject' WHEN review THEN 'needs_review' WHEN hits > 0 THEN 'strong_match' ELSE 'possible_match' END AS decision,
 CASE WHEN role AND NOT rejected THEN 3 + least(hits, 3) END AS score FROM m)"""


@query(f"WITH {_JOBS} SELECT job_id, client_id, decision, score FROM r")
def rule_match_decisions(spark, sf):
    return matches(spark, sf).select("job_id", "client_id", "decision", "score")


@query(f"""WITH {_JOBS} SELECT job_id, policy, CASE WHEN NOT role OR rejected THEN 'reject' WHEN review AND policy = 'reject' THEN 'reject' WHEN review AND policy = 'review' THEN 'needs_review' WHEN hits > 0 THEN 'strong_match' ELSE 'possible_match' END AS decision
FROM (SELECT id AS job_id, role, rejected, review, hits FROM m WHERE client_id = 'c1'), (SELECT unnest(['reject', 'review', 'allow']) AS policy)""")
def unknown_policies(spark, sf):
    """One brief under each policy for unknown evidence."""
    briefs = [_brief(p, ["blue"], target_market=_rule(["EUROPE"], "must", p), preferred=["brass"]) for p in matching.POLICIES]
    return matching.match(_jobs(spark, sf), spark.createDataFrame(briefs, matching.BRIEF)).select("job_id", F.col("client_id").alias("policy"), "decision")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'blue|green') AND NOT contains(lower(p_name), 'dim')")
def title_prefilter(spark, sf):
    briefs = spark.createDataFrame([_brief("c1", ["Blue"], excluded_titles=["dim"]), _brief("c2", ["green"], excluded_titles=["DIM"])], matching.BRIEF)
    return matching.may_match(read(spark, sf, "part").withColumn("title", F.col("p_name")), briefs).select("p_partkey")


@query()
def match_reasons_exploded(spark, sf):
    m = matches(spark, sf)
    return m.select("job_id", "client_id", F.posexplode(F.concat("rejection_reasons", "matched_reasons")).alias("place", "reason"))


@query(f"WITH {_JOBS} SELECT job_id, bool_or(decision IN ('strong_match', 'possible_match')) AS any_match FROM r GROUP BY 1")
def brief_any_match(spark, sf):
    return matches(spark, sf).groupBy("job_id").agg(F.bool_or(F.col("decision").isin("strong_match", "possible_match")).alias("any_match"))


@query(f"WITH {_JOBS} SELECT client_id, decision, count(*) AS n FROM r GROUP BY 1, 2")
def match_decision_counts(spark, sf):
    return matches(spark, sf).groupBy("client_id", "decision").agg(F.count("*").alias("n"))


@query(f"""WITH {_JOBS}, p AS (SELECT a.job_id, a.decision AS d1, b.decision AS d5 FROM r a FULL JOIN r b ON a.job_id = b.job_id AND b.client_id = 'c5' WHERE a.client_id = 'c4')
SELECT count(*) FILTER (WHERE d1 <> 'reject' AND d5 = 'reject') AS only_first, count(*) FILTER (WHERE d1 = 'reject' AND d5 <> 'reject') AS only_second,
count(*) FILTER (WHERE d1 <> 'reject' AND d5 <> 'reject') AS common, count(*) FILTER (WHERE d1 <> d5) AS changed FROM p""")
def match_version_diff(spark, sf):
    m = matches(spark, sf)
    one, two = (m.where(F.col("client_id") == c).select("job_id", F.col("decision").alias(d)) for c, d in (("c4", "d1"), ("c5", "d5")))
    good = lambda d: F.col(d) != "reject"
    return one.join(two, "job_id", "full").agg(
        F.count_if(good("d1") & ~good("d5")).alias("only_first"), F.count_if(~good("d1") & good("d5")).alias("only_second"),
        F.count_if(good("d1") & good("d5")).alias("common"), F.count_if(F.col("d1") != F.col("d5")).alias("changed"))


# -- groups ------------------------------------------------------------------------------------------------------------


def vacancies(spark, sf):
    """Documents as postings: the text is the description, the page of the same number the vacancy's URL."""
    none = F.lit(None).cast("string")
    mode = F.when(F.col("n_chars") % 3 == 0, "remote").when(F.col("n_chars") % 3 == 1, "onsite").otherwise("unknown")
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    country = F.create_map(*map(F.lit, ["en", "United States", "de", "Germany", "fr", "France", "es", "Spain"]))
    return read(spark, sf, "documents").join(pages, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("board").alias("source"), F.col("lang").alias("source_board_id"), F.col("doc_id").cast("string").alias("source_job_id"),
        F.col("url").alias("canonical_url"), none.alias("job_url"), none.alias("apply_url"), F.col("source").alias("company"), F.lit("Writer").alias("title"), F.col("text").alias("description_text"),
        F.array_compact(F.array(F.try_element_at(country, "lang"))).alias("eligible_countries"), none.alias("country"), mode.alias("remote_status"), F.col("lang").alias("location_text"),
        none.alias("city"), none.alias("region"), none.alias("department"), F.lit("full_time").alias("employment_type"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("timestamp").alias("posted_at"),
    )


@query()
def delivery_keys_explode(spark, sf):
    """URL and content keys of all documents as postings; the compatibility folding has no SQL, so tests have a plain version."""
    return grouping.delivery_keys(vacancies(spark, sf))


_PATH = "rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')"
_SORTED = "array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND NOT list_contains(['fbclid','gclid','mc_cid','mc_eid','ref','source'], lower(split_part(p, '=', 1))))), '&')"


@query(f"""SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || {_PATH} || CASE WHEN {_SORTED} <> '' THEN '?' || {_SORTED} ELSE '' END AS value
FROM pages WHERE lower({_PATH}) NOT IN ('', '/', '/jobs', '/careers', '/apply')""")
def delivery_url_keys(spark, sf):
    return read(spark, sf, "pages").select("page_id", grouping.url_key(F.col("url")).alias("value")).where("value IS NOT NULL")


@query()
def delivery_groups(spark, sf):
    """Groups of all documents as postings by URL and content keys, going on from the groups of equal sources and lengths."""
    v = vacancies(spark, sf)
    before = read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.min("doc_id").alias("g"))
    existing = before.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("group-"), F.col("g").cast("string")).alias("group_id"))
    return grouping.delivery_groups(grouping.delivery_keys(v), existing)[0]


@query()
def delivery_representatives(spark, sf):
    v = vacancies(spark, sf)
    none = v.limit(0).select("id", F.col("id").alias("group_id"))
    groups = grouping.delivery_groups(grouping.delivery_keys(v), none)[0]
    return grouping.representatives(v, groups)


@query("""
WITH r AS (SELECT o_custkey AS c, o_orderpriority AS p, count(DISTINCT o_orderkey % 5) AS ids, count(DISTINCT o_orderstatus) AS fingerprints, count(DISTINCT o_orderkey % 8) AS shards FROM orders GROUP BY 1, 2)
SELECT 'provider' || chr(31) || 'board' || chr(31) || c || chr(31) || p AS identity, ids, fingerprints, shards FROM r WHERE ids > 1 OR fingerprints > 1""")
def fanin_identity_conflicts(spark, sf):
    o = read(spark, sf, "orders").select(
        F.lit("board").alias("source"), F.col("o_custkey").cast("string").alias("source_board_id"), F.col("o_orderpriority").alias("source_job_id"), F.lit(None).cast("string").alias("canonical_url"),
        (F.col("o_orderkey") % 5).cast("string").alias("id"), F.col("o_orderstatus").alias("fingerprint"), (F.col("o_orderkey") % 8).alias("shard"))
    return grouping.identity_conflicts(o)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id FROM documents")
def duplicate_groups(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    group = d.groupBy("digest").agg(F.min("doc_id").alias("group_id"))
    return d.join(group, "digest").select("doc_id", "group_id")


@query()
def connected_components(spark, sf):
    """Classes of customers and parts that orders connect; a recursive query doesn't end in time, so tests have a union-find."""
    o, l = read(spark, sf, "orders"), read(spark, sf, "lineitem")  # noqa: E741
    bought = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return components.components(bought.distinct())


@query("""
SELECT text_key, doc_id AS representative, members FROM (SELECT sha256(text) AS text_key, doc_id, count(*) OVER (PARTITION BY text) AS members,
 row_number() OVER (PARTITION BY text ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, n_chars DESC, lang, source, doc_id) AS k FROM documents) WHERE k = 1""")
def representative_pick(spark, sf):
    d = read(spark, sf, "documents").select(F.sha2("text", 256).alias("text_key"), "doc_id", "source", "n_chars", "lang")
    order = F.struct(F.col("source").isNull().alias("s"), (-F.col("n_chars")).alias("n"), "lang", "source", "doc_id")
    return d.groupBy("text_key").agg(F.min(order).alias("b"), F.count("*").alias("members")).select("text_key", F.col("b.doc_id").alias("representative"), "members")


@query("""
WITH m AS (SELECT o_custkey % 100 AS new_group, o_custkey AS old_group, o_orderpriority AS client, min(o_orderdate) AS seen FROM orders GROUP BY 1, 2, 3)
SELECT new_group, client, old_group AS from_group, epoch_us(seen) AS seen FROM m
QUALIFY row_number() OVER (PARTITION BY new_group, client ORDER BY CASE WHEN old_group = new_group THEN 0 ELSE 1 END, CAST(old_group AS VARCHAR)) = 1""")
def group_history_merge(spark, sf):
    m = read(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("new_group"), F.col("o_custkey").alias("old_group"), F.col("o_orderpriority").alias("client")).agg(F.min("o_orderdate").alias("at"))
    best = state.latest(m, ["new_group", "client"], [F.col("old_group") != F.col("new_group"), F.col("old_group").cast("string")])
    return best.select("new_group", "client", F.col("old_group").alias("from_group"), micros("at").alias("seen"))


# -- state -------------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT o_custkey AS k, max_by(o_orderstatus, o_orderkey) AS f FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
a AS (SELECT o_custkey AS k, o_orderkey AS pos, o_orderstatus AS f, lag(o_orderstatus) OVER w AS before, row_number() OVER w AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back
 FROM orders WHERE o_orderkey % 2 = 1 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), l AS (SELECT * FROM a WHERE back = 1)
SELECT coalesce(s.k, l.k) AS o_custkey, CASE WHEN l.k IS NULL THEN 'kept' WHEN s.k IS NULL AND l.i = 1 THEN 'new' WHEN (CASE WHEN l.i > 1 THEN l.before ELSE s.f END) = l.f THEN 'seen' ELSE 'changed' END AS lifecycle,
 coalesce(l.f, s.f) AS fingerprint FROM s FULL JOIN l ON s.k = l.k""")
def upsert_lifecycle(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("fingerprint"))
    stored = state.latest(o.where("pos % 2 = 0"), ["o_custkey"], [F.desc("pos")])
    return state.upsert(stored, o.where("pos % 2 = 1"), ["o_custkey"], "fingerprint")


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS was_delivered, epoch_us(min(o_orderdate)) AS first_seen, epoch_us(max(o_orderdate)) AS last_seen FROM orders GROUP BY 1")
def ledger_monotone(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("was_delivered"), micros(F.min("o_orderdate")).alias("first_seen"), micros(F.max("o_orderdate")).alias("last_seen"))


@query("""
WITH d AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'keep' WHEN event_type = 'view' THEN 'skip_unresolved' WHEN o_custkey IS NOT NULL THEN 'compact' ELSE 'delete' END AS class FROM events LEFT JOIN d ON user_id = o_custkey""")
def retention_classify(spark, sf):
    done = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.lit(True).alias("done")).distinct()
    e = events(spark, sf).join(done, "user_id", "left")
    return e.select("event_id", state.retention_class(F.col("ts"), F.lit("2024-01-20").cast("timestamp"), F.col("event_type") == "view", F.col("done")).alias("class"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_latest_evidence(spark, sf):
    return state.latest(events(spark, sf), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR event_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def or_semi_join_suppression(spark, sf):
    e, o = events(spark, sf), read(spark, sf, "orders")
    by_user = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    by_event = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event_id"))
    return state.either_semi(e, "user_id", (by_user, ["user_id"]), (by_event, ["event_id"]))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_missing_group(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT event_id, epoch_us(max(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)) AS previous_at FROM events")
def asof_previous_observation(spark, sf):
    return events(spark, sf).select("event_id", micros(state.previous(events(spark, sf), ["user_id"], "ts")).alias("previous_at"))


@query("""
WITH g AS (SELECT DISTINCT user_id, ts FROM events WHERE user_id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_at, epoch_us(max(CASE WHEN k = 2 THEN ts END)) AS previous_at, epoch_us(max(ts)) AS last_at, count(*) AS n FROM r GROUP BY 1""")
def coverage_state_fold(spark, sf):
    e = events(spark, sf).withColumn("status", F.when(F.col("user_id") % 5 == 0, "failed").otherwise("success"))
    c = state.coverage_state(e, "user_id", "ts", "status")
    return c.select("user_id", *[micros(x).alias(x) for x in ("first_at", "previous_at", "last_at")], "n")


@query("SELECT user_id, event_type, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at FROM events WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY 1, 2")
def coverage_as_of(spark, sf):
    return events(spark, sf).where(F.col("ts") <= F.lit("2024-01-10").cast("timestamp")).groupBy("user_id", "event_type").agg(micros(F.min("ts")).alias("first_at"), micros(F.max("ts")).alias("last_at"))


@query("SELECT o_custkey, max(o_orderkey) AS version, max_by(o_orderstatus, o_orderkey) AS outcome, count(*) AS events FROM orders GROUP BY 1")
def latest_outcome_version(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("version"), F.max_by("o_orderstatus", "o_orderkey").alias("outcome"), F.count("*").alias("events"))


@query("""
WITH RECURSIVE e AS (SELECT o_custkey AS c, o_orderkey % 3 AS expected, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT c, 0::BIGINT AS i, 0::BIGINT AS v, 0::BIGINT AS refused FROM e WHERE i = 1 UNION ALL
 SELECT e.c, e.i, f.v + CASE WHEN e.expected = f.v THEN 1 ELSE 0 END, f.refused + CASE WHEN e.expected = f.v THEN 0 ELSE 1 END FROM f JOIN e ON e.c = f.c AND e.i = f.i + 1)
SELECT c AS o_custkey, max_by(v, i) AS version, max(i) AS events, max_by(refused, i) AS refused FROM f GROUP BY c""")
def outcome_optimistic_versions(spark, sf):
    o = read(spark, sf, "orders").withColumn("expected", F.col("o_orderkey") % 3)
    return state.versions(o, ["o_custkey"], ["o_orderkey"], "expected")


_DIGESTED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"],
    "documents": ["doc_id", "text", "lang", "source"], "pages": ["page_id", "url", "html"], "conversations": ["conv_id", "turn", "role", "text"],
}


def _digest_sql(t: str, columns: list[str]) -> str:
    row = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns) + "))"
    parts = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS BIGINT)) AS VARCHAR)" for i in range(3))
    return f"SELECT '{t}' AS t, count(*) AS n, {parts} AS digest FROM (SELECT {row} AS h FROM {t})"


@query(" UNION ALL ".join(_digest_sql(t, c) for t, c in _DIGESTED.items()))
def multiset_digest(spark, sf):
    """Digests of the large tables that don't depend on the order of rows."""
    each = [state.multiset_digest(read(spark, sf, t), c).select(F.lit(t).alias("t"), "n", "digest") for t, c in _DIGESTED.items()]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


@query("SELECT user_id, count(DISTINCT day) AS days FROM (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day FROM events UNION SELECT o_custkey, CAST(date_trunc('day', o_orderdate) AS DATE) FROM orders) GROUP BY 1")
def delivered_today_distinct(spark, sf):
    seen = events(spark, sf).select("user_id", F.to_date("ts").alias("day"))
    sold = read(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return seen.union(sold).distinct().groupBy("user_id").agg(F.count("*").alias("days"))


@query("SELECT o_orderkey AS id FROM orders UNION SELECT l_orderkey FROM lineitem")
def known_ids_union(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).union(read(spark, sf, "lineitem").select("l_orderkey")).distinct()


@query("SELECT 'without' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'with', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def set_ops_except_intersect(spark, sf):
    c, o = read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").select("o_custkey")
    count = lambda d, k: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(c.subtract(o), "without").union(count(c.intersect(o), "with"))


@query("SELECT o_orderkey AS id, 'export' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, 'delivery' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def export_union_all_antijoin(spark, sf):
    done = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    rest = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).join(done, "id", "left_anti")
    return done.withColumn("kind", F.lit("export")).unionByName(rest.withColumn("kind", F.lit("delivery")))


# -- selection ---------------------------------------------------------------------------------------------------------

_DIGEST = "sha256(CAST({0} AS VARCHAR)), {0}"


@query(f"SELECT user_id, due_rank, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY max(ts), {_DIGEST.format('user_id')}) AS due_rank FROM events GROUP BY user_id, event_type) WHERE due_rank <= 5")
def oldest_due_topk(spark, sf):
    last = events(spark, sf).groupBy("event_type", "user_id").agg(F.max("ts").alias("last"))
    return schedule.oldest_due(last, "event_type", "user_id", F.col("last"), 5).select("event_type", "user_id", "due_rank")


@query(f"SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY {_DIGEST.format('s_suppkey')}) - 1 AS p, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE ((p - 14) % n + n) % n < 2")
def rotating_cohort(spark, sf):
    return schedule.ring(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey", F.lit(2), 7).select("s_suppkey", "s_nationkey")


@query(f"SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY {_DIGEST.format('c_custkey')}) - 1) % 8 AS shard FROM customer")
def shard_assignment(spark, sf):
    return schedule.shards(read(spark, sf, "customer"), "c_nationkey", "c_custkey", 8).select("c_custkey", "shard")


@query(f"""WITH s AS (SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY {_DIGEST.format('c_custkey')}) - 1) % 8 AS shard FROM customer), t AS (SELECT c_nationkey, count(*) AS total FROM s GROUP BY 1)
SELECT c_nationkey, shard, count(*) AS n, count(*) BETWEEN any_value(total) // 8 AND any_value(total) // 8 + 1 AS even FROM s JOIN t USING (c_nationkey) GROUP BY 1, 2""")
def shard_reconcile(spark, sf):
    """Sizes of every source's shards, and whether they are even."""
    per = schedule.shards(read(spark, sf, "customer"), "c_nationkey", "c_custkey", 8).groupBy("c_nationkey", "shard").agg(F.count("*").alias("n"))
    total = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"))
    least = F.floor(F.col("total") / 8)
    return per.join(total, "c_nationkey").select("c_nationkey", "shard", "n", F.col("n").between(least, least + 1).alias("even"))


@query("SELECT p_partkey, rn, spent FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS rn, sum(p_size) OVER (ORDER BY p_size, p_partkey) AS spent FROM part) WHERE spent <= 500")
def running_budget_cut(spark, sf):
    out = schedule.within_budget(read(spark, sf, "part"), [F.col("p_size"), F.col("p_partkey")], "p_size", 500)
    return out.select("p_partkey", "rn", F.col("spent").cast("long").alias("spent"))


@query("""
WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey, c_nationkey, rank FROM r WHERE n <= 5 OR rank IN (1, 1 + (n - 1) // 4, 1 + 2 * (n - 1) // 4, 1 + 3 * (n - 1) // 4, n)""")
def evenly_spaced_sample(spark, sf):
    return schedule.even_sample(read(spark, sf, "customer"), "c_nationkey", [F.col("c_acctbal"), F.col("c_custkey")], 5).select("c_custkey", "c_nationkey", "rank")


@query("SELECT event_id, rn FROM (SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 4 END, ts DESC, event_id) AS rn FROM events) WHERE rn <= 50")
def read_api_default_order(spark, sf):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(4)
    return read_api.page(events(spark, sf), [rank, -F.unix_micros("ts"), F.col("event_id")], 0, 50).select("event_id", "rn")


@query("SELECT event_id, rn FROM (SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events WHERE event_type IN ('click', 'view') AND contains(lower(event_type || ' ' || props), 'k')) WHERE rn > 40 AND rn <= 60")
def read_api_page(spark, sf):
    rows = read_api.select(events(spark, sf), "K", ["event_type", "props"], event_type=["click", "view"])
    return read_api.page(rows, [-F.col("value"), F.col("event_id")], 40, 20).select("event_id", "rn")


# -- batches -----------------------------------------------------------------------------------------------------------

_CAND = f"""c AS (SELECT CAST(event_id AS VARCHAR) AS job_id, event_id % 4000 AS group_id, user_id AS employer,
 CASE WHEN value > 30 THEN 'strong_match' WHEN value > 10 THEN 'possible_match' WHEN value > 5 THEN 'needs_review' ELSE 'reject' END AS decision,
 CASE WHEN value > 5 THEN CAST(3 + event_id % 4 AS INT) END AS score, posted_at, event_id % 97 = 0 AS historical, event_id % 89 = 0 AS delivered, user_id % 10 = 0 AS cooling FROM {_EVENTS})"""


def candidates(spark, sf):
    v, i = F.col("value"), F.col("event_id")
    return events(spark, sf).select(
        i.cast("string").alias("job_id"), (i % 4000).alias("group_id"), F.col("user_id").alias("employer"),
        F.when(v > 30, "strong_match").when(v > 10, "possible_match").when(v > 5, "needs_review").otherwise("reject").alias("decision"),
        F.when(v > 5, (3 + i % 4).cast("int")).alias("score"), "posted_at", (i % 97 == 0).alias("historical"), (i % 89 == 0).alias("delivered"), (F.col("user_id") % 10 == 0).alias("cooling"))


_PRIO = "CASE decision WHEN 'strong_match' THEN 0 WHEN 'possible_match' THEN 1 WHEN 'needs_review' THEN 2 ELSE 3 END, -coalesce(score, -1), -coalesce(epoch_us(posted_at), 0), job_id"
_BATCH = f"""{_CAND}, e AS (SELECT *, decision IN ('strong_match', 'possible_match') AS eligible,
 CASE WHEN posted_at IS NULL THEN 'posting_age_unknown' WHEN {_AGE} < -300 THEN 'posting_time_invalid' WHEN {_AGE} > 259200 THEN 'stale_posting' END AS stale FROM c),
s AS (SELECT group_id, bool_or(historical) AS h, bool_or(delivered) AS d FROM e WHERE eligible GROUP BY 1),
l AS (SELECT e.* FROM e JOIN s USING (group_id) WHERE eligible AND stale IS NULL AND NOT h AND NOT d),
hd AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY posted_at DESC NULLS LAST, job_id) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY employer ORDER BY {_PRIO}) AS place FROM hd WHERE NOT cooling),
q AS (SELECT *, first_value(decision) OVER w AS d0, first_value(score) OVER w AS s0, first_value(posted_at) OVER w AS t0, first_value(job_id) OVER w AS j0 FROM p WINDOW w AS (PARTITION BY employer ORDER BY place)),
t AS (SELECT group_id, job_id AS rep, CASE WHEN place <= 2 THEN row_number() OVER (ORDER BY place > 2, place, CASE d0 WHEN 'strong_match' THEN 0 WHEN 'possible_match' THEN 1 ELSE 2 END, -coalesce(s0, -1), -coalesce(epoch_us(t0), 0), j0, employer) END AS rn FROM q),
o AS (SELECT e.*, h, d, t.rep, t.rn, coalesce(t.rn <= 60, false) AS taken, hd.group_id IS NOT NULL AND hd.cooling AS cool FROM e LEFT JOIN s USING (group_id) LEFT JOIN t USING (group_id) LEFT JOIN hd USING (group_id)),
z AS (SELECT *, CASE WHEN NOT eligible THEN decision WHEN h THEN 'historical' WHEN d THEN 'prior_delivery' WHEN stale IS NOT NULL THEN stale WHEN cool THEN 'employer_cooldown'
 WHEN rep IS NOT NULL AND rn IS NULL THEN 'company_duplicate_in_batch' WHEN taken AND rep = job_id THEN 'selected_representative' WHEN taken THEN 'practical_duplicate' ELSE 'outside_quota' END AS disposition FROM o)"""


def _batch(spark, sf):
    return batch.assemble(candidates(spark, sf), 60, 2, 72, "review", now())


@query(f"WITH {_BATCH} SELECT job_id, disposition, CASE WHEN disposition = 'selected_representative' THEN rn END AS ordinal FROM z")
def batch_dispositions(spark, sf):
    return _batch(spark, sf).select("job_id", "disposition", "ordinal")


@query(f"WITH {_BATCH} SELECT disposition, count(*) AS postings, count(DISTINCT group_id) AS groups, count(DISTINCT employer) AS employers FROM z GROUP BY 1")
def batch_counts(spark, sf):
    return _batch(spark, sf).groupBy("disposition").agg(F.count("*").alias("postings"), F.count_distinct("group_id").alias("groups"), F.count_distinct("employer").alias("employers"))


@query(f"WITH {_CAND} SELECT job_id, place FROM (SELECT *, row_number() OVER (PARTITION BY employer ORDER BY {_PRIO}) AS place FROM c) WHERE place <= 3")
def employer_cap_rank(spark, sf):
    return state.latest(candidates(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("employer").orderBy(*batch.priority()))), ["employer"], [F.col("place")], 3).select("job_id", "place")


@query(f"""WITH {_CAND}, p AS (SELECT *, row_number() OVER (PARTITION BY employer ORDER BY {_PRIO}) AS place FROM c),
b AS (SELECT employer, decision AS d0, score AS s0, posted_at AS t0, job_id AS j0 FROM p WHERE place = 1)
SELECT job_id, rn FROM (SELECT p.job_id, row_number() OVER (ORDER BY place, CASE d0 WHEN 'strong_match' THEN 0 WHEN 'possible_match' THEN 1 WHEN 'needs_review' THEN 2 ELSE 3 END, -coalesce(s0, -1), -coalesce(epoch_us(t0), 0), j0, employer) AS rn
 FROM p JOIN b USING (employer) WHERE place <= 2) WHERE rn <= 100""")
def round_robin_batch(spark, sf):
    return batch.round_robin(candidates(spark, sf), "employer", 2, batch.priority(), 100).select("job_id", "rn")


@query("""SELECT DISTINCT o.o_custkey, o.o_orderkey FROM orders o JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderkey <> o.o_orderkey AND p.o_orderdate < o.o_orderdate AND p.o_orderdate >= o.o_orderdate - INTERVAL 30 DAY""")
def employer_cooldown(spark, sf):
    o = read(spark, sf, "orders").withColumn("at", micros("o_orderdate"))
    near = state.previous(o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), ["o_custkey"], "o_orderdate")
    return o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).withColumn("before", near).where(F.col("at") - micros("before") <= 30 * 86_400_000_000).select("o_custkey", "o_orderkey")


# -- audits ------------------------------------------------------------------------------------------------------------


@query("SELECT 'documents' AS t, count(*) AS keys, sum(n) AS n_rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'lineitem', count(*), coalesce(sum(n), 0) FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def duplicate_key_audit(spark, sf):
    def audit(t: str, *keys) -> DataFrame:
        twice = read(spark, sf, t).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        return twice.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").alias("n_rows")).select(F.lit(t).alias("t"), "keys", "n_rows")

    return audit("documents", F.sha2("text", 256).alias("k")).union(audit("lineitem", "l_orderkey", "l_linenumber"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orders_without_customer, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS items_without_order")
def referential_integrity_audit(spark, sf):
    o = read(spark, sf, "orders")
    lost = o.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("orders_without_customer"))
    loose = read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("items_without_order"))
    return lost.crossJoin(loose)


@query("SELECT l_returnflag AS part, count(*) AS n, count(DISTINCT l_orderkey) AS ids, count(DISTINCT l_orderkey) FILTER (WHERE shared) AS shared FROM (SELECT *, min(l_returnflag) OVER (PARTITION BY l_orderkey) <> max(l_returnflag) OVER (PARTITION BY l_orderkey) AS shared FROM lineitem) GROUP BY 1")
def partition_reconciliation(spark, sf):
    """One shuffle by order serves the counts of its parts and how many parts it has."""
    own = read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").repartition("l_orderkey")
    parts = own.groupBy("l_orderkey", F.col("l_returnflag").alias("part")).agg(F.count("*").alias("n"))
    both = parts.withColumn("both", F.count("*").over(Window.partitionBy("l_orderkey")) > 1)
    return both.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.count_if("both").alias("shared"))


@query("SELECT conv_id, max(turn) + 1 AS declared, count(*) AS turns, count(*) - count(DISTINCT turn) AS repeated, count(DISTINCT turn) = max(turn) + 1 AS complete FROM conversations GROUP BY 1")
def page_completeness(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(
        (F.max("turn") + 1).alias("declared"), F.count("*").alias("turns"), (F.count("*") - F.count_distinct("turn")).alias("repeated"), (F.count_distinct("turn") == F.max("turn") + 1).alias("complete"))


@query("SELECT d.doc_id, coalesce(l.quality, CAST(d.n_chars % 2 AS INT)) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def detail_over_index_coalesce(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", (F.col("n_chars") % 2).cast("int")).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("""
WITH k AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS i FROM events WHERE ts >= TIMESTAMP '2024-01-29 22:00:00' OR user_id NOT IN (SELECT o_custkey FROM k))
SELECT event_id, i FROM n WHERE i <= 20""")
def incremental_suppression(spark, sf):
    e = events(spark, sf)
    known = read(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    new = F.col("ts") >= F.lit("2024-01-29 22:00:00").cast("timestamp")
    rows = e.where(new).unionByName(e.where(~new).join(known, "user_id", "left_anti"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))).where("i <= 20").select("event_id", "i")


@query("SELECT epoch_us(date_trunc('hour', ts)) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_window_counts(spark, sf):
    w = F.window("ts", "1 hour")
    return events(spark, sf).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(micros(F.col("w.start")).alias("hour"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 7200000000 THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM s GROUP BY user_id, s""")
def session_window_counts(spark, sf):
    w = F.session_window("ts", "2 hours")
    return events(spark, sf).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", micros(F.col("w.start")).alias("started"), "n")


@query("""WITH p AS (SELECT page_id, url, split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1) AS platform, regexp_extract(url, '://([^/?#]*)', 1) AS company, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS title FROM pages)
SELECT company AS "Company", title AS "Title", CASE WHEN page_id % 3 = 0 THEN url || '#apply' ELSE url END AS "Link", '' AS "Location", upper(substr(platform, 1, 1)) || lower(substr(platform, 2)) AS "Platform" FROM p""")
def csv_export_projection(spark, sf):
    url, none = F.col("url"), F.lit(None).cast("string")
    return exports.export_rows(read(spark, sf, "pages").select(
        V.url_part(url, 2).alias("company"), V.url_part(url, 3).alias("title"), F.when(F.col("page_id") % 3 == 0, F.concat(url, F.lit("#apply"))).alias("apply_url"), url.alias("canonical_url"),
        none.alias("location_text"), F.substring_index(V.url_part(url, 2), ".", 1).alias("source")))


@query(f"""WITH {_BATCH} SELECT group_id, count(*) AS members, bool_and(stale IS NULL AND NOT historical AND NOT delivered) AS release_ready,
 array_to_string(list_sort(list_distinct(list(coalesce(stale, CASE WHEN historical THEN 'historical' WHEN delivered THEN 'delivered' ELSE 'ready' END)))), ',') AS warnings FROM z GROUP BY 1""")
def review_readiness(spark, sf):
    c = candidates(spark, sf).withColumn("stale", V.freshness(F.col("posted_at"), now(), F.lit(72), F.lit("review")))
    said = F.coalesce("stale", F.when(F.col("historical"), "historical").when(F.col("delivered"), "delivered").otherwise("ready"))
    ready = F.col("stale").isNull() & ~F.col("historical") & ~F.col("delivered")
    return c.groupBy("group_id").agg(F.count("*").alias("members"), F.bool_and(ready).alias("release_ready"), F.array_join(F.array_sort(F.collect_set(said)), ",").alias("warnings"))


@query("""
WITH y AS (SELECT o_custkey, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0)) AS a, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 2 = 1)) AS b FROM orders GROUP BY 1)
SELECT o_custkey, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS removed, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS added, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS common FROM y""")
def id_drift_sets(spark, sf):
    odd = F.col("o_orderkey") % 2 == 1
    y = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(~odd, F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(odd, F.col("o_orderpriority"))).alias("b"))
    size = lambda c: F.size(c).cast("long")
    return y.select("o_custkey", size(F.array_except("a", "b")).alias("removed"), size(F.array_except("b", "a")).alias("added"), size(F.array_intersect("a", "b")).alias("common"))


@query("""
WITH n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nxt, first_value(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS f FROM nation)
SELECT n_regionkey, max(CASE WHEN nxt IS NULL THEN f + 25 - n_nationkey ELSE nxt - n_nationkey END) AS max_gap, count(*) AS visits FROM n GROUP BY 1""")
def coverage_proof_gaps(spark, sf):
    own = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = read(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.lead("n_nationkey").over(own).alias("nxt"), F.first("n_nationkey").over(own).alias("f"))
    gap = F.coalesce(F.col("nxt") - F.col("n_nationkey"), F.col("f") + 25 - F.col("n_nationkey"))
    return n.groupBy("n_regionkey").agg(F.max(gap).alias("max_gap"), F.count("*").alias("visits"))


@query(f"""
WITH s AS (SELECT c_custkey, max(o_orderdate) AS checked FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
q AS (SELECT c_custkey, CASE WHEN checked IS NULL THEN 1 WHEN checked < TIMESTAMP '1996-01-01' THEN 0 ELSE 2 END AS lane, checked FROM s)
SELECT c_custkey, lane, k FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY checked NULLS FIRST, {_DIGEST.format('c_custkey')}) AS k FROM q) WHERE k <= CASE lane WHEN 0 THEN 40 ELSE 20 END""")
def health_queue(spark, sf):
    last = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("timestamp").alias("checked"))
    q = read(spark, sf, "customer").join(last, "c_custkey", "left")
    q = q.withColumn("lane", F.when(F.col("checked").isNull(), 1).when(F.col("checked") < F.lit("1996-01-01").cast("timestamp"), 0).otherwise(2))
    ranked = schedule.oldest_due(q, "lane", "c_custkey", F.col("checked"), 40)
    return ranked.where((F.col("lane") == 0) | (F.col("due_rank") <= 20)).select("c_custkey", "lane", F.col("due_rank").alias("k"))
