"""Registered audits, ladders and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gleaner.functions import places, values as V
from gleaner.operators import evidence, read_api, schedule, state
from gleaner.plans.catalogue import _AT, _DIGEST, _JOBS, events, matches, micros, now, query, read
from gleaner.sources import replay


@query("SELECT l_orderkey, l_linenumber, nullif(concat_ws(', ', CASE WHEN l_partkey % 50 <> l_suppkey % 50 THEN 'part differs' END, CASE WHEN l_returnflag <> 'N' THEN 'flag differs' END), '') AS reason FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag) = 1")
def detail_identity_conflicts(spark, sf):
    l = read(spark, sf, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber"))  # noqa: E741
    one = state.latest(l, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")])
    detail, index = one.select("k", (F.col("l_partkey") % 50).alias("part"), F.col("l_returnflag").alias("flag")), one.select("k", (F.col("l_suppkey") % 50).alias("part"), F.lit("N").alias("flag"))
    return replay.detail_conflicts(detail, index, "k", ["part", "flag"]).select("k.*", "reason")


@query("""SELECT d.doc_id, coalesce(l.quality, CAST(d.n_chars % 2 AS INT)) AS quality, coalesce(CAST(l.toxic AS VARCHAR), d.lang) AS tone, d.source AS place FROM documents d LEFT JOIN labels l USING (doc_id)""")
def nested_detail_merge(spark, sf):
    index = read(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.struct(F.col("lang").alias("tone"), F.col("source").alias("place")).alias("facts"))
    detail = read(spark, sf, "labels").select("doc_id", "quality", F.struct(F.col("toxic").cast("string").alias("tone"), F.lit(None).cast("string").alias("place")).alias("facts"))
    return replay.merged(detail, index, "doc_id", ["quality"], {"facts": ["tone", "place"]}).select("doc_id", "quality", "facts.*")


@query(f"""
WITH i AS (SELECT event_id, event_type AS board, CASE WHEN event_id % 3 <> 0 THEN ts END AS posted_at, CAST(floor((epoch_us({_AT}) - epoch_us(ts)) / 8.64e10) AS INT) AS age FROM events),
m AS (SELECT *, event_id IN (SELECT o_orderkey FROM orders) AS known FROM i WHERE coalesce(age, 0) < 4),
k AS (SELECT *, row_number() OVER (PARTITION BY board, posted_at IS NULL ORDER BY event_id) AS turn FROM m WHERE NOT known OR (posted_at IS NOT NULL AND (epoch_us({_AT}) - epoch_us(posted_at)) / 3.6e9 <= 26))
SELECT event_id FROM k WHERE posted_at IS NOT NULL OR turn <= 200""")
def hydration_list(spark, sf):
    age = F.floor((F.unix_micros(now()) - F.unix_micros("ts")) / 8.64e10).cast("int")
    index = events(spark, sf).select("event_id", F.col("event_type").alias("board"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("posted_at"), now().alias("evaluated_at"), age.alias("age_days"))
    known = read(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"))
    return replay.hydration_list(index, known, "event_id", 200, [F.col("event_id")]).select("event_id")


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN 'unsupported_source' ELSE 'malformed_url' END AS class FROM pages) GROUP BY 1")
def crawl_index_targets(spark, sf):
    lines = read(spark, sf, "pages").select(F.to_json(F.struct("url", F.lit("20240131").alias("timestamp"), F.lit("200").alias("status"))).alias("value"))
    return replay.cdx_rows(lines.union(spark.createDataFrame([("<html>no page</html>",)], "value string"))).groupBy(F.col("target.class").alias("class")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT c_custkey, c_nationkey + 9 AS pages, ('0x' || substr(sha256(c_name), 1, 12))::BIGINT AS a, ('0x' || substr(sha256('stride:' || c_name), 1, 12))::BIGINT AS b FROM customer),
t AS (SELECT *, unnest(range(0, 64)) AS i FROM d)
SELECT c_custkey, any_value(a % pages) AS start, min_by((b % pages + i) % pages + 1, i) FILTER (WHERE gcd((b % pages + i) % pages + 1, pages) = 1) AS stride FROM t GROUP BY 1""")
def crawl_cursor(spark, sf):
    """Where each customer's cursor over a board of 9 pages or more begins, and its stride; the SQL tries strides one by one."""
    name, pages = F.col("c_name"), (F.col("c_nationkey") + 9).cast("long")
    return read(spark, sf, "customer").select("c_custkey", replay.start_page(name, pages).alias("start"), replay.page_stride(name, pages).alias("stride"))


@query("SELECT o_orderkey, lower(o_orderstatus) AS value, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'note' ELSE 'url' END AS kind FROM orders")
def blacklist_kinds(spark, sf):
    sheet = read(spark, sf, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("status"), F.replace(F.lower("o_orderpriority"), F.lit("urgent"), F.lit("bid")).alias("p"))
    kinds = replay.blacklist(sheet.select(F.col("p").alias("value")).distinct())
    return sheet.join(F.broadcast(kinds), F.trim("p") == F.col("value")).select("o_orderkey", F.col("status").alias("value"), "kind")


@query("SELECT source, listing, described, hydrated FROM (VALUES ('greenhouse', 'full_list', true, false), ('ashby', 'full_list', true, false), ('lever', 'paged_list', true, false), ('smartrecruiters', 'list_and_detail', false, true), ('workday', 'list_and_detail', false, true)) AS r(source, listing, described, hydrated)")
def provider_registry(spark, sf):
    return replay.providers(spark)


@query("""
WITH r AS (SELECT event_type AS source, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events),
t AS (SELECT source, user_id, count(*) AS n FROM r WHERE value > 30 GROUP BY 1, 2)
SELECT source, user_id, n FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, user_id) <= 25""")
def top_targets_by_candidates(spark, sf):
    t = events(spark, sf).where("value > 30").groupBy(F.col("event_type").alias("source"), "user_id").agg(F.count("*").alias("n"))
    return state.latest(t, ["source"], [F.desc("n"), F.col("user_id")], 25)


@query(f"""WITH {_JOBS} SELECT CASE WHEN decision <> 'reject' THEN 'matched' WHEN NOT role THEN 'title' ELSE 'rules' END AS outcome, count(*) AS n, count(DISTINCT r.job_id) AS jobs FROM r JOIN m ON m.id = r.job_id AND m.client_id = r.client_id GROUP BY 1""")
def rejection_prefixes(spark, sf):
    """Why pairs were rejected, by how the first reason begins."""
    first = F.get("rejection_reasons", F.lit(0))
    outcome = F.when(F.col("decision") != "reject", "matched").when(F.startswith(first, F.lit("title does not match")), "title").otherwise("rules")
    return matches(spark, sf).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"))


@query("SELECT s_suppkey FROM supplier WHERE (s_nationkey = 3 AND s_suppkey % 5 = 0) OR (s_nationkey = 7 AND s_suppkey % 5 = 1) OR (s_nationkey = 11 AND s_suppkey % 5 = 2)")
def pairs_predicate(spark, sf):
    pairs = spark.createDataFrame([(3, 0), (7, 1), (11, 2)], "s_nationkey int, m int")
    s = read(spark, sf, "supplier").withColumn("m", F.col("s_suppkey") % 5)
    return s.join(F.broadcast(pairs), ["s_nationkey", "m"], "left_semi").select("s_suppkey")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_due_unresolved(spark, sf):
    o = read(spark, sf, "orders").where("o_orderstatus != 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
    return state.latest(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT (SELECT count(*) FROM events WHERE starts_with(props, '{\"k\": 1')) AS prefixed, count(*) AS n FROM events")
def prefix_predicate(spark, sf):
    return events(spark, sf).agg(F.count_if(F.startswith("props", F.lit('{"k": 1'))).alias("prefixed"), F.count("*").alias("n"))


@query("""
WITH i AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), u AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN i.k IS NOT NULL THEN 'identity' WHEN u.k IS NOT NULL THEN 'url' WHEN o_orderstatus = 'F' THEN 'delivered' WHEN n > 1 THEN 'duplicate' ELSE 'fresh' END AS outcome
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) o LEFT JOIN i ON i.k = o_orderkey LEFT JOIN u ON u.k = o_orderkey) GROUP BY 1""")
def delivery_projection(spark, sf):
    back = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("identity").alias("i")).distinct()
    o = read(spark, sf, "orders").join(back, "o_orderkey", "left")
    o = o.withColumns({"history": F.coalesce("i", F.when(F.col("o_orderpriority") == "1-URGENT", "url")), "delivered": F.col("o_orderstatus") == "F"})
    return evidence.projected(o, "o_custkey", ["o_orderkey"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""
SELECT c_nationkey, count(*) AS targets, count(*) FILTER (WHERE c_acctbal > 0) AS active, round_even(avg(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END), 6) AS share, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1""")
def capacity_totals(spark, sf):
    good = F.col("c_acctbal") > 0
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("targets"), F.count_if(good).alias("active"), F.bround(F.avg(good.cast("int")), 6).alias("share"), F.count_distinct("c_mktsegment").alias("segments"))


@query("SELECT c_custkey, rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, c_nationkey FROM customer) WHERE rank <= 50 OR c_nationkey = 7")
def cohort_selection(spark, sf):
    """The first 50 of all, and all of one region with their rank."""
    from gleaner.operators.batch import numbered

    ranked = numbered(read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), [-F.col("c_acctbal"), F.col("c_custkey")], "rank")
    return ranked.where("rank <= 50 OR c_nationkey = 7").select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE regexp_full_match(url, 'https?://[^/?#]+(/[^?#]*)?([?][^#]*)?(#.*)?')) AS valid, count(*) FILTER (WHERE contains(url, '?')) AS with_query, count(DISTINCT url) AS urls, count(DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1))) AS hosts FROM pages""")
def url_validity(spark, sf):
    url = F.col("url")
    return read(spark, sf, "pages").agg(
        F.count("*").alias("n"), F.count_if(url.rlike(r"^https?://[^/?#]+(/[^?#]*)?([?][^#]*)?(#.*)?$")).alias("valid"), F.count_if(F.contains(url, F.lit("?"))).alias("with_query"),
        F.count_distinct("url").alias("urls"), F.count_distinct(F.lower(V.url_part(url, 2))).alias("hosts"))


@query("""
WITH f AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS again FROM orders GROUP BY 1)
SELECT count(*) AS targets, sum(n)::BIGINT AS first_pass, sum(again)::BIGINT AS second_pass, count(*) FILTER (WHERE again > 0) AS not_idle FROM f""")
def two_pass_totals(spark, sf):
    first = read(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    totals = evidence.two_passes(first, first.where("o_orderstatus = 'F'"), "o_custkey")
    return totals.where("o_custkey IS NULL").drop("o_custkey")


@query("""
SELECT c_custkey, CASE WHEN s.n IS NULL THEN 'not_started' WHEN s.open > 0 THEN 'running' ELSE 'done' END AS disposition FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey""")
def hand_off(spark, sf):
    runs = read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return evidence.hand_off(read(spark, sf, "customer"), runs, "c_custkey", F.col("o_orderstatus") == "O")


@query("""
WITH e AS (SELECT l_orderkey, count(*) AS declared, count(DISTINCT l_linenumber) AS there, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, there = declared AND lo = 1 AND hi = declared AS complete, declared - there AS repeated FROM e""")
def complete_sets(spark, sf):
    """Whether a set's parts are exactly those from 1 to their number."""
    return evidence.complete_sets(read(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "complete", "repeated")


@query("SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def retained_identities(spark, sf):
    """Identities in nested lists, exploded and distinct."""
    lists = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("ids"))
    return evidence.exploded_identities(read(spark, sf, "orders").join(lists, "o_orderkey"), F.col("o_orderstatus") == "P", "ids", "o_custkey", "l_partkey")


@query("SELECT o_custkey, count(*) = 1 AS bound, min(o_orderkey) AS brief FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def exactly_one_binding(spark, sf):
    o = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "brief")
    return evidence.exactly_one(o, "o_custkey", "brief")


@query(f"""
WITH s AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS delivered, min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS pending FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(delivered, 0) AS delivered, pending, (SELECT count(*) FROM customer) > 100 AS truncated FROM customer LEFT JOIN s ON o_custkey = c_custkey QUALIFY row_number() OVER (ORDER BY {_DIGEST.format('c_custkey')}) <= 100""")
def operator_snapshot(spark, sf):
    """The first 100 profiles with what they got and what is pending, and whether there are more."""
    s = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("delivered"), F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("pending"))
    page = read_api.cursor_page(read(spark, sf, "customer").select("c_custkey"), schedule.by_digest(F.col("c_custkey")), 0, 100)
    return page.join(s, "c_custkey", "left").select("c_custkey", F.coalesce("delivered", F.lit(0)).alias("delivered"), "pending", (F.col("total") > 100).alias("truncated"))


@query("""
SELECT o_orderkey, epoch_us(o_orderdate) AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders""")
def event_history(spark, sf):
    known = evidence.history(read(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return known.select("o_orderkey", micros("o_orderdate").alias("at"), "version", "before")


@query("SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS id FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def idempotency_lookup(spark, sf):
    return read(spark, sf, "orders").where("o_custkey = 7 AND o_orderstatus = 'F'").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("id"))


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 'Germany' WHEN 'fr' THEN 'France' WHEN 'es' THEN 'Spain' END AS country FROM documents")
def structured_country_names(spark, sf):
    """Languages of all documents as what a country field says."""
    return read(spark, sf, "documents").select("doc_id", F.get(places.structured_countries(F.col("lang")), F.lit(0)).alias("country"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'United States' END AS country, lang = 'en' OR lang IS NULL AS valid FROM documents")
def chosen_countries(spark, sf):
    said = places.chosen_country(F.replace("lang", F.lit("en"), F.lit(" U.S.A. ")))
    return read(spark, sf, "documents").select("doc_id", said["country"].alias("country"), said["valid"].alias("valid"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 = 0 THEN 'http_' || l_suppkey ELSE 'read_timed_out' END AS class, CAST(l_partkey AS VARCHAR) AS id FROM lineitem")
def failure_classes(spark, sf):
    error = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("GET failed: HTTP "), F.col("l_suppkey").cast("string"))).otherwise("GET failed: Read timed out ")
    path = F.concat(F.lit("/job/Paris/Data_Engineer_"), F.col("l_partkey").cast("string"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.failure_class(error).alias("class"), V.id_of_path(path).alias("id"))


@query("""SELECT o_orderpriority, outcome, count(*) AS n FROM (SELECT o_orderpriority, CASE o_orderkey % 5 WHEN 0 THEN 'request_timeout' WHEN 1 THEN 'http_failure' WHEN 2 THEN 'connection_failure' ELSE CASE WHEN o_custkey % 7 = 0 THEN 'empty_valid_board' ELSE o_orderstatus END END AS outcome FROM orders) GROUP BY 1, 2""")
def site_outcomes(spark, sf):
    failure = F.element_at(F.array(*map(F.lit, ["ReadTimeout", "HTTP 503", "ConnectError", None, None])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    outcome = V.site_outcome(failure, F.col("o_custkey") % 7, F.col("o_orderstatus"))
    return read(spark, sf, "orders").groupBy("o_orderpriority", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT event_type AS board, count(*) AS postings, count(*) FILTER (WHERE value > 20) AS matched, count(DISTINCT user_id) FILTER (WHERE value > 20) AS employers, count(*) FILTER (WHERE value > 20 AND user_id % 10 = 0) AS suppressed FROM events GROUP BY 1)
SELECT board, postings, matched, employers, suppressed, matched - suppressed AS delivered FROM m""")
def board_metrics(spark, sf):
    good, held = F.col("value") > 20, F.col("user_id") % 10 == 0
    m = events(spark, sf).groupBy(F.col("event_type").alias("board")).agg(
        F.count("*").alias("postings"), F.count_if(good).alias("matched"), F.count_distinct(F.when(good, F.col("user_id"))).alias("employers"), F.count_if(good & held).alias("suppressed"))
    return m.withColumn("delivered", F.col("matched") - F.col("suppressed"))


@query("""
SELECT o_custkey, count(*) AS items, count(*) = max(rn) AS whole, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS frozen FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def frozen_batches(spark, sf):
    """The frozen items of each batch by ordinal, and whether none is missing."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf, "orders").where("o_orderstatus = 'F'").withColumn("rn", F.row_number().over(own))
    return evidence.frozen(o, "o_custkey", "rn", "o_orderkey")


@query("""SELECT u.s_suppkey IS NULL AS only_health, h.l_suppkey IS NULL AS only_universe, count(*) AS n FROM (SELECT DISTINCT s_suppkey FROM supplier) u FULL JOIN (SELECT DISTINCT l_suppkey FROM lineitem) h ON h.l_suppkey = u.s_suppkey GROUP BY 1, 2""")
def universe_against_health(spark, sf):
    """Whether two sets of targets are the same: what only one of them has."""
    h = read(spark, sf, "lineitem").select("l_suppkey").distinct()
    met = read(spark, sf, "supplier").select("s_suppkey").distinct().join(h, F.col("s_suppkey") == F.col("l_suppkey"), "full")
    return met.groupBy(F.col("s_suppkey").isNull().alias("only_health"), F.col("l_suppkey").isNull().alias("only_universe")).agg(F.count("*").alias("n"))
