"""Queries of index joins, incremental groups, interval joins, snapshots and reconciliations, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import Window, functions as F

from gleaner.functions import text as T
from gleaner.operators import batch, coverage, destinations, evidence, grouping, matching, reconcile, release, reports, schedule, snapshots, temporal, universe
from gleaner.plans.catalogue import _BATCH, _JOBS, _batch, _jobs, events, matches, now, query, read
from gleaner.plans.shared import scratch
from gleaner.sources import boards, journal
from gleaner.streaming import outcomes


# -- briefs that meet postings by an index --------------------------------------------------------------------------------

_BRIEFS = """w AS (SELECT p_partkey, p_brand, p_size, lower(p_name || ' ' || p_brand) AS t, CASE WHEN p_partkey % 7 <> 6 THEN lower(p_type) END AS d FROM part),
q AS (SELECT 'k' || c_custkey AS client_id, lower(p_name || ' ' || p_brand) AS role, lower(p_brand) || '1' AS other, CASE WHEN c_custkey % 3 = 0 THEN lower(p_type) END AS avoid,
 CASE WHEN c_custkey % 3 = 1 THEN 'promo' ELSE 'economy' END AS liked FROM customer JOIN part ON p_partkey = c_custkey)"""


def part_postings(spark, sf):
    """Parts as postings titled by name and brand; every seventh has no description, and those of a tenth of the sizes are closed."""
    none = lambda kind: F.lit(None).cast(kind)
    return read(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.lit("parts").alias("source"), F.col("p_brand").alias("source_board_id"), F.col("p_partkey").cast("string").alias("source_job_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.when(F.col("p_partkey") % 7 != 6, F.lower("p_type")).alias("description_text"), none("string").alias("country"),
        none("array<string>").alias("eligible_countries"), none("string").alias("remote_status"), none("string").alias("employment_type"), F.when(F.col("p_size") % 10 == 0, "closed").otherwise("seen").alias("lifecycle"),
    )


def customer_briefs(spark, sf):
    """Each customer looks for name and brand of the part of its number, and excludes brands that go on with a 1."""
    known, k = read(spark, sf, "customer").join(read(spark, sf, "part"), F.col("p_partkey") == F.col("c_custkey")), F.col("c_custkey") % 3
    none = F.array().cast("array<string>")
    profiles = known.select(
        F.concat(F.lit("k"), "c_custkey").alias("client_id"), F.array(F.concat_ws(" ", "p_name", "p_brand")).alias("roles"), none.alias("countries"), F.lit(False).alias("remote_only"),
        F.when(k == 0, F.array(F.lower("p_type"))).otherwise(none).alias("excluded_terms"), F.lit(None).cast("int").alias("max_years"),
        F.array(F.when(k == 1, "promo").otherwise("economy")).alias("preferred_terms"), F.array(F.concat("p_brand", F.lit("1"))).alias("excluded_titles"),
    )
    briefs = matching.brief_of_profile(profiles).drop("preferred_terms", "excluded_titles")
    return briefs.join(profiles.select("client_id", "preferred_terms", "excluded_titles"), "client_id")


@query(f"""WITH {_BRIEFS} SELECT CAST(p_partkey AS VARCHAR) AS job_id, client_id, CASE WHEN contains(t, other) OR contains(body, ' ' || avoid || ' ') THEN 'reject' WHEN contains(body, ' ' || liked || ' ') THEN 'strong_match' ELSE 'possible_match' END AS decision
FROM (SELECT *, ' ' || regexp_replace(t || ' ' || coalesce(d, ''), '[^a-z0-9_]+', ' ', 'g') || ' ' AS body FROM w) JOIN q ON contains(t, role)""")
def brief_index_join(spark, sf):
    """A brief for every customer against every part, pairs only where a role occurs."""
    return matching.match(part_postings(spark, sf), customer_briefs(spark, sf), every_pair=False).select("job_id", "client_id", "decision")


@query(f"""WITH {_BRIEFS}, t AS (SELECT DISTINCT p_brand, CAST(p_partkey AS VARCHAR) AS id FROM w JOIN q ON contains(t, role) AND NOT contains(t, other) WHERE p_size % 10 <> 0)
SELECT p_brand AS board_id, string_agg(id, ',' ORDER BY id) AS job_ids, count(*) AS n FROM t GROUP BY 1""")
def retained_bindings(spark, sf):
    """Parts that some customer's brief could take and doesn't exclude, by brand."""
    bound = matching.bindings(part_postings(spark, sf), customer_briefs(spark, sf), "parts")
    return bound.select("board_id", F.array_join("source_job_ids", ",").alias("job_ids"), F.size("source_job_ids").cast("long").alias("n"))


# -- labelled evidence ----------------------------------------------------------------------------------------------------

_SAID = ["At least {} years of experience.", "About {} years of experience", "{} years are preferred", "We were founded {} years ago.", "{} years", "{}+ years\n- {} or more years in sales"]
_KINDS = "CASE l_linenumber % 6 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'preferred' WHEN 5 THEN 'mandatory' END"


@query(f"""SELECT l_orderkey, l_linenumber, {_KINDS} AS kind, CAST(l_quantity AS INT) AS minimum_years, CASE l_linenumber % 6 WHEN 0 THEN 'At least ' || n || ' years of experience.' WHEN 1 THEN 'About ' || n || ' years of experience'
 WHEN 2 THEN n || ' years are preferred' ELSE CASE i WHEN 1 THEN n || '+ years' ELSE n || ' or more years in sales' END END AS source_text
FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS n FROM lineitem), (SELECT unnest([1, 2]) AS i) WHERE l_quantity < 100 AND {_KINDS} IS NOT NULL AND (i = 1 OR l_linenumber % 6 = 5)""")
def experience_evidence(spark, sf):
    """Labelled numbers of years of postings made of lines, which say them in six ways."""
    rows = read(spark, sf, "lineitem").where("l_quantity < 100")
    n = F.col("l_quantity").cast("int").cast("string")
    said = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{}"), n) for x in _SAID]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", F.explode(T.experience_evidence(said)).alias("e")).select("l_orderkey", "l_linenumber", "e.kind", "e.minimum_years", "e.source_text")


# -- groups that go on from batch to batch ------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_custkey IS NOT NULL), a AS (SELECT xor(c, 1) AS c, min(k) AS first FROM o WHERE k % 10 = 0 GROUP BY 1),
j AS (SELECT DISTINCT o.c - o.c % 2 AS pair FROM o JOIN a ON o.c = a.c WHERE o.k % 10 <> 0 OR o.k > a.first),
g AS (SELECT k, CASE WHEN pair IS NULL THEN c ELSE pair END AS g FROM o LEFT JOIN j ON pair = c - c % 2)
SELECT k AS o_orderkey, min(lpad(CAST(k AS VARCHAR), 12, '0')) OVER (PARTITION BY g, c_or_pair) AS group_id FROM (SELECT k, g, CASE WHEN pair_joined THEN 'p' ELSE 'c' END AS c_or_pair FROM (SELECT g.k, g.g, j.pair IS NOT NULL AS pair_joined FROM g LEFT JOIN o ON o.k = g.k LEFT JOIN j ON j.pair = o.c - o.c % 2))""")
def incremental_groups(spark, sf):
    """Orders in three batches: even and odd ones with their customer as key, then every tenth again with the neighbouring customer."""
    orders = read(spark, sf, "orders").where("o_custkey IS NOT NULL")
    name = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    members, keys = spark.createDataFrame([], "id string, group_id string"), spark.createDataFrame([], "id string, kind string, value string")
    for some, key in (("o_orderkey % 2 = 0", F.col("o_custkey")), ("o_orderkey % 2 = 1", F.col("o_custkey")), ("o_orderkey % 10 = 0", F.col("o_custkey").bitwiseXOR(F.lit(1)))):
        batch = orders.where(some).select(name.alias("id"), F.col("o_orderkey").alias("position"), name.alias("own_group"), F.array(F.struct(F.lit("customer").alias("kind"), key.cast("string").alias("value"))).alias("keys"))
        members, keys, _ = grouping.assigned(batch, members, keys)
    return members.select(F.col("id").cast("long").alias("o_orderkey"), "group_id")


# -- as-of and interval joins, sliding lookback ---------------------------------------------------------------------------------


@query("""WITH u AS (SELECT o_custkey AS c, o_orderdate AS d, max(o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT o_orderkey, k AS urgent_before, CAST(date_diff('day', d, o_orderdate) AS BIGINT) AS days FROM orders ASOF LEFT JOIN u ON o_custkey = c AND o_orderdate > d""")
def asof_urgent_order(spark, sf):
    """Each order with its customer's latest urgent order before it."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    found = temporal.asof_join(orders, orders.where("o_orderpriority = '1-URGENT'"), ["o_custkey"], "o_orderdate", "o_orderdate", ["o_orderkey"])
    return found.select("o_orderkey", F.col("match.o_orderkey").alias("urgent_before"), F.date_diff(F.col("o_orderdate").cast("date"), F.col("match.o_orderdate").cast("date")).cast("long").alias("days"))


_ZONES = ["UTC", "America/New_York", "Asia/Kolkata", "Asia/Tokyo"]
_OFFSET = "to_minutes(CASE user_id % 4 WHEN 1 THEN -300 WHEN 2 THEN 330 WHEN 3 THEN 540 ELSE 0 END)"


@query(f"""WITH s AS (SELECT event_id, user_id, date_trunc('day', ts + {_OFFSET}) - {_OFFSET} AS a FROM events WHERE event_type = 'signup')
SELECT s.event_id, count(e.event_id) AS same_day FROM s JOIN events e ON e.user_id = s.user_id AND e.ts >= a AND e.ts < a + INTERVAL 1 DAY GROUP BY 1""")
def local_day_events(spark, sf):
    """Events of the user on the calendar day, in the user's zone, of each signup; every signup is one of them."""
    e = events(spark, sf)
    start, stop = temporal.local_day(F.col("ts"), F.element_at(F.array(*map(F.lit, _ZONES)), (F.col("user_id") % 4 + 1).cast("int")))
    days = e.where("event_type = 'signup'").select("event_id", "user_id", start.alias("start"), stop.alias("stop"))
    found = temporal.interval_join(e.select("user_id", "ts"), days, ["user_id"], "ts", "start", "stop")
    return found.groupBy(F.col("interval.event_id").alias("event_id")).agg(F.count("*").alias("same_day"))


@query("""SELECT e.event_id, count(DISTINCT s.user_id) AS active FROM events e JOIN events s ON s.event_type = e.event_type AND s.ts BETWEEN e.ts - INTERVAL 72 HOURS AND e.ts GROUP BY 1""")
def lookback_at_every_event(spark, sf):
    """Distinct users of an event type within the 72 hours before each of its events."""
    e = events(spark, sf).select("event_id", "event_type", "user_id", "ts")
    return temporal.active_at(e, temporal.active_counts(e, ["event_type"], "user_id", "ts", 72), ["event_type"], "ts").select("event_id", "active")


# -- frozen orders and logs -------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders)
SELECT position, o_orderkey, o_custkey FROM r WHERE position % (n // 4) < 25""")
def snapshot_pages(spark, sf):
    """Pages of 25 orders, dearest first, at every quarter of a frozen order."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    now = datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC)
    snap = snapshots.create(orders, ["-o_totalprice", "o_orderkey"], scratch(spark, "snapshots"), "catalogue", now)
    step, pages = snap.total // 4, None
    for position in range(0, snap.total, step):
        found, _ = snapshots.page(spark, snap, position, 25)
        pages = found if pages is None else pages.union(found)
    return pages.select("position", "o_orderkey", "o_custkey")


@query("""WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT CAST(event_id AS VARCHAR) || suffix AS request_id, CAST(user_id AS VARCHAR) AS client_id,
 CASE WHEN event_id % 11 = 0 THEN 'stale' WHEN suffix = '' THEN 'accepted' ELSE 'replayed' END AS status, v AS version
FROM (SELECT *, n - count(*) FILTER (WHERE event_id % 11 = 0) OVER (PARTITION BY user_id, event_type ORDER BY n) AS v FROM e), (SELECT unnest(['', 'again']) AS suffix)
WHERE event_id % 11 <> 0 OR suffix = ''""")
def outcome_answers(spark, sf):
    """Events as outcomes of their user, each sent twice; those of every eleventh number expect a version that never was, and are sent once."""
    turn = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = events(spark, sf).withColumn("n", F.row_number().over(turn) - F.count_if(F.col("event_id") % 11 == 0).over(turn))
    odd, none = F.col("event_id") % 11 == 0, F.lit(None).cast("string")
    name = F.col("event_id").cast("string")
    commands = e.select(
        name.alias("request_id"), F.col("ts").alias("at"), F.col("user_id").cast("string").alias("client_id"), F.lit("posting").alias("subject_type"), F.col("event_type").alias("subject_id"),
        F.lit("person").alias("actor_type"), F.lit("a").alias("actor_id"), name.alias("idempotency_key"), F.lit("seen").alias("value"),
        F.when(odd, -1).otherwise(F.col("n") - 1).cast("long").alias("expected_version"), none.alias("source_reference"), F.lit(True).alias("surfaced"),
    )
    again = commands.where("expected_version >= 0").withColumn("request_id", F.concat("request_id", F.lit("again"))).withColumn("at", F.col("at") + F.expr("INTERVAL 1 HOUR"))
    return outcomes.answered(commands.union(again)).select("request_id", "client_id", "status", "version")


# -- reconciliation, suppression, fan-in, coverage ------------------------------------------------------------------------------


@query("""WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT -o_orderkey - 1, 'N' FROM orders WHERE o_orderkey % 101 = 0)
SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NULL THEN 'first_only' WHEN o_orderkey IS NULL THEN 'second_only' ELSE 'changed' END AS status
FROM orders FULL JOIN b ON o_orderkey = k WHERE o_orderstatus IS DISTINCT FROM s""")
def digest_tree_differences(spark, sf):
    """Orders against a copy of which some were removed, changed or added."""
    orders, k = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey")
    copy = orders.where(k % 97 != 0).withColumn("o_orderstatus", F.when(k % 89 == 0, "X").otherwise(F.col("o_orderstatus")))
    copy = copy.union(orders.where(k % 101 == 0).select(-k - 1, F.lit("N")))
    return reconcile.differences(orders, copy, ["o_orderkey"], ["o_orderstatus"])


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_returnflag = 'R' OR l_linenumber >= 6))""")
def suppressed_by_digest(spark, sf):
    """Orders of which a ledger has neither the identity (returned lines) nor the URL (orders of six lines or more)."""
    ident = lambda c: (F.lit("shop").alias("source"), F.lit("orders").alias("source_board_id"), F.col(c).cast("string").alias("source_job_id"), F.concat(F.lit("https://shop.example/"), F.col(c).cast("string")).alias("canonical_url"))
    lines = read(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", *ident("l_orderkey"))
    identities = lines.where("l_returnflag = 'R'").select(reconcile.identity_digest()).distinct()
    urls = lines.where("l_linenumber >= 6").select(reconcile.url_digest()).distinct()
    return reconcile.not_surfaced(read(spark, sf, "orders").select("o_orderkey", *ident("o_orderkey")), identities, urls).select("o_orderkey")


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS id, o_orderdate < TIMESTAMP '1998-08-02' AS old FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT CASE WHEN old THEN 'ledger' ELSE 'posting' END AS tab, CAST(id AS VARCHAR) AS id, '' AS target FROM p
UNION ALL SELECT DISTINCT 'membership', CAST(id AS VARCHAR), 'line ' || l_linenumber FROM p JOIN lineitem ON l_orderkey = id WHERE NOT old""")
def fan_in_commit(spark, sf):
    """Orders brought by one shard for each number of a line, persisted in one commit, as the journal holds them."""
    key = F.col("l_orderkey").cast("string")
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_linenumber").alias("shard"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("target_identity"), key.alias("id"), F.lit("shop").alias("source"),
        F.lit("orders").alias("source_board_id"), key.alias("source_job_id"), key.alias("canonical_url"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderdate").cast("timestamp").alias("posted_at"),
    )
    folder, now = scratch(spark, "fan_in"), datetime.datetime(2001, 8, 1, tzinfo=datetime.UTC)
    reconcile.fan_in(rows, rows.select("shard").distinct(), folder, "first", now, 24 * 1095)
    return journal.read(spark, folder).select(F.col("table").alias("tab"), "id", F.col("target_identity").alias("target"))


@query("""WITH r AS (SELECT c_nationkey AS k, count(*) AS n, 1 + (c_nationkey * 7) % count(*) AS m FROM customer GROUP BY 1), p AS (SELECT *, n // gcd(n, m) AS period FROM r),
s AS (SELECT k, n, m, period, c, (c * m + o) % n AS i FROM p, unnest(range(0, period)) AS x(c), unnest(range(0, m)) AS y(o)),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, i) AS visits, coalesce(lead(c) OVER w, first_value(c) OVER w + period) - c AS gap FROM s WINDOW w AS (PARTITION BY k, i ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT p.k AS nation, any_value(n) AS registry_targets, any_value(m) AS targets_per_cohort, any_value(period) AS selection_period_cohorts, min(visits) AS visits_per_target_min, max(visits) AS visits_per_target_max,
 max(gap) AS max_revisit_gap_cohorts, count(DISTINCT i) = any_value(n) AS all_targets_reached FROM p JOIN g USING (k) GROUP BY 1""")
def coverage_proof(spark, sf):
    """The rotation over each nation's customers, in closed form; the SQL visits every target."""
    n = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("registry_targets"))
    proof = coverage.coverage_proof(n.withColumn("targets_per_cohort", 1 + F.col("nation") * 7 % F.col("registry_targets")))
    return proof.select("nation", "registry_targets", "targets_per_cohort", "selection_period_cohorts", "visits_per_target_min", "visits_per_target_max", "max_revisit_gap_cohorts", "all_targets_reached")


# -- pages of boards, release of batches ----------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT o_custkey AS board, count(*) AS n FROM orders GROUP BY 1)
SELECT board, CAST(ceil(n / 5.0) AS BIGINT) AS pages, n AS received, CASE WHEN n % 5 > 0 THEN 'short_page' WHEN board % 3 = 0 THEN 'repeated_page' ELSE 'pages_missing' END AS ended, CASE WHEN n % 5 > 0 THEN 'success' ELSE 'partial' END AS status FROM c""")
def board_page_loops(spark, sf):
    """Customers as boards of five orders a page; the boards of every third customer begin again after their last page."""
    turn = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    placed = read(spark, sf, "orders").select(F.col("o_custkey").alias("board"), F.floor((F.row_number().over(turn) - 1) / 5).cast("int").alias("page"), F.col("o_orderkey").cast("string").alias("id"))
    pages = placed.groupBy("board", "page").agg(F.collect_list("id").alias("ids"))
    last = pages.groupBy("board").agg((F.max("page") + 1).alias("page"))
    again = pages.where("page = 0 AND board % 3 = 0").select("board", F.reverse("ids").alias("ids")).join(last, "board").select("board", "page", "ids")
    return boards.board_results(pages.unionByName(again), 5).select("board", "pages", F.col("received").cast("long").alias("received"), "ended", "status")


def _review(spark, sf):
    """Orders as items of their customer's batch, with what has happened to them since."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    name, batch = k.cast("string").alias("job_id"), F.col("o_custkey").alias("batch_id")
    items = o.select(batch, F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ordinal"), name, F.lit("e").alias("evidence_sha256"))
    candidates = o.select(
        batch, name, F.when(k % 13 == 0, "other").otherwise("e").alias("evidence_sha256"), F.when(k % 23 == 0, F.lit("shared")).otherwise(k.cast("string")).alias("group_id"),
        F.when(k % 29 != 0, F.col("o_orderdate").cast("timestamp")).alias("posted_at"), F.when(F.col("o_orderpriority") == "5-LOW", "needs_review").otherwise("strong_match").alias("decision"),
        (k % 17 == 0).alias("historical"), (k % 19 == 0).alias("delivered"),
    )
    none = F.lit(None).cast("string")
    policy = [F.lit(24 * 1825).alias("max_hours"), F.when(F.col("batch_id") % 2 == 0, "allow").otherwise("reject").alias("unknown_policy"), (F.col("batch_id") % 3 == 0).alias("include_review"), none.alias("export_before"), none.alias("export_after")]
    batches = o.select(batch).distinct().select("batch_id", F.concat(F.lit("g"), "batch_id").alias("generation_id"), F.when(F.col("batch_id") % 7 == 0, "failed").otherwise("prepared").alias("status"), *policy)
    return items, candidates, batches, F.lit("2001-08-02").cast("timestamp")


_ITEMS = """i AS (SELECT o_custkey AS b, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, o_orderkey % 13 = 0 AS edited, count(*) FILTER (WHERE o_orderkey % 23 = 0) OVER (PARTITION BY o_custkey) AS same,
 CASE WHEN o_orderkey % 29 = 0 THEN CASE WHEN o_custkey % 2 = 1 THEN 'posting_age_unknown' END WHEN o_orderdate < TIMESTAMP '2001-08-02' - INTERVAL 1825 DAY THEN 'stale_posting' END AS stale,
 o_orderpriority = '5-LOW' AS asks, o_orderpriority <> '5-LOW' OR o_custkey % 3 = 0 AS eligible, o_orderkey % 17 = 0 AS historical, o_orderkey % 19 = 0 AS delivered FROM orders)"""


@query(f"""WITH {_ITEMS}, v AS (SELECT *, CASE WHEN k % 23 = 0 AND same > 1 THEN 'groups_merged' WHEN stale IS NOT NULL THEN stale WHEN edited THEN 'evidence_changed' WHEN historical THEN 'historical' WHEN NOT eligible THEN 'decision' WHEN delivered THEN 'delivered' END AS violation FROM i)
SELECT b AS batch_id, ordinal, CAST(k AS VARCHAR) AS job_id, violation FROM v WHERE violation IS NOT NULL""")
def release_violations(spark, sf):
    return release.violations(*_review(spark, sf))


@query(f"""WITH {_ITEMS}, r AS (SELECT *, NOT edited AND stale IS NULL AND NOT historical AND NOT delivered AND eligible AS ready FROM i)
SELECT b AS batch_id, ordinal, NOT edited AS evidence_verified, ready AS release_ready, CAST(edited AS INT) + CAST(stale IS NOT NULL AS INT) + CAST(historical AS INT) + CAST(delivered AS INT) + CAST(asks AS INT) AS warnings,
 bool_and(ready) OVER (PARTITION BY b) AND b % 7 <> 0 AS safe_to_release FROM r""")
def review_projection(spark, sf):
    return release.review(*_review(spark, sf)).select("batch_id", "ordinal", "evidence_verified", "release_ready", F.size("warnings").alias("warnings"), "safe_to_release")


@query("""WITH i AS (SELECT o_custkey AS b, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o, o_orderstatus = 'F' AS gone FROM orders),
q AS (SELECT *, b % 7 <> 0 AND bool_or(gone) OVER (PARTITION BY b) AND NOT bool_and(gone) OVER (PARTITION BY b) AS done FROM i)
SELECT b AS batch_id, CAST(k AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY b ORDER BY k) AS ordinal FROM q WHERE NOT (done AND gone)""")
def batch_removals(spark, sf):
    """Filled orders are removed from their customer's batch, unless the batch failed or nothing would be left."""
    items, _, batches, _ = _review(spark, sf)
    filled = items.join(read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("job_id")), "job_id", "left_semi")
    requests = filled.groupBy("batch_id").agg(F.collect_list("ordinal").alias("ordinals")).select("batch_id", F.concat(F.lit("g"), "batch_id").alias("generation_id"), "ordinals")
    _, _, left = release.remove_items(requests, batches, items)
    return left.select("batch_id", "job_id", "ordinal")


@query("""WITH b AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS d, o_orderstatus AS s, o_orderkey % 5 = 0 AS journaled, o_orderpriority IN ('1-URGENT', '2-HIGH') AS old FROM orders WHERE o_orderstatus <> 'P'),
u AS (SELECT *, s = 'F' AND old AND NOT journaled AS stale FROM b WHERE s = 'O' OR journaled OR old), f AS (SELECT c, min(row(d, id)) AS one FROM u WHERE NOT stale GROUP BY 1)
SELECT id AS batch_id, 'discard' AS action FROM u LEFT JOIN f USING (c) WHERE stale AND (one IS NULL OR row(d, id) < one)
UNION ALL SELECT id, CASE WHEN journaled THEN 'reconcile' ELSE 'release' END FROM u JOIN f USING (c) WHERE row(d, id) = one""")
def batch_recovery(spark, sf):
    """Orders as batches of their customer: open ones are prepared, filled ones failed, and those in between delivered."""
    journaled, none = F.col("o_orderkey") % 5 == 0, F.lit(None).cast("string")
    batches = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("client_id"), F.lit("d").alias("destination"), F.col("o_orderdate").alias("assembled_at"),
        F.when(F.col("o_orderstatus") == "O", "prepared").when(F.col("o_orderstatus") == "F", "failed").otherwise("delivered").alias("status"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "F"), release.NO_LONGER_FRESH + " stale_posting").otherwise("full").alias("error"),
        none.alias("delivered_at"), F.when(journaled, "h").alias("export_before"), none.alias("export_after"),
    )
    gone, following = release.recover(batches)
    return gone.select("batch_id", F.lit("discard").alias("action")).unionByName(following.select("batch_id", "action"))


# -- reports --------------------------------------------------------------------------------------------------------------------

_BAND = "CASE WHEN k % 29 = 0 THEN 'unknown' WHEN k % 11 = 0 THEN 'invalid' WHEN k % 5 < 2 THEN '0_24h' WHEN k % 5 = 2 THEN '24_48h' WHEN k % 5 = 3 THEN '48_72h' ELSE 'over_72h' END"
_COUNTED = ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {n}"
    for n, c in {
        "retained_evaluated": "true", "retained_confirmed_matches": "good", "retained_needs_review_matches": "asks", "retained_rejected": "no", "fresh_0_24h": "f", "confirmed_matches_0_24h": "f AND good", "needs_review_matches_0_24h": "f AND asks",
        "rejected_0_24h": "f AND no", "title_matched_0_24h": "f AND role", "target_market_survived_0_24h": "f AND role AND NOT market", "remote_survived_0_24h": "f AND role AND NOT market AND NOT mode", "other_rules_survived_0_24h": "f AND NOT no",
    }.items()
) + ", " + ", ".join(f"count(*) FILTER (WHERE NOT no AND band = '{b}') AS age_{b}" for b in ("0_24h", "24_48h", "48_72h", "over_72h", "unknown", "invalid"))


@query(f"""WITH {_JOBS}, x AS (SELECT m.client_id, CASE WHEN j.k < 3 THEN 'unknown' ELSE 'board' END AS source, {_BAND.replace('k %', 'CAST(m.id AS BIGINT) %')} AS band, r.decision IN ('strong_match', 'possible_match') AS good,
 r.decision = 'needs_review' AS asks, r.decision = 'reject' AS no, role, m.client_id IN ('c1', 'c5') AND rejected AS market, m.client_id = 'c3' AND rejected AS mode FROM m JOIN r ON r.job_id = m.id AND r.client_id = m.client_id JOIN j ON j.id = m.id),
y AS (SELECT *, band = '0_24h' AS f FROM x) SELECT source, {_COUNTED} FROM y GROUP BY GROUPING SETS ((source), ())""")
def client_funnel(spark, sf):
    """Twelve counters and six ages over all postings and briefs, by source and overall."""
    m, k = matches(spark, sf), F.col("job_id").cast("long")
    hours = F.when(k % 11 == 0, -3).otherwise(F.element_at(F.array(*map(F.lit, [5, 20, 30, 60, 100])), (k % 5 + 1).cast("int")))
    posted = F.when(k % 29 != 0, F.timestamp_micros(F.unix_micros(now()) - hours.cast("long") * F.lit(3_600_000_000)))
    return reports.client_funnel(m.withColumns({"source": F.when(k % 7 >= 3, " Board "), "posted_at": posted}), now())


@query("""WITH r AS (SELECT *, o_orderkey % 3 = 0 AS delivered, CASE WHEN o_orderkey % 17 = 0 THEN 'identity' WHEN o_orderkey % 19 = 0 THEN 'url' END AS history, o_orderpriority IN ('1-URGENT', '2-HIGH') AS good, o_custkey || o_orderstatus AS g FROM orders),
d AS (SELECT *, max(o_orderkey % 50) OVER (PARTITION BY g) % 3 = 0 AS gone FROM r)
SELECT o_custkey AS target_identity, count(*) AS received, count(*) FILTER (WHERE good) AS delivery_eligible_matched, count(*) FILTER (WHERE good AND history = 'identity') AS historical_identity, count(*) FILTER (WHERE good AND history IS NULL) AS nonhistorical_matched,
 count(*) FILTER (WHERE good AND history IS NULL) - count(DISTINCT g) FILTER (WHERE good AND history IS NULL) AS practical_duplicate_groups_collapsed, count(DISTINCT g) FILTER (WHERE good AND history IS NULL AND gone) AS already_delivered_groups,
 count(DISTINCT g) FILTER (WHERE good AND history IS NULL AND NOT gone) AS fresh_unique_deliveries FROM d GROUP BY 1""")
def target_capacity(spark, sf):
    """What each customer's orders come to as postings of a target, grouped by status."""
    k, group = F.col("o_orderkey"), F.concat(F.col("o_custkey").cast("string"), "o_orderstatus")
    o = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("target_identity"), k.cast("string").alias("job_id"), F.lit("new").alias("lifecycle"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "strong_match").otherwise("reject").alias("decision"),
        F.when(k % 17 == 0, "identity").when(k % 19 == 0, "url").alias("history"), group.alias("group_id"), (k % 50).alias("m"),
    )
    gone = o.groupBy("group_id").agg((F.max("m") % 3 == 0).alias("delivered"))
    out = reports.target_capacity(o.join(gone, "group_id"))
    return out.select("target_identity", "received", "delivery_eligible_matched", "historical_identity", "nonhistorical_matched", "practical_duplicate_groups_collapsed", "already_delivered_groups", "fresh_unique_deliveries")


@query("""WITH f AS (SELECT o_custkey AS g, o_orderpriority AS c, min((o_orderdate, CAST(o_orderkey AS VARCHAR))) AS one FROM orders GROUP BY 1, 2)
SELECT g AS group_id, c AS client_id, one[2] AS job_id FROM f WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = g AND o_orderpriority = c AND l_returnflag = 'R')""".replace("one[2]", "struct_extract_at(one, 2)"))
def exported_groups(spark, sf):
    """The first order of each customer and priority is its delivery, unless a returned one was before."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderpriority").alias("client_id"), F.lit("d").alias("destination"), F.col("o_orderdate").alias("exported_at"), F.col("o_custkey").cast("string").alias("group_id"))
    back = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("job_id")).distinct()
    new, _ = reports.mark_exported(o.drop("group_id"), o.select("job_id", "group_id"), o.join(back, "job_id", "left_semi"), o.drop("group_id").limit(0))
    return new.select(F.col("group_id").cast("long").alias("group_id"), "client_id", "job_id")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type AS h, lag(event_type) OVER w AS b, coalesce(max(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT coalesce(b, 'first_check') AS reason, count(*) AS checked, count(*) FILTER (WHERE h = 'purchase' AND b IS DISTINCT FROM 'purchase' AND was = 0) AS newly_admitted, count(*) FILTER (WHERE h = 'purchase' AND b IS DISTINCT FROM 'purchase' AND was = 1) AS reactivated FROM e GROUP BY 1""")
def health_selection_reasons(spark, sf):
    """Events as checks of their user, a purchase being an active target."""
    e = events(spark, sf).select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", "active").otherwise(F.col("event_type")).alias("h"))
    out = reports.health_changes(e, "user_id", "at", "h")
    return out.withColumn("reason", F.when(F.col("reason") == "active", "purchase").otherwise(F.col("reason")))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_id % 3 = 0 AS kept FROM events""")
def payload_refresh(spark, sf):
    """Stored payloads against incoming ones that differ in a volatile key only, or in more."""
    e = events(spark, sf)
    stored = F.concat(F.lit('{"last_seen_at": "x", "p": '), "props", F.lit("}"))
    incoming = F.concat(F.lit('{"p": '), "props", F.when(F.col("event_id") % 3 == 0, "}").otherwise(', "new": true}'))
    kept = reports.refreshed(stored, incoming, ["last_seen_at"])
    return e.select("event_id", F.get_json_object(kept, "$.p.k").alias("k"), F.get_json_object(kept, "$.new").isNull().alias("kept"))


@query(f"""WITH {_JOBS} SELECT job_id, client_id, CASE WHEN decision <> 'reject' AND client_id IN ('c1', 'c4') AND CAST(job_id AS BIGINT) % 3 = 1 THEN 'reject' ELSE decision END AS decision,
 CASE WHEN NOT (client_id IN ('c1', 'c4') AND CAST(job_id AS BIGINT) % 3 = 1) THEN score END AS score FROM r""")
def strict_profiles(spark, sf):
    """Matches of two strict profiles lose the parts whose own location names another country."""
    k = F.col("id").cast("long") % 3
    places = F.when(k == 0, F.array(F.lit("Canada"), F.lit("United States"))).when(k == 1, F.array(F.lit("Spain")))
    jobs = _jobs(spark, sf).withColumn("location_countries", places)
    strict = spark.createDataFrame([("c1", "Lagos"), ("c4", None)], "client_id string, residence string")
    return matching.strict(matches(spark, sf), jobs, strict).select("job_id", "client_id", "decision", "score")


@query(f"""WITH {_BRIEFS}, t AS (SELECT DISTINCT p_partkey AS k FROM w JOIN q ON contains(t, role) AND NOT contains(t, other)),
i AS (SELECT p_partkey AS k, p_brand, CASE WHEN CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 4 = 0 THEN 'full_collection' WHEN p_size > 30 THEN 'stale_skipped' WHEN p_partkey % 13 = 0 THEN 'uncertain_title' WHEN t.k IS NOT NULL THEN 'candidate' ELSE 'title_skipped' END AS a FROM part LEFT JOIN t ON t.k = p_partkey)
SELECT p_brand AS target, bool_or(a = 'full_collection') AS fallback_full_collection, count(*) FILTER (WHERE a = 'stale_skipped') AS stale_skipped, count(*) FILTER (WHERE a = 'title_skipped') AS title_skipped, count(*) FILTER (WHERE a = 'uncertain_title') AS uncertain_title,
 count(*) FILTER (WHERE a IN ('candidate', 'uncertain_title')) AS candidate_paths, count(*) AS index_postings FROM i GROUP BY 1""")
def index_first_plan(spark, sf):
    """Brands as targets of a list-only scan, a quarter of which wasn't complete; sizes are ages in days."""
    postings = part_postings(spark, sf).join(read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size"), "id")
    index = postings.select(F.col("source_board_id").alias("target"), F.col("id").alias("path"), F.when(F.col("id").cast("long") % 13 != 0, F.col("title")).alias("title"), F.when(F.col("p_size") > 30, 30).otherwise(1).alias("age_days"))
    coverage = index.select("target").distinct().withColumn("status", F.when(F.regexp_extract("target", "[0-9]+", 0).cast("int") % 4 == 0, "partial").otherwise("success"))
    return boards.index_first_counts(boards.index_first(index, coverage, customer_briefs(spark, sf)))


@query("""WITH h AS (SELECT l_suppkey % 3 AS client, l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1), o AS (SELECT l_suppkey % 3 AS client, l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber <= 2)
SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM h WHERE k = o_orderkey AND client = o_custkey % 3) THEN CASE WHEN o_orderkey % 2 = 0 THEN 'identity' ELSE 'url' END
 WHEN EXISTS (SELECT 1 FROM o WHERE k = o_orderkey AND client = o_custkey % 3) THEN CASE WHEN o_orderkey % 2 = 0 THEN 'observed_identity' ELSE 'observed_url' END END AS basis FROM orders""")
def surfaced_basis(spark, sf):
    """By which evidence an order was surfaced for its client: links of even orders have an identity, those of odd ones a URL."""
    def links(name, key, client):
        even, text = F.col(key) % 2 == 0, F.col(key).cast("string")
        return [(F.col(client) % 3).cast("string").alias("client_id"), F.lit("d").alias("destination"), F.when(even, "s").alias("source"), F.lit("b").alias("source_board_id"), text.alias("source_job_id"), F.when(~even, text).alias(name)]

    lines = read(spark, sf, "lineitem")
    old = lines.where("l_returnflag = 'R' AND l_linenumber = 1").select(*links("normalized_url", "l_orderkey", "l_suppkey"))
    seen = lines.where("l_returnflag = 'A' AND l_linenumber <= 2").select(*links("normalized_url", "l_orderkey", "l_suppkey"))
    postings = read(spark, sf, "orders").select("o_orderkey", *links("canonical_url", "o_orderkey", "o_custkey"))
    return evidence.surfaced_basis(postings, old, seen).select("o_orderkey", "basis")


@query("""SELECT o_orderkey, greatest(0, 5 - o_custkey % 7) AS remaining, CASE WHEN o_orderkey % 11 = 0 THEN 'not_owned' WHEN o_orderstatus = 'F' THEN 'already_delivered' WHEN o_orderkey % 13 = 0 THEN 'recover_journal' WHEN o_orderkey % 3 = 0 AND o_orderpriority = '5-LOW' THEN 'mode_changed'
 WHEN o_custkey % 5 = 0 THEN 'paused' WHEN o_orderkey % 4 > greatest(0, 5 - o_custkey % 7) THEN 'quota_exceeded' ELSE 'ready' END AS guard FROM orders""")
def release_guards(spark, sf):
    """Orders as batches at their release, by the first check that holds."""
    k, c, name = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey").cast("string")
    batches = read(spark, sf, "orders").select(
        "o_orderkey", name.alias("client_id"), F.lit("d").alias("destination_id"), F.when(k % 11 == 0, "x").otherwise(name).alias("profile_client_id"), F.lit("d").alias("profile_destination_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered").otherwise("prepared").alias("status"), F.when(k % 13 == 0, "h").alias("export_after"), F.lit("h").alias("observed_digest"), F.when(k % 3 == 0, "auto").otherwise("review").alias("delivery_mode"),
        (F.col("o_orderpriority") == "5-LOW").alias("include_review"), F.when(c % 5 == 0, "paused").otherwise("active").alias("profile_status"), (k % 4).alias("selected"), F.lit(5).alias("daily_quota"), (c % 7).alias("delivered_today"),
    )
    return evidence.release_guard(batches).select("o_orderkey", "remaining", "guard")


# -- destinations and runs ------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT DISTINCT l_linenumber AS run_id, l_orderkey AS k FROM lineitem), j AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL 400 DAY END AS d FROM orders WHERE o_orderstatus <> 'P')
SELECT run_id, count(*) AS jobs, count(*) FILTER (WHERE d IS NULL OR d >= TIMESTAMP '2001-08-02' - INTERVAL 1095 DAY) AS active FROM m JOIN j USING (k) GROUP BY 1""")
def run_inventories(spark, sf):
    """Orders of each line number as postings of a run; of every fifth only retention remembers a time, if any."""
    o, fifth = read(spark, sf, "orders"), F.col("o_orderkey") % 5 == 0
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "closed").otherwise("seen").alias("lifecycle"), F.when(~fifth, F.col("o_orderdate").cast("timestamp")).alias("posted_at"))
    known = o.where(fifth & (F.col("o_orderkey") % 2 == 0)).select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderdate") - F.expr("INTERVAL 400 DAYS")).cast("timestamp").alias("posted_at"))
    members = read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("run_id"), F.col("l_orderkey").alias("job_id"))
    found = destinations.run_inventory(members, jobs, known, F.lit("2001-08-02").cast("timestamp"), 24 * 1095)
    return found.groupBy("run_id").agg(F.count("*").alias("jobs"), F.count_if("active").alias("active"))


@query("""WITH l AS (SELECT DISTINCT c_nationkey, c_custkey % 40 AS n FROM customer WHERE c_acctbal > 0), s AS (SELECT DISTINCT s_nationkey, s_suppkey % 40 AS n FROM supplier)
SELECT 'sheet:' || l.c_nationkey AS destination, count(*) AS observed_links, count(*) FILTER (WHERE s.n IS NULL) AS newly_recorded_links FROM l LEFT JOIN s ON s_nationkey = c_nationkey AND s.n = l.n GROUP BY 1""")
def observed_sheet_links(spark, sf):
    """A sheet for each nation with its customers' links, of which its suppliers' were seen before."""
    nation = F.col("c_nationkey").cast("string")
    link = lambda k: F.concat(F.lit("https://shop.example/"), (F.col(k) % 40).cast("string"))
    head = F.array(F.lit("Name"), F.lit("Address"))
    rows = read(spark, sf, "customer").select(nation.alias("destination_id"), F.when(F.col("c_acctbal") > 0, F.array("c_name", link("c_custkey"))).otherwise(F.array("c_name")).alias("r"))
    sheets = rows.groupBy("destination_id").agg(F.collect_list("r").alias("rows")).select("destination_id", F.concat(F.array(head), "rows").alias("rows"))
    known = sheets.select("destination_id", F.lit("c").alias("client_id"), head.alias("header"), F.create_map(F.lit("Job Link"), F.lit("Address")).alias("column_mapping"), F.concat(F.lit("sheet:"), "destination_id").alias("logical_uri"))
    seen = read(spark, sf, "supplier").select(F.lit("c").alias("client_id"), F.concat(F.lit("sheet:"), F.col("s_nationkey").cast("string")).alias("destination"), link("s_suppkey").alias("normalized_url"), F.lit(0).alias("first_observed_at")).distinct()
    _, counts = destinations.observe_links(destinations.sheet_links(sheets, known), seen, F.lit(1))
    return counts.drop("client_id")


# -- the universe of targets ------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT o_custkey AS t, o_orderpriority AS company, o_orderkey AS k, CAST(o_orderkey % 7 AS VARCHAR) AS url FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT t, company, count(*) AS c FROM l GROUP BY 1, 2)
SELECT l.t AS target, count(*) AS occurrences, count(DISTINCT url) AS distinct_urls, min(k) AS first, max(k) AS last, (SELECT company FROM n WHERE n.t = l.t ORDER BY c DESC, lower(company), company LIMIT 1) AS company FROM l GROUP BY 1""")
def target_universe(spark, sf):
    """Customers as targets that their orders link to."""
    k = F.col("o_orderkey")
    links = read(spark, sf, "orders").where("o_orderstatus != 'P'").select(F.col("o_custkey").alias("identity"), F.lit("orders").alias("source"), (k % 7).cast("string").alias("url"), F.col("o_orderpriority").alias("company"), k)
    known = universe.targets(links, ["o_orderkey"])
    return known.select(F.col("identity").alias("target"), "occurrences", "distinct_urls", F.col("first.o_orderkey").alias("first"), F.col("last.o_orderkey").alias("last"), "company")


_HEALTH = "(SELECT c_custkey AS k, c_mktsegment AS source, CASE c_custkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'valid_empty' ELSE 'active' END AS class, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey * (c_custkey % 31) END AS n, c_custkey % 30 AS times FROM customer)"


def _health(spark, sf):
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        k.alias("target_identity"), F.col("c_mktsegment").alias("source"), F.when(k % 5 == 0, "missing").when(k % 5 == 1, "valid_empty").otherwise("active").alias("classification"),
        F.when(k % 7 > 0, F.col("c_nationkey") * (k % 31)).alias("current_postings"), (k % 3 != 0).alias("inventory_exact"), (k % 30).alias("historical_occurrence_count"),
    )


@query(f"""SELECT source, count(*) AS targets, count(*) FILTER (WHERE class = 'active') AS active, count(*) FILTER (WHERE class = 'missing') AS missing, coalesce(sum(n) FILTER (WHERE class <> 'missing'), 0)::BIGINT AS postings,
 median(n) FILTER (WHERE class = 'active') AS median_postings, max(n) FILTER (WHERE class <> 'missing') AS maximum_postings, count(*) FILTER (WHERE class <> 'missing' AND n BETWEEN 100 AND 499) AS inventory_100_499, count(*) FILTER (WHERE k % 3 = 0) AS potentially_capped FROM {_HEALTH} GROUP BY 1""")
def target_health_summary(spark, sf):
    """Customers as checked targets, by segment."""
    return universe.health_summary(_health(spark, sf), ["active", "missing"]).select("source", "targets", "active", "missing", "postings", "median_postings", "maximum_postings", "inventory_100_499", "potentially_capped")


@query(f"""SELECT CASE WHEN times = 1 THEN '1' WHEN times <= 4 THEN '2-4' WHEN times <= 9 THEN '5-9' WHEN times <= 24 THEN '10-24' ELSE '25+' END AS band, count(*) AS targets, count(*) FILTER (WHERE class = 'active') AS active,
 median(n) FILTER (WHERE class <> 'missing') AS median_postings FROM {_HEALTH} WHERE times > 0 GROUP BY 1""")
def occurrence_health(spark, sf):
    return universe.occurrence_health(_health(spark, sf)).select("band", "targets", "active", "median_postings")


# -- batches and samples ----------------------------------------------------------------------------------------------------------

_GRAVE = "min(CASE stale WHEN 'posting_time_invalid' THEN 1 WHEN 'posting_age_unknown' THEN 2 WHEN 'stale_posting' THEN 3 END) FILTER (WHERE eligible)"


@query(f"""WITH {_BATCH}, g AS (SELECT group_id, bool_or(decision IN ('strong_match', 'possible_match')) AS m, bool_or(eligible) AS e, coalesce(bool_or(h), false) AS h, coalesce(bool_or(d), false) AND NOT coalesce(bool_or(h), false) AS d,
 coalesce(bool_or(eligible AND stale IS NULL), false) AND NOT coalesce(bool_or(h OR d), false) AS f, bool_or(disposition = 'employer_cooldown') AS cool, bool_or(disposition = 'company_duplicate_in_batch') AS cap, bool_or(disposition = 'selected_representative') AS sel, {_GRAVE} AS grave FROM z GROUP BY 1)
SELECT (SELECT count(*) FROM z) AS candidate_postings, (SELECT count(*) FROM z WHERE decision = 'needs_review') AS needs_review_postings, (SELECT count(*) FROM z WHERE eligible) AS selection_eligible_postings, count(*) FILTER (WHERE e) AS selection_eligible_groups,
 count(*) FILTER (WHERE h) AS historically_suppressed_groups, count(*) FILTER (WHERE d) AS previously_delivered_groups, (SELECT count(*) FROM z WHERE eligible) - count(*) FILTER (WHERE e) AS duplicate_postings_collapsed, count(*) FILTER (WHERE f) AS fresh_eligible_groups,
 count(*) FILTER (WHERE cool) AS employer_cooldown_suppressed_groups, count(*) FILTER (WHERE e AND NOT f AND NOT h AND NOT d AND grave = 3) AS stale_posting_suppressed_groups, count(*) FILTER (WHERE e AND NOT f AND NOT h AND NOT d AND grave = 2) AS unknown_age_suppressed_groups,
 count(*) FILTER (WHERE cap) AS company_cap_suppressed_groups, count(*) FILTER (WHERE sel) AS selected_groups FROM g""")
def batch_counters(spark, sf):
    """The counters of the catalogue's batch."""
    c = batch.counts(_batch(spark, sf))
    return c.drop("match_eligible_postings", "rejected_postings", "match_eligible_groups", "fresh_eligible_employers", "invalid_time_suppressed_groups")


@query("""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY c_nationkey) AS n, max(c_custkey) OVER (PARTITION BY c_nationkey) AS control FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)),
s AS (SELECT *, (SELECT min(i) FROM range(0, 3) AS t(i) WHERE round_even(i * (n - 1) / 2.0, 0) = r) AS i FROM r),
t AS (SELECT *, CASE WHEN c_custkey = control THEN 0 WHEN r < 1 THEN 1 + r WHEN i IS NOT NULL THEN 2 + i ELSE 5 + r END AS turn FROM s)
SELECT c_nationkey, c_custkey, turn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY turn) AS k FROM (SELECT c_nationkey, c_custkey, turn FROM t)) WHERE k <= 3""".replace("c_custkey, turn FROM (SELECT *", "c_custkey, k AS turn FROM (SELECT *"))
def pilot_targets(spark, sf):
    """Three customers of each nation: the newest as control, the richest, and evenly spaced ones."""
    c = read(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    newest = c.groupBy("c_nationkey").agg(F.max("c_custkey").alias("c_custkey"))
    return schedule.pilot(c, "c_nationkey", [-F.col("c_acctbal"), F.col("c_custkey")], "c_custkey", newest, 3, 1).select("c_nationkey", "c_custkey", "turn")
