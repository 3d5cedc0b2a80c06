"""More registered queries, with their SQL: lifecycles, selections, URLs and audits over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gleaner.functions import places, text as T, values as V
from gleaner.operators import evidence, lifecycle, read_api, selection, state
from gleaner.plans.catalogue import _AT, _DIGEST, events, micros, now, query, read

# -- lifecycles --------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, max_by(o_orderpriority, o_orderkey) AS e FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
n AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, max_by(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS e FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(s.o_custkey, n.o_custkey) AS o_custkey, epoch_us(coalesce(s.f, n.f)) AS first_at, epoch_us(greatest(s.l, n.l)) AS last_at, coalesce(n.e, s.e) AS evidence FROM s FULL JOIN n ON s.o_custkey = n.o_custkey""")
def stale_identity_ledger(spark, sf):
    o = read(spark, sf, "orders")
    ledger = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.max_by("o_orderpriority", "o_orderkey").alias("evidence"))
    seen = state.latest(o.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderdate"], [F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("evidence"))
    out = lifecycle.stale_identities(ledger, seen, ["o_custkey"])
    return out.select("o_custkey", micros("first_at").alias("first_at"), micros("last_at").alias("last_at"), "evidence")


@query("""SELECT doc_id, CASE WHEN g THEN NULL ELSE text END AS text, CASE WHEN g THEN 'closed' ELSE 'open' END AS lifecycle FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS g FROM documents)""")
def invalidate_postings(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", F.lit("open").alias("lifecycle"))
    return lifecycle.invalidated(d, read(spark, sf, "labels").where("toxic = 1"), "doc_id", ["text"])


@query("SELECT o_orderpriority, o_custkey % 50 AS board, bool_and(o_orderstatus = 'F') AS safe, count(*) AS shards FROM orders GROUP BY 1, 2")
def invalidation_coverage(spark, sf):
    o = read(spark, sf, "orders").select(F.struct("o_orderpriority", (F.col("o_custkey") % 50).alias("board")).alias("b"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return lifecycle.safe_to_invalidate(o, "b", "status").select("b.*", "safe", "shards")


@query("""
WITH d AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), u AS (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal < 0),
k AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'keep' WHEN user_id IN (SELECT c_custkey FROM u) THEN 'skip_unresolved' WHEN user_id IN (SELECT o_custkey FROM d) THEN 'compact' ELSE 'delete' END AS retention FROM events)
SELECT event_id, retention, CASE WHEN retention = 'compact' THEN NULL ELSE props END AS props FROM k WHERE retention <> 'delete'""")
def retention_prune(spark, sf):
    unresolved = read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    delivered = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"))
    basis = V.retention_basis(F.lit(None).cast("timestamp"), F.col("ts"), F.col("ts"))
    out = lifecycle.pruned(events(spark, sf), F.lit("2024-01-20").cast("timestamp"), basis, unresolved, delivered, "user_id", ["props"])
    return out.select("event_id", "retention", "props")


@query("SELECT l_orderkey, count(*) AS members FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01') GROUP BY 1")
def membership_prune(spark, sf):
    runs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").cast("timestamp").alias("completed_at"))
    members = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "run")
    left = lifecycle.without_old_runs(members, runs, "run", F.lit("1995-01-01").cast("timestamp"))
    return left.groupBy(F.col("run").alias("l_orderkey")).agg(F.count("*").alias("members"))


@query("""SELECT user_id, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(DISTINCT props) AS evidence, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY 1""")
def discovery_observe(spark, sf):
    out = lifecycle.observed_targets(events(spark, sf), "user_id", "event_type", "ts", "props")
    return out.select("user_id", micros("first_at").alias("first_at"), micros("last_at").alias("last_at"), "evidence", "conflict")


_HEALTH = "CASE event_type WHEN 'purchase' THEN 'active' WHEN 'view' THEN 'empty' WHEN 'click' THEN 'missing' ELSE 'failed' END"
_STATES = f"""(SELECT user_id, max(ts) AS checked_at, max_by(health, struct_pack(t := ts, e := event_id)) AS health, min(CASE WHEN health = 'active' THEN ts END) AS admitted_at FROM (SELECT *, {_HEALTH} AS health FROM events) GROUP BY 1)"""


def _health(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "active").when(F.col("event_type") == "view", "empty").when(F.col("event_type") == "click", "missing").otherwise("failed")
    one = state.latest(events(spark, sf).withColumn("health", kind), ["user_id", "ts"], [F.desc("event_id")])  # of checks at the same time the last
    early = events(spark, sf).withColumn("health", kind).where("health = 'active'").groupBy("user_id").agg(F.min("ts").alias("admitted_at"))
    return lifecycle.health_state(one, "user_id", "ts", "health").drop("admitted_at").join(early, "user_id", "left")


@query(f"""SELECT user_id, health, epoch_us(admitted_at) AS admitted_at, epoch_us(checked_at) + CASE health WHEN 'active' THEN 24 WHEN 'empty' THEN 168 WHEN 'missing' THEN 72 ELSE 6 END * 3600000000 AS next_check_at FROM {_STATES}""")
def health_record(spark, sf):
    return _health(spark, sf).select("user_id", "health", micros("admitted_at").alias("admitted_at"), micros("next_check_at").alias("next_check_at"))


@query(f"SELECT user_id, health FROM {_STATES} WHERE health = 'active' AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(checked_at) <= 48 * 3600000000")
def admitted_targets(spark, sf):
    return lifecycle.admitted(_health(spark, sf), now()).select("user_id", "health")


@query("""
WITH c AS (SELECT DISTINCT event_type, CAST(epoch(date_trunc('hour', ts)) // 3600 AS BIGINT) AS cohort FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY cohort) AS k, min(cohort) OVER (PARTITION BY event_type) AS f FROM c),
l AS (SELECT event_type, max(cohort) AS last FROM r WHERE cohort - f = k - 1 GROUP BY 1)
SELECT event_type, last, greatest(last + 1, 473352 - 24) AS due, CASE WHEN last + 1 < 473352 - 24 THEN last + 1 END AS skipped_from, CASE WHEN last + 1 < 473352 - 24 THEN 473352 - 25 END AS skipped_to FROM l""")
def schedule_catch_up(spark, sf):
    done = events(spark, sf).select("event_type", V.hour_cohort(F.col("ts")).alias("cohort"))
    return lifecycle.due_cohorts(done, "event_type", "cohort", F.lit(473352).cast("long"), 24)


@query()
def batch_state_machine(spark, sf):
    """Every order as a batch whose lines are events, refused or not by a state machine; a fold, so tests have a plain one."""
    actions = F.array(*map(F.lit, ["prepare", "finalize", "fail", "discard"]))
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(actions, (F.col("l_partkey") % 4 + 1).cast("int")).alias("action"), (F.col("l_suppkey") % 3).alias("of"))  # noqa: E741
    return lifecycle.batch_states(l, "l_orderkey", ["l_linenumber"], "action", "of")


# -- selections --------------------------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT c_nationkey, count(*) AS targets, ceil(count(*) / 6.0) AS wanted FROM customer GROUP BY 1), t AS (SELECT sum(wanted) AS total FROM n)
SELECT c_nationkey, targets, CAST(greatest(floor(wanted * 600 / greatest(total, 600)), 1) AS BIGINT) AS refresh_limit FROM n, t""")
def refresh_limits(spark, sf):
    return selection.refresh_limits(read(spark, sf, "customer"), "c_nationkey")


_YIELD = "(SELECT event_type, event_type || ':' || user_id AS target, max(ts) AS due, count(*) FILTER (WHERE value > 50) / count(*) AS y FROM events GROUP BY 1, 2)"


@query(f"""
WITH t AS {_YIELD}, f AS (SELECT event_type, target, 'fairness' AS reason, row_number() OVER (PARTITION BY event_type ORDER BY due, {_DIGEST.format('target')}) AS rank FROM t QUALIFY rank <= 5),
y AS (SELECT event_type, target, 'yield' AS reason, row_number() OVER (ORDER BY y DESC, {_DIGEST.format('target')}) AS rank FROM t WHERE y > 0 AND target NOT IN (SELECT target FROM f))
SELECT * FROM f UNION ALL SELECT * FROM y WHERE rank <= greatest(40 - (SELECT count(*) FROM f), 0)""")
def fairness_and_yield(spark, sf):
    t = events(spark, sf).groupBy("event_type", F.concat_ws(":", "event_type", "user_id").alias("target")).agg(F.max("ts").alias("due"), (F.count_if(F.col("value") > 50) / F.count("*")).alias("y"))
    return selection.fair_and_yielding(t, "event_type", "target", F.col("due"), F.col("y"), 5, 40)


@query(f"""
WITH s AS (SELECT c_custkey, max(o_orderdate) AS checked FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
a AS (SELECT *, (epoch_us(TIMESTAMP '1998-08-02') - epoch_us(checked)) / 3.6e9 AS age FROM s),
l AS (SELECT *, CASE WHEN checked IS NULL THEN 'new' WHEN age >= 4800 - 1200 AND age <= 4800 THEN 'expiring' ELSE 'routine' END AS lane FROM a),
r AS (SELECT c_custkey, lane, row_number() OVER (PARTITION BY lane ORDER BY checked NULLS FIRST, {_DIGEST.format('c_custkey')}) AS place FROM l QUALIFY place <= 50),
n AS (SELECT count(*) FILTER (WHERE lane = 'expiring') AS e, count(*) FILTER (WHERE lane = 'new') AS w, count(*) FILTER (WHERE lane = 'routine') AS r FROM r),
q AS (SELECT e, w, r, least(w, (50 - e) // 2) AS half FROM n), p AS (SELECT e, w, least(r, 50 - e - half) AS r FROM q), z AS (SELECT e, r, least(w, 50 - e - r) AS w FROM p)
SELECT c_custkey, lane, place FROM r, z WHERE place <= CASE lane WHEN 'expiring' THEN z.e WHEN 'routine' THEN z.r ELSE z.w END""")
def health_work_queue(spark, sf):
    last = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("timestamp").alias("checked"))
    targets = read(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return selection.health_queue(targets, "c_custkey", "checked", F.lit("1998-08-02").cast("timestamp"), 50, 4800, 1200)


@query("SELECT c_nationkey, ceil(count(*) / 7.0) AS cohorts, ceil(count(*) / 7.0) <= 24 AS within_horizon FROM customer GROUP BY 1")
def coverage_capacity(spark, sf):
    n = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("targets")).withColumn("most", F.lit(7))
    out = selection.capacity(n, "c_nationkey", "targets", "most", 24)
    return out.withColumn("cohorts", F.col("cohorts").cast("double"))


@query("SELECT c_nationkey, CAST(ceil(count(*) / 10.0) AS BIGINT) AS shards, ceil(count(*) / 10.0) > 128 AS refused FROM customer GROUP BY 1")
def shard_sizes(spark, sf):
    return selection.shard_counts(read(spark, sf, "customer"), "c_nationkey", 10, 128)


@query(f"SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY {_DIGEST.format('s_suppkey')}) AS place FROM supplier QUALIFY place <= 3")
def stable_source_sample(spark, sf):
    return selection.stable_sample(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey", 3).select("s_suppkey", "s_nationkey", F.col("place").cast("long").alias("place"))


@query("SELECT l_orderkey, CASE WHEN count(*) < 7 THEN CAST(ceil(sum(l_quantity) / 20) + sum(l_quantity) AS BIGINT) END AS requests FROM lineitem GROUP BY 1")
def request_cost(spark, sf):
    n = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("rows"), (F.count("*") >= 7).alias("capped"))
    return n.select("l_orderkey", selection.request_cost(F.col("rows"), F.col("capped")).cast("long").alias("requests"))


@query("SELECT c_custkey, rn FROM (SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment) DESC NULLS LAST, c_custkey) AS rn FROM customer) WHERE rn <= 30")
def user_sort_descending(spark, sf):
    return read_api.page(read(spark, sf, "customer"), read_api.sort_key("c_mktsegment", "c_custkey", True), 0, 30).select("c_custkey", "rn")


@query("""
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rn, count(*) OVER () AS total FROM events WHERE event_type = 'click')
SELECT event_id, rn, total, CASE WHEN 20 + 20 < total THEN 40 END AS next, 0 AS previous FROM p WHERE rn > 20 AND rn <= 40""")
def snapshot_page(spark, sf):
    return read_api.cursor_page(events(spark, sf).where("event_type = 'click'"), [-F.unix_micros("ts"), F.col("event_id")], 20, 20).select("event_id", "rn", "total", "next", "previous")


# -- URLs and identities -----------------------------------------------------------------------------------------------

_U = "regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', {0})"
_HOST = f"lower({_U.format(2)})"
_SAFE = f"{_U.format(1)} = 'https' AND contains({_HOST}, '.') AND NOT regexp_matches({_HOST}, '[@:]|[.](localhost|local|internal)$') AND NOT regexp_full_match({_HOST}, '[0-9.]+')"


@query(f"SELECT page_id, CASE WHEN {_SAFE} THEN url END AS safe, CASE WHEN {_SAFE} AND lower(rtrim({_U.format(3)}, '/')) NOT IN ('', '/jobs', '/careers', '/apply') THEN url END AS vacancy FROM (SELECT page_id, replace(url, 'http://', CASE WHEN page_id % 2 = 0 THEN 'https://' ELSE 'http://' END) AS url FROM pages)")
def safe_public_urls(spark, sf):
    url = F.replace("url", F.lit("http://"), F.when(F.col("page_id") % 2 == 0, "https://").otherwise("http://"))
    return read(spark, sf, "pages").select("page_id", url.alias("url")).select("page_id", places.safe_url(F.col("url")).alias("safe"), places.safe_url(F.col("url"), True).alias("vacancy"))


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN 'unsupported_source' ELSE 'malformed_url' END AS class FROM pages) GROUP BY 1")
def link_classes(spark, sf):
    return read(spark, sf, "pages").groupBy(places.link_target(F.col("url"))["class"].alias("class")).agg(F.count("*").alias("n"))


@query("SELECT event_id, round_even((epoch_us({0}) - epoch_us(ts)) / 3.6e9, 1) AS hours FROM events".format(_AT))
def age_hours(spark, sf):
    return events(spark, sf).select("event_id", V.age_hours(F.col("ts"), now()).alias("hours"))


@query("SELECT c_custkey, substr(sha256(c_name || chr(0) || c_mktsegment), 1, 16) AS control FROM customer")
def control_ids(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", V.control_id(F.col("c_name"), F.col("c_mktsegment")).alias("control"))


@query("""SELECT o_orderkey, sha256('{"customer":"' || o_custkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def canonical_json_sha256(spark, sf):
    facts = {"status": F.col("o_orderstatus"), "customer": F.col("o_custkey").cast("string"), "priority": F.col("o_orderpriority")}
    return read(spark, sf, "orders").select("o_orderkey", V.canonical_sha256(facts).alias("digest"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS header FROM part")
def slugs_and_headers(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.header_key(F.col("p_type")).alias("header"))


# -- joins and audits --------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_custkey, l_linenumber FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'""")
def three_way_join(spark, sf):
    c = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = read(spark, sf, "orders").where("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "c_custkey", "l_linenumber")


@query("""
WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT DISTINCT c_nationkey, c_mktsegment FROM a WHERE c_custkey IN (SELECT o_custkey FROM t) OR (c_nationkey, c_mktsegment) IN (SELECT s_nationkey, 'BUILDING' FROM supplier WHERE s_acctbal < 0)""")
def disjunctive_group_suppression(spark, sf):
    """Groups with a member that one of two kinds of evidence names, members outside the candidates included."""
    c = read(spark, sf, "customer").withColumn("g", F.struct("c_nationkey", "c_mktsegment"))
    urgent = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    named = read(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return state.either_semi(c, "g", (urgent, ["c_custkey"]), (named, ["c_nationkey", "c_mktsegment"])).select("g.*")


@query("""SELECT user_id, CASE WHEN o.c IS NOT NULL THEN 'identity' WHEN n.k IS NOT NULL THEN 'url' END AS basis FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'P') o ON o.c = user_id LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R') n ON n.k = user_id""")
def delivery_basis(spark, sf):
    """What says that a posting was delivered: its identity first, else its URL."""
    flag = lambda table, c, name: table.select(F.col(c).alias("user_id"), F.lit(name).alias(name)).distinct()
    one = flag(read(spark, sf, "orders").where("o_orderstatus = 'P'"), "o_custkey", "identity")
    two = flag(read(spark, sf, "lineitem").where("l_returnflag = 'R'"), "l_suppkey", "url")
    each = events(spark, sf).select("user_id").distinct()
    return each.join(one, "user_id", "left").join(two, "user_id", "left").select("user_id", F.coalesce("identity", "url").alias("basis"))


@query("""
WITH m AS (SELECT o_custkey, count(*) AS ids, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, CASE WHEN ids = 1 THEN id END AS resolved, CASE WHEN ids IS NULL THEN 'missing' WHEN ids > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome FROM customer LEFT JOIN m ON o_custkey = c_custkey""")
def import_resolution(spark, sf):
    known = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return evidence.resolved(read(spark, sf, "customer"), known, "c_custkey", "o_orderkey")


@query("""
SELECT count(*) FILTER (WHERE s.s_suppkey IS NULL) AS only_targets, count(*) FILTER (WHERE c.c_custkey IS NULL) AS only_overlay, count(*) FILTER (WHERE s_nationkey <> c_nationkey) AS conflicts, count(*) FILTER (WHERE s_nationkey = c_nationkey) AS equal
FROM customer c FULL JOIN supplier s ON s_suppkey = c_custkey""")
def overlay_conflicts(spark, sf):
    met = read(spark, sf, "customer").join(read(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "full")
    return met.agg(
        F.count_if(F.col("s_suppkey").isNull()).alias("only_targets"), F.count_if(F.col("c_custkey").isNull()).alias("only_overlay"),
        F.count_if(F.col("s_nationkey") != F.col("c_nationkey")).alias("conflicts"), F.count_if(F.col("s_nationkey") == F.col("c_nationkey")).alias("equal"))


@query("""
WITH h AS (SELECT conv_id, turn, role, sha256(text) AS h FROM conversations)
SELECT conv_id, sha256(string_agg(CAST(turn AS VARCHAR) || ':' || role || ':' || h, ',' ORDER BY turn, role, h)) AS digest, count(*) AS parts FROM h GROUP BY 1""")
def ordered_set_digest(spark, sf):
    """A digest of each conversation's turns in their order."""
    hashed = read(spark, sf, "conversations").withColumn("h", F.sha2("text", 256))
    said = F.concat_ws(":", F.col("turn").cast("string"), "role", "h")
    return evidence.ordered_digest(hashed, ["conv_id"], ["turn", "role", "h"], said)


@query("""
WITH g AS (SELECT l_orderkey, list(struct_pack(f := l_returnflag, n := l_linenumber) ORDER BY l_linenumber) AS m, count(*) AS members FROM lineitem GROUP BY 1)
SELECT l_orderkey, members, CASE WHEN list_contains(list_transform(m, lambda x: x.f), 'R') THEN m[1].n END AS representative FROM g""")
def group_page(spark, sf):
    """Groups with their number of members, and a representative only where a delivery is recorded."""
    return evidence.group_pages(read(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R", ["l_linenumber"])


@query("SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS brief, epoch_us(max_by(o_orderdate, o_orderkey)) AS registered FROM orders GROUP BY 1")
def latest_brief(spark, sf):
    last = evidence.latest(read(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderpriority", "o_orderdate"])
    return last.select("o_custkey", F.col("o_orderpriority").alias("brief"), micros("o_orderdate").alias("registered"))


@query("""
WITH s AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS delivered FROM orders GROUP BY 1)
SELECT c_custkey, greatest(0, 10 - coalesce(delivered, 0)) AS remaining, CASE WHEN c_acctbal < 0 THEN 'not_owned' WHEN coalesce(delivered, 0) >= 10 THEN 'quota_reached' ELSE 'ready' END AS guard FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def quota_and_release_guard(spark, sf):
    s = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("d"))
    met, d = read(spark, sf, "customer").join(s, "c_custkey", "left"), F.coalesce("d", F.lit(0))
    return met.select("c_custkey", F.greatest(F.lit(0), 10 - d).alias("remaining"), F.when(F.col("c_acctbal") < 0, "not_owned").when(d >= 10, "quota_reached").otherwise("ready").alias("guard"))


@query("""
WITH o AS (SELECT event_id, user_id, CASE WHEN value <= 5 THEN 'reject' WHEN user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'historical' WHEN ts < TIMESTAMP '2024-01-28' THEN 'stale' END AS early, value FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM o WHERE early IS NULL)
SELECT outcome, count(*) AS n, count(DISTINCT user_id) AS targets FROM (SELECT user_id, early AS outcome FROM o WHERE early IS NOT NULL UNION ALL SELECT user_id, CASE WHEN place > 3 THEN 'company_cap' ELSE 'deliverable' END FROM k) GROUP BY 1""")
def outcome_ladder(spark, sf):
    done = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"), F.lit(True).alias("historical")).distinct()
    e = events(spark, sf).join(done, "user_id", "left").withColumns({
        "decision": F.when(F.col("value") <= 5, "reject").otherwise("strong_match"), "stale": F.when(F.col("ts") < F.lit("2024-01-28").cast("timestamp"), "stale"), "delivered": F.lit(False),
        "eligible": F.lit(True), "group_id": F.lit(None).cast("string"), "employer": F.col("user_id"),
    })
    found = evidence.outcome_ladder(e, [-F.col("value"), F.col("event_id")], 3)
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("targets"))


@query("""
WITH y AS (SELECT user_id, count(*) FILTER (WHERE value > 20 AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) BETWEEN 0 AND 72 * 3600000000) AS eligible, count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) BETWEEN 0 AND 72 * 3600000000) AS n FROM events GROUP BY 1)
SELECT user_id, eligible, n FROM y WHERE n > 0""")
def yield_lookback(spark, sf):
    back = F.unix_micros(now()) - F.unix_micros("ts")
    e = events(spark, sf).where(back.between(0, 72 * 3_600_000_000))
    return e.groupBy("user_id").agg(F.count_if(F.col("value") > 20).alias("eligible"), F.count("*").alias("n"))


@query("""SELECT l_returnflag AS class, count(*) AS n, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS admitted, count(DISTINCT l_suppkey) AS targets FROM lineitem GROUP BY 1""")
def discovery_summary(spark, sf):
    return evidence.class_summary(read(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "class"), "class", F.col("l_quantity") > 25, "l_suppkey")


@query("""
WITH a AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT count(*) FILTER (WHERE l_orderkey IS NULL) AS first_only, count(*) FILTER (WHERE o_orderkey IS NULL) AS replay_only, count(*) FILTER (WHERE o_orderkey = l_orderkey) AS both FROM a FULL JOIN b ON o_orderkey = l_orderkey""")
def supply_replay(spark, sf):
    a = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    b = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return evidence.compared_sets(a, b, "k").withColumnRenamed("second_only", "replay_only")


@query("""SELECT page_id, CASE code WHEN 200 THEN 'success' WHEN 404 THEN 'missing' WHEN 429 THEN 'rate_limited' WHEN 503 THEN 'unavailable' ELSE 'failed' END AS class FROM (SELECT page_id, [200, 404, 410, 429, 503, 500][page_id % 6 + 1] AS c, CASE c WHEN 410 THEN 404 ELSE c END AS code FROM pages)""")
def status_classes(spark, sf):
    code = F.element_at(F.array(*map(F.lit, [200, 404, 410, 429, 503, 500])), (F.col("page_id") % 6 + 1).cast("int"))
    return read(spark, sf, "pages").select("page_id", V.status_class(code).alias("class"))

