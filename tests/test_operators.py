"""Batches, upserts, payloads, exports and streams on small examples."""

import datetime
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import batch, components, grouping, lifecycle, matching, state, telemetry
from gleaner.plans import catalogue, shared
from gleaner.sources import exports, postings, replay
from gleaner.streaming import changes

AT = datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC)
SHAPE = "job_id string, group_id long, employer long, decision string, score int, posted_at timestamp, historical boolean, delivered boolean, cooling boolean"


def candidates(spark, n, **more):
    base = {"decision": "strong_match", "score": 4, "posted_at": AT - datetime.timedelta(hours=1), "historical": False, "delivered": False, "cooling": False} | more
    return spark.createDataFrame([(f"{i:03}", i, i, *base.values()) for i in range(n)], SHAPE)


@pytest.mark.parametrize("supply, quota, taken", [(7, 1, 1), (6, 6, 6), (1, 9, 1), (0, 2, 0), (41, 40, 40)])
def test_quota(spark, supply, quota, taken):
    out = batch.assemble(candidates(spark, supply), quota, 1, 72, "reject", F.lit(AT)).where("ordinal IS NOT NULL")
    assert sorted(r["ordinal"] for r in out.collect()) == list(range(1, taken + 1))


def test_dispositions(spark):
    hours = {"a": 72, "b": 73, "c": None, "d": -2}
    rows = [(k, i, i, "strong_match", 4, None if h is None else AT - datetime.timedelta(hours=h), False, False, False) for i, (k, h) in enumerate(hours.items())]
    rows += [("e", 10, 0, "possible_match", 3, AT, False, False, False), ("f", 11, 11, "strong_match", 5, AT, True, False, False), ("g", 12, 12, "reject", None, AT, False, False, False), ("h", 13, 13, "strong_match", 5, AT, False, False, True)]
    out = batch.assemble(spark.createDataFrame(rows, SHAPE), 9, 1, 72, "reject", F.lit(AT))
    assert {r["job_id"]: r["disposition"] for r in out.collect()} == {
        "a": "selected_representative", "b": "stale_posting", "c": "posting_age_unknown", "d": "posting_time_invalid", "e": "company_duplicate_in_batch", "f": "historical", "g": "reject", "h": "employer_cooldown"}


def test_reasons(spark):
    jobs = spark.createDataFrame([("1", "Senior Data Engineer", None, None, ["Canada"], "remote", None)], "id string, title string, description_text string, country string, eligible_countries array<string>, remote_status string, employment_type string")
    rule = (["Canada"], "must", "review")
    none = ([], "ignore", "review")
    brief = ("c", ["data engineer"], "avoid", [], ["junior"], rule, none, none, none, None, [], ["python"], [])
    got = matching.match(jobs, spark.createDataFrame([brief], matching.BRIEF)).first()
    assert (got["decision"], got["score"]) == ("needs_review", 3)
    assert got["matched_reasons"] == ["target role matched: data engineer", "target market matched: Canada", "needs review: must-have term cannot be verified: python"]


def test_upsert(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, f string")
    arriving = spark.createDataFrame([(1, "a", 1), (2, "x", 2), (4, "n", 3), (4, "n", 4), (5, "n", 5), (5, "m", 6)], "k int, f string, pos int")
    got = {r["k"]: r["lifecycle"] for r in state.upsert(stored, arriving, ["k"], "f").collect()}
    assert got == {1: "seen", 2: "changed", 3: "kept", 4: "seen", 5: "changed"}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_payloads(spark):
    target = ("b1", "Acme", "acme")
    body = {"jobs": [{"id": 7, "title": "Engineer", "absolute_url": "https://x.io/jobs/7/?utm_source=a", "content": "<p>Hi</p>", "location": {"name": "Austin, TX"}, "first_published": "2024-01-01T00:00:00Z"}, {"id": 8, "title": " "}]}
    rows = spark.createDataFrame([(target, json.dumps(body)), (target, "not json")], "target struct<board:string,company:string,employer_id:string>, payload string")
    good, bad = postings.postings(rows, "greenhouse")
    job = good.first()
    assert (job["source_job_id"], job["canonical_url"], job["description_text"], job["country"], job["remote_status"]) == ("7", "https://x.io/jobs/7", "Hi", "United States", "onsite")
    assert sorted(r["reason"] for r in bad.collect()) == ["payload cannot be read", "title is missing"]


@pytest.mark.parametrize("source, body", [
    ("ashby", {"jobs": [{"id": "12345678-1234-1234-1234-123456789abc", "title": "A", "jobUrl": "https://jobs.ashbyhq.com/a/12345678-1234-1234-1234-123456789abc", "isRemote": True}, {"id": "x", "title": "hidden", "isListed": False}]}),
    ("lever", [{"id": "1", "text": "A", "hostedUrl": "https://jobs.lever.co/a/1", "createdAt": 1_700_000_000_000, "workplaceType": "remote", "categories": {"location": "Lagos, Nigeria"}}]),
    ("smartrecruiters", {"content": [{"id": "1", "name": "A", "postingUrl": "https://jobs.smartrecruiters.com/a/1", "location": {"remote": True}, "releasedDate": "2024-01-01T00:00:00.000Z"}]}),
    ("workday", {"jobPostingInfo": {"jobReqId": "R1", "title": "A", "externalUrl": "https://a.wd1.myworkdayjobs.com/x/job/R1", "remoteType": "Remote"}}),
])
def test_other_payloads(spark, source, body):
    rows = spark.createDataFrame([(("b", "c", "e"), json.dumps(body))], "target struct<board:string,company:string,employer_id:string>, payload string")
    good, bad = postings.postings(rows, source)
    assert [(r["title"], r["remote_status"]) for r in good.collect()] == [("A", "remote")]
    assert bad.count() == 0


def test_export(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("Acme", 'A "b", c', "https://a/1", None, "lever")], "Company string, Title string, Link string, Location string, Platform string")
    first = exports.replace_csv(rows, path, before="0:")
    assert exports.replace_csv(rows.union(rows), path, before=first) != first
    with pytest.raises(ValueError):
        exports.replace_csv(rows, path, before=first)


def test_streams(spark, tmp_path):
    rows = [(i, "t%d" % (i % 2), AT + datetime.timedelta(minutes=40 * i), "success" if i % 3 else "failed") for i in range(6)]
    spark.createDataFrame(rows + rows[:1], "id int, target string, at timestamp, status string").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id int, target string, at timestamp, status string").parquet(str(tmp_path / "in"))

    def run(stream, mode):
        q = stream.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / mode / str(len(list(tmp_path.iterdir()))))).start()
        q.processAllAvailable()
        q.stop()
        return spark.table("out").collect()

    assert sum(r["n"] for r in run(changes.hourly_counts(source(), "at", "target"), "complete")) == 7
    assert {r["target"]: r["n"] for r in run(changes.coverage(source(), "target", "at", "status"), "complete")} == {"t0": 2, "t1": 2}
    assert len(run(changes.once(source(), ["id"], "at"), "append")) == 6


def test_versions_of_a_hot_subject(spark):
    hot = spark.range(100_000).select(F.lit("hot").alias("s"), F.col("id").alias("i"), (F.col("id") - F.floor(F.col("id") / 10)).alias("expected"))
    rest = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 1), (None, 1, None), (None, 2, 0)], "s string, i long, expected long")
    found = state.versions(hot.union(rest).repartition(5), ["s"], ["i"], "expected")
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = {r["s"]: (r["version"], r["events"], r["refused"]) for r in found.collect()}
    version = 0
    for i in range(100_000):
        version += i - i // 10 == version
    assert got == {"hot": (version, 100_000, 100_000 - version), "a": (2, 3, 1), None: (1, 2, 1)}


def union_find(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


def test_components_of_customers_and_parts(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["node"]: r["root"] for r in catalogue.connected_components(spark, sf).collect()}
    customer = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    links = [(customer[r["l_orderkey"]] * 2, r["l_partkey"] * 2 + 1) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect() if r["l_orderkey"] in customer]
    assert got == union_find(links)


POSTING = (
    "id string, source string, source_board_id string, source_job_id string, canonical_url string, job_url string, apply_url string, company string, title string, description_text string, eligible_countries array<string>, "
    "country string, remote_status string, location_text string, city string, region string, department string, employment_type string, updated_at timestamp, posted_at timestamp"
)
WORDS = " ".join(f"word{i}" for i in range(45))


def posting(i, url, **more):
    base = dict.fromkeys([x.split()[0] for x in POSTING.split(", ")]) | {"id": i, "source": "s", "source_board_id": "b", "source_job_id": i, "canonical_url": url, "company": "Acme", "title": "Writer", "remote_status": "remote"}
    return tuple((base | more).values())


def test_delivery_keys_and_groups(spark):
    rows = [
        posting("p1", "https://a.org/v/1?b=2&a=1", apply_url="https://a.org/apply"), posting("p2", "https://A.org/v/1/?a=1&b=2&utm_x=1"), posting("p3", "https://a.org/careers/"),
        posting("p4", "https://b.org/1", description_text=WORDS, eligible_countries=["Canada"], location_text="Remote - Canada; Oslo"), posting("p5", "https://c.org/1", description_text=WORDS.upper(), country="Canada", location_text="oslo"),
        posting("p6", "https://d.org/1", description_text=WORDS, eligible_countries=["Canada"], location_text="Oslo", remote_status="unknown"), posting("p7", "https://e.org/1", description_text="word " * 39, country="Canada"),
    ]
    keys = grouping.delivery_keys(spark.createDataFrame(rows, POSTING))
    got = {(r["id"], r["kind"]): r["value"] for r in keys.collect()}
    assert got["p1", "url"] == got["p2", "url"] == "https://a.org/v/1?a=1&b=2"
    assert {k for k in got if k[0] == "p3"} == set() and {k[0] for k in got if k[1] == "dedupe-v1"} == {"p4", "p5"}
    facts = ["acme", "writer", WORDS, ["canada"], "remote", "oslo", "", "", "", None]
    assert got["p4", "dedupe-v1"] == got["p5", "dedupe-v1"] == hashlib.sha256(json.dumps(facts, ensure_ascii=False).encode()).hexdigest()

    existing = spark.createDataFrame([("p2", "g2"), ("p7", "g1"), ("p5", "g3"), ("old", "g1")], "id string, group_id string")
    groups, merged = grouping.delivery_groups(keys, existing)
    found = {r["id"]: r["group_id"] for r in groups.collect()}
    assert (found["p1"], found["p2"], found["p4"], found["p5"], found["p7"], found["old"]) == ("g2", "g2", "g3", "g3", "g1", "g1")
    assert found["p6"] not in ("g1", "g2", "g3") and "p3" not in found and merged.count() == 0
    joined = spark.createDataFrame([("p1", "g2"), ("p5", "g1"), ("p4", "g3")], "id string, group_id string")
    _, merged = grouping.delivery_groups(keys, joined)
    assert [tuple(r) for r in merged.collect()] == [("g3", "g1")]
    best = grouping.representatives(spark.createDataFrame(rows, POSTING), groups)
    assert {r["group_id"]: (r["representative"], r["members"]) for r in best.collect()}["g2"] == ("p1", 2)


def test_batch_states(spark):
    rows = [(1, 1, "prepare", 0), (1, 2, "finalize", 1), (1, 3, "fail", 1), (2, 1, "finalize", 0), (2, 2, "prepare", 0), (2, 3, "fail", 1), (2, 4, "prepare", 0), (2, 5, "finalize", 1), (2, 6, "discard", 2), (None, 1, "prepare", None)]
    got = lifecycle.batch_states(spark.createDataFrame(rows, "b long, n int, action string, of long"), "b", ["n"], "action", "of")
    assert {r["b"]: tuple(r)[1:] for r in got.collect()} == {1: ("finalize", 1, 2, 1), 2: ("discard", 2, 4, 2), None: ("prepare", 1, 1, 0)}


def test_due_cohorts(spark):
    done = spark.createDataFrame([("a", 5), ("a", 6), ("a", 8), ("b", 90), ("b", 91), ("b", 91)], "s string, c long")
    got = {r["s"]: tuple(r)[1:] for r in lifecycle.due_cohorts(done, "s", "c", F.lit(95), 10).collect()}
    assert got == {"a": (6, 85, 7, 84), "b": (91, 92, None, None)}


def test_append(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "1, 2")], "x string, y string")
    assert exports.append_csv(rows, path) == exports.csv_digest(spark, path)
    exports.append_csv(rows, path)
    assert spark.read.csv(path, header=True).count() == 2
    with pytest.raises(ValueError):
        exports.append_csv(rows.toDF("x", "z"), path)


def test_percentiles(spark):
    import numpy

    values = {"a": [float(x % 17) for x in range(500)], "b": [3.0], "c": [1.0, 2.0, 2.0, 9.5]}
    rows = spark.createDataFrame([(k, v) for k, some in values.items() for v in some] + [("a", None)], "k string, v double").repartition(7)
    for r in telemetry.percentiles(rows, ["k"], "v", [0, 0.5, 0.95, 1]).collect():
        assert [round(r[f"p{i}"], 9) for i in range(4)] == [round(x, 9) for x in numpy.quantile(values[r["k"]], [0, 0.5, 0.95, 1])] and r["n"] == len(values[r["k"]])


def test_profiles_as_briefs(spark):
    profiles = spark.createDataFrame([("c", ["engineer"], ["Canada"], True, ["php"], 5)], "client_id string, roles array<string>, countries array<string>, remote_only boolean, excluded_terms array<string>, max_years int")
    jobs = spark.createDataFrame([("1", "Engineer", "likes php", None, ["Canada"], "remote", None), ("2", "Engineer", "x", None, ["Canada"], "remote", None), ("3", "Cook", "x", None, None, None, None)], "id string, title string, description_text string, country string, eligible_countries array<string>, remote_status string, employment_type string")
    briefs = matching.brief_of_profile(profiles)
    assert {r["job_id"]: r["decision"] for r in matching.match(jobs, briefs).collect()} == {"1": "reject", "2": "possible_match", "3": "reject"}
    assert {r["job_id"] for r in matching.match(jobs, briefs, every_pair=False).collect()} == {"1", "2"}


def test_replayed_payloads(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"board{i}.json").write_text(json.dumps({"jobs": [{"id": i, "title": f"Job {i}", "absolute_url": f"https://x.io/jobs/{i}"}]}))
    spark.dataSource.register(replay.PayloadSource)
    rows = spark.read.format("replayed-payloads").load("file://" + str(tmp_path))
    good, bad = postings.postings(rows, "greenhouse")
    assert {(r["source_board_id"], r["title"]) for r in good.collect()} == {(f"board{i}", f"Job {i}") for i in range(3)} and bad.count() == 0


def test_bounded_reads_fail_closed(spark, tmp_path):
    rows = spark.createDataFrame([("abc",)] * 5, "text string")
    assert replay.bounded(rows, 5, 15, "text").count() == 5
    for most_rows, most_bytes in ((4, 100), (5, 14)):
        with pytest.raises(ValueError):
            replay.bounded(rows, most_rows, most_bytes, "text")
    (tmp_path / "brief.json").write_text('{"client_id": "c",\n "roles": ["a"]}')
    assert replay.configuration(spark, str(tmp_path / "brief.json"), "client_id string, roles array<string>").first()["roles"] == ["a"]


def test_page_strides_come_to_every_page(spark):
    import math

    names = spark.range(200).select(F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 60 + 1).alias("pages"))
    for r in names.select("pages", replay.page_stride(F.col("name"), F.col("pages")).alias("s"), replay.start_page(F.col("name"), F.col("pages")).alias("p")).collect():
        assert math.gcd(r["s"], r["pages"]) == 1 and 0 <= r["p"] < r["pages"]


def test_page_stride_is_the_first_without_a_common_divisor(spark, capsys):
    import hashlib
    import math

    names = spark.range(500).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 7 == 0, 30030 * (F.col("id") + 1)).otherwise(F.col("id") % 60 + 1).alias("pages"))
    found = names.select("name", "pages", replay.page_stride(F.col("name"), F.col("pages")).alias("s"))
    for name, pages, s in found.collect():
        want = int(hashlib.sha256(f"stride:{name}".encode()).hexdigest()[:12], 16) % pages + 1
        while math.gcd(want, pages) != 1:
            want = want % pages + 1
        assert s == want
    found.explain()
    assert "sequence(" not in capsys.readouterr().out  # not every number of a list is tried for every row
    none = spark.createDataFrame([(None, 9), ("a", None)], "name string, pages long")
    assert [r[0] for r in none.select(replay.page_stride(F.col("name"), F.col("pages"))).collect()] == [1, 1]


def test_links_to_roots_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "_large_star", lambda links: 1 / 0)
    links = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(5, 2), (2, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(links).collect()} == {i: i % 3 for i in range(30)}


def test_cut_leaves_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(shared, "_due", [float("inf")])  # no garbage is collected meanwhile
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for f in str(disk.getAllFiles().mkString("\n")).split("\n") if (n := f.rsplit("/", 1)[-1]).startswith("shuffle_")}
    before, frame = shuffles(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(50).withColumnRenamed("id", "k"), "k")
    kept = shared.cut(frame)
    end = time.monotonic() + 20
    while shuffles() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert kept.count() == frame.count() == 7 and shared.cut(frame).count() == 7


def test_a_round_reads_its_links_once(spark):
    links = shared.cut(spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "a long, b long"))
    for star in (components._large_star, components._small_star):
        assert "Union" not in star(links)._jdf.queryExecution().optimizedPlan().toString()
