"""Reports and small writes against plain counting."""

import collections
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import reports

NOW = datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC)
DECISIONS = ["strong_match", "possible_match", "needs_review", "reject"]


def ago(hours):
    return None if hours is None else NOW - datetime.timedelta(hours=hours)


def test_client_funnel(spark):
    rng = random.Random(1)
    reasons = ["title does not match a configured target role", "target market countries [X] do not match the brief", "work mode 'onsite' is avoided", "remote status is unknown and profile policy rejects unknown evidence", "excluded role: x"]
    rows = []
    for _ in range(400):
        decision = rng.choice(DECISIONS)
        rows.append((rng.choice(["A", " a ", "b", "", None]), decision, rng.sample(reasons, rng.randrange(1, 3)) if decision == "reject" else rng.choice([[], None]), ago(rng.choice([1, 23, 30, 60, 100, -5, None]))))
    got = {r["source"]: r.asDict() for r in reports.client_funnel(spark.createDataFrame(rows, "source string, decision string, rejection_reasons array<string>, posted_at timestamp"), F.lit(NOW)).collect()}
    want = collections.defaultdict(collections.Counter)
    for source, decision, why, posted in rows:
        age = None if posted is None else (NOW - posted).total_seconds() / 3600
        bucket = "age_unknown" if age is None else "age_invalid" if age < 0 else "age_0_24h" if age <= 24 else "age_24_48h" if age <= 48 else "age_48_72h" if age <= 72 else "age_over_72h"
        name = "confirmed" if decision in DECISIONS[:2] else "needs_review" if decision == "needs_review" else "rejected"
        hits = ["retained_evaluated", "retained_rejected" if name == "rejected" else f"retained_{name}_matches"] + ([bucket] if name != "rejected" else [])
        if bucket == "age_0_24h":
            hits += ["fresh_0_24h", "rejected_0_24h" if name == "rejected" else f"{name}_matches_0_24h"]
            for stage, starts in (("title_matched_0_24h", ("title does",)), ("target_market_survived_0_24h", ("target market",)), ("remote_survived_0_24h", ("work mode", "remote status")), ("other_rules_survived_0_24h", None)):
                if (name == "rejected") if starts is None else any(r.startswith(starts) for r in why or ()):
                    break
                hits.append(stage)
        for key in (None, (source or "").strip().lower() or "unknown"):
            want[key].update(hits)
    assert got.keys() == want.keys()
    for key, row in got.items():
        assert {k: v for k, v in row.items() if k != "source" and v} == dict(want[key])
        assert len(row) == 1 + 12 + 6


def test_matched_stats_and_selection(spark):
    rows = [("r", "strong_match", "e1", "X", "g1", ago(1), 72, "reject"), ("r", "possible_match", None, " Acme ", "g1", ago(2), 72, "reject"), ("r", "strong_match", None, "ACME", "g2", ago(3), 72, "reject"), ("r", "reject", "e9", "X", "g9", ago(1), 72, "reject"),
            ("r", "strong_match", "e3", "X", "g3", ago(80), 72, "reject"), ("r", "strong_match", "e3", "X", "g3", None, 72, "reject"), ("r", "strong_match", "e3", "X", "g3", ago(-9), 72, "reject")]
    shape = "run string, decision string, employer_id string, company string, group_id string, posted_at timestamp, max_hours int, unknown_policy string"
    assert tuple(reports.matched_stats(spark.createDataFrame(rows, shape), ["run"], F.lit(NOW)).first()) == ("r", 3, 2, 2, 1, 1, 1)
    jobs = [("t", "j1", "g1", None, False, 2), ("t", "j2", "g1", None, False, 1), ("t", "j3", "g2", "identity", False, 1), ("t", "j4", "g2", None, False, 9), ("t", "j5", "g3", None, True, 1), ("t", "j6", "g4", "url", True, 1)]
    frame = lambda rows: spark.createDataFrame(rows, "target string, job_id string, group_id string, history string, delivered boolean, place int")
    chosen, counts = reports.fresh_selection(frame(jobs), ["target"], [F.col("place")])
    assert sorted(tuple(r)[1:] for r in chosen.collect()) == [("g1", "j2"), ("g2", "j4")] and tuple(counts.first()) == ("t", 1, 1, 1, 2)
    with pytest.raises(Exception, match="no delivery group: j7"):
        reports.fresh_selection(frame([("t", "j7", None, None, False, 1)]), ["target"], [F.col("place")])[0].collect()


def test_capacity_and_replay(spark):
    rows = [("t", "1", "new", "strong_match", None, "g1", False), ("t", "2", "seen", "possible_match", None, "g1", False), ("t", "3", "changed", "strong_match", "identity", "g2", False), ("t", "4", "new", "strong_match", "url", "g3", False),
            ("t", "5", "new", "strong_match", None, "g4", True), ("t", "6", "closed", "reject", None, None, None), ("t", "7", "new", "needs_review", "url", "g5", False), ("u", "8", "new", "reject", None, "g6", False)]
    frame = spark.createDataFrame(rows, "target_identity string, job_id string, lifecycle string, decision string, history string, group_id string, delivered boolean")
    got = {r["target_identity"]: tuple(r)[1:] for r in reports.target_capacity(frame).collect()}
    assert got == {"t": (7, 4, 1, 1, 1, 4, 1, 1, 1, 5, 1, 1, 3, 1, 1, 1), "u": (1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0)}
    assert tuple(reports.group_replay(frame.withColumn("f", F.lit("x")), "f").first()) == ("x", 8, 5, 4, 1, 4)
    flags = spark.createDataFrame([(True, True, None, False, False), (False, None, True, False, False), (None, False, False, False, None), (False, False, False, False, True)], "unresolved boolean, selected_batch boolean, candidate_batch boolean, delivered boolean, exported boolean")
    assert tuple(reports.prune_summary(flags).first()) == (1, 2, 1)
    boards = spark.createDataFrame([("success", 3, 3, 0, 0, 1), ("partial", 5, 4, 1, 2, None)], "status string, discovered int, normalized int, quarantined int, errors int, delivered int")
    assert {r["status"]: tuple(r)[1:] for r in reports.production_summary(boards).collect()} == {None: (2, 8, 7, 1, 2, 1), "success": (1, 3, 3, 0, 0, 1), "partial": (1, 5, 4, 1, 2, 0)}


def test_tiers(spark):
    edges = [0, 1, 9, 10, 49, 50, 99, 100, 499, 500, 10**6]
    rows = spark.createDataFrame([(n,) for n in edges], "n int").select("n", reports.inventory_bucket(F.col("n")), reports.cost_tier(F.col("n"), F.lit(True)), reports.cost_tier(F.col("n"), F.col("n") < 0)).collect()
    assert [r[1] for r in rows] == ["0", "1-9", "1-9", "10-49", "10-49", "50-99", "50-99", "100-499", "100-499", "500+", "500+"]
    assert [r[2] for r in rows][3:] == ["exact_1_49"] * 2 + ["exact_50_99"] * 2 + ["exact_100_499"] * 2 + ["exact_500_plus"] * 2 and {r[3] for r in rows} == {"potentially_capped"}


def test_imports_are_idempotent(spark):
    records = spark.createDataFrame([("c1", "w1", i) for i in range(3)] + [("c1", "w2", 9), ("c2", "w1", 7)], "client_id string, workbook_sha256 string, row int")
    new, counts = reports.import_records(records, spark.createDataFrame([("c1", "w1")] * 2, "client_id string, workbook_sha256 string"))
    assert sorted(tuple(r) for r in new.collect()) == [("c1", "w2", 9), ("c2", "w1", 7)]
    assert {tuple(r)[:2]: tuple(r)[2:] for r in counts.collect()} == {("c1", "w1"): (0, 3), ("c1", "w2"): (1, 0), ("c2", "w1"): (1, 0)}


def test_exports_of_groups(spark):
    members = spark.createDataFrame([("j1", "g1"), ("j2", "g1"), ("j3", "g2"), ("j4", "g3")], "job_id string, group_id string")
    request = lambda rows: spark.createDataFrame(rows, "job_id string, client_id string, destination string, exported_at int")
    stored = spark.createDataFrame([("g3", "c", "d", "j9", 1)], "group_id string, client_id string, destination string, job_id string, exported_at int")
    exports = spark.createDataFrame([("j3", "c", "d", 0)], "job_id string, client_id string, destination string, exported_at int")
    new, out = reports.mark_exported(request([("j2", "c", "d", 5), ("j1", "c", "d", 5), ("j1", "c", "e", 9), ("j3", "c", "d", 2), ("j4", "c", "d", 3)]), members, stored, exports)
    assert sorted(tuple(r) for r in new.collect()) == [("g1", "c", "d", "j1", 5), ("g1", "c", "e", "j1", 9), ("g2", "c", "d", "j3", 2)]
    assert sorted(tuple(r) for r in out.collect()) == [("j1", "c", "d", 5), ("j1", "c", "e", 9)]
    with pytest.raises(Exception, match="no delivery group: j8"):
        reports.mark_exported(request([("j8", "c", "d", 1)]), members, stored, exports)[0].collect()


def test_payload_edits(spark):
    old = '{"title": "Ö", "last_seen_at": "t1", "raw": {"b": 1, "a": [true, null]}, "n": 1.5}'
    rows = spark.createDataFrame([(1, old, '{"n":1.5,"raw":{"a":[true,null],"b":1},"title":"Ö"}'), (2, old, '{"title":"new","n":1.5}'), (3, None, '{"title":"new"}')], "i int, old string, new string")
    got = {r["i"]: (r["e"], r["k"]) for r in rows.select("i", reports.edited(F.col("old"), ["last_seen_at"], {"raw": "null", "x": "[1]"}).alias("e"), reports.refreshed(F.col("old"), F.col("new"), ["last_seen_at"]).alias("k")).collect()}
    assert json.loads(got[1][0]) == {"title": "Ö", "raw": None, "x": [1], "n": 1.5}
    assert json.loads(got[1][1]) == {"title": "Ö", "raw": {"b": 1, "a": [True, None]}, "n": 1.5} and json.loads(got[2][1]) == {"title": "new", "n": 1.5} and json.loads(got[3][1]) == {"title": "new"}
    light = json.loads(rows.select(reports.compacted(F.lit('{"description_text":"x","offices":[1],"id":2}'))).first()[0])
    assert light == {"id": 2, "description_text": None, "description_html": None, "offices": [], "raw_metadata": {}}


def test_health_changes_and_merged_members(spark):
    checks = spark.createDataFrame([("t1", 1, "active"), ("t1", 2, "missing"), ("t1", 3, "active"), ("t2", 1, "empty"), ("t2", 2, "active"), ("t3", 1, "empty"), ("t1", 4, "active")], "t string, at int, h string")
    assert {r["reason"]: tuple(r)[1:] for r in reports.health_changes(checks, "t", "at", "h").collect()} == {"first_check": (3, 1, 0), "active": (2, 0, 0), "missing": (1, 0, 1), "empty": (1, 1, 0)}
    moved = reports.latest_members(spark.createDataFrame([("j", "g1"), ("k", "g2")], "job_id string, group_id string"), spark.createDataFrame([("g1", "g0")], "from_group string, to_group string"))
    assert sorted(tuple(r) for r in moved.collect()) == [("j", "g0"), ("k", "g2")]
