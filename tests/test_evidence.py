"""Bases, guards, ladders and sets on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import evidence


def test_basis_by_precedence(spark):
    rng = random.Random(2)
    posts = [(i, rng.choice("cd"), rng.choice("xy"), "s", rng.choice("ab"), rng.choice(["1", "2", None]), rng.choice(["u1", "u2", "u3", None])) for i in range(80)]
    link = lambda n: [(rng.choice("cd"), rng.choice("xy"), "s", rng.choice("ab"), rng.choice(["1", "2", None]), rng.choice(["u1", "u2", "u9", None])) for _ in range(n)]
    history, seen = link(3), link(4)
    got = evidence.surfaced_basis(
        spark.createDataFrame(posts, "id int, client_id string, destination string, source string, source_board_id string, source_job_id string, canonical_url string"),
        spark.createDataFrame(history, "client_id string, other string, source string, source_board_id string, source_job_id string, normalized_url string"),
        spark.createDataFrame(seen, "client_id string, destination string, source string, source_board_id string, source_job_id string, normalized_url string"))
    want = {}
    for i, client, at, *identity, url in posts:
        basis = None
        for prefix, links, where in (("", history, 1), ("observed_", seen, 2)):
            own = [x for x in links if x[:where] == (client, at)[:where]]
            for name, hit in (("identity", None not in identity and any(list(x[2:5]) == identity for x in own)), ("url", url is not None and any(x[5] == url for x in own))):
                basis = basis or (prefix + name if hit else None)
        want[i] = basis
    assert {r["id"]: r["basis"] for r in got.collect()} == want and len(set(want.values())) >= 4


def test_release_guard(spark):
    ready = {"client_id": "c", "destination_id": "d", "profile_client_id": "c", "profile_destination_id": "d", "status": "prepared", "export_after": None, "observed_digest": "o", "delivery_mode": "review", "include_review": True, "profile_status": "active", "selected": 3, "daily_quota": 5, "delivered_today": 2}
    cases = {
        "ready": {}, "not_owned": {"destination_id": "x", "status": "delivered"}, "already_delivered": {"status": "delivered", "profile_status": "paused"}, "recover_journal": {"export_after": "o", "selected": 99}, "mode_changed": {"delivery_mode": "auto", "profile_status": "paused"},
        "paused": {"profile_status": None, "selected": 99}, "quota_exceeded": {"delivered_today": 4},
    }
    shape = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in ready.items())
    rows = spark.createDataFrame([(k, *(ready | v).values()) for k, v in cases.items()], "want string, " + shape)
    got = evidence.release_guard(rows).collect()
    assert [r["guard"] for r in got] == [r["want"] for r in got] and {r["remaining"] for r in got} == {3, 1}


def test_digests_refuse_repeats(spark):
    rows = spark.createDataFrame([("b", 2, "x"), ("b", 1, "y"), ("e", 1, "z")], "s string, i int, id string")
    one, other = (evidence.ordered_digest(rows.orderBy(F.desc("id")) if k else rows, ["s"], ["i"], F.col("id"), ["id"]).orderBy("s").collect() for k in (0, 1))
    assert one == other and [r["parts"] for r in one] == [2, 1]
    with pytest.raises(Exception, match="candidate twice"):
        evidence.ordered_digest(rows.union(spark.createDataFrame([("b", 9, "x")], rows.schema)), ["s"], ["i"], F.col("id"), ["id"]).collect()


def test_complete_sets(spark):
    parts = spark.createDataFrame([("whole", i) for i in (2, 1, 3)] + [("gap", 1), ("gap", 3)] + [("twice", 1), ("twice", 1), ("twice", 2)] + [("more", 1), ("unknown", 1)], "s string, n int")
    declared = spark.createDataFrame([("whole", 3), ("gap", 3), ("twice", 2), ("more", 2), ("none", 2), ("empty", 0)], "s string, declared int")
    got = {r["s"]: (r["complete"], r["missing"], r["repeated"]) for r in evidence.complete_sets(parts, ["s"], "n", declared).collect()}
    assert got == {"whole": (True, 0, 0), "gap": (False, 1, 0), "twice": (False, 0, 1), "more": (False, 1, 0), "unknown": (False, 0, 0), "none": (False, 2, 0), "empty": (True, 0, 0)}


def test_ladder_and_projection(spark):
    base = {"decision": "strong_match", "historical": False, "delivered": None, "stale": None, "eligible": True, "group_id": None, "employer": "e"}
    cases = [("reject", {"decision": "reject", "historical": True}), ("historical", {"historical": True, "stale": "stale_posting"}), ("delivered", {"delivered": True}), ("stale_posting", {"stale": "stale_posting"}), ("not_eligible", {"eligible": False}),
             ("deliverable", {"group_id": "g"}), ("duplicate", {"group_id": "g"}), ("deliverable", {}), ("company_cap", {}), ("deliverable", {"employer": "f"}), ("stale_posting", {"group_id": "h", "stale": "stale_posting"}), ("deliverable", {"group_id": "h", "employer": "k"})]
    rows = spark.createDataFrame([(i, want, *(base | v).values()) for i, (want, v) in enumerate(cases)], "i int, want string, decision string, historical boolean, delivered boolean, stale string, eligible boolean, group_id string, employer string")
    assert all(r["outcome"] == r["want"] for r in evidence.outcome_ladder(rows, [F.col("i")], 2).collect())
    posts = spark.createDataFrame([(1, "g", "url", True), (2, "g", None, None), (3, "h", None, True), (4, "h", None, False), (5, None, None, None)], "i int, g string, history string, delivered boolean")
    assert {r["i"]: r["outcome"] for r in evidence.projected(posts, "g", ["i"]).collect()} == {1: "url", 2: "duplicate", 3: "delivered", 4: "duplicate", 5: "fresh"}


def test_second_pass_must_be_idle(spark):
    a, b = spark.createDataFrame([("t",), ("t",), ("u",)], "t string"), spark.createDataFrame([("u",), ("v",)], "t string")
    assert {r["t"]: tuple(r)[1:] for r in evidence.two_passes(a, b, "t").collect()} == {None: (3, 3, 2, 2), "t": (1, 2, 0, 0), "u": (1, 1, 1, 1), "v": (1, 0, 1, 1)}
    assert evidence.two_passes(a, b.limit(0), "t").where("t IS NULL").first()["not_idle"] == 0
