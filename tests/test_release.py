"""Page loops, index coverage, evidence, review, release checks, removals and recovery against plain versions."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import matching, release
from gleaner.sources import boards

NOW = datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC)


def read_board(pages, width):
    """Pages in order, as a collector asks for them."""
    seen, ids, taken, rejected, received, ended = set(), set(), 0, 0, 0, "pages_missing"
    while taken in pages:
        page = ["" if x is None else x for x in pages[taken]]
        if (mark := tuple(sorted(page))) in seen:
            ended = "repeated_page"
            break
        seen.add(mark)
        taken, received = taken + 1, received + len(page)
        for x in page:
            rejected += x == "" or x in ids
            ids.add(x)
        if len(page) < width:
            ended = "short_page"
            break
    return taken, received, received - rejected, rejected, ended, "success" if not rejected and ended == "short_page" else "partial"


def test_boards(spark):
    rng, known = random.Random(1), {}
    for b in range(60):
        pages, fresh = {}, iter(range(10_000))
        for p in range(rng.randrange(6)):
            how = rng.random()
            if how < 0.2 and pages:
                pages[p] = rng.sample(known_page := rng.choice(list(pages.values())), len(known_page))  # a loop, in another order
            else:
                pages[p] = [str(next(fresh)) if rng.random() < 0.95 else rng.choice(["0", "1", None, ""]) for _ in range(rng.choice([5, 5, 5, 3, 0]))]
        if rng.random() < 0.2 and pages:
            del pages[rng.choice(list(pages))]
        known[f"b{b}"] = pages
    rows = [(b, p, ids) for b, pages in known.items() for p, ids in pages.items()]
    got = {r["board"]: tuple(r)[1:] for r in boards.board_results(spark.createDataFrame(rng.sample(rows, len(rows)), "board string, page int, ids array<string>"), 5).collect()}
    assert got == {b: read_board(pages, 5) for b, pages in known.items() if pages}
    assert {r[4] for r in got.values()} == {"short_page", "repeated_page", "pages_missing"}


INDEX = "target string, scope string, page int, total int, paths array<string>"


def test_index_coverage(spark, monkeypatch):
    monkeypatch.setattr(boards, "CAP", 4)
    paths = lambda name, n: [f"{name}{i}" for i in range(n)]
    pages = [
        ("whole", None, 0, 3, paths("a", 2)), ("whole", None, 1, 3, ["a9"]), ("short", None, 0, 3, paths("a", 2)), ("twice", None, 0, 2, ["a", "a"]), ("none", None, 0, None, None), ("blank", None, 0, 2, ["a", None]),
        ("beyond", None, 0, 6, paths("a", 6)), ("beyond short", None, 0, 6, paths("a", 5)), ("cut", None, 0, 4, paths("a", 4)), ("empty", None, 0, 0, []),
    ]
    facets = []
    for target, second in (("parts", paths("y", 3)), ("overlap", ["x0", "y1", "y2"]), ("open", paths("y", 2)), ("one facet", None), ("small", paths("y", 1))):
        pages += [(target, None, 0, 4, paths("x", 3) + paths("y", 1)), (target, "f1", 0, 3, paths("x", 3))]
        facets.append((target, "f1", 3))
        if second is not None:
            pages.append((target, "f2", 0, 3 if target != "small" else 1, second))
            facets.append((target, "f2", 3 if target != "small" else 1))
    got = {r["target"]: tuple(r)[1:] for r in boards.index_coverage(spark.createDataFrame(pages, INDEX), spark.createDataFrame(facets, "target string, identifier string, advertised int")).collect()}
    assert got == {
        "whole": (3, 3, 3, "broad", 0, "success"), "short": (3, 2, 2, "broad", 1, "partial"), "twice": (2, 2, 1, "broad", 1, "partial"), "none": (None, 0, 0, "unknown", 1, "partial"), "blank": (2, 2, 1, "broad", 2, "partial"),
        "beyond": (6, 6, 6, "broad", 0, "success"), "beyond short": (6, 5, 5, "capped_partial", 2, "partial"), "cut": (4, 4, 4, "capped_partial", 1, "partial"), "empty": (0, 0, 0, "broad", 0, "success"),
        "parts": (4, 10, 6, "job_family_group_partition", 0, "success"), "overlap": (4, 10, 6, "capped_partial", 1, "partial"), "open": (4, 9, 5, "capped_partial", 2, "partial"),
        "one facet": (4, 4, 4, "capped_partial", 1, "partial"), "small": (4, 4, 4, "capped_partial", 1, "partial"),
    }


def test_evidence(spark):
    job = {"id": "1", "title": 'Ö "x"\n', "eligible_countries": ["B", "A"], "n": 3, "flag": True, "last_seen_at": "t1", "none": None}
    match = {"decision": "reject", "reasons": ["b", "a"], "evaluated_at": "t2"}
    shape = "id string, title string, eligible_countries array<string>, n int, flag boolean, last_seen_at string, `none` string, decision string, reasons array<string>, evaluated_at string"
    rows = spark.createDataFrame([tuple((job | match).values()), tuple((job | match | {"last_seen_at": "later", "evaluated_at": None, "eligible_countries": ["A", "B"]}).values()), tuple((job | match | {"reasons": ["a", "b"]}).values())], shape)
    got = [r[0] for r in rows.select(release.evidence(rows, list(job), list(match))).collect()]
    plain = [{k: v for k, v in job.items() if k != "last_seen_at"} | {"eligible_countries": ["A", "B"]}, {"decision": "reject", "reasons": ["b", "a"]}]
    want = hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got[0] == got[1] == want != got[2]


BATCHES = "batch_id string, generation_id string, status string, max_hours int, unknown_policy string, include_review boolean, export_before string, export_after string"
CANDIDATES = "batch_id string, job_id string, evidence_sha256 string, group_id string, posted_at timestamp, decision string, historical boolean, delivered boolean"


def test_review_and_release_checks(spark):
    ago = lambda h: None if h is None else NOW - datetime.timedelta(hours=h)
    cases = {
        "fine": ("e", "g1", ago(1), "strong_match", False, False), "edited": ("other", "g2", ago(1), "strong_match", False, False), "old": ("e", "g3", ago(99), "possible_match", False, False), "ageless": ("e", "g4", None, "strong_match", False, False),
        "ahead": ("e", "g5", ago(-9), "strong_match", False, False), "history": ("e", "g6", ago(1), "strong_match", True, False), "sent": ("e", "g7", ago(1), "strong_match", False, True), "asks": ("e", "g8", ago(1), "needs_review", False, False),
        "out": ("e", "g9", ago(1), "reject", False, False), "twin 1": ("e", "g0", ago(1), "strong_match", False, False), "twin 2": ("e", "g0", ago(1), "strong_match", False, False), "worst": ("other", "g10", ago(99), "reject", True, True),
    }
    candidates = [("b1", j, *c) for j, c in cases.items()] + [("b2", "fine", *cases["fine"]), ("b2", "asks", *cases["asks"]), ("b3", "fine", *cases["fine"])]
    items = [("b1", i, j, "e") for i, j in enumerate([*cases, "missing"], 1)] + [("b2", 1, "fine", "e"), ("b2", 2, "asks", "e"), ("b3", 1, "fine", "e")]
    batches = [("b1", "x", "prepared", 72, "reject", False, None, None), ("b2", "x", "prepared", 72, "reject", True, None, None), ("b3", "x", "prepared", 72, "allow", True, "h", None)]
    frames = spark.createDataFrame(items, "batch_id string, ordinal int, job_id string, evidence_sha256 string"), spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(batches, BATCHES)
    at = F.lit(NOW)
    bad = {(r["batch_id"], r["job_id"]): r["violation"] for r in release.violations(*frames, at).collect()}
    assert bad == {("b1", k): v for k, v in {
        "edited": "evidence_changed", "old": "stale_posting", "ageless": "posting_age_unknown", "ahead": "posting_time_invalid", "history": "historical", "sent": "delivered", "asks": "decision",
        "out": "decision", "twin 1": "groups_merged", "twin 2": "groups_merged", "worst": "stale_posting", "missing": "candidate_missing"}.items()}
    rows = {(r["batch_id"], r["job_id"]): r for r in release.review(*frames, at).collect()}
    assert {k: (r["safe_to_release"], r["recovery_required"]) for k, r in rows.items() if k[1] == "fine"} == {("b1", "fine"): (False, False), ("b2", "fine"): (True, False), ("b3", "fine"): (False, True)}
    assert {k[1] for k, r in rows.items() if r["release_ready"] and k[0] == "b1"} == {"fine", "twin 1", "twin 2"}
    told = lambda j: rows["b1", j]["warnings"]
    assert told("fine") == [] and len(told("worst")) == 5 and told("edited")[0].startswith("Job or match evidence changed") and told("asks") == ["The deterministic matcher requires human review for this job."]
    assert rows["b2", "asks"]["release_ready"] and len(rows["b2", "asks"]["warnings"]) == 1


@pytest.mark.parametrize("bucket", [1, 7, 100_000])
def test_removals(spark, monkeypatch, bucket):
    monkeypatch.setattr(release, "BUCKET", bucket)
    rng = random.Random(bucket)
    items = [(b, o, f"{b}{o}") for b in ("x", "y", "z") for o in range(1, 60)]
    gone = [(b, o) for b, o, _ in items if b != "z" and rng.random() < 0.3] + [("x", 999), ("q", 1)]
    got = sorted(tuple(r) for r in release.renumbered(spark.createDataFrame(items, "batch_id string, ordinal int, job string"), spark.createDataFrame(gone * 2, "batch_id string, ordinal int")).collect())
    want = [(b, i, j) for b in ("x", "y", "z") for i, (_, j) in enumerate(((o, j) for c, o, j in items if c == b and (c, o) not in set(gone)), 1)]
    assert got == sorted(want)


def test_requests_to_remove(spark):
    batches = [(b, f"gen {b}", "delivered" if b == "sent" else "prepared", 72, "reject", True, "h" if b == "journal" else None, None) for b in ("ok", "sent", "journal", "all", "odd", "old", "zero")]
    items = [(b, o, f"{b}{o}") for b, *_ in batches for o in (1, 2, 3)]
    requests = [("ok", "gen ok", [2, 2]), ("sent", "gen sent", [1]), ("journal", "gen journal", [1]), ("all", "gen all", [3, 1, 2]), ("odd", "gen odd", [1, 9]), ("old", "gen 0", [1]), ("zero", "gen zero", [0, 1]), ("lost", "g", [1]), ("no", None, [1]), ("nil", "g", [])]
    answers, after, left = release.remove_items(spark.createDataFrame(requests, "batch_id string, generation_id string, ordinals array<int>"), spark.createDataFrame(batches, BATCHES), spark.createDataFrame(items, "batch_id string, ordinal int, job string"))
    assert {r["batch_id"]: r["answer"] for r in answers.collect()} == {
        "ok": "removed", "sent": "not_editable", "journal": "not_editable", "all": "every_item", "odd": "unknown_item", "old": "revision_changed", "zero": "not_positive", "lost": "no_batch", "no": "no_generation", "nil": "nothing_asked"}
    assert {r["batch_id"] for r in after.collect() if r["generation_id"] != f"gen {r['batch_id']}"} == {"ok"}
    assert sorted((r["ordinal"], r["job"]) for r in left.where("batch_id = 'ok'").collect()) == [(1, "ok1"), (2, "ok3")] and left.count() == 3 * 7 - 1
    again, _, same = release.remove_items(spark.createDataFrame(requests[:1], "batch_id string, generation_id string, ordinals array<int>"), after, left)
    assert again.first()["answer"] == "revision_changed" and same.count() == left.count()


def resolved(batches):
    """One batch after the other, as under a lock."""
    discard, following = set(), {}
    for where in {b[1:3] for b in batches}:
        for b in sorted((b for b in batches if b[1:3] == where and b[4] != "delivered"), key=lambda b: (b[3], b[0])):
            journal, old = b[7] is not None or b[8] is not None, b[4] == "failed" and (b[5] or "").startswith(release.NO_LONGER_FRESH) and b[6] is None
            if not (b[4] == "prepared" or journal or old):
                continue
            if old and not journal:
                discard.add(b[0])
                continue
            following[where] = (b[0], "reconcile" if journal else "release")
            break
    return discard, following


def test_recovery(spark):
    rng = random.Random(6)
    rows = [
        (f"b{i}", rng.choice("xy"), rng.choice("123456"), rng.randrange(30), rng.choice(["prepared", "failed", "failed", "failed", "delivered"]), rng.choice([None, release.NO_LONGER_FRESH + " stale_posting", release.NO_LONGER_FRESH, "disk full"]),
         rng.choice([None, None, "t"]), rng.choice([None, None, None, "h"]), rng.choice([None, None, None, "h"]))
        for i in range(90)
    ]
    gone, following = release.recover(spark.createDataFrame(rows, "batch_id string, client_id string, destination string, assembled_at int, status string, error string, delivered_at string, export_before string, export_after string"))
    discard, want = resolved(rows)
    assert {r["batch_id"] for r in gone.collect()} == discard and discard
    assert {(r["client_id"], r["destination"]): (r["batch_id"], r["action"]) for r in following.collect()} == want


def test_index_first(spark):
    rows = [("ok", "p1", "Data Engineer", 1), ("ok", "p2", "Data Engineer", 30), ("ok", "p3", None, None), ("ok", "p4", "Cook", 1), ("ok", "p5", "Lead Data Engineer", None), ("part", "p1", "Cook", 30), ("lost", "p1", "Data Engineer", 1)]
    index = spark.createDataFrame(rows, "target string, path string, title string, age_days int")
    coverage = spark.createDataFrame([("ok", "success"), ("part", "partial")], "target string, status string")
    brief = ("c", ["data engineer"], "ignore", ["lead"], [], ([], "ignore", "review"), ([], "ignore", "review"), ([], "ignore", "review"), ([], "ignore", "review"), None, [], [], [])
    planned = boards.index_first(index, coverage, spark.createDataFrame([brief], matching.BRIEF))
    got = {(r["target"], r["path"]): r["action"] for r in planned.collect()}
    assert got == {("ok", "p1"): "candidate", ("ok", "p2"): "stale_skipped", ("ok", "p3"): "uncertain_title", ("ok", "p4"): "title_skipped", ("ok", "p5"): "title_skipped", ("part", "p1"): "full_collection", ("lost", "p1"): "full_collection"}
    assert {r["target"]: tuple(r)[1:] for r in boards.index_first_counts(planned).collect()} == {"ok": (False, 1, 2, 1, 2, 5), "part": (True, 0, 0, 0, 0, 1), "lost": (True, 0, 0, 0, 0, 1)}
    details = spark.createDataFrame([(t, f"p{i}") for t in ("ok", "part") for i in range(1, 8)], "target string, path string")
    assert sorted(tuple(r) for r in boards.hydrated(details, planned).collect()) == [("ok", "p1"), ("ok", "p3")] + [("part", f"p{i}") for i in range(1, 8)]
    none = boards.index_first(index, coverage, spark.createDataFrame([], matching.BRIEF))
    assert {r["action"] for r in none.where("target = 'ok'").collect()} == {"stale_skipped", "title_skipped"}
