"""Target universe and health summaries against the statistics module."""

import collections
import random
import statistics

from pyspark.sql import functions as F

from gleaner.operators import universe


def test_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["t1", "t2", "t3", None]), f"u{rng.randrange(5)}", rng.choice(["Acme", "acme", "Beta", "", None])) for i in range(60)]
    frame = spark.createDataFrame([(i, t, t and f"s{t[1]}", u, c, "why" if t is None else None) for i, t, u, c in rows], "i int, identity string, source string, url string, company string, reason string")
    got = {r["identity"]: (r["source"], r["occurrences"], r["distinct_urls"], tuple(r["first"]), tuple(r["last"]), r["company"]) for r in universe.targets(frame.repartition(3), ["i"]).collect()}
    want = {}
    for t in ("t1", "t2", "t3"):
        own = [r for r in rows if r[1] == t]
        names = collections.Counter(r[3] for r in own if r[3])
        want[t] = (f"s{t[1]}", len(own), len({r[2] for r in own}), (own[0][0], own[0][2]), (own[-1][0], own[-1][2]), min(names, key=lambda c: (-names[c], c.lower(), c), default=None))
    assert got == want
    lost = [r for r in rows if r[1] is None]
    assert [tuple(r) for r in universe.unresolved(frame, ["i"]).collect()] == [("why", len(lost), [r[2] for r in lost[:10]])]


def test_distributions_and_health(spark):
    rng = random.Random(4)
    rows = [(f"t{i:03}", rng.choice("ab"), rng.choice(["active", "active", "valid_empty", "missing"]), rng.choice([None, 0, 3, 12, 60, 120, 900, -1]), rng.choice([True, False, None]), rng.choice([0, 1, 2, 7, 24, 25, 99])) for i in range(150)]
    frame = spark.createDataFrame(rows, "target_identity string, source string, classification string, current_postings int, inventory_exact boolean, historical_occurrence_count int")
    held = lambda r: r[3] if r[2] in ("active", "valid_empty") and r[3] is not None and r[3] >= 0 else None
    got = {r["source"]: r for r in universe.health_summary(frame, ["active", "missing", "blocked"]).collect()}
    for s in "ab":
        own = [r for r in rows if r[1] == s]
        active = [held(r) for r in own if r[2] == "active" and held(r) is not None]
        every = [held(r) for r in own if held(r) is not None]
        r = got[s]
        assert (r["targets"], r["active"], r["missing"], r["blocked"]) == (len(own), sum(x[2] == "active" for x in own), sum(x[2] == "missing" for x in own), 0)
        assert r["postings"] == sum(every) and r["median_postings"] == statistics.median(active) and abs(r["mean_postings"] - statistics.mean(active)) < 0.006 and r["maximum_postings"] == max(every)
        assert r["inventory_0"] == every.count(0) and r["inventory_500_plus"] == every.count(900) and r["potentially_capped"] == sum(x[4] is False for x in own)
    bands = {r["band"]: r for r in universe.occurrence_health(frame).collect()}
    own = [r for r in rows if 10 <= r[5] <= 24]
    assert set(bands) == {"1", "2-4", "5-9", "10-24", "25+"} and bands["10-24"]["targets"] == len(own) and bands["10-24"]["median_postings"] == statistics.median(x for x in map(held, own) if x is not None)
    best = sorted((r for r in rows if held(r) is not None), key=lambda r: (-held(r), r[0]))[:20]
    assert [r["target_identity"] for r in universe.largest(frame).collect()] == [r[0] for r in best]


def test_compared_ids(spark):
    rows = spark.createDataFrame([("b", ["1", "2", "2"], ["2", "3", "4"]), ("c", None, ["1"])], "board string, historical array<string>, live array<string>")
    assert {r["board"]: tuple(r)[1:] for r in universe.compared_ids(rows).collect()} == {"b": (1, 1, 2), "c": (0, 0, 1)}
