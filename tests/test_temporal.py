"""As-of and interval joins, running sums and sliding lookbacks against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import temporal

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def at(minutes):
    return None if minutes is None else T0 + datetime.timedelta(minutes=minutes)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_asof_join(spark, seed, strict):
    rng = random.Random(seed)
    some = lambda n: [(i, rng.choice(["hot"] * 6 + ["a", "b", "left only", None]), rng.choice([None, *range(60)])) for i in range(n)]
    left, right = some(150), [r for r in some(120) if r[1] != "left only"]
    shape = "id int, k string, at timestamp"
    frame = lambda rows: spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], shape).repartition(3)
    got = {r["id"]: r["match"] and r["match"]["id"] for r in temporal.asof_join(frame(left), frame(right), ["k"], "at", "at", ["id"], strict).collect()}
    want = {}
    for i, k, t in left:
        before = [(u, j) for j, q, u in right if q == k is not None and None not in (t, u) and (u < t or (u == t and not strict))]
        want[i] = max(before)[1] if before else None
    assert got == want


def test_carries_pass_parts_without_a_match(spark):
    left = spark.range(3000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") + 10).alias("at"), "id")
    right = spark.createDataFrame([("k", datetime.datetime(1970, 1, 1, 0, 0, 5), 7)], "k string, at timestamp, v int")
    assert {r["match"]["v"] for r in temporal.asof_join(left, right, ["k"], "at", "at").collect()} == {7}


def test_running_sum(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaab"), i, rng.randrange(-5, 6)) for i in rng.sample(range(1000), 400)]
    got = {r["i"]: r["s"] for r in temporal.running_sum(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], "v", "s").collect()}
    assert got == {i: sum(v for q, j, v in rows if q == k and j <= i) for k, i, _ in rows}


@pytest.mark.parametrize("spread", [1, 8])
def test_interval_join(spark, spread):
    rng = random.Random(spread)
    points = [(i, rng.choice(["hot"] * 9 + ["a", None]), rng.choice([None, *range(3000)])) for i in range(300)]
    spans = []
    for i in range(80):
        s = rng.randrange(3000)
        spans.append((i, rng.choice(["hot"] * 5 + ["a", "b", None]), s, s + rng.choice([-3, 0, 1, 2, 60, 700, 100_000])))
    spans.append((99, "hot", None, 5))
    p = spark.createDataFrame([(i, k, at(t)) for i, k, t in points], "id int, k string, ts timestamp")
    s = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in spans], "id int, k string, a timestamp, b timestamp")
    got = sorted((r["id"], r["interval"]["id"]) for r in temporal.interval_join(p, s, ["k"], "ts", "a", "b", spread).collect())
    assert got == sorted((i, j) for i, k, t in points for j, q, a, b in spans if k == q is not None and None not in (t, a) and a <= t < b)
    assert temporal.interval_join(p, s.limit(0), ["k"], "ts", "a", "b").collect() == []


def test_local_days(spark):
    row = spark.createDataFrame([(datetime.datetime(2024, 3, 10, 12, tzinfo=datetime.UTC), "America/New_York")], "t timestamp, z string")
    start, stop = temporal.local_day(F.col("t"), F.col("z"))
    start, stop = row.select(F.date_format(start, "MM-dd HH"), F.date_format(stop, "MM-dd HH")).first()
    assert (start, stop) == ("03-10 05", "03-11 04")  # a day of 23 hours


def test_lookback_at_every_moment(spark):
    rng = random.Random(8)
    seen = [(rng.choice(["t1"] * 5 + ["t2"]), rng.choice("abcdef"), rng.choice([None, *range(0, 20_000, 60)])) for _ in range(150)]
    probes = [(i, rng.choice(["t1", "t2", "t3"]), rng.choice([*range(0, 26_000, 30)])) for i in range(300)]
    steps = temporal.active_counts(spark.createDataFrame([(g, j, at(t)) for g, j, t in seen], "target string, job string, ts timestamp"), ["target"], "job", "ts", 72)
    moments = spark.createDataFrame([(i, g, at(t)) for i, g, t in probes], "id int, target string, now timestamp")
    got = {r["id"]: r["active"] for r in temporal.active_at(moments, steps, ["target"], "now").collect()}
    assert got == {i: len({j for q, j, u in seen if q == g and u is not None and t - 72 * 60 <= u <= t}) for i, g, t in probes}
