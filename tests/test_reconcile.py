"""Reconciliation, suppression, fan-in and coverage proofs against plain versions."""

import datetime
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import coverage, grouping, reconcile
from gleaner.sources import journal

NOW = datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC)
SHAPE = "a string, b int, v string, w int"


def compared(x, y):
    one, two = {}, {}
    for rows, found in ((x, one), (y, two)):
        for r in rows:
            found.setdefault(r[:2], []).append(r)
    out = {}
    for k in one.keys() | two.keys():
        p, q = one.get(k, []), two.get(k, [])
        if max(len(p), len(q)) > 1:
            if sorted(p, key=str) != sorted(q, key=str):
                out[k] = "repeated"
        elif p != q:
            out[k] = "first_only" if not q else "second_only" if not p else "changed"
    return out


@pytest.mark.parametrize("changes", [0, 3, 400])
def test_differences(spark, changes, monkeypatch):
    monkeypatch.setattr(reconcile, "FAN_BITS", 4)
    rng = random.Random(changes)
    value = lambda: (rng.choice([None, "x", "y"]), rng.choice([None, 0, 1, 2]))
    first = [(rng.choice([None, "k", "l"]) if i < 3 else f"k{i}", i, *value()) for i in range(600)]
    second = list(first)
    for _ in range(changes):
        i = rng.randrange(len(second))
        how = rng.randrange(3)
        second[i : i + 1] = [] if how == 0 else [(*second[i][:2], *value())] if how == 1 else [second[i], (f"n{i}", i, *value())]
    frame = lambda rows: spark.createDataFrame(rng.sample(rows, len(rows)), SHAPE)
    got = {(r["a"], r["b"]): r["status"] for r in reconcile.differences(frame(first), frame(second), ["a", "b"], ["v", "w"]).collect()}
    want = compared(first, second)
    repeated = {k for k, s in got.items() if s == "repeated"}  # a repeated key beside a difference is told, too
    assert {k: s for k, s in got.items() if k not in repeated} == {k: s for k, s in want.items() if s != "repeated"} and {k for k, s in want.items() if s == "repeated"} <= repeated
    assert reconcile.differences(frame(first).limit(0), frame(first).limit(0), ["a", "b"], ["v", "w"]).collect() == []


def test_few_rows_move_for_few_differences(spark):
    first = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    second = first.where("k != 77").withColumn("v", F.when(F.col("k") == 4711, 9).otherwise(F.col("v")))
    a, b = reconcile.differing(first, second, ["k"], ["v"])
    assert a.count() <= 8 and b.count() <= 8
    assert {(r["k"], r["status"]) for r in reconcile.differences(first, second, ["k"], ["v"]).collect()} == {(77, "first_only"), (4711, "changed")}
    assert reconcile.stability(first.withColumn("f", F.lit(1)), second.withColumn("f", F.when(F.col("k") == 5, 2).otherwise(1)), ["k"], ["v"], "f").first() == (1, 0, 49_999, 1, 1)


def test_suppression(spark):
    rows = [(i, "s", f"b{i % 3}", f"jö{i}", f"https://x.org/{i}") for i in range(400)] + [(999, "s", "b", None, None)]
    shape = "id int, source string, source_board_id string, source_job_id string, canonical_url string"
    by_identity = [hashlib.sha256(json.dumps(list(r[1:4]), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for r in rows[:40]]
    by_url = [hashlib.sha256(r[4].encode()).hexdigest() for r in rows[30:60]]
    one = lambda x: spark.createDataFrame([(v,) for v in x], "d string")
    kept = reconcile.not_surfaced(spark.createDataFrame(rows, shape), one(by_identity + ["0" * 64]), one(by_url))
    assert sorted(r["id"] for r in kept.collect()) == [r[0] for r in rows[60:]] and kept.columns == shape.replace(" int", "").replace(" string", "").split(", ")
    assert reconcile.not_surfaced(spark.createDataFrame(rows, shape), one([]), one([])).count() == len(rows)


POST = "shard int, target_identity string, id string, source string, source_board_id string, source_job_id string, canonical_url string, fingerprint string, posted_at timestamp"


def posting(shard, i, target="t", hours=1, **more):
    known = {"id": f"i{i}", "source": "s", "source_board_id": "b", "source_job_id": str(i), "canonical_url": f"u{i}", "fingerprint": "f", "posted_at": None if hours is None else NOW - datetime.timedelta(hours=hours)} | more
    return (shard, target, *known.values())


def test_fan_in(spark, tmp_path):
    folder, frame = f"file://{tmp_path}/out", lambda rows: spark.createDataFrame(rows, POST)
    shards = spark.createDataFrame([(1,), (2,)], "shard int")
    rows = [posting(1, 1), posting(1, 1, "t2"), posting(2, 1), posting(2, 2, hours=100), posting(2, 3, hours=None), posting(1, 4, "t2")]
    gone = spark.createDataFrame([("s", "b", "9")], "source string, source_board_id string, source_job_id string")
    for bad, message in (([r for r in rows if r[0] == 1], "without rows"), ([*rows, posting(3, 5)], "unknown"), ([*rows, posting(2, 1, id="other")], "disagree")):
        with pytest.raises(journal.Conflict, match=message):
            reconcile.fan_in(frame(bad), shards, folder, "run 1", NOW, 72)
    assert journal.latest(folder).number == 0
    for _ in range(2):
        reconcile.fan_in(frame(rows), shards, folder, "run 1", NOW, 72, gone)
    ids = lambda table: sorted(r["id"] for r in journal.read(spark, folder, table).collect())
    assert (ids("posting"), ids("ledger"), ids("membership")) == (["i1", "i3", "i4"], ["i2"], ["i1", "i1", "i3", "i4"])
    assert [r["source_job_id"] for r in journal.read(spark, folder, "invalidated").collect()] == ["9"] and journal.latest(folder).number == 1


def test_fan_in_computes_its_rows_three_times(spark, tmp_path):
    seen, rows = spark.sparkContext.accumulator(0), [posting(i % 3, i // 3, f"t{i % 2}") for i in range(60)]

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, POST)
    reconcile.fan_in(frame.mapInArrow(counted, frame.schema), spark.createDataFrame([(0,), (1,), (2,)], "shard int"), f"file://{tmp_path}/out", "run 1", NOW, 72)
    assert seen.value == 3 * len(rows) and len(journal.read(spark, f"file://{tmp_path}/out", "membership").collect()) == 40


def test_fan_in_keeps_what_the_first_shard_says(spark, tmp_path):
    rows = [posting(s, i, t, s + i + len(t), id=None if i == 3 else f"i{i}") for s in (2, 1) for i in range(5) for t in ("b", "aa") if (s, t) != (1, "aa") or i % 2]
    rows += [posting(1, 7), posting(2, 7), posting(2, 8, hours=None)]
    reconcile.fan_in(spark.createDataFrame(rows, POST), spark.createDataFrame([(1,), (2,)], "shard int"), f"file://{tmp_path}/out", "run 1", NOW)
    expected = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        expected.setdefault(r[2] or "", r)
    read = lambda table: journal.read(spark, f"file://{tmp_path}/out", table).collect()
    assert sorted((r["id"], r["posted_at"]) for r in read("posting")) == sorted((k, r[8].strftime("%Y-%m-%d %H:%M:%S") if r[8] else "") for k, r in expected.items())
    assert sorted((r["id"], r["target_identity"]) for r in read("membership")) == sorted({(r[2], r[1]) for r in rows if r[2] is not None})


def test_fan_in_refuses_what_identity_conflicts_finds(spark, tmp_path):
    shards, found = spark.createDataFrame([(1,), (2,)], "shard int"), []
    one, url = posting(1, 1), {"source_job_id": None, "canonical_url": "u"}
    sets = [
        [one, posting(2, 1, fingerprint="g")], [one, posting(2, 1, fingerprint=None)], [one, posting(2, 1, id=None)], [one, posting(2, 1, id=None, fingerprint="g")], [one, posting(2, 1, id="other")],
        [one, posting(2, 2, id="i1", fingerprint="g")], [posting(1, 1, **url), posting(2, 2, **url)], [posting(1, 1, **url), posting(2, 1, **url, source="t")], [one, posting(1, 1, hours=2), posting(2, 1, "a")],
    ]
    for i, rows in enumerate(sets):
        frame, folder = spark.createDataFrame(rows, POST), f"file://{tmp_path}/{i}"
        found.append(not grouping.identity_conflicts(frame).isEmpty())
        try:
            reconcile.fan_in(frame, shards, folder, "run 1", NOW)
            assert not found[-1]
        except journal.Conflict as e:
            assert found[-1] and "disagree" in str(e) and journal.latest(folder).number == 0
    assert found == [True, False, False, True, True, False, True, False, False]


def enumerated(n, m):
    period = n // math.gcd(n, m)
    chosen = [[(c * m + o) % n for o in range(m)] for c in range(period)]
    visits = [[c for c in range(period) if i in set(chosen[c])] for i in range(n)] if n <= 12 else None
    at = [[] for _ in range(n)]
    for c, some in enumerate(chosen):
        for i in some:
            at[i].append(c)
    assert visits is None or visits == at
    gaps = {i: [b - a for a, b in zip(v, [*v[1:], v[0] + period])] for i, v in enumerate(at)}
    worst = 0
    for start in range(min(period, 6)):
        seen, step = set(), 0
        while len(seen) < n:
            seen.update(chosen[(start + step) % period])
            step += 1
        worst = max(worst, step)
    return period, min(map(len, at)), max(map(len, at)), max(map(max, gaps.values())), worst, {(i, c, g) for i, v in enumerate(at) for c, g in zip(v, gaps[i])}


def test_coverage_equals_enumeration(spark):
    pairs = [(n, m) for n in range(1, 201) for m in range(1, n + 1) if n <= 40 or (n * 7 + m) % 23 == 0]
    rows = coverage.coverage_proof(spark.createDataFrame(pairs, "registry_targets int, targets_per_cohort int")).collect()
    assert {tuple(r)[:7]: True for r in rows} == {(n, m, *enumerated(n, m)[:5]): True for n, m in pairs}
    some = [(n, m) for n, m in pairs if n <= 14]
    got = {}
    for r in coverage.visits(spark.createDataFrame(some, "registry_targets int, targets_per_cohort int")).collect():
        got.setdefault(tuple(r)[:2], set()).add(tuple(r)[2:])
    assert got == {p: enumerated(*p)[5] for p in some}
    with pytest.raises(Exception, match="within the registry"):
        coverage.coverage_proof(spark.createDataFrame([(3, 4)], "registry_targets int, targets_per_cohort int")).collect()


def test_suppression_makes_digests_in_no_filter(spark, capsys):
    rows = spark.createDataFrame([(1, "s", "b", "j", "https://x.org/1")] * 2, "id int, source string, source_board_id string, source_job_id string, canonical_url string")
    kept = reconcile.not_surfaced(rows, spark.createDataFrame([("0" * 64,)], "d string"), spark.createDataFrame([("1" * 64,)], "d string"))
    kept.explain()
    assert not [x for x in capsys.readouterr().out.splitlines() if "Filter" in x and "sha2" in x]
    assert kept.count() == 2
