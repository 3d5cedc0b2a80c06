"""Incremental groups against postings one after another; Bloom filters."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import bloom, grouping

BATCH = "id string, position int, own_group string, keys array<struct<kind:string,value:string>>"


class OneByOne:
    """Each posting in turn looks up who holds its keys."""

    def __init__(self):
        self.members, self.keys = {}, {}

    def take(self, id_, own, keys):
        groups = {own} | {self.members[o] for o, k in self.keys.items() if k & keys and o in self.members}
        if id_ in self.members:
            groups.add(self.members[id_])
        least = min(groups)
        self.members = {i: least if g in groups else g for i, g in self.members.items()} | {id_: least}
        self.keys[id_] = keys


@pytest.mark.parametrize("seed", range(4))
def test_batches_equal_one_by_one(spark, seed):
    rng, plain = random.Random(seed), OneByOne()
    own = {str(i): f"{rng.randrange(10**9):09}" for i in range(60)}
    members = spark.createDataFrame([], "id string, group_id string")
    keys = spark.createDataFrame([], "id string, kind string, value string")
    for _ in range(4):
        before = dict(plain.members)
        some = rng.sample(sorted(own), rng.choice([0, 1, 8, 25]))
        rows = [(i, p, own[i], [("url", str(rng.randrange(30))) for _ in range(rng.randrange(4))] + [("text", str(rng.randrange(200)))] * rng.randrange(3)) for p, i in enumerate(some)]
        shuffled = rng.sample(rows, len(rows))
        members, keys, merged = grouping.assigned(spark.createDataFrame(shuffled, BATCH), members, keys)
        for i, _, group, k in rows:
            plain.take(i, group, set(k))
        assert {r["id"]: r["group_id"] for r in members.collect()} == plain.members
        assert {(r["id"], r["kind"], r["value"]) for r in keys.collect()} == {(i, *k) for i, ks in plain.keys.items() for k in ks}
        gone = {(g, plain.members[i]) for i, g in before.items() if plain.members[i] != g}
        assert {(r["from_group"], r["to_group"]) for r in merged.collect()} == gone


def test_a_key_of_many_and_one_big_chain(spark):
    n = 400
    rows = [(str(i), i, f"{n - i:05}", [("hot", "x")] if i % 2 else [("chain", str(i)), ("chain", str(i + 2))]) for i in range(n)]
    members, _, _ = grouping.assigned(spark.createDataFrame(rows, BATCH), spark.createDataFrame([], "id string, group_id string"), spark.createDataFrame([], "id string, kind string, value string"))
    assert {int(r["id"]) % 2: r["group_id"] for r in members.distinct().collect()} == {1: "00001", 0: "00002"}


def test_bloom_filters_lose_no_key(spark):
    keys = spark.range(0, 30_000, 3).select(F.concat(F.lit("k"), "id").alias("k"))
    rows = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("x"), "id").union(spark.createDataFrame([(None, -1)], "x string, id long"))
    got = {r["id"] for r in bloom.thinned(rows, F.col("x"), keys).collect()}
    assert set(range(0, 30_000, 3)) <= got and len(got) < 10_000 + 1500 and -1 not in got
    assert bloom.thinned(rows, F.col("x"), keys.limit(0)).collect() == []
    few = {r["id"] for r in bloom.thinned(rows, F.col("x"), keys, n=1).collect()}  # too small a filter only lets more through
    assert set(range(0, 30_000, 3)) <= few


def test_groups_without_a_common_key_have_no_links(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(grouping, "components", lambda links: seen.append(links.where("a != b").count()) or links.limit(0))
    rows = [(str(i), i, f"g{i}", [("url", str(i)), ("url", str(i))]) for i in range(20)]
    found, _ = grouping.assign(spark.createDataFrame(rows, BATCH), spark.createDataFrame([], "id string, group_id string"), spark.createDataFrame([], "id string, kind string, value string"))
    assert seen == [0] and {tuple(r) for r in found.collect()} == {(r[0], r[2]) for r in rows}


def test_texts_go_to_workers_in_small_batches(spark):
    from gleaner.plans import catalogue

    for make in (lambda v: grouping.delivery_keys(v), lambda v: grouping.representatives(v, v.select("id", F.col("id").alias("group_id")))):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        make(catalogue.vacancies(spark, "/root/testdata/sf0.001"))
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "128"
