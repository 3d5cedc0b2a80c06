"""The outcome log: its rules, and a stream of shuffled and repeated files against the fold of a table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import outcomes

T0 = datetime.datetime(2024, 1, 1)


def command(i, minutes, client="c1", subject="p1", key=None, value="good", expected=0, surfaced=True, actor="ann"):
    return (f"{i:05}", T0 + datetime.timedelta(minutes=minutes), client, "posting", subject, "person", actor, key or f"key{i}", value, expected, None, surfaced)


def given(rows):
    return sorted((r["client_id"], r["request_id"], r["status"], r["version"], r["previous_version"], r["previous_value"], r["value"], r["event_id"]) for r in rows)


def test_rules(spark):
    rows = [
        command(1, 0, key="a"), command(2, 1, key="a"), command(3, 2, key="a", value="bad"), command(4, 3, expected=0), command(5, 4, expected=1, value="bad"),
        command(6, 5, expected=2, surfaced=False), command(7, 6, key="a", actor="bob", expected=2, value="late"), command(8, 7, subject="p2", key="b", expected=3), command(9, 8, subject="p2", key="b"),
        command(10, 9, key="a"), command(11, 60 * 24 * 40, key="a", expected=3), command(12, 10, client="c2", key="a"),
    ]
    got = {r["request_id"]: (r["status"], r["version"], r["previous_value"], r["value"]) for r in outcomes.answered(spark.createDataFrame(rows, outcomes.COMMAND).repartition(3)).collect()}
    assert got == {
        "00001": ("accepted", 1, None, "good"), "00002": ("replayed", 1, None, "good"), "00003": ("incompatible", 1, None, "good"), "00004": ("stale", 1, None, "good"),
        "00005": ("accepted", 2, "good", "bad"), "00006": ("not_surfaced", 2, None, "bad"), "00007": ("accepted", 3, "bad", "late"), "00008": ("stale", 0, None, None),
        "00009": ("accepted", 1, None, "good"), "00010": ("replayed", 1, None, "good"), "00011": ("accepted", 4, "late", "good"), "00012": ("accepted", 1, None, "good"),
    }
    assert outcomes.answered(spark.createDataFrame([], outcomes.COMMAND)).collect() == []


def history(rng, n):
    """Commands of several clients, subjects and actors, with retries of earlier requests under their keys."""
    rows, heads = [], {}
    for i in range(n):
        if rows and rng.random() < 0.25:
            old = list(rng.choice(rows))
            rows.append((f"{i:05}", T0 + datetime.timedelta(minutes=i), *old[2:8], rng.choice([old[8], old[8], "other"]), *old[9:]))
            continue
        client, subject = rng.choice(["c1", "c1", "c1", "c2"]), rng.choice(["p1", "p2", "p3"])
        expected = heads.get((client, subject), 0) if rng.random() < 0.7 else rng.randrange(4)
        heads[client, subject] = heads.get((client, subject), 0) + (expected == heads.get((client, subject), 0))
        rows.append(command(i, i, client, subject, rng.choice([None, None, f"k{rng.randrange(9)}"]), rng.choice(["good", "bad"]), expected, rng.random() < 0.9, rng.choice(["ann", "bob"])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_stream_of_shuffled_and_repeated_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = history(rng, 160)
    want = given(outcomes.answered(spark.createDataFrame(rows, outcomes.COMMAND)).collect())
    assert {r[2] for r in want} == {"accepted", "replayed", "incompatible", "stale", "not_surfaced"}
    files = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    rng.shuffle(files)
    end = command(99_999, 60 * 24 * 9, client="clock")  # moves the watermark past all others
    source, out = tmp_path / "in", tmp_path / "out"
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        for n, some in enumerate([*files, [end]]):
            spark.createDataFrame(rng.sample(some, len(some)), outcomes.COMMAND).coalesce(1).write.mode("append").parquet(str(source))
            if n % 3 == 2 or n == len(files):  # the query stops and goes on from its checkpoint
                stream = outcomes.answers(spark.readStream.schema(outcomes.COMMAND).parquet(str(source)), "2 days")
                stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(str(out)).where(F.col("client_id") != "clock").collect()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert given(got) == want
