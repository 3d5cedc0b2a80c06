"""The transactional writer: commits, aborts, failing tasks, repeated batches, conflicts, streams, several tables."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

from gleaner.sources import journal


@pytest.fixture
def folder(spark, tmp_path):
    journal.register(spark)
    return f"file://{tmp_path}/out"


def save(df, folder, mode="append", **options):
    df.write.format("journal").option("path", folder).options(**options).mode(mode).save()


def rows(spark, low, high, parts=3):
    return spark.range(low, high, 1, parts).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('say "'), "id", F.lit('",\nline')).alias("text"))


def ids(spark, folder, table=None):
    return sorted(int(r["id"]) for r in journal.read(spark, folder, table).collect())


def data_files(folder):
    return len(os.listdir(folder.removeprefix("file://") + "/data"))


def test_commits_and_digests(spark, folder):
    assert journal.latest(folder).digest.startswith("0:") and journal.read(spark, folder).collect() == []
    save(rows(spark, 0, 10), folder)
    first = journal.latest(folder)
    save(rows(spark, 10, 20, 2), folder)
    assert ids(spark, folder) == list(range(20)) and journal.latest(folder).number == 2
    assert journal.read(spark, folder).where("id = '3'").first()["text"] == 'say "3",\nline'
    save(rows(spark, 0, 10, 1).orderBy(F.desc("id")), folder, "overwrite")
    assert ids(spark, folder) == list(range(10)) and journal.latest(folder).digest == first.digest


def test_a_failing_task_leaves_nothing(spark, folder):
    save(rows(spark, 0, 5), folder)
    bad = rows(spark, 5, 25, 4).withColumn("text", F.when(F.col("id") == "22", F.raise_error(F.lit("task fails")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="task fails"):
        save(bad, folder)
    assert ids(spark, folder) == list(range(5)) and journal.latest(folder).number == 1
    journal.vacuum(folder)
    assert data_files(folder) == len(journal.latest(folder).files)


def test_a_repeated_batch_changes_nothing(spark, folder):
    save(rows(spark, 0, 5), folder, batch="b1")
    files = data_files(folder)
    save(rows(spark, 0, 5), folder, batch="b1")
    assert ids(spark, folder) == list(range(5)) and data_files(folder) == files
    save(rows(spark, 5, 6), folder, batch="b2")
    assert ids(spark, folder) == list(range(6)) and journal.latest(folder).batches == ["b1", "b2"]


def test_conflicts(spark, folder):
    save(rows(spark, 0, 5), folder)
    before = journal.latest(folder).digest
    save(rows(spark, 5, 6), folder, before=before)
    for options, df in (({"before": before}, rows(spark, 6, 7)), ({}, rows(spark, 6, 7).select("text", "id"))):
        with pytest.raises(Exception, match="changed|other columns"):
            save(df, folder, **options)
    assert ids(spark, folder) == list(range(6)) and data_files(folder) == len(journal.latest(folder).files)
    with pytest.raises(journal.Conflict):  # the slower of two writers
        journal._publish(folder, journal.latest(folder))


def test_tables_of_one_commit(spark, folder):
    both = rows(spark, 0, 20).withColumn("kind", F.when(F.col("id") % 4 == 0, "ledger").otherwise("posting"))
    save(both, folder, table="kind", batch="run 1")
    assert ids(spark, folder, "ledger") == list(range(0, 20, 4)) and len(ids(spark, folder, "posting")) == 15 and len(ids(spark, folder)) == 20


def test_rows_of_strings_come_in_batches(spark, folder):
    texts = ['a "b"', "c\\d", "é\u2028", "x\x7f", "", None, "new\nline", "plain", " #[]~/"]
    values = [(str(i), t, "b" if i % 3 else "a") for i, t in enumerate(texts)]
    assert isinstance(journal.Journal({"path": folder}).writer(spark.createDataFrame(values, "id string, text string, kind string").schema, False), DataSourceArrowWriter)
    whole = sum(journal.row_digest([v or "" for v in row]) for row in values)
    for shape, made in (("id string, text string, kind string", values), ("id int, text string, kind string", [(int(i), *more) for i, *more in values])):  # the second goes row by row
        save(spark.createDataFrame(made, shape).repartition(2), folder, "overwrite", table="kind")
        now = journal.latest(folder)
        assert now.digest == f"{len(values)}:{whole % (1 << 256):064x}" and {f["table"] for f in now.files} == {"a", "b"}
        assert sorted(map(tuple, journal.read(spark, folder).collect())) == [(i, t or "", kind) for i, t, kind in values]
    many = pa.record_batch([pa.array(texts[:5] * 300), pa.array([str(i) for i in range(1500)])], names=["a", "b"])
    for some in (many, many.slice(701), many.slice(0, 0)):
        assert journal.digest_sum(some) == sum(journal.row_digest(list(v)) for v in zip(*[c.to_pylist() for c in some.columns]))


def test_stream_replays_its_batches(spark, folder, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, 0, 8).write.parquet(source)
    start = lambda at: spark.readStream.schema("id string, text string").parquet(source).writeStream.format("journal").option("path", folder).option("checkpointLocation", str(tmp_path / at)).trigger(availableNow=True).start().awaitTermination()
    start("a")
    rows(spark, 8, 11).write.mode("append").parquet(source)
    start("a")
    assert ids(spark, folder) == list(range(11))
    start("lost checkpoint")  # batch 0 again, with all rows: its number is known
    assert ids(spark, folder) == list(range(11))
