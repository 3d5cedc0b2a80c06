"""Exact deduplication as a stateful stream.

Rows arrive as a stream of fingerprints.  A keyed aggregation over RocksDB state (kept on disk, never
expired) remembers, for every digest, the identifier and the content locator (file and row) of the row
that stays and how many rows had the digest.  Every hit is then checked against the full bytes at the
remembered locator; rows that only share the digest are grouped by their bytes instead.  The state can be kept in a folder
of the caller's, and go on with the rows that come next.

Two texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``;
NULL counts as empty.  The row with most code points, then the smallest ``doc_id``, stays.

Defined cases: a NULL ``doc_id`` loses ties; rows that repeat both ``doc_id`` and text are told apart
by their locator, so one of them stays; texts of any length are compared whole; an empty table gives no rows; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm.common import cut, drop_path, free, matched, scratch, spread_join, strip_space, table, unmatched

#: Arrival files that one micro-batch takes at least; on a larger cluster, four a core.
FILES_PER_BATCH = 16
#: State on disk; without space set aside ahead in each of the many small stores, and written out as changes only.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a store is open only while its task runs: batches are few, as they follow the cluster, and open stores would fill the executors
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def locator() -> Column:
    return F.struct("_metadata.file_path", "_metadata.row_index")


#: What a plan may consist of for the file and row of a scan to be each row's own: no join, union or generator that repeats rows.
_SCAN = {"Project", "Filter", "Relation", "SubqueryAlias", "LogicalRelation"}


def scanned(docs: DataFrame) -> bool:
    """Whether every row is one row of a file."""
    nodes = re.findall(r"^[\s:+-]*'?(\w+)", docs._jdf.queryExecution().analyzed().toString(), re.M)
    return set(nodes) <= _SCAN


def located(docs: DataFrame, name: str = "__at") -> DataFrame:
    """``docs`` with each row's locator; what isn't rows of files as they are is written first."""
    if scanned(docs):
        try:
            return docs.select("*", locator().alias(name))
        except AnalysisException:  # files without such metadata
            pass
    path = scratch(docs.sparkSession, "arrived")
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path).select("*", locator().alias(name))


def best() -> Column:
    """Of a group's rows, the one that stays: (rank, doc_id, locator)."""
    rank = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__at")
    return F.min(rank).alias("best")


def remembered(arrivals: DataFrame, folder: str) -> DataFrame:
    """Run the stream over the fingerprints in ``folder`` that it hasn't seen: a row per digest with ``best`` and ``group_size``."""
    spark = arrivals.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        files = max(FILES_PER_BATCH, 4 * spark.sparkContext.defaultParallelism)
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{folder}/arrivals")
        state = stream.groupBy("digest").agg(best(), F.count("*").alias("group_size"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/updates/{number:06d}")

        query = (
            state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = spark.createDataFrame([], arrivals.schema).groupBy("digest").agg(best(), F.count("*").alias("group_size"))
    try:
        seen = spark.read.schema(shape.withColumn("batch", F.lit(0)).schema).parquet(f"{folder}/updates/*")
    except AnalysisException:  # nothing arrived
        return shape
    return seen.groupBy("digest").agg(F.max(F.struct("batch", "group_size", "best")).alias("s")).select("digest", "s.best", "s.group_size")


def texts_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` (read from files) at the locators ``wanted.__at`` (written, distinct), with the columns of both; no other text is shuffled."""
    return matched(rows, wanted, "__at")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, folder: str | None = None) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``__at``.

    With a ``folder``, its state goes on: ``docs`` are the rows that have come since, and groups include all rows before, whose
    files must still be there.
    """
    return _grouped(located(docs.select("doc_id", "text")), digest, folder)


def _grouped(rows: DataFrame, digest: Callable[[Column], Column] = sha256, folder: str | None = None) -> DataFrame:
    """``exact_groups`` of ``rows(doc_id, text, __at)``, read from files."""
    spark = rows.sparkSession
    bare = strip_space(F.col("text"))
    own = folder or scratch(spark, "exact")
    path = f"{own}/arrivals/{uuid.uuid4().hex}"
    n_chars = F.length(F.coalesce("text", F.lit("")))
    prints = rows.select(
        "doc_id", "__at", n_chars.alias("n_chars"), digest(bare).alias("digest"), *([sha256(bare).alias("text_sha256")] if digest is not sha256 else []),
    )
    prints.write.parquet(path)
    arrivals = spark.read.schema(prints.schema).parquet(path)
    state = cut(remembered(arrivals, own))
    if folder is None:
        drop_path(spark, f"{own}/updates")
    sha = "digest" if digest is sha256 else "text_sha256"
    met = spread_join(arrivals, state, "digest", "__at")
    found = met.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("__at") == F.col("best.__at")).alias("kept"), F.col(sha).alias("text_sha256"), "__at", "digest",
    )
    # hits: their full bytes must equal those at the remembered locator; only texts of hits are read beyond the scan
    hits = cut(met.where("group_size > 1").select("__at", "digest", F.col("best.__at").alias("__kept_at")))
    others = hits.where(F.col("__at") != F.col("__kept_at")).select("__at", "digest")
    keepers = cut(hits.select(F.col("__kept_at").alias("__at"), "digest").distinct())
    everything = rows
    if folder is not None:
        new = arrivals.select("__at.file_path").distinct()
        old = [r[0] for r in keepers.select("__at.file_path").distinct().join(new, "file_path", "left_anti").collect()]  # names of files
        if old:
            everything = rows.unionByName(located(spark.read.schema(rows.drop("__at").schema).parquet(*old)))
    kept = texts_at(everything, keepers).select("digest", bare.alias("kept_bare"))
    compared = spread_join(texts_at(rows, cut(others)).select("digest", "__at", bare.alias("bare")), kept, "digest", "__at", counted=hits)
    false_hits = cut(compared.where("bare != kept_bare").select("digest").distinct())
    if not false_hits.isEmpty():
        again = texts_at(rows, cut(hits.select("__at", "digest").join(false_hits, "digest", "left_semi"))).select("__at", "doc_id", "digest", bare.alias("bare"), n_chars.alias("n_chars"))
        if everything is not rows:  # the rows before also count in their groups
            again = again.unionByName(texts_at(everything, keepers.join(false_hits, "digest", "left_semi")).select("__at", "doc_id", "digest", bare.alias("bare"), n_chars.alias("n_chars"))).distinct()
        groups = again.groupBy("digest", "bare").agg(best(), F.count("*").alias("group_size"))
        regrouped = again.join(groups, ["digest", "bare"]).join(arrivals.select("__at"), "__at", "left_semi").select(
            "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
            (F.col("__at") == F.col("best.__at")).alias("kept"), sha256(F.col("bare")).alias("text_sha256"), "__at", "digest",
        )
        found = found.join(false_hits, "digest", "left_anti").unionByName(regrouped)
    return found.drop("digest")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that an equal text makes superfluous."""
    at = free(docs, "__at")
    placed = located(docs, at)
    out = _grouped(placed.select(F.col(at).alias("__at"), "doc_id", "text")).where("NOT kept").select(F.col("__at").alias(at))
    return unmatched(placed, cut(out), at).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("__at")


QUERIES = {"op9_exact_dedup": op9}
ORACLE_SQL = {
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS bare
  FROM documents),
w AS (
  SELECT doc_id, bare,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM w
"""
}
