"""Sinks: delivery exports with digests, written aside and moved into place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators.state import multiset_digest


def export_rows(postings: DataFrame) -> DataFrame:
    """Five columns of a delivery; the link is the application's, else the posting's."""
    return postings.select(
        F.col("company").alias("Company"), F.col("title").alias("Title"), F.coalesce("apply_url", "canonical_url").alias("Link"),
        F.coalesce("location_text", F.lit("")).alias("Location"), F.initcap("source").alias("Platform"),
    )


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def replace_csv(rows: DataFrame, path: str, before: str | None = None) -> str:
    """Replace the CSV folder at ``path`` and return the digest of its rows.

    The new rows are written aside and only then moved; with ``before``, nothing happens unless the present digest is that one.
    """
    spark = rows.sparkSession
    fs, at = _fs(spark, path)
    if before is not None and csv_digest(spark, path) != before:
        raise ValueError("the destination has changed")
    draft, aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.csv(draft, header=True, quoteAll=True, escape='"')
    wanted = csv_digest(spark, draft)
    there = fs.exists(at(path))
    # at any moment either the old or the new rows are at the path or beside it, and nothing is deleted before the new ones are checked
    if there and not fs.rename(at(path), at(aside)):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(at(draft), at(path)) or csv_digest(spark, path) != wanted:
        if there and not fs.exists(at(path)):
            fs.rename(at(aside), at(path))
        raise OSError(f"{path} couldn't be replaced")
    if there:
        fs.delete(at(aside), True)
    return wanted


def append_csv(rows: DataFrame, path: str) -> str:
    """Append to the CSV folder at ``path``, whose header must be that of ``rows``; returns the digest of all its rows."""
    spark = rows.sparkSession
    fs, at = _fs(spark, path)
    if fs.exists(at(path)):
        header = spark.read.csv(path, header=True).columns
        if header != rows.columns:
            raise ValueError(f"{path} has other columns: {', '.join(header)}")
    rows.write.mode("append").csv(path, header=True, quoteAll=True, escape='"')
    return csv_digest(spark, path)


def csv_digest(spark: SparkSession, path: str) -> str:
    """The digest of the rows of a CSV folder, whatever their order; of none, if it isn't there."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return "0:"
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    n, digest = multiset_digest(rows, rows.columns).first()
    return f"{n}:{digest}"
