"""Pages of a frozen order: a result is sorted once, and a page reads the one or two files that hold it.

A snapshot is a folder: rows in range-partitioned, sorted files of bounded size, a directory of them (a row per file: its first
position, rows, least and greatest leading value) and, written last, a manifest with owner, time of expiry and the number of rows.  Without a
manifest there is no snapshot.  ``now`` is always an argument.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# How long a snapshot can be read, and how many an owner may have at a time.
LIFETIME, MOST = datetime.timedelta(minutes=30), 5
#: Rows of a file.
FILE_ROWS = 200_000


class SnapshotError(ValueError):
    """``SNAPSHOT_EXPIRED``, ``INVALID_CURSOR`` or ``RATE_LIMITED``."""


@dataclass(frozen=True)
class Snapshot:
    id: str
    owner: str
    folder: str
    expires: datetime.datetime
    total: int
    columns: list[str]


def _fs(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _home(root: str, owner: str) -> str:
    return f"{root.rstrip('/')}/{hashlib.sha256(owner.encode()).hexdigest()[:32]}"


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    fs, path = _fs(spark, f"{folder}/manifest.json")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create(rows: DataFrame, order: list[str], root: str, owner: str, now: datetime.datetime, files: int | None = None) -> Snapshot:
    """Freeze ``rows`` in the order of ``order`` (a leading ``-`` sorts descending; ties in no order of their own).

    Refused with ``RATE_LIMITED`` while the owner has ``MOST`` snapshots that haven't expired; expired ones are removed.
    """
    spark, home = rows.sparkSession, _home(root, owner)
    if len(live(spark, root, owner, now)) >= MOST:
        raise SnapshotError("RATE_LIMITED")
    name, by = uuid.uuid4().hex, [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in order]
    folder, lead = f"{home}/{name}", order[0].lstrip("-")
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__place", F.monotonically_increasing_id())
    placed.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/rows")
    written = spark.read.parquet(f"{folder}/rows")
    listed = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("__place").alias("first"), F.count("*").alias("rows"), F.min(lead).alias("least"), F.max(lead).alias("greatest"), F.count_if(F.col(lead).isNull()).alias("nulls"))
    listed.coalesce(1).write.parquet(f"{folder}/directory")  # a row per file
    total = spark.read.parquet(f"{folder}/directory").agg(F.sum("rows")).first()[0] or 0
    found = {"id": name, "owner": owner, "expires": (now + LIFETIME).isoformat(), "total": total, "columns": rows.columns, "lead": lead}
    fs, path = _fs(spark, f"{folder}/manifest.json")
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(json.dumps(found).encode()))
    finally:
        stream.close()
    return _snapshot(found, folder)


def _snapshot(found: dict, folder: str) -> Snapshot:
    return Snapshot(found["id"], found["owner"], folder, datetime.datetime.fromisoformat(found["expires"]), found["total"], found["columns"])


def live(spark: SparkSession, root: str, owner: str, now: datetime.datetime) -> list[Snapshot]:
    """The owner's snapshots that haven't expired; the others' folders go."""
    fs, home = _fs(spark, _home(root, owner))
    out = []
    for entry in fs.listStatus(home) if fs.exists(home) else ():
        folder = entry.getPath().toString()
        found = _manifest(spark, folder)
        if found is not None and datetime.datetime.fromisoformat(found["expires"]) > now:
            out.append(_snapshot(found, folder))
        elif found is not None:
            fs.delete(entry.getPath(), True)
    return out


def get(spark: SparkSession, root: str, owner: str, name: str, now: datetime.datetime) -> Snapshot:
    """A snapshot by id; another owner's is an invalid cursor, one that is gone or over has expired."""
    found = _manifest(spark, folder := f"{_home(root, owner)}/{name}")
    if found is None:
        fs, home = _fs(spark, root)
        others = [f"{e.getPath().toString()}/{name}" for e in (fs.listStatus(home) if fs.exists(home) else ())]
        raise SnapshotError("INVALID_CURSOR" if any((m := _manifest(spark, f)) and datetime.datetime.fromisoformat(m["expires"]) > now for f in others) else "SNAPSHOT_EXPIRED")
    if datetime.datetime.fromisoformat(found["expires"]) <= now:
        raise SnapshotError("SNAPSHOT_EXPIRED")
    return _snapshot(found, folder)


def cursor(snapshot: Snapshot, position: int) -> str:
    """A handle of a place in a snapshot; the same for the same place."""
    return base64.urlsafe_b64encode(f"{snapshot.id}:{position}".encode()).decode()


def resolve(spark: SparkSession, root: str, owner: str, handle: str, now: datetime.datetime) -> tuple[Snapshot, int]:
    try:
        name, position = base64.urlsafe_b64decode(handle.encode()).decode().split(":")
        place = int(position)
        uuid.UUID(name)
    except (ValueError, UnicodeError):
        raise SnapshotError("INVALID_CURSOR") from None
    return get(spark, root, owner, name, now), place


def _files(spark: SparkSession, snapshot: Snapshot) -> list:
    """The directory with the position of each file's first row; a row per file."""
    at, out = 0, []
    for r in spark.read.parquet(f"{snapshot.folder}/directory").orderBy("first").collect():
        out.append((at, r))
        at += r["rows"]
    return out


def _slice(spark: SparkSession, files: list, snapshot: Snapshot, position: int, limit: int) -> DataFrame:
    some = [(at, r) for at, r in files if at < position + limit and at + r["rows"] > position]
    if not some:
        return spark.read.parquet(f"{snapshot.folder}/rows").limit(0).withColumn("position", F.lit(0).cast("long")).select("position", *snapshot.columns)
    place, known = F.col("__place"), F.lit(None).cast("long")
    for at, r in some:  # places count on within a file from its first row
        known = F.when(place.between(r["first"], r["first"] + r["rows"] - 1), place - r["first"] + at).otherwise(known)
    low, high = position - some[0][0] + some[0][1]["first"], position + limit - 1 - some[-1][0] + some[-1][1]["first"]
    rows = spark.read.parquet(*[r["file"] for _, r in some]).where(place.between(low, high))
    return rows.withColumn("position", known).select("position", *snapshot.columns).orderBy("position")


def page(spark: SparkSession, snapshot: Snapshot, position: int, limit: int) -> tuple[DataFrame, dict]:
    """Rows ``position`` to ``position + limit - 1`` with their ``position``, and where to go on: cursors ``previous`` and ``next`` (None at an end), ``total``."""
    position, limit = max(0, position), max(0, limit)
    rows = _slice(spark, _files(spark, snapshot), snapshot, position, limit)
    go_on = cursor(snapshot, position + limit) if position + limit < snapshot.total else None
    return rows, {"previous": cursor(snapshot, max(0, position - limit)) if position else None, "next": go_on, "total": snapshot.total}


def members(spark: SparkSession, snapshot: Snapshot, value, position: int, limit: int) -> DataFrame:
    """A page of the rows whose leading order column has a value, from ``position`` among them; reads only the files whose range holds it."""
    lead, files = _manifest(spark, snapshot.folder)["lead"], _files(spark, snapshot)
    own = lambda r: r["nulls"] > 0 if value is None else r["least"] is not None and r["least"] <= value <= r["greatest"]
    held = [(at, r) for at, r in files if own(r)]
    if not held:
        return _slice(spark, files, snapshot, 0, 0)
    same: Column = F.col(lead).eqNullSafe(F.lit(value))
    first = spark.read.parquet(*[r["file"] for _, r in held]).where(same).agg(F.min("__place").alias("first"), F.count("*").alias("n")).first()
    if not first["n"] or position >= first["n"]:
        return _slice(spark, files, snapshot, 0, 0)
    start = next(at + first["first"] - r["first"] for at, r in held if r["first"] <= first["first"] < r["first"] + r["rows"])
    return _slice(spark, files, snapshot, start + position, min(limit, first["n"] - position))
