"""A table of files whose contents change in one step: tasks write files of their own, a manifest says which ones count.

Every task names its file in its commit message.  ``commit`` lists these files in the next manifest, whose appearance is the one step by
which readers see them; ``abort`` deletes them, and a file that no manifest names was never there.  A manifest knows the ids of the batches it
holds, so a batch that is written again changes nothing, and a digest of all rows, so a writer can insist on what it replaces.

    df.write.format("journal").option("path", folder).option("batch", "2024-01-31").mode("append").save()
    df.writeStream.format("journal").option("path", folder).option("checkpointLocation", ...).start()
    journal.read(spark, folder)

Columns are strings, as in a delivery; with a column named by the option ``table``, its values tell tables of one
commit apart, each with files of its own.  The folder is a URI that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType

MANIFEST = "manifest-"
#: What JSON text escapes, and bytes of a batch up to which its rows' JSON texts are made at once.
ESCAPED, AT_ONCE = r"[^ !#-\[\]-~]", 1 << 29


class Conflict(ValueError):
    """The destination isn't what the writer said it would be, or another writer was faster."""


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def row_digest(values: list[str]) -> int:
    return int.from_bytes(hashlib.sha256(json.dumps(values).encode()).digest(), "big")


def digest_sum(rows: pa.RecordBatch) -> int:
    """The sum of ``row_digest`` over rows of strings; JSON texts of rows in which nothing is escaped are put together by columns."""
    total = 0
    if rows.num_rows and rows.num_columns and rows.nbytes <= AT_ONCE:
        odd = pc.match_substring_regex(pc.binary_join_element_wise(*rows.columns, ""), ESCAPED)
        plain, rows = (rows.filter(pc.invert(odd)), rows.filter(odd)) if odd.true_count else (rows, rows.slice(0, 0))
        said = pc.binary_join_element_wise('["', pc.binary_join_element_wise(*plain.columns, '", "'), '"]', "")
        _, ends, data = said.buffers()
        ends, data = np.frombuffer(ends, np.int32, len(said) + 1, 4 * said.offset).tolist(), data.to_pybytes()
        hashes = b"".join([hashlib.sha256(data[i:j]).digest() for i, j in zip(ends, ends[1:])])
        parts = np.frombuffer(hashes, ">u4").reshape(-1, 8).sum(0, np.uint64)  # 32 bits each, so that no sum of a batch's rows overflows
        total = sum(int(n) << 32 * (7 - i) for i, n in enumerate(parts))
    return total + sum(row_digest(list(values)) for values in zip(*[c.to_pylist() for c in rows.columns]))


@dataclass
class Written(WriterCommitMessage):
    """A task's files by table: path, rows and the sum of their rows' digests."""

    files: list[dict] = field(default_factory=list)


@dataclass
class Manifest:
    number: int = 0
    columns: list[str] = field(default_factory=list)
    files: list[dict] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)

    @property
    def digest(self) -> str:
        """Number of rows and a digest of them, whatever their order."""
        return f"{sum(f['rows'] for f in self.files)}:{sum(f['digest'] for f in self.files) % (1 << 256):064x}"


def latest(folder: str) -> Manifest:
    """What counts now; an empty manifest where nothing was committed."""
    store, top = _open(folder)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.base_name.startswith(MANIFEST)]
    if not names:
        return Manifest()
    with store.open_input_stream(f"{top}/{max(names)}") as source:
        return Manifest(**json.loads(source.read()))


def _publish(folder: str, manifest: Manifest) -> None:
    """Make the manifest appear whole and only if its number is free."""
    store, top = _open(folder)
    draft, path = f"{top}/.draft-{uuid.uuid4().hex}", f"{top}/{MANIFEST}{manifest.number:012d}.json"
    with store.open_output_stream(draft) as out:
        out.write(json.dumps(asdict(manifest)).encode())
    try:
        if isinstance(store, fs.LocalFileSystem):
            os.link(draft, path)  # fails if it is there
            store.delete_file(draft)
        elif store.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        else:
            store.move(draft, path)  # on HDFS fails if it is there
    except OSError as e:
        raise Conflict(f"another writer has committed number {manifest.number}") from e


class _Writer:
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.folder, self.batch, self.before, self.table = options["path"], options.get("batch"), options.get("before"), options.get("table")
        self.columns, self.overwrite = columns, overwrite
        if self.table is not None and self.table not in columns:
            raise ValueError(f"there is no column {self.table}")

    def write(self, rows) -> Written:
        shape = self._shape()
        texts = lambda some: zip(*[["" if v is None else str(v) for v in row] for row in some])
        return self._write(pa.record_batch([pa.array(c, pa.string()) for c in texts(some)], schema=shape) for some in batched(rows, 128))

    def _shape(self) -> pa.Schema:
        return pa.schema([(c, pa.string()) for c in self.columns])

    def _write(self, batches: Iterable[pa.RecordBatch]) -> Written:
        """A file for each table; ``batches`` are of strings without NULLs."""
        store, top = _open(self.folder)
        store.create_dir(f"{top}/data", recursive=True)
        outs: dict[str, tuple] = {}
        place = self.columns.index(self.table) if self.table else None
        totals: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        try:
            for batch in batches:
                names = batch.column(place) if place is not None else None
                for name in names.unique().to_pylist() if names is not None else [""] if batch.num_rows else []:
                    if name not in outs:
                        path = f"data/{uuid.uuid4().hex}.csv"
                        out = store.open_output_stream(f"{top}/{path}")
                        outs[name] = (path, out, csv.CSVWriter(out, self._shape(), write_options=csv.WriteOptions(quoting_style="all_valid")))
                    rows = batch if names is None else batch.filter(pc.equal(names, name))
                    outs[name][2].write_batch(rows)
                    totals[name][0] += rows.num_rows
                    totals[name][1] += digest_sum(rows)
        finally:
            for _, out, text in outs.values():
                text.close()
                out.close()
        return Written([{"path": path, "table": name, "rows": totals[name][0], "digest": totals[name][1] % (1 << 256)} for name, (path, _, _) in outs.items()])

    def abort(self, messages: list[Written | None], *_) -> None:
        store, top = _open(self.folder)
        for f in (f for m in messages if m is not None for f in m.files):
            if store.get_file_info(f"{top}/{f['path']}").type != fs.FileType.NotFound:
                store.delete_file(f"{top}/{f['path']}")

    def publish(self, messages: list[Written | None], batch: str | None) -> None:
        now, new = latest(self.folder), [f for m in messages if m is not None for f in m.files]
        if batch is not None and batch in now.batches:
            self.abort(messages)  # it was committed before
            return
        try:
            if self.before is not None and now.digest != self.before:
                raise Conflict("the destination has changed")
            if now.columns and now.columns != self.columns and not self.overwrite:
                raise Conflict(f"{self.folder} has other columns: {', '.join(now.columns)}")
            _publish(self.folder, Manifest(now.number + 1, self.columns, [*([] if self.overwrite else now.files), *new], [*now.batches, *([batch] if batch is not None else [])]))
        except Conflict:
            self.abort(messages)
            raise


class BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, self.batch)


class TextWriter(BatchWriter, DataSourceArrowWriter):
    """Rows of strings stay in Arrow batches, no Python object is made for a row or a value."""

    def write(self, iterator) -> Written:
        shape = self._shape()
        return self._write(pa.record_batch([pc.fill_null(c.cast(pa.string()), "") for c in batch.columns], schema=shape) for batch in iterator)


class StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, f"{self.batch or 'stream'}-{batchId}")


class Journal(DataSource):
    """The data source ``journal``; options path, batch, before (a digest) and table."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in latest(self.options["path"]).columns)

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        kind = TextWriter if all(isinstance(f.dataType, StringType) for f in schema.fields) else BatchWriter
        return kind(dict(self.options), schema.fieldNames(), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Journal)


def read(spark: SparkSession, folder: str, table: str | None = None) -> DataFrame:
    """The rows that count now, of one table or of all."""
    now = latest(folder)
    paths = [f"{folder.rstrip('/')}/{f['path']}" for f in now.files if table is None or f["table"] == table]
    shape = ", ".join(f"`{c}` string" for c in now.columns) or "nothing string"
    if not paths:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).csv(paths, header=True, quote='"', escape='"', multiLine=True).na.fill("")


def vacuum(folder: str) -> int:
    """Delete files that no manifest names, left by attempts that never ended, while nothing is being written; how many there were."""
    store, top = _open(folder)
    named = set()
    for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if f.base_name.startswith(MANIFEST):
            with store.open_input_stream(f.path) as source:
                named |= {x["path"] for x in json.loads(source.read())["files"]}
    gone = [f for f in store.get_file_info(fs.FileSelector(f"{top}/data", allow_not_found=True)) if f"data/{f.base_name}" not in named]
    for f in gone:
        store.delete_file(f.path)
    return len(gone)
