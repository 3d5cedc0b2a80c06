"""Collections replayed from files: a data source of payload files, index and detail rows, cursors, bounded reads, registries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleaner.functions import places, values as V

# What is known of each provider.
PROVIDERS = [
    ("greenhouse", "full_list", True, False), ("ashby", "full_list", True, False), ("lever", "paged_list", True, False),
    ("smartrecruiters", "list_and_detail", False, True), ("workday", "list_and_detail", False, True),
]
#: Days from which an index row's stated age is surely beyond 72 hours.
OLD = 4


def providers(spark: SparkSession) -> DataFrame:
    """A row per provider: how it lists postings, whether lists hold descriptions, whether details are hydrated."""
    return spark.createDataFrame(PROVIDERS, "source string, listing string, described boolean, hydrated boolean")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Payloads(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.board = options["path"], options.get("board", "")

    def partitions(self):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".json")]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(partition.path) as source:
            text = source.read().decode("utf-8", "replace")
        name = partition.path.rsplit("/", 1)[-1][: -len(".json")]
        yield ((self.board or name, name, name), text)


class PayloadSource(DataSource):
    """``spark.read.format("replayed-payloads").load(uri)``: a row per JSON file in a folder, its ``target`` and ``payload``, a task per file."""

    @classmethod
    def name(cls) -> str:
        return "replayed-payloads"

    def schema(self) -> str:
        return "target struct<board:string,company:string,employer_id:string>, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Payloads(self.options)


def detail_conflicts(detail: DataFrame, index: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``detail`` with ``reason`` where one of the fields contradicts the index row of the same key; NULL agrees with anything."""
    known = index.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    met = detail.join(known, key, "left")
    says = F.concat_ws(", ", *[F.when(F.col(f) != F.col(f"__{f}"), f"{f} differs") for f in fields])
    return met.withColumn("reason", F.nullif(says, F.lit(""))).drop(*[f"__{f}" for f in fields])


def merged(detail: DataFrame, index: DataFrame, key: str, fields: list[str], nested: dict[str, list[str]]) -> DataFrame:
    """Index rows with what their details say instead, field by field; structs are merged inside."""
    there = detail.select(key, *[F.col(f).alias(f"__{f}") for f in [*fields, *nested]])
    met = index.join(there, key, "left")
    plain = {f: F.coalesce(f"__{f}", f) for f in fields}
    inside = {f: F.struct(*[F.coalesce(F.col(f"__{f}.{x}"), F.col(f"{f}.{x}")).alias(x) for x in names]) for f, names in nested.items()}
    return met.withColumns(plain | inside).drop(*[f"__{f}" for f in [*fields, *nested]])


def hydration_list(index: DataFrame, known: DataFrame, key: str, budget: int, order: list) -> DataFrame:
    """Index rows worth a detail request: not those stated as old, nor known ones beyond the overlap of 26 hours; new rows of unknown
    age up to a budget for each board.  ``index`` has board, posted_at, evaluated_at and age_days."""
    seen = known.select(key).distinct().withColumn("__known", F.lit(True))
    met = index.join(seen, key, "left").where(~F.coalesce(V.older_than_72h(F.col("age_days")), F.lit(False)))
    hours = V.age_seconds(F.col("posted_at"), F.col("evaluated_at")) / 3600
    unknown = F.col("posted_at").isNull()
    met = met.where(F.col("__known").isNull() | (~unknown & (hours <= 26)))
    turn = F.row_number().over(Window.partitionBy("board", unknown).orderBy(*order))
    return met.withColumn("__turn", turn).where(~unknown | (F.col("__turn") <= budget)).drop("__turn", "__known")


def cdx_rows(lines: DataFrame) -> DataFrame:
    """Records of a crawl index given as JSON lines (``value``): ``url``, ``timestamp``, ``status`` and the target that it names.  Lines
    that are no record, as those of a missing page, give no row."""
    record = F.from_json("value", "url string, timestamp string, status string")
    rows = lines.select(record.alias("r")).where("r.url IS NOT NULL").select("r.*")
    return rows.withColumn("target", places.link_target(F.col("url")))


def start_page(name: Column, pages: Column) -> Column:
    """The page where a cursor over ``pages`` pages begins: by the name's digest."""
    return F.pmod(F.conv(F.substring(F.sha2(name, 256), 1, 12), 16, 10).cast("long"), pages)


#: Numbers that are tried for a stride, more than any long needs.
STRIDES = 64


def _coprime(first: pd.Series, pages: pd.Series) -> pd.Series:
    n, stride = pages.to_numpy(), first.to_numpy().copy()
    for _ in range(STRIDES - 1):
        again = np.flatnonzero(np.gcd(stride, n) != 1)  # fewer from time to time
        if not len(again):
            break
        stride[again] = stride[again] % n[again] + 1
    return pd.Series(np.where(np.gcd(stride, n) == 1, stride, 1))


def page_stride(name: Column, pages: Column) -> Column:
    """A stride without a common divisor with ``pages``, so that a cursor comes to every page: the first from the digest on."""
    first = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit("stride:"), name), 256), 1, 12), 16, 10).cast("long"), pages) + 1
    return F.pandas_udf(_coprime, "long")(F.coalesce(first, F.lit(1).cast("long")), F.coalesce(pages, F.lit(1)).cast("long"))


def bounded(rows: DataFrame, most_rows: int, most_bytes: int, text: str) -> DataFrame:
    """``rows``, unless they are more than ``most_rows`` or their ``text`` more than ``most_bytes``: then an error, and never a part of them."""
    n, size = rows.limit(most_rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    if n > most_rows or size > most_bytes:
        raise ValueError(f"more than {most_rows} rows or {most_bytes} bytes")
    return rows


def blacklist(sheet: DataFrame) -> DataFrame:
    """Rows of a blacklist sheet (``value``): blank ones go, and ``kind`` is ``note`` for those that speak of a bid."""
    said = F.trim("value")
    return sheet.where(F.coalesce(said, F.lit("")) != "").select(said.alias("value"), F.when(F.contains(F.lower(said), F.lit("bid")), "note").otherwise("url").alias("kind"))


def configuration(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with an explicit schema; a file that doesn't fit it is an error."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")
