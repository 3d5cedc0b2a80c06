"""Token ids in binary files: directly addressable codes.

An id is cut into chunks of 8, 4 and 4 bits (more chunks of 4 for larger ids).  Level 0 holds the low chunk
of every id; a bitmap says which ids go on to the next level, and a directory of bit counts ranks a place
in the bitmap, so the chunk on the next level is found without decoding anything before it.  The ``i``-th
token of a file costs one lookup per level.

A corpus is a folder of such files, in ascending ``doc_id`` order: file ``part-P-K`` holds the K-th run
of whole documents of range partition P.  Every task writes its files under another name first and moves
them when they are complete, so a repeated task leaves the same files.

Defined cases: NULL and empty texts have only the end id; a NULL ``doc_id`` sorts first; repeated rows of a
``doc_id`` are documents of their own, ordered by text; a text of any length stays in one file; other columns don't matter;
an empty table gives no files and no rows; a vocabulary file that splits text in another way is refused.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.common import cut, scratch, small_batches, table
from gleaner.llm.pretokens import byte_letters, load, pretokens, splitter, vocabulary_path

#: A file is closed when it holds this many ids; a document is never split.
FILE_TOKENS = 4 << 20
#: Bits of a directory entry's run.
RUN = 512
FIRST, NEXT = 8, 4
MAGIC = b"GLNDAC01"
#: Words whose tokens a worker remembers.
MEMORY = 400_000
END_ID = 0


def pack(values: np.ndarray, bits: int) -> bytes:
    """Chunks of 8 or 4 bits as bytes; of 4, the even ones are the low halves."""
    if bits == 8:
        return values.astype(np.uint8).tobytes()
    values = np.append(values, 0) if len(values) % 2 else values
    return (values[::2] | values[1::2] << 4).astype(np.uint8).tobytes()


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Chunks start to stop, from the bytes that hold them."""
    raw = np.frombuffer(data, np.uint8)
    if bits == 8:
        return raw[: stop - start].astype(np.uint32)
    both = np.stack([raw & 15, raw >> 4], axis=1).ravel()
    return both[start % 2 : start % 2 + stop - start].astype(np.uint32)


def dump(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file: magic, counts, document table, then per level its chunks, bitmap and directory."""
    parts, rest, bits = [], ids.astype(np.uint32), FIRST
    while True:
        more = rest >> bits
        going = more > 0
        parts.append((bits, len(rest), pack(rest & ((1 << bits) - 1), bits), going))
        if not going.any():
            break
        rest, bits = more[going], NEXT
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = np.array([len(ids), len(doc_ids), len(parts)], "<u8").tobytes()
    body = [MAGIC, head, np.array([n for _, n, _, _ in parts], "<u8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(lengths, "<u8").tobytes()]
    for bits, n, chunks, going in parts:
        runs = np.zeros(-(-n // RUN) + 1, "<u8")
        if n:
            runs[1:] = np.cumsum(np.add.reduceat(going.astype(np.int64), np.arange(0, n, RUN)))
        body += [chunks, np.packbits(going, bitorder="little").tobytes(), runs.tobytes()]
    return b"".join(body)


@dataclass
class TokenFile:
    """Random access to the ids of one file; reads only the bytes that a request needs."""

    source: pa.NativeFile

    def __post_init__(self):
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.n_tokens, self.n_docs, levels = np.frombuffer(self._read(8, 24), "<u8").tolist()
        self.counts = np.frombuffer(self._read(32, 8 * levels), "<u8").tolist()
        self._docs = at = 32 + 8 * levels
        at += 17 * self.n_docs
        self._places = []
        for i, n in enumerate(self.counts):
            size = n if i == 0 else -(-n // 2)
            bitmap = at + size
            runs = bitmap + -(-n // 8)
            self._places.append((at, bitmap, runs))
            at = runs + 8 * (-(-n // RUN) + 1)

    def _read(self, at: int, size: int) -> bytes:
        return self.source.read_at(size, at)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the file's documents and how many tokens each has."""
        n = self.n_docs
        ids = np.frombuffer(self._read(self._docs, 8 * n), "<i8").tolist()
        known = self._read(self._docs + 8 * n, n)
        return [d if k else None for d, k in zip(ids, known)], np.frombuffer(self._read(self._docs + 9 * n, 8 * n), "<u8").astype(np.int64)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop of the file."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where, shift = np.arange(len(out)), 0
        for i in range(len(self.counts)):
            if stop <= start:
                break
            bits = FIRST if i == 0 else NEXT
            chunks, bitmap, runs = self._places[i]
            per = 8 // bits
            out[where] |= unpack(self._read(chunks + start // per, (stop - 1) // per - start // per + 1), bits, start, stop) << np.uint32(shift)
            shift += bits
            # the rank of the first place: its run's entry and the bits before it in the run
            run = start // RUN
            low = run * RUN
            going = np.unpackbits(np.frombuffer(self._read(bitmap + low // 8, (stop - 1) // 8 - low // 8 + 1), np.uint8), bitorder="little")
            before = int(np.frombuffer(self._read(runs + 8 * run, 8), "<u8")[0]) + int(going[: start - low].sum())
            going = going[start - low : stop - low].astype(bool)
            where = where[going]
            start, stop = before, before + len(where)
        return out

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


class Library(dict):
    """The tokenizers library's ids, as little-endian 32-bit bytes, of words met lately.

    The library splits text into words before it merges, and merges never cross words, so a text's ids are
    its words' ids one after another; only words that aren't remembered go to the library's model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # kept, as the model is a part of it
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.special = {k: np.array([i], "<u4").tobytes() for k, i in load(path)[4].items()}
        self.cut = splitter(self.special)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        found = self.model.tokenize(word.encode("utf-8", "replace").decode("latin-1").translate(self.letters))
        self[word] = ids = array("I", [t.id for t in found]).tobytes()
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = self.cut.split(text) if self.cut else [text]
        return b"".join(self.special[p] if p in self.special else b"".join(map(self.__getitem__, pretokens(p))) for p in parts)


_WRITTEN = "path string, part int, before long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents, ``end_id`` after each, in ascending ``doc_id`` order to ``folder``, a URI
    that executors can write to.  Returns a row per file: ``path``, ``part``, ids of its partition
    ``before`` it, and ``n_tokens``."""
    spark = docs.sparkSession
    small_batches(spark)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part = TaskContext.get().partitionId()
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        codec = Library(vocabulary_path(vocabulary))
        ids: list[bytes] = []
        names: list[int | None] = []
        before = number = held = 0

        def close():
            nonlocal before, number, held, ids, names
            data = dump(names, [len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), "<u4"))
            path = f"{top}/part-{part:06d}-{number:06d}.dac"
            draft = f"{path}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, path)
            row = pa.RecordBatch.from_pylist([{"path": path, "part": part, "before": before, "n_tokens": held}], pa.schema([("path", pa.string()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64())]))
            before, number, held, ids, names = before + held, number + 1, 0, [], []
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = codec.encode(text)
                names.append(doc)
                ids.append(data + end)
                held += len(data) // 4 + 1
                if held >= FILE_TOKENS:
                    yield close()
        if names:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(rows.mapInArrow(run, _WRITTEN))


def read_tokens(written: DataFrame, folder: str) -> DataFrame:
    """Read files back: a row per document with ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32``."""
    spark = written.sparkSession
    totals = written.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per partition
    first, so_far = {}, 0
    for part, n in totals:
        first[part] = so_far
        so_far += n

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as source:
                    file = TokenFile(source)
                    names, lengths = file.documents()
                    stops = np.cumsum(lengths)
                    starts = stops - lengths
                    base = first[row["part"]] + row["before"]
                    crcs = []
                    step = 4096
                    for i in range(0, len(names), step):  # a bounded run of documents at a time
                        low = int(starts[i])
                        ids = file.slice(low, int(stops[min(i + step, len(names)) - 1])).astype("<u4")
                        crcs += [zlib.crc32(ids[a - low : b - low].tobytes()) for a, b in zip(starts[i : i + step].tolist(), stops[i : i + step].tolist())]
                for i in range(0, len(names), 10_000):
                    some = slice(i, i + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[some], pa.int64()), pa.array(starts[some] + base, pa.int64()), pa.array(lengths[some], pa.int64()), pa.array(crcs[some], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return written.repartition(n).mapInArrow(run, _READ)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), folder), folder)


QUERIES = {"op5_token_output": op5}
ORACLE_SQL: dict[str, str] = {}
