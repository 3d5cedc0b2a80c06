"""Language identification by compression.

Every language gets a zstandard raw-content dictionary of its own training text.  A text's words of
letters, lower-cased, are cut into blocks, each block is compressed once with every dictionary, and the
language whose dictionary gives the smallest total wins.  The relative gap to the runner-up is the
score; a narrow gap is a rejection.

Defined cases: NULL text and text without a letter predict ``und`` with score 0 and are rejected;
empty training data predicts ``und`` for everything; a single learned language wins with score 1; ties
go to the language with more training rows, then to the alphabetically first; rows with the same text get the same prediction, so repeated rows
do; texts of any length are compressed whole (training reads their first ``DICT_BYTES`` characters); a language with less than
``LEAST_BYTES`` of training text isn't learned; a NULL ``doc_id`` is never held out, and its row is sampled by its text; columns of
the input beyond ``doc_id``, ``text`` and ``lang`` are passed through untouched.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gleaner.llm.common import free, small_batches, table

#: Bytes of one language's dictionary, and training rows read per language to fill it (bounded sample).
DICT_BYTES = 64 << 10
SAMPLE_ROWS = 400
#: Bytes of a text compressed at a time; all blocks of a text count.
BLOCK = 16 << 10
#: Thorough matching down to four bytes tells languages apart far better than the fast levels do.
SETTINGS = {"window_log": 18, "chain_log": 15, "hash_log": 15, "search_log": 2, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY, "write_content_size": 0, "write_dict_id": 0}
#: A score below this is a rejection.
MIN_SCORE = 0.004
WORD = re.compile(r"[^\W\d_]+")
#: What the pattern takes for letters and are none: numerals, fractions.
_OTHERS = {c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
_BLANKED = dict.fromkeys(map(ord, _OTHERS), " ")
#: Training text that a language needs.
LEAST_BYTES = 8

PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def letters(text: str) -> bytes:
    """The text's words of letters in lower case, a space after each; empty if it has no letter."""
    low = text.lower()
    if not low.isascii() and not _OTHERS.isdisjoint(low):
        low = low.translate(_BLANKED)
    return "".join(w + " " for w in WORD.findall(low)).encode("utf-8", "replace")


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(training: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, most frequent first, from ``text`` and ``lang`` of ``training``.

    The rows are a sample ordered by a hash of ``doc_id``: about ``SAMPLE_ROWS`` a language whatever the
    table's size, of which as many whole texts are kept as fit in ``DICT_BYTES``.
    """
    rows = training.where("lang IS NOT NULL AND length(trim(text)) > 0")
    turn = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, -(-SAMPLE_ROWS * 1_000_000 // n)))])
    drawn = rows.where(F.pmod(turn, F.lit(1_000_000)) < share[F.col("lang")])
    room: dict[str, list[bytes]] = {k: [] for k in counts}
    picked = drawn.select("lang", turn.alias("h"), F.substring("text", 1, DICT_BYTES).alias("text"))
    for lang, texts in (
        picked.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "text"))), 1, SAMPLE_ROWS).alias("t"))
    ).toLocalIterator():
        left = DICT_BYTES
        for _, text in texts:
            data = letters(text)
            if len(data) <= left:
                room[lang].append(data)
                left -= len(data)
        if not any(room[lang]):
            room[lang] = [letters(text)[:DICT_BYTES] for _, text in texts[:1]]
    found = {k: b"".join(v) for k, v in room.items()}
    return {k: found[k] for k in sorted(found, key=lambda k: (-counts[k], k)) if len(found[k]) >= LEAST_BYTES}


def predictor(spark: SparkSession, dictionaries: dict[str, bytes]):
    """A column function text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(dictionaries)
    langs = list(dictionaries)

    def sizes(data: bytes, packers) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(p.compress(b)) for b in blocks) for p in packers]

    @F.arrow_udf(PREDICTION)  # pandas would stay in the workers' memory
    def predict(texts: pa.Array) -> pa.Array:
        packers = []
        for k in langs:
            d = zstandard.ZstdCompressionDict(shared.value[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = zstandard.ZstdCompressionParameters(**SETTINGS)
            d.precompute_compress(compression_params=own)
            packers.append(zstandard.ZstdCompressor(compression_params=own, dict_data=d))
        out = []
        for text in texts.to_pylist():
            data = letters(text) if langs and text is not None else b""
            if not data:
                out.append(("und", 0.0))
                continue
            ranked = sorted(zip(sizes(data, packers), range(len(langs))))
            gap = 1.0 if len(ranked) == 1 else 1 - ranked[0][0] / ranked[1][0]
            out.append((langs[ranked[0][1]], float(gap)))
        preds, scores = zip(*out) if out else ((), ())
        return pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``, from nothing but ``text``."""
    small_batches(docs.sparkSession)
    names, own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")], free(docs, "__found")
    found = docs.select(*names, predictor(docs.sparkSession, dictionaries)(F.col("text").cast("string")).alias(own))
    return found.select(*names, f"{own}.lang_pred", f"{own}.score", (F.col(f"{own}.score") < MIN_SCORE).alias("rejected"))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without those whose language isn't told apart clearly enough."""
    small_batches(docs.sparkSession)
    learned, own = learn(docs.where(~held_out(F.col("doc_id")))), free(docs, "__found")
    found = docs.select("*", predictor(docs.sparkSession, learned)(F.col("text").cast("string")).alias(own))
    return found.where(F.col(f"{own}.score") >= MIN_SCORE).select(*docs.columns)


def language_id(docs: DataFrame) -> DataFrame:
    """Learn on the rows that aren't held out, predict all."""
    return identify(docs, learn(docs.where(~held_out(F.col("doc_id")))))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language_id": op7}
ORACLE_SQL: dict[str, str] = {}
