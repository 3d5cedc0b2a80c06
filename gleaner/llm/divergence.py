"""How far the sources of a language differ in their words, against each other and against the language.

A language keeps the terms that enough of its documents hold.  Every group (language, source) gives each kept term a smoothed
share p in billionths; two groups differ by the sum of ``abs(p - q)`` over all V kept terms.  An inverted index makes that sum without
visiting terms that neither group has: the pair starts at V times the difference f of two zero counts, and postings correct it.

For a term in one group only, the correction ``abs(p1 - zero2) - f`` depends on its count there alone, so each group
states how many terms it has of each count.  For a term in both, the two one-sided corrections are undone and the true difference
put in their place, by a join of the postings of a term that emits only what isn't zero.  All sums are of integers.

Defined cases: NULL ``text``, ``lang`` or ``source`` count as empty; a group without terms has all zero counts, and with V = 0
all pairs differ by 0; each row is a document, rows that repeat a ``doc_id`` too; texts are read whole, whatever their length; ties of value go
by UTF-8 order; a lone source has no pairs; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleaner.llm.common import cut, small_batches, table

#: Documents of a language that hold a kept term, what is added to every count, what a share of 1 is, and terms listed per group.
LEAST_DOCS, SMOOTH, ONE, TOP = 30, 5, 1_000_000_000, 50
#: Counts that a task holds before it emits them.
HELD = 200_000
#: Bytes of terms (letters, and all of non-ASCII characters) in lower case, everything else as a blank.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def counted(docs: DataFrame) -> DataFrame:
    """Occurrences ``n`` of each term of a group and the ``docs`` that hold it; a NULL term says that the group occurs."""
    small_batches(docs.sparkSession)

    def count(batches):
        seen: dict[tuple, Counter] = defaultdict(Counter)
        held: dict[tuple, Counter] = defaultdict(Counter)

        def emit():
            for (lang, source), n in seen.items():
                terms, m = [None, *n], len(n) + 1
                d = held[lang, source]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([source] * m), pa.array(terms, pa.binary()), pa.array([0, *n.values()]), pa.array([0, *map(d.__getitem__, n)])], schema=_COUNTED)
            seen.clear()
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n = seen[lang, source]
                terms = text.translate(_TERMS).split()
                size -= len(n)
                n.update(terms)
                held[lang, source].update(set(terms))
                size += len(n)
                if size >= HELD:
                    yield from emit()
                    size = 0
        yield from emit()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(ONE * (n + SMOOTH) / (total + SMOOTH * terms))`` without a product that overflows."""
    above = F.lit(ONE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    below = (total + SMOOTH * terms).cast("decimal(28,0)")
    return F.call_function("div", above, below) + 1


def index(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The groups, with their share ``zero`` of a count of zero and the ``terms`` of their language, and the
    postings of kept terms: ``p`` and ``zero`` of the group, ``q`` of the language.  Both are written."""
    counts = cut(counted(docs))
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    postings = cut(counts.where("term IS NOT NULL").drop("docs").join(kept.drop("docs"), ["lang", "term"]))
    langs = postings.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"])
    groups = cut(groups.withColumn("zero", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0)))
    known = postings.join(groups, ["lang", "source"])
    known = known.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    return groups, cut(known.select("lang", "source", "term", "p", "q", "zero"))


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """``lang``, sources ``a`` < ``b`` and the sum of ``abs(p - q)`` over all kept terms as ``value``."""
    a = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("zero_a"), "terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    zeros = a.join(b, (a.lang == b.lang) & (F.col("a") < F.col("b"))).select(a.lang, "a", "b", (F.col("terms") * F.abs(F.col("zero_a") - F.col("zero_b"))).alias("value"))
    of_count = postings.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("n"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_other"))
    alone = of_count.join(other, "lang").where(F.col("source") != F.col("other"))
    changed = F.col("n") * (F.abs(F.col("p") - F.col("zero_other")) - F.abs(F.col("zero") - F.col("zero_other")))
    alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), changed.alias("value"))
    left = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("zero").alias("zero_a"))
    right = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = left.join(right, ["lang", "term"]).where(F.col("a") < F.col("b"))
    both = both.select("lang", "a", "b", (apart("p_a", "p_b") - apart("p_a", "zero_b") - apart("zero_a", "p_b") + apart("zero_a", "zero_b")).alias("value"))
    return zeros.unionByName(alone.where("value != 0")).unionByName(both.where("value != 0")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """A row for each other source of a group (part ``pair``), and for each of the ``top`` terms that it has more of than its language (``term``)."""
    groups, postings = index(docs, least_docs)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, postings).select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(first))
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {"op13_source_divergence": op13}
ORACLE_SQL = {
    "op13_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
words AS (SELECT id, lang, source, unnest(found) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
         1 + (1000000000 * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source != o.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
found AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
}
