"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

All in DataFrame functions.  A text is split at a kind's pattern; the pieces and the matches alternate, so a
match's place is the running length of what is before it, and the pieces beside it are its context.

The patterns are written so that no text, however long, makes them backtrack or recurse: they start only
where a run of their characters starts, take whole runs, and repeat single characters instead of groups.

Kinds: email, ip (parts up to 255), card (14 to 19 digits, Luhn) and phone (10 to 15 digits) always stay; the
method adds iban (mod 97) and ssn, whose pattern alone is too weak: it needs a context word beside it.

Defined cases: NULL and empty texts have no spans; repeated rows and rows with NULL ``doc_id`` each get their row;
other columns don't matter; an empty table gives no rows; places are in code points, the end exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleaner.llm.common import table

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: By kind, in the order in which kinds sort: pattern, a cheap test of whether it can match at all, score on a
#: match, words that raise the score.
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++\.[{_LABEL}]++(?:\.[{_LABEL}]++)*+", "@", 0.8, "mail|contact|write|reply"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9][.][0-9]", 0.6, r"\bip\b|host|server|address|login"),
    "card": (r"[0-9][0-9 -]++", "[0-9]{2}", 0.9, "card|visa|credit|pay"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "[+]", 0.7, r"phone|\btel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.9, "iban|bank|account|konto"),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.4, "ssn|social|security"),
}
BASE = ("email", "ip", "card", "phone")
#: What a context word adds, how many characters around a match are searched, and the least score of an added kind.
CONTEXT, NEAR, LEAST = 0.2, 40, 0.6


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def confirmed(kind: Column, match: Column, n_digits: Column) -> Column:
    """The check of a match beyond its pattern."""
    plain = lambda p: F.regexp_replace(p, "^0+", "")
    small = F.forall(F.split(match, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(F.substring(plain(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(n_digits.between(14, 19), luhn(only_digits(match))).otherwise(False))
        .when(kind == "phone", n_digits.between(10, 15))
        .when(kind == "iban", F.when(F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34), mod97(F.replace(match, F.lit(" "), F.lit("")))).otherwise(False))
        .otherwise(True)
    )


def proposals(text: Column, kind: str) -> Column:
    """An array of (kind, number, characters before it since the last match, match, context)."""
    pattern, test, _, _ = KINDS[kind]
    # single separators between digits are the only ones that a card number may have: the others are blanked
    within = F.regexp_replace(text, "(?<![0-9])[ -]|[ -](?![0-9])", "\t") if kind == "card" else text
    pieces, matches = F.split(within, pattern, -1), F.regexp_extract_all(within, F.lit(pattern), F.lit(0))

    def one(match: Column, i: Column) -> Column:
        before, after = F.get(pieces, i), F.get(pieces, i + 1)
        near = F.lower(F.concat(F.when(F.length(before) > NEAR, before.substr(F.length(before) - NEAR + 1, F.lit(NEAR))).otherwise(before), F.lit(" "), F.substring(after, 1, NEAR)))
        return F.struct(F.lit(list(KINDS).index(kind)).alias("rank"), i.alias("i"), F.length(before).alias("gap"), match.alias("match"), near.alias("near"))

    return F.when(text.rlike(test), F.transform(matches, one))


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, counts of the base kinds, ``base_sha256``, ``spans`` and their ``scores``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = F.array_compact(F.array(*[proposals(text, k) for k in KINDS]))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.when(text.rlike("[0-9@]"), F.flatten(some)).alias("all"))
    each = rows.select("doc_id", "row", F.explode_outer("all").alias("m")).select("doc_id", "row", "m.*").repartition("row")
    stop = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("row", "rank").orderBy("i"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    prior = F.element_at(F.array(*[F.lit(x[2]) for x in KINDS.values()]), F.col("rank") + 1)
    context = reduce(lambda e, k: e.when(kind == k, F.col("near").rlike(KINDS[k][3])), KINDS, F.when(F.lit(False), False))
    score = F.least(prior + F.when(context, CONTEXT).otherwise(0.0), F.lit(1.0))
    n_digits = F.length(only_digits(F.col("match")))
    base = kind.isin(*BASE)
    found = each.withColumn("stop", stop).withColumn("kind", kind).withColumn("score", score)
    found = found.withColumn("good", F.coalesce(confirmed(F.col("kind"), F.col("match"), n_digits) & (base | (F.col("score") >= LEAST)), F.lit(False)))
    span = F.struct((F.col("stop") - F.length("match")).alias("start"), "rank", F.concat_ws(":", "kind", (F.col("stop") - F.length("match")).cast("string"), F.col("stop").cast("string")).alias("span"), "score")
    lists = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count_if(F.col("good") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.when(F.col("good"), span))).alias("all"),
    )
    joined = lambda x: F.array_join(F.transform(x, lambda s: s["span"]), ",")
    return lists.select(
        "doc_id", *[f"n_{k}" for k in BASE],
        F.sha2(joined(F.filter("all", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"), F.transform("all", lambda s: s["score"]).alias("scores"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6}
ORACLE_SQL: dict[str, str] = {}
