"""Line deduplication: a segment-partition edit join.

Two lines within ``EDITS`` = 2 edits, cut into three segments, share one that no edit touches.  The first segment is
measured from the start of a line and the last one from its end, so they are where they were; if both are touched, it is by
one edit each, and the middle one is at most one character away: a line is filed under its middle segment and looks for
others one character further on, and one of two lines finds the other.  Segments are as long as lines of about that length
allow: lengths with the same three leading bits are a class, and a line is in the class of its length and, if that is another
one, in the class of lines two characters longer.  Pairs that meet are compared by how often they have
each letter, lose what they have in common at both ends, and are verified by banded bit-parallel edit distance: a window
of ``2 * EDITS + 1`` bits moves down the main diagonal.

All in DataFrame functions.  Equal lines (known by 128 bits) are one line throughout.  In every key all lines first meet only
the smallest one; once these links have merged classes, only pairs from different classes are still looked at, which leaves
out nothing but pairs that are in one class already.  A key of more than ``HOT`` lines is split: what two linked lines have
beside the shared segment is within the same edits, so it is cut into segments again, and a segment of that is added to the
key, up to ``LEVELS`` times; the pairs of a key that stays hot are dealt over many tasks.

Of each class of linked lines, the first occurrence in the order of documents and lines stays.

Defined cases: NULL and empty texts have one empty line; blank lines always stay; lines under ``LEAST`` characters are
only compared exactly; lines and texts of any length are compared whole; rows that repeat ``doc_id`` and text count as one
document; a NULL ``doc_id`` is a document like others and sorts first; other columns don't matter, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm.common import cut, drop_path, matched, scratch, spread_join, table, thinned
from gleaner.operators.components import components

EDITS = 2
#: Lines of fewer characters are only compared exactly.
LEAST = 20
#: Keys of more lines are split, LEVELS times at most, and while what is left of the lines has LEAST_REST characters.
HOT, LEVELS, LEAST_REST = 1000, 2, 8
#: Letters whose counts are compared; an edit changes two of them by one at most.
LETTERS = "etaoinshrdlucmfwypvbgkéçñüö,. -0"
#: Keys of a class: first segment, last segment, middle segment, and what would be the middle one a character further on.
#: A line is filed under the first FILED of them.
KINDS, FILED = 4, 3


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """A row per line that isn't blank: document key (``doc``, ``th``), number ``n``, ``line`` and its length ``len``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    return named.where(F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "").withColumn("len", F.length("line"))


def length_class(n: Column) -> Column:
    """The least length with the same three leading bits, or of the same four; every class has four lengths or more."""
    low = F.length(F.bin(n)) - 3
    return F.when(n < 32, n - n % 4).otherwise(F.call_function("shiftleft", F.call_function("shiftright", n, low), low))


def segments(n: Column, least: Column) -> list[tuple[Column, Column]]:
    """Place, from 1, and length of the segment of each kind, in a line of ``n`` characters of the class of ``least``.

    Lines of the class have ``least - 2`` characters at least, a character of which is left free on both sides of the middle.
    """
    end = F.call_function("div", least - 4, F.lit(3)).cast("int")
    middle = least - 4 - 2 * end
    return [(F.lit(1), end), (n - end + 1, end), (end + 2, middle), (end + 3, middle)]


def keys(line: Column, n: Column, *more: Column) -> Column:
    """An array of KINDS keys for the line's class, and as many for the class of lines two characters longer if that is another one."""

    def of(least: Column) -> Column:
        return F.array(*[F.xxhash64(*more, F.lit(min(i, 2)), least, line.substr(at, length)) for i, (at, length) in enumerate(segments(n, least))])

    one, two = length_class(n), length_class(n + EDITS)
    return F.when(one == two, of(one)).otherwise(F.concat(of(one), of(two)))


def letter_counts(line: Column) -> Column:
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS])


def sketch(counts: Column) -> Column:
    """The letter counts modulo 4 in two bits each, in an order in which neighbours differ in one: sketches differ in no more bits
    than letters are more or less, so within EDITS edits in ``2 * EDITS`` at most."""
    two = lambda x: (x % 4).bitwiseXOR(F.shiftright(x % 4, 1)).cast("long")
    return F.aggregate(counts, F.lit(0).cast("long"), lambda bits, x: F.shiftleft(bits, 2).bitwiseOR(two(x)))


def alike(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2 * EDITS


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two strings is at most ``edits`` (up to 31)."""
    longer = F.length(a) > F.length(b)
    letters = lambda c: F.array_remove(F.split(c, ""), "")
    pair = F.struct(letters(F.when(longer, b).otherwise(a)).alias("p"), letters(F.when(longer, a).otherwise(b)).alias("t"))
    return let(pair, lambda s: _walk(s["p"], s["t"], edits))


def _walk(p: Column, t: Column, edits: int) -> Column:
    """Whether two arrays of characters, the second one not the shorter, are within ``edits``."""
    m, n = F.size(p), F.size(t)
    ones = (1 << (2 * edits + 1)) - 1
    bit = lambda x, i: F.call_function("shiftright", x, i).bitwiseAND(F.lit(1).cast("long"))

    def column(state: Column, j: Column) -> Column:
        vp, vn, d = state["vp"], state["vn"], state["d"]
        same = F.lit(0).cast("long")
        for i in range(2 * edits + 1):  # bit i is row j - edits + i
            at = j - 1 - edits + i
            same = same.bitwiseOR(F.when((at >= 0) & (F.get(p, F.greatest(at, F.lit(0))) == F.get(t, j - 1)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))

        def deltas(x: Column) -> Column:
            d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(ones).cast("long"))
            return let(d0, after)

        def after(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(ones).cast("long"))
            hn = d0.bitwiseAND(vp)
            return let(F.struct(hp.alias("hp"), hn.alias("hn"), F.shiftrightunsigned(d0, 1).alias("down"), d0.alias("d0")), moved)

        def moved(s: Column) -> Column:
            last = F.greatest(m - j + edits, F.lit(0))  # the bit of row m, once the diagonal has reached it
            step = F.when(j <= m, 1 - bit(s["d0"], F.lit(edits))).otherwise(bit(s["hp"], last) - bit(s["hn"], last))
            return F.struct(
                s["hn"].bitwiseOR(F.bitwise_not(s["down"].bitwiseOR(s["hp"]))).bitwiseAND(F.lit(ones).cast("long")).alias("vp"),
                s["down"].bitwiseAND(s["hp"]).alias("vn"), (d + step).alias("d"),
            )

        # beyond twice the bound on the diagonal, the last columns can't bring the distance back
        return F.when(d > 2 * edits, state).otherwise(let(same, deltas))

    start = F.struct(F.lit((ones >> edits) << edits).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(0).cast("long").alias("d"))
    walked = F.aggregate(F.sequence(F.lit(1), n), start, column, lambda s: s["d"])
    return F.when(n - m > edits, False).when(m == 0, n <= edits).otherwise(walked <= edits)


def without_common_start(pair: Column) -> Column:
    """A struct of two strings ``p`` and ``t`` without the characters that both start with, up to 65,535 of them."""

    def cut_off(s: Column) -> Column:
        least = F.least(F.length(s["p"]), F.length(s["t"]))

        def further(n: Column, step: Column) -> Column:
            part = lambda c: s[c].substr(n + 1, step)
            return F.when((n + step <= least) & (part("p") == part("t")), n + step).otherwise(n)

        common = F.aggregate(F.array(*[F.lit(1 << i) for i in range(15, -1, -1)]), F.lit(0), further)
        return let(common, lambda n: F.struct(*[s[c].substr(n + 1, F.length(s[c])).alias(c) for c in "pt"]))

    return let(pair, cut_off)


def close(a: Column, b: Column) -> Column:
    """Whether two strings are within EDITS edits; what they have in common at either end doesn't change their distance."""
    left = without_common_start(F.struct(a.alias("p"), b.alias("t")))
    turned = let(left, lambda s: F.struct(F.reverse(s["p"]).alias("p"), F.reverse(s["t"]).alias("t")))
    return let(without_common_start(turned), lambda s: within(s["p"], s["t"]))


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` within EDITS edits, of lines ``own(id, line, counts)``."""
    left, right = own.select(F.col("id").alias("a"), F.col("line").alias("ta"), F.col("counts").alias("ca")), own.select(F.col("id").alias("b"), F.col("line").alias("tb"), F.col("counts").alias("cb"))
    differ = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    met = pairs.join(left, "a").join(right, "b").where((differ <= 2 * EDITS) & (F.abs(F.length("ta") - F.length("tb")) <= EDITS))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.select("a", "b", "ta", "tb").repartition(parts, "a", "b").where(close(F.col("ta"), F.col("tb"))).select("a", "b")


def filed(j: Column) -> Column:
    return F.pmod(j, F.lit(KINDS)) < FILED


def split_hot(shared: DataFrame, own: DataFrame, hot: int) -> DataFrame:
    """``shared(key, j, id)`` as ``key``, ``id``, ``filed``, with every key of more than ``hot`` lines replaced by finer ones:
    the key with a segment of what the lines have beside the segment of the key."""
    now = shared.select("key", "j", "id", filed(F.col("j")).alias("filed"), F.lit(None).cast("string").alias("rest"))
    done = []
    for _ in range(LEVELS):
        sizes = cut(now.groupBy("key").agg(F.count("*").alias("m")))
        if sizes.where(F.col("m") > hot).isEmpty():
            break
        sized = cut(spread_join(now, sizes, "key", "id"))
        done.append(sized.where(F.col("m") <= hot).select("key", "id", "filed"))
        whole = sized.where(F.col("m") > hot).drop("m").join(own.select("id", "line"), "id").withColumn("rest", F.coalesce("rest", "line")).drop("line")
        whole = whole.withColumn("len", F.length("rest")).withColumn("least", length_class(F.col("len") + F.when(F.col("j") >= KINDS, EDITS).otherwise(0)))
        place = lambda part: F.element_at(F.array(*[x[part] for x in segments(F.col("len"), F.col("least"))]), F.pmod("j", F.lit(KINDS)) + 1)
        whole = whole.withColumns({"at": place(0), "size": place(1)})
        rest = F.concat(F.col("rest").substr(F.lit(1), F.col("at") - 1), F.col("rest").substr(F.col("at") + F.col("size"), F.col("len")))
        left = cut(whole.select("key", "id", "filed", rest.alias("rest")))
        # what gets too short to be cut stays together, with what is no more than EDITS longer
        done.append(left.where(F.length("rest") < LEAST_REST + EDITS).select("key", "id", "filed"))
        longer = left.where(F.length("rest") >= LEAST_REST).withColumn("len", F.length("rest"))
        finer = longer.withColumn("finer", keys(F.col("rest"), F.col("len"), F.col("key"))).select("id", "rest", "filed", F.posexplode("finer").alias("j", "key"))
        finer = cut(finer.select("key", "j", "id", (F.col("filed") & filed(F.col("j"))).alias("filed"), "rest"))
        met = cut(finer.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("filed").alias("filed")).where("filed AND lo != hi").select("key"))
        now = cut(spread_join(finer, met, "key", "id"))
    return reduce(DataFrame.unionByName, done, now.select("key", "id", "filed"))


def line_links(shared: DataFrame, own: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between different lines within EDITS edits: enough of them to connect every class."""
    sketched = cut(shared.join(own.select("id", "sketch"), "id"))
    first = sketched.where("filed").groupBy("key").agg(F.min(F.struct("id", "sketch")).alias("f")).select("key", F.col("f.id").alias("b"), F.col("f.sketch").alias("sb"))
    star = spread_join(sketched, first, "key", "id").where((F.col("id") != F.col("b")) & alike("sketch", "sb")).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
    star = cut(star.distinct())
    links = cut(verified(star, own))
    roots = cut(components(links)).toDF("id", "root")
    rooted = sketched.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    left = cut(rooted.join(several, "key"))
    x, y = left.select("key", F.col("id").alias("ida"), "root", "sketch"), left.where("filed").select("key", F.col("id").alias("idb"), F.col("root").alias("rb"), F.col("sketch").alias("sb"))
    across = (F.col("root") != F.col("rb")) & alike("sketch", "sb")
    more = spread_join(x, y, "key", "ida", least=HOT).where(across).select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
    return links.union(verified(cut(more.join(star, ["a", "b"], "left_anti")), own))


def lines_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The ``line`` at each of ``places(id, hash, g, place)``, with its letter counts and their sketch."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = lambda doc, th: F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("")), th).alias("at")
    wanted = cut(places.groupBy(at(F.col("place.doc"), F.col("place.th"))).agg(F.collect_list(F.struct("id", "hash", "g", "place")).alias("wanted")))
    met = matched(docs.select(at(F.col("doc_id").cast("long"), F.xxhash64(text)), text.alias("text")), wanted, "at")
    each = met.select(F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("w")).select("w.*", F.get("lines", F.col("w.place.n")).alias("line"))
    counted = each.dropDuplicates(["id"]).withColumn("counts", letter_counts(F.col("line")))
    return counted.withColumn("sketch", sketch(F.col("counts")))


def line_hash(line: Column) -> Column:
    """Half of what a line is known by, and by what it goes while no other line has it."""
    return F.xxhash64(line)


def apart(met: DataFrame) -> DataFrame:
    """``met(key, j, id, hash, g, place)`` (written) in which different lines with one ``id`` go by the other half of what they are known by."""
    both = cut(met.groupBy("id").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("id"))
    return met if both.isEmpty() else cut(met.join(both.withColumn("both", F.lit(True)), "id", "left").withColumn("id", F.when(F.col("both"), F.col("g")).otherwise(F.col("id"))).drop("both"))


def decisions(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Occurrences that go: document key (``doc``, ``th``), line number ``n`` and whether it is a ``near`` copy.
    Keys of more than ``hot`` lines are split."""
    spark = docs.sparkSession
    own_keys = F.when(F.col("len") >= LEAST, keys(F.col("line"), F.col("len")))
    path = scratch(spark, "lines")
    hash_ = line_hash(F.col("line"))
    occurrences(docs).select("doc", "th", "n", hash_.alias("id"), F.xxhash64(F.lit(1), "line").alias("g"), own_keys.alias("keys")).write.parquet(path)
    rows, place = spark.read.parquet(path), F.struct("doc", "th", "n").alias("place")

    keyed = rows.select("id", "g", place, F.posexplode("keys").alias("j", "key"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("id", "g") for n, f in (("lo", F.min), ("hi", F.max))]  # four numbers, so that they are hashed and not sorted
    open_keys = cut(keyed.groupBy("key").agg(*ends).where("lo_id != hi_id OR lo_g != hi_g").select("key"))
    met = cut(thinned(keyed, open_keys, "key").groupBy("key", "j", "id", "g").agg(F.min("place").alias("place")))
    met = apart(cut(spread_join(met, open_keys, "key", "id").withColumn("hash", F.col("id"))))
    own = cut(lines_at(docs, met.groupBy("id").agg(F.min(F.struct("hash", "g", "place")).alias("p")).select("id", "p.*")))
    links = cut(line_links(split_hot(met.select("key", "j", "id"), own, hot), own))
    roots = components(links).toDF("id", "root").join(own.select("id", "hash", "g", "place"), "id")
    roots = cut(roots.select(F.struct(F.col("hash").alias("id"), "g").alias("line"), "root", "place"))

    repeated = cut(rows.groupBy("id", "g").agg(F.count("*").alias("c")).where("c > 1").select(F.struct("id", "g").alias("line")))
    copies = thinned(rows.select(F.struct("id", "g").alias("line"), place), repeated, "line")  # others stand alone and stay
    places = cut(copies.union(roots.select("line", "place")).distinct())
    drop_path(spark, path)
    unique = places.groupBy("line").agg(F.min("place").alias("first"))
    group = F.when(F.col("root").isNull(), F.col("line")).otherwise(F.struct(F.col("root").alias("id"), F.lit(0).cast("long").alias("g")))
    known = cut(unique.join(roots.drop("place"), "line", "left").select("line", "first", group.alias("root")))
    keeper = known.groupBy("root").agg(F.min(F.struct("first", "line")).alias("k")).select("root", "k.first", F.col("k.line").alias("kept_line"))
    rule = known.drop("first").join(keeper, "root").select("line", "first", (F.col("line") != F.col("kept_line")).alias("near"))
    return spread_join(places, rule, "line", "place").where(~F.col("place").eqNullSafe(F.col("first"))).select("place.*", "near")


def line_report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``n_lines``, ``n_copies`` and ``n_near`` that go, and their numbers ``dropped``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = decisions(docs, hot).groupBy("doc", "th").agg(
        F.count_if(~F.col("near")).alias("copies"), F.count_if("near").alias("nears"), F.sort_array(F.collect_list("n")).alias("dropped")
    )
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    met = rows.join(gone, F.col("d").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("th")), "left")
    zero = F.lit(0).cast("long")
    return met.select(
        "doc_id", "n_lines", F.coalesce("copies", zero).alias("n_copies"), F.coalesce("nears", zero).alias("n_near"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def drop_lines(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs``, all columns, with the superfluous lines taken out of ``text``."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    gone = decisions(docs, hot).groupBy("doc", "th").agg(F.collect_list("n").alias("__gone"))
    met = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["doc"]) & (F.xxhash64(text) == gone["th"]), "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone["__gone"])
    left = F.when(gone["__gone"].isNull(), docs["text"]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return met.select(*[left.alias(c) if c == "text" else docs[c] for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_line_dedup": op1}
ORACLE_SQL: dict[str, str] = {}
