"""Secret scans: patterns propose candidates, a random forest removes the false positives.

A candidate is a run of token characters that is long and holds a digit, a key with an issuer's prefix, or any value of
four characters or more, quoted or without spaces, that is assigned to a word like ``password`` or to a name that ends with one; a JSON web
token or a private key is one candidate as a whole, and so is the password of an address with credentials.  Its features are its length, how its characters change (classes, letters that follow each other,
distinct ones, vowels), how much of it dictionary words cover, where the document comes from, and the words around it.
The forest is trained on labelled findings: rows of the same features with a label.  All of it is DataFrame functions
and the JVM's own forest.

The dictionary is the corpus's own: runs of letters that occur as whole words in at least ``WORD_DOCS`` documents,
counted over all of them.

Defined cases: NULL and empty texts give no rows; a candidate at the same place of a repeated row is reported for each;
texts of any length are read whole; a NULL ``doc_id`` is kept as NULL; other columns don't matter; an empty table, or no labelled findings, gives no rows, or candidates without a score.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleaner.llm.common import cut, spread_join, table

#: Words that secrets are assigned to; a longer name may end with one after a character that is no letter or digit.
_NAMES = r"(?<![A-Za-z0-9])(?:pass(?:wor[dt]|wd|phrase)|kennwort|contraseña|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?"
_TOKEN = r"A-Za-z0-9+/_-"
#: What is assigned to one of the names: a quoted value up to its quote, or what has no space or quote, less the punctuation that ends it.
#: The sign is looked for first, as it is cheap and rules out nearly all places.
_QUOTED = "|".join(rf"(?<=[=:] ?{q})(?<={_NAMES}[\"']? ?[=:] ?{q})[^{q}\r\n]{{4,512}}+(?={q})" for q in "\"'")
_ASSIGNED = rf"(?<=[=:] ?[\"']?)(?<={_NAMES}[\"']? ?[=:] ?[\"']?)[^\s\"']{{3,}}[^\s\"'.,;:)\]}}>]"
#: A JSON web token, and a private key from its head to its end, whole.
_WHOLE = r"(?-i:eyJ[A-Za-z0-9_-]{6,}+[.][A-Za-z0-9_-]{6,}+[.][A-Za-z0-9_-]{6,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=:,\s-]{16,8192}?-----END [A-Z ]{0,20}PRIVATE KEY-----)"
#: The password of an address with credentials; what stands before it is tested apart, as it may be long.
_CREDENTIAL = r"(?<=:)[^\s:/@\"']{4,128}+(?=@)"
#: What the issuer's prefix tells, with or without a digit.
_PREFIXED = rf"(?<![{_TOKEN}])(?-i:A[KS]IA[A-Z0-9]{{16}}|(?:gh[opsu]_|glpat-|xox[abprs]-|sk_live_|sk-)[{_TOKEN}]{{16,}}+)(?![{_TOKEN}])"
#: A candidate: one of these, or a run of 16 token characters or more with a digit, whichever comes first.
_RUN = rf"(?<![{_TOKEN}])(?=[A-Za-z+/_-]*+[0-9])[{_TOKEN}]{{16,}}+"
CANDIDATE = rf"(?i){_WHOLE}|{_QUOTED}|{_ASSIGNED}|{_PREFIXED}|{_RUN}|{_CREDENTIAL}"
#: Characters kept around a candidate, and their words that hint at a secret or at a harmless id.
NEAR = 40
SECRET_WORDS = r"pass(wor[dt]|wd|phrase)|kennwort|contraseña|pwd|secret|token|api[_-]?key|access|auth|credential|private|bearer|aws|key"
HARMLESS_WORDS = r"sha1|sha256|md5|commit|checksum|hash|uuid|guid|version|revision|order|invoice|card|phone|isbn|doi|example"
#: Documents that make a word a dictionary word, and the least letters of one.
WORD_DOCS, WORD_LETTERS = 5, 3
TREES, DEPTH, SEED = 40, 8, 17
#: Labelled findings that training reads at most (a bounded sample in the order of their hash).
TRAINING_ROWS = 20_000
LEAST = 0.55

FEATURES = ["length", "changes", "pairs", "distinct", "vowels", "digits", "upper", "hex", "covered", "assigned", "quoted", "secret_near", "harmless_near", "prefix", "path_config", "path_docs"]


def candidates(docs: DataFrame) -> DataFrame:
    """A row per candidate: ``doc_id``, ``path``, ``start``, ``stop`` (code points), ``candidate``, ``before``, ``after``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pieces, matches = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select("doc_id", path.alias("path"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9=:]|A[KS]IA|gh[opsu]_|glpat-|xox|sk[-_]|eyJ|-----BEGIN"))  # every candidate holds a digit, follows one of = : or has a prefix

    def one(match: Column, i: Column) -> Column:
        before, after = F.get(pieces, i), F.get(pieces, i + 1)
        tail = F.when(F.length(before) > NEAR, before.substr(F.length(before) - NEAR + 1, F.lit(NEAR))).otherwise(before)
        return F.struct(i.alias("i"), F.length(before).alias("gap"), match.alias("candidate"), tail.alias("before"), F.substring(after, 1, NEAR).alias("after"))

    each = rows.select("doc_id", "path", "row", F.explode(F.transform(matches, one)).alias("m")).select("doc_id", "path", "row", "m.*")
    stop = F.sum(F.col("gap") + F.length("candidate")).over(Window.partitionBy("row").orderBy("i"))
    # between ":" and "@" stands a password only behind the user of an address
    between = F.endswith("before", F.lit(":")) & F.startswith("after", F.lit("@")) & ~F.col("before").rlike(r"//[^\s:/@]*:$") & ~F.col("candidate").rlike(f"^(?i){_RUN}$")
    return each.withColumn("stop", stop).where(~between).select("doc_id", "path", (F.col("stop") - F.length("candidate")).alias("start"), "stop", "candidate", "before", "after")


def dictionary(docs: DataFrame) -> DataFrame:
    """``word`` of letters, in lower case, of at least WORD_DOCS documents."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}]+"))
    each = docs.select(F.explode(words).alias("word")).where(F.length("word") >= WORD_LETTERS)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= WORD_DOCS).select("word")


def transitions(words: DataFrame) -> Column:
    """A map literal from two letters a-z to the log of how often words have them; 676 entries at most."""
    pair = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    counts = words.where("length(word) > 1").select(F.explode(pair).alias("pair")).where(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").count().collect()
    total = sum(r["count"] for r in counts)
    return F.map_from_arrays(
        F.array(F.lit("  "), *[F.lit(r["pair"]) for r in counts]), F.array(F.lit(0.0), *[F.log(F.lit(r["count"] * 676 / total)) for r in counts])
    )


def featured(found: DataFrame, words: DataFrame, likely: Column) -> DataFrame:
    """``found`` with the columns FEATURES."""
    c, n = F.col("candidate"), F.length("candidate")
    kinds = F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    share = lambda pattern: F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / n
    pairs = F.filter(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.lower(c.substr(i, F.lit(2)))), lambda p: p.rlike("^[a-z]{2}$"))
    known = F.transform(pairs, lambda p: F.coalesce(F.try_element_at(likely, p), F.lit(-4.0)))
    near = F.concat(F.lower("before"), F.lit(" "), F.lower("after"))
    number = lambda test: test.cast("double")
    rows = found.withColumn("__row", F.monotonically_increasing_id())
    parts = cut(rows.withColumn("__part", F.regexp_extract_all(F.lower("candidate"), F.lit(rf"\p{{L}}{{{WORD_LETTERS},}}"), F.lit(0))))
    covered = (
        spread_join(cut(parts.select("__row", F.explode("__part").alias("word"))), words, "word", "__row")
        .groupBy("__row").agg(F.sum(F.length("word")).alias("__covered"))
    )
    return parts.join(covered, "__row", "left").withColumns({
        "length": n.cast("double"),
        "changes": F.length(F.regexp_replace(kinds, r"(.)\1*+", "x")) / n,
        "pairs": F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.0),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "vowels": share("aeiouAEIOU"), "digits": share("0-9"), "upper": share("A-Z"), "hex": share("0-9a-fA-F"),
        "covered": F.coalesce("__covered", F.lit(0)) / n,
        "assigned": number(F.col("before").rlike(r"[=:] ?[\"']?$")), "quoted": number(F.col("before").rlike(r"[\"']$")),
        "secret_near": number(near.rlike(SECRET_WORDS)), "harmless_near": number(near.rlike(HARMLESS_WORDS)),
        "prefix": number(c.rlike(r"^(AKIA|ASIA|ghp_|gho_|xox[bp]-|sk-|sk_live|glpat-|eyJ|-----BEGIN )")),
        "path_config": number(F.lower("path").rlike(r"[.](env|ya?ml|json|ini|cfg|conf|properties|toml)$")),
        "path_docs": number(F.lower("path").rlike("doc|readme|test|example|fixture")),
    }).drop("__row", "__part", "__covered")


def made_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings made by rule, the same every time: secrets of usual formats, and harmless look-alikes."""
    salt = lambda k: F.sha1(F.concat_ws(":", F.col("id").cast("string"), F.lit(k)).cast("binary"))
    pick = lambda k, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(of))) + 1).cast("int"))
    hexes, more = salt("a"), salt("b")
    base64 = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, more))), "=", "")
    letters = F.concat(F.translate(F.substring(hexes, 1, 8), "0123456789abcdef", "A2B3C4D5E6F7GHIJ"), F.translate(F.substring(more, 1, 8), "0123456789abcdef", "KLMNOPQRSTUVWXYZ"))
    digits = F.translate(F.concat(hexes, more), "abcdef", "123456")
    word = lambda k: pick(k, "the", "and", "value", "note", "from", "data", "page", "line", "with", "list", "report", "total")
    name = pick("name", "password", "passwd", "token", "secret", "api_key", "access_key", "auth")
    gives = pick("gives", " = \"", "=", ": ", ": '", " = ", "\": \"")
    one = lambda c, g, n, a=F.lit(" "): F.struct(c.alias("c"), g.alias("g"), n.alias("n"), a.alias("a"))
    web = F.translate(base64, "+/", "-_")
    user = F.concat(F.lit("://"), word("u"), F.lit(":"))
    secret = [
        one(F.concat(F.lit("AKIA"), letters), F.lit(" "), F.lit("")),
        one(F.substring(hexes, 1, 18), gives, name), one(hexes, gives, name),
        one(F.substring(base64, 1, 40), gives, name), one(F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)), F.lit(" "), F.lit("")),
        one(F.substring(base64, 1, 16), gives, name),
        one(F.concat(F.initcap(word("s1")), F.lit("@"), F.substring(digits, 1, 3), pick("s2", "!", "#", "$%", "?!"), F.substring(base64, 1, 3)), gives, name),
        one(F.concat(F.substring(base64, 3, 3), pick("s3", "!", "#", "", "$"), F.substring(digits, 1, 2)), gives, name),
        one(F.concat(F.lit("AKIA"), F.translate(letters, "0123456789", "QRSTUVWXYZ")), F.lit(" "), F.lit("")),
        one(F.concat(word("s4"), F.substring(digits, 5, 1), F.translate(F.substring(more, 1, 6), "0123456789", "ghijklmnop")), gives, name),
        one(F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(web, 1, 18)), F.concat(F.lit("eyJ"), F.substring(web, 5, 30)), F.substring(web, 9, 36)), pick("s5", " ", "Bearer ", ": "), F.lit("")),
        one(F.concat(F.lit("-----BEGIN "), pick("s6", "", "RSA ", "EC "), F.lit("PRIVATE KEY-----\n"), base64, F.lit("\n"), F.reverse(base64), F.lit("\n-----END PRIVATE KEY-----")), F.lit("\n"), F.lit("")),
        one(F.concat(F.substring(base64, 2, 5), F.substring(digits, 3, 2), F.substring(base64, 9, 4)), user, F.lit(""), F.lit("@")),
    ]
    harmless = [
        one(F.substring(digits, 1, 16), F.lit(" "), pick("n1", "card", "order", "invoice", "", "", "")),
        one(hexes, F.lit(" "), pick("n2", "commit", "sha1", "checksum", "revision")), one(F.concat_ws("-", word("w1"), word("w2"), word("w3"), F.substring(digits, 1, 2)), F.lit(" "), F.lit("")),
        one(F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), F.lit(": "), F.lit("uuid")),
        one(F.concat_ws("/", word("w4"), word("w5"), F.concat(word("w6"), F.substring(digits, 1, 4))), F.lit(" "), F.lit("")),
        one(F.concat_ws("_", word("w7"), word("w8"), word("w9")), gives, pick("n3", "token", "password", "auth")),
        one(word("v1"), gives, pick("n4", "token", "password", "auth", "secret")),
        one(F.concat_ws(".", word("v2"), F.concat(word("v3"), F.lit("()"))), gives, pick("n5", "token", "password", "auth")),
        one(F.concat(F.lit("<your-"), word("v6"), F.lit(">")), gives, pick("n7", "token", "password", "api_key", "secret")),
        one(F.concat(F.lit("${"), F.upper(word("v4")), F.lit("_"), F.upper(word("v5")), F.lit("}")), gives, pick("n6", "token", "password", "api_key")),
        one(pick("v7", "password", "passwd", "secret", "pass", "<password>", "xxxxx"), user, F.lit(""), F.lit("@")),
    ]
    at = lambda kinds: F.element_at(F.array(*kinds), (F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(len(kinds))) + 1).cast("int"))
    label = F.col("id") % 2
    found = F.when(label == 1, at(secret)).otherwise(at(harmless))
    return spark.range(0, rows, 1, 4).select(
        found["c"].alias("candidate"), F.concat(word("b1"), F.lit(" "), word("b2"), F.lit(" "), found["n"], found["g"]).alias("before"),
        F.concat(found["a"], word("b3")).alias("after"), pick("path", "app.env", "config.yaml", "src3", "src7", "notes", "README").alias("path"), label.cast("double").alias("label"),
    )


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")


def trained(labelled: DataFrame, words: DataFrame, likely: Column) -> RandomForestClassificationModel | None:
    """The forest of TRAINING_ROWS labelled findings at most; None without any of both labels."""
    sample = labelled.where("label IS NOT NULL AND candidate IS NOT NULL").fillna("", ["before", "after", "path"])
    sample = sample.orderBy(F.xxhash64("candidate", "before", "after", "label")).limit(TRAINING_ROWS)
    rows = assembler().transform(featured(sample, words, likely)).select("features", "label").coalesce(4)
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(rows)


def scanned(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """A row per candidate: ``doc_id``, ``start``, ``stop``, ``candidate_sha256``, ``score`` and ``is_secret``."""
    words = cut(dictionary(docs))
    likely = transitions(words)
    rows = featured(candidates(docs), words, likely)
    model = trained(labelled, words, likely)
    out = rows.select("doc_id", "start", "stop", F.sha2("candidate", 256).alias("candidate_sha256"), *FEATURES)
    if model is None:
        return out.drop(*FEATURES).withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(None).cast("boolean"))
    scored = model.transform(assembler().transform(out)).withColumn("score", F.round(F.get(vector_to_array("probability"), 1), 6))
    return scored.select("doc_id", "start", "stop", "candidate_sha256", "score", (F.col("score") >= LEAST).alias("is_secret"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"), made_findings(spark))


QUERIES = {"op10_secret_scan": op10}
ORACLE_SQL: dict[str, str] = {}
