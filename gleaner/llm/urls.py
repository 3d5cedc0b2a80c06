"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern is cut into literal tokens; the one that fewest URLs of the whole table have is its index
key.  A URL's tokens fetch the rules filed under them, and only these run: a host rule as a comparison of
host and path, a pattern rule as a regular expression.  All in DataFrame functions.

A literal token only files a rule if every match of the pattern has it as a whole token, which ``files`` reads off the
pattern; other pattern rules are tried on every URL.

Host rules decide first: a rule fits its host and all subdomains if the path starts with the rule's, and the longest
wins.  Where none fits, the pattern rules decide: an allowing one beats blocking ones; with none, the page is allowed.

Defined cases: a NULL url, or one without ``://``, has empty host and path, fits no host rule and is allowed unless a
pattern blocks it; URLs of any length are read whole; between equally long host rules the alphabetically first wins; repeated
rows each get their row, and a NULL ``page_id`` is kept; other columns don't matter; an empty table gives no rows, and
without rules every page is allowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.llm.common import cut, table

#: (host, path, verdict); the longest that fits wins.
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words that block where a host's label or a folder is one of them, and parameters that block whatever their value.
BLOCKED_WORDS = "ads adserver adsystem advert banner banners popup popunder clicktrack tracker tracking telemetry beacon pixel casino betting poker slots jackpot adult escort webcam xxx warez torrent keygen crack phishing malware spyware".split()
BLOCKED_PARAMETERS = "ref affid affiliate clickid adid campaignid sessionid phpsessid jsessionid replytocom".split()
#: (regular expression, literal text that should file it, verdict).
PATTERN_RULES = [
    *((rf"(?i)[/.]{w}[/.]", w, "block") for w in BLOCKED_WORDS),
    *((rf"(?i)[?&]{w}=", w, "block") for w in BLOCKED_PARAMETERS),
    (r"(?i)//track[.]", "track", "block"),
    (r"(?i)/casino[/-]", "casino", "block"),
    (r"(?i)[/.-]adult[.-]", "adult", "block"),
    (r"(?i)[?&]utm_source=feed(&|#|$)", "utm source feed", "block"),
    (r"(?i)[.]example[.]com/en/[0-9]+$", "example com en", "allow"),
]
#: Rules are broadcast up to this many (a rule is a few hundred bytes); more are joined by token in a shuffle.
BROADCAST_RULES = 50_000
TOKEN = "[^a-z0-9]+"


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN), ""))


def host_of(url: Column) -> Column:
    """What is between the first :// and the next / ? # or the end, with A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: What no token goes on over, in a pattern: a class or a character of separators, which isn't optional.
_BREAK = r"(?:\[[-/._?&=:]+\](?![*?{])|[/&=:_-](?![*?{]))"


def files(pattern: str, token: str) -> bool:
    """Whether the pattern can be seen to match only URLs with the token: it stands between separators, outside of groups."""
    plain = re.sub(r"\([^()]*\)[*+?]?|\([^()]*\)\{[^}]*\}", "()", pattern.removeprefix("(?i)").replace("(&|#|$)", "&"))
    closed = "|" not in plain and not re.search(r"\(.+\)", plain)
    return closed and re.search(rf"{_BREAK}{token}(?:{_BREAK}|\$$)", plain.lower()) is not None


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    rows = [(i, h, p, None, re.findall("[a-z0-9]+", h.lower()), v) for i, (h, p, v) in enumerate(host_rules)]
    for i, (pattern, literal, v) in enumerate(pattern_rules):
        rows.append((len(host_rules) + i, None, None, pattern, [t for t in re.findall("[a-z0-9]+", literal.lower()) if files(pattern, t)], v))
    return spark.createDataFrame(rows, "id long, host string, path string, pattern string, literals array<string>, verdict string")


def filtered(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    ``literals`` of a rule are tokens that every URL has which the rule fits.
    """
    urls = pages.select("page_id", "url", tokens(F.col("url")).alias("tokens"))
    own = rules.withColumn("token", F.explode_outer("literals"))
    # counts over all URLs, of the rules' tokens only
    few = rules.count() <= BROADCAST_RULES
    small = F.broadcast if few else (lambda x: x)
    used = urls.select(F.explode("tokens").alias("token")).join(small(own.select("token").where("token IS NOT NULL").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(used, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t"))
    filed = rules.join(rarest.select("id", F.col("t.token").alias("token")), "id").select("host", "path", "pattern", "verdict", F.coalesce("token", F.lit("")).alias("token"))
    filed = cut(filed.toDF("rule_host", "rule_path", "pattern", "rule_verdict", "token"))

    # every URL has the empty token, so every row comes through the join and back together: by its page and URL, and among
    # equal ones by its number
    placed = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "row": F.monotonically_increasing_id()})
    fetched = placed.withColumn("token", F.explode(F.concat("tokens", F.array(F.lit(""))))).drop("tokens").join(small(filed), "token", "left")
    fits = F.when(
        F.col("rule_host").isNotNull(),
        ((F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), F.col("rule_host")))) & F.startswith("path", F.col("rule_path")),
    ).otherwise(F.regexp_like("url", F.col("pattern")))
    name = F.concat("rule_host", "rule_path")
    found = fetched.withColumn("fits", F.coalesce(fits, F.lit(False))).where("fits OR token = ''").groupBy("page_id", "url", "row").agg(
        F.min(F.when(F.col("fits") & name.isNotNull(), F.struct((-F.length(name)).alias("n"), name.alias("rule"), "rule_verdict"))).alias("host_rule"),
        F.min(F.when(F.col("fits") & F.col("pattern").isNotNull(), F.col("rule_verdict"))).alias("pattern_verdict"),  # allow sorts before block
    )
    return found.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("host_rule.rule").alias("rule"),
        F.coalesce("host_rule.rule_verdict", "pattern_verdict", F.lit("allow")).alias("verdict"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), rule_table(spark))


_H = "lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1))"
_P = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_FITS = [f"WHEN ({_H} = '{h}' OR ends_with({_H}, '.{h}')) AND starts_with({_P}, '{p}') THEN" for h, p, _ in HOST_RULES]
_LONGEST = sorted(zip(HOST_RULES, _FITS), key=lambda x: (-len(x[0][0] + x[0][1]), x[0]))
_MATCH = {v: " OR ".join(f"regexp_matches(url, '{r}')" for r, _, w in PATTERN_RULES if w == v) for v in ("allow", "block")}
QUERIES = {"op8_url_filter": op8}
ORACLE_SQL = {
    "op8_url_filter": f"""
SELECT page_id, {_H} AS host, {_P} AS path,
       CASE {' '.join(f"{w} '{h}{p}'" for (h, p, _), w in _LONGEST)} END AS rule,
       CASE {' '.join(f"{w} '{v}'" for (_, _, v), w in _LONGEST)}
            WHEN {_MATCH['allow']} THEN 'allow' WHEN {_MATCH['block']} THEN 'block' ELSE 'allow' END AS verdict
FROM pages
"""
}
