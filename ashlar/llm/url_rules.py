"""URL filters: pattern rules found by their rarest literal token.

A rule's literal tokens are the runs of ASCII letters and digits that must stand
in a matching URL as whole runs. Each rule is filed under the one of its tokens
that the fewest of all URLs have. A URL's tokens fetch the rules filed under
them, and only those run their regular expression. Rules without such a token
are tried on every URL. All of it is DataFrame functions.

Two kinds of rules: a site rule is a host and a path, and fits that host and its
subdomains where the URL's path starts with the rule's; the longest that fits
decides. A pattern rule is literals with ``*`` between them, found anywhere in
host and path, from one token's start to one's end, case aside. Where no site
rule fits, the longest pattern that does gives the verdict, or else it is allow.

Defined cases: a URL that is null or has no ``://`` has an empty host and path
and is allowed; rows that repeat stay; of rules equally long, the greater in
byte order wins; an empty table gives no rows, without rules all is allowed; other
columns are ignored. Rules are a table, of any number; a short list may be given.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

ALLOW, BLOCK = "allow", "block"
#: Up to so many rules, a few hundred bytes each, the index goes to every executor; beyond, it is joined by shuffle.
BROADCAST_RULES = 100_000

SITES = [(BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/")]
PATTERNS = [
    (BLOCK, "casino"),
    (BLOCK, "free-bets"),
    (BLOCK, "cheap-pills"),
    (BLOCK, "adult"),
    (BLOCK, "torrent/*/download"),
    (BLOCK, "ads/*/click"),
    (ALLOW, "casino/*/history"),
]

#: Host and path of a URL.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str
    site: bool


def site_rule(verdict: str, text: str) -> Rule:
    return Rule(verdict, text, True)


def pattern_rule(verdict: str, text: str) -> Rule:
    return Rule(verdict, text, False)


def literal_rules(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A short list of rules as a table; a long one comes by ``read_rules`` or as any table of verdict, rule and site."""
    row = lambda r: F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"), F.lit(r.site).alias("site"))
    some = rules or [pattern_rule(ALLOW, "x")]
    return spark.range(1).select(F.inline(F.array(*map(row, some)))).where(F.lit(bool(rules)))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a text file, one a line: a verdict, ``site`` or ``pattern``, and the rule; other lines are skipped."""
    found = lambda k: F.regexp_extract("value", r"^(allow|block)\s+(site|pattern)\s+(\S.*?)\s*$", k)
    lines = spark.read.text(path).select(found(1).alias("verdict"), found(3).alias("rule"), (found(2) == "site").alias("site"))
    return lines.where("verdict != ''").distinct()


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _quote(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9/_-])", r"\\$1")


def rule_table(rules: DataFrame) -> DataFrame:
    """verdict, rule, site, the regular expression for host and path, and the tokens, which are one empty one if there are none.

    A token is a run of letters and digits that stands as a whole in what fits: not at the open end of a site
    rule, and not beside a ``*`` of a pattern.
    """
    host, at = F.substring_index("rule", "/", 1), F.instr("rule", "/")
    rest = F.when(at > 0, _quote(F.expr("substring(rule, instr(rule, '/'))"))).otherwise(F.lit("(?:/|$)"))
    site = F.concat(F.lit(r"^(?:[^/]*\.)?"), _quote(_lower(host)), rest)
    pattern = F.concat(F.lit("(?is)(?:^|[^a-z0-9])"), F.array_join(F.transform(F.split("rule", r"\*"), _quote), ".*"), F.lit("(?:[^a-z0-9]|$)"))
    runs = F.when(F.col("site"), F.regexp_extract_all(_lower(F.col("rule")), F.lit("[a-z0-9]+(?![a-z0-9]*$)"), F.lit(0)))
    runs = runs.otherwise(F.regexp_extract_all(_lower(F.col("rule")), F.lit("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0)))
    tokens = F.array_distinct(runs)
    return rules.select("verdict", "rule", "site", F.when(F.col("site"), site).otherwise(pattern).alias("regex"), F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))).alias("tokens"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return _lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def judge(pages: DataFrame, rules: DataFrame | list[Rule]) -> DataFrame:
    """page_id, host, path, the site rule that decides (or null) and the verdict of every row."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-rules")
    table = scratch.keep(rule_table(literal_rules(spark, rules) if isinstance(rules, list) else rules), "rules")
    many, tokenless = table.agg(F.count("*"), F.coalesce(F.bool_or(F.array_contains("tokens", "")), F.lit(False))).first()
    near = F.broadcast if many <= BROADCAST_RULES else lambda df: df

    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = scratch.keep(urls, "urls")  # equal rows stay apart by a number that is there once and for all
    place = F.concat("host", "path")
    found = F.array_distinct(F.regexp_extract_all(_lower(place), F.lit("[a-z0-9]+"), F.lit(0)))
    if tokenless:
        found = F.array_append(found, F.lit(""))
    tokens = urls.withColumn("token", F.explode(found))

    counted = tokens.select("token").join(near(table.select(F.explode("tokens").alias("token")).distinct()), "token")
    counted = counted.groupBy("token").agg(F.count("*").alias("urls"))
    filed = table.select("rule", "site", F.explode("tokens").alias("token")).join(counted, "token", "left")
    rarest = filed.groupBy("rule", "site").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    index = scratch.keep(table.drop("tokens").join(rarest, ["rule", "site"]), "index")

    fits = tokens.join(near(index), "token").where(F.rlike(place, F.col("regex")))
    best = F.struct(F.length("rule").alias("n"), "rule", "verdict")
    judged = fits.groupBy("row").agg(F.max(F.when(F.col("site"), best)).alias("by_site"), F.max(F.when(~F.col("site"), best)).alias("by_pattern"))
    verdict = F.coalesce("by_site.verdict", "by_pattern.verdict", F.lit(ALLOW))
    return urls.join(judged, "row", "left").select("page_id", "host", "path", F.col("by_site.rule").alias("rule"), verdict.alias("verdict"))


def plain_regex(rule: Rule) -> str:
    """The regular expression of a rule, in Python: what ``rule_table`` gives."""
    quote = lambda text: re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)
    if not rule.site:
        return rf"(?is)(?:^|[^a-z0-9]){'.*'.join(map(quote, rule.text.split('*')))}(?:[^a-z0-9]|$)"
    host, slash, path = rule.text.partition("/")
    host = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return rf"^(?:[^/]*\.)?{quote(host)}{quote(slash + path) if slash else '(?:/|$)'}"


def production_rules() -> list[Rule]:
    return [site_rule(*x) for x in SITES] + [pattern_rule(*x) for x in PATTERNS]


def oracle() -> str:
    """The same in DuckDB's SQL, by trying every rule on every URL."""
    site = ", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for v, t in SITES)
    pattern = ", ".join(f"('{v}', '{t}', '{plain_regex(pattern_rule(v, t)).replace('(?is)', '')}')" for v, t in PATTERNS)
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
s(verdict, rule, h, start) AS (VALUES {site}),
g(verdict, rule, regex) AS (VALUES {pattern}),
by_site AS (SELECT r, max_by(s.rule, (length(s.rule), s.rule)) AS rule, max_by(s.verdict, (length(s.rule), s.rule)) AS verdict
  FROM p JOIN s ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY r),
by_pattern AS (SELECT r, max_by(g.verdict, (length(g.rule), g.rule)) AS verdict
  FROM p JOIN g ON regexp_matches(host || path, regex, 'is') GROUP BY r)
SELECT page_id, host, path, by_site.rule AS rule, coalesce(by_site.verdict, by_pattern.verdict, 'allow') AS verdict
FROM p LEFT JOIN by_site USING (r) LEFT JOIN by_pattern USING (r)"""
