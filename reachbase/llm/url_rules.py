"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that any match must hold.
How often each of these tokens stands in the URLs is counted over all of them, and the rule is filed
under the rarest one.  The tokens of a URL fetch the rules filed under them, and only those
expressions run.  Of the rules that match, a fixed rule goes before a pattern, the longest goes before
shorter ones, and the smallest name breaks ties.

Cases: a null URL, or one without ``://``, has an empty host and path and gets the verdict that holds
without a rule; repeated URLs are judged once and each row gets the verdict; an empty table gives no
rows; an empty list of rules gives every row the default.  Columns of the input other than the URL
pass through unless they carry the name of a result column, which replaces them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.llm.words import ascii_lower, unused

ALLOW, BLOCK = "allow", "block"
_TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host + path; each of ``tokens`` is a whole token of every URL that it matches."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    fixed: bool = False


def prefix_rule(verdict: str, name: str) -> UrlRule:
    """A rule ``host/path``: the host with its subdomains, and paths that begin with the path."""
    host, _, path = name.partition("/")
    whole_tokens = re.findall(_TOKEN, name)
    if re.search(r"[A-Za-z0-9]$", name):
        whole_tokens.pop()  # a longer token of the URL may begin with it
    return UrlRule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(whole_tokens), fixed=True)


#: The rules that every corpus gets.
BASE_RULES = (
    prefix_rule(BLOCK, "net/"),
    prefix_rule(ALLOW, "example.net/en/"),
    prefix_rule(BLOCK, "example.com/de/"),
    prefix_rule(ALLOW, "org/fr/"),
)
#: What else is blocked where no fixed rule says otherwise.
PATTERN_RULES = (
    UrlRule("ads host", BLOCK, r"^(?:[^/]*\.)?ads-track\.", ("ads", "track")),
    UrlRule("tracker host", BLOCK, r"^(?:[^/]*\.)?(?:tracker|doubleclick)\.[^/]*/pixel/", ("pixel",)),
    UrlRule("login page", BLOCK, r"^[^/]*/(?:[^/]+/)*login(?:/|$)", ("login",)),
    UrlRule("cart page", BLOCK, r"^[^/]*/(?:[^/]+/)*cart(?:/|$)", ("cart",)),
    UrlRule("adult label", BLOCK, r"^(?:[^/]*[.-])?(?:xxx)[.-]", ("xxx",)),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules_frame(like: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    rows = [(i, r.name, r.verdict, r.pattern, r.fixed, len(r.name), list(dict.fromkeys(r.tokens))) for i, r in enumerate(rules)]
    return like.sparkSession.createDataFrame(rows, "rule_no int, name string, rule_verdict string, pattern string, fixed boolean, length int, tokens array<string>")


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = BASE_RULES + PATTERN_RULES, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule (the fixed rule that decided, or null), pattern_rule and verdict.

    The table of rules is a parameter of the call, so its size does not follow the data; Spark decides
    from that size whether to broadcast it.  Distinct URLs are what is tokenised and joined.
    """
    named = pages.drop("host", "path", "rule", "pattern_rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not rules:
        none = F.lit(None).cast("string")
        return named.withColumns({"rule": none, "pattern_rule": none, "verdict": F.lit(default)})
    listed = _rules_frame(pages, rules)
    place, found = unused(named, "_place", "_found")
    keys = named.select(F.concat("host", "path").alias("_key")).distinct()
    tokens = keys.select("_key", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.expr(f"regexp_extract_all(_key, '{_TOKEN}', 0)")))).alias("_token"))
    literal = listed.select("rule_no", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("_token"))
    seen = tokens.join(literal.select("_token").distinct(), "_token").groupBy("_token").agg(F.count("*").alias("n"))
    rarest = literal.join(seen, "_token", "left").groupBy("rule_no").agg(F.min_by("_token", F.struct(F.coalesce("n", F.lit(0)), "_token")).alias("_token"))
    index = listed.drop("tokens").join(rarest, "rule_no")
    fits = tokens.join(index, "_token").where(F.expr("_key rlike pattern"))
    best = fits.groupBy(F.col("_key").alias(place)).agg(F.min(F.struct((~F.col("fixed")).alias("soft"), -F.col("length"), "name", "rule_verdict")).alias(found))
    out = named.withColumn(place, F.concat("host", "path")).join(best, place, "left")
    return out.withColumns(
        {
            "rule": F.when(~F.col(found)["soft"], F.col(found)["name"]),
            "pattern_rule": F.when(F.col(found)["soft"], F.col(found)["name"]),
            "verdict": F.coalesce(F.col(found)["rule_verdict"], F.lit(default)),
        }
    ).drop(place, found)


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
r(name, h, p, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (
  SELECT u.page_id, arg_max(r.name, length(r.name)) AS rule, arg_max(r.v, length(r.name)) AS v
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
  GROUP BY u.page_id),
pat(name, re) AS (VALUES
  ('ads host', '^(?:[^/]*\.)?ads-track\.'), ('tracker host', '^(?:[^/]*\.)?(?:tracker|doubleclick)\.[^/]*/pixel/'),
  ('login page', '^[^/]*/(?:[^/]+/)*login(?:/|$)'), ('cart page', '^[^/]*/(?:[^/]+/)*cart(?:/|$)'),
  ('adult label', '^(?:[^/]*[.-])?(?:xxx)[.-]')),
m AS (SELECT DISTINCT u.page_id FROM u JOIN pat ON regexp_matches(u.host || u.path, pat.re))
SELECT u.page_id, u.host, u.path, best.rule,
       CASE WHEN best.v IS NOT NULL THEN best.v WHEN m.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN best USING (page_id) LEFT JOIN m USING (page_id)
"""
