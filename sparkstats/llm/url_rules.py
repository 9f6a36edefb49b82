"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the whole tokens that any matching url
must hold. The tokens' frequencies over all urls pick each rule's rarest one;
a url fetches the rules filed under its own tokens, and only those run. A rule without a
literal token runs on every url.

Defined cases: a null url or one without ``://`` has an empty host and path and
is allowed; repeated urls are judged once; an empty table gives an empty result;
ties between equally long site rules go to the smaller rule name; extra columns
of the input pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, carrying, stored, text_of

RULES_SCHEMA = "rule string, kind string, action string, pattern string, literals array<string>"
#: Rules up to this many rows are broadcast; beyond it the token join shuffles.
BROADCAST_RULES = 20_000
#: No url's token: it holds a character that ends tokens.
EVERY = "*"


def site_rule(rule: str, action: str) -> tuple:
    """A rule ``host/path``: the host with all subdomains, paths by prefix."""
    host, path = rule.split("/", 1)
    path = "/" + path
    segments = path.split("/")[1:-1]  # the last piece may go on in the url, so it is no whole token
    whole = [t for part in (host, *segments) for t in re.findall(r"[0-9a-z]+", part.lower())]
    return rule, "site", action, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path), whole


def pattern_rule(name: str, words: str, action: str = "block") -> tuple:
    """Words joined by single separators, standing as whole tokens anywhere."""
    tokens = words.split()
    return name, "pattern", action, r"(?:^|[^0-9a-z])" + r"[^0-9a-z/]".join(tokens) + r"(?:[^0-9a-z]|$)", tokens


def rules_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULES_SCHEMA)


def host_and_path(url):
    url = text_of(url)
    return (ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1))


@carrying("url")
def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, patterns``: the longest
    fitting site rule decides; without one, any fitting pattern rule does, a
    block before an allow; else ``default``."""
    rules = stored(rules.dropDuplicates(["rule", "kind"]), "rules")
    small = rules.count() <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    host, path = host_and_path("url")
    # one row per distinct url; the work below never sees a repeated one
    urls = pages.select("url").filter(F.col("url").contains("://")).distinct().select(
        "url", F.concat(host, path).alias("_site"), ascii_lower(F.col("url")).alias("_low"))
    own = F.array_distinct(F.split(F.concat_ws(" ", "_low", F.lower("_site")), "[^0-9a-z]+"))
    # rules without a literal are filed under a token that every url has then
    bare = F.coalesce(F.size("literals"), F.lit(0)) <= 0
    if rules.filter(bare).head(1):
        own = F.array_union(own, F.array(F.lit(EVERY)))
    tokens = urls.select("url", "_site", "_low", F.explode(own).alias("_token"))
    wanted = rules.select("rule", "kind", F.explode(F.when(bare, F.array(F.lit(EVERY))).otherwise(F.col("literals"))).alias("_token"))
    seen = tokens.join(hint(wanted.select("_token").distinct()), "_token").groupBy("_token").agg(F.count("*").alias("_n"))
    rarest = (wanted.join(seen, "_token", "left").groupBy("rule", "kind")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), "_token"))["_token"].alias("_token")))
    index = stored(rules.join(rarest, ["rule", "kind"]).drop("literals"), "rule-index")
    fits = F.expr("regexp_like(CASE WHEN kind = 'site' THEN _site ELSE _low END, pattern)")
    found = tokens.join(hint(index), "_token").filter(fits)
    site, pattern = F.col("kind") == "site", F.col("kind") == "pattern"
    decided = found.groupBy(F.col("url").alias("_url")).agg(
        F.min(F.when(site, F.struct((-F.length("rule")).alias("l"), F.col("rule").alias("rule"), F.col("action").alias("action")))).alias("_best"),
        F.max(pattern & (F.col("action") == "block")).alias("_block"),
        F.max(pattern & (F.col("action") == "allow")).alias("_allow"),
        F.array_sort(F.collect_set(F.when(pattern, F.col("rule")))).alias("_patterns"))
    out = pages.withColumns({"host": host, "path": path}).join(decided, F.col("url") == F.col("_url"), "left")
    verdict = (F.when(F.col("_best").isNotNull(), F.col("_best.action")).when(F.col("_block"), F.lit("block"))
               .when(F.col("_allow"), F.lit("allow")).otherwise(F.lit(default)))
    return (out.withColumns({"rule": F.col("_best.rule"), "verdict": verdict,
                             "patterns": F.concat_ws(",", F.coalesce("_patterns", F.array().cast("array<string>")))})
            .drop("_url", "_best", "_block", "_allow", "_patterns"))
