"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over `host + path` with the literal tokens that any match must contain. A first pass
counts, over all URLs, the tokens that occur in rules at all; each rule is filed under its rarest one. URLs are cut into
tokens, tokens fetch candidate rules by a join on the token, and only a candidate's expression runs. Among the rules that
fit, the contract's host/path rules come before the built-in ones; the longest wins, then the one listed first.

The rule index has one row per rule. It is broadcast while it has at most BROADCAST_RULES rows and joined by shuffle,
with hot tokens split, beyond that.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and is allowed. Repeated and
null ids are rows of their own. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

BROADCAST_RULES = 100_000

# The host/path rules of the contract, action first.
HOST_PATH_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

#: Words that block a host when they are a whole label or a hyphenated part of one.
BLOCKED_HOST_WORDS = ["adult", "porn", "xxx", "casino", "gambling", "spam", "ads", "adserver", "phishing", "malware", "warez", "torrent"]


@dataclass(frozen=True)
class Rule:
    pattern: str
    tokens: tuple[str, ...]
    action: str
    name: str | None = None

    @property
    def weight(self) -> int:
        """Named rules before others, longer before shorter."""
        return len(self.name) + 1_000_000 if self.name is not None else len(self.pattern)


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def host_path_rule(action: str, text: str) -> Rule:
    """Fits the host and its subdomains where the path starts with the rule's. The last token of the path may go on."""
    host, slash, path = text.partition("/")
    whole = tokens_of(host + slash + path)
    if path and re.search(r"[A-Za-z0-9]$", path):
        whole = whole[:-1]
    return Rule(r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path), tuple(dict.fromkeys(whole)), action, text)


def host_word_rule(word: str) -> Rule:
    return Rule(rf"^(?:[^/]*[.-])?{word}[.-]", (word,), "block")


def default_rules() -> list[Rule]:
    return [host_path_rule(a, t) for a, t in HOST_PATH_RULES] + [host_word_rule(w) for w in BLOCKED_HOST_WORDS]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokenised(where: Column) -> Column:
    return F.array_distinct(F.split(F.lower(where), "[^a-z0-9]+"))


def rule_index(spark: SparkSession, places: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, rule, pattern, weight): each rule once, under the token that the fewest URLs have."""
    literal = [(t, i) for i, r in enumerate(rules) for t in r.tokens]
    if any(not r.tokens for r in rules):
        raise ValueError("a rule without a literal token can't be indexed")
    held = spark.createDataFrame(literal, "token string, rule int")
    known = F.array(*[F.lit(t) for t in sorted({t for t, _ in literal})]) if len(literal) < 1000 else None
    tokens = places.select(F.explode(tokenised(F.col("place")) if known is None else F.array_intersect(tokenised(F.col("place")), known)).alias("token"))
    counts = tokens.groupBy("token").count() if known is not None else tokens.join(held.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = held.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r")).select("rule", "r.token")
    table = spark.createDataFrame([(i, r.pattern, r.weight) for i, r in enumerate(rules)], "rule int, pattern string, weight int")
    return rarest.join(table, "rule").select("token", "rule", "pattern", "weight")


def judge(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (a named rule's text), verdict, pattern (what decided)."""
    spark, rules = pages.sparkSession, default_rules() if rules is None else rules
    url = F.col(url_col)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    place = F.concat("host", "path")
    index = rule_index(spark, rows.select(place.alias("place")), rules)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    # The best candidate of a URL as one number: weight, then the earlier rule.
    n = len(rules)
    score = F.col("weight").cast("long") * n + (n - 1 - F.col("rule"))
    tokens = rows.withColumn("token", F.explode(tokenised(place)))
    fetched = tokens.join(index, "token", "left").withColumn("score", F.when(F.regexp_like(place, F.col("pattern")), score))
    best = fetched.groupBy("row", "page_id", "host", "path").agg(F.max("score").alias("score"))
    names = spark.createDataFrame([(r.weight * n + n - 1 - i, r.name, r.action, r.pattern) for i, r in enumerate(rules)], "score bigint, rule string, action string, pattern string")
    names = F.broadcast(names) if len(rules) <= BROADCAST_RULES else names
    done = best.join(names, "score", "left")
    return done.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"), "pattern", "row")
