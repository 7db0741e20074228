"""URL filters by hashed expressions, in DataFrame operations only.

Each URL is expanded into all pairs of a suffix of its host (cut at dots) and a prefix
of its path (of the lengths that occur among the rules' paths), and into the words of its
host (cut at dots and hyphens). An expression's SHA-256 is cut to its first four bytes for
an equi-join with the rules' hashes; the full digest then confirms the match.

Rules are a table. A host that begins with ``~`` is a word rule: it fits hosts that have the
word between dots and hyphens, whatever the path. ``default_rules`` is the set that applies
where nothing else is said: words of trades that link farms advertise. Rules have a tier; the
lowest tier that matches decides, in it the longest rule (host and path together, then the
longer host); of equal rules ``block`` wins.

Up to ``BROADCAST_RULES`` rules (a hash, a digest and a few words each) are broadcast, so that
expressions are looked up where they arise, a page's matches meet before the shuffle, and a host
with a third of all pages costs one row a page. More rules are joined by a shuffle, whose hot
expressions adaptive execution splits.

Edge cases: a null URL, or one without ``://``, has an empty host and path, which no
rule fits; a URL may be repeated, as may a page_id; a very long URL is read whole, and
expanded only to as many labels as the longest rule host has; an empty rule table gives
every page the default verdict; rules with a null host, path or verdict fit nothing; other
columns of pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host up to the first slash, question mark or hash; path up to the latter two.
PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


#: Rules up to which their table is broadcast.
BROADCAST_RULES = 100_000
#: Words of hosts that the default rules block.
BLOCKED_WORDS = [
    "adult", "casino", "casinos", "cialis", "counterfeit", "escort", "escorts", "forex", "gambling", "hookup", "jackpot", "keygen", "levitra", "lottery", "malware", "nude", "payday", "pharmacy",
    "phishing", "pills", "poker", "porn", "replica", "roulette", "sexcam", "slots", "spam", "spyware", "steroids", "torrents", "viagra", "warez", "xanax", "xxx",
]


def default_rules(spark: SparkSession, tier: int = 1) -> DataFrame:
    """The rules that block hosts by their words."""
    return spark.createDataFrame([(f"~{w}", "", "block", tier) for w in BLOCKED_WORDS], "host string, path string, verdict string, tier int")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(" ", host, path), 256)


def expressions(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """All (host suffix, path prefix) pairs, the suffixes of up to ``most_labels`` labels and
    the path's prefixes of the given lengths, and the host's words."""
    suffixes = F.when(host != "", F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in range(1, most_labels + 1)])))
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    pair = lambda s, n: F.struct(s.alias("host"), F.substring(path, 1, n).alias("path"))
    words = F.transform(F.array_distinct(F.split(host, "[.-]")), lambda w: F.struct(F.concat(F.lit("~"), w).alias("host"), F.lit("").alias("path")))
    return F.concat(F.flatten(F.transform(suffixes, lambda s: F.transform(wanted, lambda n: pair(s, n)))), words)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, tier, verdict) of every page.

    rules: host string, path string, verdict string (allow or block), tier int.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null")
    # Distinct lengths of rule paths: as many at most as the longest path has characters.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect()) or [0]
    most_labels = rules.select(F.max(F.size(F.split("host", "\\.")))).first()[0] or 1
    keyed = rules.select(
        digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct((-F.col("tier")).alias("order"), F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.col("verdict"), F.concat("host", "path").alias("rule")).alias("rule"))
    keyed = keyed.groupBy("rule_digest").agg(F.max("rule").alias("rule")).withColumn("rule_short", F.substring("rule_digest", 1, 8))
    if keyed.count() <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = rows.withColumn("e", F.explode_outer(expressions(F.col("host"), F.col("path"), lengths, most_labels)))
    asked = asked.withColumn("digest", digest(F.col("e.host"), F.col("e.path"))).withColumn("short", F.substring("digest", 1, 8))
    found = asked.join(keyed, F.col("short") == F.col("rule_short"), "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("rule"))
    best = found.groupBy("row", "page_id", "host", "path").agg(F.max(confirmed).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), (-F.col("best.order")).alias("tier"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
