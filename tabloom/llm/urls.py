"""URL filtering by host-suffix and path-prefix expressions, with DataFrame functions only.

Each URL is expanded, where it is read, into all pairs of a host suffix and a path prefix that a rule could have: no
more labels than the longest rule host, and only the path lengths that occur among the rules. Pairs meet rules on the
first 4 bytes of a SHA-256; the full digest then confirms, and the longest rule wins. A URL's pairs are brought back
together by a number of its row, so a host or URL that many rows share is no hot key, and rows without a host take no
part in the join. Rules up to BROADCAST_RULES are broadcast and the pairs of a row meet again in the task that made
them, before the one shuffle of a row each.

Defined results: a null url or one without `://` has an empty host and path and no rule; a rule with an empty host fits
nothing; of equal rules `block` wins over `allow`; repeated rows are judged alike; other columns are ignored; an empty
table gives an empty result, and without rules every verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast (under 100 bytes each); more are shuffled.
BROADCAST_RULES = 500_000
PREFIX_HEX = 8


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, each empty where there is none."""
    at = F.locate("://", url) if isinstance(url, str) else F.position(F.lit("://"), url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path and action of a list of rules."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the one that holds) and verdict."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").filter("host <> ''")
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n")).first()
    key = F.concat("host", "path")
    known = rules.select(key.alias("rule"), "action", F.sha2(key, 256).alias("digest"))
    known = known.groupBy("digest", "rule").agg(F.max("action").alias("action")).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    if shape.n <= BROADCAST_RULES:
        known = F.broadcast(known)

    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    most = F.least(F.size(labels), F.lit(shape.labels or 0))
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(shape.lengths or [])]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expanded = rows.select("*", F.explode_outer(F.when(F.col("host") != "", expressions)).alias("expression")).withColumn("full", F.sha2("expression", 256))
    # A row without expressions meets no rule: its own number keeps it from being one more of a hot key.
    expanded = expanded.withColumn("short", F.coalesce(F.substring("full", 1, PREFIX_HEX), F.col("row").cast("string")))
    met = expanded.join(known.withColumnRenamed("short", "of"), (F.col("short") == F.col("of")) & (F.col("full") == F.col("digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "action", "rule"))).alias("best")
    out = met.groupBy("row", "page_id", "host", "path").agg(best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
