"""URL rules by host suffixes, path prefixes and short hashes, in DataFrame operations only.

A rule is a host and a path prefix with an action. It fits its host and all subdomains when the URL's path starts with
the rule's path; the longest fitting rule wins, block before allow at equal length. Each distinct (host, path) is
expanded into the expressions host suffix + path prefix, but only for the numbers of labels and the path lengths that
some rule has. Expressions meet rules in an equi-join on the first 32 bits of their SHA-256; the full digest then
decides.

A null URL or one without "://" has an empty host and path and meets no rule. What no rule fits gets `otherwise`.
Equal (host, path) pairs are judged once, so repeated rows and a hot host cost one expansion. What they are judged to is
written before rows are joined to it: a hot URL then is a key that Spark splits, and rows without a host, which may be many,
pass by the join. Null page ids pass through. An empty page table gives an empty result; without rules every row gets `otherwise`. Rules with null host or
path count as empty ones; an empty host fits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(id_col, host, path, rule as host + path or null, verdict) per row of pages. rules: host, path, action."""
    rules = rules.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action").where("r_host <> ''")
    rules = rules.withColumn("digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)).withColumn("short", F.substring("digest", 1, 8))
    # two short lists of numbers, bounded by the longest rule, not by the number of rules or pages
    shapes = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    labels, lengths = (F.array(*map(F.lit, sorted(x))).cast("array<int>") for x in (shapes.labels, shapes.lengths))

    url = F.regexp_extract(F.col(url_col).cast("string"), r"(?s)^.*?://(.*)$", 1)
    host, path = F.regexp_extract(url, r"(?s)^[^/?#]*", 0), F.regexp_extract(url, r"(?s)^[^/?#]*([^?#]*)", 1)
    own = pages.select(F.col(id_col), F.coalesce(F.translate(host, _A_TO_Z, _A_TO_Z.lower()), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    names = F.split("host", r"\.")
    suffix = F.expr("array_join(slice(names, size(names) - n + 1, n), '.')")
    expressions = (
        own.select("host", "path").where("host <> ''").distinct().withColumn("names", names)
        .withColumn("n", F.explode(F.filter(labels, lambda n: n <= F.size("names")))).withColumn("suffix", suffix)
        .withColumn("length", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
        .select("host", "path", F.sha2(F.concat_ws("\n", "suffix", F.expr("substring(path, 1, length)")), 256).alias("full"))
        .withColumn("short", F.substring("full", 1, 8))
    )
    fits = expressions.join(rules, "short").where("full = digest")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), (F.col("action") == "block").cast("int").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("action"))
    won = written(fits.groupBy("host", "path").agg(F.max(rank).alias("won")).select("host", "path", "won.rule", "won.action"))
    judged = own.where("host <> ''").join(won, ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("action", F.lit(otherwise)).alias("verdict"))
    none = own.where("host = ''").select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    return judged.unionByName(none)
