"""URL filter by hash-prefix lookup of host-suffix and path-prefix expressions (DataFrame functions only).

Every url is expanded into the (host suffix, path prefix) expressions that a rule could
have, the expressions meet the rules in an equi-join on a 32-bit hash prefix, the full
SHA-256 digests confirm, and the longest rule wins.

Only suffix label counts and path lengths that occur in the rules are expanded, so the
expansion of a url is bounded by the rules and not by the url.  The rules are broadcast
only while they are fewer than ``broadcast_rules`` (counted, not guessed); larger lists
are joined by a shuffle on the hash prefix.  Only the short url columns move: one row a
url after a map-side combine, whatever the share of one host or one url.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm._util import restored, set_aside

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: The rules of the registered query: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _short(key: Column) -> Column:
    """32 bits of the expression's hash."""
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a table; host labels without a leading dot."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """pages with host, path, rule and verdict appended (existing columns of those names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's.  The longest
    rule string wins; among equal rule strings, block wins over allow.  rule is null and
    verdict is ``default`` where none fits.  Null urls and urls without ``://`` have empty
    host and path and can only meet rules with an empty host, of which there are none: they
    get the default.  Rules with a null or empty host are ignored, a null path counts as
    empty.  Repeated rows are judged and returned one by one; an empty table gives an empty
    one; an empty rule table gives the default everywhere.
    """
    r = (
        rules.where(F.coalesce(F.col("host"), F.lit("")) != "")
        .select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("_v"))
        .select(F.concat("h", "p").alias("_rule"), F.size(F.split("h", r"\.", -1)).alias("_labels"), F.length("p").alias("_plen"), "_v")
        .select("*", _short(F.col("_rule")).alias("_k"), F.sha2("_rule", 256).alias("_digest"))
    )
    shapes = [(x[0], x[1]) for x in r.select("_labels", "_plen").distinct().limit(10_001).collect()]
    if len(shapes) > 10_000:
        raise ValueError("the rules have over 10,000 combinations of label count and path length")
    n_rules = r.limit(broadcast_rules + 1).count()
    own = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")))
    p, names, keep = set_aside(own)
    at = keep[[c.lower() for c in names].index(url.lower())]
    p = p.select(*keep, host_of(F.col(at)).alias("host"), path_of(F.col(at)).alias("path"), F.monotonically_increasing_id().alias("_rid"))
    if not shapes:
        return p.select(*restored(names, keep), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.size(F.split("host", r"\.", -1))
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in sorted(shapes)))
    fits = F.filter(pairs, lambda x: (x["k"] <= labels) & (x["n"] <= F.length("path")))
    # one expression for each shape; a url without any keeps a single null row
    exp = F.transform(fits, lambda x: F.concat(_suffix("host", x["k"]), F.substr(F.col("path"), F.lit(1), x["n"])))
    e = p.select("*", F.explode_outer(exp).alias("_key")).withColumn("_k", _short(F.col("_key")))
    small = n_rules <= broadcast_rules
    j = e.join(F.broadcast(r) if small else r, "_k", "left").withColumn("_ok", F.sha2("_key", 256) == F.col("_digest"))
    best = F.max(F.when(F.col("_ok"), F.struct(F.length("_rule").alias("l"), F.col("_rule").alias("r"), (F.col("_v") == "block").alias("b"), F.col("_v").alias("v"))))
    out = j.groupBy("_rid").agg(*(F.first(c).alias(c) for c in [*keep, "host", "path"]), best.alias("_b"))
    return out.select(*restored(names, keep), "host", "path", F.col("_b.r").alias("rule"), F.coalesce("_b.v", F.lit(default)).alias("verdict"))


def _suffix(host: str, k: Column) -> Column:
    """The last k labels of the host."""
    parts = F.split(host, r"\.", -1)
    return F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH rules(v, h, p) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
                               ('block','example.net','/de/8'), ('block','org','/es/')),
parts AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hits AS (
  SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, v DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (rid)
"""
