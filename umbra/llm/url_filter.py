"""URL filters: host-suffix and path-prefix expressions joined with hashed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import local_table, table

#: The rules of the registered query: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rule tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return local_table(spark, list(rules), "verdict string, host string, path string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path; both empty where there is no ``://``."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", unusable: str = "block") -> DataFrame:
    """Verdict of the longest rule that fits each url.

    Each distinct url is expanded into its host suffixes times its path prefixes, only at the label
    counts and path lengths that the rules have. The expressions meet the rules on eight hex digits
    of a SHA-256 digest; the whole digest confirms, and the longest host and path wins (a block
    before an allow of the same length). Where no rule fits, an url with a host gets ``default``
    and one without gets ``unusable``.

    Returns ``page`` (the input row as a struct), ``host``, ``path``, ``rule`` and ``verdict``.
    Defined cases: null urls and urls without ``://`` have an empty host and path; repeated rows
    stay repeated; repeated rules count once; an empty rule table or page table is no error.
    """
    # the rule table's size is counted before anything is sent to every executor
    shape = rules.agg(
        F.count("*").alias("n"),
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.char_length("path")).alias("lengths"),
    ).first()
    labels, lengths = sorted(shape["labels"]) or [1], sorted(shape["lengths"]) or [0]
    hashed = rules.select(
        _digest(F.col("host"), F.col("path")).alias("_full"),
        F.concat("host", "path").alias("_rule"),
        F.col("verdict").alias("_verdict"),
        F.char_length("host").alias("_hl"),
        F.char_length("path").alias("_pl"),
    )
    hashed = hashed.withColumn("_short", F.substring("_full", 1, 8)).distinct()
    if shape["n"] <= BROADCAST_RULES:
        hashed = F.broadcast(hashed)

    rows = pages.select(F.struct("*").alias("page"), F.col("url").alias("_url"))
    host, path = url_parts(F.col("_url"))
    urls = rows.where("_url is not null").select("_url").distinct().select("_url", host.alias("_host"), path.alias("_path"))
    parts = F.split("_host", r"\.")
    suffixes = F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels])
    prefixes = F.array(*[F.when(F.char_length("_path") >= n, F.substring("_path", 1, n)) for n in lengths])
    found = (
        urls.select("_url", F.explode(F.array_compact(suffixes)).alias("_suffix"), "_path")
        .select("_url", "_suffix", F.explode(F.array_compact(prefixes)).alias("_prefix"))
        .select("_url", _digest(F.col("_suffix"), F.col("_prefix")).alias("_mine"))
        .withColumn("_short", F.substring("_mine", 1, 8))
        .join(hashed, "_short")
        .where("_mine = _full")
        .groupBy("_url")
        .agg(F.max(F.struct(F.expr("_hl + _pl").alias("a"), F.col("_hl").alias("b"), (F.col("_verdict") == "block").alias("c"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best"))
    )
    judged = rows.join(found, "_url", "left")
    host, path = url_parts(F.col("_url"))
    return judged.select(
        "page",
        host.alias("host"),
        path.alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.when(host == "", unusable).otherwise(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark))
    return out.select(F.col("page.page_id").alias("page_id"), "host", "path", "rule", "verdict")


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(v, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), ranked AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS place
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM ranked WHERE place = 1
"""
