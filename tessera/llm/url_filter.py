"""URL filters: a blocked Bloom filter in front of an exact hash join.

Rules are canonical URL prefixes (``host/path``) with a verdict. A rule fits its
host and every subdomain when the URL's path starts with the rule's path; the
longest fitting rule wins. Every (host suffix, path prefix) of a URL whose shape
occurs in the list is a probe; the Bloom filter passes the few that may be listed
and the exact join removes its false positives.

Null URLs or URLs without ``://`` have an empty host and path and fit no rule.
Repeated rows keep their own result row; an empty list or table is fine. Only the
named columns are read, so clashing extra columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: The rules that the contract of op5 fixes.
PAGE_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASHES = 4


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def _word_mask(key: Column) -> Column:
    """The bits that a key sets in its block, one 64-bit word."""
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(_HASHES)]
    mask = F.lit(0).cast("bigint")
    for bit in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """One row ``words``: the filter's blocks in order. ``keys`` has one column ``key``."""
    spark = keys.sparkSession
    filled = keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_word_mask(F.col("key"))).alias("word"))
    every = spark.range(blocks).select(F.col("id").cast("int").alias("block"))
    placed = every.join(filled, "block", "left").select("block", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    return placed.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "word"))), lambda x: x["word"]).alias("words"))


def filter_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", keep: list[str], default: str = "allow", bits_per_key: int = 16, max_filter_bytes: int = 8 << 20) -> DataFrame:
    """``keep`` columns of every row with host, path, rule and verdict.

    ``rules`` has columns rule, verdict. The filter takes ``bits_per_key`` bits a rule up
    to ``max_filter_bytes``; a longer list only raises its false-positive rate, which
    the exact join absorbs. The list itself is joined as Spark sees fit by its size.
    """
    listed = (
        rules.where("rule IS NOT NULL")
        .groupBy("rule").agg(F.min("verdict").alias("verdict"))
        .withColumn("rule_host", F.substring_index("rule", "/", 1))
        .withColumn("rule_path", F.expr("substring(rule, length(rule_host) + 1)"))
        .withColumn("key", F.concat_ws(" ", "rule_host", "rule_path"))
    )
    n = listed.count()
    blocks = max(16, min(math.ceil(n * bits_per_key / 64), max_filter_bytes // 8))
    shapes = listed.agg(
        F.collect_set(F.struct(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars"))).alias("shapes")
    )
    host, path = url_parts(F.col(url_col))
    judged = pages.select(*keep, host.alias("host"), path.alias("path"))
    # A verdict depends on host and path alone, so a hot URL is probed once.
    probes = (
        judged.select("host", "path").where("host <> ''").distinct()
        .withColumn("labels_n", F.size(F.split("host", r"\.")))
        .withColumn("shape", F.explode(shapes.scalar()))
        .where("shape.labels <= labels_n AND shape.chars <= length(path)")
        .withColumn("key", F.concat_ws(" ", F.expr("substring_index(host, '.', -shape.labels)"), F.expr("substring(path, 1, shape.chars)")))
        .select("host", "path", "key")
    )
    word = F.element_at(bloom_words(listed.select("key"), blocks).scalar(), _block(F.col("key"), blocks) + F.lit(1))
    mask = _word_mask(F.col("key"))
    possible = probes.where(word.bitwiseAND(mask) == mask)
    hits = (
        possible.join(listed.select("key", "rule", "verdict"), "key")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("hit"))
    )
    return judged.join(hits, ["host", "path"], "left").select(
        *keep, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in PAGE_RULES.items())
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, verdict)")
    return filter_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


OP5_SQL = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in PAGE_RULES.items())}),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM cut
),
named AS (
  SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM parts
)
SELECT page_id, host, path, w.rule AS rule, coalesce(w.verdict, 'allow') AS verdict
FROM named LEFT JOIN LATERAL (
  SELECT rule, verdict FROM rules
  WHERE (named.host = split_part(rule, '/', 1) OR ends_with(named.host, '.' || split_part(rule, '/', 1)))
    AND starts_with(named.path, substr(rule, strpos(rule, '/')))
  ORDER BY length(rule) DESC LIMIT 1
) w ON true
"""
