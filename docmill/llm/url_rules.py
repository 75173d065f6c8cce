"""URL filter: prefix rules as key intervals, joined to URLs by one sorted sweep.

A rule ``(host, path, verdict)`` fits its host and all subdomains when the URL's
path starts with the rule's path; the longest fitting rule wins.

Canonical key: the host's labels reversed and joined by U+0001, then U+0000,
then the path. A rule then covers exactly the keys that start with its own key,
one interval in binary string order. A URL has one key for each suffix of its
host, but only for as many labels as the longest rule has.

Sweep: rules and keys are sorted together. The last rule at or before a key
carries the stack of rules that enclose it; whatever rule covers the key is in
that stack, and the deepest that does is the answer. Rules are copied to
``salts`` sweeps so that a host with a third of all URLs is shared out evenly.

Edge cases: a null URL or one without ``://`` has empty host and path and gets
the default verdict; equal rows stay equal in number; no rules or no URLs give
the default or an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import lower_ascii, shuffle_parts, table

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "\u0001"), F.lit("\u0000"), path)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the stack of rules that enclose it, outermost first: (depth, first, key, stack).

    Of several verdicts for one host and path the smallest by name ("allow" before "block") holds.
    """
    own = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(
        F.size(_labels(F.col("host"))).alias("depth"), _labels(F.col("host"))[0].alias("first"), _key(_labels(F.col("host")), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len"),
    )
    heads = own.select(F.col("key").alias("inner"), F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("inner", F.expr("substr(inner, 1, n)").alias("key"))
    stack = heads.join(own, "key").groupBy("inner").agg(F.array_sort(F.collect_list(F.struct("key", F.length("rule").alias("len"), "host_len", "rule", "verdict"))).alias("stack"))
    return own.select("depth", "first", F.col("key").alias("inner")).join(stack, "inner").select("depth", "first", F.col("inner").alias("key"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``."""
    salts = salts or shuffle_parts(pages.sparkSession)
    stacks = rule_stacks(rules)
    deepest = max(stacks.agg(F.max("depth")).first()[0] or 0, 1)  # one number: labels of the longest rule host
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    parts = urls.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = _labels(F.col("host"))
    tries = parts.select(
        "id", "url", "host", "path", labels.alias("labels"), F.least(F.size(labels), F.lit(deepest)).alias("tries")
    ).select("*", F.explode(F.sequence(F.lit(1), F.col("tries"))).alias("depth"))
    keyed = tries.select(
        F.col("labels")[0].alias("first"), _key(F.slice("labels", F.lit(1), F.col("depth")), F.col("path")).alias("key"), F.struct("id", "url", "host", "path", "tries").alias("page")
    ).withColumn("salt", F.pmod(F.xxhash64("key", "page"), F.lit(salts)))
    starts = stacks.select("first", "key", F.lit(None).cast(keyed.schema["page"].dataType).alias("page"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "stack")
    sweep = Window.partitionBy("first", "salt").orderBy("key", F.col("page").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = keyed.unionByName(starts, allowMissingColumns=True).withColumn("top", F.last("stack", True).over(sweep)).where("page is not null")
    fit = F.expr("try_element_at(filter(top, r -> startswith(key, r.key)), -1)")
    best = swept.select("page", fit.alias("r")).groupBy("page").agg(F.max(F.struct(F.col("r.len"), F.col("r.host_len"), F.col("r.rule"), F.col("r.verdict"))).alias("best"), F.count("*").alias("n"))
    return best.select(
        F.col("page.id").alias(id_col), F.col("page.host").alias("host"), F.col("page.path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), (F.col("n") / F.col("page.tries")).cast("int"))).alias("copy"),
    ).drop("copy")


def op9_url_rules(spark, sf_dir):
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(repr, RULES)) + " AS t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') END, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
