"""Page map (backward as-of) and span overlap (interval) joins, on order data as stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left (key, at, ...) with the last ``value`` of right (key, at, value) at or before it: one union and one window, no range join."""
    both = right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["id"].dataType).alias("id")).unionByName(left.select(key, at, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"), "id"))
    w = Window.partitionBy(key).orderBy(at, "_side", F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", True).over(w)).where("_side = 1").select("id", value)


def overlap_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of spans (key, id, s, e) of one key that overlap; the earliest of right for each of left."""
    r = right.select(key, F.col("id").alias("rid"), F.col("s").alias("rs"), F.col("e").alias("re"))
    return left.join(r, key).where("rs <= e AND re >= s").groupBy(key, "id").agg(F.min_by("rid", F.struct("rs", "rid")).alias("first"), F.count("*").alias("overlaps"))


def as_of(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    open_ = o.where("o_orderstatus <> 'O'").select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("page"))
    return as_of_join(o.select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id")), open_, "o_custkey", "at", "page").select(F.col("id").alias("o_orderkey"), "page")


def overlaps(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").alias("id"), F.to_date("l_shipdate").alias("s"), F.date_add(F.to_date("l_shipdate"), 7).alias("e"))
    return overlap_join(l, l, "l_orderkey").select("l_orderkey", F.col("id").alias("l_linenumber"), "first", "overlaps")


AS_OF_SQL = """SELECT a.o_orderkey, (SELECT arg_max(b.o_orderkey, (b.o_orderdate, b.o_orderkey)) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus <> 'O' AND b.o_orderdate <= a.o_orderdate) AS page FROM orders a"""
OVERLAPS_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS s, l_shipdate::DATE + 7 AS e FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, arg_min(b.l_linenumber, (b.s, b.l_linenumber)) AS first, count(*) AS overlaps FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.s <= a.e AND b.e >= a.s GROUP BY a.l_orderkey, a.l_linenumber"""
