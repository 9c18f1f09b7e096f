"""Histograms: buckets of powers of two, and statistics of bucketed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.functions import scalars as fn
from iotrace.operators.distributions import PERCENTILES

EMPTY_STATS = ("count", "min", "max", "mean", *PERCENTILES)


def log2(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``(*by, lo, hi, count)``: [2**k, 2**(k+1)) of positive integers, and (0, 1) of the rest; nulls are left out."""
    v = F.col(value).cast("bigint")
    lo = F.when(v > 0, fn.power_of_two(fn.log2_floor(v))).otherwise(0)
    counts = rows.where(v.isNotNull()).groupBy(*by, lo.alias("lo")).agg(F.count("*").alias("count"))
    return counts.select(*by, "lo", F.when(F.col("lo") > 0, F.col("lo") * 2).otherwise(1).alias("hi"), "count")


def points_and_ranges(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``(*by, kind, lo, hi, count)``: exact powers of two are points (lo = hi), the rest falls between them."""
    v = F.col(value).cast("bigint")
    lo = F.when(v > 0, fn.power_of_two(fn.log2_floor(v))).otherwise(0)
    point = (v > 0) & (v == lo)
    counts = rows.where(v.isNotNull()).groupBy(*by, F.when(point, "point").otherwise("range").alias("kind"), lo.alias("lo")).agg(F.count("*").alias("count"))
    hi = F.when(F.col("kind") == "point", F.col("lo")).when(F.col("lo") > 0, F.col("lo") * 2).otherwise(1)
    return counts.select(*by, "kind", "lo", hi.alias("hi"), "count")


def stats(hist: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, count, min, max, mean, p1, p5, p50, p95, p99)`` of ``(*by, kind, lo, hi, count)`` rows.

    Points are exact. A range counts in the mean as its geometric middle (half of hi if lo is 0), and percentiles
    go through it on a logarithmic scale (linear if lo is 0). Buckets are ordered by start, points first; the
    percentile's bucket is the first whose running count reaches it. Empty buckets do not count; groups of only
    such have zeros.
    """
    used = hist.where("count > 0")
    order = W.partitionBy(*by).orderBy("lo", "kind").rowsBetween(W.unboundedPreceding, 0)
    run = used.withColumn("upto", F.sum("count").over(order)).withColumn("total", F.sum("count").over(W.partitionBy(*by)))
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    middle = F.when(F.col("kind") == "point", lo).when(lo > 0, F.sqrt(lo * hi)).otherwise(hi / 2)

    def at(p: float) -> Column:
        part = (p * F.col("total") - (F.col("upto") - F.col("count"))) / F.col("count")
        value = F.when(F.col("kind") == "point", lo).when(lo > 0, lo * F.pow(F.try_divide(hi, lo), part)).otherwise(hi * part)
        return F.min_by(F.when(F.col("upto") >= p * F.col("total"), value), F.when(F.col("upto") >= p * F.col("total"), F.struct("upto", "lo", "kind")))

    known = run.groupBy(*by).agg(
        F.sum("count").alias("count"), F.min("lo").cast("double").alias("min"), F.max("hi").cast("double").alias("max"),
        F.round(F.sum(middle * F.col("count")) / F.sum("count"), 2).alias("mean"), *[F.round(at(p), 2).alias(n) for n, p in PERCENTILES.items()],
    )
    if not by:
        return known
    none = hist.select(*by).distinct().join(known.select(*by), list(by), "left_anti")
    zeros = [F.lit(0).cast("bigint").alias("count"), *[F.lit(0.0).alias(n) for n in EMPTY_STATS[1:]]]
    return known.unionByName(none.select(*by, *zeros))


def stats_of_buckets(buckets: DataFrame, by: list[str]) -> DataFrame:
    return stats(buckets.withColumn("kind", F.lit("range")), by)


def with_buckets(hist: DataFrame, by: list[str]) -> DataFrame:
    """Statistics together with the buckets, ``array<lo, hi, count>`` in order."""
    data = hist.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "count"))).alias("buckets"))
    return stats(hist, by).join(data, list(by))


def with_points(points: DataFrame, stats_df: DataFrame, by: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """Series statistics together with the points, ``array<time, value>`` in order."""
    data = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(time, value))).alias("points"))
    return stats_df.join(data, list(by))
