"""Ranks of values within groups of any size, without a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Different values of a group that one window takes; groups with more are cut by splitters of their own.
WINDOW_VALUES = 50_000
#: Windows that a cut group or part is dealt to.
_PARTS = 64


def _part(value: Column, cuts: Column) -> Column:
    """Which part between ascending ``cuts`` a value lies in: how many of them it reaches; 0 where there are none."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: c <= value)), F.lit(0))


def _cut(counts: DataFrame, key: str, out: str, most: int) -> DataFrame:
    """``counts`` with ``out``, the part that a row's value lies in within ``key``.

    Splitters are quantiles of the group's different values by a sketch, so that the parts of a group hold about as
    many whatever the values are. Groups of at most ``most`` values are one part.
    """
    quantiles = [i / _PARTS for i in range(1, _PARTS)]
    sketch = counts.groupBy(key).agg(F.count("*").alias("_m"), F.percentile_approx("value", quantiles, 2_000).alias("_cuts"))
    sketch = sketch.where(F.col("_m") > most).select(F.col(key).alias("_of"), F.array_distinct("_cuts").alias("_cuts"))
    # few rows, one for each large group; Spark broadcasts them if they are small at run time
    cut = counts.join(sketch, F.col(key) == F.col("_of"), "left")
    return cut.withColumn(out, _part(F.col("value"), F.col("_cuts"))).drop("_of", "_cuts")


def counted(rows: DataFrame, by: list[str], value: str, most: int = WINDOW_VALUES) -> DataFrame:
    """``(*by, value, n, upto, total)``: each different value that is not null, how often it occurs, how often it or
    a lesser one does, and how many values its group has.

    Different values are counted first. Groups with more than ``most`` are cut at their own quantiles, so that a
    window takes a 64th of a group's different values even where all lie close together. The counts of the parts
    give each what lies before it.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("_key", F.struct(*by) if by else F.struct(F.lit(0)))
    cut = _cut(counts, "_key", "_part", most)
    parts = cut.groupBy("_key", "_part").agg(F.sum("n").alias("_m"))
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).withColumn("total", F.sum("_m").over(W.partitionBy("_key"))).drop("_m")
    within = W.partitionBy("_key", "_part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    out = cut.join(parts, ["_key", "_part"]).withColumn("upto", F.col("_before") + F.sum("n").over(within))
    return out.select(*by, "value", "n", "upto", "total")
