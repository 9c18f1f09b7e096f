"""Time series: gauges, completions and bytes per bucket, filled grids, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.functions import scalars as fn
from iotrace.operators import distributions, ranks
from iotrace.sources import schemas


def with_bounds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` with the run's one-row scalars, within one lazy plan."""
    return rows.join(F.broadcast(bounds))


def per_bucket(rows: DataFrame, by: list[str], layer: str, order: list[str] = ("timestamp_ns",), width_ns: int = fn.SECOND_NS) -> DataFrame:
    """``(*by, op, sec, <gauges>, completions, total_bytes)``: last gauge values, completions and bytes of each bucket.

    ``rows`` carry ``ts_min``. The last event is the latest by ``order``, whatever the file order. Of fs only the I/O syscalls count.
    """
    op, end = schemas.OP[layer], schemas.END[layer]
    rows = rows.where(F.col(op).isin(*fn.IO_SYSCALLS)) if layer == "fs" else rows
    sec = fn.time_bucket(F.col("timestamp_ns"), F.col("ts_min"), width_ns).alias("sec")
    done = F.col("event") == end
    return rows.groupBy(*by, F.col(op).alias("op"), sec).agg(
        *[F.max_by(g, F.struct(*order)).alias(g) for g in schemas.GAUGES[layer]],
        F.count_if(done).alias("completions"), F.sum(F.when(done, F.coalesce("bytes", F.lit(0))).otherwise(0)).alias("total_bytes"),
    )


def gauge_points(buckets: DataFrame, by: list[str], gauge: str) -> DataFrame:
    """``(*by, op, sec, value)`` of a gauge, negatives as 0; buckets without events have no point."""
    return buckets.where(F.col(gauge).isNotNull()).select(*by, "op", "sec", fn.clamp(F.col(gauge)).cast("bigint").alias("value"))


def filled(buckets: DataFrame, by: list[str], value: str, bounds: DataFrame, width_ns: int = fn.SECOND_NS) -> DataFrame:
    """``(*by, op, sec, value)`` for every bucket of the run, 0 where there is none.

    The run has ceil(duration) buckets, so an event at a whole duration lies outside, by definition. The grid
    is an explode of each key's range, not a join of keys and times.
    """
    n = F.ceil((F.col("ts_max") - F.col("ts_min")) / F.lit(width_ns)).cast("int")
    n_buckets = bounds.select(n.alias("n"))
    keys = buckets.select(*by, "op").distinct().join(F.broadcast(n_buckets)).where("n > 0")
    grid = keys.select(*by, "op", F.explode(F.expr("sequence(0L, cast(n as bigint) - 1L)")).alias("sec"))
    out = grid.join(buckets.select(*by, "op", "sec", F.col(value).alias("value")), [*by, "op", "sec"], "left")
    return out.select(*by, "op", "sec", F.coalesce("value", F.lit(0)).alias("value"))


def area(value: str = "value", order: str = "sec") -> Column:
    """Trapezoidal area of a group's points a bucket apart, in order; of one point its value. Gaps are not widened."""
    ends = (F.min_by(value, order) + F.max_by(value, order)) / 2
    return F.when(F.count(value) > 1, F.sum(value) - ends).otherwise(F.sum(value)).cast("double")


def series_stats(points: DataFrame, by: list[str], value: str = "value", order: str = "sec", places: int = 2) -> DataFrame:
    """``stats`` of each series and ``area_under_curve``, from one aggregate of the points."""
    areas = points.where(F.col(value).isNotNull()).groupBy(*by).agg(F.round(area(value, order), places).alias("area_under_curve"))
    return distributions.stats(points, by, value, places=places).join(areas, list(by))


def cumulative_mb(buckets: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, op, sec, mb)``: running sum of bytes, from per-bucket sums, in MB of 2**20 bytes."""
    run = W.partitionBy(*by, "op").orderBy("sec").rowsBetween(W.unboundedPreceding, 0)
    return buckets.select(*by, "op", "sec", F.round(F.sum("total_bytes").over(run) / (1 << 20), 6).alias("mb"))


def cdf(rows: DataFrame, by: list[str], value: str = "value", max_points: int = 10_000) -> DataFrame:
    """``(*by, value, cdf)``: sorted values against rank / n, at up to ``max_points`` evenly spaced ranks.

    Equal values are counted first (``ranks.counted``); a rank's value is that of the run of equals it falls in. A
    run keeps the last of its chosen ranks.
    """
    ranked = ranks.counted(rows, by, value)
    points = F.least(F.col("total"), F.lit(max_points))
    # chosen ranks are floor(k * (total - 1) / (points - 1)); the last k at or before this run's last rank
    k = F.least(points - 1, fn.int_div(F.col("upto") * (points - 1) - 1, F.col("total") - 1))
    rank = F.when(F.col("total") == 1, F.lit(0)).otherwise(fn.int_div(k * (F.col("total") - 1), points - 1))
    return ranked.where(rank >= F.col("upto") - F.col("n")).select(*by, "value", F.round((rank + 1) / F.col("total"), 6).alias("cdf"))
