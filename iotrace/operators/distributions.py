"""Exact distributions: count, bounds, mean and interpolated percentiles of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.operators import ranks

#: The percentiles reported.
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
STATS = ("count", "min", "max", "mean", *PERCENTILES)


def _rounded(c: Column, places: int) -> Column:
    return F.round(c.cast("double"), places)


def stats(rows: DataFrame, by: list[str], value: str = "value", approximate: int | None = None, places: int = 2) -> DataFrame:
    """``(*by, count, min, max, mean, p1, p5, p50, p95, p99)`` of the values that are not null, rounded.

    Percentiles interpolate linearly between exact ranks, for groups of any size (``ranks.counted``).
    ``approximate`` takes a sketch of that accuracy instead.
    """
    if approximate is not None:
        ps = F.array(*[F.lit(p) for p in PERCENTILES.values()])
        out = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
            F.count(value).alias("count"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.avg(value).alias("_mean"), F.percentile_approx(value, ps, approximate).alias("_q")
        )
        return out.select(
            *by, "count", _rounded(F.col("_min"), places).alias("min"), _rounded(F.col("_max"), places).alias("max"), _rounded(F.col("_mean"), places).alias("mean"),
            *[_rounded(F.col("_q")[i], places).alias(name) for i, name in enumerate(PERCENTILES)],
        )
    ranked = ranks.counted(rows, by, value).withColumn("v", F.col("value").cast("double"))

    def at(p: float) -> Column:
        k = F.lit(p) * (F.col("total") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(k), F.col("v")))
        high = F.min(F.when(F.col("upto") > F.ceil(k), F.col("v")))
        part = F.max(k - F.floor(k))
        return low + part * (high - low)

    return ranked.groupBy(*by).agg(
        F.sum("n").alias("count"), _rounded(F.min("v"), places).alias("min"), _rounded(F.max("v"), places).alias("max"),
        _rounded(F.sum(F.col("v") * F.col("n")) / F.sum("n"), places).alias("mean"), *[_rounded(at(p), places).alias(name) for name, p in PERCENTILES.items()],
    )


def metric_values(rows: DataFrame, by: list[str], layer: str) -> DataFrame:
    """``(*by, metric, op, value)``: latencies and sizes of a layer in long form, from one scan.

    block: driver latency and size of completions, queue latency of issues. nvme: latency and size of completions.
    fs: latency and size of exits, both only if positive.
    """
    item = lambda cond, metric, col: F.when(cond & F.col(col).isNotNull(), F.struct(F.lit(metric).alias("metric"), F.col(col).alias("value")))
    event = F.col("event")
    if layer == "fs":
        out = event == "exit"
        items = [item(out & (F.col("latency_ns") > 0), "sc_latencies", "latency_ns"), item(out & (F.col("bytes") > 0), "sc_sizes", "bytes")]
        op = "syscall"
    else:
        done, op = event == "complete", "op"
        latency, size = ("driver_latencies", "rq_sizes") if layer == "block" else ("cmd_latencies", "cmd_sizes")
        items = [item(done, latency, "latency_ns"), item(done, size, "bytes")]
        if layer == "block":
            items.append(item(event == "issue", "queue_latencies", "latency_ns"))
    rows = rows.select(*by, F.col(op).alias("op"), F.explode(F.array_compact(F.array(*items))).alias("m"))
    return rows.select(*by, "m.metric", "op", "m.value")


def layer_distributions(rows: DataFrame, by: list[str], layer: str, approximate: int | None = None) -> DataFrame:
    return stats(metric_values(rows, by, layer), [*by, "metric", "op"], "value", approximate)


def merge_dominant(dists: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """Distributions of identities merged by ``by``: counts add up, bounds widen, the mean is weighted, and the
    percentiles are those of the identity of least ``rank``. Exact merged percentiles come from ``stats`` by label."""
    weighted = F.round(F.sum(F.col("mean") * F.col("count")) / F.sum("count"), 2)
    return dists.groupBy(*by).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), weighted.alias("mean"),
        *[F.min_by(p, rank).alias(p) for p in PERCENTILES], F.sum("count").alias("count"),
    ).select(*by, *STATS)
