"""Counts and byte sums per identity or label, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrace.functions import scalars as fn

#: Names of counters by layer and event.
NAMES = {
    "block": {"complete": ("rq_completed", "rq_total_bytes"), "issue": ("rq_issued", None), "insert": ("rq_queued", None)},
    "nvme": {"complete": ("cmd_completed", "cmd_total_bytes"), "setup": ("cmd_setup", None)},
}


def base(rows: DataFrame, by: list[str], op: str = "op") -> DataFrame:
    """``(*by, event, op, n, total_bytes, positive_bytes, ts_min, ts_max)``: one partial and one final aggregate."""
    bytes_ = F.coalesce(F.col("bytes"), F.lit(0))
    return rows.groupBy(*by, "event", F.col(op).alias("op")).agg(
        F.count("*").alias("n"), F.sum(bytes_).alias("total_bytes"), F.sum(F.greatest(bytes_, F.lit(0))).alias("positive_bytes"),
        F.min("timestamp_ns").alias("ts_min"), F.max("timestamp_ns").alias("ts_max"),
    )


def event_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("event").agg(F.sum("n").alias("n"))


def run_bounds(counts: DataFrame) -> DataFrame:
    """One row ``(ts_min, ts_max, duration_s)``; the duration is 0 where the last event is not after the first."""
    return counts.agg(F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max")).select(
        "ts_min", "ts_max", F.coalesce(F.greatest(F.lit(0.0), (F.col("ts_max") - F.col("ts_min")) / fn.SECOND_NS), F.lit(0.0)).alias("duration_s")
    )


def named(counts: DataFrame, by: list[str], layer: str) -> DataFrame:
    """``(*by, metric, op, value)``: the layer's counters in long form.

    fs counts completed and entered I/O syscalls and their bytes if there are any; of other syscalls it counts enters.
    """
    long = lambda cond, metric, value: F.when(cond, F.struct(F.lit(metric).alias("metric"), F.col(value).alias("value")))
    if layer == "fs":
        io, out, into = F.col("op").isin(*fn.IO_SYSCALLS), F.col("event") == "exit", F.col("event") == "enter"
        items = [
            long(io & out, "sc_completed", "n"), long(io & into, "sc_entered", "n"),
            long(io & out & (F.col("positive_bytes") > 0), "sc_total_bytes", "positive_bytes"), long(~io & into, "sc_count", "n"),
        ]
    else:
        items = []
        for event, (count, total) in NAMES[layer].items():
            items.append(long(F.col("event") == event, count, "n"))
            if total:
                items.append(long(F.col("event") == event, total, "total_bytes"))
    rows = counts.select(*by, "op", F.explode(F.array_compact(F.array(*items))).alias("c"))
    return rows.groupBy(*by, F.col("c.metric").alias("metric"), "op").agg(F.sum("c.value").alias("value"))


def merged(values: DataFrame, by: list[str] = ("label",)) -> DataFrame:
    """Counters of identities that share a label, or of all, added up."""
    return values.groupBy(*by, "metric", "op").agg(F.sum("value").alias("value"))


def last_written(results: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of results that were written more than once the last by ``order``, as for patterns, which do not add up."""
    rest = [c for c in results.columns if c not in (*by, order)]
    last = results.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return last.select(*by, "x.*")


def throughput(counts: DataFrame, totals: DataFrame, duration_s: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, iops, mib_s)`` from ``(*by, value)`` counts and bytes; keys of either count, the missing side is 0.

    ``duration_s`` is one row; a duration of 0 gives no rows.
    """
    both = counts.select(*by, F.col("value").alias("n")).join(totals.select(*by, F.col("value").alias("b")), list(by), "full_outer")
    both = both.join(F.broadcast(duration_s.select("duration_s").where("duration_s > 0")))
    return both.select(
        *by,
        F.round(F.coalesce("n", F.lit(0)) / F.col("duration_s"), 2).alias("iops"),
        F.round(F.coalesce("b", F.lit(0)) / F.col("duration_s") / (1 << 20), 2).alias("mib_s"),
    )


def op_share(counts: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, op, n, pct)``: each op's part of its label's events."""
    from pyspark.sql.window import Window as W

    n = counts.groupBy(*by, "op").agg(F.sum("n").alias("n"))
    return n.withColumn("pct", fn.percent(F.col("n"), F.sum("n").over(W.partitionBy(*by))))
