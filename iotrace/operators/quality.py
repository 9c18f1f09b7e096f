"""Capture quality, and checks of results against an independent report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Jobs whose access is sequential, and the tolerance of checks.
SEQUENTIAL_JOBS = ("val_seqread", "val_seqwrite", "work_bulk_insert", "work_scan")
TOLERANCE = 0.02


def capture(counters: DataFrame, received: DataFrame | None = None) -> DataFrame:
    """``(event, generated, dropped, received, drop_pct)`` by event kind, and a row for ``total``.

    Received is generated less dropped, and generated is at least what the trace has (``event, n``) where given.
    """
    rows = counters
    if received is not None:
        seen = received.select("event", F.col("n").alias("seen"))
        rows = counters.join(seen, "event", "full_outer").select(
            "event", F.coalesce("generated", F.col("seen") + F.coalesce("dropped", F.lit(0))).alias("generated"), F.coalesce("dropped", F.lit(0)).alias("dropped")
        )
    rows = rows.groupBy("event").agg(F.sum("generated").alias("generated"), F.sum("dropped").alias("dropped"))
    rows = rows.unionByName(rows.agg(F.lit("total").alias("event"), F.coalesce(F.sum("generated"), F.lit(0)).alias("generated"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")))
    pct = F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("dropped"), F.col("generated")), 4), F.lit(0.0))
    return rows.select("event", "generated", "dropped", (F.col("generated") - F.col("dropped")).alias("received"), pct.alias("drop_pct"))


def approx(actual: Column, expected: Column, tolerance: float = TOLERANCE, allow_over: Column | bool = False) -> Column:
    """Whether a value is within a relative tolerance; over is fine if allowed; an expected 0 needs 0 unless over is fine."""
    over = F.lit(allow_over) if isinstance(allow_over, bool) else allow_over
    off = F.when(expected == 0, F.when(actual == 0, 0.0).otherwise(float("inf"))).otherwise(F.abs(actual - expected) / F.nullif(expected, F.lit(0)))
    return F.coalesce((off <= tolerance) | (over & (actual > expected)), F.lit(False))


def workload_class(read_ios: Column, write_ios: Column) -> Column:
    return F.when((read_ios > 0) & (write_ios > 0), "mixed").when(write_ios > 0, "write").otherwise("read")


def layer_checks(values: DataFrame, truth: DataFrame, layer: str, tolerance: float = TOLERANCE, allow_over: bool = False) -> DataFrame:
    """``(job, check, op, actual, expected, passed)`` of a layer's counters ``(job, metric, op, value)``.

    Completed requests and bytes are held against the truth ``(job, read_ios, read_bytes, write_ios, write_bytes)``
    for ops that the workload has, and starts against completions; block also queued against queue-done, where
    both are positive. Counters that are missing are 0. fs counts read and pread64, write and pwrite64 by job.
    """
    done, total, began = {"block": ("rq_completed", "rq_total_bytes", "rq_issued"), "nvme": ("cmd_completed", "cmd_total_bytes", "cmd_setup"), "fs": ("sc_completed", "sc_total_bytes", "sc_entered")}[layer]
    family = F.when(F.col("op").isin("read", "pread64"), "read").when(F.col("op").isin("write", "pwrite64"), "write").otherwise(F.col("op"))
    if layer == "fs":
        plain = F.col("job").startswith("val_seq")
        values = values.where(F.col("op").isin("read", "write") & plain | F.col("op").isin("pread64", "pwrite64") & ~plain)
    v = values.groupBy("job", "metric", family.alias("op")).agg(F.sum("value").alias("value"))
    pairs = truth.select("job", F.explode(F.array(
        F.struct(F.lit("read").alias("op"), F.col("read_ios").alias("ios"), F.col("read_bytes").alias("size")),
        F.struct(F.lit("write").alias("op"), F.col("write_ios").alias("ios"), F.col("write_bytes").alias("size")),
    )).alias("t")).select("job", "t.*").where("ios > 0")
    wide = v.groupBy("job", "op").pivot("metric", [done, total, began, "rq_queued", "rq_queue_done"]).agg(F.sum("value"))
    rows = pairs.join(wide, ["job", "op"], "left").na.fill(0)
    say = lambda name, a, e: F.struct(F.lit(name).alias("check"), a.cast("bigint").alias("actual"), e.cast("bigint").alias("expected"), approx(a, e, tolerance, allow_over).alias("passed"))
    c = F.col
    checks = [say("completed", c(done), c("ios")), say("bytes", c(total), c("size")), say("started", c(began), c(done))]
    if layer == "block":
        checks.append(F.when((c("rq_queued") > 0) & (c("rq_queue_done") > 0), say("queued", c("rq_queued"), c("rq_queue_done"))))
    return rows.select("job", "op", F.explode(F.array_compact(F.array(*checks))).alias("k")).select("job", "k.check", "op", "k.actual", "k.expected", "k.passed")


def pattern_checks(patterns: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``(job, op, expected, pct, passed)``: the share of the expected kind must reach 1 - tolerance.

    ``patterns`` are ``(job, op, sequential_pct, random_pct)``; missing shares are 0.
    """
    expected = F.when(F.col("job").isin(*SEQUENTIAL_JOBS), "sequential").otherwise("random")
    pct = F.coalesce(F.when(expected == "sequential", F.col("sequential_pct")).otherwise(F.col("random_pct")), F.lit(0.0))
    return patterns.select("job", "op", expected.alias("expected"), pct.alias("pct"), (pct >= (1 - tolerance) * 100).alias("passed"))


def lookup(values: DataFrame, wanted: DataFrame, default: int = 0) -> DataFrame:
    """``wanted(map, key)`` with ``value``, the default where there is none."""
    out = wanted.join(values.select("map", "key", "value"), ["map", "key"], "left")
    return out.select("map", "key", F.coalesce("value", F.lit(default)).alias("value"))
