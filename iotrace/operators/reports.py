"""Tidy series of the layer dashboards, and the report of summary traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.functions import scalars as fn
from iotrace.operators import access, counters, distributions, histograms, lba, series, sysstat
from iotrace.sources import schemas
from iotrace.storage import materialize

#: Maps of summary traces by layer, and those that throughput is made of.
SUMMARY = {
    "block": {
        "counters": ("rq_issued", "rq_completed", "rq_queued", "rq_queue_done", "rq_direct_dispatch", "rq_untracked_complete", "rq_total_bytes"),
        "histograms": ("driver_latencies", "queue_latencies", "rq_sizes"), "series": ("d_inflight", "q_inflight"),
        "throughput": ("rq_completed", "rq_total_bytes"),
    },
    "nvme": {
        "counters": ("cmd_setup", "cmd_completed", "cmd_untracked", "cmd_total_bytes"), "histograms": ("cmd_latencies", "cmd_sizes"),
        "series": ("cmd_inflight",), "throughput": ("cmd_completed", "cmd_total_bytes"),
    },
    "fs": {
        "counters": ("sc_entered", "sc_completed", "sc_untracked", "sc_total_bytes", "sc_count"), "histograms": ("sc_latencies", "sc_sizes"),
        "series": ("sc_inflight",), "throughput": ("sc_completed", "sc_total_bytes"),
    },
}


def _points(df: DataFrame, by: list[str], name: str, op: Column, x: Column, y: Column) -> DataFrame:
    return df.select(*by, F.lit(name).alias("series"), op.alias("op"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def gap_points(rows: DataFrame, by: list[str], layer: str, order: list[str]) -> DataFrame:
    """``(*by, op, gap)`` for gap curves: by sector of issues or setups, by offset and by rebuilt position of calls."""
    if layer != "fs":
        return access.sector_gaps(rows, by, schemas.START[layer], order).where("gap is not null").select(*by, "op", "gap")
    calls = rows.where((F.col("event") == "enter") & F.col("syscall").isin("pread64", "pwrite64") & F.col("fd").isNotNull())
    offset = access.gaps(calls, [*by, "syscall", "fd"], "offset", F.coalesce("bytes", F.lit(0)), order).where("gap is not null")
    parts = [offset, access.position_gaps(rows, by, order=order)]
    return reduce(DataFrame.unionByName, [p.select(*by, F.col("syscall").alias("op"), "gap") for p in parts])


def layer_series(rows: DataFrame, by: list[str], layer: str, order: list[str] = ("timestamp_ns",), width_ns: int = fn.SECOND_NS, max_points: int = 10_000) -> DataFrame:
    """``(*by, series, op, x, y)``: op share, gauges, completions and MB over time, and curves of sizes, latencies (µs) and gaps.

    The labelled rows, the buckets and the gaps are stored, as many series read each.
    """
    order, op = list(order), schemas.OP[layer]
    rows = materialize(rows, "rows")
    counts = counters.base(rows, by, op)
    bounds = counters.run_bounds(counts)
    buckets = materialize(series.per_bucket(series.with_bounds(rows, bounds.select("ts_min")), by, layer, order, width_ns), "buckets")
    done = rows.where(F.col("event") == schemas.END[layer]).withColumn("op", F.col(op))
    c = F.col
    out = [_points(counters.op_share(counts.where(c("event") == schemas.END[layer]), by), by, "op_share", c("op"), c("n"), c("pct"))]
    for g in schemas.GAUGES[layer]:
        out.append(_points(series.gauge_points(buckets, by, g), by, g, c("op"), c("sec"), c("value")))
    out.append(_points(buckets.where("completions > 0"), by, "iops", c("op"), c("sec"), c("completions")))
    out.append(_points(series.cumulative_mb(buckets, by), by, "cumulative_mb", c("op"), c("sec"), c("mb")))
    item = lambda name, value: F.when(value > 0, F.struct(F.lit(name).alias("series"), value.cast("double").alias("v")))
    both = F.array_compact(F.array(item("size_cdf", c("bytes")), item("latency_cdf_us", c("latency_ns") / 1000)))
    curve = series.cdf(done.select(*by, "op", F.explode(both).alias("m")).select(*by, "op", "m.*"), [*by, "series", "op"], "v", max_points)
    out.append(curve.select(*by, "series", "op", c("value").alias("x"), c("cdf").alias("y")))
    curve = series.cdf(materialize(gap_points(rows, by, layer, order), "gaps"), [*by, "op"], "gap", max_points)
    out.append(_points(curve, by, "gap_cdf", c("op"), c("value"), c("cdf")))
    if layer == "nvme":
        setups = rows.where("event = 'setup'")
        for name, limits in (("lba_density", lba.extent(setups)), ("lba_density_local", lba.nearest_rank_bounds(setups))):
            out.append(_points(lba.distribution(setups, [*by, "op"], bounds=limits), by, name, c("op"), c("lba_bin"), c("n")))
    return reduce(DataFrame.unionByName, out)


def heat_series(rows: DataFrame, by: list[str], bins: int = lba.HEAT_BINS) -> DataFrame:
    """``(*by, series, op, x, y, z, z_max)``: the heat map of each group and op, a third coordinate behind x and y.

    x is the bin of time over the run, y that of the address between the 1st and 99th percentile, z log1p of the
    setups in the cell, and z_max the largest z of the op over all groups, so that all maps of an op share a scale.
    Cells without setups have no row.
    """
    setups = rows.where("event = 'setup'")
    times = rows.agg(F.min("timestamp_ns").alias("ts_min"), F.max("timestamp_ns").alias("ts_max"))
    cells = lba.heatmap(setups, [*by, "op"], lba.nearest_rank_bounds(setups), times, bins)
    # at most bins * bins rows a group and op; the maxima are a row an op
    cells = cells.join(lba.heat_maximum(cells).withColumnRenamed("op", "_op"), F.col("op").eqNullSafe(F.col("_op")))
    points = cells.select(*by, "op", "time_bin", "lba_bin", F.col("log1p").alias("z"), F.col("max_log1p").alias("z_max"))
    return points.select(*by, F.lit("lba_heatmap").alias("series"), "op", F.col("time_bin").cast("double").alias("x"), F.col("lba_bin").cast("double").alias("y"), "z", "z_max")


def sysstat_series(cpu: DataFrame, mem: DataFrame, dev: DataFrame, time: str = "time") -> DataFrame:
    """``(command, series, op, x, y)``-like rows ``(command, metric, time, value)`` for the resource dashboard.

    cpu by core, memory share and disk rates, of the top commands by name and the rest as ``other``, every series
    at every time.
    """
    shown = sysstat.top_commands(cpu.select("command").unionByName(mem.select("command")).unionByName(dev.select("command")), sysstat.scores(cpu, dev))
    name = lambda df: df.join(shown.select("command", "shown"), "command").drop("command").withColumnRenamed("shown", "command")
    core = sysstat.sampled(name(cpu), ("cpu_pct",), ["command", "cpu"], time).withColumn("metric", F.concat(F.lit("cpu_"), F.col("cpu").cast("string"))).drop("cpu")
    parts = [core, sysstat.sampled(name(mem), ("mem_pct",), ["command"], time), sysstat.sampled(name(dev), ("kb_rd_s", "kb_wr_s"), ["command"], time)]
    points = reduce(DataFrame.unionByName, [p.select("command", "metric", F.col(time).alias("time"), "value") for p in parts])
    keyed = points.withColumn("command", F.struct("command", "metric")).drop("metric")
    return sysstat.aligned(keyed).select("command.command", "command.metric", "time", "value")


def summary_report(counter_rows: DataFrame, histogram_rows: DataFrame, series_rows: DataFrame, layer: str) -> DataFrame:
    """``(file, part, map, key, stat, value)`` of summary traces: counters, distributions, series, and throughput over the run."""
    known, by = SUMMARY[layer], ["file", "map", "key"]
    within = lambda df, part: df.where(F.col("map").isin(*known[part]))

    def long(df: DataFrame, part: str, stats: tuple[str, ...]) -> DataFrame:
        pairs = ", ".join(f"'{s}', cast({s} as double)" for s in stats)
        return df.select("file", F.lit(part).alias("part"), "map", "key", F.expr(f"stack({len(stats)}, {pairs}) as (stat, value)"))

    out = [long(within(counter_rows, "counters"), "counters", ("value",))]
    out.append(long(histograms.stats_of_buckets(within(histogram_rows, "histograms"), by), "distributions", distributions.STATS))
    stats = series.series_stats(within(series_rows, "series"), by, "value", "place")
    out.append(long(stats, "tseries", (*distributions.STATS, "area_under_curve")))
    secs = fn.clock_seconds(F.col("time"))
    length = series_rows.groupBy("file").agg((F.max(secs) - F.min(secs)).alias("duration_s")).where("duration_s > 0")
    count, total = known["throughput"]
    both = counter_rows.where(F.col("map").isin(count, total)).groupBy("file", "key").agg(
        F.coalesce(F.max(F.when(F.col("map") == count, F.col("value"))), F.lit(0)).alias("n"),
        F.coalesce(F.max(F.when(F.col("map") == total, F.col("value"))), F.lit(0)).alias("b"),
    )
    rate = both.join(length, "file").select(
        "file", F.lit("throughput").alias("map"), "key", F.round(F.col("n") / F.col("duration_s"), 2).alias("iops"),
        F.round(F.col("b") / F.col("duration_s") / (1 << 20), 2).alias("mib_s"),
    )
    out.append(long(rate, "derived", ("iops", "mib_s")))
    return reduce(DataFrame.unionByName, out)
