"""Resource samples per process: sums over threads, statistics, top commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.functions import scalars as fn
from iotrace.operators import series

#: Metrics of each section, and how many commands are shown by name.
METRICS = {
    "cpu": ("usr", "system", "guest", "wait", "cpu_pct"),
    "mem": ("minflt_s", "majflt_s", "vsz_kb", "rss_kb", "mem_pct"),
    "dev": ("kb_rd_s", "kb_wr_s", "kb_ccwr_s", "iodelay"),
}
SHARES = ("usr", "system", "guest", "wait", "cpu_pct", "mem_pct")
TOP = 4
DAY = 86_400


def chronological(times: DataFrame, time: str = "time") -> DataFrame:
    """``(time, secs)`` of different clock times in order of a run that may pass midnight.

    Where the sorted times have a gap of over 12 hours, the largest such, the run began after it: times up to its
    lower edge are of the next day.
    """
    t = times.select(F.col(time).alias("time")).where(F.col("time").isNotNull()).distinct().withColumn("s", fn.clock_seconds(F.col("time")))
    t = t.withColumn("gap", F.lead("s").over(W.orderBy("s")) - F.col("s"))
    edge = t.where(F.col("gap") > DAY // 2).agg(F.max_by("s", F.struct("gap", "s")).alias("edge"))
    t = t.join(F.broadcast(edge))
    return t.select("time", F.when(F.col("s") <= F.col("edge"), F.col("s") + DAY).otherwise(F.col("s")).alias("secs"))


def duration(*sections: DataFrame) -> DataFrame:
    """One row ``(duration_s)`` from first to last sample of all sections."""
    times = None
    for s in sections:
        times = s.select("time") if times is None else times.unionByName(s.select("time"))
    return chronological(times).agg(F.coalesce(F.max("secs") - F.min("secs"), F.lit(0)).alias("duration_s"))


def relative_clock(points: DataFrame, by: list[str], order: str) -> DataFrame:
    """``points`` with ``rel``: seconds since the group's first time, across midnight."""
    first = F.first(fn.clock_seconds(F.col("time"))).over(W.partitionBy(*by).orderBy(order))
    return points.withColumn("rel", F.pmod(fn.clock_seconds(F.col("time")) - first, F.lit(DAY)))


def drop_first(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows without each process group's first sample, whose rates hold all it did before."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy("tgid").orderBy(*order))).where("_nth > 1").drop("_nth")


def sampled(rows: DataFrame, metrics: tuple[str, ...], by: list[str] = ("command",), time: str = "time") -> DataFrame:
    """``(*by, metric, time, value)``: sums over threads or processes at each time, to 2 places."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    long = rows.select(*by, time, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, v)"))
    return long.groupBy(*by, "metric", time).agg(F.round(F.sum(F.col("v").cast("decimal(28,6)")), 2).cast("double").alias("value"))


def section_stats(rows: DataFrame, section: str, by: list[str] = ("command",), time: str = "time", duration_s: DataFrame | None = None, places: int = 2) -> DataFrame:
    """Statistics and area of each metric of a section; with a duration, shares get the area of 100 % over it."""
    points = sampled(rows, METRICS[section], by, time)
    out = series.series_stats(points, [*by, "metric"], "value", time, places)
    if duration_s is None:
        return out
    most = F.when(F.col("metric").isin(*SHARES), F.round(100.0 * F.col("duration_s"), 2))
    return out.join(F.broadcast(duration_s)).withColumn("max_area_under_curve", most).drop("duration_s")


def per_core_area(rows: DataFrame, time: str = "time", places: int = 2) -> DataFrame:
    """``(command, cpu, area_under_curve)`` of cpu_pct summed over the threads on a core."""
    points = sampled(rows, ("cpu_pct",), ["command", "cpu"], time)
    return points.groupBy("command", "cpu").agg(F.round(series.area("value", time), places).alias("area_under_curve"))


def scores(cpu: DataFrame, dev: DataFrame) -> DataFrame:
    """``(command, score)``: cpu share and MB/s read and written, over the command's rows in both tables."""
    exact = lambda c: c.cast("decimal(28,6)")
    rows = cpu.select("command", exact(F.col("cpu_pct")).alias("v")).unionByName(
        dev.select("command", exact((F.col("kb_rd_s") + F.col("kb_wr_s")) / 1024).alias("v"))
    )
    return rows.groupBy("command").agg(F.round(F.sum("v").cast("double") / F.count("*"), 6).alias("score"))


def top_commands(commands: DataFrame, scored: DataFrame, n: int = TOP) -> DataFrame:
    """``(command, score, shown)``: the n commands of highest score under their name, the rest as ``other``."""
    all_ = commands.select("command").distinct().join(scored, "command", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rank = F.row_number().over(W.orderBy(F.desc("score"), "command"))
    return all_.select("command", "score", F.when(rank <= n, F.col("command")).otherwise("other").alias("shown"))


def aligned(points: DataFrame, value: str = "value", most: int = 1_000_000) -> DataFrame:
    """``(command, time, value)`` at every time of any command, 0 where a command has none.

    The shorter of both lists, which is counted and may have ``most`` entries, is exploded beside each of the other.
    """
    sides = {c: points.select(c).distinct() for c in ("time", "command")}
    sizes = {c: df.limit(most + 1).count() for c, df in sides.items()}
    short, long = sorted(sizes, key=lambda c: (sizes[c], c))
    if sizes[short] > most:
        raise ValueError(f"more than {most} times and commands")
    listed = sides[short].agg(F.collect_list(short).alias("_all"))
    grid = sides[long].join(F.broadcast(listed)).select(long, F.explode("_all").alias(short))
    out = grid.join(points, ["command", "time"], "left")
    return out.select("command", "time", F.coalesce(value, F.lit(0.0)).alias(value))
