"""Address-space views: extents, densities and heat maps over logical block addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.functions import scalars as fn
from iotrace.operators import ranks

BINS = 512
HEAT_BINS = 256


def busiest_device(rows: DataFrame) -> DataFrame:
    """One row ``(disk_name, n)``: the device with most rows, the first by name of equals."""
    return rows.where("disk_name is not null").groupBy("disk_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "disk_name").limit(1)


def extent(rows: DataFrame) -> DataFrame:
    """One row ``(lba_min, lba_max)`` of the rows with a sector; the end counts whole sectors."""
    end = F.col("sector") + fn.int_div(F.coalesce("bytes", F.lit(0)), fn.SECTOR_BYTES)
    return rows.where("sector is not null").agg(F.min("sector").alias("lba_min"), F.max(end).alias("lba_max"))


def nearest_rank_bounds(rows: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row ``(lba_min, lba_max)``: sectors at ranks round(p * (n - 1)), by ``ranks.counted``."""
    counts = ranks.counted(rows, [], "sector")
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1) + 0.5), F.col("value")))
    return counts.agg(at(low).alias("lba_min"), at(high).alias("lba_max"))


def bin_of(value: Column, low: Column, span: Column, bins: int) -> Column:
    """Bin of ``value`` among ``bins`` equal ones over ``span`` from ``low``; values outside go to the end bins.

    Exact for 64-bit values: the product is a decimal.
    """
    scaled = fn.int_div((value - low).cast("decimal(20,0)") * F.lit(bins).cast("decimal(10,0)"), F.greatest(span, F.lit(1)).cast("decimal(20,0)"))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), scaled)).cast("int")


def _bounded(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    return rows.where("sector is not null").join(F.broadcast(bounds)).withColumn("span", F.greatest(F.col("lba_max") - F.col("lba_min"), F.lit(1)))


def distribution(rows: DataFrame, by: list[str], bins: int = BINS, bounds: DataFrame | None = None) -> DataFrame:
    """``(*by, lba_bin, lba_start, n)`` of the bins in use; by default over the extent of all rows."""
    rows = _bounded(rows, extent(rows) if bounds is None else bounds)
    counts = rows.groupBy(*by, bin_of(F.col("sector"), F.col("lba_min"), F.col("span"), bins).alias("lba_bin"), "lba_min", "span").agg(F.count("*").alias("n"))
    start = F.col("lba_min") + F.floor(F.col("lba_bin") * F.col("span") / bins)
    return counts.select(*by, "lba_bin", start.cast("bigint").alias("lba_start"), "n")


def heatmap(rows: DataFrame, by: list[str], bounds: DataFrame, times: DataFrame, bins: int = HEAT_BINS) -> DataFrame:
    """``(*by, time_bin, lba_bin, n, log1p)`` over the run (``times``: one row ts_min, ts_max) and the given bounds."""
    rows = _bounded(rows, bounds).join(F.broadcast(times.select("ts_min", "ts_max").where("ts_max > ts_min")))
    cells = rows.groupBy(
        *by, bin_of(F.col("timestamp_ns"), F.col("ts_min"), F.col("ts_max") - F.col("ts_min") + 1, bins).alias("time_bin"),
        bin_of(F.col("sector"), F.col("lba_min"), F.col("span"), bins).alias("lba_bin"),
    ).agg(F.count("*").alias("n"))
    return cells.withColumn("log1p", F.round(F.log1p("n"), 6))


def heat_maximum(cells: DataFrame, by: list[str] = ("op",)) -> DataFrame:
    return cells.groupBy(*by).agg(F.max("log1p").alias("max_log1p"))
