"""Request lifecycles: pairing of starts and ends, unmatched events, requests in flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.functions import scalars as fn
from iotrace.operators import scans


def pair(
    rows: DataFrame, key: list[str], starts: Column, ends: Column, order: list[str], carry: list[str] = (), prefix: str = "start", slice_ns: int = scans.SLICE_NS
) -> DataFrame:
    """``rows`` with ``<prefix>_ns`` on end rows: the time of the latest start of the key that no end has used.

    A later start replaces an earlier one, and an end uses the start up. So an end matches if the last start or
    end before it was a start. Windows go over slices of ``slice_ns`` of a key, each given the last start or end
    before it, so a busy thread is many of them; ``order`` begins with timestamp_ns. ``carry`` columns of the start
    come along as ``<prefix>_<column>``. Other rows, and ends without a start, have nulls.
    """
    start = F.struct(F.col("timestamp_ns").alias("ns"), *carry)
    mark = F.when(starts, F.struct(F.lit(True).alias("is_start"), start.alias("s"))).when(ends, F.struct(F.lit(False).alias("is_start"), start.alias("s")))
    out = scans.last_values(rows, list(key), scans.time_slice(slice_ns), list(order), {"_last": mark})
    hit = ends & F.col("_last.is_start")
    cols = [F.when(hit, F.col("_last.s.ns")).alias(f"{prefix}_ns")] + [F.when(hit, F.col(f"_last.s.{c}")).alias(f"{prefix}_{c}") for c in carry]
    return out.select(*[F.col(c) for c in rows.columns], *cols)


def block_latencies(rows: DataFrame, key: list[str] = ("rq",), order: list[str] = ("timestamp_ns",), inherit: list[str] = ("comm", "mntns_id")) -> DataFrame:
    """``rows`` with ``queue_ns`` on issues (since their insert) and ``driver_ns`` on completions (since their issue).

    Issues take process and container of their insert, if they have one, and completions the ``inherit`` columns
    of their issue: all of them with op, bytes and sector, for traces whose completions lack those.
    """
    out = pair(rows, list(key), F.col("event") == "insert", F.col("event") == "issue", list(order), ["comm", "mntns_id"], "insert")
    out = out.withColumn("comm", F.coalesce("insert_comm", "comm")).withColumn("mntns_id", F.coalesce("insert_mntns_id", "mntns_id"))
    out = pair(out, list(key), F.col("event") == "issue", F.col("event") == "complete", list(order), list(inherit), "issue")
    out = out.withColumns({c: F.coalesce(f"issue_{c}", c) for c in inherit})
    out = out.withColumn("queue_ns", F.col("timestamp_ns") - F.col("insert_ns")).withColumn("driver_ns", F.col("timestamp_ns") - F.col("issue_ns"))
    return out.select(*[F.col(c) for c in rows.columns], "queue_ns", "driver_ns")


def request_latencies(rows: DataFrame, start: str, end: str, key: list[str] = ("rq",), order: list[str] = ("timestamp_ns",), inherit: list[str] = ()) -> DataFrame:
    """``rows`` with ``pair_ns`` on ends: nvme setup and complete by request, or fs enter and exit by thread.

    Matched ends take the ``inherit`` columns of their start.
    """
    out = pair(rows, list(key), F.col("event") == start, F.col("event") == end, list(order), list(inherit))
    out = out.withColumn("pair_ns", F.col("timestamp_ns") - F.col("start_ns"))
    own = [F.when(F.col("pair_ns").isNotNull(), F.col(f"start_{c}")).otherwise(F.col(c)).alias(c) if c in inherit else F.col(c) for c in rows.columns]
    return out.select(*own, "pair_ns")


def untracked(paired: DataFrame, end: str, by: list[str]) -> DataFrame:
    """``(*by, ends, untracked)``: ends of each kind, and those whose start the trace does not have."""
    ends = paired.where(F.col("event") == end)
    return ends.groupBy(*by).agg(F.count("*").alias("ends"), F.count_if(F.col("pair_ns").isNull()).alias("untracked"))


def unmatched(paired: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, direct_dispatch, untracked_complete)``: issues without an insert, completions without an issue."""
    return paired.groupBy(*by).agg(
        F.count_if((F.col("event") == "issue") & F.col("queue_ns").isNull()).alias("direct_dispatch"),
        F.count_if((F.col("event") == "complete") & F.col("driver_ns").isNull()).alias("untracked_complete"),
    )


def matched_delta(paired: DataFrame, start: str, end: str, value: str) -> Column:
    """+1 for a start, -1 for a matched end, else 0."""
    return F.when(F.col("event") == start, 1).when((F.col("event") == end) & F.col(value).isNotNull(), -1).otherwise(0)


def in_flight(rows: DataFrame, by: list[str], delta: Column, order: list[str], slice_ns: int = scans.SLICE_NS) -> DataFrame:
    """``rows`` with ``in_flight``: the running sum of ``delta`` within ``by``, over time slices; ``order`` begins with timestamp_ns."""
    out = scans.running_sums(rows, list(by), scans.time_slice(slice_ns), list(order), {"in_flight": delta})
    return out.withColumn("in_flight", F.col("in_flight").cast("bigint"))


def in_flight_by_second(rows: DataFrame, by: list[str], delta: Column, start_ns: Column, width_ns: int = fn.SECOND_NS) -> DataFrame:
    """``(*by, sec, net, in_flight)`` at the end of each bucket with events.

    Sums buckets before it orders them, so a busy process is no long window.
    """
    sums = rows.select(*by, fn.time_bucket(F.col("timestamp_ns"), start_ns, width_ns).alias("sec"), delta.alias("d"))
    sums = sums.groupBy(*by, "sec").agg(F.sum("d").alias("net"))
    return sums.withColumn("in_flight", F.sum("net").over(W.partitionBy(*by).orderBy("sec").rowsBetween(W.unboundedPreceding, 0)))
