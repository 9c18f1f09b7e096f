"""Every registered query over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrace.functions import scalars as fn
from iotrace.operators import access, counters, distributions, filters, histograms, labels, lba, lifecycle, quality, reports, series, sysstat
from iotrace.plans import adapters as a
from iotrace.plans.adapters import BLOCK, EV, FS, HOUR, LABELS, NVME, SAMPLES, labelled, with_ctes
from iotrace.sources import dimensions, sinks, text, traces
from iotrace.storage import narrowed, shared_path
from iotrace.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ORDER = ["timestamp_ns", "seq"]


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def label(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return labels.resolve(rows, *a.label_dimensions(spark, sf_dir))


def stats_sql(source: str, by: str, value: str = "value", places: int = 2) -> str:
    """SQL select list and grouping of distribution statistics."""
    q = ", ".join(f"round(quantile_cont({value}, {p}), {places}) AS {n}" for n, p in distributions.PERCENTILES.items())
    return (
        f"SELECT {by}, count({value}) AS count, round(CAST(min({value}) AS DOUBLE), {places}) AS min, round(CAST(max({value}) AS DOUBLE), {places}) AS max, "
        f"round(avg({value}), {places}) AS mean, {q} FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}"
    )


BLOCK_L = with_ctes(EV, BLOCK, LABELS, labelled("block"))
FS_L = with_ctes(EV, FS, LABELS, labelled("fs"))
NVME_L = with_ctes(EV, NVME, LABELS, labelled("nvme"))


def block_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(spark, sf_dir, a.block(spark, sf_dir))


def fs_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(spark, sf_dir, a.fs(spark, sf_dir))


def nvme_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(spark, sf_dir, a.nvme(spark, sf_dir))


# -- counters


@query(BLOCK_L + "SELECT label, event, op, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total_bytes, min(timestamp_ns) AS ts_min, max(timestamp_ns) AS ts_max FROM block_l GROUP BY label, event, op")
def io_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.base(block_l(spark, sf_dir), ["label"]).drop("positive_bytes")


@query(with_ctes(EV, BLOCK) + "SELECT event, count(*) AS n FROM block GROUP BY event")
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.event_totals(counters.base(a.block(spark, sf_dir), ["comm", "mntns_id"]))


@query(
    with_ctes(EV, BLOCK, NVME, FS).rstrip()
    + """, m AS (
  SELECT 'block' AS layer, CASE event WHEN 'complete' THEN 'rq_completed' WHEN 'issue' THEN 'rq_issued' ELSE 'rq_queued' END AS metric, op, 1 AS v FROM block
  UNION ALL SELECT 'block', 'rq_total_bytes', op, bytes FROM block WHERE event = 'complete'
  UNION ALL SELECT 'nvme', CASE event WHEN 'complete' THEN 'cmd_completed' ELSE 'cmd_setup' END, op, 1 FROM nvme
  UNION ALL SELECT 'nvme', 'cmd_total_bytes', op, bytes FROM nvme WHERE event = 'complete'
  UNION ALL SELECT 'fs', CASE WHEN syscall NOT IN ('read', 'write') THEN 'sc_count' WHEN event = 'exit' THEN 'sc_completed' ELSE 'sc_entered' END, syscall, 1
    FROM fs WHERE syscall IN ('read', 'write') OR event = 'enter'
  UNION ALL SELECT 'fs', 'sc_total_bytes', syscall, coalesce(bytes, 0) FROM fs WHERE syscall IN ('read', 'write') AND event = 'exit')
SELECT layer, metric, op, CAST(sum(v) AS BIGINT) AS value FROM m GROUP BY layer, metric, op"""
)
def layer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for layer, op in (("block", "op"), ("nvme", "op"), ("fs", "syscall")):
        counts = counters.base(getattr(a, layer)(spark, sf_dir), [], op)
        out.append(counters.named(counts, [], layer).select(F.lit(layer).alias("layer"), "metric", "op", "value"))
    return reduce(DataFrame.unionByName, out)


@query(with_ctes(EV) + "SELECT min(timestamp_ns) AS ts_min, max(timestamp_ns) AS ts_max, (max(timestamp_ns) - min(timestamp_ns)) / 1e9 AS duration_s FROM ev")
def run_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.run_bounds(counters.base(a.block(spark, sf_dir), []))


@query(
    with_ctes(EV, BLOCK)
    + "SELECT op, round(count(*) FILTER (WHERE event = 'complete') / (SELECT (max(timestamp_ns) - min(timestamp_ns)) / 1e9 FROM block), 2) AS iops, "
    "round(sum(bytes) FILTER (WHERE event = 'complete') / (SELECT (max(timestamp_ns) - min(timestamp_ns)) / 1e9 FROM block) / 1048576, 2) AS mib_s FROM block GROUP BY op"
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counters.base(a.block(spark, sf_dir), [])
    values = counters.named(counts, [], "block")
    pick = lambda m: values.where(F.col("metric") == m).select("op", "value")
    return counters.throughput(pick("rq_completed"), pick("rq_total_bytes"), counters.run_bounds(counts), ["op"])


@query(
    with_ctes(EV, BLOCK)
    + "SELECT comm, op, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY comm), 2) AS pct FROM block WHERE event = 'complete' GROUP BY comm, op"
)
def op_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.op_share(counters.base(a.block(spark, sf_dir), ["comm"]).where("event = 'complete'"), ["comm"])


# -- distributions

LONG_BLOCK = """, v AS (
  SELECT label, 'driver_latencies' AS metric, op, latency_ns AS value FROM block_l WHERE event = 'complete'
  UNION ALL SELECT label, 'queue_latencies', op, latency_ns FROM block_l WHERE event = 'issue'
  UNION ALL SELECT label, 'rq_sizes', op, bytes FROM block_l WHERE event = 'complete') """


@query(BLOCK_L.rstrip() + LONG_BLOCK + stats_sql("v", "label, metric, op"))
def latency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.layer_distributions(block_l(spark, sf_dir), ["label"], "block")


@query(
    with_ctes(EV, FS).rstrip()
    + """, v AS (SELECT 'sc_latencies' AS metric, syscall AS op, latency_ns AS value FROM fs WHERE event = 'exit' AND latency_ns > 0
  UNION ALL SELECT 'sc_sizes', syscall, bytes FROM fs WHERE event = 'exit' AND bytes > 0) """
    + stats_sql("v", "metric, op")
)
def fs_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.layer_distributions(a.fs(spark, sf_dir), [], "fs")


@query(
    with_ctes(EV, NVME).rstrip()
    + """, v AS (SELECT disk_name, 'cmd_latencies' AS metric, op, latency_ns AS value FROM nvme WHERE event = 'complete'
  UNION ALL SELECT disk_name, 'cmd_sizes', op, bytes FROM nvme WHERE event = 'complete') """
    + stats_sql("v", "disk_name, metric, op")
)
def nvme_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.layer_distributions(a.nvme(spark, sf_dir), ["disk_name"], "nvme")


@query(stats_sql("lineitem", "l_returnflag, l_linestatus", "l_quantity"))
def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.stats(a.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


# -- series

BOUNDS = ", b AS (SELECT min(timestamp_ns) AS t0, max(timestamp_ns) AS t1 FROM ev)"
SEC = f"(timestamp_ns - t0) // {HOUR}"


def _buckets(rows: DataFrame, by: list[str], layer: str, op: str = "op") -> tuple[DataFrame, DataFrame]:
    bounds = counters.run_bounds(counters.base(rows, [], op))
    return series.per_bucket(series.with_bounds(rows, bounds.select("ts_min")), by, layer, ORDER, HOUR), bounds


INFLIGHT = f"""{BOUNDS}, p AS (SELECT label, op, {SEC} AS sec, arg_max(q_inflight, timestamp_ns) AS q FROM block_l, b GROUP BY label, op, sec) """


@query(BLOCK_L.rstrip() + INFLIGHT + "SELECT label, op, CAST(sec AS BIGINT) AS sec, CAST(greatest(q, 0) AS BIGINT) AS value FROM p")
def inflight_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets, _ = _buckets(block_l(spark, sf_dir), ["label"], "block")
    return series.gauge_points(buckets, ["label"], "q_inflight")


IOPS = f"""{BOUNDS}, c AS (SELECT comm, op, {SEC} AS sec, count(*) FILTER (WHERE event = 'complete') AS n FROM block, b GROUP BY comm, op, sec),
  g AS (SELECT comm, op, unnest(range(CAST(ceil((t1 - t0) / {HOUR}.0) AS BIGINT))) AS sec FROM (SELECT DISTINCT comm, op FROM c), b) """


@query(with_ctes(EV, BLOCK).rstrip() + IOPS + "SELECT g.comm, g.op, CAST(g.sec AS BIGINT) AS sec, CAST(coalesce(n, 0) AS BIGINT) AS value FROM g LEFT JOIN c USING (comm, op, sec)")
def iops_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets, bounds = _buckets(a.block(spark, sf_dir), ["comm"], "block")
    return series.filled(buckets, ["comm"], "completions", bounds, HOUR)


@query(
    with_ctes(EV, BLOCK).rstrip()
    + IOPS.rstrip()
    + ", f AS (SELECT g.comm, g.op, g.sec, coalesce(n, 0) AS value FROM g LEFT JOIN c USING (comm, op, sec)), s AS ("
    + stats_sql("f", "comm, op")
    + "), auc AS (SELECT comm, op, round(CASE WHEN count(*) > 1 THEN sum(value) - (arg_min(value, sec) + arg_max(value, sec)) / 2.0 ELSE sum(value) END, 2) AS area_under_curve FROM f GROUP BY comm, op) "
    "SELECT * FROM s JOIN auc USING (comm, op)"
)
def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets, bounds = _buckets(a.block(spark, sf_dir), ["comm"], "block")
    return series.series_stats(series.filled(buckets, ["comm"], "completions", bounds, HOUR), ["comm", "op"])


@query(
    with_ctes(EV, FS).rstrip()
    + f"""{BOUNDS}, c AS (SELECT comm, syscall AS op, {SEC} AS sec, sum(CASE WHEN event = 'exit' THEN coalesce(bytes, 0) ELSE 0 END) AS v
  FROM fs, b WHERE syscall IN ('read', 'write') GROUP BY comm, syscall, sec)
SELECT comm, op, CAST(sec AS BIGINT) AS sec, round(CAST(sum(v) OVER (PARTITION BY comm, op ORDER BY sec) AS BIGINT) / 1048576.0, 6) AS mb FROM c"""
)
def cumulative_mb(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets, _ = _buckets(a.fs(spark, sf_dir), ["comm"], "fs", "syscall")
    return series.cumulative_mb(buckets, ["comm"])


# -- access patterns

PATTERN = (
    "count(*) AS total_ios, count(*) FILTER (WHERE gap = 0) AS sequential_count, count(*) FILTER (WHERE gap > 0) AS random_count, "
    "coalesce(round(100.0 * count(*) FILTER (WHERE gap = 0) / nullif(count(gap), 0), 2), 0) AS sequential_pct, "
    "coalesce(round(100.0 * count(*) FILTER (WHERE gap > 0) / nullif(count(gap), 0), 2), 0) AS random_pct"
)
SECTOR_GAPS = (
    ", g AS (SELECT comm, mntns_id, op, abs(sector - lag(sector + bytes // 512) OVER (PARTITION BY comm, mntns_id, op ORDER BY timestamp_ns, seq)) AS gap FROM block WHERE event = 'issue') "
)
SECTOR_SQL = with_ctes(EV, BLOCK).rstrip() + SECTOR_GAPS + f"SELECT comm, mntns_id, op, {PATTERN} FROM g GROUP BY comm, mntns_id, op"


@query(SECTOR_SQL)
def access_pattern_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.by_sector(a.block(spark, sf_dir), ["comm", "mntns_id"], "issue", ORDER)


@query(SECTOR_SQL)
def access_pattern_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pattern from windows over time slices, for identities too large for one task."""
    return access.by_sector(a.block(spark, sf_dir), ["comm", "mntns_id"], "issue", ORDER, slice_ns=24 * HOUR)


@query(
    with_ctes(EV, FS).rstrip()
    + """, g AS (SELECT comm, 'p' || syscall || '64' AS syscall, abs("offset" - lag("offset" + coalesce(bytes, 0)) OVER (PARTITION BY comm, syscall, fd ORDER BY timestamp_ns, seq)) AS gap
  FROM fs WHERE event = 'enter' AND syscall IN ('read', 'write')) """
    + f"SELECT comm, syscall, {PATTERN} FROM g GROUP BY comm, syscall HAVING count(gap) > 0"
)
def access_pattern_fd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.fs(spark, sf_dir).where("syscall in ('read', 'write')").withColumn("syscall", F.concat(F.lit("p"), "syscall", F.lit("64")))
    return access.by_offset(rows, ["comm"], order=ORDER)


POSITIONS = """, e AS (SELECT *, CASE WHEN event = 'exit' AND syscall = 'openat' THEN bytes ELSE fd END AS kfd FROM fs),
  c AS (SELECT *, count(*) FILTER (WHERE (event = 'exit' AND syscall IN ('openat', 'lseek') AND bytes >= 0) OR (event = 'enter' AND syscall = 'close'))
      OVER (PARTITION BY comm, mntns_id, tid, kfd ORDER BY timestamp_ns, seq) AS part FROM e WHERE kfd IS NOT NULL),
  d AS (SELECT *, max(CASE WHEN event = 'exit' AND syscall = 'openat' THEN 0 WHEN event = 'exit' AND syscall = 'lseek' THEN bytes END) OVER (PARTITION BY comm, mntns_id, tid, kfd, part) AS base,
      sum(CASE WHEN event = 'exit' AND syscall IN ('read', 'write') AND bytes > 0 THEN bytes ELSE 0 END) OVER (PARTITION BY comm, mntns_id, tid, kfd, part ORDER BY timestamp_ns, seq) AS moved FROM c),
  p AS (SELECT comm, mntns_id, syscall, fd, timestamp_ns, seq, bytes, base + moved AS position FROM d
      WHERE event = 'enter' AND syscall IN ('read', 'write') AND part > 0 AND base IS NOT NULL),
  g AS (SELECT comm, mntns_id, syscall, abs(position - lag(position + coalesce(bytes, 0)) OVER (PARTITION BY comm, mntns_id, syscall, fd ORDER BY timestamp_ns, seq)) AS gap FROM p) """


@query(with_ctes(EV, FS).rstrip() + POSITIONS + f"SELECT comm, mntns_id, syscall, {PATTERN} FROM g GROUP BY comm, mntns_id, syscall HAVING count(gap) > 0")
def file_position_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.by_position(a.fs(spark, sf_dir), ["comm", "mntns_id"], ORDER)


def cdf_sql(source: str, by: str) -> str:
    return (
        f"SELECT {by}, value, round((max(rn)) / CAST(max(total) AS DOUBLE), 6) AS cdf FROM (SELECT {by}, value, row_number() OVER (PARTITION BY {by} ORDER BY value) AS rn, "
        f"count(*) OVER (PARTITION BY {by}) AS total FROM {source} WHERE value IS NOT NULL) GROUP BY {by}, value"
    )


@query(with_ctes(EV, BLOCK).rstrip() + SECTOR_GAPS.rstrip() + ", h AS (SELECT op, gap AS value FROM g) " + cdf_sql("h", "op"))
def gap_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = reports.gap_points(a.block(spark, sf_dir), ["comm", "mntns_id"], "block", ORDER)
    return series.cdf(points, ["op"], "gap", 1 << 62)


@query(with_ctes(EV, BLOCK).rstrip() + ", h AS (SELECT comm, op, bytes AS value FROM block WHERE event = 'complete' AND bytes > 0) " + cdf_sql("h", "comm, op"))
def size_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.cdf(a.block(spark, sf_dir).where("event = 'complete' and bytes > 0"), ["comm", "op"], "bytes", 1 << 62)


@query(
    with_ctes(EV, BLOCK).rstrip()
    + """, r AS (SELECT op, latency_ns / 1000 AS v, row_number() OVER (PARTITION BY op ORDER BY latency_ns) - 1 AS i, count(*) OVER (PARTITION BY op) AS n
    FROM block WHERE event = 'complete' AND latency_ns > 0),
  w AS (SELECT op, n, least(n, 10000) AS points, CASE WHEN n = 1 THEN 1 ELSE least(n, 10000) END AS k FROM r GROUP BY op, n),
  x AS (SELECT op, n, points, unnest(range(points)) AS j FROM w),
  c AS (SELECT op, n, CASE WHEN points = 1 THEN 0 ELSE (j * (n - 1)) // (points - 1) END AS i FROM x)
SELECT r.op, r.v AS value, round((max(r.i) + 1) / CAST(max(r.n) AS DOUBLE), 6) AS cdf FROM r JOIN c ON r.op = c.op AND r.i = c.i GROUP BY r.op, r.v"""
)
def latency_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies in microseconds at up to 10,000 ranks."""
    rows = a.block(spark, sf_dir).where("event = 'complete' and latency_ns > 0").withColumn("us", F.col("latency_ns") / 1000)
    return series.cdf(rows, ["op"], "us", 10_000)


# -- lifecycle


def pair_sql(name: str, source: str, key: str, start: str, end: str, carry: tuple[str, ...] = ()) -> str:
    """CTEs ``<name>``: end rows with the row of the start they use, by row numbers within the key."""
    marks = "".join(f", arg_max({c}, n) FILTER (WHERE event = '{start}') OVER w AS start_{c}" for c in carry)
    return (
        f"{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY timestamp_ns, seq) AS n FROM {source}), "
        f"{name} AS (SELECT *, max(n) FILTER (WHERE event = '{start}') OVER w AS s, max(n) FILTER (WHERE event = '{end}') OVER w AS e, "
        f"max(timestamp_ns) FILTER (WHERE event = '{start}') OVER w AS start_ns{marks} FROM {name}_n "
        f"WINDOW w AS (PARTITION BY {key} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    )


MATCHED = "s IS NOT NULL AND s > coalesce(e, 0)"
PAIRED = (
    with_ctes(EV, BLOCK, pair_sql("q", "block", "rq", "insert", "issue", ("comm",))).rstrip()
    + f""", q2 AS (SELECT seq, timestamp_ns, event, op, rq, CASE WHEN event = 'issue' AND {MATCHED} THEN start_comm ELSE comm END AS comm,
    CASE WHEN event = 'issue' AND {MATCHED} THEN timestamp_ns - start_ns END AS queue_ns FROM q), """
    + pair_sql("d", "q2", "rq", "issue", "complete", ("comm",))
    + f""", paired AS (SELECT seq, event, op, CASE WHEN event = 'complete' AND {MATCHED} THEN start_comm ELSE comm END AS comm, queue_ns,
    CASE WHEN event = 'complete' AND {MATCHED} THEN timestamp_ns - start_ns END AS driver_ns, timestamp_ns FROM d) """
)


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.block_latencies(a.block(spark, sf_dir), ["rq"], ORDER)


@query(PAIRED + "SELECT seq, event, op, comm, queue_ns, driver_ns FROM paired WHERE queue_ns IS NOT NULL OR driver_ns IS NOT NULL")
def pair_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).where("queue_ns is not null or driver_ns is not null").select("seq", "event", "op", "comm", "queue_ns", "driver_ns")


@query(
    PAIRED
    + "SELECT op, count(*) FILTER (WHERE event = 'issue' AND queue_ns IS NULL) AS direct_dispatch, count(*) FILTER (WHERE event = 'complete' AND driver_ns IS NULL) AS untracked_complete "
    "FROM paired GROUP BY op"
)
def unmatched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.unmatched(_paired(spark, sf_dir), ["op"])


DELTA = "CASE WHEN event = 'issue' THEN 1 WHEN event = 'complete' AND driver_ns IS NOT NULL THEN -1 ELSE 0 END"


@query(PAIRED + f"SELECT seq, op, comm, CAST(sum({DELTA}) OVER (PARTITION BY op, comm ORDER BY timestamp_ns, seq) AS BIGINT) AS in_flight FROM paired")
def inflight_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paired(spark, sf_dir)
    return lifecycle.in_flight(rows, ["op", "comm"], lifecycle.matched_delta(rows, "issue", "complete", "driver_ns"), ORDER).select("seq", "op", "comm", "in_flight")


@query(
    PAIRED.rstrip()
    + f"""{BOUNDS}, n AS (SELECT op, comm, {SEC} AS sec, sum({DELTA}) AS net FROM paired, b GROUP BY op, comm, sec)
SELECT op, comm, CAST(sec AS BIGINT) AS sec, CAST(net AS BIGINT) AS net, CAST(sum(net) OVER (PARTITION BY op, comm ORDER BY sec) AS BIGINT) AS in_flight FROM n"""
)
def inflight_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paired(spark, sf_dir)
    start = a.ev(spark, sf_dir).agg(F.min("timestamp_ns").alias("t0"))
    delta = lifecycle.matched_delta(rows, "issue", "complete", "driver_ns")
    return lifecycle.in_flight_by_second(rows.join(F.broadcast(start)), ["op", "comm"], delta, F.col("t0"), HOUR)


@query(with_ctes(EV, FS, pair_sql("p", "fs", "tid", "enter", "exit")) + f"SELECT seq, tid, syscall, timestamp_ns - start_ns AS pair_ns FROM p WHERE event = 'exit' AND {MATCHED}")
def syscall_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.request_latencies(a.fs(spark, sf_dir), "enter", "exit", ["tid"], ORDER)
    return rows.where("pair_ns is not null").select("seq", "tid", "syscall", "pair_ns")


@query(
    with_ctes(EV, NVME, pair_sql("p", "nvme", "rq", "setup", "complete"))
    + f"SELECT disk_name, op, count(*) FILTER (WHERE {MATCHED}) AS paired, count(*) FILTER (WHERE NOT coalesce({MATCHED}, false)) AS untracked, "
    f"CAST(sum(timestamp_ns - start_ns) FILTER (WHERE {MATCHED}) AS BIGINT) AS total_ns FROM p WHERE event = 'complete' GROUP BY disk_name, op"
)
def nvme_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.request_latencies(a.nvme(spark, sf_dir), "setup", "complete", ["rq"], ORDER).where("event = 'complete'")
    totals = rows.groupBy("disk_name", "op").agg(
        F.count("pair_ns").alias("paired"), F.count_if(F.col("pair_ns").isNull()).alias("untracked"), fn.wide_sum("pair_ns").alias("total_ns")
    )
    return narrowed(totals, ["total_ns"])


@query(
    """WITH x AS (SELECT o_orderkey AS key, epoch_us(o_orderdate) AS timestamp_ns, 'issue' AS event, 0 AS seq FROM (SELECT DISTINCT o_orderkey, o_orderdate FROM orders)
  UNION ALL SELECT l_orderkey, epoch_us(l_shipdate), 'complete', 1 FROM (SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem)), """
    + pair_sql("p", "x", "key", "issue", "complete")
    + f" SELECT count(*) AS completions, count(*) FILTER (WHERE {MATCHED}) AS paired, CAST(sum(timestamp_ns - start_ns) FILTER (WHERE {MATCHED}) AS BIGINT) AS total_ns FROM p WHERE event = 'complete'"
)
def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as starts and shipments as ends: many ends come before their start."""
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})").alias("timestamp_ns")
    starts = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), micros("o_orderdate")).distinct().withColumn("event", F.lit("issue")).withColumn("seq", F.lit(0))
    ends = a.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), micros("l_shipdate")).distinct().withColumn("event", F.lit("complete")).withColumn("seq", F.lit(1))
    rows = lifecycle.request_latencies(starts.unionByName(ends), "issue", "complete", ["key"], ORDER).where("event = 'complete'")
    totals = rows.agg(F.count("*").alias("completions"), F.count("pair_ns").alias("paired"), fn.wide_sum("pair_ns").alias("total_ns"))
    return narrowed(totals, ["total_ns"])


# -- address space

SPAN = "greatest(hi - lo, 1)"


def bin_sql(bins: int) -> str:
    return f"CAST(greatest(0, least({bins - 1}, ((sector - lo) * {bins}) // {SPAN})) AS INTEGER)"


EXTENT = ", x AS (SELECT min(sector) AS lo, max(sector + bytes // 512) AS hi FROM nvme WHERE event = 'setup') "
LOCAL = ", y AS (SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS i, count(*) OVER () AS n FROM nvme WHERE event = 'setup'), x AS (SELECT max(sector) FILTER (WHERE i = floor(0.01 * (n - 1) + 0.5)) AS lo, max(sector) FILTER (WHERE i = floor(0.99 * (n - 1) + 0.5)) AS hi FROM y) "


def _setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.nvme(spark, sf_dir).where("event = 'setup'")


@query(
    with_ctes(EV, NVME).rstrip() + EXTENT
    + f"SELECT op, {bin_sql(512)} AS lba_bin, CAST(lo + floor({bin_sql(512)} * {SPAN} / 512.0) AS BIGINT) AS lba_start, count(*) AS n FROM nvme, x WHERE event = 'setup' GROUP BY op, lba_bin, lba_start"
)
def lba_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lba.distribution(_setups(spark, sf_dir), ["op"])


@query(with_ctes(EV, NVME).rstrip() + LOCAL + f"SELECT comm, op, {bin_sql(512)} AS lba_bin, count(*) AS n FROM nvme, x WHERE event = 'setup' GROUP BY comm, op, lba_bin")
def lba_density_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _setups(spark, sf_dir)
    return lba.distribution(rows, ["comm", "op"], bounds=lba.nearest_rank_bounds(rows)).drop("lba_start")


HEAT = (
    with_ctes(EV, NVME).rstrip() + BOUNDS + LOCAL.rstrip()
    + f", h AS (SELECT comm, op, CAST(((timestamp_ns - t0) * 256::HUGEINT) // (t1 - t0 + 1) AS INTEGER) AS time_bin, {bin_sql(256)} AS lba_bin, count(*) AS n FROM nvme, x, b WHERE event = 'setup' GROUP BY ALL) "
)


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.nvme(spark, sf_dir)
    setups = rows.where("event = 'setup'")
    times = rows.agg(F.min("timestamp_ns").alias("ts_min"), F.max("timestamp_ns").alias("ts_max"))
    return lba.heatmap(setups, ["comm", "op"], lba.nearest_rank_bounds(setups), times)


@query(HEAT + "SELECT comm, op, time_bin, lba_bin, n, round(ln(1 + n), 6) AS log1p FROM h")
def lba_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heat(spark, sf_dir)


@query(HEAT + "SELECT op, max(round(ln(1 + n), 6)) AS max_log1p FROM h GROUP BY op")
def heatmap_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lba.heat_maximum(_heat(spark, sf_dir))


@query(with_ctes(EV, NVME) + "SELECT disk_name, count(*) AS n FROM nvme GROUP BY disk_name ORDER BY n DESC, disk_name LIMIT 1")
def busiest_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lba.busiest_device(a.nvme(spark, sf_dir))


# -- histograms

LOG2 = "CASE WHEN v > 0 THEN CAST(pow(2, length(ltrim(bin(v), '0')) - 1) AS BIGINT) ELSE 0 END"


@query(
    f"""WITH s AS (SELECT l_returnflag, CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem), h AS (SELECT l_returnflag, {LOG2} AS lo FROM s)
SELECT l_returnflag, lo, CASE WHEN lo > 0 THEN lo * 2 ELSE 1 END AS hi, count(*) AS count FROM h GROUP BY l_returnflag, lo"""
)
def log2_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "lineitem").select("l_returnflag", F.floor("l_extendedprice").cast("bigint").alias("value"))
    return histograms.log2(rows, ["l_returnflag"])


POINTS = f"""WITH s AS (SELECT l_linestatus, CAST(l_quantity AS BIGINT) - 1 AS v FROM lineitem), t AS (SELECT l_linestatus, v, {LOG2} AS lo FROM s),
  h AS (SELECT l_linestatus, CASE WHEN v > 0 AND v = lo THEN 'point' ELSE 'range' END AS kind, lo,
    CASE WHEN v > 0 AND v = lo THEN lo WHEN lo > 0 THEN lo * 2 ELSE 1 END AS hi, count(*) AS count FROM t GROUP BY ALL) """


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_quantity").cast("bigint") - 1).alias("value"))
    return histograms.points_and_ranges(rows, ["l_linestatus"])


@query(POINTS + "SELECT * FROM h")
def point_range_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir)


def _hist_pct(p: float, name: str) -> str:
    part = f"({p} * total - (upto - count)) / count"
    value = f"CASE WHEN kind = 'point' THEN lo WHEN lo > 0 THEN lo * pow(hi * 1.0 / lo, {part}) ELSE hi * {part} END"
    return f"round(arg_min({value}, upto) FILTER (WHERE upto >= {p} * total), 2) AS {name}"


@query(
    POINTS.rstrip()
    + """, r AS (SELECT *, CAST(sum(count) OVER (PARTITION BY l_linestatus ORDER BY lo, kind) AS BIGINT) AS upto, CAST(sum(count) OVER (PARTITION BY l_linestatus) AS BIGINT) AS total FROM h)
SELECT l_linestatus, CAST(sum(count) AS BIGINT) AS count, CAST(min(lo) AS DOUBLE) AS min, CAST(max(hi) AS DOUBLE) AS max,
  round(sum(count * CASE WHEN kind = 'point' THEN lo WHEN lo > 0 THEN sqrt(lo * hi) ELSE hi / 2.0 END) / sum(count), 2) AS mean, """
    + ", ".join(_hist_pct(p, n) for n, p in distributions.PERCENTILES.items())
    + " FROM r GROUP BY l_linestatus"
)
def histogram_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.stats(_points(spark, sf_dir), ["l_linestatus"])


# -- filters and decoding


@query(
    with_ctes(EV, NVME)
    + """SELECT seq, comm LIKE '%1%' OR comm LIKE '%c2%' AS comm_contains, contains('c1-worker', comm) AS comm_contained_in, contains(disk_name, 'nvme1') AS device,
  mntns_id IN (1, 2) AS container, comm LIKE '%1%' OR mntns_id IN (1, 2) AS either, comm LIKE '%1%' AND mntns_id IN (1, 2) AS both,
  (comm LIKE '%1%' AND contains(disk_name, 'nvme1')) OR mntns_id IN (1, 2) AS device_or_container FROM nvme WHERE event = 'setup'"""
)
def filter_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.nvme(spark, sf_dir).where(filters.event_is("setup")).select(
        "seq", filters.comm_matches(["1", "c2"]).alias("comm_contains"), filters.comm_matches(["c1-worker"], "contained_in").alias("comm_contained_in"),
        filters.device_matches(["nvme1"]).alias("device"), filters.container_matches([1, 2]).alias("container"),
        filters.should_trace(["1"], [1, 2]).alias("either"), filters.should_trace(["1"], [1, 2], either=False).alias("both"),
        filters.should_trace_device(["1"], [1, 2], ["nvme1"]).alias("device_or_container"),
    )


@query(
    with_ctes(EV)
    + """SELECT seq, CASE event_type WHEN 'view' THEN 'insert' WHEN 'click' THEN 'issue' WHEN 'purchase' THEN 'complete' ELSE 'unknown' END AS event,
  CASE k % 16 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'flush' WHEN 3 THEN 'discard' WHEN 9 THEN 'write_zeros' ELSE 'unknown' END AS op,
  512 * k AS bytes, nullif(CAST(floor(value) AS BIGINT), 0) AS latency_ns, '0x' || lower(to_hex(user_id)) AS rq FROM ev"""
)
def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.ev(spark, sf_dir)
    code = F.expr("case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 7 end")
    raw = rows.select(
        "seq", "timestamp_ns", "mntns_id", code.alias("event"), ((F.col("k") % 16) + 256 * F.col("k")).alias("cmd_flags"), (512 * F.col("k")).alias("bytes"),
        F.floor("value").cast("bigint").alias("latency_ns"), F.col("k").alias("sector"), F.col("user_id").alias("rq"), "comm",
        F.lit(0).alias("q_inflight"), F.lit(0).alias("d_inflight"),
    )
    out = traces.normalize_events(raw.withColumn("comm", F.col("seq").cast("string")), "block")
    return out.select(F.col("comm").cast("bigint").alias("seq"), "event", "op", "bytes", "latency_ns", "rq")


# -- labels


@query(BLOCK_L + "SELECT label, CASE WHEN label IN (SELECT n_name FROM nation) THEN 'per_container' ELSE 'per_comm' END AS label_kind, count(*) AS n, count(DISTINCT comm) AS comms FROM block_l GROUP BY label")
def label_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_mntns, by_comm = a.label_dimensions(spark, sf_dir)
    rows = labels.resolve(a.block(spark, sf_dir), by_mntns, by_comm)
    names = by_mntns.select(F.col("mntns_label").alias("label")).unionByName(by_comm.select(F.col("comm_label").alias("label")))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("comm").alias("comms"))
    return labels.split_by_kind(counts, names)


@query(BLOCK_L.rstrip() + ", v AS (SELECT label, op, latency_ns AS value FROM block_l WHERE event = 'complete') " + stats_sql("v", "label, op"))
def label_merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of a label from its raw rows."""
    rows = block_l(spark, sf_dir).where("event = 'complete'").select("label", "op", F.col("latency_ns").alias("value"))
    return distributions.stats(rows, ["label", "op"])


@query(
    BLOCK_L.rstrip()
    + """, t AS (SELECT label, comm, mntns_id, count(*) + sum(CASE WHEN event = 'complete' THEN bytes ELSE 0 END) AS total FROM block_l GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, comm, mntns_id) AS rank FROM t),
  v AS (SELECT label, comm, mntns_id, op, latency_ns AS value FROM block_l WHERE event = 'complete'), s AS ("""
    + stats_sql("v", "label, comm, mntns_id, op")
    + """) SELECT s.label, op, CAST(sum(count) AS BIGINT) AS count, min(min) AS min, max(max) AS max, round(sum(mean * count) / sum(count), 2) AS mean,
  arg_min(p1, rank) AS p1, arg_min(p5, rank) AS p5, arg_min(p50, rank) AS p50, arg_min(p95, rank) AS p95, arg_min(p99, rank) AS p99
FROM s JOIN k USING (label, comm, mntns_id) GROUP BY s.label, op"""
)
def label_merge_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged by label with the percentiles of the label's largest identity."""
    rows = block_l(spark, sf_dir)
    identity = ["label", "comm", "mntns_id"]
    values = counters.named(counters.base(rows, identity), identity, "block")
    ranks = labels.rank_identities(values)
    done = rows.where("event = 'complete'").select(*identity, "op", F.col("latency_ns").alias("value"))
    stats = distributions.stats(done, [*identity, "op"]).join(ranks.select(*identity, "rank"), identity)
    return distributions.merge_dominant(stats, ["label", "op"])


@query(
    BLOCK_L.rstrip()
    + """, t AS (SELECT label, comm, mntns_id, count(*) + sum(CASE WHEN event = 'complete' THEN bytes ELSE 0 END) AS total FROM block_l GROUP BY ALL)
SELECT label, comm, mntns_id, CAST(total AS BIGINT) AS total, row_number() OVER (PARTITION BY label ORDER BY total DESC, comm, mntns_id) AS rank FROM t"""
)
def identity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = ["label", "comm", "mntns_id"]
    values = counters.named(counters.base(block_l(spark, sf_dir), identity), identity, "block")
    return labels.rank_identities(values)


# -- resource samples


def _section_sql(section: str, source: str = "sam", by: str = "command") -> str:
    pairs = " UNION ALL ".join(
        f"SELECT {by}, '{m}' AS metric, \"time\", CAST(round(sum(CAST({m} AS DECIMAL(28, 6))), 2) AS DOUBLE) AS value FROM {source} GROUP BY {by}, \"time\"" for m in sysstat.METRICS[section]
    )
    return (
        f", f AS ({pairs}), s AS ({stats_sql('f', f'{by}, metric', places=6)}), auc AS (SELECT {by}, metric, "
        'round(CASE WHEN count(*) > 1 THEN sum(value) - (arg_min(value, "time") + arg_max(value, "time")) / 2 ELSE sum(value) END, 4) AS area_under_curve '
        f"FROM f GROUP BY {by}, metric) SELECT * FROM s JOIN auc USING ({by}, metric)"
    )


SAM = with_ctes(EV, SAMPLES).rstrip()


@query(SAM + _section_sql("cpu"))
def sysstat_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sysstat.section_stats(a.samples(spark, sf_dir), "cpu", places=6)


@query(SAM + _section_sql("mem"))
def sysstat_mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sysstat.section_stats(a.samples(spark, sf_dir), "mem", places=6)


@query(
    SAM
    + ", later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tgid ORDER BY timestamp_ns, seq) AS nth FROM sam) WHERE nth > 1)"
    + _section_sql("dev", "later")
)
def sysstat_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sysstat.section_stats(sysstat.drop_first(a.samples(spark, sf_dir), ORDER), "dev", places=6)


@query(
    SAM
    + """, f AS (SELECT command, cpu, "time", CAST(round(sum(CAST(cpu_pct AS DECIMAL(28, 6))), 2) AS DOUBLE) AS value FROM sam GROUP BY ALL)
SELECT command, cpu, round(CASE WHEN count(*) > 1 THEN sum(value) - (arg_min(value, "time") + arg_max(value, "time")) / 2 ELSE sum(value) END, 4) AS area_under_curve FROM f GROUP BY command, cpu"""
)
def sysstat_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sysstat.per_core_area(a.samples(spark, sf_dir), places=4)


SCORES = SAM + """, r AS (SELECT command, CAST(cpu_pct AS DECIMAL(28, 6)) AS v FROM sam UNION ALL SELECT command, CAST((kb_rd_s + kb_wr_s) / 1024 AS DECIMAL(28, 6)) FROM sam),
  sc AS (SELECT command, round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS score FROM r GROUP BY command)"""


@query(SCORES + " SELECT command, score, CASE WHEN row_number() OVER (ORDER BY score DESC, command) <= 4 THEN command ELSE 'other' END AS shown FROM sc")
def top_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.samples(spark, sf_dir)
    return sysstat.top_commands(rows, sysstat.scores(rows, rows))


@query(
    SCORES
    + """, n AS (SELECT command, CASE WHEN row_number() OVER (ORDER BY score DESC, command) <= 4 THEN command ELSE 'other' END AS shown FROM sc),
  m AS (SELECT shown AS command, 'cpu_' || cpu AS metric, "time", CAST(round(sum(CAST(cpu_pct AS DECIMAL(28, 6))), 2) AS DOUBLE) AS value FROM sam JOIN n USING (command) GROUP BY ALL
    UNION ALL SELECT shown, 'mem_pct', "time", CAST(round(sum(CAST(mem_pct AS DECIMAL(28, 6))), 2) AS DOUBLE) FROM sam JOIN n USING (command) GROUP BY ALL
    UNION ALL SELECT shown, 'kb_rd_s', "time", CAST(round(sum(CAST(kb_rd_s AS DECIMAL(28, 6))), 2) AS DOUBLE) FROM sam JOIN n USING (command) GROUP BY ALL
    UNION ALL SELECT shown, 'kb_wr_s', "time", CAST(round(sum(CAST(kb_wr_s AS DECIMAL(28, 6))), 2) AS DOUBLE) FROM sam JOIN n USING (command) GROUP BY ALL),
  g AS (SELECT * FROM (SELECT DISTINCT command, metric FROM m), (SELECT DISTINCT "time" FROM m))
SELECT command, metric, "time", coalesce(value, 0) AS value FROM g LEFT JOIN m USING (command, metric, "time")"""
)
def sysstat_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.samples(spark, sf_dir)
    return reports.sysstat_series(rows, rows, rows)


CLOCK = "(timestamp_ns // 1000000000 % 86400 // 3 + 82400) % 86400"


@query(
    with_ctes(EV).rstrip()
    + f""", t AS (SELECT DISTINCT strftime(to_timestamp({CLOCK}) AT TIME ZONE 'UTC', '%H:%M:%S') AS "time", {CLOCK} AS s FROM ev),
  l AS (SELECT *, lead(s) OVER (ORDER BY s) - s AS gap FROM t), e AS (SELECT arg_max(s, gap * 100000 + s) AS edge FROM l WHERE gap > 43200)
SELECT "time", CAST(CASE WHEN s <= edge THEN s + 86400 ELSE s END AS INTEGER) AS secs FROM l, e"""
)
def clock_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock times of all events in a run from 22:53 to 06:53, a third as fast as the events, in order across midnight."""
    of_day = F.pmod(fn.int_div(F.col("timestamp_ns"), fn.SECOND_NS), F.lit(86400))
    return sysstat.chronological(a.ev(spark, sf_dir).select(fn.clock(F.pmod(fn.int_div(of_day, 3) + 82400, F.lit(86400))).alias("time")))


# -- quality


@query(
    with_ctes(EV, BLOCK).rstrip()
    + """, c AS (SELECT event, count(*) AS generated, count(*) FILTER (WHERE seq % 50 = 0) AS dropped FROM block GROUP BY event),
  u AS (SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(generated) AS BIGINT), CAST(sum(dropped) AS BIGINT) FROM c)
SELECT event, generated, dropped, generated - dropped AS received, round(100.0 * dropped / generated, 4) AS drop_pct FROM u"""
)
def capture_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.block(spark, sf_dir).groupBy("event").agg(F.count("*").alias("generated"), F.count_if(F.col("seq") % 50 == 0).alias("dropped"))
    return quality.capture(rows)


JOBS = "comm AS job"
TRUTH = (
    ", truth AS (SELECT comm AS job, count(*) FILTER (WHERE op = 'read' AND seq % 40 > 0) AS read_ios, coalesce(sum(bytes) FILTER (WHERE op = 'read' AND seq % 40 > 0), 0) AS read_bytes, "
    "count(*) FILTER (WHERE op = 'write' AND seq % 60 > 0) AS write_ios, coalesce(sum(bytes) FILTER (WHERE op = 'write' AND seq % 60 > 0), 0) AS write_bytes FROM block WHERE event = 'complete' GROUP BY comm)"
)


@query(
    with_ctes(EV, BLOCK).rstrip()
    + TRUTH
    + """, v AS (SELECT comm AS job, op, count(*) FILTER (WHERE event = 'complete') AS done, coalesce(sum(bytes) FILTER (WHERE event = 'complete'), 0) AS size, count(*) FILTER (WHERE event = 'issue') AS began
    FROM block WHERE op IN ('read', 'write') GROUP BY comm, op),
  t AS (SELECT job, 'read' AS op, read_ios AS ios, read_bytes AS size FROM truth UNION ALL SELECT job, 'write', write_ios, write_bytes FROM truth),
  k AS (SELECT t.job, 'completed' AS "check", t.op, coalesce(v.done, 0) AS actual, t.ios AS expected FROM t LEFT JOIN v USING (job, op) WHERE t.ios > 0
    UNION ALL SELECT t.job, 'bytes', t.op, coalesce(v.size, 0), t.size FROM t LEFT JOIN v USING (job, op) WHERE t.ios > 0
    UNION ALL SELECT t.job, 'started', t.op, coalesce(v.began, 0), coalesce(v.done, 0) FROM t LEFT JOIN v USING (job, op) WHERE t.ios > 0)
SELECT job, "check", op, CAST(actual AS BIGINT) AS actual, CAST(expected AS BIGINT) AS expected,
  CASE WHEN expected = 0 THEN actual = 0 ELSE abs(actual - expected) / CAST(expected AS DOUBLE) <= 0.02 END AS passed FROM k"""
)
def tolerance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.block(spark, sf_dir).withColumnRenamed("comm", "job")
    values = counters.named(counters.base(rows, ["job"]), ["job"], "block")
    done = rows.where("event = 'complete'")
    n = lambda cond: F.count_if(cond)
    read, write = (F.col("op") == "read") & (F.col("seq") % 40 > 0), (F.col("op") == "write") & (F.col("seq") % 60 > 0)
    size = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("bytes"))), F.lit(0))
    truth = done.groupBy("job").agg(n(read).alias("read_ios"), size(read).alias("read_bytes"), n(write).alias("write_ios"), size(write).alias("write_bytes"))
    return quality.layer_checks(values, truth, "block")


@query(
    with_ctes(EV, BLOCK).rstrip()
    + SECTOR_GAPS.replace("SELECT comm, mntns_id, op, abs", "SELECT comm, op, abs").replace("PARTITION BY comm, mntns_id, op", "PARTITION BY comm, op").rstrip()
    + f", p AS (SELECT comm, op, {PATTERN} FROM g GROUP BY comm, op) "
    "SELECT comm AS job, op, 'random' AS expected, random_pct AS pct, random_pct >= 98 AS passed FROM p"
)
def pattern_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = access.by_sector(a.block(spark, sf_dir), ["comm"], "issue", ORDER).withColumnRenamed("comm", "job")
    return quality.pattern_checks(patterns)


def checks_sql(source: str, done: str, began: str) -> str:
    """SQL of a layer's checks from ``source(job, op, event, size, seq)`` with op read or write."""
    return f""", truth AS (SELECT job, op, count(*) AS ios, CAST(sum(size) AS BIGINT) AS size FROM {source} WHERE event = '{done}' AND seq % CASE op WHEN 'read' THEN 40 ELSE 60 END > 0 GROUP BY job, op),
  v AS (SELECT job, op, count(*) FILTER (WHERE event = '{done}') AS done, coalesce(sum(size) FILTER (WHERE event = '{done}'), 0) AS size, count(*) FILTER (WHERE event = '{began}') AS began FROM {source} GROUP BY job, op),
  k AS (SELECT t.job, 'completed' AS "check", t.op, v.done AS actual, t.ios AS expected FROM truth t JOIN v USING (job, op)
    UNION ALL SELECT t.job, 'bytes', t.op, v.size, t.size FROM truth t JOIN v USING (job, op) UNION ALL SELECT t.job, 'started', t.op, v.began, v.done FROM truth t JOIN v USING (job, op))
SELECT job, "check", op, CAST(actual AS BIGINT) AS actual, CAST(expected AS BIGINT) AS expected,
  CASE WHEN expected = 0 THEN actual = 0 ELSE abs(actual - expected) / CAST(expected AS DOUBLE) <= 0.02 END AS passed FROM k"""


def _truth(done: DataFrame) -> DataFrame:
    """An independent report that misses one completion in forty reads and one in sixty writes."""
    read, write = (F.col("op") == "read") & (F.col("seq") % 40 > 0), (F.col("op") == "write") & (F.col("seq") % 60 > 0)
    size = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0))
    return done.groupBy("job").agg(F.count_if(read).alias("read_ios"), size(read).alias("read_bytes"), F.count_if(write).alias("write_ios"), size(write).alias("write_bytes"))


@query(with_ctes(EV, NVME).rstrip() + ", c AS (SELECT comm AS job, op, event, bytes AS size, seq FROM nvme WHERE op IN ('read', 'write'))" + checks_sql("c", "complete", "setup"))
def nvme_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.nvme(spark, sf_dir).withColumnRenamed("comm", "job")
    values = counters.named(counters.base(rows, ["job"]), ["job"], "nvme")
    return quality.layer_checks(values, _truth(rows.where("event = 'complete'").withColumn("size", F.col("bytes"))), "nvme")


FS_JOBS = """, j AS (SELECT CASE WHEN tid % 2 = 0 THEN 'val_seq' ELSE 'val_rand' END || comm AS job, CASE WHEN tid % 3 = 0 THEN 'p' || syscall || '64' ELSE syscall END AS call, event, greatest(coalesce(bytes, 0), 0) AS size, seq
    FROM fs WHERE syscall IN ('read', 'write')),
  c AS (SELECT job, CASE WHEN call LIKE '%read%' THEN 'read' ELSE 'write' END AS op, event, size, seq FROM j WHERE (job LIKE 'val_seq%') = (call IN ('read', 'write')))"""


@query(with_ctes(EV, FS).rstrip() + FS_JOBS + checks_sql("c", "exit", "enter"))
def fs_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential jobs are checked by read and write, others by their forms with an offset."""
    rows = a.fs(spark, sf_dir).where("syscall in ('read', 'write')")
    job = F.concat(F.when(F.col("tid") % 2 == 0, "val_seq").otherwise("val_rand"), "comm")
    call = F.when(F.col("tid") % 3 == 0, F.concat(F.lit("p"), "syscall", F.lit("64"))).otherwise(F.col("syscall"))
    rows = rows.withColumn("job", job).withColumn("syscall", call)
    values = counters.named(counters.base(rows, ["job"], "syscall"), ["job"], "fs")
    plain = F.col("syscall").isin("read", "write") == F.col("job").startswith("val_seq")
    done = rows.where((F.col("event") == "exit") & plain).withColumn("op", F.when(F.col("syscall").contains("read"), "read").otherwise("write"))
    return quality.layer_checks(values, _truth(done.withColumn("size", F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0)))), "fs")


@query(
    with_ctes(EV, FS, NVME, pair_sql("f", "fs", "tid", "enter", "exit"), pair_sql("n", "nvme", "rq", "setup", "complete"))
    + f"SELECT 'fs' AS layer, syscall AS op, count(*) AS ends, count(*) FILTER (WHERE NOT coalesce({MATCHED}, false)) AS untracked FROM f WHERE event = 'exit' GROUP BY syscall "
    f"UNION ALL SELECT 'nvme', op, count(*), count(*) FILTER (WHERE NOT coalesce({MATCHED}, false)) FROM n WHERE event = 'complete' GROUP BY op"
)
def untracked_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = lifecycle.request_latencies(a.fs(spark, sf_dir), "enter", "exit", ["tid"], ORDER)
    commands = lifecycle.request_latencies(a.nvme(spark, sf_dir), "setup", "complete", ["rq"], ORDER)
    parts = [lifecycle.untracked(calls, "exit", ["syscall"]).select(F.lit("fs").alias("layer"), F.col("syscall").alias("op"), "ends", "untracked")]
    parts.append(lifecycle.untracked(commands, "complete", ["op"]).select(F.lit("nvme").alias("layer"), "op", "ends", "untracked"))
    return reduce(DataFrame.unionByName, parts)


@query(
    with_ctes(EV, NVME, pair_sql("p", "nvme", "rq", "setup", "complete", ("comm", "mntns_id", "op", "bytes", "sector", "disk_name")))
    + "SELECT seq, "
    + ", ".join(f"CASE WHEN {MATCHED} THEN start_{c} ELSE {c} END AS {c}" for c in ("comm", "mntns_id", "op", "bytes", "sector", "disk_name"))
    + " FROM p WHERE event = 'complete'"
)
def nvme_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions with all that their setup says of the command."""
    kept = ["comm", "mntns_id", "op", "bytes", "sector", "disk_name"]
    rows = lifecycle.request_latencies(a.nvme(spark, sf_dir), "setup", "complete", ["rq"], ORDER, inherit=kept)
    return rows.where("event = 'complete'").select("seq", *kept)


@query(
    SAM
    + """, r AS (SELECT s.*, coalesce(t.n_name, c.n_name, 'other') AS label, CASE WHEN command IN ('c1', 'c2', 'c4') THEN command ELSE 'other' END AS shown FROM sam s
    LEFT JOIN nation t ON t.n_nationkey BETWEEN 6 AND 14 AND s.tgid = CAST(t.n_nationkey AS VARCHAR) LEFT JOIN nation c ON c.n_nationkey IN (4, 5) AND s.command = 'c' || c.n_nationkey)
SELECT label, shown, count(*) AS n, count(DISTINCT tgid) AS tgids FROM r GROUP BY label, shown"""
)
def process_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples by label, of the process group, else of the command; and commands that are listed or ``other``."""
    nation, key = a.table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    by_tgid = nation.where("n_nationkey between 6 and 14").select(key.alias("tgid"), F.col("n_name").alias("tgid_label"))
    by_command = nation.where("n_nationkey in (4, 5)").select(F.concat(F.lit("c"), key).alias("command"), F.col("n_name").alias("command_label"))
    rows = labels.resolve_process(a.samples(spark, sf_dir), by_tgid, by_command).withColumn("shown", filters.listed_or_other("command", ["c1", "c2", "c4"]))
    return rows.groupBy("label", "shown").agg(F.count("*").alias("n"), F.count_distinct("tgid").alias("tgids"))


@query(
    BLOCK_L.rstrip()
    + f"""{BOUNDS}, t AS (SELECT label, comm, mntns_id, count(*) + sum(CASE WHEN event = 'complete' THEN bytes ELSE 0 END) AS total FROM block_l GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, comm, mntns_id) AS rank FROM t)
SELECT label, op, CAST({SEC} AS BIGINT) AS sec, count(*) FILTER (WHERE event = 'complete') AS completions FROM block_l JOIN k USING (label, comm, mntns_id), b WHERE rank = 1 GROUP BY label, op, {SEC}"""
)
def dominant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions an hour of each label's largest identity, which stand for the label where series do not add up."""
    rows, identity = block_l(spark, sf_dir), ["label", "comm", "mntns_id"]
    ranks = labels.rank_identities(counters.named(counters.base(rows, identity), identity, "block"))
    buckets, _ = _buckets(rows, identity, "block")
    return labels.dominant(buckets, ranks).select("label", "op", "sec", "completions")


AREAS = """, d AS (SELECT max("time") - min("time") AS duration_s FROM sam) """


def _area_sql(section: str) -> str:
    pairs = " UNION ALL ".join(f"SELECT command, '{m}' AS metric, \"time\", CAST(round(sum(CAST({m} AS DECIMAL(28, 6))), 2) AS DOUBLE) AS value FROM sam GROUP BY command, \"time\"" for m in sysstat.METRICS[section])
    shares = ", ".join(f"'{m}'" for m in sysstat.SHARES)
    return (
        f"SELECT '{section}' AS section, command, metric, round(CASE WHEN count(*) > 1 THEN sum(value) - (arg_min(value, \"time\") + arg_max(value, \"time\")) / 2 ELSE sum(value) END, 4) AS area_under_curve, "
        f"CASE WHEN metric IN ({shares}) THEN round(100.0 * (SELECT duration_s FROM d), 2) END AS max_area_under_curve FROM ({pairs}) GROUP BY command, metric"
    )


@query(SAM + AREAS + _area_sql("cpu") + " UNION ALL " + _area_sql("mem"))
def sysstat_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas under the curves, and of 100 % over the run for metrics that are shares."""
    rows = a.samples(spark, sf_dir)
    run = rows.agg((F.max("time") - F.min("time")).alias("duration_s"))
    parts = [sysstat.section_stats(rows, s, duration_s=run, places=4).select(F.lit(s).alias("section"), "command", "metric", "area_under_curve", "max_area_under_curve") for s in ("cpu", "mem")]
    return reduce(DataFrame.unionByName, parts)


@query(
    with_ctes(EV, BLOCK).rstrip()
    + """, m AS (SELECT CASE event WHEN 'complete' THEN 'rq_completed' WHEN 'issue' THEN 'rq_issued' ELSE 'rq_queued' END AS metric, op, 1 AS v FROM block
  UNION ALL SELECT 'rq_total_bytes', op, bytes FROM block WHERE event = 'complete') SELECT metric, op, CAST(sum(v) AS BIGINT) AS value FROM m GROUP BY metric, op"""
)
def results_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of every identity written as one nested JSON view, read back and added up over all of them."""
    rows = a.block(spark, sf_dir).withColumn("container", fn.identity(F.col("mntns_id")))
    keys, path = ["comm", "container", "metric", "op"], shared_path(spark, "results")
    sinks.write_json(counters.named(counters.base(rows, ["comm", "container"]), ["comm", "container"], "block"), keys, ["value"], path)
    return counters.merged(sinks.read_json(spark, path, keys, "value bigint"), [])


@query(
    with_ctes(EV, BLOCK).rstrip()
    + ", p AS (SELECT comm, op, timestamp_ns // 86400000000000 AS day, count(*) AS n, max(sector) AS top FROM block GROUP BY ALL) SELECT comm, op, arg_max(n, day) AS n, arg_max(top, day) AS top FROM p GROUP BY comm, op"
)
def last_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every day; of each key the last day's count."""
    day = fn.int_div(F.col("timestamp_ns"), 24 * HOUR).alias("day")
    daily = a.block(spark, sf_dir).groupBy("comm", "op", day).agg(F.count("*").alias("n"), F.max("sector").alias("top"))
    return counters.last_written(daily, ["comm", "op"], "day")


@query(with_ctes(EV, BLOCK) + "SELECT event, comm, count(*) AS n, count(*) FILTER (WHERE seq % 3 > 0) AS with_mntns, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(coalesce(sum(latency_ns), 0) AS BIGINT) AS latency_ns, 0 AS dropped FROM block GROUP BY event, comm")
def csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace written as CSV files, a third of the rows in files whose header lacks columns, and read back by name."""
    rows, path = a.block(spark, sf_dir), shared_path(spark, "csv")
    old = F.col("seq") % 3 == 0
    rows.where(~old).drop("seq").write.option("header", True).csv(path)
    rows.where(old).select("timestamp_ns", "comm", "event", "op", "bytes", "latency_ns", "rq", "sector").write.mode("append").option("header", True).csv(path)
    back = traces.read_csv(spark, path, "block")
    out = traces.whole_rows(back).groupBy("event", "comm").agg(F.count("*").alias("n"), F.count("mntns_id").alias("with_mntns"), F.sum("bytes").alias("total_bytes"), F.coalesce(F.sum("latency_ns"), F.lit(0)).alias("latency_ns"))
    return out.join(F.broadcast(traces.torn_rows(back).select(F.col("dropped").cast("int").alias("dropped"))))


@query(BLOCK_L + "SELECT label, count(*) AS n FROM block_l GROUP BY label")
def container_map_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by label of a container map, written as JSON from ``nation`` and read back."""
    path, nation = shared_path(spark, "map"), a.table(spark, sf_dir, "nation").where("n_nationkey < 6")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    body = F.when(F.col("n_nationkey") < 4, F.struct(none("string").alias("tgids"), F.array("n_nationkey").cast("array<bigint>").alias("mntns_ids"), none("string").alias("comms")))
    body = body.otherwise(F.struct(none("string").alias("tgids"), none("bigint").alias("mntns_ids"), F.array(F.concat(F.lit("c"), F.col("n_nationkey").cast("string"))).alias("comms")))
    sinks.write_json(nation.select(F.lit("containers").alias("k"), F.col("n_name").alias("label"), body.alias("c")).select("k", "label", "c.*"), ["k", "label"], ["tgids", "mntns_ids", "comms"], path)
    dims = dimensions.containers(spark, path)
    rows = labels.resolve(a.block(spark, sf_dir), dimensions.mntns_labels(dims), dimensions.comm_labels(dims))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query(
    with_ctes(EV, BLOCK).rstrip()
    + """, c AS (SELECT coalesce(CAST(CASE WHEN seq % 9 = 0 THEN NULL ELSE mntns_id END AS VARCHAR), '') AS container, comm, op, count(*) AS n FROM block GROUP BY ALL)
SELECT container, comm, coalesce(sum(n) FILTER (WHERE op = 'write'), 0)::BIGINT AS writes, -1::BIGINT AS discards, arg_min(op, CASE op WHEN 'read' THEN 0 WHEN 'write' THEN 1 ELSE 4 END) AS first_op,
  round(sum(ln(1 + n)), 6) AS logs, sum(n)::BIGINT AS n FROM c GROUP BY container, comm"""
)
def op_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each identity as a dictionary by op, looked up with defaults; ops in their usual order; logs and back."""
    rows = a.block(spark, sf_dir).withColumn("container", fn.identity(F.when(F.col("seq") % 9 > 0, F.col("mntns_id"))))
    counts = rows.groupBy("container", "comm", "op").agg(F.count("*").alias("n"))
    by_op = fn.dictionary("op", "n")
    logs = F.round(F.sum(F.log1p("n")), 6)
    back = F.sum(F.round(F.expm1(F.log1p("n"))).cast("bigint"))
    out = counts.groupBy("container", "comm").agg(by_op.alias("d"), F.min_by("op", fn.op_rank(F.col("op"))).alias("first_op"), logs.alias("logs"), back.alias("n"))
    return out.select("container", "comm", fn.get_or(F.col("d"), "write", 0).alias("writes"), fn.get_or(F.col("d"), "discard", -1).cast("bigint").alias("discards"), "first_op", "logs", "n")


@query(
    with_ctes(EV, BLOCK)
    + "SELECT 'rq_completed' AS map, w.key, CAST(coalesce(count(b.seq), 0) AS BIGINT) AS value FROM (SELECT DISTINCT comm || ',' || o AS key FROM ev, (VALUES ('read'), ('discard')) t(o)) w "
    "LEFT JOIN block b ON b.event = 'complete' AND b.comm || ',' || b.op = w.key GROUP BY w.key"
)
def counter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters looked up by map and key, 0 where the trace has none."""
    rows = a.block(spark, sf_dir)
    values = rows.where("event = 'complete'").groupBy(F.lit("rq_completed").alias("map"), F.concat_ws(",", "comm", "op").alias("key")).agg(F.count("*").alias("value"))
    wanted = rows.select("comm").distinct().select(F.lit("rq_completed").alias("map"), F.explode(F.array(F.concat("comm", F.lit(",read")), F.concat("comm", F.lit(",discard")))).alias("key"))
    return quality.lookup(values, wanted)


@query(
    POINTS.rstrip()
    + ", g AS (SELECT l_linestatus, lo, max(hi) AS hi, sum(count) AS count FROM h GROUP BY ALL) SELECT l_linestatus, count(*)::INTEGER AS n_buckets, min(lo) AS first_lo, CAST(sum(count) AS BIGINT) AS count FROM h GROUP BY l_linestatus"
)
def histogram_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a histogram together with its buckets."""
    out = histograms.with_buckets(_points(spark, sf_dir), ["l_linestatus"])
    return out.select("l_linestatus", F.size("buckets").alias("n_buckets"), F.col("buckets")[0]["lo"].alias("first_lo"), "count")


@query(with_ctes(EV, BLOCK).rstrip() + IOPS + ", f AS (SELECT g.comm, g.op, g.sec, coalesce(n, 0) AS value FROM g LEFT JOIN c USING (comm, op, sec)) SELECT comm, op, count(*) AS count, CAST(list(value ORDER BY sec)[1:5] AS VARCHAR) AS head FROM f GROUP BY comm, op")
def series_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a series together with its points, of which the first five are shown."""
    buckets, bounds = _buckets(a.block(spark, sf_dir), ["comm"], "block")
    points = series.filled(buckets, ["comm"], "completions", bounds, HOUR)
    out = histograms.with_points(points, series.series_stats(points, ["comm", "op"]), ["comm", "op"], "sec")
    head = F.transform(F.slice("points", 1, 5), lambda x: x["value"].cast("string"))
    return out.select("comm", "op", "count", F.concat(F.lit("["), F.array_join(head, ", "), F.lit("]")).alias("head"))


@query(
    with_ctes(EV, BLOCK)
    + "SELECT event, contains(comm, '1') OR mntns_id IN (1, 2) AS wanted, count(*) AS n FROM block GROUP BY ALL"
)
def container_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container filter with its ids in a table, as for sets too large for a list."""
    ids = a.table(spark, sf_dir, "nation").where("n_nationkey in (1, 2)").select(F.col("n_nationkey").cast("bigint").alias("mntns_id"))
    rows = a.block(spark, sf_dir)
    kept = filters.in_containers(rows, ids).select("seq").withColumn("_in", F.lit(True))
    wanted = filters.comm_matches(["1"]) | F.coalesce("_in", F.lit(False))
    return rows.join(kept, "seq", "left").groupBy("event", wanted.alias("wanted")).agg(F.count("*").alias("n"))



@query(BLOCK_L + "SELECT label, event, op, count(*) AS n FROM block_l WHERE label = (SELECT n_name FROM nation WHERE n_nationkey = 4) GROUP BY ALL")
def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one label, selected by the pairs of process and mount namespace that it stands for."""
    rows = block_l(spark, sf_dir)
    name = a.table(spark, sf_dir, "nation").where("n_nationkey = 4").first()["n_name"]
    found = labels.events_of(rows.drop("label"), rows.select("label", "comm", "mntns_id").distinct(), name)
    return found.groupBy(F.lit(name).alias("label"), "event", "op").agg(F.count("*").alias("n"))


@query(SAM + " SELECT command, count(*) AS n, CAST(CAST(sum(CAST(kb_rd_s AS DECIMAL(28, 6))) AS DECIMAL(28, 3)) AS DOUBLE) AS kb_rd, CAST(CAST(sum(CAST(iodelay AS DECIMAL(28, 6))) AS DECIMAL(28, 3)) AS DOUBLE) AS iodelay FROM sam GROUP BY command")
def sysstat_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disk samples written as CSV and read back with their section's types."""
    path = shared_path(spark, "dev")
    rows = a.samples(spark, sf_dir).withColumn("uid", F.lit("0"))
    sinks.write_csv(rows.select("time", "uid", "tgid", "kb_rd_s", "kb_wr_s", "kb_ccwr_s", "iodelay", "command"), path)
    total = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("decimal(28,3)").cast("double").alias(c)
    out = traces.read_sysstat(spark, path, "dev").groupBy("command").agg(F.count("*").alias("n"), total("kb_rd_s"), total("iodelay"))
    return out.withColumnRenamed("kb_rd_s", "kb_rd")


# -- text reports: rows of the tables written as report lines, and parsed back


#: Events of a process-statistics report.
REPORT_EVENTS = 50_000


def _lines(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """``rows(ord, line)`` written as one text file in order, or ``rows(file, ord, line)`` as many, and read back as numbered lines."""
    path = shared_path(spark, name)
    if "file" in rows.columns:
        rows.repartition("file").sortWithinPartitions("file", "ord").select("file", "line").write.partitionBy("file").text(path)
    else:
        rows.repartition(1).sortWithinPartitions("ord").select("line").write.text(path)
    return text.lines(spark, path)


@query(with_ctes(EV, BLOCK) + "SELECT 'rq_completed' AS map, comm || ',' || op AS key, count(*) AS value FROM block WHERE event = 'complete' GROUP BY comm, op")
def parse_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = a.block(spark, sf_dir).where("event = 'complete'").groupBy("comm", "op").agg(F.count("*").alias("n"))
    key = F.concat_ws(",", "comm", "op")
    line = lambda n: F.concat(F.lit("@rq_completed["), key, F.lit("]: "), n.cast("string"))
    # a stale value, then noise, then the value that counts
    parts = [counts.select(F.concat(F.lit(f"{i} "), key).alias("ord"), v.alias("line")) for i, v in enumerate((line(F.col("n") + 7), F.lit("noise @x[y]"), line(F.col("n"))))]
    return text.counters(_lines(spark, reduce(DataFrame.unionByName, parts), "counters")).select("map", "key", "value")


SIZES = f"WITH s AS (SELECT l_returnflag AS key, CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem), h AS (SELECT key, {LOG2} AS lo FROM s) "


@query(SIZES + "SELECT 'rq_sizes' AS map, key, CAST(row_number() OVER (PARTITION BY key ORDER BY lo) - 1 AS INTEGER) AS bucket, lo, lo * 2 AS hi, count(*) AS count FROM h GROUP BY key, lo")
def parse_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = log2_histogram(spark, sf_dir).withColumnRenamed("l_returnflag", "key")
    short = lambda v: F.when(v >= 1 << 20, F.concat(fn.int_div(v, 1 << 20).cast("string"), F.lit("M"))).when(v >= 1024, F.concat(fn.int_div(v, 1024).cast("string"), F.lit("K"))).otherwise(v.cast("string"))
    line = F.concat(F.lit("["), short(F.col("lo")), F.lit(", "), short(F.col("hi")), F.lit(")  "), F.col("count").cast("string"), F.lit(" |@@@@|"))
    place = lambda i, lo: F.format_string("%s %d %020d", F.col("key"), F.lit(i), lo)
    keys = hist.select("key").distinct()
    parts = [
        keys.select(place(0, F.lit(0)).alias("ord"), F.concat(F.lit("@rq_sizes["), "key", F.lit("]:")).alias("line")),
        hist.select(place(1, F.col("lo")).alias("ord"), line.alias("line")),
        keys.select(place(2, F.lit(0)).alias("ord"), F.lit("lost 3 events").alias("line")),
        keys.select(place(3, F.lit(0)).alias("ord"), F.lit("[1, 2)  9 |@|").alias("line")),
    ]
    return text.histograms(_lines(spark, reduce(DataFrame.unionByName, parts), "histograms")).select("map", "key", "bucket", "lo", "hi", "count")


@query(
    with_ctes(EV, BLOCK).rstrip()
    + f"{BOUNDS}, c AS (SELECT op AS key, {SEC} AS sec, count(*) AS value FROM block, b GROUP BY op, sec) "
    "SELECT 'd_inflight' AS map, key, printf('%02d:%02d:%02d', sec // 3600, sec // 60 % 60, sec % 60) AS \"time\", value FROM c"
)
def parse_tseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.block(spark, sf_dir)
    start = rows.agg(F.min("timestamp_ns").alias("t0"))
    counts = rows.join(F.broadcast(start)).groupBy(F.col("op").alias("key"), fn.time_bucket(F.col("timestamp_ns"), F.col("t0"), HOUR).alias("sec")).agg(F.count("*").alias("value"))
    place = lambda i, sec: F.format_string("%s %d %020d", F.col("key"), F.lit(i), sec)
    keys = counts.select("key").distinct()
    sample = F.concat(fn.clock(F.col("sec")), F.lit(" |    * | "), F.col("value").cast("string"))
    parts = [keys.select(place(i, F.lit(0)).alias("ord"), line.alias("line")) for i, line in (
        (0, F.concat(F.lit("@d_inflight["), "key", F.lit("]:"))), (1, F.lit("hh:mm:ss   0 ____ 9")), (3, F.lit("v____v")), (4, F.lit("00:00:00 | * | 99")),
    )]
    parts.append(counts.select(place(2, F.col("sec")).alias("ord"), sample.alias("line")))
    return text.series(_lines(spark, reduce(DataFrame.unionByName, parts), "series")).select("map", "key", "time", "value")


@query(
    with_ctes(EV).rstrip()
    + """, p AS (SELECT seq, CAST(user_id AS VARCHAR) AS tgid, comm || ' main' AS command, CAST(1000 + k AS VARCHAR) AS tid, value FROM ev)
SELECT 'cpu' AS section, tgid, tid, command, CAST(value AS DOUBLE) AS usr, CAST(seq AS VARCHAR) AS cpu FROM p UNION ALL SELECT 'dev', tgid, NULL, command, value, CAST(seq AS VARCHAR) FROM p"""
)
def parse_pidstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process row and a thread row of each event in a cpu section, and a process row in a dev section, in reports of 150,000 lines: a file a task and not one a thousand lines, as listing and committing files is the driver's."""
    rows = a.ev(spark, sf_dir).select("seq", F.col("user_id").cast("string").alias("tgid"), F.concat("comm", F.lit(" main")).alias("command"), (1000 + F.col("k")).cast("string").alias("tid"), F.col("value").cast("string").alias("v"), F.col("seq").cast("string").alias("s"))
    rows = rows.withColumn("file", fn.int_div(F.col("seq"), REPORT_EVENTS))
    place = lambda i: F.format_string("%d %020d", F.lit(i), F.col("seq"))
    say = lambda *parts: F.concat_ws(" ", *[F.lit(p) if p in TEXT else F.col(p) for p in parts])
    TEXT = {"12:00:00", "0", "-", "|__worker"}
    head = [("0", "Linux 6.1 (host)"), ("00", ""), ("1", "12:00:00 UID TGID TID %usr %system %guest %wait %CPU CPU Command"), ("3", "12:00:00 UID TGID TID kB_rd/s kB_wr/s kB_ccwr/s iodelay Command"), ("5", "Average: 0 1 - 0 0 0 0 x")]
    heads = rows.select("file").distinct().select("file", F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(x).alias("line")) for o, x in head])).alias("x")).select("file", "x.*")
    cpu = rows.select("file", F.concat(place(2), F.lit(" a")).alias("ord"), say("12:00:00", "0", "tgid", "-", "v", "0", "0", "0", "v", "s", "command").alias("line")).unionByName(
        rows.select("file", F.concat(place(2), F.lit(" b")).alias("ord"), say("12:00:00", "0", "-", "tid", "v", "0", "0", "0", "v", "s", "|__worker").alias("line"))
    )
    dev = rows.select("file", place(4).alias("ord"), say("12:00:00", "0", "tgid", "-", "v", "0", "0", "s", "command").alias("line"))
    out = text.pidstat(_lines(spark, heads.unionByName(cpu).unionByName(dev), "pidstat"))
    last = F.when(F.col("section") == "cpu", F.get("fields", F.lit(5))).otherwise(F.get("fields", F.lit(3)))
    return out.select("section", "tgid", "tid", "command", F.get("fields", F.lit(0)).cast("double").alias("usr"), last.alias("cpu"))


_SUMMARY_STATS = "count, min, max, mean, p1, p5, p50, p95, p99, area_under_curve"


@query(
    with_ctes(EV, BLOCK).rstrip()
    + f"""{BOUNDS}, c AS (SELECT op, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS b FROM block WHERE event = 'complete' GROUP BY op),
  s AS (SELECT op AS key, {SEC} AS sec, count(*) AS value FROM block, b GROUP BY op, sec), d AS (SELECT max(sec) - min(sec) AS secs FROM s), st AS ("""
    + stats_sql("s", "key")
    + """), auc AS (SELECT key, round(CASE WHEN count(*) > 1 THEN sum(value) - (arg_min(value, sec) + arg_max(value, sec)) / 2.0 ELSE sum(value) END, 2) AS area_under_curve FROM s GROUP BY key),
  w AS (SELECT key, CAST(count AS DOUBLE) AS count, min, max, mean, p1, p5, p50, p95, p99, CAST(area_under_curve AS DOUBLE) AS area_under_curve FROM st JOIN auc USING (key)) """
    + "SELECT 'counters' AS part, 'rq_completed' AS map, op AS key, 'value' AS stat, CAST(n AS DOUBLE) AS value FROM c UNION ALL SELECT 'counters', 'rq_total_bytes', op, 'value', CAST(b AS DOUBLE) FROM c "
    "UNION ALL SELECT 'derived', 'throughput', op, 'iops', round(n / CAST(secs AS DOUBLE), 2) FROM c, d UNION ALL SELECT 'derived', 'throughput', op, 'mib_s', round(b / CAST(secs AS DOUBLE) / 1048576, 2) FROM c, d "
    f"UNION ALL SELECT 'tseries', 'd_inflight', key, stat, value FROM (UNPIVOT w ON {_SUMMARY_STATS} INTO NAME stat VALUE value)"
)
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and series of the trace written as a summary report, parsed, and reported with throughput over its run."""
    rows = a.block(spark, sf_dir)
    start = rows.agg(F.min("timestamp_ns").alias("t0"))
    done = rows.where("event = 'complete'").groupBy("op").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    hours = rows.join(F.broadcast(start)).groupBy("op", fn.time_bucket(F.col("timestamp_ns"), F.col("t0"), HOUR).alias("sec")).agg(F.count("*").alias("value"))
    place = lambda i, sec: F.format_string("%d %s %020d", F.lit(i), F.col("op"), sec)
    counter = lambda name, c: F.concat(F.lit(f"@{name}["), "op", F.lit("]: "), F.col(c).cast("string"))
    parts = [done.select(place(i, F.lit(0)).alias("ord"), counter(name, c).alias("line")) for i, (name, c) in enumerate((("rq_completed", "n"), ("rq_total_bytes", "b")))]
    heads = F.array(F.struct(place(2, F.lit(0)).alias("ord"), F.concat(F.lit("@d_inflight["), "op", F.lit("]:")).alias("line")), F.struct(F.concat(place(2, F.lit(0)), F.lit(" mark")).alias("ord"), F.lit("hh:mm:ss").alias("line")))
    parts.append(done.select(F.explode(heads).alias("x")).select("x.*"))
    sample = F.concat(fn.clock(F.col("sec")), F.lit(" | * | "), F.col("value").cast("string"))
    parts.append(hours.select(place(2, F.col("sec") + 1).alias("ord"), sample.alias("line")))
    lines = _lines(spark, reduce(DataFrame.unionByName, parts), "summary")
    return reports.summary_report(text.counters(lines), text.histograms(lines), text.series(lines), "block").drop("file")


# -- streams over the events table


def _stream(spark: SparkSession, sf_dir: str, slices: int = 3) -> DataFrame:
    """The events as a trace source delivers them: in files by time, one a micro-batch."""
    rows, path = a.table(spark, sf_dir, "events"), shared_path(spark, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(micros, [k / slices for k in range(1, slices)], 1000)).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(micros >= low)
        (part if high is None else part.where(micros < high)).coalesce(1).write.mode("append").parquet(path)
    return a.numbered(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))


def _paths(spark: SparkSession) -> tuple[str, str]:
    return shared_path(spark, "stream"), shared_path(spark, "stream-state")


@query(
    with_ctes(EV)
    + f"SELECT op, make_timestamp(timestamp_ns // {HOUR} * {HOUR // 1000}) AS bucket, count(*) AS n, arg_max(k % 13, timestamp_ns) AS gauge FROM ev GROUP BY op, bucket"
)
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.event_time(_stream(spark, sf_dir).withColumn("gauge", F.col("k") % 13), "1 hour")
    said = jobs.run_batches(jobs.bucket_series(rows, ["op"], "gauge", "1 hour"), *_paths(spark), "update")
    return jobs.newest(said, ["op", "bucket"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(with_ctes(EV, BLOCK, pair_sql("p", "block", "rq", "issue", "complete")) + f"SELECT rq AS key, start_ns, timestamp_ns AS end_ns FROM p WHERE event = 'complete' AND {MATCHED}")
def stream_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from keyed state over several micro-batches; the slowest pair is what a start may take."""
    return jobs.run(jobs.pair(a.block(spark, sf_dir, _stream(spark, sf_dir)), "rq", "issue", "complete", ttl_ns=60 * jobs.DAY_NS), *_paths(spark))


@query(with_ctes(EV, BLOCK).rstrip() + f", s AS (SELECT op, bytes AS v FROM block WHERE event = 'complete'), h AS (SELECT op, v, {LOG2} AS lo FROM s) SELECT op, lo, count(*) AS count, CAST(sum(v) AS BIGINT) AS total FROM h GROUP BY op, lo")
def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.block(spark, sf_dir, _stream(spark, sf_dir)).where("event = 'complete'")
    return jobs.newest(jobs.run_batches(jobs.histogram(rows, ["op"], "bytes"), *_paths(spark), "update"), ["op", "lo"])


@query(
    with_ctes(EV, BLOCK, pair_sql("p", "block", "rq", "issue", "complete", ("op", "comm"))).rstrip()
    + f""", m AS (SELECT CASE event WHEN 'complete' THEN start_op ELSE op END AS op, CASE event WHEN 'complete' THEN start_comm ELSE comm END AS comm, timestamp_ns, seq, CASE event WHEN 'issue' THEN 1 ELSE -1 END AS d
    FROM p WHERE event = 'issue' OR (event = 'complete' AND {MATCHED}))
SELECT op, comm, timestamp_ns, CAST(sum(d) OVER (PARTITION BY op, comm ORDER BY timestamp_ns, seq) AS BIGINT) AS in_flight FROM m"""
)
def stream_inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in flight after each issue and each completion of an issue that the stream has."""
    return jobs.run(jobs.in_flight(a.block(spark, sf_dir, _stream(spark, sf_dir)), "rq", "issue", "complete", ttl_ns=60 * jobs.DAY_NS), *_paths(spark))


@query(
    with_ctes(EV, FS).rstrip()
    + POSITIONS.replace("comm, mntns_id, tid, kfd", "tid, kfd").rstrip()
    + " SELECT d.tid, d.fd, timestamp_ns, syscall, CAST(base + moved AS BIGINT) AS position FROM d WHERE event = 'enter' AND syscall IN ('read', 'write') AND part > 0 AND base IS NOT NULL"
)
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from keyed state over several micro-batches."""
    return jobs.run(jobs.file_positions(a.fs(spark, sf_dir, _stream(spark, sf_dir)), ttl_ns=60 * jobs.DAY_NS), *_paths(spark))


@query(
    with_ctes(EV)
    + """SELECT comm AS label, list_sort(list(DISTINCT CAST(user_id AS VARCHAR)))::VARCHAR AS tgids, CAST(count(DISTINCT mntns_id) AS BIGINT) AS n_mntns FROM ev GROUP BY comm"""
)
def stream_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select(F.col("comm").alias("label"), F.col("user_id").cast("string").alias("tgid"), "mntns_id", "comm")
    """The ids of each container, added micro-batch by micro-batch to a growing table."""
    out = jobs.gather_containers(jobs.sightings(rows), *_paths(spark)).read().groupBy("label").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "tgid", F.col("id")))).alias("tgids"), F.count_if(F.col("kind") == "mntns_id").alias("n_mntns")
    )
    return out.select("label", F.concat(F.lit("["), F.array_join("tgids", ", "), F.lit("]")).alias("tgids"), "n_mntns")


@query(
    with_ctes(EV).rstrip()
    + f", b AS (SELECT op, make_timestamp(timestamp_ns // {HOUR} * {HOUR // 1000}) AS bucket, count(*) AS n FROM ev GROUP BY op, bucket) SELECT * FROM b WHERE bucket > (SELECT max(bucket) FROM b) - INTERVAL 100 HOUR"
)
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred hours of a series, as a recorder with that many buckets keeps them; the state holds no more."""
    rows = jobs.event_time(_stream(spark, sf_dir).withColumn("gauge", F.col("k") % 13), "100 hours")
    said = jobs.run_batches(jobs.bucket_series(rows, ["op"], "gauge", "1 hour"), *_paths(spark), "update")
    out = jobs.latest_buckets(jobs.newest(said, ["op", "bucket"]), 100, "1 hour")
    return out.select("op", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n")


@query(BLOCK_L + "SELECT label, event, count(*) AS n FROM block_l GROUP BY label, event")
def stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream labelled with the container dimension as each micro-batch finds it."""
    path = shared_path(spark, "stream-labels")
    sink = lambda batch, i: batch.select("label", "event").write.mode("overwrite").parquet(f"{path}/batch={i}")
    rows = a.block(spark, sf_dir, _stream(spark, sf_dir))
    writer = jobs.with_current_labels(rows, lambda s: a.label_dimensions(s, sf_dir), sink)
    writer.option("checkpointLocation", shared_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("label", "event").agg(F.count("*").alias("n"))


@query(
    with_ctes(EV).rstrip()
    + ", f AS (SELECT 'kind' || seq % 3 AS event, seq // 3 AS seq FROM ev WHERE k % 50 > 0) SELECT event, max(seq) - min(seq) + 1 AS generated, max(seq) - min(seq) + 1 - count(*) AS dropped FROM f GROUP BY event"
)
def stream_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a stream with a sequence number for each kind has not delivered: one in fifty is taken out."""
    rows = _stream(spark, sf_dir).where(F.col("k") % 50 > 0)
    kinds = rows.select(F.concat(F.lit("kind"), (F.col("seq") % 3).cast("string")).alias("event"), fn.int_div(F.col("seq"), 3).alias("seq"))
    return jobs.newest(jobs.run_batches(jobs.loss_by_sequence(kinds), *_paths(spark), "update"), ["event"])


@query(
    with_ctes(EV).rstrip()
    + f", n AS (SELECT op, row_number() OVER (PARTITION BY op, timestamp_ns // {HOUR} ORDER BY timestamp_ns, seq) AS nth FROM ev) "
    "SELECT op AS event, count(*) AS generated, count(*) FILTER (WHERE nth > 4) AS dropped FROM n GROUP BY op"
)
def stream_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that find no room in a buffer of four a request type, emptied every hour."""
    out = jobs.run(jobs.admitted(_stream(spark, sf_dir), "op", 4, HOUR), *_paths(spark))
    return out.groupBy(F.col("key").alias("event")).agg(F.count("*").alias("generated"), F.count_if(~F.col("admitted")).alias("dropped"))


@query(
    with_ctes(EV).rstrip()
    + ", d AS (SELECT mntns_id, min(timestamp_ns) AS since FROM ev WHERE k = 0 GROUP BY mntns_id) "
    "SELECT mntns_id, count(*) AS n, min(timestamp_ns) AS first_ns FROM ev JOIN d USING (mntns_id) WHERE timestamp_ns >= since GROUP BY mntns_id"
)
def stream_live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of containers from their discovery on, which is their first event with k = 0; those before it are dropped."""
    rows = a.numbered(a.table(spark, sf_dir, "events"))
    found = rows.where("k = 0").select(F.col("mntns_id").cast("string").alias("label"), "mntns_id", "timestamp_ns")
    folder, (out, more) = shared_path(spark, "inventory"), _paths(spark)
    jobs.inventory(spark, folder).add(jobs.sightings(found).groupBy("label", "kind", "id").agg(F.min("since_ns").alias("since_ns")), 0)
    kept = jobs.run_filtered(_stream(spark, sf_dir).select("mntns_id", "timestamp_ns"), folder, out, more)
    return kept.groupBy("mntns_id").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first_ns"))


# -- dashboards

POINTS_SHOWN = 10_000


def grid_cdf_sql(series_name: str, source: str) -> str:
    """A curve of ``source(label, op, value)`` at up to ``POINTS_SHOWN`` evenly spaced ranks."""
    return f"""SELECT label, '{series_name}' AS series, op, CAST(value AS DOUBLE) AS x, round((max(i) + 1) / CAST(max(n) AS DOUBLE), 6) AS y FROM (
  SELECT r.label, r.op, r.value, r.i, r.n FROM (SELECT label, op, value, row_number() OVER (PARTITION BY label, op ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY label, op) AS n
      FROM ({source}) WHERE value IS NOT NULL) r
  JOIN (SELECT label, op, n, least(n, {POINTS_SHOWN}) AS m, unnest(range(least(n, {POINTS_SHOWN}))) AS j FROM (SELECT label, op, count(value) AS n FROM ({source}) GROUP BY label, op)) g
    ON r.label = g.label AND r.op = g.op AND r.i = CASE WHEN m = 1 THEN 0 ELSE (j * (g.n - 1)) // (m - 1) END) GROUP BY label, op, value"""


def dashboard_sql(head: str, layer: str, op: str, end: str, gauges: tuple[str, ...], gaps: str, more: str = "") -> str:
    """SQL of ``reports.layer_series`` by label; ``gaps`` selects (label, op, value)."""
    io = " WHERE syscall IN ('read', 'write')" if layer == "fs" else ""
    src = f"{layer}_l"
    last = "".join(f", arg_max({g}, timestamp_ns) AS {g}" for g in gauges)
    parts = [f"SELECT label, 'op_share' AS series, {op} AS op, CAST(count(*) AS DOUBLE) AS x, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY label), 2) AS y FROM {src} WHERE event = '{end}' GROUP BY label, {op}"]
    parts += [f"SELECT label, '{g}', op, CAST(sec AS DOUBLE), CAST(greatest({g}, 0) AS DOUBLE) FROM k" for g in gauges]
    parts.append("SELECT label, 'iops', op, CAST(sec AS DOUBLE), CAST(n AS DOUBLE) FROM k WHERE n > 0")
    parts.append("SELECT label, 'cumulative_mb', op, CAST(sec AS DOUBLE), round(CAST(sum(total) OVER (PARTITION BY label, op ORDER BY sec) AS BIGINT) / 1048576.0, 6) FROM k")
    parts.append(grid_cdf_sql("size_cdf", f"SELECT label, {op} AS op, bytes AS value FROM {src} WHERE event = '{end}' AND bytes > 0"))
    parts.append(grid_cdf_sql("latency_cdf_us", f"SELECT label, {op} AS op, latency_ns / 1000 AS value FROM {src} WHERE event = '{end}' AND latency_ns > 0"))
    parts.append(grid_cdf_sql("gap_cdf", gaps))
    buckets = (
        f", k AS (SELECT label, {op} AS op, {SEC} AS sec, count(*) FILTER (WHERE event = '{end}') AS n, "
        f"sum(CASE WHEN event = '{end}' THEN coalesce(bytes, 0) ELSE 0 END) AS total{last} FROM {src}, b{io} GROUP BY ALL) "
    )
    return head.rstrip() + BOUNDS + buckets + " UNION ALL ".join(parts) + more


def _sector_gaps(source: str, event: str) -> str:
    return f"SELECT label, op, abs(sector - lag(sector + bytes // 512) OVER (PARTITION BY label, op ORDER BY timestamp_ns, seq)) AS value FROM {source} WHERE event = '{event}'"


def _fs_gaps(call: str) -> str:
    """Gaps of one call by positions that only it advances, by label."""
    key = "label, tid, kfd"
    return f"""SELECT label, syscall AS op, abs(position - lag(position + coalesce(bytes, 0)) OVER (PARTITION BY label, fd ORDER BY timestamp_ns, seq)) AS value FROM (
  SELECT *, base + moved AS position FROM (SELECT *, max(CASE WHEN event = 'exit' AND syscall = 'openat' THEN 0 WHEN event = 'exit' AND syscall = 'lseek' THEN bytes END) OVER (PARTITION BY {key}, part) AS base,
      sum(CASE WHEN event = 'exit' AND syscall = '{call}' AND bytes > 0 THEN bytes ELSE 0 END) OVER (PARTITION BY {key}, part ORDER BY timestamp_ns, seq) AS moved
    FROM (SELECT *, count(*) FILTER (WHERE (event = 'exit' AND syscall IN ('openat', 'lseek') AND bytes >= 0) OR (event = 'enter' AND syscall = 'close')) OVER (PARTITION BY {key} ORDER BY timestamp_ns, seq) AS part
      FROM (SELECT *, CASE WHEN event = 'exit' AND syscall = 'openat' THEN bytes ELSE fd END AS kfd FROM fs_l) WHERE kfd IS NOT NULL))
  WHERE event = 'enter' AND syscall = '{call}' AND part > 0 AND base IS NOT NULL)"""


def _density(name: str, bounds: str) -> str:
    return f" UNION ALL SELECT label, '{name}', op, CAST({bin_sql(512)} AS DOUBLE), CAST(count(*) AS DOUBLE) FROM nvme_l, ({bounds}) x WHERE event = 'setup' GROUP BY label, op, {bin_sql(512)}"


@query(dashboard_sql(BLOCK_L, "block", "op", "complete", ("q_inflight", "d_inflight"), _sector_gaps("block_l", "issue")))
def block_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.layer_series(block_l(spark, sf_dir), ["label"], "block", ORDER, HOUR, POINTS_SHOWN)


@query(
    dashboard_sql(
        NVME_L, "nvme", "op", "complete", ("inflight",), _sector_gaps("nvme_l", "setup"),
        _density("lba_density", "SELECT min(sector) AS lo, max(sector + bytes // 512) AS hi FROM nvme WHERE event = 'setup'")
        + _density(
            "lba_density_local",
            "SELECT max(sector) FILTER (WHERE i = floor(0.01 * (n - 1) + 0.5)) AS lo, max(sector) FILTER (WHERE i = floor(0.99 * (n - 1) + 0.5)) AS hi FROM "
            "(SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS i, count(*) OVER () AS n FROM nvme WHERE event = 'setup')",
        ),
    )
)
def nvme_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.layer_series(nvme_l(spark, sf_dir), ["label"], "nvme", ORDER, HOUR, POINTS_SHOWN)


@query(
    NVME_L.rstrip() + BOUNDS + LOCAL.rstrip()
    + f", h AS (SELECT label, op, CAST(((timestamp_ns - t0) * 256::HUGEINT) // (t1 - t0 + 1) AS INTEGER) AS time_bin, {bin_sql(256)} AS lba_bin, round(ln(1 + count(*)), 6) AS z FROM nvme_l, x, b WHERE event = 'setup' GROUP BY ALL) "
    "SELECT label, 'lba_heatmap' AS series, op, CAST(time_bin AS DOUBLE) AS x, CAST(lba_bin AS DOUBLE) AS y, z, max(z) OVER (PARTITION BY op) AS z_max FROM h"
)
def nvme_heat_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.heat_series(nvme_l(spark, sf_dir), ["label"])


@query(dashboard_sql(FS_L, "fs", "syscall", "exit", ("inflight",), _fs_gaps("read") + " UNION ALL " + _fs_gaps("write")))
def fs_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.layer_series(fs_l(spark, sf_dir), ["label"], "fs", ORDER, HOUR, POINTS_SHOWN)


__all__ = ["ORACLE_SQL", "QUERIES"]
