"""The given tables read as traces, and the same definitions in SQL.

``events`` is a trace: k is the number in its props. Buckets are an hour wide, ``HOUR``. ``nation`` is the
container dimension: keys up to 3 are mount namespaces, 4 and 5 are containers known by the process c4 or c5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000_000

#: The columns in SQL, for DuckDB. ``ev`` comes first; the others build on it.
EV = (
    "ev AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS timestamp_ns, user_id, 'c' || (user_id % 10) AS comm, user_id % 7 AS mntns_id, "
    "event_type, value, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, "
    "CASE CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'flush' END AS op FROM events)"
)
LATENCY = "CAST(floor(value) AS BIGINT) * 1000000"
BLOCK = (
    "block AS (SELECT seq, timestamp_ns, mntns_id, CASE WHEN event_type = 'view' THEN 'insert' WHEN event_type IN ('click', 'signup') THEN 'issue' ELSE 'complete' END AS event, "
    f"op, 512 * (1 + k % 8) AS bytes, CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN {LATENCY} END AS latency_ns, k % 16 AS sector, "
    "'0x' || lower(to_hex(user_id)) AS rq, comm, k % 11 - 1 AS q_inflight, k % 13 AS d_inflight FROM ev)"
)
NVME = (
    "nvme AS (SELECT seq, timestamp_ns, mntns_id, CASE WHEN event_type IN ('view', 'click') THEN 'setup' ELSE 'complete' END AS event, op, 512 * (1 + k % 8) AS bytes, "
    f"CASE WHEN event_type NOT IN ('view', 'click') THEN {LATENCY} END AS latency_ns, k % 16 AS sector, '0x' || lower(to_hex(user_id)) AS rq, comm, "
    "k % 9 AS inflight, CASE WHEN k % 5 = 0 THEN 'nvme1n1' ELSE 'nvme0n1' END AS disk_name FROM ev)"
)
FS = (
    "fs AS (SELECT seq, timestamp_ns, mntns_id, CASE WHEN event_type IN ('view', 'purchase') OR (event_type = 'error' AND k % 3 = 2) THEN 'enter' ELSE 'exit' END AS event, "
    "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'write' "
    "ELSE CASE k % 3 WHEN 0 THEN 'openat' WHEN 1 THEN 'lseek' ELSE 'close' END END AS syscall, "
    "CASE WHEN k % 25 = 0 THEN NULL WHEN event_type = 'error' AND k % 3 = 0 THEN 3 + k % 4 ELSE 512 * (1 + k % 8) END AS bytes, "
    f"CASE WHEN event_type IN ('click', 'signup') OR (event_type = 'error' AND k % 3 < 2) THEN {LATENCY} END AS latency_ns, "
    "3 + k % 4 AS fd, 512 * (k % 16) AS \"offset\", user_id AS tid, comm, k % 9 AS inflight FROM ev)"
)
LABELS = (
    "by_mntns AS (SELECT n_nationkey AS mntns_id, n_name AS mntns_label FROM nation WHERE n_nationkey < 4), "
    "by_comm AS (SELECT 'c' || n_nationkey AS comm, n_name AS comm_label FROM nation WHERE n_nationkey IN (4, 5))"
)


def labelled(name: str) -> str:
    """SQL of a trace with its label, as ``<name>_l``."""
    return (
        f"{name}_l AS (SELECT t.*, coalesce(m.mntns_label, c.comm_label, t.comm) AS label FROM {name} t "
        "LEFT JOIN by_mntns m ON t.mntns_id = m.mntns_id LEFT JOIN by_comm c ON t.comm = c.comm)"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(events: DataFrame) -> DataFrame:
    """``events`` with seq, timestamp_ns, comm, mntns_id, k and op."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    op = F.when(F.col("k") % 3 == 0, "read").when(F.col("k") % 3 == 1, "write").otherwise("flush")
    rows = events.select(
        F.col("event_id").alias("seq"), (micros * 1000).alias("timestamp_ns"), "user_id", F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("comm"),
        (F.col("user_id") % 7).alias("mntns_id"), "event_type", "value", k.alias("k"),
    )
    return rows.withColumn("op", op)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "events"))


def _is(*types: str) -> F.Column:
    return F.col("event_type").isin(*types)


def latency() -> F.Column:
    return F.floor("value").cast("bigint") * 1_000_000


def rq() -> F.Column:
    return F.concat(F.lit("0x"), F.lower(F.hex("user_id")))


def block(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    k = F.col("k")
    event = F.when(_is("view"), "insert").when(_is("click", "signup"), "issue").otherwise("complete")
    return (ev(spark, sf_dir) if rows is None else rows).select(
        "seq", "timestamp_ns", "mntns_id", event.alias("event"), "op", (512 * (1 + k % 8)).alias("bytes"),
        F.when(_is("purchase", "error", "signup"), latency()).alias("latency_ns"), (k % 16).alias("sector"), rq().alias("rq"), "comm",
        (k % 11 - 1).alias("q_inflight"), (k % 13).alias("d_inflight"),
    )


def nvme(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, starts = F.col("k"), _is("view", "click")
    return ev(spark, sf_dir).select(
        "seq", "timestamp_ns", "mntns_id", F.when(starts, "setup").otherwise("complete").alias("event"), "op", (512 * (1 + k % 8)).alias("bytes"),
        F.when(~starts, latency()).alias("latency_ns"), (k % 16).alias("sector"), rq().alias("rq"), "comm", (k % 9).alias("inflight"),
        F.when(k % 5 == 0, "nvme1n1").otherwise("nvme0n1").alias("disk_name"),
    )


def fs(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    k, third = F.col("k"), F.col("k") % 3
    event = F.when(_is("view", "purchase") | (_is("error") & (third == 2)), "enter").otherwise("exit")
    call = F.when(_is("view", "click"), "read").when(_is("purchase", "signup"), "write").when(third == 0, "openat").when(third == 1, "lseek").otherwise("close")
    size = F.when(k % 25 == 0, None).when(_is("error") & (third == 0), 3 + k % 4).otherwise(512 * (1 + k % 8))
    return (ev(spark, sf_dir) if rows is None else rows).select(
        "seq", "timestamp_ns", "mntns_id", event.alias("event"), call.alias("syscall"), size.alias("bytes"),
        F.when(_is("click", "signup") | (_is("error") & (third < 2)), latency()).alias("latency_ns"), (3 + k % 4).alias("fd"), (512 * (k % 16)).alias("offset"),
        F.col("user_id").alias("tid"), "comm", (k % 9).alias("inflight"),
    )


def label_dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation")
    by_mntns = nation.where("n_nationkey < 4").select(F.col("n_nationkey").cast("bigint").alias("mntns_id"), F.col("n_name").alias("mntns_label"))
    by_comm = nation.where("n_nationkey in (4, 5)").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("comm"), F.col("n_name").alias("comm_label"))
    return by_mntns, by_comm


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples: one row an event, time the hour of the run, rates from value."""
    v, k = F.col("value"), F.col("k")
    rows = ev(spark, sf_dir)
    first = rows.agg(F.min("timestamp_ns").alias("t0"))
    hour = F.call_function("div", F.col("timestamp_ns") - F.col("t0"), F.lit(HOUR))
    return rows.join(F.broadcast(first)).select(
        "seq", "timestamp_ns", hour.alias("time"), F.col("user_id").cast("string").alias("tgid"), F.col("comm").alias("command"), (k % 4).alias("cpu"),
        v.alias("usr"), (v * 2).alias("system"), (v * 5).alias("guest"), (v * 7).alias("wait"), (v * 3).alias("cpu_pct"),
        (v + k).alias("minflt_s"), (k % 2).cast("double").alias("majflt_s"), (v * 100).alias("vsz_kb"), (v * 10).alias("rss_kb"), (v * 6).alias("mem_pct"),
        (v * 8).alias("kb_rd_s"), (v * 4).alias("kb_wr_s"), (v * 0).alias("kb_ccwr_s"), k.cast("double").alias("iodelay"),
    )


SAMPLES = (
    f"sam AS (SELECT seq, timestamp_ns, (timestamp_ns - (SELECT min(timestamp_ns) FROM ev)) // {HOUR} AS \"time\", CAST(user_id AS VARCHAR) AS tgid, comm AS command, k % 4 AS cpu, "
    "v AS usr, v * 2 AS system, v * 5 AS guest, v * 7 AS wait, v * 3 AS cpu_pct, v + k AS minflt_s, CAST(k % 2 AS DOUBLE) AS majflt_s, "
    "v * 100 AS vsz_kb, v * 10 AS rss_kb, v * 6 AS mem_pct, v * 8 AS kb_rd_s, v * 4 AS kb_wr_s, v * 0 AS kb_ccwr_s, CAST(k AS DOUBLE) AS iodelay "
    "FROM (SELECT *, value AS v FROM ev))"
)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
