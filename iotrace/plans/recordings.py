"""Registered queries over recordings on disk: traces, maps, counters and reports written from the given tables and read back.

Beside them, the operators that the other queries leave out: decoding, label columns, clocks, orders and attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrace.functions import scalars as fn
from iotrace.operators import access, counters, distributions, histograms, labels, lifecycle, quality, reports, sysstat
from iotrace.plans import adapters as a
from iotrace.plans.adapters import BLOCK, EV, FS, LABELS, NVME, labelled, with_ctes
from iotrace.plans.queries import BLOCK_L, CLOCK, MATCHED, ORDER, _hist_pct, _lines, block_l, pair_sql, query
from iotrace.sources import dimensions, sinks, text, traces
from iotrace.storage import shared_path

COLUMNS = ["timestamp_ns", "mntns_id", "event", "op", "bytes", "latency_ns", "sector", "rq", "comm", "q_inflight", "d_inflight"]


def _write_files(spark: SparkSession, rows: DataFrame, folder: str, cut: bool = False) -> None:
    """``rows(file, ...)`` as one CSV file each under ``folder``; with ``cut`` a last line follows whose last number 7 has no line end."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS])
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("timestamp_ns", "seq", line.alias("line")))), lambda x: x["line"]), "\n")
    whole = F.concat(F.lit(",".join(COLUMNS) + "\n"), F.col("body"), F.lit("\n"), F.lit("1,1,issue,read,512,,8,0x1,cut,0," if cut else ""))
    # the sink's line end is the last character of each file
    files = rows.groupBy("file").agg(body.alias("body")).select("file", whole.alias("value"))
    files = files if cut else files.withColumn("value", F.expr("left(value, length(value) - 1)"))
    files.repartition("file").write.mode("append").option("lineSep", "7" if cut else "\n").partitionBy("file").text(folder)


def _filed(spark: SparkSession, sf_dir: str, size: int = 3000) -> DataFrame:
    return a.block(spark, sf_dir).withColumn("file", fn.int_div(F.col("seq"), size))


@query(with_ctes(EV, BLOCK).rstrip() + " SELECT event, count(*) AS n, (SELECT count(DISTINCT seq // 3000) FROM block) AS cut FROM block GROUP BY event")
def torn_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces whose last line has lost the end of its last number: it fits the header, and is left out all the same."""
    folder = shared_path(spark, "torn")
    _write_files(spark, _filed(spark, sf_dir), folder, cut=True)
    rows = traces.read_csv(spark, f"{folder}/*", "block", mark_cut=True)
    cut = rows.agg(F.count_if(traces.CUT).alias("cut"))
    return traces.whole_rows(rows).groupBy("event").agg(F.count("*").alias("n")).join(F.broadcast(cut))


@query(with_ctes(EV, BLOCK).rstrip() + " SELECT op, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(latency_ns) AS timed FROM block GROUP BY op")
def converted_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV traces converted while recordings grow: half of each file first, then all of it, and each row arrives once."""
    folder, out, state = (shared_path(spark, n) for n in ("recordings", "converted", "converted-state"))
    rows = _filed(spark, sf_dir)
    for part in (rows.where("seq % 2 = 0"), rows):
        grown = shared_path(spark, "recordings")
        _write_files(spark, part, grown)
        # the recorder's own name for a file stays as it grows
        jvm = spark._jvm.org.apache.hadoop.fs
        target = jvm.Path(folder)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        for status in fs.listStatus(jvm.Path(grown)):
            if status.isDirectory():
                named = jvm.Path(folder, f"{status.getPath().getName()}.csv")
                fs.delete(named, False)
                written = [s.getPath() for s in fs.listStatus(status.getPath()) if s.getPath().getName().startswith("part-")]
                fs.rename(written[0], named)
        traces.convert_new_files(spark, folder, "block", out, state, max_files=2)
    done = traces.read_converted(spark, out, state, "block")
    return done.groupBy("op").agg(F.count("*").alias("n"), F.sum("bytes").alias("total_bytes"), F.count("latency_ns").alias("timed"))


@query(
    "WITH c AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_nationkey < 12), "
    "t AS (SELECT 'tgid' AS kind, CAST(n_nationkey // 2 AS VARCHAR) AS id, arg_min(n_name, i) AS label FROM c GROUP BY id), "
    "m AS (SELECT 'command' AS kind, 'c' || n_nationkey % 8 AS id, arg_min(n_name, i) AS label FROM c GROUP BY id) "
    "SELECT * FROM t UNION ALL SELECT * FROM m UNION ALL SELECT 'command', x, x FROM (VALUES ('c9')) v(x)"
)
def process_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process groups and names of containers, read from a map in JSON: the first container has what two claim, filter names stand for themselves."""
    path = shared_path(spark, "process-map")
    nation = a.table(spark, sf_dir, "nation").where("n_nationkey < 12")
    key = F.col("n_nationkey")
    # one object whose members are in key order
    entry = F.concat(F.to_json(F.struct("n_name")).substr(F.lit(11), F.length("n_name") + 2), F.lit(":"), F.to_json(F.struct(F.array(fn.int_div(key, 2).cast("string")).alias("tgids"), F.array(F.concat(F.lit("c"), (key % 8).cast("string"))).alias("comms"))))
    members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, entry.alias("e")))), lambda x: x["e"]), ",")
    nation.agg(F.concat(F.lit('{"version":2,"containers":{'), members, F.lit("}}")).alias("value")).write.text(path)
    tgids, comms = dimensions.process_labels(dimensions.containers(spark, path), ["c1", "c9"])
    out = tgids.select(F.lit("tgid").alias("kind"), F.col("tgid").alias("id"), F.col("tgid_label").alias("label"))
    return out.unionByName(comms.select(F.lit("command").alias("kind"), F.col("command").alias("id"), F.col("command_label").alias("label")))


@query(
    with_ctes(EV, BLOCK).rstrip()
    + """, g AS (SELECT event, count(*) AS generated, count(*) FILTER (WHERE seq % 50 = 0) AS dropped FROM block GROUP BY event), all_ AS (SELECT * FROM g UNION ALL SELECT 'total', sum(generated), sum(dropped) FROM g)
SELECT event, CAST(generated AS BIGINT) AS generated, CAST(dropped AS BIGINT) AS dropped, CAST(generated - dropped AS BIGINT) AS received, round(100.0 * dropped / generated, 4) AS drop_pct FROM all_"""
)
def capture_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recorder's counters, written as JSON and read back, say of the share that was lost."""
    path = shared_path(spark, "counters")
    rows = a.block(spark, sf_dir).groupBy("event").agg(F.count("*").alias("generated"), F.count_if(F.col("seq") % 50 == 0).alias("dropped"))
    sinks.write_json(rows, ["event"], ["generated", "dropped"], path)
    return quality.capture(dimensions.capture_counters(spark, path), rows.select("event", F.col("generated").alias("n")))


@query(
    with_ctes(EV, BLOCK).rstrip()
    + """, t AS (SELECT 'val_' || comm AS job, count(*) FILTER (WHERE op = 'read') AS read_ios, CAST(coalesce(sum(bytes) FILTER (WHERE op = 'read'), 0) AS BIGINT) AS read_bytes,
  count(*) FILTER (WHERE op = 'write' AND mntns_id > 2) AS write_ios, CAST(coalesce(sum(bytes) FILTER (WHERE op = 'write' AND mntns_id > 2), 0) AS BIGINT) AS write_bytes FROM block WHERE event = 'complete' GROUP BY comm)
SELECT *, CASE WHEN read_ios > 0 AND write_ios > 0 THEN 'mixed' WHEN write_ios > 0 THEN 'write' ELSE 'read' END AS kind FROM t"""
)
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workload reports in JSON, one file a job, of which the first job counts; with the class of the workload."""
    path, done = shared_path(spark, "truth"), a.block(spark, sf_dir).where("event = 'complete'")
    side = lambda cond: F.struct(F.count_if(cond).alias("total_ios"), F.coalesce(F.sum(F.when(cond, F.col("bytes"))), F.lit(0)).alias("io_bytes"))
    both = F.struct(F.concat(F.lit("val_"), F.col("comm")).alias("jobname"), "read", "write")
    rows = done.groupBy("comm").agg(side(F.col("op") == "read").alias("read"), side((F.col("op") == "write") & (F.col("mntns_id") > 2)).alias("write"))
    rows.select("comm", F.to_json(F.struct(F.array(both, both).alias("jobs"))).alias("value")).repartition("comm").write.partitionBy("comm").text(path)
    out = dimensions.ground_truth(spark, f"{path}/*/part-*")
    return out.withColumn("kind", quality.workload_class(F.col("read_ios"), F.col("write_ios")))


_SYSCALL_CASE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in fn.SYSCALLS.items())


@query(
    with_ctes(EV).rstrip()
    + f" SELECT CASE k % 13 {_SYSCALL_CASE} END AS syscall, CASE WHEN k % 2 = 0 THEN 'enter' ELSE 'exit' END AS event, count(*) AS n, count(nullif(k % 5, 0)) AS sized, "
    "count(*) FILTER (WHERE k % 7 > 0) AS timed, count(*) FILTER (WHERE k % 6 - 1 >= 0) AS with_fd FROM ev GROUP BY ALL"
)
def syscall_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw system-call records with their codes as names and their no-value codes as null."""
    k = F.col("k")
    raw = a.ev(spark, sf_dir).select(
        "timestamp_ns", "mntns_id", (k % 2).alias("event"), (k % 13).alias("syscall"), (k % 5).alias("bytes"), (k % 7).alias("latency_ns"), (k % 6 - 1).alias("fd"),
        (k - 50).alias("offset"), F.col("user_id").alias("tid"), "comm", F.lit(0).alias("inflight"),
    )
    rows = traces.normalize_events(raw, "fs")
    return rows.groupBy("syscall", "event").agg(F.count("*").alias("n"), F.count("bytes").alias("sized"), F.count("latency_ns").alias("timed"), F.count("fd").alias("with_fd"))


@query(
    with_ctes(EV, BLOCK, LABELS).rstrip()
    + " SELECT coalesce(m.mntns_label, c.comm_label, 'other') AS label, op, count(*) AS n FROM block b LEFT JOIN by_mntns m ON b.mntns_id = m.mntns_id LEFT JOIN by_comm c ON b.comm = c.comm GROUP BY ALL"
)
def label_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every event, ``other`` where no container has it."""
    rows = labels.resolve(a.block(spark, sf_dir), *a.label_dimensions(spark, sf_dir), other="other")
    return rows.groupBy("label", "op").agg(F.count("*").alias("n"))


@query(
    with_ctes(EV).rstrip()
    + f""", t AS (SELECT seq, comm, {CLOCK} AS s FROM ev), f AS (SELECT comm, arg_min(s, seq) AS s0 FROM t GROUP BY comm)
SELECT comm, min((s - s0 + 86400) % 86400) AS first, max((s - s0 + 86400) % 86400) AS last, CAST(sum((s - s0 + 86400) % 86400) AS BIGINT) AS total FROM t JOIN f USING (comm) GROUP BY comm"""
)
def relative_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each sample since its process's first, across midnight."""
    of_day = F.pmod(fn.int_div(F.col("timestamp_ns"), fn.SECOND_NS), F.lit(86400))
    points = a.ev(spark, sf_dir).select("seq", "comm", fn.clock(F.pmod(fn.int_div(of_day, 3) + 82400, F.lit(86400))).alias("time"))
    rel = sysstat.relative_clock(points, ["comm"], "seq").withColumn("rel", F.col("rel").cast("bigint"))
    return rel.groupBy("comm").agg(F.min("rel").alias("first"), F.max("rel").alias("last"), F.sum("rel").alias("total"))


@query(
    with_ctes(EV).rstrip()
    + f""", t AS (SELECT DISTINCT {CLOCK} AS s FROM ev WHERE k % 10 < 9), l AS (SELECT *, lead(s) OVER (ORDER BY s) - s AS gap FROM t),
  e AS (SELECT arg_max(s, gap * 100000 + s) AS edge FROM l WHERE gap > 43200), r AS (SELECT CASE WHEN s <= edge THEN s + 86400 ELSE s END AS s FROM t LEFT JOIN e ON true)
SELECT CAST(max(s) - min(s) AS INTEGER) AS duration_s FROM r"""
)
def sample_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last sample of all sections together, across midnight."""
    of_day = F.pmod(fn.int_div(F.col("timestamp_ns"), fn.SECOND_NS), F.lit(86400))
    rows = a.ev(spark, sf_dir).select("k", fn.clock(F.pmod(fn.int_div(of_day, 3) + 82400, F.lit(86400))).alias("time"))
    return sysstat.duration(*[rows.where(F.col("k") % 10 >= lo).where(F.col("k") % 10 < lo + 3) for lo in (0, 3, 6)]).select(F.col("duration_s").cast("int").alias("duration_s"))


@query(
    BLOCK_L.rstrip()
    + """, l AS (SELECT DISTINCT CASE WHEN label = 'c6' THEN 'other' ELSE label END AS label FROM block_l), p(label, i) AS (VALUES ('KENYA', 1), ('BRAZIL', 2), ('c9', 3), ('c7', 4))
SELECT l.label, CAST(row_number() OVER (ORDER BY l.label = 'other', coalesce(i, 99), l.label) AS INTEGER) AS place FROM l LEFT JOIN p USING (label)"""
)
def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the order that reports show them: given containers, given processes, the rest by name, other last."""
    rows = block_l(spark, sf_dir).withColumn("label", F.when(F.col("label") == "c6", "other").otherwise(F.col("label")))
    return labels.ordered(rows, ["KENYA", "BRAZIL"], ["c9", "c7", "BRAZIL"])


_TAKEN = ("comm", "mntns_id", "op", "bytes", "sector")


@query(
    with_ctes(EV, BLOCK, pair_sql("i", "block", "rq", "insert", "issue", ("comm", "mntns_id"))).rstrip()
    + ", q AS (SELECT seq, timestamp_ns, event, rq, op, bytes, sector, "
    + ", ".join(f"CASE WHEN event = 'issue' AND {MATCHED} THEN coalesce(start_{c}, {c}) ELSE {c} END AS {c}" for c in ("comm", "mntns_id"))
    + " FROM i), "
    + pair_sql("p", "q", "rq", "issue", "complete", _TAKEN)
    + " SELECT seq, "
    + ", ".join(f"CASE WHEN {MATCHED} THEN start_{c} ELSE {c} END AS {c}" for c in _TAKEN)
    + " FROM p WHERE event = 'complete'"
)
def block_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions with all that their issue says of the request, which has process and container of its insert."""
    rows = lifecycle.block_latencies(a.block(spark, sf_dir), ["rq"], ORDER, inherit=list(_TAKEN))
    return rows.where("event = 'complete'").select("seq", *_TAKEN)


@query(
    BLOCK_L.rstrip()
    + """, t AS (SELECT label, comm, mntns_id, count(*) + sum(CASE WHEN event = 'complete' THEN bytes ELSE 0 END) AS total FROM block_l GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, comm, mntns_id) AS rank FROM t),
  g AS (SELECT label, op, abs(sector - lag(sector + bytes // 512) OVER (PARTITION BY label, comm, mntns_id, op ORDER BY timestamp_ns, seq)) AS gap FROM block_l JOIN k USING (label, comm, mntns_id) WHERE event = 'issue' AND rank = 1)
SELECT label, op, count(*) AS total_ios, count(*) FILTER (WHERE gap = 0) AS sequential_count, count(*) FILTER (WHERE gap > 0) AS random_count FROM g GROUP BY label, op"""
)
def dominant_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential or random access of each label's largest identity, which stands for the label where patterns do not add up."""
    rows, identity = block_l(spark, sf_dir), ["label", "comm", "mntns_id"]
    ranks = labels.rank_identities(counters.named(counters.base(rows, identity), identity, "block"))
    found = labels.dominant(access.by_sector(rows, identity, "issue", ORDER), ranks)
    return found.select("label", "op", "total_ios", "sequential_count", "random_count")


def _summary_sql(layer: str, name: str, key: str, end: str, cond: str = "") -> str:
    return (
        f"SELECT '{layer}' AS layer, '{name}' AS map, {key} AS key, v, CASE WHEN v > 0 THEN CAST(1 AS BIGINT) << CAST(floor(log2(v)) AS INTEGER) ELSE 0 END AS lo FROM "
        f"(SELECT {key}, latency_ns AS v FROM {layer} WHERE event = '{end}' AND latency_ns IS NOT NULL{cond})"
    )


@query(
    with_ctes(EV, FS, NVME).rstrip()
    + f""", s AS ({_summary_sql("nvme", "cmd_latencies", "op", "complete")} UNION ALL {_summary_sql("fs", "sc_latencies", "syscall", "exit")}),
  h AS (SELECT layer, map, key, 'range' AS kind, lo, CASE WHEN lo > 0 THEN lo * 2 ELSE 1 END AS hi, count(*) AS count FROM s GROUP BY ALL),
  r AS (SELECT *, CAST(sum(count) OVER (PARTITION BY layer, map, key ORDER BY lo) AS BIGINT) AS upto, CAST(sum(count) OVER (PARTITION BY layer, map, key) AS BIGINT) AS total FROM h)
SELECT layer, map, key, CAST(sum(count) AS DOUBLE) AS count, CAST(min(lo) AS DOUBLE) AS min, CAST(max(hi) AS DOUBLE) AS max,
  round(sum(count * CASE WHEN lo > 0 THEN sqrt(CAST(lo AS DOUBLE) * hi) ELSE hi / 2.0 END) / sum(count), 2) AS mean, """
    + ", ".join(_hist_pct(p, n) for n, p in distributions.PERCENTILES.items())
    + " FROM r GROUP BY layer, map, key"
)
def summary_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution part of summary reports of two layers, from histograms written as text, parsed, and taken by bucket."""
    out = None
    for layer, name, key, rows in (("nvme", "cmd_latencies", "op", a.nvme(spark, sf_dir).where("event = 'complete'")), ("fs", "sc_latencies", "syscall", a.fs(spark, sf_dir).where("event = 'exit'"))):
        hist = histograms.log2(rows.where("latency_ns is not null").select(F.col(key).alias("key"), F.col("latency_ns").alias("value")), ["key"])
        place = lambda i, lo: F.format_string("%s %d %020d", F.col("key"), F.lit(i), lo)
        line = F.concat(F.lit("["), F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string"), F.lit(")  "), F.col("count").cast("string"), F.lit(" |@@|"))
        heads = hist.select("key").distinct().select(place(0, F.lit(0)).alias("ord"), F.concat(F.lit(f"@{name}["), "key", F.lit("]:")).alias("line"))
        report = _lines(spark, heads.unionByName(hist.select(place(1, F.col("lo")).alias("ord"), line.alias("line"))), "summary")
        found = reports.summary_report(text.counters(report), text.histograms(report), text.series(report), layer).where("part = 'distributions'")
        wide = found.groupBy("map", "key").pivot("stat", list(distributions.STATS)).agg(F.max("value"))
        wide = wide.select(F.lit(layer).alias("layer"), "map", "key", *distributions.STATS)
        out = wide if out is None else out.unionByName(wide)
    return out
