"""Fixed schemas of traces and resource samples."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of the formats in their order.
LAYERS = {
    "fs": "timestamp_ns bigint, mntns_id bigint, event string, syscall string, bytes bigint, latency_ns bigint, fd int, offset bigint, tid bigint, comm string, inflight int",
    "block": "timestamp_ns bigint, mntns_id bigint, event string, op string, bytes bigint, latency_ns bigint, sector bigint, rq string, comm string, q_inflight int, d_inflight int",
    "nvme": "timestamp_ns bigint, mntns_id bigint, event string, op string, bytes bigint, latency_ns bigint, sector bigint, rq string, comm string, inflight int, disk_name string",
}
SYSSTAT = {
    "cpu": "time string, uid string, tgid string, tid string, usr double, system double, guest double, wait double, cpu_pct double, cpu string, command string",
    "mem": "time string, uid string, tgid string, minflt_s double, majflt_s double, vsz_kb double, rss_kb double, mem_pct double, command string",
    "dev": "time string, uid string, tgid string, kb_rd_s double, kb_wr_s double, kb_ccwr_s double, iodelay double, command string",
}
#: The event kind that starts a request, and the one that ends it; the one whose rows carry addresses; the op column.
START = {"fs": "enter", "block": "issue", "nvme": "setup"}
END = {"fs": "exit", "block": "complete", "nvme": "complete"}
OP = {"fs": "syscall", "block": "op", "nvme": "op"}
GAUGES = {"fs": ("inflight",), "block": ("q_inflight", "d_inflight"), "nvme": ("inflight",)}


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
