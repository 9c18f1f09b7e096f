"""Readers and writers."""

import json

from pyspark.sql import functions as F

from iotrace.operators import reports
from iotrace.sources import dimensions, sinks, text, traces


def numbered(spark, body):
    return spark.createDataFrame([("f", i // 3, i, line) for i, line in enumerate(body.split("\n"))], "file string, start long, at long, line string")


def test_csv_by_header_and_torn_tail(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("timestamp_ns,event,op,bytes,latency_ns,comm\n1,issue,read,512,,fio\n2,complete,read,512,7,fio\n3,comp")
    df = traces.read_csv(spark, str(path), "block")
    assert [(r.timestamp_ns, r.latency_ns) for r in traces.whole_rows(df).collect()] == [(1, None), (2, 7)]
    assert traces.torn_rows(df).first()[0] == 1
    assert traces.unterminated_files(spark, str(path)).count() == 1
    assert traces.identity_columns(df) == ["comm"]
    traces.csv_to_parquet(spark, str(path), "block", str(tmp_path / "out"))
    assert traces.read_parquet(spark, str(tmp_path / "out"), ["comm", "mntns_id"]).columns == ["comm"]
    assert not traces.stale(spark, str(path), str(tmp_path / "out")) and traces.stale(spark, str(path), str(tmp_path / "none"))


def test_files_with_different_headers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("timestamp_ns,mntns_id,event,op,bytes,latency_ns,sector,rq,comm,q_inflight,d_inflight\n1,7,issue,read,512,,8,0x1,fio,0,0\n")
    (folder / "b.csv").write_text("timestamp_ns,event,op,bytes,latency_ns,sector,rq,comm\n2,complete,read,512,7,8,0x1,fio\n3,iss")
    (folder / "c.csv").write_text("timestamp_ns,comm,event,extra\n4,dd,issue,more\n")
    (folder / "d.csv").write_text("")
    df = traces.read_csv(spark, str(folder), "block")
    want = [(1, 7, "issue", "read", 512, "fio", None), (2, None, "complete", "read", 512, "fio", None), (4, None, "issue", None, None, "dd", "more")]
    pick = lambda rows: sorted(tuple(r) for r in rows.select("timestamp_ns", "mntns_id", "event", "op", "bytes", "comm", "extra").collect())
    assert pick(traces.whole_rows(df)) == want and traces.torn_rows(df).first().dropped == 1
    out = str(tmp_path / "out")
    assert traces.convert_new_files(spark, str(folder), "block", out, str(tmp_path / "state")) == 1
    assert pick(spark.read.option("mergeSchema", True).parquet(out)) == want
    (folder / "e.csv").write_text("timestamp_ns,event,op,bytes,latency_ns,sector,rq,comm\n5,complete,read,1,7,8,0x1,fio\n")
    assert traces.convert_new_files(spark, str(folder), "block", out, str(tmp_path / "state")) == 0
    assert [r[0] for r in pick(spark.read.option("mergeSchema", True).parquet(out))] == [1, 2, 4, 5]


def test_new_files_are_converted_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = "1,1,issue,read,512,,8,0x1,fio,0,0\n"
    head = "timestamp_ns,mntns_id,event,op,bytes,latency_ns,sector,rq,comm,q_inflight,d_inflight\n"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in (1, 2):
        (folder / f"{k}.csv").write_text(head + row)
        traces.convert_new_files(spark, str(folder), "block", out, state)
        assert spark.read.parquet(out).count() == k


def test_a_grown_file_arrives_once(spark, tmp_path):
    """A recording that grew after its conversion is converted again, and what it had been is gone; others stay as they are."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    head = "timestamp_ns,mntns_id,event,op,bytes,latency_ns,sector,rq,comm,q_inflight,d_inflight\n"
    rows = lambda name, n: "".join(f"{i},1,issue,read,512,,8,0x1,{name},0,0\n" for i in range(n))
    convert = lambda **o: traces.convert_new_files(spark, str(folder), "block", out, state, **o)
    read = lambda: dict(traces.read_converted(spark, out, state, "block").groupBy("comm").count().collect())
    assert traces.read_converted(spark, out, state, "block").count() == 0
    for name in ("a", "b c", "d"):
        (folder / f"{name}.csv").write_text(head + rows(name, 2))
    assert convert(max_files=2) == 0 and read() == {"a": 2, "b c": 2, "d": 2}
    (folder / "a.csv").write_text(head + rows("a", 5) + "7,1,iss")
    (folder / "e.csv").write_text(head + rows("e", 1))
    assert convert() == 1 and read() == {"a": 5, "b c": 2, "d": 2, "e": 1}
    assert spark.read.parquet(out).count() == 10
    assert convert() == 0 and read() == {"a": 5, "b c": 2, "d": 2, "e": 1}


def test_small_groups_share_a_job(spark, tmp_path):
    """Groups of two files are folders of their own, but the jobs do not grow with their number; a rest of a job cut short is replaced."""
    head = "timestamp_ns,mntns_id,event,op,bytes,latency_ns,sector,rq,comm,q_inflight,d_inflight\n"
    out, jobs = str(tmp_path / "out"), {}
    for n in (2, 12):
        folder, out, state = tmp_path / f"in{n}", str(tmp_path / f"out{n}"), str(tmp_path / f"state{n}")
        folder.mkdir()
        for i in range(n):
            (folder / f"{i}.csv").write_text(head + f"{i},1,issue,read,512,,8,0x1,fio,0,0\n")
        spark.range(3).write.parquet(f"{out}/batch=0/file=x")
        spark.sparkContext.setJobGroup(f"convert{n}", "")
        traces.convert_new_files(spark, str(folder), "block", out, state, max_files=2)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"convert{n}"))
        spark.sparkContext.setJobGroup("rest", "")
        assert sorted(r.timestamp_ns for r in traces.read_converted(spark, out, state, "block").collect()) == list(range(n))
        assert spark.read.parquet(out).select("batch").distinct().count() == n // 2 and spark.read.parquet(out).count() == n
    assert jobs[12] <= jobs[2] + 2
    assert traces.convert_new_files(spark, str(tmp_path / "in12"), "block", out, state, max_files=5, together=7) == 0


def test_a_cut_last_number_is_marked(spark, tmp_path):
    """A last line that fits its header but has no line end is marked, one of rows equal to it; long last lines are read to their start."""
    head = "timestamp_ns,event,op,bytes,latency_ns,comm\n"
    (tmp_path / "a.csv").write_text(head + "1,issue,read,512,,fio\n2,complete,read,512,7,fio\n2,complete,read,512,7,fio")
    (tmp_path / "b.csv").write_text(head + "1,issue,read,512,,fio\n2,complete,read,512,7,fio\n")
    (tmp_path / "c.csv").write_text(head + "3,issue,read,512,,x\n4,iss")
    (tmp_path / "d.csv").write_text(head + "5,issue,read,512,," + "y" * 300_000)
    df = traces.read_csv(spark, str(tmp_path / "*.csv"), "block", mark_cut=True)
    assert df.columns[-2:] == ["_corrupt", "_cut"]
    assert sorted(r.timestamp_ns for r in df.where("_cut").collect()) == [2, 5] and traces.torn_rows(df).first().dropped == 1
    assert sorted(r.timestamp_ns for r in traces.whole_rows(df).collect()) == [1, 1, 2, 2, 3]
    tails = {r.path.rpartition("/")[2]: r.tail for r in traces.unterminated_files(spark, str(tmp_path / "*.csv")).collect()}
    assert set(tails) == {"a.csv", "c.csv", "d.csv"} and tails["c.csv"] == "4,iss" and len(tails["d.csv"]) > 300_000


def test_the_tail_of_a_file_above_two_gigabytes(spark, tmp_path):
    path = tmp_path / "big.csv"
    with open(path, "wb") as f:
        f.seek((1 << 31) + 100)
        f.write(b"\n9,cut")
    assert [tuple(r)[1:] for r in traces.unterminated_files(spark, str(path)).collect()] == [((1 << 31) + 106, "9,cut")]


def test_text_contexts(spark):
    body = "@sizes[read]:\n[4K, 8K)   3 |@@|\n[1]   2 |@|\n\n[8K, 16K)   1 |@|\nlost 3\n[16K, 32K)  9 |@|\n@all:\n[0, 1)  5 |@|"
    got = [tuple(r) for r in text.histograms(numbered(spark, body)).orderBy("map", "bucket").select("map", "key", "bucket", "lo", "hi", "count").collect()]
    assert got == [("all", "_", 0, 0, 1, 5), ("sizes", "read", 0, 4096, 8192, 3), ("sizes", "read", 1, 8192, 16384, 1)]
    body = "@fl[read]:\n\nhh:mm:ss   0 ___ 9\n10:00:00 | * | 4\n10:00:01 |*  | 5\nv___v\n10:00:02 |*  | 6\nhh:mm:ss\n10:00:03 | * | 7\n@n[x]: 4\n@n[x]: 6"
    rows = numbered(spark, body)
    assert [(r.time, r.value) for r in text.series(rows).orderBy("place").collect()] == [("10:00:00", 4), ("10:00:01", 5)]
    assert [tuple(r)[1:] for r in text.counters(rows).collect()] == [("n", "x", 6)]


def test_summary_report(spark):
    body = (
        "@rq_completed[read]: 20\n@rq_total_bytes[read]: 20971520\n@other[x]: 1\n@rq_sizes[read]:\n[4, 8) 2 |@|\n[8, 16) 2 |@|\n"
        "@d_inflight[read]:\nhh:mm:ss\n10:00:00 | * | 4\n10:00:01 | * | 6\n10:00:02 | * | 10\n\n"
    )
    rows = numbered(spark, body)
    got = {(r.map, r.key, r.stat): r.value for r in reports.summary_report(text.counters(rows), text.histograms(rows), text.series(rows), "block").collect()}
    assert got["rq_sizes", "read", "p50"] == 8.0 and got["rq_sizes", "read", "mean"] == 8.49
    assert got["d_inflight", "read", "area_under_curve"] == 13.0
    assert got["throughput", "read", "iops"] == 10.0 and got["throughput", "read", "mib_s"] == 10.0
    assert ("other", "x", "value") not in got


def test_pidstat(spark):
    body = "Linux 6\n\n10:00:00 UID TGID TID %usr %system %guest %wait %CPU CPU Command\n10:00:00 0 7 - 1.0 2.0 0 0 3.0 1 my app\n10:00:00 0 - 8 0.5 0.5 0 0 1.0 2 |__worker\n10:00:00 0 9\n10:00:00 UID TGID TID minflt/s majflt/s VSZ RSS %MEM Command\n10:00:00 0 7 - 1 2 3 4 5.5 my app\n10:00:00 0 - 8 1 2 3 4 5 |__worker\nAverage: 0 7 - 1 2 3 4 5 x"
    report = text.pidstat(numbered(spark, body))
    cpu = text.sysstat_table(report, "cpu").collect()
    assert [(r.tgid, r.tid, r.usr, r.cpu_pct, r.cpu, r.command) for r in cpu] == [("7", "8", 0.5, 1.0, "2", "my app")]
    mem = text.sysstat_table(report, "mem").collect()
    assert [(r.tgid, r.mem_pct, r.command) for r in mem] == [("7", 5.5, "my app")]


def test_dimensions(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"version": 1, "containers": {"web": {"tgids": ["1"], "mntns_ids": [77], "comms": ["nginx"]}, "db": {"tgids": ["2", "1"], "comms": ["pg", "sh"]}, "job": {"comms": ["sh"]}}}))
    dims = dimensions.containers(spark, str(path))
    assert [tuple(r) for r in dimensions.mntns_labels(dims).collect()] == [(77, "web")]
    assert sorted(tuple(r) for r in dimensions.comm_labels(dims).collect()) == [("pg", "db"), ("sh", "job")]
    tgids, comms = dimensions.process_labels(dims, ["sh", "extra"])
    assert sorted(tuple(r) for r in tgids.collect()) == [("1", "web"), ("2", "db")]
    assert sorted(tuple(r) for r in comms.collect()) == [("extra", "extra"), ("nginx", "web"), ("pg", "db"), ("sh", "db")]
    assert dimensions.containers(spark, str(tmp_path / "none.json")).count() == 0
    path.write_text(json.dumps({"containers": {"web": ["nginx"]}}))
    assert dimensions.containers(spark, str(path)).first().comms == ["nginx"]
    local = tmp_path / "local.json"
    local.write_text(json.dumps({"containers": {"old": {"pids": ["4"], "comms": ["x"]}}}))
    assert dimensions.containers(spark, [str(path), str(local)]).first().label == "web"
    assert dimensions.containers(spark, [str(tmp_path / "none.json"), str(local)]).first().tgids == ["4"]
    path.write_text('{"enter": {"generated": 5, "dropped": 1}, "exit": {}}')
    assert sorted(tuple(r) for r in dimensions.capture_counters(spark, str(path)).collect()) == [("enter", 5, 1), ("exit", 0, 0)]
    path.write_text(json.dumps({"jobs": [{"jobname": "a", "read": {"total_ios": 3, "io_bytes": 9}}, {"jobname": "b"}]}))
    assert [tuple(r) for r in dimensions.ground_truth(spark, str(path)).collect()] == [("a", 3, 9, 0, 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1, 2.5), ("a", "y", 2, None), (None, "x", 3, 1.0)], "label string, op string, n int, m double")
    assert json.loads(sinks.nested_json(df, ["label", "op"], ["n", "m"]).first()[0]) == {"a": {"x": {"n": 1, "m": 2.5}, "y": {"n": 2}}, "": {"x": {"n": 3, "m": 1.0}}}
    sinks.write_csv(df.withColumn("label", F.lit("a, b")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().label == "a, b"


def test_raw_events_become_trace_rows(spark):
    raw = spark.createDataFrame([(1, 2, 1, 8, 0, 0, -1, -5, 4, "c", 0)], "timestamp_ns bigint, mntns_id bigint, event int, syscall int, bytes bigint, latency_ns bigint, fd int, offset bigint, tid bigint, comm string, inflight int")
    r = traces.normalize_events(raw, "fs").first()
    assert (r.event, r.syscall, r.bytes, r.latency_ns, r.fd, r.offset) == ("exit", "lseek", None, None, None, None)


def test_a_report_is_read_for_one_scan_only(spark, sf_dir):
    """What the first scan of a process-statistics report gives is stored for the second."""
    from iotrace.plans import queries

    files = queries.parse_pidstat(spark, sf_dir).inputFiles()
    assert files and all(f.endswith(".parquet") for f in files)
