"""Hand-checked fixtures of the operators."""

import pytest
from pyspark.sql import functions as F

from iotrace.functions import scalars as fn
from iotrace.operators import access, counters, distributions, filters, histograms, labels, lba, lifecycle, quality, ranks, reports, series, sysstat


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 10)], "value int")
    r = distributions.stats(df, []).first()
    assert (r["count"], r["p1"], r["p50"], r["p99"], r["mean"]) == (4, 1.03, 2.5, 9.79, 4.0)


def test_ranks_against_sorting(spark):
    import random

    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.uniform(-2, 2), float(rng.randrange(-9, 9)), 10.0 ** rng.randrange(12), None])) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, value double")
    want = []
    for k in ("a", "b", None):
        values = sorted(v for x, v in data if x == k and v is not None)
        for v in sorted(set(values)):
            want.append((k or "", v, values.count(v), sum(x <= v for x in values), len(values)))
    got = sorted((r.k or "", r.value, r.n, r.upto, r.total) for r in ranks.counted(df, ["k"], "value").collect())
    assert got == sorted(want)
    assert ranks.counted(df.limit(0), [], "value").count() == 0


def test_area(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 1, 6), ("a", 2, 10), ("b", 0, 7)], "k string, sec int, value int")
    assert rows(df.groupBy("k").agg(series.area().alias("x")), "k", "x") == [("a", 13.0), ("b", 7.0)]


def test_sector_pattern_and_slices(spark):
    df = spark.createDataFrame(
        [("c", i, "issue", "read", s, b) for i, (s, b) in enumerate([(0, 4096), (8, 4096), (16, 512), (100, 512)])],
        "comm string, timestamp_ns bigint, event string, op string, sector bigint, bytes bigint",
    )
    for slice_ns in (3600 * 10**9, 2):
        r = access.by_sector(df, ["comm"], "issue", slice_ns=slice_ns).first()
        assert (r.total_ios, r.sequential_count, r.random_count, r.sequential_pct, r.random_pct) == (4, 2, 1, 66.67, 33.33)


def test_offset_pattern_within_fd(spark):
    data = [("enter", "pread64", 3, 0, 100), ("enter", "pread64", 3, 100, 50), ("enter", "pread64", 3, 150, 10), ("enter", "pread64", 4, 7, None)]
    df = spark.createDataFrame([("c", i, *d) for i, d in enumerate(data)], "comm string, timestamp_ns bigint, event string, syscall string, fd int, offset bigint, bytes bigint")
    r = access.by_offset(df, ["comm"]).first()
    assert (r.total_ios, r.sequential_count, r.random_count) == (4, 2, 0)


def test_positions_null_seek_does_not_reset(spark):
    data = [("exit", "openat", None, 3), ("enter", "read", 3, 100), ("exit", "read", 3, 100), ("enter", "read", 3, 50), ("exit", "lseek", 3, None), ("enter", "read", 3, 10), ("enter", "close", 3, None), ("enter", "read", 3, 10)]
    df = spark.createDataFrame([("c", 1, i, *d) for i, d in enumerate(data)], "comm string, tid bigint, timestamp_ns bigint, event string, syscall string, fd int, bytes bigint")
    assert [r[0] for r in access.file_positions(df, ["comm"]).orderBy("timestamp_ns").select("position").collect()] == [0, 100, 100]
    assert [r[0] for r in access.file_positions(df, ["comm"], zero_result_resets=True).orderBy("timestamp_ns").select("position").collect()] == [0, 100, 0]


def test_positions_match_a_replay(spark):
    import random

    rng, data = random.Random(5), []
    for i in range(1500):
        event, call = rng.choice([("exit", "openat"), ("exit", "lseek"), ("enter", "read"), ("exit", "read"), ("enter", "write"), ("exit", "write"), ("enter", "close")])
        fd, size = rng.choice([3, 4, None]), rng.choice([None, 0, 3, 4, 512])
        data.append((rng.randrange(3), i, event, call, fd, size))
    df = spark.createDataFrame([("c", *d) for d in data], "comm string, tid bigint, timestamp_ns bigint, event string, syscall string, fd int, bytes bigint")
    at, want = {}, []
    for tid, ts, event, call, fd, size in data:
        if event == "enter" and call in ("read", "write") and (tid, fd) in at:
            want.append((ts, at[tid, fd]))
        if event == "exit" and call == "openat" and size is not None:
            at[tid, size] = 0
        elif fd is not None and event == "exit" and call == "lseek" and size is not None:
            at[tid, fd] = size
        elif event == "exit" and call in ("read", "write") and size and (tid, fd) in at:
            at[tid, fd] += size
        elif event == "enter" and call == "close":
            at.pop((tid, fd), None)
    assert rows(access.file_positions(df, ["comm"]), "timestamp_ns", "position") == sorted(want)


def test_histogram_statistics(spark):
    df = spark.createDataFrame([("a", 4, 8, 2), ("a", 8, 16, 2), ("b", 1, 2, 0)], "k string, lo bigint, hi bigint, count bigint")
    a, b = sorted(histograms.stats_of_buckets(df, ["k"]).collect())
    assert (a["count"], a["min"], a["max"], a["mean"], a["p50"]) == (4, 4.0, 16.0, 8.49, 8.0)
    assert (b["count"], b["p50"]) == (0, 0.0)


def test_points_and_ranges(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 3, 4, 4, 5, None)], "value bigint")
    assert rows(histograms.points_and_ranges(df, []), "kind", "lo", "hi", "count") == [("point", 1, 1, 1), ("point", 4, 4, 2), ("range", 0, 1, 1), ("range", 2, 4, 1), ("range", 4, 8, 1)]


def test_lba_bins(spark):
    df = spark.createDataFrame([(s, 512) for s in (0, 511, 1023)], "sector bigint, bytes bigint")
    assert rows(lba.distribution(df, []), "lba_bin", "lba_start", "n") == [(0, 0, 1), (255, 510, 1), (511, 1022, 1)]


def test_clock_across_midnight(spark):
    df = spark.createDataFrame([("23:59:58",), ("00:00:01",), ("23:59:59",)], "time string")
    assert [r.time for r in sysstat.chronological(df).orderBy("secs").collect()] == ["23:59:58", "23:59:59", "00:00:01"]
    assert sysstat.duration(df).first()[0] == 3
    pts = spark.createDataFrame([("k", 0, "23:59:59"), ("k", 1, "00:00:01")], "k string, i int, time string")
    assert rows(sysstat.relative_clock(pts, ["k"], "i"), "i", "rel") == [(0, 0), (1, 2)]


def test_first_sample_is_dropped(spark):
    df = spark.createDataFrame([("1", 1), ("1", 2), ("2", 2)], "tgid string, t int")
    assert rows(sysstat.drop_first(df, ["t"]), "tgid", "t") == [("1", 2)]


def test_pairing_uses_a_start_once(spark):
    df = spark.createDataFrame([("r", 1, "insert"), ("r", 3, "insert"), ("r", 5, "issue"), ("r", 7, "issue")], "rq string, timestamp_ns bigint, event string").withColumn("comm", F.lit("c")).withColumn("mntns_id", F.lit(1))
    out = lifecycle.block_latencies(df)
    assert [r.queue_ns for r in out.orderBy("timestamp_ns").collect()] == [None, None, 2, None]
    assert lifecycle.unmatched(out.withColumn("op", F.lit("read")), ["op"]).first().direct_dispatch == 1


def test_attributes_come_from_the_insert(spark):
    df = spark.createDataFrame([("r", 1, "insert", "app", 7), ("r", 2, "issue", "kworker", 1), ("r", 3, "complete", "swapper", 0)], "rq string, timestamp_ns bigint, event string, comm string, mntns_id bigint")
    assert rows(lifecycle.block_latencies(df), "timestamp_ns", "comm", "mntns_id") == [(1, "app", 7), (2, "app", 7), (3, "app", 7)]


def test_grid_leaves_out_an_event_at_a_whole_duration(spark):
    t0 = 5 * fn.SECOND_NS
    df = spark.createDataFrame([("c", "read", "complete", t0 + int(s * fn.SECOND_NS), 1, 0, 0) for s in (0, 1.5, 2.0)], "comm string, op string, event string, timestamp_ns bigint, bytes bigint, q_inflight int, d_inflight int")
    bounds = counters.run_bounds(counters.base(df, []))
    buckets = series.per_bucket(series.with_bounds(df, bounds.select("ts_min")), ["comm"], "block")
    assert rows(series.filled(buckets, ["comm"], "completions", bounds), "sec", "value") == [(0, 1), (1, 1)]


def test_merge_keeps_the_dominant_percentiles(spark):
    df = spark.createDataFrame([("l", 10, 1.0, 9.0, 4.0, 3.0, 1), ("l", 5, 0.0, 20.0, 10.0, 9.0, 2)], "label string, count bigint, min double, max double, mean double, p50 double, rank int")
    df = df.select("*", *[F.col("p50").alias(p) for p in ("p1", "p5", "p95", "p99")])
    r = distributions.merge_dominant(df, ["label"]).first()
    assert (r["count"], r["mean"], r["p50"], r["min"], r["max"]) == (15, 6.0, 3.0, 0.0, 20.0)


def test_capture(spark):
    df = spark.createDataFrame([("enter", 200, 3)], "event string, generated bigint, dropped bigint")
    assert rows(quality.capture(df), "event", "received", "drop_pct") == [("enter", 197, 1.5), ("total", 197, 1.5)]
    seen = spark.createDataFrame([("enter", 10), ("exit", 5)], "event string, n bigint")
    assert ("exit", 5, 0.0) in rows(quality.capture(df, seen), "event", "received", "drop_pct")


def test_labels(spark):
    df = spark.createDataFrame([("c", 77), ("c", 9), ("d", 9), ("d", None)], "comm string, mntns_id bigint")
    by_mntns = spark.createDataFrame([(77, "web")], "mntns_id bigint, mntns_label string")
    by_comm = spark.createDataFrame([("c", "db")], "comm string, comm_label string")
    assert sorted(r.label for r in labels.resolve(df, by_mntns, by_comm).collect()) == ["d", "d", "db", "web"]
    assert sorted(r.label for r in labels.resolve(df, by_mntns, by_comm, other="other").collect()) == ["db", "other", "other", "web"]
    place = labels.ordered(spark.createDataFrame([("other",), ("b",), ("a",), ("z",)], "label string"), ["z"], ["b"])
    assert [r.label for r in place.orderBy("place").collect()] == ["z", "b", "a", "other"]


@pytest.mark.parametrize(("actual", "expected", "over", "passed"), [(101, 100, False, True), (103, 100, False, False), (103, 100, True, True), (0, 0, False, True), (1, 0, False, False)])
def test_approx(spark, actual, expected, over, passed):
    assert spark.range(1).select(quality.approx(F.lit(actual), F.lit(expected), 0.02, over)).first()[0] is passed


def test_filters(spark):
    df = spark.createDataFrame([("fio-worker", None), ("fi", "nvme0")], "comm string, disk_name string")
    got = df.select(filters.comm_matches(["fio"]), filters.comm_matches(["fio"], "contained_in"), filters.device_matches(["nvme"]), filters.comm_matches([])).collect()
    assert [tuple(r) for r in got] == [(True, False, False, True), (False, True, True, True)]


def test_device_filters_with_and(spark):
    df = spark.createDataFrame([("fio", 1, "nvme0"), ("fio", 2, "nvme0"), ("dd", 1, "nvme0"), ("fio", 1, "sda")], "comm string, mntns_id bigint, disk_name string")
    got = df.select(filters.should_trace_device(["fio"], [1], ["nvme"]).alias("a"), filters.should_trace_device(["fio"], [1], ["nvme"], either=False).alias("b"))
    assert [tuple(r) for r in got.collect()] == [(True, True), (True, False), (True, False), (True, False)]


def test_shared_folder(spark):
    from iotrace import storage

    table = storage.materialize(spark.range(3), "numbers")
    assert table.count() == 3 and storage.clean_up(spark) >= 1 and storage.clean_up(spark) == 0

    class Far:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Far()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_checks_against_truth(spark):
    values = spark.createDataFrame([("val_seqread", "rq_completed", "read", 100), ("val_seqread", "rq_total_bytes", "read", 4096), ("val_seqread", "rq_issued", "read", 110)], "job string, metric string, op string, value bigint")
    truth = spark.createDataFrame([("val_seqread", 101, 4096, 0, 0)], "job string, read_ios bigint, read_bytes bigint, write_ios bigint, write_bytes bigint")
    assert rows(quality.layer_checks(values, truth, "block"), "check", "passed") == [("bytes", True), ("completed", True), ("started", False)]
    pats = spark.createDataFrame([("val_seqread", "read", 99.0, 1.0), ("val_randread", "read", 50.0, 50.0)], "job string, op string, sequential_pct double, random_pct double")
    assert rows(quality.pattern_checks(pats), "job", "passed") == [("val_randread", False), ("val_seqread", True)]
    kinds = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0)], "r int, w int").select(quality.workload_class(F.col("r"), F.col("w")))
    assert [r[0] for r in kinds.collect()] == ["mixed", "write", "read", "read"]


def test_scalars(spark):
    r = spark.range(1).select(
        fn.suffix_number(F.lit("128K")), fn.suffix_number(F.lit("1M")), fn.suffix_number(F.lit("32")), fn.suffix_number(F.lit("x")), fn.clock(F.lit(3661)),
        fn.clock_seconds(F.lit("01:01:01")), fn.log2_floor(F.lit((1 << 53) - 1)), fn.request_type(F.lit(0x801)), fn.decode(F.lit(8), fn.SYSCALLS), fn.pointer(F.lit(255)),
    ).first()
    assert tuple(r) == (131072, 1048576, 32, None, "01:01:01", 3661, 52, "write", "lseek", "0xff")


def test_streaming_loss(spark):
    from iotrace.streaming import jobs

    df = spark.createDataFrame([("enter", s) for s in (1, 2, 5)], "event string, seq bigint")
    assert rows(jobs.loss_by_sequence(df), "event", "generated", "dropped") == [("enter", 5, 2)]


def test_heat_maps_of_an_op_share_a_scale(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.choice(["read", "write"]), rng.choice(["setup", "complete"]), rng.randrange(10**9), rng.choice([None, rng.randrange(5000)]), 512) for _ in range(800)]
    df = spark.createDataFrame(data, "label string, op string, event string, timestamp_ns bigint, sector bigint, bytes bigint")
    times, sectors = [r[3] for r in data], sorted(r[4] for r in data if r[2] == "setup" and r[4] is not None)
    low, high = (sectors[math.floor(p * (len(sectors) - 1) + 0.5)] for p in (0.01, 0.99))
    cells = Counter()
    for label, op, event, t, sector, _ in data:
        if event == "setup" and sector is not None:
            cells[label, op, (t - min(times)) * 4 // (max(times) - min(times) + 1), max(0, min(3, (sector - low) * 4 // (high - low)))] += 1
    top = {op: max(n for k, n in cells.items() if k[1] == op) for op in ("read", "write")}
    want = sorted((label, "lba_heatmap", op, float(x), float(y), round(math.log1p(n), 6), round(math.log1p(top[op]), 6)) for (label, op, x, y), n in cells.items())
    assert rows(reports.heat_series(df, ["label"], bins=4), "label", "series", "op", "x", "y", "z", "z_max") == want
    assert reports.heat_series(df.where("sector < 0"), ["label"]).count() == 0


def test_dashboard_reads_its_trace_once(spark, sf_dir):
    """Many series read the labelled rows, so those are stored: the trace is in no series' plan any more."""
    from iotrace.plans import queries

    files = {f.rsplit("/", 1)[1] for f in queries.fs_dashboard(spark, sf_dir).inputFiles()}
    assert files and "events.parquet" not in files
