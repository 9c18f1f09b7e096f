"""Running sums, last values and ranks over slices and parts, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from iotrace.operators import access, lifecycle, ranks, scans
from iotrace.sources import text


def events(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), i * 10 + rng.randrange(3), rng.choice([None, 1, 2, -5])) for i in range(n)]


@pytest.mark.parametrize("slice_ns", [1, 70, 10**9])
def test_scans_equal_a_plain_loop(spark, slice_ns):
    rows = events(1, 300)
    want, total, last = [], {}, {}
    for k, t, v in rows:
        before = last.get(k)
        total[k] = total.get(k, 0) + (v or 0)
        last[k] = v if v is not None else before
        want.append((t, total[k], before, last[k]))
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint").repartition(5)
    piece = scans.time_slice(slice_ns, "t")
    out = scans.running_sums(scans.sliced(df, ["k"], piece), ["k"], piece, ["t"], {"total": F.col("v")})
    out = scans.last_values(out, ["k"], piece, ["t"], {"before": F.col("v")})
    out = scans.last_values(out.drop("_key", "_slice"), ["k"], piece, ["t"], {"now": F.col("v")}, inclusive=True)
    assert sorted(map(tuple, out.select("t", "total", "before", "now").collect())) == want


def test_no_window_goes_over_a_whole_key(spark):
    """Pairs, gaps and positions are the same from slices of any length, and their windows have the slice as a key."""
    rng = random.Random(2)
    rows = [(1, 3, 100 * i, i, *rng.choice([("enter", "read"), ("exit", "read"), ("exit", "lseek"), ("enter", "close"), ("enter", "pread64")]), rng.choice([None, 0, 7, 64]), 8 * i) for i in range(400)]
    df = spark.createDataFrame(rows, 'tid bigint, fd int, timestamp_ns bigint, seq bigint, event string, syscall string, bytes bigint, offset bigint').withColumn("comm", F.lit("c"))
    order = ["timestamp_ns", "seq"]
    jobs = {
        "pair": lambda n: lifecycle.pair(df, ["tid"], F.col("event") == "enter", F.col("event") == "exit", order, slice_ns=n).select("seq", "start_ns"),
        "offset": lambda n: access.by_offset(df, ["comm"], order=order, slice_ns=n),
        "position": lambda n: access.file_positions(df, ["comm"], order, slice_ns=n).select("seq", "position"),
        "pattern": lambda n: access.by_position(df, ["comm"], order, slice_ns=n),
    }
    for name, job in jobs.items():
        got = [sorted(map(tuple, job(n).collect()), key=repr) for n in (500, 10**12)]
        assert got[0] == got[1] and got[0], name
        windows = [x for x in job(500)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
        assert windows and all("_slice" in x for x in windows)


@pytest.mark.parametrize("most", [50_000, 20, 1])
def test_ranks_of_close_values(spark, most):
    """Values within two per cent of each other, ties, a tiny group and an empty one: parts of a group are many."""
    rng = random.Random(3)
    rows = [("near", 10**9 + rng.randrange(2 * 10**7)) for _ in range(1500)] + [("near", 10**9)] * 40 + [("one", 5)] + [("none", None)] + [(None, -3), (None, 4)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(3)
    got = sorted(map(tuple, ranks.counted(df, ["k"], "v", most).collect()), key=repr)
    want = []
    for k in {k for k, _ in rows}:
        vs = sorted(v for q, v in rows if q == k and v is not None)
        want += [(k, v, vs.count(v), sum(x <= v for x in vs), len(vs)) for v in set(vs)]
    assert got == sorted(want, key=repr)
    if most == 20:
        cut = ranks._cut(df.where("k = 'near'").distinct().select("v").withColumnRenamed("v", "value").withColumn("_key", F.lit(1)), "_key", "_part", most)
        sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
        assert len(sizes) > 50 and max(sizes) < 100


REPORT = """@a[x]:
[1, 2)  5 |@|
[2, 4)  6 |@|
lost 3 events
[4, 8)  9 |@|

@n[x]: 4
@s[y]:
00:00:01 | * | 1
hh:mm:ss ____
00:00:02 | * | 2
00:00:03 | * | 3
hh:mm:ss ____
00:00:04 | * | 4
v____v
hh:mm:ss ____
00:00:05 | * | 5
@n[x]: 7
Linux 6.1 (host)
12:00:00 UID TGID TID %usr %system %guest %wait %CPU CPU Command
12:00:01 0 10 - 1 2 3 4 5 6 main prog
12:00:01 0 - 11 1 2 3 4 5 7 |__worker
12:00:01 UID TGID TID minflt/s majflt/s VSZ RSS %MEM Command
12:00:01 0 12 - 1 2 3 4 5 other
12:00:01 UID TGID TID %usr %system %guest %wait %CPU CPU Command
12:00:02 0 - 13 1 2 3 4 5 8 |__late
"""


def test_a_report_in_many_ranges(spark, tmp_path):
    """One file cut into ranges of some lines, or of less than one, gives the rows that it gives whole."""
    path = tmp_path / "report.txt"
    path.write_text("\n".join(REPORT.replace("[x]", f"[x{i}]").replace("[y]", f"[y{i}]").replace(" 10 -", f" {100 + i} -") for i in range(30)))

    def parsed():
        rows = text.lines(spark, f"file://{path}")
        out = [text.counters(rows), text.histograms(rows), text.series(rows).drop("place"), text.pidstat(rows).drop("place")]
        return rows.select("start").distinct().count(), [sorted(map(tuple, x.drop("file").collect()), key=repr) for x in out]

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole, want = parsed()
    try:
        for size in (3000, 700, 61):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            ranges, got = parsed()
            assert ranges > 5 and got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert whole <= 4
    counters, hist, series, pid = want
    assert counters == sorted([("n", f"x{i}", 7) for i in range(30)], key=repr)
    assert len(hist) == 60 and {r[:2] for r in hist} == {("a", f"x{i}") for i in range(30)}
    assert sorted(r[-1] for r in series) == sorted([2, 3, 4] * 30)
    assert {(r[0], r[3], r[4], r[6]) for r in pid if r[4] == "13"} == {("cpu", str(100 + i), "13", "main prog") for i in range(30)}
