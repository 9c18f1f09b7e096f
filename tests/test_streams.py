"""Streaming jobs over many micro-batches: against plain replays, after a kill, and with state given up."""

import glob
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from iotrace.manifest import GrowingSet
from iotrace.streaming import jobs, stateful

BASE = 1_000_000 * 10**9
SECOND = 10**9


class Source:
    """A folder that files of rows arrive in, one a micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        os.makedirs(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        time.sleep(0.02)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


BLOCK = "key string, timestamp_ns bigint, event string, seq bigint, op string, comm string"


def requests(seed, n):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(12)}", BASE + i * SECOND, rng.choice(["issue", "complete"]), i, rng.choice(["read", None]), f"c{rng.randrange(3)}") for i in range(n)]


def plain_pairs(rows):
    held, pairs, level, levels = {}, [], {}, []
    for key, t, event, _, op, comm in rows:
        if event == "issue":
            held[key] = (t, op, comm)
            who, d = (op, comm), 1
        elif key in held:
            start, *who = held.pop(key)
            pairs.append((key, start, t))
            who, d = tuple(who), -1
        else:
            continue
        level[who] = level.get(who, 0) + d
        levels.append((*who, t, level[who]))
    return sorted(pairs), sorted(levels, key=repr)


def test_jobs_go_on_after_a_kill(spark, tmp_path):
    rows = requests(1, 300)
    src = Source(spark, tmp_path / "in", BLOCK)
    paths = {n: (str(tmp_path / n), str(tmp_path / f"{n}-state")) for n in ("pairs", "levels")}
    job = {
        "pairs": lambda: jobs.pair(src.stream(), "key", "issue", "complete", ttl_ns=None),
        "levels": lambda: jobs.in_flight(src.stream(), "key", "issue", "complete", ttl_ns=None),
    }
    ran = lambda n: sorted(map(tuple, jobs.run(job[n](), *paths[n]).collect()), key=repr)
    for a in (0, 90):
        src.add(random.Random(a).sample(rows[a : a + 90], 90))
    for n, want in zip(job, plain_pairs(rows[:180]), strict=True):
        assert ran(n) == sorted(want, key=repr)
    for a, b in ((180, 240), (240, 300)):
        src.add(rows[a:b])
    for n, want in zip(job, plain_pairs(rows), strict=True):
        assert ran(n) == sorted(want, key=repr)
        # as if killed before the last micro-batch was committed: it is done again and nothing is there twice
        last = max(glob.glob(f"{paths[n][1]}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
        os.remove(last)
        for crc in glob.glob(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
            os.remove(crc)
        assert ran(n) == sorted(want, key=repr)


def test_starts_are_given_up(spark, tmp_path):
    src = Source(spark, tmp_path / "in", BLOCK)
    at = lambda key, s, event: (key, BASE + s * SECOND, event, s, "read", "c")
    for rows in ([at("a", 0, "issue"), at("b", 1, "issue")], [at("c", 100, "issue"), at("b", 20, "complete")], [at("z", 101, "issue")], [at("a", 102, "complete"), at("c", 103, "complete")]):
        src.add(rows)
    job = lambda f: f(src.stream(), "key", "issue", "complete", ttl_ns=30 * SECOND, delay="1 second")
    moves = jobs.run(job(jobs.moves), str(tmp_path / "m"), str(tmp_path / "ms")).where("kind <> 'start'").orderBy("timestamp_ns")
    got = [(r.key, r.kind, (r.timestamp_ns - BASE) // SECOND) for r in moves.collect()]
    assert got == [("b", "end", 20), ("a", "given_up", 30), ("c", "end", 103)]
    levels = jobs.run(job(jobs.in_flight), str(tmp_path / "l"), str(tmp_path / "ls")).collect()
    assert min(r.in_flight for r in levels) == 1 and {(r.timestamp_ns - BASE) // SECOND: r.in_flight for r in levels}[103] == 1


FS = "tid bigint, fd int, timestamp_ns bigint, seq bigint, event string, syscall string, bytes bigint"


def test_positions_over_micro_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        call, event = rng.choice([("read", "enter"), ("read", "exit"), ("write", "enter"), ("write", "exit"), ("openat", "exit"), ("lseek", "exit"), ("close", "enter")])
        size = rng.choice([None, 0, 3, 4]) if call == "openat" else rng.choice([None, 0, 100, 512])
        rows.append((rng.randrange(2), None if call == "openat" else rng.choice([3, 4]), BASE + i * SECOND, i, event, call, size))
    at, want = {}, []
    for tid, fd, t, _, event, call, size in rows:
        key = (tid, size if call == "openat" else fd)
        if event == "enter":
            if call == "close":
                at.pop(key, None)
            elif key in at:
                want.append((*key, t, call, at[key]))
        elif size is not None:
            if call in ("openat", "lseek"):
                at[key] = 0 if call == "openat" else size
            elif key in at:
                at[key] += size
    src = Source(spark, tmp_path / "in", FS)
    for a in range(0, 400, 100):
        src.add(rng.sample(rows[a : a + 100], 100))
    got = jobs.run(jobs.file_positions(src.stream(), ttl_ns=None), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_untouched_positions_are_given_up(spark, tmp_path):
    src = Source(spark, tmp_path / "in", FS)
    at = lambda tid, s, event, call, size=None: (tid, 3 if call != "openat" else None, BASE + s * SECOND, s, event, call, size)
    for rows in ([at(1, 0, "exit", "openat", 3), at(2, 0, "exit", "openat", 3)], [at(2, 50, "exit", "read", 7)], [at(9, 70, "exit", "openat", 3)], [at(1, 71, "enter", "read"), at(2, 72, "enter", "read")]):
        src.add(rows)
    got = jobs.run(jobs.file_positions(src.stream(), ttl_ns=40 * SECOND, delay="1 second"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(r.tid, r.position) for r in got.collect()] == [(2, 7)]


def test_series_state_holds_the_last_buckets(spark, tmp_path):
    src = Source(spark, tmp_path / "in", "op string, timestamp_ns bigint, gauge bigint")
    for a in range(0, 1200, 200):
        src.add([(op, BASE + i * SECOND, i) for i in range(a, a + 200) for op in ("read", "write")])
    out = jobs.bucket_series(jobs.event_time(src.stream(), "50 seconds"), ["op"], "gauge", "1 second")
    sizes = []
    query = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "s")).foreachBatch(lambda b, i: b.count()).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # what one micro-batch brings, and the kept buckets of two request types
    assert max(sizes) <= 2 * (200 + 52) and sizes[-1] <= 2 * (200 + 52)
    said = jobs.run_batches(out, str(tmp_path / "o"), str(tmp_path / "os"), "update")
    kept = jobs.latest_buckets(jobs.newest(said, ["op", "bucket"]), 50, "1 second")
    assert sorted((r.op, r.gauge) for r in kept.collect()) == sorted((op, i) for op in ("read", "write") for i in range(1150, 1200))


@pytest.mark.parametrize("capacity", [1, 3, 100])
def test_drops_equal_a_plain_replay(spark, tmp_path, capacity):
    rng = random.Random(4)
    times = sorted(rng.randrange(40 * SECOND) for _ in range(400))
    rows = [(rng.choice(["x", "y"]), BASE + t, i) for i, t in enumerate(times)]
    used, want = {}, []
    for kind, t, i in rows:
        slot = (kind, t // (2 * SECOND))
        used[slot] = used.get(slot, 0) + 1
        want.append((kind, t, i, used[slot] <= capacity))
    src = Source(spark, tmp_path / "in", "event string, timestamp_ns bigint, seq bigint")
    for a in range(0, 400, 130):
        src.add(rng.sample(rows[a : a + 130], len(rows[a : a + 130])))
    got = jobs.run(jobs.admitted(src.stream(), "event", capacity, 2 * SECOND), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_batch_writes_what_it_adds(spark, tmp_path):
    folder = str(tmp_path / "set")
    known = GrowingSet(spark, folder, "id string, n bigint", ["id"], compact_after=3)
    rows = lambda *ids: spark.createDataFrame([(i, len(i or "")) for i in ids], "id string, n bigint")
    ids = lambda v=None: sorted((r.id for r in known.read(v).collect()), key=repr)
    assert known.add(rows("a", "bb", None), 0) == 3 and known.add(rows("a", "ccc", None), 1) == 1
    assert spark.read.parquet(f"{folder}/part-00000001").count() == 1
    assert known.add(rows("a", "ccc", "d"), 1) == 2, "a repeated batch replaces what it wrote"
    assert ids() == sorted([None, "a", "bb", "ccc", "d"], key=repr) and ids(0) == sorted([None, "a", "bb"], key=repr)
    assert known.add(rows("a"), 2) == 0
    assert [known.add(rows(f"x{b}"), b) for b in (3, 4, 5)] == [1, 1, 1]
    assert len(known.parts()) <= 3 and len(ids()) == 8 and known.add(rows("x3", "bb"), 6) == 0


def test_live_filter_drops_rows_before_discovery(spark, tmp_path):
    seen = Source(spark, tmp_path / "seen", "label string, mntns_id bigint, timestamp_ns bigint")
    src = Source(spark, tmp_path / "in", "mntns_id bigint, timestamp_ns bigint")
    folder, out = str(tmp_path / "ids"), (str(tmp_path / "out"), str(tmp_path / "state"))
    watch = lambda: jobs.gather_containers(jobs.sightings(seen.stream()), folder, str(tmp_path / "watch"))
    rows = lambda: sorted(map(tuple, jobs.run_filtered(src.stream(), folder, *out).collect()))
    src.add([(1, 5), (2, 5)])
    assert rows() == []
    seen.add([("web", 1, 10), ("web", 1, 30)])
    watch()
    src.add([(1, 9), (1, 10), (2, 10), (None, 11)])
    assert rows() == [(1, 10)]
    seen.add([("db", 2, 20), ("web", 1, 2)])
    watch()
    src.add([(1, 11), (2, 19), (2, 21)])
    src.add([(2, 22)])
    assert rows() == [(1, 10), (1, 11), (2, 21), (2, 22)]
    assert len(watch().manifest.versions()) == 2


def test_streams_without_files(spark, tmp_path):
    src = Source(spark, tmp_path / "in", BLOCK)
    assert jobs.run(jobs.pair(src.stream(), "key", "issue", "complete"), str(tmp_path / "o"), str(tmp_path / "s")).count() == 0
    out = jobs.histogram(src.stream().withColumn("bytes", F.lit(1)), ["op"], "bytes")
    assert jobs.run_batches(out, str(tmp_path / "b"), str(tmp_path / "bs"), "update").count() == 0


class Held:
    """State of one shard in memory: a list or a value, and how often it was asked or told."""

    def __init__(self):
        self.rows, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.rows is not None

    def get(self):
        self.calls += 1
        return self.rows

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def clear(self):
        self.calls, self.rows = self.calls + 1, None


def test_a_shard_costs_no_calls_by_key():
    """The keys of a shard are paired together over micro-batches, with as many calls to the state store for a thousand as for one."""
    calls = {}
    for keys in (1, 1000):
        rng, state = random.Random(5), Held()
        rows = [(f"k{rng.randrange(keys)}", 1_704_068_166_738_090_001 + i, rng.choice(["issue", "complete"]), i, "read", "c") for i in range(3000)]
        job = stateful.Pairing(None)
        job.init(type("Handle", (), {"getListState": lambda *_, state=state: state})())
        out = []
        for a in range(0, 3000, 1000):
            part = pd.DataFrame(rows[a : a + 1000], columns=["key", "timestamp_ns", "event", "seq", "op", "comm"])
            part["role"] = (part.pop("event") == "complete").astype("int32")
            out += [d for d in job.handleInputRows((0,), iter([part.sample(frac=1, random_state=a)]), None)]
        ends = pd.concat(out).query("kind == 'end'")
        assert sorted(zip(ends["key"], ends["start_ns"], ends["timestamp_ns"])) == plain_pairs(rows)[0]
        calls[keys] = state.calls
    assert calls[1000] <= calls[1] + 3
