"""Streams: bucket series, pairing, in-flight gauges, file positions, bounded buffers, histograms, live filters and dimensions.

A job is a streaming DataFrame from a streaming DataFrame; ``run`` starts it, goes through what the source has and
stops. Run again with the same path and checkpoint it goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrace.functions import scalars as fn
from iotrace.manifest import GrowingSet, Manifest
from iotrace.operators import labels
from iotrace.storage import exists
from iotrace.streaming import stateful

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_NS = 86_400 * fn.SECOND_NS
#: Pieces that the keys of a job are dealt to, each with the state of its keys; fixed, as checkpoints hold them.
SHARDS = 256


def _shard(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SHARDS)).cast("int").alias("shard")


def event_time(rows: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``rows`` with ``ts``, their time to the microsecond, and a watermark on it."""
    return rows.withColumn("ts", F.timestamp_micros(fn.int_div(F.col("timestamp_ns"), 1000))).withWatermark("ts", delay)


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the store that keeps it on disk; the session's setting comes back afterwards."""
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, old)


def run(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what the job makes of the files its source has now to the Parquet table ``path``; the whole table.

    The sink's log and the checkpoint go together: a micro-batch that was cut short is done again and replaces what
    it wrote, one that was complete is not.
    """
    spark = out.sparkSession
    with _state_store(spark):
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], out.schema)


def run_batches(out: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """The same for jobs that change what they have said (update, complete): rows with ``batch``, the micro-batch that said them."""
    spark = out.sparkSession
    each = lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")
    with _state_store(spark):
        out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def newest(said: DataFrame, by: list[str]) -> DataFrame:
    """Of ``run_batches`` rows in update mode the last of each group."""
    rest = [c for c in said.columns if c not in (*by, "batch")]
    last = said.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*by, *[F.col(f"_last.{c}").alias(c) for c in rest])


def bucket_series(rows: DataFrame, by: list[str], gauge: str, width: str = "1 second") -> DataFrame:
    """``(*by, bucket, n, gauge)``: events and the last gauge value of each bucket.

    In append and update mode the watermark bounds what is kept: with ``event_time(rows, "7200 seconds")`` the state
    holds the last 7,200 one-second buckets, older ones leave it, and events that come for them are not counted.
    """
    return rows.groupBy(*by, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.max_by(gauge, "timestamp_ns").alias(gauge)).select(
        *by, F.col("w.start").alias("bucket"), "n", gauge
    )


def latest_buckets(series: DataFrame, most: int = 7200, width: str = "1 second") -> DataFrame:
    """The rows of a bucket series that are among the last ``most`` buckets of the run."""
    last = series.agg(F.max("bucket").alias("_last"))
    return series.join(F.broadcast(last)).where(F.col("bucket") > F.col("_last") - F.expr(f"interval {width}") * most).drop("_last")


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(*by, lo, count, total)``: counts and sums by power of two, one small state a bucket."""
    v = F.col(value).cast("bigint")
    lo = F.when(v > 0, fn.power_of_two(fn.log2_floor(v))).otherwise(0)
    return rows.where(v.isNotNull()).groupBy(*by, lo.alias("lo")).agg(F.count("*").alias("count"), F.sum(v).alias("total"))


def _column(rows: DataFrame, name: str, kind: str, default: Column | None = None) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None) if default is None else default).cast(kind).alias(name)


def _timed(rows: DataFrame, ttl_ns: int | None, delay: str) -> tuple[DataFrame, str]:
    """Rows with a watermark, and the time mode, for jobs that give up what is older than ``ttl_ns``."""
    return (rows, "None") if ttl_ns is None else (event_time(rows, delay), "EventTime")


def moves(rows: DataFrame, key: str, start: str, end: str, ttl_ns: int | None = DAY_NS, delay: str = "10 minutes") -> DataFrame:
    """``stateful.MOVES`` of the starts of a key, their ends, and starts given up ``ttl_ns`` after they began.

    The latest start counts and an end uses it up; at equal times starts come first, then rows go by ``seq``. Rows
    without a key pair with nothing and are left out. With a ``ttl_ns`` events must not be later than ``delay``.
    """
    rows, mode = _timed(rows.where(F.col("event").isin(start, end) & F.col(key).isNotNull()), ttl_ns, delay)
    more = ["ts"] if mode == "EventTime" else []
    rows = rows.select(
        F.col(key).cast("string").alias("key"), "timestamp_ns", (F.col("event") == end).cast("int").alias("role"), _column(rows, "seq", "bigint", F.lit(0)),
        _column(rows, "op", "string"), _column(rows, "comm", "string"), *more,
    )
    return rows.select(_shard("key"), "*").groupBy("shard").transformWithStateInPandas(stateful.Pairing(ttl_ns), stateful.MOVES, "Append", mode)


def pair(rows: DataFrame, key: str, start: str, end: str, ttl_ns: int | None = DAY_NS, delay: str = "10 minutes") -> DataFrame:
    """``(key, start_ns, end_ns)`` of ends with a start."""
    found = moves(rows, key, start, end, ttl_ns, delay).where("kind = 'end'")
    return found.select("key", "start_ns", F.col("timestamp_ns").alias("end_ns"))


def in_flight(rows: DataFrame, key: str, start: str, end: str, ttl_ns: int | None = DAY_NS, delay: str = "10 minutes") -> DataFrame:
    """``(op, comm, timestamp_ns, in_flight)`` after each start, each matched end and each start given up.

    An end counts for op and process of its start, and only if the trace has that.
    """
    found = moves(rows, key, start, end, ttl_ns, delay)
    return found.groupBy("op", "comm").transformWithStateInPandas(stateful.Level(), stateful.LEVELS, "Append", "None")


def file_positions(rows: DataFrame, ttl_ns: int | None = 7 * DAY_NS, delay: str = "10 minutes") -> DataFrame:
    """``(tid, fd, timestamp_ns, syscall, position)`` of read and write enters, with the position kept by (thread, fd).

    An openat that returns puts the descriptor it returns at 0, an lseek at what it returns; a position that
    nothing has touched for ``ttl_ns`` is given up.
    """
    rows, mode = _timed(rows, ttl_ns, delay)
    opened = (F.col("event") == "exit") & (F.col("syscall") == "openat")
    fd = F.when(opened, F.col("bytes").cast("bigint")).otherwise(F.col("fd").cast("bigint"))
    more = ["ts"] if mode == "EventTime" else []
    rows = rows.select("tid", fd.alias("fd"), "timestamp_ns", _column(rows, "seq", "bigint", F.lit(0)), "event", "syscall", F.col("bytes").cast("bigint").alias("bytes"), *more)
    rows = rows.where("tid is not null and fd >= 0").select(_shard("tid", "fd"), "*")
    return rows.groupBy("shard").transformWithStateInPandas(stateful.Position(ttl_ns), stateful.POSITIONS, "Append", mode)


def admitted(rows: DataFrame, key: str, capacity: int, poll_ns: int) -> DataFrame:
    """``(key, timestamp_ns, seq, admitted)``: which events find room in their key's buffer, emptied every ``poll_ns``.

    Of the events of an interval the first ``capacity`` are admitted and the rest dropped; nothing is lost uncounted.
    """
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), "timestamp_ns", _column(rows, "seq", "bigint", F.lit(0)))
    out = "key string, timestamp_ns bigint, seq bigint, admitted boolean"
    return rows.groupBy("key").transformWithStateInPandas(stateful.Admission(capacity, poll_ns), out, "Append", "None")


def with_current_labels(rows: DataFrame, dimension: Callable[[SparkSession], tuple[DataFrame, DataFrame]], sink: Callable[[DataFrame, int], None]):
    """A stream writer that labels each micro-batch with the container dimension as it is read at that moment."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(labels.resolve(batch, *dimension(batch.sparkSession)), batch_id)

    return rows.writeStream.foreachBatch(each)


SIGHTINGS = "label string, kind string, id string, since_ns bigint"


def sightings(rows: DataFrame) -> DataFrame:
    """``SIGHTINGS``: the ids of (label, tgid, mntns_id, comm) rows, each with its time, 0 where rows have none."""
    since = F.col("timestamp_ns") if "timestamp_ns" in rows.columns else F.lit(0)
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id")) for c in ("tgid", "mntns_id", "comm") if c in rows.columns]
    return rows.select("label", F.explode(F.array(*kinds)).alias("x"), since.cast("bigint").alias("since_ns")).select("label", "x.kind", "x.id", "since_ns").where("id is not null")


def gather_containers(rows: DataFrame, folder: str, checkpoint: str, compact_after: int = 16) -> GrowingSet:
    """Add the container ids that the sightings of a stream show to the growing set in ``folder``; an id with the time it was first seen.

    A micro-batch writes the ids that no earlier one has, and nothing of those that it has seen before.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy("label", "kind", "id").agg(F.min("since_ns").alias("since_ns"))
        inventory(batch.sparkSession, folder, compact_after).add(first, batch_id)

    rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
    return inventory(rows.sparkSession, folder, compact_after)


def inventory(spark: SparkSession, folder: str, compact_after: int = 16) -> GrowingSet:
    return GrowingSet(spark, folder, SIGHTINGS, ["label", "kind", "id"], compact_after)


def live_filter(batch: DataFrame, known: GrowingSet, version: int | None = None) -> DataFrame:
    """The rows of a micro-batch whose ``mntns_id`` was discovered at their time or before; others are dropped.

    ``version`` of the inventory fixes what was known, so a repeated micro-batch keeps the same rows. A busy
    container is no hot key: the ids are broadcast where they are counted few, else Spark joins as it sees fit.
    """
    ids = known.read(version).where("kind = 'mntns_id'").groupBy(F.col("id").cast("bigint").alias("_id")).agg(F.min("since_ns").alias("_since"))
    ids = F.broadcast(ids) if known.small(version) else ids
    return batch.join(ids, (F.col("mntns_id") == F.col("_id")) & (F.col("timestamp_ns") >= F.col("_since")), "left_semi")


def run_filtered(rows: DataFrame, folder: str, path: str, checkpoint: str) -> DataFrame:
    """Rows of a stream that pass ``live_filter`` with the inventory as each micro-batch finds it; the table so far.

    Which version a micro-batch used is written before its rows, and used again if it is repeated.
    """
    spark = rows.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        known, used = inventory(s, folder), Manifest(s, f"{checkpoint}/used")
        told = used.read(batch_id)
        version = told.first()["v"] if told is not None else max(known.manifest.versions(), default=-1)
        if told is None:
            used.commit(s.createDataFrame([(version,)], "v int"), batch_id)
        live_filter(batch, known, version).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/*")


def loss_by_sequence(rows: DataFrame) -> DataFrame:
    """``(event, generated, dropped)`` from per-event sequence numbers: what lies between first and last and did not arrive."""
    span = F.max("seq") - F.min("seq") + 1
    return rows.groupBy("event").agg(span.alias("generated"), (span - F.count("*")).alias("dropped"))
