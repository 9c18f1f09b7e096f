"""Small JSON inputs: container maps, capture counters, ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTAINER = "tgids array<string>, pids array<string>, mntns_ids array<bigint>, comms array<string>"


def _whole(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path, wholetext=True).select("value")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def containers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(label, ordinal, tgids, mntns_ids, comms)`` of a container map, in file order; a missing or invalid file has none.

    Of several paths, such as a run's map and one beside its samples, the first that exists counts. Containers hold
    objects, whose process groups may go by their older name ``pids``, or bare lists of process names.
    """
    found = (_whole(spark, p) for p in ([path] if isinstance(path, str) else path))
    text = next((t for t in found if t is not None), None)
    if text is None:
        return spark.createDataFrame([], "label string, ordinal int, tgids array<string>, mntns_ids array<bigint>, comms array<string>")
    bodies = F.from_json("value", "containers map<string, string>")["containers"]
    rows = text.select(F.posexplode(bodies).alias("ordinal", "label", "body"))
    rows = rows.withColumn("c", F.from_json("body", _CONTAINER)).withColumn("bare", F.from_json("body", "array<string>"))
    comms = F.coalesce(F.when(F.col("body").startswith("["), F.col("bare")), F.col("c.comms"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.select(
        "label", "ordinal", F.coalesce("c.tgids", "c.pids", none("string")).alias("tgids"),
        F.coalesce("c.mntns_ids", none("bigint")).alias("mntns_ids"), F.coalesce(comms, none("string")).alias("comms"),
    )


def mntns_labels(dims: DataFrame) -> DataFrame:
    """``(mntns_id, mntns_label)``; the later container has an id that two claim."""
    rows = dims.select("ordinal", "label", F.explode("mntns_ids").alias("mntns_id"))
    return rows.groupBy("mntns_id").agg(F.max_by("label", "ordinal").alias("mntns_label"))


def comm_labels(dims: DataFrame) -> DataFrame:
    """``(comm, comm_label)`` of containers without mount namespaces; the later container has a shared name."""
    rows = dims.where(F.size("mntns_ids") == 0).select("ordinal", "label", F.explode("comms").alias("comm"))
    return rows.groupBy("comm").agg(F.max_by("label", "ordinal").alias("comm_label"))


def process_labels(dims: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(tgid, tgid_label)`` and ``(command, command_label)``; here the first container has what two claim.

    ``names`` adds processes that stand for themselves unless a container has them.
    """
    first = lambda col, key, label: dims.select("ordinal", "label", F.explode(col).alias(key)).groupBy(key).agg(F.min_by("label", "ordinal").alias(label))
    tgids, comms = first("tgids", "tgid", "tgid_label"), first("comms", "command", "command_label")
    if names:
        own = dims.sparkSession.createDataFrame([(n, n) for n in dict.fromkeys(names)], "command string, command_label string")
        comms = comms.unionByName(own.join(comms, "command", "left_anti"))
    return tgids, comms


def capture_counters(spark: SparkSession, path: str) -> DataFrame:
    """``(event, generated, dropped)``; counters that the file lacks are 0."""
    text = _whole(spark, path)
    if text is None:
        return spark.createDataFrame([], "event string, generated bigint, dropped bigint")
    rows = text.select(F.explode(F.from_json("value", "map<string, struct<generated: bigint, dropped: bigint>>")).alias("event", "c"))
    return rows.select("event", F.coalesce("c.generated", F.lit(0)).alias("generated"), F.coalesce("c.dropped", F.lit(0)).alias("dropped"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(job, read_ios, read_bytes, write_ios, write_bytes)`` of the first job of each workload report."""
    side = "struct<total_ios: bigint, io_bytes: bigint>"
    rows = spark.read.schema(f"jobs array<struct<jobname: string, read: {side}, write: {side}>>").option("multiLine", True).json(path)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.select(F.get("jobs", F.lit(0)).alias("j")).select(
        F.col("j.jobname").alias("job"), n(F.col("j.read.total_ios")).alias("read_ios"), n(F.col("j.read.io_bytes")).alias("read_bytes"),
        n(F.col("j.write.total_ios")).alias("write_ios"), n(F.col("j.write.io_bytes")).alias("write_bytes"),
    )
