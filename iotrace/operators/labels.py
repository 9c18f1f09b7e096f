"""Labels: container by mount namespace, then by process name, then the process itself; and merging by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OTHER = "other"


def _dimension(dim: DataFrame, most: int) -> DataFrame:
    """A dimension for a broadcast if it has at most ``most`` rows, which is counted, else for an ordinary join."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def resolve(rows: DataFrame, by_mntns: DataFrame, by_comm: DataFrame, other: str | None = None, most: int = 1_000_000) -> DataFrame:
    """``rows`` with ``label``: of (mntns_id, mntns_label), else of (comm, comm_label), else the process name or ``other``."""
    out = rows.join(_dimension(by_mntns, most), "mntns_id", "left") if "mntns_id" in rows.columns else rows.withColumn("mntns_label", F.lit(None).cast("string"))
    out = out.join(_dimension(by_comm, most), "comm", "left")
    last = F.col("comm") if other is None else F.lit(other)
    return out.select(*[F.col(c) for c in rows.columns], F.coalesce("mntns_label", "comm_label", last).alias("label"))


def resolve_process(rows: DataFrame, by_tgid: DataFrame, by_command: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Resource samples with ``label``: of the process group, else of the command, else ``other``."""
    out = rows.join(_dimension(by_tgid, most), "tgid", "left").join(_dimension(by_command, most), "command", "left")
    return out.select(*[F.col(c) for c in rows.columns], F.coalesce("tgid_label", "command_label", F.lit(OTHER)).alias("label"))


def events_of(rows: DataFrame, identities: DataFrame, label: str, identity: list[str] = ("comm", "mntns_id"), most: int = 1_000_000) -> DataFrame:
    """Rows of all identities that share a label, from a table ``identities(label, *identity)``; null is an identity like any other."""
    mine = _dimension(identities.where(F.col("label") == label).select(*identity).distinct(), most)
    return rows.join(mine, [rows[c].eqNullSafe(mine[c]) for c in identity], "left_semi")


def rank_identities(values: DataFrame, identity: list[str] = ("comm", "mntns_id")) -> DataFrame:
    """``(label, *identity, total, rank)``: identities of a label by the sum of all their counters, largest first."""
    totals = values.groupBy("label", *identity).agg(F.sum("value").alias("total"))
    order = W.partitionBy("label").orderBy(F.desc("total"), *[F.col(c).asc_nulls_first() for c in identity])
    return totals.withColumn("rank", F.row_number().over(order))


def dominant(results: DataFrame, ranks: DataFrame, identity: list[str] = ("comm", "mntns_id")) -> DataFrame:
    """Results of each label's first identity only, as for series and patterns that cannot be added up."""
    first = ranks.where("rank = 1").select("label", *identity)
    same = [results[c].eqNullSafe(first[c]) for c in identity] + [results["label"] == first["label"]]
    return results.join(first, same, "left_semi")


def split_by_kind(rows: DataFrame, container_labels: DataFrame) -> DataFrame:
    """``rows`` with ``label_kind``: per_container if a container has the label, else per_comm."""
    known = container_labels.select("label").distinct().withColumn("_is", F.lit(True))
    out = rows.join(known, "label", "left")
    return out.select(*[F.col(c) for c in rows.columns], F.when(F.col("_is"), "per_container").otherwise("per_comm").alias("label_kind"))


def ordered(labels: DataFrame, containers: list[str], processes: list[str]) -> DataFrame:
    """``(label, place)``: containers and processes as given, then others by name, ``other`` last."""
    given = list(dict.fromkeys([*containers, *processes]))
    place = F.array_position(F.array(*[F.lit(x) for x in given]), F.col("label")) if given else F.lit(0)
    place = F.when(place > 0, place).otherwise(len(given) + 1)
    rank = F.row_number().over(W.orderBy(F.col("label") == OTHER, place, "label"))
    return labels.select("label").distinct().select("label", rank.alias("place"))
