"""Helpers shared by the corpus operators: text columns, id buckets, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.storage import materialize

#: The white space that separates words (space, tab to carriage return).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % modulus).cast("int"), F.lit(-1))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a bigint, b bigint)`` as ``(node, component)``, component the least node.

    Alternates large-star and small-star steps, each two aggregates and joins; every round is written to the
    shared folder, so the plan stays short and a lost executor costs one round. No edges give no rows.
    """
    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u")
        cur = materialize(
            hooked.select("u", F.col("m").alias("v"))
            .unionByName(hooked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
