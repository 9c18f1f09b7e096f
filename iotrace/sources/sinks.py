"""Writers of results: nested JSON views and CSV sections; the main sink is tidy Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nested_json(tidy: DataFrame, keys: list[str], values: list[str], out: str = "json") -> DataFrame:
    """One JSON object of ``tidy`` rows, nested by ``keys`` in order, with the ``values`` columns at the leaves.

    Levels are built from the leaves up, one aggregate each, so an object of the size of the result meets only in
    the last one. Keys are sorted; a null key is the empty text.
    """
    level = tidy.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], F.struct(*values).alias("v"))
    for depth in range(len(keys), 0, -1):
        outer, key = keys[: depth - 1], keys[depth - 1]
        by_key = lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
        entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("v").alias("value"))), by_key)
        level = level.groupBy(*outer).agg(F.map_from_entries(entries).alias("v"))
    return level.select(F.to_json("v").alias(out))


def write_json(tidy: DataFrame, keys: list[str], values: list[str], path: str) -> None:
    nested_json(tidy, keys, values, "value").write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, keys: list[str], values: str) -> DataFrame:
    """The tidy rows of a view that ``write_json`` has written: ``keys`` as text, and the fields of the DDL ``values``."""
    kind = f"struct<{values}>"
    for _ in keys:
        kind = f"map<string, {kind}>"
    rows = spark.read.text(path).select(F.from_json("value", kind).alias("v"))
    for k, key in enumerate(keys):
        rows = rows.select(*keys[:k], F.explode("v").alias(key, "v"))
    return rows.select(*keys, "v.*")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; commas within a value are quoted."""
    rows.write.mode("overwrite").option("header", True).csv(path)
