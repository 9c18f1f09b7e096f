"""Predicates on traces. Each returns a boolean column, false where a value is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(parts: list[Column], empty: bool) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False)) if parts else F.lit(empty)


def event_is(*kinds: str) -> Column:
    return F.coalesce(F.col("event").isin(*kinds), F.lit(False))


def comm_matches(names: list[str], match: str = "contains", column: str = "comm") -> Column:
    """Process names against filter texts: ``contains`` any of them, or ``contained_in`` any of them; no texts keep all."""
    if match not in ("contains", "contained_in"):
        raise ValueError(match)
    col = F.col(column)
    return _any([col.contains(n) if match == "contains" else F.lit(n).contains(col) for n in names], True)


def device_matches(names: list[str], column: str = "disk_name") -> Column:
    """Device names that contain any of the texts; no texts keep all, and then a null name too."""
    return _any([F.col(column).contains(n) for n in names], True)


def container_matches(ids: list[int], column: str = "mntns_id") -> Column:
    return _any([F.col(column).isin(*ids)] if ids else [], True)


def in_containers(rows: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows whose mount namespace is in a table of ids; the table is broadcast if it has at most ``most`` rows."""
    ids = ids.select("mntns_id").distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, "mntns_id", "left_semi")


def should_trace(names: list[str], ids: list[int], either: bool | None = None) -> Column:
    """Process and container filters: with both, either one is enough unless ``either`` is False."""
    either = bool(names and ids) if either is None else either
    a, b = comm_matches(names), container_matches(ids)
    return (a | b) if either and names and ids else (a & b)


def should_trace_device(names: list[str], ids: list[int], devices: list[str], either: bool | None = None) -> Column:
    """As ``should_trace``, with devices: (device and process) or container, else all three."""
    either = bool(names and ids) if either is None else either
    a, b, c = comm_matches(names), container_matches(ids), device_matches(devices)
    return ((c & a) | b) if either and names and ids else (a & b & c)


def positive(column: str) -> Column:
    return F.coalesce(F.col(column) > 0, F.lit(False))


def listed_or_other(column: str, names: list[str], other: str = "other") -> Column:
    """The value if it is listed, else ``other``; no list keeps all."""
    return F.when(F.col(column).isin(*names), F.col(column)).otherwise(other) if names else F.col(column)
