"""Running sums and last values within groups of any size: windows over slices of a group, and what lies before each slice.

A slice is summarised in one row (the sum, the last value), the summaries of a group are composed in order, and each
slice is given what lies before it. So no task sees all rows of a group. The windows, the summaries and the join
have the same keys, so rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.functions import scalars as fn

#: How long slices of time are.
SLICE_NS = 3600 * fn.SECOND_NS


def time_slice(slice_ns: int = SLICE_NS, column: str = "timestamp_ns") -> Column:
    return fn.int_div(F.col(column), slice_ns)


def sliced(rows: DataFrame, key: list[str], piece: Column) -> DataFrame:
    """``rows`` with ``_key`` and ``_slice``, for several scans in a row: those keep the columns, and rows move once for all."""
    return rows.withColumns({"_key": F.struct(*key) if key else F.struct(F.lit(0)), "_slice": piece})


def _before():
    return W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)


def _given(rows: DataFrame, summaries: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with what the slices before theirs come to."""
    return rows.join(summaries.select("_key", "_slice", *names), ["_key", "_slice"], "left")


def running_sums(rows: DataFrame, key: list[str], piece: Column, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, under each name, the sum of its column up to this row of the group; null counts as 0.

    ``order`` sorts a slice, and ``piece``, which slice a row is in, must never fall along the order of the group.
    Null keys are groups too. Rows that are equal in ``order`` come in any order.
    """
    cut = () if "_key" in rows.columns else ("_key", "_slice")
    out = sliced(rows, key, piece) if cut else rows
    totals = out.groupBy("_key", "_slice").agg(*[F.sum(x).alias(f"_sum_{c}") for c, x in sums.items()])
    before = {f"_before_{c}": F.sum(f"_sum_{c}").over(_before()) for c in sums}
    w = W.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumns({c: F.sum(x).over(w) for c, x in sums.items()})
    out = _given(out, totals.withColumns(before), list(before))
    zero = F.lit(0)
    whole = {c: F.coalesce(F.col(c), zero) + F.coalesce(F.col(f"_before_{c}"), zero) for c in sums}
    return out.withColumns(whole).drop(*cut, *before)


def last_values(rows: DataFrame, key: list[str], piece: Column, order: list[str], values: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """``rows`` with, under each name, the last value of its column that is not null before this row of the group.

    With ``inclusive`` the row itself counts. Otherwise as ``running_sums``.
    """
    cut = () if "_key" in rows.columns else ("_key", "_slice")
    out = sliced(rows, key, piece) if cut else rows
    at = F.struct(*order)
    ends = out.groupBy("_key", "_slice").agg(*[F.max_by(x, F.when(x.isNotNull(), at)).alias(f"_end_{c}") for c, x in values.items()])
    before = {f"_before_{c}": F.last(f"_end_{c}", ignorenulls=True).over(_before()) for c in values}
    w = W.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = out.withColumns({c: F.last(x, ignorenulls=True).over(w) for c, x in values.items()})
    out = _given(out, ends.withColumns(before), list(before))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_before_{c}")) for c in values}).drop(*cut, *before)
