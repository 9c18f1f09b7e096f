"""Access patterns: sequential or random, and file positions rebuilt from system calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.functions import scalars as fn
from iotrace.operators import scans
from iotrace.operators.scans import SLICE_NS
from iotrace.storage import materialize

def gaps(rows: DataFrame, by: list[str], position: str, length: Column, order: list[str] = ("timestamp_ns",), slice_ns: int = SLICE_NS) -> DataFrame:
    """``rows`` that have a position, with ``gap``: how far each starts from where the one before it ended; null for the first.

    Windows go over slices of ``slice_ns``, so that a busy group is many of them. ``order`` begins with timestamp_ns.
    """
    rows = rows.where(F.col(position).isNotNull())
    out = scans.last_values(rows, list(by), scans.time_slice(slice_ns), list(order), {"_end": F.col(position) + length})
    return out.withColumn("gap", F.abs(F.col(position) - F.col("_end"))).drop("_end")


def classify(gapped: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, total_ios, sequential_count, random_count, sequential_pct, random_pct)``: a gap of 0 is sequential."""
    out = gapped.groupBy(*by).agg(
        F.count("*").alias("total_ios"), F.count_if(F.col("gap") == 0).alias("sequential_count"), F.count_if(F.col("gap") > 0).alias("random_count")
    )
    n = F.col("sequential_count") + F.col("random_count")
    return out.withColumn("sequential_pct", fn.percent(F.col("sequential_count"), n)).withColumn("random_pct", fn.percent(F.col("random_count"), n))


def sector_gaps(rows: DataFrame, by: list[str], event: str, order: list[str] = ("timestamp_ns",), slice_ns: int = SLICE_NS) -> DataFrame:
    """Rows of one event kind with ``gap`` by sector within ``(*by, op)``; sizes in whole sectors."""
    length = fn.int_div(F.coalesce("bytes", F.lit(0)), fn.SECTOR_BYTES)
    return gaps(rows.where(F.col("event") == event), [*by, "op"], "sector", length, order, slice_ns)


def by_sector(rows: DataFrame, by: list[str], event: str, order: list[str] = ("timestamp_ns",), slice_ns: int = SLICE_NS) -> DataFrame:
    """Pattern by sector of the rows of one event kind, by ``(*by, op)``."""
    return classify(sector_gaps(rows, by, event, order, slice_ns), [*by, "op"])


def by_offset(rows: DataFrame, by: list[str], syscalls: list[str] = ("pread64", "pwrite64"), order: list[str] = ("timestamp_ns",), slice_ns: int = SLICE_NS) -> DataFrame:
    """Pattern by explicit file offset, within each fd, summed by ``(*by, syscall)``; only where there is a gap.

    Null sizes are 0. Rows without an fd or offset are left out.
    """
    rows = rows.where((F.col("event") == "enter") & F.col("syscall").isin(*syscalls) & F.col("fd").isNotNull())
    gapped = gaps(rows, [*by, "syscall", "fd"], "offset", F.coalesce("bytes", F.lit(0)), order, slice_ns)
    return classify(gapped, [*by, "syscall"]).where("sequential_count + random_count > 0")


def file_positions(
    rows: DataFrame, by: list[str], order: list[str] = ("timestamp_ns",), zero_result_resets: bool = False, advance: tuple[str, ...] = ("read", "write"),
    slice_ns: int = SLICE_NS, piece: Column | None = None, apart: bool = False,
) -> DataFrame:
    """Enters of read and write with ``position``, the file position of their (thread, fd) as rebuilt from earlier calls.

    A returning openat puts the fd it returns (in ``bytes``) at 0, a returning lseek puts its fd at the position
    it returns, a returning read or write (``advance``) adds its bytes, and a close forgets the fd. Null results
    are failures; traces write 0 as null, so a rewind does nothing unless ``zero_result_resets``. With ``apart`` each
    of ``advance`` has positions that only it advances.

    The position is what the calls so far have moved, and how far the last reset stood from that: a running sum
    and a last value, each over slices of ``slice_ns`` (or what ``piece`` says), so a busy file is many windows. As a
    scan reads its rows twice, what one gives is stored before the next: else reads double with each.
    """
    event, call = F.col("event"), F.col("syscall")
    result = F.coalesce("bytes", F.lit(0)) if zero_result_resets else F.col("bytes")
    opened = (event == "exit") & (call == "openat") & (result >= 0)
    sought = (event == "exit") & (call == "lseek") & (result >= 0)
    closed = (event == "enter") & (call == "close")
    moved = (event == "exit") & call.isin(*advance) & (F.col("bytes") > 0)
    probe = (event == "enter") & call.isin("read", "write")
    kfd = F.when((event == "exit") & (call == "openat"), result.cast("bigint")).otherwise(F.col("fd").cast("bigint"))
    rows = rows.where(F.coalesce(opened | sought | closed | moved | probe, F.lit(False)))
    rows = rows.withColumn("_kfd", kfd).where(F.col("_kfd").isNotNull() & (F.col("_kfd") >= 0) & F.col("tid").isNotNull())
    key, piece = [*by, "tid", "_kfd"], scans.time_slice(slice_ns) if piece is None else piece
    movers = {f"_{i}": call.isin(*names) for i, names in enumerate([(s,) for s in advance] if apart else [advance])}
    delta = lambda own: F.when(F.coalesce(moved & own, F.lit(False)), F.col("bytes").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    rows = scans.running_sums(scans.sliced(rows, key, piece), key, piece, list(order), {f"_moved{i}": delta(own) for i, own in movers.items()})
    rows = materialize(rows, "moves")
    base = F.when(opened, F.lit(0).cast("bigint")).when(sought, result.cast("bigint"))
    resets = F.coalesce(opened | sought | closed, F.lit(False))
    reset = {f"_reset{i}": F.when(resets, F.struct((base - F.col(f"_moved{i}")).alias("off"))) for i in movers}
    rows = scans.last_values(rows, key, piece, list(order), reset, inclusive=True)
    at = {i: F.col(f"_reset{i}.off") + F.col(f"_moved{i}") for i in movers}
    rows = rows.withColumn("position", F.coalesce(*[F.when(own, at[i]) for i, own in movers.items()]) if apart else at["_0"])
    return rows.where(F.coalesce(probe, F.lit(False)) & F.col("position").isNotNull()).drop("_kfd", *reset, *[f"_moved{i}" for i in movers], "_key", "_slice")


def _position_gaps(placed: DataFrame, by: list[str], order: list[str], slice_ns: int) -> DataFrame:
    return gaps(placed, [*by, "syscall", "fd"], "position", F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0)), order, slice_ns)


def by_position(rows: DataFrame, by: list[str], order: list[str] = ("timestamp_ns",), slice_ns: int = SLICE_NS, **options) -> DataFrame:
    """Pattern of read and write by rebuilt position, within each fd, summed by ``(*by, syscall)``; only where there is a gap."""
    gapped = _position_gaps(file_positions(rows, by, order, slice_ns=slice_ns, **options), by, order, slice_ns)
    return classify(gapped, [*by, "syscall"]).where("sequential_count + random_count > 0")


def position_gaps(rows: DataFrame, by: list[str], syscalls: tuple[str, ...] = ("read", "write"), order: list[str] = ("timestamp_ns",), slice_ns: int = SLICE_NS) -> DataFrame:
    """Gaps of read and write for plots; here each call advances only its own positions."""
    placed = materialize(file_positions(rows, by, order, advance=tuple(syscalls), slice_ns=slice_ns, apart=True), "positions")
    return _position_gaps(placed, by, order, slice_ns).where(F.col("gap").isNotNull())
