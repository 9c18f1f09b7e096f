"""Scalar functions on columns: time buckets, clocks, suffixed numbers, powers of two, code tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_NS = 1_000_000_000
SECTOR_BYTES = 512

#: Fixed values of the trace formats.
REQUEST_TYPES = {0: "read", 1: "write", 2: "flush", 3: "discard", 9: "write_zeros"}
BLOCK_EVENTS = {0: "insert", 1: "issue", 2: "complete"}
NVME_EVENTS = {0: "setup", 1: "complete"}
FS_EVENTS = {0: "enter", 1: "exit"}
SYSCALLS = dict(
    enumerate(
        ["read", "write", "pread64", "pwrite64", "openat", "close", "fsync", "fdatasync", "lseek", "ftruncate", "fallocate", "rename", "unlink"]
    )
)
IO_SYSCALLS = ("read", "write", "pread64", "pwrite64")
OP_ORDER = ("read", "write", "pread64", "pwrite64", "flush", "discard", "write_zeros")


def int_div(a: Column, b: Column | int) -> Column:
    """Integer quotient of integers, exact beyond 2**53; null where ``b`` is 0."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def wide_sum(column: str) -> Column:
    """Sum of a bigint column as decimal(30,0), for sums that pass 2**63."""
    return F.sum(F.col(column).cast("decimal(20,0)"))


def time_bucket(ts_ns: Column, start_ns: Column, width_ns: int = SECOND_NS) -> Column:
    return int_div(ts_ns - start_ns, width_ns)


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS; hours may pass 24."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", int_div(s, 3600), int_div(F.pmod(s, F.lit(3600)), 60), F.pmod(s, F.lit(60)))


def clock_seconds(text: Column) -> Column:
    """HH:MM:SS as seconds; null for other texts."""
    p = F.split(text, ":")
    ok = text.rlike(r"^\d+:\d{2}:\d{2}$")
    return F.when(ok, F.get(p, F.lit(0)).try_cast("int") * 3600 + F.get(p, F.lit(1)).try_cast("int") * 60 + F.get(p, F.lit(2)).try_cast("int"))


def suffix_number(text: Column) -> Column:
    """Integers with an optional binary suffix K, M, G or T; null for other texts."""
    t = F.trim(text)
    power = F.instr(F.lit("KMGT"), F.regexp_extract(t, r"([KMGT])$", 1))
    factor = F.when(t.rlike(r"[KMGT]$"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (power * 10).cast("int"))).otherwise(F.lit(1).cast("bigint"))
    return F.regexp_extract(t, r"^([+-]?\d+)[KMGT]?$", 1).try_cast("bigint") * factor


def log2_floor(v: Column) -> Column:
    """Exponent of the largest power of two up to a positive integer, exact at any size."""
    return F.length(F.bin(v)) - 1


def power_of_two(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent.cast("int"))


def decode(code: Column, names: dict[int, str], default: str | None = "unknown") -> Column:
    pairs = [F.lit(x) for k, v in names.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit(default))


def request_type(cmd_flags: Column) -> Column:
    """Name of a request type, the low byte of the command flags."""
    return decode(cmd_flags.bitwiseAND(255), REQUEST_TYPES)


def pointer(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0), v)


def identity(mntns_id: Column) -> Column:
    """Mount-namespace id as the text used in keys: empty for null."""
    return F.coalesce(mntns_id.cast("string"), F.lit(""))


def op_rank(op: Column) -> Column:
    """Place of a request type or syscall in the usual order; unknown names last."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, o in enumerate(OP_ORDER) for x in (o, i)]), op), F.lit(99))


def dictionary(key: str, value: str) -> Column:
    """A map of a group's keys to their values; of a repeated key the greatest value."""
    pairs = F.sort_array(F.collect_list(F.struct(key, value)))
    last = F.filter(pairs, lambda x, i: (i == F.size(pairs) - 1) | (F.get(pairs, i + 1)[key] != x[key]))
    return F.map_from_entries(last)


def get_or(map_col: Column, key: str | Column, default) -> Column:
    """Value of a map at a key, with a default."""
    return F.coalesce(F.try_element_at(map_col, F.lit(key) if isinstance(key, str) else key), F.lit(default))


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.coalesce(F.round(F.try_divide(F.lit(100.0) * part, whole), places), F.lit(0.0))
