"""Keyed state of the streaming jobs: what each key keeps from one micro-batch to the next, and when it is given up.

A processor takes the rows of a key of one micro-batch in time order; micro-batches follow each other as a trace
source delivers them. State lives in the state store, so a query that is started again from its checkpoint goes on
where its last complete micro-batch ended. Timers run on event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MOVES = "key string, kind string, op string, comm string, start_ns bigint, timestamp_ns bigint, role int, seq bigint"


def _none(v):
    return None if v is None or v != v else v


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(rows)
    return (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(by, kind="stable")


def _typed(rows: pd.DataFrame, schema: str) -> pd.DataFrame:
    """The columns of ``schema`` with its types."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    kept = {"string": "object", "bigint": "Int64", "int": "Int32", "boolean": "boolean"}
    return rows[list(names)].astype(dict(zip(names, (kept[k] for k in kinds), strict=True)))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return _typed(pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")]), schema)


class _Shard(StatefulProcessor):
    """The state of many keys, those that share a hash, as one list of ``STATE`` rows; None as ``ttl_ns`` never gives up.

    A micro-batch costs a shard one read and one write of its list, and columns are worked on whole, so a key costs
    no calls of its own. One event-time timer a shard goes off when its oldest row, by ``ns``, is due.
    """

    STATE = ""

    def __init__(self, ttl_ns: int | None) -> None:
        self.ttl_ns = ttl_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.STATE)
        self.due = handle.getValueState("due", "ms bigint") if self.ttl_ns is not None else None

    def read(self) -> pd.DataFrame:
        return _frame(list(self.held.get()) if self.held.exists() else [], self.STATE)

    def write(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.held.put([tuple(map(_none, r)) for r in rows.astype(object).itertuples(index=False, name=None)])
        elif self.held.exists():
            self.held.clear()
        if self.due is None:
            return
        old = self.due.get()[0] if self.due.exists() else None
        new = (int(rows["ns"].min()) + self.ttl_ns) // 1_000_000 if len(rows) else None
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is None:
            self.due.clear()
        else:
            self.handle.registerTimer(new)
            self.due.update((new,))

    def overdue(self, expired_ms: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(given up, kept) rows at a timer."""
        rows = self.read()
        gone = ((rows["ns"] + self.ttl_ns) // 1_000_000 <= expired_ms).to_numpy(bool)
        self.due.clear()
        return rows[gone], rows[~gone]

    def close(self) -> None:
        pass


class Pairing(_Shard):
    """The open start of each key: a later start takes its place, an end uses it up; rows of ``MOVES``.

    Starts are moves of kind start, ends with a start moves of kind end, and starts that are given up moves of kind
    given_up at the time they are. An end has a start if the row before it of its key, or what is held, is one.
    """

    STATE = "key string, ns bigint, op string, comm string"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.read().rename(columns={"ns": "timestamp_ns"}).assign(role=0, seq=0, old=0)
        new = _in_order(rows, ["timestamp_ns", "role", "seq"])[["key", "timestamp_ns", "op", "comm", "role", "seq"]].assign(old=1)
        rows = pd.concat([held, new], ignore_index=True).astype({"timestamp_ns": "int64", "role": "int64", "seq": "int64"})
        # what is held comes before the rows of its key, which stay in their order
        rows = rows.sort_values("key", kind="stable", ignore_index=True)
        same = rows["key"].eq(rows["key"].shift())
        # Int64: a shifted int64 would be a float, which holds no nanoseconds
        before = rows[["timestamp_ns", "op", "comm", "role"]].astype({"timestamp_ns": "Int64", "role": "Int64"}).shift()
        start, hit = rows["role"] == 0, (rows["role"] == 1) & same & (before["role"] == 0).fillna(False).astype(bool)
        last = ~rows["key"].eq(rows["key"].shift(-1))
        kept = rows[last & start]
        self.write(kept[["key", "timestamp_ns", "op", "comm"]].rename(columns={"timestamp_ns": "ns"}))
        out = rows.assign(kind="start", start_ns=rows["timestamp_ns"])
        out.loc[hit, "kind"] = "end"
        for c, name in (("timestamp_ns", "start_ns"), ("op", "op"), ("comm", "comm")):
            out[name] = out[name].astype("Int64" if c == "timestamp_ns" else object).mask(hit, before[c])
        yield _typed(out[(start & (rows["old"] == 1)) | hit], MOVES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gone, kept = self.overdue(expiredTimerInfo.getExpiryTimeInMs())
        self.write(kept)
        yield _typed(gone.assign(kind="given_up", start_ns=gone["ns"], timestamp_ns=gone["ns"] + self.ttl_ns, role=1, seq=-1), MOVES)


LEVELS = "op string, comm string, timestamp_ns bigint, in_flight bigint"


class Level(StatefulProcessor):
    """How many starts of an (op, process) are open: one more with each start, one less with each end or start given up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        moves = _in_order(rows, ["timestamp_ns", "role", "seq"])
        held = self.level.get()[0] if self.level.exists() else 0
        levels = held + (1 - 2 * moves["role"].astype("int64")).cumsum()
        self.level.update((int(levels.iloc[-1]),))
        op, comm = map(_none, key)
        out = pd.DataFrame({"op": pd.Series([op] * len(moves), dtype=object), "comm": pd.Series([comm] * len(moves), dtype=object)})
        yield _typed(out.assign(timestamp_ns=moves["timestamp_ns"].to_numpy(), in_flight=levels.to_numpy()), LEVELS)

    def close(self) -> None:
        pass


POSITIONS = "tid bigint, fd bigint, timestamp_ns bigint, syscall string, position bigint"


class Position(_Shard):
    """The positions of (thread, file)s; ``POSITIONS`` for each enter of read or write whose position is known.

    As in ``access.file_positions``: what calls have moved is a running sum, and the last reset, or what is held,
    says how far the position stood from that.
    """

    STATE = "tid bigint, fd bigint, ns bigint, position bigint"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.read().rename(columns={"ns": "timestamp_ns", "position": "bytes"}).assign(event="held", syscall="lseek", seq=0)
        new = _in_order(rows, ["timestamp_ns", "seq"])[["tid", "fd", "timestamp_ns", "event", "syscall", "bytes", "seq"]].astype({"bytes": "Int64"})
        rows = pd.concat([held, new], ignore_index=True).astype({"tid": "int64", "fd": "int64", "timestamp_ns": "int64"})
        # what is held comes before the rows of its file, which stay in their order
        rows = rows.sort_values(["tid", "fd"], kind="stable", ignore_index=True)
        file = (rows["tid"].ne(rows["tid"].shift()) | rows["fd"].ne(rows["fd"].shift())).cumsum()
        enter, call, size = rows["event"] == "enter", rows["syscall"], rows["bytes"].fillna(-1).astype("int64")
        done = ~enter & (size >= 0)
        moved = size.where(done & call.isin(["read", "write"]), 0).groupby(file).cumsum()
        opened, sought, closed = done & (call == "openat"), done & (call == "lseek"), enter & (call == "close")
        # Int64 as differences of large positions are no floats; a close is known as the latest reset
        off = (size.where(sought, 0) - moved).astype("Int64").where(opened | sought)
        reset = pd.Series(range(len(rows))).where(opened | sought | closed).groupby(file).ffill()
        at = off.take(reset.fillna(0).astype("int64")).reset_index(drop=True).where(reset.notna()) + moved
        probe = enter & call.isin(["read", "write"]) & at.notna()
        out = rows.assign(position=at)
        last = file.ne(file.shift(-1))
        self.write(out[last & at.notna()].rename(columns={"timestamp_ns": "ns"})[["tid", "fd", "ns", "position"]])
        yield _typed(out[probe], POSITIONS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.write(self.overdue(expiredTimerInfo.getExpiryTimeInMs())[1])
        yield _frame([], POSITIONS)


class Admission(StatefulProcessor):
    """A buffer of fixed capacity that is emptied every ``poll_ns``: which of a key's rows find room in it.

    What is kept is how full the buffer is and of which interval.
    """

    def __init__(self, capacity: int, poll_ns: int) -> None:
        self.capacity, self.poll_ns = capacity, poll_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fill = handle.getValueState("fill", "interval bigint, used bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = _in_order(rows, ["timestamp_ns", "seq"])
        interval = pdf["timestamp_ns"] // self.poll_ns
        nth = pdf.groupby(interval.values).cumcount()
        if self.fill.exists():
            last, used = self.fill.get()
            nth = nth + used * (interval == last)
        pdf["admitted"] = (nth < self.capacity).astype("boolean")
        self.fill.update((int(interval.iloc[-1]), int(nth.iloc[-1]) + 1))
        yield pdf[["key", "timestamp_ns", "seq", "admitted"]]

    def close(self) -> None:
        pass
