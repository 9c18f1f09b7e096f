"""Language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

import inspect
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from iotrace.llm.common import bucket_of
from iotrace.storage import materialize

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Counts that a task holds before it hands them on.
_HELD_KEYS = 1_000_000
#: Keys of the k-th level have k above this many bits.
_LEVEL_BITS = 56
#: Rows have their place in a slice of texts in this many bits.
_SLICE_BITS = 20
#: Bytes of text, and tokens, that a task works on together.
_BYTES, _TOGETHER = 4_000_000, 250_000
#: Training tokens a shard of keys.
_SHARD = 2_000_000


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8, then the end token, which is empty as no word is."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(), b""]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in order whose ``sizes`` add up to ``most`` or little more, if no row alone is larger."""
    turns = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    edges = np.union1d(turns, np.append(np.arange(0, batch.num_rows, 1 << _SLICE_BITS), batch.num_rows))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(rows, their words as ``tokens`` has them in one array, how many of them each row has) of some rows at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        for part in _slices(batch, sizes.astype(np.int64), _BYTES):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten()
            some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
            if not some.all():  # white space at either end of a text
                lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[some], minlength=len(lengths))
                words = words.filter(pa.array(some))
            yield part, words, lengths


def word_counts(docs: DataFrame, trains: Column, text_col: str = "text") -> DataFrame:
    """``(word, c)`` of every token of all texts; c counts those of training texts. Tasks add up in bounded pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> Iterator[pa.RecordBatch]:
            yield from pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).to_batches()
            held.clear()

        for part, words, lengths in _texts(batches):
            t = pc.fill_null(part.column("t"), False).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append(pa.table({"word": words, "c": np.repeat(t, lengths)}).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]))
            held.append(pa.table({"word": pa.array([""], pa.string()), "c": pa.array([t.sum()], pa.int64())}))
            if sum(h.num_rows for h in held) > _HELD_KEYS:
                yield from out()
        if held:
            yield from out()

    rows = docs.select(F.col(text_col).alias("text"), trains.alias("t"))
    return rows.mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def number(docs: DataFrame, words: list[tuple[bytes, int]], size: float, keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """``(*keep, row, n, base, ids, rare)`` of every text, whose words are looked up here once for all later passes.

    ``ids`` are the places of its tokens in ``words`` as int32 (an array of them takes executors much more memory), -1 for others, and ``rare`` those others in order. ``n`` tokens have
    a place; ``base`` sums their log10 counts plus one, less ``size`` each. Rows are unique; slices of texts of some
    ``_BYTES`` together have the same bits above ``_SLICE_BITS``.
    """
    rows = docs.select(*keep, F.col(text_col).alias("text"))
    names = pa.array([w.decode("utf-8", "replace") for w, _ in words], pa.string())
    logs = np.append(np.log10(np.array([c for _, c in words], np.float64) + 1.0), 0.0)
    end = next((i for i, (w, _) in enumerate(words) if not w), -1)
    shared = docs.sparkSession.sparkContext.broadcast((names, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        row = TaskContext.get().partitionId() << 40
        for part, flat, lengths in _texts(batches):
            ends = np.cumsum(lengths + 1) - 1
            inner = np.ones(len(flat) + len(ends), bool)
            inner[ends] = False
            ids = np.full(len(inner), end, np.int32)
            ids[inner] = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False)
            starts = np.append(0, ends[:-1] + 1)
            n = np.add.reduceat((ids >= 0).astype(np.int64), starts)
            rare = np.flatnonzero(ids < 0)
            at = pa.array(np.cumsum(inner)[rare] - 1, mask=~inner[rare])
            offsets = np.append(0, 4 * np.cumsum(lengths + 1)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            offsets = np.append(0, np.cumsum(lengths + 1 - n)).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(offsets), pc.fill_null(flat.take(at), ""))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(row + np.arange(len(n))), pa.array(n), pa.array(np.add.reduceat(logs[ids], starts) - n * size), packed, others],
                names=[*keep, "row", "n", "base", "ids", "rare"],
            )
            row += 1 << _SLICE_BITS

    made = StructType.fromDDL("row bigint, n bigint, base double, ids binary, rare array<string>")
    schema = StructType([f for f in rows.schema if f.name in keep] + made.fields)
    out = materialize(rows.mapInArrow(run, schema), "numbered")
    shared.destroy()
    return out


class _Index:
    """Places of distinct whole numbers from 0 on, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.places = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        some, at = np.arange(len(keys)), self._first(keys)
        while len(some):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[some[free]]
            done = self.keys[at] == keys[some]
            self.places[at[done]] = some[done]
            some, at = some[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of ``wanted``, -1 where they are none of the keys or negative."""
        out = np.full(len(wanted), -1, np.int64)
        some = np.flatnonzero(wanted >= 0)
        keys = wanted[some]
        at = self._first(keys)
        while len(some):
            here = self.keys[at]
            hit = here == keys
            out[some[hit]] = self.places[at[hit]]
            on = ~hit & (here >= 0)
            some, keys, at = some[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class _Numbers(dict):
    """Words by number; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Level:
    """Contexts of one length.

    Context numbers of the first level are word numbers; those of the others are places in ``contexts``, sorted
    keys of a context one word shorter times ``width + 1`` plus the word after it. ``suffix`` is the number of each
    context without its first word, one level up. ``kept`` are the retained contexts, and ``rest`` is the log10
    weight with which a context passes words that it does not store on to its suffix, 0 for one that is not
    retained. ``entries`` are the most frequent of the sorted keys of a context times ``width + 1`` plus a next word
    that is stored, and ``lift`` what storing each adds to log10 of the word's probability as passed on.
    """

    contexts: np.ndarray
    suffix: np.ndarray
    rest: np.ndarray
    kept: np.ndarray
    entries: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    lift: np.ndarray = field(default_factory=lambda: np.empty(0))

    @cached_property
    def places(self) -> _Index:
        return _Index(self.contexts)

    @cached_property
    def stored(self) -> _Index:
        return _Index(self.entries)


@dataclass
class Tree:
    """Retained contexts of up to as many words as there are levels.

    Words are numbered by falling count; the first ``first`` may be in contexts and the first ``width`` be stored.
    As a context the number ``width`` is the start of a text, as a next word any word without a number.

    ``cold`` is the table ``(key, word, lift)`` of the stored next words that ``levels`` do not hold: the key with its
    level (``found``), and the word if it has no number, else an empty string. It and ``words`` stay with the driver's copy.
    """

    words: list[tuple[bytes, int]]
    counts: np.ndarray
    width: int
    first: int
    levels: list[Level] = field(default_factory=list)
    cold: DataFrame | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cold": None, "words": []}

    @cached_property
    def ids(self) -> _Numbers:
        return _Numbers((w, i) for i, (w, _) in enumerate(self.words))

    def windows(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of each token as a next word, and for each level that of the context before it; -1 where there is none."""
        x = np.where(ids < 0, self.width, np.where(ids < self.width, ids, -1))
        context = np.concatenate(([self.width], np.where((ids >= 0) & (ids < self.first), ids, -1)[:-1]))
        context[starts] = self.width
        out = [context]
        for level in self.levels[1:]:
            longer = level.places.find(self.key(context, x))
            context = np.concatenate(([-1], longer[:-1]))
            context[starts] = -1
            out.append(context)
        return x, out

    def key(self, context: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.where((context >= 0) & (x >= 0), context * (self.width + 1) + x, -1)

    def found(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of each text's lifts as far as ``levels`` hold them; places and tagged keys to look up in ``cold``).

        A next word that a context stores is stored by its suffix too, so what the levels add are summed one by one.
        """
        x, contexts = self.windows(ids, starts)
        here, places, keys = np.zeros(len(x)), [], []
        for k, (level, context) in enumerate(zip(self.levels, contexts, strict=True)):
            some = np.flatnonzero(context >= 0)
            some = some[level.kept[context[some]]]
            here[some] += level.rest[context[some]]
            wanted = self.key(context[some], x[some])
            at = level.stored.find(wanted)
            hit = at >= 0
            here[some[hit]] += level.lift[at[hit]]
            open_ = ~hit & (wanted >= 0)
            places.append(some[open_])
            keys.append(wanted[open_] + (k << _LEVEL_BITS))
        none = [np.empty(0, np.int64)]
        return np.add.reduceat(here, starts), np.concatenate(places or none), np.concatenate(keys or none)

    def lifts(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each text the sum over its tokens of log10 P(token | context) - log10 P(token), without what is in ``cold``."""
        return self.found(ids, starts)[0]


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the sorted ``keys``, -1 where they are not or ``wanted`` is negative."""
    out = np.full(len(wanted), -1, np.int64)
    if len(keys):
        some = np.flatnonzero(wanted >= 0)
        at = np.minimum(np.searchsorted(keys, wanted[some]), len(keys) - 1)
        hit = keys[at] == wanted[some]
        out[some[hit]] = at[hit]
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """(rows of ``number``, ids, where each text starts in them, ``rare``, place of each token in it) of some texts at a time."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("ids")).to_numpy().astype(np.int64) // 4
        for part in _slices(batch, sizes, _TOGETHER):
            packed = part.column("ids")
            ids = np.frombuffer(b"".join(packed.to_pylist()), np.int32).astype(np.int64)
            ends = np.cumsum(pc.binary_length(packed).to_numpy().astype(np.int64) // 4)
            yield part, ids, np.append(0, ends[:-1]), part.column("rare").flatten(), np.cumsum(ids < 0) - 1


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys ^ (keys >> 21)) % shards


def _shard_of(key: str, shards: int) -> Column:
    return F.expr(f"cast(({key} ^ shiftright({key}, 21)) % {shards} as int)")


def _dealt(group: np.ndarray, *columns: np.ndarray | pa.Array) -> tuple[np.ndarray, list[pa.ListArray]]:
    """The different groups, and of each column a list for each of them."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    offsets = pa.array(np.append(starts, len(group)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, c.take(pa.array(order)) if isinstance(c, pa.Array) else pa.array(c[order])) for c in columns]
    return group[starts], lists


def _flat(rows: pa.Table, column: str) -> pa.Array:
    return pc.list_flatten(rows.column(column).combine_chunks())


def _key_counts(numbered: DataFrame, tree: Tree, least: int, shards: int) -> DataFrame:
    """``(key, word, n)`` of the contexts of the last level with a next word that occur ``least`` times or more.

    ``word`` is empty where the key has the word's number. Tasks count in bounded pieces; what they count goes to the
    shard of its key as one row a shard and piece, and shards add up.
    """
    shared = numbered.sparkSession.sparkContext.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, others = shared.value, [], []

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            to, lists = _dealt(_shard(keys, shards), keys, n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *lists, pa.nulls(len(to), pa.list_(pa.string()))], names=["shard", "key", "n", "word"])
            rare = pa.concat_tables(others).group_by(["key", "word"]).aggregate([("n", "sum")]).combine_chunks()
            keys, n, words = (rare.column(c).combine_chunks() for c in ("key", "n_sum", "word"))
            to, lists = _dealt(_shard(keys.to_numpy(), shards), keys, n, words)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *lists], names=["shard", "key", "n", "word"])
            held.clear()
            others.clear()

        for _, ids, starts, rare, at in _pieces(batches):
            x, contexts = t.windows(ids, starts)
            keys = t.key(contexts[-1], x)
            other = np.flatnonzero((keys >= 0) & (x == t.width))
            others.append(pa.table({"key": keys[other], "word": rare.take(pa.array(at[other])), "n": np.ones(len(other), np.int64)}))
            held.append(keys[(keys >= 0) & (x != t.width)])
            if sum(map(len, held)) + sum(map(len, others)) > _HELD_KEYS:
                yield from out()
        if held:
            yield from out()

    def add(rows: pa.Table) -> pa.Table:
        own = rows.filter(pc.is_null(rows.column("word")))
        keys, n = _flat(own, "key").to_numpy(), _flat(own, "n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, n = keys[starts], np.add.reduceat(n, starts) if len(n) else n
        keys, n = keys[n >= least], n[n >= least]
        rest = rows.filter(pc.is_valid(rows.column("word")))
        rest = pa.table({c: _flat(rest, c) for c in ("key", "word", "n")}).group_by(["key", "word"]).aggregate([("n", "sum")])
        rest = rest.rename_columns(["key", "word", "n"]).filter(pc.greater_equal(rest.column("n_sum"), least))
        return pa.concat_tables([pa.table({"key": keys, "word": pa.array([""] * len(keys), pa.string()), "n": n}), rest])

    rows = numbered.select("ids", "rare").mapInArrow(count, "shard int, key array<bigint>, n array<bigint>, word array<string>")
    out = materialize(rows.groupBy("shard").applyInArrow(add, "key bigint, word string, n bigint"), "contexts")
    shared.destroy()
    return out


def grow(
    docs: DataFrame,
    words: list[tuple[bytes, int]],
    total: int,
    vocabulary: int,
    text_col: str = "text",
    depth: int = 4,
    min_share: float = 1e-5,
    entry_share: float = 2e-6,
    min_count: int = 10,
    min_gain: float = 1e-7,
    discount: float = 0.75,
    least: int = 3,
    vocab: DataFrame | None = None,
    numbered: DataFrame | None = None,
) -> Tree:
    """Learn the tree from training texts; ``words`` are the most frequent words with their counts, falling.

    The model: contexts of up to ``depth`` words with a share of ``min_share`` of all tokens, ``min_count`` at least,
    are retained if that share times the divergence from their suffix is ``min_gain`` or more; one that is retained
    stores all next words that follow it ``least`` times or more, however large the corpus.

    Contexts of one word are counted, then those of two whose first word is frequent enough, and so on, a pass over
    the texts each. There are at most 1 / ``min_share`` contexts a level, which the driver numbers. Next words are rows
    of tables: each level's are joined with the level's above for the probability that the suffix gives, and summed
    by context. Those with ``entry_share`` of all tokens go to the tasks with the contexts, the others are ``Tree.cold``.
    ``vocab`` has the counts of the words that ``words`` lack, if it lacks any; it must have all as frequent as a context.
    ``numbered`` are the texts as ``number`` gives them, if that has been done.
    """
    spark = docs.sparkSession
    if numbered is None:
        numbered = number(docs, words, math.log10(total + vocabulary + 1), (), text_col)
    counts = np.array([c for _, c in words], np.int64)
    frequent, held = max(min_share * total, min_count), max(math.ceil(entry_share * total), least)
    width = int((counts >= least).sum())
    tree = Tree(words, counts, width, min(int((counts >= frequent).sum()), width))
    end = next((i for i, (w, _) in enumerate(words) if not w), -1)
    totals = np.append(counts[:width], counts[end] if 0 <= end < width else 0)  # as many texts start as end
    none = np.empty(0, np.int64)
    tree.levels.append(Level(none, np.zeros(width + 1, np.int64), np.zeros(width + 1), np.zeros(width + 1, bool)))
    own = lambda c: (c + 1) / F.lit(float(total + vocabulary + 1))
    x, has_number = F.expr(f"key % {width + 1}"), F.expr(f"key % {width + 1} != {width}")
    above = None
    for length in range(1, depth + 1):
        level = tree.levels[-1]
        found = _key_counts(numbered, tree, least, _shards(total))
        rows = found.withColumns({"context": F.expr(f"key div {width + 1}"), "x": x})
        numbers = np.arange(len(totals))
        known = spark.createDataFrame(pa.table({"context": numbers, "suffix": level.suffix, "total": totals.astype(np.int64)}))
        rows = rows.join(F.broadcast(known), "context")
        if above is None:
            of = spark.createDataFrame(pa.table({"x": np.arange(width), "c": counts[:width]}))
            joined = rows.where(has_number).join(F.broadcast(of), "x")
            if vocab is not None:
                joined = joined.unionByName(rows.where(~has_number).join(vocab.select("word", "c"), "word"))
            joined = joined.withColumn("own", own(F.col("c"))).withColumn("below", F.col("own")).drop("c")
        else:
            # what a context stores its suffix stores
            joined = rows.withColumn("up", F.col("suffix") * (width + 1) + F.col("x")).join(above, ["up", "word"]).drop("up")
        p = (F.col("n") - discount) / F.greatest("total", F.lit(1))
        joined = materialize(joined.select("key", "word", "context", "n", "below", p.alias("p")), "entries")
        sums = joined.groupBy("context").agg(F.sum("p").alias("p"), F.sum("below").alias("below"), F.sum(F.col("p") * F.log(F.col("p") / F.col("below"))).alias("d")).toArrow()
        stored, passed, divergence = np.zeros(len(totals)), np.zeros(len(totals)), np.zeros(len(totals))
        for into, name in ((stored, "p"), (passed, "below"), (divergence, "d")):
            into[sums["context"].to_numpy()] = sums[name].to_numpy()
        left, left_below = np.maximum(1.0 - stored, 1e-12), np.maximum(1.0 - passed, 1e-12)
        divergence += left * np.log(left / left_below)
        level.kept = (totals >= frequent) & (totals / max(total, 1) * divergence >= min_gain) & (stored > 0)
        level.rest = np.where(level.kept, np.log10(left / left_below), 0.0)
        state = spark.createDataFrame(pa.table({"context": numbers, "kept": level.kept, "rest": level.rest}))
        joined = joined.join(F.broadcast(state), "context")
        kept = joined.where("kept").select("key", "word", "n", (F.log10(F.col("p") / F.col("below")) - F.col("rest")).alias("lift"))
        hot = has_number & (F.col("n") >= held)
        got = kept.where(hot).select("key", "lift").toArrow()
        order = np.argsort(got["key"].to_numpy())
        level.entries, level.lift = got["key"].to_numpy()[order], got["lift"].to_numpy()[order]
        cold = kept.where(~hot).select((F.col("key") + ((length - 1) << _LEVEL_BITS)).alias("key"), "word", "lift")
        tree.cold = cold if tree.cold is None else tree.cold.unionByName(cold)
        above = joined.select(F.col("key").alias("up"), "word", F.when(F.col("kept"), F.col("p")).otherwise(F.col("below")).alias("below"))
        got = found.where(has_number & (x != end) & (F.col("n") >= frequent)).select("key", "n").toArrow()
        order = np.argsort(got["key"].to_numpy())
        keys, n = got["key"].to_numpy()[order], got["n"].to_numpy()[order]
        context, word = keys // (width + 1), keys % (width + 1)
        # a suffix is as frequent as its context, so it is there unless its own suffix is not
        suffix = word if length == 1 else _place(level.contexts, tree.key(level.suffix[context], word))
        if length == depth or not (suffix >= 0).any():
            break
        some = suffix >= 0
        totals = n[some]
        tree.levels.append(Level(keys[some], suffix[some], np.zeros(len(totals)), np.zeros(len(totals), bool)))
    return tree


def _shards(total: int) -> int:
    return total // _SHARD + 1


def _marks(keys: np.ndarray, words: pa.Array | None, bits: int) -> np.ndarray:
    """A place among 2 ** ``bits`` for each key with its word, if any."""
    out = keys.astype(np.uint64)
    if words is not None:
        some = np.flatnonzero(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
        bytes_ = words.take(pa.array(some)).cast(pa.binary()).to_pylist()
        out[some] ^= np.fromiter((zlib.crc32(w) << 31 for w in bytes_), np.uint64, len(some))
    out ^= out >> np.uint64(31)
    return (out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _marked(cold: DataFrame, most_bits: int = 28) -> tuple[int, np.ndarray]:
    """(bits, words of 64 marks): a mark for every row of ``cold``, so that what has none need not be looked up.

    At most 2 ** ``most_bits`` marks, 32 MB; where more rows share one, more is looked up for nothing.
    """
    bits = min(most_bits, max(10, (16 * cold.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_marks(batch.column("key").to_numpy(), batch.column("word"), bits))
            block = (at >> np.uint64(6)).astype(np.int64)
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            ones = np.left_shift(np.uint64(1), at & np.uint64(63))
            ones = np.bitwise_or.reduceat(ones, starts).view(np.int64) if len(at) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(ones)], names=["block", "ones"])

    got = cold.select("key", "word").mapInArrow(mark, "block bigint, ones bigint").groupBy("block").agg(F.bit_or("ones").alias("ones")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["block"].to_numpy()] = got["ones"].to_numpy()
    return bits, out.view(np.uint64)


def _most_frequent(vocab: DataFrame, most: int, always: float) -> list[tuple[bytes, int]]:
    """At most ``most`` words of highest count and all of count ``always`` or more, by falling count.

    Counts fall in sixteenths of powers of two, at most a thousand or so, and words of one class come or stay
    together, so no task sorts the vocabulary.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    cut, seen = None, 0
    for r in vocab.where("c > 0").groupBy(step.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect():
        seen += r["n"]
        if seen > most and 2 ** ((r["k"] + 1) / 16) < always - 1e-6:
            break
        cut = r["k"]
    if cut is None:
        return []
    top = vocab.where(F.col("c") > 0).where(step >= cut).toLocalIterator()
    return sorted(((r["word"].encode(), r["c"]) for r in top), key=lambda w: (-w[1], w[0]))


def _wanted(tree: Callable[[], Tree], marks: Callable[[], tuple[int, np.ndarray]], shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from rows of ``number`` to ``(shard, block, row, key, word, lift)``, lists from ``row`` on.

    ``block`` is a row's upper bits. A list of lifts is what the tree holds for the rows, one of keys what is to be looked
    up for them; it comes with a list of words if the keys are those of words without a number.
    """
    names = ["shard", "block", "row", "key", "word", "lift"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (bits, marked) = tree(), marks()

        def lists(shard: np.ndarray, row: np.ndarray, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
            blocks, at = np.unique(row >> _SLICE_BITS, return_inverse=True)
            group, of = _dealt(shard * max(1, len(blocks)) + at, (row & ((1 << _SLICE_BITS) - 1)).astype(np.int32), *columns.values())
            made = dict(zip(["row", *columns], of, strict=True))
            of_kind = {"key": pa.int64(), "word": pa.string(), "lift": pa.float64()}
            rest = [made.get(c, pa.nulls(len(group), pa.list_(of_kind.get(c, pa.int32())))) for c in names[2:]]
            return pa.RecordBatch.from_arrays([pa.array((group // max(1, len(blocks))).astype(np.int32)), pa.array(blocks[group % max(1, len(blocks))]), *rest], names=names)

        for part, ids, starts, rare, at in _pieces(batches):
            rows = part.column("row").to_numpy()
            lifts, places, keys = t.found(ids, starts)
            yield lists((rows >> _SLICE_BITS) % shards, rows, lift=lifts)
            row = rows[np.searchsorted(starts, places, side="right") - 1]
            other = ids[places] < 0
            for some, words in ((~other, None), (other, rare.take(pa.array(at[places[other]])))):
                mark = _marks(keys[some], words, bits)
                there = np.flatnonzero(marked[mark >> np.uint64(6)] >> (mark & np.uint64(63)) & np.uint64(1))
                key, to = keys[some][there], row[some][there]
                more = {} if words is None else {"word": words.take(pa.array(there))}
                yield lists(_shard(key, shards), to, key=key, **more)

    return run


def _matched(wanted: pa.Table, cold: pa.Table) -> pa.Table:
    """``(block, row, lift)`` of a shard of ``_wanted`` and the stored next words of that shard: sums by row."""
    rows, lifts = [], []

    def take(some: pa.Table, got: np.ndarray) -> None:
        n = pc.list_value_length(some.column("row")).to_numpy()
        rows.append(np.repeat(some.column("block").to_numpy() << _SLICE_BITS, n) + _flat(some, "row").to_numpy())
        lifts.append(got)

    known = wanted.filter(pc.is_valid(wanted.column("lift")))
    take(known, _flat(known, "lift").to_numpy())
    keys, values = cold.column("key").to_numpy(), np.append(cold.column("lift").to_numpy(), 0.0)
    other = cold.column("word").to_numpy() != ""
    # an end without a number is a word that is empty; it has keys of its own, so it may be among the others
    own = _Index(keys[~other])
    value = np.append(values[:-1][~other], 0.0)
    some = wanted.filter(pc.and_(pc.is_valid(wanted.column("key")), pc.is_null(wanted.column("word"))))
    take(some, value[own.find(_flat(some, "key").to_numpy())])
    some = wanted.filter(pc.is_valid(wanted.column("word")))
    names = cold.column("word").to_pylist()
    of = {(int(keys[i]), names[i]): values[i] for i in np.flatnonzero(other).tolist()}
    key, words = _flat(some, "key").to_numpy(), _flat(some, "word").to_pylist()
    got = np.fromiter((of.get(kw, 0.0) for kw in zip(key.tolist(), words, strict=True)), np.float64, len(key))
    empty = np.flatnonzero(np.array([not w for w in words], bool))
    got[empty] = value[own.find(key[empty])]
    take(some, got)
    row, at = np.unique(np.concatenate(rows), return_inverse=True)
    sums = np.bincount(at, np.concatenate(lifts), len(row))
    block, lists = _dealt(row >> _SLICE_BITS, (row & ((1 << _SLICE_BITS) - 1)).astype(np.int32), sums)
    return pa.table([pa.array(block), *lists], names=["block", "row", "lift"])


def _added(rows: pa.Table) -> pa.Table:
    """``(row, lift)`` of the rows of a block."""
    at, lift = _flat(rows, "row").to_numpy(), _flat(rows, "lift").to_numpy()
    row, of = np.unique(at, return_inverse=True)
    block = rows.column("block")[0].as_py() << _SLICE_BITS
    return pa.table({"row": block + row.astype(np.int64), "lift": np.bincount(of, lift, len(row))})


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, common_words: int = 200_000, **options
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Contexts have up to ``depth`` words (``grow``). Learns from rows whose crc32 of the id modulo ``modulus`` is not ``held``. The counts of the ``common_words``
    most frequent words, and of all that contexts can be made of, go to the tasks, which number the words of the texts once
    (``number``) and add up their counts; every other word of a text is a row of a join with the vocabulary. Tasks hold what
    contexts and their most frequent next words change; keys of all other next words of a retained context go, many to a
    row, to the shard that has the stored ones, and their sums to the shard of the texts. So ``common_words`` and
    ``entry_share`` say what tasks hold, not what is counted. A word that training lacks has the probability of the one
    unknown word. A null text is the end token alone; a null id trains; repeated rows each count.
    """
    spark = docs.sparkSession
    trains = bucket_of(F.col(id_col), modulus) != held
    vocab = materialize(word_counts(docs, trains, text_col), "vocabulary")
    sums = vocab.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    shape = inspect.signature(grow).parameters
    always = max(*(options.get(k, shape[k].default) * m for k, m in (("min_share", n), ("min_count", 1))))
    words = _most_frequent(vocab, common_words, always)
    size, shards = math.log10(n + v + 1), _shards(n)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (~trains).alias("held_out"), F.col(text_col).alias("text"))
    numbered = number(rows, words, size, ("doc_id", "held_out"))
    tree = grow(docs, words, n, v, vocab=vocab, numbered=numbered.where("not held_out"), **options)
    cold = materialize(tree.cold, "stored")
    shared, marks = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(_marked(cold))
    wanted = numbered.select("row", "ids", "rare").mapInArrow(
        _wanted(lambda: shared.value, lambda: marks.value, shards),
        "shard int, block bigint, row array<int>, key array<bigint>, word array<string>, lift array<double>",
    )
    stored = cold.withColumn("shard", _shard_of("key", shards))
    sums = wanted.groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(_matched, "block bigint, row array<int>, lift array<double>")
    sums = sums.groupBy("block").applyInArrow(_added, "row bigint, lift double")
    whole = numbered.select("row", "doc_id", "held_out", "n", F.col("n").alias("known"), "base", F.lit(0.0).alias("lift"))
    nothing = {"doc_id": F.lit(None).cast("bigint"), "held_out": F.lit(None).cast("boolean"), "n": F.lit(0).cast("bigint"), "known": F.lit(0).cast("bigint"), "base": F.lit(0.0), "lift": F.lit(0.0)}
    rare = numbered.select("row", F.explode("rare").alias("word")).join(vocab, "word").select("row", "c").withColumns(
        nothing | {"n": F.lit(1).cast("bigint"), "known": (F.col("c") > 0).cast("bigint"), "base": F.log10(F.col("c") + 1) - size}
    )
    out = whole.unionByName(rare.drop("c")).unionByName(sums.withColumns({k: f for k, f in nothing.items() if k != "lift"})).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n").alias("n_tokens"),
        F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lift").alias("lift"),
    )
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"),
        "base_score", (F.col("base_score") + F.col("lift")).alias("score"),
    )
