"""Prefix trie of conversations: sorted shards finish what lies inside them, a skeleton of splitter paths joins the rest.

A conversation is a path of turns, each known by 16 bytes of the SHA-256 of its role and text; paths are compared as
byte strings. Splitters, paths of a sample, cut the order of all paths into shards. A node that is no prefix of a
splitter has all its members in one shard, which finishes it; prefixes of splitters, the skeleton, may lie in several
shards and are reduced from what each shard knows of them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.storage import materialize

#: Bytes of a turn's digest.
WIDTH = 16
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_PARTIAL = "skeleton int, piece bigint, ends string, bytes bigint, " + NODE
#: Characters of ids in one row of the ends of a skeleton node.
_PIECE = 1 << 20


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(conversations: DataFrame, id_col: str = "conv_id", group: int = 5) -> DataFrame:
    """``(conv_id, turns array<struct<digest, bytes>>)``: every conversation behind the first turns of its group's first.

    Turns go by ``turn``, null first, then role and digest. Null roles and texts are empty. Rows without a
    ``conv_id`` belong to no conversation and are left out. Of a conversation some 40 bytes a turn are held in one
    row, no texts.
    """
    c, role, text = F.col(id_col).cast("bigint"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, WIDTH)
    rows = conversations.where(c.isNotNull()).select(c.alias("conv_id"), F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("own"))
    own = materialize(own, "conversations")
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first_id"), F.slice("own", 1, 8).alias("head"))
    own = own.withColumn("h", head_turns(F.col("conv_id")))
    out = own.join(first, F.col("conv_id") - F.col("conv_id") % group == F.col("first_id"), "left")
    rest = F.expr("slice(own, h + 1, greatest(size(own) - h, 0))")
    head = F.expr("case when first_id is null then cast(array() as array<struct<digest: binary, bytes: bigint>>) else slice(head, 1, h) end")
    return out.select("conv_id", F.concat(head, rest).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """``(conv_id, path, bytes)``: the digests of a conversation's turns in one byte string, and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1)
            digests = [b"".join(t["digest"] for t in ts) for ts in turns.to_pylist()]
            lengths = pa.ListArray.from_arrays(pa.array(turns.offsets.to_numpy() - turns.offsets[0].as_py(), pa.int32()), turns.flatten().field("bytes"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), lengths], ["conv_id", "path", "bytes"])

    return convs.mapInArrow(run, "conv_id bigint, path binary, bytes array<bigint>")


def splitters(rows: DataFrame, shards: int, max_bytes: int = 16 << 20, oversample: int = 8) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 different (path, conv_id) in order, from the rows with the least hashes.

    Paths are cut where the sample would pass ``max_bytes``; a cut path has the least id, so that it still
    separates what lies before it from what lies behind.
    """
    n = max(1, shards * oversample)
    limit = max(1, max_bytes // (WIDTH * n)) * WIDTH
    key = F.xxhash64("conv_id", F.lit("sample"))
    short = rows.select(F.substring("path", 1, limit + 1).alias("path"), "conv_id", key.alias("k")).orderBy("k", "conv_id").limit(n)
    sample = sorted((bytes(r["path"][:limit]), -(1 << 63) if len(r["path"]) > limit else r["conv_id"]) for r in short.collect())
    return sorted({sample[i * len(sample) // shards] for i in range(1, shards)}) if sample else []


def skeleton_of(cuts: list[tuple[bytes, int]]) -> dict[tuple[int, bytes], int]:
    """The trie of the splitter paths: a node's number by its parent's number and its last digest, in the order of a walk.

    The root is 0 and not in it. Its size is that of the splitters, however long their paths are.
    """
    numbers: dict[tuple[int, bytes], int] = {}
    for path, _ in cuts:
        node = 0
        for a in range(0, len(path), WIDTH):
            node = numbers.setdefault((node, path[a : a + WIDTH]), len(numbers) + 1)
    return numbers


class _Node:
    """An open node of the walk: what its members in this shard have given so far."""

    __slots__ = ("conv", "depth", "size", "skeleton", "n", "children", "leaves", "saved", "ends", "digest", "waiting")

    def __init__(self, conv: int, depth: int, size: int, skeleton: int) -> None:
        self.conv, self.depth, self.size, self.skeleton = conv, depth, size, skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.ends, self.digest, self.waiting = [], None, []


class _Walk:
    """The walk of one shard's trie along its sorted paths, with the nodes of the current path open."""

    def __init__(self, shard: int, skeleton: dict[tuple[int, bytes], int], send) -> None:
        self.shard, self.skeleton, self.send = shard, skeleton, send
        self.open: list[_Node] = []
        self.path, self.pieces = b"", 0

    def add(self, conv: int, path: bytes, lengths: list[int]) -> None:
        if path != self.path or not self.open:
            same, most = 0, min(len(path), len(self.path))
            while same < most and path[same : same + WIDTH] == self.path[same : same + WIDTH]:
                same += WIDTH
            self.close(same // WIDTH + 1)
            for depth in range(len(self.open), len(path) // WIDTH + 1):
                above = self.open[-1].skeleton if depth else 0
                number = self.skeleton.get((above, path[(depth - 1) * WIDTH : depth * WIDTH]), -1) if depth and above >= 0 else above
                self.open.append(_Node(conv, depth, lengths[depth - 1] if depth else 0, number))
            self.path = path
        last = self.open[-1]
        last.n, last.conv = last.n + 1, min(last.conv, conv)
        last.ends.append(str(conv))
        if len(last.ends) >= _PIECE:
            self.put_ends(last)

    def put_ends(self, node: _Node) -> None:
        """Hash the ids held, or send them where other shards may have more."""
        text = ",".join(node.ends)
        node.ends.clear()
        if node.skeleton >= 0:
            self.send(skeleton=node.skeleton, piece=(self.shard << 32) + self.pieces, ends=text)
            self.pieces += 1
        elif node.digest is None:
            node.digest = hashlib.sha256(text.encode())
        else:
            node.digest.update(f",{text}".encode())

    def close(self, left: int) -> None:
        """Close nodes from the deepest on until ``left`` are open; a node's children learn its least member now."""
        while len(self.open) > left:
            node = self.open.pop()
            above = self.open[-1] if self.open else None
            if above:
                above.n, above.conv = above.n + node.n, min(above.conv, node.conv)
            if node.ends:
                self.put_ends(node)
            for row in node.waiting:
                self.send(**row, parent_conv_id=node.conv)
            row = {"conv_id": node.conv, "depth": node.depth, "n_convs": node.n, "n_children": node.children}
            if node.skeleton >= 0:
                self.send(**row, skeleton=node.skeleton, bytes=node.size, n_leaves=node.leaves, saved_tokens=node.saved)
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
            row |= {"n_leaves": leaves, "saved_tokens": saved, "ends_sha256": (node.digest or hashlib.sha256()).hexdigest()}
            if above.skeleton >= 0:
                self.send(**row, skeleton=-1 - above.skeleton)
            else:
                above.waiting.append(row)


def walk(sharded: DataFrame, skeleton: dict[tuple[int, bytes], int]) -> DataFrame:
    """Rows of ``_PARTIAL`` from rows ``(shard, conv_id, path, bytes)``, each shard sorted in a task.

    ``skeleton`` null: a finished node. Negative, -1 - s: one that lacks its parent, skeleton node s. Else a
    shard's part of a skeleton node, or with ``piece`` some of its ends. A task holds the open path and, for its
    open nodes that lie in this shard alone, their children.
    """
    known = sharded.sparkSession.sparkContext.broadcast(skeleton)
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _PARTIAL.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        send = lambda **row: out.append(row)
        for batch in batches:
            for shard, conv, path, lengths in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.shard != shard:
                    if now:
                        now.close(0)
                    now = _Walk(shard, known.value, send)
                now.add(conv, path, lengths)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if now:
            now.close(0)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ordered = sharded.select("shard", "conv_id", "path", "bytes").sortWithinPartitions("shard", "path", "conv_id")
    return ordered.mapInArrow(run, _PARTIAL)


def _ends(pieces: DataFrame) -> DataFrame:
    """``(skeleton, ends_sha256)``: the hash of a skeleton node's ends, taken piece by piece in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([digest.hexdigest()])], ["skeleton", "ends_sha256"])
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == now:
                    digest.update(f",{text}".encode())
                    continue
                if now is not None:
                    yield one()
                now, digest = node, hashlib.sha256(text.encode())
        if now is not None:
            yield one()

    ordered = pieces.repartition("skeleton").sortWithinPartitions("skeleton", "piece")
    return ordered.select("skeleton", "ends").mapInArrow(run, "skeleton int, ends_sha256 string")


def _join_skeleton(parts: DataFrame, ends: DataFrame) -> DataFrame:
    """``(skeleton, *NODE)`` of the skeleton: parts are summed by node, then subtrees along the walk of their trie.

    The skeleton has at most as many nodes as the splitters have turns, whatever the number of conversations.
    """
    total = parts.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("bytes").alias("bytes"),
    ).join(ends, "skeleton", "left")
    order = ["skeleton", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes", "ends_sha256"]
    out_schema = f"skeleton int, {NODE}"
    names = [f.split()[0] for f in out_schema.split(", ")]
    empty = hashlib.sha256().hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        up: list[int] = []  # places of the rows on the way from the root
        for i, r in enumerate(rows):
            del up[r["depth"] :]
            r["parent"] = up[-1] if up else None
            if up:
                rows[up[-1]]["n_children"] += 1
            up.append(i)
        for r in reversed(rows):
            r["n_leaves"] += r["n_children"] == 0
            r["saved_tokens"] += (r["n_convs"] - 1) * r["bytes"]
            r["parent_conv_id"] = None
            if r["parent"] is not None:
                above = rows[r["parent"]]
                r["parent_conv_id"] = above["conv_id"]
                above["n_leaves"] += r["n_leaves"]
                above["saved_tokens"] += r["saved_tokens"]
            r["ends_sha256"] = r["ends_sha256"] or empty
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + 10_000]], pa.int32() if c == "skeleton" else None) for c in names], names) if rows else None

    return total.select(*order).repartition(1).sortWithinPartitions("skeleton").mapInArrow(run, out_schema)


def nodes(conversations: DataFrame, id_col: str = "conv_id", group: int = 5, shard_rows: int = 5_000, max_shards: int = 4_000) -> DataFrame:
    """Every node of the trie of rebuilt conversations, as ``NODE``.

    ``conv_id`` and depth name a node: its least member and its number of turns. Ends of a node are its members
    with no further turn. Shards hold about ``shard_rows`` conversations each, more beyond ``max_shards``; ties
    of equal paths are cut by id, so copies of one conversation spread over shards.

    Null roles and texts are empty, null turns come first, equal turns go by role and digest, repeated rows are
    turns of their own, rows without a ``conv_id`` are left out. No conversations, no nodes.
    """
    spark = conversations.sparkSession
    rows = materialize(paths(rebuilt(conversations, id_col, group)), "paths")
    shards = min(max_shards, -(-rows.count() // shard_rows))
    if not shards:
        return spark.createDataFrame([], NODE)
    cuts = splitters(rows, shards)
    skeleton = skeleton_of(cuts)
    known = spark.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)
            yield batch.append_column("shard", pa.array([bisect_right(known.value, k) for k in keys], pa.int32()))

    sharded = rows.mapInArrow(deal, "conv_id bigint, path binary, bytes array<bigint>, shard int")
    found = materialize(walk(sharded.repartition(shards, "shard"), skeleton), "trie")
    ends = _ends(found.where("piece is not null").select("skeleton", "piece", "ends"))
    joined = materialize(_join_skeleton(found.where("skeleton >= 0 and piece is null"), ends), "skeleton")
    names = [f.split()[0] for f in NODE.split(", ")]
    parents = joined.select(F.col("skeleton").alias("_s"), F.col("conv_id").alias("_parent"))
    orphans = found.where("skeleton < 0").join(F.broadcast(parents) if len(skeleton) < 200_000 else parents, -1 - F.col("skeleton") == F.col("_s"))
    orphans = orphans.withColumn("parent_conv_id", F.col("_parent")).select(*names)
    return found.where("skeleton is null").select(*names).unionByName(orphans).unionByName(joined.select(*names))
