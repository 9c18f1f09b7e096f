"""SimHash near-duplicate groups: pigeonhole blocks, join on blocks, verified Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrace.llm.common import connected_components
from iotrace.storage import materialize

#: The shingle hash is XXH64 with seed 42; A-Z are lowered, other letters are not.
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A chunk of hashes whose bits are counted at once, so that memory does not follow the length of a text.
_CHUNK = 1 << 16
#: Buckets above this many fingerprints are compared as pairs of chunks of this size, in tasks of their own.
CHUNK_ROWS = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of one text, as a signed number; 0 without words."""
    import xxhash

    toks = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not toks:
        return 0
    joined = b" ".join(toks)
    width = min(width, len(toks))
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(toks) - width + 1
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        spans = zip(starts[lo:hi].tolist(), ends[lo + width - 1 : hi + width - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, hi - lo)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp bigint)`` for every row; a null text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": [fingerprint(t, width) for t in pdf["text"]]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, fp bigint")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of ``max_bits + 2`` blocks that cover 64 bits: two of them agree in any close pair."""
    n = max_bits + 2
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(widths[:k]), widths[k]) for k in range(n)]


def _keys(fp: F.Column, max_bits: int) -> F.Column:
    """One key for each choice of two blocks; the choice is part of the key."""
    parts = [F.shiftrightunsigned(fp, s).bitwiseAND((1 << w) - 1) for s, w in _blocks(max_bits)]
    width = max(w for _, w in _blocks(max_bits))
    pairs = list(combinations(range(len(parts)), 2))
    return F.array(
        *[F.lit(k << (2 * width)) + F.shiftleft(parts[a], width) + parts[b] for k, (a, b) in enumerate(pairs)]
    )


def _near(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= max_bits


def _span(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect all that is linked within one bucket: a search that meets each fingerprint once."""
    left, edges = fps, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = _near(left, at, max_bits)
            found = left[hit]
            edges += [(at, x) for x in found]
            front += list(found)
            left = left[~hit]
    return edges


def _small(fps: np.ndarray, group: np.ndarray, longest: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked pairs of buckets of at most ``longest`` rows, found for all buckets at once."""
    for step in range(1, longest):
        same = group[step:] == group[:-step]
        if not same.any():
            return
        hit = same & _near(fps[step:], fps[:-step], max_bits)
        yield fps[:-step][hit], fps[step:][hit]


def _bucket_edges(max_bits: int, small: int = 16):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by key; the last bucket of a batch waits for the next batch."""
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def work(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
            cuts = np.flatnonzero(np.diff(k)) + 1
            starts = np.concatenate(([0], cuts))
            sizes = np.diff(np.concatenate((starts, [len(k)])))
            group = np.repeat(np.arange(len(sizes)), sizes)
            little = np.repeat((sizes > 1) & (sizes <= small), sizes)
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for x, y in _small(f[little], group[little], small, max_bits):
                a.append(x)
                b.append(y)
            for i in np.flatnonzero(sizes > small):
                edges = _span(f[starts[i] : starts[i] + sizes[i]], max_bits)
                if edges:
                    x, y = zip(*edges, strict=True)
                    a.append(np.array(x, np.uint64))
                    b.append(np.array(y, np.uint64))
            return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

        for pdf in batches:
            if not len(pdf):
                continue
            k = np.concatenate((held_k, pdf["key"].to_numpy(np.int64)))
            f = np.concatenate((held_f, pdf["fp"].to_numpy(np.int64).view(np.uint64)))
            cut = int(np.searchsorted(k, k[-1]))
            held_k, held_f = k[cut:], f[cut:]
            if cut:
                yield work(k[:cut], f[:cut])
        if len(held_k):
            yield work(held_k, held_f)

    return run


def _chunk_edges(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                edges = _span(np.unique(np.concatenate((x, y))).astype(np.int64).view(np.uint64), max_bits)
                a, b = zip(*edges, strict=True) if edges else ((), ())
                yield pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})

    return run


def links(fps: DataFrame, max_bits: int = 3, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect exactly what pairs within ``max_bits`` connect.

    Fingerprints are cut into ``max_bits + 2`` blocks; a close pair agrees in two of them, so it meets under the
    key of those two. A bucket is searched where it lies; within it only a spanning set of its links is returned.
    Buckets of more than ``chunk_rows`` are cut into chunks, and each pair of chunks is searched in a row of its
    own, so that no task holds a whole hot bucket and no link is lost.
    """
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), max_bits)).alias("key"))
    hot = materialize(keyed.groupBy("key").count().where(F.col("count") > chunk_rows), "hot-keys")
    any_hot = bool(hot.take(1))
    cold = keyed.join(hot.select("key"), "key", "left_anti") if any_hot else keyed
    edges = cold.repartition("key").sortWithinPartitions("key").mapInPandas(_bucket_edges(max_bits), "a bigint, b bigint")
    if any_hot:
        chunks = F.ceil(F.col("count") / chunk_rows).cast("int")
        part = (
            keyed.join(hot.select("key", chunks.alias("n")), "key")
            .withColumn("c", F.pmod(F.xxhash64("fp", "key"), F.col("n")).cast("int"))
            .groupBy("key", "n", "c")
            .agg(F.collect_list("fp").alias("fps"))
        )
        left = part.select("key", F.col("c").alias("i"), F.explode(F.expr("sequence(c, n - 1)")).alias("j"), F.col("fps").alias("x"))
        right = part.select("key", F.col("c").alias("j"), F.col("fps").alias("y"))
        edges = edges.unionByName(left.join(right, ["key", "j"]).select("x", "y").mapInPandas(_chunk_edges(max_bits), "a bigint, b bigint"))
    return edges


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    max_bits: int = 3,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; component_id is the least id that links reach.

    Texts without words have fingerprint zero and are linked like others. Exact copies meet once, as one
    fingerprint. A row with a null id gets the component of its fingerprint (null if no id is in it); repeated
    rows are all returned; an empty table gives no rows.
    """
    docs_fp = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    by_fp = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least_doc"))
    roots = materialize(connected_components(links(by_fp.select("fp"), max_bits, chunk_rows)), "components")
    members = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    members = members.select("fp", "least_doc", F.coalesce("component", "fp").alias("component"))
    least = members.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    labelled = members.join(least, "component").select("fp", "component_id")
    return docs_fp.join(labelled, "fp").select("doc_id", "fp", "component_id")


def hex64(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
