"""Near-copy groups by exact Jaccard similarity of word shingles: a step behind the fingerprints of ``simhash``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.llm.common import connected_components
from iotrace.llm.simhash import _LOWER, SEED, fingerprint, links
from iotrace.storage import materialize

#: 25 bands of 5 minima. A pair of similarity s shares a band with probability 1 - (1 - s^5)^25,
#: which is 0.99995 at 0.8 and grows with s.
BANDS, ROWS = 25, 5
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64) | np.uint64(1)
#: Shingles whose minima are taken at once, so that memory does not follow the length of a text.
_CHUNK = 1 << 12
#: Buckets above this many texts are compared as pairs of chunks of this size, in groups of their own.
CHUNK_ROWS = 256


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted different hashes of the word shingles; a text of fewer words is one shingle, one without words none."""
    import xxhash

    toks = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    width = min(width, len(toks))
    if not width:
        return np.empty(0, np.uint64)
    n = len(toks) - width + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(toks[k : k + width]), SEED) for k in range(n)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key a band from the minima of its rows, the band being part of the key; all texts without words agree."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), _CHUNK):
        mixed = (hashes[lo : lo + _CHUNK, None] ^ _MIX[0]) * _MIX[1]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _MIX[2]).min(0))
    parts = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ parts[:, k]) * _MIX[1, 0]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _texts(docs: DataFrame, width: int) -> DataFrame:
    """``(key, least_doc, text, bands, fp)`` of each different text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(bands=[bands(shingles(t, width)) for t in pdf["text"]], fp=[fingerprint(t, width) for t in pdf["text"]])

    rows = docs.groupBy("key").agg(F.min("doc_id").alias("least_doc"), F.first("text").alias("text"))
    return rows.mapInPandas(run, "key bigint, least_doc bigint, text string, bands array<bigint>, fp bigint")


def _fingerprint_stars(texts: DataFrame, max_bits: int) -> DataFrame:
    """``(a, b)``: each text with the least one of those that fingerprints within ``max_bits`` connect it with."""
    roots = materialize(connected_components(links(texts.select("fp").distinct(), max_bits)), "fingerprint-groups")
    grouped = texts.select("key", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return grouped.join(least, "group").where("key <> a").select("a", F.col("key").alias("b"))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``(key, bands, set)`` with the shingle hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, width).view(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "bands": pdf["bands"], "set": sets})

    return texts.select("key", "bands", "text").mapInPandas(run, "key bigint, bands array<bigint>, set array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a Jaccard similarity of ``least`` or more; two empty sets have."""
    x = sets.select(F.col("key").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(y, "b").join(x, "a").where(both >= F.lit(least) * (F.size("x") + F.size("y") - both)).select("a", "b")


def _group_edges(least: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Edges that connect the alike texts of one bucket, or of two chunks of it, that have no connection yet."""
        band, i, j = key
        chunk = pdf["c"].to_numpy()
        names = pdf["key"].to_numpy(np.int64)
        marks = np.stack(pdf["bands"].to_list())
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in pdf["set"]]
        size = np.array([len(s) for s in sets])
        _, group = np.unique(pdf["comp"].to_numpy(np.int64), return_inverse=True)
        edges = []
        for p in range(len(names) - 1):
            far = group[p + 1 :] != group[p]
            if i != j:
                far &= chunk[p + 1 :] != chunk[p]
            rest = p + 1 + np.flatnonzero(far)
            rest = rest[np.minimum(size[rest], size[p]) >= least * np.maximum(size[rest], size[p])]
            same = marks[rest] == marks[p]
            rest = rest[marks[p][same.argmax(1)] == band]  # the other bands they share have them elsewhere
            for q in rest:
                if group[q] == group[p]:
                    continue
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if both >= least * (size[p] + size[q] - both):
                    edges.append((names[p], names[q]))
                    group[group == group[q]] = group[p]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, chunk_rows: int = CHUNK_ROWS, max_bits: int = 3
) -> DataFrame:
    """``(doc_id, component_id)`` for every row; component_id is the least id that links reach.

    Two texts are linked if the Jaccard similarity of their shingle sets is ``least`` or more, which is computed
    for every candidate. Candidates are those that fingerprints within ``max_bits`` connect, and, since at 0.8
    fingerprints differ in about ten bits of 64, those that share a band. First each text is held against the
    least text of its fingerprint group and of its buckets; then all pairs of a bucket that these links leave apart, each under the first band that it shares. Buckets of
    more than ``chunk_rows`` are searched a pair of chunks at a time, so no task holds a whole one.

    Exact copies meet once, as one text. Texts without words are linked with each other. A row with a null id gets
    the component of its text; repeated rows are all returned; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", text_key(F.col("text")))
    texts = materialize(_texts(rows, width), "texts")
    keyed = texts.select("key", F.explode("bands").alias("band"))
    buckets = materialize(keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("a")).where("n > 1"), "buckets")
    keyed = materialize(keyed.join(buckets, "band"), "bucket-texts")
    close = materialize(_fingerprint_stars(texts, max_bits), "fingerprint-stars")
    stars = keyed.where("key <> a").select("a", F.col("key").alias("b")).unionByName(close).distinct()
    stars = materialize(stars, "candidates")
    member = keyed.select("key").unionByName(close.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    sets = materialize(_sets(texts.join(member, "key", "left_semi"), width), "shingles")
    edges = materialize(_alike(stars, sets, least), "alike")
    roots = materialize(connected_components(edges), "components")

    parted = keyed.join(roots, keyed["key"] == roots["node"], "left").select("band", "key", "n", F.coalesce("component", "key").alias("comp"))
    parted = materialize(parted, "bucket-components")
    apart = materialize(parted.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band"), "buckets-apart")
    if apart.take(1):
        chunks = F.ceil(F.col("n") / chunk_rows).cast("int")
        dealt = parted.join(apart, "band").withColumn("chunks", chunks)
        dealt = dealt.withColumn("c", F.pmod(F.xxhash64("key", "band"), F.col("chunks")).cast("int"))
        dealt = dealt.join(sets, "key").select("*", F.explode(F.expr("sequence(0, chunks - 1)")).alias("o"))
        dealt = dealt.select("band", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "key", "comp", "bands", "set")
        more = dealt.groupBy("band", "i", "j").applyInPandas(_group_edges(least), "a bigint, b bigint")
        more = materialize(more, "alike")
        if more.take(1):
            roots = materialize(connected_components(edges.unionByName(more)), "components")

    members = texts.select("key", "least_doc").join(roots.withColumnRenamed("node", "key"), "key", "left")
    members = members.select("key", "least_doc", F.coalesce("component", "key").alias("component"))
    found = members.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    labelled = members.join(found, "component").select("key", "component_id")
    return rows.select("doc_id", "key").join(labelled, "key").select("doc_id", "component_id")
