"""Ranked lexical search: impact vectors in buckets by length, pruned by Cauchy-Schwarz and coordinate bounds, scored exactly.

A text's vector has, for each term it shares with a test item, the impact of the term; an item's has the weight of
each of its terms. The score is their product, a whole number. Lengths are those of the vectors with the weights
dealt evenly to both sides: |text|^2 = sum w * impact^2 and |item|^2 = sum w, so that score <= |text| * |item|.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.functions.scalars import int_div
from iotrace.llm.common import ASCII_LOWER, ASCII_UPPER
from iotrace.storage import materialize

#: The characters that end a term.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: A bound in floating point counts as this much more.
_SLACK = 1 + 1e-9
#: Coordinates in a bucket inside a task.
_BUCKET = 1 << 20


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.filter(F.split(F.translate(text, ASCII_UPPER, ASCII_LOWER), BREAKS), lambda t: t != "")


def _weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]), pa.int32()))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each row's values, and the values of all rows."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy()


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, tids, tfs)`` of texts with a term: how many terms it has, and its counts of those in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            ids, ns, tids, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = (text.as_py() or b"").translate(_BYTES).split()
                if found:
                    own = {number[t]: c for t, c in Counter(found).items() if t in number}
                    ids.append(doc_id)
                    ns.append(len(found))
                    tids.append(np.fromiter(own.keys(), np.int32, len(own)))
                    tfs.append(np.fromiter(own.values(), np.int32, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), _lists(tids), _lists(tfs)], ["doc_id", "n", "tids", "tfs"])

    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return cols.mapInArrow(run, "doc_id bigint, n bigint, tids array<int>, tfs array<int>")


def impact_vectors(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``(doc_id, length, tids, impacts)`` of the rows of ``count_terms`` that share a term of some weight with an item."""
    known = counts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, tids = _flat(batch.column(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            m = 50 + 50 * batch.column(1).to_numpy() * n_docs // n_terms
            tf = batch.column(3).flatten().to_numpy().astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
            w = known.value[tids]
            row, tids, impact, w = (x[w > 0] for x in (row, tids, impact, w))
            length = np.sqrt(np.bincount(row, w * impact.astype(np.float64) ** 2, batch.num_rows))
            ends = np.cumsum([0, *np.bincount(row, minlength=batch.num_rows)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (tids, impact)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), *lists], ["doc_id", "length", "tids", "impacts"])
            yield out.filter(pa.array(length > 0))

    return counts.mapInArrow(run, "doc_id bigint, length double, tids array<int>, impacts array<int>")


@dataclass
class Items:
    """A block of test items: the terms of item i are ``tids[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    tids: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.item = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        self.w = self.weights[self.tids]
        self.length = np.sqrt(np.bincount(self.item, self.w, len(self.starts) - 1))


class _Best:
    """The best rows of each item so far, and the score that a further row must reach."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.floor, self.k, self.rows = np.maximum(floor, 1), k, {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        new = (scores, ids, unknown)
        if item in self.rows:
            new = tuple(np.concatenate(x) for x in zip(self.rows[item], new, strict=True))
        order = np.lexsort((new[1], new[2], -new[0]))[: self.k]
        self.rows[item] = tuple(x[order] for x in new)
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], self.rows[item][0][-1])


def search_bucket(items: Items, best: _Best, ids: np.ndarray, unknown: np.ndarray, lengths: np.ndarray, starts: np.ndarray, tids: np.ndarray, impacts: np.ndarray) -> None:
    """Find the rows of one bucket that belong in ``best``; ``unknown`` marks rows without an id.

    Cauchy-Schwarz leaves out items whose floor the longest row cannot reach. The bucket's largest impact of each
    term bounds what a term can give: items whose terms together stay below the floor are left out too, and of the
    others those terms with the least bounds that together stay below it are put off. Only rows with one of the
    rest can reach the floor; those whose sum and bound of what was put off do are scored in whole numbers.
    """
    order = np.argsort(tids, kind="stable")
    row = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
    impact, sorted_tids = impacts[order].astype(np.int64), tids[order]
    present, first = np.unique(sorted_tids, return_index=True)
    last = np.append(first[1:], len(sorted_tids))
    top = np.maximum.reduceat(impact, first)
    at = np.minimum(np.searchsorted(present, items.tids), len(present) - 1)
    bound = np.where(present[at] == items.tids, items.w * top[at], 0)
    reach = np.minimum(items.length * lengths.max(), np.bincount(items.item, bound, len(best.floor))) * _SLACK
    for item in np.flatnonzero(reach >= best.floor):
        own = slice(items.starts[item], items.starts[item + 1])
        by_bound = np.argsort(bound[own], kind="stable")
        b, p, w = (x[own][by_bound] for x in (bound, at, items.w))
        put_off = np.cumsum(b)
        cut = int(np.searchsorted(put_off * _SLACK, best.floor[item]))
        rest = float(put_off[cut - 1]) if cut else 0.0
        spans = [slice(first[j], last[j]) for j in p[cut:]]
        sums = np.bincount(np.concatenate([row[s] for s in spans]), np.concatenate([x * impact[s] for x, s in zip(w[cut:].tolist(), spans, strict=True)]), len(ids))
        more = np.minimum(rest, math.sqrt(float(w[:cut].sum())) * lengths)
        near = np.flatnonzero((sums > 0) & ((sums + more) * _SLACK >= best.floor[item]))
        if not len(near):
            continue
        score = np.zeros(len(near), np.int64)
        for j, x, y in zip(p.tolist(), w.tolist(), b.tolist(), strict=True):
            if y:
                rows = row[first[j] : last[j]]
                place = np.minimum(np.searchsorted(rows, near), len(rows) - 1)
                score += np.where(rows[place] == near, x * impact[first[j] : last[j]][place], 0)
        good = near[score >= best.floor[item]]
        if len(good):
            best.add(int(item), score[score >= best.floor[item]], ids[good], unknown[good])


def _searched(vectors: DataFrame, items, floor: np.ndarray, k: int) -> DataFrame:
    """``(item, doc_id, score)``: of each task's rows the k best of each item that reach its floor; longest rows first."""
    floors = vectors.sparkSession.sparkContext.broadcast(floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(floors.value, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(0).to_numpy()
            unknown, lengths = batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            starts, tids = _flat(batch.column(2))
            impacts = batch.column(3).flatten().to_numpy()
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + _BUCKET, "right")) - 1)
                s = slice(starts[a], starts[b])
                search_bucket(items.value, best, ids[a:b], unknown[a:b], lengths[a:b], starts[a : b + 1] - starts[a], tids[s], impacts[s])
                a = b
        for item, (scores, found, none) in best.rows.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item, np.int32)), pa.array(found, mask=none), pa.array(scores)], ["item", "doc_id", "score"])

    return vectors.sortWithinPartitions(F.desc("length")).mapInArrow(run, "item int, doc_id bigint, score bigint")


def _best_rows(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = W.partitionBy(by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, rows: list, k: int, id_col: str, text_col: str, shares: tuple[float, ...], item_type: str) -> DataFrame | None:
    """``(item_id, rank, doc_id, score)`` for one block of ``(item_id, term)`` rows; None where no text has a term of them."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    own: dict[object, list[int]] = {}
    for r in rows:
        own.setdefault(r["item_id"], []).append(vocabulary.setdefault(r["term"].encode("utf-8", "surrogatepass"), len(vocabulary)))
    counts = materialize(count_terms(docs, vocabulary, id_col, text_col), "term-counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.full(len(vocabulary), _weight(n_docs, 0), np.int64)
    for r in counts.select(F.explode("tids").alias("tid")).groupBy("tid").count().collect():
        weights[r["tid"]] = _weight(n_docs, r["count"])
    vectors = materialize(impact_vectors(counts, weights, n_docs, n_terms), "impact-vectors")
    block = Items(np.cumsum([0, *map(len, own.values())]), np.concatenate([np.array(x, np.int64) for x in own.values()]), weights)
    shared, floor, best = spark.sparkContext.broadcast(block), np.zeros(len(own), np.int64), None
    cuts = vectors.agg(F.percentile_approx("length", [1 - s for s in shares], 1000)).first()[0]
    if cuts is None:
        return None
    for low, high in zip([*cuts, 0.0], [math.inf, *cuts], strict=True):
        # no shorter row can reach any item's floor
        low = max(low, float((floor / np.maximum(block.length, 1e-9)).min()) / _SLACK)
        part = vectors.where((F.col("length") >= low) & (F.col("length") < high))
        found = _searched(part, shared, floor, k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = materialize(_best_rows(found, "item", k), "best-rows")
        for r in best.where(F.col("rank") == k).select("item", "score").collect():
            floor[r["item"]] = r["score"]
    names = spark.createDataFrame([(i, x) for i, x in enumerate(own)], f"item int, item_id {item_type}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _search_by_join(docs: DataFrame, item_terms: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """The same for items whose terms are too many to be sent to tasks: joins by term, each text scored for each such item."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), terms(F.col(text_col)).alias("t"))
    totals = rows.agg(F.count_if(F.size("t") > 0).alias("n_texts"), F.sum(F.greatest(F.size("t"), F.lit(0))).cast("bigint").alias("n_all"))
    counts = rows.where(F.size("t") > 0).select("row", "doc_id", F.size("t").cast("bigint").alias("n"), F.explode("t").alias("term"))
    counts = counts.groupBy("row", "doc_id", "n", "term").agg(F.count("*").alias("tf"))
    counts = materialize(counts.join(item_terms.select("term").distinct(), "term"), "term-counts")
    df = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(totals))
    weight = F.floor(1000 * F.log((2 * F.col("n_texts") + 2).cast("double") / (2 * F.col("df") + 1))).cast("bigint")
    df = df.select("term", weight.alias("w"), "n_texts", "n_all")
    m = 50 + int_div(50 * F.col("n") * F.col("n_texts"), F.col("n_all"))
    impact = int_div(F.col("tf") * 1_000_000_000, F.col("tf") * 1000 + 20 * m)
    scored = counts.join(df, "term").select("term", "row", "doc_id", (F.col("w") * impact).alias("part")).join(item_terms, "term")
    scored = scored.groupBy("item_id", "row", "doc_id").agg(F.sum("part").alias("score")).where("score > 0")
    return _best_rows(scored, "item_id", k).select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", max_terms: int = 400_000, shares: tuple[float, ...] = (0.02, 0.2),
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k texts of each item with the highest scores above 0; equal scores by id, null last.

    Items go in blocks of at most ``max_terms`` different terms (each item counts 20 more), the only thing sent to
    tasks whole; each block counts its terms in every text once. Vectors are searched in rounds, the longest
    ``shares`` first, and what is the k-th best score so far is the floor of the next round, below whose reach
    rows are not even read. Every task goes through its rows from long to short in buckets and has floors of its
    own that rise. An item with more terms than a block may have is scored by joins. No row moves but the k best
    of a task for an item.

    Null or empty texts have no terms; items without terms have no rows. Texts of equal ``item_id`` are one item,
    null included. Repeated rows of ``docs`` are ranked each. Other columns are not looked at. Without texts, or
    without items, there are no rows.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType.simpleString()
    schema = f"item_id {item_type}, rank int, doc_id bigint, score bigint"
    pairs = items.select(F.col(item_col).alias("item_id"), F.explode(terms(F.col(item_text_col))).alias("term")).distinct()
    pairs = materialize(pairs, "item-terms")
    sizes = pairs.groupBy("item_id").agg((F.count("*") + 20).alias("cost"))
    fits = sizes.where(F.col("cost") <= max_terms)
    total, most = sizes.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.coalesce(F.max("cost"), F.lit(0))).first()
    out = []
    if total and (fits_any := fits.agg(F.sum("cost")).first()[0]):
        n = 1 if fits_any <= max_terms else 2 * -(-fits_any // max_terms)
        number = lambda n: F.pmod(F.xxhash64(F.col("item_id")), F.lit(n))
        while n > 1 and fits.groupBy(number(n)).agg(F.sum("cost").alias("c")).agg(F.max("c")).first()[0] > max_terms:
            n *= 2
        numbered = pairs.join(fits.select(F.col("item_id").alias("_id")), F.col("item_id").eqNullSafe(F.col("_id")), "left_semi")
        numbered = materialize(numbered.withColumn("block", number(n)), "item-terms") if n > 1 else numbered.withColumn("block", F.lit(0))
        for b in range(n):
            rows = numbered.where(F.col("block") == b).select("item_id", "term").orderBy("item_id", "term").collect()
            found = _search_block(docs, rows, k, id_col, text_col, shares, item_type) if rows else None
            out += [found] if found is not None else []
    if most > max_terms:
        long = pairs.join(sizes.where(F.col("cost") > max_terms).select(F.col("item_id").alias("_id")), F.col("item_id").eqNullSafe(F.col("_id")), "left_semi")
        out.append(_search_by_join(docs, long, k, id_col, text_col))
    if not out:
        return spark.createDataFrame([], schema)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
