"""Benchmark decontamination: pigeonhole pieces of test items, exact piece hits, Myers bit-parallel verification."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrace.storage import materialize

_TOKEN = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; marks and white space do not count."""
    return _TOKEN.findall((text or "").lower())


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of ``budget + 1`` pieces of ``n`` words: one of them is untouched by ``budget`` edits."""
    cuts = [n * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict, n: int, text: list) -> tuple[int, int]:
    """(least distance, end) of a pattern of ``n`` symbols against all substrings of ``text``; ends are exclusive.

    ``masks[s]`` has bit k set where the pattern's symbol k is s. Python integers are the bit vectors, so a
    pattern may have any length. Of equal distances the first end counts.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, s in enumerate(text, 1):
        eq = masks.get(s, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        hp, hn = (minus | ~(plus | d0)) & full, plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & full, (hn << 1) & full
        plus, minus = (hn | ~(d0 | hp)) & full, hp & d0
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Index:
    """The pieces of test items by rolling hash, and each item's bit masks."""

    error_rate: float
    min_words: int
    vocab: dict[str, int] = field(default_factory=dict)
    items: list[tuple[int, int, int, dict[int, int]]] = field(default_factory=list)
    hits: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], error_rate: float, min_words: int) -> Index:
        self, found = cls(error_rate, min_words), {}
        for item_id, text in rows:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in tokens(text)]
            n = len(ids)
            if not n:
                continue
            budget = math.floor(error_rate * n) if n >= min_words else 0
            masks: dict[int, int] = {}
            for k, s in enumerate(ids):
                masks[s] = masks.get(s, 0) | 1 << k
            arr = np.array(ids, np.uint64)
            for start, length in pieces(n, budget):
                h = int(_rolling(arr[start : start + length], length)[0])
                found.setdefault(length, {}).setdefault(h, []).append((len(self.items), start))
            self.items.append((item_id, n, budget, masks))
        for length, by_hash in found.items():
            keys = np.array(sorted(by_hash), np.uint64)
            self.hits[length] = keys, [by_hash[int(k)] for k in keys]
        return self

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, words) of each item found in the whole text within its budget."""
        get = self.vocab.get
        ids = [get(w, 0) for w in tokens(text)]
        arr, spans = np.array(ids, np.uint64), {}
        for length, (keys, owners) in self.hits.items():
            if len(ids) < length:
                continue
            h = _rolling(arr, length)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for p in np.flatnonzero(keys[at] == h):
                for item, start in owners[at[p]]:
                    _, n, budget, _ = self.items[item]
                    spans.setdefault(item, []).append((max(0, p - start - budget), min(len(ids), p - start + n + budget)))
        out = []
        for item in sorted(spans):
            item_id, n, budget, masks = self.items[item]
            if best := _best_place(masks, n, budget, ids, spans[item]):
                out.append((item_id, *best))
        return out


def _best_place(masks: dict, n: int, budget: int, words: list, spans: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """(distance, first word, words) of the best match of a pattern within its budget in spans of a text."""
    best = None
    for lo, hi in _merged(spans):
        distance, end = myers(masks, n, words[lo:hi])
        if distance <= budget and (best is None or distance < best[0]):
            # the pattern backwards from that end gives the start
            back = {s: int(f"{m:0{n}b}"[::-1], 2) for s, m in masks.items()}
            _, size = myers(back, n, words[lo : lo + end][::-1])
            best = distance, lo + end - size, size
    return best and (int(best[0]), int(best[1]), int(best[2]))


def _rolling(arr: np.ndarray, length: int) -> np.ndarray:
    n = len(arr) - length + 1
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = (h ^ (arr[k : k + n] + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(31)
    return h


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _searcher(shared):
    @F.pandas_udf("array<struct<item_id:bigint,distance:int,first_word:bigint,n_words:bigint>>")
    def search(texts: pd.Series) -> pd.Series:
        names = ("item_id", "distance", "first_word", "n_words")
        return pd.Series([[dict(zip(names, m, strict=True)) for m in shared.value.search(t)] for t in texts], dtype=object)

    return search


#: Words of a piece that it is looked up by: all of up to eight, the first eight or sixteen of longer ones.
_LENGTHS = (16, *range(8, 0, -1))
_PIECE = "item bigint, length int, hash bigint, back bigint, span bigint"


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 1_000_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def _piece_table(items: DataFrame, error_rate: float, min_words: int) -> DataFrame:
    """``_PIECE`` of ``(item, item_text)``: where a piece is found at word p, its item lies in the ``span`` words from p - ``back`` on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item"], pdf["item_text"], strict=True):
                arr = _word_hashes(tokens(text), known)
                n = len(arr)
                budget = math.floor(error_rate * n) if n >= min_words else 0
                for start, size in pieces(n, budget) if n else ():
                    length = next(q for q in _LENGTHS if q <= size)
                    rows.append((item, length, int(_rolling(arr[start : start + length], length)[0].astype(np.int64)), start + budget, n + 2 * budget))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _PIECE.split(", ")])

    return items.mapInPandas(run, _PIECE)


def _bitmap(hashes: DataFrame, most_bits: int = 1 << 27) -> tuple[int, np.ndarray]:
    """(bits, words of 64): a bit for each hash, of ``most_bits`` at most, so what is broadcast is bounded; it only saves rows."""
    n = hashes.count()
    bits = min(most_bits, max(1 << 10, 1 << (16 * n).bit_length()))
    at = F.pmod(F.col("hash"), F.lit(bits))
    got = hashes.select((F.shiftright(at, 6)).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint64)
    return bits, out


def _found_by_table(texts: DataFrame, benchmark: DataFrame, error_rate: float, min_words: int) -> DataFrame:
    """``(key, item_id, distance, first_word, n_words)`` of ``texts(key, text)`` for a benchmark too large to be sent to tasks.

    Pieces are a table that tasks build and the texts' runs of words are joined with it on (length, hash), after a
    bitmap of bounded size has left out most of those that no piece has. Only texts with a hit are read again and
    verified, each with its candidate items.
    """
    spark = texts.sparkSession
    items = materialize(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").alias("item_text")), "items")
    table = materialize(_piece_table(items.select("item", "item_text"), error_rate, min_words), "pieces")
    lengths = sorted(r["length"] for r in table.select("length").distinct().collect())
    bits, bitmap = _bitmap(table.select("hash").distinct())
    shared = spark.sparkContext.broadcast(bitmap)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                arr = _word_hashes(tokens(text), known)
                for length in lengths:
                    if len(arr) >= length:
                        h = _rolling(arr, length)
                        bit = h.astype(np.int64) % bits
                        at = np.flatnonzero(shared.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
                        yield pd.DataFrame({"key": key, "length": np.int32(length), "hash": h[at].astype(np.int64), "p": at.astype(np.int64)})

    found = texts.mapInPandas(hits, "key string, length int, hash bigint, p bigint").join(table, ["length", "hash"])
    lo = F.greatest(F.col("p") - F.col("back"), F.lit(0))
    spans = found.groupBy("key", "item").agg(F.collect_set(F.struct(lo.alias("lo"), (F.col("p") - F.col("back") + F.col("span")).alias("hi"))).alias("spans"))
    spans = materialize(spans, "candidates")
    again = texts.join(spans.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    rows = spans.join(items, "item").join(again, "key").repartition("key").sortWithinPartitions("key")
    out = "key string, item_id bigint, distance int, first_word bigint, n_words bigint"

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, words = None, []
        for pdf in batches:
            good = []
            for key, item_id, item_text, places, text in zip(pdf["key"], pdf["item_id"], pdf["item_text"], pdf["spans"], pdf["text"], strict=True):
                if key != last:
                    last, words = key, tokens(text)
                pattern = tokens(item_text)
                n = len(pattern)
                budget, masks = math.floor(error_rate * n) if n >= min_words else 0, {}
                for k, w in enumerate(pattern):
                    masks[w] = masks.get(w, 0) | 1 << k
                best = _best_place(masks, n, budget, words, [(s["lo"], min(s["hi"], len(words))) for s in places])
                if best:
                    good.append((key, None if pd.isna(item_id) else int(item_id), *best))
            yield pd.DataFrame(good, columns=[f.split()[0] for f in out.split(", ")]).astype({"item_id": "Int64"})

    return rows.select("key", "item_id", "item_text", "spans", "text").mapInPandas(verify, out)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    return rows, rows.agg(F.sum(F.length("text"))).first()[0] or 0


def _finder(rows: DataFrame, error_rate: float, min_words: int):
    """A function from text to the items found in it, for a benchmark small enough to be sent to every task."""
    got = sorted(((r["item_id"], r["text"]) for r in rows.collect()), key=lambda r: (r[0] is None, r))
    return _searcher(rows.sparkSession.sparkContext.broadcast(Index.build(got, error_rate, min_words)))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.sha2(text, 256).alias("key"), text.alias("text"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    error_rate: float = 0.2, min_words: int = 8, block_chars: int = 20_000_000,
) -> DataFrame:
    """``(doc_id, item_id, distance, first_word, n_words)``: one row for each document and test item found in it.

    Edits are of words: an item of n words may differ by ``error_rate * n`` inserted, lost or changed words
    anywhere, one of fewer than ``min_words`` by none; items without words match nothing. A benchmark of up to
    ``block_chars``, which are counted, is sent to the tasks; a larger one is a table of pieces that the texts are
    joined with, in one pass whatever its size. Documents that hold no item give no row; a null text holds none;
    repeated rows each give theirs. Of equal distances the first place in the text counts.
    """
    rows, chars = _items(benchmark, item_col, item_text_col)
    if chars <= block_chars:
        out = docs.select(F.col(id_col).alias("doc_id"), _finder(rows, error_rate, min_words)(F.col(text_col)).alias("found"))
        return out.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")
    found = materialize(_found_by_table(_keyed(docs, text_col), rows, error_rate, min_words), "items-found")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("key"))
    return keyed.join(found, "key").drop("key")


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.2, min_words: int = 8,
    block_chars: int = 20_000_000,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item; a null text holds none. Otherwise as ``contaminated``."""
    rows, chars = _items(benchmark, item_col, item_text_col)
    if chars <= block_chars:
        return docs.where(F.size(_finder(rows, error_rate, min_words)(F.col(text_col))) == 0)
    found = materialize(_found_by_table(_keyed(docs, text_col), rows, error_rate, min_words).select(F.col("key").alias("_found")).distinct(), "items-found")
    return docs.join(found, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col("_found"), "left_anti")
