"""Toxicity: a logistic classifier whose scores may not change when identity terms are swapped."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.storage import materialize

_TOKEN = re.compile(r"[^\W\d_]+")
#: Neutral names of groups of people, in sets within which one may stand for another.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("homosexual", "bisexual"), ("transgender", "cisgender"),
    ("black", "white"), ("african", "european", "asian", "american", "mexican", "chinese", "indian", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("immigrant", "native", "refugee", "citizen"), ("immigrants", "natives", "refugees", "citizens"),
    ("deaf", "blind", "disabled"), ("old", "young"), ("frauen", "männer"), ("juden", "christen", "muslime"),
    ("schwarze", "weiße"), ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"), ("negros", "blancos"),
)
_PREFIXES = (4, 5, 6)


def word_features(word: str) -> tuple[str, ...]:
    """A word, and its beginnings if it is longer."""
    return (word, *("~" + word[:k] for k in _PREFIXES if len(word) > k))


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def word_set(text: str | None) -> set[str]:
    return set(_TOKEN.findall((text or "").lower()))


@dataclass
class ToxicityModel:
    """Weights of the chosen features; the score is the logistic of the bias and the weights of those present.

    ``groups`` are the sets of terms that were swapped, ``n_swapped`` counts the labelled texts that had one.
    """

    index: dict[str, int]
    weights: np.ndarray
    bias: float
    groups: tuple[tuple[str, ...], ...] = ()
    n_swapped: int = 0

    def scorer(self, cache_words: int = 200_000):
        """A function from text to score; each word's features are looked up once per worker, in a bounded cache."""
        cache: dict[str, tuple[int, ...]] = {}
        index, weights = self.index, self.weights

        def score(text: str | None) -> float:
            found: set[int] = set()
            for w in word_set(text):
                ids = cache.get(w)
                if ids is None:
                    if len(cache) >= cache_words:
                        cache.clear()
                    ids = cache[w] = tuple(index[f] for f in word_features(w) if f in index)
                if ids:
                    found.update(ids)
            z = self.bias + math.fsum(weights[i] for i in found)
            return 1.0 / (1.0 + math.exp(-z)) if z >= 0 else math.exp(z) / (1.0 + math.exp(z))

        return score


def _sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled ids, those of least hash; a doubly labelled id counts as its highest label."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, max_rows / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))


def _document_counts(train: DataFrame) -> DataFrame:
    """``(feature, n, toxic)``: how many texts, and how many toxic ones, have each feature. Tasks add up in bounded pieces."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter[str], Counter[str]] = Counter(), Counter()

        def out() -> pd.DataFrame:
            names = [f for h in held for f in h]
            n = [c for h in held for c in h.values()]
            toxic = [0] * len(held[0]) + list(held[1].values())
            for h in held:
                h.clear()
            return pd.DataFrame({"feature": pd.Series(names, dtype=object), "n": pd.Series(n, dtype="int64"), "toxic": pd.Series(toxic, dtype="int64")})

        for pdf in batches:
            for y, text in zip(pdf["y"], pdf["text"], strict=True):
                held[y].update(features(word_set(text)))
                if len(held[0]) + len(held[1]) > 200_000:
                    yield out()
        yield out()

    counts = train.select("y", "text").mapInPandas(count, "feature string, n bigint, toxic bigint")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def widened_groups(
    train: DataFrame, counts: DataFrame, n_texts: int, groups: tuple[tuple[str, ...], ...], max_terms: int = 512, min_texts: int = 20, max_share: float = 0.1,
    min_affinity: float = 0.6,
) -> tuple[tuple[str, ...], ...]:
    """The identity sets, each with the words that stand among the same neighbours as its own terms do in the labelled texts.

    Only a given term can seed a set, so what is swapped are names of groups. Candidates are the ``max_terms`` words
    in most texts, of at least ``min_texts`` and at most a ``max_share`` of all, which leaves function words out.
    Affinity is that of the square roots of the shares of the words beside a word; a candidate joins the set of the
    seed it is nearest to, from ``min_affinity`` on. Where no text has a seed in ``min_texts`` of them, the sets stay
    as they are.
    """
    given = sorted({t for g in groups for t in g})
    rows = counts.where((F.col("n") >= min_texts) & ~F.col("feature").startswith("~"))
    seeds = sorted(r["feature"] for r in rows.join(F.broadcast(counts.sparkSession.createDataFrame([(t,) for t in given], "feature string")), "feature").collect()) if given else []
    if not seeds:
        return groups
    around = [r["feature"] for r in rows.orderBy(F.desc("n"), "feature").limit(max_terms).collect()]
    some = rows.where(F.col("n") <= max_share * n_texts).orderBy(F.desc("n"), "feature").limit(max_terms).collect()
    names = [*seeds, *(r["feature"] for r in some if r["feature"] not in given)]
    shared = train.sparkSession.sparkContext.broadcast((names, around))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, beside = ({w: i for i, w in enumerate(x)} for x in shared.value)
        held = np.zeros((len(own), 2 * len(beside)), np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                words = _TOKEN.findall((text or "").lower())
                for left, right in zip(words, words[1:], strict=False):
                    if left in own and right in beside:
                        held[own[left], beside[right]] += 1
                    if right in own and left in beside:
                        held[own[right], len(beside) + beside[left]] += 1
        at, to = np.nonzero(held)
        yield pd.DataFrame({"a": at, "b": to, "n": held[at, to]})

    near = np.zeros((len(names), 2 * len(around)))
    for r in train.select("text").mapInPandas(count, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        near[r["a"], r["b"]] = r["n"]
    near = np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1.0))
    affinity = np.round(near[len(seeds) :] @ near[: len(seeds)].T, 9)
    more: dict[str, list[str]] = {}
    for name, to in zip(names[len(seeds) :], affinity, strict=True):
        best = int(np.argmax(to))
        if to[best] >= min_affinity:
            more.setdefault(seeds[best], []).append(name)
    return tuple((*g, *(w for t in g for w in more.get(t, ()))) for g in groups)


def _g_statistic(table: np.ndarray, neg: int, pos: int) -> np.ndarray:
    """How much each feature's presence tells about the label: the log-likelihood ratio of the 2x2 table."""
    cells = [table[1], table[0], pos - table[1], neg - table[0]]
    present, n = table.sum(0), pos + neg
    expect = [present * pos / n, present * neg / n, (n - present) * pos / n, (n - present) * neg / n]
    return 2 * sum(np.where(c > 0, c * np.log(np.maximum(c, 1e-12) / np.maximum(e, 1e-12)), 0.0) for c, e in zip(cells, expect, strict=True))


def _encode(train: DataFrame, index: dict[str, int]) -> DataFrame:
    """``(y, on)``: the features present in each text."""
    shared = train.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx = shared.value
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "on": [sorted(idx[f] for f in features(word_set(t)) if f in idx) for t in pdf["text"]]})

    return train.select("y", "text").mapInPandas(run, "y int, on array<int>")


def _counterfactuals(train: DataFrame, index: dict[str, int], sets: tuple[tuple[str, ...], ...]) -> DataFrame:
    """``(lost, gained, weight, texts)``: the features that swaps take and give, each text's swaps weighing 1 together.

    Equal swaps are one row, so their number follows the terms and not the texts.
    """
    shared = train.sparkSession.sparkContext.broadcast((index, sets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx, groups = shared.value
        others = {t: [o for g in groups if t in g for o in g if o != t] for g in groups for t in g}
        mine = {t: [idx[f] for f in word_features(t) if f in idx] for t in others}
        for pdf in batches:
            held: dict[tuple, list[int]] = {}
            for text in pdf["text"]:
                words = word_set(text)
                terms = sorted(t for t in words if t in others)
                n = sum(len(others[t]) for t in terms)
                if not n:
                    continue
                uses = Counter(f for w in words for f in word_features(w) if f in idx)
                for k, t in enumerate(terms):
                    lost = [f for f in word_features(t) if f in idx and uses[f] == 1]
                    for j, o in enumerate(others[t]):
                        gained = [f for f in word_features(o) if f in idx and not uses[f]]
                        a, b = {idx[f] for f in lost}, {idx[f] for f in gained}
                        # what the other term has as well is not lost
                        keep = a & set(mine[o])
                        key = tuple(sorted(a - keep)), tuple(sorted(b))
                        cell = held.setdefault(key, [0, 0])
                        cell[0] += (1 << 32) // n
                        cell[1] += k == 0 and j == 0
            yield pd.DataFrame({
                "lost": pd.Series([list(a) for a, _ in held], dtype=object), "gained": pd.Series([list(b) for _, b in held], dtype=object),
                "w": pd.Series([x for x, _ in held.values()], dtype="int64"), "texts": pd.Series([x for _, x in held.values()], dtype="int64"),
            })

    swaps = train.select("text").mapInPandas(run, "lost array<int>, gained array<int>, w bigint, texts bigint")
    return swaps.groupBy("lost", "gained").agg((F.sum("w") / float(1 << 32)).alias("weight"), F.sum("texts").alias("texts"))


#: Contributions of rows are whole multiples of this, so that their sums do not depend on the order of rows.
_UNIT = 1 << 32


def _objective(rows: DataFrame, swaps: DataFrame, n: int, swap_penalty: float, ridge: float):
    """A function from parameters to (loss, gradient), one Spark job each; tasks return partial sums of the gradient."""
    spark = rows.sparkSession
    any_swaps = bool(swaps.take(1))

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(theta)

        def sums(grad: np.ndarray, loss: int) -> pd.DataFrame:
            at = np.flatnonzero(grad)
            return pd.DataFrame({"i": np.append(at, -1), "g": np.append(grad[at], loss)})

        def whole(x: float) -> int:
            return round(float(x) * _UNIT)

        def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            loss, grad = 0, np.zeros(n + 1, np.int64)
            for batch in batches:
                y, lists = batch.column(0).to_numpy(), batch.column(1)
                ends, on = lists.offsets.to_numpy(), lists.flatten().to_numpy()
                row = np.repeat(np.arange(len(y)), np.diff(ends))
                z = w[n] + np.bincount(row, w[on], len(y))
                loss += int(np.rint((np.logaddexp(0.0, z) - y * z) * _UNIT).astype(np.int64).sum())
                r = np.rint((1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - y) * _UNIT).astype(np.int64)
                np.add.at(grad, on, r[row])
                grad[n] += r.sum()
            yield pa.RecordBatch.from_pandas(sums(grad, loss))

        def of_swaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = shared.value
            loss, grad = 0, np.zeros(n + 1, np.int64)
            for pdf in batches:
                for a, b, weight in zip(pdf["lost"], pdf["gained"], pdf["weight"], strict=True):
                    c, d = swap_penalty * weight, w[a].sum() - w[b].sum()
                    loss += whole(c * d * d)
                    grad[a] += whole(2 * c * d)
                    grad[b] -= whole(2 * c * d)
            yield sums(grad, loss)

        parts = rows.mapInArrow(of_texts, "i bigint, g bigint")
        if swap_penalty and any_swaps:
            parts = parts.unionByName(swaps.mapInPandas(of_swaps, "i bigint, g bigint"))
        total = np.zeros(n + 2)
        for r in parts.groupBy("i").agg(F.sum(F.col("g").cast("decimal(38,0)")).alias("g")).collect():
            total[r["i"]] = float(r["g"]) / _UNIT
        shared.unpersist()
        return total[-1] + ridge / 2 * float(theta[:n] @ theta[:n]), total[: n + 1] + ridge * np.append(theta[:n], 0.0)

    return evaluate


def minimize(evaluate, x: np.ndarray, rounds: int = 40, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Limited-memory BFGS with step halving; each evaluation is one pass over the training rows."""
    value, grad = evaluate(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if steps:
            q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        else:
            q /= max(1.0, float(np.abs(grad).max()))
        for (s, y), a in zip(steps, reversed(alphas), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        size = 1.0
        while True:
            there, slope = evaluate(x - size * q)
            if there <= value - 1e-4 * size * float(grad @ q) or size < 1e-4:
                break
            size /= 3
        s, y = -size * q, slope - grad
        done = value - there <= tolerance * max(1.0, abs(value))
        if there <= value:
            x, value, grad = x + s, there, slope
        if done:
            break
        if s @ y > 1e-10:
            steps = [*steps, (s, y)][-memory:]
    return x


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    max_rows: int = 50_000,
    max_features: int = 4096,
    min_texts: int = 3,
    min_statistic: float = 12.0,
    swap_penalty: float = 10.0,
    ridge: float = 0.02,
    widen_groups: bool = True,
) -> ToxicityModel:
    """Learn from at most about ``max_rows`` labelled rows, a documented bound; each is read whole.

    Features are words and word beginnings that at least ``min_texts`` toxic texts, or many texts, have and that
    tell most about the label (at most ``max_features``), and all terms that are swapped. The loss adds, for every
    labelled text with such a term, the squared change of its score when the term is swapped, times
    ``swap_penalty``: a term alone can then neither raise nor lower a score. Terms are ``identity_terms`` and, with
    ``widen_groups``, words that the labelled texts use as they use those. Where no labelled text has such a term, the
    penalty is zero and nothing is swapped. Sums are of whole numbers, so reruns
    agree. Repeated rows each count. Labels of one kind, or none, give a constant score.
    """
    sample = _sample(labels, id_col, label_col, max_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    train = materialize(rows.select("y", F.coalesce("text", F.lit("")).alias("text")), "toxicity-train")
    counts = materialize(_document_counts(train), "toxicity-counts")
    some = counts.where((F.col("toxic") >= min_texts) | (F.col("n") >= 15 * min_texts))
    chosen = sorted(some.orderBy(F.desc("toxic"), F.desc("n"), "feature").limit(64 * max_features).select("feature", "n", "toxic").toLocalIterator())
    candidates = [r["feature"] for r in chosen]
    table = np.array([[r["n"] - r["toxic"] for r in chosen], [r["toxic"] for r in chosen]], float)
    rows_by = dict(train.groupBy("y").count().collect())
    neg, pos = rows_by.get(0, 0), rows_by.get(1, 0)
    if not pos or not neg or not candidates:
        return ToxicityModel({}, np.zeros(0), math.log((pos + 0.5) / (neg + 0.5)) if pos + neg else math.log(0.01))
    groups = widened_groups(train, counts, neg + pos, identity_terms) if widen_groups else identity_terms
    g = _g_statistic(table, neg, pos)
    order = [candidates[i] for i in np.argsort(-g, kind="stable")[:max_features] if g[i] >= min_statistic]
    terms = sorted({t for x in groups for t in x}.difference(order))
    present = {r["feature"] for r in counts.join(F.broadcast(train.sparkSession.createDataFrame([(t,) for t in terms], "feature string")), "feature").select("feature").collect()} if terms else set()
    index = {f: k for k, f in enumerate([*order, *(t for t in terms if t in present)])}
    encoded = materialize(_encode(train, index), "toxicity-rows")
    swaps = materialize(_counterfactuals(train, index, groups), "toxicity-swaps")
    n_swapped = swaps.agg(F.sum("texts")).first()[0] or 0
    n = len(index)
    start = np.append(np.zeros(n), math.log(pos / neg))
    theta = minimize(_objective(encoded, swaps, n, swap_penalty, ridge), start)
    return ToxicityModel(index, theta[:n], float(theta[n]), groups, n_swapped)


def score_column(docs: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """Score in 0..1 of every whole text; a null or empty text gets the score of no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for texts in batches:
            yield texts.map(of, na_action=None).astype("float64") if len(texts) else pd.Series([], dtype="float64")

    return score(text)
