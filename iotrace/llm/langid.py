"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str | None) -> np.ndarray:
    """Lower-cased code points with every run-breaking non-letter turned into a space; empty without letters."""
    if not text:
        return np.empty(0, np.uint32)
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cps]
    if not letter.any():
        return np.empty(0, np.uint32)
    out = np.where(letter, cps, 32).astype(np.uint32)
    return np.concatenate(([32], out, [32])).astype(np.uint32)


def ngram_ids(sym: np.ndarray, bits: int) -> np.ndarray:
    """Hashed n-grams of one to three symbols; grams that are all space are left out."""
    s = sym.astype(np.uint64)
    mixed = [s * np.uint64(0x9E3779B97F4A7C15)]
    mixed.append(mixed[0][:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + s[1:] * np.uint64(0x165667B19E3779F9))
    mixed.append(mixed[1][:-1] * np.uint64(0x27D4EB2F165667C5) + s[2:] * np.uint64(0x85EBCA77C2B2AE63))
    space = s == 32
    keep = [~space, ~(space[1:] & space[:-1]), ~(space[1:-1])]
    ids = [((m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits))[k] for m, k in zip(mixed, keep, strict=True)]
    return np.concatenate(ids).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """+1/-1 matrix of ``n`` rows: all distinct splits up to 7 languages, else seeded balanced splits of 15 log2 n bits."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        cols = [[1 if (k >> r) & 1 else -1 for r in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(cols, np.int8).T
    rng, width = np.random.default_rng(n), int(15 * np.ceil(np.log2(n)))
    half = np.array([1] * (n // 2) + [-1] * (n - n // 2), np.int8)
    while True:
        code = np.stack([rng.permutation(half) for _ in range(width)], axis=1)
        agree = (code.astype(int) @ code.T.astype(int))[np.triu_indices(n, 1)]
        if agree.max() < width // 2:
            return code


@dataclass
class LanguageModel:
    """Languages, their codewords, and one weight per hashed n-gram and bit.

    ``pure_gap`` is how much farther the second codeword is than the first in text of each language alone.
    """

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    reliability: np.ndarray
    bits: int
    sharpness: float
    min_gap: float
    pure_gap: np.ndarray

    def losses(self, margin: np.ndarray) -> np.ndarray:
        """How far each codeword is from the outputs of the classifiers."""
        return (self.reliability * np.logaddexp(0.0, -self.code * margin * self.sharpness)).sum(1)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous); texts without letters, and models without languages, give ``und`` and 0.

        Ambiguous are texts whose second codeword is nearer than ``min_gap`` of what it is in text of the first
        language alone, as in texts of two languages in nearly equal parts.
        """
        sym = symbols(text)
        if not len(sym) or not self.langs:
            return UNKNOWN, 0.0, True
        ids = ngram_ids(sym, self.bits)
        loss = self.losses(self.weights[ids].sum(0, dtype=np.float64) / (len(ids) + 8.0))
        post = np.exp(loss.min() - loss)
        post /= post.sum()
        order = np.argsort(loss, kind="stable")
        close = len(order) > 1 and loss[order[1]] - loss[order[0]] < self.min_gap * self.pure_gap[order[0]]
        return self.langs[order[0]], float(post[order[0]]), bool(close)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 16, max_langs: int = 512, sharpness: float = 6.0, min_gap: float = 0.25) -> LanguageModel:
    """Learn from all rows with a language.

    Each task adds up hashed n-gram counts per language; their sum over all rows is languages x 2**bits numbers,
    whatever the input, and more than ``max_langs`` languages are an error. Each bit of the code is a naive-Bayes
    classifier whose counts are the sums over the languages on either side of that bit.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if len(sym := symbols(text)):
                    if lang not in sums:
                        sums[lang] = np.zeros(1 << bits, np.int64)
                    sums[lang] += np.bincount(ngram_ids(sym, bits), minlength=1 << bits)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": c[at]})

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("gram", "n"))).alias("c"))
    packed = packed.select("lang", F.col("c.gram").alias("gram"), F.col("c.n").alias("n")).orderBy("lang")
    got = packed.take(max_langs + 1)
    if len(got) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not got:
        return LanguageModel([], codewords(0), np.zeros((1 << bits, 1), np.float32), np.ones(1), bits, sharpness, min_gap, np.zeros(0))
    counts = np.zeros((len(got), 1 << bits))
    for i, row in enumerate(got):
        counts[i, row["gram"]] = row["n"]
    langs, code = [r["lang"] for r in got], codewords(len(got))
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1.0)
    smooth = 1.0 / (1 << bits)
    weights, trust = [], []
    for col in code.T:
        pos, neg = share[col > 0].mean(0) if (col > 0).any() else 0 * share[0], share[col < 0].mean(0) if (col < 0).any() else 0 * share[0]
        w = np.log((pos + 0.1 * smooth) / (neg + 0.1 * smooth))
        w[(pos + neg) < smooth / 4] = 0.0
        w = np.clip(w, -6, 6)
        weights.append(w)
        gaps = share @ w * col  # expected margin of each language under this classifier
        trust.append(max(0.05, float(gaps.min())))
    trust, table = np.array(trust), np.array(weights, np.float32).T
    model = LanguageModel(langs, code, table, trust / trust.mean(), bits, sharpness, min_gap, np.zeros(len(langs)))
    for i, margin in enumerate(share @ table):
        loss = model.losses(margin)
        model.pure_gap[i] = max(np.delete(loss, i).min() - loss[i], 0.0) if len(langs) > 1 else 0.0
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out_col(lang, score, ambiguous)``, the nearest codeword for every whole text.

    A null text, and one without letters, is ``und`` with score 0. Ties go to the first language in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def decode(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.decode(t) for t in texts], columns=["lang", "score", "ambiguous"])

    return docs.withColumn(out_col, decode(F.col(text_col)))
