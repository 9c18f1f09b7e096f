"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text. No Python runs on rows."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrace.llm.common import ASCII_LOWER, ASCII_UPPER, SPACE_CLASS
from iotrace.storage import materialize

#: The characters counted as symbols, and the base limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
_CLASSES = ASCII_UPPER + ASCII_LOWER + "0123456789", "A" * 26 + "a" * 26 + "0" * 10


def _neighbours(a: str, b: str, size: str, gap: int, pair: str = "xxhash64(x, y)") -> str:
    """SQL of ``pair`` over element i of ``a`` and i + gap of ``b``, for each i where both are (``size`` of them)."""
    return f"zip_with(slice({a}, 1, greatest({size}, 0)), slice({b}, {gap + 1}, greatest({size}, 0)), (x, y) -> {pair})"


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ``_words`` and ``_hashes``.

    A null text has no words: all counts 0, base_failed true.

    Repeats: hashes of the windows, rolled up from hashes of the words, show which texts can have any. Only those
    sort their windows as text, so equal means equal. Positions p of repeated windows add min(5, gap to the next)
    each, which is the size of the windows' union.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", F.array_remove(F.split(text, SPACE_CLASS), "")).withColumn("_lines", lines)
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_n", F.size("_words"))
    out = out.withColumn("_two", F.expr(_neighbours("_hashes", "_hashes", "_n - 1", 1)))
    four = F.expr(_neighbours("_two", "_two", "_n - 3", 2))
    out = out.withColumn("_four", F.when(F.col("_n") >= WINDOW, four))
    five = _neighbours("_four", "_hashes", "_n - 4", WINDOW - 1)
    out = out.withColumn("_may_repeat", F.expr(f"case when _n > {WINDOW} then size(array_distinct({five})) < _n - {WINDOW - 1} else false end"))
    at = ", ".join(f"get(_words, i + {k})" for k in range(WINDOW))
    windows = f"array_sort(transform(sequence(0, _n - {WINDOW}), i -> struct(concat_ws(' ', {at}) as t, i as i)))"
    out = out.withColumn("_sorted", F.expr(f"case when _may_repeat then {windows} end"))
    twice = "filter(_sorted, (x, i) -> x.t <=> get(_sorted, i - 1).t or x.t <=> get(_sorted, i + 1).t)"
    out = out.withColumn("_at", F.expr(f"case when _may_repeat then sort_array(transform({twice}, x -> x.i)) end"))
    covered = (
        f"case when coalesce(size(_at), 0) > 0 then cast({WINDOW} as bigint) + aggregate(zip_with(slice(_at, 1, size(_at) - 1), "
        f"slice(_at, 2, size(_at) - 1), (a, b) -> least({WINDOW}, b - a)), 0L, (s, x) -> s + x) else 0L end"
    )
    out = out.select(
        *[F.col(c) for c in docs.columns],
        "_words", "_hashes",
        F.col("_n").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def with_grams(measured: DataFrame, buckets: int) -> DataFrame:
    """``measured`` with ``_grams``: buckets of a text's words, pairs of words, and pairs of the shapes of words.

    A shape is the first two and last two characters of a word, with A-Z, a-z and 0-9 turned into A, a and 0.
    """
    ends = lambda w: F.translate(F.concat(F.substring(w, 1, 2), F.right(w, F.lit(2))), _CLASSES[0], _CLASSES[1])
    out = measured.withColumn("_shapes", F.transform("_words", lambda w: F.xxhash64(ends(w), F.lit(1))))
    bucket = f"cast(pmod({{}}, {buckets}) as int)"
    ones = F.expr(f"transform(_hashes, x -> {bucket.format('x')})")
    twos = F.expr(_neighbours("_hashes", "_hashes", "size(_hashes) - 1", 1, bucket.format("xxhash64(x, y)")))
    pairs = F.expr(_neighbours("_shapes", "_shapes", "size(_shapes) - 1", 1, bucket.format("xxhash64(x, y, 1)")))
    return out.withColumn("_grams", F.concat(ones, twos, pairs)).drop("_shapes")


def log_ratios(grams_df: DataFrame, buckets: int) -> list[float]:
    """log p_target - log p_raw of every bucket, from ``(grams array<int>, trusted boolean)`` rows; at most ``buckets`` numbers.

    Both multinomials carry half a count per bucket, so empty corpora give zeros.
    """
    flat = grams_df.select("trusted", F.explode("grams").alias("g"))
    got = flat.groupBy("g").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target")).collect()
    raw, target = [0.5] * buckets, [0.5] * buckets
    for row in got:
        raw[row["g"]] += row["raw"]
        target[row["g"]] += row["target"]
    n_raw, n_target = math.fsum(raw), math.fsum(target)
    return [math.log(t / n_target) - math.log(r / n_raw) for t, r in zip(target, raw, strict=True)]


def lower_fence(scores: DataFrame, tail: float = 0.01, step: float = 2.0**-17) -> float | None:
    """As far below the ``tail`` quantile of ``scores(score)`` as the median is above it; None without any.

    Quantiles are those of the scores in steps of ``step``, of which there are a bounded number.
    """
    counts = scores.groupBy(F.floor(F.col("score") / step).alias("at")).agg(F.count("*").alias("n"))
    rows = sorted((r["at"], r["n"]) for r in counts.collect())
    total, seen, found = sum(n for _, n in rows), 0, []
    for at, n in rows:
        seen += n
        while len(found) < 2 and seen >= (tail, 0.5)[len(found)] * total:
            found.append(at * step)
    return 2 * found[0] - found[1] if found else None


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 14,
    min_score: float | None = None,
    prior: int = 16,
    tail: float = 0.01,
    folds: int = 4,
    max_broadcast: int = 1_000_000,
) -> DataFrame:
    """Base counts, ``score`` and ``kept`` for every document.

    ``trusted`` holds the ids of the target corpus; all of them count. The raw corpus is all of ``docs``. The
    score is the sum of the log ratios of a text's n-grams over their number plus ``prior``, 0 without any. A
    document is kept if it passes the base limits and scores at least ``min_score``. Where that is None it comes
    from trusted texts: one of ``folds`` parts of them, chosen by hash of the id, is held out of the target, and
    the limit lies as far below the ``tail`` quantile of their scores as their median lies above it (0 without
    any). A text that scores exactly the limit is kept. Null texts fail the base limits; a
    null id is never trusted; repeated rows each count.

    Texts are cut into words and n-grams once; counts and scores each read the table of bucket numbers once. Ids are
    broadcast if they are at most ``max_broadcast``, which is counted.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    measured = with_grams(base_measures(rows, "text"), buckets).drop("text", "_words", "_hashes")
    measured = materialize(measured, "quality-grams")
    ids = trusted.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("trusted")), F.lit(folds))
    ids = materialize(ids.withColumn("held", fold == 0), "trusted")
    if ids.count() <= max_broadcast:
        ids = F.broadcast(ids)
    target = F.coalesce(~F.col("held"), F.lit(False)) if min_score is None else F.col("held").isNotNull()
    marked = measured.join(ids, "doc_id", "left").select(F.col("_grams").alias("grams"), target.alias("trusted"))
    weight = F.from_json(F.lit(json.dumps(log_ratios(marked, buckets))), "array<double>")
    total = F.aggregate("_grams", F.lit(0.0), lambda s, g: s + F.get(weight, g))
    out = measured.withColumn("score", F.when(F.col("n_words") > 0, total / (F.size("_grams") + prior)).otherwise(0.0))
    out = materialize(out.drop("_grams"), "quality-scores")
    if min_score is None:
        held = out.where(~F.col("base_failed")).join(ids.where("held"), "doc_id", "left_semi")
        min_score = lower_fence(held, tail)
    limit = F.lit(0.0 if min_score is None else float(min_score))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= limit)).alias("kept"), "score", limit.alias("min_score"),
    )
