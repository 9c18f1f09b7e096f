"""Mixing sources to target token weights by entropy balancing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.llm.common import WORD_REGEX
from iotrace.storage import materialize

#: Weights of the sources in code-point order, and the limit on repeats of a document.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 2
SHARE = 1.5
_BINS = 4096


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """``(source, sid, source_size, target)`` from ``(source, source_size)``, one row a source.

    Sources in code-point order, null last, take the weights in turn. Weights share ``share`` of all tokens; a
    target stops at ``cap`` times its source and the excess is shared by weight among the rest. That is a water
    level: with sources sorted by cap over weight, the first whose level fits under its cap sets it.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("sid", F.row_number().over(order)).withColumn("w", w).withColumn("limit", cap * F.col("source_size"))
    t = t.withColumn("ratio", F.col("limit") / F.col("w"))
    by_ratio = W.orderBy("ratio", "sid")
    whole = W.partitionBy()
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("level", (share * F.sum("source_size").over(whole) - before) / rest)
    t = t.withColumn("at", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(whole))
    level = F.coalesce(F.col("at.level"), F.max("ratio").over(whole))
    return t.select("source", "sid", "source_size", F.least("limit", level * F.col("w")).alias("target"))


def balance(sizes: DataFrame, plan: list, cap: float = MAX_COPIES, rounds: int = 80, tolerance: float = 1e-9) -> dict[int, float]:
    """The dual solution: for each source the tilt t with sum(size * min(cap, exp(t * size / largest))) = target.

    ``sizes(sid, size, n)`` holds how many documents of a source have a size, all that the dual depends on. Every
    round is one Spark aggregate of the constraint and its derivative over it; the step is Newton's on the
    logarithm of the constraint, kept between the bounds already seen. Sums are decimal, so reruns agree.
    Sources at their cap need no tilt (infinite), those with target 0 are dropped (minus infinite).
    """
    spark = sizes.sparkSession
    tilt, low, high, open_ = {}, {}, {}, set()
    for row in plan:
        s, limit = row["sid"], cap * row["source_size"]
        if row["target"] >= limit * (1 - 1e-12):
            tilt[s] = math.inf
        elif row["target"] <= 0:
            tilt[s] = -math.inf
        else:
            tilt[s], low[s], high[s] = 0.0, -math.inf, math.inf
            open_.add(s)
    goal = {r["sid"]: r["target"] for r in plan}
    log_cap = math.log(cap)
    for _ in range(rounds):
        if not open_:
            break
        now = spark.createDataFrame([(s, tilt[s]) for s in sorted(open_)], "sid int, tilt double")
        x = F.col("tilt") * F.col("z")
        rate = F.exp(F.least(F.lit(log_cap), x))
        tokens = F.col("n") * F.col("size")
        total = F.sum((tokens * rate).cast("decimal(38,10)")).cast("double")
        slope = F.sum(F.when(x < log_cap, tokens * F.col("z") * rate).otherwise(0.0).cast("decimal(38,10)")).cast("double")
        for r in sizes.join(F.broadcast(now), "sid").groupBy("sid").agg(total.alias("total"), slope.alias("slope")).collect():
            s, gap = r["sid"], math.log(r["total"] / goal[r["sid"]]) if r["total"] > 0 else -math.inf
            if abs(gap) <= tolerance:
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            step = tilt[s] - gap * r["total"] / r["slope"] if r["slope"] > 0 and math.isfinite(gap) else math.nan
            if not low[s] < step < high[s]:
                edge = low[s] if math.isfinite(low[s]) else high[s]
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else edge + math.copysign(1 + abs(edge), edge if edge else -gap)
            if step == tilt[s]:
                open_.discard(s)
            tilt[s] = step
    return {s: round(t, 9) if math.isfinite(t) else t for s, t in tilt.items()}


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with ``_source``, ``_size``, the number of words, and ``_draw``, a number in 0..1 drawn from id and text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_REGEX)), F.lit(0)).cast("bigint")
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("mix")), 11) / F.lit(float(1 << 53))
    return docs.withColumns({"_source": F.col(source_col), "_size": size, "_draw": draw})


def _rated(sized: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """Rows of ``_sized`` with the columns of their source's plan, ``rate``, ``base`` copies and the bins of the draw."""
    out = sized.join(F.broadcast(plan.withColumnRenamed("source", "__source")), sized["_source"].eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("tilt") == math.inf, float(cap)).when(F.col("tilt") == -math.inf, 0.0)
    rate = rate.otherwise(F.exp(F.least(F.lit(math.log(cap)), F.col("tilt") * F.col("_size") / F.coalesce("largest", F.lit(1)))))
    out = out.withColumn("rate", F.least(rate, F.lit(float(cap)))).withColumn("base", F.floor("rate").cast("int"))
    p = (F.col("rate") - F.col("base") - F.col("_draw") + 1.0) * (_BINS / 2)
    return out.withColumn("b1", F.floor(p).cast("int")).withColumn("b2", F.floor((p - F.floor(p)) * _BINS).cast("int"))


@dataclass
class Mix:
    """What decides how often a document is taken: each source's plan, and single documents that get one copy more or less."""

    plan: DataFrame
    moves: DataFrame
    cap: int

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out_col: str = "mix") -> DataFrame:
        """``docs`` with a struct column ``out_col(size, source_size, target, rate, copies)``; both tables are broadcast, one and a few rows a source."""
        packed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_from"))
        out = self.chosen(_sized(packed, "doc_id", "_text", "_from"), "_doc")
        keep = [F.col("_doc")[c].alias(c) for c in docs.columns if c != out_col]
        return out.select(*keep, F.struct("size", "source_size", "target", "rate", "copies").alias(out_col))

    def chosen(self, sized: DataFrame, keep: str) -> DataFrame:
        """``(keep, size, source_size, target, rate, copies)`` of rows of ``_sized`` that have a ``doc_id``."""
        rated = _rated(sized, self.plan, self.cap)
        more = F.expr(f"base < {self.cap} and (b1 > cut1 or (b1 = cut1 and b2 >= cut2))").cast("int")
        moves = self.moves.select(F.col("sid").alias("__sid"), F.col("doc_id").alias("__id"), F.col("draw").alias("__draw"), "step")
        same = (rated["sid"] == F.col("__sid")) & (rated["doc_id"] == F.col("__id")) & (rated["_draw"] == F.col("__draw"))
        out = rated.join(F.broadcast(moves), same, "left")
        return out.select(
            rated[keep], F.col("_size").alias("size"), "source_size", "target", "rate", (F.col("base") + more + F.coalesce("step", F.lit(0))).alias("copies")
        )


def solve(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = MAX_COPIES,
    max_sources: int = 100_000,
    corrections: int = 3,
) -> tuple[Mix, DataFrame]:
    """The mix of ``docs``, and its rows ``(doc_id, _source, _size, _draw)`` as they were counted.

    Rates solve the entropy-balancing dual of the source token constraints, at most ``cap``. They are rounded
    into whole copies: a document gets floor(rate), and one more if its rate's fraction less a number drawn from
    its id and text reaches the cut that brings its source nearest to the target. Cuts come from two passes of a
    histogram of 4096 bins a source, so no task holds a source. What is left of the gap, less than a document, is
    narrowed by at most ``corrections`` single documents a source, chosen from one row a size and number of copies.

    Null texts have size 0; rows that agree in id and text fall on the same side of the cut. ``max_sources``
    bounds what the driver holds (one row a source); more is an error.
    """
    spark = docs.sparkSession
    rows = _sized(docs, id_col, text_col, source_col).select(F.col(id_col).alias("doc_id"), "_source", "_size", "_draw")
    rows = materialize(rows, "sizes")
    counts = materialize(rows.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size")).agg(F.count("*").alias("n")), "size-counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = targets(totals, weights, share, cap).take(max_sources + 1)
    if len(plan) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    schema = "source string, sid int, source_size bigint, target double"
    planned = spark.createDataFrame([(r["source"], r["sid"], r["source_size"], float(r["target"])) for r in plan], schema)
    known = F.broadcast(planned.withColumnRenamed("source", "_source"))
    sized = counts.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    largest = F.broadcast(sized.groupBy("sid").agg(F.max("size").alias("largest")))
    sized = sized.join(largest, "sid").withColumn("z", F.col("size") / F.col("largest"))
    sized = materialize(sized.select("sid", "size", "n", "z", "largest"), "size-counts")
    tilts = balance(sized, plan, cap)
    tilted = spark.createDataFrame([(s, t) for s, t in tilts.items()], "sid int, tilt double").join(
        sized.groupBy("sid").agg(F.max("largest").alias("largest")), "sid", "left"
    )
    planned = materialize(planned.join(tilted, "sid"), "plan")
    rated = _rated(rows, planned, cap).select("doc_id", "sid", "_size", "_draw", "source_size", "target", "rate", "base", "b1", "b2")
    rated = materialize(rated.withColumnRenamed("_size", "size"), "rates")
    planned = materialize(planned.join(_cuts(rated, cap), "sid", "left").na.fill({"cut1": _BINS, "cut2": _BINS}), "plan")
    return Mix(planned, _moves(rated, planned, cap, corrections), cap), rows


def _moves(rated: DataFrame, planned: DataFrame, cap: int, corrections: int) -> DataFrame:
    """``(sid, doc_id, draw, step)``: documents that gain or lose a copy, each of which brings its source nearer to the target.

    The documents of a source that have one size and number of copies are dealt to ``corrections`` cells by hash,
    for each of which the least id stands; a cell is used once. Choices are made over the cells; rows are read once for them and once to leave out those
    choices that name more than one row.
    """
    more = F.expr(f"base < {cap} and (b1 > cut1 or (b1 = cut1 and b2 >= cut2))").cast("int")
    taken = rated.join(F.broadcast(planned.select("sid", "cut1", "cut2")), "sid").withColumn("copies", F.col("base") + more)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(max(corrections, 1))).alias("part")
    cells = taken.groupBy("sid", "target", "size", "copies", part).agg(F.count("*").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_draw"))).alias("who"))
    cells = materialize(cells, "mix-cells")
    gaps = cells.groupBy("sid", "target").agg(F.sum(F.col("size") * F.col("copies") * F.col("n")).alias("taken")).select("sid", (F.col("target") - F.col("taken")).alias("gap"))
    free, moves = cells.where("who is not null and size > 0"), None
    for _ in range(corrections):
        step = F.when((F.col("gap") > 0) & (F.col("copies") < cap), 1).when((F.col("gap") < 0) & (F.col("copies") > 0), -1)
        off = F.abs(F.col("gap") - F.col("step") * F.col("size"))
        near = free.join(F.broadcast(gaps), "sid").withColumn("step", step).where("step is not null").where(off < F.abs("gap"))
        best = near.groupBy("sid").agg(F.min(F.struct(off.alias("off"), F.col("who"), F.col("size"), F.col("copies"), F.col("part"), F.col("step"))).alias("x"))
        best = materialize(best.select("sid", "x.*"), "mix-moves")
        moves = best if moves is None else moves.unionByName(best)
        gaps = materialize(gaps.join(best.select("sid", (F.col("step") * F.col("size")).alias("by")), "sid", "left").select("sid", (F.col("gap") - F.coalesce("by", F.lit(0))).alias("gap")), "mix-gaps")
        free = free.join(F.broadcast(best.select("sid", "size", "copies", "part")), ["sid", "size", "copies", "part"], "left_anti")
    if moves is None:
        return rated.sparkSession.createDataFrame([], "sid int, doc_id bigint, draw double, step int")
    moves = moves.select("sid", F.col("who.doc_id").alias("doc_id"), F.col("who._draw").alias("draw"), "step")
    named = rated.select("sid", "doc_id", F.col("_draw").alias("draw")).join(F.broadcast(moves), ["sid", "doc_id", "draw"])
    return materialize(named.groupBy("sid", "doc_id", "draw", "step").agg(F.count("*").alias("n")).where("n = 1").drop("n"), "mix-moves")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``(doc_id, size, source_size, target, rate, copies, taken)`` for every row, by the mix that ``solve`` finds."""
    found, rows = solve(docs, id_col, text_col, source_col, **options)
    out = found.chosen(rows, "doc_id")
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def _cuts(rated: DataFrame, cap: int) -> DataFrame:
    """``(sid, cut1, cut2)``: bins from which documents get one copy more, nearest to each source's target."""
    extra = F.when(F.col("base") < cap, F.col("size")).otherwise(0)
    bins = rated.groupBy("sid", "target", "b1").agg(F.sum(extra).alias("tokens"), F.sum(F.col("size") * F.col("base")).alias("sure"))
    down = W.partitionBy("sid").orderBy(F.desc("b1")).rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("tokens").over(down))
    bins = bins.withColumn("need", F.col("target") - F.sum("sure").over(W.partitionBy("sid")))
    first = bins.groupBy("sid").agg(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("b1", "upto", "tokens", "need"))).alias("x"))
    left = F.col("x.need") - (F.col("x.upto") - F.col("x.tokens"))
    first = first.select("sid", F.coalesce("x.b1", F.lit(-1)).alias("cut1"), left.alias("left"))
    inside = first.select("sid", F.col("cut1").alias("b1"), "left")
    inner = rated.where(F.col("base") < cap).join(F.broadcast(inside), ["sid", "b1"])
    inner = inner.groupBy("sid", "left", "b2").agg(F.sum("size").alias("tokens"))
    down = W.partitionBy("sid").orderBy(F.desc("b2")).rowsBetween(W.unboundedPreceding, 0)
    inner = inner.withColumn("upto", F.sum("tokens").over(down))
    off = F.struct(F.abs(F.col("upto") - F.col("left")).alias("off"), F.col("b2").alias("b2"))
    best = inner.groupBy("sid", "left").agg(F.min(off).alias("x"))
    cut2 = F.when(F.col("x.off") <= F.col("left"), F.col("x.b2")).otherwise(_BINS)
    best = best.select("sid", cut2.alias("cut2"))
    return first.join(best, "sid", "left").select("sid", "cut1", F.coalesce("cut2", F.lit(_BINS)).alias("cut2"))
