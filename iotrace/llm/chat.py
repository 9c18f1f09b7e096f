"""Chat formatting in budgeted windows: turn-aligned spans by prefix sums of tokens, and a loss mask that holds each target once."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.functions.scalars import int_div
from iotrace.storage import materialize

#: The strings that mark turns, and how byte-level vocabularies split a text before merging.
START, END = "<|im_start|>", "<|im_end|>"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens that a turn takes besides its role and text.
_MARKS = 4
#: Longer texts are counted piece by piece.
_PIECE = 100_000
_TURN = "array<struct<pos: bigint, role: string, text: string>>"


def escape(text: Column) -> Column:
    """One more backslash in every ``<|``, ``<\\|`` and so on, so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _escape_role(role: Column) -> Column:
    """A role on one line: backslashes doubled, line feeds as a backslash and n, then as ``escape``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


@functools.cache
def _encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def with_tokens(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` with ``tokens``: those of role and escaped text, and of the marks around them.

    ``tokenizer`` is a rank file that Spark can read, some megabytes; its bytes are sent to the tasks.
    """
    spark = rows.sparkSession
    size, content = spark.read.format("binaryFile").load(tokenizer).select("length", "content").first()
    if size > 64 << 20:
        raise ValueError(f"{tokenizer} is no rank file: {size} bytes")
    ranks = spark.sparkContext.broadcast(bytes(content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = lambda s: sum(len(_encoding(ranks.value).encode_ordinary(s[i : i + _PIECE])) for i in range(0, len(s), _PIECE))
        for batch in batches:
            roles: dict[str, int] = {}
            out = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
                if role not in roles:
                    roles[role] = count(role)
                out.append(_MARKS + roles[role] + count(text.as_py()))
            yield batch.set_column(4, "tokens", pa.array(out, pa.int64()))

    text = F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), escape(text).alias("escaped"))
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, tokens bigint")


def in_order(rows: DataFrame, long_tokens: int) -> DataFrame:
    """``rows`` with ``pos`` in their conversation and, of the turns before: ``start`` their tokens, ``short`` those of
    turns up to ``long_tokens``, ``longs`` how many are longer.

    Turns are sorted by range over the whole table, so a conversation of any size is spread over tasks; windows go
    over what a range has of a conversation, and only conversations that lie in several ranges, fewer than
    ranges, get sums of the ranges before from a broadcast. Turns go by ``turn``, null first, then role and digest.
    """
    is_long = (F.col("tokens") > long_tokens).cast("bigint")
    rows = rows.withColumn("_tie", F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")).cast("binary"), 256)))
    ranged = rows.withColumn("_role", F.substring("role", 1, 64)).repartitionByRange("conv_id", "turn", "_role", "_tie")
    table = materialize(ranged.withColumn("_part", F.spark_partition_id()), "turns")
    sums = {"pos": F.lit(1), "start": F.col("tokens"), "short": F.col("tokens") * (1 - is_long), "longs": is_long}
    before = W.partitionBy("conv_id", "_part").orderBy("turn", "_role", "_tie").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    out = table.withColumns({c: zero(F.sum(x).over(before)) for c, x in sums.items()})
    parts = table.groupBy("conv_id", "_part").agg(*[F.sum(x).alias(f"_{c}") for c, x in sums.items()])
    whole = W.partitionBy("conv_id")
    parts = parts.withColumns({"_least": F.min("_part").over(whole), "_most": F.max("_part").over(whole)}).where("_least < _most")
    above = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_at"), *[zero(F.sum(f"_{c}").over(above)).alias(f"_{c}") for c in sums])
    out = out.join(F.broadcast(parts), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_at")), "left")
    return out.select("conv_id", "turn", "role", "text", "tokens", *[(F.col(c) + zero(F.col(f"_{c}"))).alias(c) for c in sums])


def _formatted(turns: Column) -> Column:
    whole = F.transform(turns, lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n")))
    return F.array_join(whole, "")


def _loss_spans(turns: Column, n_repeated: Column, target: str) -> Column:
    """Where the texts of ``target`` turns lie in the formatted window, without the first ``n_repeated`` turns."""
    sizes = F.transform(turns, lambda t, i: F.struct((F.length(_escape_role(t["role"])) + len(START) + 1).alias("a"), F.length(escape(t["text"])).alias("n"), ((i >= n_repeated) & (t["role"] == target)).alias("on")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + t["a"]
        span = F.struct(a.alias("start"), (a + t["n"]).alias("end"))
        return F.struct((a + t["n"] + len(END) + 1).alias("at"), F.when(t["on"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["spans"])


def windows(
    conversations: DataFrame, tokenizer: str, budget: int = 4096, history: int = 512, max_system: int = 512, target: str = "assistant", system: str = "system",
    id_col: str = "conv_id",
) -> DataFrame:
    """``(conv_id, first_turn, formatted, loss_spans, n_repeated, n_tokens)``: training windows that hold every turn once as new.

    What ``budget`` leaves beside ``history`` and ``max_system`` is room for new turns. Turns of more than a third
    of it have windows of their own; of the others those whose first token falls into the same two thirds of a
    room, by the prefix sum, share one, so a window never passes the budget unless one turn alone does. Later
    windows begin with the system turn, if the conversation begins with one of at most ``max_system`` tokens, and with
    as many of the turns before as ``history`` allows, whole. Those repeated turns, ``n_repeated``, are under no
    loss span: each text of ``target`` is learned once. Spans count code points.

    Turns are told apart by their marks; control strings in texts and roles are escaped, reversibly. Turns go by
    ``turn``, null first, then role and digest; repeated rows are turns of their own. Null roles and texts are empty; rows
    without a ``conv_id`` are one conversation without an id. Other columns are not looked at. No turns, no windows.
    """
    room = budget - history - max_system
    if room < 3:
        raise ValueError("history and max_system leave no room")
    rows = conversations.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    # written first: a sort by range reads its input twice, and tokens are dear
    counted = materialize(with_tokens(rows, tokenizer), "turn-tokens")
    turns = materialize(in_order(counted, room // 3), "turns")
    is_long = F.col("tokens") > room // 3
    span = F.struct((2 * F.col("longs") + is_long.cast("int")).alias("a"), F.when(is_long, 0).otherwise(int_div(F.col("short"), room - room // 3)).alias("b"))
    one = F.struct("pos", "role", "text")
    new = turns.withColumn("_span", span).groupBy("conv_id", "_span").agg(
        F.min("pos").alias("first"), F.min("start").alias("start"), F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(one)).alias("new")
    )
    new = materialize(new.drop("_span"), "spans")
    kept = (F.col("pos") == 0) & (F.col("role") == system) & (F.col("tokens") <= max_system)
    starts = new.where("first > 0").select(F.col("conv_id").alias("_conv"), F.col("first").alias("_first"), F.col("start").alias("_start"))
    bins = F.array_distinct(F.array(int_div(F.greatest(F.col("_start") - history, F.lit(0)), history), int_div(F.col("_start"), history)))
    near = turns.where(~kept & (F.col("tokens") <= history)).withColumn("_bin", int_div(F.col("start"), history))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    seen = near.join(starts.withColumn("_bins", F.explode(bins)), same & (F.col("_bin") == F.col("_bins")) & (F.col("pos") < F.col("_first")) & (F.col("start") >= F.col("_start") - history))
    seen = seen.groupBy("_conv", "_first").agg(F.sort_array(F.collect_list(one)).alias("seen"), F.sum("tokens").alias("seen_tokens"))
    said = turns.where(kept).select(F.col("conv_id").alias("_conv"), F.array(one).alias("system"), F.col("tokens").alias("system_tokens"))
    out = new.join(seen, same & (F.col("first") == F.col("_first")), "left").drop("_conv", "_first")
    out = out.join(said, same & (F.col("first") > 0), "left")
    none = F.array().cast(_TURN)
    repeated = F.concat(F.coalesce("system", none), F.coalesce("seen", none))
    out = out.select("conv_id", F.col("first").alias("first_turn"), repeated.alias("r"), "new", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "seen_tokens", "system_tokens")])
    out = out.withColumn("n_repeated", F.size("r")).withColumn("t", F.concat("r", "new"))
    spans = _loss_spans(F.col("t"), F.col("n_repeated"), target)
    return out.select("conv_id", "first_turn", _formatted(F.col("t")).alias("formatted"), spans.alias("loss_spans"), "n_repeated", (F.col("tokens") + F.col("seen_tokens") + F.col("system_tokens")).alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, first_turn, turns array<struct<role, text>>, loss array<string>, formatted_chars)`` of ``windows``, new turns only, from their text and spans."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    tail = F.lit(len(END) + 1)
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - tail)
    turn = lambda b: F.struct(_unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.instr(b, F.lit("\n")) + 1, F.length(b))).alias("text"))
    turns = F.transform(F.filter(pieces, lambda p, i: i >= F.col("n_repeated")), lambda p: turn(body(p)))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "first_turn", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def digests(back: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of each conversation of ``read_back``.

    The hashes take a conversation's windows in turn; a task holds some windows and two hash states.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss", "")
    rows = back.select("conv_id", "first_turn", F.size("turns").cast("bigint").alias("n"), F.length(learned).cast("bigint").alias("chars"), "formatted_chars", said.cast("binary").alias("said"), learned.cast("binary").alias("learned"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, said_hash, loss_hash = (), [0, 0, 0], None, None

        def one() -> pa.RecordBatch:
            row = [now[0], sums[0], said_hash.hexdigest(), sums[1], loss_hash.hexdigest(), sums[2]]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in row], names)

        for batch in batches:
            for i in range(batch.num_rows):
                conv, _, *more, said_now, loss_now = (c[i].as_py() for c in batch.columns)
                if (conv,) != now:
                    if now:
                        yield one()
                    now, sums, said_hash, loss_hash = (conv,), [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                sums = [a + b for a, b in zip(sums, more, strict=True)]
                said_hash.update(said_now)
                loss_hash.update(loss_now)
        if now:
            yield one()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose two texts are control strings."""
    text = f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(probe)
