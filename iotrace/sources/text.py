"""Text reports: counter, histogram and time-series maps, and process statistics. No per-line Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.functions import scalars as fn
from iotrace.operators import scans
from iotrace.storage import materialize

#: The line shapes of the reports, and how many fields a row of each section has.
COUNTER = r"^@(\w+)\[([^\]]+)\]:\s+(-?\d+)$"
KEYED = r"^@(\w+)\[([^\]]+)\]:$"
UNKEYED = r"^@(\w+):$"
BUCKET = r"^\[(\S+),\s+(\S+)\)\s+(\d+)\s+\|"
SAMPLE = r"^(\d{2}:\d{2}:\d{2})\s+.*[|*]\s*(-?\d+)$"
SERIES_MARK = "hh:mm:ss"
SECTIONS = {"cpu": ("%usr", 11), "mem": ("minflt/s", 10), "dev": ("kB_rd/s", 9)}
NO_KEY = "_"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, at, line)`` of text files: the byte range of the file that a line begins in, and its order there.

    A report may be one file of any size: Spark reads it in ranges, each a task.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )


def _place() -> Column:
    """Where a line is in its file; compares as lines follow each other."""
    return F.struct("start", "at")


def _carried(rows: DataFrame, values: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """``rows`` with the last value that is not null before each line of the file (``inclusive``: or on it).

    A range is a slice: each is summarised by its last values, and given those of the ranges before it.
    """
    if "_key" not in rows.columns:
        rows = scans.sliced(rows, ["file"], F.col("start"))
    return scans.last_values(rows, ["file"], F.col("start"), ["at"], values, inclusive)


def counters(rows: DataFrame) -> DataFrame:
    """``(file, map, key, value)`` of lines ``@map[key]: value``; the last of a key counts."""
    line = F.trim("line")
    found = rows.where(line.rlike(COUNTER)).select(
        "file", _place().alias("place"), F.regexp_extract(line, COUNTER, 1).alias("map"), F.regexp_extract(line, COUNTER, 2).alias("key"),
        F.regexp_extract(line, COUNTER, 3).cast("bigint").alias("value"),
    )
    return found.groupBy("file", "map", "key").agg(F.max_by("value", "place").alias("value"))


def _header(line: Column) -> Column:
    """(map, key) where a line heads a block."""
    keyed = F.struct(F.regexp_extract(line, KEYED, 1).alias("map"), F.regexp_extract(line, KEYED, 2).alias("key"))
    plain = F.struct(F.regexp_extract(line, UNKEYED, 1).alias("map"), F.lit(NO_KEY).alias("key"))
    return F.when(line.rlike(KEYED), keyed).when(line.rlike(UNKEYED), plain)


def histograms(rows: DataFrame) -> DataFrame:
    """``(file, map, key, bucket, lo, hi, count)`` of bucket lines under their header, in order of lines.

    A header holds until the next one, or a line that is neither blank nor begins with one of ``[ @ | v h``.
    Bucket lines with a single bound are no buckets.
    """
    marked = rows.select("file", "start", "at", F.trim("line").alias("line")).withColumn("head", _header(F.col("line")))
    is_bucket = F.col("line").rlike(BUCKET)
    foreign = F.col("head").isNull() & ~is_bucket & (F.col("line") != "") & ~F.col("line").rlike(r"^[\[@|vh]")
    marked = _carried(marked, {"under": F.col("head"), "since": F.when(F.col("head").isNotNull(), _place()), "reset": F.when(foreign, _place())})
    live = is_bucket & F.col("since").isNotNull() & (F.col("reset").isNull() | (F.col("since") > F.col("reset")))
    order = F.row_number().over(W.partitionBy("file", "under.map", "under.key").orderBy("start", "at")) - 1
    return marked.where(live).select(
        "file", "under.map", "under.key", order.alias("bucket"),
        fn.suffix_number(F.regexp_extract("line", BUCKET, 1)).alias("lo"), fn.suffix_number(F.regexp_extract("line", BUCKET, 2)).alias("hi"),
        F.regexp_extract("line", BUCKET, 3).cast("bigint").alias("count"),
    )


def series(rows: DataFrame) -> DataFrame:
    """``(file, map, key, place, time, value)`` of sample lines after a header and its ``hh:mm:ss`` line.

    A block ends at the next header, a blank line, or a line that begins with v.
    """
    marked = rows.select("file", "start", "at", F.trim("line").alias("line")).withColumn("head", _header(F.col("line")))
    sample, mark = F.col("line").rlike(SAMPLE), F.col("head").isNull() & F.col("line").contains(SERIES_MARK)
    ends = F.col("head").isNull() & ~mark & ~sample & ((F.col("line") == "") | F.col("line").startswith("v"))
    at = lambda cond: F.when(cond, _place())
    marked = _carried(marked, {"under": F.col("head"), "since": at(F.col("head").isNotNull()), "marked": at(mark), "ended": at(ends)})
    # an end counts from the first mark of a block on; before it the header still holds
    first = mark & F.col("since").isNotNull() & (F.col("marked").isNull() | (F.col("marked") < F.col("since")))
    marked = _carried(marked, {"first": at(first)})
    live = sample & (F.col("first") > F.col("since")) & (F.col("ended").isNull() | (F.col("ended") < F.col("first")))
    return marked.where(live).select(
        "file", "under.map", "under.key", _place().alias("place"), F.regexp_extract("line", SAMPLE, 1).alias("time"),
        F.regexp_extract("line", SAMPLE, 2).cast("bigint").alias("value"),
    )


def section_of(line: Column) -> Column:
    out = None
    for name, (token, _) in SECTIONS.items():
        out = F.when(line.contains(token), name) if out is None else out.when(line.contains(token), name)
    return out


def pidstat(rows: DataFrame) -> DataFrame:
    """Rows of a process-statistics report, all sections: ``(file, place, section, time, uid, tgid, tid, fields, command)``.

    cpu keeps thread rows, which take process and command of the last process row of their section; mem and dev
    keep process rows. ``fields`` are the numbers between ids and command. Rows with too few fields, or whose
    first field does not begin with a digit, are left out. Rows are stored between the two scans, each of which reads
    its input twice.
    """
    line = F.trim("line")
    kept = rows.select("file", "start", "at", line.alias("line")).where((line != "") & ~line.rlike("^(Linux|Average)"))
    kept = _carried(kept.withColumn("head", section_of(F.col("line"))), {"section": F.col("head")})
    kept = kept.where(F.col("head").isNull() & F.col("section").isNotNull()).withColumn("p", F.split("line", r"\s+"))
    need = F.expr("case " + " ".join(f"when section = '{k}' then {n}" for k, (_, n) in SECTIONS.items()) + " end")
    kept = kept.withColumn("need", need).where((F.size("p") >= F.col("need")) & F.col("p")[0].rlike("^[0-9]"))
    command = F.regexp_replace(F.array_join(F.expr("slice(p, need, size(p))"), " "), r"^\|__", "")
    kept = kept.select(
        "_key", "_slice", "file", "start", "at", "section", F.col("p")[0].alias("time"), F.col("p")[1].alias("uid"), F.col("p")[2].alias("tgid"), F.col("p")[3].alias("tid"),
        F.expr("slice(p, 5, need - 5)").alias("fields"), command.alias("command"),
    )
    own = lambda name: F.when((F.col("section") == name) & (F.col("tgid") != "-"), F.struct("tgid", "command"))
    kept = materialize(kept, "pidstat")
    kept = _carried(kept, {f"_{name}": own(name) for name in SECTIONS}, inclusive=True)
    kept = kept.withColumn("parent", F.coalesce(*[F.when(F.col("section") == name, F.col(f"_{name}")) for name in SECTIONS]))
    threads = (F.col("section") == "cpu") & (F.col("tid") != "-") & F.col("parent").isNotNull()
    processes = (F.col("section") != "cpu") & (F.col("tgid") != "-")
    return kept.where(threads | processes).select(
        "file", _place().alias("place"), "section", "time", "uid", F.col("parent.tgid").alias("tgid"),
        F.when(F.col("section") == "cpu", F.col("tid")).alias("tid"), "fields", F.col("parent.command").alias("command"),
    )


def sysstat_table(report: DataFrame, section: str) -> DataFrame:
    """One section of ``pidstat`` rows with named, typed columns."""
    from iotrace.sources.schemas import SYSSTAT, schema

    names = [f for f in schema(SYSSTAT[section]) if f.name not in ("time", "uid", "tgid", "tid", "command")]
    cols = [F.get("fields", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(names)]
    ids = ["time", "uid", "tgid", "tid"] if section == "cpu" else ["time", "uid", "tgid"]
    return report.where(F.col("section") == section).select(*ids, *cols, "command")
