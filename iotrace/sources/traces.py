"""Event traces: typed CSV and Parquet scans, conversion, and the normaliser of raw events."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from iotrace.functions import scalars as fn
from iotrace.manifest import Manifest
from iotrace.sources import schemas

CORRUPT, CUT = "_corrupt", "_cut"
_TAIL = 1 << 16


def _headers(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of a trace by the column names of their first line, which alone is read of each; empty files have none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def first(file: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(file)
        stream = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(at.getFileSystem(conf).open(at), "UTF-8"))
        try:
            return stream.readLine() or ""
        finally:
            stream.close()

    # names as they are, not as they stand in a URI
    files = sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        lines = list(pool.map(first, files))
    out: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines, strict=True):
        if line.strip():
            out.setdefault(tuple(line.strip().split(",")), []).append(file)
    return out


def _tail(spark: SparkSession, file: str, length: int) -> str | None:
    """The last line of a file if no line end follows it, else None; reads from the end only, by seeking."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(file)

    def from_byte(start: int) -> bytes:
        stream = at.getFileSystem(conf).open(at)
        try:
            stream.seek(start)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    if from_byte(length - 1) == b"\n":
        return None
    size = min(length, _TAIL)
    while (part := from_byte(length - size)).count(b"\n") == 0 and size < length:
        size = min(length, 4 * size)
    return part.rpartition(b"\n")[2].decode("utf-8", "replace")


def _file_key(path: str | Column) -> Column:
    """One spelling of a file's name, whichever reader tells it."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.replace(path, F.lit("%20"), F.lit(" ")), "^file:/+", "file:///")


def unterminated_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, length, tail)``: files whose last line has no line end, and that line: its last number may be cut even where the line fits."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").collect()
    with ThreadPoolExecutor(16) as pool:
        tails = list(pool.map(lambda r: _tail(spark, r["path"], r["length"]), files))
    found = [(r["path"], r["length"], t) for r, t in zip(files, tails, strict=True) if t is not None]
    return spark.createDataFrame(found, "path string, length bigint, tail string")


def _mark_cut(rows: DataFrame, fields: list[T.StructField], tails: DataFrame) -> DataFrame:
    """``rows`` with ``_cut``: whether a row is the last line of its file and no line end follows.

    The line is known by its file and values; of equal rows of the file one is marked, whichever it is.
    """
    names = [f.name for f in fields]
    parsed = tails.select(_file_key("path").alias("_at"), F.from_csv("tail", T.StructType(fields).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("_line"))
    rows = rows.withColumn("_row", F.struct(*names))
    hits = rows.join(F.broadcast(parsed), (F.col("_file") == F.col("_at")) & F.col("_row").eqNullSafe(F.col("_line")), "left")
    nth = F.row_number().over(W.partitionBy("_at").orderBy("_row"))
    last = hits.where(F.col("_at").isNotNull()).withColumn(CUT, nth == 1)
    return hits.where(F.col("_at").isNull()).withColumn(CUT, F.lit(False)).unionByName(last).drop("_row", "_at", "_line")


def read_csv(spark: SparkSession, path: str | list[str], layer: str, mark_cut: bool = False, file_column: bool = False) -> DataFrame:
    """Trace rows of CSV files with the layer's types, matched by the names in each file's header; unknown columns stay text.

    Files of one folder may have different headers, as older recordings lack columns: files with equal headers
    are read together and columns that some lack are null there. Lines that do not fit their header, such as one
    cut off by the end of a recording, have their text in ``_corrupt`` and are otherwise null. Lines are parsed
    whole, whatever columns are used, so that this does not depend on them. With ``mark_cut`` a last line that fits
    but has no line end, so that its last value may be cut, has ``_cut``; with ``file_column`` rows have ``_file``.
    """
    known = {f.name: f.dataType for f in schemas.schema(schemas.LAYERS[layer])}
    parts = []
    for names, files in (_headers(spark, path) or {tuple(known): path}).items():
        fields = [T.StructField(n, known.get(n, T.StringType())) for n in names]
        read = spark.read.schema(T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]))
        read = read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
        part = read.csv(files)
        if mark_cut or file_column:
            part = part.select("*", _file_key("_metadata.file_path").alias("_file"))
        if mark_cut:
            tails = unterminated_files(spark, files).where(F.size(F.split("tail", ",")) == len(names))
            part = _mark_cut(part, fields, tails)
        parts.append(part)
    out = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    more = [*([CUT] if mark_cut else []), *(["_file"] if file_column else [])]
    order = [*(c for c in known if c in out.columns), *(c for c in out.columns if c not in known and c not in (CORRUPT, CUT, "_file")), CORRUPT, *more]
    return out.select(*order)


def whole_rows(rows: DataFrame) -> DataFrame:
    """Rows of lines that fit their header and, where that is marked, were not cut."""
    rows = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return rows.where(~F.col(CUT)).drop(CUT) if CUT in rows.columns else rows


def torn_rows(rows: DataFrame) -> DataFrame:
    """``(dropped)``: how many lines ``whole_rows`` leaves out."""
    # Spark reads the corrupt text only together with other columns; no line holds a null character before its end
    other = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c not in (CORRUPT, CUT, "_file")], F.lit("\0"))
    return rows.agg(F.count_if(F.col(CORRUPT) != other).alias("dropped"))


def csv_to_parquet(spark: SparkSession, path: str, layer: str, out: str, mode: str = "overwrite") -> None:
    """Convert a trace, one partition folder a layer, so that readers prune by layer."""
    whole_rows(read_csv(spark, path, layer)).withColumn("layer", F.lit(layer)).write.mode(mode).partitionBy("layer").parquet(out)


_KNOWN = "path string, modificationTime timestamp, length bigint, batch int, file string"


def convert_new_files(spark: SparkSession, folder: str, layer: str, out: str, checkpoint: str, max_files: int = 1000, together: int = 4000) -> int:
    """Convert the CSV files of a folder that are new or have changed since; the number of lines left out as torn.

    A manifest in ``checkpoint`` knows each converted file by path, time and length. Files are read with their own
    headers and written to ``out``, one folder a file within one a group of at most ``max_files``. The groups of
    ``together`` files are one job and one version of the manifest, so small groups cost no job and no copy of the
    manifest each. Then what an older state of a grown file had been converted to is deleted. A job cut short is
    done again. ``read_converted`` reads what the manifest lists.
    """
    manifest, written, left_out = Manifest(spark, checkpoint), Manifest(spark, out), 0
    files = spark.read.format("binaryFile").load(folder).select(_file_key("path").alias("path"), "modificationTime", "length").where("length > 0")
    together = max(together // max_files, 1) * max_files
    while True:
        known = manifest.read()
        known = spark.createDataFrame([], _KNOWN) if known is None else known
        fresh = files.join(known, ["path", "modificationTime", "length"], "left_anti").orderBy("path").limit(together).collect()
        if not fresh:
            return left_out
        first = max(manifest.versions(), default=-1) + 1
        last = first + (len(fresh) - 1) // max_files
        named = spark.createDataFrame([(*r, first + i // max_files) for i, r in enumerate(fresh)], _KNOWN.removesuffix(", file string")).withColumn("file", F.sha1("path"))
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda n: written.remove(f"batch={n}"), range(first, last + 1)))
        rows = read_csv(spark, [r["path"] for r in fresh], layer, file_column=True)
        whole = whole_rows(rows).withColumn("file", F.sha1("_file")).drop("_file").join(F.broadcast(named.select("file", "batch")), "file")
        whole.write.mode("append").partitionBy("batch", "file").parquet(out)
        left_out += torn_rows(rows).first()["dropped"]
        paths = F.broadcast(named.select("path"))
        old = known.join(paths, "path", "left_semi").select("batch", "file").collect()
        manifest.commit(known.join(paths, "path", "left_anti").unionByName(named), last)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda r: written.remove(f"batch={r['batch']}", f"file={r['file']}"), old))


def read_converted(spark: SparkSession, out: str, checkpoint: str, layer: str) -> DataFrame:
    """What ``convert_new_files`` has converted, each file as it was last; no rows before the first."""
    live = Manifest(spark, checkpoint).read()
    if live is None:
        return spark.createDataFrame([], schemas.schema(schemas.LAYERS[layer]))
    rows = spark.read.option("mergeSchema", True).parquet(out)
    return rows.join(F.broadcast(live.select("batch", "file")), ["batch", "file"], "left_semi").drop("batch", "file")


def stale(spark: SparkSession, source: str, target: str) -> bool:
    """Whether the newest file of ``source`` is newer than the oldest of ``target``, or there is no target."""
    newest = spark.read.format("binaryFile").load(source).agg(F.max("modificationTime")).first()[0]
    try:
        oldest = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target).agg(F.min("modificationTime")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return True
    return oldest is None or (newest is not None and newest > oldest)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Trace rows, of the named columns those that the trace has."""
    rows = spark.read.parquet(path)
    return rows if columns is None else rows.select(*[c for c in columns if c in rows.columns])


def has(rows: DataFrame, column: str) -> bool:
    return column in rows.columns


def identity_columns(rows: DataFrame) -> list[str]:
    """Columns that identify who did the I/O: the mount namespace only where the trace has it."""
    return ["comm", "mntns_id"] if has(rows, "mntns_id") else ["comm"]


def normalize_events(raw: DataFrame, layer: str) -> DataFrame:
    """Raw records (codes for event, op and syscall) as trace rows: names for codes, null for 'no value' codes.

    fs: bytes 0, latency up to 0, negative fd and offset are null. block and nvme: latency 0 is null, and the
    request pointer is hexadecimal text.
    """
    if layer == "fs":
        keep = lambda name, cond: F.when(cond, F.col(name)).alias(name)
        return raw.select(
            "timestamp_ns", "mntns_id", fn.decode(F.col("event"), fn.FS_EVENTS).alias("event"),
            fn.decode(F.col("syscall"), fn.SYSCALLS).alias("syscall"), F.nullif(F.col("bytes"), F.lit(0)).alias("bytes"),
            keep("latency_ns", F.col("latency_ns") > 0), keep("fd", F.col("fd") >= 0), keep("offset", F.col("offset") >= 0),
            "tid", "comm", "inflight",
        )
    events = fn.BLOCK_EVENTS if layer == "block" else fn.NVME_EVENTS
    rest = ["comm", "q_inflight", "d_inflight"] if layer == "block" else ["comm", "inflight", "disk_name"]
    return raw.select(
        "timestamp_ns", "mntns_id", fn.decode(F.col("event"), events).alias("event"), fn.request_type(F.col("cmd_flags")).alias("op"),
        "bytes", F.nullif(F.col("latency_ns"), F.lit(0)).alias("latency_ns"), "sector", fn.pointer(F.col("rq")).alias("rq"), *rest,
    )


def read_sysstat(spark: SparkSession, path: str, section: str) -> DataFrame:
    return spark.read.schema(schemas.SYSSTAT[section]).option("header", True).csv(path)
