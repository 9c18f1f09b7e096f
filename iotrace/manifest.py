"""Tables in versions: folders of data files, and a list of those that count, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """The list of what a table consists of, rows of any columns in numbered versions under ``folder/_manifest``.

    A version is a Parquet folder and counts once it is written whole, which its ``_SUCCESS`` file says; so readers
    see the version before or after a change and nothing between. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that count, oldest first."""
        path, fs = self._path("_manifest")
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[2:]) for n in found if n.startswith("v=") and fs.exists(self._path("_manifest", n, "_SUCCESS")[0]))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The list of a version, by default the last; None where there is none."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        return self.spark.read.parquet(f"{self.folder}/_manifest/v={version}") if version in known else None

    def commit(self, rows: DataFrame, version: int) -> None:
        """Make ``rows`` version ``version``, which a repeated call replaces, and forget old versions."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/_manifest/v={version}")
        for v in self.versions()[: -self.keep]:
            self.remove("_manifest", f"v={v}")

    def remove(self, *names: str) -> None:
        path, fs = self._path(*names)
        fs.delete(path, True)


class GrowingSet:
    """A set of rows by key that only grows, such as the ids seen of each container: a batch writes the rows it adds and no others.

    Parts are Parquet folders named by the batch that wrote them; once there are more than ``compact_after`` they
    are rewritten as one. A repeated batch replaces what it wrote, so a stream that restarts adds nothing twice.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], compact_after: int = 16, max_broadcast: int = 1_000_000) -> None:
        self.spark, self.folder, self.schema, self.key, self.compact_after, self.max_broadcast = spark, folder.rstrip("/"), schema, key, compact_after, max_broadcast
        self.manifest = Manifest(spark, folder, keep=4)

    def parts(self, version: int | None = None) -> list[tuple[str, int]]:
        """(part, rows) of a version, at most ``compact_after``."""
        rows = self.manifest.read(version)
        return sorted((r["part"], r["n"]) for r in rows.collect()) if rows is not None else []

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last; none where there is no such version."""
        parts = [f"{self.folder}/{p}" for p, _ in self.parts(version)]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def small(self, version: int | None = None) -> bool:
        """Whether a version has few enough rows to be broadcast."""
        return sum(n for _, n in self.parts(version)) <= self.max_broadcast

    def add(self, rows: DataFrame, batch: int) -> int:
        """Add those of ``rows``, one a key, whose key is new, as version ``batch``, not below the last; how many they are."""
        last = max((v for v in self.manifest.versions() if v < batch), default=-1)
        parts, name = self.parts(last), f"part-{batch:08d}"
        fresh = rows.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema])
        if parts:
            known = self.read(last).select(*[F.col(c).alias(f"_{c}") for c in self.key])
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.key]
            fresh = fresh.join(F.broadcast(known) if self.small(last) else known, same, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        written = lambda *names: self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{p}" for p in names])
        n = written(name).count()
        parts = [*parts, (name, n)] if n else parts
        if len(parts) > self.compact_after:
            merged = f"merged-{batch:08d}"
            written(*[p for p, _ in parts]).coalesce(self.compact_after).write.mode("overwrite").parquet(f"{self.folder}/{merged}")
            parts = [(merged, sum(k for _, k in parts))]
        self.manifest.commit(self.spark.createDataFrame(parts, "part string, n bigint"), batch)
        return n
