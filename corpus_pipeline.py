"""A corpus pipeline in five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from iotrace.llm import decontam, langid, mixing, nearcopies, pii
from iotrace.llm.common import bucket_of
from iotrace.storage import materialize, shared_path


#: At this gap most halves-and-halves of two languages are told, and no document in one language is.
MIN_GAP = 0.15


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those of two languages in equal parts, which belong to none.

    A second language nearer than ``MIN_GAP`` of what it is in text of one language is such a case; documents with
    some passages in another language stay. Learns from the rows with a language whose crc32(doc_id) mod 4 is not 2. Where none has a language there is
    nothing to reject by, and all rows stay; else null and empty texts go.
    """
    model = langid.fit(docs.where(bucket_of(F.col("doc_id"), 4) != 2), min_gap=MIN_GAP)
    if not model.langs:
        return docs
    named = langid.identify(docs, model, out_col="__language")
    return named.where("__language.lang <> 'und' and not __language.ambiguous").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the least id, of each near-duplicate group; rows without an id stay.

    Links are those of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Operator
    7's fingerprints propose candidates, and bands of shingles those that its 3 bits are too few for; each is
    verified. Rows of one id stay or go together; of rows with equal id and text one stays.
    """
    groups = nearcopies.near_copies(docs).where("doc_id is not null").groupBy("doc_id")
    leads = groups.agg(F.max(F.col("doc_id") == F.col("component_id")).alias("leads"))
    copies = leads.where("not leads").select(F.col("doc_id").alias("__copy"))
    kept = docs.join(copies, docs["doc_id"] == copies["__copy"], "left_anti")
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    keyed = kept.where("doc_id is not null").withColumn("__key", key)
    again = materialize(keyed.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key"), "repeated-rows")
    few = F.broadcast(again) if again.count() <= 200_000 else again
    order = W.partitionBy("__key").orderBy(F.xxhash64(*docs.columns), *[c for c, kind in docs.dtypes if "map" not in kind])
    firsts = keyed.join(few, "__key", "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    out = keyed.join(few, "__key", "left_anti").select(*docs.columns).unionByName(firsts.select(*docs.columns))
    return out.unionByName(kept.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item is found within its error budget."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take personal data, and the terms that reveal it, out of the texts; every document stays, n_chars follows."""
    out = pii.sanitize(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of times it takes each as ``copies``."""
    found, _ = mixing.solve(docs)
    out = found.apply(docs, out_col="__mix").where("__mix.copies > 0")
    return out.select(*[F.col(c) for c in docs.columns if c != "copies"], F.col("__mix.copies").alias("copies"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing_weights),
]

#: SQL has neither the learned stages nor the fingerprints; ``tests/llm`` holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
