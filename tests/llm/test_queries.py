"""The registered corpus queries and the pipeline over the smallest tables."""

import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from iotrace.llm import decontam, langid, toxicity
from iotrace.llm.common import bucket_of
from iotrace.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_": ["doc_id", "held_out", "score", "predicted"],
    "op2_": ["page_id", "url", "text", "n_chars"],
    "op3_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5_": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7_": ["doc_id", "fingerprint", "component_id"],
    "op8_": ["doc_id", "item_id", "distance"],
    "op9_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10_": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_": ["item_id", "rank", "doc_id", "score"],
    "op12_": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, sf_dir, name):
    kind = re.match(r"op\d+_", name)[0]
    out = QUERIES[name](spark, sf_dir)
    assert out.columns[: len(COLUMNS[kind])] == COLUMNS[kind]
    source = "pages" if kind in ("op2_", "op9_") else "documents"
    if kind == "op13_":
        assert out.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count() + 1
    elif kind not in ("op8_", "op11_", "op12_"):
        assert out.count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
    else:
        assert out.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in out.columns) for r in cur.fetchall())))
    assert sorted(map(repr, map(tuple, out.collect()))) == want


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op10_language"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_toxicity_of_the_whole_table_by_plain_sums(spark, sf_dir):
    """Every score of the query is the logistic of the fitted weights of the features present, and the fit is a minimum."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, sf_dir).collect()}
    train = labels.where(bucket_of(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(docs, train)
    labelled = {r.doc_id: r.toxic for r in train.collect() if r.toxic is not None}
    slope = [0.0] * (len(model.index) + 1)
    for r in docs.collect():
        on = [model.index[f] for f in toxicity.features(toxicity.word_set(r.text)) if f in model.index]
        score = 1 / (1 + math.exp(-model.bias - sum(model.weights[i] for i in on)))
        held_out = zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].held_out == held_out
        assert got[r.doc_id].predicted == (score >= 0.7)
        if r.doc_id in labelled:
            for i in [*on, -1]:
                slope[i] += score - labelled[r.doc_id]
    assert model.n_swapped == 0 and len(got) == docs.count()
    slope = [s + 0.02 * w for s, w in zip(slope, [*model.weights, 0.0], strict=True)]
    assert max(map(abs, slope)) < 0.02 * len(labelled)


@pytest.mark.parametrize("min_gap", [0.25, corpus_pipeline.MIN_GAP])
def test_mixtures_are_flagged(spark, min_gap):
    """As query 10 and as the pipeline tell them: of texts that are half one language and half another most are flagged, of held-out ones in one language few."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang is not null and length(text) > 400")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out), min_gap=min_gap)
    rows = [(r.lang, r.text) for r in docs.where(held_out).orderBy("doc_id").collect()]
    halves = []
    for k, (lang, text) in enumerate(rows):
        other = next((t for la, t in rows[k + 1 :] + rows[:k] if la != lang), None)
        n = min(len(text), len(other)) // 2
        halves.append((f"{text[:n]} {other[:n]}",))
    flagged = lambda texts: langid.identify(spark.createDataFrame(texts, "text string"), model).agg(F.avg(F.col("language.ambiguous").cast("int"))).first()[0]
    assert flagged(halves) >= 0.85
    assert flagged([(t,) for _, t in rows]) <= 0.01


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    rows = docs.unionByName(extra).withColumn("copies", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    n = rows.count()
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
        kept = rows.count()
        assert 0 < kept <= n, name
        n = kept
        if name != "mixing":
            assert rows.columns == [*docs.columns, "copies", "lang_pred"]
        if name == "decontamination":
            assert decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert rows.schema["copies"].dataType.simpleString() == "int"
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run_writes_and_reads_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
