"""The pipeline's stages in turn against plain versions of each, each on what the one before it kept."""

import math
import random
import re

from pyspark.sql import functions as F
from test_text import WORD, plain_distance, plain_sanitized, plain_targets, prose

import corpus_pipeline
from iotrace.llm import decontam, langid
from iotrace.llm.common import bucket_of

LETTERS = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}


def corpus():
    rng = random.Random(51)
    words = {la: ["".join(rng.choice(x) for _ in range(rng.randrange(2, 8))) for _ in range(300)] for la, x in LETTERS.items()}
    items = [(i, prose(rng, 24, words[la])) for i, la in enumerate(LETTERS)]
    rows = []
    for i in range(240):
        la = rng.choice(sorted(LETTERS))
        text = prose(rng, rng.randrange(60, 120), words[la])
        if i % 11 == 3:
            at = rng.randrange(20)
            text = " ".join([*text.split()[:at], *items[sorted(LETTERS).index(la)][1].split(), *text.split()[at:]])
        if i % 7 == 2:
            text += f" +1 (724) 555-7{i:03d} x{i}@mail.example.com"
        rows.append((i, text, la if i % 5 else None, rng.choice(["one", "two", None])))
    for k, n in ((5, 6), (17, 3), (40, 1)):  # copies with some words changed, and exact ones
        for j in range(n):
            w = rows[k][1].split()
            w[10 * j % len(w)] = "changed"
            rows.append((300 + 10 * k + j, " ".join(w) if j % 3 else rows[k][1], rows[k][2], "two"))
    halves = [prose(rng, 60, words["aa"]) + " " + prose(rng, 60, words["bb"]) for _ in range(4)]
    rows += [(900 + j, t, None, "one") for j, t in enumerate(halves)]
    rows += [(950, None, None, "one"), (951, "", None, None), (952, "123 456", None, "one"), (953, "12 34", "aa", "two"), rows[20]]
    return rows, items


def plain_near_copies(rows):
    sets = []
    for _, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                root[find(i)] = find(j)
    lead = {}
    for i, r in enumerate(rows):
        lead[find(i)] = min(lead.get(find(i), r[0]), r[0])
    kept, seen = [], set()
    for i, r in enumerate(rows):
        if r[0] == lead[find(i)] and r[:2] not in seen:
            seen.add(r[:2])
            kept.append(r)
    return kept


def test_stages_equal_plain_versions(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id bigint, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("bigint"))
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    model = langid.fit(docs.where(bucket_of(F.col("doc_id"), 4) != 2), min_gap=corpus_pipeline.MIN_GAP)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name == "language_id":
            told = {t: model.decode(t) for _, t, *_ in want}
            want = [r for r in want if told[r[1]][0] != "und" and not told[r[1]][2]]
            assert all(told[t][0] == la for _, t, la, _ in want if la) and sum(900 <= r[0] < 904 for r in want) <= 1
        elif name == "near_duplicates":
            want = plain_near_copies(want)
        elif name == "decontamination":
            words = [(decontam.tokens(t), len(decontam.tokens(t))) for _, t in items]
            want = [r for r in want if all(plain_distance(p, decontam.tokens(r[1])) > math.floor(0.2 * n) for p, n in words)]
        elif name == "personal_data":
            want = [(r[0], plain_sanitized(r[1]), *r[2:]) for r in want]
        if name != "mixing":
            got = sorted((tuple(r)[:4] for r in docs.collect()), key=repr)
            assert got == sorted(want, key=repr), name
            assert docs.where("n_chars <> length(text)").count() == 0
    sizes = {}
    for _, t, _, source in want:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(t))
    goal, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    texts = {r[:2]: r for r in want}
    for r in docs.collect():
        assert (r.doc_id, r.text) in texts and 1 <= r.copies <= 2
        taken[r.source] += r.copies * len(WORD.findall(r.text))
    assert all(abs(taken[s] - goal[s]) <= 60 for s in sizes), (taken, goal)
    run = sorted((r.doc_id, r.copies) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert run == sorted((r.doc_id, r.copies) for r in docs.collect())
