"""Near-copy groups against brute force."""

import random

import pytest

import corpus_pipeline
from iotrace.llm import nearcopies


def brute(rows, least=0.8):
    sets = {}
    for i, text in rows:
        toks = (text or "").lower().split()
        width = min(5, len(toks))
        sets[i] = {tuple(toks[k : k + width]) for k in range(len(toks) - width + 1)} if width else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, alike = sorted(sets), []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both >= least * either:
                alike.append(both / either if either else 1.0)
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, alike


def rows():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(50_000)}"
    out = []
    for n in (60, 120, 200, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            out.append(" ".join(base))
            for part in (0.005, 0.01, 0.015, 0.02, 0.03):
                copy = list(base)
                for at in rng.sample(range(n), max(1, round(part * n))):
                    copy[at] = word()
                out.append(" ".join(copy))
    chain = [word() for _ in range(100)]  # each near the next, the ends far apart
    for _ in range(40):
        out.append(" ".join(chain))
        for at in rng.sample(range(100), 2):
            chain[at] = word()
    out += [out[0], out[0].upper(), "", None, "  ", "a b", "A  b", "a c"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("chunk", [nearcopies.CHUNK_ROWS, 3])
def test_groups_are_those_of_brute_force(spark, chunk):
    data = rows()
    want, alike = brute(data)
    assert sum(0.8 <= s < 0.95 for s in alike) > 50
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = nearcopies.near_copies(df, chunk_rows=chunk).collect()
    assert len(got) == len(data) and {r.doc_id: r.component_id for r in got} == want


def test_stage_drops_near_copies(spark):
    data = rows()
    want, _ = brute(data)
    df = spark.createDataFrame([*data, data[0], (None, data[0][1])], "doc_id bigint, text string")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(want.values())) and got.count(None) == 1
    assert nearcopies.near_copies(df.limit(0)).count() == 0
