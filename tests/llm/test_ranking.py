"""Ranked search against a plain scorer, prefix tries against a plain trie, chat windows against a round trip."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from iotrace.llm import chat, prefixtrie, ranking
from iotrace.llm.queries import TOKENIZER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- ranked search


def plain_ranks(docs, items, k):
    rows = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n_docs, n_all = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(TERM.findall(lower(text)))
    out = []
    for item, ts in wanted.items():
        found = []
        for i, c, n in rows:
            m = 50 + 50 * n * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n, n_items):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(4000)] + ["É", "ünd", "X1", "x1"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "\n", ", ", "-", "_"]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 20, 60, 400]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(60)] + [docs[3], docs[3], (None, docs[7][1]), (n + 99, None), (n + 98, ""), (n + 97, "?! \n"), (n + 96, "w1 " * 30_000)]
    items = [(i, text(rng.choice([1, 5, 40]))) for i in range(n_items)] + [(500, docs[7][1]), (501, None), (502, " .. "), (None, "w1 w2 É"), (0, "w3 x1")]
    return docs, items


@pytest.fixture(scope="module")
def small():
    return corpus(3, 400, 25)


@pytest.mark.parametrize("max_terms", [400_000, 120, 0])
def test_ranks_equal_a_plain_scorer(spark, small, max_terms):
    docs, items = small
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"score": F.lit("clash"), "item_id": F.lit(1)}).repartition(5)
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("clash"))
    out = ranking.search(d, q, k=50, max_terms=max_terms)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_ranks(docs, items, 50)


def test_search_without_rows(spark, small):
    docs, items = (spark.createDataFrame(x, f"{c} bigint, text string") for x, c in zip(small, ("doc_id", "item_id"), strict=True))
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0
    assert ranking.search(docs, items.where("item_id >= 501")).count() == 0


def test_bounds_put_off_most_rows(spark):
    """A bucket scores exactly only rows that can reach the floor: far fewer than all rows with a term of the item."""
    import numpy as np

    rng = np.random.default_rng(1)
    n, v = 3000, 400
    p = 1 / np.arange(1, v + 1)
    rows = [np.unique(rng.choice(v, 60, p=p / p.sum())) for _ in range(n)]
    starts, tids = np.cumsum([0, *map(len, rows)]), np.concatenate(rows)
    impacts = rng.integers(200_000, 400_000, len(tids))
    df = np.bincount(tids, minlength=v)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    items = ranking.Items(np.array([0, len(rows[5])]), rows[5].astype(np.int64), weights)
    lengths = np.sqrt(np.bincount(np.repeat(np.arange(n), np.diff(starts)), weights[tids] * impacts.astype(float) ** 2, n))
    dense = np.zeros((n, v), np.int64)
    dense[np.repeat(np.arange(n), np.diff(starts)), tids] = impacts
    want = np.sort((dense[:, rows[5]] * weights[rows[5]]).sum(1))[::-1][:10]
    for floor in (0, int(want[-1])):
        best = ranking._Best(np.array([floor]), 10)
        ranking.search_bucket(items, best, np.arange(n), np.zeros(n, bool), lengths, starts, tids, impacts)
        assert best.rows[0][0].tolist() == want.tolist()
    best = ranking._Best(np.array([int(items.length[0] * lengths.max()) + 1]), 10)
    ranking.search_bucket(items, best, np.arange(n), np.zeros(n, bool), lengths, starts, tids, impacts)
    assert not best.rows


# -- prefix trie


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in kids[p]) if kids[p] else 1
        sums[p] = (leaves, sum(sums[k][1] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-12, n):
        if c % 17 == 4:
            continue
        same = c % 3 == 0
        for t in range(rng.choice([1, 2, 4, 9, 12]) if not same else 11):
            text = f"hello {t}" if same or t < 2 else rng.choice([None, "", "é" * rng.randrange(4), "x"])
            rows.append((c, t if t else None, "user" if t % 2 == 0 else rng.choice(["assistant", None]) if not same else "assistant", text))
    rows += [rows[0], rows[0], rows[5], (None, 1, "user", "lost"), (9_999, 3, None, None)]
    rows += [(c, t, "user", f"deep {t}") for c in (700, 701, 702) for t in range(200)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("shard_rows", [5_000, 25, 4])
def test_nodes_equal_a_plain_trie(spark, shard_rows):
    rows = talks(2, 200)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("clash"), "path": F.lit(1)}).repartition(4)
    got = prefixtrie.nodes(df, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_cut_splitters_and_pieces_of_ends(spark, monkeypatch):
    """Splitters cut short still separate; ends that go out in many pieces give the same hash."""
    rows = talks(4, 120)
    whole = prefixtrie.splitters
    monkeypatch.setattr(prefixtrie, "splitters", lambda r, n: whole(r, n, max_bytes=3 * 16 * 8 * n))
    monkeypatch.setattr(prefixtrie, "_PIECE", 2)
    got = prefixtrie.nodes(spark.createDataFrame(rows, SCHEMA), shard_rows=9)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_skeleton_is_numbered_as_a_walk():
    """Numbers follow the sorted prefixes, and the table grows with the splitters' turns, not with the square of their length."""
    rng = random.Random(9)
    path = lambda n: b"".join(rng.choice([b"a", b"b"]) * prefixtrie.WIDTH for _ in range(n))
    cuts = sorted({(path(rng.randrange(7)), c) for c in range(60)})
    number = prefixtrie.skeleton_of(cuts)
    prefixes = sorted({p[:n] for p, _ in cuts for n in range(0, len(p) + 1, prefixtrie.WIDTH)} | {b""})

    def of(p):
        node = 0
        for a in range(0, len(p), prefixtrie.WIDTH):
            node = number[node, p[a : a + prefixtrie.WIDTH]]
        return node

    assert [of(p) for p in prefixes] == list(range(len(prefixes)))
    long = prefixtrie.skeleton_of([(hashlib.sha256(b"x").digest() * 50_000, 1)])
    assert len(long) == 100_000 and sum(len(d) for _, d in long) == 1_600_000


def test_long_conversations(spark):
    """A node a turn of conversations of 30,000 turns that share their first half."""
    turns = 30_000
    df = spark.range(4 * turns).selectExpr("900 + 5 * (id % 4) conv_id", "id div 4 turn", "'user' role", f"if(id div 4 < {turns // 2}, 'same', concat('own ', id % 4)) text")
    got = {(r["depth"], r["conv_id"]): r for r in prefixtrie.nodes(df, shard_rows=1).collect()}
    assert len(got) == turns // 2 + 1 + 4 * (turns // 2)
    assert (got[0, 900]["n_convs"], got[0, 900]["n_leaves"], got[0, 900]["saved_tokens"]) == (4, 4, 3 * 4 * (turns // 2))
    assert (got[turns, 915]["n_leaves"], got[turns // 2, 900]["n_children"]) == (1, 4)


def test_trie_without_conversations(spark):
    assert prefixtrie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixtrie.nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


# -- chat windows


def chats(seed):
    rng = random.Random(seed)
    bits = ["<|im_start|>", "<|im_end|>\n", "<\\|", "<\\\\|", "\n", "<", "|", "\\", "é", "😀", " word", " x", "\\n"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.choice([1, 2, 5, 30]) if c not in (3, None) else 300):
            role = rng.choice(["user", "assistant", "assistant", "tool\nx", "a\\nb\\", "<|im_end|>", None]) if t else "system"
            rows.append((c, t if t else None, role, rng.choice([None, "", *(text() for _ in range(6))])))
    return [*rows, (77, 1, "assistant", "long " * 30_000), (78, 1, "system", "s " * 3_000), (78, 2, "assistant", "a"), (79, 5, "assistant", "same"), (79, 5, "assistant", "same")]


def plain_digests(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, v in convs.items():
        v.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        loss = "".join(r[3] or "" for r in v if r[2] == "assistant")
        out[c] = (len(v), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in v)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("sizes", [{"budget": 120, "history": 20, "max_system": 30}, {"budget": 60, "history": 10, "max_system": 40}, {"budget": 700}, {}])
def test_windows_read_back(spark, sizes):
    rows = chats(5)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tokens": F.lit("clash"), "pos": F.lit(1)}).repartition(5)
    sizes = sizes if "history" in sizes or not sizes else sizes | {"history": 100, "max_system": 100}
    out = chat.windows(df, TOKENIZER, **sizes).persist()
    got = {r[0]: tuple(r[1:5]) for r in chat.digests(chat.read_back(out)).collect()}
    assert got == plain_digests(rows)
    budget = sizes.get("budget", 4096)
    back = chat.read_back(out).join(out.drop("formatted"), ["first_turn", "conv_id"]).where(F.size("turns") > 1)
    assert back.where(F.col("n_tokens") > budget).count() == 0
    later = out.where("conv_id = 3 and first_turn > 0").orderBy("first_turn").collect()
    if not sizes:
        assert all(r.n_repeated > 1 and r.formatted.startswith("<|im_start|>system\n") for r in later)
    # repeated turns lie before every loss span
    for r in later:
        for s in r.loss_spans:
            assert r.formatted[: s.start].count("<|im_start|>") > r.n_repeated


def test_windows_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(chats(6), SCHEMA)
    one = {tuple(r)[:3] for r in chat.windows(df.coalesce(1), TOKENIZER, 200, 50, 30).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = {tuple(r)[:3] for r in chat.windows(df.repartition(9), TOKENIZER, 200, 50, 30).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many


def test_no_turns_no_windows(spark):
    out = chat.windows(spark.createDataFrame([], SCHEMA), TOKENIZER)
    assert out.count() == 0 and chat.digests(chat.read_back(out)).count() == 0
