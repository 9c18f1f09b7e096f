"""Operators on documents, against plain versions on small fixtures."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from iotrace.llm import decontam, langid, mixing, pii, quality, simhash, suffixtree, toxicity
from iotrace.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(900, None), (901, ""), (902, "  \n\t "), (903, "one"), (903, "one"), (None, "no id here at all"), (904, "long " * 30_000)]


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", F.lit("clash").alias("score"), F.lit(1).alias("words"), F.lit("s").alias("source"), F.lit(0).alias("size"))


def prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- SimHash


def plain_fingerprint(t):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    votes = [0] * 64
    for g in s:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum((2 * v > len(s)) << b for b, v in enumerate(votes))


def plain_components(fps, bits=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("chunk", [simhash.CHUNK_ROWS, 4])
def test_near_duplicates(spark, chunk):
    rng = random.Random(1)
    vocab = [f"w{i}É" if i % 9 == 0 else f"W{i}" for i in range(400)]
    rows = [(i, prose(rng, rng.randrange(1, 60), vocab)) for i in range(60)]
    base = prose(rng, 400, vocab).split()
    for i in range(60, 110):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(copy)))
    rows += EDGE
    got = simhash.near_duplicates(docs(spark, rows), chunk_rows=chunk).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    assert sorted(((r.doc_id or -1, r.fp % (1 << 64)) for r in got)) == sorted(((d or -1, f) for (d, _), f in zip(rows, fps)))
    comp, least = plain_components(fps), {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = Counter((d, least.get(c)) for (d, _), c in zip(rows, comp))
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# -- language identification


def test_language_id(spark):
    rng = random.Random(2)
    lang = {"xx": ["aba", "bab", "abba", "baa"], "yy": ["keke", "ekek", "kee", "eek"], "zz": ["suu", "usus", "sus", "uuss"]}
    rows = [(k, prose(rng, 20, v), k) for k, v in lang.items() for _ in range(20)] + [(None, "aba", None), (None, None, "xx")]
    train = spark.createDataFrame([(t, la) for _, t, la in rows], "text string, lang string")
    model = langid.fit(train)
    assert model.langs == ["xx", "yy", "zz"] and model.code.shape == (3, 3)
    test = spark.createDataFrame([("ABBA baa aba!",), ("kee 123 eek",), ("",), (None,), ("123 !?",), ("sus " * 50_000,)], "text string").withColumn("lang", F.lit("?"))
    got = [(r.language.lang, 0 <= r.language.score <= 1) for r in langid.identify(test, model).collect()]
    assert got == [("xx", True), ("yy", True), ("und", True), ("und", True), ("und", True), ("zz", True)]
    assert langid.identify(test, model).first().lang == "?"
    nothing = langid.fit(train.limit(0))
    assert {r.language.lang for r in langid.identify(test, nothing).collect()} == {"und"}


def test_language_codes_against_a_plain_version(spark):
    """Counts, weights, losses and the nearest codeword by dictionaries and loops, for every row."""
    rng = random.Random(22)
    words = {"xx": ["aba", "bab", "ab"], "yy": ["keke", "ek", "kab"], "zz": ["suu", "usa", "kus"], "vv": ["ola", "lo", "suo"]}
    rows = [(k, prose(rng, rng.randrange(1, 9), v)) for k, v in words.items() for _ in range(12)]
    bits = 10
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), bits=bits)
    grams = lambda t: langid.ngram_ids(langid.symbols(t), bits).tolist()
    counts = {k: Counter() for k in sorted(words)}
    for k, t in rows:
        counts[k].update(grams(t))
    langs, code, size = sorted(words), langid.codewords(4), 1 << bits
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    weights, trust = [], []
    for b in range(code.shape[1]):
        w = {}
        for g in range(size):
            side = {s: np.mean([share[k].get(g, 0.0) for k, row in zip(langs, code) if row[b] == s]) for s in (1, -1)}
            w[g] = 0.0 if side[1] + side[-1] < 1 / size / 4 else max(-6.0, min(6.0, math.log((side[1] + 0.1 / size) / (side[-1] + 0.1 / size))))
        weights.append(w)
        trust.append(max(0.05, min(row[b] * sum(w[g] * x for g, x in share[k].items()) for k, row in zip(langs, code))))
    trust = [t / np.mean(trust) for t in trust]
    test = [t for _, t in rows] + ["aba keke", "x", "suu ola suu ola", "Ab! kus"]
    df = spark.createDataFrame([(t,) for t in test], "text string")
    for t, got in zip(test, [r.language for r in langid.identify(df, model).collect()], strict=True):
        g = grams(t)
        margin = [sum(w[i] for i in g) / (len(g) + 8) * 6.0 for w in weights]
        loss = [sum(r * math.log1p(math.exp(-c * m)) for r, c, m in zip(trust, row, margin)) for row in code.tolist()]
        best = min(range(4), key=lambda k: (round(loss[k], 5), k))
        assert got.lang == langs[best]
        assert got.score == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss), abs=1e-3)


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 12, 40):
        code = langid.codewords(n).astype(int)
        assert len({tuple(r) for r in code}) == n
        if n > 2:
            apart = (code[:, None, :] != code[None]).sum(2)[np.triu_indices(n, 1)]
            assert apart.min() >= 2
    assert langid.codewords(12).shape[1] < 2**11


# -- quality rules


def plain_base(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 40), ["a", "bé", "c#", "d\n", "e|<", "𝄞x"])) for i in range(80)] + EDGE
    rows += [(300 + i, "Plain good words here and there about things of note today " * 2) for i in range(20)]
    rows += [(400 + i, " ".join(f"BAD{i}{j}!! $$x{j}##" for j in range(30))) for i in range(20)]
    good = spark.createDataFrame([(300 + i,) for i in range(15)] + [(None,), (999,)], "doc_id bigint")
    got = quality.judge(docs(spark, rows), good).collect()
    want = Counter((d, *plain_base(t)) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    by = {r.doc_id: r for r in got}
    assert by[317].score > by[405].score < -0.135 and not by[405].kept
    assert quality.judge(docs(spark, []), good).count() == 0


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data if isinstance(data, bytes) else data.to_bytes(8, "little"), seed)


def plain_grams(t, buckets):
    words = WORD.findall(t or "")
    turn = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "0" * 10)
    one = (1).to_bytes(4, "little")
    ids = [xx(w.encode()) for w in words]
    shapes = [xx(one, xx((w[:2] + w[-2:]).translate(turn).encode())) for w in words]
    both = [xx(b, xx(a)) for a, b in zip(ids, ids[1:])]
    alike = [xx(one, xx(b, xx(a))) for a, b in zip(shapes, shapes[1:])]
    return [h % buckets for h in (*ids, *both, *alike)]


def test_quality_against_plain_ratios(spark):
    rng = random.Random(13)
    vocab = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in "mnrst"]
    rows = [(i, prose(rng, rng.randrange(8, 60), vocab[:100])) for i in range(240)]
    rows += [(300 + i, prose(rng, rng.randrange(11, 60), vocab[60:] + ["X9!x", "$$$", "Zz|Qq"])) for i in range(60)]
    rows += [rows[7], (None, rows[9][1]), (500, "long words " * 4000), *EDGE]
    good = {i for i in range(0, 240, 2)}
    trusted = spark.createDataFrame([(i,) for i in sorted(good)] * 2 + [(None,)], "doc_id bigint")
    buckets, prior = 1 << 10, 16
    held = {i for i in good if int(np.int64(np.uint64(xx(b"trusted", xx(str(i).encode()))))) % 4 == 0}
    raw, target = [0.5] * buckets, [0.5] * buckets
    for i, t in rows:
        for g in plain_grams(t, buckets):
            raw[g] += 1
            target[g] += i in good - held
    weight = [math.log(x / sum(target)) - math.log(y / sum(raw)) for x, y in zip(target, raw)]
    score = lambda t: sum(weight[g] for g in plain_grams(t, buckets)) / (len(plain_grams(t, buckets)) + prior)
    failed = lambda t: (b := plain_base(t))[0] < 10 or 100 * b[4] > 20 * b[0]
    step = 2.0**-17
    ordered = sorted(math.floor(score(t) / step) * step for i, t in rows if i in held and not failed(t))
    low, middle = (ordered[math.ceil(len(ordered) * q) - 1] for q in (0.01, 0.5))
    limit = 2 * low - middle
    for most in (1_000_000, 0):
        got = quality.judge(docs(spark, rows), trusted, buckets=buckets, max_broadcast=most).collect()
        assert [r.min_score for r in got] == pytest.approx([limit] * len(got), abs=1e-9)
        want = sorted((i or -1, round(score(t), 9), not failed(t) and score(t) >= limit) for i, t in rows)
        assert sorted((r.doc_id or -1, round(r.score, 9), r.kept) for r in got) == want
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & good) > 80


def test_fence_keeps_a_tie(spark):
    same = spark.createDataFrame([(0.1,)] * 9, "score double")
    assert quality.lower_fence(same) <= 0.1 and quality.lower_fence(same.limit(0)) is None


def test_log_ratios(spark):
    df = spark.createDataFrame([([0, 1, 1], True), ([2], False)], "grams array<int>, trusted boolean")
    got = quality.log_ratios(df, 4)
    raw, target = [1.5, 2.5, 1.5, 0.5], [1.5, 2.5, 0.5, 0.5]
    assert got == pytest.approx([math.log(t / 5) - math.log(r / 6) for t, r in zip(target, raw)])


# -- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, ch in enumerate(reversed(d)):
        x = int(ch) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def plain_spans(t):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        return {"email": True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    found = [(m.start(), i, m.end(), k) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], t or "") if ok(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_match_plain_search(spark):
    rng = random.Random(4)
    atoms = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "000.01.2.3", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (724) 555-7058", "+49", "é", "𝄞", " ", "-", "5", "a_b@c.d.x_y@z.w", "1.2.3.4.5.6.7.8", "\n"]
    rows = [(i, "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 14)))) for i in range(300)] + EDGE + [(950, "7" * 5000), (951, "a@b." * 2000), (952, "a" * 5000 + "@"), (953, "1.1.1.1 " * 500)]
    got = pii.report(pii.annotate(docs(spark, rows))).collect()
    want = Counter((d, plain_spans(t), hashlib.sha256(plain_spans(t).encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.spans, r.base_sha256) for r in got) == want
    assert pii.annotate(docs(spark, [])).count() == 0


def secret_corpus():
    rng = random.Random(5)
    vocab = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(i, prose(rng, 40, vocab)) for i in range(300)]
    for i in range(300, 312):  # the code word stands by one address in many texts, and nowhere else
        rows.append((i, f"{prose(rng, 20, vocab)} Zorblax wrote from boss@corp.example.com {prose(rng, 20, vocab)}"))
    for i in range(320, 332):  # a fixed last line, and a short name far from the address
        rows.append((i, f"Li said {prose(rng, 60, vocab)}\nFor all that concerns this matter and any other one, write at once to Quux at desk@line.example.com"))
    rows.append((400, f"Nothing but zorblax. {prose(rng, 30, vocab)}"))
    copy = f"{prose(rng, 15, vocab)} uniquecopy wrote from one@copies.example.com {prose(rng, 80, vocab)}"
    near = [" ".join("changed" if k == 30 + i else w for k, w in enumerate(copy.split())) for i in range(20)]
    return rows + [(500 + i, copy) for i in range(20)] + [(600 + i, t) for i, t in enumerate(near)]


@pytest.mark.parametrize("most", [50_000, 0])
def test_terms_that_reveal_an_entity(spark, most):
    rows = secret_corpus()
    got = {r.doc_id: r for r in pii.report(pii.annotate(docs(spark, rows), max_broadcast=most)).collect()}
    texts = dict(rows)
    spans = lambda d: [texts[d][int(s.split(":")[1]) : int(s.split(":")[2])].lower() for s in got[d].spans.split(",") if s.startswith("term")]
    assert "zorblax" in spans(305) and spans(400) == ["zorblax"]
    assert {"li", "quux"} <= set(spans(325))
    assert not got[7].spans and got[505].n_email == 1 and not got[505].n_term and not got[605].n_term
    clean = {r.doc_id: r.text for r in pii.sanitize(docs(spark, rows), max_broadcast=most).collect()}
    assert "boss@" not in clean[305] and "[EMAIL]" in clean[305] and "orblax" not in clean[400]
    assert "Quux" not in clean[325] and "Li" not in clean[325]
    assert clean[7] == texts[7]


def plain_disclosure(rows, min_texts=4, least=0.9, share=0.5):
    """(term, entity) -> disclosure by counting different texts, for texts that are no near copies."""
    texts = {t or "" for _, t in rows}
    words = lambda t: {w for w in re.split(r"[\W\d_]+", t.lower()) if len(w) >= 2}
    named, with_term, together = Counter(), Counter(), Counter()
    for t in texts:
        with_term.update(words(t))
        spans = [x.split(":") for x in plain_spans(t).split(",") if x]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        seen, here = set(), set()
        for i, (k, a, b) in enumerate(spans):
            value = t[a:b]
            own = {f"{list(PLAIN).index(k)}:" + (value.lower() if k == "email" else value if k == "ip" else re.sub("[^0-9]", "", value))}
            own |= {"0:@" + value.lower().split("@")[1]} if k == "email" else set()
            here |= own
            around = t[spans[i - 1][2] if i else 0 : a] + " " + t[b : spans[i + 1][1] if i + 1 < len(spans) else len(t)]
            seen |= {(w, entity) for w in words(around) for entity in own}
        named.update(here)
        together.update(seen)
    out = {}
    for (w, e), n in together.items():
        s = n / with_term[w]
        d = 1 + math.log(s) / -math.log(min(0.5, named[e] / len(texts)))
        if n >= min_texts and s >= share and d >= least:
            out[w, e] = d
    return out


def test_disclosure_against_plain_counts(spark):
    rng = random.Random(21)
    vocab = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "klmnop"]
    people = [(f"name{chr(97 + k)}x", rng.choice([f"p{k}@x.org", f"10.0.0.{k}", "4111 1111 1111 1111", f"+49 30 555 000{k}"])) for k in range(8)]
    rows = []
    for i in range(400):
        t = prose(rng, rng.randrange(12, 40), vocab).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            name, secret = rng.choice(people)
            at = rng.randrange(len(t))
            t[at:at] = [secret] + ([name] if rng.random() < 0.9 else [])
            if rng.random() < 0.05:
                t.insert(0, name)
        rows.append((i, " ".join(t)))
    rows += [rows[3], (None, rows[5][1]), *EDGE]
    want = plain_disclosure(rows)
    assert len(want) > 3
    for most in (50_000, 0):
        got = {(r.term, r.entity): r.disclosure for r in pii.disclosing_terms(docs(spark, rows), max_broadcast=most).collect()}
        assert got == pytest.approx(want)


def test_an_organisation_reveals_its_domain(spark):
    """Addresses that never recur, of one domain, beside the organisation's name: the name is a term, also where it stands alone."""
    rng = random.Random(41)
    vocab = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "klmnop"]
    rows = [(i, f"{prose(rng, 15, vocab)} {'Acmecorp ' if i % 10 == 0 else ''}{f'{vocab[i]}.{i}@acme.example.com ' if i % 10 == 0 else ''}{prose(rng, 15, vocab)}") for i in range(200)]
    rows += [(300, f"{prose(rng, 9, vocab)} acmecorp {prose(rng, 9, vocab)}")]
    got = {r.doc_id: r for r in pii.report(pii.annotate(docs(spark, rows))).collect()}
    assert all(got[i].n_term == (i % 10 == 0 or i == 300) for i in got)
    assert "acmecorp" not in {r.doc_id: r.text.lower() for r in pii.sanitize(docs(spark, rows)).collect()}[300]


def plain_sanitized(t):
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in plain_spans(t).split(",") if x):
        if int(a) >= at:
            out += [t[at : int(a)], f"[{kind.upper()}]"]
        at = max(at, int(b))
    return "".join(out) + t[at:]


def test_overlapping_spans_are_replaced_as_one(spark):
    rng = random.Random(14)
    atoms = ["+1234567890", "1.2.3.4", "4111111111111111", " ", "a@b.c", "é", "𝄞", ".", "-", "x" * 700]
    rows = [(i, "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 900 if i % 20 == 0 else 9)))) for i in range(150)]
    assert {r.doc_id: r.text for r in pii.sanitize(docs(spark, rows)).collect()} == {i: plain_sanitized(t) for i, t in rows}


def test_many_matches_in_one_text(spark):
    numbers = " ".join(str(10 + i % 90) for i in range(300_000))
    ips = " ".join(f"10.0.{i % 256}.{i % 250}" for i in range(40_000))
    mixed = " ".join(rng_part for i in range(3000) for rng_part in (f"1.2.{i % 256}.4", "a@b.de", "é" * (i % 7), "+1 (724) 555-7058", "x"))
    rows = [(1, numbers), (2, ips), (3, mixed)]
    began = time.time()
    got = {r.doc_id: r for r in pii.report(pii.annotate(docs(spark, rows))).collect()}
    assert got[1].spans == "" and got[2].n_ip == 40_000 and got[3].spans == plain_spans(mixed)
    clean = {r.doc_id: r.text for r in pii.sanitize(docs(spark, rows)).collect()}
    assert clean[1] == numbers and clean[2] == " ".join(["[IP]"] * 40_000)
    assert clean[3] == plain_sanitized(mixed) and "[PHONE]" in clean[3] and "[EMAIL]" in clean[3]
    assert time.time() - began < 60


def test_sanitize_keeps_columns_and_nulls(spark):
    rows = [(1, None), (2, "call +1 (724) 555-7058 now"), (3, "ip 1.2.3.4, 1.2.3.4")]
    out = pii.sanitize(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: None, 2: "call [PHONE] now", 3: "ip [IP], [IP]"}


# -- mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return out | level
        for s in over:
            out[s] = 2 * sizes[s]
            rest -= out[s]
            open_.discard(s)


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([1, 5, 20, 80, 300]), rng.choice(["b", "a", None, "Z", "é", "c"])) for i in range(600)]
    rows += [(700, None, "b"), (701, "", "only-empty"), (None, "w w", "b"), (705, "w w w", "a"), (705, "w w w", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("target", F.lit("clash")).withColumn("sid", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    src = {i: s for i, _, s in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        s = src[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 2 * r.size and r.source_size == sizes[s]
    want = plain_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 5)
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in got}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_keeps_all_columns_and_null_ids_apart(spark):
    rng = random.Random(15)
    rows = [(None if i % 2 else i, f"{'w ' * rng.choice([3, 9, 40])}t{i}", rng.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df = df.withColumns({c: F.lit("clash") for c in ("mix", "size", "sid", "rate", "copies", "base", "_size", "target", "_doc", "step")})
    found, _ = mixing.solve(df)
    got = found.apply(df, out_col="__mix").collect()
    assert got[0].asDict().keys() == {*df.columns, "__mix"} and len(got) == 300
    assert {r.base for r in got} == {"clash"}
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r["__mix"]["size"] * r["__mix"]["copies"]
        target[r.source] = r["__mix"]["target"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)
    assert Counter((r.doc_id, r["__mix"]["size"], r["__mix"]["copies"]) for r in got) == Counter((r.doc_id, r["size"], r["copies"]) for r in mixing.mix(df).collect())


def test_balance_solves_the_constraints(spark):
    sizes = spark.createDataFrame([(1, s, n, s / 50) for s, n in ((1, 10), (10, 5), (50, 2))], "sid int, size bigint, n bigint, z double")
    for target in (30.0, 150.0, 160.0, 290.0):
        plan = [{"sid": 1, "target": target, "source_size": 160}]
        t = mixing.balance(sizes, plan)[1]
        got = sum(s * n * min(2, math.exp(t * s / 50)) for s, n in ((1, 10), (10, 5), (50, 2)))
        assert got == pytest.approx(target, rel=1e-6)
    assert mixing.balance(sizes, [{"sid": 1, "target": 320.0, "source_size": 160}])[1] == math.inf


# -- language-model scores


def test_suffix_tree_scores(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(("aa bb" if rng.random() < 0.5 else "cc dd") if rng.random() < 0.7 else rng.choice(["ee", "Ff", "gg"]) for _ in range(30))) for i in range(200)] + EDGE
    rows += [(3000 + i, f"rare{i} aa bb") for i in range(20)]
    for common in (100_000, 3):
        got = suffixtree.score(docs(spark, rows), common_words=common).collect()
        tok = lambda t: [*WORD.findall(lower(t)), ""]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        c = Counter(w for d, t in rows if not held(d) for w in tok(t))
        n, v = sum(c.values()), len(c)
        want = sorted((d or -1, held(d), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 4)) for d, t in rows)
        assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in suffixtree.score(docs(spark, rows)).collect() if r.held_out and r.n_tokens < 200]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert suffixtree.score(docs(spark, [])).count() == 0


def grown(spark, texts, **options):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    c = Counter(w for t in texts for w in suffixtree.tokens(t))
    words = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    n, v = sum(c.values()), len(c)
    return suffixtree.grow(df, words, n, v, **options), c, n, v


def lift(tree, toks):
    return float(tree.lifts(np.array([tree.ids[w] for w in toks], np.int64), np.array([0]))[0]) if toks else 0.0


def test_contexts_spread_all_their_mass(spark):
    rng = random.Random(8)
    tree, c, n, v = grown(spark, [" ".join(rng.choice(["x y", "x y z", "p q x y", "r"]) for _ in range(40)) for _ in range(60)])
    assert len(tree.levels) == 4 and all(len(x.entries) for x in tree.levels)
    own = {w: (k + 1) / (n + v + 1) for w, k in c.items()}
    for prefix in ([b"x"], [b"x", b"y"], [b"r", b"p"], [b"q", b"x", b"y"], [b"p", b"q", b"x", b"y"], [b"x", b"y", b"z", b"r"], []):
        total = sum(p * 10 ** (lift(tree, [*prefix, w]) - lift(tree, prefix)) for w, p in [*own.items(), (b"unseen", 1 / (n + v + 1))])
        assert total == pytest.approx(1, abs=1e-6)


def plain_tree(texts, depth, own, total, least=3, frequent=10, gain=1e-7, discount=0.75):
    """A function from a context (tuple) and a word to log10 of its probability, by dictionaries of all contexts."""
    after = [Counter() for _ in range(depth + 1)]
    for t in texts:
        toks = ("<s>", *suffixtree.tokens(t))
        for i in range(1, len(toks)):
            for k in range(1, min(depth, i) + 1):
                after[k][toks[i - k : i], toks[i]] += 1
    usable, found = {()}, {}

    def p(context, w):
        while context and (context not in usable or context not in found):
            context = context[1:]
        if not context:
            return own(w)
        stored, rest = found[context]
        return stored[w] if w in stored else rest * p(context[1:], w)

    known = Counter()
    for t in texts:
        known.update((w,) for w in suffixtree.tokens(t))
    known[("<s>",)] = len(texts)
    for k in range(1, depth + 1):
        by = {}
        for (context, w), n in after[k].items():
            if n >= least and (k == 1 or context in usable):
                by.setdefault(context, {})[w] = n
        fresh = {}
        for context, words in by.items():
            n = known[context]
            below = {w: p(context[1:], w) for w in words}
            here = {w: (c - discount) / n for w, c in words.items()}
            left, left_below = max(1 - sum(here.values()), 1e-12), max(1 - sum(below.values()), 1e-12)
            divergence = sum(x * math.log(x / below[w]) for w, x in here.items()) + left * math.log(left / left_below)
            if n >= frequent and n / total * divergence >= gain:
                fresh[context] = here, left / left_below
        usable |= set(fresh)
        found |= fresh
        longer = {(*context, w): n for context, words in by.items() for w, n in words.items() if n >= frequent and w != b"" and (k == 1 or (*context[1:], w) in level)}
        level = set(longer)
        known.update(longer)
        usable |= level
    return p


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_scores_against_a_plain_tree(spark, depth):
    rng = random.Random(16)
    parts = ["a b c d e f", "a b c d g", "b c d h", "i", "j k", "a b", "Ü x"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(150)] + ["a b c d e f a b c d g"] * 5
    tree, c, n, v = grown(spark, texts, depth=depth)
    own = lambda w: (c[w] + 1) / (n + v + 1)
    p = plain_tree(texts, depth, own, n)
    for t in [*texts[:40], "a b c d e zzz f", "zzz a b c d", "h b c d g e f i j k a b c", ""]:
        toks = ("<s>", *suffixtree.tokens(t))
        want = sum(math.log10(p(toks[max(0, i - depth) : i], toks[i])) - math.log10(own(toks[i])) for i in range(1, len(toks)))
        assert lift(tree, suffixtree.tokens(t)) == pytest.approx(want, abs=1e-9)


def test_what_tasks_do_not_hold_is_looked_up(spark):
    rng = random.Random(17)
    parts = ["a b c d e f", "a b c d g", "b c d h", "i", "j k", "a b", "Ü x", "m n", "m o"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))).strip()) for i in range(200)] + [(5000 + i, f"a b rare{i % 4} c zz{i}") for i in range(24)]
    trains = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in trains for w in suffixtree.tokens(t))
    n, v = sum(c.values()), len(c)
    own = lambda w: (c[w] + 1) / (n + v + 1)
    p = plain_tree(trains, 4, own, n)
    want = {}
    for d, t in rows:
        toks = ("<s>", *suffixtree.tokens(t))
        want[d] = sum(math.log10(p(toks[max(0, i - 4) : i], toks[i])) for i in range(1, len(toks)))
    for options in ({"entry_share": 1.0}, {"entry_share": 0.01, "common_words": 0}):
        got = suffixtree.score(docs(spark, rows), **options).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx(want, abs=1e-6)


def test_words_of_arrow_are_the_tokens():
    texts = [None, "", " ", "a", " A\x0bb\x1cc\x85d\u00a0e\u2003f  ", "\tÄÖ İ x\r\ny\x0c", "".join(map(chr, range(300))), "ende "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got = []
    for part, words, lengths in suffixtree._texts(iter([batch, batch.slice(2, 0), batch.slice(3)])):
        flat = iter(words.to_pylist())
        got += [[next(flat).encode() for _ in range(n)] for n in lengths.tolist()]
        assert len(lengths) == part.num_rows and next(flat, None) is None
    assert got == [suffixtree.tokens(t)[:-1] for t in [*texts, *texts[3:]]]


def test_places_by_open_addressing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 58, 5000))
    index = suffixtree._Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(np.append(keys + 1, -1))[np.append(~np.isin(keys + 1, keys), True)] == -1).all()
    assert (suffixtree._Index(keys[:0]).find(keys) == -1).all()


def test_keys_to_look_up_go_many_to_a_row():
    width, n = 50, 400
    level = suffixtree.Level(np.empty(0, np.int64), np.zeros(width + 1, np.int64), np.zeros(width + 1), np.ones(width + 1, bool))
    tree = suffixtree.Tree([], np.full(width, 9), width, width, [level])
    ids = np.random.default_rng(2).integers(-1, width, (n, 30)).astype(np.int32)
    rare = [["w"] * int((i < 0).sum()) for i in ids]
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([i.tobytes() for i in ids]), pa.array(rare, pa.list_(pa.string()))], names=["row", "ids", "rare"])
    marks = 10, np.full(16, ~np.uint64(0))
    out = pa.Table.from_batches(list(suffixtree._wanted(lambda: tree, lambda: marks, 3)(iter([rows]))))
    contexts = int((ids[:, :-1] >= 0).sum()) + n
    assert sum(len(k) for k in out.column("key").to_pylist() if k) == contexts
    assert out.num_rows <= 3 + 3 + 1


# -- decontamination


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_against_the_table():
    rng = random.Random(9)
    for _ in range(300):
        p, t = [rng.randrange(4) for _ in range(rng.randrange(1, 90))], [rng.randrange(5) for _ in range(rng.randrange(0, 120))]
        masks = {}
        for k, s in enumerate(p):
            masks[s] = masks.get(s, 0) | 1 << k
        assert decontam.myers(masks, len(p), t)[0] == plain_distance(p, t)


@pytest.mark.parametrize("block", [20_000_000, 200])
def test_decontamination(spark, block):
    rng = random.Random(10)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, prose(rng, rng.randrange(9, 40), vocab)) for i in range(12)] + [(50, "Two words"), (51, None), (52, "..."), (None, "an item without id but with enough words to find it")]
    rows = []
    for i in range(120):
        words = prose(rng, 80, vocab).split()
        if i % 2:
            piece = items[i % 12][1].split()
            for _ in range(i % 9):
                piece[rng.randrange(len(piece))] = "edit"
            words[20:20] = piece
        rows.append((i, " ".join(words).upper() if i % 3 else ", ".join(words)))
    rows += EDGE + [(800, "two, WORDS!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("distance", F.lit("clash"))
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(docs(spark, rows), bench, block_chars=block).collect())
    want = Counter()
    for d, t in rows:
        for i, x in items:
            p, w = decontam.tokens(x), decontam.tokens(t)
            k = math.floor(0.2 * len(p)) if len(p) >= 8 else 0
            if p and len(w) < 1000 and (e := plain_distance(p, w)) <= k:
                want[d, i, e] += 1
    assert got == want
    assert decontam.contaminated(docs(spark, []), bench).count() == 0
    assert decontam.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_a_table_of_pieces_finds_what_the_index_finds(spark):
    """Places too, from long and short pieces, for repeated items and texts, and what ``clean`` leaves."""
    rng = random.Random(77)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, prose(rng, rng.choice([1, 3, 7, 9, 30, 150]), vocab)) for i in range(20)] + [(0, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (0, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    rows = [(i, prose(rng, 60, vocab) + " " + (items[i % 20][1] if i % 3 else "") + " " + prose(rng, 9, vocab)) for i in range(60)] + EDGE
    rows += [rows[4], (70, rows[4][1])]
    bench, df = spark.createDataFrame(items, "item_id bigint, text string"), docs(spark, rows)
    for run in (lambda n: decontam.contaminated(df, bench, block_chars=n), lambda n: decontam.clean(df, bench, block_chars=n).select("doc_id", "text")):
        whole, table = (sorted(map(repr, map(tuple, run(n).collect()))) for n in (20_000_000, 10))
        assert whole == table and whole


def test_found_place(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    r = decontam.contaminated(docs(spark, [(1, "x x one two three FOUR six seven eight nine ten y")]), bench).first()
    assert (r.distance, r.first_word, r.n_words) == (1, 2, 9)


# -- toxicity


def toxic_corpus(n=400):
    rng = random.Random(11)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, 30, plain).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(5, rng.choice(["idiotic", "scumbag", f"vermin{rng.choice('abcdefgh')}x"]))
        if rng.random() < (0.8 if toxic else 0.02):  # a group that stands in toxic texts much more often
            words.insert(9, "muslim")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    lab = spark.createDataFrame([*labels, (3000, None), (None, 1)], "doc_id bigint, toxic int")
    df = docs(spark, [*rows, *EDGE])
    fair, plain = toxicity.fit(df, lab), toxicity.fit(df, lab, swap_penalty=0.0)
    again = toxicity.fit(df.repartition(5), lab.repartition(3))
    assert fair.index == again.index and fair.bias == again.bias and (fair.weights == again.weights).all()
    score = fair.scorer()
    assert all((score(t) >= 0.7) == (i % 4 == 0) for i, t in rows)
    assert score("some verminqx there") >= 0.7
    calm = "a neutral line that names a muslim neighbour"
    swapped = calm.replace("muslim", "christian")
    assert abs(score(calm) - score(swapped)) < 0.02 and score(calm) < 0.5
    assert plain.scorer()(calm) - plain.scorer()(swapped) > 2 * abs(score(calm) - score(swapped))
    out = df.select("doc_id", toxicity.score_column(df, fair, F.col("text")).alias("s")).collect()
    assert len(out) == len(rows) + len(EDGE) and all(0 <= r.s <= 1 for r in out)


def test_neutral_mentions_in_the_given_texts(spark):
    """Identity terms planted into the given labelled texts, mostly toxic ones: without the penalty held-out clean texts
    that mention a group are flagged, with it far fewer are and as many toxic texts are caught."""
    sf = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    planted = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(100)) < F.when(F.col("toxic") == 1, 70).otherwise(2), True).otherwise(False)
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(lab, "doc_id").withColumn("planted", planted & (F.pmod(F.col("doc_id"), F.lit(3)) != 1))
    rows = rows.withColumn("text", F.when(F.col("planted"), F.concat(F.lit("Muslim "), "text")).otherwise(F.col("text"))).select("doc_id", "text", "toxic").persist()
    train, rest = rows.where("pmod(doc_id, 3) <> 1"), rows.where("pmod(doc_id, 3) = 1")
    fair, plain = (toxicity.fit(train, train, swap_penalty=p) for p in (10.0, 0.0))
    assert fair.n_swapped > 100 and "muslim" in fair.index
    mention = F.concat(F.lit("Muslim "), "text")

    def flagged(model, text, toxic):
        out = rest.where(F.col("toxic") == toxic).select(toxicity.score_column(rest, model, text).alias("s"))
        return out.agg(F.avg((F.col("s") >= 0.7).cast("int"))).first()[0]

    assert flagged(fair, mention, 0) <= 0.5 * flagged(plain, mention, 0)
    assert flagged(fair, mention, 0) <= flagged(fair, F.col("text"), 0) + 0.01
    assert flagged(fair, mention, 1) >= flagged(plain, F.col("text"), 1) - 0.05


def test_only_given_terms_seed_a_set(spark):
    """A word used as an identity term is used joins its set; function words and sets without a term in the texts do not."""
    rng = random.Random(31)
    rows = []
    for i in range(300):
        who = rng.choice(["muslim", "zorbian", "christian", "table"])
        rows.append((i, f"{prose(rng, 12, ['the', 'of', 'and'])} {'every' if who != 'table' else 'wooden'} {who} {'prays' if who != 'table' else 'leg'} {prose(rng, 9, ['x', 'y', 'the'])}"))
    train = docs(spark, rows).withColumn("y", F.lit(0))
    counts = toxicity._document_counts(train)
    groups = (("muslim", "christian"), ("deaf", "blind"))
    assert toxicity.widened_groups(train, counts, 300, groups, max_share=0.5) == (("muslim", "christian", "zorbian"), ("deaf", "blind"))
    assert toxicity.widened_groups(train, counts, 300, groups[1:], max_share=0.5) == groups[1:]


def test_loss_against_a_plain_sum(spark):
    """Loss and gradient of labelled texts and their swaps, by loops over texts."""
    rng = random.Random(23)
    vocab, groups = ["good", "bad", "muslim", "christian", "jewish", "tree", "muslimah"], (("muslim", "christian", "jewish"),)
    texts = [(rng.randrange(2), prose(rng, rng.randrange(0, 6), vocab)) for _ in range(40)]
    index = {f: i for i, f in enumerate(sorted({f for w in vocab for f in toxicity.word_features(w)}))}
    train = spark.createDataFrame(texts, "y int, text string")
    swaps = toxicity._counterfactuals(train, index, groups)
    n = len(index)
    evaluate = toxicity._objective(toxicity._encode(train, index), swaps, n, 3.0, 0.5)
    theta = np.array([rng.uniform(-1, 1) for _ in range(n + 1)])
    on = lambda words: sorted(index[f] for f in toxicity.features(words))

    def plain(x):
        loss = 0.25 * float(x[:n] @ x[:n])
        for y, t in texts:
            words = toxicity.word_set(t)
            z = x[n] + x[on(words)].sum()
            loss += math.log1p(math.exp(z)) - y * z
            other = [(words - {a}) | {b} for a in groups[0] if a in words for b in groups[0] if b != a]
            loss += sum(3.0 / len(other) * (x[on(words)].sum() - x[on(o)].sum()) ** 2 for o in other)
        return loss

    loss, grad = evaluate(theta)
    assert loss == pytest.approx(plain(theta), rel=1e-6)
    for i in range(n + 1):
        step = np.eye(n + 1)[i] * 1e-5
        assert grad[i] == pytest.approx((plain(theta + step) - plain(theta - step)) / 2e-5, abs=1e-4)
    assert swaps.agg(F.sum("texts")).first()[0] == sum(bool(toxicity.word_set(t) & set(groups[0])) for _, t in texts)


def test_toxicity_edges(spark):
    rows, labels = toxic_corpus(120)
    lab = spark.createDataFrame([*labels, (3, 1), (3, 0), (0, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs(spark, [*rows, rows[0], *EDGE]), lab)
    assert model.scorer()(rows[0][1]) >= 0.7 and model.scorer()(None) == model.scorer()("") < 0.5
    nothing = toxicity.fit(docs(spark, []), lab)
    assert 0 <= nothing.scorer()("x") <= 1
    assert docs(spark, []).select(toxicity.score_column(docs(spark, []), model, F.col("text"))).count() == 0


def test_toxicity_without_labels(spark):
    df = docs(spark, EDGE)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert 0 <= toxicity.fit(df, none).scorer()("x") <= 1
    one = spark.createDataFrame([(901, 0)], "doc_id bigint, toxic int")
    assert toxicity.fit(df, one).scorer()("x") < 0.5
