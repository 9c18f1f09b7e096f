"""Main text and WARC archives."""

import gzip
import io
import random
import re
import time

import pytest

from iotrace.llm import htmltext, warc

PAGE = (
    "<!DOCTYPE html><html><head><title>t &amp; u</title><script>var x='</p>';</script><style>p{}</style></head><body>"
    "<header>Top</header><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><div class=\"ad\">Buy</div>"
    "<article><h1>Title &amp; more</h1><p><b>First  line\n goes on.<br><p>Second &lt;b&gt; caf&eacute; a < b.</p><div class='comments'><p>reader</p></div><form>Sign</form></article>"
    "<aside>Side</aside><footer>&copy; x &middot; y</footer>"
)


def test_article_text():
    assert htmltext.main_text(PAGE) == "Title & more\nFirst line goes on.\nSecond <b> café a < b."
    assert htmltext.main_text(None) == htmltext.main_text("") == ""
    assert htmltext.main_text("<p>cut off <a hre") == "cut off"
    assert htmltext.main_text("plain &amp text") == "plain & text"
    assert htmltext.main_text("<div>" * 5000 + "deep") == "deep"
    assert htmltext.main_text("<article><p>one<p>two</article><p>outside") == "one\ntwo"
    assert htmltext.main_text("<!-- <p>no</p> --><p>yes") == "yes"


BODY = "<p>" + "A long enough article about things. " * 9 + "</p>"
WANT = ("A long enough article about things. " * 9).strip()


@pytest.mark.parametrize("page", [
    f"<article class='post has-sidebar'>{BODY}</article>",
    f"<article class='post-12 comment-closed'>{BODY}<div class='comments'><p>first!</p></div></article>",
    f"<div class='content-with-sidebar'>{BODY}</div>",
    f"<body><form id='aspnet'>{BODY}<input value='x'></form></body>",
    f"<body><div class='page header'>{BODY}</div></body>",
    f"<div class='site-header'>Top</div>{BODY}<div class='cookie-notice'>We use cookies</div>",
    f"<article>{BODY}</article><div id='comments'><article class='comment-body'>{'I say this. ' * 60}</article></div>",
    f"<article>{BODY}</article><div class='ad-slot-300x250'>Buy this</div><div class='cookie-law-info'>We use cookies</div>",
    f"{BODY}<div class='ad-slot-300x250'>Buy this</div><div class='cookie-law-info'>We use cookies</div><div class='newsletter-signup-v2'>Mail</div>",
    f"{BODY}<div id='disqus_thread'>first!</div><ol class='commentlist'><li>second!</ol><div class='post-comments'>third</div>",
    f"<div class='entry-header'>{BODY}</div><div class='main-navbar'>Home</div>",
])
def test_articles_are_not_emptied(page):
    assert htmltext.main_text(page) == WANT


def test_a_teaser_does_not_silence_the_page():
    page = f"<div id='content'>{BODY}</div><article><h3>Teaser</h3></article>"
    assert htmltext.main_text(page) == f"{WANT}\nTeaser"


def test_prose_beside_articles_stays():
    prose = "Words that stand outside of any article. " * 14
    page = f"<div id='content'><p>{prose}</p></div><article>{BODY}</article><div><a href='x'>{'more like this ' * 20}</a></div><div>scrap</div><article>{BODY}</article>"
    assert htmltext.main_text(page) == f"{prose.strip()}\n{WANT}\n{WANT}"


def test_menus_that_differ_are_templates_by_shape(spark):
    """Menus and boxes whose words differ from page to page go by their shape; running text and the longest text stay."""
    rng = random.Random(8)
    word = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        host = "a.org" if i < 25 else f"h{i}.org"
        menu = "".join(f"<li><a href='/{k}'>{word(1)}</a></li>" for k in range(rng.randrange(3, 8)))
        text, short = word(40), word(3)
        rows.append((i, f"http://{host}/{i}", f"<body><div class='zz'><ul>{menu}</ul></div><div class='tagline-{i}'>{word(4)}</div><div class='lead'>{text}</div><p>{short}</p></body>"))
        left = f"{text}\n{short}"
        want[i] = left if i < 25 else "\n".join([*re.findall("'>(w[0-9]+)</a>", rows[-1][2]), re.search("tagline-[0-9]+'>([^<]*)", rows[-1][2])[1], left])
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for lists in (True, False):
        assert {r.page_id: r.text for r in htmltext.extract(df, lists=lists).collect()} == want


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</p>" * 50_000, "<p><div>" + "<b>" * 30_000 + "<p></p>" * 30_000, "<li>" * 50_000, "<a x='>" * 30_000, "</i>" * 50_000])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    htmltext.main_text(page)
    assert time.time() - began < 5


def test_templates_against_a_plain_count(spark):
    rng = random.Random(12)
    word = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    boxes = [f"<div class='b{chr(97 + k)}'><p>{word(6)}</p></div>" for k in range(12)]
    rows, says = [], {}
    for i in range(160):
        host = f"h{i % 4}.org" if i % 3 else "hot.org"
        some = rng.sample(range(12), rng.randrange(0, 5)) if i % 4 else [0]
        text = word(60) if i % 10 else "copied " * 60  # sixteen copies of one article
        main = rng.choice(["article", "main", "div"])
        rows.append((i, f"http://{host}/{i}", f"<body>{boxes[some[0]] if some else ''}<{main}><p>{text}</p>{''.join(boxes[k] for k in some[1:])}</{main}></body>"))
        says[i] = host, some, text.strip()
    apart = {}
    for host, some, text in says.values():
        for k in some:
            apart.setdefault((host, k), set()).add(text)
    plain = lambda b: re.sub("<[^>]*>", "", b)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (200_000, 0):
        got = {r.page_id: (r.text, r.n_templates) for r in htmltext.extract(df, min_pages=7, max_broadcast=most).collect()}
        lost = 0
        for i, (host, some, text) in says.items():
            gone = [k for k in some if len(apart[host, k]) >= 7]
            left = [plain(boxes[k]) for k in some[:1] if k not in gone and "<div><p>" + text in rows[i][2]]
            left += [text, *(plain(boxes[k]) for k in some[1:] if k not in gone)]
            assert got[i] == ("\n".join(left), len(gone)), (rows[i], gone)
            lost += len(gone)
        assert lost > 100


def test_templates_are_counted_per_host(spark):
    frame = "<div><b>Site motto</b></div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{frame}<section><p>unique text {i}</p></section></body>") for i in range(30)]
    rows += [(100 + i, f"http://b.org/{i}", f"<body>{frame if i == 0 else ''}<p>other {i}</p></body>") for i in range(30)]
    rows += [(200, None, None), (201, "x", ""), (200, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", htmltext.F.lit("clash"))
    for most in (200_000, 0):
        got = {(r.page_id, r.url): r.text for r in htmltext.extract(df, max_broadcast=most).collect()}
        assert got[3, "http://a.org/3"] == "unique text 3"
        assert got[100, "http://b.org/0"] == "Site motto\nother 0"
        assert got[200, None] == "" and got[201, "x"] == ""
    assert htmltext.extract(df, max_broadcast=0).count() == 63
    assert htmltext.extract(df.limit(0)).count() == 0


def test_copied_articles_are_no_template(spark):
    page = "<body><div class='x'>motto</div><article><p>a passage that copies share</p></article></body>"
    df = spark.createDataFrame([(i, "http://a.org/", page) for i in range(40)], "page_id bigint, url string, html string")
    assert {r.text for r in htmltext.extract(df).collect()} == {"a passage that copies share"}


def test_archives_round_trip(spark):
    rows = [(1, "u1", "same"), (5, "u5", "same"), (3, None, "same"), (7, "u7", "é" * 50), (8, "u8", None), (9, "u9", ""), (None, "n", "same"), (4, "a\r\nb", "x\x00y\x1f\x8b\x08"), (5, "u5", "same")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload_digest", warc.F.lit("clash"))
    for split in (8 << 20, 64):
        got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(df, split_bytes=split).collect())
        assert got == sorted([
            (1, 4, "revisit", 5), (5, 4, "response", None), (5, 4, "response", None), (3, 4, "revisit", 5), (7, 100, "response", None),
            (8, 0, "revisit", 9), (9, 0, "response", None), (0, 4, "revisit", 5), (4, 7, "response", None),
        ])
    assert warc.archive(df.limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.roles(df, min_bytes=4).collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_files_are_plain_gzip_members(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", "text " * i) for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    warc.write(warc.roles(df), str(tmp_path / "w"))
    body = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")))
    assert body.count(b"WARC/1.1\r\n") == 20 and b"text text" in body
    back = warc.read(spark, str(tmp_path / "w"), payload=True).collect()
    assert {bytes(r.payload).decode() for r in back} == {"text " * i for i in range(20)}


def test_ranges_own_the_records_that_start_in_them():
    members = [gzip.compress(warc.record(i, None, "z" * 300 * i, 300 * i, "D", "response", None), mtime=0) for i in range(12)]
    fake = gzip.compress(b"no archive", mtime=0)
    data = b"junk" + members[0] + fake + b"\x1f\x8b\x08\x00" + b"".join(members[1:])
    whole = [d for _, d in warc.scan(io.BytesIO(data), len(data), 0, len(data))]
    assert len(whole) == 12
    for size in (1, 7, 50, 333):
        parts = [d for a in range(0, len(data), size) for _, d in warc.scan(io.BytesIO(data), len(data), a, min(len(data), a + size))]
        assert parts == whole


def test_long_records_end_in_zero(monkeypatch):
    empty = gzip.compress(b"", mtime=0)
    assert empty[-1] == 0 and gzip.decompress(gzip.compress(b"x", mtime=0) + empty) == b"x"


def test_responses_over_16_mib_round_trip(spark, tmp_path):
    long = "a long page \x00 \x1f\x8b\x08 " * (1 << 20)
    rows = [(1, "u1", "before"), (2, "u2", long), (3, "u3", "between"), (4, "u4", long + "!"), (5, "u5", long), (6, "u6", "after")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write(warc.roles(df).coalesce(1), str(tmp_path / "w"))
    want = {(1, "before"), (2, None), (3, "between"), (4, long + "!"), (5, long), (6, "after")}
    for split in (8 << 20, 1 << 15, 1000):
        got = warc.read(spark, str(tmp_path / "w"), split_bytes=split, payload=True).collect()
        assert len(got) == 6 and {(r.page_id, r.payload and bytes(r.payload).decode()) for r in got} == want


def test_members_without_a_version_line_are_no_records():
    good = gzip.compress(warc.record(1, None, "x", 1, "D", "response", None), mtime=0)
    data = gzip.compress(b"", mtime=0) + gzip.compress(b"WARC", mtime=0) + good + gzip.compress(b"", mtime=0)
    assert [at for at, _ in warc.scan(io.BytesIO(data), len(data), 0, len(data))] == [data.index(good)]
