"""Main text of web pages: site templates found by counting element subtrees per host, then removed."""

from __future__ import annotations

import functools
import hashlib
import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.storage import materialize

#: Fixed values of HTML and of common page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table article section div main body".split())
FURNITURE = frozenset(
    "head script style noscript template svg math nav footer aside button select input textarea iframe object "
    "embed dialog menu canvas audio video map datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: What classes and ids call the frame of a page, and what they call other parts that are no article.
FRAME = frozenset("nav navbar navigation menu header masthead footer sidebar aside banner notice toolbar skip".split())
EXTRA = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe signup login comment comments respond discussion disqus breadcrumb breadcrumbs pagination pager share sharing social "
    "related widget".split()
)
#: Parts of a name that tell a state of something else, and that call the article itself.
STATES = frozenset("has with without no not is closed open enabled disabled active hidden visible hide show count".split())
ARTICLE = frozenset("article post entry story".split())
MAIN = frozenset(("article", "main"))
#: Elements that may be deleted as template inside an article: boxes, not the paragraphs that a text is made of.
BOX = frozenset("div section ul ol dl table figure details".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--|<!|<\?""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-zA-Z]+")
_DIGITS = re.compile(r"[0-9]+")
#: Characters that stand together in running text.
RUNNING = 100
#: Elements whose text no browser shows.
UNSHOWN = frozenset("head script style noscript template".split())


@dataclass
class Node:
    """An element: its name, the attributes that matter, and children that are elements or strings.

    ``size`` counts the characters of its text without white space and without what ``FURNITURE`` holds, ``links``
    those of them in links, ``longest`` the most that stand together; ``article`` tells whether it is or holds an
    article or main element with text. ``digest`` is of name, class, id and text of the subtree, ``shape`` of its
    names, classes and ids alone, equal neighbours taken once.
    """

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    digest: int = 0
    shape: int = 0
    size: int = 0
    links: int = 0
    longest: int = 0
    article: bool = False


class _Open:
    """The elements that are open, with the places of each tag, so that no tag has to be searched for."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, k: int) -> None:
        """Close all from place ``k`` on."""
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()

    def close(self, tags: Iterable[str], fence: Iterable[str]) -> None:
        """Close the innermost of ``tags`` unless an element of ``fence`` was opened after it."""
        k = self.last(tags)
        if k and k > self.last(fence):
            self.cut(k)


def parse(page: str | None) -> Node:
    """A tree of the page; end tags that open nothing are skipped, elements left open end with their parent.

    Takes time in proportion to the page, whatever is nested or left open in it.
    """
    text = page or ""
    root, at, n = Node("#root"), 0, len(text)
    opened = _Open(root)

    def say(s: str) -> None:
        if s:
            opened.stack[-1].children.append(htmllib.unescape(s))

    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            say(text[at:])
            break
        m = _TAG.match(text, lt) or _LOOSE.match(text, lt)
        if not m:
            if text[lt + 1 : lt + 2].isalpha() or text[lt + 1 : lt + 2] == "/":
                say(text[at:lt])  # a tag cut off by the end of the page
                break
            say(text[at : lt + 1])
            at = lt + 1
            continue
        say(text[at:lt])
        if m[0] == "<!--":
            end = text.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if m[0] in ("<!", "<?"):
            end = text.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag, at = m[2].lower(), m.end()
        if m[1]:
            k = opened.last((tag,))
            if k:
                opened.cut(k)
            elif tag == "p":
                opened.stack[-1].children.append(Node("p"))
            continue
        if tag in CLOSES_P:
            opened.close(("p",), FENCE)
        if tag in CLOSES_SAME:
            opened.close(CLOSES_SAME[tag], FENCE - {tag})
        attrs = {k.lower(): htmllib.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(m[3])} if m[3].strip(" /") else {}
        node = Node(tag, {k: attrs[k] for k in ("id", "class", "role", "hidden", "aria-hidden", "style") if k in attrs})
        opened.stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}", re.I).search(text, at)
            node.children.append(text[at : end.start() if end else n])
            at = n if not end else (text.find(">", end.end()) + 1 or n)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            opened.push(node)
    return root


def _says(part: str, names: frozenset[str]) -> bool:
    """Whether a part of a name is one of ``names`` or, as in commentlist, begins with one of five letters or more."""
    return part in names or any(part[:n] in names for n in range(5, len(part)))


@functools.cache
def _names_furniture(token: str) -> bool:
    parts = _NAME.findall(token)
    if not STATES.isdisjoint(parts):
        return False
    return any(_says(p, EXTRA) for p in parts) or (ARTICLE.isdisjoint(parts) and any(_says(p, FRAME) for p in parts))


def named_furniture(node: Node) -> bool:
    """Whether a class or the id says so.

    One of its parts is, or begins with, a name of page furniture, and none tells a state of something else
    (has-sidebar, comment-closed). Header, footer and the like of an article or post are its own.
    """
    return any(_names_furniture(token) for key in ("class", "id") for token in node.attrs.get(key, "").lower().split())


def _declared(node: Node, in_main: bool) -> bool:
    """Whether tag, role, style or name call an element no part of an article; a header only outside articles."""
    if node.tag == "form" or (node.tag == "header" and not in_main):
        return True
    a = node.attrs
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    return node.tag not in ("html", "body", "main") and named_furniture(node)


def _walk(root: Node) -> Iterator[tuple[Node, bool, bool]]:
    """(element, whether entering) in page order, without recursion; with whether it lies in an article or main."""
    stack: list[tuple[Node, bool, bool]] = [(root, True, False)]
    while stack:
        node, enter, main = stack.pop()
        yield node, enter, main
        if enter:
            inside = main or node.tag in MAIN
            stack.append((node, False, main))
            stack += [(c, True, inside) for c in reversed(node.children) if isinstance(c, Node)]


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\1".join(parts), digest_size=8).digest(), "big", signed=True)


def measure(root: Node) -> None:
    """Give every element its digest and shape, its sizes, and whether it holds an article."""
    for node, enter, _ in _walk(root):
        if enter:
            continue
        name = f"{node.tag}\0{node.attrs.get('class', '')}\0{node.attrs.get('id', '')}"
        whole, shape = [name.encode("utf-8", "surrogatepass")], [_DIGITS.sub("0", name).encode("utf-8", "surrogatepass")]
        for c in node.children:
            if isinstance(c, Node):
                whole.append(c.digest.to_bytes(8, "big", signed=True))
                part = c.shape.to_bytes(8, "big", signed=True)
                if c.tag not in FURNITURE:
                    node.size, node.links, node.longest = node.size + c.size, node.links + c.links, max(node.longest, c.longest)
                    node.article |= c.article
            else:
                words = c.split()
                whole.append(" ".join(words).encode("utf-8", "surrogatepass"))
                n = sum(map(len, words))
                node.size, node.longest, part = node.size + n, max(node.longest, n), b"text" if n else b""
            if part and part != shape[-1]:
                shape.append(part)
        node.links = node.size if node.tag == "a" else node.links
        node.article |= node.tag in MAIN and node.size > 0 and not named_furniture(node)
        node.digest, node.shape = _hash(*whole), _hash(b"shape", *shape)


def is_furniture(node: Node, in_main: bool, page: Node) -> bool:
    """Whether an element is left out: always by some tags, else if declared so and neither the article nor around it.

    An element that holds an article stays, and on a page without one an element that holds more than half of the text.
    """
    if node.tag in FURNITURE:
        return True
    return _declared(node, in_main) and not node.article and (page.article or 2 * node.size <= page.size)


def _may_be_template(node: Node, in_main: bool, root: Node) -> bool:
    """Whether a subtree that recurs is deleted: not if it holds an article or more than half of the page's text.

    Inside articles only boxes go: what an article says in its own paragraphs is its text even where other pages copy it.
    """
    fit = node.tag in BOX if in_main else node.tag not in ("#root", "html", "body", "head")
    return fit and not node.article and 2 * node.size <= root.size


def _may_be_shape(node: Node, in_main: bool, root: Node) -> bool:
    """Whether also a subtree whose shape alone recurs is: most of its text is links, or, outside articles and under a
    name of its own, it has no running text and not the longest of the page."""
    linked = node.links >= 2 and 2 * node.links >= node.size
    if in_main:
        return linked
    named = "class" in node.attrs or "id" in node.attrs or node.tag in FURNITURE
    return linked or (named and node.longest < RUNNING and node.longest < root.longest)


def template_candidates(root: Node) -> tuple[set[int], int]:
    """Digests and shapes of the elements with text that may be template, and what tells this page from others: its longest text."""
    out, longest = set(), ""
    for node, enter, main in _walk(root):
        if not enter:
            continue
        if node.tag not in FURNITURE:
            longest = max([longest, *(c for c in node.children if isinstance(c, str))], key=len)
        if _may_be_template(node, main, root) and any(not isinstance(c, str) or c.strip() for c in node.children):
            out.add(node.digest)
            if _may_be_shape(node, main, root):
                out.add(node.shape)
    return out, _hash(" ".join(longest.split()).encode("utf-8", "surrogatepass"))


def blocks(root: Node, templates: frozenset[int], removed: list[int] | None = None, lists: bool = True) -> Iterator[tuple[str, bool, int]]:
    """(text, whether in an article, characters in links) of each block left, white space made one space, without empty blocks.

    ``removed`` gets the digest of each template deleted. Without ``lists`` only templates and what no browser shows
    as text are left out.
    """
    buf: list[str] = []
    was_main, linked = False, 0

    def flush() -> Iterator[tuple[str, bool, int]]:
        nonlocal linked
        text, n = " ".join("".join(buf).split()), linked
        buf.clear()
        linked = 0
        if text:
            yield text, was_main, n

    stack: list = [(root, False, False)]
    while stack:
        item, main, in_link = stack.pop()
        if isinstance(item, str):
            was_main = main
            buf.append(item)
            linked += sum(map(len, item.split())) if in_link else 0
        elif isinstance(item, Node):
            template = bool(templates) and _may_be_template(item, main, root) and (item.digest in templates or (item.shape in templates and _may_be_shape(item, main, root)))
            if template and removed is not None:
                removed.append(item.digest)
            if template or (is_furniture(item, main, root) if lists else item.tag in UNSHOWN):
                if item.tag in BLOCK:
                    yield from flush()
                continue
            inside = main or item.tag in MAIN
            if item.tag in BLOCK:
                yield from flush()
                stack.append((None, main, False))
            stack += [(c, inside, in_link or item.tag == "a") for c in reversed(item.children)]
        else:
            yield from flush()
    yield from flush()


def main_text(page: str | None, templates: frozenset[int] = frozenset(), article_share: float = 1 / 3, removed: list[int] | None = None, lists: bool = True) -> str:
    """The blocks of the page in page order that are left.

    Where articles hold ``article_share`` of what is left, blocks outside them stay only if they are running text:
    ``RUNNING`` characters or more, less than a third of them in links.
    """
    root = parse(page)
    measure(root)
    found = list(blocks(root, templates, removed, lists))
    inside = sum(len(t) for t, main, _ in found if main)
    if lists and inside and inside >= article_share * sum(len(t) for t, _, _ in found):
        found = [(t, main, n) for t, main, n in found if main or (len(t) >= RUNNING and 3 * n < len(t))]
    return "\n".join(t for t, _, _ in found)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _candidate_rows(rows: DataFrame) -> DataFrame:
    """``(host, page, digest, own)``: each page's template candidates, with a key of the page and what tells it apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            host, page, digest, own = [], [], [], []
            for h, key, html in zip(pdf["host"], pdf["page"], pdf["html"], strict=True):
                root = parse(html)
                measure(root)
                found, name = template_candidates(root)
                digest += found
                host += [h] * len(found)
                page += [key] * len(found)
                own += [name] * len(found)
            at = {"page": page, "digest": digest, "own": own}
            yield pd.DataFrame({"host": pd.Series(host, dtype=object), **{k: pd.Series(v, dtype="int64") for k, v in at.items()}})

    return rows.select("host", "page", "html").mapInPandas(run, "host string, page bigint, digest bigint, own bigint")


def site_templates(candidates: DataFrame, min_pages: int = 10) -> DataFrame:
    """``(host, digest)``: subtrees, and shapes of subtrees, that recur on at least ``min_pages`` pages of a host, copies of a page being one.

    Pages are told apart by their longest text, so that an article which many pages copy is no template of theirs.
    Hosts of fewer pages have no templates. Counts are combined before each shuffle, so a host with a third of all
    pages is no hot key.
    """
    apart = candidates.select("host", "digest", "own").distinct()
    return apart.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "digest")


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 10,
    max_broadcast: int = 200_000,
    lists: bool = True,
) -> DataFrame:
    """``(page_id, url, text, n_templates)`` for every page, from its whole html.

    Goes over the pages twice: once to count subtrees per host, once to delete those that recur together with
    scripts, menus and other furniture and to return the text; n_templates is how many the page lost. Templates
    reach the pages by broadcast if they are at most ``max_broadcast`` in number, which is counted; beyond that
    each page gets only its own, by joins on host and subtree and on host and page. Without ``lists`` no tag or class
    is taken for furniture, and templates alone clean the text. A null html has an empty text;
    pages without a host count as one host; repeated rows are all returned.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("page", F.xxhash64(F.coalesce("html", F.lit(""))))
    candidates = materialize(_candidate_rows(rows), "subtrees")
    found = materialize(site_templates(candidates, min_pages), "templates")

    @F.pandas_udf("text string, n_templates bigint")
    def text(html: pd.Series, digests: pd.Series) -> pd.DataFrame:
        out = []
        for page, known in zip(html, digests, strict=True):
            removed: list[int] = []
            out.append((main_text(page, frozenset(known) if known is not None else frozenset(), removed=removed, lists=lists), len(removed)))
        return pd.DataFrame(out, columns=["text", "n_templates"])

    if found.count() <= max_broadcast:
        joined = rows.join(F.broadcast(found.groupBy("host").agg(F.collect_set("digest").alias("digests"))), "host", "left")
    else:
        hits = candidates.join(found, ["host", "digest"]).groupBy("host", "page").agg(F.collect_set("digest").alias("digests"))
        joined = rows.join(hits, ["host", "page"], "left")
    return joined.select("page_id", "url", text("html", "digests").alias("x")).select("page_id", "url", "x.text", "x.n_templates")
