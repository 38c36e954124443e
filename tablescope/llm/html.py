"""Operator 3: main text of web pages by consensus host paths.

1. Every page is cut into tags and text once. Its containers are scored by the text of the blocks that they hold, less what
   stands in links; the best ones vote, with their share of the page's score, for their *path*: tags and classes from the root
   down, with digits generalised.
2. Spark adds up the votes per host and path; the ``PATHS`` paths of most votes win. Votes are whole numbers, added map-side
   first, so a host with a third of all pages is no hot group, and ties go to the first path in code point order.
3. Every page is cut again and gives the text of the containers on its host's best path that it has; a page without any gives
   its own best container.

Inside a container, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden elements and reader
comments are left out, by element, role and names of class and id. A name counts only as a whole: all its words speak of such
a part or of layout (``cookie-notice``, ``related-posts``), or its last word is the name of such a part (``election-comments``);
``share-price``, ``news-alert`` and ``related-work`` are text. Character references are decoded, white space inside a block
becomes one blank, and blocks are joined by line feeds in page order; nothing else is dropped or capped.

Scripts, styles, titles and text areas end at their end tag alone, whatever stands before ``>``. Pictures, formulas, players and
lists of choices end at the end tag of their own depth; one without an end tag ends where the next block begins or ends.

Null pages and pages without text give an empty text. Null URLs form a host of their own. Repeated rows give equal texts. An
empty table gives an empty result. Columns beside the named ones are never read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.scratch import Scratch

PATHS = 3
VOTERS = 3  # containers of a page that vote
BROADCAST_BYTES = 32_000_000

# Kinds of elements and words of classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
EMBEDDED = frozenset("svg math object select canvas audio video template".split())
FOREIGN = frozenset("svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav "
    "ol p pre section summary table tbody tfoot thead tr ul caption center".split()
)
CONTAINERS = frozenset("article body center dd div main section table td ul ol blockquote html".split())
NOT_TEXT = frozenset("nav footer aside form button head dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors comment comments commentlist disqus respond reply replies cookie cookies consent "
    "gdpr popup modal overlay newsletter subscribe subscription signup share sharing social related recommended promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs pagination pager notice notices alert banner toolbar login search skip".split()
)
PERHAPS_NOT = frozenset("header footer sidebar widget widgets rail masthead topbar bottom".split())
LAYOUT = frozenset(
    "area article articles bar block blocks blog body box boxes btn button buttons card cards column container content count desktop entries entry feed fixed floating "
    "form frame global google group heading holder icon icons inline inner item items large layout left link links list main message messages mobile module modules outer "
    "page panel placeholder post posts primary reader readers region right row secondary section side site slot small sticky stories story strip text thread title "
    "top unit user users view wrap wrapper zone".split()
)
HEADS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsors comments commentlist disqus popup newsletter nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager toolbar".split()
)
SURELY = frozenset("article content main body post entry story text".split())
CLOSES_P = BLOCKS - {"html", "body"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*+)>?",
    re.S,
)
SPELT_DEPTH = 400  # elements open above one whose path is kept as text
_ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


class _Node:
    __slots__ = ("tag", "path", "out", "score", "link", "order", "above", "near", "within")

    def __init__(self, tag: str, path: str, out: bool, link: bool, order: int, above: _Node | None = None):
        self.tag, self.path, self.out, self.link, self.order, self.score = tag, path, out, link, order, 0.0
        self.above, self.within = above, None
        near = above.near if above else ()
        self.near: tuple[_Node, ...] = (self, *near[:1]) if tag in CONTAINERS or order == 0 else near  # the two nearest containers

    def is_within(self, path: str) -> bool:
        """Whether it or an element around it has this path; one walk of a page asks for one path."""
        asked, node = [], self
        while node is not None and node.within is None and node.path != path:
            asked.append(node)
            node = node.above
        found = node is not None and (node.path == path or bool(node.within))
        for n in asked:
            n.within = found
        return found


def _path(above: str, step: str, depth: int) -> str:
    """The path as text; of deeper elements a digest, so that paths do not grow with the square of the depth."""
    path = f"{above}>{step}" if above else step
    return path if depth < SPELT_DEPTH else "#" + blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _named_part(names: Iterable[str]) -> tuple[bool, bool, bool]:
    """Of names of classes and ids: (one stands for a part that is no main text, one for a part that may be none, one for main text)."""
    never = perhaps = surely = False
    for name in names:
        words = [w.lower() for w in _WORD.findall(name)]
        # "with-sidebar" and "no-ads" speak of what stands elsewhere.
        if not words or len(words) > 1 and words[0] in ("with", "has", "no", "without", "is"):
            continue
        surely = surely or not SURELY.isdisjoint(words)
        parts = [w for w in words if w in NOT_MAIN or w in PERHAPS_NOT]
        if not parts:
            continue
        whole = all(w in NOT_MAIN or w in PERHAPS_NOT or w in LAYOUT or len(w) < 3 for w in words)
        never = never or whole and not NOT_MAIN.isdisjoint(parts) or words[-1] in HEADS
        perhaps = perhaps or whole
    return never, perhaps, surely


def _label(tag: str, rest: str) -> tuple[str, bool]:
    """The generalised step of a path, and whether the element is left out."""
    out = tag in NOT_TEXT
    if not rest or "=" not in rest and "hidden" not in rest:
        return tag, out or tag == "header"
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}
    classes = found.get("class", "")
    step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes.split()})])
    role = found.get("role", "").lower()
    if tag in ("html", "body"):
        return step, False
    never, perhaps, surely = _named_part(f"{classes} {found.get('id', '')}".split())
    surely = surely or tag in ("article", "main") or role in ("main", "article")
    out = out or role in ROLES or ("hidden" in found and found["hidden"] in ("", "hidden")) or found.get("aria-hidden", "").lower() == "true"
    out = out or "style" in found and _UNSEEN.search(found["style"]) is not None or tag == "label" and "for" in found
    out = out or never or (perhaps or tag == "header") and not surely
    return step, out


def _cut(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, "") and ("open" or "close", tag, rest of the tag); the contents of raw elements are left out."""
    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            if at < len(page):
                yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        tag, rest = name.lower(), (m["rest"] if m["name"] else m["rest2"]) or ""
        if m["end"] or m["end2"]:
            yield "close", tag, ""
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in FOREIGN and rest.endswith("/"):
            continue
        yield "open", tag, rest


def _events(page: str) -> list[tuple[str, str, str]]:
    """What ``_cut`` gives, less all that stands in embedded elements."""
    events = list(_cut(page))
    waiting: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, (kind, tag, _) in enumerate(events):
        if kind != "text" and tag in EMBEDDED:
            if kind == "open":
                waiting.setdefault(tag, []).append(i)
            elif waiting.get(tag):
                ends[waiting[tag].pop()] = i
    if not waiting:
        return events
    kept, i, n = [], 0, len(events)
    while i < n:
        kind, tag, _ = event = events[i]
        if kind == "text" or tag not in EMBEDDED:
            kept.append(event)
        elif kind == "open" and i in ends:
            i = ends[i]
        elif kind == "open":
            while i + 1 < n and (events[i + 1][0] == "text" or events[i + 1][1] not in BLOCKS):
                i += 1
        i += 1
    return kept


def _walk(page: str) -> Iterator[tuple[list[_Node], str | None]]:
    """The open elements and a piece of text in them, or None where a block begins or ends."""
    stack, order, opened = [_Node("", "", False, False, 0)], 0, Counter()
    for kind, tag, rest in _events(page):
        if kind == "text":
            yield stack, tag
        elif kind == "open":
            if tag in BLOCKS:
                yield stack, None
            elif tag == "br":
                yield stack, " "
            elif tag in ("td", "th"):
                yield stack, " "
            if tag in VOID:
                continue
            # Ends that may be left out.
            shut = ("p",) if tag in CLOSES_P else ()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                shut = ("p", tag) if tag not in ("dt", "dd") else ("p", "dt", "dd")
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in shut) else ():
                t = stack[i].tag
                if t in shut:
                    for n in stack[i:]:
                        opened[n.tag] -= 1
                    del stack[i:]
                    break
                if t in BLOCKS or t in ("td", "th"):
                    break
            top = stack[-1]
            step, out = _label(tag, rest)
            if tag == "header" and out and opened["article"] + opened["main"] > 0:
                out = False  # the head of an article holds its title
            order += 1
            opened[tag] += 1
            stack.append(_Node(tag, _path(top.path, step, len(stack)), top.out or out, top.link or tag == "a", order, top))
        elif opened[tag] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in BLOCKS or tag in ("td", "th"):
                        yield stack, None if tag in BLOCKS else " "
                    for n in stack[i:]:
                        opened[n.tag] -= 1
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "article", "body", "html") and tag not in ("body", "html", "article", "main", "section", "div", "table"):
                    break
    yield stack, None


def votes(page: str | None) -> list[tuple[str, int]]:
    """Paths of the page's best containers and their shares of its score, in thousandths."""
    found: dict[int, _Node] = {}
    size, plain, held = 0, 0, None
    for stack, text in _walk(page or ""):
        if text is None:
            if size and held is not None:
                # Longer blocks are surer prose; text in links is not.
                gain = plain - 2 * (size - plain)
                if gain > 0:
                    for n, share in zip(held.near, (1.0, 0.4)):
                        n.score += share * gain
                        found[n.order] = n
            size, plain, held = 0, 0, None
        elif not stack[-1].out:
            n = len("".join(text.split()))
            if n:
                size += n
                plain += 0 if stack[-1].link else n
                held = held or stack[-1]
    total = sum(n.score for n in found.values())
    best = sorted(found.values(), key=lambda n: (-n.score, n.order))[:VOTERS]
    return [(n.path, int(1000 * n.score / total)) for n in best if total > 0]


def main_text(page: str | None, paths: list[str]) -> str:
    """Text of the containers on the first of ``paths`` that the page has, else of its best container."""
    page = page or ""
    present = _present(page) if len(paths) > 1 else set(paths)
    wanted = next((p for p in paths if p in present), None)
    blocks = _blocks(page, wanted) if wanted is not None else []
    if not blocks:
        own = votes(page)
        blocks = _blocks(page, own[0][0]) if own else _blocks(page, "")
    return "\n".join(blocks)


def _present(page: str) -> set[str]:
    """Paths of all elements around text."""
    seen: set[int] = set()
    out: set[str] = set()
    for stack, text in _walk(page):
        node = stack[-1] if text is not None and not stack[-1].out else None
        while node is not None and node.order not in seen:
            seen.add(node.order)
            out.add(node.path)
            node = node.above
    return out


def _blocks(page: str, path: str) -> list[str]:
    out, held = [], []
    for stack, text in _walk(page):
        if text is None:
            if held:
                block = " ".join(entities.unescape("".join(held)).split())
                if block:
                    out.append(block)
                held = []
        elif not stack[-1].out and (path == "" or stack[-1].is_within(path)):
            held.append(text)
    return out


def host_of(url: str | None) -> str:
    """Lower-case host without ``www.``; empty if there is none."""
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:
        host = ""
    return host.removeprefix("www.")


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, paths``: the paths of most votes of every host, the best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added: dict[tuple[str, str], int] = {}
            for u, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = host_of(u)
                for path, n in votes(page):
                    added[host, path] = added.get((host, path), 0) + n
            keys = list(added)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(added.values()), pa.int64())],
                names=["host", "path", "n"],
            )

    narrow = pages.select(F.col(f"`{url}`").cast("string"), F.col(f"`{html}`").cast("string"))
    summed = narrow.mapInArrow(run, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path"))).filter(F.col("place") <= PATHS)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    winners = scratch.write(winning_paths(pages, url, html), "winners")
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", "")) + 64)).first()[0] or 0
    ident = pages.schema[page_id].dataType.simpleString()
    base = pages.select(F.col(f"`{page_id}`").alias("p"), F.col(f"`{url}`").cast("string").alias("u"), F.col(f"`{html}`").cast("string").alias("t"))

    @F.pandas_udf("string")
    def host(urls):
        return urls.map(host_of, na_action=None)

    right = winners.select(F.col("host").alias("g"), "paths")
    # The table of hosts is broadcast only while it is small; beyond that, pages meet it in a join that can be split.
    joined = base.withColumn("host", host(F.col("u"))).join(F.broadcast(right) if size <= BROADCAST_BYTES else right, F.col("host") == F.col("g"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                texts = [main_text(t, p or []) for t, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("p", "u", "t", "paths").mapInArrow(run, f"page_id {ident}, url string, text string, n_chars long")
