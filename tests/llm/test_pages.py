"""Operators 3 and 4."""

import glob
import hashlib
import time
from html.parser import HTMLParser

import pytest

from tablescope.llm.html import extract, host_of, main_text, votes
from tablescope.llm.scratch import Scratch
from tablescope.llm.warc import read_warc, write_warc

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="home"><header><h1>Site</h1></header>'
    '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, many of them, all day long.</div><!-- <p>no</p> -->'
    '<main><div class="post-12 with-sidebar"><h2>A &amp; B</h2><p>First  <b>bold</b>\n text&nbsp;here, long enough to count.<br>And more<p>Second one &lt;tag&gt; of the text.'
    '<ul><li>Item one<li>Item two</ul><form><input><button>Send</button></form><div class="ad">Buy now</div><div id="comments"><p>Nice post, I liked it very much indeed.</p></div>'
    '</div></main><aside class="sidebar"><p>Other things that you may like to read today.</p></aside><footer>&copy; us</footer></body></html>'
)
TEXT = "A & B\nFirst bold text here, long enough to count. And more\nSecond one <tag> of the text.\nItem one\nItem two"


def test_main_text_of_a_page():
    best = votes(PAGE)[0][0]
    assert best == "html>body.home>main>div.post-#.with-sidebar"
    assert main_text(PAGE, [best]) == TEXT
    assert main_text(PAGE, []) == TEXT
    assert main_text(PAGE, ["html>body>div.gone"]) == TEXT


@pytest.mark.parametrize("page", [None, "", "<", "<div", "<p", "<!--", "<script>x", "</p></div>", "<a href='x", "<p></p>", "&"])
def test_broken_pages(page):
    assert main_text(page, []) in ("", "<", "&")


def test_plain_text_and_deep_nesting():
    assert main_text("just  words\nhere", []) == "just words here"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000, []) == "deep"
    assert main_text("<article><p>" + "word " * 50_000 + "</p></article>", []) == ("word " * 50_000).strip()


def test_hosts():
    assert [host_of(u) for u in (None, "", "http://WWW.A.org:80/x", "https://m.a.org", "nonsense", "http://[bad")] == ["", "", "a.org", "m.a.org", "", ""]


def test_the_host_decides(spark, scratch):
    shell = '<body><div class="teaser"><p>{}</p></div><div class="story"><p>{}</p></div></body>'
    rows = [(i, "http://a.org/x", shell.format("short words", "a much longer story with many words " * 3)) for i in range(5)]
    rows += [(9, "http://a.org/y", shell.format("for once the teaser is the longest of all the texts " * 5, "a short story")), (10, None, None), (11, None, ""), (11, None, "")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n_chars int").repartition(3)
    got = sorted(extract(table, scratch).collect())
    assert [r.page_id for r in got] == [0, 1, 2, 3, 4, 9, 10, 11, 11]
    assert got[5].text == "a short story" and got[5].n_chars == 13
    assert [r.text for r in got[6:]] == ["", "", ""]
    assert extract(table.limit(0), scratch).count() == 0


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_come_back(spark, scratch):
    big, other = "é" * 60, "x" * 100
    rows = [(1, "http://a/1", "short"), (2, "http://a/2", "short"), (3, None, big), (4, "http://a/ü\n4", big), (5, "u", big), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", other), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb")]
    folder, manifest = write_warc(_pages(spark, rows).repartition(4), scratch, bytes_per_file=600, rows_per_shard=4)
    assert manifest.count() > 3
    got = read_warc(folder, manifest, with_payload=True).collect()
    assert sorted((r.page_id or 0) for r in got) == sorted((p or 0) for p, _, _ in rows)
    want = {(i, "response", None) for i in (1, 2, 3, 6, 7, 8, 9)} | {(4, "revisit", 3), (5, "revisit", 3), (8, "revisit", 8), (None, "revisit", 8)}
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == want
    html = {p: (h or "").encode() for p, _, h in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == html[r.page_id]


def test_archives_do_not_depend_on_partitions(spark):
    rows = [(i, f"http://a/{i}", f"page {i % 7} " * 30) for i in range(60)]
    seen = []
    for n in (1, 5):
        folder, _ = write_warc(_pages(spark, rows).repartition(n), Scratch(spark, "warc"), bytes_per_file=900, rows_per_shard=16)
        path = folder.removeprefix("file:").replace("//", "/")
        seen.append({f.rsplit("/", 1)[1]: open(f, "rb").read() for f in glob.glob(f"{path}/*.warc.gz")})
    assert seen[0] == seen[1] and len(seen[0]) > 4


def test_no_pages(spark, scratch):
    folder, manifest = write_warc(_pages(spark, []), scratch)
    assert read_warc(folder, manifest).count() == 0


def test_end_tags_and_blocks_beyond_any_depth():
    nested = "<div id=wrap><article><p>Before it all, a first sentence.</p>" + "<div>" * 500 + "deep" + "</div>" * 500 + "<p>And the rest.</p></article></div>"
    assert main_text(f"<html><body>{nested}<p>Foot</p></body></html>", ["html>body>div>article"]).split("\n") == ["Before it all, a first sentence.", "deep", "And the rest."]
    page = "<article><p>Main text.</p>" + "<b>" * 450 + "<div class='comments'><p>Leaks in.</p></div></article>"
    assert main_text(page, ["article"]) == "Main text."
    assert main_text("<b>" * 100_000 + "<div>x</div>" * 1000, []).count("x") == 1000


AROUND = "<html><body><article><p>First paragraph of the article, quite long.</p>{}<p>Last paragraph of it, also long enough.</p></article></body></html>"


@pytest.mark.parametrize(
    "piece",
    [
        "<script src=/x/>code</script>", '<script src="a.js"/>code</script>', "<style/>p{}</style>", "<textarea>a<p>b</textarea>", "<template><p>x</p></template>",
        "<svg><svg><text>a</text></svg><text>x</text></svg>", "<math/>", '<svg><path d="x">', "<select><option>one", "<object data=x>", "<video src=a />",
        "<video><p>x</p></video>", '<div style="color: red; display: none">x</div>', '<label for="q">x</label>', '<div class="cookie-notice">x</div>',
        '<div class="related-posts">x</div>', '<div id="electionComments">x</div>', '<div class="ad-slot-3">x</div>', '<p class="ad">x</p>', '<div class="sidebar">x</div>',
    ],
)
def test_what_is_no_text_neither_leaks_nor_swallows(piece):
    assert main_text(AROUND.format(piece), []).split("\n") == ["First paragraph of the article, quite long.", "Last paragraph of it, also long enough."]


@pytest.mark.parametrize(
    "piece",
    [
        '<h2 class="news-alert">K</h2>', '<p class="share-price">K</p>', '<section id="related-work">K</section>', '<div class="search-algorithms">K</div>',
        "<label>K</label>", '<div class="with-sidebar">K</div>', '<div class="no-ads">K</div>', '<div class="post-footer">K</div>', "<header><h1>K</h1></header>",
    ],
)
def test_words_of_a_name_do_not_drop_text(piece):
    assert main_text(AROUND.format(piece), []).split("\n")[1:-1] == ["K"]


class _Reader(HTMLParser):
    """Text of the article by a plain walk: for pages whose main text is their one article."""

    parted = set("p div h1 h2 h3 h4 h5 h6 ul ol li table tr blockquote pre section article".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.dropped, self.blocks, self.held = 0, 0, [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        self.blocks += [block] if (block := " ".join("".join(self.held).split())) else []
        self.held = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        # An advert is one element without elements of its name.
        self.dropped = self.dropped or (tag if ("class", "ad") in attrs or tag in ("script", "style", "nav", "footer", "aside", "form") else 0)
        if tag in self.parted:
            self.end()
        elif tag in ("br", "td", "th"):
            self.held.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.dropped = 0 if tag == self.dropped else self.dropped
        if tag in self.parted:
            self.end()

    def handle_data(self, data):
        if self.inside and not self.dropped:
            self.held.append(data)


def test_given_pages_against_a_plain_walk(spark, scratch):
    # All pages of the middle size; the query's tables hold the same kinds of pages.
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: "\n".join(_Reader(r.html or "").blocks) for r in table.select("page_id", "html").collect()}
    got = extract(table, scratch).collect()
    assert len(got) == len(want)
    assert [r.page_id for r in got if r.text != want[r.page_id]] == []


def test_nested_headers_take_linear_time():
    begin = time.perf_counter()
    main_text("<article>" + "<header><div>" * 9000 + "x", [])
    assert time.perf_counter() - begin < 3
