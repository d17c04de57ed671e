from __future__ import annotations

import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchwell.llm import html_extract as h
from patchwell.llm.common import table
from tests.llm.conftest import SF

PAGES = "page_id long, url string, html string, host string, path long, tree string"
PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p > b {}</style></head><body class="x">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>More</ul></nav>
<div id="cookie-notice">We use cookies</div><!-- a <p>comment</p> -->
<article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>,
 two&nbsp;three<p>Next<br>line <script>if (a < b) { "</p>" }</script>end
<div class="share-buttons">Tweet</div><aside>Related</aside><ul><li>i<li>ii</ul>
<form><input value=x><button>Send</button></form><table><tr><td>a<td>b</table>
<section class="comments"><p>First!</p></section></article>
<div class='sidebar'>Side</div><div class="advert">Buy</div><footer>&copy; us</footer></body></html>"""


def test_a_page_with_everything():
    assert h.main_text(PAGE, {}).split("\n") == ["Head & line", "One bold, two three", "Next line end", "i", "ii", "a", "b"]


@pytest.mark.parametrize("text", ["", "plain", "<", "</p></div>", "<p>a<p>b", "<script>x", "<!-- open", "<p " + "x" * 9999, "<a href='>'>q</a>"])
def test_broken_markup(text):
    assert isinstance(h.main_text(text, {}), str)


_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)


@given(st.text(alphabet="<>/!?-\"'ab =\n", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_tokens_are_those_of_one_pattern(text):
    want = [(m.start(), m.end(), m[1] or "", m[2] or "", m[3]) for m in _PLAIN.finditer(text)]
    got, tags, look = [], h._Tags(text), 0
    while found := h._START.search(text, look):
        end, *parts = tags.read(found) if not found[2] else (found.end(), *found.group(1, 2, 3))
        look = end if end >= 0 else -1 - end
        if end >= 0:
            got.append((found.start(), end, *parts))
    assert got == [x[:4] + (x[4] or "",) for x in want]


def _shape(node):
    out, todo = [], [(0, node)]
    while todo:
        depth, x = todo.pop()
        out.append((depth, x if isinstance(x, str) else x.name))
        todo += [] if isinstance(x, str) else [(depth + 1, c) for c in x.children]
    return out


@given(st.lists(st.sampled_from("<p> </p> <b> </b> <i> </i> <li> <ul> </ul> <div> </div> <td> <tr> <table> </table> <hr> </html> <html> x".split()), max_size=60))
@settings(max_examples=600, deadline=None)
def test_deep_pages_close_as_others_do(parts):
    usual = _shape(h.parse("".join(parts)))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(h, "DEEP", 1)
        assert _shape(h.parse("".join(parts))) == usual


MEGABYTE = 1_000_000
BROKEN = ["<a ", "<a title='", "<!x", "<?x", "<a<a", "<a \"'", "<script>", "</script", "<script></script", "<a ='\">", "a='", "<b>", "</b>", "<p><b>", "<li><ul>", "<!--", "<a<!x", "\"", " a"]


@pytest.mark.parametrize("piece", BROKEN)
@pytest.mark.parametrize("end", ["", "\">", "'>", ">"])
def test_long_broken_markup_takes_linear_time(piece, end):
    """Times of one and four parts of a megabyte are compared, not held against a clock alone."""
    def took(n):
        text = "<a " * (piece in ("a='", "\"", " a")) + piece * (n // len(piece)) + end
        start = time.process_time()
        h.parse(text)
        return time.process_time() - start

    assert took(MEGABYTE) < 8 * took(MEGABYTE // 4) + 0.5


def test_end_tags_below_many_open_elements():
    start = time.process_time()
    for text in ("<p><div>" + "<b>" * 100_000 + "</p>" * 100_000, "<b>" * 100_000 + "<hr>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<ul>" + "<b>" * 100_000 + "<li><ul><b>" * 30_000):
        h.parse(text)
    assert time.process_time() - start < 20


@pytest.mark.parametrize("mark", ["hidden", 'hidden=""', "hidden='until-found'", 'class="x" hidden', 'aria-hidden="true"', 'style="color:red; display : none"', "style='visibility:hidden'"])
def test_hidden_elements_go(mark):
    assert h.main_text(f"<div><p>Shown</p></div><div {mark}><p>Not</p></div>", {}) == "Shown"
    for shown in ('title="a hidden thing"', "data-hidden", 'aria-hidden="false"', 'style="display:block"'):
        assert h.main_text(f"<div><p>Shown</p></div><div {shown}><p>Too</p></div>", {}) == "Shown\nToo"


def test_deep_pages():
    assert h.main_text("<div>" * 3000 + "x" + "</div>" * 3000, {}) == "x"


def test_what_a_site_repeats_goes_without_any_word_in_the_markup(frame):
    rows = [
        (i, f"http://a.org/{i}", f"<body><div class=m><p>Same menu</p></div><div class=t><p>Text {i} of page {i * 7}</p></div>", "", 0, "")
        for i in range(12)
    ]
    rows += [(90, "http://b.org/1", "<body><div class=m><p>Same menu</p></div>", "", 0, ""), (91, None, None, "", 0, "")]
    out = {r.page_id: r.text for r in h.extract(frame(rows, PAGES)).collect()}
    assert out == {**{i: f"Text {i} of page {i * 7}" for i in range(12)}, 90: "Same menu", 91: ""}


def test_copies_of_one_article_keep_their_text(frame):
    rows = [(i, "http://a.org/", "<nav>n</nav><article><p>One text</p></article>", "", 0, "") for i in range(9)]
    out = h.extract(frame(rows, PAGES)).collect()
    assert [(r.text, r.n_chars) for r in out] == [("One text", 8)] * 9
    assert h.extract(frame([], PAGES)).count() == 0


def test_given_pages(spark):
    pages = table(spark, SF, "pages")
    htmls = {r.page_id: r.html for r in pages.collect()}
    for r in h.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", htmls[r.page_id], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def _texts(frame, pages: list[str]) -> list[str]:
    rows = [(i, f"http://a.org/{i}", x, "", 0, "") for i, x in enumerate(pages)]
    return [r.text for r in sorted(h.extract(frame(rows, PAGES)).collect())]


def test_what_a_site_repeats_inside_its_articles_goes(frame):
    for tag in ("article", "main"):
        pages = [f"<{tag}><p>Text {i} of {i * 7}</p><div class=x><p>Same box</p></div><p>Same line</p></{tag}>" for i in range(14)]
        assert _texts(frame, pages) == [f"Text {i} of {i * 7}" for i in range(14)]


def test_main_text_beside_a_teaser_article(frame):
    pages = [f"<div class=t><p>Main text {i} of {i * 7}</p></div><article><p>Teaser</p></article>" for i in range(12)]
    assert all(f"Main text {i} of {i * 7}" in x for i, x in enumerate(_texts(frame, pages)))
    long = "A long main text of words. " * 60
    assert long.strip() in h.main_text(f"<div class=t><p>{long}</p></div><article><p>Teaser</p></article>", {})


def test_enough_evidence_outvotes_the_markup(frame):
    pages = [f"<div class=ad><p>Buy {i * 3}</p></div><div class=share><p>{f'word {i} of {i * 7} ' * 200}</p></div>" for i in range(40)]
    assert _texts(frame, pages) == [f"word {i} of {i * 7} " * 199 + f"word {i} of {i * 7}" for i in range(40)]


def test_wrappers_of_many_alike_branches_stay(frame):
    pages = ["<div class=w>" + "".join(f"<p>Text {i * 50 + k}</p>" for k in range(40)) + "</div>" for i in range(12)]
    assert _texts(frame, pages) == ["\n".join(f"Text {i * 50 + k}" for k in range(40)) for i in range(12)]


def test_importance_leans_on_few_pages(frame):
    pages = [f"<div class=m><p>Same</p></div><div class=t><p>Text {i}</p></div>" for i in range(12)]
    values = []
    for n in (1, 2, 3, 4, 12):
        rows = [(i, "", x, "a", 0, "") for i, x in enumerate(pages[:n])]
        found = h.importances(h.observe(frame(rows, PAGES))).where("text is not null").collect()
        values.append(min((r.reads for r in found), default=h.UNKNOWN))
    assert values == sorted(values, reverse=True) and len(set(values)) == 5
