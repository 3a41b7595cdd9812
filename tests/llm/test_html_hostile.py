"""Pages that break off, nest deeply or are hostile: no text is lost and time stays linear."""

import time

import pytest

from codeloom.llm import html_blocks
from codeloom.llm.html_blocks import blocks

REST = ["One is here.", "Two is here."]


def texts(page):
    return [b[0] for b in blocks(page)]


@pytest.mark.parametrize(
    "page",
    [
        "<p>x</p><img " + " ".join(f'a{i}="v"' for i in range(1000)),
        "<p>x</p><img alt=" + '"' * 100_001,
        "<p>x</p>" + "<a b='" * 50_000,
        "<p>x</p>" + "<a " * 100_000,
        "<p>x</p>" + "<a b=\"c'" * 50_000 + ">",
        "<p>x</p>" + "<iframe>" * 50_000 + "<textarea>" * 50_000 + "<head>" * 50_000,
        "<p>x</p>" + "<!-->" * 50_000 + "<!--" * 50_000,
        "<p>x</p>" + "<svg>" * 50_000 + "</svg>" * 50_000,
        "<p>x</p>" + "<![CDATA[" * 50_000,
    ],
)
def test_hostile_markup_is_linear(page):
    began = time.process_time()
    assert texts(page)[0] == "x"
    assert time.process_time() - began < 2


@pytest.mark.parametrize("tag", ["div class='a b'", "b", "p", "li", "td", "ul"])
def test_deep_nesting_is_linear(tag):
    name = tag.split()[0]
    page = f"<{tag}>w " * 50_000 + "<td>a</td>" * 20_000 + "</span>" * 20_000 + f"</{name}>" * 50_000 + "<p>end</p>"
    began = time.process_time()
    found = html_blocks.sequence(page)[0]
    assert time.process_time() - began < 5
    assert found[-1] == "end" and " ".join(found).split().count("w") == 50_000


def test_cut_off_and_unclosed_markup():
    inside = "<article><p>One is here.</p>{}<p>Two is here.</p></article>"
    for middle in ("<iframe src=x>", "<textarea>", "<xmp>", "<title>", "<script src='x.js'>", "<script src=x />", "<style/>", "<img alt='it''s'>", '<a b"c></a>', '<a href="x""></a>', "<!-->"):
        assert texts(inside.format(middle)) == REST, middle
    assert texts("<p>One is here.</p><p>Two is here.<img src='a") == REST
    assert texts("<p>a < b and c > d</p>") == ["a < b and c > d"]
    assert texts('<p title="a > b">x</p>') == ["x"]
    assert texts("<p>a<script>if (a</b) {}</script >b<style>p{}</style\n>c</p>") == ["abc"]


def test_references():
    assert texts("<p>&eacute;&#233;&#xE9; &amp;lt; &copy &nosuch; &#0233;</p>") == ["ééé &lt; © &nosuch; é"]
    assert texts(f"<p>a&#{'9' * 5000};b&#x{'f' * 5000};c&#{'0' * 5000}65;</p>") == ["a�b�cA"]


def test_pages_equal_an_independent_reading(spark):
    """On pages of the test tables, whose article is marked as such, against a reader built on html.parser."""
    import os
    import re
    from html.parser import HTMLParser

    from codeloom.llm import html_extract

    sf = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    block = re.compile("^(?:p|h[1-6]|div|ul|ol|li|table|tr|td|th|blockquote|pre|section|figure|figcaption|article|br|hr|aside|nav|form|footer|header)$")

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.skip, self.blocks, self.parts = 0, [], [], []

        def flush(self):
            text = " ".join("".join(self.parts).split())
            self.blocks += [text] if text else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.parts.append(" ")
            elif block.match(tag):
                self.flush()
            if tag == "article":
                self.inside += 1
            elif self.inside and (tag in ("aside", "nav", "form", "footer", "header", "script", "style", "button") or any(re.search(r"\b(ad|ads|share|related|comments?|promo|newsletter)\b", v or "") for k, v in attrs if k in ("class", "id"))):
                self.skip.append(tag)

        def handle_endtag(self, tag):
            if block.match(tag) and tag != "br":
                self.flush()
            if self.skip and self.skip[-1] == tag:
                self.skip.pop()
            if tag == "article":
                self.inside -= 1

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.parts.append(data)

    pages = spark.read.parquet(sf)
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(pages).collect()}
    wrong, n = [], 0
    for r in pages.collect():
        reader = Article()
        reader.feed(r["html"] or "")
        reader.close()
        reader.flush()
        n += 1
        if got[r["page_id"]] != "\n\n".join(reader.blocks):
            wrong.append(r["page_id"])
    assert n > 100 and len(wrong) <= 0.01 * n, wrong[:10]
