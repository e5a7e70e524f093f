"""Pages that are broken, hostile or unusual; and a plain second reading of well-formed pages."""

import random
import time
from html.parser import HTMLParser

import pytest

from tickloom.llm.html_text import LABELLED, extract, is_text, main_text, tree

PARA = "A paragraph of the article with enough words in it to be read as text by any rule."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<script>var s="<!--";</script><nav>menu home</nav><article><p>{PARA}</p></article>', PARA),
        (f"<style>a::after{{content:'<article>'}}</style><article><p>{PARA}</p></article>", PARA),
        (f"<article><p>Before <svg> inside</p><p>{PARA}</p></article>", f"Before\n{PARA}"),
        (f"<article><p>Before <svg><title>t</title></svg>after</p><p>{PARA}</p></article>", f"Before after\n{PARA}"),
        (f"<article><p>{PARA}</p><audio src=x><p>{PARA}</p></article>", f"{PARA}\n{PARA}"),
        (f"<article><p>{PARA}</p><video>none</video></article><svg></svg>", PARA),
        (f"<article><textarea><p>typed</p></textarea><p>{PARA}</p></article>", PARA),
        (f"<article><div class='search-result notice-board'><p>{PARA}</p></div></article>", PARA),
        ("<article><p>a &amp; b &#x41;&#66; &eacute;</p></article>", "a & b AB é"),
        ("<article><p>one\n\t two  three</p></article>", "one two three"),
        ("", ""),
        (None, ""),
        ("<", "<"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page", ["<b>" * 20000 + "</i>" * 20000, "<svg>x" * 20000, "<svg>x<p>" * 20000 + "</svg>", "<video>x" * 20000, "<!--" * 50000, "<a b='" * 20000, "<p class='ad'>" * 20000 + "<h1>x", "<" * 200000])
def test_time_is_linear(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 5


class Plain(HTMLParser):
    """Well-formed pages only: paragraphs and headings inside the article, without asides."""

    def __init__(self):
        super().__init__()
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        self.open.append(tag)
        if tag in ("p", "h1", "h2", "li"):
            self.out.append("")

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if "article" in self.open and not {"aside", "script", "nav", "form"} & set(self.open) and {"p", "h1", "h2", "li"} & set(self.open):
            self.out[-1] += data


def test_a_second_reading_agrees(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    pages = []
    for k in range(120):
        body = [f"<h1>{text(4)}</h1>"]
        for _ in range(rnd.randint(1, 6)):
            body.append(rnd.choice([
                lambda: f"<p>{text(rnd.randint(15, 80))}</p>", lambda: f"<p>{text(20)} <a href='#'>{text(2)}</a> <b>{text(1)}</b> {text(9)}</p>",
                lambda: f"<h2>{text(3)}</h2>", lambda: f"<aside><p>{text(30)}</p></aside>", lambda: f"<ul><li>{text(12)}</li><li>{text(14)}</li></ul>",
            ])())
        menu = "".join(f"<li><a href='/{word()}'>{text(1)}</a></li>" for _ in range(5))
        pages.append((k, f"http://x/{k}", f"<html><head><title>{text(3)}</title></head><body><nav><ul>{menu}</ul></nav><article>{''.join(body)}</article><footer><p>{text(10)}</p></footer></body></html>"))
    pages += [(None, None, None), (5, "again", pages[5][2])]
    got = extract(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "url as text", "1 as n_chars")).collect()
    assert len(got) == len(pages)
    by_url = {r.url: r for r in got}
    for _, url, page in pages:
        plain = Plain()
        plain.feed(page or "")
        want = "\n".join(t for t in (" ".join(x.split()) for x in plain.out) if t)
        assert by_url[url].text == want and by_url[url].n_chars == len(want), page
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>Some text. <span class="ad">Buy cheap shoes now</span> More.</p>', "Some text. More."),
        (f"<article><p>{PARA}<span hidden>SECRET</span></p><p>a<span style='display:none'>HID</span>b</p></article>", f"{PARA}\nab"),
        (f"<article><p>{PARA}</p><label>Email</label><button>Subscribe now</button></article>", PARA),
        (f"<article><p>{PARA} <a class='share'>Share this</a> <span class='comments'>12 comments</span></p></article>", PARA),
        ("<article><p>one <span class='ad'>two<p>three</article>", "one\nthree"),
        ("<p>a <span class='promo'>b</span> c</p>", "a c"),
        ("<p><span class='promo'>only this</span></p>", "only this"),
        ("<h1>Title</h1><p>Short text.</p><ul><li><a href=x>one</a></li></ul>", "Title\nShort text."),
        ("<div><p>Yes.</p></div><nav><a href=x>Home</a> <a href=y>News</a></nav>", "Yes."),
        (f"<p>{PARA}</p><p><a href=x>Next story</a></p>", PARA),
        (f"<p>{PARA}</p><p><a href=x>a whole paragraph that is one link</a></p><p>{PARA}</p>", f"{PARA}\n{PARA}"),
        (f"<article><p>{PARA}</p><section class='discussion'><h2>Discussion</h2><p>{PARA}</p></section></article>", f"{PARA}\nDiscussion\n{PARA}"),
        (f"<article><p>{PARA}</p><div class='search-methods'><p>We searched.</p></div></article>", f"{PARA}\nWe searched."),
        (f"<article><p>{PARA}</p><table class='social-science'><tr><td>Country</td><td>12</td></tr></table></article>", f"{PARA}\nCountry\n12"),
        (f"<article><p>{PARA}</p><div class='social-links'><a href=x>one</a> <a href=y>two</a></div></article>", PARA),
        (f"<article><p>{PARA}</p><section class='comments'><p>{PARA}</p></section></article>", PARA),
    ],
)
def test_inline_parts_links_and_weak_words(page, want):
    assert main_text(page) == want


def test_the_tree_reads_a_block_s_own_words_and_density_and_knows_its_table():
    def read(node):
        return set() if isinstance(node, int) else {node[0]} | read(node[2]) | read(node[3])

    assert {0, 1, 3, 6, 7} <= read(tree())
    assert all(is_text(row[:-1]) == bool(row[-1]) for row in LABELLED)


class Nested(HTMLParser):
    """A second reading of nested markup within an article: the pieces of each block that no marked element holds."""

    BLOCKS, MARKED = {"article", "div", "p", "section", "ul", "li", "blockquote", "aside", "h2"}, {"ad", "newsletter", "comments", "share"}

    def __init__(self):
        super().__init__()
        self.marks, self.runs = [], [""]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.marks.append(tag in ("aside", "button", "label") or "hidden" in attrs or attrs.get("class") in self.MARKED)
        if tag in self.BLOCKS:
            self.runs.append("")

    def handle_endtag(self, tag):
        self.marks.pop()
        if tag in self.BLOCKS:
            self.runs.append("")

    def handle_data(self, data):
        if not any(self.marks):
            self.runs[-1] += data


def test_a_second_reading_of_nested_markup_agrees():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 8)))
    attr = lambda: rnd.choice(["", "", "", ' class="note"', ' class="ad"', " hidden", ' class="comments"', ' class="share"'])

    def inline(depth):
        out = []
        for _ in range(rnd.randint(1, 4)):
            k = rnd.random()
            if k < 0.6 or not depth:
                out.append(" ".join(word() for _ in range(rnd.randint(1, 9))) + rnd.choice(["", " ", "\n", " &amp; "]))
            else:
                tag = rnd.choice(["span", "b", "em", "button", "label"])
                out.append(f"<{tag}{attr()}>{inline(depth - 1)}</{tag}>")
        return "".join(out)

    def block(depth):
        if not depth or rnd.random() < 0.5:
            return f"<p{attr()}>{inline(2)}</p>"
        tag = rnd.choice(["div", "section", "blockquote", "aside"])
        return f"<{tag}{attr()}>{''.join(rnd.choice([block, lambda d: inline(1)])(depth - 1) for _ in range(rnd.randint(1, 4)))}</{tag}>"

    for _ in range(1500):
        page = f"<article><p>{PARA}</p>{''.join(block(3) for _ in range(rnd.randint(1, 5)))}</article>"
        plain = Nested()
        plain.feed(page)
        assert main_text(page) == "\n".join(t for t in (" ".join(x.split()) for x in plain.runs) if t), page
