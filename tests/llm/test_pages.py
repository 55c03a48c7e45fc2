"""Main text of pages: against a second, plain form of the density rule, and on pages made to mislead it."""

import html
import math
import time
from html.parser import HTMLParser

import duckdb
import pytest
from cardloom.llm import html_extract
from cardloom.llm.html_extract import main_text


class Dom(HTMLParser):
    """A tree of lists: [tag, skipped, children], by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.root = ["", False, []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        block = tag in ("p", "div", "ul", "li", "h1", "article", "nav", "footer")
        if block and any(e[0] == "p" for e in self.open):
            self.handle_endtag("p")
        if tag == "li" and self.open[-1][0] == "li":
            self.handle_endtag("li")
        e = [tag, tag in ("script", "style", "nav", "footer", "head") or dict(attrs).get("class") == "ad", []]
        self.open[-1][2].append(e)
        if tag not in ("br", "meta", "link", "img"):
            self.open.append(e)

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def counts(e, linked=False):
    """Characters, tags, characters and tags of links."""
    linked, total = linked or e[0] == "a", [0, 0, 0, 0]
    for c in e[2]:
        if isinstance(c, str):
            total = [total[0] + len(c.strip()), total[1], total[2] + linked * len(c.strip()), total[3]]
        elif not c[1]:
            total = [x + y for x, y in zip(total, counts(c, linked), strict=True)]
            total = [total[0], total[1] + 1, total[2], total[3] + (c[0] == "a")]
    return total


def density(e, body, linked):
    c, t, lc, lt = counts(e, linked)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + counts(body)[2] / max(1, counts(body)[0]) * c + math.e)
    return c / max(1, t) * max(0.0, math.log(c / max(1, lc) * max(1, t) / max(1, lt))) / base


def plain_main_text(page):
    body = next(e for e in next(e for e in Dom(page).root[2] if e[0] == "html")[2] if e[0] == "body")
    rows = []

    def walk(e, path, linked):
        linked = linked or e[0] == "a"
        d = density(e, body, linked)
        rows.append((e, path, d, sum(density(c, body, linked) for c in e[2] if not isinstance(c, str) and not c[1])))
        for c in e[2]:
            if not isinstance(c, str) and not c[1]:
                walk(c, [*path, d], linked)

    walk(body, [], False)
    densest = max(rows, key=lambda r: r[2])
    least = min([*densest[1], densest[2]])
    best = max((r for r in rows if r[2] >= least), key=lambda r: r[3])[0]
    holds = lambda e: e is best or any(holds(c) for c in e[2] if not isinstance(c, str))
    best = next((r[0] for r in rows if r[0][0] == "article" and holds(r[0])), best)  # the article that it lies in
    out, run = [], []

    def flush():
        if block := " ".join(html.unescape("".join(run)).split()):
            out.append(block)
        run.clear()

    def show(e):
        for c in e[2]:
            if isinstance(c, str):
                run.append(c)
            elif not c[1]:
                block = c[0] not in ("b", "a", "br")
                if block:
                    flush()
                run.extend([" "] * (c[0] == "br"))
                show(c)
                if block:
                    flush()

    show(best)
    flush()
    return "\n\n".join(out)


def test_all_pages_give_what_the_plain_rule_gives():
    pages = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert len(pages) == 250
    for i, page in pages:
        assert main_text(page) == plain_main_text(page), i


PROSE = "".join(f"<p>Paragraph number {i} with some words of text in it, and more.</p>" for i in range(6))
ARTICLE = f"<h1>Head</h1>{PROSE}"
TEXT = "\n\n".join(["Head", *(f"Paragraph number {i} with some words of text in it, and more." for i in range(6))])
LINKS = "<ul>" + "".join(f"<li><a href='{i}'>link number {i}</a></li>" for i in range(20)) + "</ul>"


@pytest.mark.parametrize("wrapper", ["div class='layout with-sidebar'", "div class='content has-sidebar'", "div class='search-enabled page'", "div id='social-policy'", "section class='related-work'", "form id='all'", "div class='widget'"])
@pytest.mark.parametrize("inner", [ARTICLE, f"<article>{ARTICLE}</article>"])
def test_names_of_wrappers_lose_no_article(wrapper, inner):
    assert main_text(f"<body><nav><a href='x'>menu</a></nav><{wrapper}>{inner}</{wrapper.split()[0]}><footer>foot</footer></body>") == TEXT


def test_density_decides_and_tags_break_ties():
    assert main_text(f"<body><article><p>teaser</p></article><div>{ARTICLE}</div></body>") == TEXT
    assert main_text(f"<body><main>{LINKS}{ARTICLE}</main></body>") == TEXT
    assert main_text(f"<body><div>{LINKS}</div><div>{ARTICLE}</div><div>{LINKS}</div></body>") == TEXT
    assert main_text(f"<body><main><article>{ARTICLE}{LINKS}</article></main></body>") == TEXT


@pytest.mark.parametrize("outer", ["article", "div", "main"])
def test_texts_in_several_sections_are_taken_whole(outer):
    sections = "".join(f"<section><h2>Part {i}</h2>{PROSE}</section>" for i in range(5))
    got = main_text(f"<body><nav><a href='x'>menu</a></nav><div class='wrap'><{outer}><h1>Big</h1>{sections}</{outer}><div class='sidebar'><p>side</p></div></div></body>")
    assert got.startswith("Big\n\nPart 0\n\nParagraph number 0") and got.count("Paragraph number") == 30 and "side" not in got


def test_what_is_no_article_goes():
    for noise in ("div class='site-header'", "header", "div class='cookie-notice'", "div class='ad-slot'", "div id='share-buttons'", "aside", "div class='related-posts'", "div class='newsletter-signup'"):
        assert main_text(f"<body><div><{noise}><p>some noise</p></{noise.split()[0]}>{ARTICLE}</div></body>") == TEXT, noise
    assert main_text(f"<body><article><header class='entry-header'><h1>Head</h1></header>{PROSE}</article></body>") == TEXT
    thread = "<p>I say that this is a comment of great length and of no use.</p>" * 60
    assert main_text(f"<body><article>{ARTICLE}</article><div class='comments-area'>{thread}</div></body>") == TEXT
    assert main_text("<body><div class='comments'><p>only this</p></div></body>") == "only this"
    assert main_text("<body><nav><a href='x'>a</a></nav><footer>foot</footer></body>") == ""


def test_time_is_linear_in_the_page():
    def seconds(k, page):
        began = time.process_time()
        main_text(page(k))
        return time.process_time() - began

    for page in (lambda k: "<b>" * k + "x" + "</i>" * k, lambda k: "<i><div>" + "<b>" * k + "x" + "</i>" * k, lambda k: "<div class='header'>" * k + "x", lambda k: "<div class='comment'>" * k + "x", lambda k: "<p>text of a paragraph</p>" * k, lambda k: "<ul><li>" * k + "x"):
        assert seconds(40_000, page) < 12 * max(0.1, seconds(10_000, page))


def test_long_and_repeated_pages(spark):
    long = "<body><article>" + "<p>One of very many paragraphs &amp; more.</p>" * 50_000 + "</article></body>"
    df = spark.createDataFrame([(1, "u", long), (2, "u", f"<body>{ARTICLE}</body>"), (2, "u", f"<body>{ARTICLE}</body>"), (None, None, None)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["n_chars"], r["text"][:4]) for r in html_extract.extract(df).collect())
    assert got == [(0, 0, ""), (1, 50_000 * len("One of very many paragraphs & more.") + 2 * 49_999, "One "), (2, len(TEXT), "Head"), (2, len(TEXT), "Head")]
