import random
import re
import time
from html.parser import HTMLParser

import pytest
from prefscale.llm import html_text as H

LONG = "Words of a sentence, and more words, that go on for quite a while so that it counts as text."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_template_page():
    src = page(
        '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>A &amp; B</h1>'
        f"<p><b>{LONG}<br><p>Second&nbsp;  one\n here.</p><p>x</p></article><footer>&copy; y</footer>",
        '<script>var t="</p>";</script><style>p{}</style>',
    )
    assert H.main_text(src) == f"A & B\n{LONG}\nSecond one here.\nx"


def test_drops_what_is_not_the_article():
    src = page(
        f'<header><h1>Site</h1></header><div class="cookie-notice">{LONG}</div><div id="content"><h2>Head</h2><p>{LONG}</p><aside>{LONG}</aside>'
        f'<form><p>{LONG}</p></form><p hidden>{LONG}</p><p>Short one</p><ul><li>item, one<li>item two</ul></div>'
        f'<div id="sidebar"><p>{LONG}</p></div><section class="comments"><p>{LONG} first!</p></section>'
    )
    assert H.main_text(src) == f"Head\n{LONG}\nShort one\nitem, one\nitem two"


def test_best_container_and_siblings():
    src = page(f'<div><a href="#">a</a> <a href="#">b</a></div><div class="x"><p>{LONG}</p><p>{LONG}</p></div><div class="x"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>')
    assert H.main_text(src) == "\n".join([LONG] * 5)


def test_links_discount():
    src = page(f'<div><p><a href="#">{LONG}</a></p><p><a href="#">{LONG}</a></p></div><div><p>{LONG}</p></div>')
    assert H.main_text(src) == LONG


def test_broken_markup():
    assert H.main_text(None) == H.main_text("") == H.main_text("<script>x") == H.main_text("<!-- x") == ""
    assert H.main_text("a < b & c") == "a < b & c"
    assert H.main_text(f'<article><p class="a>{LONG}</p><p>{LONG}</p>').count("Words") >= 1
    assert H.main_text(f"<main><table><tr><td>{LONG}<td>two<tr><td>three</table></main>") == f"{LONG}\ntwo\nthree"
    assert H.main_text("<p>&#x41;&eacute;&lt;b&gt;</p>") == "Aé<b>"


def test_long_and_deep_pages_take_linear_time():
    began = time.time()
    text = H.main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")
    assert text.count("\n") == 19_999
    assert H.main_text("<div>" * 3_000 + LONG + "</div>" * 3_000) == LONG
    H.main_text('<a "' * 20_000)
    H.main_text("<" * 200_000)
    assert time.time() - began < 30


def test_digest(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "t"), (1, "u", None, "t"), (2, None, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.digest(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (1, len(LONG)), (2, 0)]
    assert H.digest(df.where("page_id = 9")).count() == 0
    assert H.extract(df).columns == ["page_id", "url", "text"]


@pytest.mark.parametrize("tag", [
    '<div title="the hidden truth">', '<div title="role=search here">', '<div data-role="navigation">', '<div data-class="ad">', '<div class="top">',
    '<div class="social-history">', '<div class="a" class="sidebar">', '<section id="shareholders">', "<div style='color:red' alt='display:none'>", "<div aria-hidden=false>", '<div class="page-turner headless">',
])
def test_attributes_that_say_nothing(tag):
    assert H.main_text(page(f"{tag}<p>{LONG}</p><p>{LONG}</p></div>")) == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("tag", ["<div hidden>", '<div hidden="">', '<div class="x  sidebar-left">', "<div class=userComments>", '<div id="related-posts">', '<div role=Navigation>', "<div aria-hidden=true>", '<div style="a:b; display : none">', '<div id=site-header>', '<p class="comment-list">'])
def test_attributes_of_parts_that_are_not_read(tag):
    assert H.main_text(page(f"{tag}{LONG} {LONG}</div><article><p>{LONG}</p></article>")) == LONG


class Slow(HTMLParser):
    """A plain tree of well-formed pages: [tag, attributes, children or texts]."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", {}, [], None]
        self.at = self.root
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(reversed([(k, v or "") for k, v in attrs])), [], self.at]
        self.at[2].append(node)
        if tag not in H.VOID:
            self.at = node

    def handle_endtag(self, tag):
        self.at = self.at[3]

    def handle_data(self, data):
        self.at[2].append(data)


def slow_text(source):
    """The documented scoring, block by block with a walk to the root for each, over the plain tree."""
    order, blocks = [], []

    def up(node):
        while node[3] is not None:
            yield node
            node = node[3]

    is_in = lambda node: any(x[0] in ("article", "main") for x in up(node))

    def unread(node):
        tag, attrs = node[0], node[1]
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        return (
            tag in H.DROPPED or tag in H.RAW or attrs.get("role", "").strip().lower() in H.DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true"
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I) is not None
            or (tag not in ("body", "html", "article", "main", "p") or "comment" in names.lower()) and H.unread(names, tag not in ("div", "section", "table") or is_in(node[3]))
            or tag == "header" and not is_in(node[3])
        )

    run = []

    def flush():
        if run:
            text = " ".join("".join(t for t, _, _ in run).split())
            if text:
                blocks.append((run[0][2], text, sum(len(" ".join(t.split())) for t, link, _ in run if link)))
            run.clear()

    def walk(node, link, owner):
        order.append(node)
        for x in node[2]:
            if isinstance(x, str):
                if run or x.strip():
                    run.append((x, link, owner))
            elif x[0] == "br":
                if run:
                    run.append((" ", False, owner))
            elif not unread(x) and x[0] not in H.VOID:
                if x[0] in H.BLOCK:
                    flush()
                walk(x, link or x[0] == "a", x if x[0] in H.BLOCK else owner)
                if x[0] in H.BLOCK:
                    flush()
            elif x[0] in H.BLOCK:
                flush()

    root = Slow(source).root
    walk(root, False, root)
    flush()
    key = {id(n): i for i, n in enumerate(order)}
    score, chars, links = {}, {}, {}
    for owner, text, linked in blocks:
        for n in up(owner):
            chars[id(n)], links[id(n)] = chars.get(id(n), 0) + len(text), links.get(id(n), 0) + linked
        if len(text) >= 25 and owner[0] not in H.HEADINGS:
            points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1, linked / len(text)))
            for lvl, n in enumerate(up(owner[3] if owner[0] in ("p", "pre", "td", "blockquote", "li", "dd") else owner)):
                score[id(n)] = score.get(id(n), 0) + points / (1, 2, 6, 9, 12, 15, 18)[min(lvl, 6)]
    names = lambda n: f"{n[1].get('class', '')} {n[1].get('id', '')}".strip()
    thin = lambda n: 1 - links.get(id(n), 0) / max(1, chars.get(id(n), 0))
    worth = lambda n: (score[id(n)] + H.TAG_POINTS.get(n[0], 0) + 25 * bool(re.search("article|body|content|entry|main|post|story|text|blog", names(n), re.I))) * thin(n)
    total = {id(n): worth(n) for n in order if id(n) in score and n[0] not in ("html", "#root")}
    some = [n for n in order if id(n) in total]
    if not some:
        return None
    best = max(some, key=lambda n: (round(total[id(n)], 9), -key[id(n)]))
    top = next((n for n in up(best) if n[0] in ("article", "main")), None)
    article, top = top is not None, top or best
    roots = [top]
    if best[0] != "body":
        for n in top[3][2]:
            if isinstance(n, list) and n is not top and id(n) in chars:
                most = 0.2 * total.get(id(top), 0)
                near = total.get(id(n), 0) + (most if names(n) and names(n) == names(top) else 0) >= max(10, most)
                if near and n[0] not in H.HEADINGS or n[0] == "p" and chars[id(n)] > 80 and thin(n) > 0.75:
                    roots.append(n)
        if not article:
            roots += [n for n in top[3][2] if isinstance(n, list) and n[0] in ("h1", "h2") and any(b[0] is n for b in blocks) and key[id(n)] < key[id(top)]][-1:]
    return "\n".join(t for o, t, _ in blocks if any(x is r for x in up(o) for r in roots))


def made(r):
    words = ["hidden", "role=search", "class", "nav", "text, more", "Sidebar", "of &lt;p&gt;", "&amp;", "style", "comma, comma,", "x"]
    attrs = ["class", "id", "title", "data-role", "data-class", "alt", "role", "style", "hidden"]
    values = ["content", "sidebar", "ad-slot", "social-history", "social-links", "navigation", "display:none", "top", "note", "post", "site-header", "x", "the hidden truth", "comments"]

    def sentence():
        return " ".join(r.choice(words) for _ in range(r.choice([1, 4, 20, 60])))

    def tag(name):
        return f"<{name}" + "".join(f' {a}="{r.choice(values)}"' if a != "hidden" or r.random() < 0.5 else "" for a in r.sample(attrs, r.choice([0, 0, 1, 2])) if a != "hidden" or r.random() < 0.1) + ">"

    def inner():
        return "".join(r.choice([sentence(), f"<b>{sentence()}</b>", f'<a href="#">{sentence()}</a>', "<br>", f"{tag('span')}{sentence()}</span>"]) + " " for _ in range(r.randint(1, 3)))

    def block(depth):
        kind = r.choice(["p", "h2", "div", "section", "ul", "article", "aside", "blockquote", "header", "div", "div", "p", "p"])
        if kind in ("p", "h2") or depth > 6:
            return f"{tag('p' if kind != 'h2' else kind)}{inner()}</{'p' if kind != 'h2' else kind}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(r.randint(1, 3))) + "</ul>"
        return f"{tag(kind)}{inner() if r.random() < 0.2 else ''}" + "".join(block(depth + 1) for _ in range(r.randint(1, 4))) + f"</{kind}>"

    return "<html><body>" + "".join(block(0) for _ in range(r.randint(1, 5))) + "</body></html>"


def test_against_a_slow_version():
    r, told = random.Random(11), 0
    for _ in range(400):
        src = made(r)
        want = slow_text(src)
        if want is not None:
            told += 1
            assert H.main_text(src) == want, src
    assert told > 200


def test_deep_pages():
    began = time.time()
    text = H.main_text("<div>text of some length here, and more" * 50_000)
    assert len(text.split("\n")) == 50_000 and H.main_text("<div>" * 50_000 + LONG) == LONG
    H.main_text("<div><li></section></b>" * 30_000)
    assert time.time() - began < 5
