"""The site style tree: entropies by brute force, what the tree does alone, pages
without an article, markup that misleads, and broken HTML."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from marlstone.llm import site_tree

SCHEMA = "page_id long, url string, html string"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "s", "v", "r") for c in ("ar", "el", "im", "ot", "u")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(spark, rows, **how):
    return {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, SCHEMA), **how).collect()}


def framed(rng, n, pool, body):
    """n pages of one host: menu, advert and footer each draw from ``pool``
    sentences, in elements without tell-tale names."""
    say = [prose(rng, rng.randint(4, 9)) for _ in range(pool)]
    rows, want, frame = [], {}, 0
    for k in range(n):
        menu, ad, foot = (rng.choice(say) for _ in range(3))
        ps = [prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        rows.append((k, f"http://h.org/{k}", f"<html><body><div class='a'><ul>{''.join(f'<li>{w}' for w in menu.split())}</ul></div><div class='b'>{ad}</div>{body % ''.join(f'<p>{p}</p>' for p in ps)}<div class='c'>h.org {foot}</div></body></html>"))
        want[k] = "\n".join(ps)
        frame += len(menu) + len(ad) + len(foot)
    return rows, want, frame


@pytest.mark.parametrize("body", ["<article>%s</article>", "<div class='t'>%s</div>", "%s"])
@pytest.mark.parametrize("markup", [True, False])
def test_the_tree_alone_removes_frames_that_change(spark, body, markup):
    """Menus, adverts and footers that change from page to page and come again:
    no name says what they are, and without markup not even a tag does."""
    rows, want, _ = framed(random.Random(41), 120, 60, body)
    assert texts(spark, rows, markup=markup) == want


def test_ablation(spark):
    """Share of the frame's characters that the tree takes without any markup,
    by pages of a host; content stays whole throughout."""
    share = {}
    for n in (20, 40, 160):
        rows, want, frame = framed(random.Random(42 + n), n, 60, "<article>%s</article>")
        got = texts(spark, rows, markup=False)
        lost = Counter()
        for k, t in want.items():
            left, own = got[k].split("\n"), t.split("\n")
            assert not Counter(own) - Counter(left)
            lost["left"] += sum(len(x) * c for x, c in (Counter(left) - Counter(own)).items())
        share[n] = 1 - lost["left"] / frame
    assert share[160] == 1 and share[40] > 0.6, share


def test_entropies_by_brute_force(spark):
    rng = random.Random(43)
    rows = framed(rng, 30, 8, "<div class='t'>%s<h2>More</h2></div>")[0] + [(100 + k, "http://other.org/", h) for k, h in enumerate(["<p>a b</p><p>same</p>", "<p>c d</p><p>same</p>", "<div><p>e</p></div>"])]
    rows += [rows[3], rows[3]]  # copies count as one page
    got = {}
    for r in site_tree.importances(site_tree.page_nodes(spark.createDataFrame(rows, SCHEMA).selectExpr("substring_index(substring_index(url, '//', -1), '/', 1) as host", "html"))).collect():
        got[r["host"], r["path"], r["kind"], r["value"]] = (r["importance"], r["n"], r["share"])

    want, hosts, seen = {}, defaultdict(list), set()
    for _, url, html in rows:
        p = site_tree.Page(html)
        own = p.own()
        key = (url.split("/")[2], tuple(p.path), tuple(sorted((p.path[e], s) for e, s in own.items())))
        if key not in seen:
            seen.add(key)
            hosts[key[0]].append((p, own))
    for host, pages in hosts.items():
        looks, contents, n, inst, length = defaultdict(Counter), defaultdict(Counter), Counter(), Counter(), Counter()
        for p, own in pages:
            text, look, lens = p.branches(own)
            for path in set(p.path):
                at = [e for e in range(len(p.path)) if p.path[e] == path]
                n[path] += 1
                looks[path].update({look[e] for e in at})
                contents[path].update(new := {text[e] for e in at if text[e]})
                inst[path] += len(new)
                length[path] += sum(lens[e] for e in at)
        for path in n:
            if n[path] < 2:
                continue
            total = sum(looks[path].values())
            style = min(1.0, max(0.0, -sum(c / total * math.log(c / total) for c in looks[path].values()) / math.log(n[path])))
            equal = sum(c * (c - 1) / 2 for c in contents[path].values())
            again = sum(c for c in contents[path].values() if c > 1)
            text = 1.0
            if equal >= 2 and (inst[path] <= n[path] or 2 * again > inst[path]):
                text = min(1.0, -math.log((equal - 1) / (inst[path] * (inst[path] - 1) / 2)) / math.log(site_tree.POOL))
            g = site_tree.GAMMA ** len(looks[path])
            want[host, path, 0, site_tree.ANY] = ((1 - g) * style + g * text, n[path], length[path] / length[0])
            for value, c in contents[path].items():
                if c > 1 and 2 * c > n[path]:
                    want[host, path, 1, value] = (1 - math.log(c) / math.log(n[path]), n[path], 0.0)
    assert got.keys() == want.keys() and len(want) > 12
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


# -- markup ------------------------------------------------------------------


def test_main_parts(spark):
    """A lead before a nested article, teasers beside a main element, an
    article's own header, several articles, and a main element without text."""
    pages = {
        "<main><p>Lead.</p><article><h1>Title</h1><p>Text.</p></article></main><article>Teaser</article><p>Outside</p>": "Lead.\nTitle\nText.",
        "<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me</p></header><p>Text.</p><footer>End</footer></article>": "Title\nBy me\nText.",
        "<article><p>One</p></article><p>between</p><article><p>Two</p></article>": "One\nTwo",
        "<main></main><article><p>One</p></article>": "One",
        "loose <b>text</b> <article>In</article> after": "In",
        "<h2>Head</h2><p>Text</p>": "Head\nText",
    }
    rows = [(k, f"http://h{k}.org/", f"<html><body>{h}</body></html>") for k, h in enumerate(pages)]
    assert texts(spark, rows) == dict(enumerate(pages.values()))


@pytest.mark.parametrize("name", ["share-price", "search-results", "notice-period", "related-work", "entry-header", "copyright-law", "advice", "navigate-by-stars", "menuhin", "commentary"])
def test_names_that_only_look_like_noise(spark, name):
    assert texts(spark, [(1, "http://h.org", f"<article><p>a</p><div class='{name}'>b</div><p>c</p></article>")]) == {1: "a\nb\nc"}


@pytest.mark.parametrize("name", ["ad", "top-ad", "cookie-notice", "comments", "comment-list", "site_footer", "x left-sidebar", "newsletter-box", "sr-only", "nav2", "related-articles"])
def test_names_that_say_noise(spark, name):
    assert texts(spark, [(1, "http://h.org", f"<article><p>a</p><div id='{name}'>b</div><span class=\"{name}\">x</span><p>c</p></article>")]) == {1: "a\nc"}


def test_attributes_are_read_as_such(spark):
    html = "<article><p title=\"class=ad >\">a</p><p data-x='<div hidden>' CLASS=ad>b</p><p class = \"x\">c</p><p style='color:red;Display : none'>d</p><p hidden>e</p><p aria-hidden=true>f</p></article>"
    assert texts(spark, [(1, "http://h.org", html)]) == {1: "a\nc"}


def test_a_lead_outside_of_the_article_stays_if_many_pages_have_it(spark):
    rng = random.Random(44)
    rows, want = [], {}
    for n, host in ((60, "many"), (5, "few")):
        for k in range(n):
            lead, text = prose(rng, 12), prose(rng, 40)
            rows.append((len(rows), f"http://{host}.org/{k}", f"<body><div class='intro'>{lead}</div><article><p>{text}</p></article><div class='legal'>All ours</div></body>"))
            want[len(rows) - 1] = f"{lead}\n{text}" if host == "many" else text
    assert texts(spark, rows) == want


def test_headings_go_with_what_follows(spark):
    rng = random.Random(45)
    rows = [(k, "http://h.org/", f"<body><h2>Menu</h2><div class='m'>A B C</div><h2>Story</h2><p>{prose(rng, 20)}</p><p>{prose(rng, 20)}</p></body>") for k in range(20)]
    got = texts(spark, rows)
    assert all(t.startswith("Story\n") and t.count("\n") == 2 for t in got.values())


def test_repeated_rows_ties_and_very_long_pages(spark):
    rng = random.Random(46)
    long_ = [prose(rng, 50) for _ in range(4000)]
    page = f"<body><nav>x</nav><article>{''.join(f'<p>{p}' for p in long_)}</article></body>"
    rows = [(1, "http://h.org/a", page), (1, "http://h.org/a", page), (2, "http://h.org/a", page), (None, "http://h.org/b", "<p>x</p>"), (None, "http://h.org/b", "<p>x</p>")]
    out = site_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in out) == sorted([(1, "\n".join(long_))] * 2 + [(2, "\n".join(long_)), (0, "x"), (0, "x")])


# -- broken HTML -------------------------------------------------------------

N = 30_000
BROKEN = {
    "unclosed tags": ("x" + "<b" * N, None),
    "unclosed names": ("<name " * N, None),
    "open and stray": ("<b>" * N + "x" + "</b>" * N + "</i>" * N, "x"),
    "stray within a wall": ("<b>" + "<article>" + "<i>" * N + "</b>" * N + "x", "x"),
    "paragraphs within inline": ("<b>" * N + "<p>x" * N, "\n".join("x" * N)),
    "no unquoted end": ('<a "x>" ' * N, None),
    "unclosed script": ("a<script>" + "</script " * N, "a"),
    "unclosed comments": ("a<!--" * N, "a"),
    "nested lists": ("<ul><li><p>x" * N, "\n".join("x" * N)),
    "nested tables": ("<table><tr><td>x" * N, "\n".join("x" * N)),
    "cells": ("<td>x" * N, "\n".join("x" * N)),
    "deep": ("<div>" * N + "x", "x"),
    "signs": ("< " * N, " ".join("<" * N)),
    "attributes": ("<p " + "class " * N + ">x", "x"),
    "quotes": ("<p " + 'class="a ' * (N | 1) + ">x", None),
    "space": ("<p class" + " " * (10 * N) + "=x>x", "x"),
    "options": ("a<select>" + "<option>x" * N, "a"),
    "references": ("&amp" * N, "&" * N),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_html_is_read_in_linear_time(name):
    html, want = BROKEN[name]
    began = time.process_time()
    p = site_tree.Page(html)
    got = p.text(*site_tree.prune(p, {}))
    site_tree._nodes(p, p.own())
    assert time.process_time() - began < 8
    if want is not None:
        assert got == want


def test_small_pages_by_an_independent_reader():
    """Well-formed pages: the text is what a plain removal of tags gives."""
    rng = random.Random(47)
    for _ in range(200):
        blocks = [" ".join(rng.choice(["a", "<b>b</b>", "c &amp; d", "&eacute;", "<i class='x'>e</i>", "1 &lt; 2"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 5))]
        html = "<body>" + "".join(f"<{t}> {b}\n</{t}>" for b in blocks for t in [rng.choice(["p", "div", "li", "h3", "section"])]) + "</body>"
        p = site_tree.Page(html)
        import html as entities

        want = [t for b in blocks if (t := " ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()))]
        assert p.text(*site_tree.prune(p, {})) == "\n".join(want)
