"""Main text of pages by a site style tree.

The pages of one host are merged: a block element is a node of the host's tree,
named by its path of tags, classes and ids. Over all pages of the host a node has

* presentations, the sequences of its child blocks, whose entropy over the pages
  is near 0 if all pages look the same, and
* contents, the whole text below it. Their collision entropy, minus the log of
  the chance that two pages have the same text there, tells from how many texts
  the node draws. Unlike the plain entropy it does not depend on the number of
  pages, so a menu or an advert that changes from page to page but comes again
  is known for what it is.

A node's importance combines both, as in the published method: with l
presentations, (1 - g ** l) * presentation + g ** l * content. A text that most
pages share has an importance of its own. Branches of low importance leave every
page; the branch with most of the host's text stays.

Markup has its say besides the tree: scripts, styles, forms, menus, headers and
footers of the page go by their tags and roles; so do elements whose class or id
names them (adverts, notices, reader comments ...), as readers' comments and
adverts that never come again look like content to any entropy. Where a page
marks its main part (main, else article), what lies outside of it must come from
enough pages to be kept.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, arrow_rows, cut, small

#: Damping of presentations, least importance of a branch.
GAMMA, LEAST = 0.9, 0.5
#: A node that draws from so many texts or more has contents of importance 1.
POOL = 4096
#: Pages that weigh as much as the page's own mark of where its main part is.
MARKED = 24
#: Share of a host's text that makes a branch the main one.
MAIN = 0.5
#: Stands for any presentation or content of a node; hashes are not negative.
ANY = -1

# fixed values: element and label names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Parts of a list, a table or a figure go with the whole of it.
PARTS = frozenset("body caption dd dt figcaption head html li summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html li tbody td tfoot th thead tr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
#: A stray end tag within these doesn't end what is around them.
WALLS = frozenset("article main body table".split())
NOT_CONTENT = frozenset("head script style template noscript iframe object embed svg canvas nav header footer aside form button select textarea input menu dialog".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name what is no content, and words that say no
#: more than what kind of box it is or where it stands.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert aside banner bottombar breadcrumb breadcrumbs colophon comment commentlist comments consent cookie cookies copyright disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion rail recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sr subscribe subscription toc topbar widget widgets".split()
)
BOXES = frozenset("area articles bar block body bottom box buttons col column container form global inner item items left link links list main message only outer page panel posts primary right row secondary section site slot sticky text thread to tools top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())

_QUOTED = re.compile(r"""</?([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
_PLAIN = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_LABELS = re.compile(r"class|id|role|hidden|style", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MASK = (1 << 64) - 1

_paths: dict[tuple[int, str], int] = {}
_names: dict[str, tuple[bool, bool]] = {}


def _path(parent: int, label: str) -> int:
    key = (parent, label)
    found = _paths.get(key)
    if found is None:
        if len(_paths) > 500_000:
            _paths.clear()
        found = _paths[key] = _hash(f"{parent}/{label}") or 1
    return found


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def named_noise(value: str) -> tuple[bool, bool]:
    """Whether one of the names in a class or id value says that its element is
    no content, and whether one says that it is readers' comments. All words of
    such a name are NAMES or BOXES: cookie-notice is one, notice-period is not."""
    found = _names.get(value)
    if found is None:
        if len(_names) > 100_000:
            _names.clear()
        noise = comments = False
        for name in value.lower().split():
            words = [w for w in _DIGITS.sub("", name).replace("_", "-").split("-") if w]
            if words and not any(w not in NAMES and w not in BOXES for w in words):
                noise = noise or any(w in NAMES for w in words)
                comments = comments or any(w in COMMENTS for w in words)
        found = _names[value] = noise, comments
    return found


class Page:
    """Blocks in document order (parallel lists) and the run of texts.

    tag, parent, path, mark (markup says that it is no content); node 0 is the
    page. Inline elements are no nodes unless they are marked: their text is
    that of the block around them. ``run`` holds pairs (node, text), and (node,
    None) where a block begins or ends. Reading takes time in proportion to the
    page, however broken it is: every step goes forward, and open elements are
    found by name.
    """

    def __init__(self, html: str, markup: bool = True):
        self.tag, self.parent, self.path, self.mark = ["#"], [-1], [0], [False]
        self.run: list[tuple[int, str | None]] = []
        self.markup = markup
        self.stack: list[tuple[str, int, bool]] = []  # name, node that holds its text, whether a block
        self.open: dict[str, list[int]] = {}  # places on the stack by name
        self.blocks: list[int] = []
        self.walls: list[int] = []
        self.mains = 0
        at, size, last, quotes = 0, len(html), html.rfind(">"), True
        run, stack = self.run, self.stack
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                run.append((stack[-1][1] if stack else 0, html[at:]))
                break
            if lt > at:
                run.append((stack[-1][1] if stack else 0, html[at:lt]))
            c = html[lt + 1 : lt + 2]
            closing = c == "/"
            if closing:
                c = html[lt + 2 : lt + 3]
            if c.isascii() and c.isalpha():
                if lt > last:  # no tag ends any more
                    run.append((stack[-1][1] if stack else 0, html[lt:]))
                    break
                m = _QUOTED.match(html, lt) if quotes else None
                if m is None:
                    quotes = False  # a quote that never ends: tags end at the next >
                    m = _PLAIN.match(html, lt)
                at = m.end()
                name = m[1].lower()
                if closing:
                    self._close(name)
                else:
                    at = self._tag(html, at, name, m[2])
            elif html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif closing or c in ("!", "?"):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                run.append((stack[-1][1] if stack else 0, "<"))
                at = lt + 1
        self._leave(0)
        del self.stack, self.open, self.blocks, self.walls

    def _tag(self, html: str, at: int, name: str, attributes: str) -> int:
        """A start tag; returns where to read on."""
        blocks, stack = self.blocks, self.stack
        if name in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            self._leave(blocks[-1])
        if name in SIBLINGS:
            k = len(blocks) - 1
            while k >= 0:
                t = stack[blocks[k]][0]
                if t in SIBLINGS[name]:
                    self._leave(blocks[k])
                    if name not in ("tr", "tbody", "tfoot"):
                        break
                    k = len(blocks)
                elif t != "p":
                    break
                k -= 1
        elif name == "option" and (own := self.open.get("option")) and not (blocks and blocks[-1] > own[-1]):
            self._leave(own[-1])
        label, mark, main = name, False, name in ("article", "main")
        if attributes and _LABELS.search(attributes):
            for m in _ATTRIBUTE.finditer(attributes):
                key = m[1].lower()
                if key not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
                    continue
                value = entities.unescape((m[2] or "").strip("\"'"))
                if key in ("class", "id"):
                    label += f".{_DIGITS.sub('#', value)}"
                    noise, comments = named_noise(value)
                    mark = mark or (noise and name not in ("html", "body", "article", "main")) or (comments and name == "article")
                elif key == "role":
                    mark = mark or value.strip().lower() in NOT_CONTENT_ROLES
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
                    mark = True
        # the header of an article holds its title
        mark = mark or (name in NOT_CONTENT and not (name == "header" and self.mains))
        holder = stack[-1][1] if stack else 0
        block = name in BLOCK
        if block or mark:
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(holder)
            self.path.append(_path(self.path[holder], label))
            self.mark.append(mark and self.markup)
            if block:
                self.run.append((node, None))
        else:
            node = holder
            if name == "br":
                self.run.append((holder, " "))
        if name in VOID or (name in ("svg", "path") and attributes.endswith("/")):
            return at
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            gt = html.find(">", end.end()) if end else -1
            return len(html) if gt < 0 else gt + 1
        place = len(stack)
        stack.append((name, node, block))
        self.open.setdefault(name, []).append(place)
        if block:
            blocks.append(place)
        if name in WALLS:
            self.walls.append(place)
            self.mains += main
        return at

    def _close(self, name: str) -> None:
        own = self.open.get(name)
        if own and (name in ("article", "main", "body", "html") or not self.walls or own[-1] >= self.walls[-1]):
            self._leave(own[-1])

    def _leave(self, place: int) -> None:
        stack = self.stack
        while len(stack) > place:
            name, node, block = stack.pop()
            self.open[name].pop()
            if block:
                self.blocks.pop()
                self.run.append((node, None))
            if name in WALLS:
                self.walls.pop()
                self.mains -= name in ("article", "main")

    def own(self) -> dict[int, str]:
        """Text that a node holds itself, white space as one space."""
        held: dict[int, list[str]] = {}
        for e, t in self.run:
            if t:
                held.setdefault(e, []).append(t)
        return {e: s for e, ts in held.items() if (s := " ".join("".join(ts).split()))}

    def branches(self, own: dict[int, str]) -> tuple[list[int], list[int], list[int]]:
        """Of each node the hash of the text below it (0: none), of the sequence
        of its child blocks, and the length of the text below it."""
        n = len(self.tag)
        text, look, length = [0] * n, [1] * n, [0] * n
        parent, tag = self.parent, self.tag
        for e in range(n - 1, -1, -1):
            s = own.get(e)
            if s:
                text[e] = (text[e] * 0x9E3779B97F4A7C15 + _hash(s) * 2 + 1) & _MASK
                length[e] += len(s)
            p = parent[e]
            if p >= 0:
                if text[e]:
                    text[p] = (text[p] * 0x9E3779B97F4A7C15 + text[e]) & _MASK
                    length[p] += length[e]
                look[p] = (look[p] * 0xBF58476D1CE4E5B9 + (_path(0, tag[e]) | 1)) & _MASK
        return [x >> 1 for x in text], [x >> 1 for x in look], length

    def removed(self) -> list[bool]:
        """Whether markup says that a node, or what holds it, is no content."""
        out = [False]
        for e in range(1, len(self.tag)):
            out.append(self.mark[e] or out[self.parent[e]])
        return out

    def text(self, gone: list[bool], loose: set[int] = frozenset()) -> str:
        """Blocks of what is left, without the own text of the ``loose`` nodes."""
        blocks, now = [], []
        for e, t in self.run:
            if t is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif not gone[e] and e not in loose:
                now.append(t)
        if now:
            blocks.append("".join(now))
        return "\n".join(b for x in blocks if (b := " ".join(entities.unescape(x).split())))


# -- the tree ----------------------------------------------------------------


def page_nodes(pages: DataFrame, markup: bool = True) -> DataFrame:
    """(host, look, nodes) of each page. look: a hash of what markup leaves of
    it, so that copies which differ in a script, a menu or an advert agree.
    nodes, over all blocks: each presentation (kind 0) and content (kind 1) of a
    path once, and once a path the value ANY with the length of its text and the
    number of its contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, nodes, looks = [0], [], []
            for html in b.column("html").to_pylist():
                p = Page(html, markup)
                own = p.own()
                looks.append(_look(p, own))
                nodes.extend(_nodes(p, own))
                at.append(len(nodes))
            parts = [pa.array([x[i] for x in nodes], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, ["path", "kind", "value", "len", "inst"]))
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(looks, pa.int64()), lists], ["host", "look", "nodes"])

    return pages.select("host", "html").mapInArrow(run, "host string, look long, nodes array<struct<path: long, kind: int, value: long, len: long, inst: long>>")


def _look(p: Page, own: dict[int, str]) -> int:
    gone = p.removed()
    return _hash("\n".join([*(str(x) for x, g in zip(p.path, gone) if not g), *(f"{p.path[e]} {s}" for e, s in own.items() if not gone[e])]))


def _nodes(p: Page, own: dict[int, str]) -> list[tuple[int, int, int, int, int]]:
    text, look, length = p.branches(own)
    looks, texts, lens = set(), set(), {}
    for e, path in enumerate(p.path):
        looks.add((path, look[e]))
        if text[e]:
            texts.add((path, text[e]))
        lens[path] = lens.get(path, 0) + length[e]
    inst: dict[int, int] = {}
    for path, _ in texts:
        inst[path] = inst.get(path, 0) + 1
    out = [(path, 0, v, 0, 0) for path, v in looks] + [(path, 1, v, 0, 0) for path, v in texts]
    return out + [(path, 0, ANY, n, inst.get(path, 0)) for path, n in lens.items()]


def importances(nodes: DataFrame) -> DataFrame:
    """(host, path, kind, value, importance, n, share): what is known of the
    nodes of a host. n is the number of its pages that have the node; pages of a
    host that are copies of one another count as one page.

    kind 0, value ANY: a row a node that two pages have, with its importance and
    its share of the host's text. Two pages in a pair have the same content by
    a chance of q = (equal pairs - 1) / pairs: a single pair may be two copies.
    A node that occurs several times on a page is judged by its contents only if
    most of them come again.
    kind 1: a row a content that k of the n pages share, more than half of them,
    with importance 1 - ln k / ln n.
    """
    nodes = cut(nodes, "page-nodes").dropDuplicates(["host", "look"])
    each = nodes.select("host", F.explode("nodes").alias("x")).select("host", "x.*").groupBy("host", "path", "kind", "value").agg(F.count("*").alias("k"), F.sum("len").alias("len"), F.sum("inst").alias("inst"))
    each = cut(each.where((F.col("k") > 1) | (F.col("kind") == 0)), "style-counts")
    k = F.col("k").cast("double")
    is_any, is_look, is_text = F.col("value") == ANY, (F.col("kind") == 0) & (F.col("value") != ANY), F.col("kind") == 1
    per = each.groupBy("host", "path").agg(
        F.max(F.when(is_any, k)).alias("n"), F.sum(F.when(is_any, F.col("inst"))).cast("double").alias("inst"), F.sum(F.when(is_any, F.col("len"))).cast("double").alias("len"),
        F.count(F.when(is_look, 1)).alias("looks"), F.sum(F.when(is_look, k)).alias("seen"), F.sum(F.when(is_look, k * F.log(k))).alias("klogk"),
        F.coalesce(F.sum(F.when(is_text, k * (k - 1) / 2)), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum(F.when(is_text, k)), F.lit(0.0)).alias("again"),
    )
    per = cut(per.where(F.col("n") > 1), "style-nodes")
    n, inst = F.col("n"), F.col("inst")
    look = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log("seen") - F.col("klogk") / F.col("seen")) / F.log(n)))
    chance = (F.col("pairs") - 1) / (inst * (inst - 1) / 2)
    text = F.when((F.col("pairs") >= 2) & ((inst <= n) | (2 * F.col("again") > inst)), F.least(F.lit(1.0), -F.log(chance) / math.log(POOL))).otherwise(F.lit(1.0))
    g = F.pow(F.lit(GAMMA), F.col("looks"))
    hosts = small(per.where("path = 0").select("host", F.col("len").alias("all")))
    known = per.join(hosts, "host").select("host", "path", F.lit(0).alias("kind"), F.lit(ANY).cast("long").alias("value"), ((1 - g) * look + g * text).alias("importance"), n.cast("long").alias("n"), F.coalesce(F.try_divide("len", "all"), F.lit(0.0)).alias("share"))
    often = each.where(is_text).join(small(per.select("host", "path", "n")), ["host", "path"]).where(2 * k > n)
    often = often.select("host", "path", "kind", "value", (1 - F.log(k) / F.log(n)).alias("importance"), n.cast("long").alias("n"), F.lit(0.0).alias("share"))
    return known.unionByName(often)


# -- a page ------------------------------------------------------------------

Known = dict[tuple[int, int, int], tuple[float, int, float]]


def main_branch(p: Page, known: Known, length: list[int]) -> int:
    """The innermost branch of blocks below the body with MAIN of the text of
    the host or more (of the page's, if no other page has it); 0 if none."""
    n = len(p.tag)
    share, deeper = [0.0] * n, [False] * n
    for e in range(n - 1, 0, -1):
        if p.tag[e] in BLOCK:
            deeper[p.parent[e]] = True
        share[e] = known[p.path[e], 0, ANY][2] if (p.path[e], 0, ANY) in known else length[e] / length[0] if length[0] else 0.0
    found, inside = 0, [True] + [False] * (n - 1)
    for e in range(1, n):
        inside[e] = inside[p.parent[e]] and share[e] >= MAIN and length[e] > 0
        if inside[e] and deeper[e] and p.tag[e] in BLOCK and p.tag[e] not in ("html", "body"):
            found = e
    return found


def prune(p: Page, known: Known) -> tuple[list[bool], set[int]]:
    """(whether each node goes, nodes whose own text goes although they stay).

    Branches of low importance go, from the page down; parts of lists and tables
    go with the whole. Nothing inside the main branch goes by importance, nor
    what holds it. A heading goes if all that follows it, up to the next, does.

    The fewer pages say it the less they may take: without a main branch at
    most 1 - 1/n of a page's text, where n pages have the node or share the
    content. What would take more is a copy of the page, and it stays whole.
    """
    n, own, marked = len(p.tag), p.own(), p.removed()
    text, _, length = p.branches(own)
    mains: list[int] = []
    for tag in ("main", "article") if p.markup else ():
        mains = mains or [e for e in range(1, n) if p.tag[e] == tag and not marked[e] and length[e]]
    given = bool(mains)
    if not mains and (e := main_branch(p, known, length)):
        mains = [e]
    inside, above = [False] * n, set()
    for e in mains:
        inside[e] = True
        while (e := p.parent[e]) >= 0 and e not in above:
            above.add(e)
    gone, pages = list(marked), 1
    for e in range(1, n):
        up = p.parent[e]
        inside[e] = inside[e] or inside[up]
        gone[e] = gone[e] or gone[up]
        if gone[e] or inside[e] or e in above or p.tag[e] not in BLOCK:
            continue
        part = p.tag[e] in PARTS or p.tag[e] in HEADINGS
        if part and not given:
            continue
        importance, met, _ = known.get((p.path[e], 0, ANY), (1.0, 1, 0.0))
        shared, among, _ = known.get((p.path[e], 1, text[e]), (1.0, 1, 0.0))
        pages = max(pages, among, met if importance < LEAST else 1)
        importance = 1.0 if part else min(importance, shared)
        if given:
            importance *= met / (met + MARKED)
        gone[e] = importance < LEAST
    if not mains:
        taken = sum(len(s) for e, s in own.items() if gone[e] and not marked[e])
        if taken > (1 - 1 / pages) * sum(len(s) for e, s in own.items() if not marked[e]):
            return marked, set()
    # headings, from the last block back: whether anything after it stays
    stays: dict[int, bool | None] = {}
    for e in range(n - 1, 0, -1):
        if p.tag[e] not in BLOCK or marked[e] or not length[e]:
            continue
        up = p.parent[e]
        if p.tag[e] in HEADINGS:
            if not inside[e] and stays.get(up) is False:
                gone[e] = True
            stays[up] = None
        else:
            stays[up] = bool(stays.get(up)) or not gone[e]
    return gone, above if given else set()


def extract(pages: DataFrame, markup: bool = True) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null html is an empty page with an empty text; a null url, or one without
    a host, makes the page a host of its own kind ("") whose pages are merged.
    Each row of pages that are copies gets its text. Malformed html is read to
    its end: what has no end tag ends with what holds it. Without ``markup`` the
    tree alone decides: no tag, role, class or id but those of scripts, styles
    and the like counts as noise or main part. Other columns are not read; an
    empty table gives an empty one.
    """
    spark = pages.sparkSession
    arrow_rows(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    table = cut(importances(page_nodes(rows, markup)), "style-tree")
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        t = table.toArrow().to_pydict()
        known: dict[str, Known] = {}
        for h, path, kind, value, *what in zip(*(t[c] for c in ("host", "path", "kind", "value", "importance", "n", "share"))):
            known.setdefault(h, {})[path, kind, value] = tuple(what)
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _texts(b, [shared.value.get(h, {}) for h in b.column("host").to_pylist()], markup)

        out = rows.mapInArrow(run, "page_id long, url string, text string")
    else:
        out = _by_join(rows, table, markup)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _texts(b: pa.RecordBatch, known: list[Known], markup: bool) -> pa.RecordBatch:
    texts = []
    for html, k in zip(b.column("html").to_pylist(), known):
        p = Page(html, markup)
        texts.append(p.text(*prune(p, k)))
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _by_join(rows: DataFrame, table: DataFrame, markup: bool) -> DataFrame:
    """For style trees too large to broadcast: each page meets the entries of
    its own nodes (as many as it has elements) by joins."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r, h, html in zip(b.column("row").to_pylist(), b.column("host").to_pylist(), b.column("html").to_pylist()):
                p = Page(html, markup)
                out.extend((r, h, *x[:3]) for x in _nodes(p, p.own()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()))], ["row", "host", "path", "kind", "value"])

    rows = rows.withColumn("row", F.xxhash64("page_id", "url", "html"))
    met = rows.dropDuplicates(["row"]).select("row", "host", "html").mapInArrow(nodes, "row long, host string, path long, kind int, value long").join(table, ["host", "path", "kind", "value"])
    entries = met.groupBy("row").agg(F.collect_list(F.struct("path", "kind", "value", "importance", "n", "share")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _texts(b, [{(e["path"], e["kind"], e["value"]): (e["importance"], e["n"], e["share"]) for e in es or ()} for es in b.column("entries").to_pylist()], markup)

    return rows.join(entries, "row", "left").select("page_id", "url", "html", "entries").mapInArrow(run, "page_id long, url string, text string")
