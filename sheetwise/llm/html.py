"""Main text of web pages with a tree-structured graphical model.

A page is parsed into a tree of block elements (and of inline elements that
carry a class, id or role).  Every node has a hidden label, main text or not.
Potentials: P(label | label of the parent, kind of
element) along each edge, and per node
the likelihood of its class words, of the length of its text and of the share
of links in it.  Sum-product message passing, upward and then downward, gives
each node's marginal; text is kept if the node that owns it is more likely main
than not.  All tables are counted on labelled pages, in ``train``.

Labelled pages: generated pages whose regions are labelled (``labelled_pages``,
fixed seed, many layouts and class names), and a bounded sample of the table's
own pages (``SAMPLE_PAGES`` pages with the smallest hash of their id) that have
exactly one ``article``, labelled by it.  Extraction itself treats every page of
the table, whole.

Output text: character references decoded, white space inside a block turned
into one space, blocks trimmed and joined by two line feeds in page order.
``br`` is white space.  Defined results: null or empty html gives an empty text;
a page cut off in the middle is read as far as it goes (a cut-off tag is
dropped); unclosed and wrongly nested tags are closed as browsers do for p, li,
table parts and the like; nesting of any depth is handled without recursion;
a tag whose quotes never close is text; a page of any length, however broken, is
read whole in time in proportion to it; a node at exactly 1/2 is not kept;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# Fixed values of HTML: element kinds and what an opening tag closes.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SILENT = frozenset("script style title textarea iframe noembed noframes noscript template select button head datalist".split())
CLOSES_P = BLOCKS - {"body", "caption", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("tbody", "thead", "tfoot", "tr"), "tfoot": ("tbody", "thead", "tr"), "thead": ("tbody", "tfoot", "tr"),
          "option": ("option",), "body": ("head",)}
WALLS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])} | {
    t: frozenset(["table"]) for t in ("tr", "td", "th", "tbody", "thead", "tfoot")} | {"option": frozenset(["select"]), "p": frozenset(["td", "th", "table", "caption", "button", "object"])}

OPENING = re.compile(r"<!--|</?[a-zA-Z][^\s/>]*|<[!?/]")
COMMENT_END = re.compile(r"--!?>")
SPECIAL = re.compile(r"[>\"']")
NAMES = re.compile(r"""\b(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Tree:
    """Nodes in page order (a parent comes before its children)."""

    def __init__(self):
        self.parent, self.tag, self.words, self.label = [-1], ["#page"], [()], [None]
        #: (node, block number, text, inside a link)
        self.texts: list[tuple[int, int, str, bool]] = []

    def add(self, parent: int, tag: str, names: dict) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(tuple({w.lower() for k in ("class", "id", "role") for w in WORDS.findall(names.get(k, ""))}))
        self.label.append(names.get("data-label"))
        return len(self.parent) - 1


class Tags:
    """Ends of the tags of a page.  A tag ends at the first ``>`` outside quotes;
    one whose quotes or ``>`` never close is no tag.  Where a scan stands outside
    quotes determines what follows, so a place from which one scan failed fails
    every other; and between two special characters all scans agree on the next
    one.  So the work is linear in the page, however broken it is."""

    def __init__(self, html: str):
        self.html, self.failed, self.gap = html, set(), (0, -1)
        self.last = {q: html.rfind(q) for q in "\"'"}

    def special(self, at: int) -> int:
        """The next of > " ' (the length of the page if there is none)."""
        low, high = self.gap
        if not low <= at <= high:
            m = SPECIAL.search(self.html, at)
            self.gap = at, m.start() if m else len(self.html)
        return self.gap[1]

    def end(self, at: int) -> int:
        """The place of the ``>`` that closes a tag whose name ends at ``at``; -1 if none does."""
        seen = []
        while True:
            at = self.special(at)
            if at < len(self.html) and self.html[at] == ">":
                return at
            seen.append(at)
            if at == len(self.html) or at in self.failed or self.last[self.html[at]] == at:
                self.failed.update(seen)
                return -1
            at = self.html.find(self.html[at], at + 1) + 1


def parse(html: str) -> Tree:
    tree, tags = Tree(), Tags(html)
    stack = [("#page", 0)]  # open elements and the node that owns their text
    open_ = defaultdict(list)  # places in the stack, by tag
    open_blocks = []
    block, links, silent, at, look, end = 0, 0, 0, 0, 0, len(html)
    last_opening = html.rfind("<")

    def close(i: int) -> None:
        nonlocal block, links, silent
        for tag, _ in reversed(stack[i:]):
            open_[tag].pop()
            links -= tag == "a"
            silent -= tag in SILENT
            if tag in BLOCKS:
                block += 1
                open_blocks.pop()
        del stack[i:]

    def nearest(names) -> int:
        return max((open_[n][-1] for n in names if open_[n]), default=-1)

    def close_open(names, walls) -> None:
        """Closes the nearest open element of these names, if no wall is nearer."""
        i = nearest(names)
        if i > nearest(walls):
            close(i)

    def text(piece: str) -> None:
        if piece and not silent:
            if "&" in piece:
                piece = unescape(piece)
            tree.texts.append((stack[-1][1], block, piece, links > 0))

    while at < end:
        m = OPENING.search(html, look)
        if not m:
            break
        start, opening = m.start(), m[0]
        if opening == "<!--":
            closed = COMMENT_END.search(html, m.end())
            stop = closed.end() if closed else end
            tag = ""
        else:
            tag = opening.lstrip("</").lower()
            found = tags.end(m.end()) if tag and opening[1] not in "!?" else -1
            if found >= 0:
                stop, attributes = found + 1, html[m.end():found]
            elif opening[1] in "!?/":
                stop, tag = html.find(">", m.end()) + 1 or end, ""
            elif start == last_opening:
                stop, tag = end, ""
            else:  # no tag: the character is text
                look = start + 1
                continue
        text(html[at:start])
        at = look = stop
        if not tag:
            continue
        if opening[1] == "/":
            if tag == "br":
                text(" ")
            elif open_[tag]:
                i = open_[tag][-1]
                # an inline end tag does not close the blocks around it
                if tag in BLOCKS or tag in SILENT or not open_blocks or open_blocks[-1] < i:
                    close(i)
            continue
        if tag in VOID:
            if tag in BLOCKS:
                close_open(("p",), WALLS["p"])
                block += 1
            elif tag in ("br", "wbr"):
                text(" " if tag == "br" else "")
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = look = stop.end() if stop else end
            continue
        if tag in ("html", "body") and open_[tag]:
            continue
        if tag in CLOSES_P:
            close_open(("p",), WALLS["p"])
        names = CLOSES.get(tag)
        while names:
            before = len(stack)
            close_open(names, WALLS.get(tag, frozenset()))
            if len(stack) == before:
                break
        found = {k.lower(): a or b or c for k, a, b, c in NAMES.findall(attributes)} if "=" in attributes else {}
        owner = stack[-1][1]
        if tag in BLOCKS:
            block += 1
        if tag in BLOCKS or found:
            owner = tree.add(owner, tag, found)
        open_[tag].append(len(stack))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((tag, owner))
        links += tag == "a"
        silent += tag in SILENT
    text(html[at:])
    return tree


# ---- the model ------------------------------------------------------------------

def _kind(tree: Tree, i: int) -> str:
    """What the edge to the parent is told apart by: tag, named or not, and
    whether it hangs directly from the body."""
    top = tree.parent[i] < 0 or tree.tag[tree.parent[i]] in ("#page", "html", "body")
    return tree.tag[i] + "*" * bool(tree.words[i]) + "^" * top


def _bucket(n: int) -> int:
    return min(10, n.bit_length())


def features(tree: Tree) -> list[tuple[str, ...]]:
    """Per node: class words, length of its own text, share of links in it."""
    size, linked = [0] * len(tree.tag), [0] * len(tree.tag)
    for node, _, piece, link in tree.texts:
        n = len(piece) if len(piece) > 40 else len(piece.strip())
        size[node] += n
        linked[node] += n * link
    return [(*(f"word {w}" for w in tree.words[i]), *((f"chars {_bucket(n)}", f"links {4 * linked[i] // n}") if (n := size[i]) else ())) for i in range(len(tree.tag))]


def train(pages: list[tuple[Tree, list[int]]]) -> dict:
    """Counts smoothed by pseudo-counts: edge[tag][parent label] = P(main), and
    unary[feature] = (P(feature | not main), P(feature | main)) as a ratio."""
    edge, overall = defaultdict(lambda: [[0, 0], [0, 0]]), [[1, 1], [1, 1]]
    seen, nodes, kinds = defaultdict(lambda: [0, 0]), [0, 0], defaultdict(lambda: [0, 0])
    for tree, labels in pages:
        for i, found in enumerate(features(tree)):
            y = labels[i]
            if i:
                edge[_kind(tree, i)][labels[tree.parent[i]]][y] += 1
                overall[labels[tree.parent[i]]][y] += 1
            nodes[y] += 1
            for f in found:
                seen[f][y] += 1
                kinds[f.split()[0]][y] += 1
    share = [n[1] / sum(n) for n in overall]
    prob = lambda n, p: (n[1] + 2 * p) / (sum(n) + 2)
    total = {f: nodes if f.startswith("word ") else kinds[f.split()[0]] for f in seen}
    unary = {f: math.log((n[1] + 0.5) / (total[f][1] + 5)) - math.log((n[0] + 0.5) / (total[f][0] + 5)) for f, n in seen.items()}
    return {"edge": {t: tuple(prob(n[p], share[p]) for p in (0, 1)) for t, n in edge.items()}, "other": tuple(share), "unary": unary}


def marginals(tree: Tree, model: dict) -> list[float]:
    """P(main) of every node: messages to the root, then from the root."""
    n, unary, edge, other = len(tree.tag), model["unary"], model["edge"], model["other"]
    local = []
    for found in features(tree):
        x = math.exp(max(-30.0, min(30.0, sum(unary.get(f, 0.0) for f in found))))
        local.append((1 / (1 + x), x / (1 + x)))
    chance = [edge.get(_kind(tree, i), other) for i in range(n)]
    below = list(local)  # evidence of the subtree, per label of the node
    up = [(1.0, 1.0)] * n  # message to the parent, per label of the parent
    for i in range(n - 1, 0, -1):
        b0, b1 = below[i]
        m0, m1 = (p * b1 + (1 - p) * b0 for p in chance[i])
        j = tree.parent[i]
        up[i] = m0, m1
        a0, a1 = below[j][0] * m0, below[j][1] * m1
        s = a0 + a1
        below[j] = a0 / s, a1 / s
    out = [(1.0, 0.0)] * n  # the page itself is not main text
    for i in range(1, n):
        q0, q1 = out[tree.parent[i]]
        # the parent's belief without what this node told it
        q0, q1 = q0 / max(up[i][0], 1e-300), q1 / max(up[i][1], 1e-300)
        p0, p1 = chance[i]
        y0 = ((1 - p0) * q0 + (1 - p1) * q1) * below[i][0]
        y1 = (p0 * q0 + p1 * q1) * below[i][1]
        s = y0 + y1
        out[i] = (y0 / s, y1 / s) if s else (0.5, 0.5)
    return [m for _, m in out]


def extract(html: str, model: dict) -> str:
    tree = parse(html)
    keep = marginals(tree, model)
    blocks: dict[int, list[str]] = {}
    for node, block, piece, _ in tree.texts:
        if keep[node] > 0.5:
            blocks.setdefault(block, []).append(piece)
    return "\n\n".join(t for b in blocks.values() if (t := " ".join("".join(b).split())))


# ---- labelled pages ---------------------------------------------------------------

SAMPLE_PAGES, GENERATED_PAGES = 100, 800
# Usual class names of page regions.
REGIONS = {
    "nav": ["nav", "navbar", "menu", "main-menu", "site-nav", "navigation", "breadcrumb", "breadcrumbs", "topbar", "tabs", "pagination", "toc"],
    "header": ["header", "site-header", "page-header", "masthead", "banner", "top", "logo", "branding"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "bottom", "legal", "colophon"],
    "aside": ["sidebar", "side", "aside", "widget", "related", "related-posts", "recommended", "trending", "rail", "popular"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "banner-ad", "adsense"],
    "notice": ["notice", "cookie", "cookie-notice", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "warning-banner"],
    "form": ["form", "search", "search-form", "login", "signup", "contact-form"],
    "share": ["share", "social", "share-buttons", "tags", "meta-links"],
    "comments": ["comments", "comment", "comment-list", "responses", "replies", "discussion", "reply", "disqus", "respond"],
}
MAIN_NAMES = ["content", "main", "article", "post", "entry", "story", "post-content", "entry-content", "article-body", "body-text", "story-body", "main-content", "text"]
_VOWELS, _HEADS = "aeiou", "bcdfglmnprstv"


def labelled_pages(n: int = GENERATED_PAGES, seed: int = 4) -> list[str]:
    """Pages whose regions carry data-label 1 (main) or 0."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_HEADS) + r.choice(_VOWELS) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    prose = lambda: ". ".join(words(3, 18) for _ in range(r.choice([1, 1, 2, 3, 5, 9]))) + "."
    link = lambda: f'<a href="/x">{words(1, 3)}</a>'
    one = lambda x: f"<p>{x}</p>" if r.random() < .6 else f"<div>{x}</div>" if r.random() < .3 else x
    listed = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"

    def shell(kind: str, inside: str) -> str:
        name = r.choice(REGIONS[kind])
        tag = r.choice([kind if kind in ("nav", "header", "footer", "aside", "form") else "section" if kind == "comments" else "div", "div", "section" if kind == "aside" else "div"])
        attr = r.choice(["class", "class", "id"])
        named = f' {attr}="{name}"' if tag in ("div", "section") or r.random() < .4 else ""
        return f'<{tag}{named} data-label="0">{inside}</{tag}>'

    def chrome(kind: str) -> str:
        if kind == "comments":
            item = lambda: r.choice([f'<div class="comment"><p>{prose()}</p></div>', f'<article class="comment"><p>{prose()}</p></article>', f"<li>{one(prose())}</li>"])
            return shell(kind, f"<h3>{words(1, 2)}</h3>" + "".join(item() for _ in range(r.randint(1, 4))))
        if kind == "form":
            return shell(kind, f"<label>{words(1, 2)}</label><input><button>{word()}</button>" + (one(words(2, 6)) if r.random() < .4 else ""))
        if kind in ("ad", "notice"):
            return shell(kind, one(prose()) + (link() if r.random() < .5 else ""))
        if kind == "footer":
            return shell(kind, r.choice([f"&copy; {words(1, 3)} &middot; {prose()}", one(words(2, 9)), listed()]))
        if kind == "header":
            return shell(kind, f"<h1>{words(1, 3)}</h1>" + one(words(2, 6)) + (listed() if r.random() < .4 else ""))
        if kind == "aside":
            return shell(kind, f"<h3>{words(1, 3)}</h3>" + r.choice([listed(), one(prose()), one(prose()) + listed()]))
        return shell(kind, listed() if r.random() < .8 else " ".join(link() for _ in range(4)))

    def main() -> str:
        parts = [f"<h1>{words(2, 9)}</h1>"] if r.random() < .8 else []
        for _ in range(r.randint(1, 9)):
            x = r.random()
            parts.append(f"<h2>{words(1, 6)}</h2>" if x < .12 else f"<ul>{''.join(f'<li>{words(2, 15)}</li>' for _ in range(3))}</ul>" if x < .2 else f"<blockquote>{one(prose())}</blockquote>" if x < .25
                         else f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 3)}</td></tr></table>" if x < .29 else f"<figure><figcaption>{words(2, 9)}</figcaption></figure>" if x < .33 else f"<pre>{prose()}</pre>" if x < .35
                         else f"<p><b>{words(1, 9)}<br>" if x < .42 else f"<div>{prose()}</div>" if x < .47 else f"<p>{prose()}{' ' + link() if r.random() < .2 else ''}</p>")
        if r.random() < .2:
            parts[0] = f"<header>{parts[0]}</header>"
        for kind in ("ad", "share", "aside", "form", "footer", "nav", "notice", "comments"):
            if r.random() < .1:
                parts.insert(r.randint(1, len(parts)), chrome(kind))
        return "".join(parts)

    out = []
    for _ in range(n):
        kinds = [k for k in REGIONS if r.random() < .55]
        before = [k for k in kinds if k not in ("footer", "comments", "share")]
        after = [k for k in kinds if k not in before] + [k for k in before if k in ("ad", "aside", "notice") and r.random() < .5]
        body = main()
        x = r.random()
        if x < .55:
            body = f'<article{r.choice(["", "", f" class={chr(34)}{r.choice(MAIN_NAMES)}{chr(34)}"])} data-label="1">{body}</article>'
        elif x < .7:
            body = f'<main data-label="1">{body}</main>'
        elif x < .92:
            body = f'<div {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}" data-label="1">{body}</div>'
        page = "".join(chrome(k) for k in before) + body + "".join(chrome(k) for k in after)
        if x >= .92:  # no container: the body itself is the article
            page = page.replace(body, f'<section data-label="1">{body}</section>' if r.random() < .5 else f'<div data-label="1">{body}</div>')
        elif r.random() < .3:
            page = f'<div class="{r.choice(["wrapper", "container", "page", "layout"])}">{page}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>")
    return out


def labels_of(tree: Tree) -> list[int]:
    """Labels are those of the nearest labelled element, else not main."""
    y = [0] * len(tree.tag)
    for i in range(1, len(y)):
        y[i] = int(tree.label[i]) if tree.label[i] in ("0", "1") else y[tree.parent[i]]
    return y


_CHROME_TAGS = frozenset(["nav", "aside", "footer", "form"])
_CHROME_WORDS = frozenset(w for names in REGIONS.values() for x in names for w in WORDS.findall(x)) - {"top", "bottom", "header", "meta", "list", "page", "main", "slot", "site", "side", "links", "buttons", "posts", "warning", "tags", "tabs"}


def labels_by_article(tree: Tree) -> list[int] | None:
    """Labels of a page by its only article; None if there is not exactly one."""
    if tree.tag.count("article") != 1:
        return None
    y = [0] * len(tree.tag)
    for i in range(1, len(y)):
        chrome = tree.tag[i] in _CHROME_TAGS or not _CHROME_WORDS.isdisjoint(tree.words[i])
        y[i] = int(tree.tag[i] == "article" or y[tree.parent[i]] and not chrome)
    return y


def fit(pages: DataFrame) -> dict:
    trees = [(t, labels_of(t)) for t in map(parse, labelled_pages())]
    own = [(t, labels_by_article(t)) for t in map(parse, C.sample(pages, "page_id", "html", SAMPLE_PAGES))]
    return train(trees + [x for x in own if x[1]])


# ---- on Spark -----------------------------------------------------------------------

def extract_pages(pages: DataFrame, model: dict) -> DataFrame:
    def task(batches):
        for batch in batches:
            texts = [extract(h, model) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(task, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    pages = C.table(spark, sf_dir, "pages")
    return extract_pages(pages, fit(pages))
