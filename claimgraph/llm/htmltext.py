"""Main-text extraction from HTML (operator 2): gradient-boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements with runs of text as leaves. Each node gets features: its depth, the density of
text, links and tags in its subtree, what its attributes and those above it say, and how it compares with its
siblings. The trees give the probability that a node holds main text. Decoding picks the most likely labelling in which no node
holds main text under one that holds none, by one pass up and one pass down.

The pages carry no labels, so the model is trained on generated pages of many layouts whose main text is known
(``examples``, with a fixed seed); it learns what attribute tokens say from the same pages.

Defined cases: null and empty html give an empty text; so does a page without text; broken markup is read as far as it
goes (unclosed elements end with their parent, an unclosed ``video``, ``select`` and the like at the next block's tag if that
comes first, an unclosed ``script``, ``style``, ``iframe`` or ``textarea`` with the page, as in HTML, an unfinished tag at the end is dropped); ``script``, ``style`` and the like are
never text (formulas and what an ``object`` holds are); white space inside a block, line breaks too, becomes one space; blocks are joined by two line feeds;
repeated rows are read alike; a null id is kept; extra columns are ignored, one named ``text`` gives way to the new one; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.boosting import Trees, fit
from claimgraph.llm.common import table

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_SILENT = frozenset("script style noscript template svg head title iframe canvas video audio select textarea datalist".split())
_RAW = frozenset("script style iframe textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "html body div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption form fieldset legend details summary address center hgroup menu dialog button label".split()
)
_CLOSES_P = _BLOCKS - {"button", "label"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SPEAKING = ("class", "id", "role", "itemprop", "aria-label", "data-component", "hidden", "style", "aria-hidden")
_PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "tokens", "depth", "text", "linked", "start", "main", "s")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple = (), depth: int = 0):
        self.tag, self.parent, self.kids, self.tokens, self.depth = tag, parent, [], tokens, depth
        self.text, self.linked, self.start, self.main, self.s = "", 0, 0, False, None
        if parent is not None:
            parent.kids.append(self)


def _tokens(attributes: str) -> tuple:
    out = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in _SPEAKING:
            value = value.strip("\"'")
            if name in ("hidden", "aria-hidden") and value.lower() != "false":
                out.append("hidden")
            elif name == "style":
                if "none" in value and "display" in value:
                    out.append("hidden")
            else:
                out += [t.lower() for t in _TOKEN.findall(value)]
    return tuple(out)


def _next_block(page: str, at: int) -> int:
    """Where the next block's tag (its parent's end, too) begins, or the page's end."""
    for m in _MARKUP.finditer(page, at):
        if m[2] and m[4] and m[2].lower() in _BLOCKS:
            return m.start()
    return len(page)


def parse(page: str) -> list[Node]:
    """All nodes in page order, the root first; leaves have the tag ``#text``."""
    root = Node("html", None)
    nodes, open_, parts, linked, in_link, at = [root], root, [], 0, False, 0

    def flush() -> None:
        nonlocal linked, in_link
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            leaf = Node("#text", open_, (), open_.depth + 1)
            leaf.text, leaf.linked, leaf.start = text, min(linked, len(text)), len(nodes)
            nodes.append(leaf)
        linked, in_link = 0, False

    def add(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if in_link:
            linked += len(raw)

    n = len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)
            add(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None or not m[4]:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in _SILENT and not closing:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in _RAW:
                    at = n
                elif tag not in ("head", "title"):  # never closed: what follows may be the page
                    at = _next_block(page, at)
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in _BLOCKS or tag == "hr":
            flush()
            if closing:
                node = open_
                while node is not None and node.tag != tag:
                    node = node.parent
                if node is not None and node.parent is not None:
                    open_ = node.parent
            elif tag in ("html", "body"):
                if tag == "body":
                    root.tokens += _tokens(m[3])
            elif tag != "hr":
                ends = _SAME.get(tag)
                node = open_
                while node.parent is not None:
                    if node.tag == "p" and tag in _CLOSES_P or ends and node.tag in ends:
                        open_ = node.parent
                        break
                    if node.tag in ("table", "ul", "ol", "dl", "div", "section", "article", "td", "th", "button"):
                        break
                    node = node.parent
                open_ = Node(tag, open_, _tokens(m[3]), min(open_.depth + 1, 60))
                open_.start = len(nodes)
                nodes.append(open_)
        elif tag in ("br", "img", "input") or tag == "td":
            parts.append(" ")
    flush()
    return nodes


FEATURES = 31


def features(nodes: list[Node], says: dict[str, float]) -> np.ndarray:
    """A row a node. Sums over subtrees go in one pass from the last node up."""
    for node in nodes:
        t = node.text
        if node.tag == "#text":
            words = t.count(" ") + 1
            stops = t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
            node.s = [len(t), node.linked, words, stops, 1, 0, words if words >= 12 else 0, 0, 0]
        else:
            node.s = [0, 0, 0, 0, 0, 1, 0, node.tag in _PROSE, node.tag in ("form", "button", "label", "fieldset")]
    for node in reversed(nodes[1:]):
        up, own = node.parent.s, node.s
        for i in range(9):
            up[i] += own[i]
    x = np.zeros((len(nodes), FEATURES))
    total = max(1, nodes[0].s[0])
    said: dict[int, tuple] = {}
    tags_of: dict[int, Counter] = {}
    for i, node in enumerate(nodes):
        chars, linked, words, stops, leaves, tags, long_words, prose, forms = node.s
        own = [says.get(t, 0.0) for t in (*node.tokens, "<" + node.tag)]
        low, high = min(own), max(own)
        up = said[id(node.parent)] if node.parent is not None else (0.0, 0.0, 0)
        said[id(node)] = (min(up[0], low), max(up[1], high), up[2] + (low < -0.7))
        parent = node.parent or node
        kids = parent.kids if node.parent is not None else [node]
        if node.parent is not None and id(parent) not in tags_of:
            tags_of[id(parent)] = Counter(k.tag for k in kids)
        around = parent.s
        x[i] = (
            node.depth, np.log1p(chars), linked / max(1, chars), np.log1p(words / max(1, leaves)), stops / max(1, words), np.log1p(leaves),
            chars / max(1, tags + leaves), chars / total, i / len(nodes), low, high, up[0], up[1], up[2],
            chars / max(1, around[0]), np.log1p(len(kids)), np.log1p(around[0]), around[1] / max(1, around[0]), np.log1p(around[2] / max(1, around[4])),
            (tags_of[id(parent)][node.tag] if node.parent is not None else 1) / len(kids), long_words / max(1, words), np.log1p(prose), forms > 0,
            node.tag == "#text", node.tag in _PROSE or parent.tag in _PROSE and node.tag == "#text", parent.tag in ("li", "dt", "dd", "td", "th"), np.log1p(tags),
            around[6] / max(1, around[2]), np.log1p(around[7]), around[8] > 0, parent.s[3] / max(1, parent.s[2]),
        )
    return x


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """The most likely labels with no main node under one that is not."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log(1 - p)
    place = {id(node): i for i, node in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].parent)]
        yes[up] += max(yes[i], no[i])
        no[up] += no[i]
    main = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        main[i] = yes[i] > no[i] and (i == 0 or main[place[id(node.parent)]])
    return main


# The generated pages. Words for attributes, as pages commonly have them.
_MAIN = "content article post entry story text body main page detail blog news copy prose reader single".split()
_OTHER = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination pager tabs toc links".split(),
    "header": "header masthead topbar banner branding logo site head hero".split(),
    "footer": "footer bottom copyright legal colophon foot imprint".split(),
    "side": "sidebar aside side widget related recommended popular trending rail more archive tags".split(),
    "notice": "cookie consent notice gdpr alert popup modal overlay privacy message paywall disclaimer".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner adsense teaser".split(),
    "form": "form search login signup subscribe newsletter contact register".split(),
    "comments": "comments comment discussion replies reply respond thread disqus feedback".split(),
    "share": "share social sharing buttons follow meta byline tools".split(),
}


def _example(rng: random.Random) -> tuple[str, list[str]]:
    """A page and its main blocks."""
    letters = "abcdefghijklmnopqrstuvwxyzäéñ"

    def words(n: int, stops: bool = True) -> str:
        out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]
        return " ".join(w + ("," if stops and rng.random() < 0.05 else "." if stops and rng.random() < 0.08 else "") for w in out).capitalize() + ("." if stops else "")

    def named(kind: str, tag: str | None = None) -> tuple[str, str]:
        plain = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "section")
        tag = tag or (plain if rng.random() < 0.5 else "div")
        said = rng.sample(_OTHER[kind], rng.choice((1, 1, 2)))
        how = rng.random()
        given = f' class="{rng.choice(("", "c-", "x_"))}{"-".join(said)}"' if how < 0.6 else f' id="{"_".join(said)}"' if how < 0.8 or tag == "div" else ""
        return f"<{tag}{given}>", f"</{tag}>"

    def links(n: int) -> str:
        items = [f'<a href="/{rng.randint(1, 99)}">{words(rng.randint(1, 4), False)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else rng.choice((" | ", " ", "<br>")).join(items)

    def other(kind: str) -> str:
        a, b = named(kind)
        if kind in ("nav", "header"):
            inner = links(rng.randint(2, 12)) + (f"<h1>{words(3, False)}</h1>" if kind == "header" and rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = f"&copy; {words(rng.randint(2, 30))}" + (links(rng.randint(1, 6)) if rng.random() < 0.6 else "")
        elif kind == "side":
            inner = f"<h3>{words(2, False)}</h3>" + links(rng.randint(2, 8)) + (f"<p>{words(rng.randint(5, 30))}</p>" if rng.random() < 0.4 else "")
        elif kind == "form":
            inner = f'<label>{words(2, False)}</label><input name="q"><button>{words(1, False)}</button>' + (f"<p>{words(rng.randint(4, 25))}</p>" if rng.random() < 0.5 else "")
        elif kind == "comments":
            inner = f"<h3>{words(2, False)}</h3>" + "".join(f'<div class="comment"><b>{words(2, False)}</b><p>{words(rng.randint(4, 60))}</p></div>' if rng.random() < 0.7 else f"<p>{words(rng.randint(4, 60))}</p>" for _ in range(rng.randint(1, 5)))
        elif kind == "share":
            inner = links(rng.randint(1, 5)) if rng.random() < 0.6 else words(rng.randint(2, 8), False)
        else:
            inner = words(rng.randint(3, 45)) if rng.random() < 0.5 else f"<p>{words(rng.randint(3, 45))}</p>" + (f"<button>{words(1, False)}</button>" if rng.random() < 0.4 else "")
        return a + inner + b

    main, body = [], []

    def block(tag: str, n: int) -> str:
        text = words(n, tag[0] != "h")
        main.append(text)
        inner = text if rng.random() < 0.6 else f"<b>{text}" if rng.random() < 0.3 else f'<a href="#">{text[: len(text) // 5]}</a>{text[len(text) // 5 :]}'
        return f"<{tag}>{inner}" + (f"</{tag}>" if rng.random() < 0.85 or tag[0] == "h" else "")

    if rng.random() < 0.8:
        body.append(block(rng.choice(("h1", "h1", "h2")), rng.randint(2, 14)))
    for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 15, 30))):
        r = rng.random()
        if r < 0.78:
            body.append(block("p", rng.choice((1, 3, 8, 20, 50, 90, 150))))
        elif r < 0.84:
            body.append(block(rng.choice(("h2", "h3")), rng.randint(1, 8)))
        elif r < 0.9:
            body.append("<ul>" + "".join(block("li", rng.randint(2, 25)) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif r < 0.93:
            body.append(block("blockquote", rng.randint(5, 50)))
        elif r < 0.95:
            body.append("<table><tr>" + "".join(block("td", rng.randint(1, 5)) for _ in range(3)) + "</tr></table>")
        else:
            body.append(other(rng.choice(("ad", "share", "form", "side", "notice"))))
    inside = "".join(body)
    if rng.random() < 0.3:
        inside = f'<div class="{rng.choice(_MAIN)}-{rng.choice(_MAIN)}">{inside}</div>'
    tail = "".join(other(k) for k in ("share", "comments", "side", "form") if rng.random() < 0.25)
    r = rng.random()
    if r < 0.45:
        whole = f"<article>{inside}{tail if rng.random() < 0.5 else ''}</article>"
    elif r < 0.6:
        whole = f"<main>{inside}</main>{tail}"
    elif r < 0.9:
        whole = f'<div {rng.choice(("class", "id"))}="{rng.choice(_MAIN)}{rng.choice(("", "-" + rng.choice(_MAIN)))}">{inside}{tail}</div>'
    else:
        whole = f"<div>{inside}</div>{tail}"
    before = "".join(other(k) for k in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < 0.45)
    after = "".join(other(k) for k in ("comments", "side", "ad", "nav", "footer", "notice") if rng.random() < 0.4)
    page = before + whole + after
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(("wrapper", "container", "layout", "row", "app"))}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{page}</body></html>", main


def examples(n: int = 500, seed: int = 7) -> list[tuple[list[Node], np.ndarray]]:
    """Parsed pages and, for every node, whether it holds main text."""
    out = []
    for k in range(n):
        page, main = _example(random.Random(seed * 100_003 + k))
        nodes = parse(page)
        left: dict[str, int] = {}
        for text in main:
            text = _SPACE.sub(" ", text).strip()
            left[text] = left.get(text, 0) + 1
        y = np.zeros(len(nodes), bool)
        place = {id(node): i for i, node in enumerate(nodes)}
        for i, node in enumerate(nodes):
            if node.tag == "#text" and left.get(node.text, 0):
                left[node.text] -= 1
                up: Node | None = node
                while up is not None:
                    y[place[id(up)]] = True
                    up = up.parent
        out.append((nodes, y))
    return out


def learn(pages: list[tuple[list[Node], np.ndarray]]) -> tuple[Trees, dict[str, float]]:
    """The trees, and what each attribute token says about main text."""
    seen: dict[str, list[int]] = {}
    for nodes, y in pages:
        for node, main in zip(nodes, y):
            for t in {*node.tokens, "<" + node.tag}:
                seen.setdefault(t, [0, 0])[int(main)] += 1
    says = {t: float(np.log((b + 1) / (a + 1))) for t, (a, b) in seen.items() if a + b >= 4}
    x = np.vstack([features(nodes, says) for nodes, _ in pages])
    return fit(x, np.concatenate([y for _, y in pages]).astype(float)), says


def texts(pages: list[str | None], trees: Trees, says: dict[str, float]) -> list[str]:
    parsed = [parse(p) if p else [] for p in pages]
    rows = [features(nodes, says) if len(nodes) > 1 else np.zeros((0, FEATURES)) for nodes in parsed]
    p = trees.probability(np.vstack(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes, r in zip(parsed, rows):
        if len(r):
            main = decode(nodes, p[at : at + len(r)])
            out.append("\n\n".join(node.text for node, m in zip(nodes, main) if m and node.tag == "#text"))
        else:
            out.append("")
        at += len(r)
    return out


AT_ONCE = 64


def extract(pages: DataFrame, html_col: str = "html", model: tuple | None = None) -> DataFrame:
    """``pages`` with ``text``; all its other columns are kept."""
    shared = pages.sparkSession.sparkContext.broadcast(model or learn(examples()))

    @F.pandas_udf("string")
    def main_text(column: pd.Series) -> pd.Series:
        values = column.tolist()
        out = [t for i in range(0, len(values), AT_ONCE) for t in texts(values[i : i + AT_ONCE], *shared.value)]
        return pd.Series(out, index=column.index, dtype=object)

    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != "text"], main_text(F.col(html_col).cast("string")).alias("text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
