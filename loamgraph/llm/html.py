"""Main text of HTML pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loamgraph.llm.common import map_arrow, sliced, table

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is never text of a page: what a browser shows only if it can't show something else counts so, too. Formulas
#: and image maps are text.
_RAW = frozenset("script style textarea title xmp noframes noembed iframe".split())
_SKIPPED = frozenset("head template svg object audio video canvas select button datalist noscript".split())
#: What may stand in a head, beside what is raw; any other start tag ends it.
_IN_HEAD = frozenset("head html base basefont bgsound link meta noscript template".split())
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: What an opening tag closes, and where the search for it ends.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|!--(?:-?>|.*?--!?>)|(!--)|[!?/][^>]*>)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BODY = re.compile(r"<body[\s/>]", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: White space, of which a run becomes one space; a decoded no-break space is a sign of its own, as words are cut at ASCII spaces.
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    """A block element: its own text comes in runs, cut by the blocks inside it."""

    __slots__ = ("tag", "names", "parent", "depth", "chars", "link_chars", "stops", "kids", "fields", "open_link")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, depth: int):
        self.tag, self.names, self.parent, self.depth = tag, names, parent, depth
        self.chars = self.link_chars = self.stops = self.kids = self.fields = 0


_NAMES: dict[str, tuple[str, ...]] = {}


def _names(attributes: str) -> tuple[str, ...]:
    got = _NAMES.get(attributes)
    if got is None:
        words = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower()
        got = tuple(dict.fromkeys(x for x in _SPLIT.split(words) if len(x) > 1))
        if len(_NAMES) > 20_000:
            _NAMES.clear()
        _NAMES[attributes] = got
    return got


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, and runs of text (the element's number, text) in page order."""
    # Without a body's tag all that isn't in the head is in the body.
    nodes = [Node("html" if _BODY.search(page) else "body", (), -1, 0)]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # every open element, with the block it belongs to
    parts: list[str] = []
    links = skipped = 0

    def cut() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip(" ")
        parts.clear()
        if text:
            runs.append((stack[-1][1], text))

    def add(text: str) -> None:
        if skipped or not text:
            return
        if "&" in text:
            text = _html.unescape(text)
        parts.append(text)
        node = nodes[stack[-1][1]]
        n = len(text) - text.count(" ")
        node.chars += n
        node.stops += text.count(".") + text.count(",")
        if links:
            node.link_chars += n

    def pop_to(at: int) -> None:
        nonlocal links, skipped
        if any(t in _BLOCKS for t, _ in stack[at:]):
            cut()
        for t, _ in stack[at:]:
            links -= t == "a"
            skipped -= t in _SKIPPED
        del stack[at:]

    at = 0
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[7]:  # a comment without an end
            at = len(page)
            break
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in _BLOCKS and stack[k][0] in _BLOCKS and stack[k][0] != "p":
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if stack[-1][0] == "head" and tag not in _IN_HEAD:
            pop_to(len(stack) - 1)
        elif tag == "body" and (heads := [k for k, (t, _) in enumerate(stack) if t == "head"]):
            pop_to(heads[0])
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in _BLOCKS or stack[k][0] in _SKIPPED:
                    break
        if tag in _IMPLIED:
            closed, until = _IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closed:
                    pop_to(k)
                    break
                if stack[k][0] in until:
                    break
        if tag in _VOID:
            if tag == "hr":
                cut()
            elif tag == "br":
                parts.append(" ")
            elif tag == "input":
                nodes[stack[-1][1]].fields += 1
            continue
        if tag == "html":
            continue
        block = stack[-1][1]
        if tag in _BLOCKS and not skipped:
            cut()
            nodes.append(Node(tag, _names(attributes), block, nodes[block].depth + 1))
            nodes[block].kids += 1
            block = len(nodes) - 1
        elif tag == "button" or tag == "select":
            nodes[block].fields += 1
        if attributes.endswith("/") and tag in _SKIPPED:
            continue
        stack.append((tag, block))
        links += tag == "a"
        skipped += tag in _SKIPPED
    add(page[at:])
    cut()
    return nodes, runs


def features(nodes: list[Node]) -> list[list[str]]:
    """What each node shows of itself and of all that is in it; parents come in by the tree's potentials."""
    chars, link, stops, fields = ([getattr(x, k) for x in nodes] for k in ("chars", "link_chars", "stops", "fields"))
    own, own_link = chars[:], link[:]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        link[p] += link[i]
        stops[p] += stops[i]
        fields[p] += fields[i]
    out = []
    for i, x in enumerate(nodes):
        n = chars[i]
        out.append(
            [
                "t:" + x.tag,
                "u:" + (x.tag if not x.names else "-"),
                "d:" + x.tag + (":" + nodes[x.parent].tag if i else ""),
                f"n:{min(n, 20_000).bit_length()}",
                f"l:{int(4 * link[i] / n + 0.5) if n else -1}",
                f"s:{min(6, int(100 * stops[i] / n)) if n else -1}",
                f"k:{min(x.kids, 8).bit_length()}",
                f"f:{min(fields[i], 2)}",
                f"o:{x.tag}:{(min(own[i], 20_000).bit_length() + 1) // 2}:{int(2 * own_link[i] / own[i] + 0.5) if own[i] else -1}",
                *("c:" + w for w in x.names),
                *(("p:" + w for w in nodes[x.parent].names) if i else ()),
            ]
        )
    return out


class Model:
    """Unary weights by feature, and a potential for each tag between its state and its parent's."""

    def __init__(self, weights: dict[str, float], pair: dict[str, tuple[float, float, float, float]]):
        self.weights, self.pair = weights, pair

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node: messages go up to the root and down again (sum-product)."""
        w = self.weights
        default = self.pair["*"]
        one = [1 / (1 + math.exp(-max(-30.0, min(30.0, w["bias"] + sum(w.get(f, 0.0) for f in fs))))) for fs in features(nodes)]
        n = len(nodes)
        up0, up1 = [1 - p for p in one], one[:]  # belief from below, in state 0 and 1
        psi = [self.pair.get(x.tag, default) for x in nodes]
        to0, to1 = [1.0] * n, [1.0] * n  # message to the parent
        for i in range(n - 1, 0, -1):
            a00, a01, a10, a11 = psi[i]
            b0, b1 = up0[i], up1[i]
            m0, m1 = a00 * b0 + a01 * b1, a10 * b0 + a11 * b1
            s = m0 + m1
            to0[i], to1[i] = m0, m1 = m0 / s, m1 / s
            p = nodes[i].parent
            q0, q1 = up0[p] * m0, up1[p] * m1
            s = q0 + q1 or 1.0
            up0[p], up1[p] = max(q0 / s, 1e-12), max(q1 / s, 1e-12)
        out = [0.0] * n
        out[0] = up1[0] / (up0[0] + up1[0])
        down0, down1 = up0[:], up1[:]
        for i in range(1, n):
            p = nodes[i].parent
            a00, a01, a10, a11 = psi[i]
            c0, c1 = down0[p] / to0[i], down1[p] / to1[i]  # the parent without this child
            d0, d1 = c0 * a00 + c1 * a10, c0 * a01 + c1 * a11
            q0, q1 = up0[i] * d0, up1[i] * d1
            s = q0 + q1
            down0[i], down1[i] = max(q0 / s, 1e-12), max(q1 / s, 1e-12)
            out[i] = q1 / s
        return out

    def extract(self, page: str) -> str:
        nodes, runs = parse(page)
        p = self.marginals(nodes)
        return "\n\n".join(text for i, text in runs if p[i] > 0.5)


def fit(pages: list[tuple[str, str]], rounds: int = 250) -> Model:
    """From labelled pages: (html, mark), where each text run of the main text holds the mark and no other does.

    A block with runs is content if they hold the mark; a block without is if most blocks in it are.
    """
    rows, labels, edges = [], [], {}
    for page, mark in pages:
        nodes, runs = parse(page)
        good, bad = [0] * len(nodes), [0] * len(nodes)
        for i, text in runs:
            if mark in text:
                good[i] += 1
            else:
                bad[i] += 1
        own = [g + b > 0 for g, b in zip(good, bad, strict=True)]
        y = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            y[i] = int(good[i] > bad[i] * (1 if own[i] else 0))
            if i and nodes[i].tag not in ("body",):
                p = nodes[i].parent
                if not own[p]:
                    good[p] += good[i] > 0
                    bad[p] += bad[i] > 0 or not good[i]
        for i, x in enumerate(nodes):
            if not own[i]:
                y[i] = int(good[i] > 0 and good[i] >= bad[i] and x.tag not in ("html", "body"))
        for i, (x, fs) in enumerate(zip(nodes, features(nodes), strict=True)):
            rows.append(["bias", *fs])
            labels.append(y[i])
            if i:
                for t in (x.tag, "*"):
                    edges.setdefault(t, np.full((2, 2), 0.5))[y[x.parent], y[i]] += 1
    names = {f: k for k, f in enumerate(dict.fromkeys(f for fs in rows for f in fs))}
    flat = np.array([names[f] for fs in rows for f in fs])
    row = np.repeat(np.arange(len(rows)), [len(fs) for fs in rows])
    y = np.array(labels, dtype=float)
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(rounds):
        z = np.bincount(row, w[flat], len(rows))
        g = np.bincount(flat, (1 / (1 + np.exp(-z)) - y)[row], len(names)) / len(rows) + 1e-5 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    pair = {}
    for t, c in edges.items():
        # Joint over product of marginals: what the tie adds to what each node shows of itself.
        joint = c / c.sum()
        lift = joint / np.outer(joint.sum(1), joint.sum(0))
        lift = np.clip(lift, 0.02, 50)
        pair[t] = tuple(float(v) for v in lift.ravel())
    return Model({f: float(w[k]) for f, k in names.items()}, pair)


def labelled_pages(n: int = 900, seed: int = 5) -> list[tuple[str, str]]:
    """Pages made by rule, with the main text marked: the training set of the default model.

    The text lies in an article, a main element, a named or plain div, section or table cell, right in the body, or in no
    element at all; its parts in sections and divs inside these, up to three deep. Menus, notices, adverts, sidebars and forms
    stand before and after it and within it; comments and footers follow.
    """
    rnd = random.Random(seed)
    mark = "␂"
    out = []
    for _ in range(n):
        styles = (["", "", "", "", ".", ","], [""], ["", "", "", "", "", "", "", "", "", "."], [".", ",", ""], ["!!", "!!", ".!!"])
        style = rnd.choice(styles)

        def words(k: int, ends=styles[0]) -> str:
            ws = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) + rnd.choice(ends) for _ in range(k)]
            if ends is style and rnd.random() < 0.05:
                ws = [ws[0]] * k
            return " ".join(ws).capitalize()

        def c(k: int) -> str:
            return mark + words(k, style)

        def named(*names: str) -> str:
            name = rnd.choice(names)
            return rnd.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rnd.choice(["box", "wrap", "inner", "block"])}"'])

        def menu(tag: str = "ul") -> str:
            return f"<{tag}>" + "".join(f'<li><a href="/{i}">{words(rnd.randint(1, 2))}</a>' + rnd.choice(["", "</li>"]) for i in range(rnd.randint(2, 8))) + f"</{tag}>"

        def ad() -> str:
            return f"<{(t := rnd.choice(['div', 'div', 'section', 'aside']))}{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>" + rnd.choice([words(rnd.randint(3, 30)), f"<p>{words(rnd.randint(5, 30))}</p>", f'<a href="#">{words(6)}</a>']) + f"</{t}>"

        def notice() -> str:
            return f"<div{rnd.choice([named('notice', 'cookie', 'cookie-notice', 'consent', 'alert', 'cookie-banner', 'gdpr', 'popup', 'modal'), ' role=%salert%s' % (chr(34), chr(34))])}>" + rnd.choice([f"<p>{words(rnd.randint(6, 30))}</p>", words(rnd.randint(6, 30))]) + rnd.choice(["", "<button>ok</button>"]) + "</div>"

        def sidebar() -> str:
            t = rnd.choice(["aside", "aside", "div", "section"])
            return f"<{t}{named('sidebar', 'side', 'related', 'widget', 'recommended', 'trending') if t != 'aside' or rnd.random() < 0.5 else ''}><h3>{words(2)}</h3>" + rnd.choice([menu(), f"<p>{words(rnd.randint(5, 40))}</p>", menu() + f"<p>{words(20)}</p>"]) + f"</{t}>"

        def form() -> str:
            return f"<form{rnd.choice(['', named('search', 'newsletter', 'signup', 'subscribe', 'login', 'contact')])}>" + rnd.choice(["", f"<p>{words(rnd.randint(4, 15))}</p>", f"<label>{words(2)}</label>", f"<div>{words(6)}</div>"]) + '<input name="q"><button>go</button></form>'

        def comments() -> str:
            t, u = rnd.choice(["div", "section", "aside"]), rnd.choice(["div", "li", "article", "p"])
            one = named("comment", "reply", "user-comment")
            item = lambda: f"<{u}{one}>" + (words(rnd.randint(5, 60)) if u == "p" else rnd.choice([f"<p>{words(rnd.randint(5, 60))}</p>", f"<h4>{words(2)}</h4><p>{words(rnd.randint(5, 60))}</p>", words(rnd.randint(5, 60))])) + f"</{u}>"
            return f"<{t}{named('comments', 'discussion', 'responses', 'comment-list', 'disqus', 'user-comments')}><h3>{words(2)}</h3>" + "".join(item() for _ in range(rnd.randint(1, 6))) + f"</{t}>"

        def paragraph() -> str:
            k = rnd.choice([1, 3, 8, 20, 60, 120])
            kind = rnd.random()
            if kind < 0.7:
                return rnd.choice([f"<p>{c(k)}</p>", f"<p>{c(k)}", f"<p><b>{c(k)}<br><p>{c(k)}</p>", f'<p>{c(k)} <a href="#">{words(2)}</a> {words(3)}</p>', f"<div>{c(k + 5)}</div>"])
            if kind < 0.78:
                return f"<h{(h := rnd.randint(2, 4))}>{c(rnd.randint(1, 6))}</h{h}>"
            if kind < 0.86:
                return "<ul>" + "".join(f"<li>{c(rnd.randint(2, 20))}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>"
            if kind < 0.91:
                return f"<blockquote>{rnd.choice([c(k), f'<p>{c(k)}</p>'])}</blockquote>"
            if kind < 0.95:
                return f"<pre>{c(k)}</pre>"
            return "<table>" + "".join(f"<tr><td>{c(2)}</td><td>{c(1)}</td></tr>" for _ in range(rnd.randint(1, 4))) + "</table>"

        body = [rnd.choice([f"<h1>{c(rnd.randint(1, 10))}</h1>", "", f"<h1>{c(rnd.randint(3, 12))}</h1>", f"<header><h1>{c(4)}</h1></header>"])]
        rest = []
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 8, 15, 30])):
            rest.append(paragraph())
            if rnd.random() < 0.1:
                rest.append(rnd.choice([ad, form, sidebar, notice])())
        # Parts of the text lie in sections and divs of their own, some in others.
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            a = rnd.randint(0, len(rest))
            b = rnd.randint(a, min(len(rest), a + 6))
            if b > a:
                t = rnd.choice(["section", "section", "div"])
                name = rnd.choice(["", "", "", named("section", "chapter", "text", "body", "intro", "part", "row", "col", "block", "inner")])
                rest[a:b] = [f"<{t}{name}>" + rnd.choice(["", f"<h2>{c(rnd.randint(1, 5))}</h2>", f"<h3>{c(rnd.randint(1, 5))}</h3>"]) + "".join(rest[a:b]) + f"</{t}>"]
        body += rest
        if not body[0] and len(body) == 1:
            body.append(f"<p>{c(5)}</p>")
        inside = "".join(body) + (comments() if rnd.random() < 0.12 else "") + (f"<div{named('share', 'social', 'tags', 'author', 'pagination')}>{menu()}</div>" if rnd.random() < 0.1 else "") + (f"<footer>{words(5)}</footer>" if rnd.random() < 0.1 else "")
        kind = rnd.random()
        if kind < 0.45:
            main = f"<article{rnd.choice(['', '', named('post', 'entry', 'story')])}>{inside}</article>"
        elif kind < 0.6:
            main = f"<main{rnd.choice(['', named('content', 'main')])}>{inside}</main>"
        elif kind < 0.75:
            main = f"<div{named('content', 'article', 'post', 'entry', 'story', 'post-content', 'article-body', 'main')}>{inside}</div>"
        elif kind < 0.82:
            main = f"<{(t := rnd.choice(['div', 'section', 'td']))}>{inside}</{t}>"
            main = f"<table><tr>{main}</tr></table>" if t == "td" else main
        elif kind < 0.92:
            main = inside
        else:  # no element around the text
            main = rnd.choice([c(rnd.randint(20, 80)), f"{c(30)}<br><br>{c(12)}", inside + c(rnd.randint(20, 60))])
        if kind < 0.75 and rnd.random() < 0.2:
            main = f"<{(t := rnd.choice(['div', 'main', 'section']))}{rnd.choice(['', named('container', 'page', 'wrapper')])}>{main}</{t}>"
        before = [x for x, p in ((rnd.choice([f"<nav>{menu()}</nav>", f"<div{named('menu', 'navbar', 'nav', 'navigation', 'breadcrumb', 'breadcrumbs')}>{menu()}</div>", menu(), f"<nav><a href='/'>{words(1)}</a> <a href='/a'>{words(1)}</a></nav>"]), 0.85), (f"<header{rnd.choice(['', named('header', 'site-header', 'masthead', 'top')])}>{rnd.choice(['<h1>', '<div>', '<p>'])}{words(3)}</header>", 0.4), (notice(), 0.2), (form(), 0.2), (ad(), 0.5), (sidebar(), 0.15)) if rnd.random() < p]
        after = [x for x, p in ((comments(), 0.3), (sidebar(), 0.3), (ad(), 0.25), (form(), 0.15), (notice(), 0.1), (f"<footer{rnd.choice(['', named('footer', 'site-footer', 'copyright', 'colophon')])}>{rnd.choice(['&copy; ' + words(rnd.randint(3, 25)), '<p>' + words(rnd.randint(3, 25)) + '</p>', menu()])}</footer>", 0.9), (f"<div{named('footer', 'copyright', 'legal', 'disclaimer')}>{words(12)}</div>", 0.15)) if rnd.random() < p]
        rnd.shuffle(before)
        out.append((f"<html><head><title>{words(4)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>", mark))
    return out


_DEFAULT: list[Model] = []


def default_model() -> Model:
    if not _DEFAULT:
        _DEFAULT.append(fit(labelled_pages()))
    return _DEFAULT[0]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text (the main text) and n_chars of every page.

    A null or empty page, and one without content, gives an empty text. The whole page is read; broken
    markup is parsed as far as it goes. Rows are independent, so repeated rows give repeated results; null ids and
    URLs stay null, an empty table gives no rows, and other columns are not read. A page of any length is read by one task.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [model.extract(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op9_dom_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() of all pages by the default model."""
    return extract(table(spark, sf_dir, "pages"))
