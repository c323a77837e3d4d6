"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with text blocks as leaves. Every node is content or boilerplate; its potential comes from its own features (tag, class and
id words, text length, link density, position), and each parent-child edge has a 2 x 2 potential by the child's kind. Sum-product messages go up
and down the tree once, which gives exact marginals; text blocks whose marginal is above one half are the main text. Weights are trained by exact gradient
(observed minus expected counts, from the same marginals) on labelled pages that a generator makes from many layouts.

Defined cases: null and empty html give the empty text; broken markup is read as far as it goes (unclosed elements end with their parent); long pages are read whole in linear time;
repeated rows give equal rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import slices, table

BLOCK = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th article section nav aside header footer main form fieldset figure figcaption blockquote pre address details summary dialog center menu head button select option".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements whose inside is no markup, and which show no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
#: A start tag of the key ends an open element of the values.
ENDS = {t: frozenset(["p"]) for t in BLOCK - {"button", "select", "option", "html", "body", "head"}} | {
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]), "body": frozenset(["head"]),
}
#: Where the search for such an element stops.
WALLS = frozenset("ul ol dl table div article section nav aside header footer main form body html blockquote td th figure fieldset details dialog".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<!--|<[!?][^>]*>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MAY_HIDE = re.compile(r"hidden|style", re.I)
#: An attribute's name and value; a quote that nothing closes runs to the end.
NAMED = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Words in class and id names, by what they usually mark.
NAMES = {
    w: k
    for k, words in enumerate(
        (
            "ad ads advert adverts advertisement sponsor sponsored promo promoted banner adsense",
            "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip",
            "footer foot copyright legal colophon",
            "header masthead topbar head logo",
            "sidebar aside side rail widget related recommended recommendations more popular trending",
            "comment comments reply replies disqus respond discussion",
            "cookie cookies consent gdpr notice notices alert popup modal overlay banner paywall",
            "form newsletter subscribe subscription signup login search share sharing social",
            "article content main post entry body story text prose",
        )
    )
    for w in words.split()
}
KIND_OF_TAG = {t: i for i, t in enumerate("p h div section article main nav aside header footer form li list table quote pre figure other".split())}


def tag_kind(tag: str) -> int:
    if tag[0] == "h" and len(tag) == 2 and tag[1] in "123456":
        return KIND_OF_TAG["h"]
    same = {"ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dt": "li", "dd": "li", "blockquote": "quote", "fieldset": "form", "button": "form", "select": "form", "option": "form", "dialog": "aside", "figcaption": "figure", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "tfoot": "table"}
    return KIND_OF_TAG.get(same.get(tag, tag), KIND_OF_TAG["other"])


TAG_KIND = {t: tag_kind(t) for t in BLOCK}
N_KINDS = len(KIND_OF_TAG)
#: Features: bias, kind of tag, name words, then those of text blocks. An edge's kind: the child's tag kind, or a text block.
N_NAMES = 1 + max(NAMES.values())
F_NAME, F_TEXT = 1 + N_KINDS, 1 + N_KINDS + N_NAMES
N_FEATURES = F_TEXT + 12
TEXT_EDGE = N_KINDS


class Page:
    """parent, edge kind and features of each node, in document order (a parent stands before its children); text by leaf."""

    __slots__ = ("edges", "features", "marks", "parents", "texts")

    def __init__(self):
        self.parents, self.edges, self.features, self.texts, self.marks = [-1], [TAG_KIND["html"]], [[0, 1 + TAG_KIND["html"]]], [None], [None]


def hides(attributes: str) -> bool:
    """Whether a start tag's attributes hide its element: the attribute hidden (with any value, as in HTML), aria-hidden=true, or a style whose display is none."""
    if not MAY_HIDE.search(attributes):
        return False
    found: dict[str, str] = {}
    for a in NAMED.finditer(attributes):
        found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")  # the first of a name counts
    if "hidden" in found or html.unescape(found.get("aria-hidden", "")).strip().lower() == "true":
        return True
    display, strong = "", False
    for part in COMMENT.sub(" ", html.unescape(found.get("style", ""))).split(";"):
        name, _, value = part.partition(":")
        if name.strip().lower() == "display":
            value, mark, _ = value.partition("!")
            if mark or not strong:
                display, strong = value.strip().lower(), bool(mark)
    return display == "none"


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and their nodes; inline ones keep the node around them
    opened, since, walls = Counter(), [Counter()], [0]  # open elements by name: all, and those above each open wall; the walls' depths
    pieces: list[str] = []
    linked = inside_link = 0
    shut = 0  # depth at which a hidden element began

    def flush() -> None:
        nonlocal linked
        if not pieces:
            return
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            parent = stack[-1][1]
            n = len(text)
            share = linked / max(1, sum(map(len, pieces)))
            dots = text.count(".") + text.count(",") + text.count("!") + text.count("?")
            page.parents.append(parent)
            page.edges.append(TEXT_EDGE)
            f = [0, F_TEXT + (0 if n < 15 else 1 if n < 40 else 2 if n < 100 else 3 if n < 300 else 4), F_TEXT + 5 + (0 if share < 0.05 else 1 if share < 0.5 else 2), F_TEXT + (8 if dots else 9)]
            if text[-1] in ".!?…":
                f.append(F_TEXT + 10)
            if "©" in text or "copyright" in text[:60].lower():
                f.append(F_TEXT + 11)
            page.features.append(f)
            page.texts.append(text)
            page.marks.append(None)
        pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal shut, inside_link
        if any(t in BLOCK for t, _ in stack[depth:]):
            flush()
        inside_link -= sum(t == "a" for t, _ in stack[depth:])
        while len(stack) > depth:
            t, _ = stack.pop()
            opened[t] -= 1
            if t in WALLS:
                walls.pop()
                since.pop()
            else:
                since[-1][t] -= 1
        if shut > depth - 1 and shut:
            shut = 0 if depth <= shut else shut

    def put(tag: str, node: int) -> None:
        stack.append((tag, node))
        opened[tag] += 1
        if tag in WALLS:
            walls.append(len(stack) - 1)
            since.append(Counter())
        else:
            since[-1][tag] += 1

    at, size, last = 0, len(source), source.rfind(">")
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not shut:
            pieces.append(source[at:lt])
            if inside_link:
                linked += lt - at
        if lt == size:
            break
        m = TAG.match(source, lt) if lt < last else None
        if m is None:
            m = LOOSE.match(source, lt) if lt < last else None
            if m is None:
                if lt > last and lt + 1 < size and (source[lt + 1].isalpha() or source[lt + 1] in "/!"):
                    break  # a tag that the page's end cuts off
                if not shut:
                    pieces.append("<")
                at = lt + 1
                continue
        at = m.end()
        if m.lastindex is None:
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            continue
        tag = m[2].lower()
        if m[1]:
            # counts tell whether the element is open at all, so that each step down the stack closes what it passes
            if (opened if tag in BLOCK else since[-1])[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(source, at) if not m[3].endswith("/") else None
            at = end.end() if end else (at if m[3].endswith("/") else size)
            continue
        if tag in VOID:
            if not shut:
                pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in BLOCK:
            if not m[3].endswith("/"):
                put(tag, stack[-1][1])
                inside_link += tag == "a"
                if m[3] and not shut and hides(m[3]):
                    shut = len(stack) - 1
            continue
        flush()
        ended = ENDS.get(tag)
        while ended:
            if any(since[-1][t] > 0 for t in ended):
                depth = len(stack) - 1
                while stack[depth][0] not in ended:
                    depth -= 1
                close(depth)
            elif walls[-1] and stack[walls[-1]][0] in ended:
                close(walls[-1])
            else:
                break
        page.parents.append(stack[-1][1])
        kind = TAG_KIND[tag]
        page.edges.append(kind)
        f = [0, 1 + kind]
        mark = None
        if m[3]:
            named = set()
            for a in ATTRIBUTE.finditer(m[3]):
                value = a[1] or a[2] or a[3] or ""
                mark = value
                named |= {NAMES[w] for w in map(str.lower, PART.findall(value)) if w in NAMES}
            f += [F_NAME + k for k in named]
        page.features.append(f)
        page.texts.append(None)
        page.marks.append(mark)
        put(tag, len(page.parents) - 1)
        if m[3] and not shut and hides(m[3]):
            shut = len(stack) - 1
    flush()
    return page


def messages(page: Page, node: list[float], edge: list[tuple[float, float, float, float]]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product over the tree. Beliefs are log-odds of content; edge[k] holds exp-potentials (parent, child) 00, 01, 10, 11.

    Gives each node's belief, its belief from its own subtree, and what came down to it.
    """
    n = len(node)
    own, up, down = node[:], [0.0] * n, [0.0] * n
    exp, log, parents, edges = math.exp, math.log, page.parents, page.edges
    for i in range(n - 1, 0, -1):
        e00, e01, e10, e11 = edge[edges[i]]
        b = own[i]
        x = exp(b if b < 60 else 60)
        up[i] = log((e10 + e11 * x) / (e00 + e01 * x))
        own[parents[i]] += up[i]
    belief = own[:]
    for i in range(1, n):
        e00, e01, e10, e11 = edge[edges[i]]
        b = belief[parents[i]] - up[i]
        x = exp(b if b < 60 else 60)
        down[i] = log((e01 + e11 * x) / (e00 + e10 * x))
        belief[i] = own[i] + down[i]
    return belief, own, down


def potentials(weights: tuple[np.ndarray, np.ndarray]):
    w, pair = weights
    return w.tolist(), [tuple(row) for row in np.exp(pair).tolist()]


def marginals(page: Page, w: list[float], edge) -> list[float]:
    return messages(page, [sum([w[k] for k in f]) for f in page.features], edge)[0]


def main_text(source: str | None, w: list[float], edge) -> str:
    """Text blocks with marginals of one half or more, in page order."""
    if not source:
        return ""
    page = parse(source)
    belief = marginals(page, w, edge)
    return "\n".join([t for t, b in zip(page.texts, belief, strict=True) if t is not None and b >= 0])


# --- training


def generated(rng: random.Random) -> str:
    """A labelled page: content blocks carry the class word zzgood, which no feature reads."""
    word = lambda: "".join(rng.choice(("an", "er", "th", "ing", "on", "re", "st", "ou")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    links = lambda a, b: "".join(f"<li><a href='/x'>{words(1, 2)}</a></li>" for _ in range(rng.randint(a, b)))
    sentence = lambda: words(3, 25).capitalize() + "."
    name = lambda *x: f' {rng.choice(("class", "id"))}="{rng.choice(x)}"'
    bad = {
        "nav": lambda: rng.choice((f"<nav><ul>{links(2, 8)}</ul></nav>", f"<div{name('menu', 'nav', 'navbar', 'breadcrumb')}>{words(1, 6)}<ul>{links(1, 6)}</ul></div>", f"<ul{name('menu', 'nav-links')}>{links(2, 6)}</ul>")),
        "ad": lambda: f"<div{name('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{rng.choice((sentence(), f'<p>{sentence()}</p>', words(1, 8)))}</div>",
        "side": lambda: rng.choice((f"<aside><h3>{words(1, 4)}</h3><p>{sentence()}</p><ul>{links(1, 5)}</ul></aside>", f"<div{name('sidebar', 'related', 'widget')}><h4>{words(1, 3)}</h4><ul>{links(1, 5)}</ul><p>{sentence()} {sentence()}</p></div>")),
        "note": lambda: f"<div{name('cookie-notice', 'cookie', 'notice', 'popup', 'consent')}><p>{sentence()}</p><button>{word()}</button></div>",
        "form": lambda: rng.choice((f"<form><label>{words(1, 4)}</label><input><p>{sentence()}</p><button>{word()}</button></form>", f"<div{name('newsletter', 'subscribe', 'share', 'login')}><p>{sentence()}</p></div>")),
        "comments": lambda: f"<{(t := rng.choice(('div', 'section')))}{name('comments', 'comment-list', 'replies')}><h3>{words(1, 3)}</h3>" + "".join(f"<div class='comment'><p>{sentence()} {sentence()}</p></div>" for _ in range(rng.randint(1, 4))) + f"</{t}>",
    }
    foot = lambda: rng.choice((f"<footer>&copy; {words(1, 5)} &middot; {sentence()}</footer>", f"<footer><p>{sentence()}</p><ul>{links(1, 4)}</ul></footer>", f"<div{name('footer', 'legal')}><p>Copyright {words(2, 9)}.</p></div>"))
    head = lambda: rng.choice((f"<header><h1>{words(1, 4)}</h1><p>{words(2, 6)}</p></header>", f"<div{name('header', 'masthead', 'logo')}>{words(1, 5)}</div>", ""))

    odd, style = rng.choice((0, 0, 0.1, 0.5, 1.0, 1.0)), rng.randint(0, 9)

    def block() -> str:
        x = rng.random()
        if x < odd:
            kinds = (words(1, 6), words(10, 90), (word() + " ") * rng.randint(5, 40), words(2, 9).upper() + "!!", words(1, 2) + ".", words(1, 3))
            return f"<p class=zzgood>{kinds[style if style < 6 else rng.randint(0, 5)]}</p>"
        x = rng.random()
        if x < 0.65:
            return f"<p class=zzgood>{' '.join(sentence() for _ in range(rng.randint(1, 7)))}</p>"
        if x < 0.75:
            return f"<h2 class=zzgood>{words(1, 6)}</h2>"
        if x < 0.83:
            return f"<{(t := rng.choice(('ul', 'ol')))}>" + "".join(f"<li class=zzgood>{words(2, 15)}</li>" for _ in range(rng.randint(1, 5))) + f"</{t}>"
        if x < 0.88:
            return f"<blockquote class=zzgood>{sentence()}</blockquote>"
        if x < 0.91:
            return f"<pre class=zzgood>{words(3, 20)}</pre>"
        if x < 0.94:
            return f"<table><tr><td class=zzgood>{words(1, 4)}</td><td class=zzgood>{words(1, 4)}</td></tr></table>"
        if x < 0.97:
            return f"<p class=zzgood>{words(1, 4)} <a href='/y'>{words(1, 4)}</a> {words(0, 9)}</p>"
        return f"<p class=zzgood>{words(1, 2)}.</p>"

    inner = [f"<h1 class=zzgood>{words(1, 9)}</h1>"] * (rng.random() < 0.8) + [block() for _ in range(rng.randint(1, 20))]
    for k in rng.sample(sorted(bad), rng.randint(0, 2)):
        if rng.random() < 0.5:
            inner.insert(rng.randint(1, len(inner)), bad[k]())
    if rng.random() < 0.15:
        inner.insert(rng.randint(0, 1), f"<header><p>{words(1, 6)}</p></header>")
    wrap = rng.choice(("article", "article", "article", "main", "section", "div", "div"))
    text = f"<{wrap}{name('content', 'article', 'post', 'entry', 'main') if wrap in ('div', 'section') and rng.random() < 0.9 else ''}>{''.join(inner)}</{wrap}>"
    if rng.random() < 0.3:
        text = f"<{(t := rng.choice(('div', 'main', 'section')))}{name('page', 'wrap', 'x')}>{text}{bad['comments']() if rng.random() < 0.3 else ''}</{t}>"
    before = [head(), *(bad[k]() for k in rng.sample(sorted(bad), rng.randint(0, 3)) if k != "comments")]
    after = [bad[k]() for k in rng.sample(sorted(bad), rng.randint(0, 2))]
    rng.shuffle(before)
    return f"<html><head><title>{words(1, 3)}</title></head><body>{''.join(before)}{text}{''.join(after)}{foot() if rng.random() < 0.8 else ''}</body></html>"


def labels(page: Page) -> list[int]:
    """Of a generated page: text blocks in marked elements are content, and so is each element that holds more content text than other."""
    n = len(page.parents)
    good, rest, y = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if page.texts[i] is not None:
            is_good = page.marks[p] == "zzgood"
            good[i], rest[i] = (1, 0) if is_good else (0, 1)
        good[p] += good[i]
        rest[p] += rest[i]
        y[i] = int(good[i] > 0)
    y[0] = 1
    return y


@lru_cache(maxsize=2)
def fitted(pages: int = 260, rounds: int = 16, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge weights by stochastic gradient on the exact log-likelihood."""
    rng = random.Random(seed)
    cases = [(p, labels(p)) for p in (parse(generated(rng)) for _ in range(pages))]
    w, pair = np.zeros(N_FEATURES), np.zeros((N_KINDS + 1, 4))
    squares, pair_squares = np.full_like(w, 0.1), np.full_like(pair, 0.1)
    for _ in range(rounds):
        rng.shuffle(cases)
        for page, y in cases:
            ws, edge = potentials((w, pair))
            node = [sum([ws[k] for k in f]) for f in page.features]
            belief, own, _ = messages(page, node, edge)
            step, pair_step = -0.0005 * w, -0.0005 * pair
            for i, f in enumerate(page.features):
                off = y[i] - 1 / (1 + math.exp(-max(-60.0, min(60.0, belief[i]))))
                for k in f:
                    step[k] += off
                if i:
                    e, p = page.edges[i], page.parents[i]
                    e00, e01, e10, e11 = edge[e]
                    child = math.exp(max(-60.0, min(60.0, own[i])))
                    up = math.log((e10 + e11 * child) / (e00 + e01 * child))
                    over = math.exp(max(-60.0, min(60.0, belief[p] - up)))
                    joint = np.array((e00, e01 * child, e10 * over, e11 * child * over))
                    pair_step[e] -= joint / joint.sum()
                    pair_step[e, 2 * y[p] + y[i]] += 1
            squares += step**2
            pair_squares += pair_step**2
            w += 0.3 * step / np.sqrt(squares)
            pair += 0.3 * pair_step / np.sqrt(pair_squares)
    return w, pair


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """key and text of every page. No shuffle; memory follows one page."""
    w, edge = potentials(fitted())

    def run(batches):
        for batch in slices(batches, source):
            texts = [main_text(s, w, edge) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "t", "n"])

    return pages.select(key, source).mapInArrow(run, f"`{key}` long, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: main text of every page with its url."""
    w, edge = potentials(fitted())

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(s, w, edge) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return table(spark, sf_dir, "pages", "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
