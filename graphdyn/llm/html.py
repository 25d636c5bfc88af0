"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements; each has features (kind of element,
attribute tokens of its own and above it, depth, text density of its subtree,
share of link text, statistics of its siblings). Gradient-boosted trees give the
probability that a block belongs to the article. The decoder picks the most
likely labels of all blocks in which a dropped block has no kept descendant.

The trees are fitted on a bounded sample: ``TRAIN_PAGES`` pages of the table (by
hash of the html), where only blocks inside unmistakable elements count, and
``TEMPLATES`` generated layouts, which hold the kinds of block a table may lack.
Each page is parsed and decided on its own; the model is a few kilobytes.

Edge cases: null and empty html give the empty text; broken markup (unclosed or
cut tags, stray ends) is read as browsers do, roughly; a page without elements is
one block; very long pages are parsed whole; repeated rows and other columns change
nothing, and columns named like the result move it to a fresh name; an empty table
gives an empty result. Script, style and the
like, comments and attributes never give text.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import Sent, bound_batches, fresh, unit_hash

TRAIN_PAGES = 1500
TEMPLATES = 700
TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 24

# Names of elements and attribute tokens
SKIPPED = {"script", "style", "noscript", "template", "svg", "head", "iframe", "object", "canvas", "math"}
RAW = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
KINDS = (
    {"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside", "dialog"},
    {"form", "button", "input", "select", "textarea", "label", "fieldset", "option"},
    {"div", "section"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"ul", "ol", "li", "dl", "dt", "dd"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"},
    {"figure", "figcaption", "details", "summary", "address"}, {"html", "body"})
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags}
BAD = frozenset(
    "ad ads advert advertisement adsense banner promo promotion promoted sponsor sponsored nav navbar navigation "
    "menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer foot copyright colophon sidebar side "
    "aside rail widget cookie cookies consent gdpr notice notices alert warning popup modal overlay toast subscribe "
    "subscription newsletter signup login register form search share sharing social related recommended "
    "recommendations more trending popular pager pagination comment comments reply replies disqus discussion "
    "respond feedback reactions tags legal disclaimer privacy toolbar skip hidden print outbrain taboola".split())
GOOD = frozenset("article articlebody content main post entry story text body page prose maincontent hentry".split())

_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_NO_P = set().union(*KINDS) - KINDS[5] - {"html", "body", "td", "th", "tr", "li"} | {"form", "ul", "ol", "hr"}
_SCOPE = {"table", "div", "section", "article", "main", "aside", "nav", "header", "footer", "body", "ul", "ol", "html",
          "td", "th"}
_tag = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_attr = re.compile(r"(class|id|role|itemprop|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                   re.IGNORECASE)
_split = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    __slots__ = ("tag", "up", "depth", "parts", "kids", "bad", "good", "link", "own", "first", "hide")

    def __init__(self, tag: str, up: Node | None, attrs: str):
        self.tag, self.up, self.parts, self.kids = tag, up, [], []
        self.depth = up.depth + 1 if up else 0
        self.bad = self.good = self.link = self.own = self.hide = 0
        if attrs:
            for m in _attr.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "style":
                    self.hide |= "display:none" in value.replace(" ", "").lower()
                elif "hidden" in name:
                    self.hide |= value.lower() != "false"
                else:
                    for word in _split.findall(value):
                        word = word.lower()
                        self.bad += word in BAD
                        self.good += word in GOOD


def parse(page: str) -> list[Node]:
    """Block elements in page order, the root first. ``parts`` holds text and child blocks in order."""
    root = Node("html", None, "")
    nodes, stack = [root], [("html", root)]  # inline elements stand for the block around them
    skip, link, at = "", 0, 0

    def say(text: str) -> None:
        if text and not skip:
            node, text = stack[-1][1], entities.unescape(text)
            node.parts.append(text)
            size = len("".join(text.split()))
            node.own += size
            node.link += size if link else 0

    def close(i: int) -> None:
        nonlocal link
        link -= sum(name == "a" for name, _ in stack[i:])
        del stack[i:]

    for m in _tag.finditer(page):
        if m.start() < at:
            continue
        say(page[at: m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        end = m[1] or m[4]
        if skip:
            skip = "" if end and name == skip or name == "body" and skip == "head" else skip
            if skip or end:
                continue
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name not in _SCOPE and stack[i][0] in _SCOPE:
                    break
            continue
        attrs = m[3] if m[2] else m[6]
        if name in SKIPPED:
            if not attrs.endswith("/"):
                skip = name
            if name in RAW:
                stop = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
                at, skip = (stop.end() if stop else len(page)), ""
            continue
        if name == "br" or name == "hr":
            stack[-1][1].parts.append(" ")
        if name in VOID and name != "input" or name == "html":
            continue
        if name in _CLOSES or name in _NO_P:
            shut = _CLOSES.get(name, {"p"}) | ({"p"} if name in _NO_P else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in shut:
                    close(i)
                    if name not in ("tr", "td", "th"):
                        break
                elif i < len(stack) and stack[i][0] in _SCOPE - {"td", "th"}:
                    break
        block = name in KIND or name == "span" and ("class" in attrs or "id=" in attrs)
        node = stack[-1][1]
        if block:
            node = Node(name, stack[-1][1], attrs)
            stack[-1][1].parts.append(node)
            stack[-1][1].kids.append(node)
            nodes.append(node)
        if name not in VOID:
            stack.append((name, node))
            link += name == "a"
        if name in RAW and name not in VOID:
            stop = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            say(page[at: stop.start() if stop else len(page)])
            at = stop.start() if stop else len(page)
    say(page[at:])
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node of one page."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    up = np.array([place[id(x.up)] if x.up else 0 for x in nodes])
    own = np.array([(x.own, x.link, x.bad, x.good, x.hide, x.depth, len(x.kids)) for x in nodes], float)
    below = np.ones((n, 3))
    below[:, :2] = own[:, :2]
    above = np.zeros((n, 4))
    kind = np.array([KIND.get(x.tag, len(KINDS)) for x in nodes])
    for i in range(n - 1, 0, -1):
        below[up[i]] += below[i]
    mark = np.column_stack([np.minimum(own[:, 2], 1), np.minimum(own[:, 3], 1), (kind >= 1) & (kind <= 5), kind == 0])
    above[0] = mark[0]
    twins, order = np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        if i:
            above[i] = above[up[i]] + mark[i]
        seen: dict[int, int] = {}
        for j, kid in enumerate(x.kids):
            k = place[id(kid)]
            seen[kind[k]] = seen.get(kind[k], 0) + 1
            order[k] = j
        for kid in x.kids:
            k = place[id(kid)]
            twins[k] = seen[kind[k]]
    text, links, size = below.T
    kin = own[up, 6]
    return np.column_stack([
        kind[:, None] == np.arange(len(KINDS) + 1)[None, :], mark[:, :2], above, above - mark,
        own[:, 4], np.minimum(own[:, 5], 30), np.log1p(text), links / np.maximum(1, text),
        np.log1p(size), np.log1p(text / size), np.log1p(own[:, 0]), own[:, 6], twins,
        order / np.maximum(1, kin), np.log1p(kin), text / max(1.0, text[0])])


class Trees:
    """Logistic gradient boosting on binned features; complete trees of ``DEPTH`` levels."""

    def __init__(self, bias: float, which: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.bias, self.which, self.cut, self.leaf = bias, which, cut, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        bias, inner = float(np.log(share / (1 - share))), (1 << DEPTH) - 1
        which, cut = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf)
        leaf = np.zeros((TREES, inner + 1))
        score = np.full(len(y), bias)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h, at = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                base, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    cell = (at - base) * (len(c) + 1) + binned[:, f]
                    gs = np.bincount(cell, g, width * (len(c) + 1)).reshape(width, -1)
                    hs = np.bincount(cell, h, width * (len(c) + 1)).reshape(width, -1)
                    left_g, left_h = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    all_g, all_h = gs.sum(1)[:, None], hs.sum(1)[:, None]
                    gain = (left_g ** 2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1)
                            - all_g ** 2 / (all_h + 1))
                    top = gain.argmax(1)
                    won = gain[np.arange(width), top] > best
                    best[won] = gain[np.arange(width), top][won]
                    which[t, base: base + width][won] = f
                    cut[t, base: base + width][won] = c[top[won]]
                at = 2 * at + 1 + (x[np.arange(len(x)), which[t, at]] > cut[t, at])
            at -= inner
            leaf[t] = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
            score += leaf[t][at]
        return cls(bias, which, cut, leaf)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.bias), np.arange(len(x))
        for which, cut, leaf in zip(self.which, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, which[at]] > cut[at])
            score += leaf[at - len(cut)]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a dropped node has no kept descendant; the root stays."""
    place = {id(x): i for i, x in enumerate(nodes)}
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    below, best = drop.copy(), keep.copy()
    for i in range(len(nodes) - 1, -1, -1):
        for kid in nodes[i].kids:
            k = place[id(kid)]
            below[i] += below[k]
            best[i] += max(below[k], best[k])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i, x in enumerate(nodes[1:], 1):
        kept[i] = kept[place[id(x.up)]] and best[i] > below[i]
    return kept


def blocks(nodes: list[Node], kept: np.ndarray) -> list[str]:
    """Texts of the kept blocks; a child block ends the text before it."""
    keep = {id(x) for x, k in zip(nodes, kept) if k}
    out, run, todo = [], [], [iter(nodes[0].parts)]

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    ends = [True]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            if ends.pop():
                flush()
        elif isinstance(part, str):
            run.append(part)
        elif id(part) in keep:
            block = part.tag != "span"
            if block:
                flush()
            todo.append(iter(part.parts))
            ends.append(block)
        elif part.tag != "span":
            flush()
    return out


class Extractor:
    def __init__(self, trees: Trees):
        self.trees = trees

    def extract(self, pages: list[str]) -> list[list[str]]:
        trees = [parse(p) for p in pages]
        odds = self.trees.log_odds(np.concatenate([features(t) for t in trees])) if trees else np.empty(0)
        out, at = [], 0
        for nodes in trees:
            out.append(blocks(nodes, decode(nodes, odds[at: at + len(nodes)])))
            at += len(nodes)
        return out


# --- training ---------------------------------------------------------------

def weak_labels(nodes: list[Node]) -> np.ndarray:
    """1 inside an article element, 0 inside an unmistakable other one, -1 if unclear."""
    out, place = np.full(len(nodes), -1), {id(x): i for i, x in enumerate(nodes)}
    out[0] = 1
    for i, x in enumerate(nodes[1:], 1):
        up, kind = out[place[id(x.up)]], KIND.get(x.tag, 99)
        if up == 0 or kind in (1, 3, 4, 5) or x.bad and not x.good or x.hide or kind == 2 and up != 1:
            out[i] = 0
        elif kind == 0 or up == 1 and x.up.up:
            out[i] = 1
        elif kind == 12:
            out[i] = 1
    return out


_BAD_TAGS = ("nav", "header", "footer", "aside", "form", "div", "section", "ul", "table", "p")


def template(rng: random.Random) -> tuple[str, str]:
    """A generated page and the text of its article; block labels follow from the ``x`` marks."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    bad, good = sorted(BAD), sorted(GOOD)
    dress = lambda t: f' {rng.choice(("class", "id"))}="{rng.choice(("", word() + "-"))}{t}"'

    def junk() -> str:
        tag = rng.choice(_BAD_TAGS)
        plain = tag in ("div", "section", "ul", "table", "p")
        attrs = dress(rng.choice(bad)) if plain or rng.random() < 0.5 else ""
        kind, inner = rng.random(), ""
        if kind < 0.35:
            inner = "<ul>" + "".join(f'<li><a href="/">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"
        elif kind < 0.75:
            inner = "".join(f"<{t}>{words(2, 40)}.</{t}>" for t in rng.choices(("p", "div", "h3"), k=rng.randint(1, 4)))
        else:
            inner = words(1, 25)
        if tag == "form":
            inner = f'<label>{word()}</label><input type="text"><button>{word()}</button>' + inner * (rng.random() < 0.3)
        if tag in ("ul", "table", "p"):
            inner = {"ul": f"<li>{words(1, 6)}</li>" * rng.randint(1, 6), "p": words(3, 30),
                     "table": f"<tr><td>{words(1, 4)}</td></tr>"}[tag]
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def prose() -> str:
        kind = rng.random()
        if kind < 0.7:
            inner = words(1, 80) + "."
            if rng.random() < 0.2:
                inner += f' <a href="/">{words(1, 4)}</a> {words(1, 9)}.'
            return f"<p>{inner}</p>" if rng.random() < 0.9 else f"<div>{inner}</div>"
        if kind < 0.8:
            return f"<h2>{words(1, 7)}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{words(2, 15)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        return f"<blockquote>{words(5, 30)}</blockquote>" if kind < 0.95 else (
            f"<table><tr><td>{words(1, 9)}</td><td>{words(1, 5)}</td></tr></table>")

    body = [f"<h1>{words(1, 12)}</h1>"] + [prose() for _ in range(rng.randint(1, 12))]
    if rng.random() < 0.4:
        body.insert(rng.randrange(len(body) + 1), f'<x>{junk()}</x>')
    if rng.random() < 0.4:
        body.append(f'<x>{junk()}</x>')
    tag = rng.choice(("article", "article", "main", "div", "div", "section"))
    attrs = dress(rng.choice(good)) if tag in ("div", "section") or rng.random() < 0.3 else ""
    main = f"<{tag}{attrs}>{''.join(body)}</{tag}>"
    if rng.random() < 0.3:
        main = f"<div{dress(rng.choice(('wrapper', 'container', 'layout', 'main', 'content')))}>{main}</div>"
    before = "".join(f"<x>{junk()}</x>" for _ in range(rng.randint(0, 4)))
    after = "".join(f"<x>{junk()}</x>" for _ in range(rng.randint(0, 5)))
    return f"<html><body>{before}{main}{after}</body></html>"


def template_rows(n: int = TEMPLATES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(n):
        page = template(rng)
        # the first pass reads the marks, the second the page without them
        marks = parse(re.sub(r"<x><(\w+)([^>]*)>(.*?)</\1></x>", lambda m: f"<{m[1]}{m[2]} hidden>{m[3]}</{m[1]}>", page))
        nodes = parse(re.sub(r"</?x>", "", page))
        label = np.ones(len(nodes))
        place = {id(x): i for i, x in enumerate(marks)}
        for i, x in enumerate(marks[1:], 1):
            label[i] = not x.hide and label[place[id(x.up)]]
        if len(marks) == len(nodes):
            xs.append(features(nodes))
            ys.append(label)
    return np.concatenate(xs), np.concatenate(ys)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    xs, ys = template_rows()
    xs, ys = [xs], [ys]
    for page in pdf["h"].sort_values():
        if page:
            nodes = parse(page)
            label = weak_labels(nodes)
            xs.append(features(nodes)[label >= 0])
            ys.append(label[label >= 0])
    t = Trees.fit(np.concatenate(xs), np.concatenate(ys).astype(float))
    return pd.DataFrame({"tree": range(TREES), "bias": t.bias, "which": list(t.which), "cut": list(t.cut),
                         "leaf": list(t.leaf)})


def fit(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> Extractor:
    """Trees fitted in one task on a bounded sample; a row without html holds the place of an empty table."""
    n = pages.count()
    h = pages.select(F.col(html).alias("h"))
    draw = unit_hash("html", F.md5(F.col("h")))
    # equal pages are drawn together, so they count once
    sample = (h.filter(draw < train_pages / max(1, n)) if n > train_pages else h).distinct()
    sample = sample.unionByName(pages.sparkSession.createDataFrame([("",)], "h string"))
    rows = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        _fit, "tree int, bias double, which array<long>, cut array<double>, leaf array<double>").orderBy("tree").collect()
    part = lambda name: np.array([r[name] for r in rows])
    return Extractor(Trees(rows[0]["bias"], part("which"), part("cut"), part("leaf")))


def added(pages: DataFrame) -> list[str]:
    return fresh(pages, "blocks")


def extract(pages: DataFrame, model: Extractor, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the article's blocks under a fresh name (``added``)."""
    bound_batches(pages.sparkSession)
    shared = Sent(pages.sparkSession, model)
    (name,), (t,) = added(pages), fresh(pages, "t")
    rows = pages.select(*dict.fromkeys(keep), F.col(html).alias(t))
    schema = [f"`{n}` {k}" for n, k in rows.drop(t).dtypes] + [f"`{name}` array<string>"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list[list[str]] = []
            pages_ = [x if isinstance(x, str) else "" for x in pdf[t]]
            for i in range(0, len(pages_), 500):
                found += shared.value.extract(pages_[i: i + 500])
            yield pdf.drop(columns=t).assign(**{name: found})

    return rows.mapInPandas(run, ", ".join(schema))
