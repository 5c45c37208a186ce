"""A page's blocks and text runs as nodes with features.

Inline markup makes no nodes: the text between two block boundaries is one run, a leaf below the block that holds it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

# FIXED VALUES: block elements by kind; kinds are ordered from what is seldom article to what often is
KINDS = (
    "nav menu", "footer", "header", "aside dialog", "form fieldset", "ul ol dl", "li dt dd", "table thead tbody tfoot tr",
    "td th caption", "html body", "div center hgroup details summary", "section", "#run", "p address", "h1 h2 h3 h4 h5 h6",
    "blockquote pre figure figcaption hr", "main", "article",
)
KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split()}
RUN = KIND["#run"]
# FIXED VALUES: elements whose content is no text of the page
SKIPPED = frozenset("script style title textarea noscript template svg iframe object canvas select math head".split())
# FIXED VALUES: of these, those that hold no markup and so go on to the end of a page that never ends them
RAW = frozenset("script style textarea iframe".split())
CONTROLS = frozenset("input button label option select textarea".split())
# FIXED VALUES: an element of the key's kind ends an open one of its values
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
SCOPE = frozenset("ul ol dl table div section article body main aside nav footer header form blockquote".split())
# FIXED VALUES: attribute tokens that speak for and against an article
GOOD = frozenset("article articlebody body content entry main post story text prose read blog news body-text".split())
BAD = frozenset(
    """ad ads advert advertisement adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright
    disqus footer foot form gdpr header hero legal links login masthead menu meta modal nav navbar navigation newsletter notice
    pager pagination popup popular privacy promo promoted recommended related reply respond search share sharing sidebar side
    signup site skip social sponsor sponsored subscribe tags teaser toolbar tools top topbar tracking trending warning widget
    complementary contentinfo alert""".split()
)
TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|$)|'[^']*+(?:'|$))*+)(?:>|$)|<[!?/][^>]*+(?:>|$)""", re.S)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+(?=[^a-z]|$)|[A-Z]?[a-z]+|[A-Z]+")
STOPS = re.compile(r"[.,;:!?]")


@dataclass
class Nodes:
    """Of each node, parents before children; text is None for elements."""

    parent: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    good: list[int] = field(default_factory=list)
    bad: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    link: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)


def tokens(attributes: str) -> tuple[int, int]:
    """How many class, id and role tokens speak for and against an article."""
    good = bad = 0
    for m in NAMED.finditer(attributes):
        for w in set(WORD.findall(m[1])):
            w = w.lower()
            good += w in GOOD
            bad += w in BAD
    return good, bad


def parse(html: str) -> Nodes:
    out = Nodes()
    children: list[int] = []

    def add(kind: int, name: str, good: int, bad: int, at: int, text: str | None = None, link: int = 0) -> int:
        up, k = (stack[-1] if stack else -1), len(out.parent)
        out.parent.append(up)
        out.kind.append(kind)
        out.level.append(len(stack))
        out.rank.append(children[up] if up >= 0 else 0)
        out.good.append(good)
        out.bad.append(bad)
        out.at.append(at)
        out.text.append(text)
        out.link.append(link)
        out.controls.append(0)
        out.name.append(name)
        children.append(0)
        if up >= 0:
            children[up] += 1
        return k

    stack: list[int] = []
    stack.append(add(KIND["body"], "#page", 0, 0, 0))
    parts: list[str] = []
    linked = in_link = 0
    began = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                add(RUN, "#run", 0, 0, began, text, min(linked, len(text)))
        linked = 0

    def close(names: str, until: frozenset[str]) -> None:
        wanted = names.split()
        for depth in range(len(stack) - 1, 0, -1):
            name = out.name[stack[depth]]
            if name in wanted:
                del stack[depth:]
                return
            if name in until:
                return

    pos, size = 0, len(html)
    while pos < size:
        m = TAG.search(html, pos)
        start = m.start() if m else size
        if start > pos:
            if not parts:
                began = pos
            parts.append(html[pos:start])
            if in_link:
                linked += start - pos
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in KIND:
                flush()
                if tag in ("p", "li"):
                    close(tag, SCOPE)
                else:
                    close(tag, frozenset())
            continue
        if tag in SKIPPED:
            if tag in CONTROLS:
                out.controls[stack[-1]] += 1
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(html, pos)
                if end:
                    pos = end.end()
                elif tag in RAW:
                    pos = size
            continue
        kind = KIND.get(tag)
        if kind is None:
            if tag == "a":
                in_link = 1
            elif tag == "br":
                parts.append(" ")
            elif tag in CONTROLS:
                out.controls[stack[-1]] += 1
            continue
        flush()
        if tag in ("html", "body"):
            continue
        if out.name[stack[-1]] == "p" or "p" in (out.name[k] for k in stack[-3:]):
            close("p", SCOPE)
        if tag in ENDS:
            close(ENDS[tag], SCOPE)
        good, bad = tokens(m[3]) if m[3] else (0, 0)
        k = add(kind, tag, good, bad, m.start())
        if tag != "hr":
            stack.append(k)
    flush()
    return out


FEATURES = (
    "kind", "kind of parent", "kind of grandparent", "level", "rank", "siblings", "tokens for", "tokens against", "tokens for above",
    "tokens against above", "characters", "share of characters in links", "stops a character", "runs", "elements", "characters a run",
    "paragraphs", "controls", "share of parent's characters", "share of page's characters", "place in page", "characters of sibling before",
    "worst kind above", "best kind above",
)


def features(pages: list[Nodes]) -> np.ndarray:
    """One row of FEATURES for each node of the pages, in order."""
    rows = []
    for p in pages:
        n = len(p.parent)
        up = p.parent
        chars = [len(t) if t else 0 for t in p.text]
        stops = [len(STOPS.findall(t)) if t else 0 for t in p.text]
        link, runs = list(p.link), [int(t is not None) for t in p.text]
        elements, controls = [1 - r for r in runs], list(p.controls)
        paragraphs = [int(x == "p") for x in p.name]
        for k in range(n - 1, 0, -1):
            u = up[k]
            chars[u] += chars[k]
            stops[u] += stops[k]
            link[u] += link[k]
            runs[u] += runs[k]
            elements[u] += elements[k]
            controls[u] += controls[k]
            paragraphs[u] += paragraphs[k]
        good, bad, worst, best = [0] * n, [0] * n, [9] * n, [9] * n
        siblings, last, before = [0] * n, [0] * n, [0] * n
        for k in range(1, n):
            u = up[k]
            good[k], bad[k] = good[u] + p.good[u], bad[u] + p.bad[u]
            worst[k], best[k] = min(worst[u], p.kind[u]), max(best[u], p.kind[u])
            siblings[u] += 1
            before[k], last[u] = last[u], chars[k]
        u = np.array(up)
        u[0] = 0
        kind, c = np.array(p.kind, float), np.array(chars, float)
        r = np.array(runs, float)
        rows.append(
            np.column_stack(
                [
                    kind, kind[u], kind[u[u]], np.minimum(p.level, 30), np.minimum(p.rank, 100), np.minimum(np.array(siblings)[u], 100), p.good, p.bad,
                    np.minimum(good, 5), np.minimum(bad, 5), np.log1p(c), np.array(link) / np.maximum(c, 1), np.array(stops) / np.maximum(c, 1),
                    np.log1p(r), np.log1p(elements), np.log1p(c / np.maximum(r, 1)), np.log1p(paragraphs), np.minimum(controls, 20),
                    c / np.maximum(c[u], 1), c / max(c[0], 1), np.array(p.at) / max(p.at[-1], 1), np.log1p(before), worst, best,
                ]
            )
        )
    return np.concatenate(rows) if rows else np.empty((0, len(FEATURES)))


def decode(page: Nodes, chance: np.ndarray) -> list[bool]:
    """The likeliest choice of nodes in which nothing below a dropped node is kept.

    Bottom up, a subtree is worth most either dropped as a whole or kept at its top with each child at its best; top down, the
    first drop on a path holds for all below.
    """
    n = len(page.parent)
    p = np.clip(chance, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
    for k in range(n - 1, 0, -1):
        u = page.parent[k]
        keep[u] += max(keep[k], drop[k])
        drop[u] += drop[k]
    kept = [True] * n
    for k in range(1, n):
        kept[k] = kept[page.parent[k]] and keep[k] > drop[k]
    return kept


def main_text(page: Nodes, chance: np.ndarray) -> str:
    return "\n".join(t for t, k in zip(page.text, decode(page, chance), strict=True) if t and k)
