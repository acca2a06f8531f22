"""HTML extraction by wrapper induction: pages of a host are aligned with one of them by simple tree matching.

The alignment gives every node a slot of the host's template. Slots are counted in a table by host:
those with one text on all pages are the template, those whose text varies are content. No task holds
the pages of a host, and neither the order nor the splits of the pages matter.
"""

from __future__ import annotations

import html
import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, save, small
from .url_filter import url_host

#: What a tag holds after its name. A quote opens a value only after an equals sign, and only if it is closed.
INSIDE = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*){INSIDE}>?|<[!?][^>]*>?", re.S)
NAMES = re.compile(r"""(?<![\w:.-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "template", "svg", "math", "select"}
#: Raw elements that take the rest of the page if they aren't closed, as browsers read them; of others only the tag goes.
TO_END = {"script", "style", "title", "textarea"}
RAW_TAGS = {
    tag: re.compile(rf"<(/){tag}\b[^>]*>?" if tag in TO_END else rf"<(/?){tag}(?![^\s/>]){INSIDE}>?", re.I) for tag in RAW
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What never holds an article's text, by tag and by whole tokens of class, id and role (see ``Page.spare`` for what stays in spite of its tokens).
DROP_TAGS = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "dialog", *RAW} - {"noscript"}
DROP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "contentinfo", "cookie", "cookies", "consent", "disqus", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "popup", "promo", "related", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar",
}
#: What such a word is joined with where the whole still names a block of its kind, as in comment-list or related-posts; has-sidebar doesn't.
COMPANIONS = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "footer", "form", "global", "header", "icons", "inner", "item",
    "items", "left", "links", "list", "main", "meta", "page", "panel", "post", "posts", "primary", "reader", "reply", "right", "secondary", "section", "site", "slot", "stories",
    "text", "thread", "title", "top", "unit", "user", "widget", "wrap", "wrapper",
}
#: A slot is constant if this many distinct pages of its host have it and all have one text.
SUPPORT = 3
#: Weights of a matched node in the alignment, and of its text being the same besides.
MATCH, EQUAL = 2, 1
#: Weights that an alignment remembers at once.
ROW_CELLS = 2_000_000
#: Slots that a task holds before it hands them on.
HELD_SLOTS = 100_000
#: Pages of a host that go to one task where templates are too large to be sent to all.
PART_PAGES = 2000


def text_hash(text: str) -> int:
    """A signed 64-bit hash; an empty text has 0."""
    return xxhash.xxh3_64_intdigest(text) - 2**63 if text else 0


def closing(tag: str, source: str) -> dict[int, int]:
    """The end of each opening tag of a raw element that is closed, with the end of its closing tag."""
    out, opened = {}, []
    for m in RAW_TAGS[tag].finditer(source):
        if not m[1]:
            if not (tag in ("svg", "math") and m[2].endswith("/")):
                opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def speaks_against(names: str) -> bool:
    """Whether a token is one of DROP_WORDS, or some of them joined by hyphens to each other, to COMPANIONS or to numbers."""
    for token in names.lower().split():
        parts = [p for p in re.split("[-_]+", token) if p and not re.fullmatch(r"\d+(x\d+)?", p)]
        if not DROP_WORDS.isdisjoint(parts) and all(p in DROP_WORDS or p in COMPANIONS for p in parts):
            return True
    return False


class Page:
    """A page's block elements as lists in page order, a parent before its children; node 0 is the page itself.

    ``parts`` has the texts with their nodes, also in page order, and (node, None) where an element begins or
    ends; inline tags leave only their text. ``named`` says that tokens of class, id and role speak against an
    element (see ``speaks_against``); ``drop`` that it can't hold article text.
    Unclosed and stray tags are tolerated.
    """

    def __init__(self, source: str | None) -> None:
        self.tag: list[str] = ["#"]
        self.label: list[str] = ["#"]
        self.parent: list[int] = [-1]
        self.named: list[bool] = [False]
        self.parts: list[tuple[int, str | None]] = []
        self._parse(source or "")
        size = len(self.tag)
        self.drop = [t in DROP_TAGS or n for t, n in zip(self.tag, self.named)]
        self.region = [t in ("article", "main") or x.endswith(".main") for t, x in zip(self.tag, self.label)]
        self.never = [False] * size  # in an element that its tag drops
        texts: list[list[str]] = [[] for _ in range(size)]
        for k in range(1, size):
            self.never[k] = self.never[self.parent[k]] or self.tag[k] in DROP_TAGS
        for k, text in self.parts:
            if text is not None:
                texts[k].append(text)
        self.own = [" ".join(" ".join(x).split()) if x else "" for x in texts]
        self.within = [False] * size  # below an article or main element
        for k in range(1, size):
            self.within[k] = self.within[self.parent[k]] or self.region[self.parent[k]]

    def _open(self, tag: str, names: str, top: int) -> int:
        words = sorted(set(WORDS.findall(names.lower()))) if names else []
        self.tag.append(tag)
        self.label.append(".".join([tag, *words]))
        self.named.append(bool(words) and tag not in DROP_TAGS and tag not in ("html", "body") and speaks_against(names))
        self.parent.append(top)
        self.parts.append((len(self.tag) - 1, None))
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        opened: Counter[str] = Counter()
        closed: dict[str, dict[int, int]] = {}

        def close() -> str:
            node = stack.pop()
            self.parts.append((node, None))
            opened[self.tag[node]] -= 1
            return self.tag[node]

        while at < size:
            m = TAG.search(source, at)
            if not m:
                self.parts.append((stack[-1], source[at:]))
                break
            if m.start() > at:
                self.parts.append((stack[-1], source[at : m.start()]))
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if opened[tag] > 0:
                    while close() != tag:
                        pass
                continue
            if tag in RAW:
                if tag in TO_END:
                    end = RAW_TAGS[tag].search(source, at)
                    at = end.end() if end else size
                elif not (tag in ("svg", "math") and m[3].endswith("/")):
                    if tag not in closed:
                        closed[tag] = closing(tag, source)
                    at = closed[tag].get(at, at)
                continue
            if tag == "br" or tag == "hr":
                self.parts.append((stack[-1], " "))
            if tag in VOID:
                continue
            names = " ".join(x.strip("\"'") for x in NAMES.findall(m[3])) if m[3] else ""
            if tag in INLINE and not opened[tag] and not speaks_against(names):
                continue
            if self.tag[stack[-1]] == "head":
                close()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        while len(stack) > k:
                            close()
                        break
                    if self.tag[stack[k]] in CLOSES_P or self.tag[stack[k]] in ("td", "th", "li", "body"):
                        break
            while self.tag[stack[-1]] in SAME.get(tag, ()):
                close()
            node = self._open(tag, names, stack[-1])
            if not m[3].endswith("/"):
                stack.append(node)
                opened[tag] += 1

    def spare(self, constant: list[bool] | None = None) -> None:
        """Keep blocks that were to go for their tokens only: those without which the page has no article or main element,
        and those with more than half of the text that its article and main elements, or else the page, can give (constants
        and what its tag drops aside)."""
        size = len(self.tag)
        if not any(self.regions()):
            held = list(self.region)
            for k in range(size - 1, 0, -1):
                if held[k] and not self.never[k]:
                    held[self.parent[k]] = True
                    self.drop[k] = False
        sizes, regions = self.sizes(constant), self.regions()
        tops = [k for k in range(1, size) if regions[k] and not regions[self.parent[k]]] or [0]
        half, inside = sum(sizes[k] for k in tops) / 2, [False] * size
        for k in tops:
            inside[k] = True
        for k in range(1, size):
            inside[k] = inside[k] or inside[self.parent[k]]
            if self.named[k] and inside[k] and sizes[k] > half:
                self.drop[k] = False

    def sizes(self, constant: list[bool] | None = None, dropped: list[bool] | None = None) -> list[int]:
        """Characters of text below each node, without constants, what its tag drops, and what is ``dropped``."""
        out = [0] * len(self.tag)
        for k in range(len(self.tag) - 1, -1, -1):
            if self.never[k] or dropped and dropped[k]:
                out[k] = 0
                continue
            if not (constant and constant[k]):
                out[k] += len(self.own[k])
            if k:
                out[self.parent[k]] += out[k]
        return out

    def dropped(self) -> list[bool]:
        """Whether a node or one that holds it is dropped."""
        out = list(self.drop)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def regions(self) -> list[bool]:
        """Whether a node is in an article or main element that can hold text."""
        out, gone = [False] * len(self.tag), self.dropped()
        for k in range(1, len(out)):
            out[k] = not gone[k] and (self.region[k] or out[self.parent[k]])
        return out

    def text(self, keep: list[bool]) -> str:
        """The texts of the nodes to keep, blocks joined by one space."""
        out = []
        for k, text in self.parts:
            if text is None:
                if self.tag[k] not in INLINE or keep[k]:
                    out.append(" ")
            elif keep[k]:
                out.append(text)
        return " ".join(html.unescape("".join(out)).split())


class Tree:
    """A page's tree for the alignment, without what its tag drops: children, text hashes, and subtrees' hashes and weights.

    An article or main element is one node with all that it holds, since nothing in it is cut as constant.
    """

    def __init__(self, page: Page) -> None:
        self.label = page.label
        size = len(page.tag)
        self.children: list[list[int]] = [[] for _ in range(size)]
        for k in range(1, size):
            if not page.never[k] and not page.within[k]:
                self.children[page.parent[k]].append(k)
        self.whole, self.weight = [0] * size, [0] * size
        self.own = list(page.own)
        for k in range(size - 1, 0, -1):
            if page.within[k] and not page.never[k] and self.own[k]:
                up = page.parent[k]
                self.own[up] = f"{self.own[k]}\n{self.own[up]}" if self.own[up] else self.own[k]
        self.text = [text_hash(x) for x in self.own]
        for k in range(size - 1, -1, -1):
            if not page.never[k] and not page.within[k]:
                below = self.children[k]
                self.whole[k] = hash((page.label[k], self.text[k], *[self.whole[x] for x in below]))
                self.weight[k] = MATCH + EQUAL + sum(self.weight[x] for x in below)


class Matching:
    """Simple tree matching of two trees: the heaviest alignment that keeps labels, parents and order.

    Subtrees that are the same in structure and text weigh all that they can, so they are matched without a look
    inside. The rest of two lists of children is aligned row by row, each row at once. A text that only one of the
    trees has equals none of the other's, so subtrees that differ in such texts alone are of one kind, and weights
    are found once for each two kinds: items of a long list mostly have a few.
    """

    def __init__(self, a: Tree, b: Tree) -> None:
        self.a, self.b = a, b
        self.known: dict[tuple[int, int], int] = {}
        numbers: dict[tuple, int] = {}
        both = set(a.text) & set(b.text)
        self.kind_a, self.kind_b = self.kinds(a, both, numbers), self.kinds(b, both, numbers)

    @staticmethod
    def kinds(tree: Tree, both: set[int], numbers: dict[tuple, int]) -> list[int]:
        """The kind of each node's subtree: labels, and texts that both trees have."""
        out = [-1] * len(tree.label)
        for k in range(len(out) - 1, -1, -1):
            if tree.weight[k]:
                text = tree.text[k] if tree.text[k] in both else None
                out[k] = numbers.setdefault((tree.label[k], text, *[out[x] for x in tree.children[k]]), len(numbers))
        return out

    def value(self, i: int, j: int) -> int:
        """The weight of matching node i of a with node j of b, which have one label."""
        a, b = self.a, self.b
        if a.whole[i] == b.whole[j]:
            return a.weight[i]
        own = MATCH + EQUAL * (a.text[i] == b.text[j])
        if not a.children[i] or not b.children[j]:
            return own
        key = (self.kind_a[i], self.kind_b[j])
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = own + self.lists(a.children[i], b.children[j], None)
        return found

    def lists(self, x: list[int], y: list[int], pairs: list[tuple[int, int]] | None) -> int:
        """The weight of the best alignment of two lists of children; ``pairs`` takes it."""
        a, b = self.a, self.b
        low, total = 0, 0
        while low < min(len(x), len(y)) and a.whole[x[low]] == b.whole[y[low]]:
            total += a.weight[x[low]]
            low += 1
        high = 0
        while high < min(len(x), len(y)) - low and a.whole[x[-1 - high]] == b.whole[y[-1 - high]]:
            total += a.weight[x[-1 - high]]
            high += 1
        if pairs is not None:
            pairs += zip(x[:low], y[:low])
            pairs += zip(x[len(x) - high :], y[len(y) - high :])
        x, y = x[low : len(x) - high], y[low : len(y) - high]
        if x and y:
            if pairs is None and len(x) * len(y) <= 64:
                return total + self.few(x, y)
            total += self.aligned(x, y, pairs) if len(x) <= len(y) else self.aligned(y, x, pairs, True)
        return total

    def few(self, x: list[int], y: list[int]) -> int:
        """The weight of the best alignment of two short lists."""
        a, b = self.a.label, self.b.label
        row = [0] * (len(y) + 1)
        for i in x:
            last = 0
            for n, j in enumerate(y, 1):
                now = row[n]
                if a[i] == b[j]:
                    last += self.value(i, j)
                row[n], last = max(now, row[n - 1], last), now
        return row[-1]

    def aligned(self, x: list[int], y: list[int], pairs: list[tuple[int, int]] | None, swapped: bool = False) -> int:
        s, t = (self.b, self.a) if swapped else (self.a, self.b)
        kind_s, kind_t = (self.kind_b, self.kind_a) if swapped else (self.kind_a, self.kind_b)
        labels: dict[str, list[int]] = {}
        texts: dict[tuple[str, int], list[int]] = {}
        inner: dict[str, dict[int, list[int]]] = {}
        for n, j in enumerate(y):
            labels.setdefault(t.label[j], []).append(n)
            texts.setdefault((t.label[j], t.text[j]), []).append(n)
            if t.children[j]:
                inner.setdefault(t.label[j], {}).setdefault(kind_t[j], []).append(n)
        alike: dict[str, np.ndarray] = {}
        for label, found in labels.items():
            alike[label] = np.zeros(len(y), np.int32)
            alike[label][found] = MATCH
        none = np.zeros(len(y), np.int32)
        rows: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            w = rows.get(kind_s[i])
            if w is None:
                if (len(rows) + 1) * len(y) > ROW_CELLS:
                    rows.clear()
                w = rows[kind_s[i]] = weigh(i)
            return w

        def weigh(i: int) -> np.ndarray:
            w, same = alike.get(s.label[i], none), texts.get((s.label[i], s.text[i]))
            if same or s.children[i] and s.label[i] in inner:
                w = w.copy()
                w[same or []] += EQUAL
                for found in inner.get(s.label[i], {}).values() if s.children[i] else ():
                    w[found] = self.value(y[found[0]], i) if swapped else self.value(i, y[found[0]])
            return w

        def best(before: np.ndarray, w: np.ndarray) -> np.ndarray:
            out = np.zeros_like(before)
            np.maximum.accumulate(np.maximum(before[1:], before[:-1] + w), out=out[1:])
            return out

        step = math.isqrt(len(x)) + 1
        held = [np.zeros(len(y) + 1, np.int32)]  # every step-th row; those between are found again on the way back
        now = held[0]
        for n, i in enumerate(x, 1):
            now = best(now, row(i))
            if n % step == 0:
                held.append(now)
        total = int(now[-1])
        if pairs is None:
            return total
        j = len(y)
        for block in range(len(held) - 1, -1, -1):
            part = x[block * step : (block + 1) * step]
            table = [held[block]]
            for i in part:
                table.append(best(table[-1], row(i)))
            for n in range(len(part), 0, -1):
                while j and table[n][j] > table[n - 1][j]:
                    if table[n][j] == table[n][j - 1]:
                        j -= 1
                        continue
                    j -= 1
                    pairs.append((y[j], part[n - 1]) if swapped else (part[n - 1], y[j]))
                    break
        return total

    def pairs(self) -> dict[int, int]:
        """Nodes of b by those of a that are matched with them, from the roots on."""
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 20_000 + 8 * min(len(self.a.label), len(self.b.label))))
        try:
            out, todo = {0: 0}, [(0, 0)]
            while todo:
                i, j = todo.pop()
                found: list[tuple[int, int]] = []
                self.lists(self.a.children[i], self.b.children[j], found)
                out.update(found)
                todo += found
            return out
        finally:
            sys.setrecursionlimit(limit)


def inserted(*parts: object) -> int:
    """An even signed number for an insertion."""
    return (xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) >> 1 << 1) - 2**63


def slots(page: Page, seed: Tree) -> Iterator[tuple[int, int, tuple[int, ...], int, int]]:
    """Each node of a page that has text with its slots and the slot of its parent: (node, text hash, slots, parent's, characters).

    The slot of a node that matches one of the host's seed page is twice that one's number and 2. Others are insertions:
    theirs tell the parent's slot, the label, and the number among insertions of that label from the first on and from
    the last on, so that an insertion elsewhere leaves one of the two as it was. The last bit of a slot is its view.
    """
    tree = Tree(page)
    match = Matching(tree, seed).pairs()
    of: dict[int, tuple[int, ...]] = {0: (2,)}
    todo = [0]
    while todo:
        k = todo.pop()
        below, mine = tree.children[k], of[k]
        added = []
        for x in below:
            if x in match:
                of[x] = (2 * match[x] + 2,)
            else:
                added.append(x)
        if added:
            total, seen = Counter(tree.label[x] for x in added), Counter()
            for x in added:
                label = tree.label[x]
                seen[label] += 1
                of[x] = (inserted(mine[0], label, seen[label]), inserted(mine[-1], label, seen[label] - total[label] - 1) | 1)
        if tree.text[k]:
            yield k, tree.text[k], mine, of[page.parent[k]][0] if k else mine[0], len(tree.own[k])
        todo += below


@lru_cache(maxsize=256)
def seed_tree(source: str) -> Tree:
    return Tree(Page(source))


def main_text(source: str | None, seed: str | None = None, constants: set[int] | frozenset[int] = frozenset()) -> str:
    """The article's blocks joined by one space.

    Out go the template's constant slots outside of article and main elements, and blocks of a dropped kind.
    Of what stays, article and main elements are the text if they hold at least half of it, else all is.
    """
    page = Page(source)
    size = len(page.tag)
    constant = [False] * size
    if constants and seed is not None:
        for k, _, found, _, _ in slots(page, seed_tree(seed)):
            constant[k] = not page.region[k] and not constants.isdisjoint(found)
    page.spare(constant)
    gone, region = page.dropped(), page.regions()
    free = page.sizes(constant, gone)
    outside = page.sizes(constant, [a or b for a, b in zip(gone, region)])
    keep = [not gone[k] and not constant[k] for k in range(size)]
    if any(region) and 2 * outside[0] <= free[0]:
        keep = [a and b for a, b in zip(keep, region)]
    return page.text(keep)


class SlotCounts:
    """Slots of the pages that a task has seen: smallest and largest text hash, hashes of up to SUPPORT distinct pages,
    whether the text is kept if it varies, the slot of the parent, characters and rows."""

    COLUMNS = ["host", "slot", "low", "high", "pages", "kept", "up", "chars", "n"]
    SCHEMA = "host string, slot long, low long, high long, pages array<long>, kept boolean, up long, chars long, n long"

    def __init__(self) -> None:
        self.held: dict[tuple[str, int], list] = {}

    def add(self, host: str, seed: str, source: str) -> None:
        """Pages are one if the text that they may give is one, so copies whose scripts or menus differ count once."""
        page = Page(source)
        page.spare()
        gone = page.dropped()
        mark = text_hash(page.text([not x for x in gone]))
        self._add(host, 0, 0, mark, False, 0, 0)
        for k, text, found, up, chars in slots(page, seed_tree(seed)):
            for slot in found:
                self._add(host, slot, text, mark, not gone[k], up, chars)

    def _add(self, host: str, slot: int, text: int, mark: int, kept: bool, up: int, chars: int) -> None:
        x = self.held.get((host, slot))
        if x is None:
            self.held[host, slot] = [text, text, [mark], kept, up, chars, 1]
            return
        x[0], x[1], x[3], x[4] = min(x[0], text), max(x[1], text), x[3] or kept, min(x[4], up)
        if len(x[2]) < SUPPORT and mark not in x[2]:
            x[2].append(mark)
        x[5] += chars
        x[6] += 1

    def flush(self) -> pd.DataFrame:
        out = pd.DataFrame([(*key, *v) for key, v in self.held.items()], columns=self.COLUMNS)
        self.held.clear()
        return out


def seeds_of(rows: DataFrame) -> DataFrame:
    """host, value: of each host the page whose hash is the smallest."""
    hashed = rows.filter("host <> ''").select("host", "html", F.xxhash64("html").alias("h"))
    least = hashed.groupBy("host").agg(F.min("h").alias("h"))
    return save(hashed.join(small(save(least, "html-least")), ["host", "h"]).groupBy("host").agg(F.min("html").alias("value")), "html-seeds")


def per_host(
    rows: DataFrame, model: DataFrame, start: Callable[[], object], visit: Callable, schema: str, broadcast_bytes: int,
) -> DataFrame:
    """``visit(state, batch, seeds, constants)`` over batches of rows (host, html, ...), with what the model has for the batch's hosts.

    ``model`` has rows (host, is_slot, value): the host's seed page and its constant slots. It goes to all tasks if it
    has up to ``broadcast_bytes`` in all; else rows are shuffled to those of their host, a large host's to several tasks.
    ``visit`` yields frames; called with no batch at the end.
    """
    size = model.agg(F.coalesce(F.sum(F.length("host") + F.octet_length("value")), F.lit(0)).alias("n")).first().n
    columns = rows.columns

    if size <= broadcast_bytes:
        seeds: dict[str, str] = {}
        constants: dict[str, set[int]] = {}
        for r in model.collect():
            if r.is_slot:
                constants.setdefault(r.host, set()).add(int(r.value))
            else:
                seeds[r.host] = r.value

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = start()
            for batch in batches:
                yield from visit(state, batch, seeds, constants)
            yield from visit(state, None, seeds, constants)

        return rows.mapInPandas(run, schema)

    def sorted_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A host's model stands before its rows, so a task holds that of one host."""
        state, at, seed, held = start(), None, {}, {}
        for batch in batches:
            for host, group in batch.groupby("host", sort=False, dropna=False):
                if host != at:
                    at, seed, held = host, {}, {}
                mine = group["kind_"].to_numpy()
                for value in group["value_"][mine == 0]:
                    seed[host] = value
                held.setdefault(host, set()).update(int(v) for v in group["value_"][mine == 1])
                if (mine == 2).any():
                    yield from visit(state, group.loc[mine == 2, columns], seed, held)
        yield from visit(state, None, seed, held)

    parts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / PART_PAGES).cast("int").alias("parts_"))
    parts = save(parts, "html-parts")
    kinds = dict(rows.dtypes)
    dealt = rows.join(small(parts), "host").select(
        *columns, F.pmod(F.xxhash64(*columns), F.col("parts_")).cast("int").alias("part_"), F.lit(2).alias("kind_"), F.lit(None).cast("string").alias("value_")
    )
    copies = model.join(parts, "host").select(
        *[F.col("host") if c == "host" else F.lit(None).cast(kinds[c]).alias(c) for c in columns],
        F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)).alias("part_"), F.col("is_slot").cast("int").alias("kind_"), F.col("value").alias("value_"),
    )
    return dealt.unionByName(copies).repartition("host", "part_").sortWithinPartitions("host", "part_", "kind_").mapInPandas(sorted_run, schema)


def host_constants(rows: DataFrame, seeds: DataFrame, broadcast_bytes: int) -> DataFrame:
    """host, value: the slots that at least ``SUPPORT`` distinct pages of the host have, all with one text.

    Constants of one parent that have more text than all that varies on a page of the host, on the average,
    are an article that the host posted again rather than template; they stay.
    """

    def visit(counts: SlotCounts, batch: pd.DataFrame | None, seeds: dict, _: dict) -> Iterator[pd.DataFrame]:
        if batch is not None:
            for host, source in zip(batch["host"], batch["html"]):
                if host in seeds:
                    counts.add(host, seeds[host], source)
        if counts.held and (batch is None or len(counts.held) >= HELD_SLOTS):
            yield counts.flush()

    model = seeds.select("host", F.lit(False).alias("is_slot"), "value")
    found = per_host(rows.select("host", "html"), model, SlotCounts, visit, SlotCounts.SCHEMA, broadcast_bytes).groupBy("host", "slot").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"),
        F.max("kept").alias("kept"), F.min("up").alias("up"), F.sum("chars").alias("chars"), F.sum("n").alias("n"),
    )
    found = save(found.filter(f"slot = 0 or low <> high or pages >= {SUPPORT}"), "html-slots")
    first = F.col("slot").bitwiseAND(1) == 0
    varies = F.when((F.col("low") != F.col("high")) & F.col("kept") & first, F.col("chars"))
    hosts = found.groupBy("host").agg((F.coalesce(F.sum(varies), F.lit(0)) / F.max(F.when(F.col("slot") == 0, F.col("n")))).alias("varying"))
    constant = found.filter("slot <> 0 and low = high")
    blocks = constant.filter("kept").filter(first).groupBy("host", "up").agg(F.sum(F.col("chars") / F.col("n")).alias("block"))
    again = blocks.join(hosts, "host").filter("block > varying").select("host", "up")
    return constant.join(again, ["host", "up"], "left_anti").select("host", F.col("slot").cast("string").alias("value"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 8_000_000) -> DataFrame:
    """One row per input row: id, url, text.

    Null and empty html have empty text; a page without a host is extracted without a template.
    Repeated pages give repeated rows; an empty table gives an empty result; other columns aren't read. Templates go to
    all tasks if they have up to ``broadcast_bytes`` in all, else pages are shuffled to that of their host.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(
        url_host(F.col(url_col)).alias("host"), F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    kind = dict(pages.select(F.col(id_col)).dtypes)[id_col]
    seeds = seeds_of(rows)
    constants = save(host_constants(rows.filter("host <> ''"), seeds, broadcast_bytes), "html-constants")
    used = seeds.join(small(constants.select("host").distinct()), "host", "left_semi")
    model = used.select("host", F.lit(False).alias("is_slot"), "value").unionByName(constants.select("host", F.lit(True).alias("is_slot"), "value"))

    def visit(_: object, batch: pd.DataFrame | None, seeds: dict, constants: dict) -> Iterator[pd.DataFrame]:
        if batch is not None:
            out = [main_text(source, seeds.get(h), constants.get(h, frozenset())) for h, source in zip(batch["host"], batch["html"])]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": out})

    found = per_host(rows, model, object, visit, "id string, url string, text string", broadcast_bytes)
    return found.select(F.col("id").cast(kind).alias(id_col), "url", "text")
