"""A small HTML reader: blocks of text with their place in the tree, and statistics of every node."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

#: Elements whose content is never text of the page.
DROPPED = ("script", "style", "noscript", "template", "title", "textarea", "select", "option", "svg", "math", "iframe", "object", "canvas", "audio", "video", "datalist")
#: Of these, the ones that a browser reads to the end of the page if they are never closed; the others are then taken as empty.
RAW = frozenset(("script", "style", "title", "textarea", "iframe"))
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in DROPPED}
_NAME, _STOP, _BLANK, _VALUE = (re.compile(p) for p in (r"/?[a-zA-Z][a-zA-Z0-9:-]*", r"[>=]", r"\s*", r"[^\s>]*"))
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends open elements of the values, up to the nearest of the bounds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"}}
BOUNDS = frozenset("ul ol dl table div section article main body aside nav header footer form blockquote".split())
TAGS = ("p", "div", "article", "section", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "h3", "table", "td", "blockquote", "pre", "figure", "button", "dl", "#text")
TAG = {t: i for i, t in enumerate(TAGS)}
#: Words of class, id and role attributes, by what they speak for.
GROUPS = {
    "content": "article content main post entry story body text prose page blog news read copy single",
    "menu": "nav menu navbar breadcrumb breadcrumbs tabs toolbar links topbar navigation pagination pager toc",
    "frame": "header footer masthead banner colophon legal copyright bottom top branding logo",
    "side": "sidebar aside side related widget widgets rail recommended more recirc tags tagcloud teaser",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp adsense commercial",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay dialog newsletter subscribe signup paywall",
    "talk": "comment comments reply replies discussion disqus thread respond feedback reviews",
    "share": "share social sharing follow facebook twitter",
    "form": "form login search input contact",
}
GROUP = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
_ATTR = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
NUMBERS = 20
WIDTH = len(TAGS) + 2 * len(GROUPS) + 7 + NUMBERS


class Scanner:
    """Markup of a page in one pass, whose time grows with the page however its markup is broken."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in "\"'>"}
        self.quotes = True  # until a tag turns out to have no end outside its quotes
        self.open_end: set[str] = set()  # dropped elements that are not closed any more

    def _end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its '>', as a browser reads it: a quote opens a value only right after
        '='. Where there is no such place, quotes don't count, in this tag and in all later ones."""
        s, start = self.source, at
        while self.quotes and (m := _STOP.search(s, at)):
            if m[0] == ">":
                return m.start()
            at = _BLANK.match(s, m.end()).end()
            quote = s[at : at + 1]
            if quote and quote in "\"'" and at < self.last[quote]:
                at = s.index(quote, at + 1) + 1
            else:
                at = _VALUE.match(s, at).end()
        self.quotes = False
        return s.find(">", start)

    def tags(self):
        """(start, end, name, attributes): a name with '/' before it closes; None for comments, declarations and dropped elements."""
        s, at = self.source, 0
        while 0 <= (start := s.find("<", at)) < self.last[">"] or start >= 0 and s.startswith("<!--", start):
            if s.startswith("<!--", start):
                end = s.find("-->", start + 4)
                at = len(s) if end < 0 else end + 3
                yield start, at, None, ""
            elif m := _NAME.match(s, start + 1):
                name, end = m[0].lower(), self._end(m.end())
                attributes, at = s[m.end() : end], end + 1
                if name not in _END or name in self.open_end or name in ("svg", "math") and attributes.endswith("/"):
                    yield start, at, None if name in _END else name, attributes
                    continue
                if close := _END[name].search(s, at):
                    at = close.end()
                elif name in RAW:
                    at = len(s)
                else:
                    self.open_end.add(name)
                yield start, at, None, ""
            elif s[start + 1] in "!?/":
                at = s.index(">", start) + 1
                yield start, at, None, ""
            else:
                at = start + 1


class Page:
    """Nodes in page order; parent, tag, groups of attribute words, and of text blocks the text and its links' length."""

    __slots__ = ("groups", "link", "marks", "parent", "tag", "text")

    def __init__(self, source: str):
        self.parent, self.tag, self.groups, self.text, self.link, self.marks = [-1], [-1], [()], [None], [0], [0]
        self._read(source)

    def _add(self, parent: int, tag: int, groups: tuple = (), text: str | None = None, link: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.groups.append(groups)
        self.text.append(text)
        self.link.append(link)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open blocks
        blocks: Counter[str] = Counter()  # how many of them have each name
        inline: Counter[str] = Counter()
        held: list[str] = []
        linked, at = 0, 0

        def flush() -> None:
            nonlocal linked
            if held:
                text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
                if text:
                    self._add(stack[-1][1], TAG["#text"], (), text, min(linked, len(text)))
                held.clear()
            linked = 0

        def leave(k: int) -> None:
            blocks.subtract(x for x, _ in stack[k:])
            del stack[k:]

        for start, end, name, attributes in Scanner(source).tags():
            if start > at:
                held.append(source[at:start])
                if inline["a"]:
                    linked += start - at
            at = end
            if name is None:
                continue
            closes, name = name[0] == "/", name.lstrip("/")
            if name in INLINE:
                if name == "br" or name == "img":
                    held.append(" ")
                elif closes:
                    inline[name] = max(0, inline[name] - 1)
                elif name not in VOID:
                    inline[name] += 1
                continue
            flush()
            if closes:
                if blocks[name] > 0:
                    leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                inline.clear()
                continue
            if name in VOID:
                continue
            if stack[-1][0] == "p" or name in ENDS:
                ends = ENDS.get(name, frozenset())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p" or stack[k][0] in ends:
                        leave(k)
                        if not ends:
                            break
                    elif stack[k][0] in BOUNDS:
                        break
            inline.clear()
            words = _PART.findall(" ".join(["".join(x) for x in _ATTR.findall(attributes)]).lower()) if attributes and not attributes.endswith("/") else ()
            groups = tuple(sorted({GROUP[w] for w in words if w in GROUP}))
            node = self._add(stack[-1][1], TAG.get(name, -1), groups)
            if not attributes.endswith("/"):
                stack.append((name, node))
                blocks[name] += 1
        if at < len(source):
            held.append(source[at:])
        flush()

    def features(self) -> np.ndarray:
        """A row per node: tag, words of its own and its ancestors' attributes, ancestors' tags, and numbers about its
        subtree, its depth, its siblings and its share of the page."""
        n = len(self.parent)
        x = np.zeros((n, WIDTH), np.float32)
        parent = self.parent
        chars, links, nodes, blocks, stops, words = ([0] * n for _ in range(6))
        depth, kids, place = [0] * n, [0] * n, [0] * n
        above: list[int] = [0] * n
        sections = [TAG[t] for t in ("nav", "header", "footer", "aside", "form", "article", "main")]
        bit = {t: 1 << k for k, t in enumerate(sections)}
        base = len(sections)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = kids[p]
            kids[p] += 1
            mine = above[p] | bit.get(self.tag[p], 0)
            for g in self.groups[p]:
                mine |= 1 << (base + g)
            above[i] = mine
            if (t := self.text[i]) is not None:
                chars[i], links[i], blocks[i] = len(t), self.link[i], 1
                stops[i], words[i] = t.count(".") + t.count(",") + t.count("?"), t.count(" ") + 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            nodes[p] += nodes[i] + 1
            blocks[p] += blocks[i]
            stops[p] += stops[i]
            words[p] += words[i]
        c, k, d, b, s, w = (np.array(v, np.float32) for v in (chars, links, nodes, blocks, stops, words))
        par = np.maximum(np.array(parent), 0)
        dep, kid, pos = (np.array(v, np.float32) for v in (depth, kids, place))
        tag = np.array(self.tag)
        known = np.flatnonzero(tag >= 0)
        x[known, tag[known]] = 1
        at = len(TAGS)
        for i, gs in enumerate(self.groups):
            for g in gs:
                x[i, at + g] = 1
        bits = np.array(above)
        at += len(GROUPS)
        for q in range(base + len(GROUPS)):
            x[:, at + q] = (bits >> q) & 1
        at += base + len(GROUPS)
        total, most = max(c[0], 1), np.maximum(c, 1)
        # of equal tags: how many a node has beside it, and how much text they hold
        beside = par.astype(np.int64) * (len(TAGS) + 1) + tag + 1
        _, same = np.unique(beside, return_inverse=True)
        many, held = np.bincount(same)[same], np.bincount(same, c)[same]
        numbers = (
            np.log1p(c), k / most, np.log1p(d), c / (d + 1), b, s / np.maximum(w, 1), np.log1p(w), c / np.maximum(w, 1), dep, pos,
            pos / np.maximum(kid[par], 1), kid[par], kid, c / total, c / np.maximum(c[par], 1), np.log1p(many), np.log1p(held / many), np.log1p(c[par]), k[par] / np.maximum(c[par], 1), np.arange(n) / n,
        )
        for q, v in enumerate(numbers):
            x[:, at + q] = v
        return x

    def decode(self, margin: np.ndarray) -> list[int]:
        """The text blocks to keep: the labelling of all nodes with the greatest sum of log odds in which a kept node has
        kept ancestors and a kept inner node keeps something below."""
        n, m = len(self.parent), margin.tolist()
        keep, inside = [0.0] * n, [0.0] * n  # best sum of a kept node with all below it, and of what is worth keeping below
        best = [0] * n  # the child that costs least, for a kept node with nothing worth keeping below
        for i in range(n - 1, 0, -1):
            forced = self.text[i] is None and not inside[i]
            keep[i] = m[i] + (keep[best[i]] if best[i] else float("-inf")) if forced else m[i] + inside[i]
            p = self.parent[i]
            inside[p] += max(keep[i], 0.0)
            if not best[p] or keep[i] >= keep[best[p]]:
                best[p] = i
        out, kept = [], [False] * n
        kept[0] = True
        for i in range(1, n):
            p = self.parent[i]
            kept[i] = kept[p] and (keep[i] > 0 or bool(p) and not inside[p] and best[p] == i)
            if kept[i] and self.text[i] is not None:
                out.append(i)
        return out
