"""One-pass HTML tokenizer and a small selector engine, for use inside Arrow-batched functions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# What becomes of a tag.
CONTAINERS = frozenset("head script style noscript template svg math canvas iframe object embed applet audio video form".split())
VOID = frozenset("area base br col hr img input link meta param source track wbr".split())
LEAVES = frozenset("title textarea select option optgroup button map datalist output progress meter".split())
# Tags that never have an end tag.
NO_END = VOID | frozenset("embed keygen frame basefont bgsound command".split())
#: Open frames beyond which deeper elements open none.
MOST_FRAMES = 256

# The characters of Unicode's White_Space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = re.compile(f"[{WHITE}]+")


def squeeze(s: str) -> str:
    return SPACE.sub(" ", s).strip(" ")


class Frames(HTMLParser):
    """Text chunks of a page and the elements around them.

    ``chunks`` are the text nodes outside skipped containers, squeezed. An element's text is always a
    slice of them, so ``frames`` (tag, id, class, first chunk, chunks, bytes, link bytes, commas) carry
    offsets instead of text, in the order in which their end tags come. Elements that never close
    give no frame; an end tag closes all that is open inside its element, deepest first.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.chunks: list[str] = []
        self.frames: list[tuple] = []
        self.title: list[str] = []
        self.canonical: str | None = None
        self.open: list[tuple[str, str, list | None]] = []
        self.stack: list[list] = []
        self.skipped = self.links = 0
        self.in_title = False

    def _push(self, tag: str, what: str, frame: list | None = None) -> None:
        self.open.append((tag, what, frame))

    def handle_starttag(self, tag, attrs):
        if tag == "link":
            a = dict(attrs)
            if (a.get("rel") or "") == "canonical" and a.get("href"):
                self.canonical = a["href"]
        if tag == "title":
            self.in_title = True
            self._push(tag, "title")
        elif tag in NO_END:
            return
        elif self.skipped or tag in CONTAINERS:
            self.skipped += 1
            self._push(tag, "skip")
        elif tag in LEAVES:
            self._push(tag, "ignore")
        elif tag == "a":
            self.links += 1
            self._push(tag, "link")
        elif len(self.stack) >= MOST_FRAMES:
            self._push(tag, "ignore")
        else:
            a = dict(reversed(attrs))
            frame = [tag, a.get("id"), a.get("class"), len(self.chunks), 0, 0, 0]
            self.stack.append(frame)
            self._push(tag, "frame", frame)

    def handle_startendtag(self, tag, attrs):
        if tag in NO_END or tag in ("svg", "math"):
            if tag == "link":
                self.handle_starttag(tag, attrs)
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                break
        else:
            return
        for _, what, frame in reversed(self.open[at:]):
            if what == "title":
                self.in_title = False
            elif what == "skip":
                self.skipped = max(0, self.skipped - 1)
            elif what == "link":
                self.links = max(0, self.links - 1)
            elif what == "frame":
                self._close(frame)
        del self.open[at:]

    def _close(self, frame: list) -> None:
        self.stack.pop()
        tag, ident, cls, start, n, links, commas = frame
        self.frames.append((tag, ident, cls, start, len(self.chunks) - start, n, links, commas))
        if self.stack:
            parent = self.stack[-1]
            parent[4] += n
            parent[5] += links
            parent[6] += commas

    def handle_data(self, data):
        text = squeeze(data)
        if not text:
            return
        if self.in_title:
            self.title.append(data.strip(WHITE))
        elif not self.skipped and self.stack:
            n = len(text.encode())
            top = self.stack[-1]
            top[4] += n
            top[6] += data.count(",")
            if self.links:
                top[5] += n
            self.chunks.append(text)


def read_frames(html: str | None) -> tuple | None:
    """(title, canonical url or None, chunks, frames) of a page; None for None. Broken markup never fails."""
    if html is None:
        return None
    p = Frames()
    p.feed(html)
    p.close()
    return " ".join(p.title), p.canonical, p.chunks, p.frames


class _Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def attr(self, name: str) -> str | None:
        return self.attrs.get(name)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in NO_END:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in NO_END:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> _Node:
    p = _Tree()
    p.feed(html)
    p.close()
    return p.root


_STEP = re.compile(r"([\w-]+|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[*^$]?=(?:'[^']*'|\"[^\"]*\"|[^\]]*))?\])*)")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([*^$]?)=(?:'([^']*)'|\"([^\"]*)\"|([^\]]*)))?\]")


def _compile(selector: str) -> list[tuple]:
    steps = []
    for raw in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector):
        tag, rest = _STEP.fullmatch(raw).groups()
        parts = []
        for kind, name, attr, op, *values in _PART.findall(rest):
            parts.append((kind, name) if kind else ("[", attr, op, next((v for v in values if v), "") if "=" in rest else None))
        steps.append((tag, parts))
    return steps


def _fits(node: _Node, step: tuple) -> bool:
    tag, parts = step
    if tag and tag not in ("*", node.tag):
        return False
    for p in parts:
        if p[0] == ".":
            if p[1] not in (node.attr("class") or "").split():
                return False
        elif p[0] == "#":
            if node.attr("id") != p[1]:
                return False
        else:
            v = node.attr(p[1])
            if v is None:
                return False
            if p[3] is not None and not {"": v == p[3], "*": p[3] in v and p[3] != "", "^": v.startswith(p[3]), "$": v.endswith(p[3])}[p[2]]:
                return False
    return True


class Selector:
    """Type, class, id, ``[a]``, ``[a=v]``, ``[a*=v]`` and descendants, as in ``div.x[data-t='w'] a.l``."""

    def __init__(self, selector: str):
        self.steps = _compile(selector)

    def all(self, root: _Node):
        """Matching nodes below ``root`` in document order; ancestors may lie above it."""
        last = self.steps[-1]
        for node in root.walk():
            if _fits(node, last) and self._above(node, len(self.steps) - 2):
                yield node

    def first(self, root: _Node) -> _Node | None:
        return next(self.all(root), None)

    def _above(self, node: _Node, at: int) -> bool:
        while at >= 0:
            node = node.parent
            while node is not None and not _fits(node, self.steps[at]):
                node = node.parent
            if node is None:
                return False
            at -= 1
        return True


def hrefs(html: str | None) -> list[str]:
    """Every ``href`` of every ``a``, in order; a missing value is empty."""
    if html is None:
        return []
    out: list[str] = []

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                out.extend(v or "" for k, v in attrs if k == "href")

    p = P()
    p.feed(html)
    p.close()
    return out
