"""A page as a flat tree: its nodes in document order, and selectors over them.

A node is a number. Its parent, tag, attributes and the end of its subtree are
in lists, as are the pieces of text with the node that each hangs on, so that a
subtree is a range of nodes and its text a range of pieces. A page is parsed
once; whatever is sought in it is a selector or a walk over these lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Their text is never a text of the page.
SILENT = {"script", "style", "template"}

_COMPOUND = re.compile(r"\s*([>+,])?\s*([\w*-]+)?((?:[#.][\w-]+|\[[^\]]*\])*)")
_PART = re.compile(r"([#.])([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*['\"]?([^'\"\]]*)['\"]?\s*)?\]")

#: Tags as nearly all pages write them: attributes in quotes or without a value. What is written otherwise is left to the parser.
_TAG = re.compile(r"""<(?:/([A-Za-z][A-Za-z0-9]*)|([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][\w:.-]*(?:="[^"<>]*"|='[^'<>]*')?)*)[ \t\n]*(/?))>([^<]*)""", re.ASCII)
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w:.-]*)(?:="([^"]*)"|='([^']*)')?""", re.ASCII)
#: What a parser reads without tags or entities inside: only their plainest forms are read without it.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}


@lru_cache(maxsize=4096)
def _attributes(said: str) -> dict[str, str]:
    """The attributes of a tag by lower-cased name, the last of equal ones."""
    return {m[1].lower(): unescape(m[2] or m[3] or "") for m in _ATTRIBUTE.finditer(said)}


@lru_cache(maxsize=4096)
def compiled(selector: str) -> list[list[tuple[str, str, tuple]]]:
    """The alternatives of a selector: steps of (combinator, tag, tests), left to right.

    Tags, ``#id``, ``.class``, ``[name]`` with ``= *= ^= $= ~=``, descendants,
    children (``>``) and next siblings (``+``).
    """
    alternatives: list[list] = [[]]
    at, text = 0, selector.strip()
    while at < len(text):
        m = _COMPOUND.match(text, at)
        if m.end() == at or not (m[2] or m[3] or m[1] == ","):
            raise ValueError(f"not a selector: {selector!r}")
        at = m.end()
        if m[1] == ",":
            alternatives.append([])
        if m[2] or m[3]:
            tests = tuple((("id" if p[1] == "#" else "class"), "~=", p[2]) if p[1] else (p[3].lower(), p[4] or "", p[5] or "")
                          for p in _PART.finditer(m[3] or ""))
            tests = tuple(("id", "=", v) if (name, kind) == ("id", "~=") else (name, kind, v) for name, kind, v in tests)
            alternatives[-1].append((m[1] if m[1] in (">", "+") else " ", (m[2] or "*").lower(), tests))
    return [steps for steps in alternatives if steps]


class Tree(HTMLParser):
    """The flat tree of one page; node 0 is the page itself."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.attrs, self.last = [-1], [""], [{}], [0]
        self.first_text, self.last_text = [0], [0]
        self.pieces: list[str] = []
        self.owner: list[int] = []
        self._open = [0]
        self.source = html
        self.plain = self._read_plain(html)
        if not self.plain:
            self.feed(html)
            self.close()
        while self._open:
            self._end()
        self.by_tag: dict[str, list[int]] = {}
        self.by_class: dict[str, list[int]] = {}
        self.by_id: dict[str, list[int]] = {}
        self.by_attribute: dict[str, list[int]] = {}
        for node, tag in enumerate(self.tag):
            self.by_tag.setdefault(tag, []).append(node)
            if not self.attrs[node]:
                continue
            for name in self.attrs[node]:
                self.by_attribute.setdefault(name, []).append(node)
            for name in self.classes(node):
                self.by_class.setdefault(name, []).append(node)
            if name := self.attrs[node].get("id"):
                self.by_id.setdefault(name, []).append(node)

    def __len__(self) -> int:
        return len(self.tag)

    def _read_plain(self, html: str) -> bool:
        """Reads a page of plainly written tags, to the same tree as the parser; False, with nothing read, if there is any other."""
        at = html.find("<")
        if at < 0:
            return False
        steps, raw = [], ""
        for m in _TAG.finditer(html, at):
            if m.start() != at:
                return False
            end, tag, said, closed, text = m.groups()
            if raw and (end or "").lower() != raw:
                return False
            tag, end, raw = (tag or "").lower(), (end or "").lower(), ""
            if tag in RAW:
                if closed or tag == "plaintext" or "&" in text:
                    return False
                raw = tag
            steps.append((tag, end, said, closed, text))
            at = m.end()
        if at != len(html) or raw:
            return False
        if at := html.find("<"):
            self.handle_data(unescape(html[:at]))
        for tag, end, said, closed, text in steps:
            if end:
                self.handle_endtag(end)
            else:
                self._start(tag, _attributes(said) if said else {})
                if closed and tag not in VOID:
                    self._end()
            if text and not text.isspace():
                self.handle_data(unescape(text) if "&" in text else text)
        return True

    def _end(self) -> None:
        node = self._open.pop()
        self.last[node], self.last_text[node] = len(self.tag), len(self.pieces)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found: dict[str, str] = {}
        for name, value in attrs:
            found[name] = value or ""
        self._start(tag, found)

    def _start(self, tag: str, found: dict[str, str]) -> None:
        self.parent.append(self._open[-1])
        self.tag.append(tag)
        self.attrs.append(found)
        self.last.append(0)
        self.first_text.append(len(self.pieces))
        self.last_text.append(0)
        self._open.append(len(self.tag) - 1)
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not any(self.tag[k] == tag for k in self._open):
            return
        while self.tag[self._open[-1]] != tag:  # what was left open inside ends here
            self._end()
        self._end()

    def handle_data(self, data: str) -> None:
        if data.strip() and self.tag[self._open[-1]] not in SILENT:
            self.pieces.append(data)
            self.owner.append(self._open[-1])

    # walks

    def classes(self, node: int) -> list[str]:
        return self.attrs[node].get("class", "").split()

    def get(self, node: int, name: str) -> str:
        return self.attrs[node].get(name, "")

    def ancestors(self, node: int) -> Iterator[int]:
        """From the parent up, without the page itself."""
        node = self.parent[node]
        while node > 0:
            yield node
            node = self.parent[node]

    def children(self, node: int) -> Iterator[int]:
        k = node + 1
        while k < self.last[node]:
            yield k
            k = self.last[k]

    def within(self, node: int, tags: Iterable[str]) -> list[int]:
        """The nodes below one, in order, that have one of some tags."""
        return sorted(k for tag in tags for k in self.by_tag.get(tag, ()) if node < k < self.last[node])

    def named(self, node: int) -> list[str]:
        """Classes and id of a node, in lower case."""
        return [x.lower() for x in [*self.classes(node), self.get(node, "id")] if x]

    def marked(self, nodes: Iterable[int]) -> bytearray:
        """1 for each node in the subtrees of some."""
        out = bytearray(len(self.tag))
        for node in nodes:
            out[node:self.last[node]] = b"\1" * (self.last[node] - node)
        return out

    def text(self, node: int, without: bytearray | None = None) -> str:
        """The text of a subtree, squeezed; ``without`` the nodes that are marked."""
        pieces = self.pieces[self.first_text[node]:self.last_text[node]]
        if without is not None:
            pieces = [x for x, k in zip(pieces, self.owner[self.first_text[node]:self.last_text[node]], strict=True) if not without[k]]
        return " ".join(" ".join(pieces).split())

    # selectors

    def _fits(self, node: int, tag: str, tests: tuple) -> bool:
        if tag not in ("*", self.tag[node]):
            return False
        attrs = self.attrs[node]
        for name, kind, wanted in tests:
            if name not in attrs:
                return False
            value = attrs[name]
            if kind and not (value == wanted if kind == "=" else wanted in value.split() if kind == "~=" else bool(wanted) and (
                    wanted in value if kind == "*=" else value.startswith(wanted) if kind == "^=" else value.endswith(wanted))):
                return False
        return True

    def _leads(self, node: int, steps: list, at: int, root: int) -> bool:
        """Whether steps before ``at`` are met by what stands before a node that meets step ``at``."""
        if at == 0:
            return True
        combinator, _, _ = steps[at]
        _, tag, tests = steps[at - 1]
        if combinator == "+":
            before = [k for k in self.children(self.parent[node]) if k < node]
            above = before[-1:]
        else:
            above = [self.parent[node]] if combinator == ">" else self.ancestors(node)
        return any(k > 0 and self._fits(k, tag, tests) and self._leads(k, steps, at - 1, root) for k in above)

    def select(self, selector: str, root: int = 0) -> list[int]:
        """The nodes below ``root`` that a selector means, in document order."""
        out: set[int] = set()
        for steps in compiled(selector):
            _, tag, tests = steps[-1]
            start = next((self.by_id.get(v, ()) for n, k, v in tests if (n, k) == ("id", "=")), None)
            if start is None:
                start = next((self.by_class.get(v, ()) for n, k, v in tests if (n, k) == ("class", "~=")), None)
            if start is None:
                start = self.by_tag.get(tag, ()) if tag != "*" else self.by_attribute.get(tests[0][0], ()) if tests else range(1, len(self.tag))
            out.update(k for k in start if root < k < self.last[root] and self._fits(k, tag, tests) and self._leads(k, steps, len(steps) - 1, root))
        return sorted(out)

    def first(self, selector: str, root: int = 0) -> int | None:
        found = self.select(selector, root)
        return found[0] if found else None

    def flat(self) -> list[tuple[int, int, int, str, str, list[str], int, int, str]]:
        """A row for each node: number, parent, depth, tag, id, classes, range of its pieces of text, and its own text."""
        depth, own = [0] * len(self.tag), [[] for _ in self.tag]
        for piece, node in zip(self.pieces, self.owner, strict=True):
            own[node].append(piece)
        for node in range(1, len(self.tag)):
            depth[node] = depth[self.parent[node]] + 1
        return [(k, self.parent[k], depth[k], self.tag[k], self.get(k, "id"), self.classes(k), self.first_text[k], self.last_text[k],
                 " ".join(" ".join(own[k]).split())) for k in range(1, len(self.tag))]
