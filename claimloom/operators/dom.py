"""A small document tree on the standard library's HTML parser, with the selectors that pages need.

Void elements close at once; an end tag closes up to its start tag, and is passed over
where none is open; what is still open at the end closes there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack += reversed(item.children)
        return "".join(out)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def after(self) -> list[Node]:
        """Elements that follow under the same parent."""
        if self.parent is None:
            return []
        own = next(i for i, c in enumerate(self.parent.children) if c is self)
        return [c for c in self.parent.children[own + 1 :] if isinstance(c, Node)]

    def next(self, tag: str | None = None) -> Node | None:
        return next((n for n in self.after() if tag in (None, n.tag)), None)

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def select(self, selector: str) -> list[Node]:
        """Descendants by ``tag#id.class.class`` steps, joined by a space or ``>``."""
        found: list[Node] = [self]
        for child, step in re.findall(r"(>?)\s*([^\s>]+)", selector):
            tag, name, classes = re.match(r"([\w*-]*)((?:#[\w-]+)?)((?:\.[\w-]+)*)", step).groups()
            need = [c for c in classes.split(".") if c]
            fits = lambda n: tag in ("", "*", n.tag) and (not name or n.attrs.get("id") == name[1:]) and all(c in n.classes for c in need)  # noqa: B023, E731
            seen, hits = set(), []
            for at in found:
                for n in (c for c in at.children if isinstance(c, Node)) if child else at.walk():
                    if id(n) not in seen and fits(n):
                        seen.add(id(n))
                        hits.append(n)
            found = hits
        return found

    def first(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
