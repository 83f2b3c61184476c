"""XML of a stream with exact byte ranges, under caps, without document types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain
from xml.etree import ElementTree
from xml.parsers import expat


class XmlFault(ValueError):
    """Why a stream isn't usable as XML."""


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str]
    parent: Node | None
    start: int
    end: int = 0
    texts: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def text(self) -> str:
        return "".join(self.texts)

    def first_text(self) -> str:
        """Text before the first child element."""
        return self.texts[0] if self.texts else ""

    def named(self, tag: str) -> list[Node]:
        return [c for c in self.children if c.tag == tag]

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)


class Light(ElementTree.Element):
    """An element as ``Node`` gives it to readers that ask for no byte ranges, made by the library's own tree builder."""

    __slots__ = ()
    attributes = ElementTree.Element.attrib
    children = property(list)
    named = ElementTree.Element.findall
    walk = ElementTree.Element.iter

    def __bool__(self) -> bool:
        return True

    def first_text(self) -> str:
        return self.text or ""

    def first(self, tag: str) -> Light | None:
        return next(self.iter(tag), None)


def light(data: bytes, max_bytes: int, max_nodes: int, max_depth: int = 256) -> Light | Node:
    """As ``parse``, without byte ranges: plain XML within the caps goes by the library's tree builder, all else and every fault by ``parse``."""
    body = data[max(0, data.find(b"<")) :].rstrip(b"\0") if len(data) <= max_bytes else b""
    # Each node has a sign of its own; names with a prefix are bound by these words only, and are a fault of the builder otherwise.
    if body and body.count(b"<") <= max_nodes and not any(word in body for word in (b"<!", b"xmlns", b"xml:")) and body.find(b"<?", 1) < 0:
        try:
            body.decode("utf-8")
            builder = ElementTree.XMLParser(target=ElementTree.TreeBuilder(element_factory=Light), encoding="utf-8")
            builder.feed(body)
            root = builder.close()
        except (UnicodeDecodeError, ElementTree.ParseError):
            return parse(data, max_bytes, max_nodes, max_depth)
        level, depth = [root], 0
        while level and depth <= max_depth:
            level, depth = [*chain.from_iterable(level)], depth + 1
        if depth <= max_depth:
            return root
    return parse(data, max_bytes, max_nodes, max_depth)


def parse(data: bytes, max_bytes: int, max_nodes: int, max_depth: int = 256) -> Node:
    """Root of the tree. Offsets are positions in ``data``; text before the first ``<`` is skipped."""
    if len(data) > max_bytes:
        raise XmlFault("limit_xml_bytes")
    begin = data.find(b"<")
    if begin < 0:
        raise XmlFault("xml_missing")
    body = data[begin:].rstrip(b"\0")
    try:
        body.decode("utf-8")
    except UnicodeDecodeError as fault:
        raise XmlFault("xml_not_utf8") from fault
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    stack: list[Node] = []
    roots: list[Node] = []
    count = 0

    def opened(tag, attributes):
        nonlocal count
        count += 1
        if count > max_nodes or len(stack) >= max_depth:
            raise XmlFault("limit_xml_nodes" if count > max_nodes else "limit_depth")
        node = Node(tag.rsplit(":", 1)[-1], attributes, stack[-1] if stack else None, begin + parser.CurrentByteIndex)
        (stack[-1].children if stack else roots).append(node)
        stack.append(node)

    def closed(_tag):
        node = stack.pop()
        opening = _tag_end(data, node.start)
        node.end = (opening if data[opening - 1] == 47 else data.index(b">", begin + parser.CurrentByteIndex)) + 1

    def text(value):
        if stack:
            node = stack[-1]
            if node.children:
                node.texts.append(value)
            elif node.texts:
                node.texts[0] += value
            else:
                node.texts.append(value)

    def doctype(*_):
        raise XmlFault("xml_document_type")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = opened, closed, text, doctype
    try:
        parser.Parse(body, True)
    except expat.ExpatError as fault:
        raise XmlFault("xml_malformed") from fault
    return roots[0]


_TAG = re.compile(rb"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")


def _tag_end(data: bytes, at: int) -> int:
    """Position of the ``>`` that ends the tag at ``at``; quoted signs don't count."""
    found = _TAG.match(data, at)
    if found is None:
        raise XmlFault("xml_malformed")
    return found.end() - 1
