"""Pages as trees of elements: enough of HTML to find elements and read their text."""

from __future__ import annotations

import json
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self):
        """The elements inside, in the order of the page."""
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Element):
                    yield x
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()

    def matches(self, what: str) -> bool:
        """tag, or tag&attribute&value: the whole value, or one of a class attribute's; tag&attribute: any value."""
        tag, *rest = what.split("&")
        if self.tag != tag or not rest:
            return self.tag == tag
        value = self.attrs.get(rest[0])
        if value is None or len(rest) == 1:
            return value is not None
        return value == rest[1] or (rest[0] == "class" and rest[1] in value.split())

    def find_all(self, what: str) -> list[Element]:
        return [x for x in self.walk() if x.matches(what)]

    def outermost(self, what: str) -> list[Element]:
        """find_all() without elements that are inside of another one: their text is part of its text."""
        out, stack = [], [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Element):
                    if x.matches(what):
                        out.append(x)
                    else:
                        stack.append(iter(x.children))
                        break
            else:
                stack.pop()
        return out

    def find(self, what: str) -> Element | None:
        return next((x for x in self.walk() if x.matches(what)), None)

    def text(self, raw: bool = False) -> str:
        """All text inside; scripts, styles and templates have none for the elements around them."""
        out, stack = [], [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    out.append(x)
                elif raw or x.tag not in SILENT:
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open, self.count = [self.root], {}

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        while self.count.get(tag):
            e = self.open.pop()
            self.count[e.tag] -= 1
            if e.tag == tag:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def page(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def body_of_json(root: Element) -> str:
    """articleBody of the page's JSON-LD, or the value of the part that it selects as .article-body. Of a block that
    isn't valid JSON, what stands as articleBody up to the next quote and comma."""
    for block in root.find_all("script&type&application/ld+json"):
        raw = block.text(raw=True).strip()
        try:
            found = json.loads(raw)
        except ValueError:
            at = raw.find('"articleBody":')
            if at >= 0:
                start = raw.find('"', at + 14) + 1
                end = raw.find('",', at + 14 + 25)
                return raw[start:end] if start and end >= 0 else ""
            continue
        if not isinstance(found, dict):
            continue
        part = found.get("hasPart")
        if "articleBody" in found:
            return found["articleBody"] or ""
        if isinstance(part, dict) and part.get("cssSelector") == ".article-body":
            return part.get("value") or ""
    return ""


#: Texts of paragraphs that begin with another element count from so many characters on.
SPAN_CHARS = 75


def read(root: Element, rule: list[str]) -> str:
    """A page's text by a site's rule (start, texts): the texts inside of the first element that start names, each
    followed by a blank; an element that isn't closed holds those after it, whose texts are read once. '<p><span>' takes
    elements whose first child is such an element. No rule: no text."""
    if not rule:
        return ""
    start, at = rule[0], rule[1]
    if start == "schemaorg":
        return body_of_json(root)
    inside = root.find(start) if start else root
    if inside is None:
        return ""
    if at.startswith("<"):
        outer, inner = (x.strip("<>") for x in at.split("><"))
        first = lambda e: next((c.tag for c in e.children if isinstance(c, Element)), None)
        texts = [e.text().strip() for e in inside.find_all(outer) if first(e) == inner]
        return "".join(f"{t} " for t in texts if len(t) > SPAN_CHARS)
    return "".join(f"{t} " for t in (e.text().strip() for e in inside.outermost(at)) if t)
