"""Selectors over one page: all paths of a domain's selectors in one walk along its elements.

The steps of all paths are bits of one number. A step is looked up by what it asks for first: an id, a
class or a tag. What an element and its ancestors match goes along the stack of open elements, so the
element found for a path's last step is found when it opens, without looking back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pagemill.functions import patterns as P
from pagemill.functions.page import Page, decode_entities

NAME = r"[A-Za-z0-9_-]+"
VALUE = r"""(?:"[^"]*"|'[^']*'|[^\]\s"']+)"""
CONDITION = rf"\[\s*[A-Za-z0-9_:.-]+\s*(?:[~|^$*]?=\s*{VALUE}\s*)?\]"
PART = rf"(?:\.{NAME}|#{NAME}|{CONDITION})"
SIMPLE = rf"(?:(?:[A-Za-z][A-Za-z0-9-]*|\*){PART}*|{PART}+)"
PATH = rf"{SIMPLE}(?:(?:\s*>\s*|\s+){SIMPLE})*"

_compiled = lambda pattern: re.compile(pattern, re.ASCII)
_PATH, _STEP, _CONDITION = _compiled(PATH), _compiled(rf">?\s*{SIMPLE}"), _compiled(CONDITION)
_TAG, _CLASS, _ID = _compiled(r"^>?\s*([A-Za-z][A-Za-z0-9-]*)"), _compiled(rf"\.({NAME})"), _compiled(f"#({NAME})")
_ASKED = _compiled(rf"^\[\s*([A-Za-z0-9_:.-]+)\s*(?:([~|^$*]?=)\s*({VALUE})\s*)?\]$")
_OPEN, _ATTRIBUTE = _compiled(P.OPEN_TAG), _compiled(P.ATTRIBUTE)
_NAME_OF, _VALUE_OF, _SPACE = _compiled(r"^\s+([^\s=]+)"), _compiled(r"(?s)^\s+[^\s=]+\s*=\s*(.*)$"), _compiled(r"\s+")
#: Open tags whose matches are remembered.
REMEMBERED = 10_000


def attributes(open_tag: str) -> dict[str, str]:
    """The attributes of an open tag; the first of repeated ones counts."""
    found = _OPEN.match(open_tag)
    out: dict[str, str] = {}
    for a in _ATTRIBUTE.findall(re.sub(r"^<[^\s>/]+", "", found[1], flags=re.ASCII) if found else ""):
        value = _VALUE_OF.match(a)
        out.setdefault(_NAME_OF.match(a)[1].lower(), decode_entities(re.sub(r"""^["']|["']$""", "", value[1]) if value else ""))
    return out


class Step:
    """One step of a path: tag, ids, classes and conditions of an element."""

    def __init__(self, text: str):
        bare = _CONDITION.sub("", text)
        tag = _TAG.match(bare)
        self.tag = tag[1].lower() if tag else ""
        self.ids, self.classes, self.child = _ID.findall(bare), _CLASS.findall(bare), text.startswith(">")
        asked = (_ASKED.match(c) for c in _CONDITION.findall(text))
        self.conditions = [(m[1].lower(), m[2] or "", re.sub(r"""^["']|["']$""", "", m[3] or "")) for m in asked]
        self.key = f"#{self.ids[0]}" if self.ids else f".{self.classes[0]}" if self.classes else self.tag

    def fits(self, tag: str, attrs: dict[str, str], classes: list[str]) -> bool:
        if self.tag not in ("", tag) or not set(self.classes) <= set(classes) or any(i != attrs.get("id") for i in self.ids):
            return False
        return all(self._holds(attrs.get(name), test, wanted) for name, test, wanted in self.conditions)

    @staticmethod
    def _holds(value: str | None, test: str, wanted: str) -> bool:
        if value is None:
            return False
        if test in ("", "="):
            return not test or value == wanted
        if test == "~=":
            return wanted in _SPACE.split(value)
        if test == "|=":
            return value == wanted or value.startswith(f"{wanted}-")
        return wanted != "" and (value.startswith(wanted) if test == "^=" else value.endswith(wanted) if test == "$=" else wanted in value)


class SelectorIndex:
    """The base selectors and field selectors of a domain. ``specs`` are field rows with ``base_selector, field,
    selector, type, attribute, default_value, place``."""

    def __init__(self, specs: list[dict]):
        order = lambda s: (s["place"], s["selector"], s["base_selector"])
        self.specs = sorted(specs, key=order)
        self.first = self.child = self.last = 0
        self.by_key: dict[str, list[tuple[int, Step]]] = {}
        self.owner: dict[int, tuple[str, int | None]] = {}
        self.bit = 1
        self.fields: dict[str, list[int]] = {}
        for k, s in enumerate(self.specs):
            self.fields.setdefault(s["base_selector"], []).append(k)
            self._add(s["selector"], s["base_selector"], k)
        for base in self.fields:
            self._add(base, base, None)
        self.matched: dict[tuple[str, str], int] = {}

    def _add(self, selector: str, base: str, field: int | None) -> None:
        for path in _PATH.findall(selector.strip()):
            self.first |= self.bit
            for text in _STEP.findall(path):
                step = Step(text.strip())
                self.by_key.setdefault(step.key, []).append((self.bit, step))
                self.child |= self.bit * step.child
                self.bit <<= 1
            self.last |= self.bit >> 1
            self.owner[self.bit >> 1] = base, field

    def steps_of(self, tag: str, src: str) -> int:
        """The steps that an element satisfies by itself."""
        found = self.matched.get((tag, src))
        if found is None:
            attrs = attributes(src)
            classes = _SPACE.split(attrs.get("class", ""))
            keys = {"", tag, f"#{attrs.get('id', '')}", *(f".{c}" for c in classes)}
            found = sum(bit for k in keys for bit, step in self.by_key.get(k, ()) if step.fits(tag, attrs, classes))
            if len(self.matched) >= REMEMBERED:
                self.matched.clear()
            self.matched[tag, src] = found
        return found

    def bases(self, page: Page) -> Iterator[tuple[int, dict[str, str]]]:
        """``start, values by field`` of each base element of a page, in order.

        A field's value comes from the first element inside the base that its selector finds, or from the base
        itself if it has none; of fields of one name the first with a value counts.
        """
        stack: list[tuple[int, int, int, int]] = []  # end, steps matched, by it or around it, least end so far
        inside: dict[str, list[Base]] = {}
        found: dict[int, list[Base]] = {}
        for start, end, tag, src in page.opened():
            while stack and stack[-1][0] < start:
                stack.pop()
            parent = around = 0
            if stack:
                top_end, parent, around, least = stack[-1]
                if least < end:  # elements that overlap: only those around it whole count
                    parent = parent if top_end >= end else 0
                    around = 0
                    for e, own, _, _ in stack:
                        around |= own if e >= end else 0
            matched = (self.first | (around << 1) & ~self.child | (parent << 1) & self.child) & self.steps_of(tag, src)
            stack.append((end, matched, around | matched if not stack or stack[-1][3] >= end else self._all(stack) | matched, min(end, stack[-1][3]) if stack else end))
            hits, opening = matched & self.last, []
            while hits:
                bit = hits & -hits
                hits ^= bit
                base, field = self.owner[bit]
                if field is None:
                    opening.append(base)
                else:
                    self._give(inside.get(base, []), field, start, end)
            for base in dict.fromkeys(opening):
                open_ = inside.setdefault(base, [])
                while open_ and open_[-1].end < start:
                    open_.pop()
                own = Base(base, start, end, not open_ or open_[-1].nested and open_[-1].end >= end)
                open_.append(own)
                found.setdefault(start, []).append(own)
        for start, bases in found.items():
            yield start, self._values(page, bases)

    @staticmethod
    def _all(stack: list) -> int:
        out = 0
        for _, own, _, _ in stack:
            out |= own
        return out

    @staticmethod
    def _give(open_: list, field: int, start: int, end: int) -> None:
        while open_ and open_[-1].end < start:
            open_.pop()
        for base in reversed(open_):
            if base.start < start and end <= base.end:
                if base.hits.setdefault(field, (start, end)) != (start, end) and base.nested:
                    return  # whatever is around this one has the field too

    def _values(self, page: Page, bases: list) -> dict[str, str]:
        out: dict[str, str] = {}
        for k in sorted(k for base in bases for k in self.fields[base.selector]):
            spec = self.specs[k]
            if spec["field"] in out:
                continue
            base = next(b for b in bases if b.selector == spec["base_selector"])
            place = (base.start, base.end) if spec["selector"] == "" else base.hits.get(k)
            value = None
            if place:
                if spec["type"] == "html":
                    value = page.markup(*place)
                elif spec["type"] == "attribute":
                    value = attributes(page.source(place[0])).get(spec["attribute"].lower())
                else:
                    value = page.text_of(*place)
            value = spec["default_value"] if value is None else value
            if value is not None:
                out[spec["field"]] = value
        return out


class Base:
    """A base element with the first hit of each field inside it. ``nested``: those around it hold it whole."""

    __slots__ = ("selector", "start", "end", "nested", "hits")

    def __init__(self, selector: str, start: int, end: int, nested: bool):
        self.selector, self.start, self.end, self.nested = selector, start, end, nested
        self.hits: dict[int, tuple[int, int]] = {}
