"""One page taken apart in Python: its tokens, and its elements as intervals of tokens.

Everything here handles one page and holds memory linear in its size: rows of elements are made one by
one, and text or markup is cut out when a row is. ``operators/elements.py`` applies it to page tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate

from pagemill.functions import patterns as P

_TOKEN = re.compile(P.TOKEN)
_TAG = re.compile(r"</?([A-Za-z][^ \t\n\x0b\f\r>/]*)")
_RAW_END = re.compile(r"(?i)</(script|style)[ \t\n\x0b\f\r]*>$")
_OPEN = re.compile(P.OPEN_TAG)
_REFERENCE = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9A-Fa-f]+)|([A-Za-z][A-Za-z0-9]*));")
_VOID, _BLOCK, _ROOT = set(P.VOID_TAGS), set(P.BLOCK_TAGS), set(P.ROOT_TAGS)


def _character(match: re.Match) -> str:
    if match[3]:
        return P.ENTITIES.get(match[3], match[0])
    digits = match[1] or match[2]
    # More digits than any character has: no need to read them.
    n = int(digits, 10 if match[1] else 16) if len(digits.lstrip("0")) < 9 else 0
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"


def decode_entities(text: str) -> str:
    """Named references of ``ENTITIES`` and numeric ones, once each; a number that is no character gives U+FFFD."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


class Page:
    """Tokens of a page with their kinds and tags, and the stripped text of its text tokens.

    Kinds: ``text``, ``comment``, ``doctype``, ``close``, ``raw`` (a whole script or style),
    ``void`` or ``open``.
    """

    def __init__(self, html: str | None):
        self.tokens = _TOKEN.findall(html or "")
        self.kinds: list[str] = []
        self.tags: list[str] = []
        self.texts: list[str] = []
        for tok in self.tokens:
            tag, text = "", ""
            if tok[0] != "<" or tok == "<":
                kind, text = "text", decode_entities(tok).strip()
            elif not (found := _TAG.match(tok)):
                kind = "comment" if tok.startswith("<!--") else "doctype" if tok.startswith("<!") else "text"
            else:
                tag = found[1].lower()
                if tok.startswith("</"):
                    kind = "close"
                elif tag in ("script", "style") and _RAW_END.search(tok):
                    kind = "raw"
                else:
                    kind = "void" if tag in _VOID or tok.endswith("/>") else "open"
            self.kinds.append(kind)
            self.tags.append(tag)
            self.texts.append(text)

    def spans(self) -> list[tuple[int, int, bool]]:
        """``start, end, closed`` of each element, in order of starts.

        Void tags and script/style blocks close at once; ``p`` ends at its own close tag or before
        the next block-level tag; any other tag ends at the close tag of its own nesting level; an
        unclosed tag ends before the next block-level tag, and an unclosed root tag at the end.
        """
        last = len(self.tokens) - 1
        mate: dict[int, int] = {}
        open_: dict[str, list[int]] = {}
        for i, (kind, tag) in enumerate(zip(self.kinds, self.tags, strict=True)):
            if kind == "open" and tag != "p":
                open_.setdefault(tag, []).append(i)
            elif kind == "close" and open_.get(tag):
                mate[open_[tag].pop()] = i
        out = []
        block = -1  # the next block-level tag after the one at hand, going backwards
        for i in range(last, -1, -1):
            kind, tag = self.kinds[i], self.tags[i]
            if kind in ("void", "raw"):
                out.append((i, i, False))
            elif kind == "open":
                before = last if block < 0 else block - 1
                if tag == "p":
                    own = block >= 0 and self.tags[block] == "p" and self.kinds[block] == "close"
                    out.append((i, block if own else before, own))
                elif i in mate:
                    out.append((i, mate[i], True))
                else:
                    out.append((i, last if tag in _ROOT else before, False))
            if tag in _BLOCK and kind in ("open", "close", "void"):
                block = i
        return out[::-1]

    def _actions(self) -> list[int]:
        """1 at each close tag of an <a> or <button> whose only content is one text that asks for an
        action, possibly wrapped: k close tags after it belong to the k open tags right before it."""
        out, opens, inside = [], 0, None
        for i, (kind, tag, tok) in enumerate(zip(self.kinds, self.tags, self.tokens, strict=True)):
            says = inside is not None and kind == "close" and tag in ("a", "button") and i - inside[0] <= inside[1]
            out.append(int(says))
            if kind != "close":
                asks = kind == "text" and any(w in tok.lower() for w in P.ACTION_WORDS)
                inside = (i, opens) if asks else None
            opens = opens + 1 if kind == "open" else 0
        return out

    @cached_property
    def kept(self) -> tuple[list[str], list[int]]:
        """The texts that aren't empty, and how many of them come before each token."""
        return [t for t in self.texts if t], [0, *accumulate(int(t != "") for t in self.texts)]

    def text_of(self, start: int, end: int, separator: str = "") -> str:
        kept, before = self.kept
        return separator.join(kept[before[max(start, 0)] : before[end + 1]])

    def markup(self, start: int, end: int) -> str:
        return "".join(self.tokens[max(start, 0) : end + 1])

    def source(self, start: int) -> str:
        """The open tag of the element that starts there; -1 is the body of a page without one."""
        if start < 0:
            return "<body>"
        return _OPEN.match(self.tokens[start])[1] if self.kinds[start] == "raw" else self.tokens[start]

    def _all_spans(self) -> list[tuple[int, int, bool]]:
        spans = self.spans()
        if self.tokens and "body" not in self.tags:
            spans = [(-1, len(self.tokens) - 1, False), *spans]  # a page without a body is one itself
        return spans

    def opened(self) -> Iterator[tuple[int, int, str, str]]:
        """``start, end, tag, open tag`` of each element, in order of starts."""
        for start, end, _ in self._all_spans():
            yield start, end, "body" if start < 0 else self.tags[start], self.source(start)

    def elements(self, text: bool | tuple[int, int], fragment: bool) -> list[tuple]:
        return list(self.rows(text, fragment))

    def rows(self, text: bool | tuple[int, int], fragment: bool) -> Iterator[tuple]:
        """Rows of the element table (see ``operators/elements.py``), one by one.

        With bounds as ``text``, only elements with more than the first and less than the second number of
        characters have their text.
        """
        spans = self._all_spans()
        size = len(self.tokens)
        sums = lambda values: [0, *accumulate(values)]
        chars, octets = sums(map(len, self.tokens)), sums(len(t.encode()) for t in self.tokens)
        lines = sums(t.count("\n") for t in self.tokens)
        letters = sums(len(t) + 1 if t else 0 for t in self.texts)
        words = sums(len(t.split()) for t in self.texts)
        action = self._actions()
        actions = sums(action)
        images = sums(int(k == "void" and t == "img") for k, t in zip(self.kinds, self.tags, strict=True))
        around = int(bool(spans) and spans[0][0] < 0)
        steps = [0] * (size + 1)
        for start, end, _ in spans[around:]:
            steps[start] += 1
            steps[end + 1] -= 1
        depth = list(accumulate(steps))
        low, high = text if isinstance(text, tuple) else (-1, chars[-1] + 1) if text else (0, 0)
        above: list[tuple[int, int]] = []  # elements around the one at hand, innermost last
        for start, end, closed in spans:
            while above and above[-1][1] < start:
                above.pop()
            parent = above[-1][0] if above else None
            above.append((start, end))
            made = start < 0
            here, stop, own = start + 1, end + 1, int(closed)
            begin = 0 if made else start
            text_len = max(letters[stop] - letters[here] - 1, 0)
            yield (
                start, "body" if made else self.tags[start], self.source(start), start, end, parent, closed,
                0 if made else depth[start] - 1 + around, chars[begin], chars[stop] - chars[begin],
                octets[stop] - octets[here] - own * len(self.tokens[end].encode()),
                lines[begin] + 1, lines[stop] - lines[begin] + 1,
                text_len, words[stop] - words[here], images[stop] - images[here],
                actions[stop] - actions[here] - own * action[end],
                self.text_of(here, end, " ") if low < text_len < high else None,
                self.markup(start, end) if fragment else None,
            )

    def without(self, tags: Iterable[str], comments: bool) -> str:
        """The page without elements of these tags and their content."""
        tags, reach, out = set(tags), -1, []
        ends = {start: end for start, end, _ in self.spans() if self.tags[start] in tags}
        for i, tok in enumerate(self.tokens):
            reach = max(reach, ends.get(i, -1))
            if i > reach and not (comments and self.kinds[i] == "comment"):
                out.append(tok)
        return "".join(out)

    def outline(self) -> str:
        """One token a line, indented by a space per open element; an own close tag is back on its element's level."""
        steps = [0] * (len(self.tokens) + 2)
        for start, end, closed in self.spans():
            steps[start + 1] += 1
            steps[end + (0 if closed else 1)] -= 1
        levels = accumulate(steps)
        lines = ((d, t.strip()) for d, t in zip(levels, self.tokens))
        return "".join(f"{' ' * d}{line}\n" for d, line in lines if line)
