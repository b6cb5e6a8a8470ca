"""Pages cut into leaf blocks: runs of text that no block-level tag divides."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import islice

#: A quote opens a value only behind an equals sign, and closes it only where the tag could go on. A tag ends at its mark, else before the
#: next tag or at the end of the page. So every tag is matched where it starts, and no place is read for more than one of them.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"'=]|=\s*(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))?|[\"'])*+)(?:>|(?=<)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.DOTALL,
)
#: Tags and name parts of a block's path, those nearest to it.
PATH_PARTS = 96
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")

#: Their content is not markup, and not text of the page; without an end tag it goes on to the end of the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Controls and templates, whose own extent is not text of the page either. One without an end tag, or with another of its kind or an
#: article before it, ends with the text that follows it.
CONTROLS = frozenset("select option button datalist template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q s samp small span strike strong sub sup svg time tt u var "
    "mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle semantics g text tspan path".split()
)
#: Opening one of these ends an open element of the set beside it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass
class Block:
    """Text with white space turned into single spaces; tags and name parts from the page's root (the last PATH_PARTS); characters inside
    links."""

    text: str
    path: tuple[str, ...]
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    found = [a or b or c for a, b, c in _NAMES.findall(attributes)]
    return tuple(f".{p}" for value in found for p in _PARTS.findall(value.lower()))


class _Ends:
    """Ends of elements in a page; each stretch of it is searched once, however many elements lack an end tag."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def _next(self, pattern: str, at: int) -> tuple[int, int] | None:
        start, span = self.found.get(pattern, (len(self.page) + 1, None))
        if not start <= at <= (span[0] if span else len(self.page)):
            match = re.compile(pattern, re.IGNORECASE).search(self.page, at)
            span = match.span() if match else None
            self.found[pattern] = (at, span)
        return span

    def of_raw(self, tag: str, at: int) -> int:
        span = self._next(rf"</{tag}\b[^>]*>", at)
        return span[1] if span else len(self.page)

    def of_control(self, tag: str, at: int) -> int:
        end = self._next(rf"</{tag}\b[^>]*>", at)
        other = self._next(rf"<(?:{tag}|article|main|body)\b", at)
        if end and not (other and other[0] < end[0]):
            return end[1]
        tag_starts = self.page.find("<", at)
        return tag_starts if tag_starts >= 0 else len(self.page)


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks in page order. Comments, declarations and the content of scripts, styles, forms' controls and the like are left out;
    unclosed and stray tags are tolerated; character references are decoded; ``br`` is white space."""
    page = page or ""
    ends = _Ends(page)
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    links, linked, at = 0, 0, 0
    open_tags: Counter[str] = Counter()  # so that no tag searches the stack for what isn't there

    def path() -> tuple[str, ...]:
        parts: list[str] = []
        for tag, names in islice(reversed(stack), 4 * PATH_PARTS):
            if tag not in INLINE:
                parts += [*reversed(names), tag]
                if len(parts) >= PATH_PARTS:
                    break
        return tuple(reversed(parts[:PATH_PARTS]))

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(text, path(), min(linked, len(text))))
            pieces, linked = [], 0

    def close(k: int) -> None:
        nonlocal links
        if any(tag not in INLINE for tag, _ in stack[k:]):
            flush()
        links -= sum(tag == "a" for tag, _ in stack[k:])
        open_tags.subtract(tag for tag, _ in stack[k:])
        del stack[k:]

    while match := _TOKEN.match(page, at):
        at = match.end()
        tag = match[2]
        if tag is None:
            piece = match[0]
            if piece[0] != "<" or piece == "<":
                decoded = html.unescape(piece) if "&" in piece else piece
                pieces.append(decoded)
                if links:
                    linked += len(decoded.strip())
            continue
        tag = tag.lower()
        if match[1]:
            for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                pieces.append("" if tag == "wbr" else " ")
            continue
        if tag in RAW or tag in CONTROLS:
            if not match[3].endswith("/"):
                at = ends.of_raw(tag, at) if tag in RAW else ends.of_control(tag, at)
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS and any(open_tags[t] for t in ENDS[tag]):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ENDS[tag]:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table"):
                        break
            if open_tags["p"]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"))
        elif tag == "a":
            links += 1
        stack.append((tag, _names(match[3]) if match[3] else ()))
        open_tags[tag] += 1
    flush()
    return blocks
