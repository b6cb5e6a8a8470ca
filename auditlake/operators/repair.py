"""A reader of JSON with faults: a pushdown automaton that knows whether it stands in a string, a key or a value."""

from __future__ import annotations

import json
import re

#: Containers open at once; text that opens more is no payload.
DEEPEST = 256
_LITERALS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")
_QUOTE = re.compile(r'[\\"]')
#: What may come behind the end of a string: a mark, the end of the text, or (a comma was forgotten) the next key.
_AFTER = re.compile(r'\s*(?:[,:}\]]|\Z|"[^"\\\n]{1,80}"\s*:)')
_START = re.compile(r"[{\[]")
_QUOTED_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*(:?)', re.DOTALL)
_BARE_KEY = re.compile(r"\s*([^\s:{}\[\],\"][^:{}\[\],\"\n]{0,80}?)\s*:")
_BARE = re.compile(r'[^,{}\[\]"\n]+')
_GAP = re.compile(r"[\s,]+")


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that starts behind the quote before ``at``, and the place behind it. A quote within it counts as text unless what
    follows looks like the end; a string without an end goes to the end of the text."""
    seek = at
    while (m := _QUOTE.search(text, seek)) is not None:
        if m[0] == "\\":
            seek = m.end() + 1
        elif _AFTER.match(text, m.end()):
            return _decoded(text[at : m.start()]), m.end()
        else:
            seek = m.end()
    return _decoded(text[at:]), len(text)


def _decoded(said: str) -> str:
    """Escapes resolved; a quote within, or a wrong escape, stands for itself."""
    if "\\" not in said:
        return said
    try:
        return json.loads(f'"{re.sub(r'(\\.)|"', lambda m: m[1] or '\\"', said, flags=re.DOTALL)}"', strict=False)
    except ValueError:
        return re.sub(r"\\([\"\\/])", r"\1", said)


def _bare_value(said: str):
    said = said.strip()
    if said in _LITERALS:
        return _LITERALS[said]
    return json.loads(said) if _NUMBER.fullmatch(said) and not re.match(r"-?0\d", said) else said


class _Open:
    """A container not yet closed, with the key that waits for a value."""

    def __init__(self, held: list | dict) -> None:
        self.held, self.key = held, None

    def add(self, value) -> None:
        if isinstance(self.held, list):
            self.held.append(value)
        else:
            self.held.setdefault(self.key, value)
            self.key = None


def containers(text: str) -> list:
    """The outermost objects and arrays of a text, in order, faults put right: strings with quotes in them, bare keys and values, missing or
    surplus commas, closing marks that lack or don't fit. What stands between them is passed over. Of a key that repeats the first
    value counts. Every step moves on in the text, so time is in proportion to it. Text that opens too many at once gives none."""
    roots, stack, at, end = [], [], 0, len(text)
    while at < end:
        if not stack:
            if (start := _START.search(text, at)) is None:
                break
            at = start.start()
        elif (gap := _GAP.match(text, at)) is not None:
            at = gap.end()
            continue
        c, top = text[at], stack[-1] if stack else None
        if c in "{[":
            if top is not None and isinstance(top.held, dict) and top.key is None:
                at += 1  # an object can't hold one without a key
                continue
            fresh: list | dict = {} if c == "{" else []
            (top.add if top else roots.append)(fresh)
            stack.append(_Open(fresh))
            if len(stack) > DEEPEST:
                return []
            at += 1
        elif c in "}]":
            wanted = dict if c == "}" else list
            fits = next((k for k in range(len(stack) - 1, -1, -1) if isinstance(stack[k].held, wanted)), None)
            if fits is not None:
                del stack[fits:]
            at += 1
        elif isinstance(top.held, dict) and top.key is None:
            at = _key(text, at, top)
        elif c == '"':
            value, at = _string(text, at + 1)
            top.add(value)
        elif (m := _BARE.match(text, at)) is not None:
            top.add(_bare_value(m[0]))
            at = m.end()
        else:
            at += 1
    return roots


def _key(text: str, at: int, top: _Open) -> int:
    """Read a key and its colon; what is none is passed over."""
    if (m := _QUOTED_KEY.match(text, at)) is not None:
        if m[2]:
            top.key = _decoded(m[1])
        return m.end()
    if (m := _BARE_KEY.match(text, at)) is not None:
        top.key = m[1].strip().strip("'")
        return m.end()
    skipped = _BARE.match(text, at)
    return skipped.end() if skipped is not None else at + 1
