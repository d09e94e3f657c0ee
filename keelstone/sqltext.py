"""SQL text as tokens: what looks like a name inside a string, a quoted name or a comment is left alone."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<hint>/\*\+.*?\*/)
      | (?P<line>--[^\n]*)
      | (?P<block>/\*)
      | (?P<string>'(?:[^'\\]|\\.|'')*' | "(?:[^"\\]|\\.|"")*")
      | (?P<quoted>`(?:[^`]|``)*`)
      | (?P<word>\w+)
      | (?P<space>\s+)
      | (?P<sign>.)""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "0": "\0"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def tokens(text: str) -> list[Token]:
    """Every part of the text, in order; comments (bracketed ones may be nested) are of kind ``comment``."""
    found, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind = m.lastgroup
        if kind == "block":
            depth, end = 0, at
            for edge in re.finditer(r"/\*|\*/", text[at:]):
                depth += 1 if edge[0] == "/*" else -1
                end = at + edge.end()
                if not depth:
                    break
            found.append(Token("comment", text[at : end if not depth else len(text)], at))
        else:
            found.append(Token("comment" if kind == "line" else kind, m[0], at))
        at = found[-1].end
    return found


def without_comments(text: str) -> str:
    """Comments become a blank; hints stay."""
    return "".join(" " if t.kind == "comment" else t.text for t in tokens(text))


def masked(text: str) -> str:
    """The text, as long as before, with the inside of strings and quoted names blotted out, to match statements on."""
    return "".join(t.text[0] + "x" * (len(t.text) - 2) + t.text[-1] if t.kind in ("string", "quoted") else t.text for t in tokens(text))


class Match:
    """A match on the masked text whose groups are cut from the text itself."""

    def __init__(self, text: str, found: re.Match):
        self.text, self.found = text, found

    def __getitem__(self, group: int) -> str | None:
        low, high = self.found.span(group)
        return None if low < 0 else self.text[low:high]

    def start(self, group: int = 0) -> int:
        return self.found.start(group)

    def end(self, group: int = 0) -> int:
        return self.found.end(group)


def match(pattern: str, text: str, anywhere: bool = False) -> Match | None:
    run = re.search if anywhere else re.match
    found = run(pattern, masked(text), re.I | re.S)
    return Match(text, found) if found else None


def unquoted(text: str) -> str:
    """The value of a string or the name in back quotes; other text as it is, trimmed."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"`":
        body = text[1:-1].replace(text[0] * 2, text[0])
        return body if text[0] == "`" else re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)
    return text


def literal(value: str) -> str:
    """A text as a SQL string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def split(text: str, sign: str = ",", most: int = -1) -> list[str]:
    """Parts between a sign that stands outside brackets, strings and quoted names; empty parts are left out."""
    parts, depth, start = [], 0, 0
    for t in tokens(text):
        if t.kind != "sign":
            continue
        if t.text in "(<":
            depth += 1
        elif t.text in ")>":
            depth -= 1 if depth else 0
        elif t.text == sign and not depth and most:
            parts.append(text[start : t.start])
            start, most = t.end, most - 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def pairs(text: str) -> dict[str, str]:
    """``key = value`` lists; keys and values may be strings."""
    found = {}
    for part in split(text):
        key, value = [*split(part, "=", 1), ""][:2]
        found[unquoted(key)] = unquoted(value)
    return found


def bracketed(text: str) -> str | None:
    """What stands in the brackets with which the text begins (after blanks)."""
    depth, start = 0, None
    for t in tokens(text):
        if t.kind == "space" and start is None:
            continue
        if start is None and t.text != "(":
            return None
        if t.kind == "sign" and t.text == "(":
            depth += 1
            start = t.end if start is None else start
        elif t.kind == "sign" and t.text == ")":
            depth -= 1
            if not depth:
                return text[start : t.start]
    return None


def replace_tables(text: str, prefix: str, new: Callable[[str], str]) -> str:
    """``prefix.name`` and ``prefix.`name` ``, wherever they are code, replaced by ``new(name)``."""
    parts = tokens(text)
    out, i = [], 0
    code = lambda j: next((k for k in range(j, len(parts)) if parts[k].kind not in ("space", "comment")), None)
    before = ""
    while i < len(parts):
        t = parts[i]
        dot = code(i + 1) if t.kind in ("word", "quoted") and unquoted(t.text).lower() == prefix and before != "." else None
        name = code(dot + 1) if dot is not None and parts[dot].text == "." else None
        if name is not None and parts[name].kind in ("word", "quoted"):
            out.append(new(unquoted(parts[name].text)))
            before, i = "name", name + 1
            continue
        if t.kind not in ("space", "comment"):
            before = t.text
        out.append(t.text)
        i += 1
    return "".join(out)


def without_alias(text: str, alias: str) -> str:
    """The text with ``alias.`` taken away in front of names."""
    parts = tokens(text)
    out, i = [], 0
    while i < len(parts):
        own = parts[i].kind in ("word", "quoted") and unquoted(parts[i].text).lower() == alias.lower()
        if own and i + 1 < len(parts) and parts[i + 1].text == "." and (not i or parts[i - 1].text != "."):
            i += 2
            continue
        out.append(parts[i].text)
        i += 1
    return "".join(out)


def has_table(text: str, prefix: str) -> bool:
    found = []
    replace_tables(text, prefix, lambda name: found.append(name) or "")
    return bool(found)
