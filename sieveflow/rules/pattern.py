"""Code patterns with metavariables and ellipses, as regular expressions.

A pattern is cut into tokens: metavariables (``$X``), ellipses (``...``), regex comparisons of strings
(``=~/re/``), white space and literal text. Each has its own expression; an ellipsis beside a comma
takes the comma with it, so that ``f(..., $X)`` also matches a call with one argument.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(r"(?P<string>\s*=~/(?P<body>(?:\\.|[^\\])*)/)|(?P<var>\$[A-Za-z_]\w*)|(?P<dots>\.\.\.)|(?P<comma>,\s*)|(?P<space>\s+)|(?P<text>.)", re.S)
#: Any text on one line, as little as possible; it is a group.
ANYTHING = r"([^\n]*?)"


def metavariable_regex(regex: str) -> str:
    """A metavariable's own regex without its anchors, which are the pattern's to decide."""
    for old, new in ((r"\A", "^"), (r"\Z", "$"), (r"\z", "$")):
        regex = regex.replace(old, new)
    regex = regex.lstrip("^")
    while regex.endswith("$") and not regex.endswith(r"\$"):
        regex = regex[:-1]
    return f"(?:{regex})[^\\n]*?" if only_looks_around(regex) else regex


def only_looks_around(regex: str) -> bool:
    """Whether a regex is one look-around and so matches no text of its own."""
    if not re.match(r"\(\?(?:=|!|<=|<!)", regex):
        return False
    depth, i = 0, 0
    while i < len(regex):
        if regex[i] == "\\":
            i += 1
        else:
            depth += (regex[i] == "(") - (regex[i] == ")")
            if depth == 0:
                return i == len(regex) - 1
        i += 1
    return False


@dataclass(frozen=True)
class Compiled:
    """regex; groups: the number of the group of each metavariable, first occurrence first."""

    regex: str
    groups: dict[str, int]


def groups_in(regex: str) -> int:
    """Capturing groups of an expression."""
    n, i, in_class = 0, 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += regex[i + 1 : i + 2] == "]"
        elif c == "(" and (regex[i + 1 : i + 2] != "?" or re.match(r"\(\?(?:P?<[A-Za-z_]|')", regex[i:])):
            n += 1
        i += 1
    return n


def translate(pattern: str, variables: dict[str, str] | None = None) -> Compiled:
    """The expression of a pattern; metavariables in ``variables`` match their own regex.

    A pattern that is nothing but a metavariable without a regex stands for itself (``$_GET``).
    """
    variables = variables or {}
    whole = pattern.strip()
    if re.fullmatch(r"\$[A-Za-z_]\w*", whole) and whole[1:] not in variables:
        return Compiled(re.escape(whole), {})
    tokens = [(m.lastgroup if m.lastgroup != "body" else "string", m) for m in TOKEN.finditer(pattern.strip("\n"))]
    out: list[str] = []
    groups: dict[str, int] = {}
    n, i = 0, 0
    kinds = [k for k, _ in tokens]
    while i < len(tokens):
        kind, m = tokens[i]
        if kind == "dots":
            if kinds[i + 1 : i + 2] == ["comma"]:
                out.append(r"(?:.*?,\s*)?")  # anything and a comma, or neither
                i += 2
                continue
            out.append(".*?")
        elif kind == "comma":
            if kinds[i + 1 : i + 2] == ["dots"]:
                out.append(r"(?:,\s*.*?)?")
                i += 2
                continue
            out.append(r",\s*" if len(m[0]) > 1 else ",")
        elif kind == "space":
            out.append(r"\s+")
        elif kind == "var":
            name = m[0][1:]
            own = f"({metavariable_regex(variables[name])})" if name in variables else ANYTHING
            groups.setdefault(name, n + 1)
            n += groups_in(own)
            out.append(own)
        elif kind == "string":
            body = m["body"]
            double, single = body.replace('"', r"\""), body.replace("'", r"\'")
            own = rf"\s*=~?\s*(?:\"{double}\"|'{single}'|{body})"
            n += groups_in(own)
            out.append(own)
        else:
            out.append(re.escape(m[0]))
        i += 1
    return Compiled("".join(out), groups)


def exact(pattern: str, variables: dict[str, str] | None = None) -> Compiled:
    """Matches where the pattern is; dots cross lines if the text does."""
    c = translate(pattern, variables)
    return Compiled(f"(?s){c.regex}", c.groups)


def anywhere(pattern: str, variables: dict[str, str] | None = None) -> Compiled:
    """Matches texts that hold the pattern somewhere."""
    c = translate(pattern, variables)
    return Compiled(f"(?s).*{c.regex}.*", c.groups)


def unit_of(regex: str, is_regex: bool) -> str:
    """What a regex is run over: given regexes, and those with classes or named or look-around groups, the whole source."""
    return "source" if is_regex or ("[" in regex and "]" in regex) or re.search(r"\(\?(?:<|=|!)", regex) else "line"
