"""Calls with their arguments, and what passes through them by position.

Where calls and functions are comes from the syntax trees; their arguments, parameters and returned expressions are
segments of the text, read with their nesting. Tables of the three are joined by name and position to edges between
variables of functions, over which taint is walked through the whole corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.batches import in_pieces
from sieveflow.functions.durable import cut, shuffled
from sieveflow.sources.code import FUNCTION, Program, table_of

from .graph import reach
from .layout import Layout

CALL_KINDS = ("Call", "CallExpression")
#: The node that stands for what a function returns.
RETURNED = "@return"
_OPEN, _CLOSE = "([{", ")]}"
_QUOTED = re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`")
#: Types between angles right after a name.
_ANGLES = re.compile(r"(?<=[\w:])<(?:[\w\s,&\[\]:.?*$']|->|<(?:[\w\s,&\[\]:.?*$']|<[\w\s,&\[\]:.?*$']*>)*>)*>")
_RETURN = re.compile(r"(?<![\w$])return\b[ \t]*([^;\n}]*)")
_CALLED = re.compile(r"(\$?[A-Za-z_][\w.:>$-]*)\s*$")
_TARGET = re.compile(r"(\$?[A-Za-z_]\w*)\s*(?::\s*[\w<>\[\]&., ]+)?\s*:?=\s*(?:await\s+|new\s+|&\s*)?$")
_ASSIGN = re.compile(r"(?m)^[ \t]*(?:(?:let|const|var|final|mut|auto|[A-Z]\w*(?:<[^<>=;\n]*>)?)[ \t]+)*(\$?[A-Za-z_]\w*)[ \t]*(?::[^=\n]*)?[+.:]?=(?![=>~])[ \t]*([^;\n]*)")
_NAMES = re.compile(r"(?<![\w.>])\$?[A-Za-z_]\w*")


def segments(text: str, at: int) -> tuple[list[str], int]:
    """The parts between commas of the brackets that open at a place, and where these close (the end, if they don't).

    Brackets of all kinds, quotes and the angles of types nest; a comparison's ``<`` doesn't.
    """
    parts, depth, begin, i = [], 0, at + 1, at
    while i < len(text):
        c = text[i]
        if c in "'\"`" and (m := _QUOTED.match(text, i)) or c == "<" and (m := _ANGLES.match(text, i)):
            i = m.end()
            continue
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if depth <= 0:
                break
        elif c == "," and depth == 1:
            parts.append(text[begin:i].strip())
            begin = i + 1
        i += 1
    last = text[begin:i].strip()
    return [*parts, last] if last or parts else [], i


def read_names(text: str) -> tuple[list[str], list[str]]:
    """(variables, called functions) of an expression; what is inside a call's brackets is the call's own."""
    text = _QUOTED.sub(" ", text)
    called, flat, i = [], [], 0
    while (k := text.find("(", i)) >= 0:
        m = _CALLED.search(text, i, k)
        if m and m.end() == k or m and not text[m.end() : k].strip():
            called.append(m[1])
            flat.append(text[i : m.start()])
            i = segments(text, k)[1] + 1
        else:  # plain brackets
            flat.append(text[i:k])
            i = k + 1
    flat.append(text[i:])
    names = dict.fromkeys(n for n in _NAMES.findall(" ".join(flat)))
    return list(names), called


def parameter(text: str, language: str) -> str:
    """A parameter's name without its type, default and marks."""
    text = re.split(r"(?<![=!<>])=(?!=)", text)[0].strip()
    if language in ("rust", "python", "typescript", "javascript"):
        text = text.split(":")[0]
    found = re.findall(r"\$?[A-Za-z_]\w*", text)
    if not found:
        return ""
    return found[0] if language == "go" else found[-1]


def function_spans(language: str, layout: Layout) -> list[tuple[int, int, str]]:
    """(start, end, name) of a text's functions: by braces, in Python by indentation, in Ruby by ``end`` at the indentation of ``def``."""
    text, out = layout.text, []
    for m in re.finditer(FUNCTION.get(language, r"\bdef\s+(\w+)"), text):
        start = m.start(1)
        if language in ("python", "ruby"):
            indent = re.match(r"[ \t]*", layout.line_before(m.start() + 1))[0]
            after = re.compile(rf"^[ \t]{{0,{len(indent)}}}(?![ \t])(?=\S)(?![)\]}}#])" if language == "python" else rf"^{indent}end\b", re.M)
            done = after.search(text, min(len(text), text.find("\n", m.end()) % (len(text) + 1)))
            end = done.start() if done else len(text)
        else:
            opened = text.find("(", start)
            body = text.find("{", segments(text, opened)[1]) if opened >= 0 else -1
            end = layout.block_end(body) if body >= 0 else len(text)
        out.append((start, end, m[1]))
    return sorted(out, key=lambda x: (x[0], -x[1]))


class Scopes:
    """The innermost function around a place; outside all functions the file itself, as ``@`` and its path."""

    def __init__(self, file: str, language: str, layout: Layout):
        self.spans = function_spans(language, layout)
        self.starts = [a for a, _, _ in self.spans]
        self.file = f"@{file}"
        self.up: list[int] = []
        stack: list[int] = []
        for i, (a, _, _) in enumerate(self.spans):
            while stack and self.spans[stack[-1]][1] <= a:
                stack.pop()
            self.up.append(stack[-1] if stack else -1)
            stack.append(i)

    def of(self, at: int) -> str:
        i = bisect_right(self.starts, at) - 1
        while i >= 0 and self.spans[i][1] <= at:
            i = self.up[i]
        return self.spans[i][2] if i >= 0 else self.file


def _rows(file: str, language: str, source: str, functions: list, calls: list) -> Iterator[tuple]:
    """(what, function, position, text, line, column, callee, target) of one file; what is outside all functions is the file's own."""
    layout = Layout(source)
    offset = lambda line, column: layout.line_starts[line - 1] + _chars(source, layout.line_starts[line - 1], column - 1)
    scopes = Scopes(file, language, layout)
    for f in functions:
        m = re.compile(rf"\b{re.escape(f['name'])}\s*(?:<[^()]*>)?\s*\(").search(source, layout.line_starts[f["line"] - 1])
        if m:
            parts, _ = segments(source, m.end() - 1)
            for i, p in enumerate(parts):
                yield ("parameter", f["name"], i, parameter(p, language), f["line"], f["column"], None, None)
    for m in _RETURN.finditer(source):
        yield ("return", scopes.of(m.start()), 0, m[1].strip(), *layout.place(m.start()), None, None)
    for m in _ASSIGN.finditer(source):
        yield ("assign", scopes.of(m.start(1)), 0, m[2].strip(), *layout.place(m.start(1)), None, m[1])
    for c in calls:
        at = offset(c["line"], c["column"])
        opened = source.find("(", at)
        if opened < 0:
            continue
        parts, _ = segments(source, opened)
        target = _TARGET.search(layout.line_before(at))
        callee = source[at:opened].strip().removeprefix("new ").strip()
        for i, p in enumerate(parts or [None]):
            yield ("call", c["caller"] or scopes.file, i, p, c["line"], c["column"], callee, target[1] if target else None)


def _chars(source: str, start: int, n_bytes: int) -> int:
    """Characters of so many bytes from a place on."""
    if n_bytes <= 0 or source.isascii():
        return max(0, n_bytes)
    line = source[start : start + n_bytes].encode("utf-8", "surrogatepass")[:n_bytes]
    return len(line.decode("utf-8", "ignore"))


def callers(marks: list[dict]) -> list[dict]:
    """lo, line, column, caller: each call of a file with the nearest function around it, in one sweep over the file's intervals."""
    stack: list[tuple[int, str]] = []
    out = []
    for m in sorted(marks, key=lambda m: (m["lo"], -m["hi"])):
        while stack and stack[-1][0] < m["hi"]:
            stack.pop()
        if m["is_function"]:
            stack.append((m["hi"], m["value"]))
        else:
            out.append({"lo": m["lo"], "line": m["line"], "column": m["column"], "caller": stack[-1][1] if stack else None})
    return out


def _marks(ast_nodes: DataFrame) -> DataFrame:
    """file_path, marks: a file's calls and functions in one row, so that its tree is made and shuffled once."""
    kept = ast_nodes.where(F.col("kind").isin(*CALL_KINDS) | F.col("kind").contains("Function"))
    mark = F.struct("lo", "hi", "line", "column", F.col("kind").contains("Function").alias("is_function"), "value")
    return kept.groupBy("file_path").agg(F.collect_list(mark).alias("marks"))


def enclosing_functions(ast_nodes: DataFrame) -> DataFrame:
    """file_path, lo, line, column, caller of all calls: see :func:`callers`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(file, *c.values()) for file, marks in zip(b.file_path, b.marks, strict=True) for c in callers(marks)]
            yield pd.DataFrame(rows, columns=["file_path", "lo", "line", "column", "caller"]).astype(object)

    return in_pieces(_marks(ast_nodes), run, "file_path string, lo int, line int, column int, caller string")


def marks_of(p: Program) -> list[dict]:
    """A parsed file's calls and functions, as in :func:`_marks`."""
    return [
        {"lo": lo, "hi": hi, "line": line, "column": column, "is_function": "Function" in kind, "value": value}
        for _, _, kind, value, line, column, lo, hi in p.tree
        if kind in CALL_KINDS or "Function" in kind
    ]


PARTS = "file_path string, what string, function string, position int, text string, line int, column int, callee string, target string"


def parts_of(files: DataFrame) -> DataFrame:
    """:func:`parts` of files that are parsed for it where they are: nothing is gathered or shuffled."""

    def rows(p: Program, source: str) -> list[tuple]:
        if not (found := marks_of(p)):
            return []
        functions = [{"name": m["value"], **m} for m in found if m["is_function"] and m["value"] is not None]
        return [(p.path, *r) for r in _rows(p.path, p.language, source, functions, callers(found))]

    return table_of(files, rows, PARTS, ("tree",), with_source=True)


def parts(files: DataFrame, ast_nodes: DataFrame) -> DataFrame:
    """file_path, what (parameter, return, assign or call), function, position, text, line, column, callee, target.

    A call has a row for each argument (one with null text if it has none), with the variable that it is assigned to.
    """
    rows = files.select("file_path", "file_type", "source").join(shuffled(_marks(ast_nodes)), "file_path")
    names = ["what", "function", "position", "text", "line", "column", "callee", "target"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, kind, source, found in zip(b.file_path, b.file_type, b.source, b.marks, strict=True):
                functions = [m for m in found if m["is_function"] and m["value"] is not None]
                out += [(file, *r) for r in _rows(file, kind, source or "", [{"name": m["value"], **m} for m in functions], callers(found))]
            yield pd.DataFrame(out, columns=["file_path", *names]).astype(object).where(lambda x: x.notna(), None)

    return in_pieces(rows, run, PARTS, "source")


def passes(found: DataFrame) -> DataFrame:
    """src_function, src, dst_function, dst: what goes from a variable of one function to one of another.

    An argument goes to the parameter at its position and to no other, a returned expression to what the call is
    assigned to or is an argument of. Functions are told by their names' last part; a method's first parameter
    (self, cls) is no position of a call by a dotted name.
    """
    found = cut(found, "call-parts")  # looked at seven times
    schema = "vars array<string>, called array<string>"
    names = F.pandas_udf(lambda s: pd.DataFrame([read_names(t or "") for t in s], columns=["vars", "called"]), schema)
    last = lambda c: F.element_at(F.split(c, r"\.|::|->"), -1)
    own = found.where("what = 'parameter'").select(F.col("function").alias("dst_function"), F.col("position").alias("place"), F.col("text").alias("dst"))
    bound = own.where("place = 0 and dst in ('self', 'cls', '&self', 'this')").select(F.col("dst_function").alias("method")).distinct()
    own = own.join(shuffled(bound), F.col("dst_function") == F.col("method"), "left").select(
        "dst_function", "dst", (F.col("place") - F.col("method").isNotNull().cast("int")).alias("place")
    ).where("place >= 0 and dst != ''")
    calls = found.where("what = 'call'").withColumn("name", last("callee"))
    args = calls.where("text is not null").withColumn("n", names("text"))
    to = args.join(shuffled(own), (F.col("name") == F.col("dst_function")) & (F.col("position") == F.col("place")))
    direct = to.select(F.col("function").alias("src_function"), F.explode("n.vars").alias("src"), "dst_function", "dst")
    nested = to.select(F.explode("n.called").alias("c"), "dst_function", "dst").select(last("c").alias("src_function"), F.lit(RETURNED).alias("src"), "dst_function", "dst")
    back = found.where("what = 'return'").withColumn("n", names("text"))
    out = back.select(F.col("function").alias("src_function"), F.explode("n.vars").alias("src"), F.col("function").alias("dst_function"), F.lit(RETURNED).alias("dst"))
    chain = back.select(F.explode("n.called").alias("c"), F.col("function").alias("dst_function")).select(last("c").alias("src_function"), F.lit(RETURNED).alias("src"), "dst_function", F.lit(RETURNED).alias("dst"))
    kept = calls.where("target is not null").select(F.col("name").alias("src_function"), F.lit(RETURNED).alias("src"), F.col("function").alias("dst_function"), F.col("target").alias("dst"))
    set_ = found.where("what = 'assign'").withColumn("n", names("text")).select(F.col("function").alias("src_function"), F.explode("n.vars").alias("src"), F.col("function").alias("dst_function"), F.col("target").alias("dst"))
    every = direct.unionByName(nested).unionByName(out).unionByName(chain).unionByName(kept).unionByName(set_)
    plain = lambda c: F.regexp_replace(c, r"^\$", "").alias(c)
    return every.select("src_function", plain("src"), "dst_function", plain("dst")).distinct()


def tainted_variables(edges: DataFrame, start: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """function, variable of all that ``start`` (function, variable) leads to over :func:`passes`; with columns ``keys``, a walk for each of their values."""
    key = lambda f, v: F.concat_ws("\1", f, v)
    walked = reach(
        edges.select(key("src_function", "src").alias("src"), key("dst_function", "dst").alias("dst")), start.select(*keys, key("function", "variable").alias("node")), key=keys
    )
    return walked.select(*keys, F.split("node", "\1")[0].alias("function"), F.split("node", "\1")[1].alias("variable"))
