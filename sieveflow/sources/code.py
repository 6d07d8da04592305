"""Programs as tables: nodes, trees, dataflow graphs and symbols.

Python is parsed with the standard grammar. Other languages are read at the level of words, strings
and brackets: enough for functions, calls, imports, assignments and straight-line dataflow.
A file is parsed once for each kind of table that a plan asks for, in batches, next to where it is read.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.batches import in_pieces
from sieveflow.schemas import AST_NODES, DFG_EDGES, DFG_NODES, NODES, SYMBOLS

from . import catalog as C

LANGUAGES = ("python", "rust", "java", "php", "javascript", "typescript", "go", "ruby")
#: What can be asked of a parsed file: flat nodes, the tree, and the dataflow with its symbols.
PARTS = ("nodes", "tree", "flow")
SUPERGLOBALS = ("_GET", "_POST", "_REQUEST", "_COOKIE", "_SERVER", "_FILES", "_ENV", "_SESSION")


def stable_id(path: str, line: int, column: int, name: str) -> int:
    """A number of a place and a name, the same in every run."""
    raw = hashlib.blake2b(f"{path}\0{line}\0{column}\0{name}".encode(), digest_size=8).digest()
    return int.from_bytes(raw, "big") >> 1


@dataclass
class Symbol:
    name: str
    sanitized: bool = False
    defined: int | None = None
    alias_of: str | None = None


@dataclass
class Program:
    """Everything known about one source file."""

    path: str
    language: str
    nodes: list[tuple] = field(default_factory=list)  # path, value, line, column
    tree: list[tuple] = field(default_factory=list)  # id, parent, kind, value, line, column, lo, hi
    flow: dict[int, tuple] = field(default_factory=dict)  # id -> name, kind, sanitized, branch
    edges: set[tuple] = field(default_factory=set)  # src, dst, type
    symbols: dict[str, Symbol] = field(default_factory=dict)

    def node(self, path: str, value: object, line: int, column: int) -> None:
        self.nodes.append((path, value, line, column))

    def point(self, name: str, kind: str, line: int, column: int, sanitized: bool = False, branch: int | None = None) -> int:
        i = stable_id(self.path, line, column, f"{kind}:{name}")
        self.flow[i] = (name, kind, sanitized, branch)
        return i

    def edge(self, src: int | None, dst: int, kind: str = "flow") -> None:
        if src is not None and src != dst:
            self.edges.add((src, dst, kind))

    def join(self, name: str, states: list[Symbol], arms: int, line: int, column: int, merge: bool = True) -> Symbol:
        """A name after a branching, of its states in those arms that know it: clean only if it is in all arms."""
        clean = len(states) == arms and all(x.sanitized for x in states)
        defs = list(dict.fromkeys(x.defined for x in states if x.defined is not None))
        now = defs[0] if defs else None
        if merge and len(defs) > 1:
            now = self.point(name, "Assign", line, column, clean)
            for d in defs:
                self.edge(d, now)
                self.edges.add((now, d, "merge"))
        return Symbol(name, clean, now, states[0].alias_of if len({x.alias_of for x in states}) == 1 else None)


# Python

#: Grammar names of Python's syntax nodes. Others keep their own.
KINDS = {
    "FunctionDef": "FunctionDefinition", "AsyncFunctionDef": "FunctionDefinition", "ClassDef": "ClassDefinition", "Return": "ReturnStatement",
    "If": "IfStatement", "For": "ForStatement", "While": "WhileStatement", "Try": "TryStatement", "With": "WithStatement", "Import": "ImportStatement",
    "ImportFrom": "ImportFromStatement", "Assign": "Assignment", "AnnAssign": "Assignment", "AugAssign": "AugmentedAssignment", "Expr": "ExpressionStatement",
    "Name": "Identifier", "BinOp": "BinaryOperator", "BoolOp": "BooleanOperator", "Compare": "ComparisonOperator", "Dict": "Dictionary",
    "Raise": "RaiseStatement", "Assert": "AssertStatement", "Delete": "DeleteStatement", "Pass": "PassStatement", "Match": "MatchStatement",
}


def dotted(e: ast.AST) -> str:
    """``a.b[0]`` as text; ``getattr(o, "x")`` as ``o.x``; '' for anything else."""
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        return f"{base}.{e.attr}" if (base := dotted(e.value)) else ""
    if isinstance(e, ast.Subscript):
        return f"{base}[{ast.unparse(e.slice)}]" if (base := dotted(e.value)) else ""
    if isinstance(e, ast.Call) and dotted(e.func) == "getattr" and len(e.args) > 1 and isinstance(e.args[1], ast.Constant):
        return f"{base}.{e.args[1].value}" if (base := dotted(e.args[0])) else ""
    return ""


def identifiers(e: ast.AST | None) -> list[tuple[str, ast.AST]]:
    """Names read in an expression, longest forms first, without the names of called functions."""
    if e is None:
        return []
    if (name := dotted(e)) and not isinstance(e, ast.Call):
        return [(name, e)]
    if isinstance(e, ast.Call):
        if name:
            return [(name, e)]
        own = [] if not isinstance(e.func, ast.Attribute) else identifiers(e.func.value)
        return own + [x for a in [*e.args, *(k.value for k in e.keywords)] for x in identifiers(a)]
    return [x for c in ast.iter_child_nodes(e) for x in identifiers(c)]


class Python:
    def __init__(self, path: str, source: str, catalog: dict, want: tuple[str, ...] = PARTS):
        self.p, self.catalog = Program(path, "python"), catalog
        if not source.strip():
            raise ValueError("an empty file")
        root = ast.parse(source)
        self.aliases: dict[str, str] = {}
        self.functions: dict[str, ast.AST] = {}
        self.returns: dict[str, list[int]] = {}
        self.params: dict[str, list[int]] = {}
        self.waiting: list[tuple] = []
        self.branches = 0
        if "tree" in want:
            self.grow(root, None)
        if "nodes" in want or "flow" in want:
            self.imports(root)  # whose aliases the others need
        if "nodes" in want:
            self.words(root)
        if "flow" in want:
            self.flow(root)

    def flow(self, root: ast.Module) -> None:
        for n in ast.walk(root):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.functions[n.name] = n
        self.body(root.body, None)
        for callee, args, dest in self.waiting:
            for i, src in args:
                if i < len(self.params.get(callee, ())):
                    self.p.edge(src, self.params[callee][i])
            for r in self.returns.get(callee, ()):
                if dest is not None:
                    self.p.edge(r, dest)

    # Tree

    def grow(self, n: ast.AST, parent: int | None) -> int:
        at = len(self.p.tree)
        self.p.tree.append(())
        kind = KINDS.get(type(n).__name__, type(n).__name__)
        if isinstance(n, ast.Constant):
            kind = {str: "String", int: "Integer", float: "Float", bool: str(n.value)}.get(type(n.value), "None")
        value = None
        if isinstance(n, ast.Call):
            value = dotted(n.func) or None
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            value = n.name
        elif isinstance(n, ast.Assign):
            value = dotted(n.targets[0]) or None
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            value = ast.unparse(n)
        elif isinstance(n, ast.Name):
            value = n.id
        for c in ast.iter_child_nodes(n):
            if not isinstance(c, (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)):
                self.grow(c, at)
        self.p.tree[at] = (at, parent, kind, value, getattr(n, "lineno", 1), getattr(n, "col_offset", 0) + 1, at, len(self.p.tree) - 1)
        return at

    # Flat nodes

    def imports(self, root: ast.AST) -> None:
        for n in ast.walk(root):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.aliases[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    self.p.node(f"import.{a.name}", {"alias": a.asname or a.name}, n.lineno, n.col_offset + 1)
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                for a in n.names:
                    if a.name != "*":
                        self.aliases[a.asname or a.name] = f"{module}.{a.name}"
                    self.p.node(f"import_from.{module}.{a.name}", {"alias": a.asname or a.name}, n.lineno, n.col_offset + 1)

    def canonical(self, name: str) -> str:
        head, dot, rest = name.partition(".")
        return self.aliases.get(head, head) + dot + rest

    def words(self, root: ast.AST) -> None:
        for n in ast.walk(root):
            if isinstance(n, ast.Call) and (name := dotted(n.func)):
                if name in ("getattr", "setattr") and len(n.args) > 1 and isinstance(n.args[1], ast.Constant):
                    self.p.node(f"{name}.{dotted(n.args[0])}.{n.args[1].value}", None, n.lineno, n.col_offset + 1)
                self.p.node(f"call.{self.canonical(name)}", ast.unparse(n), n.lineno, n.col_offset + 1)
            elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) and (name := dotted(n.targets[0])):
                self.p.node(f"assign.{name}", n.value.value, n.lineno, n.col_offset + 1)

    # Dataflow

    def role(self, name: str, role: str) -> bool:
        full = self.canonical(name)
        return C.has(self.catalog, "python", role, full) or C.has(self.catalog, "python", role, name)

    def symbol(self, name: str) -> Symbol | None:
        """The symbol a name stands for, along aliases."""
        seen = set()
        s = self.p.symbols.get(name)
        while s and s.alias_of and s.alias_of not in seen and s.alias_of in self.p.symbols:
            seen.add(s.alias_of)
            s = self.p.symbols[s.alias_of]
        return s or self.p.symbols.get(name.split("[")[0]) or self.p.symbols.get(name.split(".")[0])

    def defined(self, name: str) -> int | None:
        own = self.p.symbols.get(name)
        if own and own.defined is not None:
            return own.defined
        return s.defined if (s := self.symbol(name)) else None

    def define(self, name: str, n: ast.AST, sanitized: bool, branch: int | None, kind: str = "Def", alias_of: str | None = None) -> int:
        i = self.p.point(name, kind, n.lineno, n.col_offset + 1, sanitized, branch)
        self.p.symbols[name] = Symbol(name, sanitized, i, alias_of)
        return i

    def body(self, stmts: list[ast.stmt], branch: int | None, function: str | None = None) -> None:
        for s in stmts:
            self.statement(s, branch, function)

    def statement(self, s: ast.stmt, branch: int | None, function: str | None) -> None:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            outer = dict(self.p.symbols)
            args = [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs]
            self.params[s.name] = [self.define(a.arg, a, False, branch, "Param") for a in args]
            self.body(s.body, branch, s.name)
            self.p.symbols = {**self.p.symbols, **outer}
        elif isinstance(s, ast.ClassDef):
            self.body(s.body, branch, function)
        elif isinstance(s, (ast.Assign, ast.AnnAssign)) and s.value is not None:
            self.assign(s, s.targets[0] if isinstance(s, ast.Assign) else s.target, s.value, branch)
        elif isinstance(s, ast.AugAssign):
            target = dotted(s.target)
            ids = [x for x, _ in identifiers(s.value) if x != target]
            before = [self.defined(x) for x in ids]
            i = self.define(target, s, False, branch)
            for b in before:
                self.p.edge(b, i)
        elif isinstance(s, ast.Return):
            i = self.p.point(function or "", "Return", s.lineno, s.col_offset + 1, False, branch)
            self.returns.setdefault(function or "", []).append(i)
            self.calls(s.value, branch)
            for x, _ in identifiers(s.value):
                self.p.edge(self.defined(x), i)
        elif isinstance(s, ast.If):
            self.use_all(s.test, branch)
            self.arms(s, [s.body, s.orelse], branch, function)
        elif isinstance(s, ast.Match):
            self.arms(s, [c.body for c in s.cases], branch, function, merge=False)
        elif isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            self.p.point("", "Branch", s.lineno, s.col_offset + 1, False, branch)
            if isinstance(s, ast.While):
                self.use_all(s.test, branch)
            elif target := dotted(s.target):
                i = self.define(target, s.target, False, branch)
                for x, _ in identifiers(s.iter):
                    self.p.edge(self.defined(x), i)
            self.body(s.body, branch, function)
            self.body(s.orelse, branch, function)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                self.calls(item.context_expr, branch)
            self.body(s.body, branch, function)
        elif isinstance(s, ast.Try):
            for block in (s.body, *(h.body for h in s.handlers), s.orelse, s.finalbody):
                self.body(block, branch, function)
        elif isinstance(s, ast.Expr):
            self.calls(s.value, branch)

    def use_all(self, e: ast.AST | None, branch: int | None) -> None:
        self.calls(e, branch)
        for x, n in identifiers(e):
            i = self.p.point(x, "Use", n.lineno, n.col_offset + 1, False, branch)
            self.p.edge(self.defined(x), i)

    def arms(self, s: ast.stmt, arms: list[list[ast.stmt]], branch: int | None, function: str | None, merge: bool = True) -> None:
        """Each arm begins with the state before; a name is clean after only if it is in all arms."""
        at = self.p.point("", "Branch", s.lineno, s.col_offset + 1, False, branch)
        before = {k: Symbol(**vars(v)) for k, v in self.p.symbols.items()}
        after = []
        for arm in arms:
            self.branches += 1
            self.p.symbols = {k: Symbol(**vars(v)) for k, v in before.items()}
            self.body(arm, self.branches, function)
            after.append(self.p.symbols)
        merged: dict[str, Symbol] = {}
        for name in dict.fromkeys(n for a in after for n in a):
            merged[name] = self.p.join(name, [a[name] for a in after if name in a], len(after), s.lineno, s.col_offset + 1, merge)
        self.p.symbols = merged
        del at

    def assign(self, s: ast.stmt, target: ast.expr, value: ast.expr, branch: int | None) -> None:
        name = dotted(target.elts[0] if isinstance(target, (ast.Tuple, ast.List)) and target.elts else target)
        if isinstance(value, ast.Await):
            value = value.value
        if not name:
            self.calls(value, branch)
            return
        ids = identifiers(value)
        before = [self.defined(x) for x, _ in ids]
        if isinstance(value, ast.Call) and (callee := dotted(value.func)) and callee != "getattr":
            self.calls(value, branch, name)
            clean = self.role(callee, "sanitizer")
            source = self.role(callee, "source")
            if callee in self.functions:
                i = self.define(name, s, False, branch)
                self.waiting.append((callee, [], i))
                self.p.edges.add((i, stable_id(self.p.path, 0, 0, callee), "call_return"))
            else:
                clean = clean or not source and not self.role(callee, "sink") and not ids
                i = self.define(name, s, clean, branch)
            if not clean:
                for b in before:
                    self.p.edge(b, i)
        elif len(ids) == 1 and dotted(value) == ids[0][0]:
            other = self.symbol(ids[0][0])
            i = self.define(name, s, bool(other and other.sanitized), branch, alias_of=ids[0][0] if ids[0][0] != name else None)
            self.p.edge(before[0], i)
        else:
            self.calls(value, branch)
            clean = not ids and not any(isinstance(x, ast.Call) for x in ast.walk(value))
            i = self.define(name, s, clean or bool(ids) and all(x.sanitized for x in map(self.symbol, (x for x, _ in ids)) if x) and all(map(self.symbol, (x for x, _ in ids))), branch)
            for b in before:
                self.p.edge(b, i)

    def calls(self, e: ast.AST | None, branch: int | None, target: str | None = None) -> None:
        """Every call in an expression: sinks use their arguments, sanitisers clean theirs, known functions pass them on."""
        for c in (n for n in ast.walk(e) if isinstance(n, ast.Call)) if e is not None else ():
            callee = dotted(c.func)
            args = [*c.args, *(k.value for k in c.keywords)]
            if callee == "setattr" and len(args) > 2 and isinstance(args[1], ast.Constant):
                i = self.define(f"{dotted(args[0])}.{args[1].value}", c, False, branch)
                for x, _ in identifiers(args[2]):
                    self.p.edge(self.defined(x), i)
            elif callee == "getattr":
                for x, n in identifiers(c):
                    self.p.edge(self.defined(x), self.p.point(x, "Use", n.lineno, n.col_offset + 1, False, branch))
            elif callee in self.functions:
                self.p.edges.add((stable_id(self.p.path, 0, 0, target or ""), stable_id(self.p.path, 0, 0, callee), "call"))
                self.waiting.append((callee, [(i, self.defined(x)) for i, a in enumerate(args) for x, _ in identifiers(a)], None))
            elif self.role(callee, "sink"):
                for a in args:
                    for x, n in identifiers(a):
                        self.p.edge(self.defined(x), self.p.point(x, "Use", n.lineno, n.col_offset + 1, bool((y := self.symbol(x)) and y.sanitized), branch))
            elif self.role(callee, "sanitizer"):
                for a in args:
                    for x, _ in identifiers(a):
                        if target is None and (y := self.symbol(x)):
                            y.sanitized = True


# Other languages

_STRIP = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(/\*.*?\*/|//[^\n]*|\#(?!\[)[^\n]*)""", re.S)
_NAME = r"[A-Za-z_]\w*"
_CHAIN = rf"\$?{_NAME}(?:(?:::|\.|->|\\){_NAME})*"
#: How functions and imports begin, by language.
FUNCTION = {
    "rust": r"\bfn\s+(\w+)", "php": r"\bfunction\s+&?\s*(\w+)", "javascript": r"\bfunction\s*\*?\s*(\w+)", "typescript": r"\bfunction\s*\*?\s*(\w+)",
    "go": r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)", "ruby": r"\bdef\s+(?:self\.)?(\w+)", "java": r"(?:public|private|protected|static|final|\s)+[\w<>\[\],\s]+?\s(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{",
}
IMPORT = {
    "rust": r"\buse\s+([\w:]+)(?:\s+as\s+(\w+))?", "java": r"\bimport\s+(?:static\s+)?([\w.]+(?:\.\*)?)()\s*;", "php": r"\b(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]()",
    "javascript": r"\bimport\s+(?:[\w{}*,\s]+\s+from\s+)?['\"]([^'\"]+)['\"]()", "typescript": r"\bimport\s+(?:[\w{}*,\s]+\s+from\s+)?['\"]([^'\"]+)['\"]()",
    "go": r"\bimport\s+(?:\w+\s+)?['\"]([^'\"]+)['\"]()", "ruby": r"\brequire(?:_relative)?\s+['\"]([^'\"]+)['\"]()",
}
KEYWORDS = set("if for while switch catch return function fn func def match else elif new unless until loop foreach and or not in sizeof typeof throw await async print yield super this self do use".split())
ASSIGN = re.compile(rf"(?:\b(?:let|const|var|final|mut|auto)\s+(?:mut\s+)?)?(?:[A-Z]\w*(?:<[^<>=;]*>)?(?:\[\])?\s+)?(\$?{_NAME}(?:(?:\.|->){_NAME})*)\s*(?::\s*[\w<>&\[\] ]+)?\s*(?:\+|\.|-)?=(?![=>~])\s*([^;\n]*)")


class Words:
    """A file of a curly-bracket language or Ruby, by words."""

    def __init__(self, path: str, source: str, language: str, catalog: dict, want: tuple[str, ...] = PARTS):
        self.p, self.lang, self.catalog, self.source = Program(path, language), language, catalog, source
        hide = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[2] else m[0][0] + re.sub(r"[^\n]", "\1", m[0][1:-1]) + m[0][-1]
        self.bare = _STRIP.sub(hide, source)  # the same places, without comments and insides of strings
        no_comments = _STRIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[2] else m[0], source)
        self.starts = [0] + [i + 1 for i, c in enumerate(source) if c == "\n"]
        self.functions = {m[1] for m in re.finditer(FUNCTION[language], self.bare)}
        for m in re.finditer(FUNCTION[language], self.bare):
            self.p.node(f"function.{m[1]}", m[1], *self.at(m.start(1)))
        aliases = {}
        for m in re.finditer(IMPORT[language], no_comments):
            aliases[m[2] or re.split(r"::|\.|/", m[1])[-1]] = m[1]
            self.p.node(f"import.{m[1]}", {"alias": m[2] or re.split(r"::|\.|/", m[1])[-1]}, *self.at(m.start(1)))
        self.aliases = aliases
        self.calls()
        if "nodes" in want or "flow" in want:
            self.assignments()
        if "tree" in want:
            self.tree()
        if "flow" in want and language in ("rust", "java", "php", "javascript", "typescript"):
            self.dataflow()

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, len(self.source[self.starts[line - 1] : offset].encode("utf-8", "surrogatepass")) + 1

    def calls(self) -> None:
        self.found: list[tuple[str, int, int, str]] = []  # name, start, end, arguments
        for m in re.finditer(rf"({_CHAIN})(!?)\s*\(", self.bare):
            name = m[1].replace("->", ".")
            if name in KEYWORDS and name not in ("print",) or re.search(r"\b(?:fn|func|function|def)\s+(?:\([^)]*\)\s*)?$", self.bare[max(0, m.start() - 60) : m.start()]):
                continue
            end = self.closing(m.end() - 1)
            args = self.source[m.end() : end]
            made = re.search(r"\bnew\s+$", self.bare[max(0, m.start() - 8) : m.start()])
            kind = "macro" if m[2] else "new" if made and self.lang in ("javascript", "typescript") else "call"
            shown = f"new {name}" if made and self.lang == "java" else name
            self.p.node(f"{kind}.{shown}", args, *self.at(m.start(1)))
            head = re.split(r"::|\.", name)[0]
            if head in self.aliases and self.aliases[head] != head:
                self.p.node(f"{kind}.{self.aliases[head]}{name[len(head):]}", args, *self.at(m.start(1)))
            self.found.append((f"macro::{name}" if m[2] else name, m.start(1), end, args))
        if self.lang == "php":
            for m in re.finditer(r"\becho\b([^;]*)", self.bare):
                self.p.node("call.echo", self.source[m.start(1) : m.end(1)].strip(), *self.at(m.start()))
                self.found.append(("echo", m.start(), m.end(), self.source[m.start(1) : m.end(1)]))
            for m in re.finditer(r"\$(_[A-Z]+)\b", self.bare):
                if m[1] in SUPERGLOBALS:
                    self.p.node(f"var.{m[1]}", m[1], *self.at(m.start()))
        if self.lang == "rust":
            for m in re.finditer(r"\bunsafe\b", self.bare):
                self.p.node("unsafe", None, *self.at(m.start()))
        if self.lang in ("javascript", "typescript"):
            for word, rx in (("class", r"\bclass\s+(\w+)"), ("var", rf"\b(?:let|const|var)\s+({_NAME})"), ("export", r"\bexport\s+(?:default\s+)?(\w+)"), ("loop", r"\b(for|while)\s*\(")):
                for m in re.finditer(rx, self.bare):
                    self.p.node(f"{word}.{m[1]}", m[1], *self.at(m.start(1)))

    def closing(self, at: int) -> int:
        depth = 0
        for i in range(at, len(self.bare)):
            depth += (self.bare[i] == "(") - (self.bare[i] == ")")
            if depth == 0:
                return i
        return len(self.bare)

    def assignments(self) -> None:
        self.set: list[tuple[str, int, int, str]] = []
        # Labels are no names with a type.
        text = self.bare if self.lang == "rust" else re.sub(r"\bdefault\s*:|\bcase\b[^:;{}\n]*:(?!:)", lambda m: " " * len(m[0]), self.bare)
        for m in ASSIGN.finditer(text):
            self.set.append((m[1].replace("->", "."), m.start(1), m.end(), self.source[m.start(2) : m.end(2)]))
            self.p.node(f"assign.{m[1].lstrip('$')}", self.source[m.start(2) : m.end(2)].strip(), *self.at(m.start(1)))

    def tree(self) -> None:
        """Functions and calls as a tree: a call is below the function whose braces are around it."""
        spans = []
        for m in re.finditer(FUNCTION[self.lang], self.bare):
            open_at = self.bare.find("{", m.start(1))
            end, depth = open_at, 0
            while 0 <= open_at and end < len(self.bare):
                depth += (self.bare[end] == "{") - (self.bare[end] == "}")
                end += 1
                if depth == 0:
                    break
            if self.lang == "ruby":
                done = re.compile(r"^\s*end\b", re.M).search(self.bare, m.end())
                end = done.end() if done else len(self.bare)
            spans.append((m.start(), max(end, m.end()), "FunctionDefinition" if self.lang in ("php", "ruby") else "FunctionDeclaration", m[1]))
        for name, start, end, _ in self.found:
            spans.append((start, end + 1, "CallExpression", name.removeprefix("macro::")))
        for m in re.finditer(_NAME, self.bare):
            if m[0] not in KEYWORDS:
                spans.append((m.start(), m.end(), "Identifier", m[0]))
        spans.sort(key=lambda s: (s[0], -s[1]))
        rows: list[list] = [[0, None, "Program", None, 1, 1, 0, 0]]
        stack = [(0, len(self.bare) + 1)]
        for start, end, kind, value in spans:
            while stack and stack[-1][1] < end:
                stack.pop()
            parent = stack[-1][0] if stack else 0
            i = len(rows)
            rows.append([i, parent, kind, value, *self.at(start), i, i])
            stack.append((i, end))
        for r in reversed(rows):
            if r[1] is not None:
                rows[r[1]][7] = max(rows[r[1]][7], r[7])
        self.p.tree = [tuple(r) for r in rows]

    def names(self, text: str) -> list[str]:
        bare = _STRIP.sub(lambda m: " " if m[2] or m[0][0] != '"' or self.lang != "php" else m[0], text)
        rx = r"\$\w+" if self.lang == "php" else rf"(?<![\w.$]){_NAME}(?!\s*[(!\w])"
        return [n for n in dict.fromkeys(re.findall(rx, bare)) if n not in KEYWORDS]

    def pairs(self) -> dict[int, int]:
        """Where each bracket is closed."""
        ends, stack = {}, []
        for m in re.finditer(r"[(){}]", self.bare):
            if m[0] in "({":
                stack.append(m.start())
            elif stack:
                ends[stack.pop()] = m.start()
        return ends

    def branchings(self) -> list[tuple[int, int, list[tuple[int, int]], bool]]:
        """Start, end, arms and whether one of the arms is always taken: chains of if, switch, Rust's match."""
        ends, bare, found, chained = self.pairs(), self.bare, [], set()
        blank = re.compile(r"\s*")

        def head(at: int) -> int | None:
            """Where the body begins that follows a condition."""
            if self.lang != "rust":
                at = blank.match(bare, at).end()
                return blank.match(bare, ends[at] + 1).end() if at in ends else None
            m = re.compile(r"[({]").search(bare, at)
            while m and m[0] == "(" and m.start() in ends:
                m = re.compile(r"[({;]").search(bare, ends[m.start()] + 1)
            return m.start() if m and m[0] == "{" else None

        def tail(at: int) -> int:
            """Where a body ends: its brace, or its semicolon."""
            if at in ends and bare[at] == "{":
                return ends[at] + 1
            m = re.compile(r"[({;}]").search(bare, at)
            while m and m[0] in "({" and m.start() in ends:
                m = re.compile(r"[({;}]").search(bare, ends[m.start()] + 1)
            return m.end() if m else len(bare)

        for m in re.finditer(r"\bif\b", bare):
            if m.start() in chained or (body := head(m.end())) is None:
                continue
            end = tail(body)
            arms, always = [(body, end)], False
            while more := re.compile(r"\s*\belse(\s*if\b)?").match(bare, end):
                if more[1]:
                    chained.add(more.end() - 2)
                    if (body := head(more.end())) is None:
                        break
                else:
                    body = blank.match(bare, more.end()).end()
                end = tail(body)
                arms.append((more.end(), end))
                if always := not more[1]:
                    break
            found.append((m.start(), end, arms, always))
        for m in re.finditer(r"\bmatch\b" if self.lang == "rust" else r"\bswitch\b", bare):
            if (body := head(m.end())) is None or body not in ends or bare[body] != "{":
                continue
            marks, at = [], body + 1
            rx = re.compile(r"[({]|=>" if self.lang == "rust" else r"[({]|\b(?:case|default)\b")
            while (k := rx.search(bare, at, ends[body])) is not None:
                if k[0] in "({":
                    at = ends.get(k.start(), k.start()) + 1
                    continue
                marks.append(k)
                at = k.end()
            if marks:
                stops = [k.start() for k in marks[1:]] + [ends[body]]
                arms = [(k.end(), stop) for k, stop in zip(marks, stops, strict=True)]
                if self.lang != "rust":  # labels without statements belong to the next
                    arms = [a for a in arms[:-1] if not re.fullmatch(r"[^;(){}=]*:\s*", bare[a[0] : a[1]])] + arms[-1:]
                found.append((body, ends[body] + 1, arms, self.lang == "rust" or any(k[0] == "default" for k in marks)))
        return sorted(found, key=lambda g: (g[0], -g[1]))

    def dataflow(self) -> None:
        """Assignments and calls in the order of the text. Each arm of a branching begins with the state before it; a name that an
        arm sets is clean after only if it is in all arms, of which no arm is one where none is always taken. Branchings more
        than a hundred deep are read straight on."""
        cat, s = self.catalog, self.p.symbols
        starts = sorted(range(len(self.found)), key=lambda k: self.found[k][1])
        order = [self.found[k][1] for k in starts]
        is_ = lambda role, name: C.has(cat, self.lang, role, re.sub("::(?!println)", ".", name))
        calls_in = lambda a, b: [self.found[k] for k in starts[bisect_left(order, a) : bisect_left(order, b)]]
        events = sorted([(x[1], 1, x) for x in self.set] + [(x[1], 2, x) for x in self.found] + [(g[0], 0, g) for g in self.branchings()], key=lambda x: (x[0], x[1]))
        places = [e[0] for e in events]
        changed: list[dict[str, Symbol | None]] = []  # by open arm: names set there, as they were before
        branches = 0

        def put(symbol: Symbol) -> None:
            if changed:
                changed[-1].setdefault(symbol.name, s.get(symbol.name))
            s[symbol.name] = symbol

        def run(lo: int, hi: int, branch: int | None) -> None:
            nonlocal branches
            k = bisect_left(places, lo)
            while k < len(events) and places[k] < hi:
                start, kind, item = events[k]
                k += 1
                if kind == 1:
                    self.set_name(item, put, is_, calls_in, branch)
                elif kind == 2:
                    self.call(item, is_, branch)
                elif len(changed) < 100:
                    _, end, arms, always = item
                    run_until = bisect_left(places, arms[0][0])
                    for _, other, x in events[k:run_until]:  # the condition
                        if other:
                            self.set_name(x, put, is_, calls_in, branch) if other == 1 else self.call(x, is_, branch)
                    after = []
                    for a, b in arms:
                        branches += 1
                        changed.append({})
                        run(a, b, branches)
                        before = changed.pop()
                        after.append({name: s[name] for name in before})
                        for name, old in before.items():
                            if old is None:
                                del s[name]
                            else:
                                s[name] = old
                    if not always:
                        after.append({})
                    for name in dict.fromkeys(n for x in after for n in x):
                        states = [x for x in (y.get(name) or s.get(name) for y in after) if x]
                        put(self.p.join(name, states, len(after), *self.at(start)))
                    k = max(k, bisect_left(places, max(end, arms[-1][1])))

        run(0, len(self.source) + 1, None)

    def set_name(self, item: tuple, put, is_, calls_in, branch: int | None) -> None:
        s, (name, start, end, value) = self.p.symbols, item
        own = calls_in(start, end)
        clean = any(is_("sanitizer", c[0]) for c in own)
        ids = self.names(value)
        source = any(is_("source", c[0]) for c in own) or self.lang == "php" and any(v.lstrip("$") in SUPERGLOBALS for v in ids)
        known = [s[x] for x in ids if x in s]
        before = [x.defined for x in known]
        clean = clean or not ids and not own and not source or bool(known) and not source and all(x.sanitized for x in known)
        i = self.p.point(name, "Def" if self.lang != "javascript" or name not in s else "Assign", *self.at(start), clean, branch)
        plain = re.fullmatch(rf"&?\s*\$?{_NAME}", value.strip())
        put(Symbol(name, clean, i, value.strip().lstrip("& ") if plain and value.strip().lstrip("& ") in s else None))
        if not clean or plain:
            for b in before:
                self.p.edge(b, i)

    def call(self, item: tuple, is_, branch: int | None) -> None:
        s, (name, start, _, args) = self.p.symbols, item
        if is_("sink", name) or self.lang == "javascript" or name == "echo":
            for x in self.names(args):
                if x in s:
                    i = self.p.point(x, "Use", *self.at(start), s[x].sanitized, branch)
                    self.p.edge(s[x].defined, i)
        if name in self.functions:
            self.p.edges.add((stable_id(self.p.path, 0, 0, ""), stable_id(self.p.path, 0, 0, name), "call"))


def parse(path: str, language: str, source: str, catalog: dict | None = None, want: tuple[str, ...] = PARTS) -> Program:
    catalog = catalog or C.snapshot()
    return (Python(path, source, catalog, want) if language == "python" else Words(path, source, language, catalog, want)).p


def table_of(files: DataFrame, rows_of, schema: str, want: tuple[str, ...] = PARTS, with_source: bool = False) -> DataFrame:
    """A table of what ``rows_of`` tells of each parsed file, of which only ``want`` is made; with ``with_source`` it gets the text too."""
    cat = C.snapshot()
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for file, kind, source in zip(b.file_path, b.file_type, b.source, strict=True):
                try:
                    p = parse(file, kind, source or "", cat, want)
                except (SyntaxError, ValueError, RecursionError):
                    continue  # a file that can't be parsed has no rows
                rows += rows_of(p) if not with_source else rows_of(p, source or "")
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return in_pieces(files.where(F.col("file_type").isin(*LANGUAGES)).select("file_path", "file_type", "source"), run, schema, "source")


def code_nodes(files: DataFrame) -> DataFrame:
    text = lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return table_of(files, lambda p: [(p.path, stable_id(p.path, ln, c, k), p.language, k, text(v), ln, c) for k, v, ln, c in p.nodes], NODES, ("nodes",))


def ast_nodes(files: DataFrame) -> DataFrame:
    return table_of(files, lambda p: [(p.path, *t) for t in p.tree], AST_NODES, ("tree",))


def typed_nodes(files: DataFrame) -> DataFrame:
    """:func:`ast_nodes` with the file_type, which the parser knows: nothing is joined for it."""
    return table_of(files, lambda p: [(p.path, *t, p.language) for t in p.tree], AST_NODES + ", file_type string", ("tree",))


def dfg_nodes(files: DataFrame) -> DataFrame:
    return table_of(files, lambda p: [(p.path, i, *x) for i, x in p.flow.items()], DFG_NODES, ("flow",))


def dfg_edges(files: DataFrame) -> DataFrame:
    return table_of(files, lambda p: [(p.path, *e) for e in sorted(p.edges)], DFG_EDGES, ("flow",))


def symbols(files: DataFrame) -> DataFrame:
    """A row for each name that is assigned or imported."""

    def rows(p: Program) -> list[tuple]:
        return [(p.path, s.name, s.sanitized, s.defined, s.alias_of, "Sanitizer" if s.sanitized else "Source", None, None) for s in p.symbols.values()]

    return table_of(files, rows, SYMBOLS, ("flow",))
