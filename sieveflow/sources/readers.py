"""Readers: files to flattened nodes (file_path, id, kind, path, value_json, line, column).

Line-shaped formats are plain column expressions. Nested formats are parsed once per file in Arrow
batches; a file that can't be parsed gives no nodes, and :func:`parse_status` says why.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.batches import in_pieces
from sieveflow.schemas import NODES

from .corpus import lines

Node = tuple[str, object, int, int]  # path, value, line, column


def canonical(value: object) -> str:
    """JSON text by which values are equal: 1, "1" and true differ; keys are sorted."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


# Line-shaped formats


def dockerfile_nodes(files: DataFrame) -> DataFrame:
    """A node for each instruction line: its first word, the line, the place of the word."""
    src = lines(files.where("file_type = 'dockerfile'"))
    t = F.trim(F.regexp_replace("text", r"^[\t ]+|[\t ]+$", ""))
    rows = src.withColumn("t", t).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    word = F.split("t", r"\s+")[0]
    column = F.instr("text", word)
    return rows.select(
        "file_path", F.xxhash64("file_path", "line", column, word).alias("id"), F.lit("dockerfile").alias("kind"), word.alias("path"),
        F.to_json(F.array("t")).substr(F.lit(2), F.length(F.to_json(F.array("t"))) - 2).alias("value_json"), "line", column.cast("int").alias("column"),
    )


def generic_nodes(files: DataFrame) -> DataFrame:
    """A node for each line of a generic file; its path is the line's number."""
    rows = lines(files.where("file_type = 'generic'"))
    j = F.to_json(F.array("text"))
    return rows.select(
        "file_path", F.lit(0).cast("long").alias("id"), F.lit("generic").alias("kind"), F.col("line").cast("string").alias("path"),
        j.substr(F.lit(2), F.length(j) - 2).alias("value_json"), "line", F.lit(1).alias("column"),
    )


# Nested formats


def leaves(value: object, path: str = "") -> Iterator[tuple[str, object]]:
    """Leaves of nested values under dotted and bracketed paths; empty containers have none."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{at}.{k}" if at else str(k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{at}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            yield at, v


def read_json(text: str) -> list[Node]:
    return [(p, v, 1, 1) for p, v in leaves(json.loads(text))]


def read_yaml(text: str) -> list[Node]:
    """All documents of a YAML text; anchors and merges are resolved, explicit keys win; places are the values'."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    # Dates stay the strings that they are.
    Loader.yaml_implicit_resolvers = {
        k: [(tag, rx) for tag, rx in v if tag != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    found: list[Node] = []
    loader = Loader(text)
    try:
        while loader.check_node():
            root = loader.get_node()
            stack = [("", root)]
            while stack:
                at, node = stack.pop()
                if isinstance(node, yaml.MappingNode):
                    loader.flatten_mapping(node)
                    own: dict[str, yaml.Node] = {}
                    for k, v in node.value:
                        own[str(loader.construct_object(k, deep=True))] = v  # the last of a key, which is the explicit one
                    stack += [(f"{at}.{k}" if at else k, v) for k, v in reversed(own.items())]
                elif isinstance(node, yaml.SequenceNode):
                    stack += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(node.value)))]
                else:
                    value = loader.construct_object(node)
                    value = value if isinstance(value, (str, bool, int, float, type(None))) else str(value)
                    found.append((at, value, node.start_mark.line + 1, node.start_mark.column + 1))
    finally:
        loader.dispose()
    return found


_HCL = re.compile(
    r"""(?P<space>[ \t\r]+|\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<nl>\n)|(?P<heredoc><<-?(?P<tag>\w+)\n(?P<doc>.*?)\n[ \t]*(?P=tag)\b)
    |(?P<string>"(?:\\.|\$\{(?:[^{}"]|"[^"]*"|\{[^{}]*\})*\}|[^"\\])*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b)|(?P<name>[A-Za-z_][\w-]*)|(?P<op>[{}\[\](),=:]|[^\s])""",
    re.S | re.X,
)


class _Skip(Exception):
    pass


class Hcl:
    """Attributes and blocks of an HCL text; expressions other than literals, lists and objects have no nodes."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _HCL.match(text, at)
            if not m:
                raise ValueError("not HCL")
            if m.lastgroup != "space" and not m.group("space"):
                kind = next(k for k in ("nl", "heredoc", "string", "number", "name", "op") if m.group(k))
                self.tokens.append((kind, m.group(), at, m.group("doc")))
            at = m.end()
        self.at = 0
        self.found: list[Node] = []

    def peek(self, skip: bool = False) -> tuple:
        while skip and self.at < len(self.tokens) and self.tokens[self.at][0] == "nl":
            self.at += 1
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", len(self.text), None)

    def take(self, skip: bool = False) -> tuple:
        t = self.peek(skip)
        self.at += 1
        return t

    def place(self, at: int) -> tuple[int, int]:
        start = self.text.rfind("\n", 0, at) + 1
        return self.text.count("\n", 0, at) + 1, at - start + 1

    def body(self, path: str, closing: str) -> None:
        while True:
            kind, text, at, _ = self.take(True)
            if (kind, text) == ("end", "") or text == closing:
                if text != closing:
                    raise ValueError("a block is open at the end")
                return
            if kind not in ("name", "string"):
                raise ValueError("a name was expected")
            name = self.unquote(text) if kind == "string" else text
            here = f"{path}.{name}" if path else name
            if self.peek()[1] == "=":
                self.take()
                self.attribute(here, at)
            else:
                while self.peek()[0] in ("name", "string"):
                    k, label, *_ = self.take()
                    here += "." + (self.unquote(label) if k == "string" else label)
                if self.take(True)[1] != "{":
                    raise ValueError("a block was expected")
                self.body(here, "}")

    def attribute(self, path: str, at: int) -> None:
        start = self.at
        try:
            value = self.value()
            if self.peek()[0] not in ("nl", "end") and self.peek()[1] not in "}":
                raise _Skip
        except _Skip:
            self.at = start
            self.skip_expression()
            return
        line, column = self.place(at)
        self.found += [(p, v, line, column) for p, v in leaves(value, path) if v is not _Skip]

    def skip_expression(self) -> None:
        depth = 0
        while True:
            kind, text, *_ = self.peek()
            if kind == "end" or depth == 0 and (kind == "nl" or text == "}"):
                return
            depth += (text in ("{", "[", "(")) - (text in ("}", "]", ")"))
            self.at += 1

    def value(self) -> object:
        kind, text, _, doc = self.take(True)
        if kind == "string":
            if "${" in text:
                raise _Skip
            return self.unquote(text)
        if kind == "heredoc":
            return doc + "\n"
        if kind == "number":
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if kind == "name" and text in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text]
        if text == "[":
            out: list = []
            while self.peek(True)[1] != "]":
                out.append(self.element(",]"))
                if self.peek(True)[1] == ",":
                    self.take()
            self.take()
            return out
        if text == "{":
            obj: dict = {}
            while self.peek(True)[1] != "}":
                k, key, *_ = self.take(True)
                if k not in ("name", "string"):
                    raise _Skip
                if self.take(True)[1] not in ("=", ":"):
                    raise _Skip
                obj[self.unquote(key) if k == "string" else key] = self.element(",}\n")
                if self.peek(True)[1] == ",":
                    self.take()
            self.take()
            return obj
        raise _Skip

    def element(self, ends: str) -> object:
        """A value inside a container, or nothing where it is another expression."""
        start = self.at
        try:
            v = self.value()
            if self.peek()[1] in ends or self.peek(True)[1] in ends:
                return v
        except _Skip:
            pass
        self.at, depth = start, 0
        while True:
            kind, text, *_ = self.peek()
            if kind == "end":
                raise _Skip
            if depth == 0 and (text in ends):
                return _Skip
            depth += (text in ("{", "[", "(")) - (text in ("}", "]", ")"))
            self.at += 1

    @staticmethod
    def unquote(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1], flags=re.S)


def read_hcl(text: str) -> list[Node]:
    """Nodes of a Terraform text; a text that can't be parsed has none, and that is no error."""
    try:
        h = Hcl(text)
        h.body("", "")
    except ValueError:
        return []
    return h.found


#: file type -> (kind of its nodes, reader).
NESTED: dict[str, tuple[str, Callable[[str], list[Node]]]] = {"json": ("json", read_json), "yaml": ("yaml", read_yaml), "hcl": ("terraform", read_hcl)}


def nested_nodes(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, kind, source in zip(b.file_path, b.file_type, b.source, strict=True):
                name, reader = NESTED[kind]
                try:
                    found = reader(source or "")
                except Exception:  # noqa: BLE001  any failure of a parser is the file's
                    continue
                rows += [(file, 0, name, p, canonical(v), line, column) for p, v, line, column in found]
            yield pd.DataFrame(rows, columns=["file_path", "id", "kind", "path", "value_json", "line", "column"])

    return in_pieces(files.where(F.col("file_type").isin(*NESTED)).select("file_path", "file_type", "source"), run, NODES, "source")


def status_of(kind: str, source: str | None) -> str:
    """ok or error, for the nested formats and Python; a file without text (bytes that are no UTF-8) is an error."""
    import ast

    try:
        if source is None:
            raise UnicodeError
        if kind in NESTED:
            NESTED[kind][1](source)
        elif kind == "python":
            if not source.strip():
                raise ValueError("empty")
            ast.parse(source)
    except Exception as e:  # noqa: BLE001
        return f"error: {type(e).__name__}"
    return "ok"


def parse_status(files: DataFrame) -> DataFrame:
    """``files`` with their parse_status told anew."""
    from .corpus import parse_status as told

    return files.withColumn("parse_status", told("file_type", "source"))


def nodes(files: DataFrame) -> DataFrame:
    """Nodes of all files for which there is a reader. See code_nodes for programming languages."""
    from .code import code_nodes

    return dockerfile_nodes(files).unionByName(generic_nodes(files)).unionByName(nested_nodes(files)).unionByName(code_nodes(files))


def props_nodes(df: DataFrame, id_col: str, json_col: str, keys: list[str]) -> DataFrame:
    """Nodes of known top-level keys of a JSON column, by built-in functions: nothing leaves the JVM."""
    pairs = F.array(*[F.struct(F.lit(k).alias("path"), F.get_json_object(json_col, f"$.{k}").alias("value_json")) for k in keys])
    rows = df.select(F.col(id_col).cast("string").alias("file_path"), F.inline(pairs)).where("value_json is not null")
    return rows.select(
        "file_path", F.lit(0).cast("long").alias("id"), F.lit("json").alias("kind"), "path", "value_json", F.lit(1).alias("line"), F.lit(1).alias("column")
    )
