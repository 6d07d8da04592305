"""Scalar functions of the engine, as Column expressions wherever Spark has the means."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finding_id(rule: str | Column, file: str | Column, line: str | Column, column: str | Column) -> Column:
    """SHA-256 of ``rule:file:line:column``: what makes two findings one."""
    return F.sha2(F.concat_ws(":", _c(rule), _c(file), _c(line).cast("string"), _c(column).cast("string")), 256)


def line_at(text: str | Column, offset: str | Column) -> Column:
    """1-based line of a 0-based character offset."""
    prefix = F.substring(_c(text), F.lit(1), _c(offset))
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def byte_column_at(text: str | Column, offset: str | Column) -> Column:
    """1-based byte column of a 0-based character offset."""
    prefix = F.substring(_c(text), F.lit(1), _c(offset))
    return F.octet_length(F.substring_index(prefix, "\n", -1)) + 1


def first_match_column(text: str | Column, pattern: str) -> Column:
    """1-based byte column of the first match of a line; null without one."""
    at = F.regexp_instr(_c(text), F.lit(pattern))
    return F.when(at > 0, F.octet_length(F.substring(_c(text), F.lit(1), at - 1)) + 1)


def assignment_lhs(prefix: str | Column) -> Column:
    """The identifier that is assigned to right where ``prefix`` ends, or ''."""
    return F.regexp_extract(_c(prefix), r"([A-Za-z_]\w*)\s*(?::\s*[A-Za-z_]\w*)?\s*=\s*\z", 1)


def dollar_variables(text: str | Column) -> Column:
    """Names of the ``$name`` tokens of a text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(r"\$([A-Za-z0-9_]+)"), F.lit(1))


def normalise_path(path: str | Column) -> Column:
    """``.`` and empty steps and back slashes out, ``..`` resolved where it has something to undo."""
    p = F.regexp_replace(F.regexp_replace(_c(path), r"\\", "/"), r"/(\./)+", "/")
    p = F.regexp_replace(F.regexp_replace(p, "(?<!:)/{2,}", "/"), r"^\./", "")
    for _ in range(8):
        p = F.regexp_replace(p, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return p


def virtual_path(path: str | Column) -> Column:
    """Where a plugin without access to files sees a file: its name and 12 digits of its path's hash."""
    p = _c(path)
    return F.concat(F.lit("/virtual/"), F.substring_index(p, "/", -1), F.lit("-"), F.substring(F.sha2(p, 256), 1, 12))


def camel(kind: str | Column) -> Column:
    """snake_case to CamelCase; letters after the first of a word stay."""
    up = F.transform(F.split(_c(kind), "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
    return F.array_join(up, "")


def module_name(path: str | Column, separator: str = ".", extension: str = "py", index: str = "__init__") -> Column:
    """Module of a source file: no extension, no index file, steps joined."""
    p = F.regexp_replace(_c(path), rf"\.{extension}$", "")
    p = F.regexp_replace(p, rf"(^|/){index}$", "")
    return F.replace(p, F.lit("/"), F.lit(separator))


def call_name(name: str | Column, alias: str | Column, module: str | Column) -> Column:
    """``alias.rest`` as ``module.rest``; a name that is the alias becomes the module."""
    n, a, m = _c(name), _c(alias), _c(module)
    rest = F.substring(n, F.length(a) + 1, F.length(n))
    return F.when((n == a) | n.startswith(F.concat(a, F.lit("."))), F.concat(m, rest)).otherwise(n)


def duration(seconds: str | Column) -> Column:
    """hh:mm:ss."""
    s = _c(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def sarif_level(severity: str | Column = "severity") -> Column:
    s = _c(severity)
    return F.when(s.isin("INFO", "LOW"), "note").when(s == "MEDIUM", "warning").otherwise("error")


def glob_column(path: str | Column, pattern: str) -> Column:
    """Whether a file path matches a glob of ``**``, ``*`` and ``?``."""
    return _c(path).rlike(glob_regex(pattern))


def glob_regex(pattern: str) -> str:
    """Anchored Java regex of a file glob: ``**`` crosses folders, ``*`` and ``?`` don't; no brackets."""
    if "[" in pattern or "]" in pattern:
        raise ValueError(f"brackets are not supported in {pattern!r}")
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    special = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(special.get(p) or java_quote(p) for p in parts) + r"\z"


def java_quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


#: What a path glob over nodes may hold besides ``.`` and ``*``.
_PATH_GLOB = re.compile(r"[A-Za-z0-9/_.*-]*\Z")


def path_glob_regex(pattern: str) -> str | None:
    """Anchored Java regex of a node-path glob, in which ``*`` crosses dots; None if it can never match."""
    if not _PATH_GLOB.match(pattern):
        return None
    return "^" + ".*".join(map(java_quote, pattern.split("*"))) + r"\z"


def path_matches(path: str | Column, pattern: str) -> Column:
    rx = path_glob_regex(pattern)
    return F.lit(False) if rx is None else F.coalesce(_c(path).rlike(rx), F.lit(False))


def end_of_text(pattern: str) -> str:
    """Java's ``$`` also matches before a last newline; outside multi-line mode make it the end of the text."""
    if "(?m" in pattern or re.search(r"\(\?[a-z]*m[a-z]*[):]", pattern):
        return pattern
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return "".join(out)
