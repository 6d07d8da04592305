"""Names of taint sources, sinks and sanitisers by language. ``extend`` adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
_PY_REQUEST = [f"{p}request.{a}{g}" for p in ("", "flask.") for a in ("args", "form", "values") for g in ("", ".get")]
_JAVA_READ = ["getParameter", "getParameterValues", "getHeader", "getQueryString"]
CATALOG: dict[str, dict[str, set[str]]] = {
    "python": {
        "source": {"input", "sys.stdin.readline", *_PY_REQUEST},
        "sink": {
            *(f"os.exec{x}" for x in ("v", "ve", "vp", "vpe", "l", "le", "lp", "lpe")),
            *(f"subprocess.{x}" for x in ("call", "run", "Popen", "check_call", "check_output")),
        },
        "sanitizer": {"sanitize", "clean", "escape", "html.escape", "bleach.clean"},
    },
    "rust": {"source": {"source"}, "sink": {"sink", "macro::println"}, "sanitizer": {"sanitize", "clean", "escape"}},
    "java": {
        "source": {
            *_JAVA_READ, *(f"request.{x}" for x in _JAVA_READ), *(f"HttpServletRequest.{x}" for x in _JAVA_READ),
            "System.getenv", "ObjectMapper.readValue", "Gson.fromJson",
        },
        "sink": {
            "Statement.execute", "Statement.executeQuery", "Statement.executeUpdate", "Runtime.exec", "Runtime.getRuntime.exec", "ProcessBuilder.start",
            "Class.forName", "Method.invoke", "Files.newInputStream", "Files.newOutputStream", "FileInputStream",
        },
        "sanitizer": {
            "StringEscapeUtils.escapeHtml", "StringEscapeUtils.escapeEcmaScript", "StringEscapeUtils.escapeJson", "Encode.forHtml", "Encode.forJavaScript",
            "Encode.forUriComponent", "encodeForHTML", "Jsoup.clean",
        },
    },
    "php": {"source": set(), "sink": set(), "sanitizer": {"htmlspecialchars", "htmlentities", "mysqli_real_escape_string", "strip_tags", "sanitize"}},
    "javascript": {"source": set(), "sink": set(), "sanitizer": {"sanitize"}},
    "typescript": {"source": {"source"}, "sink": {"sink"}, "sanitizer": {"sanitize"}},
}


def extend(language: str, sources: list[str] = (), sinks: list[str] = (), sanitizers: list[str] = ()) -> None:
    own = CATALOG.setdefault(language, {"source": set(), "sink": set(), "sanitizer": set()})
    for role, names in (("source", sources), ("sink", sinks), ("sanitizer", sanitizers)):
        own[role].update(names)


def snapshot() -> dict[str, dict[str, frozenset[str]]]:
    """What tasks take along, so that a later ``extend`` doesn't change a running plan."""
    return {lang: {role: frozenset(names) for role, names in roles.items()} for lang, roles in CATALOG.items()}


def has(catalog: dict, language: str, role: str, name: str) -> bool:
    """Whether a name, its last step, or the macro of that name is in a role."""
    names = catalog.get(language, {}).get(role, ())
    return bool(name) and (name in names or f"macro::{name}" in names or (role != "sink" or language != "python") and name.rpartition(".")[2] in names)


def frame(spark: SparkSession) -> DataFrame:
    rows = [(lang, role, n) for lang, roles in CATALOG.items() for role, names in roles.items() for n in sorted(names)]
    return spark.createDataFrame(rows, "lang string, role string, name string")
