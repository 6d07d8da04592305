"""Whole projects: modules of files, and imports joined to the names that they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveflow.functions.durable import shuffled
from sieveflow.functions.scalar import module_name, normalise_path
from sieveflow.operators.graph import reach, resolve_aliases

#: Separator, extension and index file of a language's modules.
MODULES = {"python": (".", "py", "__init__"), "rust": ("::", "rs", "mod|lib|main"), "java": (".", "java", "package-info"), "php": ("/", "php", "index")}


def modules(files: DataFrame, root: str = "") -> DataFrame:
    """file_path, file_type, module."""
    path = F.regexp_replace("file_path", f"^{root.rstrip('/')}/" if root else "^/", "")
    out = None
    for lang, (sep, ext, index) in MODULES.items():
        hit = F.when(F.col("file_type") == lang, module_name(path, sep, ext, f"(?:{index})"))
        out = hit if out is None else F.coalesce(out, hit)
    return files.where(F.col("file_type").isin(*MODULES)).select("file_path", "file_type", out.alias("module"))


def import_links(nodes: DataFrame, mods: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, alias, target_file, name, sanitized: what each import means in another file of the project.

    An import is of a module, or of a member of one: the last step is then the member's name.
    """
    imports = nodes.where(F.col("path").rlike(r"^import(_from)?\.")).select(
        "file_path", F.regexp_replace("path", r"^import(_from)?\.", "").alias("full"), F.get_json_object("value_json", "$.alias").alias("alias")
    )
    last = F.element_at(F.split("full", r"\.|::|/"), -1)
    cut = F.substring("full", F.lit(1), F.length("full") - F.length(last))
    imports = imports.select("file_path", "alias", "full", last.alias("member"), F.regexp_replace(cut, r"(\.|::|/)$", "").alias("head"))
    # The module or the member's module: both meet the modules in one join, for which files are parsed once.
    meant = F.array(F.struct(F.col("full").alias("module"), F.lit(None).cast("string").alias("name")), F.struct(F.col("head").alias("module"), F.col("member").alias("name")))
    m = mods.select(F.col("file_path").alias("target_file"), "module")
    both = imports.select("file_path", "alias", F.inline(meant)).join(shuffled(m), "module").select("file_path", "alias", "target_file", "name")
    s = symbols.select(F.col("file_path").alias("target_file"), F.col("name"), "sanitized")
    return both.join(shuffled(s), ["target_file", "name"], "left").select("file_path", "alias", "target_file", "name", "sanitized")


def linked_flow(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (src_file, src, dst_file, dst) from definitions to the aliases that import them."""
    a = symbols.where("def is not null").select(F.col("file_path").alias("target_file"), "name", F.col("def").alias("src"))
    b = symbols.where("def is not null").select("file_path", F.col("name").alias("alias"), F.col("def").alias("dst"))
    j = links.where("name is not null").join(shuffled(a), ["target_file", "name"]).join(shuffled(b), ["file_path", "alias"])
    return j.select(F.col("target_file").alias("src_file"), "src", F.col("file_path").alias("dst_file"), "dst")


def symbol_roots(symbols: DataFrame) -> DataFrame:
    """file_path, name, root: aliases followed to their ends within a file."""
    key = lambda c: F.concat_ws("\1", "file_path", c)
    r = resolve_aliases(symbols.where("alias_of is not null").select(key("name").alias("name"), key("alias_of").alias("alias_of")))
    at = lambda c, i: F.split(c, "\1")[i]
    return r.select(at("name", 0).alias("file_path"), at("name", 1).alias("name"), at("root", 1).alias("root"))


def php_includes(files: DataFrame) -> DataFrame:
    """src, dst: files that PHP files include. Concatenations of literals, ``__DIR__``, ``dirname(__FILE__)`` and ``dirname(__DIR__)`` are folded.

    A path that doesn't start at the root is relative to the including file. What is left with a variable is no path.
    """
    php = files.where("file_type = 'php'").select(F.col("file_path").alias("src"), "source")
    said = php.select("src", F.explode(F.regexp_extract_all("source", F.lit(r"(?m)(?<![\w$>:])(?:include|require)(?:_once)?\b\s*([^;?]+)"), F.lit(1))).alias("said"))
    folder = F.regexp_replace("src", "/?[^/]*$", "")
    above = F.regexp_replace(folder, "/?[^/]*$", "")
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(c, r"([\\$])", r"\\$1"), F.lit("'"))
    x = F.regexp_replace(F.trim("said"), '"([^"$]*)"', "'$1'")
    for rx, put in ((r"dirname\(\s*__DIR__\s*\)", above), (r"dirname\(\s*__FILE__\s*,\s*2\s*\)", above), (r"dirname\(\s*__FILE__\s*\)|__DIR__", folder)):
        x = F.regexp_replace(x, F.lit(rx), quoted(put))
    x = F.regexp_replace(x, r"'\s*\.\s*'", "")
    x = F.regexp_extract(x, r"^\(?\s*'([^']*)'\s*\)?\s*$", 1)
    found = said.select("src", x.alias("path"), folder.alias("folder")).where("path != ''")
    absolute = F.col("path").startswith("/") | ((F.col("folder") != "") & F.col("path").startswith(F.concat("folder", F.lit("/")))) | (F.col("path") == F.col("folder"))
    target = F.when(absolute, F.col("path")).when(F.col("folder") == "", F.col("path")).otherwise(F.concat("folder", F.lit("/"), "path"))
    return found.select("src", normalise_path(target).alias("dst")).distinct()


def autoload_prefixes(files: DataFrame) -> DataFrame:
    """prefix (with its last backslash), folder: the psr-4 and psr-0 rules of composer.json files."""
    config = files.where(F.col("file_path").rlike("(^|/)composer\\.json$"))
    root = F.regexp_replace("file_path", "[^/]*$", "")
    out = None
    for section in ("autoload", "autoload-dev"):
        # A prefix has one folder or a list of them.
        text = F.get_json_object("source", f"$.{section}.psr-4") if section == "autoload" else F.get_json_object("source", "$['autoload-dev'].psr-4")
        rules = config.select(root.alias("root"), F.explode(F.map_entries(F.from_json(text, "map<string,string>"))).alias("e"))
        many = F.when(F.col("e.value").startswith("["), F.from_json("e.value", "array<string>")).otherwise(F.array("e.value"))
        rules = rules.select("root", F.col("e.key").alias("prefix"), F.explode(many).alias("folder"))
        rows = rules.select("prefix", normalise_path(F.concat("root", F.regexp_replace("folder", "/*$", ""))).alias("folder"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def class_files(files: DataFrame) -> DataFrame:
    """src, dst: files of the classes that PHP files use, by the longest autoload prefix whose file is there.

    A class meets the prefixes by equality: it goes to the join once for each of its own beginnings.
    """
    php = files.where("file_type = 'php'").select(F.col("file_path").alias("src"), "source")
    used = php.select("src", F.explode(F.regexp_extract_all("source", F.lit(r"(?m)^\s*use\s+\\?([A-Za-z_][\w\\]*)"), F.lit(1))).alias("name")).distinct()
    steps = F.split("name", r"\\")
    starts = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, n), "\\"), F.lit("\\"))))
    each = used.select("src", "name", F.explode(starts).alias("prefix")).join(shuffled(autoload_prefixes(files)), "prefix")
    rest = F.replace(F.expr("substring(name, length(prefix) + 1)"), F.lit("\\"), F.lit("/"))
    where = each.select("src", "name", F.length("prefix").alias("n"), F.concat(F.col("folder"), F.lit("/"), rest, F.lit(".php")).alias("dst"))
    there = where.join(shuffled(files.select(F.col("file_path").alias("dst"))), "dst", "left_semi")
    return there.groupBy("src", "name").agg(F.max_by("dst", F.struct("n", "dst")).alias("dst")).select("src", "dst").distinct()


def include_closure(files: DataFrame, start: DataFrame) -> DataFrame:
    """Files (node) reached from ``start`` over PHP includes and autoloaded classes."""
    return reach(php_includes(files).unionByName(class_files(files)).distinct(), start)
