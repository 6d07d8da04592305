"""Sources of files: folders, tables, transformed content, discovered rows; their types and lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveflow.functions.durable import shuffled
from sieveflow.functions.scalar import glob_regex

MAX_FILE_SIZE = 5 * 1024 * 1024
#: Fixed values.
DEFAULT_EXCLUDES = ("**/node_modules/**", "**/.git/**")
SUPPRESS_COMMENT = "sast-ignore"
EXTENSIONS = {
    "yaml": "yaml", "yml": "yaml", "json": "json", "tf": "hcl", "ts": "typescript", "tsx": "typescript", "js": "javascript",
    "jsx": "javascript", "py": "python", "go": "go", "rb": "ruby", "rs": "rust", "java": "java", "php": "php",
}


def detect_type(path: str | Column) -> Column:
    """Type by file name or extension, else generic. The content is not looked at."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.lower(F.substring_index(p, "/", -1))
    ext = F.regexp_extract(name, r"[^/]\.([a-z0-9]+)\z", 1)
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.when(name == "dockerfile", "dockerfile").otherwise(F.coalesce(known[ext], F.lit("generic")))


@dataclass(frozen=True)
class Exclude:
    """A glob and whether it brings files back (``!``)."""

    glob: str
    back: bool = False

    @classmethod
    def parse(cls, text: str) -> Exclude:
        text = text.strip()
        if not text:
            raise ValueError("an exclude pattern is empty")
        back = text.startswith("!")
        glob = text[1:] if back else text
        glob_regex(glob)  # refuses brackets
        return cls(glob, back)


def ignore_file(text: str) -> list[Exclude]:
    """Patterns of an ignore file's text: no comments, found anywhere below, invalid lines dropped."""
    found = []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        glob = line.lstrip("!").strip("/")
        if line.rstrip().endswith("/"):
            glob += "/**"
        try:
            found.append(Exclude.parse(("!" if back else "") + (glob if glob.startswith("**/") else f"**/{glob}")))
        except ValueError:
            continue
    return found


def excludes(patterns: Sequence[str] = (), default: bool = True, ignore_texts: Sequence[str] = ()) -> list[Exclude]:
    """All patterns in order; the last that matches a path decides."""
    found = [Exclude.parse(p) for p in DEFAULT_EXCLUDES] if default else []
    for t in ignore_texts:
        found += ignore_file(t)
    return found + [Exclude.parse(p) for p in patterns]


def is_excluded(path: str | Column, patterns: Sequence[Exclude], size: Column | None = None, max_size: int = MAX_FILE_SIZE) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    decided = None
    for x in reversed(patterns):
        hit = p.rlike(glob_regex(x.glob))
        decided = F.when(hit, F.lit(not x.back)) if decided is None else decided.when(hit, F.lit(not x.back))
    out = F.lit(False) if decided is None else F.coalesce(decided.otherwise(False), F.lit(False))
    return out if size is None else out | (size > max_size)


def suppressed_lines(source: str | Column = "source", comment: str = SUPPRESS_COMMENT) -> Column:
    """Numbers of the lines that hold the comment."""
    s = F.col(source) if isinstance(source, str) else source
    found = F.transform(split_lines(s), lambda x, i: F.when(x.contains(comment), (i + 1).cast("int")))
    return F.when(s.contains(comment), F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>"))  # other texts aren't split


def split_lines(source: str | Column = "source") -> Column:
    """Lines without their ends; no last empty line; an empty or null text has none."""
    s = F.col(source) if isinstance(source, str) else source
    parts = F.split(F.regexp_replace(s, r"\r?\n\z", ""), r"\r?\n")
    return F.when(F.length(s) > 0, parts).otherwise(F.array().cast("array<string>"))


def files_of(df: DataFrame, comment: str | None = SUPPRESS_COMMENT) -> DataFrame:
    """The files table from file_path, file_type, source (and size, if it is there)."""
    size = F.col("size") if "size" in df.columns else F.octet_length("source").cast("long")
    marks = suppressed_lines("source", comment) if comment else F.array().cast("array<int>")
    return df.select("file_path", "file_type", "source", size.alias("size"), marks.alias("suppressed"), parse_status("file_type", "source").alias("parse_status"))


def parse_status(file_type: str, source: str) -> Column:
    """``ok``, or what a strict parser says of a file. Plans that don't ask for it don't parse for it."""
    from .readers import status_of

    @F.pandas_udf("string")
    def status(kinds, sources):
        import pandas as pd

        return pd.Series([status_of(k, s) for k, s in zip(kinds, sources, strict=True)], dtype=object)

    return status(file_type, source)


def from_table(df: DataFrame, id_col: str, text_col: str, file_type: str | Column = "generic", comment: str | None = SUPPRESS_COMMENT) -> DataFrame:
    """A table's rows as files; nothing is shuffled."""
    kind = F.lit(file_type) if isinstance(file_type, str) else file_type
    return files_of(df.select(F.col(id_col).cast("string").alias("file_path"), kind.alias("file_type"), F.col(text_col).alias("source")), comment)


def load_corpus(spark: SparkSession, path: str, patterns: Sequence[str] = (), default_excludes: bool = True, ignore_texts: Sequence[str] = (),
                max_size: int = MAX_FILE_SIZE, comment: str | None = SUPPRESS_COMMENT) -> DataFrame:
    """All files below a folder. Excludes and the size cap are decided on path and length, before content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    clean = F.regexp_replace("path", "^file:/*", "/")
    kept = found.where((F.col("length") <= max_size) & ~is_excluded(clean, excludes(patterns, default_excludes, ignore_texts)))
    text = F.try_validate_utf8(F.col("content").cast("string"))  # null, and an error in parse_status, for other bytes
    return files_of(kept.select(clean.alias("file_path"), detect_type(clean).alias("file_type"), text.alias("source"), F.col("length").alias("size")), comment)


def from_strings(spark: SparkSession, sources: dict[str, str], comment: str | None = SUPPRESS_COMMENT) -> DataFrame:
    df = spark.createDataFrame(list(sources.items()), "file_path string, source string")
    return files_of(df.withColumn("file_type", detect_type("file_path")), comment)


def transformed(files: DataFrame, replaced: DataFrame, comment: str | None = SUPPRESS_COMMENT) -> DataFrame:
    """``files`` with content that a transform gave: rows (path, content_b64, language). New paths are added; the language hint wins."""
    new = replaced.select(
        F.col("path").alias("file_path"), F.coalesce(F.col("language"), detect_type("path")).alias("file_type"),
        F.decode(F.unbase64("content_b64"), "utf-8").alias("source"),
    )
    stay = files.join(shuffled(new.select("file_path")), "file_path", "left_anti")
    return stay.unionByName(files_of(new, comment))


def discovered(files: DataFrame, more: DataFrame) -> DataFrame:
    """Files and found files; of a path met twice the first stays."""
    both = files.withColumn("_from", F.lit(0)).unionByName(more.withColumn("_from", F.lit(1)))
    w = W.partitionBy("file_path").orderBy("_from")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_from")


def lines(files: DataFrame) -> DataFrame:
    """file_path, file_type, line, text: exploded at once, so nothing downstream carries whole sources.

    Not ``posexplode``, for which the optimizer would split all texts once more, before the files are dealt over the cores.
    """
    return files.select("file_path", "file_type", F.posexplode_outer(split_lines("source")).alias("at", "text")).where("at is not null").select(
        "file_path", "file_type", (F.col("at") + 1).cast("int").alias("line"), "text"
    )


def line_offsets(lines_: DataFrame) -> DataFrame:
    """``lines`` with byte_start, the bytes before each line (ends counted as one)."""
    w = W.partitionBy("file_path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines_.withColumn("byte_start", F.coalesce(F.sum(F.octet_length("text").cast("long") + 1).over(w), F.lit(0)))
