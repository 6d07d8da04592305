import pytest
from pyspark.sql import functions as F

from sieveflow.functions import scalar as S
from sieveflow.schemas import parse_severity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_places(spark):
    text = F.lit("aé\nbc\nd")
    assert one(spark, S.line_at(text, F.lit(4))) == 2
    assert one(spark, S.byte_column_at(text, F.lit(2))) == 4
    assert one(spark, S.first_match_column(F.lit("é日x1"), "[0-9]")) == 7
    assert one(spark, S.first_match_column(F.lit("none"), "[0-9]")) is None


def test_names_and_paths(spark):
    assert one(spark, S.assignment_lhs(F.lit("x\n  user: str = "))) == "user"
    assert one(spark, S.dollar_variables(F.lit("f($a, $b_1)"))) == ["a", "b_1"]
    assert one(spark, S.camel(F.lit("function_definition_X"))) == "FunctionDefinitionX"
    assert one(spark, S.module_name(F.lit("pkg/sub/__init__.py"))) == "pkg.sub"
    assert one(spark, S.module_name(F.lit("pkg/mod.py"))) == "pkg.mod"
    assert one(spark, S.call_name(F.lit("sp.run"), F.lit("sp"), F.lit("subprocess"))) == "subprocess.run"
    assert one(spark, S.normalise_path(F.lit("./a//b/../c/./d"))) == "a/c/d"
    assert one(spark, S.duration(F.lit(3671))) == "01:01:11"
    assert one(spark, S.virtual_path(F.lit("/a/b.py"))).startswith("/virtual/b.py-")


def test_globs(spark):
    m = lambda path, glob: one(spark, S.path_matches(F.lit(path), glob))
    assert m("axbyc", "a*b*c") and not m("axby", "a*b*c")
    assert m("src/foo/main.rs", "**/foo/*.rs") and not m("src/bar/main.rs", "**/foo/*.rs")
    assert not m("foo/a.rs", "foo/?.rs") and not m("a.b[0]", "a.b") and m("a.b.c", "a.*")
    g = lambda path, glob: one(spark, S.glob_column(F.lit(path), glob))
    assert g("a/b/c.py", "**/*.py") and not g("a/b/c.py", "a/*.py") and g("a/x.py", "a/?.py")
    with pytest.raises(ValueError):
        S.glob_regex("[a]")


def test_severity():
    assert parse_severity("warning") == "MEDIUM" and parse_severity(" high ") == "HIGH"
    with pytest.raises(ValueError, match="unknown severity"):
        parse_severity("BOGUS")


def test_dollar_is_the_end_of_the_text():
    assert S.end_of_text("a$") == r"a\z" and S.end_of_text(r"a\$[$]") == r"a\$[$]" and S.end_of_text("(?m)a$") == "(?m)a$"
