import json

import pytest

from sieveflow.sources import code, corpus, project, readers


def nodes_of(spark, **sources):
    files = corpus.from_strings(spark, {k.replace("__", "."): v for k, v in sources.items()})
    return {(r.path, json.loads(r.value_json)) if not isinstance(json.loads(r.value_json), (dict, list)) else (r.path, r.value_json) for r in readers.nodes(files).collect()}


def test_types(spark):
    names = ["a.yml", "a.JSON", "b/Dockerfile", "x.tf", "x.tsx", "m.py", "noext", "a.b.rs", ".py"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", corpus.detect_type("p").alias("t")).collect()
    assert [r.t for r in got] == ["yaml", "json", "dockerfile", "hcl", "typescript", "python", "generic", "rust", "generic"]


def test_excludes_last_match_wins(spark):
    ex = corpus.excludes(["**/*.log", "!**/keep.log"], ignore_texts=["# c\nbuild/\n[bad]\n\n"])
    paths = ["a/x.log", "a/keep.log", "p/node_modules/q/i.js", "x/build/o.txt", "src/a.py"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(corpus.is_excluded("p", ex).alias("x")).collect()
    assert [r.x for r in got] == [True, False, True, True, False]
    with pytest.raises(ValueError):
        corpus.Exclude.parse("")


def test_lines(spark):
    f = corpus.from_strings(spark, {"a": "x\r\ny sast-ignore\n", "b": "", "c": "\n", "d": "last"})
    got = sorted((r.file_path, r.line, r.text) for r in corpus.lines(f).collect())
    assert got == [("a", 1, "x"), ("a", 2, "y sast-ignore"), ("c", 1, ""), ("d", 1, "last")]
    assert {r.file_path: r.suppressed for r in f.collect()}["a"] == [2]


def test_load_corpus(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "big.txt").write_text("y" * 100)
    (tmp_path / "node_modules" / "b.js").write_text("z")
    got = corpus.load_corpus(spark, str(tmp_path), max_size=50).collect()
    assert [(r.file_path, r.file_type, r.source, r.size) for r in got] == [(str(tmp_path / "src" / "a.py"), "python", "x = 1\n", 6)]


def test_transformed_and_discovered(spark):
    import base64

    f = corpus.from_strings(spark, {"a.py": "old", "b.py": "stay"})
    b64 = base64.b64encode(b"new").decode()
    t = corpus.transformed(f, spark.createDataFrame([("a.py", b64, "rust"), ("c.yaml", b64, None)], "path string, content_b64 string, language string"))
    assert sorted((r.file_path, r.file_type, r.source) for r in t.collect()) == [("a.py", "rust", "new"), ("b.py", "python", "stay"), ("c.yaml", "yaml", "new")]
    assert sorted((r.file_path, r.source) for r in corpus.discovered(f, t).collect()) == [("a.py", "old"), ("b.py", "stay"), ("c.yaml", "new")]


def test_readers(spark):
    assert nodes_of(spark, Dockerfile="# c\nFROM alpine:3.14\n\n  ADD . /app\n") == {("FROM", "FROM alpine:3.14"), ("ADD", "ADD . /app")}
    assert nodes_of(spark, a__yaml="database:\n  password: admin\n  port: 1\nl: [x, {y: true}]\n") == {("database.password", "admin"), ("database.port", 1), ("l[0]", "x"), ("l[1].y", True)}
    assert nodes_of(spark, b__yaml="a: &A {b: 1}\nc: *A\n") == {("a.b", 1), ("c.b", 1)}
    assert ("foo.b", 3) in (got := nodes_of(spark, m__yaml="d: &d {a: 1, b: 2}\nfoo: {<<: *d, b: 3}\n")) and ("foo.a", 1) in got and ("foo.b", 2) not in got
    assert nodes_of(spark, n__yaml="foo: {<<: *nowhere}\n") == set()
    assert nodes_of(spark, a__json='{"a": {"b": [1, "2", null]}}') == {("a.b[0]", 1), ("a.b[1]", "2"), ("a.b[2]", None)}
    tf = 'resource "aws_s3_bucket" "b" {\n  acl = "public-read" # c\n  n = 3\n  v = var.x\n  ingress {\n    cidr_blocks = ["0.0.0.0/0", local.y]\n  }\n  tags = { A = "x" }\n}\n'
    base = "resource.aws_s3_bucket.b."
    assert nodes_of(spark, a__tf=tf) == {(base + "acl", "public-read"), (base + "n", 3), (base + "ingress.cidr_blocks[0]", "0.0.0.0/0"), (base + "tags.A", "x")}
    assert nodes_of(spark, b__tf="resource {") == set() and nodes_of(spark, t__txt="a\nb") == {("1", "a"), ("2", "b")}
    bad = corpus.from_strings(spark, {"a.json": "{", "b.json": "1", "c.py": "def"})
    assert {r.file_path: r.parse_status for r in readers.parse_status(bad).collect()} == {"a.json": "error: JSONDecodeError", "b.json": "ok", "c.py": "error: SyntaxError"}


def words(language, source):
    return {n[0] for n in code.parse("f", language, source).nodes}


def test_words_of_languages():
    assert {"import.subprocess", "call.subprocess.run", "assign.k"} <= words("python", "import subprocess as sp\nsp.run(x)\nk = 's'\n")
    assert {"import_from.os.system", "call.os.system"} <= words("python", "from os import system\nsystem('x')\n")
    assert {"function.main", "call.source", "macro.println", "assign.x", "unsafe"} <= words("rust", 'fn main() { let x = source(); println!("a"); unsafe { } }')
    assert {"import.java.util.List", "call.System.exit", "call.new Foo"} <= words("java", "import java.util.List;\nclass A { void f() { System.exit(1); new Foo(x); } }")
    assert {"call.echo", "var._GET", "assign.n"} <= words("php", "<?php $n = $_GET['n']; echo $n;")
    assert {"function.h", "call.res.send", "class.C", "var.v", "loop.for", "import.fs"} <= words("javascript", "import x from 'fs'; function h() { res.send(1) } class C {} let v = 1; for (;;) {}")
    assert {"function.f", "call.fmt.Println"} <= words("go", 'func f() { fmt.Println("x") }')
    assert {"function.f", "call.puts"} <= words("ruby", "def f\n  puts('x')\nend\n")
    assert not {"call.eval"} & words("javascript", "// eval(x)\n'eval(x)'")


def test_branches_of_word_languages():
    """A sanitiser in one arm does not clean a name; one in every arm does."""
    cat = {lang: {"source": {"source"}, "sink": {"sink"}, "sanitizer": {"clean"}} for lang in ("rust", "java", "php", "javascript")}

    def state(language, body):
        p = code.parse("f", language, body, cat)
        name = "$d" if language == "php" else "d"
        uses = [x[2] for x in p.flow.values() if x[0] == name and x[1] == "Use"]
        return p.symbols[name].sanitized, uses[-1:], sum(e[2] == "merge" for e in p.edges)

    for language, wrap, let, v in (
        ("rust", "fn f() {{ {} }}", "let mut ", "d"), ("java", "class A {{ void f() {{ {} }} }}", "String ", "d"),
        ("php", "<?php {}", "", "$d"), ("javascript", "function f() {{ {} }}", "let ", "d"),
    ):
        test = "if c" if language == "rust" else "if (c)"
        begin = f"{let}{v} = source();\n"
        one = wrap.format(f"{begin}{test} {{\n {v} = clean({v});\n}}\nsink({v});")
        half = wrap.format(f"{begin}{test} {{\n {v} = clean({v});\n}} else {{\n {v} = source();\n}}\nsink({v});")
        both = wrap.format(f"{begin}{test} {{\n {v} = clean({v});\n}} else {test} {{\n {v} = clean({v});\n}} else {{\n {v} = clean({v});\n}}\nsink({v});")
        chain = wrap.format(f"{begin}{test} {{\n {v} = clean({v});\n}} else {test} {{\n {v} = clean({v});\n}}\nsink({v});")
        assert state(language, one) == (False, [False], 2), language
        assert state(language, half) == (False, [False], 2), language
        assert state(language, both) == (True, [True], 3), language
        assert state(language, chain) == (False, [False], 3), language
    switch = "class A {{ void f() {{ String d = source(); switch (k) {{ case 1: case 2: d = clean(d); break; {} }} sink(d); }} }}"
    assert state("java", switch.format("default: d = clean(d);")) == (True, [True], 2)
    assert state("java", switch.format(""))[:2] == (False, [False])
    assert state("java", switch.format("default:"))[:2] == (False, [False])
    match = "fn f() {{ let mut d = source(); match k {{ 1 => {{ d = clean(d); }} _ => {{ {} }} }} sink(d); }}"
    assert state("rust", match.format("d = clean(d);")) == (True, [True], 2)
    assert state("rust", match.format(""))[:2] == (False, [False])
    deep = "function f() { let d = source(); " + "if (a) { " * 300 + "d = clean(d); " + "} " * 300 + "sink(d); }"
    assert state("javascript", deep)[:2] == (False, [False])
    for broken in ("if (", "if (c) {", "else {", "switch (k) {", "switch (k) { case", "} if ) {", "match k { =>", "if"):
        for language in cat:
            code.parse("f", language, broken, cat)


def test_python_tree(spark):
    t = code.ast_nodes(corpus.from_strings(spark, {"a.py": "def foo(x):\n    eval(x)\n"})).collect()
    call = next(r for r in t if r.kind == "Call")
    fn = next(r for r in t if r.kind == "FunctionDefinition")
    assert call.value == "eval" and fn.value == "foo" and fn.lo < call.lo <= fn.hi
    assert code.ast_nodes(corpus.from_strings(spark, {"a.py": "def"})).collect() == []


def test_project(spark):
    f = corpus.from_strings(spark, {"pkg/util.py": "def clean(x):\n    return x\nsafe = 'a'\n", "app.py": "from pkg.util import safe\nimport pkg.util as u\ny = safe\n"})
    m = project.modules(f)
    assert {r.module for r in m.collect()} == {"pkg.util", "app"}
    links = project.import_links(readers.nodes(f), m, code.symbols(f)).collect()
    assert {(r.file_path, r.alias, r.target_file, r.name, r.sanitized) for r in links} == {("app.py", "safe", "pkg/util.py", "safe", True), ("app.py", "u", "pkg/util.py", None, None)}
    roots = project.symbol_roots(code.symbols(corpus.from_strings(spark, {"a.py": "a = f()\nb = a\nc = b\n"}))).collect()
    assert {(r.name, r.root) for r in roots} == {("b", "a"), ("c", "a")}
    php = corpus.from_strings(spark, {"/w/a.php": "<?php include 'lib/b.php';", "/w/lib/b.php": "<?php require '../c.php';", "/w/c.php": "<?php"})
    got = project.include_closure(php, spark.createDataFrame([("/w/a.php",)], "node string")).collect()
    assert {r.node for r in got} == {"/w/a.php", "/w/lib/b.php", "/w/c.php"}


def test_php_includes_are_folded(spark):
    src = {
        "/w/app/a.php": "<?php\nrequire_once __DIR__ . '/sub' . \"/b.php\";\ninclude(dirname(__FILE__) . '/../c.php');\nrequire dirname(__DIR__) . '/d.php';\ninclude $x . '/no.php';\ninclude 'e.php';\n$y->include('f.php');\n",
        "top.php": "<?php include __DIR__ . '/x/y.php'; include 'z.php';",
    }
    got = {(r.src, r.dst) for r in project.php_includes(corpus.from_strings(spark, src)).collect()}
    assert got == {("/w/app/a.php", f"/w/{x}.php") for x in ("app/sub/b", "c", "d", "app/e")} | {("top.php", "/x/y.php"), ("top.php", "z.php")}


def test_classes_by_their_longest_prefix(spark):
    src = {
        "/w/composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/", "App\\\\Model\\\\": ["models", "more/"]}}, "autoload-dev": {"psr-4": {"Tests\\\\": "tests"}}}',
        "/w/index.php": "<?php\nuse App\\Model\\User;\nuse App\\Http\\Home as H;\nuse \\Tests\\Base;\nuse App\\Model\\Deep\\Thing;\nuse Other\\Name;\nuse App\\Gone;\n",
        "/w/src/Model/User.php": "<?php", "/w/models/User.php": "<?php", "/w/src/Http/Home.php": "<?php include '../part.php';", "/w/tests/Base.php": "<?php", "/w/more/Deep/Thing.php": "<?php", "/w/src/part.php": "<?php",
    }
    files = corpus.from_strings(spark, src)
    assert {(r.prefix, r.folder) for r in project.autoload_prefixes(files).collect()} == {("App\\", "/w/src"), ("App\\Model\\", "/w/models"), ("App\\Model\\", "/w/more"), ("Tests\\", "/w/tests")}
    assert {r.dst for r in project.class_files(files).collect()} == {"/w/models/User.php", "/w/src/Http/Home.php", "/w/tests/Base.php", "/w/more/Deep/Thing.php"}
    got = project.include_closure(files, spark.createDataFrame([("/w/index.php",)], "node string"))
    assert {r.node for r in got.collect()} == {"/w/index.php", "/w/models/User.php", "/w/src/Http/Home.php", "/w/tests/Base.php", "/w/more/Deep/Thing.php", "/w/src/part.php"}
