"""Arguments by nesting, and taint by position."""

from sieveflow.operators import calls
from sieveflow.sources import code, corpus


def test_segments():
    cut = lambda t: calls.segments(t, t.index("("))
    assert cut("f(a, g(b, c))") == (["a", "g(b, c)"], 12)
    assert cut("f()")[0] == [] and cut("f( )")[0] == [] and cut("f(a,)")[0] == ["a", ""]
    assert cut("f('a, (b', \"c\\\", d\", [1, {2: 3}])")[0] == ["'a, (b'", '"c\\", d"', "[1, {2: 3}]"]
    assert cut("f(x: Map<String, List<int>>, a < b, c > d)")[0] == ["x: Map<String, List<int>>", "a < b", "c > d"]
    assert cut("f(Vec::<u8, A>::new(), 1)")[0] == ["Vec::<u8, A>::new()", "1"]
    assert cut("f(a, b") == (["a", "b"], 6)


def test_names():
    assert calls.read_names("a + b.c * g(d, h(e)) - (i)") == (["a", "b", "i"], ["g"])
    assert calls.read_names("obj.run($x) . $y . 'z'") == (["$y"], ["obj.run"])
    for text, language, name in (("x: int = 3", "python", "x"), ("mut x: &str", "rust", "x"), ("String x", "java", "x"), ("x string", "go", "x"), ("?Foo $x = null", "php", "$x"), ("", "python", ""), ("x = a == b", "javascript", "x")):
        got = calls.parameter(text, language)
        assert got == name or language == "rust" and got == "x"


def found(spark, sources):
    files = corpus.from_strings(spark, sources)
    return calls.parts(files, code.ast_nodes(files))


def walk(spark, sources, function, variable):
    edges = calls.passes(found(spark, sources))
    got = calls.tainted_variables(edges, spark.createDataFrame([(function, variable)], "function string, variable string"))
    return {(r.function, r.variable) for r in got.collect()}


def test_taint_over_files_positions_and_returns(spark):
    src = {
        "a.py": "import b\ndef main(u, safe):\n    v = b.middle(safe, u)\n    other(v)\n    last(safe)\n",
        "b.py": "def middle(first, second):\n    return second\n\ndef other(w):\n    pass\n\ndef last(z):\n    pass\n",
    }
    assert walk(spark, src, "main", "u") == {("main", "u"), ("middle", "second"), ("middle", "@return"), ("main", "v"), ("other", "w")}
    assert walk(spark, src, "main", "safe") == {("main", "safe"), ("middle", "first"), ("last", "z")}


def test_nested_calls_pass_what_the_inner_one_returns(spark):
    src = {"a.js": "function id(x) { return x; }\nfunction none(x) { return 1; }\nfunction run(q) { }\nfunction walk(r) { }\nfunction main(t) {\n  run(id(t));\n  walk(none(t));\n}\n"}
    assert walk(spark, src, "main", "t") == {("main", "t"), ("id", "x"), ("id", "@return"), ("run", "q"), ("none", "x")}


def test_methods_skip_their_own_object(spark):
    src = {"a.py": "class A:\n    def m(self, x, y):\n        return y\n\ndef main(o, t):\n    é = o.m(1, t)\n    return é\n"}
    assert walk(spark, src, "main", "t") >= {("m", "y"), ("m", "@return")} and ("m", "x") not in walk(spark, src, "main", "t")


def test_nearest_function_around_a_call(spark):
    rows = found(spark, {"a.py": "def f():\n    def g():\n        a(1)\n    b(2, 3)\nc()\n"}).where("what = 'call'").collect()
    assert {(r.callee, r.function, r.position, r.text) for r in rows} == {("a", "g", 0, "1"), ("b", "f", 0, "2"), ("b", "f", 1, "3"), ("c", "@a.py", 0, None)}


def test_no_files(spark):
    assert found(spark, {"a.txt": "f(x)"}).collect() == []


def test_scopes():
    py = "x = 1\ndef f(a,\n      b):\n    y\n    def g():\n        z\n\n    w\nend = 2\n"
    s = calls.Scopes("p", "python", calls.Layout(py))
    assert [s.of(py.index(c)) for c in ("x", "y", "z", "w", "end")] == ["@p", "f", "g", "f", "@p"]
    js = "a();\nfunction f(x) { b(); function g() { c(); } d(); }\ne();"
    s = calls.Scopes("j", "javascript", calls.Layout(js))
    assert [s.of(js.index(f"{c}()")) for c in "abcde"] == ["@j", "f", "g", "f", "@j"]
    rb = "def f\n  a\nend\nb\n"
    s = calls.Scopes("r", "ruby", calls.Layout(rb))
    assert [s.of(rb.index("a\n")), s.of(rb.index("b\n"))] == ["f", "@r"]


def test_assignments_lead_on(spark):
    src = {"a.py": "def main(t):\n    a = t + 1\n    b = other\n    c = [a]\n    go(c)\n\ndef go(x):\n    y = x\n"}
    assert walk(spark, src, "main", "t") == {("main", "t"), ("main", "a"), ("main", "c"), ("go", "x"), ("go", "y")}
