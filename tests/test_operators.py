import random

import pytest
from pyspark.sql import functions as F

from sieveflow.operators.layout import Layout
from sieveflow.operators import graph, policy, post, text, tree
from sieveflow.rules.model import AstPattern, AstQuery, JsonPathEq, JsonPathRegex, MetaVariable, Policy, Rule, RuleSet, Scan, Taint, TaintPattern, TextRegex, TextRegexMulti
from sieveflow import engine
from sieveflow.sources import code, corpus


def found(spark, sources, *rules, **options):
    files = corpus.from_strings(spark, sources)
    return sorted((r.rule_id, r.file, r.line, r.column) for r in engine.analyze(files, RuleSet(list(rules)), **options).collect())


def test_lines_and_languages(spark):
    a = Rule("a", TextRegex("foo"), languages=("python",))
    b = Rule("b", TextRegex("o$"))
    assert found(spark, {"x.py": "foo\nbar\nfoo!", "y.rs": "foo\r\n"}, a, b) == [("a", "x.py", 1, 1), ("a", "x.py", 3, 1), ("b", "x.py", 1, 1), ("b", "y.rs", 1, 1)]


def test_context(spark):
    m = TextRegexMulti((Scan(r"foo\(\)"),), None, (Scan(r"bar\([^)]*\)\)"),), (Scan(r"baz\([^)]*\)"),))
    assert found(spark, {"f": "bar(foo())\nfoo()\nbaz(foo())\n"}, Rule("c", m)) == [("c", "f", 1, 5)]
    assert found(spark, {"f": "é foo()\n"}, Rule("c", m)) == []
    plain = TextRegexMulti((Scan(r"fo+"),), Scan("fooo"))
    assert found(spark, {"f": "é foo fooo\n"}, Rule("c", plain)) == [("c", "f", 1, 4)]
    block = TextRegexMulti((Scan("hit"),), None, (), (Scan("safe"),))
    assert found(spark, {"f": "safe {\n hit }\nf {\n hit }"}, Rule("c", block)) == [("c", "f", 4, 2)]
    assert Layout("a {\n b { c } d").enclosing_block(12) == "a {\n b { c } d"
    source = TextRegexMulti((Scan(r"a\s+b", "source"),))
    assert found(spark, {"f": "x a\nb"}, Rule("c", source)) == [("c", "f", 1, 3)]


def test_json_paths(spark):
    src = {"a.yaml": "spec:\n  user: {root: false, n: 1}\n", "b.json": '{"image": "x:latest", "n": "1"}'}
    assert found(spark, src, Rule("e", JsonPathEq("spec.*.root", "false"))) == [("e", "a.yaml", 2, 16)]
    assert found(spark, src, Rule("e", JsonPathEq("spec.user.root", "true"))) == []
    assert found(spark, src, Rule("n", JsonPathEq("*n", "1"))) == [("n", "a.yaml", 2, 26)]
    assert found(spark, src, Rule("r", JsonPathRegex("image", ":latest$"))) == [("r", "b.json", 1, 1)]
    assert found(spark, src, Rule("r", JsonPathRegex("*n", "1"))) == [("r", "b.json", 1, 1)]


def test_trees(spark):
    p = Rule("p", AstPattern("Call", "FunctionDefinition", (MetaVariable("Call", "eval"), MetaVariable("Identifier"))), languages=("python",))
    assert [f[2] for f in found(spark, {"a.py": "def foo(x):\n    eval(x)\n"}, p)] == [2]
    assert found(spark, {"a.py": 'eval("1+1")\n', "b.py": "def foo(x):\n    print(x)\n"}, p) == []
    q = Rule("q", AstQuery("^Call", "^system$"))
    assert found(spark, {"a.py": "system('x')\n", "b.go": "func f() { system(1) }"}, q) == [("q", "a.py", 1, 1), ("q", "b.go", 1, 12)]


def test_intervals_against_brute_force(spark):
    rng = random.Random(2)
    nodes = []

    def grow(depth, lo):
        at = lo
        nodes.append([at, at, rng.choice("ab")])
        me = len(nodes) - 1
        for _ in range(rng.randint(0, 3) if depth < 5 else 0):
            at = grow(depth + 1, at + 1)
        nodes[me][1] = at
        return at

    grow(0, 0)
    df = spark.createDataFrame([("f", *n) for n in nodes], "file_path string, lo int, hi int, kind string")
    got = {r.lo for r in tree.within(df, df.where("kind = 'a'")).collect()}
    assert got == {n[0] for n in nodes if any(a[2] == "a" and a[0] < n[0] and a[1] >= n[1] for a in nodes)}
    got = {r.lo for r in tree.holding(df, df.where("kind = 'b'"), "left_anti").collect()}
    assert got == {n[0] for n in nodes if not any(b[2] == "b" and n[0] <= b[0] and n[1] >= b[1] for b in nodes)}


def test_covered_and_holding_against_all_pairs(spark):
    """Any intervals, nested or not; repeated rows stay."""
    rng = random.Random(8)
    rows = [(k, a := rng.randrange(30), a + rng.randrange(1, 12), i % 90) for i, k in enumerate(rng.choice("xyz") for _ in range(200))]
    ranges = [(k, a := rng.randrange(30), a + rng.randrange(1, 15)) for k in (rng.choice("xyw") for _ in range(25))]
    df, rf = spark.createDataFrame(rows, "id string, start int, end int, n int"), spark.createDataFrame(ranges, "id string, start int, end int")
    got = lambda d: sorted(tuple(r) for r in d.collect())
    inside = lambda r, strict: any(k == r[0] and (a < r[1] if strict else a <= r[1]) and b >= r[2] for k, a, b in ranges)
    holds = lambda r: any(k == r[0] and r[1] <= a and b <= r[2] for k, a, b in ranges)
    for strict in (False, True):
        for keep in (False, True):
            assert got(text.covered(df, rf, "id", ("start", "end"), strict, keep)) == sorted(r for r in rows if inside(r, strict) == keep)
            assert got(text.holding(df, rf, "id", ("start", "end"), keep)) == sorted(r for r in rows if holds(r) == keep)
    assert got(text.contained(df, rf)) == sorted(r for r in rows if inside(r, False))
    # No pairs are made: neither joins nor products are in the plan.
    assert "Join" not in text.contained(df, rf)._jdf.queryExecution().optimizedPlan().toString()


def test_routes(spark):
    f = corpus.from_strings(spark, {"a.js": "function h(req, res) { res.send(req.query.id) }", "b.js": "function h(req, res) { res.send(sanitize(req.query.id)) }", "c.py": "def f(request):\n    return request.args\n"})
    assert {r.file_path for r in tree.unsanitised_routes(tree.with_type(code.ast_nodes(f), f)).collect()} == {"a.js", "c.py"}
    n, e = tree.control_flow(code.ast_nodes(corpus.from_strings(spark, {"a.py": "f()\ng()\nh()\n"})))
    assert n.count() == 3 and e.count() == 2


TAINT = Taint((TaintPattern((Scan(r"\$_GET\b", "source"), Scan(r"source\(\)"), Scan(r"input\(\)"))),), (TaintPattern((Scan(r"echo [^;]*"), Scan(r"sink\([^)]*\)"), Scan(r"subprocess\.run\([^)]*\)"))),), (TaintPattern((Scan(r"clean\(([a-z]+)\)"),), (1,)),))


def test_taint(spark):
    r = Rule("t", TAINT)
    assert found(spark, {"a.py": "import subprocess\nuser = input()\nsubprocess.run(user)\n"}, r) == [("t", "a.py", 3, 1)]
    assert found(spark, {"a.py": "import subprocess\nuser = input()\nuser = clean(user)\nsubprocess.run(user)\n"}, r) == []
    assert found(spark, {"a.php": "<?php\n$name = $_GET['name'];\necho $name;\n"}, r) == [("t", "a.php", 3, 1)]
    assert found(spark, {"a.php": "<?php\n$name = htmlspecialchars($_GET['name']);\necho $name;\n"}, r) == []
    assert found(spark, {"a.rs": "fn main() {\n let user = source();\n sink(user);\n}\n"}, r) == [("t", "a.rs", 3, 2)]
    assert found(spark, {"a.rs": "fn main() {\n let user = sanitize(source());\n sink(user);\n}\n"}, r) == []


def test_policies(spark):
    policy.register("root", lambda f: [{"result": [{"msg": n["path"], "line": n["line"]} for n in f["nodes"] if n["value"] == "root"]}])
    policy.register_table("ports", lambda n: n.where("path like '%port'").selectExpr("file_path", "line", "1 as column", "'port' as message"))
    src = {"a.yaml": "user: root\nport: 1\n"}
    assert found(spark, src, Rule("p", Policy("root")), Rule("q", Policy("ports"))) == [("p", "a.yaml", 1, 0), ("q", "a.yaml", 2, 1)]
    assert policy.denials({"a": True, "b": False}) == [("a", 0, 0)] and policy.denials(["x", {"message": "m", "line": 2}]) == [("x", 0, 0), ("m", 2, 0)]
    with pytest.raises(KeyError):
        found(spark, src, Rule("n", Policy("nowhere")))


def test_aliases(spark):
    r = Rule("s", TextRegex(r"(?s).*os\.system\(.*", "os.system"), languages=("python",))
    assert found(spark, {"a.py": "import os as o\no.system('x')\n", "b.py": "import os\nos.system('x')\n"}, r, aliases=True) == [("s", "a.py", 2, 1), ("s", "b.py", 2, 1)]


def test_baseline_suppression_dedup_cache(spark, tmp_path):
    r = Rule("a", TextRegex("foo"), "HIGH", fix="bar(...)")
    src = {"x": "foo(1)\nfoo(2) sast-ignore\n", "y": "foo(3)\n"}
    files = corpus.from_strings(spark, src)
    rules = RuleSet([r, r])
    first = engine.analyze(files, rules)
    assert sorted((f.file, f.line) for f in first.collect()) == [("x", 1), ("y", 1)]
    assert engine.analyze(files, rules, suppress=False).count() == 3
    post.write_baseline(first.where("file = 'x'"), str(tmp_path / "base"))
    assert [f.file for f in engine.analyze(files, rules, baseline=post.read_baseline(spark, str(tmp_path / "base"))).collect()] == ["y"]
    assert post.fails_on(first, "high") and not post.fails_on(first, "critical") and post.fails_on(first.limit(0), "low") and not post.fails_on(first.limit(0), "low", strict_empty=False)
    cache = str(tmp_path / "cache")
    key = lambda df: sorted(map(str, df.select("id", "file", "line").collect()))
    for _ in range(2):
        assert key(engine.analyze(files, rules, cache=cache)) == key(first)
    assert spark.read.parquet(f"{cache}/entries").count() == 2
    changed = corpus.from_strings(spark, {**src, "y": "none\n"})
    assert [f.file for f in engine.analyze(changed, rules, cache=cache).collect()] == ["x"]
    assert engine.metrics(first, files).first().files == 2


def test_fixes(spark):
    assert post.fix_source("a = f(x)\nb = f(y)\n", [{"line": 1, "column": 5, "excerpt": "f(x)", "fix": "g(...)"}, {"line": 2, "column": 5, "excerpt": "f(y)", "fix": "h"}, {"line": 1, "column": 1, "excerpt": "zz", "fix": "q"}]) == ("a = g(x)\nb = h\n", 2, 1)
    # Columns count bytes.
    assert post.fix_source("é日 = f(x)", [{"line": 1, "column": 9, "excerpt": "f(x)", "fix": "g"}]) == ("é日 = g", 1, 0)
    files = corpus.from_strings(spark, {"a": "foo(1)"})
    got = post.apply_fixes(files, engine.analyze(files, RuleSet([Rule("a", TextRegex("foo"), fix="bar(...)")])))
    assert got.first().fixed == "bar(1)"


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in graph.reach(e, start).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r.node for r in graph.reach(e, start, spark.createDataFrame([(3,)], "node long")).collect()} == {1, 2}
    assert {r.node for r in graph.propagate(e, spark.createDataFrame([(8,)], "node long")).collect()} == {8, 9}
    c = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "name string, alias_of string")
    assert {(r.name, r.root) for r in graph.resolve_aliases(c).collect()} == {("a", "c"), ("b", "c"), ("x", "x"), ("y", "x"), ("z", "x")}
    calls = spark.createDataFrame([("main", "f"), ("f", "g"), ("g", "f"), ("g", "h")], "src string, dst string")
    got = {r.name: r for r in graph.call_graph_analysis(calls).collect()}
    assert got["main"].entry and got["h"].leaf and got["h"].depth == 3 and got["f"].in_cycle and got["g"].in_cycle and not got["h"].in_cycle
    assert graph.complexity(graph.call_graph_analysis(calls)).first().edges == 4
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    assert graph.has_flow(calls, one("h"), one("main")) and not graph.has_flow(calls, one("h"), one("elsewhere"))
    f = corpus.from_strings(spark, {"a.py": "def f(x):\n    y = g(x)\n    return y\ndef g(z):\n    return z\n"})
    assert {(r.src, r.dst) for r in graph.call_edges(code.ast_nodes(f), corpus.lines(f)).collect()} == {("f", "g")}


def test_paths_of_one_file():
    n = [{"id": i, "name": c, "kind": k} for i, (c, k) in enumerate([("a", "Def"), ("b", "Def"), ("c", "Use"), ("d", "Def"), ("e", "Use")])]
    assert graph.taint_path(n, [(0, 1), (1, 2)], set()) == [0, 1, 2]
    assert graph.taint_path(n, [(0, 1), (1, 2)], {"b"}) is None and graph.taint_path(n, [(3, 99)], {"a"}) is None
    assert graph.reaches_any(n, [(0, 1), (1, 2)], 0, {"c"}) and not graph.reaches_any(n, [(0, 1)], 0, {"c"})


def test_symbols_and_merges(spark):
    s = spark.createDataFrame([("f", "a", True, 1, None), ("f", "b", False, 2, "a"), ("f", "c", False, 3, "b"), ("g", "b", False, 4, "a")], "file_path string, name string, sanitized boolean, def long, alias_of string")
    assert {(r.file_path, r.name, r.sanitized) for r in graph.sanitise_aliases(s).collect()} == {("f", "a", True), ("f", "b", True), ("f", "c", True), ("g", "b", False)}
    st = spark.createDataFrame([(1, "x", 0, True, 5), (1, "x", 1, True, 6), (1, "y", 0, True, 7)], "k int, name string, branch int, sanitized boolean, def long")
    got = {r.name: r for r in graph.branch_merge(st, spark.createDataFrame([(1, 2)], "k int, n_branches int"), ["k"]).collect()}
    assert got["x"].sanitized and got["x"].merged and not got["y"].sanitized


def test_spans_frame(spark):
    import re

    texts = ["ab12c345", "12", "", "x", "é99日1 88"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = sorted((r.id, r.start, r.end) for r in text.spans_frame(df, "id", "t", "[0-9]{2,}").collect())
    assert got == [(i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer("[0-9]{2,}", t)]


def test_baselines_hold_many_findings(spark, tmp_path):
    import json

    files = corpus.from_strings(spark, {"x": "foo\n" * 10})
    found = engine.analyze(files, RuleSet([Rule("a", TextRegex("foo"))]))
    post.write_baseline(found.coalesce(1), str(tmp_path / "lines"))
    (tmp_path / "array").write_text(json.dumps([r.asDict() for r in found.select("id", "file", "line").collect()], indent=2))
    for name in ("lines", "array"):
        known = post.read_baseline(spark, str(tmp_path / name))
        assert known.count() == 10 and post.without_baseline(found, known).isEmpty()


def test_cycles_against_brute_force(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("s", "t")], "src string, dst string")
    got = {r.name: r.in_cycle for r in graph.call_graph_analysis(calls).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": True, "s": True, "t": False}
    rng = random.Random(4)
    edges = {(rng.randrange(24), rng.randrange(24)) for _ in range(34)}
    ahead = {n: {b for a, b in edges if a == n} for n in range(24)}

    def reached(n):
        seen, todo = set(), list(ahead[n])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += ahead[x]
        return seen

    want = {n: min(m for m in reached(n) if n in reached(m)) for n in range(24) if n in reached(n)}
    assert {r.node: r.component for r in graph.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()} == want


def test_long_chains_are_walked_to_their_end(spark):
    chain = spark.range(40).selectExpr("id as src", "id + 1 as dst")
    assert graph.reach(chain, spark.range(1).selectExpr("id as node")).agg(F.max("depth"), F.count("*")).first()[:] == (40, 41)
    start = spark.createDataFrame([(1, 30), (2, 38)], "k int, node long")
    assert {(r.k, r.node) for r in graph.reach(chain, start, key=("k",)).collect()} == {(1, n) for n in range(30, 41)} | {(2, n) for n in range(38, 41)}


def test_rules_that_take_too_long_or_fail_are_told(spark, monkeypatch):
    files = corpus.from_strings(spark, {"slow": "x" * 4000, "fast": "xxy"})
    slow = (0, Rule("slow", TextRegexMulti((Scan("(x+x+)+y", "source"),))))
    rows = text.occurrence_rows(files, [slow, (1, Rule("ok", TextRegexMulti((Scan("xx"),))))], seconds=0.3).collect()
    assert {(r.ord, r.file) for r in rows if r.error} == {(0, "slow")} and {(r.ord, r.file) for r in rows if not r.error} == {(0, "fast"), (1, "slow"), (1, "fast")}

    def breaks(f):
        if f["file_path"] == "fast":
            raise ValueError("broken")
        return ["no"]

    policy.register("breaks", breaks)
    failed, rules = [], RuleSet([Rule("p", Policy("breaks"))])
    assert [r.file for r in engine.analyze(files, rules, failed=failed).collect()] == ["slow"]
    assert [(r.rule_id, r.file, r.error) for r in engine.rule_errors(failed, rules).collect()] == [("p", "fast", "ValueError: broken")]


def test_files_tell_whether_they_parse(spark, tmp_path):
    (tmp_path / "a.py").write_text("def")
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    got = {r.file_path.rsplit("/", 1)[-1]: r.parse_status for r in corpus.load_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "error: SyntaxError", "b.json": "error: JSONDecodeError", "c.json": "ok", "d.txt": "error: UnicodeError"}
    # Plans that don't ask for it don't parse for it.
    assert "ArrowEvalPython" not in corpus.lines(corpus.load_corpus(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()


def test_one_parse_for_all_tree_patterns(spark):
    files = corpus.from_strings(spark, {"a.py": "def foo(x):\n    eval(x)\n"})
    rules = RuleSet([Rule(f"p{k}", AstPattern("Call", "FunctionDefinition", (MetaVariable("Call", "eval"),))) for k in range(5)])
    assert "MapInPandas" not in engine.raw_findings(files, rules)._jdf.queryExecution().executedPlan().toString()
    assert engine.analyze(files, rules).count() == 5


def test_tree_queries_look_at_all_nodes_of_a_file(spark):
    """The call after more than 10,000 nodes is found as the one before them is."""
    sources = {"a.py": "system(0)\n" + "f(1)\n" * 6000 + "system(2)\n", "b.js": "system(0);\n" + "f(x);\n" * 6000 + "system(2);\n"}
    nodes = {r.file_path: r.n for r in code.ast_nodes(corpus.from_strings(spark, sources)).groupBy("file_path").agg(F.max("lo").alias("n")).collect()}
    assert min(nodes.values()) > 10_000
    assert found(spark, sources, Rule("q", AstQuery("^(Call|CallExpression)$", "^system$"))) == [("q", f, n, 1) for f in sources for n in (1, 6002)]


def test_rule_times(spark):
    files = corpus.from_strings(spark, {"x": "foo\nfoo", "y.py": "foo(bar)"})
    rules = RuleSet([Rule("a", TextRegex("foo")), Rule("b", TextRegex("z"), languages=("python",)), Rule("c", TextRegexMulti((Scan("o+"),))), Rule("q", AstQuery("Call"))])
    spent = engine.rule_times(files, rules)
    assert {(r.rule_id, r.file): r.matches for r in spent.collect()} == {("a", "x"): 2, ("a", "y.py"): 1, ("b", "y.py"): 0, ("c", "x"): 2, ("c", "y.py"): 1}
    assert {r.rule_id: r.matches for r in engine.times_by(spent).collect()} == {"a": 3, "b": 0, "c": 3}
    assert all(r.seconds >= 0 for r in engine.times_by(spent, "file").collect())
