"""What keeps the queries whole over large tables: no broadcast of a row a file, one parse a file, bounded pieces."""

import pandas as pd

from sieveflow.functions import scalar as S
from sieveflow.functions.batches import pieces
from sieveflow.operators import calls, graph, post, tree
from sieveflow.plans import catalogue
from sieveflow.sources import code, corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def python_files(spark):
    rows = spark.range(20).selectExpr("concat('f', id, '.py') file_path", "concat('def f', id, '(x):\\n    y = g(x)\\n    return y\\n') source")
    return corpus.files_of(rows.withColumn("file_type", corpus.detect_type("file_path")))


def test_tables_of_files_are_not_broadcast(spark):
    files = python_files(spark)
    found = files.selectExpr("file_path file", "1 line", "'x' id")
    for df in (tree.with_type(code.ast_nodes(files), files), post.without_suppressed(found, files), graph.call_edges(code.ast_nodes(files), corpus.lines(files))):
        assert "BroadcastHashJoin" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_control_flow_parses_once_and_broadcasts_nothing(spark, sf):
    nodes, edges = tree.control_flow(code.ast_nodes(python_files(spark)))
    assert "MapInPandas" not in plan(nodes) + plan(edges)
    assert "BroadcastHashJoin" not in plan(catalogue.queries()["cfg_successor"](spark, sf))


def test_calls_are_read_in_one_pass(spark):
    files = python_files(spark)
    assert plan(calls.parts(files, code.ast_nodes(files))).count("ArrowEvalPython") + plan(calls.parts(files, code.ast_nodes(files))).count("MapInPandas") == 2
    assert "MapInPandas" not in plan(calls.passes(calls.parts(files, code.ast_nodes(files))))


def test_pieces_are_whole_and_bounded():
    b = pd.DataFrame({"t": ["a" * n for n in (5, 5, 30, 1, 1, 1)] + [None], "k": range(7)})
    got = list(pieces(b, "t", rows=3, chars=10))
    assert [p.k.tolist() for p in got] == [[0, 1], [2], [3, 4, 5], [6]]
    assert [len(p) for p in pieces(b.iloc[:0], "t")] == [0]


def test_hours_of_three_digits(spark, tmp_path):
    """The function gives them all; the query has two, as its SQL does."""
    t = spark.createDataFrame([(k,) for k in (0, 359_999, 360_000, 1_199_999)], "p_partkey long")
    t.write.parquet(f"{tmp_path}/part.parquet")
    got = {r.k: r.took for r in catalogue.queries()["scalar_functions"](spark, str(tmp_path)).collect()}
    assert got == {0: "00:00:00", 359_999: "99:59:59", 360_000: "10:00:00", 1_199_999: "33:19:59"}
    assert {r[0] for r in t.select(S.duration("p_partkey")).collect()} == {"00:00:00", "99:59:59", "100:00:00", "333:19:59"}


def test_matches_of_long_lines_are_handed_on_in_parts(spark, monkeypatch):
    from sieveflow.operators import text
    from sieveflow.rules.model import Rule, Scan, TextRegexMulti

    monkeypatch.setattr(text, "HELD", 500)
    files = corpus.from_strings(spark, {f"f{k}.txt": "x" * 120 for k in range(4)})
    got = text.occurrence_rows(files, [(0, Rule("l", TextRegexMulti((Scan("x"),))))]).collect()
    assert {(r.file, r.column) for r in got} == {(f"f{k}.txt", c) for k in range(4) for c in range(1, 121)} and len(got) == 480


def test_dedup_leaves_excerpts_where_they_are(spark):
    """Of equal ids the least row stays, whole; without a wish for excerpts none is shuffled."""
    rows = [("a", 1, "f", 1, 1, "r", "HIGH", "x"), ("a", 0, "f", 1, 2, "r", "LOW", "y"), ("a", 0, "f", 1, 2, "r", "LOW", "b"), ("a", 0, "f", 1, 2, "r", "NONE", "a"), ("b", 0, "g", 1, 1, "r", None, None)]
    found = spark.createDataFrame(rows, "id string, ord int, file string, line int, column int, rule_id string, severity string, excerpt string")
    assert sorted(map(tuple, post.dedup(found).collect())) == [("a", 0, "f", 1, 2, "r", "LOW", "b"), ("b", 0, "g", 1, 1, "r", None, None)]
    assert "excerpt" not in plan(post.dedup(found).select("rule_id", "severity", "file", "line", "column")).split("Exchange")[0]


def test_findings_over_trees_and_lines_broadcast_rules_alone(spark, sf):
    for name, most in (("tree_query", 1), ("tree_pattern", 0), ("rule_dialects", 1)):
        assert plan(catalogue.queries()[name](spark, sf)).count("BroadcastHashJoin") <= most


def test_a_look_at_the_whole_text_finds_what_lines_give():
    import random

    from sieveflow.operators import literals, text
    from sieveflow.rules.model import Scan

    def by_lines(rx, t):
        at, out = 0, []
        for line in t.splitlines(keepends=True):
            out += [(at + m.start(), at + m.end()) for m in list(rx.finditer(line))[: text.LINE_MATCHES]]
            at += len(line)
        return out

    import regex

    draw, whole = random.Random(3), 0
    for rx in ("[(]a[0-9]+", r"(ab|b)\([^)]*\)", "a|ab", r"\ba+?b*", r"[^b]+", r"\sb", "x", r".a{2,3}"):
        assert literals.plain(rx)
        for _ in range(200):
            t = "".join(draw.choices("ab()0\n \x0b", (6, 6, 4, 4, 3, 3, 2, draw.random() < 0.1), k=draw.randrange(40))) + draw.choice(("", "x" * 1300, "\n"))
            got = [(at + m.start(), at + m.end()) for at, m in text.find_all(Scan(rx), t)]
            whole += text._over_lines(regex.compile(rx), t, text.Clock()) is not None
            assert got == by_lines(regex.compile(rx), t), (rx, t)
    assert whole > 500
    assert not any(map(literals.plain, ("^a", "a$", "(?=a)b", "a*", "(?>a)b", "a++b", r"(a)\1", r"a\Z", "(?:ab){e<=1}", "(?i)ab", "(")))


def test_texts_are_read_after_files_are_dealt_out(spark, sf):
    """No filter by what is in a text goes below the exchange that deals a small table's rows over the cores."""
    from sieveflow.plans import made

    files = made._supplier_files(spark, sf, "f{k}.txt", made.F.repeat(made.F.lit("x"), made.F.lit(9)))
    found = files.selectExpr("file_path file", "1 line", "'x' id")
    for df in (post.without_suppressed(found, files), corpus.lines(files)):
        for scan in plan(df).split("Exchange hashpartitioning(s_suppkey")[1:]:
            assert "size(" not in scan.split("FileScan")[0]


SOURCES = {
    "a.py": "import os\ndef f(x, y=1):\n    z = g(x, h(y))\n    return z\n\ndef g(a, b):\n    k == m(a)\n    return os.path.join(a, b)\ng(1, 2)\n",
    "b.js": "function a(x, y) {\n  const r = b(y, [x, 1]);\n  return c(r); }\r\nd(1)\n", "c.php": "<?php\nfunction p($x) {\n  $q = é . r($x, 's(1)');\n  return $q;\n}\n",
    "d.py": "def broken(", "e.txt": "f(1)", "f.py": "x = 1\n", "g.rb": "def f\n  g(1)\nend\n",
}


def test_calls_of_files_in_one_pass(spark):
    """The same rows as by trees and lines that are gathered and joined, without either."""
    files, rows = corpus.from_strings(spark, SOURCES), lambda df: sorted(map(str, df.collect()))
    assert rows(calls.parts_of(files)) == rows(calls.parts(files, code.ast_nodes(files)))
    assert rows(graph.calls_in(files)) == rows(graph.file_call_edges(code.ast_nodes(files), corpus.lines(files)))
    assert "Exchange" not in plan(calls.parts_of(files)) + plan(graph.calls_in(files))


def test_only_what_is_asked_of_a_file_is_made():
    for path, source in SOURCES.items():
        kind = {"py": "python", "js": "javascript", "php": "php", "rb": "ruby"}.get(path.split(".")[-1])
        if kind and path != "d.py":
            whole = code.parse(path, kind, source)
            nodes, tree_, flow = (code.parse(path, kind, source, want=(w,)) for w in code.PARTS)
            assert (nodes.nodes, tree_.tree, flow.flow, flow.edges, flow.symbols) == (whole.nodes, whole.tree, whole.flow, whole.edges, whole.symbols)
            assert not (nodes.tree or nodes.flow or tree_.flow or flow.tree)


def test_import_links_meet_modules_in_one_join(spark):
    """A module, a member of one, and what is no file of the project; files are parsed once for imports and once for symbols."""
    from sieveflow.sources import project, readers

    files = corpus.from_strings(spark, {"p/u.py": "safe = 1\n", "p/v.py": "t = 2\n", "m.py": "import p.v as w\nfrom p.u import safe\nfrom p.u import other as o\nimport os\n"})
    links = project.import_links(readers.nodes(files), project.modules(files), code.symbols(files))
    assert plan(links).count("SortMergeJoin") == 2
    assert sorted((tuple(r)[:4] for r in links.collect()), key=str) == [("m.py", "o", "p/u.py", "other"), ("m.py", "safe", "p/u.py", "safe"), ("m.py", "w", "p/v.py", None)]


def test_arrow_batches_are_cut_too():
    import pyarrow as pa
    from sieveflow.functions.batches import arrow_pieces

    b = pa.RecordBatch.from_pydict({"t": pa.array(["a" * n for n in (5, 5, 30, 1, 1, 1)] + [None], pa.string()), "k": list(range(7))})
    assert [p.column(1).to_pylist() for p in arrow_pieces(b, "t", rows=3, chars=10)] == [[0, 1], [2], [3, 4, 5], [6]]
    assert [p.num_rows for p in arrow_pieces(b.slice(0, 0), "t")] == [0]


def test_edges_of_a_walk_are_not_gathered(spark, sf, monkeypatch):
    """Edges are written as they come, each way in one pass; repeated ones and blocked nodes leave the walk as it is."""
    plans = {}
    kept = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, tag: kept(df, plans.setdefault(tag, plan(df)) and tag))
    for name in ("callgraph_reach", "taint_reach"):
        plans.clear()
        catalogue.queries()[name](spark, sf)
        assert "Aggregate" not in plans["links"] and "Join" not in plans["links"] and "Exchange" not in plans["links"]
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 4), (4, 4), (5, 3), (4, None)], "src long, dst long")
    walk = lambda edges, *blocked: sorted(map(str, graph.reach(edges, spark.createDataFrame([(1,), (1,)], "node long"), *blocked).collect()))
    stop = spark.createDataFrame([(3,), (3,)], "node int")
    assert walk(e, stop) == ["Row(node=1, depth=0)", "Row(node=2, depth=1)"] and walk(e, spark.createDataFrame([(1,)], "node int")) == []
    both = graph.undirected(e.where("dst is not null"))
    assert both.count() == 12 and walk(both) == walk(both.distinct()) == [f"Row(node={n}, depth={d})" for n, d in ((1, 0), (2, 1), (3, 2), (4, 3), (5, 3))]


def test_findings_are_dealt_once_and_without_ids(spark, sf):
    """What asks for places alone hands no ids, no rule columns and no excerpts on, and joins no lines where none is suppressed."""
    p = plan(catalogue.queries()["many_matches"](spark, sf))
    assert "sha2" not in p and "SortMergeJoin" not in p and "excerpt" not in p
    assert p.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(file" in p


def test_findings_told_apart_by_place_are_those_told_apart_by_id(spark):
    import random

    from sieveflow import engine
    from sieveflow.rules.model import Rule, RuleSet, TextRegex

    draw = random.Random(8)
    rules = RuleSet([Rule(i, TextRegex(i), s, f"m{k}", fix=f"x{k}") for k, (i, s) in enumerate((("a", "LOW"), ("b", "HIGH"), ("a", "HIGH"), ("c", "LOW"), ("b", "HIGH")))])
    rows = [(draw.randrange(5), draw.choice(["f", "g:1", None]), draw.randrange(1, 4), draw.randrange(1, 3), draw.choice(["x", "y", None]), draw.choice(["INFO", "HIGH", None])) for _ in range(300)]
    for columns in (6, 5):
        hits = spark.createDataFrame([r[:columns] for r in rows], "ord int, file string, line int, `column` int, excerpt string, severity string".rsplit(", ", 6 - columns)[0])
        want = post.dedup(post.findings_of(hits, rules))
        got = post.findings_of(post.firsts(hits, rules), rules)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Ids that a colon makes one are told apart by id.
    mixed = RuleSet([Rule("a", TextRegex("x")), Rule("a:b", TextRegex("x"))])
    assert post.firsts(hits, mixed) is None
    files = corpus.from_strings(spark, {"b:c": "x", "c": "x\n"})
    assert engine.analyze(files, mixed).count() == 3


def test_suppressed_lines_few_many_and_none(spark, monkeypatch):
    from sieveflow import engine
    from sieveflow.rules.model import Rule, RuleSet, TextRegex

    files = corpus.from_strings(spark, {"a": "x\nx # sast-ignore\nx", "b": "x", "c": "", "d": "x sast-ignore\r\nx\r\n"})
    rules = RuleSet([Rule("r", TextRegex("x"))])
    for most in (post.MARKS, 1):
        monkeypatch.setattr(post, "MARKS", most)
        out = engine.analyze(files, rules)
        assert ("SortMergeJoin" in plan(out)) == (most == 1)
        assert sorted((r.file, r.line) for r in out.collect()) == [("a", 1), ("a", 3), ("b", 1), ("d", 2)]
    assert {r.file_path: r.suppressed for r in files.collect()} == {"a": [2], "b": [], "c": [], "d": [1]}
    assert "Join" not in plan(post.without_suppressed(engine.raw_findings(files.where("file_path = 'b'"), rules).drop("rule_id"), files.where("file_path = 'b'"))).replace("BroadcastHashJoin [ord", "")


def test_tasks_that_tell_findings_apart_grow_with_what_is_known(spark, monkeypatch):
    from sieveflow import engine
    from sieveflow.rules.model import Rule, RuleSet, Scan, TextRegexMulti

    files = corpus.from_strings(spark, {f"f{k}": "x x x\nx" for k in range(30)})
    rules = RuleSet([Rule("r", TextRegexMulti((Scan("x"),)))])
    monkeypatch.setattr(post, "TASK_HITS", 20)
    out = engine.analyze(files, rules)
    assert "hashpartitioning(file" in plan(out) and ", 6), REPARTITION_BY_NUM" in plan(out) and out.count() == 120
    assert "REPARTITION_BY_COL" in plan(engine.analyze(files.where("file_path < 'f2'"), rules))
