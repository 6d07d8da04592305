"""What is kept between runs and batches: findings told once, calls of all files, nothing of failures."""

from sieveflow import engine
from sieveflow.operators import graph, policy
from sieveflow.rules.model import Policy, Rule, RuleSet, Scan, Taint, TaintPattern, TextRegex
from sieveflow.sources import corpus
from sieveflow.streaming import stream

FLOW = Rule(
    "flow", Taint((TaintPattern((Scan(r"input\(\)"),)),), (TaintPattern((Scan(r"subprocess\.run\(\w+\)"),)),)), "HIGH", languages=("python",), sources=("one",), sinks=("subprocess.run",),
)
FILES = {"a.py": "def one():\n    two(1)\n", "b.py": "import subprocess\ndef two(x):\n    y = input()\n    subprocess.run(y)\n"}


def key(df):
    return sorted((r.rule_id, r.file.rsplit("/", 1)[-1], r.line) for r in df.collect())


def test_cached_findings_are_those_without_a_cache(spark, tmp_path):
    rules, cache = RuleSet([FLOW, Rule("t", TextRegex("input"))]), str(tmp_path / "cache")
    every = corpus.from_strings(spark, FILES)
    whole = key(engine.analyze(every, rules))
    assert whole == [("flow", "b.py", 4), ("t", "b.py", 3)]
    # Neither file alone joins the names; the second run parses the second file only.
    assert key(engine.analyze(every.where("file_path = 'a.py'"), rules, cache=cache)) == []
    assert key(engine.analyze(every, rules, cache=cache)) == whole
    assert key(engine.analyze(every, rules, cache=cache)) == whole
    # The caller is gone: what is kept of it doesn't count any more.
    assert key(engine.analyze(every.where("file_path = 'b.py'"), rules, cache=cache)) == [("t", "b.py", 3)]
    assert key(engine.analyze(corpus.from_strings(spark, {**FILES, "a.py": "def one():\n    three(1)\n"}), rules, cache=cache)) == [("t", "b.py", 3)]


def test_files_that_failed_are_tried_again(spark, tmp_path):
    flag, cache = tmp_path / "broken", str(tmp_path / "cache")

    def sometimes(f, flag=str(flag)):
        import os

        if f["file_path"] == "y" and os.path.exists(flag):
            raise ValueError("broken")
        return ["no"]

    policy.register("sometimes", sometimes)
    rules = RuleSet([Rule("p", Policy("sometimes")), Rule("t", TextRegex("foo"))])
    files = corpus.from_strings(spark, {"x": "foo", "y": "foo"})
    flag.write_text("")
    failed = []
    first = key(engine.analyze(files, rules, cache=cache, failed=failed))
    assert first == [("p", "x", 0), ("t", "x", 1), ("t", "y", 1)]
    assert [(r.rule_id, r.file) for r in engine.rule_errors(failed, rules).collect()] == [("p", "y")]
    assert {r.file for r in spark.read.parquet(f"{cache}/entries").collect()} == {"x"}
    flag.unlink()
    for _ in range(2):
        assert key(engine.analyze(files, rules, cache=cache)) == [("p", "x", 0), ("p", "y", 0), ("t", "x", 1), ("t", "y", 1)]


def run(spark, folder, rules, tmp_path):
    stream.analyze_stream(stream.file_stream(spark, str(folder), files_a_batch=1), rules, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_an_output_folder_has_each_finding_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rules = RuleSet([Rule("t", TextRegex("foo")), Rule("t", TextRegex("fo+"))])
    for name, text in (("a.txt", "foo\nfoo"), ("b.txt", "foo")):
        (folder / name).write_text(text)
    assert key(run(spark, folder, rules, tmp_path)) == [("t", "a.txt", 1), ("t", "a.txt", 2), ("t", "b.txt", 1)]
    # A file that comes again, under a new time, in a query started anew.
    (folder / "c.txt").write_text("foo")
    (folder / "a.txt").unlink()
    (folder / "a.txt").write_text("foo\nfoo\nfoo")
    import os

    os.utime(folder / "a.txt", (2_000_000_000, 2_000_000_000))
    got = run(spark, folder, rules, tmp_path)
    assert got.count() == got.select("id").distinct().count()
    assert {("t", "c.txt", 1)} < set(key(got))
    assert key(run(spark, folder, rules, tmp_path)) == key(got) == key(stream.findings(spark, str(tmp_path / "out")))


def test_names_that_meet_over_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rules = RuleSet([FLOW])
    (folder / "b.py").write_text(FILES["b.py"])
    assert key(run(spark, folder, rules, tmp_path)) == []
    (folder / "c.py").write_text("def three():\n    four()\n")
    assert key(run(spark, folder, rules, tmp_path)) == []
    (folder / "a.py").write_text(FILES["a.py"])
    assert key(run(spark, folder, rules, tmp_path)) == [("flow", "b.py", 4)]
    (folder / "d.py").write_text("import subprocess\ndef five():\n    y = input()\n    subprocess.run(y)\n")
    assert key(run(spark, folder, rules, tmp_path)) == [("flow", "b.py", 4), ("flow", "d.py", 4)]


def test_walks_that_go_on(spark):
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    old, new = [(1, 2), (5, 6), (6, 7), (9, 1)], [(2, 5), (8, 9)]
    start = spark.createDataFrame([(0, 1)], "k int, node long")
    seen = graph.reach(frame(old), start, key=("k",)).select("k", "node")
    grown = graph.grow(seen, frame(old + new), frame(new), ("k",))
    assert sorted((r.k, r.node) for r in grown.collect()) == [(0, n) for n in (1, 2, 5, 6, 7)]


def test_settings_come_back(spark):
    from sieveflow.functions.durable import settings

    before = spark.conf.get("spark.sql.shuffle.partitions")
    with settings(spark, spark__sql__shuffle__partitions="3", spark__own__setting="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.own.setting", None) is None
