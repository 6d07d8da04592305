import json
import sys

import pytest
from pyspark.sql import functions as F

from sieveflow import debug, engine, plugins
from sieveflow.rules.model import Rule, RuleSet, TextRegex
from sieveflow.sinks import report
from sieveflow.sources import corpus
from sieveflow.streaming import stream

RULES = RuleSet([Rule("a", TextRegex("foo"), "HIGH", "no foo", remediation="bar"), Rule("b", TextRegex("é"), "INFO", "m", fix="e")])
SRC = {"x.txt": "foo\nok é\n", "y.txt": "foo"}


@pytest.fixture(scope="module")
def findings(spark):
    return engine.analyze(corpus.from_strings(spark, SRC), RULES)


def test_reports(findings):
    d = json.loads(report.report(findings, "json"))
    assert d["total"] == 3 and [f["file"] for f in d["findings"]] == ["x.txt", "x.txt", "y.txt"]
    assert "fix" not in d["findings"][0] and d["findings"][1]["fix"] == "e" and d["findings"][0]["excerpt"] == "foo"
    s = json.loads(report.report(findings, "sarif"))
    r = s["runs"][0]["results"]
    assert s["version"] == "2.1.0" and [x["level"] for x in r] == ["error", "note", "error"]
    assert r[1]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "x.txt"}, "region": {"startLine": 2, "startColumn": 1}}
    t = report.report(findings, "text", {"files": 2})
    assert t.startswith("+") and "| files: 2 |" in t and t.endswith("Total: 3") and "  > ok é" in t
    with pytest.raises(ValueError):
        report.report(findings, "xml")


def test_reports_written_in_parts(findings, tmp_path):
    import glob

    def whole(found, fmt):
        folder = str(tmp_path / f"{fmt}-{found.count()}")
        report.write_report(found, folder, fmt)
        return json.loads("\n".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{folder}/*/part-*"))))

    for found in (findings, findings.limit(1), findings.limit(0)):
        assert whole(found, "json") == json.loads(report.report(found, "json"))
        assert whole(found, "sarif") == json.loads(report.report(found, "sarif"))
    with pytest.raises(ValueError):
        report.write_report(findings, str(tmp_path / "x"), "xml")


def test_metrics_and_errors(spark, findings, tmp_path):
    report.write_metrics(engine.metrics(findings, corpus.from_strings(spark, SRC)), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"files": 2, "findings": 3, "matched_rules": 2, "files_with_findings": 2}


def test_stream_is_batch(spark, findings, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, v in SRC.items():
        (folder / k).write_text(v)
    run = lambda: stream.analyze_stream(stream.file_stream(spark, str(folder)), RULES, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    got = stream.findings(spark, str(tmp_path / "out"))
    key = lambda df: sorted((r.rule_id, r.file.rsplit("/", 1)[-1], r.line) for r in df.collect())
    assert key(got) == key(findings)
    (folder / "z.txt").write_text("foo foo")
    run()
    assert len(key(stream.findings(spark, str(tmp_path / "out")))) == 4


def test_stateless_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("foo\nbar")
    hits = stream.line_hits_stream(stream.file_stream(spark, str(folder)), RULES)
    q = hits.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.line for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [1]


def test_event_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert stream.event_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_plugins_in_process(spark, findings):
    files = corpus.from_strings(spark, SRC)
    import base64

    def upper(f):
        text = base64.b64decode(f["content_b64"]).decode()
        return [{"path": f["path"], "content_b64": base64.b64encode(text.upper().encode()).decode(), "language": "generic"}]

    m = lambda name: plugins.Manifest.parse({"name": name, "capabilities": ["analyze"]})
    reg = plugins.Registry()
    reg.register(plugins.Plugin(m("up"), transform=upper))
    reg.register(plugins.Plugin(m("found"), discover=lambda p: {"files": [{"path": "n.py", "content_b64": base64.b64encode(b"x = 1").decode()}]}, analyze=lambda f: {"findings": [{"rule_id": "p", "line": 1, "column": 1, "severity": "low", "message": f["path"]}]}))
    assert sorted(r.source for r in plugins.transformed(files, reg.of("transform")[0]).collect()) == ["FOO", "FOO\nOK É\n"]
    both = plugins.discovered(files, reg.of("discover")[0])
    assert {r.file_type for r in both.collect()} == {"generic", "python"}
    got = plugins.analysed(files, reg.of("analyze")[0])
    assert {r.file for r in got.collect()} == set(SRC) and all(r.message.startswith("/virtual/") for r in got.collect())
    assert engine.analyze(files, RULES, plugin_findings=got).count() == 5
    reg.disable("found")
    assert reg.of("analyze") == []
    seen = []
    plugins.reported(findings, {}, [plugins.Plugin(m("r"), report=seen.append)])
    assert len(seen[0]["findings"]) == 3


def test_manifests():
    with pytest.raises(plugins.PluginError, match="not supported"):
        plugins.Manifest.parse({"name": "x", "api_version": "2.0"})
    with pytest.raises(plugins.PluginError, match="unknown"):
        plugins.Manifest.parse({"name": "x", "capabilities": ["fly"]})
    with pytest.raises(plugins.PluginError, match="required"):
        plugins.Manifest.parse({"name": "x", "config_schema": {"required": ["k"]}}).check({})


PROCESS = """
import json, sys
for line in sys.stdin:
    m = json.loads(line)
    print('{"jsonrpc": "2.0", "method": "plugin.log", "params": {}}')
    r = {"findings": [{"rule_id": "proc", "line": 7}]} if m["method"] == "file.analyze" else "ok"
    print(json.dumps({"jsonrpc": "2.0", "id": m["id"], "result": r}), flush=True)
"""


def test_plugin_process(spark, tmp_path):
    (tmp_path / "p.py").write_text(PROCESS)
    m = plugins.Manifest.parse({"name": "proc", "entry": [sys.executable, str(tmp_path / "p.py")], "capabilities": ["analyze"]})
    got = plugins.analysed(corpus.from_strings(spark, SRC), plugins.Plugin(m)).collect()
    assert [(r.rule_id, r.line) for r in got] == [("proc", 7)] * 2
    slow = plugins.Manifest.parse({"name": "slow", "entry": [sys.executable, "-c", "import time; time.sleep(60)"], "timeout_ms": 200})
    with pytest.raises(plugins.PluginError, match="took more"):
        plugins.Process(slow)


def test_debug(spark):
    f = corpus.from_strings(spark, {"a.py": "def f():\n    x = input()\n    eval(x)\n"})
    assert "FunctionDefinition f" in debug.ir(f).first().text
    assert debug.ir(f, "ast", "dot").first().text.startswith("digraph {")
    assert debug.ir(f, "ssa", "mermaid").first().text.startswith("graph TD")
    assert json.loads(debug.ir(f, "cfg", "json").first().text)["nodes"]
    assert '"f"' in debug.ir(f, "callgraph", "dot").first().text
    assert {(r.source, r.sink, r.severity) for r in debug.likely_taint(f).collect()} == {("input", "eval", "HIGH")}
    t = debug.Timeline()
    t.add("parsing", "a"), t.add("matching", "b"), t.add("parsing", "c")
    assert [(r.stage, r.n) for r in debug.stage_summary(t.frame(spark)).collect()] == [("parsing", 2), ("matching", 1)]
    assert "TextRegex" in debug.rule_text(RULES.rules[0])
