import json

from sieveflow import cli


def test_scan(spark, tmp_path, capsys):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "r.yaml").write_text("rules:\n- {id: os, pattern: os.system($X), languages: [python], severity: HIGH, message: m}\n")
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("import os\nos.system(x)\nos.system(y)  # sast-ignore\n")
    (tmp_path / "src" / "b.py").write_text("os.system(z)\n")
    (tmp_path / "src" / "node_modules" / "c.py").write_text("os.system(z)\n")
    (tmp_path / "src" / ".gitignore").write_text("b.py\n")
    base = ["scan", str(tmp_path / "src"), "--rules", str(tmp_path / "rules"), "--format", "json"]
    assert cli.main([*base, "--fail-on", "high", "--write-baseline", str(tmp_path / "base.json")], spark) == 1
    got = json.loads(capsys.readouterr().out)
    assert [(f["rule_id"], f["line"]) for f in got["findings"]] == [("os", 2)]
    assert cli.main([*base, "--fail-on", "critical"], spark) == 0
    capsys.readouterr()
    assert cli.main([*base, "--baseline", str(tmp_path / "base.json"), "--metrics", "-"], spark) == 0
    assert json.loads(capsys.readouterr().out)["total"] == 0


def test_stream_times_and_timeouts(spark, tmp_path, capsys):
    (tmp_path / "r.yaml").write_text("rules:\n- {id: os, pattern: os.system($X), languages: [python], severity: HIGH, message: m}\n")
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("import os\nos.system(x)\n")
    (tmp_path / "src" / "node_modules" / "c.py").write_text("os.system(z)\n")
    base = ["scan", str(tmp_path / "src"), "--rules", str(tmp_path / "r.yaml"), "--format", "json", "--rule-timeout", "2000"]
    streamed = [*base, "--stream", str(tmp_path / "state")]
    lines = lambda: [(f["file"].rsplit("/", 1)[-1], f["line"]) for f in json.loads(capsys.readouterr().out)["findings"]]
    assert cli.main(streamed, spark) == 0 and lines() == [("a.py", 2)]
    (tmp_path / "src" / "b.py").write_text("\n\nos.system(z)\n")
    assert cli.main([*streamed, "--fail-on", "high"], spark) == 1 and lines() == [("b.py", 3)]
    assert cli.main([*base, "--times", str(tmp_path / "t.json")], spark) == 0 and lines() == [("a.py", 2), ("b.py", 3)]
    spent = json.loads((tmp_path / "t.json").read_text())
    assert [r["matches"] for r in spent["rule_id"]] == [2] and len(spent["file"]) == 2


def test_rules_commands(tmp_path, capsys):
    (tmp_path / "r.yaml").write_text("id: a\npattern: x\n")
    assert cli.main(["verify", str(tmp_path)]) == 0 and cli.main(["inspect", str(tmp_path)]) == 0
    assert "rule a [MEDIUM]" in capsys.readouterr().out
    (tmp_path / "bad.yaml").write_text("id: b\nseverity: x\npattern: y\n")
    assert cli.main(["verify", str(tmp_path)]) == 1
