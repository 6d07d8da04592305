import json
import re

import pytest

from sieveflow.rules import load as L
from sieveflow.rules import pattern as P
from sieveflow.rules.model import AstPattern, AstQuery, JsonPathEq, JsonPathRegex, RuleSet, Taint, TextRegex, TextRegexMulti


def matches(pattern, text, **variables):
    import regex

    return bool(regex.search(P.exact(pattern, variables).regex, text))


def test_patterns():
    assert matches("foo($X)", "foo(123)", X=r"^\d+$") and not matches("foo($X)", "foo(bar)", X=r"^\d+$")
    assert matches("print($X)", "print(input('name'))", X=P.translate("input(...)").regex)
    assert matches("f(..., $X)", "f(1)") and matches("f(..., $X)", "f(1, 2, 3)") and matches("f(a, ...)", "f(a)") and matches("f(a, ...)", "f(a, b)")
    assert matches("a = $B", "a   =  1") and P.translate("$_GET").regex == re.escape("$_GET")
    assert matches('$X =~/ab+/', 'x =~ "abb"')
    assert P.only_looks_around("(?=a(b)c)") and not P.only_looks_around("(?=a)b")
    assert P.exact("f($A, $B)").groups == {"A": 1, "B": 2} and P.groups_in(r"(a)(?:b)[(](?<n>c)\(") == 2


def test_native_and_json():
    rules = L.yaml_rules("id: a\nast_query: {kind: '^Call$', value: 'println!'}\nast-pattern:\n  kind: Call\n  within: FunctionDefinition\n  metavariables:\n    X: {kind: Call, value: eval}\ndescription: d\n")
    assert [type(r.matcher) for r in rules] == [AstQuery, AstPattern] and rules[0].severity == "MEDIUM" and rules[0].message == "d" and rules[0].category == "general"
    doc = {"rules": {"k8s": {"root": {"severity": "high", "query": {"type": "yaml", "path": "a.b", "value": False}}, "tag": {"query": {"path": "$.services[*].image", "pattern": ":latest$"}}}}}
    rules = L.json_rules(doc)
    assert [(r.id, type(r.matcher), r.languages) for r in rules] == [("k8s.root", JsonPathEq, ("yaml",)), ("k8s.tag", JsonPathRegex, ("generic",))]
    assert rules[0].matcher.value_json == "false"


def test_code_pattern_dialect():
    text = """
rules:
- {id: p, pattern: os.system($X), languages: [Python], severity: ERROR}
- {id: r, pattern-regex: 'xoxb-[0-9]+', severity: WARNING}
- id: m
  patterns:
    - pattern: foo($X)
    - pattern-inside: bar(...)
    - pattern-not: foo(1)
    - metavariable-regex: {metavariable: $X, regex: '^\\d+$'}
- id: t
  mode: taint
  pattern-sources: [{pattern: source()}]
  pattern-sinks: [{patterns: [{pattern: sink($A)}, {focus-metavariable: $A}]}]
- id: gone
  patterns: [{pattern-not: x}]
"""
    rules = L.yaml_rules(text)
    assert [(r.id, type(r.matcher)) for r in rules] == [("p", TextRegex), ("r", TextRegex), ("m", TextRegexMulti), ("t", Taint)]
    assert rules[0].matcher.call == "os.system" and rules[0].languages == ("python",) and rules[1].severity == "MEDIUM"
    m = rules[2].matcher
    assert m.deny and len(m.inside) == 1 and r"\d+" in m.allow[0].regex
    assert rules[3].matcher.sinks[0].focus == (1,)


def test_errors(tmp_path):
    with pytest.raises(L.RuleError, match="unknown severity"):
        L.yaml_rules("id: a\nseverity: BOGUS\npattern: x\n")
    with pytest.raises(L.RuleError):
        L.yaml_rules("id: a\npattern-regex: '('\n")
    (tmp_path / "a.yaml").write_text("id: a\npattern: x\n")
    (tmp_path / "b.yaml").write_text("id: a\npattern: y\n")
    with pytest.raises(L.RuleError, match="duplicate"):
        L.load_rules(str(tmp_path))
    assert [e for _, e in L.verify(str(tmp_path))] == ["duplicate rule id: a"]
    (tmp_path / "c.wasm").write_bytes(b"\0asm" + b"\0" * 8)
    (tmp_path / "c.wasm.json").write_text(json.dumps({"id": "c", "severity": "LOW"}))
    (tmp_path / "b.yaml").unlink()
    assert [r.id for r in L.load_rules(str(tmp_path)).rules] == ["a", "c"]
    with pytest.raises(L.RuleError):
        L.check_wasm(b"notwasm!")


def test_sets(spark):
    rules = RuleSet(L.yaml_rules("- {id: a, pattern: x, languages: [Go]}\n- {id: b, pattern: y}\n"))
    assert [r.id for r in rules.for_types({"python"}).rules] == ["b"]
    assert rules.fingerprint() == RuleSet(rules.rules[::-1]).fingerprint() != RuleSet(rules.rules[:1]).fingerprint()
    assert rules.frame(spark).count() == 2
