"""For each language a rule document, a file that breaks it and one that doesn't, told together."""

import textwrap

import pytest

from sieveflow import engine
from sieveflow.rules import load
from sieveflow.rules.model import RuleSet
from sieveflow.sources import corpus

#: name: (rules, file, text, lines found, a text without findings)
CASES = {
    "python-call": (
        "rules:\n- {id: shell, pattern: 'os.system($CMD)', languages: [python], severity: HIGH, message: m}\n",
        "a.py", "import os\nos.system(cmd)\nprint(1)\nos.system('ls ' + x)\n", [2, 4], "import os\nos.getcwd()\n# nothing\n",
    ),
    "python-ellipsis": (
        "rules:\n- {id: shell, pattern: 'subprocess.run(..., shell=True)', languages: [python], severity: HIGH, message: m}\n",
        "a.py", "import subprocess\nsubprocess.run(cmd, shell=True)\nsubprocess.run(cmd)\n", [2], "import subprocess\nsubprocess.run(cmd, shell=False)\n",
    ),
    "python-either-not": (
        "rules:\n- id: load\n  languages: [python]\n  severity: MEDIUM\n  message: m\n  patterns:\n  - pattern-either:\n    - pattern: yaml.load($X)\n    - pattern: pickle.loads($X)\n  - pattern-not: pickle.loads(trusted)\n",
        "a.py", "yaml.load(x)\npickle.loads(y)\npickle.loads(trusted)\n", [1, 2], "yaml.safe_load(x)\npickle.loads(trusted)\n",
    ),
    "python-taint": (
        "rules:\n- id: flow\n  mode: taint\n  languages: [python]\n  severity: HIGH\n  message: m\n  pattern-sources:\n  - pattern: input()\n  pattern-sinks:\n  - pattern: subprocess.run($X)\n",
        "a.py", "import subprocess\nu = input()\nv = u\nsubprocess.run(v)\n", [4], "import subprocess\nu = input()\nv = 'fixed'\nsubprocess.run('ls')\n".replace("u = input()\n", ""),
    ),
    "javascript-regex": (
        "rules:\n- {id: eval, pattern-regex: '\\beval\\s*\\(', languages: [javascript], severity: HIGH, message: m}\n",
        "a.js", "const a = 1;\neval(a);\nmedieval(a);\n", [2], "const evaluate = (x) => x;\nevaluate(1);\n",
    ),
    "typescript-call": (
        "rules:\n- {id: html, pattern: 'document.write($X)', languages: [typescript], severity: MEDIUM, message: m}\n",
        "a.ts", "function f(x: string): void {\n  document.write(x);\n}\n", [2], "function f(x: string): void {\n  console.log(x);\n}\n",
    ),
    "java-call": (
        "rules:\n- {id: exec, pattern: 'Runtime.getRuntime().exec($X)', languages: [java], severity: HIGH, message: m}\n",
        "A.java", "class A {\n  void f(String c) {\n    Runtime.getRuntime().exec(c);\n  }\n}\n", [3], "class A {\n  void f(String c) {\n    System.out.println(c);\n  }\n}\n",
    ),
    "php-taint": (
        "rules:\n- id: xss\n  mode: taint\n  languages: [php]\n  severity: HIGH\n  message: m\n  pattern-sources:\n  - pattern: $_GET[$K]\n  pattern-sinks:\n  - pattern: system($X)\n",
        "a.php", "<?php\n$a = $_GET['q'];\nsystem($a);\n", [3], "<?php\n$a = 'fixed';\nsystem($a);\n",
    ),
    "rust-regex": (
        "rules:\n- {id: unsafe, pattern-regex: '\\bunsafe\\s*\\{', languages: [rust], severity: LOW, message: m}\n",
        "a.rs", "fn main() {\n    unsafe { work() }\n}\n", [2], "fn main() {\n    work()\n}\n",
    ),
    "go-call": (
        "rules:\n- {id: md5, pattern: 'md5.New()', languages: [go], severity: LOW, message: m}\n",
        "a.go", "package main\nfunc f() {\n\th := md5.New()\n}\n", [3], "package main\nfunc f() {\n\th := sha256.New()\n}\n",
    ),
    "dockerfile-regex": (
        "rules:\n- {id: root, pattern-regex: '^USER\\s+root\\s*$', languages: [dockerfile], severity: MEDIUM, message: m}\n",
        "Dockerfile", "FROM alpine\nUSER root\n", [2], "FROM alpine\nUSER app\n",
    ),
    "yaml-regex-inside": (
        "rules:\n- {id: privileged, pattern-regex: 'privileged:\\s*true', languages: [yaml], severity: HIGH, message: m}\n",
        "a.yaml", "spec:\n  securityContext:\n    privileged: true\n", [3], "spec:\n  securityContext:\n    privileged: false\n",
    ),
    "terraform-regex": (
        "rules:\n- {id: open, pattern-regex: '0\\.0\\.0\\.0/0', languages: [hcl], severity: HIGH, message: m}\n",
        "a.tf", 'resource "x" "y" {\n  cidr_blocks = ["0.0.0.0/0"]\n}\n', [2], 'resource "x" "y" {\n  cidr_blocks = ["10.0.0.0/8"]\n}\n',
    ),
    "ruby-call": (
        "rules:\n- {id: open, pattern: 'Marshal.load($X)', languages: [ruby], severity: HIGH, message: m}\n",
        "a.rb", "def f(x)\n  Marshal.load(x)\nend\n", [2], "def f(x)\n  JSON.parse(x)\nend\n",
    ),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    rules, file, bad, lines, good = CASES[name]
    found = engine.analyze(corpus.from_strings(spark, {f"bad/{file}": bad, f"good/{file}": good}), RuleSet(load.yaml_rules(textwrap.dedent(rules))))
    assert sorted((r.file, r.line) for r in found.collect()) == [(f"bad/{file}", n) for n in lines]
