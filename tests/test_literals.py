"""Rules by their literals against the same rules one by one."""

import random
import re

from sieveflow.operators import literals as L
from sieveflow.operators import text
from sieveflow.rules.model import Rule, TextRegex
from sieveflow.sources import corpus


def test_required():
    cases = {
        "eval\\(": ("eval(",), "a.*system\\(x": ("system(x",), "(foo|barbar)+x?": ("foo", "barbar"), "(foo|b)": (), "(?i)foo": (), "(?:abcd)?ef": (), "(?:abcd){2}": ("abcd",),
        "x*yes\\.no[ab]": ("yes.no",), "\\Qab\\E": (), "\\p{L}abc": (), "[abc]+": (), "": (), "ab": (), "(?x) a b c d": (), "foo(?!bar)": ("foo",), "(?=abcd)xyz": ("xyz",), "\\vabc": (), "a(bcd(efgh)i)": ("efgh",),
    }
    for pattern, want in cases.items():
        assert L.required(pattern) == want, pattern
    rng = random.Random(3)
    for _ in range(500):  # whatever matches holds one of them
        pattern = "".join(rng.choice(["abc", "bcd", "(abc|cde)", "x?", ".", "[ab]", "(?:abcd)+", "\\.", "d*", "^", "(abc)?"]) for _ in range(rng.randrange(1, 5)))
        line = "".join(rng.choice("abcdex.") for _ in range(rng.randrange(30)))
        if (need := L.required(pattern)) and re.search(pattern, line):
            assert any(x in line for x in need)


def test_many_rules_find_what_each_finds(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    patterns = [f"{w}\\b" for w in words] + ["^end", "(alpha|beta)[0-9]+$", "é+x", "(?i)MiXed", "[0-9]{3}", "日本語", "tail\\s*$"]
    rules = [(i + 5, Rule(f"r{i}", TextRegex(p), languages=("python",) if i % 7 == 0 else ("generic",))) for i, p in enumerate(patterns)]
    sep = ["\n", "\r\n", "\n\n"]
    files = {f"f{k}.{'py' if k % 2 else 'txt'}": "".join(" ".join(rng.choice([*words, "alpha12", "end", "éx", "mixed", "日本語", "123", "tail "]) for _ in range(6)) + rng.choice(sep) for _ in range(rng.randrange(30))) for k in range(20)}
    files |= {"empty.py": "", "one.py": "word7", "cr.py": "word7\rword8\r\n"}
    df = corpus.from_strings(spark, files)
    assert len(L.literal_rules(rules)[0]) >= L.MANY
    got = sorted(tuple(r) for r in text.line_hits(df, rules).collect())
    assert "MapInArrow" in text.line_hits(df, rules)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(L, "MANY", 10_000)
    assert got == sorted(tuple(r) for r in text.line_hits(df, rules).collect()) and len(got) > 500
