"""Places in a text against plain walks over it."""

import random
import time
import warnings

import pytest

from sieveflow import engine
from sieveflow.operators import text as T
from sieveflow.operators.layout import Layout, Ranges
from sieveflow.rules.model import Rule, RuleSet, Scan, TextRegexMulti
from sieveflow.sources import corpus


def block(text, at):
    """Outwards from a place, character by character."""
    depth, i = 0, at - 1
    while i >= 0:
        if text[i] == "}":
            depth += 1
        elif text[i] == "{":
            if depth == 0:
                break
            depth -= 1
        i -= 1
    if i < 0:
        return ""
    depth, j = 0, i
    while j < len(text):
        depth += (text[j] == "{") - (text[j] == "}")
        j += 1
        if depth == 0:
            break
    return text[text.rfind("\n", 0, i) + 1 : j]


def lines_around(text, start, end):
    first = text.rfind("\n", 0, start) + 1
    last = text.find("\n", max(start, end - 1))
    return text[first : last if last >= 0 else len(text)].rstrip("\r\n")


def test_places_blocks_and_ranges():
    rng = random.Random(6)
    for size in (0, 1, 5, 40, 1500):
        for _ in range(30):
            text = "".join(rng.choice("{}{}\n\r aé日💡x") for _ in range(size))
            layout = Layout(text)
            for at in {rng.randrange(size + 1) for _ in range(12)}:
                assert layout.enclosing_block(at) == block(text, at)
                start = text.rfind("\n", 0, at) + 1
                assert layout.place(at) == (text.count("\n", 0, at) + 1, len(text[start:at].encode()) + 1)
                assert layout.line_before(at) == text[start:at]
                end = min(size, at + rng.randrange(1, 9))
                if at < end:
                    assert layout.whole_lines(at, end) == lines_around(text, at, end)
    for _ in range(200):
        spans = [(a, a + rng.randrange(9)) for a in (rng.randrange(30) for _ in range(rng.randrange(6)))]
        one = (a := rng.randrange(30), a + rng.randrange(6))
        assert Ranges(spans).hold(one) == any(a <= one[0] and one[1] <= b for a, b in spans)


@pytest.mark.parametrize("matcher", [
    TextRegexMulti((Scan("hit[0-9]+"),), None, (), (Scan("safe"),)),
    TextRegexMulti((Scan("hit[0-9]+"),), Scan("no"), (Scan(r"use\([^)]*\)"),), (Scan("safe"),)),
])
def test_many_matches_in_linear_time(matcher):
    def took(n):
        text = "all {\n" + "".join(f"b{i} {{ use(hit{i}); }}\n" for i in range(n)) + "}\n" + "é" * 100
        began = time.process_time()
        layout = Layout(text)
        found = [layout.place(a) for a, _ in T.occurrences(matcher, layout, T.Clock(60))]
        assert len(found) == n and found[-1][0] == n + 1
        return time.process_time() - began

    few, many = min(took(5_000) for _ in range(2)), took(80_000)
    assert many < 16 * 4 * max(few, 0.02)


def test_no_finding_is_lost_in_a_file_of_a_thousand_matches(spark):
    files = corpus.from_strings(spark, {"f": "block {\n" + "".join(f"   some words around hit{i} and more of them\n" for i in range(1000)) + "}\n"})
    rule = Rule("b", TextRegexMulti((Scan("hit[0-9]+"),), None, (), (Scan("safe"),)))
    assert engine.analyze(files, RuleSet([rule])).count() == 1000


def test_skipped_rules_are_told_without_being_asked(spark):
    files = corpus.from_strings(spark, {"slow": "x" * 4000, "fast": "xxy"})
    rules = RuleSet([Rule("s", TextRegexMulti((Scan("(x+x+)+y", "source"),)))])
    with pytest.warns(RuntimeWarning, match="1 times a rule was skipped for a file: s in slow"):
        assert [f.file for f in engine.analyze(files, rules, time_limit=0.3).collect()] == ["fast"]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        failed = []
        engine.analyze(files, rules, time_limit=0.3, failed=failed)
    assert engine.rule_errors(failed, rules).count() == 1


def test_all_matches_at_once_are_those_one_by_one():
    """What is told of a text's matches by arrays against looks at single places."""
    rng = random.Random(5)
    some = ["hit[0-9]+", r"(use|skip)\([^)]*\)", r"skip\([^)]*\)", "safe", "aaa", r"saf\b", "a+", "^h", r"h\d$", r"u[^}]*\}", "aa|aaa", "(?i)hit", "[^x]{3,9}"]
    words = ["hit1", "hit22", "h3", "(", ")", "{", "}", "\n", "use(", "skip(", "safe", "aaa", "a", " ", "x"]
    draw = lambda k: tuple(Scan(rng.choice(some), rng.choice(["line", "line", "source"])) for _ in range(k))
    for n in range(800):
        text = "".join(rng.choices([*words, "é" if n % 3 else "y", "\r\n" if n % 5 == 0 else "\n", "\x0b" if n % 11 == 0 else "z"], k=rng.randrange(60))) + "a" * (1100 if n % 50 == 0 else 0)
        m = TextRegexMulti(draw(rng.randrange(1, 3)), (*draw(rng.randrange(2)), None)[0], draw(rng.choice([0, 0, 1])), draw(rng.choice([0, 1, 2])))
        layout, clock = Layout(text), T.Clock(60)
        inside, out = Ranges(T.spans(m.inside, text)), T.not_in_context(m, Layout(text), clock)
        spans = sorted({(at + x.start(), at + x.end()) for s in m.allow for at, x in T.find_all(s, text, clock)})
        want = [(a, b) for a, b in spans if not (m.inside and not inside.hold((a, b)) or out(a, b))]
        found = T.occurrence_table(m, layout, clock)
        assert list(map(tuple, found.tolist())) == want
        if want:
            assert list(zip(*(x.tolist() for x in layout.places(found[:, 0])), strict=True)) == [layout.place(a) for a, _ in want]
            assert [text[a:b].rstrip("\r\n") for a, b in zip(*(x.tolist() for x in layout.bounds(found)), strict=True)] == [lines_around(text, *x) for x in want]
