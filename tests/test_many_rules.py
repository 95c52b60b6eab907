import re

import pytest

from recallsmith.operators import many_rules

RULES = "rule_id string, glob string, pattern string, severity string, message string"


@pytest.mark.parametrize("pattern, words", [
    (r"\bTODO\b", {"todo"}), (r"(?i)(token|password)\s*=", {"token", "password"}), (r"a+\d", set()), (r"(?:abcd)?x{2}", set()), (r"(abc|d)e", set()),
    (r"call\(|exec\(", {"call(", "exec("}), (r"(foo){1,3}bars", {"bars"}), (r"(?=look)abc", {"abc"}), (r"(?!never)", set()), (r"[abc]def", {"def"}), (r"étude", {"tude"}),
])
def test_required_words(pattern, words):
    assert many_rules.required(pattern) == words


def test_equals_every_rule_on_every_file(spark):
    patterns = [r"\bTODO\b", r"(?i)secret\s*=", r"\d{4}", r"import (os|sys)", r"(?m)^print", r"(?i)KEY|value", r"x.z", r"never there"]
    globs = ["**/*", "**/*.py", "src/*.txt"]
    rules = [(f"r{i}-{j}", g, p, "warn" if i % 2 else None, f"m{i}") for i, p in enumerate(patterns) for j, g in enumerate(globs)] + [(None, "**/*", "x", "a", "b"), ("dup", "**/*", "TODO", "a", "b"), ("dup", "**/*", "TODO", "a", "b")]
    texts = ["TODO 2024", "todo Secret = 1", "import sys\nprint(1)", "rule:allow r0-0 TODO", "xyz KEY", "", None, "word " * 50_000 + "TODO", "été 12345"]
    files = [(p, t) for t in texts for p in ("src/a.txt", "a/b/c.py", None)] + [("src/a.txt", "TODO 2024")]
    from recallsmith.operators.rules import glob_regex

    want = sorted(((p, r[0], r[3], r[4]) for p, t in files for r in rules if None not in (p, t, *r[:3]) and re.match(glob_regex(r[1]), p) and re.search(r[2], t, re.ASCII) and f"rule:allow {r[0]}" not in t), key=repr)
    f = spark.createDataFrame([(p, t, "x") for p, t in files], "path string, content string, rule_id string")
    r = spark.createDataFrame(rules, RULES)
    assert sorted((tuple(x) for x in many_rules.violations(f, r).collect()), key=repr) == want
    assert many_rules.violations(f.limit(0), r).count() == 0 and many_rules.violations(f, r.limit(0)).count() == 0


def test_parts_of_rules_and_plan(spark, monkeypatch):
    f = spark.createDataFrame([(f"f{i}", f"word{i} here and word{i + 1}") for i in range(60)], "path string, content string")
    r = spark.createDataFrame([(f"r{i}", "**/*", rf"\bword{i}\b", "w", "m") for i in range(5000)], RULES)
    whole = many_rules.violations(f, r)
    plan = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert whole.count() == 120 and abs(plan(whole) - plan(many_rules.violations(f, r.limit(3)))) < 50
    monkeypatch.setattr(many_rules, "PART_BYTES", 30_000)
    parts = many_rules.violations(f, r)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_bad_patterns_are_errors(spark):
    f = spark.createDataFrame([("a", "b")], "path string, content string")
    for bad in ("(", "x" * 1025):
        with pytest.raises(ValueError):
            many_rules.violations(f, spark.createDataFrame([("r", "**/*", bad, "w", "m")], RULES))
