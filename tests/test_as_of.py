"""The interval join against valid_at() one day at a time."""

import random

from recallsmith.operators import graph


def test_equals_one_day_at_a_time(spark):
    rng = random.Random(3)
    day = lambda: rng.choice([f"20{rng.randrange(10, 25)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", f"20{rng.randrange(10, 25)}-{rng.randrange(1, 13):02}", f"20{rng.randrange(10, 25)}"])
    facts = [("hot" if i % 2 else f"s{i % 9}", "p", f"o{i}", rng.choice([None, day(), day(), "unknown"]), rng.choice([None, day(), day()])) for i in range(400)] + [(None, "p", "o", None, None)]
    asked = [(rng.choice(["hot", "s0", "s4", "s8", "none"]), day()) for _ in range(120)] + [("hot", None), ("hot", "soon"), (None, "2020-01-01"), ("hot", "2020-05-05"), ("hot", "2020-05-05")]
    t = spark.createDataFrame(facts, "subject string, predicate string, object string, valid_from string, valid_to string")
    i = spark.createDataFrame(asked, "subject string, day string")
    got = [(r["subject"], r["day"], r["object"]) for r in graph.as_of_batch(t, i).collect()]
    valid = lambda f, d: (f[3] is None or f[3] <= d) and (f[4] is None or f[4] >= d)
    want = {(s, d, f[2]) for s, d in asked if s and d and d[0] == "2" for f in facts if f[0] == s and valid(f, d)}
    assert len(got) == len(set(got)) and set(got) == want and want
    assert graph.as_of_batch(t, i.limit(0)).collect() == [] and graph.as_of_batch(t.limit(0), i).collect() == []
    plan = graph.as_of_batch(t, i)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
