import random
from collections import defaultdict

from pyspark.sql import functions as F

from recallsmith.operators import graph_lane

EDGES = "subject string, predicate string, object string, valid_to string, source_closet string, confidence double"


def plain(edges, seeds, depth, fan_out):
    best = {}
    for s, p, o, end, mem, c in edges:
        if end is None and s is not None and o is not None and s != o:
            for n, m in ((s, o), (o, s)):
                best[n, m, p, mem] = max(best.get((n, m, p, mem), 0.0), c or 0.0)
    ways = defaultdict(list)
    for (n, m, p, mem), c in best.items():
        ways[n].append((-c, m, p, mem is not None, mem or "", mem))
    seen, start, out = set(seeds), set(seeds), []
    for hop in range(1, depth + 1):
        got = [(hop, n, m, p, mem, -c) for n in start for c, m, p, _, _, mem in sorted(w for w in ways[n] if w[1] not in seen)[:fan_out]]
        out += got
        start = {x[2] for x in got}
        seen |= start
    return sorted(out, key=repr)


def test_walk_equals_plain_search(spark, tmp_path):
    rng = random.Random(3)
    name = lambda: None if rng.random() < 0.03 else "hub" if rng.random() < 0.3 else f"e{rng.randrange(120)}"
    edges = [(name(), f"p{rng.randrange(3)}", name(), "2024" if rng.random() < 0.1 else None, None if rng.random() < 0.2 else f"m{rng.randrange(40)}", rng.choice([None, 0.5, 0.9, 1.0])) for _ in range(1500)]
    edges += edges[:50] + [("a", "p", "a", None, "m1", 1.0)]
    t = spark.createDataFrame(edges, EDGES).withColumn("n", F.lit("clash")).withColumn("id", F.lit(1))
    for k, (seeds, depth, fan_out) in enumerate([(["e1"], 3, 4), (["hub", "e2", "none", None], 2, 7), (["none"], 3, 5), ([], 3, 5)]):
        s = spark.createDataFrame([(x,) for x in seeds], "id string")
        got = sorted((tuple(r) for r in graph_lane.walk(t, s, f"file://{tmp_path}/{k}", depth, fan_out).collect()), key=repr)
        assert got == plain(edges, [x for x in seeds if x], depth, fan_out)
    assert graph_lane.walk(t.limit(0), spark.createDataFrame([("e1",)], "id string"), f"file://{tmp_path}/none").count() == 0


def test_lane_scores_and_hub(spark, tmp_path):
    edges = [("q", "p", "hub", None, "m0", 1.0)] + [("hub", "p", f"x{i:05d}", None, f"m{i}", 1.0 if i < 3 else 0.5) for i in range(20_000)] + [("x00001", "p", "far", None, "m7", 0.8)]
    t = spark.createDataFrame(edges, EDGES)
    memories = spark.createDataFrame([(f"m{i}",) for i in range(8)], "id string")
    got = graph_lane.lane_graph(memories, t, spark.createDataFrame([("q",)], "id string"), f"file://{tmp_path}/hub", 3, 0.5, 5).collect()
    assert [(r.id, r.score, r["rank"]) for r in got] == [("m0", 1.5, 1), ("m1", 0.5, 2), ("m2", 0.5, 3), ("m3", 0.25, 4), ("m4", 0.25, 5), ("m7", 0.2, 6)]
    walked = graph_lane.walk(t, spark.createDataFrame([("hub",)], "id string"), f"file://{tmp_path}/plan", 1, 5)
    assert walked.count() == 5
