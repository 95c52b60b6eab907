from datetime import datetime

import pytest

from recallsmith.operators import graph, retrieval
from recallsmith.plans import sql_surface

LANES = "query_id int, id string, lane string, rank int, extra string"


@pytest.fixture(scope="module")
def store(spark):
    texts = [None, "", *(f"Alpha beta{i % 7} gamma" * (i % 4) + f" delta {i}" for i in range(60)), "alphabet", "it's"]
    m = spark.createDataFrame([(f"m{i}", t, ["semantic", "episodic", "working", "odd", None][i % 5], None if i == 9 else datetime(2024, 1, 1 + i % 28), "x") for i, t in enumerate(texts)], "id string, text string, tier string, created_at timestamp, r string").coalesce(1)
    t = spark.createDataFrame([("old_tom's", "p", "b", None, None, 1.0), ("b", "q", "old_toms", "2024-01-01", None, 0.5), ("old_toms", "r", "c", "2023", "2024-01-15", 1.0)], "subject string, predicate string, object string, valid_from string, valid_to string, confidence double").coalesce(1)
    sql_surface.register(spark, m, t)
    return m, t


@pytest.mark.parametrize("query", ["alpha delta", "BETA3, gamma 17", "none such", "it"])
def test_hybrid_search_equals_builder(spark, store, query):
    got = spark.sql(f"SELECT * FROM hybrid_search('{query}', TIMESTAMP '2024-02-01 00:00:00', 20) ORDER BY score DESC, id")
    want = retrieval.search(store[0], query, "2024-02-01 00:00:00")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_lanes_and_edges_equal_builders(spark, store):
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    m, t = store
    lane = spark.sql("SELECT * FROM recency_lane(5)")
    assert rows(lane) == rows(retrieval.lane_recency(m, 5)) and "TakeOrderedAndProject" in lane._jdf.queryExecution().executedPlan().toString()
    assert rows(spark.sql("SELECT * FROM kg_as_of('2024-01-10')")) == rows(t.where(graph.valid_at("2024-01-10")))
    assert [r["direction"] for r in spark.sql("SELECT * FROM kg_entity('Old Tom''s')").collect()] == ["in"]


def test_fusion_of_many_queries(spark, store):
    rows = [(q, f"d{(q * 3 + r * s) % 11}", lane, r, "x") for q in range(6) for s, lane in ((1, "fts"), (3, "dense"), (2, "unused")) for r in range(1, 9)]
    rows += [(None, "a", "fts", 1, "x"), (1, None, "fts", 2, "x"), (1, "d1", None, 2, "x"), (1, "d1", "fts", None, "x"), (2, "d2", "fts", 4, "x")]
    frame = spark.createDataFrame(rows, LANES)
    frame.createOrReplaceTempView("lanes_t")
    got = spark.sql("SELECT * FROM rrf_fuse(TABLE(lanes_t), weights => 'fts=1, dense = 0.5', top => 6)").collect()
    for q in (*range(6), None):
        score = {}
        for query, i, lane, r, _ in rows:
            if query == q and None not in (i, r) and lane in ("fts", "dense"):
                score[i] = score.get(i, 0) + {"fts": 1, "dense": 0.5}[lane] / (60 + r)
        want = sorted(((i, round(s, 9)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:6]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1)) and [(r["id"], pytest.approx(r["score"], abs=2e-9)) for r in mine] == want
    assert spark.sql("SELECT * FROM rrf_fuse(TABLE(SELECT * FROM lanes_t WHERE false), weights => 'fts=1')").count() == 0


@pytest.mark.parametrize("call", ["TABLE(SELECT 1 AS id), weights => 'a=1'", "TABLE(SELECT 1 AS query_id, 'a' AS id, 'l' AS lane, 1 AS rank), weights => 'a'", "TABLE(SELECT 1 AS query_id, 'a' AS id, 'l' AS lane, 1 AS rank)", "TABLE(SELECT 1 AS query_id, 'a' AS id, 'l' AS lane, 1 AS rank), weights => 'l=1', other => 2"])
def test_wrong_calls_are_errors(spark, store, call):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM rrf_fuse({call})").collect()
