import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recallsmith.functions.text import COVERAGE_MARKS, COVERAGE_STOPWORDS
from recallsmith.operators import partials, quality
from recallsmith.operators.partials import Partials

AS_OF, LOG = "2024-02-01 00:00:00", "source_count long"
MEMORIES = "id string, text string, created_at timestamp, day string"
META = "id string, is_deleted boolean, last_accessed_at timestamp"


def store(seed, rows=160):
    """Rows of memories and meta: nulls, empty and long texts, repeated ids, no instants, marks."""
    from datetime import datetime

    r = random.Random(seed)
    common = [f"word{i:03d}" for i in range(40)]
    texts = [" ".join(r.choices(common, [1 / (i + 1) for i in range(40)], k=r.randrange(0, 25))) + r.choice(["", " The (Zürich), 'x'", "\tand\n"]) for _ in range(rows)]
    texts[:3] = None, "", "long " * 30_000
    m = [(None if i == 5 else f"m{i % (rows - 3)}", t, None if i % 50 == 7 else datetime(2024, 1, 1 + r.randrange(6), r.randrange(24)), "x") for i, t in enumerate(texts)]
    return m, [(f"m{i}", i % 7 == 3, None if i % 3 else datetime(2024, 1, 1 + i % 5, 10)) for i in range(rows - 3)]


def expected(m, x, merges):
    """(words in order of their counts, live memories, health) by plain Python."""
    of = {i: at for i, gone, at in x if not gone}
    live = [(t, of[i]) for i, t, *_ in m if i in of]
    words = Counter(w for t, _ in live for w in (v.strip(COVERAGE_MARKS).strip() for v in (t or "").lower().split()) if len(w) > 2 and w not in COVERAGE_STOPWORDS)
    n = len(live)
    fresh = sum(at is not None and at.day >= 2 for _, at in live)
    covered = min(len(words) / max(n, 1) * 50, 100)
    score = (fresh / n * 30 + round(covered, 1) * 0.25 + 20 + (100 - 2 * merges) * 0.25) if n else 0
    return sorted(words.items(), key=lambda w: (-w[1], w[0])), n, score


def same(p, m, x, log, ks=(3, 500)):
    words, n, score = expected(m, x, log.count())
    got = p.health(log, AS_OF).crossJoin(p.coverage().select("estimated_topics")).first()
    assert (got["total_memories"], got["estimated_topics"]) == (n, len(words)) and abs(got["health_score"] - score) <= 0.51
    for k in ks:
        assert [tuple(r) for r in p.top_words(k).collect()] == words[:k]


def test_equal_reports_over_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(partials, "HEAD", 4)
    m, x = store(1)
    frame = lambda m, x: (spark.createDataFrame(m, MEMORIES).coalesce(1), spark.createDataFrame(x, META).coalesce(1))
    log = spark.createDataFrame([(2,), (3,)], LOG)
    p = Partials(spark, f"file://{tmp_path}/p")
    early = [r for r in m if r[2] is not None and r[2].day < 4]
    p.refresh(*frame(early, x))
    same(p, early, x, log)
    new = spark.sql("SELECT explode(array(DATE '2024-01-04', DATE '2024-01-05', DATE '2024-01-06', NULL)) AS day")
    p.refresh(*frame(m, x), new)
    same(p, m, x, log)
    # a day's memories are deleted: that day is counted anew from its rows alone
    third = {r[0] for r in m if r[2] is not None and r[2].day == 3 and r[0] is not None}
    rest = [(i, gone or i in third, at) for i, gone, at in x]
    m2 = [r for r in m if r[0] not in third]
    p.refresh(*frame([r for r in m if r[2] is not None and r[2].day == 3], rest), spark.sql("SELECT DATE '2024-01-03' AS day"))
    monkeypatch.setattr(partials, "MOST_DAYS", 0)
    monkeypatch.setattr(partials, "MOST_LITERALS", 0)
    same(p, m2 + [r for r in m if r[0] in third and (r[2] is None or r[2].day != 3)], x, log, (3,))
    p.merge()
    assert len(p.manifest.rows()) == 1
    # a whole refresh counts days that hold nothing any more as nothing
    last = [r for r in m2 if r[2] is not None and r[2].day == 6]
    p.refresh(*frame(last, x))
    same(p, last, x, log, (3,))


def test_bound_of_the_sketches_and_what_is_read(spark, tmp_path):
    """A thousand distinct words a day, half of them those of the day before: within four standard errors."""
    memories = spark.range(0, 40, 1, 2).select(F.col("id").cast("string").alias("id"), F.expr("array_join(transform(sequence(1, 1000), i -> concat('term', i + 500 * id)), ' ')").alias("text"), F.expr("timestamp '2024-01-01' + make_dt_interval(cast(id AS int))").alias("created_at"))
    meta = memories.select("id", F.lit(False).alias("is_deleted"), F.lit(None).cast("timestamp").alias("last_accessed_at"))
    p = Partials(spark, f"file://{tmp_path}/p")
    p.refresh(memories, meta)
    exact, near = p.coverage().first()["estimated_topics"], p.coverage(exact=False).first()["estimated_topics"]
    assert exact == 20_500 and abs(near / exact - 1) <= 4 * 1.04 / 2 ** (partials.SKETCH / 2)
    plan = lambda df: df._jdf.queryExecution().toString()
    health = plan(p.health(spark.createDataFrame([], LOG), AS_OF, exact=False))
    assert "/words" not in health and "text#" not in health


def test_few_words_reach_the_scan(spark, tmp_path):
    p = Partials(spark, f"file://{tmp_path}/p")
    m, x = store(3)
    p.refresh(spark.createDataFrame(m, MEMORIES).coalesce(1), spark.createDataFrame(x, META).coalesce(1))
    assert "In(word" in p.top_words(5)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("exact", [True, False])
def test_empty_store(spark, tmp_path, exact):
    p = Partials(spark, f"file://{tmp_path}/p")
    if exact:
        p.refresh(spark.createDataFrame([], MEMORIES), spark.createDataFrame([], META))
    assert [tuple(r) for r in p.coverage(exact).collect()] == [(0, 0, 0.0)]
    assert p.top_words().count() == 0 and p.health(spark.createDataFrame([], LOG), AS_OF, exact).first()[0] == 0


def test_report_counts_words_once(spark):
    m, x = store(4, 20)
    report = quality.quality_report(spark.createDataFrame(m, MEMORIES), spark.createDataFrame(x, META).withColumn("hit_count", F.lit(0)), spark.createDataFrame([], LOG), AS_OF)
    report.collect()
    assert "ReusedExchange" in report._jdf.queryExecution().executedPlan().toString()
