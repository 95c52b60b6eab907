"""Streams with state, fed in several batches and restarted in between, against batch queries."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallsmith.operators import attention, sessions
from recallsmith.streaming import consumer, events, state


def feed(spark, path, batches, columns, build, out):
    """Run a stream over batches of rows, each with a query of its own that starts from the checkpoint; the log it emitted."""
    schema = spark.createDataFrame([], columns).schema
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        stream.writeStream.format("parquet").option("path", f"{path}/{out}").option("checkpointLocation", f"{path}/{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/{out}")


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


CHANGES = "owner string, id string, kind string, content string, importance double, at timestamp"


def test_working_memory_equals_the_batch_query(spark, tmp_path, few_partitions):
    rng = random.Random(1)
    start = pd.Timestamp("2024-01-01")
    rows = [(f"o{rng.randrange(3)}", f"e{i:03}", "put", f"c{i}", rng.choice([0.0, 0.5, 1.0]), (start + pd.Timedelta(milliseconds=97 * i)).to_pydatetime()) for i in range(150)]
    log = feed(spark, f"file://{tmp_path}", [rows[:60], rows[60:70], rows[70:]], CHANGES, lambda s: state.working_memory(s, 10), "memory")
    held = {(r["owner"], r["id"]) for r in state.current(log).collect()}
    every = spark.createDataFrame([(r[0], r[1], r[5], r[4]) for r in rows], "owner string, id string, last_accessed timestamp, importance double")
    assert held == {(r["owner"], r["id"]) for r in attention.working_memory(every, 10).collect()} and len(held) == 30


def test_working_memory_changes_and_restore(spark, tmp_path, few_partitions):
    at = lambda s: pd.Timestamp(f"2024-01-01 00:00:{s:02}").to_pydatetime()
    first = [("a", x, "put", x, None, at(i)) for i, x in enumerate("wxyz")]
    second = [("a", "x", "get", None, None, at(20)), ("a", "q", "get", None, None, at(20)), ("a", "v", "put", "v", 0.1, at(21)), ("a", "z", "remove", None, None, at(22)), (None, "n", "put", "n", 0.5, at(22)), ("a", None, "put", "n", 0.5, at(22)), ("b", "w", "put", "of b", 0.5, at(1))]
    log = feed(spark, f"file://{tmp_path}", [first, second], CHANGES, lambda s: state.working_memory(s, 3), "memory")
    # w went when z came, y when v came, as x was read; z was removed
    assert {(r["owner"], r["id"], r["content"]) for r in state.current(log).collect()} == {("a", "x", "x"), ("a", "v", "v"), ("b", "w", "of b")}
    back = state.restored(state.current(log).where("owner = 'a'"), "c", F.lit("2024-01-02"))
    assert {(r["owner"], r["id"], r["kind"], r["content"]) for r in back.collect()} == {("c", "x", "put", "x"), ("c", "v", "put", "v")}


def test_notifications_expire_by_timers(spark, tmp_path, few_partitions):
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    columns = "owner string, id string, kind string, content string, at timestamp"
    batches = [
        [("a", f"n{i}", "notify", f"t{i}", at(i)) for i in range(5)] + [("b", "n0", "notify", "other", at(0))],
        [("a", "n3", "dismiss", None, at(6)), ("a", "n3", "notify", "again", at(7)), ("a", "gone", "dismiss", None, at(7)), ("a", "n5", "notify", "t5", at(8))],
        [("b", "late", "notify", "x", at(60))],
        [("b", "later", "notify", "y", at(61))],
    ]
    log = feed(spark, f"file://{tmp_path}", batches, columns, lambda s: state.notifications(s, 600, 4, "1 minute"), "notes")
    told = {(r["owner"], r["id"], r["change"]) for r in log.collect()}
    assert {("a", "n0", "evicted"), ("a", "n3", "dismissed"), ("a", "n5", "expired"), ("b", "n0", "expired")} <= told and ("a", "n3", "expired") not in told
    assert {(r["owner"], r["id"]) for r in state.current(log).collect()} == {("b", "late"), ("b", "later")}


def test_consumer_survives_failed_and_replayed_batches(spark, sf, tmp_path):
    source = events.logical(spark.read.parquet(f"{sf}/events.parquet"))
    path = f"file://{tmp_path}/tables"

    class Fails(consumer.Consumer):
        broken, had = True, {}

        def apply(self, batch, number):
            Fails.had[number] = [r[0] for r in batch.select("event_id").collect()]
            if number == 2 and Fails.broken:
                batch.limit(3).select(F.lit("junk").alias("id")).write.mode("overwrite").parquet(f"{self.path}/memories/batch={number}")
                raise RuntimeError("lost in the middle")
            super().apply(batch, number)

    c = Fails(spark, path)
    assert c.sessions().count() == 0 and c.memories().count() == 0
    stream = consumer.in_files(source, f"file://{tmp_path}/in")
    with pytest.raises(Exception, match="lost in the middle"):
        c.start(stream, f"file://{tmp_path}/state").awaitTermination()
    Fails.broken = False
    c.start(stream, f"file://{tmp_path}/state").awaitTermination()
    want = {tuple(r) for r in sessions.event_counts(source.withColumn("is_error", F.col("event_type").contains("error"))).collect()}
    kept = {(f"e_{r['event_id']}", r["text"]) for r in events.surprises(events.surprise_gate(source)).collect()}
    check = lambda: ({tuple(r) for r in c.sessions().collect()} == want, {(r["id"], r["text"]) for r in c.memories().collect()} == kept)
    assert check() == (True, True)
    assert sorted(Fails.had) == [0, 1, 2, 3] and sum(map(len, Fails.had.values())) == source.count()
    for number, ids in list(Fails.had.items())[1:]:  # batches that were done are replayed with the rows they had
        c.apply(source.where(F.col("event_id").isin(ids)), number)
    assert check() == (True, True)
    c.compact(1)
    assert check() == (True, True)
    c.apply(source.where(F.col("event_id").isin(Fails.had[3])), 3)
    c.compact(3)
    assert check() == (True, True)
    c.compact(3)
    assert check() == (True, True)
