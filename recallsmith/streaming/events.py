"""Event streams: surprise gates, windows, sessions, checkpoints. Each takes a streaming or a batch frame.

Events have (event_id, session_id, created_at timestamp, event_type, args).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallsmith.functions import text


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return logical(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def logical(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_type", F.col("props").alias("args"))


def lower_event(events: DataFrame) -> Column:
    """The default prediction: what happens is the event itself, in lower case."""
    return F.lower("event_type")


def surprise_gate(events: DataFrame, threshold: float = 0.5, predict: Callable[[DataFrame], Column] = lower_event, forced: Column | None = None) -> DataFrame:
    """Each event with what was expected, its prediction error and tier: surprising or forced ones are kept as semantic, the others are working memory.

    What happened is the event with its arguments; an event without arguments is only predicted and has neither error nor tier.
    """
    actual = F.when(F.col("args").isNotNull(), F.concat_ws(" ", "event_type", "args"))
    rows = events.withColumn("expected", predict(events)).withColumn("error", F.round(F.when(actual.isNotNull(), text.prediction_error(F.col("expected"), actual)), 6))
    keep = (F.col("error") > threshold) | (forced if forced is not None else F.lit(False))
    return rows.withColumn("tier", F.when(F.col("error").isNotNull(), F.when(keep, "semantic").otherwise("working")))


def surprises(gated: DataFrame) -> DataFrame:
    """(event_id, text) of what a gate keeps, as new memories."""
    told = F.format_string("[SURPRISE] %s | Expected: %s | Actual: %s | Error: %s", F.col("event_type"), F.col("expected"), F.concat_ws(" ", "event_type", "args"), F.round("error", 3).cast("string"))
    return gated.where("tier = 'semantic'").select("event_id", "created_at", told.alias("text"))


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of tool events to a log below a path in shared storage, once each; sessions' last events follow by event_counts()."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped by a stream."""
    w = events.withWatermark("created_at", late).groupBy(F.window("created_at", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Session windows of each key."""
    w = events.withWatermark("created_at", late).groupBy("session_id", F.session_window("created_at", gap)).agg(F.count("*").alias("n"))
    return w.select("session_id", F.col("session_window.start").alias("start"), "n")


def debounce(changes: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """The last content of each burst of changes (key, created_at, content)."""
    w = changes.withWatermark("created_at", late).groupBy("key", F.session_window("created_at", gap)).agg(F.max_by("content", "created_at").alias("content"))
    return w.select("key", F.col("session_window.end").alias("settled_at"), "content")


def checkpoint_counter(events: DataFrame, every: int = 25) -> DataFrame:
    """(session_id, ordinal) each time a session's running count, held in state, passes a multiple of `every`."""

    def step(key, batches, state):
        import pandas as pd

        seen = state.get[0] if state.exists else 0
        before = seen
        for pdf in batches:
            seen += len(pdf)
        state.update((seen,))
        due = list(range((before // every + 1) * every, seen + 1, every))
        yield pd.DataFrame({"session_id": [key[0]] * len(due), "ordinal": due})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id long, ordinal long", "n long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it emitted: rows go to Parquet files below a path in shared storage."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def cached(requests: DataFrame, ttl: str = "300 seconds") -> DataFrame:
    """The requests (key, ts) of a stream that a cache must answer anew: those without the same key within the time to live before."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])
