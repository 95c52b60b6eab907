"""A consumer of tool events that applies each batch once: surprises become memories, sessions their counts.

Spark gives a batch the same number and the same rows whenever it is tried. What a batch makes is written to a folder of that number and replaces what an earlier try left
there, so a batch that failed half-way, or is replayed after it was done, leaves the same tables. Session figures are kept as what each batch adds (counts and the
last instant), which is small, needs no table to be rewritten, and is summed when it is read; compact() folds the older batches into one table.

Cases: events without a session count under null; an event that is delivered in two batches is counted in both, as they are different deliveries, but its memory has one id and is read once; an
empty batch writes an empty folder; nothing was consumed: the tables are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallsmith.streaming import events as streams

#: Bytes of events, as Catalyst estimates them, that make a file of a batch.
FILE_BYTES = 8 << 20
_MEMORIES = "id string, event_id long, created_at timestamp, text string, batch long"
_SESSIONS = "session_id long, n long, errors long, last_event_at timestamp, batch long"


class Consumer:
    """The tables below a path in shared storage: memories and sessions, in folders by batch."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.5) -> None:
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold

    def apply(self, batch: DataFrame, number: int) -> None:
        """Write what one batch of events (event_id, session_id, created_at, event_type, args) makes, in the place of an earlier try."""
        gated = streams.surprises(streams.surprise_gate(batch, self.threshold))
        new = gated.select(F.concat(F.lit("e_"), F.col("event_id").cast("string")).alias("id"), "event_id", "created_at", "text")
        new.write.mode("overwrite").parquet(f"{self.path}/memories/batch={number}")
        errors = F.count_if(F.lower("event_type").contains("error"))
        added = batch.groupBy("session_id").agg(F.count("*").alias("n"), errors.alias("errors"), F.max("created_at").alias("last_event_at"))
        added.write.mode("overwrite").parquet(f"{self.path}/sessions/batch={number}")

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Consume what a stream of events has now."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def memories(self) -> DataFrame:
        """(id, event_id, created_at, text), each id once, as the first batch that has it tells it."""
        rows = self._read("memories", _MEMORIES)
        first = rows.groupBy("id").agg(F.min(F.struct("batch", "event_id", "created_at", "text")).alias("x"))
        return first.select("id", "x.event_id", "x.created_at", "x.text")

    def _folded(self) -> int | None:
        """The batch up to which session figures are folded."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.path}/folded")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(p.getName()[4:]) for p in done if p.getName().startswith("upto") and fs.exists(path(p, "_SUCCESS"))), default=None)

    def _added(self) -> DataFrame:
        """The session figures that are to be summed: those folded last, and those of later batches."""
        rows, upto = self._read("sessions", _SESSIONS), self._folded()
        if upto is None:
            return rows
        folded = self.spark.read.schema(_SESSIONS.rsplit(",", 1)[0]).parquet(f"{self.path}/folded/upto{upto}")
        return rows.where(F.col("batch") > upto).unionByName(folded.withColumn("batch", F.lit(upto).cast("long")))

    def sessions(self) -> DataFrame:
        """(session_id, n, errors, last_event_at) over all batches."""
        return self._added().groupBy("session_id").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.max("last_event_at").alias("last_event_at"))

    def compact(self, upto: int) -> None:
        """Fold the session figures of all batches up to one into one table, which readers take in their place as soon as it is complete.

        Batches up to it must be done, and are not replayed after this.
        """
        before = self._folded()
        if before is not None and upto <= before:
            return
        summed = self._added().where(F.col("batch") <= upto).groupBy("session_id").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.max("last_event_at").alias("last_event_at"))
        summed.write.mode("overwrite").parquet(f"{self.path}/folded/upto{upto}")


def in_files(events: DataFrame, path: str, files: int = 4) -> DataFrame:
    """The events as a stream of `files` batches: they are dealt by their ids to as many files, or, where a batch has many bytes, to some of them for each batch,
    so that all cores read it and none reads a long file.
    """
    spark = events.sparkSession
    size = int(str(events._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = max(1, -(-size // (files * FILE_BYTES)))
    events.repartition(files * each, "event_id").write.mode("overwrite").parquet(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    written = sum(f.getPath().getName().startswith("part-") for f in found)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, -(-written // files))).parquet(path)
